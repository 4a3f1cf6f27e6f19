"""Sentiment of texts, its summaries, and the forms in which they are reported."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofsieve.functions.text import given, once, runs, tokens
from proofsieve.operators.models import filled, predict
from proofsieve.sources.scratch import written

#: Words of the default scorer; a user's own lists or model replace them.
POSITIVE = ["gain", "gains", "growth", "beat", "strong", "profit", "record", "up", "rise", "good", "best", "improved"]
NEGATIVE = ["loss", "losses", "miss", "weak", "decline", "down", "fall", "risk", "lawsuit", "bad", "worst", "worthless", "pathetic"]


def scores_by_words(text: Column | str, positive: list[str] | None = None, negative: list[str] | None = None) -> Column:
    """Map of positive, negative, neutral: softmax over word counts; neutral stands at 0.5."""
    t = tokens(text)
    count = lambda words: F.size(F.filter(t, lambda x: x.isin(words))).cast("double")
    p, n, z = count(positive or POSITIVE), count(negative or NEGATIVE), F.lit(0.5)
    most = F.greatest(p, n, z)  # taken off first, so that no count is too large for exp
    p, n, z = (F.exp(x - most) for x in (p, n, z))
    return F.create_map(F.lit("positive"), p / (p + n + z), F.lit("negative"), n / (p + n + z), F.lit("neutral"), z / (p + n + z))


def classify(rows: DataFrame, text: str = "text", make: Callable[[], Callable[[list[str]], list[dict[str, float]]]] | None = None, batch_size: int = 16) -> DataFrame:
    """Adds scores, label (the largest, ties by name), confidence and error, by a user's model made once a task, else by word lists. A text that the model fails on has an error and no label."""
    if make is None:
        scored = rows.withColumns({"scores": scores_by_words(text), "error": F.lit(None).cast("string")})
    else:
        scored = predict(rows, lambda: filled(make()), [text], "scores", "map<string,double>", batch_size)
    best = F.array_sort(F.transform(F.map_entries("scores"), lambda e: F.struct((-e["value"]).alias("s"), e["key"].alias("k"))))[0]
    return scored.withColumn("label", best["k"]).withColumn("confidence", -best["s"])


def summary(entities: DataFrame, labelled: DataFrame) -> DataFrame:
    """Counts for each entity and overall_sentiment, by majority of positive and negative, neutral on ties and without articles; blank snippets don't count."""
    count = lambda name: F.count_if(F.col("label") == name).alias(f"{name}_count")
    per = labelled.where(given("snippet").isNotNull()).groupBy("entity_id").agg(*map(count, ("positive", "negative", "neutral")))
    rows = entities.select("entity_id").distinct().join(per, "entity_id", "left").na.fill(0)
    overall = F.when(F.col("positive_count") > F.col("negative_count"), "positive").when(F.col("negative_count") > F.col("positive_count"), "negative").otherwise("neutral")
    return rows.withColumn("overall_sentiment", overall)


def averages(scored: DataFrame) -> DataFrame:
    return scored.groupBy("entity_id").agg(F.avg(F.col("scores")["positive"]).alias("avg_positive"), F.avg(F.col("scores")["negative"]).alias("avg_negative"))


def report_rows(scored: DataFrame, text: str = "text") -> DataFrame:
    """Texts over 100 characters cut to 97 and '...', scores rounded to 4 places."""
    short = F.when(F.length(text) > 100, F.concat(F.substring(text, 1, 97), F.lit("..."))).otherwise(F.col(text))
    return scored.withColumn("shown", short).withColumn("scores", F.transform_values("scores", lambda k, v: F.round(v, 4)))


#: Weights of so many tokens at most, some 30 MB, are sent to every task; more are met by a shuffle.
SENT = 300_000
#: Classes of sentiment; of equal scores the first counts.
CLASSES = ["negative", "neutral", "positive"]


def learn(rows: DataFrame, text: str = "text", label: str = "label") -> tuple[DataFrame, dict[str, float | None]]:
    """(weights, priors) of a multinomial naive Bayes model from labelled texts: a table (token, w_negative, w_neutral, w_positive) and three numbers, all logarithms.

    All counts come from one grouping by token; a class without texts has no prior and is never given. Rows with another label are left out.
    """
    known = rows.where(F.col(label).isin(CLASSES)).select(F.col(label).alias("label"), F.col(text).alias("text"))
    each = known.select("label", F.explode(tokens("text")).alias("token"))
    counts = written(each.groupBy("token").agg(*[F.count_if(F.col("label") == c).alias(c) for c in CLASSES]), "sentiment-counts")
    v, *sizes = counts.agg(F.count("*"), *[F.coalesce(F.sum(c), F.lit(0)) for c in CLASSES]).first()
    weights = counts.select("token", *[F.log((F.col(c) + 1) / F.lit(float(n + v))).alias(f"w_{c}") for c, n in zip(CLASSES, sizes, strict=True)])
    n, *own = known.agg(F.count("*"), *[F.count_if(F.col("label") == c) for c in CLASSES]).first()
    return weights, {c: math.log(x / n) if x else None for c, x in zip(CLASSES, own, strict=True)}


def classify_learnt(rows: DataFrame, model: tuple[DataFrame, dict[str, float | None]], key: str, text: str = "text", digits: int = 9) -> DataFrame:
    """(key, label, confidence) of each row by a model of ``learn``: the class of the largest score and its share of the likelihood. Tokens that the
    model doesn't know are passed over; a text without known tokens is judged by the priors. ``key`` tells rows apart. A model without texts says neutral, with confidence null.

    A text's tokens are counted where it stands, and only its sums leave the task if the weights are few enough to be sent there.
    """
    weights, priors = model
    named = rows.select(F.col(key).alias("__key"), F.col(text).alias("__text"))
    tf = once(F.sort_array(tokens("__text")), lambda t: runs(t, lambda token, n: F.struct(token.alias("token"), n.alias("tf"))))
    each = named.select("__key", F.inline(tf))
    met = each.join(F.broadcast(weights), "token") if weights.count() <= SENT else each.hint("merge").join(weights.hint("merge"), "token")
    sums = met.groupBy("__key").agg(*[F.sum(F.col("tf") * F.col(f"w_{c}")).alias(c) for c in CLASSES])
    both = named.select("__key").distinct().hint("merge").join(sums.hint("merge"), "__key", "left")
    scored = both.select("__key", *[F.round(F.coalesce(c, F.lit(0.0)) + F.lit(priors[c]).cast("double"), digits).alias(c) for c in CLASSES])
    best = F.greatest(*CLASSES)
    label = reduce(lambda rest, c: F.when(F.col(c) == best, c).otherwise(rest), reversed(CLASSES), F.lit("neutral"))
    total = sum([F.coalesce(F.exp(F.col(c) - best), F.lit(0.0)) for c in CLASSES], F.lit(0.0))
    return scored.select(F.col("__key").alias(key), label.alias("label"), F.when(best.isNotNull(), 1 / total).alias("confidence"))
