"""Running sums and numbers in ranges, streams in several arrivals, and the state they keep."""

import random
from collections import defaultdict
from datetime import datetime, timedelta

from proofsieve.operators import evaluate as X
from proofsieve.operators import index as I
from proofsieve.operators import runlog as R
from proofsieve.operators import sentiment as N
from proofsieve.operators.ordered import numbered, running_sum
from proofsieve.streaming import streams as Z


def test_running_sum_with_hot_and_null_groups(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice(["hot"] * 6 + ["a", "b", None]), rng.choice([1, -1, 5, None])) for i in range(3000)]
    df = spark.createDataFrame(rows, "i long, g string, v int").repartition(7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so small a table would be one range
    try:
        got = running_sum(df, "v", ["i"], "s", ["g"])
        ranges = df.repartitionByRange("g", "i").selectExpr("g", "spark_partition_id() p").where("g = 'hot'").distinct().count()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got.columns == ["i", "g", "v", "s"] and ranges > 1  # the hot group isn't in one task
    want, total = {}, defaultdict(int)
    for i, g, v in rows:
        total[g] += v or 0
        want[i] = total[g]
    assert {r.i: r.s for r in got.collect()} == want


def test_running_sum_over_everything_and_nothing(spark):
    rows = [(i, (i * 37) % 101, 1 if i % 3 else -1) for i in range(101)]
    df = spark.createDataFrame(rows, "i int, t int, v int")
    want, total = {}, 0
    for i, _, v in sorted(rows, key=lambda r: r[1]):
        total += v
        want[i] = total
    assert {r.i: r.s for r in running_sum(df, "v", ["t"], "s").collect()} == want
    assert running_sum(df.limit(0), "v", ["t"], "s").collect() == []
    assert running_sum(df.limit(0), "v", ["t"], "s", ["i"]).collect() == []


def test_numbers_in_groups(spark):
    rows = [(f"g{i % 3 if i % 2 else 0}", i) for i in range(500)] + [(None, 7), (None, 3)]
    got = defaultdict(list)
    for r in numbered(spark.createDataFrame(rows, "g string, i int"), ["g"], ["i"], "n").collect():
        got[r.g].append((r.n, r.i))
    for g, pairs in got.items():
        assert sorted(pairs) == list(enumerate(sorted(i for h, i in rows if h == g), 1))


def test_gauge_needs_no_window_over_the_table(spark):
    events = spark.createDataFrame([(i, datetime(2024, 1, 1) + timedelta(seconds=i // 2), 1 if i % 4 else -1) for i in range(200)], "event_id long, ts timestamp, delta int")
    got = R.active_runs(events)
    assert {r.event_id: r.active for r in got.collect()}[199] == 100
    plan = got._jdf.queryExecution().executedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert windows and sum("__part" in line and "windowspecdefinition(__part" in line for line in windows) >= 1  # rows are windowed inside their range


def at(hour, minute=0):
    return datetime(2024, 1, 1, hour, minute)


def test_late_rows_are_left_out_and_windows_come_once(spark, tmp_path):
    lots = [[("a", at(1, 5)), ("a", at(1, 50)), ("a", at(3, 30))], [("a", at(1, 10)), ("a", at(3, 5)), ("a", at(2, 59))], [("a", at(9))]]
    frames = [spark.createDataFrame(x, "k string, ts timestamp") for x in lots]
    got = Z.in_arrivals(spark, frames, lambda s: Z.event_windows(s, "k"), str(tmp_path))
    # 1:10 and 2:59 came after the watermark 3:20 had passed their windows; 3:05 was in time; the window of 9:00 is open.
    assert sorted((r.start.hour, r.n) for r in got.collect()) == [(1, 2), (3, 2)]


def test_sessions_end_after_a_gap(spark, tmp_path):
    lot = [("a", at(1, 0)), ("a", at(1, 20)), ("a", at(1, 49)), ("a", at(3, 0)), ("b", at(1, 0)), ("b", at(9, 0))]
    got = Z.in_arrivals(spark, [spark.createDataFrame(lot, "k string, ts timestamp")], lambda s: Z.session_windows(s, "k"), str(tmp_path))
    assert sorted((r.k, r.start.hour, r.start.minute, r.end.hour, r.end.minute, r.n) for r in got.collect()) == [("a", 1, 0, 2, 19, 3), ("a", 3, 0, 3, 30, 1), ("b", 1, 0, 1, 30, 1)]


def test_state_of_final_runs_is_removed(spark, tmp_path):
    schema = "job_id bigint, status string, ts timestamp, event_id bigint"
    kept, out = [], []

    def run(k, *rows):
        spark.createDataFrame(list(rows), schema).coalesce(1).write.parquet(f"{tmp_path}/in/b{k}")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in/*")
        query = Z.run_to_end(Z.run_states(stream, stale_after_s=86_400, keep_final_s=3600), "update", f"{tmp_path}/cp", lambda df, n: out.extend(sorted(map(tuple, df.select("job_id", "status").collect()))))
        kept.append(query.lastProgress["stateOperators"][0]["numRowsTotal"])

    run(0, *[(j, "completed", at(1), j) for j in range(50)], (100, "running", at(1), 100))
    assert kept[-1] == 51
    run(1, (101, "failed", at(6), 200))  # the watermark passes 2:00
    run(2, (0, "running", at(1, 30), 300), (102, "running", at(6), 201))  # late for a run that has left
    assert kept[-1] == 3 and (0, "running") not in out and not any(s == "stale" for _, s in out)


def test_bootstrap_of_one_metric_by_hand(spark):
    import hashlib

    values = [(f"c{i}", float(i % 5) / 4, 0.5) for i in range(30)]
    pairs = spark.createDataFrame([("m", c, "x", b, a) for c, a, b in values] + [("m", "c0", "y", None, 1.0)], "mode string, case_id string, metric string, baseline double, candidate double")
    means = []
    for b in range(40):
        times = [sum(int.from_bytes(hashlib.md5(f"13:{b // 4}:{c}".encode()).digest()[4 * (b % 4) : 4 * (b % 4) + 4], "big") >= least for least in X.DRAWN) for c, _, _ in values]
        if sum(times):
            means.append(round(sum(t * (a - z) for t, (_, a, z) in zip(times, values, strict=True)) / sum(times), 9))
    means.sort()
    got = X.bootstrap_ci(pairs, samples=40).collect()
    assert [(r.metric, r.ci_low, r.ci_high) for r in got] == [("x", means[int(0.025 * (len(means) - 1))], means[int(0.975 * (len(means) - 1))])]
    assert X.bootstrap_ci(pairs.limit(0)).collect() == []


def test_log_is_compacted_and_goes_on(spark, tmp_path):
    schema = "ticker string, filing_type string, filing_date string, raw_name string, text string"
    index = f"{tmp_path}/index"

    def add(*rows):
        spark.createDataFrame(list(rows), schema).write.mode("append").parquet(f"{tmp_path}/in")
        Z.ingest_stream(Z.stream_of(spark, f"{tmp_path}/in"), index, f"{tmp_path}/checkpoint")

    rows = lambda: sorted((r.document_id[0], r.text) for r in Z.index_of(spark, index).collect())
    add(("A", "10-K", "d1", "Business", "one"), ("B", "10-K", "d2", "Business", "two"))
    add(("A", "10-K", "d1", "Business", "one changed"))
    before = rows()
    assert before == [("A", "one changed"), ("B", "two")] and Z.compact(spark, index) == 1 and rows() == before
    read = [x for x in Z.index_of(spark, index).inputFiles()]
    assert read and all("/base=1/" in x for x in read)  # the log before isn't read any more
    add(("B", "10-K", "d2", "Business", "two changed"), ("C", "10-K", "d3", "Business", "three"))
    assert rows() == [("A", "one changed"), ("B", "two changed"), ("C", "three")]
    (tmp_path / "index" / "base=2").mkdir()  # a compaction that failed before its manifest was written
    assert rows() == [("A", "one changed"), ("B", "two changed"), ("C", "three")]
    assert Z.compact(spark, index) == 2 and Z.compact(spark, index) == 2 and rows() == [("A", "one changed"), ("B", "two changed"), ("C", "three")]


def plain_pieces(text, size, overlap, separators=("\n\n", "\n", ". ", ", ", " ", "")):
    """The recursive splitter with joined texts in place of running lengths."""
    separator = next((s for s in separators if s in text), "")
    rest = separators[separators.index(separator) + 1 :]
    out, held = [], []
    for piece in text.split(separator) if separator else list(text):
        if len(piece) > size and rest:
            out += [separator.join(held).strip(), *plain_pieces(piece, size, overlap, rest)]
            held = []
            continue
        if held and len(separator.join([*held, piece])) > size:
            out.append(separator.join(held).strip())
            while held and (len(separator.join(held)) > overlap or len(separator.join([*held, piece])) > size):
                held = held[1:]
        held.append(piece)
    return [x for x in [*out, separator.join(held).strip()] if x]


def test_recursive_chunks_are_those_of_a_plain_splitter(spark):
    rng = random.Random(9)
    text = lambda n: "".join(rng.choice(["word", "a", "sentence. ", ", ", " ", " ", "\n", "\n\n", "x" * 30, "é", ""]) for _ in range(n))
    rows = [(i, text(rng.randint(0, 120))) for i in range(60)] + [(100, None), (101, ""), (102, "x" * 500), (103, " \n\n "), (104, text(300)), (104, text(300))]
    got = I.chunk_recursive(spark.createDataFrame(rows, "i int, content string"), size=40, overlap=12, most=3)
    assert got.columns == ["i", "content", "chunk_index", "chunk_text"]
    want = sorted((i, t, k, x) for i, t in rows for k, x in enumerate(plain_pieces(t or "", 40, 12)))
    assert sorted((r.i, r.content, r.chunk_index, r.chunk_text) for r in got.collect()) == want
    long = "".join(rng.choice(["lorem ipsum ", "dolor. ", "sit, amet\n", "consectetur\n\n"]) for _ in range(600_000))
    pieces = list(I.recursive_pieces(long, 1000, 200))
    assert len(long) > 5_000_000 and pieces == plain_pieces(long, 1000, 200)
    one_run = list(I.recursive_pieces("y" * 2_000_000, 1000, 200))  # no separator: carried over character by character
    assert {len(x) for x in one_run[:-1]} == {1000} and len(one_run) == 1 + -(-(2_000_000 - 1000) // 800)


def test_hashed_embeddings_are_signed_counts(spark):
    import re
    import struct

    import numpy as np
    import xxhash

    signed = lambda h: h - (1 << 64) if h >> 63 else h
    texts = ["Risk factors, risk AND more 42", "a b a", "", None, "...", "é only e", "word " * 300]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    for r in I.embed_hashed(rows, dim=16).collect():
        v = np.zeros(16)
        for t in re.findall("[a-z0-9]+", (r.text or "").lower()):
            h = xxhash.xxh64_intdigest(t.encode(), 42)
            v[signed(h) % 16] += 1 if signed(xxhash.xxh64_intdigest(struct.pack("<i", 1), h)) % 2 == 0 else -1
        want = v / np.linalg.norm(v) if v.any() else []
        assert np.allclose(r.embedding, want, atol=1e-6) and len(r.embedding) == len(want)


def test_learnt_sentiment_is_naive_bayes(spark):
    import math
    import re
    from collections import Counter

    rng = random.Random(12)
    words = {"positive": ["good", "up"], "negative": ["bad", "down"], "neutral": ["flat"]}
    rows = [(i, c, " ".join(rng.choices([*words[c], "the", "a"], k=rng.randint(1, 8)))) for i, c in enumerate(rng.choices([*words], weights=[5, 3, 2], k=80))]
    rows += [(200, "other", "good good"), (201, None, "bad"), (202, "neutral", None)]
    asked = [(0, "Good, the UP"), (1, "bad a"), (2, "unheard of"), (3, None), (4, ""), (5, "good bad flat " * 50)]
    model = N.learn(spark.createDataFrame(rows, "i int, label string, text string"))
    got = {r.i: (r.label, r.confidence) for r in N.classify_learnt(spark.createDataFrame(asked, "i int, text string"), model, "i").collect()}
    split = lambda t: re.findall("[a-z0-9]+", (t or "").lower())
    known = [(c, split(t)) for _, c, t in rows if c in words]
    counts = {c: Counter(w for k, t in known if k == c for w in t) for c in words}
    v = len(set().union(*counts.values()))
    for i, text in asked:
        score = {c: round(math.log(sum(k == c for k, _ in known) / len(known)) + sum(math.log((counts[c][w] + 1) / (sum(counts[c].values()) + v)) for w in split(text) if any(w in x for x in counts.values())), 9) for c in words}
        best = min(words, key=lambda c: (-score[c], c))
        assert got[i][0] == best and abs(got[i][1] - 1 / sum(math.exp(s - score[best]) for s in score.values())) < 1e-6
    none = N.classify_learnt(spark.createDataFrame(asked[:1], "i int, text string"), N.learn(spark.createDataFrame([], "label string, text string")), "i")
    assert [tuple(r) for r in none.collect()] == [(0, "neutral", None)]
