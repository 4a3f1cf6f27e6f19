"""How far the sources of each language differ in the words they use, exactly, with every text tokenized once.

1. Equal texts of a language are collapsed: a row for each text with the number of times each source has it. Copies are counted where
   they are read, and a text that a task has sent isn't sent again by it.
2. Each distinct text is tokenized once. Its terms, weighted by the sources' numbers, give occurrences and document frequencies of (lang, source, term).
3. A language keeps the terms that ``least_docs`` of its documents have. Each source, and the language, gives each kept term the share
   p = 1 + floor(1e9 * (count + 1) / (N + V)), N its occurrences of kept terms and V the number of these.
4. Pairs of sources are summed over all V terms, but evaluated only where both have a term. Where one or none has it the other's share is
   one number, that of a count of 0, so the rest follows from each source's histogram of shares.

Nulls in text, lang and source count as empty. All arithmetic is on integers: shares by long division in decimals, terms in 64 bits, sums in decimals. The
sources that hold one term are met in one row, and a pair of sources of one language is a row of the result; no text, group of copies or language is.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proofsieve.llm.shared import by_bytes, byte_view, small_batches, stored
from proofsieve.llm.words import LETTER, ranges, runs

#: Distinct texts that a task remembers having sent.
REMEMBERED = 200_000
#: Bytes of distinct texts, rows of sources, and (source, term) pairs that are counted at a time.
BLOCK, ROWS, PAIRS = 16 << 20, 1 << 16, 1 << 22
SCALE = 1_000_000_000


def collapsed(docs: DataFrame) -> DataFrame:
    """(lang, digest, source, n, text) of ``docs`` (lang, source, text): the copies of a text that a task has met, the text itself in one of its rows at least."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[tuple[str, bytes]] = set()
        for batch in batches:
            langs, sources, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)
            at, raw = byte_view(texts)
            view, counts, first = memoryview(raw), {}, {}
            for i, (lang, source) in enumerate(zip(langs, sources, strict=True)):
                key = (lang, hashlib.blake2b(view[at[i] : at[i + 1]], digest_size=16).digest())
                counts[*key, source] = counts.get((*key, source), 0) + 1
                first.setdefault(key, i)
            rows, told = [], set()
            for lang, digest, source in counts:
                key = (lang, digest)
                rows.append(None if key in sent or key in told else first[key])
                told.add(key)
            sent = (sent if len(sent) < REMEMBERED else set()) | told
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in counts], pa.string()), pa.array([k[1] for k in counts], pa.binary()), pa.array([k[2] for k in counts], pa.string()), pa.array(list(counts.values()), pa.int64()), texts.take(pa.array(rows, pa.int64()))],
                names=["lang", "digest", "source", "n", "text"],
            )

    return small_batches(docs).mapInArrow(run, "lang string, digest binary, source string, n long, text string")


def counted(lists: DataFrame) -> DataFrame:
    """(lang, source, term, count, df) from rows of ``collapsed`` that stand by lang and digest, those with the text first; sums are left to be added up."""
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("count", pa.int64()), ("df", pa.int64())])

    def tally(texts: pa.Array, of: np.ndarray, group: np.ndarray, n: np.ndarray, names: list[tuple[str, str]]) -> Iterator[pa.RecordBatch]:
        """Row k: group[k] has the text of[k] n[k] times."""
        sizes, words = runs(*byte_view(texts), LETTER)
        coded = words.dictionary_encode()
        terms = coded.dictionary
        if not len(terms):
            return
        cells, tf = np.unique(np.repeat(np.arange(len(texts)), sizes) * len(terms) + coded.indices.to_numpy(), return_counts=True)
        ends = np.searchsorted(cells // len(terms), np.arange(len(texts) + 1))
        code = cells % len(terms)
        by = np.argsort(group, kind="stable")
        of, group, n = of[by], group[by], n[by]
        wide = np.diff(ends)[of]
        done, at = np.cumsum(wide), 0
        while at < len(of):
            end = max(at + 1, int(np.searchsorted(done, (done[at - 1] if at else 0) + PAIRS, "right")))
            own, many = ranges(ends[of[at:end]], wide[at:end]), np.repeat(n[at:end], wide[at:end])
            key = np.repeat(group[at:end], wide[at:end]) * len(terms) + code[own]
            order = np.argsort(key, kind="stable")
            key = key[order]
            starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
            if len(starts):
                count, df = np.add.reduceat((tf[own] * many)[order], starts), np.add.reduceat(many[order], starts)
                g = key[starts] // len(terms)
                langs, sources = (pa.array([x[i] for x in names], pa.string()).take(pa.array(g)) for i in (0, 1))
                for a in range(0, len(starts), 1 << 16):
                    part = slice(a, a + (1 << 16))
                    yield pa.RecordBatch.from_arrays([langs[part], sources[part], terms.take(pa.array(key[starts][part] % len(terms))).cast(pa.string()), pa.array(count[part]), pa.array(df[part])], schema=schema)
            at = end

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts: list[str] = []
        rows: list[tuple[int, int, int]] = []
        names: dict[tuple[str, str], int] = {}
        held, last = 0, None

        def done() -> Iterator[pa.RecordBatch]:
            of, group, n = (np.array(x, np.int64) for x in zip(*rows, strict=True)) if rows else (np.zeros(0, np.int64),) * 3
            for a, b in by_bytes(pa.array(texts, pa.large_string()), BLOCK):
                mine = (of >= a) & (of < b)
                yield from tally(pa.array(texts[a:b], pa.large_string()), of[mine] - a, group[mine], n[mine], list(names))

        for batch in batches:
            for lang, digest, source, n, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (lang, digest) != last:
                    if held >= BLOCK or len(rows) >= ROWS:
                        yield from done()
                        texts, rows, names, held = [], [], {}, 0
                    last = (lang, digest)
                    texts.append(text)
                    held += len(text)
                elif len(rows) >= ROWS:  # a text with very many sources goes on in another block
                    yield from done()
                    texts, rows, names, held = [texts[-1]], [], {}, len(texts[-1])
                rows.append((len(texts) - 1, names.setdefault((lang, source), len(names)), n))
        yield from done()

    return lists.mapInArrow(run, "lang string, source string, term string, count long, df long")


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, count, df) over all of ``docs`` (lang, source, text): occurrences, and documents that have the term."""
    lists = collapsed(docs).repartition("lang", "digest").sortWithinPartitions("lang", "digest", F.col("text").isNull())
    return counted(lists.select("lang", "digest", "source", "n", "text")).groupBy("lang", "source", "term").agg(F.sum("count").alias("count"), F.sum("df").alias("df"))


def shares(count: str, total: str, kept: str) -> Column:
    """1 + floor(1e9 * (count + 1) / (total + kept)) of three columns, null if ``kept`` is 0."""
    return F.expr(f"1 + (cast({SCALE} as decimal(10,0)) * cast({count} + 1 as decimal(19,0))) div cast(case when {kept} > 0 then {total} + {kept} end as decimal(19,0))")


def gap(p: str, q: str) -> Column:
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div {q}")


def gaps(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def audited(docs: DataFrame, least_docs: int = 3) -> tuple[DataFrame, DataFrame]:
    """(groups, cells): (lang, source, n, v, z) of each source that occurs, z its share of a count of 0, and (lang, source, term, p, q, z) of each kept term that it has, q the language's share."""
    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    counts = stored(term_counts(rows), "divergence-counts")
    kept = counts.groupBy("lang", "term").agg(F.sum("df").alias("df"), F.sum("count").alias("all"), F.collect_list(F.struct("source", "count")).alias("held")).where(F.col("df") >= least_docs)
    kept = stored(kept.select("lang", "term", "all", "held"), "divergence-kept")
    langs = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("all").alias("n_lang"))
    each = kept.select("lang", "term", "all", F.explode("held").alias("h")).select("lang", "term", "all", "h.source", "h.count")
    sums = each.groupBy("lang", "source").agg(F.sum("count").alias("n"))
    groups = rows.select("lang", "source").distinct().hint("merge").join(sums.hint("merge"), ["lang", "source"], "left").hint("merge").join(langs.hint("merge"), "lang", "left")
    groups = groups.fillna(0, ["n", "v", "n_lang"]).withColumn("none", F.lit(0))
    groups = stored(groups.select("lang", "source", "n", "v", "n_lang", shares("none", "n", "v").alias("z")), "divergence-groups")
    cells = each.hint("merge").join(groups.hint("merge"), ["lang", "source"])
    cells = stored(cells.select("lang", "source", "term", shares("count", "n", "v").alias("p"), shares("all", "n_lang", "v").alias("q"), "z"), "divergence-cells")
    return groups, cells


def leading_terms(cells: DataFrame, most: int) -> DataFrame:
    """(lang, source, item, value, rank): the ``most`` terms of each source that it uses more than its language does."""
    rows = cells.where("p > q").select("lang", "source", F.col("term").alias("item"), gap("p", "q").alias("value"))
    nth = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item"))
    return rows.withColumn("rank", nth).where(F.col("rank") <= most)


def met_pairs(cells: DataFrame) -> DataFrame:
    """(lang, source, item, part): for the terms that both sources have, what their sum differs from the one that holds where one or none has it. A task sends a row for each pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, tuple[dict[str, int], dict[tuple[int, int], int]]] = {}
        for batch in batches:
            lists = batch.column(1)
            offsets, fields = lists.offsets.to_numpy(), lists.values.flatten()
            p_all, z_all = fields[1].to_numpy(), fields[2].to_numpy()
            for lang in batch.column(0).unique().to_pylist():
                own = np.flatnonzero(np.array(batch.column(0).to_pylist(), object) == lang)
                places, sums = totals.setdefault(lang, ({}, {}))
                sizes = np.diff(offsets)[own]
                flat = ranges(offsets[own].astype(np.int64), sizes.astype(np.int64))
                if not len(flat):
                    continue
                named = fields[0].take(pa.array(flat)).dictionary_encode()
                code = np.array([places.setdefault(x, len(places)) for x in named.dictionary.to_pylist()], np.int64)[named.indices.to_numpy()]
                p, z, width = p_all[flat], z_all[flat], len(places)
                start, size = np.repeat(np.cumsum(sizes) - sizes, sizes).astype(np.int64), np.repeat(sizes, sizes).astype(np.int64)
                done, at = np.cumsum(size), 0
                while at < len(flat):  # entry k meets the entries of its term
                    end = max(at + 1, int(np.searchsorted(done, (done[at - 1] if at else 0) + PAIRS // 4, "right")))
                    a = np.repeat(np.arange(at, end), size[at:end])
                    b = ranges(start[at:end], size[at:end])
                    a, b = a[a != b], b[a != b]
                    value = gaps(p[a], p[b]) - gaps(p[a], z[b]) - gaps(z[a], p[b]) + gaps(z[a], z[b])
                    pair, index = np.unique(code[a] * width + code[b], return_inverse=True)
                    total = np.zeros(len(pair), np.int64)
                    np.add.at(total, index, value)
                    for x, y in zip(pair.tolist(), total.tolist(), strict=True):
                        sums[divmod(x, width)] = sums.get(divmod(x, width), 0) + y
                    at = end
        for lang, (places, sums) in totals.items():
            names = pa.array(list(places), pa.string())
            if sums:
                a, b = (pa.array([k[i] for k in sums], pa.int64()) for i in (0, 1))
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(sums), pa.string()), names.take(a), names.take(b), pa.array([str(v) for v in sums.values()])], names=["lang", "source", "item", "part"])

    lists = cells.groupBy("lang", "term").agg(F.collect_list(F.struct("source", "p", "z")).alias("held")).where(F.size("held") > 1)
    return lists.select("lang", "held").mapInArrow(run, "lang string, source string, item string, part string").withColumn("part", F.col("part").cast("decimal(38,0)"))


def other_pairs(groups: DataFrame, cells: DataFrame) -> DataFrame:
    """(lang, source, item, part): the sums over all kept terms as if no term were held by both sources; from each source's histogram of shares and the others' share of nothing."""
    shapes = cells.groupBy("lang", "source", "p").agg(F.count("*").alias("times")).groupBy("lang", "source").agg(F.collect_list(F.struct("p", "times")).alias("shape"))
    own = groups.hint("merge").join(shapes.hint("merge"), ["lang", "source"], "left").select("lang", "source", "v", "z", "shape")
    every = groups.groupBy("lang").agg(F.collect_list(F.struct("source", "z")).alias("others"))  # the row of a source is as long as its pairs are many

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, source, v, z, shape, others in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                others = [x for x in others if x["source"] != source]
                p, times = (np.array([x[k] for x in shape or []], np.int64) for k in ("p", "times"))
                to, of = [], []
                for x in others:
                    t = x["z"]
                    base = (z - t) * (z - t) // t if v else 0
                    to.append(v * base + int(((gaps(p, np.int64(t)) - base) * times).sum()) if v else 0)  # this source against the other
                    back = (t - z) * (t - z) // z if v else 0
                    of.append(int(((gaps(np.int64(t), p) - back) * times).sum()) if v else 0)  # what this source's terms add to the other's sum against it
                names = pa.array([x["source"] for x in others], pa.string())
                mine, n = pa.array([source] * len(others), pa.string()), len(others)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * 2 * n, pa.string()), pa.concat_arrays([mine, names]), pa.concat_arrays([names, mine]), pa.array([str(y) for y in to + of], pa.string())], names=["lang", "source", "item", "part"])

    rows = own.hint("merge").join(every.hint("merge"), "lang")
    return rows.select("lang", "source", "v", "z", "shape", "others").mapInArrow(run, "lang string, source string, item string, part string").withColumn("part", F.col("part").cast("decimal(38,0)"))


def report(docs: DataFrame, least_docs: int = 3, most_terms: int = 200) -> DataFrame:
    """(lang, source, part, item, value, rank): in part ``pair`` the sum for every other source of the language, in part ``term`` the
    ``most_terms`` terms that set the source apart from its language; the largest first, ties by item."""
    groups, cells = audited(docs, least_docs)
    sums = met_pairs(cells).unionByName(other_pairs(groups, cells)).groupBy("lang", "source", "item").agg(F.sum("part").cast("long").alias("value"))
    nth = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item"))
    parts = [sums.withColumn("rank", nth).withColumn("part", F.lit("pair")), leading_terms(cells, most_terms).withColumn("part", F.lit("term"))]
    return parts[0].unionByName(parts[1]).select("lang", "source", "part", "item", "value", "rank")


def oracle_sql() -> str:
    """The report in DuckDB, over all terms and pairs."""
    p = "1 + (1000000000::HUGEINT * ({} + 1)) // ({} + v)"
    return f"""WITH d AS (SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS t FROM documents),
tok AS (SELECT row, lang, source, unnest(t) AS term FROM d), kept AS (SELECT lang, term, count(*) AS total FROM tok GROUP BY 1, 2 HAVING count(DISTINCT row) >= 3),
grp AS (SELECT DISTINCT lang, source FROM d), cnt AS (SELECT lang, source, term, count(*) AS c FROM tok SEMI JOIN kept USING (lang, term) GROUP BY 1, 2, 3),
size AS (SELECT lang, count(*) AS v, sum(total) AS n FROM kept GROUP BY 1), own AS (SELECT lang, source, sum(c) AS n FROM cnt GROUP BY 1, 2),
share AS (SELECT g.lang, g.source, k.term, coalesce(c.c, 0) AS c, {p.format('coalesce(c.c, 0)', 'coalesce(o.n, 0)')} AS p, {p.format('k.total', 's.n')} AS q
  FROM grp g JOIN kept k USING (lang) JOIN size s USING (lang) LEFT JOIN own o ON o.lang = g.lang AND o.source = g.source LEFT JOIN cnt c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
pair AS (SELECT a.lang, a.source, b.source AS item, coalesce(sum(((x.p - y.p) * (x.p - y.p)) // y.p), 0) AS value FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN share x ON x.lang = a.lang AND x.source = a.source LEFT JOIN share y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term GROUP BY 1, 2, 3),
both_parts AS (SELECT lang, source, 'pair' AS part, item, value FROM pair UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q)) // q FROM share WHERE c > 0 AND p > q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM both_parts) WHERE part = 'pair' OR rank <= 200"""
