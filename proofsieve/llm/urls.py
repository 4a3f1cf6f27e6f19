"""URL filters: rules of host and path, held in cascades of Bloom filters.

A rule (host, path, verdict) fits its host and all subdomains if the url's path starts with the rule's; of several the longest
wins, of equal length that with the longer host. The keys of a url are host suffix + path prefix in the shapes (numbers of
characters) that rules have, so a url is judged by asking which of its keys are listed.

A cascade answers that without a join: level 1 is a Bloom filter of the listed keys, level 2 one of the keys of this corpus that pass
level 1 without being listed, level 3 one of the listed keys that pass level 2, and so on until a level lets nothing wrong through. Every key of
the corpus is asked while the levels are built, so the answer is exact for all of them. A second cascade, over the rules alone, tells blocking
from allowing ones. Each level hashes with a seed of its own, so two keys never stay alike.

A filter is sent to every task, so its size is bounded by ``most_bytes``: longer lists are cut by a hash of the key into parts that the pages pass
one after the other.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofsieve.llm.shared import fresh, stored

#: Bits of a filter for each key, and positions of a key: about one wrong key in 2,000 on every level.
BITS, POSITIONS = 16, 11
#: Bytes of a filter that is sent to every task.
MOST_BYTES = 16 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; path: then up to ``?``, ``#`` or the end. Both are empty without a ``://``."""
    text = F.coalesce(url, F.lit(""))
    at = F.locate("://", text)
    rest = F.when(at > 0, F.substring(text, at + 3, F.length(text))).otherwise("")
    return F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


@dataclass
class Bloom:
    seed: int
    words: np.ndarray
    positions: int

    def passes(self, keys: list[str]) -> np.ndarray:
        at = bit_numbers(keys, self.seed, 64 * len(self.words), self.positions)
        return ((self.words[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1)).all(axis=1)


def bit_numbers(keys: list[str], seed: int, bits: int, positions: int) -> np.ndarray:
    """One row of bit numbers for each key."""
    both = np.frombuffer(b"".join(xxhash.xxh3_128_digest(k.encode(), seed) for k in keys), "<u8").reshape(-1, 2)
    return (both[:, :1] + np.arange(positions, dtype=np.uint64) * (both[:, 1:] | np.uint64(1))) % np.uint64(bits)


def part_of(key: str, parts: int) -> int:
    return xxhash.xxh64_intdigest(key.encode(), 11) % parts


def filter_of(keys: DataFrame, n: int, seed: int) -> Bloom:
    """The filter of the ``n`` strings in the column ``key``: words are set where the keys are and joined by OR; the driver gets ``BITS`` bits a key."""
    size, positions = max(1, math.ceil(n * BITS / 64)), POSITIONS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                at = np.unique(bit_numbers(batch.column(0).to_pylist(), seed, 64 * size, positions))
                word, first = np.unique(at >> np.uint64(6), return_index=True)
                value = np.bitwise_or.reduceat(np.uint64(1) << (at & np.uint64(63)), first)
                yield pa.RecordBatch.from_arrays([pa.array(word.astype(np.int64)), pa.array(value.view(np.int64))], names=["word", "value"])

    got = keys.select("key").mapInArrow(run, "word long, value long").groupBy("word").agg(F.bit_or("value").alias("value")).toArrow()
    words = np.zeros(size, np.uint64)
    words[got["word"].to_numpy()] = got["value"].to_numpy().view(np.uint64)
    return Bloom(seed, words, positions)


@dataclass
class Cascade:
    levels: list[Bloom]

    def has(self, keys: list[str]) -> np.ndarray:
        """Whether each key is listed; right for every key that the cascade was built over."""
        out, left = np.zeros(len(keys), bool), np.arange(len(keys))
        for depth, level in enumerate(self.levels):
            if not len(left):
                break
            passed = level.passes([keys[i] for i in left])
            out[left[~passed]] = depth % 2 == 1
            left = left[passed]
        out[left] = len(self.levels) % 2 == 1
        return out


def passing(keys: DataFrame, level: Bloom) -> DataFrame:
    """The strings in ``key`` that pass a filter."""
    sent = keys.sparkSession.sparkContext.broadcast(level)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield batch.filter(pa.array(sent.value.passes(batch.column(0).to_pylist())))

    return keys.select("key").mapInArrow(run, "key string")


def grown(first: Bloom, listed: DataFrame, others: DataFrame) -> Cascade:
    """The cascade that begins with ``first``: ``others`` are the keys that pass it without being listed, ``listed`` the keys to be told from them."""
    levels, sides = [first], [stored(others, "urls-others"), listed]
    while n := sides[0].count():
        levels.append(filter_of(sides[0], n, len(levels)))
        sides = [stored(passing(sides[1], levels[-1]), "urls-pass"), sides[0]]
    return Cascade(levels)


class Shapes:
    """The shapes of rules: for each number of a host's characters those of paths."""

    def __init__(self, shapes: list[tuple[int, int]]):
        self.paths: dict[int, list[int]] = {}
        for h, p in shapes:
            self.paths.setdefault(h, []).append(p)

    def keys(self, host: str, path: str) -> list[str]:
        """Keys of a url, the longest first, of equal length that with the longer host first."""
        found, at = [], 0
        while True:
            h = len(host) - at
            found += [(h + p, h, p) for p in self.paths.get(h, ()) if p <= len(path)]
            at = host.find(".", at) + 1
            if not at:
                break
        return [host[len(host) - h :] + path[:p] for _, h, p in sorted(found, reverse=True)]


def checked(rules: DataFrame) -> DataFrame:
    """(key, blocks, h, p) of the rules that can fit: hosts in lower case, none empty, and paths empty or with a slash ahead. Of a rule given both ways the blocking one counts."""
    host, path = F.translate("host", UPPER, LOWER), F.coalesce("path", F.lit(""))
    rows = rules.select(F.concat(host, path).alias("key"), (F.col("verdict") == "block").alias("blocks"), F.length(host).alias("h"), F.length(path).alias("p"))
    fit = rows.where((F.col("h") > 0) & (F.locate("/", host) == 0) & ((path == "") | F.startswith(path, F.lit("/"))) & F.col("blocks").isNotNull())
    return fit.groupBy("key", "h", "p").agg(F.max("blocks").alias("blocks"))


def judge(pages: DataFrame, rules: DataFrame, key: str = "page_id", url: str = "url", default: str = "allow", most_bytes: int = MOST_BYTES) -> DataFrame:
    """(key, host, path, rule, verdict) for each row of ``pages``: the rule that fits, as host + path, and what it says; without one a null rule and ``default``.

    ``rules`` has host, path and verdict (allow or block). A null url has an empty host and path and no rule; repeated rows are judged each.
    """
    own = stored(checked(rules), "urls-rules")
    n = own.count()
    shapes = Shapes([(r.h, r.p) for r in own.select("h", "p").distinct().collect()])  # lengths alone, at most as many as the longest url squared
    parts = max(1, math.ceil(n * BITS / 8 / most_bytes))
    host, path = host_and_path(F.col(f"`{url}`"))
    out = pages.select(F.col(f"`{key}`").alias("k"), host.alias("host"), path.alias("path"), F.lit(None).cast("string").alias("rule"), F.lit(None).cast("boolean").alias("blocks"))
    for part in range(parts if n else 0):
        listed = own if parts == 1 else stored(own.where(_in_part(part, parts)), "urls-part")
        cascades = [_membership(pages.select(host.alias("host"), path.alias("path")), listed, shapes, part, parts), _blocking(listed)]
        out = _judged(out, cascades, shapes, part, parts)
        out = stored(out, "urls-judged") if part < parts - 1 else out
    verdict = F.when(F.col("blocks"), "block").when(F.col("rule").isNotNull(), "allow").otherwise(default)
    return out.select(F.col("k").alias(fresh(key, ["host", "path", "rule", "verdict"])), "host", "path", "rule", verdict.alias("verdict"))


def _in_part(part: int, parts: int) -> Column:
    @F.udf("boolean", useArrow=True)
    def inside(k: str) -> bool:
        return part_of(k, parts) == part

    return inside("key")


def _membership(urls: DataFrame, listed: DataFrame, shapes: Shapes, part: int, parts: int) -> Cascade:
    """The cascade that tells the listed keys from all other keys of the corpus."""
    first = filter_of(listed, listed.count(), 0)
    sent = urls.sparkSession.sparkContext.broadcast((first, shapes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level, forms = sent.value
        for batch in batches:
            urls_here = set(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
            keys = sorted({k for h, p in urls_here for k in forms.keys(h, p) if parts == 1 or part_of(k, parts) == part})
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()).filter(pa.array(level.passes(keys)))], names=["key"])

    passed = stored(urls.mapInArrow(run, "key string").distinct(), "urls-keys")
    there = passed.hint("merge").join(listed.select("key").hint("merge"), "key", "left_semi")
    return grown(first, stored(there, "urls-listed"), passed.hint("merge").join(listed.select("key").hint("merge"), "key", "left_anti"))


def _blocking(listed: DataFrame) -> Cascade:
    """The cascade that tells blocking rules from allowing ones."""
    blocks, allows = listed.where("blocks").select("key"), listed.where("not blocks").select("key")
    if not (n := blocks.count()):
        return Cascade([])
    first = filter_of(blocks, n, 0)
    return grown(first, blocks, passing(allows, first))


def _judged(rows: DataFrame, cascades: list[Cascade], shapes: Shapes, part: int, parts: int) -> DataFrame:
    """``rows`` (k, host, path, rule, blocks) with the longest listed key of this part, unless the rule that they have goes before."""
    sent = rows.sparkSession.sparkContext.broadcast((cascades, shapes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (member, blocking), forms = sent.value
        for batch in batches:
            had, blocked = batch.column(3).to_pylist(), batch.column(4).to_pylist()
            keys, ends = [], []
            for h, p in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                keys += [k for k in forms.keys(h, p) if parts == 1 or part_of(k, parts) == part]
                ends.append(len(keys))
            listed, start = member.has(keys), 0
            for i, end in enumerate(ends):
                hit = next((keys[j] for j in range(start, end) if listed[j]), None)
                if hit is not None and (had[i] is None or _order(hit) > _order(had[i])):
                    had[i], blocked[i] = hit, bool(blocking.has([hit])[0])
                start = end
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(had, pa.string()), pa.array(blocked, pa.bool_())], names=rows_names)

    rows_names = ["k", "host", "path", "rule", "blocks"]
    return rows.mapInArrow(run, f"k {dict(rows.dtypes)['k']}, host string, path string, rule string, blocks boolean")


def _order(rule: str) -> tuple[int, int]:
    return len(rule), len(rule.split("/", 1)[0])


def allowed(pages: DataFrame, rules: DataFrame, url: str = "url", most_bytes: int = MOST_BYTES) -> DataFrame:
    """The rows of ``pages`` whose verdict is allow, with all their columns."""
    name = fresh("row", pages.columns)
    both = pages.select(F.struct(*[F.col(f"`{c}`") for c in pages.columns]).alias(name), F.col(f"`{url}`").alias(fresh("url", [name])))
    kept = judge(both, rules, name, fresh("url", [name]), most_bytes=most_bytes).where("verdict = 'allow'")
    return kept.select(*[F.col(f"{name}.`{c}`").alias(c) for c in pages.columns])


#: The rules of the query.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def report(pages: DataFrame) -> DataFrame:
    """page_id, host, path, rule and verdict by the fixed rules; a url without a rule isn't listed and so allowed."""
    return judge(pages, pages.sparkSession.createDataFrame(RULES, "host string, path string, verdict string"))


def oracle_sql() -> str:
    """The report in DuckDB."""
    fits = " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{h}{p}'" for h, p, _ in sorted(RULES, key=lambda r: -len(r[0] + r[1])))
    blocks = ", ".join(f"'{h}{p}'" for h, p, v in RULES if v == "block")
    return f"""WITH cut AS (SELECT page_id, CASE WHEN contains(coalesce(url, ''), '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
ruled AS (SELECT *, CASE {fits} END AS rule FROM parts)
SELECT page_id, host, path, rule, CASE WHEN rule IN ({blocks}) THEN 'block' ELSE 'allow' END AS verdict FROM ruled"""
