"""The chunk index as a table, and what fills it: sections, chunks, upserts, reports."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proofsieve.functions.text import canonical_section_key, counted, given, once, section_descriptor, section_pieces, stripped, tokens
from proofsieve.operators.models import filled, predict


def upsert(existing: DataFrame, batch: DataFrame, key: str = "chunk_id", version: str = "version") -> DataFrame:
    """``existing`` with the rows of ``batch`` put in by key: blank texts are left out, of a key's batch rows the last version counts."""
    last = batch.where(given("text").isNotNull()).withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(F.col(version).desc()))).where("__n = 1").drop("__n")
    return existing.hint("merge").join(last.hint("merge"), key, "left_anti").unionByName(last)


def write_index(chunks: DataFrame, path: str) -> None:
    """Replaces the tickers that ``chunks`` has, and no other."""
    chunks.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("ticker").parquet(path)


def delete_ticker(chunks: DataFrame, ticker: str) -> DataFrame:
    return chunks.where(~F.upper(F.trim("ticker")).eqNullSafe(ticker.strip().upper()))


def drop_index(chunks: DataFrame) -> DataFrame:
    """An index with the same columns and no rows."""
    return chunks.where(F.lit(False))


def get_by_id(chunks: DataFrame, ids: DataFrame) -> DataFrame:
    return chunks.join(ids.select("chunk_id").distinct(), "chunk_id").withColumn("distance", F.lit(0.0))


def index_status(tickers: DataFrame, chunks: DataFrame) -> DataFrame:
    """(ticker, n_chunks, indexed) for each ticker asked for."""
    n = chunks.groupBy("ticker").agg(F.count("*").alias("n_chunks"))
    out = tickers.select(F.upper(F.trim("ticker")).alias("ticker")).distinct().join(n, "ticker", "left")
    return out.select("ticker", F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"), F.coalesce(F.col("n_chunks") > 0, F.lit(False)).alias("indexed"))


def sparse_corpus(chunks: DataFrame, cap: int | None = None) -> DataFrame:
    """Chunks with text and an id; with ``cap`` the first ones of each ticker and filing type by id."""
    out = chunks.where(given("text").isNotNull()).withColumn("chunk_id", F.coalesce(given("retrieval_id"), given("chunk_id"), given("id")))
    if cap is None:
        return out
    nth = F.row_number().over(Window.partitionBy("ticker", "filing_type").orderBy("chunk_id"))
    return out.withColumn("__n", nth).where(F.col("__n") <= cap).drop("__n")


def sanitized(metadata: Column | str) -> Column:
    """A map without its null values."""
    return F.map_filter(F.col(metadata) if isinstance(metadata, str) else metadata, lambda k, v: v.isNotNull())


def slice_sections(filings: DataFrame, text: str = "text", least: int = 500, most: int = 50_000) -> DataFrame:
    """(document_id, section_key, content): the longest piece over ``least`` characters of each section, the first on ties, cut to ``most``."""
    pieces = filings.select("document_id", F.posexplode(section_pieces(text)).alias("pos", "p")).select("document_id", "pos", F.col("p.name").alias("section_key"), stripped("p.content").alias("content")).where(F.length("content") > least)
    nth = F.row_number().over(Window.partitionBy("document_id", "section_key").orderBy(F.length("content").desc(), "pos"))
    return pieces.withColumn("__n", nth).where("__n = 1").select("document_id", "section_key", F.substring("content", 1, most).alias("content"))


def resolve_sections(sections: DataFrame, requested: DataFrame) -> DataFrame:
    """(document_id, found, skipped) for each document: requested sections, in their order, that it has, and those it lacks or has without text."""
    keyed = sections.withColumn("section_key", F.coalesce(canonical_section_key("raw_name"), section_descriptor("raw_name")["key"]))
    first = keyed.withColumn("__n", F.row_number().over(Window.partitionBy("document_id", "section_key").orderBy("pos"))).where("__n = 1").where(given("content").isNotNull()).select("document_id", "section_key", F.lit(True).alias("has"))
    asked = requested.agg(F.collect_list(F.struct(F.col("pos").alias("order"), "section_key"))).scalar()  # the request is one short list
    wanted = sections.select("document_id").distinct().select("document_id", F.explode(asked).alias("r")).select("document_id", "r.order", "r.section_key")
    listed = wanted.hint("merge").join(first.hint("merge"), ["document_id", "section_key"], "left")
    names = lambda rows: F.transform(F.array_sort(rows), lambda x: x["section_key"])
    entry = F.struct("order", "section_key")
    return listed.groupBy("document_id").agg(names(F.collect_list(F.when(F.col("has"), entry))).alias("found"), names(F.collect_list(F.when(F.col("has").isNull(), entry))).alias("skipped"))


def chunk_fixed(sections: DataFrame, text: str = "content", size: int = 1000, overlap: int = 200) -> DataFrame:
    """One row for each stretch of ``size`` characters, each beginning ``overlap`` before the last one's end; blanks dropped."""
    step = size - overlap
    starts = F.sequence(F.lit(0), F.greatest(F.length(text) - overlap - 1, F.lit(0)), F.lit(step))
    cut = sections.where(F.length(text) > 0).select("*", F.posexplode(starts).alias("chunk_index", "__at"))
    return cut.withColumn("chunk_text", stripped(F.substring(F.col(text), F.col("__at") + 1, F.lit(size)))).where("chunk_text <> ''").drop("__at")


def chunk_packed(sections: DataFrame, text: str = "content", size: int = 1000) -> DataFrame:
    """Sentences packed greedily into chunks of at most ``size`` characters; a longer sentence is a chunk by itself."""
    from proofsieve.functions.text import sentences

    fold = F.aggregate(
        sentences(text), F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open")),
        lambda acc, s: F.when(acc["open"] == "", F.struct(acc["done"].alias("done"), s.alias("open")))
        .when(F.length(acc["open"]) + F.length(s) + 1 <= size, F.struct(acc["done"].alias("done"), F.concat_ws(" ", acc["open"], s).alias("open")))
        .otherwise(F.struct(F.array_append(acc["done"], acc["open"]).alias("done"), s.alias("open"))),
        lambda acc: F.filter(F.array_append(acc["done"], acc["open"]), lambda x: x != ""),
    )
    return sections.select("*", F.posexplode(fold).alias("chunk_index", "chunk_text"))


SEPARATORS = ("\n\n", "\n", ". ", ", ", " ", "")


def recursive_pieces(text: str, size: int, overlap: int, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Split at the first separator the text has, split longer pieces at the next ones, and pack pieces up to ``size``, carrying over up to ``overlap``."""
    return list(each_piece(text, size, overlap, separators))


def each_piece(text: str, size: int, overlap: int, separators: tuple[str, ...] = SEPARATORS) -> Iterator[str]:
    """The ``recursive_pieces`` one after the other, in linear time."""
    separator = next((s for s in separators if s in text), "")
    rest = separators[separators.index(separator) + 1 :]
    held: deque[str] = deque()
    length = 0  # of the held pieces as they are joined

    for piece in text.split(separator) if separator else text:
        if len(piece) > size and rest:
            if joined := separator.join(held).strip():
                yield joined
            held.clear()
            length = 0
            yield from each_piece(piece, size, overlap, rest)
            continue
        if held and length + len(separator) + len(piece) > size:
            if joined := separator.join(held).strip():
                yield joined
            while held and (length > overlap or length + len(separator) + len(piece) > size):
                length -= len(held.popleft()) + (len(separator) if held else 0)
        length += len(piece) + (len(separator) if held else 0)
        held.append(piece)
    if joined := separator.join(held).strip():
        yield joined


def chunk_recursive(sections: DataFrame, text: str = "content", size: int = 1000, overlap: int = 200, most: int = 10_000) -> DataFrame:
    """One row for each of the ``recursive_pieces`` of each section, numbered by chunk_index. Pieces are sent on ``most`` at a time, so a long text needs no more memory than itself and those."""
    names = [*sections.columns, "chunk_index", "chunk_text"]
    schema = ", ".join([*(f"`{c}` {t}" for c, t in sections.dtypes), "chunk_index int", "chunk_text string"])
    place = sections.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, value in enumerate(batch.column(place).to_pylist()):
                pieces = enumerate(each_piece(value or "", size, overlap))
                while part := list(islice(pieces, most)):
                    own = [c.take(pa.array([row] * len(part), pa.int64())) for c in batch.columns]
                    yield pa.RecordBatch.from_arrays([*own, pa.array([i for i, _ in part], pa.int32()), pa.array([x for _, x in part], pa.string())], names=names)

    return sections.mapInArrow(run, schema)


def build_chunks(chunked: DataFrame) -> DataFrame:
    """Chunks with document_id, parent_section_id, chunk_id and their metadata, nulls left out, from rows with chunk_index and chunk_text."""
    document = F.concat_ws("_", F.upper("ticker"), "filing_type", F.coalesce("filing_date", F.lit("unknown_date")))
    of = section_descriptor("raw_name")
    rows = chunked.withColumn("document_id", document).withColumn("d", of)
    rows = rows.withColumns({"parent_section_id": F.concat_ws(":", "document_id", "d.slug"), "chunk_id": F.format_string("%s_%s_%03d", F.col("document_id"), F.col("d.slug"), F.col("chunk_index")), "section_key": F.col("d.key"), "section_name": F.col("d.display_name")})
    keys = ["ticker", "company_name", "filing_type", "filing_date", "section_key", "section_name", "document_id", "parent_section_id"]
    metadata = sanitized(F.create_map(*[x for k in keys for x in (F.lit(k), F.col(k))]))
    return rows.select("chunk_id", F.col("chunk_text").alias("text"), "document_id", "parent_section_id", "section_key", "section_name", "chunk_index", metadata.alias("metadata"))


def ingestion_report(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """(document_id, total_chunks, sections, success, error) for each document, those without chunks included."""
    made = chunks.groupBy("document_id").agg(F.count("*").alias("n"), F.sort_array(F.collect_set("section_key")).alias("sections"))
    out = documents.select("document_id").distinct().hint("merge").join(made.hint("merge"), "document_id", "left")
    error = F.when(F.col("n").isNull(), "No content found in requested sections")
    return out.select("document_id", F.coalesce("n", F.lit(0)).alias("total_chunks"), F.coalesce("sections", F.array().cast("array<string>")).alias("sections"), error.isNull().alias("success"), error.alias("error"))


def ingest(existing: DataFrame, batch: DataFrame, replace: bool = False, scope: str = "ticker") -> DataFrame:
    """The index after a batch: without ``replace`` tickers (or documents) that it has keep what they have and the batch's rows for them are skipped; with it they are replaced."""
    if replace:
        return existing.join(batch.select(scope).distinct(), scope, "left_anti").unionByName(batch)
    return existing.unionByName(batch.join(existing.select(scope).distinct(), scope, "left_anti"))


def embed_hashed(rows: DataFrame, text: str = "text", dim: int = 64) -> DataFrame:
    """Adds ``embedding``: signed counts of hashed tokens, of length 1; empty texts get an empty array."""
    code = lambda t: F.pmod(F.xxhash64(t), F.lit(dim)).cast("int") * 2 + F.pmod(F.xxhash64(t, F.lit(1)), F.lit(2)).cast("int")  # noqa: E731  # odd: counts -1
    sums = once(F.sort_array(F.transform(tokens(text), code)), lambda codes: once(counted(codes), lambda n: F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.coalesce(n[2 * i], F.lit(0)) - F.coalesce(n[2 * i + 1], F.lit(0)))))
    sums = F.transform(sums, lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate("__v", F.lit(0.0), lambda s, x: s + x * x))
    out = rows.withColumn("__v", sums).withColumn("__n", norm)
    return out.withColumn("embedding", F.when(F.col("__n") > 0, F.transform("__v", lambda x: (x / F.col("__n")).cast("float"))).otherwise(F.array().cast("array<float>"))).drop("__v", "__n")


def embed_with(rows: DataFrame, make: Callable[[], Callable[[list[str]], list[list[float]]]], text: str = "text", batch_size: int = 8) -> DataFrame:
    """Adds ``embedding`` and ``error`` by a user's model, made once a task and called with batches of texts, null ones as empty; a text that fails has an error and no vector."""
    return predict(rows, lambda: filled(make()), [text], "embedding", "array<float>", batch_size)


