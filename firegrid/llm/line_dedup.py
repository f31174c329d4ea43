"""Line deduplication over levelled sorted runs of line hashes.

A line's hash stands for its key: the line without blanks at its ends, A-Z in lower case. What is known of all lines seen
so far lies in runs, tables of (hash, number of documents, largest document) bucketed and sorted by hash. Every new
batch of documents

1. is reduced to one entry per hash,
2. is merge-anti-joined with the runs: entries that a run already decides (in enough documents, one of them at
   least as large) add nothing and go,
3. adds the rest as a run of its own to the lowest level.

When a level has ``FANOUT`` runs they are merged to one run of the next level, by merge joins. All runs share buckets, so
runs are shuffled neither for the anti-join nor to be merged. Batches may come in any order, but a document comes in one batch.

Hashes have 128 bits. A line in a third of all documents is one entry per task before it is shuffled.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from firegrid.llm.shingles import in_slices
from firegrid.session import forget, scratch

MIN_CHARS, MIN_DOCS = 20, 3
FANOUT, BATCHES = 4, 4
# of all entries: what occurs more often is broadcast, which is at most so many rows
HOT = 1000


def line_hashes(raw: bytes, min_chars: int = MIN_CHARS) -> list[bytes | None]:
    """The hash of each line's key, None for keys that are too short."""
    out = []
    for line in raw.lower().split(b"\n"):
        key = line.strip()
        long = len(key) >= min_chars and (key.isascii() or len(key.decode("utf-8", "surrogatepass")) >= min_chars)
        out.append(xxhash.xxh3_128_digest(key) if long else None)
    return out


def _raw(column: pa.Array) -> list[bytes]:
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


class LineRuns:
    """The runs of one job. ``min_docs`` tells which entries are decided."""

    def __init__(self, spark: SparkSession, min_docs: int = MIN_DOCS, fanout: int = FANOUT):
        self.spark, self.min_docs, self.fanout = spark, min_docs, fanout
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[tuple[str, str]]] = []

    def _write(self, entries: DataFrame, level: int) -> None:
        name, path = f"firegrid_lines_{uuid.uuid4().hex}", scratch(self.spark, "lines-run")
        entries.repartition(self.buckets, "hash").write.bucketBy(self.buckets, "hash").sortBy("hash").option("path", path).saveAsTable(name)
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append((name, path))
        if len(self.levels[level]) >= self.fanout:
            self._compact(level)

    def _merged(self, runs: list[tuple[str, str]]) -> DataFrame:
        """One entry per hash of all runs, by merge joins."""
        merged = self.spark.table(runs[0][0])
        for name, _ in runs[1:]:
            both = merged.alias("x").join(self.spark.table(name).alias("y"), "hash", "full_outer")
            docs = F.coalesce("x.docs", F.lit(0)) + F.coalesce("y.docs", F.lit(0))
            merged = both.select("hash", docs.alias("docs"), F.greatest("x.last", "y.last").alias("last"))
        return merged

    def _drop(self, runs: list[tuple[str, str]]) -> None:
        for name, path in runs:
            self.spark.sql(f"DROP TABLE {name}")
            forget(self.spark, path)

    def _compact(self, level: int) -> None:
        runs = self.levels[level]
        self.levels[level] = []
        self._write(self._merged(runs), level + 1)
        self._drop(runs)

    def add(self, lines: DataFrame) -> None:
        """``lines``: ``doc, hash``, the lines of documents that came in no earlier batch; repeats count once."""
        fresh = lines.groupBy("hash").agg(F.count_distinct(F.struct("doc")).alias("docs"), F.max("doc").alias("last"))
        for name, _ in (run for level in self.levels for run in level):
            decided = self.spark.table(name).where(F.col("docs") >= self.min_docs).select("hash", F.col("last").alias("_last"))
            fresh = fresh.alias("x").join(decided.alias("y"), (F.col("x.hash") == F.col("y.hash")) & (F.col("y._last") >= F.col("x.last")), "left_anti")
        self._write(fresh, 0)

    def entries(self) -> DataFrame | None:
        """Every hash with its largest document, and its number of documents or at least ``min_docs``."""
        runs = [run for level in self.levels for run in level]
        return self._merged(runs) if runs else None

    def close(self) -> None:
        self._drop([run for level in self.levels for run in level])
        self.levels = []


def _lines(docs: DataFrame, batches: int, min_chars: int) -> DataFrame:
    """``doc, hash, batch``: the hashes of every row, each once."""
    doc_type = docs.schema["doc"].dataType.simpleString()

    def hashed(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_slices(rows):
            own = [list(dict.fromkeys(h for h in line_hashes(raw, min_chars) if h)) for raw in _raw(b.column(2))]
            at = pa.array([i for i, hs in enumerate(own) for _ in hs], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), pa.array([h for hs in own for h in hs], pa.binary()), b.column(1).take(at)], names=["doc", "hash", "batch"])

    batch = F.pmod(F.xxhash64("doc"), F.lit(batches)).cast("int")
    return docs.select("doc", batch.alias("batch"), "text").mapInArrow(hashed, f"doc {doc_type}, hash binary, batch int")


def repeated_lines(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, batches: int = BATCHES) -> DataFrame:
    """``doc, hashes``: the lines that each document loses. ``docs``: ``doc, text``."""
    spark = docs.sparkSession
    path, settled = scratch(spark, "lines"), scratch(spark, "lines-settled")
    _lines(docs, batches, min_chars).write.partitionBy("batch").parquet(path)
    lines = spark.read.schema(f"doc {docs.schema['doc'].dataType.simpleString()}, hash binary, batch int").parquet(path)
    runs = LineRuns(spark, min_docs)
    for i in range(batches):
        runs.add(lines.where(F.col("batch") == i).select("doc", "hash"))
    runs.entries().where(F.col("docs") >= min_docs).write.parquet(settled)
    runs.close()
    known = spark.read.parquet(settled)

    total = max(lines.count(), 1)
    common = F.col("docs") * HOT > total
    hot = known.where(common).select("hash", F.col("last").alias("_hot"))  # fewer than HOT rows
    rows = lines.select("doc", "hash").join(F.broadcast(hot), "hash", "left")
    lost = lambda last: ~F.col("doc").eqNullSafe(F.col(last))
    of_hot = rows.where(F.col("_hot").isNotNull() & lost("_hot")).select("doc", "hash")
    of_rest = rows.where(F.col("_hot").isNull()).join(known.where(~common).select("hash", "last"), "hash").where(lost("last")).select("doc", "hash")
    return of_hot.unionByName(of_rest).groupBy("doc").agg(F.collect_set("hash").alias("hashes"))


def dedup_lines(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, batches: int = BATCHES) -> DataFrame:
    """``docs`` (``doc_id``, ``text``, others) with the repeated lines taken out of ``text``, and ``n_lines, n_dropped`` (long).

    A line goes where its key has ``min_chars`` code points or more and is found in ``min_docs`` documents or more,
    except in the largest doc_id that holds it; there it stays as often as it stands. The other lines stay as they were.

    NULL and empty texts are one empty line. Rows with equal doc_id are one document, also those of a NULL doc_id, which is
    smaller than any other. Existing columns ``n_lines`` and ``n_dropped`` are replaced, other columns are kept. An
    empty table stays empty. A text is worked on in one task, whatever its length.
    """
    plain = docs.drop("n_lines", "n_dropped")
    dropped = repeated_lines(plain.select(F.col("doc_id").alias("doc"), "text"), min_docs, min_chars, batches)
    dropped = dropped.select(F.col("doc").alias("_doc"), F.col("hashes").alias("_hashes"))
    joined = plain.join(dropped, F.col("doc_id").eqNullSafe(F.col("_doc")), "left").drop("_doc")
    at, names = plain.columns.index("text"), plain.columns
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema), "n_lines bigint, n_dropped bigint"])

    def rebuilt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_slices(batches):
            texts, n_lines, n_dropped = [], [], []
            for raw, gone in zip(_raw(b.column(at)), b.column(len(names)).to_pylist(), strict=True):
                lines, gone = raw.split(b"\n"), set(gone or ())
                kept = [x for x, h in zip(lines, line_hashes(raw, min_chars), strict=True) if h not in gone] if gone else lines
                texts.append(b"\n".join(kept)), n_lines.append(len(lines)), n_dropped.append(len(lines) - len(kept))
            columns = list(b.columns[: len(names)])
            columns[at] = pa.array(texts, pa.large_binary()).cast(pa.large_string()).cast(b.column(at).type)
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], names=[*names, "n_lines", "n_dropped"])

    return joined.mapInArrow(rebuilt, schema)
