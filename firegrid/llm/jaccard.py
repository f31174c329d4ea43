"""Near-duplicate join: documents whose sets of five-word shingles have a Jaccard similarity of 75 % or more.

The incidence matrix of distinct shingle sets (rows) by shingles (columns) is multiplied with its transpose in
blocks, without ever forming the product:

1. Rows with the same set become one row. Columns are ordered: frequent ones last, else by hash. A pair that
   overlaps as much as its sizes demand shares one of the first ``n - ceil(0.75 n) + 1`` entries of either
   row, so only these entries enter a block (a column's block holds its rows).
2. In each block, all rows are paired with one pivot, the row with most frequent columns. Pairs whose sizes, or
   whose parity bitmaps, rule out the overlap are dropped; the overlap of the rest is counted exactly. Rows
   linked this way form components, so a family of near copies costs one pair per member.
3. Blocks whose other rows still lie in different components are multiplied for those pairs only. Their products are
   added up over all blocks: pairs that meet in fewer blocks than a link must are dropped, the rest are bounded and
   counted as before.

Step 3 misses no link between different components, and links inside one change nothing. Sets are identified and
compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from firegrid.llm.graph import components
from firegrid.llm.shingles import TextHasher, in_slices
from firegrid.session import scratch

# cells of the table of frequent columns, a bound whatever the input; it only shapes the order of columns
CELL_BITS = 22
FREQUENT = 32
LOCAL = 6
CHUNK = 1 << 22
# cells of the filters that spare other documents the shuffle when pairs are bounded, and, for the fewer pairs and longer
# rows then, when they are counted
FILTER_CELLS, TEXT_CELLS = 1 << 20, 1 << 22
# parity bitmaps of a set, in words of 64 bits: one that travels with every entry, two for pairs that pass it, and, for sets
# too large for these, one that grows with the set, so that few texts are shuffled for pairs that do not link
BITMAP, MIDDLE, WIDE = 4, 16, 64
FINE = 4  # cells per shingle, at least
_BITS = [f"b{i}" for i in range(BITMAP)]


def _digest(shingles: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(shingles.tobytes()) - (1 << 63)


def _parity(shingles: np.ndarray) -> np.ndarray:
    """Whether each cell holds an odd number of shingles; 64 cells to a word, ``WIDE`` times a power of two of words.

    The exclusive or of both halves is the bitmap of half as many cells.
    """
    words = WIDE
    while 64 * words < FINE * len(shingles):
        words *= 2
    odd = np.bincount((shingles & np.uint64(64 * words - 1)).astype(np.int64), minlength=64 * words) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _saved(df: DataFrame, name: str) -> DataFrame:
    """Written to the shared folder and read again: what several steps use is made once, and outlives executors."""
    path = scratch(df.sparkSession, f"jaccard-{name}")
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of documents (id, size, set, bitmap), and rows (cell, count) of cells that columns of a chunk crowd."""
    names = ["doc_id", "n", "id", *_BITS, "wide", "fine", "cell", "count"]
    hasher, seen, size = TextHasher(), set(), 0
    counts = np.zeros(1 << CELL_BITS, np.int32)

    def crowded() -> pa.RecordBatch:
        cells = np.flatnonzero(counts >= LOCAL)
        none = pa.nulls(len(cells), pa.int64())
        out = pa.RecordBatch.from_arrays([none] * (3 + BITMAP) + [pa.nulls(len(cells), pa.list_(pa.int64()))] * 2 + [pa.array(cells), pa.array(counts[cells].astype(np.int64))], names=names)
        counts[:] = 0
        return out

    for b in in_slices(batches):
        sizes, ids, bits, new = [], [], [], []
        for s in hasher.sets(b.column(1).to_pylist()):
            i = _digest(s) if len(s) else None
            sizes.append(len(s)), ids.append(i), bits.append(_parity(s))
            if i is not None and i not in seen:
                seen.add(i)
                new.append(s)
        wide = np.array([np.bitwise_xor.reduce(x.reshape(-1, WIDE), axis=0) for x in bits], np.int64).reshape(len(bits), WIDE)
        narrow = np.bitwise_xor.reduce(wide.reshape(len(bits), -1, BITMAP), axis=1)  # the parity of fewer, merged cells
        packed = pa.ListArray.from_arrays(pa.array(np.arange(len(bits) + 1, dtype=np.int32) * WIDE), pa.array(wide.ravel()))
        fine = pa.array([x if len(x) > WIDE else None for x in bits], pa.list_(pa.int64()))
        none = pa.nulls(len(ids), pa.int64())
        yield pa.RecordBatch.from_arrays(
            [b.column(0).cast(pa.int64()), pa.array(sizes, pa.int64()), pa.array(ids, pa.int64()), *(pa.array(narrow[:, i]) for i in range(BITMAP)), packed, fine, none, none], names=names
        )
        for s in new:
            np.add.at(counts, (s >> np.uint64(64 - CELL_BITS)).astype(np.int64), 1)
            size += len(s)
            if size >= CHUNK:
                yield crowded()
                size = 0
    if size:
        yield crowded()


def _entries(docs: DataFrame, frequent: np.ndarray) -> DataFrame:
    """``h, id, n, common``: the first entries of every distinct set in the order of columns."""

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        is_frequent = np.unpackbits(frequent).astype(bool)
        hasher, seen = TextHasher(), set()
        for b in in_slices(batches):
            h, ids, ns, common, size = [], [], [], [], []
            for s in hasher.sets(b.column(0).to_pylist()):
                if not len(s) or (i := _digest(s)) in seen:
                    continue
                seen.add(i)
                late = is_frequent[(s >> np.uint64(64 - CELL_BITS)).astype(np.int64)]
                p = len(s) - (3 * len(s) + 3) // 4 + 1
                h.append(np.concatenate([s[~late], s[late]])[:p])
                ids.append(i), ns.append(len(s)), common.append(int(late.sum())), size.append(p)
            if h:
                rep = lambda x, dtype: pa.array(np.repeat(np.array(x, dtype), size))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(h).view(np.int64)), rep(ids, np.int64), rep(ns, np.int32), rep(common, np.int32)], names=["h", "id", "n", "common"])

    return docs.select("text").mapInArrow(first, "h bigint, id bigint, n int, common int")


def _needed(n: Column, m: Column) -> Column:
    """Least overlap of a link: 100 * o >= 75 * (n + m - o)."""
    return F.ceil((n + m) * 75 / 175)


def _fits(n: Column, m: Column) -> Column:
    return F.least(n, m) * 100 >= F.greatest(n, m) * 75


def _least_met(n: Column, m: Column) -> Column:
    """Least number of blocks in which rows that link meet.

    The row whose first entries end earlier finds all it shares there in the other's first entries; what is left of it
    adds at most ``ceil(0.75 n) - 1`` to the overlap.
    """
    return _needed(n, m) - F.greatest(F.ceil(n * 0.75), F.ceil(m * 0.75)) + 1


def _bounded(a: str, b: str) -> Column:
    """Whether sizes and bitmaps leave room for the overlap that a link needs."""
    n, m = F.col(f"{a}.n"), F.col(f"{b}.n")
    apart = reduce(lambda x, y: x + y, [F.bit_count(F.col(f"{a}.{c}").bitwiseXOR(F.col(f"{b}.{c}"))) for c in _BITS])
    return _fits(n, m) & ((n + m - apart) >= 2 * _needed(n, m))


def _few(df: DataFrame, wanted: DataFrame, key: str, size: int | None = None) -> DataFrame:
    """``df`` without most rows whose key is not wanted, so that these are not shuffled; keys are matched later."""
    cell = lambda: F.pmod(F.xxhash64(key), F.lit(size or FILTER_CELLS))
    cells = F.broadcast(wanted.select(cell().alias("_cell")).distinct())  # at most as many rows as cells
    return df.join(cells, cell() == F.col("_cell"), "left_semi")


def _labelled(rows: DataFrame, family: DataFrame) -> DataFrame:
    """``rows`` with component ``c``, the id itself outside any; only rows that may be in one are shuffled for it."""
    rows = rows.withColumn("_cell", F.pmod(F.xxhash64("id"), F.lit(FILTER_CELLS)))
    cells = F.broadcast(family.select(F.pmod(F.xxhash64("id"), F.lit(FILTER_CELLS)).alias("_cell")).distinct())  # at most FILTER_CELLS rows
    inside = rows.join(cells, "_cell", "left_semi").join(family, "id", "left").select("h", "id", "n", F.coalesce("component", "id").alias("c"))
    outside = rows.join(cells, "_cell", "left_anti").select("h", "id", "n", F.col("id").alias("c"))
    return inside.unionByName(outside)


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()


def _folded(bitmap: Column, words: int) -> Column:
    """The bitmap of so many words that the ``WIDE`` words of ``bitmap`` merge to."""
    return F.transform(F.sequence(F.lit(0), F.lit(words - 1)), lambda i: reduce(lambda x, y: x.bitwiseXOR(y), [F.get(bitmap, i + k) for k in range(0, WIDE, words)]))


def _narrowed(bitmap: Column, other: Column) -> Column:
    """``bitmap``, its halves merged where it is longer than ``other``; sizes that fit differ by one doubling at most."""
    half = F.size(other)
    merged = F.zip_with(F.slice(bitmap, F.lit(1), half), F.slice(bitmap, half + 1, half), lambda u, v: u.bitwiseXOR(v))
    return F.when(F.size(bitmap) > half, merged).otherwise(bitmap)


def _bounded_by(pairs: DataFrame, rows: DataFrame, bitmap: Column) -> DataFrame:
    """Pairs that such bitmaps leave room for, with their sizes ``na`` and ``nb``."""
    sets = _few(rows, _ends(pairs), "id").select("id", "n", bitmap.alias("w")).dropDuplicates(["id"])
    x, y = (sets.select(F.col("id").alias(c), F.col("n").alias(f"n{c}"), F.col("w").alias(f"w{c}")) for c in "ab")
    wa, wb, n, m = (F.col(c) for c in ("wa", "wb", "na", "nb"))
    apart = F.aggregate(F.zip_with(_narrowed(wa, wb), _narrowed(wb, wa), lambda u, v: F.bit_count(u.bitwiseXOR(v))), F.lit(0), lambda t, k: t + k)
    met = pairs.select("a", "b").join(x, "a").join(y, "b").where(_fits(n, m))
    return met.where((n + m - apart) >= 2 * _needed(n, m)).select("a", "b", "na", "nb")


def _bounded_wide(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """Pairs that ever wider bitmaps leave room for: most fall by a small one, so that few large ones are shuffled."""
    for bitmap in _folded(F.col("wide"), MIDDLE), F.col("wide"):
        pairs = _saved(_bounded_by(pairs, rows, bitmap), "pairs")
    large = F.least("na", "nb") * FINE > 64 * WIDE
    fine = _bounded_by(pairs.where(large), rows.where("fine IS NOT NULL"), F.col("fine"))
    return _saved(fine.unionByName(pairs.where(~large)).select("a", "b"), "pairs")


def _links(pairs: DataFrame, sets: DataFrame, docs: DataFrame) -> DataFrame:
    """Of the pairs (``a``, ``b``), those whose overlap, counted exactly, makes a link. ``sets``: a document per id."""
    ids = _ends(pairs).join(sets.select("id", "doc_id"), "id")

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = TextHasher()
        for b in in_slices(batches):
            got = [_digest(s) if len(s) else None for s in hasher.sets(b.column(0).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(got, pa.int64()), b.column(0)], names=["id", "text"])

    # texts name themselves: the few that are read are shuffled once, by id, and one of each set meets the pairs
    texts = _few(docs, ids, "doc_id", TEXT_CELLS).select("text").mapInArrow(named, "id bigint, text string")
    texts = _few(texts, ids, "id", TEXT_CELLS).dropDuplicates(["id"])

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = TextHasher()
        for b in in_slices(batches):
            ta, tb = b.column("ta").to_pylist(), b.column("tb").to_pylist()
            distinct = list(dict.fromkeys(ta + tb))
            made = dict(zip(distinct, hasher.sets(distinct), strict=True))
            keep = []
            for tx, ty in zip(ta, tb, strict=True):
                u, v = made[tx], made[ty]
                both = len(np.intersect1d(u, v, assume_unique=True))
                keep.append(100 * both >= 75 * (len(u) + len(v) - both))
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    a, b = texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), texts.select(F.col("id").alias("b"), F.col("text").alias("tb"))
    return pairs.join(a, "a").join(b, "b").select("a", "b", "ta", "tb").mapInArrow(linked, "a bigint, b bigint")


def jaccard_join(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row of ``docs`` (``doc_id``, ``text``).

    ``component_id`` is the smallest doc_id that links reach, the document's own included. Texts with one to four words
    are one shingle; NULL and empty texts have none and stay alone. Repeated rows give repeated rows, rows of a NULL
    doc_id count by their text and are never a component's name unless alone. Other columns are ignored; an empty
    table gives no rows. Texts are read three times rather than kept as shingles, which would be larger than the input.
    """
    docs = docs.select("doc_id", "text")
    described = _saved(docs.mapInArrow(_describe, ", ".join(f"{c} bigint" for c in ["doc_id", "n", "id", *_BITS]) + ", wide array<bigint>, fine array<bigint>, cell bigint, count bigint"), "documents")
    rows = described.where("cell IS NULL").drop("cell", "count")
    sets = _saved(rows.where("n > 0").groupBy("id").agg(F.min("doc_id").alias("doc_id"), *[F.first(c).alias(c) for c in ["n", *_BITS]]), "sets")

    cells = described.where("cell IS NOT NULL").groupBy("cell").agg(F.sum("count").alias("c"))
    usual = cells.agg(F.sum("c")).first()[0] or 0
    flags = np.zeros(1 << CELL_BITS, bool)
    # at most as many rows as there are cells
    flags[[r[0] for r in cells.where(F.col("c") >= FREQUENT + 4 * usual / (1 << CELL_BITS)).select("cell").collect()]] = True
    w = Window.partitionBy("h").orderBy(F.desc("common"), "id")
    entries = _entries(docs, np.packbits(flags)).withColumns({"pivot": F.first("id").over(w), "pivot_n": F.first("n").over(w), "next": F.lead("id").over(w), "last": F.lag("id").over(w)})
    # the same set from two tasks stands next to itself
    shared = _saved(entries.where("NOT (id <=> last) AND (id <> pivot OR next IS NOT NULL)").drop("next", "last", "common"), "blocks")

    first = shared.where(F.col("id") != F.col("pivot")).where(_fits(F.col("n"), F.col("pivot_n"))).select(F.col("pivot").alias("a"), F.col("id").alias("b")).distinct()
    first = _bounded_wide(_saved(first, "pairs"), rows)
    links = _saved(_links(first, sets, docs), "links")
    family = components(links)

    block = Window.partitionBy("h")
    # every pair with a block's pivot is settled, so the pivot itself takes no further part
    placed = shared.where(F.col("id") != F.col("pivot")).select("h", "id", "n")
    placed = _labelled(placed, family)
    mixed = placed.withColumns({"lo": F.min("c").over(block), "hi": F.max("c").over(block)}).where("lo < hi").drop("lo", "hi")
    left = _saved(mixed, "mixed").join(sets.select("id", *_BITS), "id")
    across = left.alias("x").join(left.alias("y"), (F.col("x.h") == F.col("y.h")) & (F.col("x.c") < F.col("y.c")) & _bounded("x", "y"))
    # pairs that meet at a pivot anywhere are settled; all other blocks that hold both rows are counted here
    second = across.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b"), _least_met(F.col("x.n"), F.col("y.n")).alias("least"))
    second = second.groupBy("a", "b", "least").count().where("count >= least").select("a", "b")
    done = first.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    second = _bounded_wide(_saved(second.join(done, ["a", "b"], "left_anti"), "pairs"), rows)
    tied = family.select(F.col("component").alias("a"), F.col("id").alias("b"))
    family = components(tied.unionByName(_saved(_links(second, sets, docs), "links")))

    named = sets.select("id", "doc_id").join(family, "id", "left").select("id", "doc_id", F.coalesce("component", "id").alias("component"))
    names = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    whole = named.join(names, "component").select("id", "component_id")
    return rows.select("doc_id", F.col("n").alias("n_shingles"), "id").join(whole, "id", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def deduplicate(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each group, the one that names it; of rows with equal id and text one stays."""
    named = jaccard_join(docs).where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("_kept")).distinct()
    kept = docs.join(named, F.col("doc_id").eqNullSafe(F.col("_kept")), "left_semi")
    return kept.withColumn("_text", F.xxhash64("text")).dropDuplicates(["doc_id", "_text"]).drop("_text")
