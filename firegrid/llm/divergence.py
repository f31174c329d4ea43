"""Source divergence audit: how far the word use of each source of a language lies from the other sources'.

Counting takes two passes over the texts, and is exact:

1. Documents per language and term are counted; terms in too few documents go.
2. A language's kept terms are dealt by hash to shards. One task builds the minimal perfect hash of a shard: levels
   of bits, where a key stands at the first level at which no other key of that level shares its place, and its slot
   is the rank of its bit. The keys are stored in slot order. The second pass receives the shards by broadcast, in
   rounds of at most ``ROUND_BYTES``, looks every term of a portion of texts up, compares it with the stored key, and
   increments the slot in a dense array of its (language, source). Tasks hand on pieces of these arrays.

Distances of sources are then added up from pieces of a language's slots and blocks of its sources, so that no task
holds a whole language.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from firegrid.llm.shingles import in_slices, mix
from firegrid.session import scratch

MIN_DOCS, TOP = 30, 50
# kept terms of a shard, and bytes of shards that one pass over the texts receives
SHARD, ROUND_BYTES = 1 << 14, 64 << 20
# slots and sources whose distances one task adds up
PIECE, BLOCK = 512, 64
# terms, or slots, that a task holds before it hands its counts on
HELD = 1 << 19
_LEVELS = 48
_STEP = np.uint64(0x9E3779B97F4A7C15)

_TO_SPACE = bytes(c if c >= 0x80 or chr(c).isalpha() else 0x20 for c in range(256)).lower()


def terms_of(raw: bytes) -> list[bytes]:
    """Runs of letters and of characters beyond ASCII, A-Z in lower case."""
    return raw.translate(_TO_SPACE).split()


class PerfectHash:
    """Minimal perfect hash of a set of keys, with the keys in slot order."""

    def __init__(self, seed: int, levels: list[np.ndarray], keys: pa.Array):
        self.seed, self.levels, self.keys = seed, levels, keys
        self.ranks, before = [], 0
        for bits in levels:
            self.ranks.append(np.cumsum(bits, dtype=np.int64) + (before - 1))
            before += int(bits.sum())

    @staticmethod
    def digests(keys: Iterable[bytes], seed: int) -> np.ndarray:
        return np.frombuffer(b"".join(xxhash.xxh3_128_digest(k, seed) for k in keys), np.uint64).reshape(-1, 2)

    @staticmethod
    def _place(digests: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix(digests[:, 0] ^ mix(digests[:, 1] + np.uint64(level * int(_STEP) % (1 << 64)))) % np.uint64(size)).astype(np.int64)

    @classmethod
    def build(cls, keys: list[bytes]) -> PerfectHash:
        """``keys`` are distinct. Keys that no level parts, which takes equal digests, get another seed."""
        for seed in range(64):
            digests, left, levels, order = cls.digests(keys, seed), np.arange(len(keys)), [], []
            while len(left) and len(levels) < _LEVELS:
                size = max(8, 2 * len(left))
                place = cls._place(digests[left], len(levels), size)
                alone = np.bincount(place, minlength=size) == 1
                levels.append(alone)
                settled = alone[place]
                order.append(left[settled][np.argsort(place[settled], kind="stable")])
                left = left[~settled]
            if not len(left):
                slots = np.concatenate([*order, np.zeros(0, np.int64)]).astype(np.int64)
                return cls(seed, levels, pa.array(keys, pa.large_binary()).take(pa.array(slots)))
        raise ValueError("repeated keys")

    def slots(self, keys: list[bytes]) -> np.ndarray:
        """The slot of each key, -1 for one that is not stored."""
        out, rest, digests = np.full(len(keys), -1, np.int64), np.arange(len(keys)), self.digests(keys, self.seed)
        for level, (bits, ranks) in enumerate(zip(self.levels, self.ranks, strict=True)):
            place = self._place(digests[rest], level, len(bits))
            hit = bits[place]
            out[rest[hit]] = ranks[place[hit]]
            rest = rest[~hit]
        found = np.flatnonzero(out >= 0)
        same = pc.equal(self.keys.take(pa.array(out[found])), pa.array(keys, pa.large_binary()).take(pa.array(found)))
        out[found[~same.to_numpy(zero_copy_only=False)]] = -1
        return out

    def pack(self) -> bytes:
        sink = pa.BufferOutputStream()
        bits = [np.packbits(x).tobytes() for x in self.levels]
        sizes = [len(x) for x in self.levels]
        head = pa.record_batch({"seed": pa.array([self.seed]), "sizes": pa.array([sizes], pa.list_(pa.int64())), "bits": pa.array([bits], pa.list_(pa.large_binary())), "keys": pa.array([self.keys.to_pylist()], pa.list_(pa.large_binary()))})
        with pa.ipc.new_stream(sink, head.schema) as w:
            w.write_batch(head)
        return sink.getvalue().to_pybytes()

    @classmethod
    def unpack(cls, blob: bytes) -> PerfectHash:
        b = pa.ipc.open_stream(blob).read_next_batch()
        sizes, bits = b["sizes"][0].as_py(), b["bits"][0].as_py()
        return cls(b["seed"][0].as_py(), [np.unpackbits(np.frombuffer(x, np.uint8), count=n).astype(bool) for x, n in zip(bits, sizes, strict=True)], b["keys"].flatten())


def shard_of(keys: list[bytes], n: int) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(k, 7) % n for k in keys), np.int64, len(keys))


def _raw(column: pa.Array) -> list[bytes]:
    return column.cast(pa.large_binary()).to_pylist()


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``lang, term, docs``: in how many texts of a task a term is, in portions of bounded size."""
    seen: dict[str, Counter] = defaultdict(Counter)

    def out() -> Iterator[pa.RecordBatch]:
        for lang, c in seen.items():
            terms, docs = pa.array(c.keys(), pa.large_binary()).cast(pa.large_string()).cast(pa.string()), pa.array(c.values(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(c), pa.string()), terms, docs], names=["lang", "term", "docs"])
        seen.clear()

    for b in in_slices(batches):
        for lang, text in zip(b.column(0).to_pylist(), _raw(b.column(1)), strict=True):
            seen[lang].update(set(terms_of(text)))
        if sum(map(len, seen.values())) > HELD:
            yield from out()
    yield from out()


def kept_terms(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """``lang, term`` in at least ``min_docs`` of the language's documents."""
    counted = docs.select("lang", "text").mapInArrow(_frequencies, "lang string, term string, docs bigint")
    return counted.groupBy("lang", "term").agg(F.sum("docs").alias("docs")).where(F.col("docs") >= min_docs).select("lang", "term")


def _shards(kept: DataFrame, sizes: DataFrame) -> DataFrame:
    """``lang, shard, n, bytes, hash``: the perfect hash of every shard, built where its terms are."""

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lang, term, n = b.columns
            keys, n = _raw(term), n.to_pylist()
            shard = np.fromiter((xxhash.xxh64_intdigest(k, 7) % m for k, m in zip(keys, n, strict=True)), np.int64, len(keys))
            yield pa.RecordBatch.from_arrays([lang, term, pa.array(shard)], names=["lang", "term", "shard"])

    def built(key: tuple, t: pa.Table) -> pa.Table:
        blob = PerfectHash.build(_raw(t["term"].combine_chunks())).pack()
        return pa.table({"lang": [key[0].as_py()], "shard": [key[1].as_py()], "n": [t.num_rows], "bytes": [len(blob)], "hash": [blob]}, schema=pa.schema({"lang": pa.string(), "shard": pa.int64(), "n": pa.int64(), "bytes": pa.int64(), "hash": pa.binary()}))

    n = F.ceil(F.col("terms") / SHARD).cast("long")
    rows = kept.join(sizes, "lang").select("lang", "term", n.alias("n")).mapInArrow(dealt, "lang string, term string, shard bigint")
    return rows.groupBy("lang", "shard").applyInArrow(built, "lang string, shard bigint, n bigint, bytes bigint, hash binary")


def _rounds(listed: list) -> Iterator[list]:
    held, size = [], 0
    for r in listed:
        if held and size + r["bytes"] > ROUND_BYTES:
            yield held
            held, size = [], 0
        held.append(r)
        size += r["bytes"]
    if held:
        yield held


def _recount(docs: DataFrame, shards: DataFrame, first: dict[tuple[str, int], int], part: list) -> DataFrame:
    """``lang, source, piece, counts``: the second pass for one round of shards, at most one row per task, source and piece of slots."""
    spark = docs.sparkSession
    wanted = {lang: {r["shard"] for r in part if r["lang"] == lang} for lang in {r["lang"] for r in part}}
    chosen = [(F.col("lang") == lang) & F.col("shard").isin(list(s)) for lang, s in wanted.items()]
    some = chosen[0]
    for c in chosen[1:]:
        some = some | c
    # at most ROUND_BYTES, or one shard
    blobs = {(r["lang"], r["shard"]): bytes(r["hash"]) for r in shards.where(some).select("lang", "shard", "hash").collect()}
    n_shards = {lang: max(s for x, s in first if x == lang) + 1 for lang in wanted}
    # the round's slots of a language, from and to the ends of pieces
    low = {lang: min(first[lang, s] for s in shards_) // PIECE for lang, shards_ in wanted.items()}
    high = {lang: max(-(-(first[lang, r["shard"]] + r["n"]) // PIECE) for r in part if r["lang"] == lang) for lang in wanted}
    sent = spark.sparkContext.broadcast(blobs)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes: dict[tuple[str, int], PerfectHash] = {}
        known: dict[str, dict[bytes, int]] = defaultdict(dict)
        held: dict[str, dict[str, Counter]] = defaultdict(lambda: defaultdict(Counter))
        dense: dict[tuple[str, str], np.ndarray] = {}

        def look_up(lang: str, keys: list[bytes]) -> Iterator[tuple[bytes, int]]:
            shard, slots = shard_of(keys, n_shards[lang]), np.full(len(keys), -1, np.int64)
            for s in wanted[lang]:
                h = hashes.get((lang, s)) or hashes.setdefault((lang, s), PerfectHash.unpack(sent.value[lang, s]))
                mine = np.flatnonzero(shard == s)
                got = h.slots([keys[i] for i in mine])
                slots[mine] = np.where(got >= 0, got + first[lang, s] - low[lang] * PIECE, -1)
            return zip(keys, slots.tolist(), strict=True)

        def settle() -> None:
            for lang, by_source in held.items():
                slot_of = known[lang]
                if len(slot_of) > HELD:
                    slot_of.clear()
                slot_of.update(look_up(lang, list(set().union(*by_source.values()).difference(slot_of))))
                for source, c in by_source.items():
                    at = np.fromiter(map(slot_of.__getitem__, c), np.int64, len(c))
                    n = np.fromiter(c.values(), np.int64, len(c))
                    counts = dense.setdefault((lang, source), np.zeros((high[lang] - low[lang]) * PIECE, np.int64))
                    counts[at[at >= 0]] += n[at >= 0]  # a term has one place in a counter
            held.clear()

        def out() -> Iterator[pa.RecordBatch]:
            for (lang, source), counts in dense.items():
                pieces = counts.reshape(-1, PIECE)
                some = np.flatnonzero(pieces.any(axis=1))
                data = [narrow(pieces[i]) for i in some]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some), pa.string()), pa.array([source] * len(some), pa.string()), pa.array(some + low[lang]), pa.array(data, pa.binary())], names=["lang", "source", "piece", "counts"])
            dense.clear()

        for b in in_slices(batches, 2048):
            # a source's texts one after the other: its counter stays in the processor's cache
            for lang, source, text in sorted(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), _raw(b.column(2)), strict=True), key=lambda r: r[:2]):
                held[lang][source].update(terms_of(text))
            if sum(len(c) for by_source in held.values() for c in by_source.values()) > HELD:
                settle()
            if sum(map(len, dense.values())) > 16 * HELD:
                yield from out()
        settle()
        yield from out()

    rows = docs.where(F.col("lang").isin(list(wanted))).select("lang", "source", "text")
    return rows.mapInArrow(counted, "lang string, source string, piece bigint, counts binary")


def narrow(counts: np.ndarray) -> bytes:
    """Counts in as few bytes each as the largest needs; the length tells how many."""
    return counts.astype(np.min_scalar_type(int(counts.max()))).tobytes()


def _added_up(found: DataFrame) -> DataFrame:
    """``lang, source, slot, n`` from dense pieces: equal ones lie side by side in a sorted partition and are added one by one."""

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, total = None, np.zeros(PIECE, np.int64)

        def out() -> pa.RecordBatch:
            at = np.flatnonzero(total)
            return pa.RecordBatch.from_arrays([pa.array([key[0]] * len(at), pa.string()), pa.array([key[1]] * len(at), pa.string()), pa.array(at + key[2] * PIECE), pa.array(total[at])], names=["lang", "source", "slot", "n"])

        for b in batches:
            for *its, data in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if its != key:
                    if key is not None:
                        yield out()
                    key, total = its, np.zeros(PIECE, np.int64)
                total += np.frombuffer(data, f"u{len(data) // PIECE}").astype(np.int64)
        if key is not None:
            yield out()

    keys = ["lang", "source", "piece"]
    return found.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(added, "lang string, source string, slot bigint, n bigint")


def _saved(df: DataFrame, name: str) -> DataFrame:
    path = scratch(df.sparkSession, f"divergence-{name}")
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(10**9 * (n + 5) / (total + 5 * terms)), in whole numbers of 38 digits."""
    wide = lambda c: c.cast("decimal(20,0)")
    over = F.call_function("div", wide(n + 5) * F.lit(10**9).cast("decimal(10,0)"), wide(total + 5 * F.greatest(terms, F.lit(1))))
    return (over + 1).cast("long")


def _distances(cells: DataFrame) -> DataFrame:
    """``lang, a, b, value`` of pairs of sources a < b, from ``lang, piece, width, source, block, blocks, slot, p``.

    A row of slot -1 gives the share of a source's terms without a row. A task gets two blocks of sources and one piece of slots.
    """

    def added(key: tuple, t: pa.Table) -> pa.Table:
        lang, piece, i, j = (k.as_py() for k in key)
        names, row = np.unique(t["source"].to_numpy().astype(object), return_inverse=True)
        of_row, width, slot, share = (t[c].to_numpy() for c in ("block", "width", "slot", "p"))
        block, none, rest = np.zeros(len(names), np.int64), np.zeros(len(names), np.int64), slot < 0
        block[row], none[row[rest]] = of_row, share[rest]
        p = np.repeat(none[:, None], width[0], axis=1)
        p[row[~rest], slot[~rest] - piece * PIECE] = share[~rest]
        a, b, value = [], [], [np.zeros(0, np.int64)]
        for x in range(len(names)):
            ys = np.arange(x + 1, len(names))
            ys = ys if i == j else ys[block[ys] != block[x]]
            a += [names[x]] * len(ys)
            b += list(names[ys])
            value.append(np.abs(p[ys] - p[x]).sum(axis=1))
        return pa.table({"lang": pa.array([lang] * len(a), pa.string()), "a": pa.array(a, pa.string()), "b": pa.array(b, pa.string()), "value": pa.array(np.concatenate(value).astype(np.int64))})

    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    dealt = cells.withColumn("_o", other).withColumns({"i": F.least("block", "_o"), "j": F.greatest("block", "_o")}).drop("_o", "blocks")
    parts = dealt.groupBy("lang", "piece", "i", "j").applyInArrow(added, "lang string, a string, b string, value bigint")
    return parts.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def _counts(spark: SparkSession, docs: DataFrame, min_docs: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Stored tables: occurrences (lang, source, slot, n), names (lang, slot, term), groups (lang, source, total, lang_total, terms, sources)."""
    kept = _saved(kept_terms(docs, min_docs), "kept")
    sizes = _saved(kept.groupBy("lang").agg(F.count(F.lit(1)).alias("terms")), "sizes")
    shards = _saved(_shards(kept, sizes), "shards")
    listed = shards.select("lang", "shard", "n", "bytes").orderBy("lang", "shard").collect()  # one row per SHARD terms
    first, at = {}, Counter()
    for r in listed:
        first[r["lang"], r["shard"]] = at[r["lang"]]
        at[r["lang"]] += r["n"]

    def spelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lang, shard, blob in zip(*(c.to_pylist() for c in b.columns), strict=True):
                keys = PerfectHash.unpack(blob).keys
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(np.arange(len(keys)) + first[lang, shard]), keys.cast(pa.large_string()).cast(pa.string())], names=["lang", "slot", "term"])

    names = shards.select("lang", "shard", "hash").mapInArrow(spelled, "lang string, slot bigint, term string")
    found = spark.createDataFrame([], "lang string, source string, piece bigint, counts binary")
    for part in _rounds(listed):
        found = found.unionByName(_recount(docs, shards, first, part))
    counts = _saved(_added_up(found), "counts")
    groups = docs.select("lang", "source").distinct().join(counts.groupBy("lang", "source").agg(F.sum("n").alias("total")), ["lang", "source"], "left").na.fill(0, ["total"])
    groups = _saved(groups, "sources")
    langs = groups.groupBy("lang").agg(F.sum("total").alias("lang_total"), F.count(F.lit(1)).alias("sources"))
    return counts, names, _saved(groups.join(langs, "lang").join(sizes, "lang", "left").na.fill(0, ["terms"]), "groups")


def divergence(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """``lang, source, part, item, value, rank`` of ``docs`` (``lang``, ``source``, ``text``).

    Part ``pair``: the distance of a source to each other source of its language, summed over all kept terms. Part
    ``term``: the ``top`` terms that the source uses more than its language does. Values are billionths.

    NULL in any column is read as an empty string. A row is a document, so repeated rows count again. Groups without
    terms have equal shares of all terms; without kept terms distances are 0. Equal values rank by the item's bytes.
    An empty table gives no rows, the length of a text does not matter, and other columns are ignored.
    """
    docs = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    counts, names, groups = _counts(docs.sparkSession, docs, min_docs)
    used = counts.join(groups, ["lang", "source"])
    share = _share(F.col("n"), F.col("total"), F.col("terms"))

    whole = F.sum("n").over(Window.partitionBy("lang", "slot"))
    more = share - _share(whole, F.col("lang_total"), F.col("terms"))
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = used.join(names, ["lang", "slot"]).select("lang", "source", F.col("term").alias("item"), more.alias("value")).where("value > 0")
    terms = terms.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)

    blocks = F.ceil(F.col("sources") / BLOCK).cast("long")
    place = {"blocks": blocks, "block": F.pmod(F.xxhash64("source"), blocks)}
    width = F.least(F.lit(PIECE).cast("long"), F.col("terms") - F.col("piece") * PIECE)
    pieces = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.ceil(F.col("terms") / PIECE).cast("long"), F.lit(1).cast("long")) - 1))
    columns = ["lang", "piece", "width", "source", "block", "blocks", "slot", "p"]
    rows = used.withColumns({**place, "piece": F.floor(F.col("slot") / PIECE).cast("long"), "p": share}).withColumn("width", width).select(columns)
    rest = groups.withColumns({**place, "piece": pieces, "slot": F.lit(-1).cast("long"), "p": _share(F.lit(0), F.col("total"), F.col("terms"))}).withColumn("width", width).select(columns)
    apart = _distances(rows.unionByName(rest))
    pairs = apart.select("lang", F.col("a").alias("source"), F.col("b").alias("item"), "value").unionByName(apart.select("lang", F.col("b").alias("source"), F.col("a").alias("item"), "value"))
    pairs = pairs.withColumn("rank", F.row_number().over(best))

    out = pairs.withColumn("part", F.lit("pair")).unionByName(terms.withColumn("part", F.lit("term")))
    return out.select("lang", "source", "part", "item", "value", "rank")
