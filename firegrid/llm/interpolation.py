"""Language-model scoring by deleted interpolation of word bigrams.

p(v | u) = a2 * c(u v) / c(u) + a1 * c(v) / N + a0 / (V + 1), the weights a depending on how often the context u was
seen (buckets of powers of two). They are learned by expectation-maximisation on held-out counts: each of the four training
folds in turn is deleted from all counts, and its bigrams are predicted by the other three.

How the counts reach the texts: words seen often enough (at most ``2**INDEX_BITS``) get an index and their counts are
broadcast, a bound whatever the input. Bigrams of indexed words travel as 40-bit codes to the task that counts
them, bigrams with one rare word to the task that counts this word, together with the document they score; the few
of two rare words are joined with the table of counts. Very frequent bigrams are spread over all tasks, their counts
summed there and broadcast. A text's scores are summed where its key belongs. The codes are shuffled once and read
twice (counts for the weights, then scores), which is why this part is an RDD: a lost executor's share is made again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from firegrid.llm.shingles import TextHasher, mix
from firegrid.llm.toxicity import fold as fold_of
from firegrid.session import scratch

HELD_OUT = 1
FOLDS = (0, 2, 3, 4)  # training folds, in the order of count columns
TEST = 4
INDEX_BITS = 19
PAIRS = 1 << 15
# a bigram that makes up this share of some chunk may be spread
PAIR_SHARE = 2.0**-14
# words worked on at once, and words whose counts are merged before they are sent
CHUNK = 1 << 18
COUNT_CHUNK = 1 << 20
# about 100 bytes each while they are counted; more for larger executors
EVENTS_PER_TASK = 2_000_000
# bigrams that a task counts at once
SLICE = 1 << 19
CONTEXT_BUCKETS = 32
ROUNDS = 200
_COUNTS = [f"c{f}" for f in FOLDS]
# hashes of the two marks, no word's
START, END = (np.uint64(xxhash.xxh64_intdigest(x)) for x in (b" start", b" end"))
_RARE = np.uint64(1 << 63)
_SLOT = np.full(5, TEST, np.int64)
_SLOT[list(FOLDS)] = range(4)


def _keyed(docs: DataFrame) -> DataFrame:
    """``k`` (hash of id and text, the same for repeated rows), ``doc_id``, ``fold``, ``text``."""
    return docs.select(F.xxhash64(F.coalesce("doc_id", F.lit(0)), F.coalesce("text", F.lit(""))).alias("k"), F.col("doc_id").cast("long").alias("doc_id"), fold_of(F.col("doc_id")).cast("int").alias("fold"), "text")


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts per fold of a chunk's training words (key, NULL), and of bigrams that are frequent in it (key, next)."""
    hasher, held, slots, size = TextHasher(), [], [], 0

    def counted() -> pa.RecordBatch:
        v, slot = np.concatenate(held), np.concatenate(slots)
        words, inverse = np.unique(v, return_inverse=True)
        n = np.bincount(inverse * 4 + slot, minlength=4 * len(words)).reshape(-1, 4)
        u = _contexts(v, v == END, START)
        _, first, m = np.unique(mix(u * np.uint64(0x9E3779B97F4A7C15) + v), return_index=True, return_counts=True)
        often = m >= max(16, len(v) * PAIR_SHARE)
        key = np.concatenate([words, u[first[often]]]).view(np.int64)
        after = pa.array(np.concatenate([np.zeros(len(words), np.uint64), v[first[often]]]).view(np.int64), mask=np.arange(len(key)) < len(words))
        count = np.concatenate([n, np.stack([m[often], *[np.zeros(often.sum(), np.int64)] * 3], axis=1)])
        return pa.RecordBatch.from_arrays([pa.array(key), after, *(pa.array(count[:, i]) for i in range(4))], names=["key", "next", *_COUNTS])

    for b in batches:
        slot = _SLOT[b.column(0).to_numpy()]
        for lo, hi in _runs(b.column(1)):
            flat, n = hasher.words(b.column(1)[lo:hi].to_pylist())
            held.append(_ended(flat, n, END))
            slots.append(np.repeat(slot[lo:hi], n + 1))
            size += len(held[-1])
            if size >= COUNT_CHUNK:
                yield counted()
                held, slots, size = [], [], 0
    if held:
        yield counted()


def _runs(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Ranges of a batch's texts that hold about ``CHUNK`` words."""
    lo = total = 0
    for hi, n in enumerate(pc.fill_null(pc.binary_length(texts), 0).to_pylist(), 1):
        total += n
        if total >= 6 * CHUNK or hi == len(texts):
            yield lo, hi
            lo, total = hi, 0


def _ended(flat: np.ndarray, counts: np.ndarray, end: int | np.uint64) -> np.ndarray:
    """Words of texts one after another, each text closed by its end."""
    out = np.full(len(flat) + len(counts), end, np.uint64)
    inside = np.ones(len(out), bool)
    inside[np.cumsum(counts + 1) - 1] = False
    out[inside] = flat
    return out


def _contexts(v: np.ndarray, ends: np.ndarray, start: int | np.uint64) -> np.ndarray:
    """The word before each word; after an end a text starts."""
    u = np.empty_like(v)
    u[1:] = np.where(ends[:-1], np.uint64(start), v[:-1])
    u[:1] = start
    return u


def _pack(k: np.ndarray, slot: np.ndarray, doc: np.ndarray, *columns: np.ndarray) -> tuple:
    """Events in order of documents: keys, folds and run lengths of documents, then the events' columns."""
    first = np.flatnonzero(np.append(True, doc[1:] != doc[:-1])) if len(doc) else np.zeros(0, np.int64)
    return (k[doc[first]], slot[doc[first]].astype(np.uint8), np.diff(np.append(first, len(doc))).astype(np.int32), *columns)


class Table:
    """Counts of indexed words (START and END last), totals, and the codes of very frequent bigrams."""

    def __init__(self, words: np.ndarray, counts: np.ndarray, pairs: np.ndarray, n: np.ndarray, v: int, tasks: int):
        self.words, self.counts, self.pairs, self.n, self.v, self.tasks = words, counts, pairs, n, v, tasks
        self.start, self.end = len(words), len(words) + 1
        self.total = counts.sum(axis=1)

    def codes(self, h: np.ndarray) -> np.ndarray:
        """Index of each word; of rare words the hash with the top bit set."""
        # the first bits of a hash lead to the few indexed words that share them
        bits = np.uint64(64 - max(1, len(self.words).bit_length()))
        first = np.searchsorted(self.words, np.arange(1 << (64 - int(bits)), dtype=np.uint64) << bits)
        at = first[(h >> bits).astype(np.int64)]
        out = h | _RARE
        left = np.arange(len(h))
        while len(left):
            left = left[at[left] < len(self.words)]
            here = self.words[at[left]]
            same = here == h[left]
            out[left[same]] = at[left[same]]
            left = left[here < h[left]]
            at[left] += 1
        return out

    def parts(self) -> tuple:
        return self.words, self.counts, self.pairs, self.n, self.v, self.tasks


def _events(rows: Iterator, table: Table) -> Iterator[tuple[int, tuple]]:
    """(task, section) of all bigrams of a partition's texts, packed chunk by chunk.

    Sections: ``hh`` both words indexed, ``ru`` rare context, ``rv`` rare word, ``rr`` both rare (at the word's
    task; ``cu`` lets the context's task count it), ``d`` the documents themselves.
    """
    bits = np.uint64(INDEX_BITS)
    chunk = min(max(CHUNK, table.tasks << 12), CHUNK << 4)
    hasher = TextHasher()

    def packed(held: list) -> Iterator[tuple[int, tuple]]:
        k = np.array([x[0] for x in held], np.int64)
        slot = _SLOT[np.array([x[2] for x in held])]
        flat, sizes = hasher.words([x[3] for x in held])
        v, sizes = _ended(table.codes(flat), sizes, table.end), sizes + 1
        del flat
        ends = np.cumsum(sizes)
        u = _contexts(v, v == np.uint64(table.end), table.start)
        doc = np.repeat(np.arange(len(held)), sizes)
        rare_u, rare_v = u >= _RARE, v >= _RARE
        both = ~rare_u & ~rare_v
        base = np.where(rare_v, 0.0, np.log10(table.total[np.where(rare_v, 0, v).astype(np.int64)] + 0.5) - np.log10(table.n.sum() + 0.5 * (table.v + 1)))
        known = ~rare_v & (table.total[np.where(rare_v, 0, v).astype(np.int64)] > 0)
        whole = np.add.reduceat(base, ends - sizes), np.add.reduceat(known.astype(np.int64), ends - sizes)
        yield int(k[0] % table.tasks), ("d", k, np.array([x[1] if x[1] is not None else 0 for x in held], np.int64), np.array([x[1] is None for x in held]), slot.astype(np.uint8), sizes, *whole)

        def dealt(section: str, task: np.ndarray, at: np.ndarray, *columns: np.ndarray) -> Iterator[tuple[int, tuple]]:
            task = task.astype(np.int32)
            order = np.argsort(task, kind="stable")
            cut = np.searchsorted(task[order], np.arange(table.tasks + 1))
            for t in np.flatnonzero(np.diff(cut)):
                o = order[cut[t] : cut[t + 1]]
                yield int(t), (section, *_pack(k, slot, at[o], *(c[o] for c in columns)))

        tasks = np.uint64(table.tasks)
        code = (u[both] << bits) | v[both]
        task = mix(code) % tasks
        if len(table.pairs):
            i = np.minimum(np.searchsorted(table.pairs, code), len(table.pairs) - 1)
            task = np.where(table.pairs[i] == code, (doc[both] + int(k[0] % table.tasks)).astype(np.uint64) % tasks, task)
        yield from dealt("hh", task, doc[both], (code & np.uint64(0xFFFFFFFF)).astype(np.uint32), (code >> np.uint64(32)).astype(np.uint8))
        x = rare_u & ~rare_v
        yield from dealt("ru", u[x] % tasks, doc[x], u[x], v[x].astype(np.uint32))
        x = ~rare_u & rare_v
        yield from dealt("rv", v[x] % tasks, doc[x], v[x], u[x].astype(np.uint32))
        x = rare_u & rare_v
        yield from dealt("rr", v[x] % tasks, doc[x], v[x], u[x])
        yield from dealt("cu", u[x] % tasks, doc[x], u[x])

    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[3] or "") + 6
        if size >= 6 * chunk:
            yield from packed(held)
            held, size = [], 0
    if held:
        yield from packed(held)


def _gather(records: Iterator[tuple[int, tuple]]) -> dict[str, list[np.ndarray]]:
    """Sections of one task, their columns joined."""
    parts: dict[str, list[tuple]] = {}
    for _, (section, *columns) in records:
        parts.setdefault(section, []).append(tuple(columns))
    out = {}
    for section in list(parts):
        rows = parts.pop(section)
        out[section] = [np.concatenate([r[i] for r in rows]) for i in range(len(rows[0]))]
    return out


def _per_fold(group: np.ndarray, slot: np.ndarray, n: int) -> np.ndarray:
    """Counts by group and fold; texts held out from training count in none."""
    return np.bincount(group * 5 + slot.astype(np.int64), minlength=5 * n).reshape(n, 5)[:, :4]


class Bigrams:
    """Distinct bigrams of a section: counts per fold of bigram, context and word, and each event's bigram."""

    def __init__(self, cuv, cu, cv, inverse):
        self.cuv, self.cu, self.cv, self.inverse = cuv, cu, cv, inverse


def _sections(parts: dict[str, list[np.ndarray]], table: Table, spread: np.ndarray | None) -> Iterator[tuple[str, np.ndarray, np.ndarray, np.ndarray, np.ndarray | slice, Bigrams, np.ndarray]]:
    """(section, keys, runs, slots of events, which events, bigrams, their own values) of each kind of event.

    ``spread``: counts of the very frequent bigrams; without them these have the counts of this task alone.
    """
    mask = np.uint64((1 << INDEX_BITS) - 1)

    def events(section: str) -> tuple:
        k, slot, runs, *columns = parts[section]
        return k, runs, np.repeat(slot, runs), columns

    if "hh" in parts:
        k, runs, slot, (low, high) = events("hh")
        codes = low.astype(np.uint64) | (high.astype(np.uint64) << np.uint64(32))
        pieces = -(-len(codes) // SLICE)
        piece = ((mix(codes) >> np.uint64(32)) % np.uint64(pieces)).astype(np.uint16)
        for p in range(pieces):
            some = np.flatnonzero(piece == p)
            code, inverse = np.unique(codes[some], return_inverse=True)
            cuv = _per_fold(inverse, slot[some], len(code))
            if len(table.pairs) and spread is not None:
                i = np.minimum(np.searchsorted(table.pairs, code), len(table.pairs) - 1)
                hot = table.pairs[i] == code
                cuv[hot] = spread[i[hot]]
            u, v = (code >> np.uint64(INDEX_BITS)).astype(np.int64), (code & mask).astype(np.int64)
            yield "hh", k, runs, slot, some, Bigrams(cuv, table.counts[u], table.counts[v], inverse), code

    everything = slice(None)

    def rare(names: tuple[str, ...]) -> tuple[np.ndarray, np.ndarray]:
        """Rare words of this task and their counts, from all sections that count them."""
        got = [(events(s)[3][0], events(s)[2]) for s in names if s in parts]
        words, inverse = np.unique(np.concatenate([w for w, _ in got]), return_inverse=True)
        return words, _per_fold(inverse, np.concatenate([s for _, s in got]), len(words))

    if "ru" in parts:
        words, counts = rare(("ru", "cu"))
        k, runs, slot, (u, v) = events("ru")
        i = np.searchsorted(words, u).astype(np.uint64)
        pair, inverse = np.unique((i << np.uint64(INDEX_BITS)) | v.astype(np.uint64), return_inverse=True)
        at = (pair >> np.uint64(INDEX_BITS)).astype(np.int64)
        yield "ru", k, runs, slot, everything, Bigrams(_per_fold(inverse, slot, len(pair)), counts[at], table.counts[(pair & mask).astype(np.int64)], inverse), pair
    if "rv" in parts or "rr" in parts:
        words, counts = rare(("rv", "rr"))
        if "rv" in parts:
            k, runs, slot, (v, u) = events("rv")
            i = np.searchsorted(words, v).astype(np.uint64)
            pair, inverse = np.unique((i << np.uint64(INDEX_BITS)) | u.astype(np.uint64), return_inverse=True)
            at = (pair >> np.uint64(INDEX_BITS)).astype(np.int64)
            yield "rv", k, runs, slot, everything, Bigrams(_per_fold(inverse, slot, len(pair)), table.counts[(pair & mask).astype(np.int64)], counts[at], inverse), pair
        if "rr" in parts:
            k, runs, slot, (v, u) = events("rr")
            i = np.searchsorted(words, v)
            both = np.stack([i.astype(np.uint64), u], axis=1)
            pair, inverse = np.unique(both, axis=0, return_inverse=True)
            yield "rr", k, runs, slot, everything, Bigrams(_per_fold(inverse.ravel(), slot, len(pair)), np.zeros((len(pair), 4), np.int64), counts[pair[:, 0].astype(np.int64)], inverse.ravel()), pair[:, 1]


def context_bucket(c: np.ndarray) -> np.ndarray:
    """0 for unseen contexts, then 1 + floor(log2(count)), at most ``CONTEXT_BUCKETS - 1``."""
    return np.minimum(np.frexp(c.astype(float))[1], CONTEXT_BUCKETS - 1)


def _cells(uv: np.ndarray, u: np.ndarray, v: np.ndarray, n: np.ndarray, times: np.ndarray) -> pd.DataFrame:
    """Held-out events by context bucket and size of both estimates: ``b, q2, q1, n, s2, s1`` (number, sums of estimates)."""
    f2, f1 = np.where(u > 0, uv / np.maximum(u, 1), 0.0), v / np.maximum(n, 1)
    grade = lambda p: np.where(p > 0, np.round(-4 * np.log2(np.maximum(p, 1e-300))), -1).astype(np.int64)
    cells = pd.DataFrame({"b": context_bucket(u).astype(np.int64), "q2": grade(f2), "q1": grade(f1), "n": times.astype(float), "s2": f2 * times, "s1": f1 * times})
    return cells.groupby(["b", "q2", "q1"], as_index=False).sum()


def held_out_cells(b: Bigrams, n: np.ndarray) -> pd.DataFrame:
    """Cells of all events of distinct bigrams, each predicted by the counts without its fold. ``n``: tokens by fold."""
    x, f = np.nonzero(b.cuv)
    times = b.cuv[x, f]
    return _cells(b.cuv[x].sum(axis=1) - times, b.cu[x].sum(axis=1) - b.cu[x, f], b.cv[x].sum(axis=1) - b.cv[x, f], n.sum() - n[f], times)


def learn_weights(cells: pd.DataFrame, v: int) -> np.ndarray:
    """Weights (bucket, [bigram, word, uniform]) by expectation-maximisation; unseen buckets take their neighbour's."""
    weights = np.full((CONTEXT_BUCKETS, 3), np.nan)
    for b, c in cells.groupby("b"):
        n = c["n"].to_numpy(float)
        parts = np.stack([c["s2"] / n, c["s1"] / n, np.full(len(c), 1.0 / (v + 1))], axis=1)
        w = np.full(3, 1 / 3)
        for _ in range(ROUNDS):
            post = parts * w
            post /= post.sum(axis=1, keepdims=True)
            w = n @ post / n.sum()
        w = np.maximum(w, [0.0, 0.0, 1e-9])
        weights[int(b)] = w / w.sum()
    if np.isnan(weights).all():
        return np.tile([0.0, 0.0, 1.0], (CONTEXT_BUCKETS, 1))
    return pd.DataFrame(weights).ffill().bfill().to_numpy()


def log_probability(b: Bigrams, n: int, v: int, weights: np.ndarray) -> np.ndarray:
    """log10 of the interpolated probability of each distinct bigram, from all training counts."""
    cuv, cu, cv = b.cuv.sum(axis=1), b.cu.sum(axis=1), b.cv.sum(axis=1)
    w = weights[context_bucket(cu)]
    return np.log10(w[:, 0] * cuv / np.maximum(cu, 1) + w[:, 1] * cv / max(n, 1) + w[:, 2] / (v + 1))


def score(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``, a row per row of ``docs``.

    Tokens are words in A-Z lower case and one end per text; all texts of folds other than ``HELD_OUT`` train, all texts
    are scored whole. ``base_score`` is the add-half unigram of the training counts. NULL and empty texts are one end token.
    Rows with a NULL id belong to fold 0. Repeated rows train as often as they occur and get equal scores. Without training
    texts every token has probability 1 / (0 + 1). Words are compared by 63-bit hashes. Other columns are ignored.
    """
    spark = docs.sparkSession
    sc = spark.sparkContext
    keyed = _keyed(docs)
    path = scratch(spark, "lm-counts")
    counted = keyed.where(F.col("fold") != HELD_OUT).select("fold", "text").mapInArrow(_count_words, "key bigint, next bigint, " + ", ".join(f"{c} bigint" for c in _COUNTS))
    counted.groupBy("key", "next").agg(*[F.sum(c).alias(c) for c in _COUNTS]).write.parquet(path)
    counted = spark.read.parquet(path)
    words = counted.where("next IS NULL").drop("next").withColumn("c", F.expr("+".join(_COUNTS)))
    t = _table(words, counted.where("next IS NOT NULL"), keyed)
    table = sc.broadcast(t.parts())
    tasks = t.tasks

    deals = keyed.rdd.mapPartitions(lambda rows: _events(rows, Table(*table.value))).partitionBy(tasks, int)

    def first_pass(records: Iterator) -> Iterator[tuple]:
        t = Table(*table.value)
        cells, none = [], (None,) * 6
        for section, k, runs, slot, some, b, own in _sections(_gather(records), t, None):
            if section == "rr":
                event = b.inverse
                rows = np.column_stack([np.repeat(k, runs), slot, own[event].view(np.int64), b.cv[event], b.cuv[event]])
                yield from (("rr", *none, [int(x) for x in r]) for r in rows)
                continue
            if section == "hh" and len(t.pairs):
                i = np.minimum(np.searchsorted(t.pairs, own), len(t.pairs) - 1)
                hot = t.pairs[i] == own
                yield from (("pair", *none, [int(x) for x in r]) for r in np.column_stack([i[hot], b.cuv[hot]]))
                b = Bigrams(b.cuv[~hot], b.cu[~hot], b.cv[~hot], None)
            cells.append(held_out_cells(b, t.n))
        if cells:
            whole = pd.concat(cells).groupby(["b", "q2", "q1"], as_index=False).sum()
            yield from (("cell", int(r.b), int(r.q2), int(r.q1), float(r.n), float(r.s2), float(r.s1), None) for r in whole.itertuples())

    path = scratch(spark, "lm-held-out")
    spark.createDataFrame(deals.mapPartitions(first_pass), "kind string, b int, q2 int, q1 int, n double, s2 double, s1 double, x array<bigint>", verifySchema=False).write.parquet(path)
    first = spark.read.parquet(path)

    # bigrams of two rare words: their task knows all but the context's count
    path = scratch(spark, "lm-rare")
    rare = first.where("kind = 'rr'").select(*[F.col("x")[i].alias(c) for i, c in enumerate(["k", "slot", "u", *(f"v{j}" for j in range(4)), *(f"uv{j}" for j in range(4))])])
    context = words.select(F.col("key").bitwiseOR(F.lit(-(1 << 63))).alias("u"), *[F.col(c).alias(f"u{i}") for i, c in enumerate(_COUNTS)])
    rare.join(context, "u", "left").na.fill(0).write.parquet(path)
    rare = spark.read.parquet(path)

    cells = first.where("kind = 'cell'").select("b", "q2", "q1", "n", "s2", "s1").unionByName(_rare_cells(rare, t.n)).groupBy("b", "q2", "q1").agg(F.sum("n").alias("n"), F.sum("s2").alias("s2"), F.sum("s1").alias("s1")).toPandas()
    pairs = first.where("kind = 'pair'").select(*[F.col("x")[i].alias(f"x{i}") for i in range(5)]).groupBy("x0").agg(*[F.sum(f"x{i}").alias(f"x{i}") for i in range(1, 5)]).toPandas()
    spread = np.zeros((len(t.pairs), 4), np.int64)
    spread[pairs["x0"].to_numpy(np.int64)] = pairs[["x1", "x2", "x3", "x4"]].to_numpy(np.int64)
    code = t.pairs
    hot = Bigrams(spread, t.counts[(code >> np.uint64(INDEX_BITS)).astype(np.int64)], t.counts[(code & np.uint64((1 << INDEX_BITS) - 1)).astype(np.int64)], None)
    weights = learn_weights(pd.concat([cells, held_out_cells(hot, t.n)]).groupby(["b", "q2", "q1"], as_index=False).sum(), t.v)
    spread_there = sc.broadcast(spread)
    trained = int(t.n.sum())

    def second_pass(records: Iterator) -> Iterator[tuple[int, tuple]]:
        t = Table(*table.value)
        n, v = int(t.n.sum()), t.v
        parts = _gather(records)
        norm = np.log10(n + 0.5 * (v + 1))
        logs, bases = {}, []  # by section (keys, runs, events), and of rare words (key, base score, known)
        for section, k, runs, slot, some, b, own in _sections(parts, t, spread_there.value):
            at = np.cumsum(runs) - runs
            if section != "rr":
                events = logs.setdefault(section, (k, at, np.zeros(int(runs.sum()))))[2]
                events[some] = log_probability(b, n, v, weights)[b.inverse]
            if section in ("rv", "rr"):
                c = b.cv.sum(axis=1)
                bases.append((k, np.add.reduceat((np.log10(c + 0.5) - norm)[b.inverse], at), np.add.reduceat((c > 0).astype(np.int64)[b.inverse], at)))

        def dealt(kind: str, k: np.ndarray, *columns: np.ndarray) -> Iterator[tuple[int, tuple]]:
            task = k % t.tasks
            order = np.argsort(task, kind="stable")
            cut = np.searchsorted(task[order], np.arange(t.tasks + 1))
            for i in np.flatnonzero(np.diff(cut)):
                o = order[cut[i] : cut[i + 1]]
                yield int(i), (kind, k[o], *(c[o] for c in columns))

        scores = [(k, np.add.reduceat(events, at)) for k, at, events in logs.values()]
        for kind, rows in (("s", scores), ("b", bases)):
            if rows:
                yield from dealt(kind, *(np.concatenate(c) for c in zip(*rows, strict=True)))
        if "d" in parts:
            yield from dealt("d", *parts["d"])

    def last_pass(records: Iterator) -> Iterator[tuple]:
        parts = _gather(records)
        if "d" not in parts:
            return
        k, doc_id, no_id, slot, sizes, base, known = parts["d"]
        keys, times = np.unique(k, return_counts=True)

        def summed(kind: str, column: int) -> np.ndarray:
            """Per row, what its key was sent; repeated rows of a key were sent it once each."""
            if kind not in parts:
                return np.zeros(len(k))
            return (np.bincount(np.searchsorted(keys, parts[kind][0]), parts[kind][column], len(keys)) / times)[np.searchsorted(keys, k)]

        total, rare_base, rare_known = summed("s", 1), summed("b", 1), summed("b", 2)
        times = times[np.searchsorted(keys, k)]
        for j in range(len(k)):
            yield (int(k[j]), None if no_id[j] else int(doc_id[j]), bool(slot[j] == TEST), int(sizes[j]), int(known[j] + round(rare_known[j])), trained, float(base[j] + rare_base[j]), float(total[j]), int(times[j]))

    rows = deals.mapPartitions(second_pass).partitionBy(tasks, int).mapPartitions(last_pass)
    scored = spark.createDataFrame(rows, "k bigint, doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double, times bigint", verifySchema=False)
    more = _rare_scores(rare, int(t.n.sum()), t.v, weights)
    return scored.join(more, "k", "left").select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", (F.col("score") + F.coalesce(F.col("rare_score") / F.col("times"), F.lit(0.0))).alias("score"))


def _table(words: DataFrame, pairs: DataFrame, keyed: DataFrame) -> Table:
    """What is broadcast: at most ``2**INDEX_BITS`` words, ``PAIRS`` bigrams, and totals."""
    totals = words.agg(*[F.sum(c) for c in _COUNTS], F.count("*")).first()
    n, v = np.array([x or 0 for x in totals[:4]], np.int64), int(totals[4])
    # whole grades of frequency, an eighth of a power of two each, while there is room for them
    words = words.where(F.col("key") != int(END.view(np.int64))).withColumn("grade", F.floor(F.log2("c") * 8))
    least, room = None, (1 << INDEX_BITS) - 2
    for r in sorted(words.groupBy("grade").count().collect(), reverse=True):
        if r["count"] > room:
            break
        least, room = r["grade"], room - r["count"]
    known = words.where(F.col("grade") >= F.lit(least)).select("key", *_COUNTS).toPandas()
    ends = {r["fold"]: r["count"] for r in keyed.where(F.col("fold") != HELD_OUT).groupBy("fold").count().collect()}
    texts = np.array([ends.get(f, 0) for f in FOLDS], np.int64)
    keys = known["key"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(keys)
    # a text has one start and one end
    counts = np.concatenate([known[_COUNTS].to_numpy(np.int64).reshape(-1, 4)[order], [texts], [texts]])
    keys = keys[order]
    top = pairs.orderBy(F.desc("c0"), "key", "next").limit(PAIRS).select("key", "next").toPandas()

    def place(column: str) -> np.ndarray:
        h = top[column].to_numpy(np.int64).view(np.uint64)
        i = np.minimum(np.searchsorted(keys, h), max(len(keys) - 1, 0))
        found = keys[i] == h if len(keys) else np.zeros(len(h), bool)
        return np.where(found, i, np.where(h == START, len(keys), np.where(h == END, len(keys) + 1, -1)))

    u, w = place("key"), place("next")
    both = (u >= 0) & (w >= 0)
    codes = np.unique((u[both].astype(np.uint64) << np.uint64(INDEX_BITS)) | w[both].astype(np.uint64))
    tasks = max(2, -(-int(n.sum()) * 5 // 4 // EVENTS_PER_TASK))
    return Table(keys, counts, codes, n, v, tasks)


def _as_bigrams(p: pd.DataFrame) -> Bigrams:
    take = lambda c: p[[f"{c}{i}" for i in range(4)]].to_numpy(np.int64)
    return Bigrams(take("uv"), take("u"), take("v"), None)


def _rare_cells(rare: DataFrame, n: np.ndarray) -> DataFrame:
    """Held-out cells of bigrams of two rare words; a row of the table is one event that deletes its fold."""

    def cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            p = p[p["slot"] != TEST]
            b, x, f = _as_bigrams(p), np.arange(len(p)), p["slot"].to_numpy(np.int64)
            rest = lambda c: c.sum(axis=1) - c[x, f]
            yield _cells(rest(b.cuv), rest(b.cu), rest(b.cv), n.sum() - n[f], np.ones(len(p)))

    return rare.mapInPandas(cells, "b int, q2 int, q1 int, n double, s2 double, s1 double")


def _rare_scores(rare: DataFrame, n: int, v: int, weights: np.ndarray) -> DataFrame:
    def scores(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            yield pd.DataFrame({"k": p["k"], "rare_score": log_probability(_as_bigrams(p), n, v, weights)})

    return rare.mapInPandas(scores, "k bigint, rare_score double").groupBy("k").agg(F.sum("rare_score").alias("rare_score"))
