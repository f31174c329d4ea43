"""Spelling variants: words one edit apart, found by pairs of numbers of trie nodes.

The words are sorted, and sorted again by their reversal. The nodes of the trie of a sorted list are numbered without
building the trie: a prefix's number is the place at which the list, written out, has it for the first time
(start of the first word with that prefix, plus the prefix's length). Neighbours in the list share the nodes of their common
prefix, so each range of the list is walked on its own; the nodes that reach over the edge of a range come from a
small table of the ranges' first and last words.

A word of L code points then has, with prefix nodes p and suffix nodes s by length,

- ``(p[i], s[L-1-i])`` for each position i it may skip, and
- ``(p[i], s[L-i])`` for each position i at which something may be inserted.

Two words that share a pair of the first kind differ in one replaced code point; a word whose pair of the first kind
is another's pair of the second kind has one code point more. In a run of equal code points only the first is skipped for the
latter, so every two neighbours meet exactly once. A pair of numbers is shared by at most one word per
letter of the alphabet and one that is shorter, however many words there are.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from firegrid.llm.shingles import in_slices
from firegrid.session import cut_lineage, scratch

MIN_CHARS, MIN_COUNT, FACTOR, DAMAGED = 7, 2, 10, 31
# words that a task counts before it hands them on
HELD = 1 << 19
_REPLACED, _EITHER, _WHOLE = 0, 1, 2


def _saved(df: DataFrame, name: str) -> DataFrame:
    path = scratch(df.sparkSession, f"spelling-{name}")
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def damaged(run: str, crc: int) -> str:
    """The run without one code point where ``DAMAGED`` divides its checksum; ``crc``: that of the text before it."""
    h = zlib.crc32(run.encode(), crc)
    at = h % len(run)
    return run if h % DAMAGED else run[:at] + run[at + 1 :]


def words_of(docs: DataFrame, min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT) -> DataFrame:
    """``word, n``: words of at least ``min_chars`` code points with their occurrences, if these are at least ``min_count``.

    Words are runs of ``A-Z a-z`` and U+00C0 to U+00FF, A-Z in lower case, with a sprinkling of typing errors that follows
    from the checksum of doc_id and run. NULL texts have no words, a NULL doc_id is read as empty.
    """
    run = re.compile("[a-zÀ-ÿ]{%d,}" % min_chars)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for b in in_slices(batches):
            for doc, raw in zip(b.column(0).to_pylist(), b.column(1).cast(pa.large_binary()).to_pylist(), strict=True):
                crc = zlib.crc32(f"{doc or ''}:".encode())
                for word, n in Counter(run.findall((raw or b"").lower().decode("utf-8", "surrogatepass"))).items():
                    word = damaged(word, crc)
                    if len(word) >= min_chars:
                        seen[word] += n
            if len(seen) > HELD:
                yield pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], names=["word", "n"])
                seen.clear()
        yield pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], names=["word", "n"])

    rows = docs.select(F.col("doc_id").cast("string"), "text").mapInArrow(counted, "word string, n bigint")
    return rows.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def _common(a: str, b: str) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    lo, hi = 0, n
    while hi - lo > 8:
        mid = (lo + hi) // 2
        lo, hi = (mid, hi) if a[lo:mid] == b[lo:mid] else (lo, mid)
    while a[lo] == b[lo]:
        lo += 1
    return lo


class _Walk:
    """Numbers the nodes of words that come in sorted order. ``base``: place of the first word; ``nodes``: the nodes that
    it shares with the words before it."""

    def __init__(self, base: int = 0, nodes: list[int] | None = None):
        self.at, self.path, self.last = base, nodes or [], None

    def of(self, word: str) -> list[int]:
        known = len(self.path) if self.last is None else _common(self.last, word) + 1
        self.path = self.path[:known] + [self.at + i for i in range(known, len(word) + 1)]
        self.at += len(word) + 1
        self.last = word
        return self.path


def _starts(ends: list) -> dict[int, tuple[int, int, list[int]]]:
    """For each range: words before it, its place, and the nodes its first word shares with the range before."""
    out, rows, base, path, last = {}, 0, 0, [], None
    for r in sorted(ends, key=lambda r: r["part"]):
        shared = path[: _common(last, r["first"]) + 1] if last is not None else []
        out[r["part"]] = (rows, base, shared)
        # nodes of the last word: those of the range's first word may be shared ones
        path = [(shared[x] if x < len(shared) else base + x) if x <= len(r["first"]) else base + x for x in r["path"]]
        rows, base, last = rows + r["words"], base + r["chars"], r["last"]
    return out


def numbered(rows: DataFrame, key: str, rank: str, nodes: str) -> DataFrame:
    """``rows`` in the order of the distinct strings ``key``, with their ``rank`` from 0 and the ``nodes`` of their prefixes."""
    ordered = cut_lineage(rows.repartitionByRange(key).sortWithinPartitions(key))
    at, names = ordered.columns.index(key), ordered.columns

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk, first, n, path = _Walk(), None, 0, []
        for b in batches:
            for word in b.column(0).to_pylist():
                first = word if first is None else first
                path, n = walk.of(word), n + 1
        if n:
            yield pa.RecordBatch.from_pylist([{"part": TaskContext.get().partitionId(), "words": n, "chars": walk.at, "first": first, "last": walk.last, "path": path}], schema=pa.schema([("part", pa.int64()), ("words", pa.int64()), ("chars", pa.int64()), ("first", pa.string()), ("last", pa.string()), ("path", pa.list_(pa.int64()))]))

    # one row per range
    starts = _starts(ordered.select(key).mapInArrow(edges, "part bigint, words bigint, chars bigint, first string, last string, path array<bigint>").collect())

    def walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, base, shared = starts.get(TaskContext.get().partitionId(), (0, 0, []))
        walk = _Walk(base, shared)
        for b in in_slices(batches, 2048):
            paths = [walk.of(word) for word in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(range(n, n + len(paths)), pa.int64()), pa.array(paths, pa.list_(pa.int64()))], names=[*names, rank, nodes])
            n += len(paths)

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in ordered.schema]
    return ordered.mapInArrow(walked, ", ".join([*fields, f"{rank} bigint, {nodes} array<bigint>"]))


def _pairs(tries: DataFrame) -> DataFrame:
    """``p, s, kind, id, n``: the node pairs of every word."""

    def paired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_slices(batches):
            p, s, kind, size = [], [], [], []
            for word, up, down in zip(*(b.column(i).to_pylist() for i in (0, 3, 4)), strict=True):
                last, down = None, down[::-1]
                p += up[:-1]
                s += down[1:]
                for c in word:
                    kind.append(_REPLACED if c == last else _EITHER)
                    last = c
                p += up
                s += down
                kind += [_WHOLE] * len(up)
                size.append(2 * len(up) - 1)
            at = pa.array([i for i, k in enumerate(size) for _ in range(k)], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(p, pa.int64()), pa.array(s, pa.int64()), pa.array(kind, pa.int8()), b.column(2).take(at), b.column(1).take(at)], names=["p", "s", "kind", "id", "n"])

    return tries.select("word", "n", "id", "up", "down").mapInArrow(paired, "p bigint, s bigint, kind tinyint, id bigint, n bigint")


def neighbours(words: DataFrame) -> DataFrame:
    """``id, n, near, near_n``: both directions of every two words one edit apart, each once. ``words``: those of :func:`ranked`."""
    backward = numbered(words.withColumn("_back", F.reverse("word")), "_back", "_rank", "down")
    pairs = _pairs(backward)
    # at most one word per letter and a shorter one share a pair
    together = Window.partitionBy("p", "s")
    met = pairs.withColumn("c", F.count(F.lit(1)).over(together)).where("c > 1")
    groups = met.groupBy("p", "s").agg(F.collect_list(F.struct("kind", "id", "n")).alias("m"))
    near = lambda x, y: (x["id"] != y["id"]) & (((x["kind"] < _WHOLE) & (y["kind"] < _WHOLE)) | (x["kind"] + y["kind"] == _EITHER + _WHOLE))
    found = F.flatten(F.transform("m", lambda x: F.transform(F.filter("m", lambda y: near(x, y)), lambda y: F.struct(x["id"].alias("id"), x["n"].alias("n"), y["id"].alias("near"), y["n"].alias("near_n")))))
    return groups.select(F.inline(found))


def ranked(words: DataFrame) -> DataFrame:
    """``word, n, id, up``, stored: words in code-point order, with the nodes of their prefixes."""
    return _saved(numbered(words.select("word", "n"), "word", "id", "up"), "words")


def _roots(forms: DataFrame) -> DataFrame:
    """``id, form, form_n, root``: every chain of forms followed to its end, in doubling steps.

    A form is ``factor`` times as frequent as its word, so chains are short.
    """
    roots = _saved(forms.withColumn("root", F.col("form")), "roots")
    while True:
        ahead = roots.select(F.col("id").alias("root"), F.col("root").alias("_root"))
        longer = _saved(roots.join(ahead, "root", "left").select("id", "form", "form_n", F.coalesce("_root", "root").alias("root"), F.col("_root").isNotNull().alias("moved")), "roots")
        roots = longer.drop("moved")
        if longer.where("moved").isEmpty():
            return roots


def variants(words: DataFrame, factor: int = FACTOR) -> DataFrame:
    """``word, form, root`` (string), ``n, n_near, form_n`` (long) for ``words`` (distinct ``word``, ``n``).

    ``form`` is the most frequent of the words one inserted, deleted or replaced code point away, the first in code-point
    order among equals, if it is at least ``factor`` times as frequent; ``root`` is where the chain of forms ends,
    the word itself without one. Rows without a word are left out; a repeated word counts with the sum of its
    rows. Words may be of any length. Other columns are ignored, an empty table gives no rows.
    """
    if factor < 2:
        raise ValueError("forms must be more frequent than their words")
    words = ranked(words.where(F.col("word").isNotNull()).groupBy("word").agg(F.sum("n").alias("n")))
    met = neighbours(words).groupBy("id", "n").agg(F.count(F.lit(1)).alias("n_near"), F.max(F.struct("near_n", (-F.col("near")).alias("near"))).alias("best"))
    met = _saved(met.select("id", "n_near", F.when(F.col("best.near_n") >= factor * F.col("n"), F.struct((-F.col("best.near")).alias("id"), F.col("best.near_n").alias("n"))).alias("form")), "near")
    roots = _roots(met.where(F.col("form").isNotNull()).select("id", F.col("form.id").alias("form"), F.col("form.n").alias("form_n")))
    named = lambda c: words.select(F.col("id").alias(c), F.col("word").alias(f"{c}_word"))
    forms = roots.join(named("form"), "form").join(named("root"), "root").select("id", "form_word", "root_word", "form_n")
    out = words.select("id", "word", "n").join(met.select("id", "n_near"), "id", "left").join(forms, "id", "left")
    return out.select("word", F.col("form_word").alias("form"), F.coalesce("root_word", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")
