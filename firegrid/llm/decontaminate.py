"""Benchmark decontamination by SimHash windows and multi-index Hamming search.

Every window of a document that is as long as a benchmark item (up to ``MAX_WINDOW`` words) gets a 64-bit
SimHash of its words. Fingerprints within ``RADIUS`` bits of an item's are found through four blocks of 16 bits:
of 7 differing bits at least one block has no more than one, so each block's table lists the items within one bit
of a value, and no fingerprint within the radius is missed. What is found is compared exactly, by the weighted
similarity of five-word shingles; shingles that many items share weigh less.

A few changed words can move a fingerprint beyond any radius, most of all in short windows. So that no passage is missed,
texts are also searched for each item's leading shingles: so many of its heaviest that the others weigh less than
``SIMILARITY`` of it, and a similar passage holds at least one of them. Around such a shingle every window is compared.

Items are the query set: they go to the tasks in blocks of ``ITEM_BLOCK``, so what is sent has a bound. Documents are read
in place, nothing is shuffled, and memory holds one batch of texts and ``CHUNK`` windows.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from firegrid.llm.shingles import WORDS, WordHashes, in_slices, shingle_hashes

RADIUS = 7
BLOCKS = 4
MAX_WINDOW = 255
SPREAD = 1.5
ITEM_BLOCK = 20_000
CHUNK = 1 << 14
SIMILARITY = 0.75
FILTER_BITS = 22
SHIFTS = (0, -1, 1, -2, 2, -3, 3)  # in words, nearest first
WORD = re.compile(r"\w+")


def words_of(text: str | None) -> list[str]:
    """Words of a whole text without case and punctuation."""
    return WORD.findall((text or "").lower())


# byte -> eight lanes of eight bits, one per bit: window sums of up to 255 words fit a lane
_LANES = np.array([sum(((b >> i) & 1) << (8 * i) for i in range(8)) for b in range(256)], np.uint64)


def running_sums(hashes: np.ndarray) -> np.ndarray:
    """Sums of each bit over the words so far, as lanes; differences of two columns are exact modulo 2**64."""
    sums = np.zeros((8, len(hashes) + 1), np.uint64)
    octets = hashes.view(np.uint8).reshape(-1, 8)
    for j in range(8):
        np.cumsum(_LANES[octets[:, j]], out=sums[j, 1:])
    return sums


_ONES, _TOPS, _GATHER = (np.uint64(x) for x in (0x0101010101010101, 0x8080808080808080, 0x0102040810204080))


def fingerprints(counts: np.ndarray, size: int) -> np.ndarray:
    """SimHashes of windows of ``size`` words as (4, windows) blocks of 16 bits.

    A bit is set where more than half of the words have it: lane + 127 - half then reaches the lane's top bit.
    """
    over = ((counts + _ONES * np.uint64(127 - size // 2)) & _TOPS) >> np.uint64(7)
    octets = (over * _GATHER) >> np.uint64(56)
    return (octets[0::2] | (octets[1::2] << np.uint64(8))).astype(np.uint16)


def simhash(hashes: np.ndarray) -> np.ndarray:
    sums = running_sums(hashes)
    return fingerprints(sums[:, -1:] - sums[:, :1], len(hashes))


def whole(blocks: np.ndarray) -> np.ndarray:
    b = blocks.astype(np.uint64)
    return b[0] | (b[1] << np.uint64(16)) | (b[2] << np.uint64(32)) | (b[3] << np.uint64(48))


@dataclass
class Length:
    """Targets of one window length: fingerprints, their items and places in them, and a table per block."""

    size: int
    prints: np.ndarray
    items: np.ndarray
    offsets: np.ndarray
    tables: list[tuple[np.ndarray, np.ndarray, np.ndarray]]

    def near(self, prints: np.ndarray, inside: np.ndarray) -> list[tuple[int, int]]:
        """(window, target) within the radius, of the windows that lie inside a text."""
        found: set[tuple[int, int]] = set()
        for k, (first, listed, some) in enumerate(self.tables):
            hit = np.nonzero(some[prints[k]] & inside)[0]
            if not len(hit):
                continue
            value = prints[k, hit].astype(np.int64)
            n = first[value + 1] - first[value]
            w = np.repeat(np.arange(len(hit)), n)
            t = listed[np.repeat(first[value] - np.cumsum(n) + n, n) + np.arange(n.sum())]
            close = np.bitwise_count(whole(prints[:, hit])[w] ^ self.prints[t]) <= RADIUS
            found.update(zip(hit[w[close]].tolist(), t[close].tolist(), strict=True))
        return sorted(found)


class Index:
    """A block of items, ready to be searched."""

    def __init__(self, items: list[tuple[object, str]]):
        self.ids = [i for i, _ in items]
        words = [words_of(t) for _, t in items]
        hashes = WordHashes()
        self.shingles = [_shingles(w) for w in words]
        df = Counter(s for x in self.shingles for s in x)
        self.rare = math.log(1 + len(items))
        self.weights = {s: math.log(1 + len(items) / n) for s, n in df.items()}
        self.sizes = [len(w) for w in words]
        grams = [shingle_hashes(hashes.of(w)) for w in words]
        self.hashed = [frozenset(g.tolist()) for g in grams]
        self.weighed = [{h: self.weights[tuple(w[k : k + WORDS])] for k, h in enumerate(g.tolist())} for w, g in zip(words, grams, strict=True)]
        self.totals = [sum(x.values()) for x in self.weighed]
        leading = [(h, i) for i, n in enumerate(self.sizes) if n >= WORDS for h in _leading(self.weighed[i])]
        keys = np.array([h for h, _ in leading], np.uint64)
        order = np.argsort(keys, kind="stable")
        self.leading, self.led = keys[order], np.array([i for _, i in leading], np.int64)[order]
        self.some = np.zeros(1 << FILTER_BITS, bool)
        self.some[self.leading >> np.uint64(64 - FILTER_BITS)] = True
        lengths: list[int] = []
        for n in sorted({min(len(w), MAX_WINDOW) for w in words if w}):
            if not lengths or n > lengths[-1] * SPREAD:
                lengths.append(n)
        groups = defaultdict(list)
        for i, w in enumerate(words):
            if w:
                size = max(x for x in lengths if x <= len(w))
                for at in sorted({0, (len(w) - size) // 2, len(w) - size}):
                    groups[size].append((simhash(hashes.of(w[at : at + size])), i, at))
        self.lengths = [_length(size, rows) for size, rows in sorted(groups.items())]

    def similarity(self, item: int, words: list[str]) -> float:
        """Weighted Jaccard similarity of an item and a passage; the exact check."""
        a, b = self.shingles[item], _shingles(words)
        weight = lambda s: self.weights.get(s, self.rare)
        return math.fsum(map(weight, a & b)) / max(math.fsum(map(weight, a | b)), 1e-12)

    def search(self, texts: list[str | None], hashes: WordHashes) -> Iterator[tuple[int, int, float, int]]:
        """(text, item, similarity, first word) of the best passage for every text and item that match."""
        words = [words_of(t) for t in texts]
        ends = np.cumsum([len(w) for w in words])
        starts = ends - [len(w) for w in words]
        flat = hashes.of(list(chain.from_iterable(words)))
        grams = shingle_hashes(flat)
        best: dict[tuple[int, int], tuple[float, int]] = {}
        tried: set[tuple[int, int, int]] = set()
        for at, target, length in self._candidates(flat, starts, ends):
            doc = int(np.searchsorted(ends, at, "right"))
            item = int(length.items[target])
            place = at - int(starts[doc]) - int(length.offsets[target])
            if best.get((doc, item), (0.0, 0))[0] >= 1.0 or (doc, item, place) in tried:
                continue
            tried.add((doc, item, place))
            begin = max(0, place - max(SHIFTS)) + int(starts[doc])
            if self.sizes[item] >= WORDS and self.hashed[item].isdisjoint(grams[begin : begin + self.sizes[item] + 2 * len(SHIFTS)].tolist()):
                continue  # not one shingle in common, at any shift
            for shift in SHIFTS:
                first = max(0, place + shift)
                found = self.similarity(item, words[doc][first : max(0, place + shift + self.sizes[item])])
                if found >= SIMILARITY - 1e-12:
                    best[doc, item] = max(best.get((doc, item), (found, first)), (found, first), key=_rank)
                if found >= 1.0:
                    break
        for doc, item, places in self._led(grams, starts, ends):
            for first, found in self._windows(item, words[doc], places):
                best[doc, item] = max(best.get((doc, item), (found, first)), (found, first), key=_rank)
        for (doc, item), (found, first) in sorted(best.items()):
            yield doc, item, found, first

    def _led(self, grams: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, int, list[int]]]:
        """(text, item, places of leading shingles) where the text holds enough of the item's shingles to be similar."""
        if not len(self.leading) or not len(grams):
            return
        at = np.flatnonzero(self.some[grams >> np.uint64(64 - FILTER_BITS)])
        doc = np.searchsorted(ends, at, "right")
        inside = at + WORDS <= ends[doc]
        at, doc = at[inside], doc[inside]
        lo, hi = (np.searchsorted(self.leading, grams[at], side) for side in ("left", "right"))
        n = hi - lo
        item = self.led[np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())]
        groups: dict[int, dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
        for d, i, place in zip(np.repeat(doc, n).tolist(), item.tolist(), np.repeat(at - starts[doc], n).tolist(), strict=True):
            groups[d][i].append(place)
        for d, items in groups.items():
            own = set(grams[starts[d] : ends[d] - WORDS + 1].tolist())
            for i, places in items.items():
                if sum(w for h, w in self.weighed[i].items() if h in own) >= (SIMILARITY - 1e-9) * self.totals[i]:
                    yield d, i, places

    def _windows(self, item: int, words: list[str], places: list[int]) -> Iterator[tuple[int, float]]:
        """(first word, similarity) of the similar windows around the places; windows reach over the ends of a text."""
        size, own = self.sizes[item], self.shingles[item]
        weight = lambda s: self.weights.get(s, self.rare)
        done = lo = hi = None  # shingles lo to hi - 1 are counted
        for place in places:
            for first in range(place + WORDS - size if done is None else max(place + WORDS - size, done + 1), place + 1):
                a, b = max(0, first), min(first + size, len(words)) - WORDS + 1
                if done is None or a >= hi:
                    held, both, every = Counter(), 0.0, self.totals[item]
                    lo = hi = a
                for k in range(hi, b):
                    s = tuple(words[k : k + WORDS])
                    held[s] += 1
                    if held[s] == 1:
                        both, every = (both + weight(s), every) if s in own else (both, every + weight(s))
                for k in range(lo, a):
                    s = tuple(words[k : k + WORDS])
                    held[s] -= 1
                    if not held[s]:
                        both, every = (both - weight(s), every) if s in own else (both, every - weight(s))
                done, lo, hi = first, a, b
                if both >= (SIMILARITY - 1e-6) * every:
                    found = self.similarity(item, words[a : first + size])
                    if found >= SIMILARITY - 1e-12:
                        yield a, found

    def _candidates(self, flat: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, int, Length]]:
        """Windows of all texts within the radius of a target; ``flat`` holds the texts' words one after another."""
        if not self.lengths or not len(flat):
            return
        longest = self.lengths[-1].size
        last = np.repeat(ends, ends - starts)  # where the text of each word ends
        for lo in range(0, len(flat), CHUNK):
            part = flat[lo : lo + CHUNK + longest]
            sums = running_sums(part)
            own = last[lo : lo + CHUNK] - lo
            for length in self.lengths:
                m = min(CHUNK, len(part) - length.size + 1)
                if m > 0:
                    prints = fingerprints(sums[:, length.size : length.size + m] - sums[:, :m], length.size)
                    inside = np.arange(m) + length.size <= own[:m]
                    for w, t in length.near(prints, inside):
                        yield lo + w, t, length
        for length in self.lengths:  # texts a little shorter than the window are one window
            n = ends - starts
            for doc in np.nonzero((n < length.size) & (n * SPREAD >= length.size) & (n > 0))[0]:
                prints = simhash(flat[starts[doc] : ends[doc]])
                for _, t in length.near(prints, np.ones(1, bool)):
                    yield int(starts[doc]), t, length


def _rank(passage: tuple[float, int]) -> tuple[float, int]:
    """The more similar passage counts, of equal ones the first."""
    return passage[0], -passage[1]


def _leading(weighed: dict[int, float]) -> list[int]:
    """The heaviest shingles, so many that the others alone are not similar."""
    out, left = [], sum(weighed.values())
    enough = (SIMILARITY - 1e-9) * left
    for h, w in sorted(weighed.items(), key=lambda x: -x[1]):
        if left < enough:
            break
        out.append(h)
        left -= w
    return out


def _shingles(words: list[str]) -> frozenset[tuple[str, ...]]:
    return frozenset(tuple(words[i : i + WORDS]) for i in range(max(1, len(words) - WORDS + 1))) if words else frozenset()


def _length(size: int, rows: list[tuple[np.ndarray, int, int]]) -> Length:
    blocks = np.concatenate([r[0] for r in rows], axis=1)
    tables = []
    for k in range(BLOCKS):
        # every value within RADIUS // BLOCKS = 1 bit of a target's block
        near = np.concatenate([blocks[k]] + [blocks[k] ^ np.uint16(1 << i) for i in range(16)])
        target = np.tile(np.arange(len(rows)), 17)
        order = np.argsort(near, kind="stable")
        first = np.searchsorted(near[order], np.arange(65537)).astype(np.int64)
        tables.append((first, target[order], np.diff(first) > 0))
    return Length(size, whole(blocks), np.array([r[1] for r in rows]), np.array([r[2] for r in rows]), tables)


def _blocks(items: DataFrame, key: str, text: str) -> Iterator[list[tuple[object, str]]]:
    """Items in blocks of about ``ITEM_BLOCK``; NULL and wordless texts are none."""
    items = items.where(F.col(text).isNotNull()).select(key, text).distinct()
    n = max(1, -(-items.count() // ITEM_BLOCK))
    for i in range(n):
        rows = items.where(F.pmod(F.xxhash64(key, text), F.lit(n)) == i).collect()
        yield sorted(((r[0], r[1]) for r in rows), key=lambda r: (r[0] is None, r[0], r[1]))


def find(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """``doc_id, item_id, similarity, first_word`` of every document and item with a passage of similarity 0.75 or more.

    Passages are windows as long as the item, cut off at the ends of a text. The best passage counts, the first of equal ones. NULL and empty texts match nothing; items of fewer than five words are one
    shingle and match only as they stand. Items given twice are reported under each id, repeated documents in each
    row. An empty table on either side gives no rows.
    """
    kinds = docs.schema[key].dataType.simpleString(), items.schema[item_key].dataType.simpleString()
    schema = f"doc_id {kinds[0]}, item_id {kinds[1]}, similarity double, first_word bigint"

    def one(block: list[tuple[object, str]]) -> DataFrame:
        def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index, hashes = Index(block), WordHashes()
            for b in in_slices(batches):
                rows = list(index.search(b.column(1).to_pylist(), hashes))
                at = pa.array([r[0] for r in rows], pa.int64())
                item = pa.array([index.ids[r[1]] for r in rows])
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(at), item if rows else pa.nulls(0), pa.array([r[2] for r in rows], pa.float64()), pa.array([r[3] for r in rows], pa.int64())],
                    names=["doc_id", "item_id", "similarity", "first_word"],
                ) if rows else _nothing(b, kinds)

        return docs.select(key, text).mapInArrow(found, schema)

    return reduce(DataFrame.unionByName, [one(b) for b in _blocks(items, item_key, item_text)])


def _nothing(b: pa.RecordBatch, kinds: tuple[str, str]) -> pa.RecordBatch:
    item = pa.string() if kinds[1] == "string" else pa.int32() if kinds[1] == "int" else pa.int64()
    return pa.RecordBatch.from_arrays([b.column(0).slice(0, 0), pa.nulls(0, item), pa.nulls(0, pa.float64()), pa.nulls(0, pa.int64())], names=["doc_id", "item_id", "similarity", "first_word"])


def without(docs: DataFrame, items: DataFrame, text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """``docs`` without the documents that hold a passage of an item; all columns stay, nothing is joined or shuffled."""
    at = docs.columns.index(text)
    for block in _blocks(items, item_key, item_text):

        def clean(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            index, hashes = Index(block), WordHashes()
            for b in in_slices(batches):
                hit = {r[0] for r in index.search(b.column(at).to_pylist(), hashes)}
                yield b.filter(pa.array([i not in hit for i in range(b.num_rows)], pa.bool_()))

        docs = docs.mapInArrow(clean, docs.schema)
    return docs
