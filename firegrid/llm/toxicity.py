"""Toxicity by compression distance.

Two zstandard dictionaries are trained, on ordinary text and on toxic text. A window of words that the
toxic dictionary compresses to fewer bytes than the ordinary one is nearer to toxic text; a document's score comes
from how many of its windows save at least a calibrated number of bytes.

Both dictionaries share the ordinary part, so a saving can only come from toxic passages. Toxic documents are
mostly ordinary text; their dictionary is therefore trained on the words that hold letters in a row which toxic documents
have significantly more often than ordinary ones. Only labels and texts of the training rows are read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firegrid.llm.shingles import in_slices

# bounds of the training sample: rows of either class, drawn by hash, and distinct words of a row, drawn by hash
SAMPLE_TOXIC = 2500
SAMPLE_ORDINARY = 7500
SAMPLE_WORDS = 4096

# words of a window: short ones single a passage out, long ones compress more steadily
WINDOWS = (8, 20)
LEVEL = 12
BASE_BYTES = 32_768
TOXIC_BYTES = (2048, 8192, 24_576)
SAVINGS = (1, 2, 3, 4, 5)
# letters in a row that mark toxic text: how many, in how many documents, how significantly and how much more often
GRAM = 5
MIN_DOCS, MIN_Z, MIN_RATIO = 4, 5.0, 4.0
WORD = re.compile(r"\w+")
# remembered savings of windows
MEMO = 1 << 16
# bytes of a passage that tells toxic text from ordinary text: the compressor matches no fewer, and more are not told apart
GRAMS = (5, 6, 7, 8)
_MASKS = tuple(np.uint64((1 << 8 * k) - 1) for k in GRAMS)
# cells of a table of their beginnings; windows of more bytes are compressed whatever they hold
CELL_BITS, LONGEST = 18, 4096
_SPREAD = np.uint64(0x9E3779B97F4A7C15)
# first bytes of a trained dictionary
HEADER = bytes.fromhex("37a430ec")


def fold(key: Column, n: int = 5) -> Column:
    """crc32 of the key's text modulo n; a NULL key counts as empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % n


def words_of(text: str | None) -> list[str]:
    """Words of a whole text as they follow each other, in lower case."""
    return WORD.findall((text or "").lower())


def window_starts(n: int, width: int) -> np.ndarray:
    """First words of the windows of ``width`` words over a text of ``n`` words, one at least."""
    step = width // 2
    return np.arange(0, max(1, n - step), step)


def windows_of(words: list[str], width: int) -> list[bytes]:
    """Windows of ``width`` words that overlap by half; the last one ends with the text."""
    return [f" {' '.join(words[i : i + width])} ".encode() for i in window_starts(len(words), width).tolist()] if words else []


def _near_keys(text: str | None, n: int = 3) -> list[int]:
    """Smallest hashes of five-word passages: near copies share at least one of them nearly always."""
    words = (text or "").lower().split()
    grams = {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))}
    return [min(xxhash.xxh64_intdigest(g, seed) for g in grams) >> 1 for seed in range(n)]


@dataclass(frozen=True)
class Model:
    """Dictionaries, the saving a toxic window has at least, and the weights of a document's features."""

    base: bytes
    toxic: bytes
    saving: int
    weights: tuple[float, ...]

    def savings(self) -> Savings:
        return Savings(self.base, self.toxic)

    def scores(self, savings: list[list[np.ndarray]]) -> np.ndarray:
        x = np.array([features(s, self.saving) for s in savings]).reshape(len(savings), len(self.weights))
        return 1.0 / (1.0 + np.exp(-np.clip(x @ np.array(self.weights), -30, 30)))


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    params = zstandard.ZstdCompressionParameters.from_level(
        LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False, format=zstandard.FORMAT_ZSTD1_MAGICLESS
    )
    data = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    return zstandard.ZstdCompressor(dict_data=data, compression_params=params)


def _codes(raw: bytes, n: int) -> np.ndarray:
    """The ``GRAMS[-1]`` bytes from each of the first ``n`` places on, as one number; zeros follow the end."""
    return np.ndarray((n,), "<u8", raw + bytes(8), strides=(1,)).copy()


def _cell(codes: np.ndarray) -> np.ndarray:
    return ((codes & _MASKS[0]) * _SPREAD) >> np.uint64(64 - CELL_BITS)


class Marks:
    """Where a text says what the toxic part of a dictionary holds and the ordinary part does not.

    The compressor looks the ordinary part through before the toxic one and takes a passage of the latter only if it
    matches more bytes, ``GRAMS[0]`` at least. So a window saves exactly nothing unless it holds a passage of
    the toxic part that is not in the ordinary one. The shortest such passages are kept, cut to ``GRAMS[-1]`` bytes;
    a passage found too often costs time, never a result.
    """

    def __init__(self, base: bytes, toxic: bytes):
        # tables of either dictionary must be of one size, and the ordinary part must begin with the header of a
        # trained one, so that no passage of text runs over from the toxic part into it
        self.usable = len(base) > LONGEST and len(base).bit_length() == (len(base) + len(toxic) + LONGEST).bit_length() and base[:4] == HEADER
        ordinary, own = _codes(base, len(base)), _codes(toxic + base, len(toxic))
        self.passages: list[np.ndarray] = []
        self.begins = np.zeros(1 << CELL_BITS, bool)
        left = np.ones(len(own), bool)
        for mask in _MASKS:
            new = left & ~np.isin(own & mask, ordinary & mask) if mask != _MASKS[-1] else left
            self.passages.append(np.unique(own[new] & mask))
            self.begins[_cell(own[new])] = True
            left = left & ~new

    def places(self, raw: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Places where such passages begin, ascending, and the earliest end of any that begins there or later."""
        codes = _codes(raw, len(raw))
        at = np.flatnonzero(self.begins[_cell(codes)])
        codes, none = codes[at], len(raw) + 1
        end = np.full(len(at), none, np.int64)
        for k, mask, passages in zip(GRAMS[::-1], _MASKS[::-1], self.passages[::-1], strict=True):
            if len(passages):
                own = codes & mask
                found = passages[np.minimum(np.searchsorted(passages, own), len(passages) - 1)] == own
                end[found] = at[found] + k
        kept = end < none
        return at[kept], np.minimum.accumulate(end[kept][::-1])[::-1]


class Savings(dict):
    """Bytes that the toxic dictionary saves over the ordinary one, by window.

    Only windows with one of the :class:`Marks` are compressed, equal ones once, up to a bound.
    """

    def __init__(self, base: bytes, toxic: bytes):
        self.base, self.toxic = _compressor(base).compress, _compressor(toxic + base).compress
        self.marks = Marks(base, toxic)

    def __missing__(self, window: bytes) -> int:
        if len(self) >= MEMO:
            self.clear()
        n = self[window] = len(self.base(window)) - len(self.toxic(window))
        return n

    def of(self, words: list[str]) -> list[np.ndarray]:
        """Window by window, for each width."""
        if not words:
            return [np.zeros(0, np.int64) for _ in WINDOWS]
        raw = f" {' '.join(words)} ".encode()
        blanks = np.flatnonzero(np.frombuffer(raw, np.uint8) == 32)
        at, end = self.marks.places(raw)
        out = []
        for width in WINDOWS:
            first = window_starts(len(words), width)
            lo, hi = blanks[first], blanks[np.minimum(first + width, len(words))] + 1
            if self.marks.usable:
                k = np.searchsorted(at, lo)
                told = np.append(end, len(raw) + 1)[k] <= hi
                todo = np.flatnonzero(told | (hi - lo > LONGEST))
            else:
                todo = np.arange(len(first))
            saved = np.zeros(len(first), np.int64)
            saved[todo] = [self[raw[i:j]] for i, j in zip(lo[todo].tolist(), hi[todo].tolist(), strict=True)]
            out.append(saved)
        return out


def features(savings: list[np.ndarray], least: int) -> tuple[float, ...]:
    out = [1.0]
    for s in savings:
        n = int((s >= least).sum())
        mean = float(np.clip(s, -2, 8).mean()) if len(s) else 0.0
        out += [float(n > 0), math.log1p(n), n / max(1, len(s)), float(s.max(initial=0)) / 8.0, mean]
    return tuple(out)


def constant(logit: float) -> tuple[float, ...]:
    """Weights of a model that gives every document the same score."""
    return (logit, *[0.0] * (5 * len(WINDOWS)))


def _trained(size: int, samples: list[bytes], k: int, d: int) -> bytes:
    """Content of a trained dictionary; where there is too little to train on, the samples themselves."""
    try:
        raw = zstandard.train_dictionary(size, samples, k=k, d=d).as_bytes()
    except zstandard.ZstdError:
        raw = b" ".join(samples)[-size:]
    return raw or b" "


def _logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 1e-2) -> tuple[np.ndarray, float]:
    """Weighted ridge regression by Newton steps; coefficients and mean loss."""
    b = np.zeros(x.shape[1])
    w = w / w.sum()
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        g = x.T @ (w * (p - y)) + ridge * 1e-2 * b
        h = (x * (w * p * (1 - p))[:, None]).T @ x + ridge * 1e-2 * np.eye(len(b))
        b = b - np.linalg.solve(h, g)
    p = np.clip(1 / (1 + np.exp(-np.clip(x @ b, -30, 30))), 1e-9, 1 - 1e-9)
    return b, float(-(w * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum())


def _grams(words: list[str]) -> set[str]:
    padded = [f" {w} " for w in words]
    return {w[i : i + GRAM] for w in padded for i in range(max(1, len(w) - GRAM + 1))}


def _parts(toxic: list[str], ordinary: list[str]) -> tuple[bytes, list[bytes]]:
    """Dictionary of ordinary text, and what toxic documents say beyond it: per document, the words that hold letters
    in a row whose share of toxic documents is significantly larger than that of ordinary ones. A document is given by its
    distinct words between blanks.
    """
    # letters that too few toxic documents have are not counted any further: they are the bulk, and the driver holds the counts
    often = Counter(g for words in toxic for g in _grams(words.split()))
    often = {g for g, k in often.items() if k >= MIN_DOCS}
    docs, uses, n_words = {}, {}, {}
    for kind, texts in ((1, toxic), (0, ordinary)):
        docs[kind], uses[kind], n_words[kind] = Counter(), Counter(), sum(words.count(" ") + 1 for words in texts)
        for words in texts:
            own = [g for w in words.split() for g in _grams([w]) if g in often]
            uses[kind].update(own)
            docs[kind].update(set(own))
    marks = set()
    for g, k in docs[1].items():
        p = (k + docs[0][g]) / (len(toxic) + len(ordinary))
        z = (k / len(toxic) - docs[0][g] / len(ordinary)) / math.sqrt(max(p * (1 - p), 1e-12) * (1 / len(toxic) + 1 / len(ordinary)))
        if z >= MIN_Z and uses[1][g] * n_words[0] >= MIN_RATIO * uses[0][g] * n_words[1]:
            marks.add(g)
    samples = [f" {' '.join(w for w in words.split() if _grams([w]) & marks)} ".encode() for words in toxic]
    return _trained(BASE_BYTES, [words.encode() for words in ordinary], k=32, d=8), [s for s in samples if s.strip()]


Measure = Callable[[list[list[tuple[bytes, bytes]]], dict[tuple, int]], list[tuple[tuple, np.ndarray]]]


def fit_rows(rows: list[tuple[object, str, tuple[int, ...], int]], share_toxic: float, measure: Measure) -> Model:
    """Model of rows (key, distinct words between blanks, near-copy keys, label). ``share_toxic``: share of label 1 among all labels.

    Of near copies one row trains, so that what a copied text alone contains does not look like a rule. ``measure`` gives
    whole texts' features. With one class only, or no rows, every document scores that share.
    """
    seen: set[tuple[int, int]] = set()
    kept = []
    for key, words, near, y in rows:
        marks = set(enumerate(near))
        if words and not marks & seen:
            kept.append(((key, near), words, y))
        seen |= marks
    prior = math.log(max(share_toxic, 1e-6) / max(1 - share_toxic, 1e-6))
    toxic, ordinary = ([(k, w) for k, w, y in kept if y == label] for label in (1, 0))
    if not toxic or not ordinary:
        return Model(b" ", b" ", 1, constant(prior))
    words_only = lambda r: [w for _, w in r]

    # halves: thresholds are calibrated on documents that the dictionaries have not seen
    halves = [(toxic[i::2], ordinary[i::2]) for i in (0, 1)]
    parts = [_parts(words_only(t), words_only(o)) if t and o else None for t, o in halves]
    trained = [[(p[0], _trained(size, p[1], k=16, d=6) if p[1] else b" ") for size in TOXIC_BYTES] if p else [] for p in parts]
    other = {k: 1 - i for i, half in enumerate(halves) if parts[1 - i] for rows_ in half for k, _ in rows_}
    label = {k: y for k, _, y in kept}
    got = measure(trained, other)
    labels = np.array([label[k] for k, _ in got], float)
    best: tuple[float, int, int, np.ndarray] | None = None
    if 0 < labels.sum() < len(labels):
        x = np.stack([f for _, f in got]).reshape(len(got), len(TOXIC_BYTES), len(SAVINGS), -1)
        weight = np.where(labels > 0, max(share_toxic, 1e-3) / labels.sum(), max(1 - share_toxic, 1e-3) / (len(labels) - labels.sum()))
        for i, size in enumerate(TOXIC_BYTES):
            for j, least in enumerate(SAVINGS):
                b, loss = _logistic(x[:, i, j], labels, weight)
                if best is None or loss < best[0] - 1e-9:
                    best = loss, size, least, b
    if best is None:
        return Model(b" ", b" ", 1, constant(prior))
    base, samples = _parts(words_only(toxic), words_only(ordinary))
    extra = _trained(best[1], samples, k=16, d=6) if samples else b" "
    return Model(base, extra, best[2], tuple(map(float, best[3])))


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """Model from the labelled rows whose :func:`fold` is not 0, at most ``SAMPLE_TOXIC + SAMPLE_ORDINARY`` of them.

    The sample is bounded whatever the size of the input: its ids are drawn by hash, broadcast, and the sampled
    documents' distinct words come to the driver. Thresholds are calibrated on their whole texts, in the tasks. Of several labels of a document the largest counts; NULL labels do not.
    """
    known = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull() & (fold(F.col(key)) != 0)).groupBy(F.col(key).alias("_id")).agg(F.max(label).cast("int").alias("_y"))
    counts = {r["_y"]: r["count"] for r in known.groupBy("_y").count().collect()}
    draws = [known.where(F.col("_y") == y).orderBy(F.xxhash64("_id"), "_id").limit(n) for y, n in ((1, SAMPLE_TOXIC), (0, SAMPLE_ORDINARY))]
    drawn = F.broadcast(draws[0].unionByName(draws[1]))
    rows = docs.select(F.col(key).alias("_id"), F.col(text).alias("_text")).join(drawn, "_id")

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_slices(batches):
            texts = b.column(1).to_pylist()
            words = [list(dict.fromkeys(words_of(t))) for t in texts]
            words = [w if len(w) <= SAMPLE_WORDS else sorted(w, key=xxhash.xxh64_intdigest)[:SAMPLE_WORDS] for w in words]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([" ".join(w) for w in words], pa.string()), pa.array([_near_keys(t) for t in texts], pa.list_(pa.int64())), b.column(2)], names=["_id", "words", "near", "y"]
            )

    kind = dict(docs.dtypes)[key]
    got = rows.mapInArrow(sample, f"_id {kind}, words string, near array<bigint>, y int").collect()
    # words stay one string per text: the driver holds them while it trains
    drawn_rows = sorted(((r["_id"], r["words"], tuple(r["near"]), r["y"]) for r in got), key=lambda r: r[:2])
    total = sum(counts.values())
    del got

    def measure(trained: list[list[tuple[bytes, bytes]]], other: dict[tuple, int]) -> list[tuple[tuple, np.ndarray]]:
        def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            savings = [[Savings(base, extra) for base, extra in half] for half in trained]
            for b in in_slices(batches):
                out = []
                for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    near = _near_keys(t)
                    if (i, tuple(near)) in other:
                        words = words_of(t)
                        found = [s.of(words) for s in savings[other[i, tuple(near)]]]
                        out.append((i, near, np.array([features(s, least) for s in found for least in SAVINGS]).tobytes()))
                ids, nears, data = zip(*out, strict=True) if out else ((), (), ())
                yield pa.RecordBatch.from_arrays([pa.array(ids, b.schema.field(0).type), pa.array(nears, pa.list_(pa.int64())), pa.array(data, pa.binary())], names=["_id", "near", "x"])

        got = {}
        for r in rows.mapInArrow(measured, f"_id {kind}, near array<bigint>, x binary").collect():
            key, x = (r["_id"], tuple(r["near"])), bytes(r["x"])
            got[key] = max(got.get(key, x), x)  # rows of one id that are near copies count once
        return [(k, np.frombuffer(x)) for k, x in sorted(got.items())]

    return fit_rows(drawn_rows, counts.get(1, 0) / total if total else 0.5, measure)


def score(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """``keep`` plus ``score`` (0 to 1) and ``predicted`` (1 from 0.5 on), a row per row of ``docs``.

    Whole texts are windowed, word after word, windows overlapping by half. NULL and empty texts have no window and get the score of a document without a
    toxic window. Only ``text`` enters a score; columns outside ``keep`` are not read.
    """
    names = list(keep)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        savings = model.savings()
        for b in in_slices(batches):
            found = model.scores([savings.of(words_of(t)) for t in b.column(len(names)).to_pylist()])
            yield pa.RecordBatch.from_arrays([*b.columns[: len(names)], pa.array(found, pa.float64()), pa.array((found >= 0.5).astype(np.int32))], names=[*names, "score", "predicted"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*names).schema.fields)
    return docs.select(*names, F.col(text).alias("_text")).mapInArrow(scored, ", ".join(x for x in (fields, "score double, predicted int") if x))


def without(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` without the rows that are predicted toxic; all columns stay, nothing is joined or shuffled."""
    at = docs.columns.index(text)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        savings = model.savings()
        for b in in_slices(batches):
            found = model.scores([savings.of(words_of(t)) for t in b.column(at).to_pylist()])
            yield b.filter(pa.array(found < 0.5))

    return docs.mapInArrow(clean, docs.schema)
