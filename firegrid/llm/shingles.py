"""Words and hashed five-word shingles of whole texts, in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

WORDS = 5
_STEP = np.uint64(0x9E3779B97F4A7C15)
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
_MEMO = 1 << 20
BLOCK = 1 << 20


def in_slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Batches a few hundred texts at a time, so that what is made of them stays small."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def split_words(text: str | None) -> list[bytes]:
    """A-Z in lower case; words are runs of characters other than space and \\t \\n \\v \\f \\r."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads every bit of the input over the output."""
    h = (h ^ (h >> np.uint64(30))) * _MIX[0]
    h = (h ^ (h >> np.uint64(27))) * _MIX[1]
    return h ^ (h >> np.uint64(31))


class WordHashes(dict):
    """64-bit hashes of words, remembered up to a bound."""

    def __missing__(self, word: bytes | str) -> int:
        if len(self) >= _MEMO:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h

    def of(self, words: list[bytes] | list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


class TextHasher:
    """64-bit hashes of the words of many texts at once, the words being those of :func:`split_words`.

    A word's hash is a polynomial in its bytes, taken as a difference of running sums modulo 2**64 and scaled back to
    the word's start, then mixed. Texts are worked on in blocks of about ``BLOCK`` bytes; longer texts are cut between words.
    """

    _BASE = 0xD6E8FEB86659FD93
    _BACK = pow(_BASE, -1, 1 << 64)

    def __init__(self):
        self.letters = mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * _STEP)
        self.space = np.zeros(256, bool)
        self.space[[9, 10, 11, 12, 13, 32]] = True
        self._powers(BLOCK + 2)

    def _powers(self, n: int) -> None:
        ones = lambda x: np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n, x, np.uint64)]))
        self.up, self.down = ones(np.uint64(self._BASE)), ones(np.uint64(self._BACK))

    def _block(self, raw: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Starts and hashes of the words of one block."""
        b = np.frombuffer(raw.lower(), np.uint8)
        if len(b) + 1 > len(self.up):
            self._powers(2 * len(b))
        blank = np.concatenate([[True], self.space[b], [True]])
        edges = np.flatnonzero(blank[1:] != blank[:-1])
        start, end = edges[0::2], edges[1::2]
        sums = np.zeros(len(b) + 1, np.uint64)
        np.cumsum(self.letters[b] * self.up[: len(b)], out=sums[1:])
        return start, mix((sums[end] - sums[start]) * self.down[start] + (end - start).astype(np.uint64) * _STEP)

    def _pieces(self, texts: list[str | None]) -> Iterator[tuple[int, bytes]]:
        for i, t in enumerate(texts):
            raw = (t or "").encode("utf-8", "surrogatepass")
            while len(raw) > BLOCK:
                cut = max(raw.rfind(c, 0, BLOCK) for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c"))
                if cut <= 0:  # one word longer than a block
                    found = [x for x in (raw.find(c, BLOCK) for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c")) if x >= 0]
                    cut = min(found, default=len(raw))
                yield i, raw[:cut]
                raw = raw[cut:]
            yield i, raw

    def words(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all words one after another, and the number of words of each text."""
        counts, hashes = np.zeros(len(texts), np.int64), [np.zeros(0, np.uint64)]
        held: list[tuple[int, bytes]] = []
        size = 0

        def flush() -> None:
            start, h = self._block(b" ".join(p for _, p in held))
            first = np.cumsum([0] + [len(p) + 1 for _, p in held])
            n = np.diff(np.searchsorted(start, first))
            np.add.at(counts, [i for i, _ in held], n)
            hashes.append(h)

        for piece in self._pieces(texts):
            if held and size + len(piece[1]) > BLOCK:
                flush()
                held, size = [], 0
            held.append(piece)
            size += len(piece[1]) + 1
        if held:
            flush()
        return np.concatenate(hashes), counts

    def sets(self, texts: list[str | None], n: int = WORDS) -> Iterator[np.ndarray]:
        """Each text's distinct shingles in ascending order."""
        flat, counts = self.words(texts)
        grams, ends = shingle_hashes(flat, n), np.cumsum(counts)
        for lo, hi in zip(ends - counts, ends, strict=True):
            yield np.unique(grams[lo : hi - n + 1] if hi - lo >= n else shingle_hashes(flat[lo:hi], n))


def shingle_hashes(words: np.ndarray, n: int = WORDS) -> np.ndarray:
    """Hashes of all windows of ``n`` words; shorter sequences are one window, none stay none."""
    if len(words) == 0:
        return words
    width = min(n, len(words))
    h = np.full(len(words) - width + 1, width, np.uint64)
    for i in range(width):
        h = h * _STEP + words[i : len(words) - width + 1 + i]
    return mix(h)
