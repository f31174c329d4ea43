"""URL filter: a sorted array of 64-bit digests, memory-mapped and probed by vectorised binary search.

A list is a table of patterns ``host + path prefix`` (``org/``, ``example.org/es/``); a pattern fits its host and all
subdomains, and paths that start with its path. The driver writes four flat arrays (keys, actions, offsets and
strings, sorted by key), Spark's file server hands them to every executor, also to one that joins later, and
workers map them into memory instead of loading them. The list is bounded by its maker, not by the pages.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# patterns of rules say allow or block; those that are only listed block where no rule fits
ACTIONS = ("allow", "block", "listed")
ARRAYS = ("keys", "actions", "starts", "text")


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or end, A-Z in lower case; empty for NULL or without ``://``."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def sorted_arrays(patterns: Iterable[tuple[str, str]], digest=xxhash.xxh64_intdigest) -> dict[str, np.ndarray]:
    """The four arrays of a list; of a pattern given twice, ``block`` wins over ``allow`` over ``listed``."""
    order = ("listed", "allow", "block")
    table: dict[str, int] = {}
    for pattern, action in patterns:
        was = table.get(pattern, -1)
        table[pattern] = ACTIONS.index(max(action, ACTIONS[was] if was >= 0 else "listed", key=order.index))
    rows = sorted((digest(p.encode()), p.encode(), a) for p, a in table.items())
    return {
        "keys": np.array([r[0] for r in rows], np.uint64),
        "actions": np.array([r[2] for r in rows], np.uint8),
        "starts": np.cumsum([0] + [len(r[1]) for r in rows]).astype(np.int64),
        "text": np.frombuffer(b"".join(r[1] for r in rows) or b"\0", np.uint8),
    }


class UrlList:
    """A list handed to the executors; ``name`` finds its files there."""

    def __init__(self, spark: SparkSession, patterns: Iterable[tuple[str, str]]):
        patterns = list(patterns)
        self.name = f"urls-{uuid.uuid4().hex}"
        self.path_lengths = sorted({len(p.partition("/")[2]) + ("/" in p) for p, _ in patterns})
        folder = tempfile.mkdtemp(prefix="firegrid-urls-")  # read by the driver's file server only
        for kind, array in sorted_arrays(patterns).items():
            path = os.path.join(folder, f"{self.name}-{kind}.npy")
            np.save(path, array)
            spark.sparkContext.addFile(path)


def _mapped(name: str) -> tuple[np.ndarray, ...]:
    return tuple(np.load(SparkFiles.get(f"{name}-{kind}.npy"), mmap_mode="r") for kind in ARRAYS)


def probe(arrays: tuple[np.ndarray, ...], candidates: list[str], digest=xxhash.xxh64_intdigest) -> np.ndarray:
    """Place in the list of each candidate, -1 if it is not in it: binary search, then the stored string is compared."""
    keys, _, starts, text = arrays
    raw = [c.encode() for c in candidates]
    wanted = np.fromiter((digest(c) for c in raw), np.uint64, len(raw))
    found = np.full(len(raw), -1, np.int64)
    lo = np.searchsorted(keys, wanted, "left")
    hi = np.searchsorted(keys, wanted, "right")
    for i in np.nonzero(hi > lo)[0]:
        for k in range(lo[i], hi[i]):  # more than one only where digests collide
            if text[starts[k] : starts[k + 1]].tobytes() == raw[i]:
                found[i] = k
    return found


def candidates(host: str, path: str, lengths: list[int]) -> list[str]:
    """Patterns that would fit, longest first: every host suffix with every path prefix of a length in the list."""
    parts = host.split(".")
    hosts = [".".join(parts[i:]) for i in range(len(parts))]
    out = {h + path[:n] for h in hosts for n in lengths if n <= len(path)}
    return sorted(out, key=lambda s: (-len(s), s))


def filter_urls(pages: DataFrame, urls: UrlList, default: str = "allow", url: str = "url", keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """``keep``, then ``host``, ``path``, ``rule`` (the longest rule that fits, else NULL) and ``verdict``.

    The verdict is the rule's; without one, ``block`` for what is listed and ``default`` for the rest.
    NULL urls and urls without ``://`` have empty host and path and get the default. Repeated rows give repeated
    rows, an empty table none; columns outside ``keep`` are not read.
    """
    fields = [pages.schema[c] for c in keep]
    rows = pages.select(*keep, host_of(F.col(url)).alias("_host"), path_of(F.col(url)).alias("_path"))
    name, lengths = urls.name, urls.path_lengths

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrays = _mapped(name)
        for b in batches:
            host, path = b.column(len(keep)).to_pylist(), b.column(len(keep) + 1).to_pylist()
            asked = [candidates(h, p, lengths) if h else [] for h, p in zip(host, path, strict=True)]
            flat = [c for cs in asked for c in cs]
            found = probe(arrays, flat)
            rule, verdict, at = [], [], 0
            for cs in asked:
                hits = [(c, ACTIONS[arrays[1][k]]) for c, k in zip(cs, found[at : at + len(cs)], strict=True) if k >= 0]
                at += len(cs)
                r, v = next(((c, a) for c, a in hits if a != "listed"), (None, "block" if hits else default))
                rule.append(r)
                verdict.append(v)
            columns = [*b.columns[: len(keep)], pa.array(host, pa.string()), pa.array(path, pa.string()), pa.array(rule, pa.string()), pa.array(verdict, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, "host", "path", "rule", "verdict"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), "host string, path string, rule string, verdict string"])
    return rows.mapInArrow(judged, schema)
