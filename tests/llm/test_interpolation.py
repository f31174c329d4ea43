import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from firegrid.llm import interpolation as I
from firegrid.llm.shingles import split_words

SCHEMA = "doc_id long, text string, score string, fold string"


def corpus(seed=1, n=250):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        words, w = [], 0
        for _ in range(rnd.randrange(0, 60)):
            w = rnd.randrange(500) if rnd.random() < 0.3 else (w * 7 + rnd.randrange(3)) % 500
            words.append(f"W{w}" if w > 5 else "the")
        rows.append((i, " ".join(words), "clash", "clash"))
    return rows + [(n, None, "", ""), (n + 1, "", "", ""), (n + 2, "unheard of é", "", "")]


def brute(rows):
    docs = [(i, zlib.crc32(str(i).encode()) % 5, [*split_words(t), None]) for i, t, *_ in rows]
    c1, c2, cu = ({f: Counter() for f in I.FOLDS} for _ in range(3))
    for _, f, w in docs:
        if f != I.HELD_OUT:
            for u, v in zip(["<s>", *w[:-1]], w, strict=True):
                c1[f][v] += 1
                c2[f][u, v] += 1
                cu[f][u] += 1
    t1, t2, tu = (sum(c.values(), Counter()) for c in (c1, c2, cu))
    n, v = sum(t1.values()), len(t1)
    events = defaultdict(list)
    for f in I.FOLDS:
        for (u, x), k in c2[f].items():
            c = tu[u] - cu[f][u]
            events[min(31, math.frexp(c)[1])].append((k, (t2[u, x] - k) / c if c else 0.0, (t1[x] - c1[f][x]) / (n - sum(c1[f].values()))))
    weights = {}
    for b, e in events.items():
        a = np.array(e)
        p, w = np.stack([a[:, 1], a[:, 2], np.full(len(a), 1 / (v + 1))], 1), np.full(3, 1 / 3)
        for _ in range(I.ROUNDS):
            q = p * w
            q /= q.sum(1, keepdims=True)
            w = a[:, 0] @ q / a[:, 0].sum()
        w = np.maximum(w, [0, 0, 1e-9])
        weights[b] = w / w.sum()
    known = sorted(weights)
    out = {}
    for i, f, w in docs:
        s = base = k = 0
        for u, x in zip(["<s>", *w[:-1]], w, strict=True):
            b = min(31, math.frexp(tu[u])[1])
            a = weights[max([z for z in known if z <= b], default=known[0])]
            s += math.log10(a[0] * (t2[u, x] / tu[u] if tu[u] else 0) + a[1] * t1[x] / n + a[2] / (v + 1))
            base += math.log10((t1[x] + 0.5) / (n + 0.5 * (v + 1)))
            k += t1[x] > 0
        out[i] = (f == I.HELD_OUT, len(w), k, n, base, s)
    return out


@pytest.mark.parametrize("bits,chunk,events", [(20, 1 << 21, 4_000_000), (5, 300, 900)])
def test_scores_equal_brute_force(spark, monkeypatch, bits, chunk, events):
    """Once with all words indexed, once with rare words, several chunks and several tasks."""
    monkeypatch.setattr(I, "INDEX_BITS", bits)
    monkeypatch.setattr(I, "CHUNK", chunk)
    monkeypatch.setattr(I, "EVENTS_PER_TASK", events)
    monkeypatch.setattr(I, "COUNT_CHUNK", chunk)
    monkeypatch.setattr(I, "SLICE", chunk)
    rows = corpus()
    want = brute(rows)
    got = {r.doc_id: r for r in I.score(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()}
    assert set(got) == set(want)
    for i, (held, tokens, known, n, base, s) in want.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, tokens, known, n)
        assert r.base_score == pytest.approx(base, abs=1e-9)
        # the weights come from counts gathered by size of estimate, so they differ in the fourth digit
        assert abs(r.score - s) / tokens < 2e-3
    held = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_probabilities_sum_to_one():
    b = I.Bigrams(np.array([[2, 1, 0, 0], [0, 0, 1, 0], [0, 0, 0, 0]]), np.array([[2, 1, 1, 0]] * 3), np.array([[3, 1, 0, 0], [0, 0, 2, 0], [1, 1, 1, 1]]), None)
    weights = np.tile([0.5, 0.3, 0.2], (I.CONTEXT_BUCKETS, 1))
    total = (10 ** I.log_probability(b, 10, 3, weights)).sum() + 0.2 / 4  # the unknown word has the rest
    assert total == pytest.approx(1.0)


def test_repeated_rows_null_ids_and_long_text(spark):
    rows = [(1, "a b a b", "", ""), (1, "a b a b", "", ""), (None, "a c", "", ""), (3, "z " * 50_000, "", "")]
    got = I.score(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == 4
    twice = [r for r in got if r.doc_id == 1]
    assert twice[0] == twice[1] and twice[0].n_tokens == 5
    assert next(r for r in got if r.doc_id == 3).n_tokens == 50_001


def test_empty_table_and_no_training_text(spark):
    assert I.score(spark.createDataFrame([], SCHEMA)).count() == 0
    only = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 5 == I.HELD_OUT)
    r = I.score(spark.createDataFrame([(only, "a b", "", "")], SCHEMA)).first()
    assert (r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) == (3, 0, 0, 0.0, 0.0)
