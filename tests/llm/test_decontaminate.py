import random

import numpy as np
import pytest

from firegrid.llm import decontaminate as D
from firegrid.llm.shingles import WordHashes

SCHEMA = "doc_id long, text string, item_id string, similarity string"


def corpus(seed=1):
    rnd = random.Random(seed)
    word = lambda: rnd.choice("the of and to in a".split()) if rnd.random() < 0.4 else f"w{rnd.randrange(3000)}"
    items = [(i, " ".join(word() for _ in range(rnd.choice([1, 3, 4, 5, 9, 15, 16, 30, 45, 60, 90, 400])))) for i in range(60)]
    docs = []
    for i in range(400):
        words = [word() for _ in range(rnd.randrange(0, 300))]
        if i % 3 == 0:
            item = rnd.choice(items)[1].split()
            if i % 2:
                item = [w.upper() + rnd.choice(["", ",", "!!", "###"]) for w in item]
            if i % 9 == 0 and len(item) > 40:
                item[rnd.randrange(len(item))] = "edited"
            at = rnd.randrange(len(words) + 1)
            words[at:at] = item
        docs.append((i, " ".join(words), "clash", "clash"))
    return docs, items


def brute(docs, items):
    index = D.Index(items)
    out = {}
    for i, t, *_ in docs:
        w = D.words_of(t)
        for k, (item, _) in enumerate(items):
            n = index.sizes[k]
            if n:
                best = max((index.similarity(k, w[p : p + n]) for p in range(max(1, len(w) - n + 1))), default=0.0)
                if best >= D.SIMILARITY - 1e-12:
                    out[i, item] = best
    return out


def test_found_equals_brute_force(spark):
    docs, items = corpus()
    want = brute(docs, items)
    got = {(r.doc_id, r.item_id): r.similarity for r in D.find(spark.createDataFrame(docs, SCHEMA).repartition(3), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert set(got) <= set(want)
    exact = {k for k, s in want.items() if s > 1 - 1e-9}
    assert exact <= set(got), "every unchanged passage is found"
    assert len(got) >= 0.9 * len(want)
    assert all(abs(got[k] - want[k]) < 1e-9 for k in exact)


def edited(rnd, n):
    """Items of ``n`` words with every place or pair of places changed, words left out, put in or repeated."""
    fresh = lambda: f"x{rnd.randrange(10**6)}"
    docs, items = [], []
    for i in range(6):
        item = [f"i{i}w{k}" if rnd.random() < 0.7 else "the" for k in range(n)]
        items.append((i, " ".join(item)))
        for _ in range(10):
            new, k = list(item), rnd.randrange(n)
            for _ in range(rnd.randrange(1, 3)):
                k = rnd.choice([0, n - 1, rnd.randrange(n)])
                change = rnd.randrange(4)
                new[k : k + 1] = [[fresh()], [], [fresh(), *new[k : k + 1]], new[k : k + 1] * 2][change]
            docs.append((len(docs), " ".join([*(fresh() for _ in range(rnd.choice([0, 1, 30]))), *new, *(fresh() for _ in range(rnd.choice([0, 1, 30])))])))
    return docs, items


@pytest.mark.parametrize("n", [5, 6, 8, 11, 15, 23, 35, 53])
def test_all_edited_passages_are_found(n):
    docs, items = edited(random.Random(n), n)
    index = D.Index(items)
    want = {}
    for d, t in docs:
        w = D.words_of(t)
        for k in range(len(items)):
            # windows as long as the item, cut off at the ends of the text
            some = [(index.similarity(k, w[max(0, p) : p + n]), -max(0, p)) for p in range(1 - n, len(w))] if w and not index.shingles[k].isdisjoint(D._shingles(w)) else []
            best = max(some, default=(0.0, 0))
            if best[0] >= D.SIMILARITY - 1e-12:
                want[d, k] = best[0], -best[1]
    got = {(d, k): (s, at) for d, k, s, at in index.search([t for _, t in docs], WordHashes())}
    assert want and got == want


def test_no_print_within_the_radius_is_missed():
    rnd = np.random.default_rng(1)
    _, items = corpus()
    length = D.Index(items).lengths[-1]
    base = length.prints[rnd.integers(len(length.prints), size=3000)]
    flips = np.zeros(3000, np.uint64)
    for i in range(3000):
        for bit in rnd.choice(64, rnd.integers(0, 12), replace=False):
            flips[i] |= np.uint64(1) << np.uint64(bit)
    prints = base ^ flips
    blocks = np.stack([(prints >> np.uint64(16 * k)) & np.uint64(0xFFFF) for k in range(4)]).astype(np.uint16)
    want = {(w, t) for w in range(3000) for t in np.flatnonzero(np.bitwise_count(prints[w] ^ length.prints) <= D.RADIUS)}
    assert set(length.near(blocks, np.ones(3000, bool))) == want


def test_print_is_the_majority_of_bits():
    h = WordHashes().of([f"w{i}" for i in range(37)])
    bits = np.array([[(int(x) >> i) & 1 for i in range(64)] for x in h]).sum(axis=0) > 37 // 2
    got = int(D.whole(D.simhash(h))[0])
    # octets keep their place, bits inside one are mirrored
    assert [(got >> (8 * j + 7 - i)) & 1 for j in range(8) for i in range(8)] == bits.astype(int).tolist() or [(got >> i) & 1 for i in range(64)] == bits.astype(int).tolist()


def test_blocks_of_items_and_chunks_of_windows(spark, monkeypatch):
    docs, items = corpus(2)
    d, b = spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(items, "item_id long, text string")
    want = sorted(tuple(r)[:2] for r in D.find(d, b).collect())
    monkeypatch.setattr(D, "ITEM_BLOCK", 25)
    monkeypatch.setattr(D, "CHUNK", 64)
    assert sorted(tuple(r)[:2] for r in D.find(d, b).collect()) == want
    kept = D.without(d, b)
    assert kept.columns == d.columns and {r.doc_id for r in kept.collect()} == {r[0] for r in docs} - {w[0] for w in want}


def test_edges(spark):
    item = "one two three four five six seven eight nine ten eleven twelve"
    b = spark.createDataFrame([(1, item), (2, item), (3, None), (4, ""), (5, "!!"), (6, "just so")], "item_id long, text string")
    docs = [(1, None, "", ""), (2, "", "", ""), (3, item, "", ""), (3, item, "", ""), (None, "x " * 100_000 + item, "", ""), (4, " ".join(item.split()[:-1]), "", ""), (5, "so just", "", ""), (6, "Just, so!", "", "")]
    got = sorted((r.doc_id or -1, r.item_id) for r in D.find(spark.createDataFrame(docs, SCHEMA), b).collect())
    assert got == [(-1, 1), (-1, 2), (3, 1), (3, 1), (3, 2), (3, 2), (4, 1), (4, 2), (6, 6)]
    assert D.find(spark.createDataFrame([], SCHEMA), b).count() == 0
    assert D.find(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame([], "item_id long, text string")).count() == 0
