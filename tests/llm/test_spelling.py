import random
import re
import zlib
from collections import Counter

import pytest

from firegrid.llm import spelling


def edits(word):
    """All words that lack one code point, and those with one gap."""
    return {word[:i] + word[i + 1 :] for i in range(len(word))}, {(i, word[:i] + word[i + 1 :]) for i in range(len(word))}


def brute(counts, factor=10):
    less = {w: edits(w) for w in counts}

    def near(a, b):
        return len(a) == len(b) and bool(less[a][1] & less[b][1]) or a in less[b][0] or b in less[a][0]

    near_of = {w: [x for x in counts if x != w and near(w, x)] for w in counts}
    form = {}
    for w, xs in near_of.items():
        best = min(xs, key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= factor * counts[w] else None
    out = set()
    for w in counts:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, counts[w], len(near_of[w]), counts[form[w]] if form[w] is not None else None))
    return out


def some_words(seed, letters="abé", longest=7):
    rnd = random.Random(seed)
    words = {"".join(rnd.choices(letters, k=rnd.randrange(1, longest))) for _ in range(400)} | {"", "a" * 300, "a" * 301, "b" + "a" * 300, "字" * 40, "字" * 39 + "é"}
    return {w: rnd.choice([1, 2, 3, 20, 25, 30, 400, 400, 5000]) for w in words}


@pytest.mark.parametrize("seed,parts", [(1, 1), (2, 7), (3, 40)])
def test_equals_brute_force(spark, seed, parts, monkeypatch):
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        counts = some_words(seed)
        rows = [(w, n, "x", "y", "z") for w, n in counts.items()] + [(None, 5, None, None, None)]
        w = next(iter(counts))
        rows, counts[w] = rows + [(w, 4, "", "", "")], counts[w] + 4  # a repeated row
        got = spelling.variants(spark.createDataFrame(rows, "word string, n long, id string, form string, n_near string"))
        assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
        got = [tuple(r) for r in got.collect()]
        assert len(got) == len(counts) and set(got) == brute(counts)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_long_chain(spark):
    words = ["aaaaaaa" + "b" * i for i in range(12)]
    counts = {w: 2 * 10 ** (11 - i) for i, w in enumerate(words)}
    assert {tuple(r) for r in spelling.variants(spark.createDataFrame(list(counts.items()), "word string, n long")).collect()} == brute(counts)


def test_nodes_are_numbered_as_in_one_list(spark):
    words = sorted(some_words(5))
    want, seen = [], {}
    at = 0
    for w in words:
        want.append((w, [seen.setdefault(w[:i], at + i) for i in range(len(w) + 1)]))
        at += len(w) + 1
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = spelling.numbered(spark.createDataFrame([(w,) for w in words], "word string").repartition(3), "word", "id", "up").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert [(r.word, r.up) for r in sorted(got, key=lambda r: r.id)] == want
    assert sorted(r.id for r in got) == list(range(len(words)))


def test_words(spark, monkeypatch):
    rnd = random.Random(3)
    pool = ["Stränge", "strängen", "ÀÉÎÕÜÿ×÷", "abcdefgh", "AbcdefgH", "short", "zzzzzzz", "longer" * 2000]
    docs = [(i, " ".join(rnd.choices(pool, k=30)).replace(" ", rnd.choice([" ", "1", "_", "ā"])), "w") for i in range(200)] + [(None, "abcdefgh", ""), (1, None, ""), (2, "", "")]
    counts = Counter()
    for i, text, _ in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            if len(run) >= 7:
                counts[run] += 1
    monkeypatch.setattr(spelling, "HELD", 3)
    frame = spark.createDataFrame(docs, "doc_id long, text string, word string").repartition(4)
    got = spelling.words_of(frame).collect()
    assert {r.word: r.n for r in got} == {w: n for w, n in counts.items() if n >= 2}
    assert any(n >= 2 and w not in {p.lower() for p in pool} for w, n in counts.items())


def test_empty_table(spark):
    assert spelling.variants(spelling.words_of(spark.createDataFrame([], "doc_id long, text string"))).collect() == []
