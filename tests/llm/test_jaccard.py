import random
from itertools import combinations

import pytest

from firegrid.llm import graph, jaccard
from firegrid.llm.shingles import split_words

SCHEMA = "doc_id long, text string, id string, n string, component_id string"


def brute(rows):
    sets = {}
    for i, t, *_ in rows:
        w = split_words(t)
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()
    name = {i: i for i in sets}

    def find(x):
        while name[x] != x:
            x = name[x]
        return x

    for a, b in combinations(sorted(sets), 2):
        o = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * o >= 75 * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            name[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def corpus(seed):
    rnd = random.Random(seed)
    word = lambda: f"w{rnd.randrange(400)}"
    passage = [f"p{i}" for i in range(60)]
    out = []
    for _ in range(12):  # families: copies, edited copies, chains of edits
        text = [word() for _ in range(rnd.randrange(20, 120))]
        for _ in range(rnd.randrange(1, 12)):
            out.append(" ".join(text))
            if rnd.random() < 0.7:
                text = list(text)
                text[rnd.randrange(len(text))] = word()
            if rnd.random() < 0.3:
                text = text[: -rnd.randrange(1, 8)]
    for _ in range(40):  # unlike texts around one common passage
        out.append(" ".join([word() for _ in range(rnd.randrange(5, 60))] + passage + [word() for _ in range(rnd.randrange(5))]))
    out += ["", None, " \n", "a", "A", "a b c d", "A B\tc  D", "a b c d e", "a b c d e f", "x\x85y z"]
    rnd.shuffle(out)
    return [(i * 3 + 1, t, "x", "y", "z") for i, t in enumerate(out)]


@pytest.mark.parametrize("seed", [1, 2])
def test_components_equal_brute_force(spark, seed, monkeypatch):
    if seed == 2:
        monkeypatch.setattr(jaccard, "FREQUENT", 4)
    rows = corpus(seed)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_join(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()}
    assert got == brute(rows)


def test_large_family_stays_linear(spark):
    rnd = random.Random(5)
    base = [f"w{rnd.randrange(10_000)}" for _ in range(150)]
    rows = []
    for i in range(300):
        t = list(base)
        if i:
            for k in rnd.sample(range(150), 2):
                t[k] = f"e{i}"
        rows.append((i, " ".join(t), "", "", ""))
    got = jaccard.jaccard_join(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(rows)


def test_repeated_rows_null_ids_long_text_empty_table(spark):
    long = " ".join(f"v{i}" for i in range(60_000))
    rows = [(4, "a b c", "", "", ""), (4, "a b c", "", "", ""), (None, "a b c", "", "", ""), (None, "q", "", "", ""), (9, long, "", "", ""), (8, long + " end", "", "", "")]
    got = sorted((r.doc_id or -1, r.n_shingles, r.component_id or -1) for r in jaccard.jaccard_join(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == [(-1, 1, -1), (-1, 1, 4), (4, 1, 4), (4, 1, 4), (8, 59_997, 8), (9, 59_996, 8)]
    assert jaccard.jaccard_join(spark.createDataFrame([], SCHEMA)).count() == 0


def test_one_of_each_group_stays(spark):
    rows = corpus(3)
    want = {i for i, (_, c) in brute(rows).items() if i == c}
    got = jaccard.deduplicate(spark.createDataFrame(rows + rows[:20], SCHEMA))
    assert sorted(r.doc_id for r in got.collect()) == sorted(want) and got.columns == ["doc_id", "text", "id", "n", "component_id"]


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000 + i, 1000) for i in range(1, 50)] + [(5000, 5000), (7, 6)]
    got = {r.id: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(201)}, **{1000 + i: 1000 for i in range(50)}}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def unlike(rnd, n, common):
    """Texts of ``n`` words of their own around a common passage."""
    passage = [f"p{i}" for i in range(common)]
    return lambda i: " ".join([f"d{i}x{rnd.randrange(10**9)}" for _ in range(n)] + passage)


def test_large_sets_around_the_limit_equal_brute_force(spark):
    rnd = random.Random(11)
    rows = []
    for size in (1020, 2050, 4096):  # bitmaps of one size and of two
        base = [f"w{rnd.randrange(10**6)}" for _ in range(size)]
        for k in range(10):
            t = list(base) if k % 2 else base[: size - rnd.randrange(size // 5)]
            for at in rnd.sample(range(len(t)), round(len(t) * (0.005 + 0.005 * k))):
                t[at] = f"e{rnd.randrange(10**6)}"
            rows.append((len(rows), " ".join(t), "", "", ""))
    want = brute(rows)
    assert 3 < len({c for _, c in want.values()}) < len(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_join(spark.createDataFrame(rows, SCHEMA)).collect()} == want


def test_texts_of_large_unlike_sets_are_not_compared(spark, monkeypatch):
    make, counted, links = unlike(random.Random(12), 1700, 6300), [], jaccard._links
    monkeypatch.setattr(jaccard, "_links", lambda pairs, *rest: counted.append(pairs.count()) or links(pairs, *rest))
    rows = [(i, make(i), "", "", "") for i in range(3)]  # similarity 0.65
    assert {r.doc_id: r.component_id for r in jaccard.jaccard_join(spark.createDataFrame(rows, SCHEMA)).collect()} == {i: i for i in range(3)}
    assert counted == [0, 0]


def test_pairs_that_meet_in_too_few_blocks_are_dropped(spark, monkeypatch):
    make, counted, bounded = unlike(random.Random(13), 700, 300), [], jaccard._bounded_wide
    monkeypatch.setattr(jaccard, "_bounded_wide", lambda pairs, rows: counted.append(pairs.count()) or bounded(pairs, rows))
    rows = [(i, make(i), "", "", "") for i in range(12)]
    assert {r.doc_id: r.component_id for r in jaccard.jaccard_join(spark.createDataFrame(rows, SCHEMA)).collect()} == {i: i for i in range(12)}
    assert counted[1] == 0


def test_copies_of_a_text_do_not_multiply_its_links(spark, monkeypatch):
    for cells in "FILTER_CELLS", "TEXT_CELLS":  # filters that let every row through
        monkeypatch.setattr(jaccard, cells, 1, raising=False)
    counted, links = [], jaccard._links
    monkeypatch.setattr(jaccard, "_links", lambda *given: counted.append((made := links(*given)).count()) or made)
    words = [f"w{i}" for i in range(100)]
    rows = [(i, " ".join(words if i % 2 else words[:95]), "", "", "") for i in range(12)]
    assert {r.component_id for r in jaccard.jaccard_join(spark.createDataFrame(rows, SCHEMA)).collect()} == {0}
    assert counted == [1, 0]


def test_stars_need_no_round(spark, monkeypatch):
    made = []
    monkeypatch.setattr(graph, "cut_lineage", lambda df, f=graph.cut_lineage: made.append(1) or f(df))
    edges = [(i, 100) for i in range(101, 150)] + [(i, 7) for i in range(8, 20)] * 2
    got = {r.id: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 100 for i in range(100, 150)}, **{i: 7 for i in range(7, 20)}} and len(made) == 1
