import random
import re
from collections import Counter, defaultdict

import pytest

from firegrid.llm import divergence
from firegrid.llm.divergence import PerfectHash

SCHEMA = "doc_id long, lang string, source string, text string, term string, n string, value string"


def brute(rows, min_docs, top):
    rows = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))) for lang, source, text in rows]
    docs, counts, sources = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, terms in rows:
        docs[lang].update(set(terms))
        counts[lang, source].update(terms)
        sources[lang].add(source)
    out = set()
    for lang, names in sources.items():
        kept = [t for t, n in docs[lang].items() if n >= min_docs]
        whole = sum((Counter({t: counts[lang, s][t] for t in kept}) for s in names), Counter())

        def shares(c):
            total = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 5) // (total + 5 * len(kept)) for t in kept}

        p, q = {s: shares(counts[lang, s]) for s in names}, shares(whole)
        for s in names:
            pairs = [(-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode()) for o in names - {s}]
            terms = [(q[t] - p[s][t], t.encode()) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                out |= {(lang, s, part, item.decode(), -value, i) for i, (value, item) in enumerate(found, 1)}
    return out


def corpus(seed):
    rnd = random.Random(seed)
    words = [f"{a}{b}" for a in ("ka", "Ko", "é", "字", "ß", "x") for b in ("ra", "ri", "ñu", "TO", "", "q")]
    out = []
    for i in range(400):
        lang = rnd.choice(["a", "b", "c", None])
        source = "hot" if rnd.random() < 0.4 else rnd.choice(["s1", "s2", "s3", "Ä", None])
        text = " ".join(rnd.choices(words, [1 + (hash(source or "") + j) % 5 for j in range(len(words))], k=rnd.randrange(0, 30)))
        out.append((i, lang, source, text.replace(" ", rnd.choice([" ", "_", "7", "\n"])), "x", "y", "z"))
    out += [(900, "c", "empty", "", "", "", ""), (901, "only", "one", "kara", None, None, None), (902, "none", "s1", "1 2", "", "", ""), (903, "none", "s2", None, "", "", "")]
    out += [(904, "a", "s1", "KARA kora " * 20000, "", "", "")] + out[:5]
    return out


@pytest.mark.parametrize("seed,small", [(1, False), (2, True)])
def test_equals_brute_force(spark, seed, small, monkeypatch):
    if small:  # several shards, rounds, pieces, blocks and hand-overs
        for name, value in (("SHARD", 4), ("ROUND_BYTES", 2000), ("PIECE", 8), ("BLOCK", 2), ("HELD", 4)):
            monkeypatch.setattr(divergence, name, value)
    rows = corpus(seed)
    got = divergence.divergence(spark.createDataFrame(rows, SCHEMA).repartition(3), min_docs=5, top=6)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    got = [tuple(r) for r in got.collect()]
    assert len(got) == len(set(got)) and set(got) == brute([(r[1], r[2], r[3]) for r in rows], 5, 6)


def test_large_counts_stay_exact(spark):
    share = divergence._share
    n, total, terms = 4 * 10**17 + 7, 9 * 10**17 + 3, 12345
    row = spark.createDataFrame([(n, total, terms)], "n long, total long, terms long")
    assert row.select(share(row.n, row.total, row.terms)).first()[0] == 1 + 10**9 * (n + 5) // (total + 5 * terms)


def test_empty_table(spark):
    assert divergence.divergence(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("n", [0, 1, 2, 5000])
def test_perfect_hash(n):
    keys = [f"k{i}é".encode() for i in range(n)]
    h = PerfectHash.unpack(PerfectHash.build(keys).pack())
    assert sorted(h.slots(keys)) == list(range(n))  # minimal and without collisions
    assert (h.slots([f"x{i}".encode() for i in range(3000)]) == -1).all()  # the stored key decides
    assert [h.keys[int(i)].as_py() for i in h.slots(keys)] == keys
