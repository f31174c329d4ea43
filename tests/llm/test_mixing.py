import math

import pytest
from pyspark.sql import functions as F

from firegrid.llm import mixing

SCHEMA = "doc_id long, text string, source string, copy string"


def docs(spark, n=3000):
    # one source holds two thirds of the rows
    rows = [(i, "x" * (10 + i % 7), "big" if i % 3 else f"s{i % 4}", "old") for i in range(n)] + [(n, None, "s1", None), (n + 1, "", None, None), (n + 2, "abc", None, None)]
    return spark.createDataFrame(rows, SCHEMA)


def test_sizes_follow_weights(spark):
    d = docs(spark)
    got = {r.source: r.n for r in mixing.mix(d, {"big": 1.0, "s0": 2.0, "s1": 1.0}).groupBy("source").agg(F.sum(F.length("text")).alias("n")).collect()}
    total = d.agg(F.sum(F.length("text"))).first()[0]
    assert set(got) == {"big", "s0", "s1"}
    for s, w in (("big", 0.25), ("s0", 0.5), ("s1", 0.25)):
        assert got[s] == pytest.approx(w * total, rel=0.12)


def test_copies_are_those_of_the_inverse(spark):
    d = docs(spark, 300)
    rate = {r.source: r.rate for r in mixing.rates(d).collect()}
    rows = mixing.mix(d, seed=3).collect()
    n = {}
    for r in rows:
        n.setdefault(r.doc_id, []).append(r.copy)
    assert all(sorted(c) == list(range(len(c))) for c in n.values())
    u = {r.doc_id: r.u for r in d.select("doc_id", mixing.uniform(F.lit("3"), F.col("doc_id").cast("string"), F.lit("1")).alias("u")).collect()}
    for r in d.collect():
        lam, k, p = rate[r.source], 0, math.exp(-rate[r.source])
        c = p
        if lam > mixing.PART_MEAN:
            continue
        while lam > 0 and c <= u[r.doc_id]:
            k += 1
            p *= lam / k
            c += p
        assert len(n.get(r.doc_id, [])) == k, r


def test_large_means_are_sums_of_parts(spark):
    d = spark.createDataFrame([(i, "abcd", "a" if i else "b", None) for i in range(2001)], SCHEMA)
    # the single document of b is wanted about a thousand times
    assert mixing.mix(d).where("source = 'b'").count() == pytest.approx(1000, abs=150)


def test_same_numbers_again_and_shuffled(spark):
    a, b = ([tuple(r) for r in mixing.mix(docs(spark, 500).repartition(p), seed=1).select("doc_id", "copy", "shuffle_key").collect()] for p in (1, 7))
    assert sorted(a) == sorted(b)
    assert a != sorted(a)


def test_many_sources_take_the_join(spark, monkeypatch):
    want = sorted(tuple(r) for r in mixing.mix(docs(spark, 200)).select("doc_id", "copy").collect())
    monkeypatch.setattr(mixing, "FEW_SOURCES", 1)
    assert sorted(tuple(r) for r in mixing.mix(docs(spark, 200)).select("doc_id", "copy").collect()) == want


def test_empty_table(spark):
    assert mixing.mix(spark.createDataFrame([], SCHEMA)).count() == 0
    assert mixing.mix(spark.createDataFrame([(1, None, None, None)], SCHEMA)).count() == 0
