import random
from collections import defaultdict

import pytest

from firegrid.llm import line_dedup

SCHEMA = "doc_id long, text string, hash string, n_lines string, doc string, batch string"
BLANK = " \t\n\x0b\x0c\r"


def key(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(BLANK))


def brute(rows):
    """By doc_id: a set of (text, n_lines, n_dropped)."""
    held = defaultdict(set)
    for doc, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= 20:
                held[key(line)].add(doc)
    last = {k: max(d, key=lambda x: (x is not None, x or 0)) for k, d in held.items() if len(d) >= 3}
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if last.get(key(x), doc) == doc]
        out.append((doc, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=str)


def corpus(seed):
    rnd = random.Random(seed)
    pool = [f"Line {i} of the common pool ÀÉ" for i in range(40)] + ["x" * 19, "é" * 19, "é" * 20, "short", ""]
    out = []
    for i in range(150):
        lines = [rnd.choice(pool) for _ in range(rnd.randrange(12))] + ["a line in every third text"] * (i % 3 == 0)
        rnd.shuffle(lines)
        lines = [rnd.choice(["", " ", "\t\x0b"]) + (x.upper() if rnd.random() < 0.2 and x.isascii() else x) + rnd.choice(["", "\r", "  "]) for x in lines]
        out.append((rnd.choice([i, -i, i + 10**12]), "\n".join(lines), "h", "n", "d", "b"))
    out += [(None, pool[0], "", "", "", ""), (None, pool[0] + "\n" + pool[1], "", "", "", ""), (7000, None, "", "", "", ""), (7001, "", "", "", "", ""), (7002, "\n\n", "", "", "", "")]
    out += [(8000, "only in null and one more", "", "", "", ""), (None, "only in null and one more", "", "", "", ""), (8000, "only in null and one more", "", "", "", "")]
    out += [(9000, "\n".join(rnd.choice(pool) for _ in range(30000)), "", "", "", "")] + out[:10]
    return out


@pytest.mark.parametrize("seed,batches,fanout", [(1, 4, 4), (2, 7, 2), (3, 1, 4)])
def test_equals_brute_force(spark, seed, batches, fanout, monkeypatch):
    monkeypatch.setattr(line_dedup, "FANOUT", fanout)
    monkeypatch.setattr(line_dedup, "HOT", 20)
    rows = corpus(seed)
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, SCHEMA).repartition(3), batches=batches)
    assert got.columns == ["doc_id", "text", "hash", "doc", "batch", "n_lines", "n_dropped"]
    assert sorted(((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in got.collect()), key=str) == brute([r[:2] for r in rows])


def test_string_ids_and_empty_table(spark):
    line = "one line that is long enough"
    got = line_dedup.dedup_lines(spark.createDataFrame([(i, line) for i in "abc"], "doc_id string, text string"))
    assert {(r.doc_id, r.text) for r in got.collect()} == {("a", ""), ("b", ""), ("c", line)}
    assert line_dedup.dedup_lines(spark.createDataFrame([], SCHEMA)).collect() == []


def test_decided_entries_are_not_added_again(spark):
    runs = line_dedup.LineRuns(spark, min_docs=2, fanout=3)
    batch = lambda rows: spark.createDataFrame([(d, h.encode()) for d, h in rows], "doc long, hash binary")
    runs.add(batch([(9, "a"), (8, "a"), (9, "b")]))
    runs.add(batch([(7, "a"), (7, "b"), (6, "c")]))  # a is decided, b not yet
    assert {bytes(r.hash) for r in spark.table(runs.levels[0][1][0]).collect()} == {b"b", b"c"}
    runs.add(batch([(99, "a"), (5, "b")]))  # a larger document is news
    assert [len(level) for level in runs.levels] == [0, 1]  # three runs became one
    assert {(bytes(r.hash), r.docs >= 2, r.last) for r in runs.entries().collect()} == {(b"a", True, 99), (b"b", True, 9), (b"c", False, 6)}
    runs.close()


def test_runs_are_not_shuffled_for_the_anti_join(spark):
    runs = line_dedup.LineRuns(spark)
    lines = spark.range(50_000).selectExpr("id AS doc", "unhex(md5(string(id % 20000))) AS hash")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        runs.add(lines)
        table = spark.table(runs.levels[0][0][0])
        plan = lines.groupBy("hash").count().join(table, "hash", "left_anti")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        runs.close()
    assert plan.count("Exchange") == 1 and "Bucketed: true" in plan
