import re
from collections import Counter

from firegrid.llm import quality

SCHEMA = "doc_id long, text string, n_words string, kept string"


def brute(text):
    t = text or ""
    words = [w for w in re.split("[ \t\n\x0b\x0c\r]+", t) if w]
    grams = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {j for i in range(len(words) - 7) if grams[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in t.split("\n") if re.search("[^ \t\n\x0b\x0c\r]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered)


TEXTS = [
    None,
    "",
    " \n\t ",
    "one",
    "the a b c d e f g",
    "a b c d e f g h a b c d e f g h",
    "x " * 40,
    "a b c\x85d # | <b> \x0b tail",
    "line\nline\n\nline\n \n- x\n• y\nend...\nmore…",
    ("the cat and the dog went to a house " * 3 + "with some other words in it that are new ") * 2,
    " ".join(f"w{i % 97}" for i in range(20_000)),
]


def test_measures(spark):
    got = quality.judge(spark.createDataFrame([(i, t, "clash", "clash") for i, t in enumerate(TEXTS)] * 2, SCHEMA)).collect()
    assert len(got) == 2 * len(TEXTS)
    for r in got:
        n, chars, symbols, dup, repeat = brute(r.text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dup, repeat), r.text
        assert r.base_failed == (n < 20 or 100 * repeat > 30 * n)
        assert not (r.base_failed and r.kept)


def test_rules_decide(spark):
    good = "the quick brown fox is in the garden of the old house and it sees that the dog was not there at all today"
    symbols = " ".join(w + "###" for w in good.split())
    rare = " ".join(f"qq{i}" for i in range(30))
    got = {r.doc_id: (r.kept, r.failed) for r in quality.judge(spark.createDataFrame([(1, good, "", ""), (2, symbols, "", ""), (3, rare, "", "")], SCHEMA)).collect()}
    assert got[1] == (True, [])
    assert got[2][1] == ["symbols", "stop_words"] and got[3][1] == ["stop_words"]


def test_one_projection_without_python(spark):
    plan = quality.judge(spark.createDataFrame([(1, "a", "", "")], SCHEMA))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan


def test_empty_table(spark):
    assert quality.judge(spark.createDataFrame([], SCHEMA)).count() == 0
