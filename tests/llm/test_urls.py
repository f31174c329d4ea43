import numpy as np
import xxhash

from firegrid.llm import urls

RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("spam.example.net", "listed")]
CASES = [
    ("http://a.example.ORG/es/1?x", "example.org/es/", "block"),
    ("https://Example.org/en/12", "example.org/en/1", "block"),
    ("https://example.org/en/2", "org/", "allow"),
    ("https://notexample.org/es/2", "org/", "allow"),
    ("http://x.com/fr/#a", "com/fr/", "allow"),
    ("http://x.com/frog", None, "allow"),
    ("http://www.spam.example.net", None, "block"),
    ("http://notspam.example.net/", None, "allow"),
    ("http://org?q=/", None, "allow"),
    ("no scheme", None, "allow"),
    ("", None, "allow"),
    (None, None, "allow"),
    ("http://a\nb.org/\nes/", "org/", "allow"),
    ("http://" + "a." * 300 + "org/" + "p" * 5000, "org/", "allow"),
]


def test_rules(spark):
    pages = spark.createDataFrame([(i, u, "clash", "clash") for i, (u, _, _) in enumerate(CASES)] * 2, "page_id long, url string, host string, verdict string")
    got = urls.filter_urls(pages, urls.UrlList(spark, RULES)).collect()
    assert len(got) == 2 * len(CASES)
    for r in got:
        assert (r.rule, r.verdict) == CASES[r.page_id][1:], CASES[r.page_id]
    assert {r.page_id: r.path for r in got}[12] == "/\nes/"


def test_empty_tables_and_lists(spark):
    schema = "page_id long, url string"
    assert urls.filter_urls(spark.createDataFrame([], schema), urls.UrlList(spark, RULES)).count() == 0
    got = urls.filter_urls(spark.createDataFrame([(1, "http://a/b")], schema), urls.UrlList(spark, [])).first()
    assert (got.rule, got.verdict) == (None, "allow")


def test_stored_strings_settle_collisions():
    few = lambda b: xxhash.xxh64_intdigest(b) % 3
    patterns = [f"h{i}.org" for i in range(50)]
    a = urls.sorted_arrays([(p, "block") for p in patterns], digest=few)
    arrays = tuple(a[k] for k in urls.ARRAYS)
    asked = patterns + ["h50.org", "other"]
    found = urls.probe(arrays, asked, digest=few)
    assert (found[:50] >= 0).all() and (found[50:] == -1).all() and len(np.unique(found[:50])) == 50


def test_arrays_are_mapped(spark):
    u = urls.UrlList(spark, RULES)
    assert all(isinstance(a, np.memmap) for a in urls._mapped(u.name))
