from firegrid.llm import licenses

SCHEMA = "doc_id long, text string, license string, scope string"
MIT = next(b for n, b in licenses.KNOWN if n == "MIT" and len(b) > 500)


def found(spark, rows):
    return {(r.doc_id, r.scope, r.license): (r.n_hits, r.first_line) for r in licenses.scan(spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)).collect()}


def test_whole_texts_and_lines(spark):
    rows = [
        (1, MIT),
        (2, "Copyright (c) 2020 Somebody\n\n" + MIT.upper().replace("SUBLICENSE", "sub-licence".replace("-", "")).replace(".", " . ")),
        (3, MIT + " And more."),
        (4, "some text\nReleased under the MIT Licence!!\nmore\nreleased under the mit license"),
        (5, "It was Released under the MIT License."),
        (6, "Licensed under the Apache License, Version 2.0."),
    ]
    got = found(spark, rows)
    assert (1, "document", "MIT") in got and (2, "document", "MIT") in got
    assert not [k for k in got if k[0] == 3 and k[1] == "document"]
    assert got[4, "line", "MIT"] == (2, 1)
    assert not [k for k in got if k[0] == 5]
    assert got[6, "document", "Apache-2.0"] == (1, -1) and got[6, "line", "Apache-2.0"] == (1, 0)


def test_edges(spark):
    assert found(spark, [(1, None), (2, ""), (3, "\n\n"), (4, "license"), (5, "x" * 200_000 + " licen")]) == {}
    assert found(spark, [(None, "Released under the MIT License.")] * 2)[None, "line", "MIT"] == (2, 0)
    assert licenses.scan(spark.createDataFrame([], SCHEMA)).count() == 0


def test_other_licences_need_no_anchor(spark):
    docs = spark.createDataFrame([(1, "Do what you want!", "", "")], SCHEMA)
    assert licenses.scan(docs, known=(("FREE", "do what you want"),)).count() == 2
