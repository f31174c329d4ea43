import random
import tracemalloc
import zlib

from firegrid.llm import toxicity

BAD = ["idiot", "scum", "trash", "moron", "pathetic"]
SCHEMA = "doc_id long, text string, score string, lang string"


def corpus(n=600, seed=1):
    rnd = random.Random(seed)
    parts = "th er on an re he in ed nd ha at en es of or nt ea ti to it".split()
    rows, labels = [], []
    for i in range(n):
        words = ["".join(rnd.choices(parts, k=rnd.randrange(1, 4))) for _ in range(rnd.randrange(20, 150))]
        y = int(i % 5 == 0)
        if y:
            for _ in range(rnd.randrange(1, 6)):
                words.insert(rnd.randrange(len(words)), rnd.choice(BAD))
        rows.append((i, " ".join(words), "clash", "en"))
        labels.append((i, y))
    return rows, labels


def test_held_out_accuracy(spark):
    rows, labels = corpus()
    docs, known = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.score(docs, toxicity.fit(docs, known)).collect()}
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())
    held = [(got[i].predicted, y) for i, y in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum(p == y for p, y in held) / len(held) > 0.9
    assert sum(p for p, y in held if y) / sum(y for _, y in held) > 0.75


def test_only_training_labels_and_texts_matter(spark):
    rows, labels = corpus(300)
    docs = spark.createDataFrame(rows, SCHEMA)
    flipped = [(i, 1 - y if zlib.crc32(str(i).encode()) % 5 == 0 else y) for i, y in labels]
    a, b = (toxicity.fit(docs, spark.createDataFrame(x, "doc_id long, toxic int")) for x in (labels, flipped))
    share = lambda m: (m.base, m.toxic, m.saving, m.weights)
    assert share(a) == share(b)


def test_edges(spark):
    rows, labels = corpus(300)
    docs = spark.createDataFrame(rows, SCHEMA)
    known = spark.createDataFrame([*labels, (1, None), (None, 1), (10**9, 1)], "doc_id long, toxic int")
    m = toxicity.fit(docs, known)
    odd = [(1, None, "", ""), (2, "", "", ""), (2, "", "", ""), (None, "idiot " * 3, "", ""), (3, "12 !!", "", ""), (4, "th er " * 50_000 + "idiot scum", "", "")]
    got = toxicity.score(spark.createDataFrame(odd, SCHEMA), m).collect()
    assert len(got) == 6
    calm = {r.score for r in got if r.doc_id in (1, 2, 3)}
    assert len(calm) == 1 and calm.pop() < 0.5
    assert toxicity.score(spark.createDataFrame([], SCHEMA), m).count() == 0
    kept = toxicity.without(docs, m)
    assert kept.columns == docs.columns and kept.count() < 300


def test_one_class_or_no_labels_give_the_share(spark):
    docs = spark.createDataFrame([(i, "a b c", "", "") for i in range(10)], SCHEMA)
    none = toxicity.score(docs, toxicity.fit(docs, spark.createDataFrame([], "doc_id long, toxic int")))
    assert {round(r.score, 6) for r in none.collect()} == {0.5}
    ones = toxicity.score(docs, toxicity.fit(docs, spark.createDataFrame([(i, 0) for i in range(10)], "doc_id long, toxic int")))
    assert all(r.score < 0.01 for r in ones.collect())


def test_phrase_of_words_used_earlier_is_in_a_window(spark):
    rnd = random.Random(3)
    phrase = "you are 2 pure evil"
    calm = [rnd.choice("th er on an re he in ed nd ha at en es of or nt ea ti to it".split()) for _ in range(3000)]
    for at, w in zip((100, 700, 1300, 1900, 2500), phrase.split(), strict=True):
        calm[at] = w
    # only the longest saving of the short windows counts
    model = toxicity.Model(" ".join(calm[:2600]).encode(), f" {phrase} ".encode(), 4, (-30.0, 0.0, 0.0, 0.0, 80.0, *[0.0] * 6))
    docs = [(-1, " ".join(calm), "", "")] + [(k, " ".join([*calm[: 2600 + k], phrase, *calm[2600 + k :]]), "", "") for k in range(16)]
    got = {r.doc_id: r.predicted for r in toxicity.score(spark.createDataFrame(docs, SCHEMA), model).collect()}
    assert got.pop(-1) == 0 and set(got.values()) == {1}, "every place of the phrase lies whole in a window"


def test_windows_are_the_running_text():
    for n in range(60):
        words = [f"w{k % 7}" for k in range(n)]
        for width in toxicity.WINDOWS:
            got = [w.decode().split() for w in toxicity.windows_of(words, width)]
            starts = range(0, width // 2 * len(got), width // 2)
            assert all(g == words[a : a + width] for a, g in zip(starts, got, strict=True))
            assert {k for a, g in zip(starts, got, strict=True) for k in range(a, a + len(g))} == set(range(n))
            need = width // 2 + 1
            assert all(any(a <= k and k + need <= a + len(g) for a, g in zip(starts, got, strict=True)) for k in range(n - need + 1))
    assert toxicity.words_of("You, you 24 YOU") == ["you", "you", "24", "you"]


def test_windows_that_are_not_compressed_save_nothing():
    rnd = random.Random(4)
    letters = "e n i r t s a h d u l o g m c".split()
    vocabulary = ["".join(rnd.choices(letters, k=rnd.randrange(1, 9))) for _ in range(6000)]
    bad = ["".join(rnd.choices(letters, k=9)) for _ in range(150)]
    line = lambda words, n: " ".join(rnd.choices(words, k=n))
    base = toxicity._trained(toxicity.BASE_BYTES, [line(vocabulary, 150).encode() for _ in range(700)], k=32, d=8)
    for size in toxicity.TOXIC_BYTES:
        toxic = toxicity._trained(size, [f" {line(bad + vocabulary[:100], 40)} ".encode() for _ in range(200)], k=16, d=6)
        savings = toxicity.Model(base, toxic, 1, ()).savings()
        texts = [line(vocabulary + bad * (k % 4), rnd.randrange(200)).split() for k in range(200)] + [[], ["x" * 9000, "y"], [bad[0][:5]], ["é" * 3, "ü"], vocabulary[:3] + ["z" * 5000] + bad[:40]]
        want = [[[len(savings.base(w)) - len(savings.toxic(w)) for w in toxicity.windows_of(t, width)] for width in toxicity.WINDOWS] for t in texts]
        assert savings.marks.usable and [[s.tolist() for s in savings.of(t)] for t in texts] == want
        windows = sum(len(x) for t in want for x in t)
        assert len(savings) < 0.8 * windows, "most windows need no compression"
    # dictionaries whose tables may differ leave nothing out
    small = toxicity.Model(base[:3000], toxic, 1, ()).savings()
    assert not small.marks.usable and [s.tolist() for s in small.of(texts[5])] == [[len(small.base(w)) - len(small.toxic(w)) for w in toxicity.windows_of(texts[5], width)] for width in toxicity.WINDOWS]


def test_driver_holds_neither_words_nor_rare_letters(spark):
    rnd = random.Random(7)
    words = ["".join(rnd.choices("abcdefghijklmnopqrstuvwxyz", k=8)) for _ in range(40_000)]
    rows = [(i, " ".join(rnd.sample(words, 500) + BAD * (i % 5 == 0)), "", "") for i in range(600)]
    docs = spark.createDataFrame(rows, SCHEMA)
    known = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(600)], "doc_id long, toxic int")
    tracemalloc.start()
    try:
        toxicity.fit(docs, known)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 26e6, peak
