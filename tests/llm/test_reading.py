import random

import numpy as np
from pyspark.sql import functions as F

from weftgraph.llm import reading as r

SETS = [["cat", "dog", "sun", "run", "red", "box"], ["team", "page", "list", "week", "report", "filter"], ["pipeline", "schema", "cluster", "broker", "catalogue", "tenant"], ["hypothesis", "taxonomy", "provisional", "consistency", "escalation", "comprehensive"], ["monotonicity", "perturbation", "ontological", "compositional", "indeterminacy", "teleological"]]


def text(rng, grade):
    def sentence(g):
        return "the " + " of ".join(rng.choice(SETS[g - 1]) for _ in range(6)) + "."

    near = [max(1, grade - 1), grade, grade, grade, grade]
    return " ".join(sentence(rng.choice(near)) for _ in range(12))


def test_isotonic():
    x, y = r.isotonic(np.array([1.0, 2, 3, 4]), np.array([1.0, 3, 2, 4]))
    assert list(np.interp([1, 2.5, 4], x, y)) == [1.0, 2.5, 4.0]


def test_read_marks_sentences():
    words = r.Words({"a": 2, "b": 3})
    ids, sentence, owner = r.read(["a b. a 12", None, "", "b\nzz"], words)
    assert ids.tolist() == [2, 3, 2, 1, 3, 0] and sentence.tolist() == [0, 0, 1, 1, 2, 3] and owner.tolist() == [0, 0, 3, 3]
    assert r.read([None, ""], words)[0].tolist() == []


def test_models_are_distributions():
    rng = random.Random(1)
    texts = [text(rng, g) for g in range(1, 6) for _ in range(10)]
    words = r.Words({w: k for k, w in enumerate(sorted({w for s in SETS for w in s} | {"the", "of"}), 2)})
    ids, sentence, owner = r.read(texts, words)
    size = len(words) + 2
    model = r.fit(ids, sentence, np.full((owner.size, r.GRADES), 0.2), size)
    for before in (words["the"], size):
        codes = before * size + np.arange(size)
        at = np.searchsorted(model["seen"], codes).clip(max=len(model["seen"]) - 1)
        bits = np.where((model["seen"][at] == codes)[:, None], model["both"][at], model["single"] + model["back"][before])
        assert np.allclose(np.exp2(-bits).sum(0), 1, atol=1e-3)


def test_held_out_accuracy_and_dirty_rows(spark):
    rng = random.Random(2)
    docs, grades = [], []
    for k in range(150):
        docs.append((k, text(rng, k % 5 + 1), "x"))
        if k < 100:
            grades.append((k, "r", k % 5 + 1))
    docs += [(900, None, "x"), (901, "", "x"), (902, "漢字 。 漢字", "x"), (903, "Jede Abfrage meldet nichts davon", "x"), (None, docs[0][1], "x"), docs[0]]
    grades += [(0, "q", None), (1, "q", 9), (None, "q", 3), (777, "q", 3)]
    d = spark.createDataFrame(docs, "doc_id bigint, text string, grade string")
    g = spark.createDataFrame(grades, "doc_id bigint, rater string, grade int")
    rows = r.reading_levels(d, g).collect()
    assert len(rows) == len(docs)
    by = {x.doc_id: x for x in rows}
    assert np.mean([by[k].grade == k % 5 + 1 for k in range(100, 150)]) >= 0.9
    assert by[900].level is None and by[901].level is None and not by[900].prose and not by[902].prose and not by[903].prose
    none = r.reading_levels(d, g.limit(0)).collect()
    assert len(none) == len(docs) and all(x.level is None for x in none)
    assert r.reading_levels(d.limit(0), g).collect() == []


def test_all_graded_documents_count(spark):
    """Words that only the last of many graded documents bring are known: none is left out of training."""
    rng = random.Random(5)
    docs = [(k, f"the cat of the dog. a {SETS[k % 5][k % 6]} of the sun.") for k in range(4_400)] + [(10_000 + k, text(rng, k % 5 + 1)) for k in range(60)]
    common = spark.createDataFrame(docs, "doc_id bigint, text string")
    grades = spark.createDataFrame([(k, k % 5 + 1) for k, _ in docs], "doc_id bigint, grade int")
    # the documents that a sample in the order of hashes takes last
    late = [x.doc_id for x in grades.orderBy(F.xxhash64("doc_id").desc()).limit(100).collect()]
    rare = common.withColumn("text", F.when(F.col("doc_id").isin(late), F.concat("text", F.lit(" Zyx qwv. Zyx qwv."))).otherwise(F.col("text")))
    state = r.train_model(rare, grades)
    known = {x.word: x.known for x in spark.read.parquet(state["words"]).filter("word in ('zyx', 'qwv')").collect()}
    assert known == {"zyx": [True] * 3, "qwv": [True] * 3}
    vocabulary = sorted(x.word for x in spark.read.parquet(state["words"]).collect())
    code = (vocabulary.index("zyx") + 2) * (len(vocabulary) + 2) + vocabulary.index("qwv") + 2
    counted = spark.read.parquet(state["counts"]).filter(f"m = {r.WHOLE} AND code = {code}").first()
    assert abs(sum(counted[f"w{g}"] for g in range(r.GRADES)) / r.STEP - 200) < 1e-3


def test_parts_make_the_whole():
    """Counts, sums and monotone blocks of parts are those of all texts."""
    rng = np.random.default_rng(6)
    f, y = rng.normal(size=(400, 3 + 2 * r.GRADES + 2 * len(r.QUANTILES))), rng.integers(1, 6, 400).astype(float)
    assert np.allclose(r.moments(f, y), r.moments(f[:150], y[:150]) + r.moments(f[150:], y[150:]))
    x = np.delete(f, (1, 2), axis=1)
    z = (x - x.mean(0)) / x.std(0)
    assert np.allclose(r.fit_line(r.moments(f, y))["weight"], np.linalg.solve(z.T @ z + r.RIDGE * np.eye(z.shape[1]), z.T @ (y - y.mean())))
    order = np.argsort(f[:, 0])
    rows = [(y[k], 1.0, f[k, 0], f[k, 0]) for k in order]
    whole = r.knots_of(r.pool([], rows))
    parts = r.knots_of(r.pool([], [b for a in range(0, 400, 90) for b in r.pool([], rows[a : a + 90])]))
    assert np.allclose(whole, parts)
