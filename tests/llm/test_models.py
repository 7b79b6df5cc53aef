import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from windrow.llm import quality as Q
from windrow.llm import toxicity as T
from windrow.llm.common import word_hashes

RNG = np.random.default_rng(3)
WORDS = ["alpha", "beta", "gamma", "delta", "eta", "theta", "iota", "kappa", "mu", "nu", "xi", "rho", "tau", "phi", "chi", "psi"]


def prose(n):
    return " ".join(RNG.choice(WORDS, n)) + "."


@pytest.fixture(scope="module")
def corpus(spark):
    rows = []
    for i in range(800):
        bad, mean = i % 4 == 0, i % 5 == 0
        text = prose(int(RNG.integers(20, 60)))
        if mean:
            text = text.replace(" ", " vile ", 1)
        if bad:
            text = " ".join(w + "###" for w in text.split())
        rows.append((i, text, int(not bad), int(mean), "x", "y"))
    return spark.createDataFrame(rows, "doc_id long, text string, quality int, toxic int, id string, label string")


ODD = [(1000, None), (1001, ""), (1002, "   \n"), (1003, "word " * 100_000), (1004, "twice"), (1004, "twice"), (None, "no id")]


def odd(spark):
    return spark.createDataFrame([(i, t, "z", 9) for i, t in ODD], "doc_id long, text string, id string, label int")


def test_quality_learns_and_scores_everything(spark, corpus):
    labels = Q.clean_labels(corpus.where("doc_id < 600"), "quality")
    model = Q.fit_quality(corpus, labels)
    got = {r.id: r.score for r in Q.score_quality(corpus, model).collect()}
    held = [(got[r.doc_id] >= 0.5) == bool(r.quality) for r in corpus.where("doc_id >= 600").collect()]
    assert np.mean(held) > 0.95
    rest = Q.score_quality(odd(spark), model).collect()
    assert len(rest) == len(ODD) and all(0 <= r.score <= 1 for r in rest)
    assert Q.score_quality(odd(spark).limit(0), model).count() == 0


def test_quality_score_is_a_log_density_difference(spark, corpus):
    labels = Q.clean_labels(corpus, "quality")
    stats = Q.text_statistics(corpus)
    model = Q.fit_quality(corpus, labels, pooling=0.3, ridge=0.02)
    rows = {r.id: np.array(r.stats) for r in stats.collect()}
    y = {r.id: r.label for r in labels.collect()}
    x = np.array([rows[i] for i in sorted(rows)])
    c = np.array([y[i] for i in sorted(rows)])
    sd = x.std(axis=0)
    z = (x - x.mean(axis=0)) / np.where(sd > 1e-9, sd, 1)
    cov = {k: np.cov(z[c == k].T, bias=True) for k in (0, 1)}
    pooled = sum(cov[k] * (c == k).mean() for k in (0, 1))
    density = []
    for k in (0, 1):
        s = 0.98 * (0.7 * cov[k] + 0.3 * pooled) + 0.02 * np.eye(len(sd))
        d = z - z[c == k].mean(axis=0)
        density.append(np.log((c == k).mean()) - 0.5 * np.linalg.slogdet(s)[1] - 0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(s), d))
    want = 1 / (1 + np.exp(np.clip(density[0] - density[1], -500, 500)))
    assert np.allclose(model.score(x), want, atol=1e-6)


def test_one_class_or_none(spark, corpus):
    none = Q.fit_quality(corpus, Q.clean_labels(corpus.limit(0), "quality"))
    one = Q.fit_quality(corpus, Q.clean_labels(corpus.where("quality = 1"), "quality"))
    assert Q.score_quality(corpus, none).first().score == 0.5 and Q.score_quality(corpus, one).first().score == 1.0


def test_repeated_ids_and_text_ids_train(spark, corpus):
    labels = Q.clean_labels(corpus, "quality")
    twice = corpus.unionByName(corpus.where("doc_id % 2 = 0").withColumn("text", F.lit("other text here")))
    one, two = (Q.fit_quality(twice.repartition(n), labels) for n in (2, 7))
    x = Q.batch_statistics(pa.array(["some plain words", "### $$$", None]))
    assert np.allclose(one.score(x), two.score(x))
    named = corpus.withColumn("doc_id", F.concat(F.lit("n"), "doc_id"))
    assert np.allclose(Q.fit_quality(named, Q.clean_labels(named, "quality")).score(x), Q.fit_quality(corpus, labels).score(x))


def test_labels_by_majority(spark):
    rows = spark.createDataFrame([(1, 0), (1, 0), (1, 1), (2, 1), (2, 0), (3, None), (None, 1)], "doc_id long, quality int")
    assert {r.id: r.label for r in Q.clean_labels(rows, "quality").collect()} == {1: 0, 2: 1}


def test_toxicity_learns_a_word(spark, corpus):
    labels = Q.clean_labels(corpus.where("doc_id < 600"), "toxic")
    p = T.FtrlParams(bits=16, l1=4.0, epochs=8)
    model = T.fit_toxicity(corpus, labels, p)
    got = {r.id: r.score for r in T.score_toxicity(corpus, model).collect()}
    held = [(got[r.doc_id], r.toxic) for r in corpus.where("doc_id >= 600").collect()]
    order = [(a > b) + (a == b) / 2 for a, toxic in held if toxic for b, other in held if not other]
    assert np.mean(order) > 0.95 and len(model.coordinates) < 5000
    rest = T.score_toxicity(odd(spark), model).collect()
    assert len(rest) == len(ODD) and all(0 <= r.score <= 1 for r in rest)
    assert T.score_toxicity(odd(spark).limit(0), model).count() == 0


def test_toxicity_score_equals_a_plain_sum(spark, corpus):
    model = T.fit_toxicity(corpus, Q.clean_labels(corpus, "toxic"), T.FtrlParams(bits=14, l1=0.5))
    weight = dict(zip(model.coordinates.tolist(), model.weights))
    for r in T.score_toxicity(corpus.limit(20), model).join(corpus.select("doc_id", "text"), T.F.col("id") == T.F.col("doc_id")).collect():
        raw = np.frombuffer(r.text.encode(), np.uint8)
        words, _ = word_hashes(raw, np.array([0, len(raw)]), T._KEEP)
        found = set(np.concatenate(T.coordinates(words, 14)).astype(int).tolist())
        total = model.intercept + sum(weight.get(i, 0) for i in found)
        assert abs(r.score - 1 / (1 + np.exp(-total))) < 1e-9


def test_ftrl_minimises_its_regularised_sum():
    """Weights are found anew for each row by bisection over the sum that FTRL-proximal minimises, from all past steps."""
    p = T.FtrlParams(bits=4, alpha=0.7, beta=1.3, l1=2.0, l2=0.05, epochs=3)  # so much L1 that some weights are zero
    draw = np.random.default_rng(11)
    rows = [(int(k % 3 == 0), np.unique(draw.integers(0, 12, 5))) for k in range(30)]
    past = {}  # coordinate (-1: intercept) to its (gradient, sigma, weight) steps

    def best(i):
        l1, l2 = (0.0, 0.0) if i < 0 else (p.l1, p.l2)
        steps = past.get(i, [])

        def slope(w):
            return sum(g + s * (w - v) for g, s, v in steps) + (p.beta / p.alpha + l2) * w

        if abs(slope(0.0)) <= l1:
            return 0.0
        low, high = -50.0, 50.0
        for _ in range(80):
            w = (low + high) / 2
            low, high = (low, w) if slope(w) + l1 * np.sign(w) > 0 else (w, high)
        return (low + high) / 2

    order = np.random.default_rng(7)
    for _ in range(p.epochs):
        for k in order.permutation(len(rows)):
            label, features = rows[k]
            now = {i: best(i) for i in [-1, *features.tolist()]}
            g = 1 / (1 + np.exp(-sum(now.values()))) - label
            for i, w in now.items():
                n = sum(h * h for h, _, _ in past.get(i, []))
                past.setdefault(i, []).append((g, (np.sqrt(n + g * g) - np.sqrt(n)) / p.alpha, w))
    expected = {i: best(i) for i in past}
    used, weights, intercept = T.ftrl(rows, p)
    assert 0 < len(used) < 12 and set(used.tolist()) == {i for i, w in expected.items() if i >= 0 and w}
    np.testing.assert_allclose(weights, [expected[i] for i in used.tolist()], atol=1e-8)
    assert abs(intercept - expected[-1]) < 1e-8


def test_no_labels(spark, corpus):
    model = T.fit_toxicity(corpus, Q.clean_labels(corpus.limit(0), "toxic"))
    assert T.score_toxicity(corpus, model).first().score == 0.5


def test_bound_of_the_sample(spark, corpus):
    p = T.FtrlParams(bits=12, max_train=10)
    assert len(T.fit_toxicity(corpus, Q.clean_labels(corpus, "toxic"), p).coordinates) < 10 * 250
