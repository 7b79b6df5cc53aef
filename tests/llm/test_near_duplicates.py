import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from windrow.llm import embedding_dedup as E
from windrow.llm import jaccard_join as J
from windrow.llm.common import components


def classes(n, links):
    top = list(range(n))

    def find(x):
        while top[x] != x:
            top[x] = top[top[x]]
            x = top[x]
        return x

    for a, b in links:
        top[max(find(a), find(b))] = min(find(a), find(b))
    return [find(i) for i in range(n)]


def test_components(spark):
    rng = random.Random(2)
    links = [(i, i + 1) for i in range(40)] + [(100, 50 + i) for i in range(30)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)] + [(7, 7)]
    got = {r.id: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = classes(300, links)
    assert got == {i: want[i] for i in {x for a, b in links if a != b for x in (a, b)}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def shingles(text, n=4):
    words = (text or "").lower().split()
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if len(words) >= n else ({tuple(words)} if words else set())


def families(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(200)]
    docs = []
    for _ in range(8):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([7, 12, 20, 40, 100, 300]))]
        for _ in range(rng.choice([3, 10, 40])):
            text = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 3, 5])):
                text[rng.randrange(len(text))] = rng.choice(vocabulary)
            docs.append(" ".join(text))
    return docs


@pytest.mark.parametrize(("seed", "small"), [(1, 32), (2, 2)])
def test_classes_equal_brute_force(spark, seed, small):
    docs = [*families(seed), "", "a", "a b", "A  B", "a b c", None, "x y z q r s", "x y z q r s", "same " * 50_000]
    sets = [shingles(t) for t in docs]
    near = [(a, b) for a in range(len(docs)) for b in range(a) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    df = spark.createDataFrame([(i, t, "e") for i, t in enumerate(docs)], "doc_id long, text string, key string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in J.similarity_classes(df, small=small).collect()}
    want = classes(len(docs), near)
    assert got == {i: (len(sets[i]), want[i]) for i in range(len(docs))}


def test_linked_sets_share_a_signature():
    rng = np.random.default_rng(4)
    for size in [*range(6, 40), 100, 333]:
        whole = rng.integers(0, 2**63, 2 * size).astype(np.uint64)
        one = np.unique(whole[:size])
        for gone in range(size // 7 + 1):
            for new in range(size // 7 + 1):
                two = np.unique(np.concatenate([one[gone:], whole[size : size + new]]))
                common = len(np.intersect1d(one, two))
                if 100 * common >= 85 * (len(one) + len(two) - common) and len(two) and gone + new:
                    of, found = J.signatures([one, two], 85)
                    assert set(found[of == 0]) & set(found[of == 1])


def test_null_and_repeated_ids(spark):
    text = "one two three four five six seven"
    rows = [(5, text), (5, text), (None, text), (None, "other words entirely here now"), (9, text + " "), (3, "unlike anything else in here")]
    got = sorted((r.doc_id or -1, r.component_id or -1) for r in J.similarity_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(-1, -1), (-1, 5), (3, 3), (5, 5), (5, 5), (9, 5)]
    assert J.similarity_classes(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_stage_keeps_one_of_each_class(spark):
    text = "one two three four five six seven"
    rows = [(5, text, "a"), (5, text, "a"), (9, text.upper(), "a"), (3, "unlike anything else in here", None), (None, "no id", "a"), (4, None, "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, copies string")
    got = J.jaccard_stage(spark, df, "")
    assert got.columns == df.columns and sorted(r.doc_id or -1 for r in got.collect()) == [-1, 3, 4, 5]


def test_stage_links_five_words_at_four_fifths(spark):
    base = [f"b{i}" for i in range(200)]
    docs = [" ".join(base), " ".join(base + [f"x{i}" for i in range(49)]), " ".join([f"y{i}" for i in range(50)] + base), *families(3)]  # 196/245, 196/246
    sets = [shingles(t, 5) for t in docs]
    near = [(a, b) for a in range(len(docs)) for b in range(a) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    assert (1, 0) in near and (2, 0) not in near
    got = J.jaccard_stage(spark, spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string"), "")
    assert sorted(r.doc_id for r in got.collect()) == sorted(set(classes(len(docs), near)))


@pytest.mark.parametrize("limit", [100_000, 0])
def test_stage_decides_by_row(spark, limit):
    one, two, three, four = (" ".join(f"{c}{i}" for i in range(30)) for c in "abcd")
    rows = [(1, one), (1, two), (2, one), (2, three), (None, four), (None, "no like of it here at all"), (None, one), (None, four), (None, None), (None, None), (3, None), (3, None)]
    got = J.jaccard_stage(spark, spark.createDataFrame(rows, "doc_id long, text string"), "", broadcast_rows=limit)
    want = [(1, one), (1, two), (2, three), (None, four), (None, rows[5][1]), (None, None), (None, None), (3, None)]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))


@pytest.mark.parametrize("options", [{}, {"parts": 3, "least": 1, "most_bytes": 4_000}])
def test_clusters_have_few_blocks_and_lose_no_link(spark, monkeypatch, options):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 60, np.uint64)
    sets = [np.unique(np.concatenate([base[: 60 - i % 13], rng.integers(0, 2**63, i % 29, np.uint64)])) for i in range(5_000 if not options else 120)]
    if not options:  # most are alike in one part only
        sets[100:] = [np.unique(np.concatenate([s[:4], rng.integers(0, 2**63, 20, np.uint64)])) for s in sets[100:]]
    keys = np.arange(len(sets)) - 50
    rows = [(int(k), len(s), s.tolist(), d) for k, s, d in zip(keys, sets, J.sketches(sets).to_pylist())]
    given = spark.createDataFrame(rows, "key long, n long, elements array<long>, sketch array<long>").coalesce(4).persist()
    tables = {}
    kept = J.stored
    monkeypatch.setattr(J, "stored", lambda df, label, *a: tables.setdefault(label, kept(df, label, *a)))
    members = given.select(F.lit(1).cast("long").alias("cluster"), "key", F.col("key").alias("class"))
    links = [(r.a + 50, r.b + 50) for r in J.block_links(members, given.select("key", "elements"), given, 80, **options).collect()]
    near = [(a, b) for a in range(120) for b in range(a) for n in [len(np.intersect1d(sets[a], sets[b]))] if 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n)]
    assert near and classes(len(sets), links) == classes(len(sets), near)
    if not options:
        assert tables["numbered"].select("block").distinct().count() <= 8
        assert tables["meet"].count() < 1_000


def vectors(seed):
    rng = np.random.default_rng(seed)
    rows = []
    for family in range(30):
        base = rng.standard_normal(64)
        for _ in range(int(rng.integers(1, 12))):
            x = base + rng.standard_normal(64) * np.linalg.norm(base) / 8 * rng.uniform(0, 0.45)
            rows.append((x * rng.uniform(0.1, 9)).astype(np.float32).tolist())
    out = [(i, x, int(rng.integers(0, 2))) for i, x in enumerate(rows)]
    out += [(1000 + i, rows[0], out[0][2]) for i in range(40)]
    return out


ODD = [(2000, None, 0), (2001, [], 0), (2002, [0.0] * 64, 0), (2003, [1.0] * 63 + [None], 0), (2004, [float("nan")] + [1.0] * 63, 0), (2005, [float("inf")] + [1.0] * 63, 0), (2006, [1.0, 2.0], 0), (2007, [1.0, 2.0], None), (2008, [2.0, 4.0], 0)]


@pytest.mark.parametrize("block", [512, 16])
def test_links_equal_brute_force(spark, block):
    rows = vectors(1)
    x = np.array([r[1] for r in rows], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    label = np.array([r[2] for r in rows])
    near = (x @ x.T >= 0.93) & (label[:, None] == label)
    np.fill_diagonal(near, False)
    df = spark.createDataFrame([(*r, "e") for r in rows + ODD], "vec_id long, embedding array<float>, label int, node string")
    got = {r.vec_id: r for r in E.near_duplicates(df, E.CollisionParams(block=block)).collect()}
    assert len(got) == len(rows) + len(ODD) and near.sum() > 500
    order = [r[0] for r in rows]
    top = classes(len(rows), [(a, b) for a, b in zip(*np.nonzero(near)) if a > b])
    assert [got[i].n_links for i in order] == near.sum(axis=1).tolist()
    assert [got[i].component_id for i in order] == [order[t] for t in top]
    assert all(got[i].kept == (got[i].component_id == i) for i in got)
    assert {i: got[i].n_links for i, _, _ in ODD} == {2000: 0, 2001: 0, 2002: 0, 2003: 0, 2004: 0, 2005: 0, 2006: 1, 2007: 0, 2008: 1}


def test_windows_reach_the_recall():
    p = E.CollisionParams()
    width, least = p.windows(64)
    rng = np.random.default_rng(0)
    found = 0
    directions = p.directions(64)
    for _ in range(4000):
        a = rng.standard_normal(64)
        a /= np.linalg.norm(a)
        b = rng.standard_normal(64)
        b -= b @ a * a
        b = 0.93 * a + np.sqrt(1 - 0.93**2) * b / np.linalg.norm(b)
        found += (np.abs(directions @ (a - b)) <= width).sum() >= least
    assert found >= 3990


def at_threshold(rng, n, cosine, dims=64):
    a = rng.standard_normal((n, dims))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = rng.standard_normal((n, dims))
    b -= (a * b).sum(axis=1, keepdims=True) * a
    return a, cosine * a + np.sqrt(1 - cosine**2) * b / np.linalg.norm(b, axis=1, keepdims=True)


@pytest.mark.parametrize("cuts", [0, 1, 4, 7])
def test_tables_reach_the_recall(cuts):
    p = E.CollisionParams()
    a, b = at_threshold(np.random.default_rng(2), 6000, 0.93)
    met = (p.cells(a, cuts) == p.cells(b, cuts)).any(axis=1).mean()
    assert met >= p.recall - 0.002 and p.cells(a, cuts).max() < 1 << cuts


def test_one_hot_label_in_many_cells(spark):
    """Pairs just above the threshold, a large group of like vectors, and the rest apart: recall against brute force."""
    rng = np.random.default_rng(5)
    a, b = at_threshold(rng, 900, 0.932)
    like = rng.standard_normal(64) + rng.standard_normal((300, 64)) * 0.2
    x = np.concatenate([a, b, like, rng.standard_normal((400, 64))]).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: r for r in E.near_duplicates(df, E.CollisionParams(cell=40, block=64)).collect()}
    x = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    near = x @ x.T >= 0.93
    np.fill_diagonal(near, False)
    links = np.array([got[i].n_links for i in range(len(x))])
    assert (links <= near.sum(axis=1)).all() and links.sum() >= 0.998 * near.sum()
    pairs = links[:1800]
    assert pairs.sum() >= 0.99 * near[:1800].sum()


def test_no_vectors(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert E.near_duplicates(df).count() == 0
