import os
import re

import numpy as np
import pytest

import __spark_entry__ as entry
from windrow.operators import blocks as B

DATA = "/root/testdata/sf0.001"
ONE, TWO = "redgreenbluewhite", "bluexgreenred"
LINE = "this line is in all of them."
TEXTS = [
    ONE, TWO, ONE, "xx" + TWO[3:15] + "yy" + ONE[2:12], "abcabcabcabc", "bcabca", "", "zz", ONE + TWO + ONE, None, TWO, ONE, "aaaaaaaaaaaaaaaa", "aaaaa", "é€😀é€😀é€",
    "x😀é€x", *(LINE + f"{i:03d}" * 20 for i in range(20)), LINE, LINE + "x", "y" + LINE, LINE, "abc", "abc",
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(7 * i - 20, t) for i, t in enumerate(TEXTS)] + [(None, ONE)]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(5)


def brute(k):
    """{(x, y): (positions of x whose gram y has, distinct grams in common)}"""
    grams = {7 * i - 20: [t[p : p + k] for p in range(len(t) - k + 1)] for i, t in enumerate(t or "" for t in TEXTS)}
    for x, a in grams.items():
        for y, b in grams.items():
            theirs = set(b)
            if x != y and (at := [p for p, g in enumerate(a) if g in theirs]):
                yield (x, y), (at, len(set(a) & theirs))


def merged(at, k):
    out = []
    for p in at:
        if out and p - (out[-1][1] - k) <= k - 1:
            out[-1][1] = p + k
        else:
            out.append([p, p + k])
    return out


@pytest.mark.parametrize(("k", "sizes"), [(3, None), (3, (40, 50, 60, 5)), (12, None), (2, (1, 1, 1, 1))])
def test_pairs_equal_brute_force(spark, docs, k, sizes, monkeypatch):
    if sizes:
        for name, n in zip(("CHUNK", "BUCKET", "BLOCK", "ROWS"), sizes):
            monkeypatch.setattr(B, name, max(n, 50) if name in ("BUCKET", "BLOCK") else n)
    want, whole = dict(brute(k)), {7 * i - 20: len(t or "") for i, t in enumerate(TEXTS)}
    texts = B.Texts(docs, k)
    slices = {(x, y, *s) for (x, y), (at, _) in want.items() for s in merged(at, k)}
    got = [tuple(r) for r in texts.slices().collect()]
    assert len(got) == len(slices) and set(got) == slices
    marked = {(r.x, r.y): (r.length, r.marked) for r in texts.marked().collect()}
    assert marked == {p: (whole[p[0]], sum(b - a for a, b in merged(at, k))) for p, (at, _) in want.items()}
    scores = {p: len({q for s in at for q in range(s, s + k)}) for p, (at, _) in want.items()}
    assert {(r.x, r.y): (r.overlap, r.coverage, r.similarity) for r in texts.scores().collect()} == {p: (n, whole[p[0]], n / whole[p[0]]) for p, n in scores.items()}
    assert {(r.x, r.y): r.shared for r in texts.shared().collect()} == {p: n for p, (_, n) in want.items() if p[0] < p[1]}
    like = {p: n / whole[p[0]] for p, n in scores.items()}
    for above in (0.33, 0.7):
        kept = {p: s for p, s in like.items() if s > above}
        assert {(r.x, r.y): r.similarity for r in texts.similar(above).collect() if r.similarity > above} == kept
        both = {(r.x, r.y): tuple(r)[2:] for r in texts.both_ways(above).collect() if r.similarity > above}
        assert both == {(x, y): (scores[x, y], s, scores[y, x], like[y, x]) for (x, y), s in kept.items()}
        lists = {(r.x, r.y): (r.similarity, [tuple(s) for s in r.slices]) for r in texts.similar_slices(above).collect() if r.similarity > above}
        assert lists == {p: (s, [tuple(z) for z in merged(want[p][0], k)]) for p, s in kept.items()}
    best, top = {}, {}
    for (x, y), s in like.items():
        best[x] = min(best.get(x, (0, 0)), (-round(s, 6), y))
    for r in texts.best().collect():
        top[r.x] = min(top.get(r.x, (0, 0)), (-round(r.similarity, 6), r.y))
    assert top == best
    counts = {}
    for p, n in scores.items():
        counts[n / whole[p[0]]] = counts.get(n / whole[p[0]], 0) + 1
    assert {r.similarity: r.n for r in texts.counts().groupBy("similarity").agg({"n": "sum"}).toDF("similarity", "n").collect()} == counts


def test_repeated_and_other_ids_are_told(spark, docs):
    assert B.Texts(docs, 3).apart and not B.Texts(docs.union(docs.limit(1)), 3).apart
    assert not B.Texts(docs.selectExpr("cast(doc_id as string) as doc_id", "text"), 3).apart
    nothing = B.Texts(docs.limit(0), 3)
    assert nothing.slices().count() == nothing.counts().count() == nothing.shared().count() == 0


def test_packed_columns():
    columns = [np.array([5, -3, 2**63 - 1, -(2**63), 0]), np.arange(1000), np.frombuffer(b"text", np.uint8), np.zeros(0, np.int64)]
    assert all((a == b).all() and len(a) == len(b) for a, b in zip(B.unpacked(B.packed(*columns)), columns))


def test_runs_cost_less_than_grams():
    texts = ["".join(chr(97 + c) for c in np.random.default_rng(i // 2).integers(0, 26, 5000)) for i in range(40)]
    parts = list(B.stretches(np.arange(40), texts, np.ones(40, np.int64), 25, 4))
    assert sum(len(p) for _, p in parts) < 4 * 40 * 5000
    found = [r for b in range(4) for r in B.shared_runs([p for c, p in parts if c == b], 25, 2)]
    assert sum(len(p) for _, p in found) < 40 * 5000


#: Queries over all pairs: no row for each gram and none for each pair is dealt out.
FLAGGED = ["top_match_per_doc", "pair_similarity", "flagged_summary", "highlight_report", "flagged_pairs_dedup", "same_name_pairs", "ignore_leaf_pairs"]
WHOLE = ["highlight_pct", "pair_slices", "shared_hash_counts", "conversation_similarity", "similarity_histogram"]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", WHOLE)
def test_no_gram_and_no_pair_is_shuffled(spark, name):
    plan = entry.queries()[name](spark, DATA)._jdf.queryExecution().optimizedPlan().toString() + (physical := entry.queries()[name](spark, DATA)._jdf.queryExecution().executedPlan().toString())
    keys = re.findall(r"Exchange hashpartitioning\(([^)]*)", physical)
    assert keys and not [k for k in keys if re.search(r"\b(x|y|h|posting)#", k)], plan


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", FLAGGED)
def test_no_gram_is_shuffled_for_flagged_pairs(spark, name):
    plan = entry.queries()[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"Exchange hashpartitioning\(([^)]*\b)?(h|posting)#", plan), plan
