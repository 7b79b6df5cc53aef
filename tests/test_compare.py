import pytest
from pyspark.sql import functions as F

from windrow.functions.hashing import fingerprint_rows
from windrow.operators import compare as C
from windrow.operators import fingerprint as P
from windrow.operators import report as R
from windrow.plans.detector import compare

ONE, TWO = "redgreenbluewhite", "bluexgreenred"


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")


def test_pair_of_short_texts(spark):
    got = compare(spark, ONE, TWO, 3)
    assert got["slices"] == ([(0, 3), (3, 8), (8, 12)], [(0, 4), (5, 10), (10, 13)])
    assert got["overlap"] == 12
    assert got["similarity"] == (12 / 17, 12 / 13)


def test_unrelated_and_empty_texts(spark):
    assert compare(spark, "abcdef", "uvwxyz", 3) == {"overlap": 0, "similarity": (0.0, 0.0), "slices": ([], [])}
    assert compare(spark, "", "", 3)["overlap"] == 0


def test_boilerplate(spark):
    rows = fingerprint_rows(docs(spark, ONE, TWO), 3, 1)
    bare = P.without_boilerplate(rows, P.boilerplate_hashes(docs(spark, "greet"), 3))
    kept = {(r.doc_id, r.pos) for r in bare.collect()}
    assert not kept & {(0, 3), (0, 4), (1, 5), (1, 6)} and {(0, 5), (1, 7)} <= kept


def test_compat_boilerplate_keeps_last_positions(spark):
    rows = spark.createDataFrame([(1, i, h) for i, h in enumerate([7, 5, 7, 9, 5, 5])], "doc_id int, pos int, h long")
    bp = spark.createDataFrame([(9,)], "h long")
    assert sorted(r.pos for r in P.without_boilerplate(rows, bp).collect()) == [0, 1, 2, 4, 5]
    assert sorted(r.pos for r in P.without_boilerplate(rows, bp, compat=True).collect()) == [2, 5]


@pytest.mark.parametrize(("positions", "k", "expected"), [([0, 5], 5, 10), ([0, 5], 3, 6), ([0, 5], 1, 2), (range(8), 3, 10)])
def test_coverage(spark, positions, k, expected):
    rows = spark.createDataFrame([(1, p, p) for p in positions], "doc_id int, pos int, h long")
    assert P.coverage(rows, k).first().coverage == expected


def brute(texts, k):
    out = {}
    for x, a in enumerate(texts):
        for y, b in enumerate(texts):
            theirs = {b[i : i + k] for i in range(len(b) - k + 1)}
            at = [i for i in range(len(a) - k + 1) if a[i : i + k] in theirs]
            if x != y and at:
                cover = lambda ps: len({q for p in ps for q in range(p, p + k)})
                out[x, y] = (cover(at), cover(at) / cover(range(len(a) - k + 1)))
    return out


def test_scores_equal_brute_force(spark):
    texts = [ONE, TWO, ONE, "xx" + TWO[3:15] + "yy" + ONE[2:12], "abcabcabcabc", "bcabca", "", "zz", ONE + TWO + ONE]
    got = {(r.x, r.y): (r.overlap, r.similarity) for r in C.pair_scores(fingerprint_rows(docs(spark, *texts), 3, 1), 3).collect()}
    assert got == brute(texts, 3)
    shared = {(r.x, r.y): r.shared for r in C.shared_hashes(fingerprint_rows(docs(spark, *texts), 3, 1)).collect()}
    grams = [{t[i : i + 3] for i in range(len(t) - 2)} for t in texts]
    assert shared == {(x, y): len(grams[x] & grams[y]) for x in range(len(texts)) for y in range(x + 1, len(texts)) if grams[x] & grams[y]}


def about(spark, rows):
    return spark.createDataFrame(rows, "doc_id int, name string, leaf string, is_test boolean, is_ref boolean")


def test_pair_options(spark):
    rows = fingerprint_rows(docs(spark, ONE, TWO, ONE, "nothing alike"), 3, 1)
    who = about(spark, [(0, "a", "l1", True, True), (1, "a", "l2", True, True), (2, "b", "l1", True, True), (3, "a", "l1", True, True)])
    ids = lambda df: {(r.test, r.ref) for r in df.collect()}
    assert ids(C.pairwise(rows, who, 3)) == {(0, 1), (1, 0), (0, 2), (2, 0), (1, 2), (2, 1)}
    assert ids(C.pairwise(rows, who, 3, same_name_only=True)) == {(0, 1), (1, 0)}
    assert ids(C.pairwise(rows, who, 3, ignore_leaf=True)) == {(0, 1), (1, 0), (1, 2), (2, 1)}
    unnamed = about(spark, [(0, None, "l1", True, True), (1, None, "l2", True, True), (2, "b", "l1", True, True)])
    assert ids(C.pairwise(rows, unnamed, 3, same_name_only=True)) == set()
    grid = {(r.test, r.ref): (r.test_sim, r.token_overlap) for r in C.dense_matrix(who, C.pairwise(rows, who, 3, ignore_leaf=True), ignore_leaf=True).collect()}
    assert len(grid) == 16 and grid[0, 0] == (-1, -1) and grid[0, 2] == (-1, -1) and grid[1, 3] == (0, 0) and grid[0, 1][1] == 12


def test_mirrored_overlap_comes_from_the_first_document(spark):
    texts = ["abcabcabc", "xabcx"]
    rows = fingerprint_rows(docs(spark, *texts), 3, 1)
    who = about(spark, [(i, "a", "l", True, True) for i in range(2)])
    got = {(r.test, r.ref): r.token_overlap for r in C.pairwise(rows, who, 3).collect()}
    assert got == {(0, 1): 9, (1, 0): 9}


def pairs(spark, rows):
    return spark.createDataFrame(rows, "test int, ref int, test_sim double, ref_sim double, token_overlap long")


def test_report_rows(spark):
    df = pairs(spark, [(0, 1, 0.5, 0.9, 5), (1, 0, 0.9, 0.5, 5), (0, 2, 0.33, 0.1, 1), (2, 3, 0.4, 0.2, 1)])
    hits = R.flagged(df, 0.33)
    assert [(r.test, r.ref) for r in R.ordered(R.without_mirrors(hits)).collect()] == [(0, 1), (2, 3)]
    who = about(spark, [(i, "a", "l", True, i < 2) for i in range(4)])
    s = R.summary(df, who, 0.33).first()
    assert (s.tests, s.refs, s.flagged, s.flagged_percent) == (4, 2, 3, 75.0)
    assert [(r.test, r.ref) for r in R.top_matches(df).orderBy("test").collect()] == [(0, 1), (1, 0), (2, 3)]
    assert {(r.row, r.col): r.value for r in R.heatmap(df, who).collect()} == {(0, 1): 0.5, (1, 0): 0.9, (0, 2): 0.33, (2, 3): 0.4}
    one = R.heatmap(df, who, cells=1).collect()
    assert [(r.row, r.col) for r in one] == [(0, 0)] and one[0].value == pytest.approx((0.5 + 0.9 + 0.33 + 0.4) / 4)
    assert R.heatmap(df.limit(0), who.limit(0)).count() == 0


def test_histogram_matches_numpy(spark):
    import numpy as np

    values = [0.0, 0.04, 0.05, 0.5, 0.51, 0.99, 1.0, 1.0]
    df = pairs(spark, [(i, 0, v, v, 1) for i, v in enumerate(values)] + [(99, 0, -1.0, -1.0, -1)])
    got = R.histogram(df).orderBy("bin").collect()
    assert [r.n for r in got] == np.histogram(values, 20)[0].tolist()
    one = R.histogram(pairs(spark, [(0, 0, 0.7, 0.7, 1)])).orderBy("bin").collect()
    assert (one[0].low, one[-1].high) == (pytest.approx(0.2), pytest.approx(1.2)) and sum(r.n for r in one) == 1
    assert R.histogram(pairs(spark, [])).count() == 0


def test_highlight():
    assert R.highlight(ONE, [(0, 3), (3, 8), (8, 12)], "->", "<") == ("->red<->green<->blue<white", 12 / 17)
    assert R.highlight(TWO, [(0, 4), (5, 10), (10, 13)], "->", "<")[0] == "->blue<x->green<->red<"
    assert R.highlight("<a>", [], "[", "]", escape=True) == ("&lt;a&gt;", 0.0)
    assert R.highlight('"<\'&', [(1, 2)], "[", "]", escape=True)[0] == "&#34;[&lt;]&#39;&amp;"
    lines = "\n".join(f"line {i}" for i in range(60))
    cut = R.highlight(lines, [(0, 4), (400, 410)], "[", "]", truncate=3)[0]
    assert "..." in cut and len(cut) < 200
    assert R.highlight("", [], "[", "]") == ("", 0.0)


def test_percent_and_paths(spark):
    from windrow.functions.text import html_escape, path_name, path_parent, percent

    r = spark.range(1).select(
        percent(F.lit(0.8284)).alias("p"), path_name(F.lit("/a/b/c.py")).alias("n"), path_parent(F.lit("/a/b/c.py")).alias("d"), html_escape(F.lit("<'\"&>")).alias("e")).first()
    assert (r.p, r.n, r.d, r.e) == ("82.84", "c.py", "/a/b", "&lt;&#39;&#34;&amp;&gt;")


def test_truncated_context_keeps_head_and_tail():
    five = "\n".join(f"L{i}" for i in range(5))
    assert R._gap(five, False, 2) == "L0\nL1\nL2\n\n...\n\nL2\nL3\nL4"
    four = "\n".join(f"L{i}" for i in range(4))
    assert R._gap(four, True, 1) == "L2\nL3" and R._gap("one line", False, 2) == "one line"


def test_grams_of_a_document_are_counted_where_it_is_read(spark):
    rows = [(1, "abcabcabc"), (1, "xxabcx"), (None, "zzzzz"), (None, "azzz"), (2, "abcdabcd"), (3, "ab"), (4, None)]
    df = spark.createDataFrame(rows, "doc_id int, text string")
    want = {}
    for i, text in rows:
        for p in range(len(text or "") - 2):
            want.setdefault((i, text[p : p + 3]), []).append(p)
    found = {(r.doc_id, r.n, r.first_pos, r.last_pos): 0 for r in P.gram_positions(df, 3).collect()}
    assert set(found) == {(i, len(p), min(p), max(p)) for (i, _), p in want.items()}
    assert P.gram_positions(df, 3, broadcast_rows=0).count() == len(want)
    single = df.where("doc_id > 1")
    bp = P.boilerplate_hashes(docs(spark, "abc"), 3)
    for made in (P.gram_positions(single, 3), P.fingerprint(single, 3, remove_duplicates=True)):
        assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()
    assert sorted(r.pos for r in P.fingerprint(single, 3, boilerplate=bp, compat_boilerplate=True).collect()) == [2, 3, 5]
    assert sorted(r.pos for r in P.fingerprint(single, 3, remove_duplicates=True).collect()) == [0, 1, 2, 3]


def test_coverage_shuffles_runs(spark):
    rows = fingerprint_rows(docs(spark, "abcdefgh" * 50, ONE), 3, 1)
    assert P.runs(rows).count() == 2
    mixed = spark.createDataFrame([(1, 5), (1, 0), (1, 1), (1, 5), (None, 3), (None, 9), (1, 4), (1, 30)], "doc_id int, pos int")
    assert {(r.doc_id, r.coverage) for r in P.coverage(mixed, 3).collect()} == {(1, 4 + 4 + 3), (None, 6)}


def test_pairs_above_a_threshold(spark):
    line = "this line is in all of them."
    texts = [line + f"{i:03d}" * 40 for i in range(40)] + [line, line + "x", "y" + line] + [f"{i:03d}" * 30 for i in range(5)] + ["", "no"]
    rows = fingerprint_rows(docs(spark, *texts), 3, 1)
    want = {p: s for p, s in brute(texts, 3).items() if s[1] > 0.33}
    got = {(r.x, r.y): (r.overlap, r.similarity) for r in C.pair_scores(rows, 3, above=0.33).collect()}
    assert want.items() <= got.items() and want
    who = about(spark, [(i, "ab"[i % 2], "l", True, True) for i in range(len(texts))])
    for options in ({}, {"same_name_only": True}):
        fast, slow = ({tuple(r) for r in R.flagged(C.pairwise(rows, who, 3, above=t, **options), 0.33).collect()} for t in (0.33, None))
        assert fast == slow and fast
    top = [{tuple(r) for r in R.top_matches(C.pairwise(rows, who, 3, best=b)).select("test", "ref", "test_sim").collect()} for b in (True, False)]
    assert top[0] == top[1] and len(top[0]) > 40
    meet = C.matched_above(C.shared_segments(rows), P.coverage(rows, 3), 3, 0.33).select("x", "y").distinct()
    assert meet.where("x < 40 and y < 40").count() < 100 < 40 * 39


@pytest.mark.parametrize("limit", [1_000, 0])
def test_scores_against_others(spark, limit):
    texts = [ONE, TWO, ONE, "nothing", "", ONE + TWO]
    rows = fingerprint_rows(docs(spark, *texts), 3, 1)
    got = C.scores_against(rows.where("doc_id < 3"), rows.where("doc_id >= 3"), 3, limit)
    assert {(r.x, r.y): (r.overlap, r.similarity) for r in got.collect()} == {(x, y): s for (x, y), s in brute(texts, 3).items() if x < 3 <= y}
