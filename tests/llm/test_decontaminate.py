import itertools
import random
import re
import unicodedata

import pytest

from windrow.llm import decontaminate as D

VOCABULARY = [f"{a}{b}" for a in "bcdfghklmnprst" for b in ("a", "e", "io", "um", "an")]


def text(rng, n):
    return [rng.choice(VOCABULARY) for _ in range(n)]


def brute(docs, items, similarity=0.8):
    """(doc, item) to the most words in place over all alignments, where they are enough."""
    out = {}
    for d, words in docs:
        for i, item in items:
            best = max((sum(words[p + k] == w for k, w in enumerate(item) if 0 <= p + k < len(words)) for p in range(-len(item), len(words) + 1)), default=0) if item else 0
            if item and best >= similarity * len(item):
                out[d, i] = max(best, out.get((d, i), 0))
    return out


def cased(text):
    return re.findall(r"[a-z]+", (text or "").lower())


@pytest.fixture(scope="module")
def found(spark):
    rng = random.Random(6)
    items = [(i, text(rng, n)) for i, n in enumerate([5, 7, 12, 16, 20, 40, 60, 200, 3, 1, 2, 4])]
    docs = []
    for k, (_, words) in enumerate(items):
        before, after = text(rng, 80), text(rng, 30)
        docs.append((10 * k, before + words + after))
        docs.append((10 * k + 1, before + [w if p % 7 != 3 else "zzz" for p, w in enumerate(words)] + after))
        docs.append((10 * k + 2, before + [w if p % 2 else "zzz" for p, w in enumerate(words)] + after))
        docs.append((10 * k + 3, words[len(words) // 6 :] + after))
        docs.append((10 * k + 4, before + words[: len(words) - len(words) // 6]))
    rows = [(i, " ".join(w), "e") for i, w in docs] + [(900, None, "e"), (901, "", "e"), (0, " ".join(docs[0][1]), "e"), (None, " ".join(items[5][1]).upper().replace(" ", ", "), "e"), (902, "ba " * 100_000, "e")]
    df = spark.createDataFrame(rows, "doc_id long, text string, words string")
    bench = spark.createDataFrame([(i, " ".join(w), 1) for i, w in items] + [(50, None, 1), (51, "", 1)], "item_id long, text string, seed int")
    return df, bench, D.find_contamination(df, bench).collect(), brute([(r[0], cased(r[1])) for r in rows if r[0] != 902], items)


def test_items_are_found_as_by_brute_force(found):
    _, _, got, want = found
    pairs = {(r.doc_id, r.item_id): r.matched_words for r in got if r.doc_id != 902}
    assert pairs == want and pairs[None, 5] == 40 and pairs[70, 7] == 200 and pairs[80, 8] == 3
    assert len(got) == len({(r.doc_id, r.item_id) for r in got})


def test_query_over_whole_tables_as_by_brute_force(spark):
    docs, items = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet").collect() for t in ("documents", "benchmark"))

    def words(x):
        return re.findall(r"[^\W_]+", unicodedata.normalize("NFC", (x or "").casefold()))

    pages, known = [(r.doc_id, words(r.text)) for r in docs], [(r.item_id, words(r.text)) for r in items]
    near = []  # alignments that share no two neighbouring words cannot reach four fifths
    for d, page in pages:
        pairs = set(zip(page, page[1:]))
        near += [(d, page, i, item) for i, item in known if sum(p in pairs for p in zip(item, item[1:])) > len(item) // 4]
    want = {}
    for d, page, i, item in near:
        want |= brute([(d, page)], [(i, item)])
    got = {(r.doc_id, r.item_id): r.matched_words for r in D.op6_spaced_seed_decontamination(spark, "/root/testdata/sf0.001").collect()}
    assert got == want and got


def test_ids_of_any_type_and_clashing_columns(spark, tmp_path):
    item = " ".join(text(random.Random(4), 30))
    docs = spark.createDataFrame([("a", f"so {item}", 1, 2), ("b", "clean words here", 1, 2)], "doc_id string, text string, bad_text int, seed int")
    bench = spark.createDataFrame([("i-1", item)], "item_id string, text string")
    assert [tuple(r) for r in D.find_contamination(docs, bench).collect()] == [("a", "i-1", 30, 30)]
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = D.decontamination_stage(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns and [r.doc_id for r in kept.collect()] == ["b"]


def test_empty_tables(spark, found):
    df, bench, _, _ = found
    assert D.find_contamination(df.limit(0), bench).count() == 0
    assert D.find_contamination(df, bench.limit(0)).count() == 0


def test_stage_drops_what_is_found(spark, found, tmp_path):
    df, bench, got, _ = found
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    bad = {r.doc_id for r in got}
    for limit in (100_000, 0):
        kept = D.decontamination_stage(spark, df, str(tmp_path), broadcast_rows=limit)
        assert kept.columns == df.columns
        assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in df.collect() if r.doc_id not in bad)


@pytest.mark.parametrize("change", [str, str.upper, str.title, lambda x: unicodedata.normalize("NFD", x), lambda x: unicodedata.normalize("NFD", x.upper())])
def test_case_and_composition_do_not_matter(spark, change):
    item = "été à la forêt où naît déjà l'élève zélé près du château brûlé straße größe öl übung ähre"
    bench = spark.createDataFrame([(1, item), (2, change(item))], "item_id long, text string")
    docs = spark.createDataFrame([(1, f"voilà {change(item)} fin"), (2, f"voilà {item} fin")], "doc_id long, text string")
    assert {(r.doc_id, r.item_id, r.matched_words == r.item_words) for r in D.find_contamination(docs, bench).collect()} == {(d, i, True) for d in (1, 2) for i in (1, 2)}


@pytest.mark.parametrize("n", range(1, 25))
def test_masks_hit_every_placement_of_a_fifth_replaced(n):
    shapes = [int(mask[::-1], 2) << at for mask in D.masks_for(n) for at in range(n - len(mask) + 1)]
    assert all(any(not shape & gone for shape in shapes) for gone in (sum(1 << p for p in c) for c in itertools.combinations(range(n), n // 5)))


def test_every_placement_of_a_fifth_is_found(spark):
    rng = random.Random(8)
    items = [(n, text(rng, n)) for n in (10, 16)]
    docs = [(n, " ".join("zzz" if p in c else w for p, w in enumerate(words))) for n, words in items for c in itertools.combinations(range(n), n // 5)]
    df = spark.createDataFrame([(k, t) for k, (_, t) in enumerate(docs)], "doc_id long, text string")
    bench = spark.createDataFrame([(n, " ".join(words)) for n, words in items], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in D.find_contamination(df, bench).collect()} >= {(k, n) for k, (n, _) in enumerate(docs)}


def test_long_items_are_judged_whole(spark):
    rng = random.Random(9)
    one, two = text(rng, 400), text(rng, 1200)
    docs = [
        (0, text(rng, 50) + one[:180] + ["zzz"] * 70 + one[250:] + text(rng, 50)),  # 330 of 400 words
        (1, text(rng, 50) + one[:180] + ["zzz"] * 90 + one[270:]),  # 310
        (2, text(rng, 300) + two[300:900] + text(rng, 300)),  # a half
        (3, two[240:] + text(rng, 30)),  # four fifths
    ]
    df = spark.createDataFrame([(k, " ".join(w)) for k, w in docs], "doc_id long, text string")
    bench = spark.createDataFrame([(1, " ".join(one)), (2, " ".join(two))], "item_id long, text string")
    assert {(r.doc_id, r.item_id): (r.matched_words, r.item_words) for r in D.find_contamination(df, bench).collect()} == {(0, 1): (330, 400), (3, 2): (960, 1200)}


def test_stage_decides_by_row(spark, tmp_path):
    rng = random.Random(10)
    item, clean, other = (" ".join(text(rng, 30)) for _ in range(3))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    df = spark.createDataFrame([(None, item), (None, clean), (7, f"so {item}"), (7, other), (None, None)], "doc_id long, text string")
    for limit in (100_000, 0):
        got = D.decontamination_stage(spark, df, str(tmp_path), broadcast_rows=limit).collect()
        assert sorted(map(str, map(tuple, got))) == sorted(map(str, [(None, clean), (7, other), (None, None)]))
