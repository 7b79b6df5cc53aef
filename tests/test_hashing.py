import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from windrow.functions.hashing import density, fingerprint_rows, kgram_hashes, kgram_hashes_sql, kgram_md5, winnow_positions, winnow_sql

VALUES = [5, 3, 4, 4, 1, 7, 7, 2, 6, 6, 6, 0]
KEPT = {1: list(range(12)), 2: [0, 1, 3, 4, 6, 7, 9, 11], 3: [0, 1, 4, 7, 10, 11], 25: [0, 1, 4, 11]}


def walk(hashes, window):
    """Robust winnowing word for word: the window slides, a new minimum is taken when the old one leaves or is beaten."""
    kept, at = [], None
    for right in range(len(hashes)):
        left = max(0, right - window + 1)
        if at is None or hashes[right] < hashes[at]:
            at = right
            kept.append(at)
        elif at < left:
            low = min(hashes[left : right + 1])
            at = max(i for i in range(left, right + 1) if hashes[i] == low)
            kept.append(at)
    return kept


@pytest.mark.parametrize("window", KEPT)
def test_known_selection(window):
    assert winnow_positions(np.array(VALUES), window).tolist() == KEPT[window]


def test_no_hashes_and_bad_window():
    assert winnow_positions(np.zeros(0, np.int64), 3).tolist() == []
    with pytest.raises(ValueError):
        winnow_positions(np.array([1]), 0)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(-3, 3), max_size=40), st.integers(2, 9))
def test_selection_follows_the_sliding_window(values, window):
    assert winnow_positions(np.array(values, np.int64), window).tolist() == walk(values, window)


@pytest.mark.parametrize("window", range(2, 20))
def test_density(window):
    kept = winnow_positions(np.random.default_rng(5).integers(-(2**62), 2**62, 10_000), window)
    assert abs(len(kept) - density(window) * 10_000) < 200


def test_sql_fold_selects_the_same(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [int(x) for x in rng.integers(-4, 4, n)]) for i, n in enumerate((0, 1, 5, 20, 33))] + [(9, VALUES)]
    for window in (1, 2, 3, 25):
        got = spark.createDataFrame(rows, "id int, h array<bigint>").select("id", winnow_sql(F.col("h"), window).alias("p")).collect()
        for r in got:
            assert r.p == winnow_positions(np.array(dict(rows)[r.id], np.int64), window).tolist()


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="ab é漢🎉\n", max_size=30), st.integers(1, 8))
def test_equal_grams_have_equal_hashes(text, k):
    grams = [text[i : i + k] for i in range(len(text) - k + 1)]
    hashes = kgram_hashes(text, k).tolist()
    assert len(hashes) == len(grams) == len(kgram_md5(text, k))
    assert len(set(hashes)) == len(set(grams))
    assert len(set(zip(grams, hashes))) == len(set(grams))


def test_built_in_form_counts_alike(spark):
    df = spark.createDataFrame([(1, "hello hello"), (2, "ab"), (3, ""), (4, None), (5, "漢🎉é漢🎉é")], "id int, text string")
    got = {r.id: r.h for r in df.select("id", kgram_hashes_sql(F.col("text"), 3).alias("h")).collect()}
    assert [len(got[i]) for i in (1, 2, 3, 4, 5)] == [9, 0, 0, 0, 4]
    assert len(set(got[5])) == 3


def test_rows_of_null_and_short_texts(spark):
    df = spark.createDataFrame([(1, None), (2, "ab"), (3, "abc")], "doc_id long, text string")
    assert [(r.doc_id, r.pos) for r in fingerprint_rows(df, 3, 1).collect()] == [(3, 0)]


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="abcd", min_size=9, max_size=12), st.text(alphabet="abcd", max_size=20), st.text(alphabet="abcd", max_size=20))
def test_shared_runs_are_found(run, before, after):
    k, window = 4, 6  # any shared run of k + window - 1 characters leaves a common hash
    one, two = before + run + after, after + run + before
    kept = [kgram_hashes(t, k)[winnow_positions(kgram_hashes(t, k), window)] for t in (one, two)]
    assert len(run) < k + window - 1 or set(kept[0]) & set(kept[1])
