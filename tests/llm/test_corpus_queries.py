"""The registered queries over the smallest tables: against SQL where there is some, else against plain Python."""

import os
import zlib

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from windrow.llm import registry

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
        path = f"{DATA}/{t}.parquet"
        con.execute(f"create view {t} as select * from read_parquet('{path}{'/*' if os.path.isdir(path) else ''}')")
    return con


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    got = registry.QUERIES[name](spark, DATA)
    order = sorted(got.columns)
    want = duck.execute(registry.ORACLE_SQL[name])
    names = [c[0] for c in want.description]
    told = lambda rows: sorted([str(v) for v in r] for r in rows)
    assert sorted(names) == order
    assert told([r[c] for c in order] for r in got.collect()) == told([dict(zip(names, r))[c] for c in order] for r in want.fetchall())


def test_ten_operators_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in registry.QUERIES) == list(range(1, 11))
    assert {*registry.QUERIES, "pipeline"} <= set(entry.queries())


@pytest.mark.parametrize(("name", "folds", "held"), [("op2_toxicity_ftrl", 5, 0), ("op9_quality_qda", 3, 1)])
def test_scores(spark, name, folds, held):
    rows = registry.QUERIES[name](spark, DATA).collect()
    assert len(rows) == 200
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % folds == held)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)


def test_pipeline_stages_agree_with_their_operators(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    from windrow.llm import common, decontaminate, jaccard_join, pii

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "pii", "packing"]
    stages = dict(corpus_pipeline.STAGES)
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    scores = {r.doc_id: r.predicted for r in registry.QUERIES["op9_quality_qda"](spark, DATA).collect()}
    kept = stages["quality"](spark, docs, DATA)
    assert kept.columns == docs.columns and ids(kept) == sorted(i for i, p in scores.items() if p)
    classes = jaccard_join.similarity_classes(kept.select("doc_id", "text")).collect()
    single = stages["near_duplicates"](spark, kept, DATA)
    assert ids(single) == sorted({r.component_id for r in classes})
    bad = {r.doc_id for r in decontaminate.find_contamination(single, spark.read.parquet(f"{DATA}/benchmark.parquet")).collect()}
    clean = stages["decontamination"](spark, single, DATA)
    assert ids(clean) == [i for i in ids(single) if i not in bad]
    masked = common.stored(stages["pii"](spark, clean, DATA), "masked")
    assert masked.columns == docs.columns and ids(masked) == ids(clean)
    assert pii.find_pii(masked).where("size(pii) > 0").count() == 0
    assert masked.where("n_chars <> char_length(text)").count() == 0
    packed = stages["packing"](spark, masked, DATA)
    assert sorted({r.doc_id for r in packed.collect()}) == ids(masked)
    whole = corpus_pipeline.run(spark, DATA)
    assert sorted(map(tuple, whole.select("doc_id", "piece", "ids_crc32").collect())) == sorted(map(tuple, packed.select("doc_id", "piece", "ids_crc32").collect()))
