import pytest

from windrow.streaming.ingest import watch


def test_new_documents_meet_the_index(spark, tmp_path):
    text = "the quick brown fox jumps over the lazy dog again and again"
    source, paths = tmp_path / "in", [str(tmp_path / x) for x in ("index", "matches", "state")]
    for number, rows in enumerate(([(1, text), (2, "nothing of the kind is here at all, really")], [(3, text + "!")])):
        spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema("doc_id long, text string").parquet(str(source))
        watch(stream, *paths, k=10).awaitTermination(120)
    found = {(r.x, r.y) for r in spark.read.parquet(paths[1]).collect()}
    assert found == {(3, 1)}
    assert spark.read.parquet(paths[0]).select("doc_id").distinct().count() == 3
    spark.createDataFrame([(4, text)], "doc_id long, text string").write.mode("append").parquet(str(source))
    with pytest.raises(Exception, match="another k or window"):
        watch(spark.readStream.schema("doc_id long, text string").parquet(str(source)), *paths, k=11).awaitTermination(120)


def test_sql_functions(spark):
    from windrow.plans.sql_functions import register

    register(spark)
    assert len(spark.sql("select kgram_hashes('hello', 3) h").first().h) == 3
    assert spark.sql("select winnow(array(3L, 1L, 2L), 2) p").first().p == [0, 1]
    assert spark.sql("select * from fingerprints('hello', 3, 1)").count() == 3
