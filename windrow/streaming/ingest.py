"""Continuous checking of new documents against a stored fingerprint index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from windrow.functions.hashing import fingerprint_rows
from windrow.operators.compare import pair_scores


def watch(stream: DataFrame, index_path: str, matches_path: str, checkpoint: str, k: int = 25, window: int = 1, threshold: float = 0.33) -> StreamingQuery:
    """stream: (doc_id, text). Each batch is compared with the index and itself, then joins the index.

    Index and matches are partitioned by batch, and a repeated batch overwrites its own partition only. The index holds the k
    and the window it was made with; hashes of others can't be compared, so a batch with other ones fails.
    """

    def handle(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(index_path)
        known = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
        fresh = fingerprint_rows(batch, k, window)
        ids = batch.select(F.col("doc_id").alias("x"))
        if known:
            schema = f"doc_id {batch.schema['doc_id'].dataType.simpleString()}, pos int, h long, k int, window int, batch long"
            old = spark.read.schema(schema).parquet(index_path).where(F.col("batch") < number)
            if not old.where(~(F.col("k").eqNullSafe(k) & F.col("window").eqNullSafe(window))).isEmpty():
                raise ValueError(f"the index at {index_path} was made with another k or window than {k} and {window}")
            old = old.select("doc_id", "pos", "h")
            # Only indexed documents that share a hash with the batch can match it.
            near = old.join(fresh.select("h").distinct(), "h", "left_semi").select("doc_id").distinct()
            fresh_and_near = fresh.unionByName(old.join(near, "doc_id", "left_semi"))
        else:
            fresh_and_near = fresh
        found = pair_scores(fresh_and_near, k).join(ids, "x", "left_semi").where(F.col("similarity") > threshold)
        save = lambda df, to: df.withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(to)
        save(found, matches_path)
        save(fresh.withColumns({"k": F.lit(k), "window": F.lit(window)}), index_path)

    return stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
