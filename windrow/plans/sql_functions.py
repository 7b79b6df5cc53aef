"""Functions for SQL text: kgram_hashes(text, k), winnow(hashes, w), and the table function fingerprints(text, k, w)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from windrow.functions.hashing import kgram_hashes, winnow_positions


def register(spark: SparkSession) -> None:
    import numpy as np

    @F.pandas_udf("array<bigint>")
    def hashes(text: pd.Series, k: pd.Series) -> pd.Series:
        return pd.Series([kgram_hashes(t or "", int(n)).tolist() for t, n in zip(text, k)])

    @F.pandas_udf("array<int>")
    def winnow(values: pd.Series, window: pd.Series) -> pd.Series:
        return pd.Series([winnow_positions(np.array(v if v is not None else [], np.int64), int(w)).tolist() for v, w in zip(values, window)])

    class Fingerprints:
        def eval(self, text: str, k: int, w: int):
            found = kgram_hashes(text or "", k)
            for p in winnow_positions(found, w):
                yield int(p), int(found[p])

    spark.udf.register("kgram_hashes", hashes)
    spark.udf.register("winnow", winnow)
    spark.udtf.register("fingerprints", F.udtf(Fingerprints, returnType="pos int, h bigint"))
