"""The whole run as lazy tables: files, documents, fingerprints, pairs, slices, matches, report."""

from __future__ import annotations

import logging
import os
import webbrowser
from functools import cached_property

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from windrow import __version__
from windrow.config import Config
from windrow.functions.hashing import fingerprint_rows
from windrow.functions.text import raw_position
from windrow.functions.tokens import filter_code
from windrow.operators import compare as C
from windrow.operators import report as R
from windrow.operators.fingerprint import boilerplate_hashes, coverage, fingerprint, without_boilerplate
from windrow.sources import files as S

log = logging.getLogger("windrow")
LEFT, RIGHT = '<span class="hit">', "</span>"


class Detector:
    """Copy detection over directories, or over documents given as a table.

    documents: path, name, leaf, text, is_test, is_ref, is_boilerplate (see windrow.sources.files).
    """

    def __init__(self, spark: SparkSession, config: Config | None = None, documents: DataFrame | None = None):
        self.spark, self.config, self._given = spark, config or Config(), documents
        self._added: list[tuple[str, str]] = []
        self.empty_roots: list[str] = []

    @classmethod
    def from_config(cls, spark: SparkSession, options: dict) -> Detector:
        return cls(spark, Config.from_dict(options))

    def add_file(self, path: str, role: str = "testref") -> None:
        """Adds one file before the run; role: testref, test, ref or boilerplate."""
        if role not in S.ROLES:
            raise ValueError(f"role must be one of {', '.join(S.ROLES)}")
        self._added.append((path, role))
        for name in [n for n in vars(type(self)) if n in self.__dict__]:
            del self.__dict__[name]

    @cached_property
    def files(self) -> DataFrame:
        c, found = self.config, []
        for roots in (c.test_dirs, c.ref_dirs, c.boilerplate_dirs):
            names, bare = S.list_files(roots, c.extensions)
            found.append(names)
            self.empty_roots += bare
        out = S.file_table(self.spark, *found)
        for path, role in self._added:
            out = S.add_file(out, path, role)
        return out

    @cached_property
    def _read(self) -> tuple[DataFrame, DataFrame]:
        if self._given is not None:
            return self._given, self._given.select("path", F.lit(None).cast("string").alias("problem")).limit(0)
        return S.read_files(self.files, self.config.encoding)

    @property
    def quarantine(self) -> DataFrame:
        """(path, problem) of files that are no text of the encoding; they are left out of the comparison."""
        return self._read[1]

    @cached_property
    def documents(self) -> DataFrame:
        """Documents with filtered text and offsets, read and tokenised once."""
        docs = self._read[0]
        if self.config.disable_filtering:
            docs = docs.select("*", F.col("text").alias("filtered"), F.array().cast("array<struct<pos:int,off:int>>").alias("offsets"), F.lit(None).cast("string").alias("language"))
        else:
            docs = filter_code(docs, language=self.config.force_language)
        return docs.withColumn("doc_id", F.col("path")).persist(StorageLevel.MEMORY_AND_DISK)

    @cached_property
    def fingerprints(self) -> DataFrame:
        c = self.config
        compared = self.documents.where("is_test or is_ref")
        rows = fingerprint(compared, c.noise_t, c.window_size, text_col="filtered")
        if self._given is not None or c.boilerplate_dirs or any(r == "boilerplate" for _, r in self._added):
            rows = without_boilerplate(rows, boilerplate_hashes(self.documents.where("is_boilerplate"), c.noise_t, text_col="filtered"))
        return rows.persist(StorageLevel.MEMORY_AND_DISK)

    @cached_property
    def _matched(self) -> DataFrame:
        return C.matched_segments(C.shared_segments(self.fingerprints))

    @property
    def coverage(self) -> DataFrame:
        return coverage(self.fingerprints, self.config.noise_t)

    @cached_property
    def pairs(self) -> DataFrame:
        """(test, ref, test_sim, ref_sim, token_overlap) of pairs that share a fingerprint."""
        c = self.config
        return C.pairwise(self.fingerprints, self.documents, c.noise_t, c.same_name_only, c.ignore_leaf)

    @property
    def slices(self) -> DataFrame:
        """(x, y, start, end) in filtered text: what of x is in y."""
        return C.slices(self._matched, self.config.noise_t)

    def dense_matrix(self) -> DataFrame:
        """The whole grid with -1 where not compared; for few documents."""
        c = self.config
        return C.dense_matrix(self.documents, self.pairs, c.same_name_only, c.ignore_leaf)

    @cached_property
    def matches(self) -> DataFrame:
        """Flagged pairs, most similar first, with both texts highlighted."""
        c = self.config
        hits = R.without_mirrors(R.flagged(self.pairs, c.display_t))
        nested = self.slices.groupBy("x", "y").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("slices"))
        raw = self.documents.select("doc_id", "text", "offsets")
        keep = 10 if c.truncate else -1

        def side(df: DataFrame, own: str, other: str, out: str) -> DataFrame:
            own_slices = nested.select(F.col("x").alias(own), F.col("y").alias(other), "slices")
            df = df.join(own_slices, [own, other], "left").join(raw.select(F.col("doc_id").alias(own), "text", "offsets"), own)
            moved = F.transform("slices", lambda s: F.struct(raw_position(F.col("offsets"), s["start"]).alias("start"), raw_position(F.col("offsets"), s["end"]).alias("end")))
            df = df.withColumn("slices", moved)
            return R.highlighted(df, "text", "slices", out, LEFT, RIGHT, keep).drop("slices", "text", "offsets")

        out = side(side(hits, "test", "ref", "test_code"), "ref", "test", "ref_code")
        return R.ordered(out).select("test_sim", "ref_sim", F.col("test").alias("test_file"), F.col("ref").alias("ref_file"), "test_code", "ref_code", "token_overlap")

    def run(self) -> Detector:
        """Computes pairs once; without documents it only logs so."""
        if self.documents.where("is_test").isEmpty() or self.documents.where("is_ref").isEmpty():
            log.error("No documents to compare")
        if not self.config.disable_filtering:
            unknown = self.documents.where("language is null")
            for r in unknown.select("path").orderBy("path").limit(20).collect():
                log.warning("No tokenizer for %s: its text is compared as it is", r.path)
        self.pairs = self.pairs.persist(StorageLevel.MEMORY_AND_DISK)
        if not self.config.silent:
            log.info("%d pairs share fingerprints", self.pairs.count())
        return self

    def copied_code_list(self) -> list[tuple]:
        """matches as plain tuples on the driver."""
        return [tuple(r) for r in self.matches.collect()]

    def report(self, output: str = "save") -> str:
        """The page as a string ("return"), or written to the report's file, whose path is returned ("save")."""
        if output not in ("save", "return"):
            raise ValueError("output must be save or return")
        c = self.config
        stats = R.summary(self.pairs, self.documents, c.display_t).first().asDict()
        bins = [(r.low, r.high, r.n) for r in R.histogram(self.pairs).orderBy("bin").collect()]
        cells = [(r.row, r.col, r.value) for r in R.heatmap(self.pairs, self.documents.where("is_test or is_ref")).collect()]
        files = {role: [r.path for r in self.documents.where(f"is_{role}").select("path").orderBy("path").collect()] for role in ("test", "ref", "boilerplate")}
        page = R.render([r.asDict() for r in self.matches.collect()], stats, bins, cells, files, c.to_dict(), c.css_files, __version__)
        if output == "return":
            return page
        with open(c.out_file, "w", encoding="utf-8") as f:
            f.write(page)
        log.info("Report written to %s", c.out_file)
        if c.autoopen:
            webbrowser.open(f"file://{os.path.abspath(c.out_file)}")
        return c.out_file


def compare(spark: SparkSession, one: str, two: str, k: int, window: int = 1) -> dict:
    """Overlap, similarities and slices of two texts; the pair case of the tables."""
    rows = fingerprint_rows(spark.createDataFrame([(1, one), (2, two)], "doc_id int, text string"), k, window)
    scores = {r.x: r for r in C.pair_scores(rows, k).collect()}
    cut = C.slices(C.matched_segments(C.shared_segments(rows)), k).orderBy("x", "start").collect()
    return {
        "overlap": scores[1].overlap if 1 in scores else 0,
        "similarity": tuple(scores[i].similarity if i in scores else 0.0 for i in (1, 2)),
        "slices": tuple([(r.start, r.end) for r in cut if r.x == i] for i in (1, 2)),
    }
