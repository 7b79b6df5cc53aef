"""Near-duplicate embeddings by collision counting over one-dimensional random projections.

Only vectors with the same label and number of dimensions are compared. Unit vectors are projected on `projections`
random directions. Two vectors at the cosine threshold are a known distance apart, so the spread of their projected
difference is known: windows of `width` of its standard deviations around a query make them collide in one projection
with a known probability, and the binomial law gives the number of collisions that links reach with probability
`recall`. Pairs that reach it are verified by their cosine in double precision.

Work is laid out in joint cells: a table cuts the vectors of a label by the signs of several further random projections, so
that a cell holds about `cell` vectors however many the label has, and two vectors share a cell with a probability that only
their angle sets. As many tables are made as give pairs at the threshold `recall` of meeting in one; closer pairs meet
surer. Only vectors of a cell are compared: every one of the `projections` is sorted, windows are found by binary search,
and collisions of the cell's pairs are counted by prefix sums over the sorted order. A cell that is still large (vectors
alike) is cut by hash into blocks, compared two by two. A pair is taken in the first table in which it meets. A group
returns link counts and enough links to join what is linked, not all pairs. So work grows with the size of a label to
the power 1.2 or so, not with its square. Labels of at most `cell` vectors are one cell: nothing there depends on tables. Below 16
dimensions, where projections are far from normal, the windows hold every link for certain and the count is that of all
projections.

Equal vectors (same label, same bytes) are one node with a multiplicity. Null labels, and vectors that are null, empty,
zero or have null or non-finite components link with nothing: they get no links and are their own component. Repeated
vec_ids get a row each.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from windrow.llm.common import components, drop_stored, read, stored, trimmed

@dataclass(frozen=True)
class CollisionParams:
    cosine: float = 0.93
    projections: int = 24
    width: float = 2.3
    recall: float = 0.9995
    cell: int = 256
    block: int = 512
    seed: int = 11

    def tables(self, cuts: int) -> int:
        """Tables of so many signs that a pair at the threshold shares a cell of one with probability `recall`."""
        same = (1 - math.acos(self.cosine) / math.pi) ** cuts
        return 1 if same == 1 else math.ceil(math.log(1 - self.recall) / math.log(1 - same))

    def cells(self, unit: np.ndarray, cuts: int) -> np.ndarray:
        """The cell of each unit vector (rows) in every table (columns)."""
        out = np.zeros((len(unit), self.tables(cuts)), np.int64)
        for t in range(out.shape[1] if cuts else 0):
            plane = np.random.default_rng([self.seed, unit.shape[1], cuts, t]).standard_normal((unit.shape[1], cuts))
            out[:, t] = (unit @ plane > 0) @ (1 << np.arange(cuts))
        return out

    def windows(self, dims: int) -> tuple[float, int]:
        """Half-width of the windows, and the least number of collisions."""
        apart = math.sqrt(2 - 2 * self.cosine)
        if dims < 16:  # the normal law is no good; by Cauchy-Schwarz this window holds every link
            return apart + 1e-6, self.projections
        step = apart / math.sqrt(dims)
        p = math.erf(self.width / math.sqrt(2))
        tail, least = 0.0, self.projections
        while least > 0:
            tail += math.comb(self.projections, least) * p**least * (1 - p) ** (self.projections - least)
            if tail >= 1 - (1 - self.recall) / 5:
                break
            least -= 1
        return self.width * step, least

    def directions(self, dims: int) -> np.ndarray:
        rows = np.random.default_rng([self.seed, dims]).standard_normal((self.projections, dims))
        return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def vector_nodes(vectors: DataFrame) -> DataFrame:
    """(vec_id, node, side, label, dims, embedding); node is null for vectors that link with nothing."""
    kind, of = vectors.schema["vec_id"].dataType.simpleString(), vectors.schema["embedding"].dataType.simpleString()
    of = of if of == "array<float>" else "array<double>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, sizes = [], []
            for label, vector in zip(batch.column(1).to_pylist(), batch.column(2)):
                node = None
                values = vector.values if vector.is_valid else None
                if label is not None and values is not None and len(values) and not values.null_count:
                    x = values.to_numpy()
                    with np.errstate(over="ignore"):
                        square = float((x.astype(np.float64) ** 2).sum())
                    if math.isfinite(square) and square > 0:
                        node = xxhash.xxh64_intdigest(x.tobytes(), xxhash.xxh64_intdigest(str(label)) ^ len(x)) - (1 << 63)
                nodes.append(node)
                sizes.append(len(values) if values is not None else 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(nodes, pa.int64()), batch.column(1), pa.array(sizes, pa.int32()), batch.column(2)], ["vec_id", "node", "label", "dims", "embedding"])

    wide = vectors.select("vec_id", F.col("label").cast("string").alias("label"), F.col("embedding").cast(of).alias("embedding"))
    return wide.mapInArrow(trimmed(run), f"vec_id {kind}, node long, label string, dims int, embedding {of}")


def unit_rows(vectors: np.ndarray) -> np.ndarray:
    """Rows of length one, in double precision whatever their scale."""
    x = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def placed(nodes: DataFrame, p: CollisionParams) -> DataFrame:
    """nodes (with their label's `cuts`) and `spots`: each table with the cell in it."""
    of = nodes.schema["embedding"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, cuts = (batch.column(c).to_numpy() for c in ("dims", "cuts"))
            for d, c in sorted(set(zip(dims.tolist(), cuts.tolist()))):
                rows = np.flatnonzero((dims == d) & (cuts == c))
                part = batch.take(pa.array(rows))
                cells = p.cells(unit_rows(part.column("embedding").flatten().to_numpy().reshape(-1, d).astype(np.float64)), c)
                spots = (np.arange(cells.shape[1]) << 40) + cells
                yield pa.RecordBatch.from_arrays([*part.columns, pa.FixedSizeListArray.from_arrays(pa.array(spots.ravel()), cells.shape[1]).cast(pa.list_(pa.int64()))], [*batch.schema.names, "spots"])

    return nodes.mapInArrow(trimmed(run), f"node long, label string, dims int, embedding {of}, copies long, cuts int, spots array<long>")


def compare_blocks(p: CollisionParams):
    def compare(table: pa.Table) -> pa.Table:
        low, high, dims, cuts, spot = (table.column(c)[0].as_py() for c in ("low", "high", "dims", "cuts", "spot"))
        block, node, copies = (table.column(c).to_numpy() for c in ("block", "node", "copies"))
        x = unit_rows(table.column("embedding").combine_chunks().flatten().to_numpy().reshape(len(node), dims).astype(np.float64))
        at = x @ p.directions(dims).T
        one, two = np.flatnonzero(block == low), np.flatnonzero(block == high)
        width, least = p.windows(dims)
        counts = np.zeros((len(one), len(two)), np.int16)
        for j in range(p.projections):
            order = np.argsort(at[two, j])
            line = at[two[order], j]
            begin, end = np.searchsorted(line, at[one, j] - width, "left"), np.searchsorted(line, at[one, j] + width, "right")
            marks = np.zeros((len(one), len(two) + 1), np.int16)
            rows = np.arange(len(one))
            marks[rows, begin] += 1
            marks[rows, end] -= 1
            rank = np.empty(len(two), np.int64)
            rank[order] = np.arange(len(two))
            counts += np.cumsum(marks, axis=1, dtype=np.int16)[:, rank]
        i, j = np.nonzero(counts >= least)
        i, j = one[i], two[j]
        if low == high:
            i, j = i[node[i] < node[j]], j[node[i] < node[j]]
        good = np.zeros(len(i), bool)
        for k in range(0, len(i), 65536):
            a, b = i[k : k + 65536], j[k : k + 65536]
            good[k : k + 65536] = (x[a] * x[b]).sum(axis=1) >= p.cosine
        i, j = i[good], j[good]
        if spot >> 40 and len(i):  # pairs that met in an earlier table were taken there
            cells = p.cells(x, cuts)[:, : spot >> 40]
            new = np.concatenate([~(cells[i[k : k + 65536]] == cells[j[k : k + 65536]]).any(axis=1) for k in range(0, len(i), 65536)])
            i, j = i[new], j[new]
        links = np.bincount(i, copies[j], len(node)) + np.bincount(j, copies[i], len(node))
        leader = list(range(len(node)))

        def top(c: int) -> int:
            while leader[c] != c:
                leader[c] = leader[leader[c]]
                c = leader[c]
            return c

        tree = []
        for a, b in zip(i.tolist(), j.tolist()):
            a_top, b_top = top(a), top(b)
            if a_top != b_top:
                leader[max(a_top, b_top)] = min(a_top, b_top)
                tree.append((a, b))
        some = np.flatnonzero(links)
        return pa.table({
            "node": pa.array(np.concatenate([node[some], node[np.array([a for a, _ in tree], np.int64)]])),
            "links": pa.array(np.concatenate([links[some].astype(np.int64), np.zeros(len(tree), np.int64)])),
            "other": pa.array([None] * len(some) + [int(node[b]) for _, b in tree], pa.int64()),
        })

    return compare


def near_duplicates(vectors: DataFrame, p: CollisionParams = CollisionParams()) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of vectors (vec_id, embedding, label)."""
    rows = stored(vector_nodes(vectors.select("vec_id", "embedding", "label")), "vectors")
    merged = rows.where("node is not null").groupBy("node").agg(
        F.first("label").alias("label"), F.first("dims").alias("dims"), F.first("embedding").alias("embedding"), F.count("*").alias("copies"))
    nodes = stored(merged, "nodes")
    sizes = nodes.groupBy("label", "dims").agg(F.count("*").alias("n")).select("label", "dims", F.greatest(F.lit(0), F.ceil(F.log2(F.col("n") / p.cell))).cast("int").alias("cuts"))
    spots = stored(placed(nodes.join(sizes, ["label", "dims"]).select("node", "label", "dims", "embedding", "copies", "cuts"), p), "spots")
    # Cells over the block size are cut by hash, and their blocks meet two by two.
    key = ["label", "dims", "cuts", "spot"]
    spread = spots.withColumn("spot", F.explode("spots")).drop("spots")
    large = stored(spread.groupBy(*key).agg(F.count("*").alias("n")).where(F.col("n") > p.block).select(*key, F.ceil(F.col("n") / p.block).alias("parts")), "large")
    own = F.when(F.col("parts").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64("node"), "parts"))
    others = F.when(F.col("parts").isNull(), F.array(F.lit(0).cast("long"))).otherwise(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))
    member = spread.join(large, key, "left").withColumn("block", own.cast("long")).withColumn("other", F.explode(others))
    member = member.withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other")).drop("parts", "other")
    found = stored(member.groupBy(*key, "low", "high").applyInArrow(compare_blocks(p), "node long, links long, other long"), "links")
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    classes = stored(components(found.where("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b"))), "classes")
    of = rows.where("node is not null").groupBy("node").agg(F.min("vec_id").alias("first"), F.count("*").alias("copies"))
    of = of.join(classes.withColumnRenamed("id", "node"), "node", "left").withColumn("root", F.coalesce("component", "node"))
    names = of.groupBy("root").agg(F.min("first").alias("name"))
    known = of.join(names, "root").join(counts, "node", "left").select("node", "name", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n"))
    known = stored(known.where("n > 0"), "known")
    for table in (nodes, spots, large, found, classes):
        drop_stored(table)
    out = rows.select("vec_id", "node").join(known, "node", "left")
    component = F.coalesce("name", "vec_id")
    return out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


def op8_collision_counting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "embeddings"))
