"""Set-similarity self-join of word n-grams by PartEnum signatures, and the classes of linked documents.

A document is the set of its distinct shingles (n words; the whole sequence where there are fewer; empty without words).
Documents with equal sets are one node. Sizes fall into bands, each half as wide again as it starts. A pair belongs to
the band of its smaller set: if its similarity is p percent or more, the sets differ in at most k = (100 - p) / p times
the band's largest size. Every set so signs in its own band, and in the one before if a set of that could be similar.

Two levels: in a band the hashed shingle domain is cut into n1 first-level parts of three second-level parts each, and in
every first-level part the three subsets of two second-level parts are enumerated; a signature is the hash of the set's
shingles in such a subset. A first-level part with no difference leaves three subsets equal, one with one difference
leaves one. With 2 * n1 > k some subset is always equal; n1 is a tenth larger, so that `spare` more are: linked sets share
at least spare + 1 signatures. Each set leaves out its `spare` least telling ones, those with the fewest shingles, in an
order that depends on a signature's contents only: the best that a linked pair shares is among what both keep. Thus the
empty and near-empty subsets on which unlike sets agree are not sent, and no link is lost.

Before any shingles are fetched, sketches rule candidate pairs out: a set's sketch has a bit for each cell of a hashed domain of
at least as many cells as shingles, the parity of those that fall there. Two sketches differ in no more bits than the sets
in shingles, so a pair whose sketches differ in too many is surely not similar.

Signatures are shuffled once, packed by bucket, one set of a batch for each signature; the other sets of the batch with it
are written beside, so that a signature that a third of all sets share is one row a batch and not one a set. The sets of
a signature share its smallest key as a centre; each
set is compared with the centres it shares most signatures with, exactly, and linked classes come from those links: groups
of thousands of copies or near copies cost a few comparisons a member. Where a signature then still holds several classes,
no pair of them is left out: large ones that overlap make a cluster, which is compared in a bounded number of blocks (those
of one class are skipped), each giving links enough to join what is linked; pairs of small ones that
neither a centre nor a cluster covers are compared one by one, each once.

Node keys and shingles are 64-bit hashes. Null and empty texts have no shingles and link with nothing. Repeated
doc_ids get a row each. A null doc_id never is a component's name while another id is reachable.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from windrow.llm.common import components, drop_stored, gram_hashes, mix, read, release, slices, stored, text_buffers, trim, trimmed, word_hashes

#: Keys of sets that a task remembers, so as not to sign the copies of a set again.
_SEEN = 1 << 15
_SIGN_BYTES = 1_000_000
#: Second-level parts of a first-level part, taken two at a time.
_SUBSETS = ((0, 1), (0, 2), (1, 2))


def shingle_sets(part: pa.RecordBatch, n: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each row's whole text."""
    words, at = word_hashes(*text_buffers(part.column("text")))
    return [np.unique(gram_hashes(words[s:e], n)) for s, e in zip(at[:-1], at[1:])]


def set_keys(sets: list[np.ndarray]) -> np.ndarray:
    """A 64-bit key of each set."""
    sizes = np.array([len(s) for s in sets], np.int64)
    flat = np.concatenate([mix(s, 23) for s in sets]) if len(sets) else np.zeros(0, np.uint64)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(flat, dtype=np.uint64)])
    ends = np.cumsum(sizes)
    return mix(sums[ends] - sums[ends - sizes] + sizes.astype(np.uint64), 29).view(np.int64)


def bands(largest: int) -> np.ndarray:
    """First sizes of the bands that sizes up to `largest` need, and of the next."""
    out = [1]
    while out[-1] <= largest:
        out.append(max(out[-1] + 1, out[-1] * 3 // 2))
    return np.array([*out, out[-1] * 3 // 2 + 1], np.int64)


def parts_of(k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """n1 for sets that differ in at most k elements, and how many signatures linked sets share beyond one."""
    least = (k + 2) // 2
    n1 = least + 1 + least // 10
    # k differences, spread evenly, are the worst: up to n1 of them leave one subset of three, each further one none.
    shared = np.where(k >= n1, 2 * n1 - k, 3 * n1 - 2 * k)
    return n1, shared - 1


def signatures(sets: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(set number, signature) of all sets; those of sets that can only be linked to equal ones have none."""
    sizes = np.array([len(s) for s in sets], np.int64)
    if not sizes.sum():
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    flat = np.concatenate(sets)
    place, value = mix(flat, 5) >> np.uint64(32), mix(flat, 6)
    first = bands(int(sizes.max()))
    band = np.searchsorted(first, sizes, side="right") - 1
    numbers, found = [], []
    for down in (0, 1):
        slot = band - down
        upper = first[np.maximum(slot, 0) + 1] - 1
        k = np.where((slot >= 0) & (sizes > 0) & (percent * sizes <= 100 * upper if down else True), upper * (100 - percent) // percent, 0)
        signing = np.flatnonzero(k > 0)
        if not len(signing):
            continue
        n1, spare = parts_of(k[signing])
        count = sizes[signing]
        base = np.concatenate([[0], np.cumsum(n1)])
        at = np.repeat(np.cumsum(sizes)[signing] - count - (np.cumsum(count) - count), count) + np.arange(count.sum())
        cells = np.repeat((3 * n1).astype(np.uint64), count)
        cell = np.repeat(3 * base[:-1], count) + (place[at] * cells >> np.uint64(32)).astype(np.int64)
        order = np.argsort(cell)
        filled = np.bincount(cell, minlength=3 * base[-1])
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(value[at][order], dtype=np.uint64)])
        ends = np.cumsum(filled)
        total, filled = (sums[ends] - sums[ends - filled]).reshape(-1, 3), filled.reshape(-1, 3)
        owner = np.repeat(np.arange(len(signing)), n1)
        label = (slot[signing][owner].astype(np.uint64) << np.uint64(40)) + (np.arange(base[-1]) - base[owner]).astype(np.uint64) * np.uint64(4)
        held = np.concatenate([filled[:, a] + filled[:, b] for a, b in _SUBSETS])
        hashes = np.concatenate([mix(total[:, a] + total[:, b] + mix(label + np.uint64(i), 7), 8) for i, (a, b) in enumerate(_SUBSETS)])
        owner = np.tile(owner, 3)
        # Least telling first: by elements, then by hash, which equal contents share.
        order = np.argsort((owner.astype(np.uint64) << np.uint64(40)) | (np.minimum(held, 255).astype(np.uint64) << np.uint64(32)) | (hashes >> np.uint64(32)))
        rank = np.arange(len(order)) - np.repeat(3 * base[:-1], 3 * n1)
        kept = order[rank >= np.repeat(spare, 3 * n1)]
        numbers.append(signing[owner[kept]])
        found.append(hashes[kept])
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(numbers), np.concatenate(found)


def sketches(sets: list[np.ndarray]) -> pa.ListArray:
    """The parity bits of each set, as 64-bit words: the least power of two of them with a bit for each element."""
    sizes = np.array([len(s) for s in sets], np.int64)
    words = np.int64(1) << np.ceil(np.log2(np.maximum(1, sizes / 64))).astype(np.int64)
    ends = np.cumsum(words)
    out = np.zeros(ends[-1], np.uint64)
    if sizes.sum():
        bit = (mix(np.concatenate(sets), 31) & np.repeat(words * 64 - 1, sizes).astype(np.uint64)).astype(np.int64)
        np.bitwise_xor.at(out, np.repeat(ends - words, sizes) + (bit >> 6), np.uint64(1) << (bit & 63).astype(np.uint64))
    return pa.ListArray.from_arrays(np.append(0, ends).astype(np.int32), pa.array(out.view(np.int64)))


def likely(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The (a, b) key pairs that sizes and sketches don't rule out; nodes: (key, n, sketch)."""
    one, two = (nodes.select(F.col("key").alias(c), F.col("n").alias(f"n_{c}"), F.col("sketch").alias(f"of_{c}")) for c in ("a", "b"))
    both = pairs.join(one, "a").join(two, "b").where(f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)")

    def folded(x: str, y: str) -> Column:  # of two sizes a factor of two apart, the larger is folded
        half = F.size(y)
        return F.when(F.size(x) > half, F.zip_with(F.slice(x, 1, half), F.slice(x, half + 1, half), lambda p, q: p.bitwiseXOR(q))).otherwise(F.col(x))

    apart = F.aggregate(F.zip_with(folded("of_a", "of_b"), folded("of_b", "of_a"), lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda t, x: t + x)
    return both.where((100 + percent) * apart <= (100 - percent) * (F.col("n_a") + F.col("n_b"))).select("a", "b")


def document_sets(docs: DataFrame, n: int) -> DataFrame:
    """(doc_id, n_shingles, key, sketch) of every row; key is null for the empty set."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            sets = shingle_sets(part, n)
            sizes = np.array([len(s) for s in sets], np.int64)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sizes), pa.array(set_keys(sets), mask=sizes == 0), sketches(sets)], ["doc_id", "n_shingles", "key", "sketch"])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(trimmed(run), f"doc_id {kind}, n_shingles long, key long, sketch array<long>")


def packed_signatures(docs: DataFrame, n: int, percent: int, buckets: int) -> DataFrame:
    """(bucket, signatures array<int>, keys array<long>): a batch's signatures by bucket, each with one set's key.

    A signature's bucket is its high half modulo `buckets`; its low half is sent. Sets of the batch that share a signature go
    into buckets of their own from `buckets` on, dealt by batch, with whole signatures as (signature, key) in turn.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(_SEEN, np.int64)
        for part in slices(batches, "text", _SIGN_BYTES):
            sets = shingle_sets(part, n)
            keys = set_keys(sets)
            _, fresh = np.unique(keys, return_index=True)
            slot = (keys[fresh] % _SEEN).astype(np.int64)
            fresh = fresh[seen[slot] != keys[fresh]]
            seen[keys[fresh] % _SEEN] = keys[fresh]
            of, found = signatures([sets[i] for i in fresh], percent)
            if not len(of):
                continue
            key = keys[fresh][of]
            order = np.lexsort((key, found))
            key, found = key[order], found[order]
            new = np.concatenate([[True], found[1:] != found[:-1]])
            alike = ~new
            alike[:-1] |= ~new[1:]
            bucket = bucket_of(found[new], buckets)
            order = np.argsort(bucket, kind="stable")
            edges = np.flatnonzero(np.concatenate([[True], np.diff(bucket[order]) != 0]))
            names, lists = [bucket[order][edges]], [(found[new][order] & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.int32)]
            members, ends = [key[new][order]], [np.append(edges, len(order))]
            if alike.any():
                both = np.stack([found[alike].view(np.int64), key[alike]], axis=1).ravel()
                names.append(np.array([buckets + int(found[0] % np.uint64(buckets))]))
                members.append(both)
                ends.append(ends[-1][-1:] + len(both))
            key_ends = np.concatenate(ends).astype(np.int32)
            sign_ends = np.minimum(key_ends, len(order))
            yield pa.RecordBatch.from_arrays([
                pa.array(np.concatenate(names)), pa.ListArray.from_arrays(sign_ends, pa.array(lists[0])), pa.ListArray.from_arrays(key_ends, pa.array(np.concatenate(members))),
            ], ["bucket", "signatures", "keys"])

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(trimmed(run), "bucket long, signatures array<int>, keys array<long>")


def bucket_of(found: np.ndarray, buckets: int) -> np.ndarray:
    return ((found >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)


def shared_signatures(packed: DataFrame, buckets: int) -> DataFrame:
    """(signature, key) of the signatures that several sets have; repeats occur."""

    def collide(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        key = table.column("keys").combine_chunks().flatten().to_numpy()
        if bucket >= buckets:
            return pa.table({"signature": pa.array(shortened(key[::2].view(np.uint64), buckets)), "key": pa.array(key[1::2])})
        low = table.column("signatures").combine_chunks().flatten().to_numpy().view(np.uint32).astype(np.int64)
        order = np.argsort(low, kind="stable")
        low, key = low[order], key[order]
        starts = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]]))
        several = np.minimum.reduceat(key, starts) != np.maximum.reduceat(key, starts)
        kept = np.repeat(several, np.diff(np.append(starts, len(low))))
        trim()
        return pa.table({"signature": pa.array((bucket << 32) + low[kept]), "key": pa.array(key[kept])})

    return packed.groupBy("bucket").applyInArrow(collide, "signature long, key long")


def shortened(found: np.ndarray, buckets: int) -> np.ndarray:
    """Signatures as they are known after the shuffle: bucket and low half."""
    return (bucket_of(found, buckets) << 32) + (found & np.uint64(0xFFFFFFFF)).astype(np.int64)


def bounded(df: DataFrame, most: int) -> DataFrame:
    """df, to be broadcast where it has at most so many rows."""
    return F.broadcast(df) if df.count() <= most else df


def sets_of(docs: DataFrame, wanted: DataFrame, n: int, broadcast_rows: int) -> DataFrame:
    """(key, elements) of the wanted (key, doc_id): their texts are shingled again; each key once."""
    ids = bounded(wanted.select(F.col("doc_id").alias("wanted_id")).distinct(), broadcast_rows)
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    texts = texts.join(ids, F.col("doc_id").eqNullSafe(F.col("wanted_id")), "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            sets = shingle_sets(part, n)
            ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(set_keys(sets)), pa.ListArray.from_arrays(ends, pa.array(np.concatenate(sets).view(np.int64)))], ["key", "elements"])

    made = texts.select("text").mapInArrow(trimmed(run), "key long, elements array<long>")
    return made.join(wanted.select("key"), "key", "left_semi").dropDuplicates(["key"])


def linked_pairs(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The (a, b) key pairs whose sets are similar enough, by exact integer comparison."""
    one = sets.select(F.col("key").alias("a"), F.col("elements").alias("of_a"))
    two = sets.select(F.col("key").alias("b"), F.col("elements").alias("of_b"))
    both = pairs.join(one, "a").join(two, "b").withColumn("common", F.size(F.array_intersect("of_a", "of_b")))
    return both.where(100 * F.col("common") >= percent * (F.size("of_a") + F.size("of_b") - F.col("common"))).select("a", "b")


def near_tiles(table: pa.Table, labels: np.ndarray, ends: np.ndarray, flat: np.ndarray, percent: int, tile: int = 512) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows of block low, rows of block high, near) by tiles: pairs of different labels that sizes and sketches don't rule out.

    ends, flat: the rows' sketches. The caller may change labels between tiles. Within one block each pair comes once.
    """
    blocks, n = table.column("block").to_numpy(), table.column("n").to_numpy()
    low, high = table.column("low")[0].as_py(), table.column("high")[0].as_py()
    words = np.diff(ends)

    def side(block: int, size: int) -> list[np.ndarray]:
        rows = np.flatnonzero((blocks == block) & (words == size))
        return [rows[i : i + tile] for i in range(0, len(rows), tile)]

    for size in np.unique(words):
        for other in {size, size * 2, size // 2} - {0}:
            for one in side(low, size):
                left = flat[ends[one][:, None] + np.arange(size)]
                if other < size:  # of two sizes a factor of two apart, the larger is folded
                    left = left[:, :other] ^ left[:, other:]
                for two in side(high, other):
                    near = labels[one][:, None] != labels[two]
                    if low == high:
                        near &= one[:, None] < two
                    near &= 100 * np.minimum(n[one][:, None], n[two]) >= percent * np.maximum(n[one][:, None], n[two])
                    if not near.any():
                        continue
                    right = flat[ends[two][:, None] + np.arange(other)]
                    if other > size:
                        right = right[:, :size] ^ right[:, size:]
                    apart = np.zeros(near.shape, np.int64)
                    for k in range(left.shape[1]):
                        apart += np.bitwise_count(left[:, k, None] ^ right[None, :, k])
                    near &= (100 + percent) * apart <= (100 - percent) * (n[one][:, None] + n[two])
                    if near.any():
                        yield one, two, near


def likely_in_blocks(percent: int):
    """For one pair of blocks of (key, class, n, sketch): the rows that sketches leave a partner of another class."""

    def compare(table: pa.Table) -> pa.Table:
        column = table.column("sketch").combine_chunks()
        labels, kept = table.column("class").to_numpy(), np.zeros(len(table), bool)
        for one, two, near in near_tiles(table, labels, column.offsets.to_numpy(), column.values.to_numpy().view(np.uint64), percent):
            kept[one] |= near.any(axis=1)
            kept[two] |= near.any(axis=0)
        return table.select(["cluster", "low", "high", "block", "key", "class"]).filter(pa.array(kept))

    return compare


def links_in_blocks(percent: int):
    """For one pair of blocks of (key, class, n, elements): links (a, b), enough to join what is linked, by exact comparison."""

    def compare(table: pa.Table) -> pa.Table:
        keys, labels = table.column("key").to_numpy(), table.column("class").to_numpy().copy()
        column = table.column("elements").combine_chunks()
        ends = column.offsets.to_numpy()
        values, ends = column.values.to_numpy()[ends[0] : ends[-1]].view(np.uint64), ends - ends[0]
        sets = [values[s:e] for s, e in zip(ends[:-1], ends[1:])]
        sizes = np.diff(ends).astype(np.int64)
        sketch = sketches(sets)
        links = []
        for one, two, near in near_tiles(table, labels, sketch.offsets.to_numpy(), sketch.values.to_numpy().view(np.uint64), percent):
            of = np.unique(np.concatenate([one[near.any(axis=1)], two[near.any(axis=0)]]))
            numbers = np.unique(np.concatenate([sets[r] for r in of]), return_inverse=True)[1]
            numbered = dict(zip(of.tolist(), np.split(numbers, np.cumsum(sizes[of])[:-1])))
            mark = np.zeros(len(numbers), bool)
            for i, partners in zip(one.tolist(), near):
                if not partners.any():
                    continue
                mark[numbered[i]] = True
                for j in two[partners].tolist():
                    if labels[i] != labels[j]:
                        common = int(np.count_nonzero(mark[numbered[j]]))
                        if 100 * common >= percent * (sizes[i] + sizes[j] - common):
                            links.append((int(keys[i]), int(keys[j])))
                            labels[labels == labels[j]] = labels[i]
                mark[numbered[i]] = False
        trim()
        return pa.table({"a": pa.array([a for a, _ in links], pa.int64()), "b": pa.array([b for _, b in links], pa.int64())})

    return compare


def block_links(members: DataFrame, sets: DataFrame, nodes: DataFrame, percent: int, parts: int = 8, least: int = 256, most_bytes: int = 16_000_000) -> DataFrame:
    """Links between sets of different classes within the same cluster, compared block against block.

    members: (cluster, key, class). Every pair of blocks is one group, and a set is sent once for each block of its cluster. So
    a cluster has about `parts` blocks however large it is: rows sent grow with the sets, and only comparisons with their
    square. Fewer blocks do where they would have under `least` sets, more only where a block's sets would be over
    `most_bytes`. A class of more than a block is cut by hash into blocks of its own, smaller classes are dealt to shared
    blocks by the class's hash. Sets (key, elements) go only to those pairs of blocks in which sketches (nodes: key, n,
    sketch) leave them a partner; a group gives fewer links than it has sets: enough to join what is linked.
    """
    weighed = members.join(nodes.select("key", (F.col("n") * 8 + 64).alias("w")), "key")
    sizes = weighed.groupBy("cluster", "class").agg(F.sum("w").alias("w"), F.count("*").alias("n"))
    unit = F.least(F.lit(float(most_bytes)), F.greatest(F.sum("w") / parts, F.sum("w") / F.sum("n") * least))
    units = sizes.groupBy("cluster").agg(unit.alias("unit"))
    sizes = sizes.join(units, "cluster")
    small = sizes.where("w <= unit").groupBy("cluster").agg(F.ceil(F.sum("w") / F.first("unit")).alias("shares"))
    large = sizes.where("w > unit").select("cluster", "class", F.ceil(F.col("w") / F.col("unit")).alias("cuts"))
    name = F.when(F.col("cuts").isNotNull(), F.xxhash64("class", F.pmod(F.xxhash64("key"), "cuts"))).otherwise(F.pmod(F.xxhash64("class"), "shares"))
    numbered = members.join(large, ["cluster", "class"], "left").join(small, "cluster", "left")
    numbered = stored(numbered.select("cluster", "key", "class", name.alias("block")), "numbered")
    blocks = numbered.groupBy("cluster", "block").agg(F.min("class").alias("least"), F.max("class").alias("most"))
    one = blocks.select("cluster", F.col("block").alias("low"), F.col("least").alias("low_least"), F.col("most").alias("low_most"))
    two = blocks.select("cluster", F.col("block").alias("high"), F.col("least").alias("high_least"), F.col("most").alias("high_most"))
    same = (F.col("low_least") == F.col("low_most")) & (F.col("high_least") == F.col("high_most")) & (F.col("low_least") == F.col("high_least"))
    meet = one.join(two, "cluster").where((F.col("low") <= F.col("high")) & ~same).select("cluster", "low", "high")
    sides = meet.withColumn("block", F.col("low")).union(meet.where("low <> high").withColumn("block", F.col("high")))
    first = numbered.join(sides, ["cluster", "block"]).join(nodes.select("key", "n", "sketch"), "key").groupBy("cluster", "low", "high")
    left = stored(first.applyInArrow(likely_in_blocks(percent), "cluster long, low long, high long, block long, key long, class long"), "meet")
    second = left.join(sets.select("key", F.size("elements").cast("bigint").alias("n"), "elements"), "key").groupBy("cluster", "low", "high")
    return second.applyInArrow(links_in_blocks(percent), "a long, b long")


def merged(classes: DataFrame, links: DataFrame) -> DataFrame:
    """classes (key, class) of all keys, after links (a, b) between keys."""
    roots = links.join(classes.select(F.col("key").alias("a"), F.col("class").alias("class_a")), "a").join(classes.select(F.col("key").alias("b"), F.col("class").alias("class_b")), "b")
    found = components(roots.select(F.col("class_a").alias("a"), F.col("class_b").alias("b"))).withColumnRenamed("id", "class")
    return stored(classes.join(found, "class", "left").select("key", F.coalesce("component", "class").alias("class")), "classes")


def similarity_classes(docs: DataFrame, n: int = 4, percent: int = 85, broadcast_rows: int = 200_000, small: int = 32, centres: int = 2, per_bucket: int = 2_000_000) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of docs (doc_id, text).

    small: members up to which a bucket of several classes is compared pair by pair; centres: comparisons of a set
    before classes are first formed; per_bucket: shingles behind a bucket of signatures. None changes the result.
    """
    if not 70 <= percent <= 100:
        raise ValueError("percent must be from 70 to 100: below, similar sets may lie two bands apart")
    spark = docs.sparkSession
    rows = stored(document_sets(docs, n), "sets")
    named = rows.where("key is not null").groupBy("key")
    nodes = named.agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))
    total = rows.agg(F.sum("n_shingles")).first()[0] or 0
    buckets = max(256, int(total // per_bucket))
    shared = stored(shared_signatures(packed_signatures(docs, n, percent, buckets), buckets), "shared")
    release(spark)
    # Copies are aggregated before the join, so that the many rows of one set don't meet in one task.
    sketched = named.agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch"))
    wanted = stored(sketched.join(shared.select("key").distinct(), "key"), "wanted")

    def exact(pairs: DataFrame, label: str) -> DataFrame:
        """The linked ones of the (a, b) pairs: sketches first, then the sets of those that are left."""
        few = stored(likely(pairs, wanted, percent), f"{label}-likely")
        of = few.select(F.col("a").alias("key")).union(few.select("b")).distinct()
        sets = stored(sets_of(docs, wanted.join(of, "key").select("key", "doc_id"), n, broadcast_rows), f"{label}-sets")
        links = stored(linked_pairs(few, sets, percent), label)
        for table in (few, sets):
            drop_stored(table)
        return links

    centre = shared.groupBy("signature").agg(F.min("key").alias("centre"))
    often = shared.join(centre, "signature").where("key <> centre").groupBy(F.col("centre").alias("a"), F.col("key").alias("b")).agg(F.count("*").alias("n"))
    star = stored(often.withColumn("rank", F.row_number().over(Window.partitionBy("b").orderBy(F.desc("n"), "a"))).where(F.col("rank") <= centres).select("a", "b"), "star")
    links = exact(star, "links")
    classes = merged(wanted.select("key", F.col("key").alias("class")), links)

    placed = shared.join(bounded(classes, broadcast_rows), "key")
    # A bucket is known by its members, so the many signatures of the same few sets are one bucket.
    mixed = placed.groupBy("signature").agg(
        F.count("*").alias("n"), F.sum(F.xxhash64("key").cast("decimal(38,0)")).alias("h"), F.min("class").alias("low"), F.max("class").alias("high"),
    ).where("low <> high").groupBy("n", "h").agg(F.min("signature").alias("signature"))
    rest = stored(placed.join(mixed, "signature").select(F.col("signature").alias("bucket"), "key", "class", "n"), "mixed")
    release(spark)
    many = rest.where(F.col("n") > small)
    # Classes that meet in a large bucket make a cluster; a class has one row a bucket, however many of its sets are there.
    seats = many.select("bucket", "class").distinct()
    chain = seats.join(seats.groupBy("bucket").agg(F.min("class").alias("a")), "bucket").select("a", F.col("class").alias("b"))
    joined = components(chain).select(F.col("id").alias("class"), F.col("component").alias("cluster"))
    clusters = stored(many.select("key", "class").distinct().join(joined, "class").select("key", "cluster"), "clusters")
    held = stored(sets_of(docs, wanted.join(clusters.select("key"), "key").select("key", "doc_id"), n, broadcast_rows), "held")
    more = stored(block_links(clusters.join(classes, "key"), held, wanted, percent), "more")
    classes = merged(classes, more)

    few = rest.where(F.col("n") <= small).drop("class").join(classes, "key").join(clusters, "key", "left").select("bucket", "key", "class", F.coalesce("cluster", "key").alias("cluster"))
    one, two = ([F.col(c).alias(f"{c}_{side}") for c in ("key", "class", "cluster")] for side in ("a", "b"))
    pairs = few.select("bucket", *one).join(few.select("bucket", *two), "bucket").where("key_a < key_b and class_a <> class_b and cluster_a <> cluster_b")
    pairs = pairs.select(F.col("key_a").alias("a"), F.col("key_b").alias("b")).distinct()
    last = exact(pairs.join(star, ["a", "b"], "left_anti"), "last")
    release(spark)
    classes = merged(classes, last)

    top = nodes.join(classes, "key", "left").withColumn("root", F.coalesce("class", "key"))
    names = top.groupBy("root").agg(F.min("doc_id").alias("name"), F.sum("copies").alias("size")).where("size > 1")
    known = stored(top.select("key", "root").join(names, "root").select("key", "name"), "known")
    for table in (shared, star, wanted, links, rest, clusters, held, more, last, classes):
        drop_stored(table)
    release(spark)
    return rows.join(known, "key", "left").select("doc_id", "n_shingles", F.coalesce("name", "doc_id").alias("component_id"))


def op7_partenum_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity_classes(read(spark, sf_dir, "documents").select("doc_id", "text"))


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str, broadcast_rows: int = 100_000) -> DataFrame:
    """One row of each class by five-word shingles and a similarity of 0.8 or more stays, that with the smallest id.

    Rows are told apart by id and text, so a null or repeated id says nothing of other rows with it. Of rows with
    the same id and text one stays, but all of those with neither id nor words.
    """
    text = F.xxhash64("text")
    row = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), text.alias("text"))
    found = similarity_classes(docs.select(row.alias("doc_id"), "text"), n=5, percent=80)
    dropped = stored(found.where("doc_id <> component_id").select("doc_id.id", F.col("doc_id.text").alias("hash")).distinct(), "dropped")
    dropped = F.broadcast(dropped) if dropped.count() <= broadcast_rows else dropped
    is_row = F.col("doc_id").eqNullSafe(F.col("id")) & (text == F.col("hash"))
    kept = docs.join(dropped, is_row, "left_anti")
    repeats = found.groupBy("doc_id").agg(F.count("*").alias("n"), F.max("n_shingles").alias("words")).where("n > 1 and (not doc_id.none or words > 0)")
    twice = stored(repeats.select("doc_id.id", F.col("doc_id.text").alias("hash")), "twice")
    if twice.isEmpty():
        return kept.select(docs.columns)
    first = kept.join(twice, is_row, "left_semi").withColumn("__text", text).dropDuplicates(["doc_id", "__text"])
    return kept.join(twice, is_row, "left_anti").select(docs.columns).union(first.select(docs.columns))
