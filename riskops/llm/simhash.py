"""SimHash near-duplicates by tiled exact comparison.

Fingerprints are compared by exclusive-or and bit counts in numpy, tile against tile; tiles
are sorted by population count, and a pair of tiles whose population counts differ by more
than the radius is skipped. Equal fingerprints are compared once. Two fingerprints within
the radius agree on all but ``radius`` of the blocks that their bits are cut into, so a tile
only holds fingerprints that agree on some choice of blocks: no pair is lost, and the number
of blocks follows from how many fingerprints there are. A group with more rows than a tile is
cut into (population band, salt) tiles whose pairs are dealt to different tasks.

A tile sends on a spanning forest of its links, not all pairs; labels then spread over the
links with pointer jumping until nothing changes.

Defined cases: a null text is empty; a text without words has the fingerprint zero and is
linked like any other; repeated rows keep one output row each; rows with a null ``doc_id``
take part, and a group with no other id has a null ``component_id``; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, key_groups, slices, written

SHINGLE_WORDS, RADIUS, SEED = 4, 4, 42
#: Fingerprints of a tile.
TILE = 2048


def fingerprint(text: str | None, words: int = SHINGLE_WORDS, seed: int = SEED) -> int:
    """64-bit SimHash of a whole text; its shingles are hashed in runs of bounded size."""
    import xxhash

    w = (text or "").encode("utf-8").lower().split()  # bytes: ASCII letters and white space only
    if not w:
        return 0
    joined, ends = b" ".join(w), np.cumsum([len(x) + 1 for x in w]) - 1
    first = np.concatenate([[0], ends[:-1] + 1]).tolist()
    last = ends[min(words, len(w)) - 1 :].tolist()
    total, ones = len(last), np.zeros(64, np.int64)
    h = xxhash.xxh64_intdigest
    for at in range(0, total, 8192):
        run = [h(joined[a:b], seed) for a, b in zip(first[at : at + 8192], last[at : at + 8192])]
        bits = np.unpackbits(np.array(run, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > total, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = SHINGLE_WORDS, seed: int = SEED) -> DataFrame:
    """doc_id, row_key (hash of doc_id and text) and fp, the fingerprint as a signed 64-bit number."""
    docs = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("row_key"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            fp = np.array([fingerprint(t, words, seed) for t in part.column("text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("row_key"), pa.array(fp.view(np.int64))], ["doc_id", "row_key", "fp"])

    return docs.mapInArrow(run, T.StructType([docs.schema["doc_id"], docs.schema["row_key"], T.StructField("fp", T.LongType())]))


def block_masks(n: int, radius: int) -> list[int]:
    """Signed masks of the bit choices on which any two fingerprints within the radius agree once.

    64 bits are cut into b blocks; two fingerprints that differ in at most ``radius`` bits
    agree on b - radius of them. b is the least number for which n fingerprints leave no more
    than a tile of them for each value of a choice, if they are spread evenly.
    """
    b = radius + 1
    while b < 2 * radius and n >> (64 * (b - radius) // b) > TILE:
        b += 1
    edges = [64 * k // b for k in range(b + 1)]
    blocks = [sum(1 << i for i in range(x, y)) for x, y in zip(edges, edges[1:])]
    masks = [sum(c) for c in combinations(blocks, b - radius)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def forest(fp: np.ndarray, radius: int, tile: int = 512) -> np.ndarray:
    """For each fingerprint the position of its component's first one, by tiled comparison."""
    order = np.argsort(np.bitwise_count(fp), kind="stable")
    x, pop = fp[order], np.bitwise_count(fp[order]).astype(int)
    label = np.arange(len(x))
    for a in range(0, len(x), tile):
        for b in range(a, len(x), tile):
            if pop[b] - pop[min(a + tile, len(x)) - 1] > radius:
                break  # sorted: the tiles that follow are farther still
            near = np.bitwise_count(x[a : a + tile, None] ^ x[None, b : b + tile]) <= radius
            for i in np.flatnonzero(near.sum(axis=1) > (a == b)):
                joined = np.unique(label[np.append(b + np.flatnonzero(near[i]), a + i)])
                if len(joined) > 1:
                    label[np.isin(label, joined)] = joined[0]
    out = np.empty_like(label)
    out[order] = order[label]
    return out


def links(classes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links (a, b) between different fingerprints ``fp`` that hold the groups together."""
    masks = block_masks(classes.count(), radius)
    keyed = classes.select(
        "fp", F.explode(F.array(*[F.struct(F.lit(k).alias("choice"), F.col("fp").bitwiseAND(F.lit(m)).alias("bits")) for k, m in enumerate(masks)])).alias("x")
    ).select("fp", "x.*")
    sizes = keyed.groupBy("choice", "bits").agg(F.count("*").alias("n")).where("n > 1")
    m = F.ceil(F.col("n") / TILE).cast("int")
    band = F.floor(F.bit_count("fp") / (radius + 1)).cast("int")  # partners are in this band or the next
    salt = F.pmod(F.xxhash64("fp"), F.col("m")).cast("int")
    every = F.sequence(F.lit(0), F.col("m") - 1)

    def tile(low, a, step, b):
        return F.concat_ws(":", low.cast("string"), a.cast("string"), F.lit(step), b.cast("string"))

    pairs = F.when(F.col("m") == 1, F.array(F.lit("all"))).otherwise(
        F.concat(
            F.transform(every, lambda b: tile(F.col("band"), F.least(b, F.col("salt")), 0, F.greatest(b, F.col("salt")))),
            F.transform(every, lambda b: tile(F.col("band"), F.col("salt"), 1, b)),
            F.transform(every, lambda b: tile(F.col("band") - 1, b, 1, F.col("salt"))),
        )
    )
    tiles = (
        keyed.join(sizes, ["choice", "bits"])
        .withColumns({"m": m, "band": band}).withColumn("salt", salt)
        .select("choice", "bits", F.explode(pairs).alias("tile"), "fp")
    )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[np.ndarray] = []
        for group in key_groups(batches, ["choice", "bits", "tile"]):
            fp = group.column("fp").to_numpy().view(np.uint64)
            root = fp[forest(fp, radius)]
            moved = root != fp
            if moved.any():
                out.append(np.stack([fp[moved], root[moved]]).view(np.int64))
            if len(out) > 1000:
                yield edges(out)
                out = []
        if out:
            yield edges(out)

    def edges(found: list[np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c) for c in np.concatenate(found, axis=1)], ["a", "b"])

    keys = ["choice", "bits", "tile"]
    dealt = tiles.repartition(*keys).sortWithinPartitions(*keys)
    return dealt.mapInArrow(compare, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root: the least node that can be reached, for each node that has a link.

    Each round takes the least label among the neighbours, then follows labels once
    (pointer jumping); both joins start from written tables, so Spark can split a hot key.
    """
    both = written(edges.select("a", "b").union(edges.select("b", "a")).toDF("node", "other"), "links")
    labels = written(both.groupBy("node").agg(F.min("other").alias("o")).select("node", F.least("node", "o").alias("root")), "labels")
    while True:
        heard = both.join(labels.withColumnRenamed("node", "other"), "other").select("node", "root", F.lit(None).cast("long").alias("old"))
        least = (
            heard.union(labels.select("node", "root", F.col("root").alias("old")))
            .groupBy("node").agg(F.min("root").alias("via"), F.max("old").alias("old"))
        )
        least = written(least, "labels")
        jump = least.select(F.col("node").alias("via"), F.col("via").alias("root"))
        labels = written(least.join(jump, "via").select("node", "root", "old"), "labels")
        if labels.where("root < old").isEmpty():
            return labels.select("node", "root")


def near_duplicates(docs: DataFrame, words: int = SHINGLE_WORDS, radius: int = RADIUS, seed: int = SEED) -> DataFrame:
    """doc_id, fingerprint (hex), component_id (least doc_id of the group), row_key, kept_key.

    ``row_key`` hashes a row's doc_id and text; ``kept_key`` is that of the group's first row.
    """
    prints = written(fingerprints(docs, words, seed), "fingerprints")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_key"))
    classes = written(prints.groupBy("fp").agg(first.alias("first")), "classes")
    roots = components(links(classes, radius)).withColumnRenamed("node", "fp")
    rooted = written(classes.join(roots, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "first"), "rooted")
    named = written(rooted.groupBy("root").agg(F.min("first").alias("first")), "named")
    group = written(rooted.select("fp", "root").join(named, "root").select("fp", "first.*").withColumnsRenamed({"doc_id": "component_id", "row_key": "kept_key"}), "groups")
    return prints.join(group, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "row_key", "kept_key"
    )


def one_of_each(docs: DataFrame, words: int = SHINGLE_WORDS, radius: int = RADIUS, seed: int = SEED) -> DataFrame:
    """The documents, one of each group: that with the least doc_id. Columns as they came.

    Rows that repeat both doc_id and text are one document.
    """
    key = fresh("row_key", docs.columns)
    kept = near_duplicates(docs, words, radius, seed).where("row_key = kept_key").select(F.col("row_key").alias(key)).distinct()
    return docs.withColumn(key, F.xxhash64("doc_id", "text")).join(kept, key, "left_semi").dropDuplicates([key]).drop(key)
