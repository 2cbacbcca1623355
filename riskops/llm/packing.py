"""Best-fit packing by minimum bin slack.

Documents become token pieces of at most ``capacity`` ids. Only the histogram of piece
lengths decides which lengths share a sequence, and it has at most ``capacity`` rows however
large the corpus is. Per bin, the longest length left is placed and a bitset subset-sum
program over the lengths that are still available finds the fullest combination beside it;
the combination is removed as often as its lengths last, which is what repeating the search
bin by bin would do. Pieces then take their places by their rank among the pieces of their
length, a distributed two-level rank. With a column of places, as the source mix gives, pieces
are ranked by it, and the sequences of all combinations run side by side from the first to the
last, numbered in that order: a sequence holds pieces from about its own part of the mix.

Defined cases: null text is empty (its piece is the single id 0); repeated rows and rows with
a null ``doc_id`` are packed like any other; ties between equal lengths go by hash bucket,
doc_id and piece; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import written
from .tokens import by_bytes, word_tokens

CAPACITY = 2048
TOKENIZER = "word_bpe_49k.json"
#: Pieces of a bucket of the two-level rank, about.
RANK_BUCKET = 4096

PIECE_FIELDS = "piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str = TOKENIZER, place: str | None = None) -> DataFrame:
    """Token pieces of each document: doc_id, piece, start, length and the CRC-32 of its ids (and place_, the column ``place``)."""
    docs = docs.select("doc_id", "text", *([F.col(place).cast("long").alias("place_")] if place else []))
    more = ["place_"] if place else []

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = word_tokens(tokenizer)
        for part in by_bytes(batches):
            ids, ends = encode(part.column("text"))
            rows: list[tuple[int, int, int, int, int]] = []
            for k, (a, b) in enumerate(zip(ends, ends[1:])):
                own = np.append(ids[a:b], np.uint32(0)).astype("<u4")
                for j, start in enumerate(range(0, len(own), capacity)):
                    x = own[start : start + capacity]
                    rows.append((k, j, start, len(x), zlib.crc32(x.tobytes())))
            of, *rest = (np.array(c, np.int64) for c in zip(*rows))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id").take(pa.array(of)), pa.array(rest[0].astype(np.int32)), *map(pa.array, rest[1:]), *[part.column(c).take(pa.array(of)) for c in more]],
                ["doc_id", "piece", "start", "length", "ids_crc32", *more],
            )

    schema = T.StructType([docs.schema["doc_id"]]).simpleString()[7:-1].replace(":", " ") + ", " + ", ".join([PIECE_FIELDS, *[f"{c} long" for c in more]])
    return docs.mapInArrow(cut, schema)


def fullest(counts: dict[int, int], room: int) -> list[tuple[int, int]]:
    """The combination of available lengths that fills ``room`` best, as (length, times).

    Bit t of the set is on if some combination has the sum t. Longer lengths enter first, a
    length that is there c times as chunks of 1, 2, 4 ... copies; the walk back takes a chunk
    only where the sum could not be reached without it.
    """
    bits, mask, goal, steps = 1, (1 << (room + 1)) - 1, 1 << room, []
    for size in sorted((x for x, c in counts.items() if c and x <= room), reverse=True):
        left, chunk = min(counts[size], room // size), 1
        while left and not bits & goal:
            take = min(chunk, left)
            more = bits | (bits << (size * take)) & mask
            if more != bits:
                steps.append((size, take, bits))
            bits, left, chunk = more, left - take, chunk * 2
        if bits & goal:
            break
    total, used = bits.bit_length() - 1, {}
    for size, take, before in reversed(steps):
        if not before >> total & 1:
            used[size] = used.get(size, 0) + take
            total -= size * take
    return sorted(used.items(), reverse=True)


def bin_patterns(histogram: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """(how many sequences, [(length, how often in one sequence)]) until no length is left."""
    counts = {x: c for x, c in histogram.items() if c}
    out = []
    while counts:
        longest = max(counts)
        counts[longest] -= 1
        found = dict(fullest(counts, capacity - longest))
        counts[longest] += 1
        found[longest] = found.get(longest, 0) + 1
        times = min(counts[x] // k for x, k in found.items())
        out.append((times, sorted(found.items(), reverse=True)))
        for x, k in found.items():
            counts[x] -= times * k
            if not counts[x]:
                del counts[x]
    return out


def ranked(df: DataFrame, key: str, order: list[str], rank: str, rows: int, bucket: Column | None = None) -> DataFrame:
    """Number the rows of each ``key`` from 0 without ever holding one key in one task.

    Rows are dealt to hash buckets of about RANK_BUCKET rows; a bucket's rows are numbered
    within (key, bucket), and the counts per (key, bucket) give each bucket its first number.
    With a ``bucket`` that does not fall as ``order`` rises, ranks follow ``order``.
    ``key`` must not be null. Columns named bucket_ and first_ are used on the way.
    """
    buckets = max(1, -(-rows // RANK_BUCKET))
    df = df.withColumn("bucket_", F.pmod(F.xxhash64(*order), F.lit(buckets)) if bucket is None else bucket)
    within = Window.partitionBy(key, "bucket_")
    earlier = Window.partitionBy(key).orderBy("bucket_").rowsBetween(Window.unboundedPreceding, -1)
    first = (
        df.groupBy(key, "bucket_").agg(F.count("*").alias("n_"))
        .select(key, "bucket_", F.coalesce(F.sum("n_").over(earlier), F.lit(0)).alias("first_"))
    )
    return (
        df.withColumn(rank, F.row_number().over(within.orderBy(*order)) - 1)
        .join(first, [key, "bucket_"])
        .withColumn(rank, (F.col(rank) + F.col("first_")).cast("long"))
        .drop("bucket_", "first_")
    )


def pack_in_order(cut: DataFrame, patterns: list[tuple[int, list[tuple[int, int]]]], rows: int) -> DataFrame:
    """Places of the pieces ``cut`` by their place_: the n-th of ``times`` sequences of a pattern stands at (n + 1/2) / times of the way."""
    spark = cut.sparkSession
    total = sum(times for times, _ in patterns)
    runs = [(p, a, min(a + RANK_BUCKET, times) - 1, times) for p, (times, _) in enumerate(patterns) for a in range(0, times, RANK_BUCKET)]
    of = spark.createDataFrame(runs, "pattern int, a long, b long, times long").select("pattern", "times", F.explode(F.sequence("a", "b")).alias("n"))
    of = of.select("pattern", ((F.col("n") + 0.5) / F.col("times")).alias("way"), F.lit(0).alias("one"))
    parts = max(1, -(-total // RANK_BUCKET))
    of = ranked(of, "one", ["way", "pattern"], "sequence_id", total, F.floor(F.col("way") * parts)).select("pattern", "sequence_id")
    of = written(of, "sequences")
    combos = []
    for p, (_, combo) in enumerate(patterns):
        at = 0
        for length, k in combo:
            combos.append((p, length, k, at))
            at += length * k
    slots = of.join(spark.createDataFrame(combos, "pattern int, length long, k int, at long"), "pattern")
    slots = slots.select("length", "sequence_id", F.posexplode(F.sequence(F.lit(1), "k")).alias("j", "one"), "at")
    slots = slots.select("length", "sequence_id", (F.col("at") + F.col("j") * F.col("length")).alias("offset"))
    slots = ranked(slots, "length", ["sequence_id", "offset"], "rank_", rows, F.floor(F.col("sequence_id") / RANK_BUCKET))
    placed = ranked(cut, "length", ["place_", "doc_id", "piece"], "rank_", rows, F.floor(F.col("place_") / RANK_BUCKET))
    return placed.join(slots, ["length", "rank_"]).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def pack(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str = TOKENIZER, place: str | None = None) -> DataFrame:
    """Places of all pieces: doc_id, piece, start, length, ids_crc32, sequence_id, offset; in the order of the column ``place``, if given."""
    cut = written(pieces(docs, capacity, tokenizer, place), "pieces")
    histogram = {r.length: r["count"] for r in cut.groupBy("length").count().collect()}  # at most capacity rows
    if place:
        return pack_in_order(cut, bin_patterns(histogram, capacity), sum(histogram.values()))
    keys, first_seq, in_one, first_at = [], [], [], []
    seq, taken = 0, dict.fromkeys(histogram, 0)
    for times, combo in bin_patterns(histogram, capacity):
        at = 0
        for length, k in combo:
            keys.append((length << 44) + taken[length])
            first_seq.append(seq)
            in_one.append(k)
            first_at.append(at)
            taken[length] += times * k
            at += length * k
        seq += times
    order = np.argsort(np.array(keys, np.int64), kind="stable")
    starts, seqs, many, offsets = (np.array(x, np.int64)[order] for x in (keys, first_seq, in_one, first_at))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = (b.column(c).to_numpy() for c in ("length", "rank_"))
            run = np.searchsorted(starts, (length << 44) + rank, side="right") - 1
            nth = (length << 44) + rank - starts[run]
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:5], pa.array(seqs[run] + nth // many[run]), pa.array(offsets[run] + nth % many[run] * length)],
                [*b.schema.names[:5], "sequence_id", "offset"],
            )

    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    rows = ranked(cut, "length", ["doc_id", "piece"], "rank_", sum(histogram.values())).select(*names, "rank_")
    schema = T.StructType([*cut.select(names).schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return rows.mapInArrow(place, schema)
