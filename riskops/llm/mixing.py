"""Mixing sources to target weights by Pfair scheduling.

A source's documents, in a pseudo-random order, are cut into blocks. Of a source with weight
w, block j (from 1) is released at slot floor((j-1)/w) and due at slot ceil(j/w); in each
slot the released block with the earliest deadline runs. The weights sum to one, so all
deadlines are met, and at every slot each source has had its weight's share of the slots to
within less than one block.

Releases and deadlines follow from the weights as exact fractions, over all blocks there are.
The blocks are scheduled one after the other by one task that holds the next block of each
source and steps over empty slots, a step for each ``block_docs`` documents; the rows then
look up their block's slot in a join. With a ``period``, weights are rounded to multiples of
1/period instead, and the schedule of one period repeats. A source that has run out leaves
its slots empty, and the others go on in the same proportions; no document is dropped or
repeated.

Defined cases: rows with a null source form a source of their own; a source without a target
weight gets 1/period, or 1/LEAST of the others' sum without a period; repeated rows, null ids and null texts keep their
rows; ties in the order go by doc_id, then text; an empty table gives an empty result;
other columns stay as they are.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from fractions import Fraction
from math import lcm

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, written
from .packing import ranked

BLOCK_DOCS, LEAST, TEMPER = 32, 4096, 0.7


def shares(weights: dict, period: int) -> dict:
    """Slots of a period for each source: its weight's share, rounded by largest remainder, 1 at least."""
    total = sum(weights.values())
    exact = {s: w / total * period for s, w in weights.items()}
    slots = {s: max(1, int(x)) for s, x in exact.items()}
    order = sorted(exact, key=lambda s: (int(exact[s]) - exact[s], str(s)))
    k = 0
    while (left := period - sum(slots.values())) != 0:
        s = order[k % len(order)] if left > 0 else max(slots, key=lambda s: (slots[s], str(s)))
        slots[s] += 1 if left > 0 else -1
        k += 1
    return slots


def schedule(slots: dict) -> list[tuple]:
    """Earliest deadline first over one period: (source, block, slot, release, deadline), blocks from 0."""
    period = sum(slots.values())
    waiting = sorted((j * period // n, -(-(j + 1) * period // n), str(s), j, s) for s, n in slots.items() for j in range(n))
    ready: list[tuple] = []
    out, at = [], 0
    for slot in range(period):
        while at < len(waiting) and waiting[at][0] <= slot:
            release, deadline, name, j, s = waiting[at]
            heapq.heappush(ready, (deadline, name, j, release, at))
            at += 1
        deadline, _, j, release, k = heapq.heappop(ready)
        out.append((waiting[k][4], j, slot, release, deadline))
    return out


def exact(weights: dict) -> dict:
    """Whole numbers in exactly the proportions of the weights; a source without one has 1/LEAST of the sum."""
    parts = {s: Fraction(w) for s, w in weights.items()}
    total = sum(parts.values())
    parts = {s: x or (total or 1) / LEAST for s, x in parts.items()}
    scale = lcm(*(x.denominator for x in parts.values()))
    return {s: int(x * scale) for s, x in parts.items()}


def timetable(shares: dict, blocks: dict) -> Iterator[tuple]:
    """Earliest deadline first over all blocks: (source, block, slot, release, deadline), blocks from 0."""
    total = sum(shares.values())

    def times(s, j: int) -> tuple[int, int]:
        return j * total // shares[s], -(-(j + 1) * total // shares[s])

    waiting = [(0, str(s), s, 0) for s, n in blocks.items() if n]  # the next block of each source, by release or else by deadline
    heapq.heapify(waiting)
    ready: list[tuple] = []
    slot = 0
    while waiting or ready:
        if not ready:
            slot = max(slot, waiting[0][0])
        while waiting and waiting[0][0] <= slot:
            _, name, s, j = heapq.heappop(waiting)
            heapq.heappush(ready, (times(s, j)[1], name, s, j))
        due, name, s, j = heapq.heappop(ready)
        yield s, j, slot, times(s, j)[0], due
        slot += 1
        if j + 1 < blocks[s]:
            heapq.heappush(waiting, (times(s, j + 1)[0], name, s, j + 1))


def exact_slots(spark, shares: dict, blocks: dict, rows: int = 1 << 14) -> DataFrame:
    """The timetable as a table: source_key, block, slot, release, due."""
    names = ["source_key", "block", "slot", "release", "due"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _ in range(batch.num_rows):  # one
                every = timetable(shares, blocks)
                while some := [x for _, x in zip(range(rows), every)]:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*some)], names)

    return written(spark.range(0, 1, 1, 1).mapInArrow(run, ", ".join(f"{c} long" for c in names)), "slots")


def mix(docs: DataFrame, weights: dict | None = None, block_docs: int = BLOCK_DOCS, period: int | None = None, temper: float = TEMPER) -> DataFrame:
    """doc_id, source, text_key, block, slot, released, deadline, mix_order for every row.

    ``weights`` maps sources to target weights; without it a source's weight is its number of
    documents to the power ``temper``. Only the counts per source come to the driver.
    ``mix_order`` sorts the rows into the mix; it has gaps where blocks are not full.
    """
    spark = docs.sparkSession
    rows = written(docs.select("doc_id", "source", F.xxhash64("text").alias("text_key"), F.xxhash64("source", F.col("source").isNull()).alias("source_key")), "sources")
    counts = {r.source_key: (r.source, r.n) for r in rows.groupBy("source_key", "source").agg(F.count("*").alias("n")).collect()}
    schema = "source_key long, nth long, per_period long, slot long, release long, due long"
    plan: list[tuple] = []
    wish = {k: (n**temper if weights is None else weights.get(s, 0.0)) for k, (s, n) in counts.items()}
    if counts and period:
        while period < 4 * len(counts):
            period *= 2
        slots = shares(wish if sum(wish.values()) else dict.fromkeys(wish, 1.0), period)
        plan = [(k, j, slots[k], at, release, due) for k, j, at, release, due in schedule(slots)]
    numbered = ranked(rows, "source_key", ["doc_id", "text_key"], "rank", sum(n for _, n in counts.values()))
    block = numbered.withColumn("block", F.floor(F.col("rank") / block_docs))
    if not period:
        timed = block.join(exact_slots(spark, exact(wish), {k: -(-n // block_docs) for k, (_, n) in counts.items()}), ["source_key", "block"])
        return timed.select(
            "doc_id", "source", "text_key", "block", "slot", F.col("release").alias("released"), F.col("due").alias("deadline"),
            (F.col("slot") * block_docs + F.pmod("rank", F.lit(block_docs))).alias("mix_order"),
        )
    n_of = spark.createDataFrame(list({(p[0], p[2]) for p in plan}), "source_key long, per_period long")
    times = spark.createDataFrame([(p[0], p[1], p[3], p[4], p[5]) for p in plan], schema.replace("per_period long, ", ""))
    timed = (
        block.join(F.broadcast(n_of), "source_key")  # a row for each source
        .withColumn("nth", F.pmod("block", "per_period"))
        .withColumn("ahead", F.floor(F.col("block") / F.col("per_period")) * period)
        .join(F.broadcast(times), ["source_key", "nth"])  # period rows
    )
    return timed.select(
        "doc_id", "source", "text_key", "block",
        (F.col("ahead") + F.col("slot")).alias("slot"),
        (F.col("ahead") + F.col("release")).alias("released"),
        (F.col("ahead") + F.col("due")).alias("deadline"),
        ((F.col("ahead") + F.col("slot")) * block_docs + F.pmod("rank", F.lit(block_docs))).alias("mix_order"),
    )


def in_mix_order(docs: DataFrame, weights: dict | None = None, block_docs: int = BLOCK_DOCS, period: int | None = None, temper: float = TEMPER) -> DataFrame:
    """The documents sorted into the mix, columns as they came: written files follow its order."""
    order = fresh("mix_order", docs.columns)
    return with_place(docs, order, weights, block_docs, period, temper).sort(order).drop(order)


def with_place(docs: DataFrame, order: str, weights: dict | None = None, block_docs: int = BLOCK_DOCS, period: int | None = None, temper: float = TEMPER) -> DataFrame:
    """The documents with their place in the mix as a new column ``order``; it depends on the set of rows alone, not on their order."""
    one, two = (fresh(c, [*docs.columns, order]) for c in ("mix_id", "mix_text"))
    place = (
        mix(docs, weights, block_docs, period, temper)
        .groupBy(F.xxhash64("doc_id", "text_key", "source").alias(one)).agg(F.min("mix_order").alias(order))
    )
    keyed = docs.withColumn(two, F.xxhash64("doc_id", F.xxhash64("text"), "source"))
    return keyed.join(place, F.col(one) == F.col(two)).drop(one, two)
