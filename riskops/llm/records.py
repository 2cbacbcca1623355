"""Token ids as length-delimited binary records, with a separate offset index for shuffled reads.

A shard file is a row of frames and nothing else. A frame is, in little-endian order: the
payload's length in bytes (8 bytes), the masked CRC-32C of those eight bytes (4), the payload,
the masked CRC-32C of the payload (4). A payload is one document's sequence: the bytes of an
id, 2 or 4, plus 1 if the doc_id is not null (4), the doc_id (8), the number of ids (4), the
ids, and zeros up to a multiple of 4 bytes. Ids take 2 bytes if the vocabulary allows. Readers
of the common record format that uses this framing can read the files.

Documents are sorted into shards by ranges of (doc_id, hash of the text). A task encodes its
shard, writes it beside its final name in the shared folder and then renames it, so a task that
is run twice leaves the same file. The offset index is a Parquet table (``INDEX``) beside the
files. A sequential read streams a shard; a shuffled read takes index rows in a seeded order
and seeks.

Defined cases: null text is empty (its sequence is the end id alone); null doc_ids come last;
rows of equal doc_id stand in the order of their text's hash, then text; an empty table gives
no files, an index without rows and an empty result; other columns are ignored. Any mismatch
of a length or checksum is an error that names the file.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskops.session import scratch_path

from .tokens import by_bytes, word_tokens

TOKENIZER = "word_bpe_49k.json"
END_ID = 1
#: Text bytes of a shard, about, and the most shards; a larger corpus has larger shards.
SHARD_BYTES, MOST_SHARDS = 32 << 20, 100_000
#: Bytes that a sequential read holds at a time (or one frame).
READ_BYTES = 8 << 20
#: Shard files that a shuffled read keeps open.
OPEN_FILES = 64
#: Words of 32 bits before the payload, of it before the ids, and after it.
HEAD_WORDS, OWN_WORDS, TAIL_WORDS = 3, 4, 1
#: Reflected polynomial of CRC-32C and the mask of stored checksums (fixed values of the format).
POLYNOMIAL, MASK_DELTA = 0x82F63B78, 0xA282EAD8
#: 32-bit words of a lane; lanes of a record are checked side by side.
LANE_WORDS = 64

INDEX = "shard int, record int, doc_id long, offset long, length long, n_tokens long"


@lru_cache(1)
def crc_tables() -> tuple[np.ndarray, ...]:
    """What the low and the high half of a state become after one word of zeros, and after a lane of zeros."""
    one = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        one = np.where(one & 1, (one >> 1) ^ np.uint32(POLYNOMIAL), one >> 1).astype(np.uint32)

    def word(state: np.ndarray) -> np.ndarray:
        for _ in range(4):
            state = one[state & np.uint32(255)] ^ (state >> np.uint32(8))
        return state

    half = np.arange(1 << 16, dtype=np.uint32)
    low, high = word(half), word(half << np.uint32(16))
    lane_low, lane_high = half, half << np.uint32(16)
    for _ in range(LANE_WORDS):
        lane_low, lane_high = word(lane_low), word(lane_high)
    return low, high, lane_low, lane_high


def advance(state: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    return low[state & np.uint32(0xFFFF)] ^ high[state >> np.uint32(16)]


def masked_crc32c(words: np.ndarray, first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Masked CRC-32C of each slice ``words[first : first + count]`` of 32-bit words (``count`` of 1 or more).

    A slice is cut into lanes, the first one filled with zeros in front, which leave a state
    of zero as it is. All lanes run side by side; then each slice's lanes are joined.
    """
    low, high, lane_low, lane_high = crc_tables()
    lanes = -(-count // LANE_WORDS)
    ends = np.cumsum(lanes)
    grid = np.zeros((int(ends[-1]) if len(ends) else 0) * LANE_WORDS, np.uint32)
    to = ends * LANE_WORDS - count  # where a slice begins in the grid
    n = np.cumsum(count)
    at = np.arange(n[-1] if len(n) else 0)
    grid[at + np.repeat(to - (n - count), count)] = words[at + np.repeat(first - (n - count), count)]
    grid[to] ^= np.uint32(0xFFFFFFFF)
    grid = np.ascontiguousarray(grid.reshape(-1, LANE_WORDS).T)
    part = np.zeros(grid.shape[1], np.uint32)
    for row in grid:
        part = advance(part ^ row, low, high)
    order = np.argsort(-lanes, kind="stable")
    start, left = (ends - lanes)[order], lanes[order]
    state = np.zeros(len(lanes), np.uint32)
    for k in range(int(left[0]) if len(left) else 0):
        live = int(np.searchsorted(-left, -k, side="left"))  # those with more than k lanes
        state[:live] = advance(state[:live], lane_low, lane_high) ^ part[start[:live] + k]
    crc = np.empty_like(state)
    crc[order] = ~state
    return ((crc >> np.uint32(15)) | (crc << np.uint32(17))) + np.uint32(MASK_DELTA)


def frames(doc_ids: pa.Array, ids: np.ndarray, ends: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """All frames as 32-bit words, and the words of each; ``ends`` tells where each document's ids end (with a 0 before)."""
    n = np.diff(ends)
    size = HEAD_WORDS + OWN_WORDS + -(-n * width // 4) + TAIL_WORDS
    stop = np.cumsum(size)
    at = stop - size
    out = np.zeros(int(stop[-1]) if len(stop) else 0, np.uint32)
    payload = (size - HEAD_WORDS - TAIL_WORDS) * 4
    out[at], out[at + 1] = halves(payload)
    out[at + 3] = width + doc_ids.is_valid().to_numpy(zero_copy_only=False)
    out[at + 4], out[at + 5] = halves(doc_ids.fill_null(0).to_numpy(zero_copy_only=False))
    out[at + 6] = n
    kind = np.uint16 if width == 2 else np.uint32
    out.view(kind)[np.arange(len(ids)) + np.repeat((at + HEAD_WORDS + OWN_WORDS) * (4 // width) - ends[:-1], n)] = ids
    out[at + 2] = masked_crc32c(out, at, np.full(len(at), 2))
    out[stop - 1] = masked_crc32c(out, at + HEAD_WORDS, size - HEAD_WORDS - TAIL_WORDS)
    return out, size


def halves(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    x = x.astype(np.int64).view(np.uint64)
    return (x & np.uint64(0xFFFFFFFF)).astype(np.uint32), (x >> np.uint64(32)).astype(np.uint32)


def store(uri: str):
    """File system and path of a shared folder."""
    from pyarrow import fs

    scheme, _, rest = uri.partition("://")
    return fs.FileSystem.from_uri(f"s3://{rest}" if scheme in ("s3a", "s3n") else uri)


def shard_name(shard: int) -> str:
    return f"part-{shard:06d}.records"


@dataclass
class Records:
    """Written records: ``folder`` holds the shard files in ``data`` and the offset index in ``index``."""

    spark: SparkSession
    folder: str

    @property
    def index(self) -> DataFrame:
        return self.spark.read.schema(INDEX).parquet(f"{self.folder}/index")


def write(docs: DataFrame, folder: str | None = None, tokenizer: str = TOKENIZER, end_id: int = END_ID, shard_bytes: int = SHARD_BYTES) -> Records:
    """Encode every text, append ``end_id`` and write all sequences in ascending doc_id order; ``folder`` must be shared and new."""
    spark = docs.sparkSession
    folder = folder or scratch_path(spark, f"llm/records-{uuid.uuid4().hex}")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    shards = max(1, -(-total // max(shard_bytes, -(-total // MOST_SHARDS))))
    rows = rows.withColumn("key", F.xxhash64("text"))
    order = [F.col("doc_id").asc_nulls_last(), "key"]
    rows = rows.repartitionByRange(shards, *order).sortWithinPartitions(*order, "text").select("doc_id", "text")

    def write_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, shard = word_tokens(tokenizer), TaskContext.get().partitionId()
        fs, data = store(f"{folder}/data")
        name, final, out, at, record = f"{data}/_{uuid.uuid4().hex}", f"{data}/{shard_name(shard)}", None, 0, 0
        for part in by_bytes(batches):
            ids, ends = encode(part.column("text"))
            k = np.arange(part.num_rows)
            own = np.full(len(ids) + len(k), end_id, np.uint32)
            own[np.arange(len(ids)) + np.repeat(k, np.diff(ends))] = ids
            words, size = frames(part.column("doc_id"), own, ends + np.append(0, k + 1), 2 if max(encode.size - 1, end_id) < 1 << 16 else 4)
            if out is None:
                fs.create_dir(data, recursive=True)
                out = fs.open_output_stream(name)
            out.write(words.astype("<u4").tobytes())
            stop = at + 4 * np.cumsum(size)
            many = [np.full(len(k), shard, np.int32), (record + k).astype(np.int32), part.column("doc_id"), stop - 4 * size, 4 * size, np.diff(ends) + 1]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in many], ["shard", "record", "doc_id", "offset", "length", "n_tokens"])
            at, record = int(stop[-1]), record + len(k)
        if out is not None:
            out.close()
            fs.move(name, final)

    rows.mapInArrow(write_shard, INDEX).write.parquet(f"{folder}/index")
    return Records(spark, folder)


def whole_frames(raw: bytes) -> list[int]:
    """Where the frames of ``raw`` begin that are whole, and where the last of them ends."""
    at, cuts = 0, [0]
    while at + 12 <= len(raw):
        at += int.from_bytes(raw[at : at + 8], "little") + 16
        if at > len(raw):
            break
        cuts.append(at)
    return cuts


def check(raw: bytes, cuts: list[int], name: str) -> tuple[np.ndarray, np.ndarray]:
    """The words of the frames and where each begins; raises if a length or checksum is wrong."""
    words, at = np.frombuffer(raw[: cuts[-1]], "<u4"), np.array(cuts, np.int64) // 4
    at, size = at[:-1], np.diff(at)
    if np.any(np.diff(cuts) % 4) or np.any(size < HEAD_WORDS + OWN_WORDS + TAIL_WORDS):
        raise ValueError(f"{name}: a record's length is wrong")
    if len(at) and not (np.array_equal(masked_crc32c(words, at, np.full(len(at), 2)), words[at + 2]) and np.array_equal(masked_crc32c(words, at + HEAD_WORDS, size - HEAD_WORDS - TAIL_WORDS), words[at + size - 1])):
        raise ValueError(f"{name}: a record's checksum is wrong")
    return words, at


def decoded(words: np.ndarray, at: np.ndarray) -> tuple[pa.Array, list[np.ndarray]]:
    """doc_ids and the ids of each sequence."""
    number = (words[at + 4].astype(np.uint64) | words[at + 5].astype(np.uint64) << np.uint64(32)).view(np.int64)
    kind = words[at + 3]
    by_width = {2: words.view("<u2"), 4: words}
    first = ((at + HEAD_WORDS + OWN_WORDS) * np.where(kind < 4, 2, 1)).tolist()
    ids = [by_width[w & 6][a : a + n] for w, a, n in zip(kind.tolist(), first, words[at + 6].tolist())]
    return pa.array(number, mask=kind % 2 == 0), ids


def read(records: Records) -> DataFrame:
    """One row a document, from the files in their order: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    spark, folder = records.spark, records.folder
    begins, all_before = {}, 0
    for r in sorted(records.index.groupBy("shard").agg(F.sum("n_tokens").alias("n")).collect()):  # one row a shard, a bounded number
        begins[r.shard], all_before = all_before, all_before + r.n
    shards = spark.range(0, max(begins, default=-1) + 1, 1, max(begins, default=0) + 1).select(F.col("id").cast("int").alias("shard"))

    def read_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, data = store(f"{folder}/data")
        for shard in (s for b in batches for s in b.column("shard").to_pylist() if s in begins):
            start, left = begins[shard], b""
            with fs.open_input_stream(f"{data}/{shard_name(shard)}") as file:
                want = READ_BYTES
                while more := file.read(want):
                    left += more
                    cuts = whole_frames(left)
                    # a frame longer than what is held: read the rest of it at once
                    want = READ_BYTES if len(cuts) > 1 or len(left) < 12 else max(READ_BYTES, int.from_bytes(left[:8], "little") + 16 - len(left))
                    if len(cuts) == 1:
                        continue
                    doc_id, ids = decoded(*check(left, cuts, shard_name(shard)))
                    n = np.array([len(x) for x in ids], np.int64)
                    crc = np.array([zlib.crc32(x.astype("<u4")) for x in ids], np.int64)
                    yield pa.RecordBatch.from_arrays([doc_id, *(pa.array(x) for x in (start + np.cumsum(n) - n, n, crc))], ["doc_id", "start", "n_tokens", "ids_crc32"])
                    start, left = start + int(n.sum()), left[cuts[-1] :]
            if left:
                raise ValueError(f"{shard_name(shard)}: the last record is cut off")

    return shards.mapInArrow(read_shard, "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_shuffled(records: Records, seed: int, parts: int) -> DataFrame:
    """All sequences in a seeded order, by seeks: part, place, doc_id, ids. A part's order is by hash; parts are dealt by another."""
    folder = records.folder
    mix = lambda salt: F.xxhash64(F.lit(seed), F.lit(salt), "shard", "record")
    rows = records.index.select(F.pmod(mix(1), F.lit(parts)).cast("int").alias("part"), mix(2).alias("place"), "shard", "offset", "length", "record")
    rows = rows.repartition(parts, "part").sortWithinPartitions("part", "place", "shard", "record")

    names, kinds = ["part", "place", "doc_id", "ids"], [pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64())]

    def seek(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, data = store(f"{folder}/data")
        files: dict = {}
        held: list[tuple] = []
        room = READ_BYTES
        for b in batches:
            for part, place, shard, offset, length in zip(*(b.column(c).to_pylist() for c in ("part", "place", "shard", "offset", "length"))):
                if shard not in files:
                    if len(files) >= OPEN_FILES:
                        files.pop(next(iter(files))).close()
                    files[shard] = fs.open_input_file(f"{data}/{shard_name(shard)}")
                files[shard].seek(offset)
                raw = files[shard].read(length)
                cuts = whole_frames(raw)
                if cuts != [0, length]:
                    raise ValueError(f"{shard_name(shard)}: no record at {offset}")
                doc_id, ids = decoded(*check(raw, cuts, shard_name(shard)))
                held.append((part, place, doc_id[0].as_py(), ids[0].astype(np.int64)))
                room -= length
                if room < 0:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*held), kinds)], names)
                    held, room = [], READ_BYTES
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*held), kinds)], names)

    return rows.mapInArrow(seek, "part int, place long, doc_id long, ids array<long>")
