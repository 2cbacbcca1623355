"""Exact substring deduplication with suffix arrays.

A byte is removed if a ``LENGTH``-byte string covers it that also starts in a document with a
smaller doc_id. Which suffixes have to be sorted is found first. Every window of LENGTH bytes
has an owner, the GRAM bytes inside it with the least hash; the windows in a row with one
owner form a run, and equal windows have equal owners. For each run a document sends 32 bits
of its owner and 40 bits of a digest of its bytes to the owner's bucket, a batch each
different pair once, for its first document. Runs that equal an earlier document's are
settled so. Only where an owner has different runs does the first document of each send its
bytes, to shards by owner.

In a shard a suffix array is refined by Larsson and Sadakane's method (groups that are already
single are left alone, the others are sorted by the rank of what follows) until LENGTH bytes
are told apart; Kasai's common prefixes, in lanes, mark the groups of equal windows, and each
group's least document decides. Shards of one bucket are merged by binary search of one's
windows among the other's.

Documents equal to one with a smaller doc_id are settled by their digest.

Defined cases: null text is empty; null doc_ids come last and are smaller than none; rows
with equal doc_ids do not remove each other; an empty table gives an empty result; other
columns are ignored; texts shorter than LENGTH are kept.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import key_groups, slices, written

LENGTH, GRAM = 50, 24
#: Text bytes that are hashed at once, whose runs are sent together, and of a bucket (about); bytes of a shard's contexts.
BATCH_BYTES, SEND_BYTES, BUCKET_BYTES, SHARD_BYTES = 2 << 20, 16 << 20, 16 << 20, 2 << 20
#: Sub-buckets that the contexts of a bucket are dealt to.
CONTEXT_SPLIT = 16
POSITION_BITS = np.uint64(30)
BASE = 0x5851F42D4C957F2D


def words_at(buf: np.ndarray) -> np.ndarray:
    """The little-endian 64-bit word at each byte of ``buf`` but the last seven."""
    return np.ndarray((max(len(buf) - 7, 0),), "<u8", buffer=buf, strides=(1,))


def gram_hashes(buf: np.ndarray, gram: int = GRAM) -> np.ndarray:
    w, n = words_at(buf), max(len(buf) - gram + 1, 0)
    h = np.zeros(n, np.uint64)
    for k, at in enumerate(range(0, gram - 7, 8)):
        h ^= w[at : at + n] * np.uint64(0x9E3779B97F4A7C15 + 2 * 0x1F123BB5159A55E5 * k & (1 << 64) - 1)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def owners(texts: list[bytes], length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """For runs of windows with one owner: its hash, the text's number, first and last window start, a digest.

    Starts are positions in the text. Of equal hashes the leftmost owns a window. The digest,
    40 bits, is of all bytes that the run's windows cover.
    """
    sizes = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(sizes)
    buf = np.frombuffer(b"".join(texts) + bytes(8), np.uint8)
    total = int(ends[-1]) if len(ends) else 0
    none = np.zeros(0, np.int64)
    if total < length:
        return none.astype(np.uint64), none, none, none, none.astype(np.uint64)
    h = gram_hashes(buf[: total + 8], gram)[: total - gram + 1]
    low = np.uint64((1 << int(POSITION_BITS)) - 1)
    least, span, width = (h & ~low) | np.arange(len(h), dtype=np.uint64), 1, length - gram + 1
    while 2 * span <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if width > span:
        least = np.minimum(least[: len(least) - (width - span)], least[width - span :])
    owner = (least & low).astype(np.int64)
    start = np.concatenate([np.arange(a, b - length + 1) for a, b in zip(ends - sizes, ends) if b - a >= length] or [none])
    if not len(start):
        return none.astype(np.uint64), none, none, none, none.astype(np.uint64)
    own, of = owner[start], np.searchsorted(ends, start, side="right")
    new = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]) | (of[1:] != of[:-1])]))
    last = np.append(new[1:], len(start)) - 1
    base = (ends - sizes)[of[new]]
    low_at, high_at = start[new], start[last] + length
    return h[own[new]], of[new], low_at - base, start[last] - base, run_digests(buf, low_at, high_at)


@lru_cache(1)
def powers(mega: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse for so many times 2**20 positions."""
    return tuple(np.cumprod(np.full(mega << 20, x, np.uint64)) for x in (BASE, pow(BASE, -1, 1 << 64)))


def run_digests(buf: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """40-bit digests of the slices [first, end): polynomials modulo 2**64 from prefix sums."""
    n = len(buf)
    byte = np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    byte ^= byte >> np.uint64(31)
    with np.errstate(over="ignore"):
        power, inverse = (x[:n] for x in powers(n // (1 << 20) + 1))
        prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(byte[buf] * power)])
        d = (prefix[end] - prefix[first]) * inverse[first] + (end - first).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        d ^= d >> np.uint64(32)
        d *= np.uint64(0xBF58476D1CE4E5B9)
    return d >> np.uint64(24)


def run_names(key: np.ndarray, digest: np.ndarray) -> np.ndarray:
    """A 64-bit name of each run, told apart from its own document's other runs."""
    return (key * np.uint64(0x9E3779B97F4A7C15)) ^ (digest * np.uint64(0xC2B2AE3D27D4EB4F))


def refined_suffixes(text: np.ndarray, depth: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array and ranks of ``text`` with regard to the first ``depth`` bytes of each suffix."""
    n = len(text)
    first = words_at(np.concatenate([text, np.zeros(8, np.uint8)]))[:n].byteswap()
    sa = np.argsort(first)
    slot = np.arange(n)
    new = np.concatenate([[True], first[sa][1:] != first[sa][:-1]])
    rank = np.zeros(n + depth, np.int64) - 1
    rank[sa] = np.maximum.accumulate(np.where(new, slot, 0))
    done = 8
    while done < depth:
        step = min(done, depth - done)
        single = new & np.append(new[1:], True)
        at = np.flatnonzero(~single)
        if not len(at):
            break
        pos = sa[at]
        key = rank[pos] * (n + 1) + rank[pos + step] + 1
        order = np.argsort(key)
        sa[at], key = pos[order], key[order]
        new[at] = np.concatenate([[True], key[1:] != key[:-1]])
        group = np.maximum.accumulate(np.where(new[at], at, 0))
        rank[sa[at]] = group  # all ranks were read before
        done += step
    return sa, rank[:n]


def common_prefixes(text: np.ndarray, sa: np.ndarray, cap: int = LENGTH, lanes: int = 4096) -> np.ndarray:
    """Kasai's common prefix of each suffix with the one before it in ``sa``, up to ``cap``.

    Runs of text positions are walked side by side; a run's prefix is one shorter at least at
    its next position, and grows by comparing eight bytes at a time. Suffixes that are equal up
    to ``cap`` stand in any order, so after such a prefix the next one begins at 0.
    """
    n = len(text)
    at = np.empty(n, np.int64)
    at[sa] = np.arange(n)
    w = words_at(np.concatenate([text, np.zeros(cap + 8, np.uint8)]))
    out = np.zeros(n, np.int64)
    run = -(-n // lanes)
    first = np.arange(0, n, run)
    h = np.zeros(len(first), np.int64)
    for k in range(run):
        i = first + k
        live = i < n
        i, h = i[live], h[live]
        first = first[live]
        slot = at[i]
        j = sa[slot - 1]
        go = np.flatnonzero((slot > 0) & (h < cap))
        while len(go):
            x = w[i[go] + h[go]] ^ w[j[go] + h[go]]
            same = np.where(x == 0, 8, np.bitwise_count((x & (~x + np.uint64(1))) - np.uint64(1)) >> 3)
            h[go] += same
            go = go[(x == 0) & (h[go] < cap)]
        h = np.minimum(np.minimum(h, cap), n - np.maximum(i, j))
        h[slot == 0] = 0
        out[slot] = h
        h = np.where(h < cap, np.maximum(h - 1, 0), 0)
    return out


def window_groups(contexts: list[bytes], length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Start of every window in the joined contexts, and the number of its group of equal windows.

    Groups are numbered in the order of their bytes.
    """
    sizes = np.array([len(c) for c in contexts], np.int64)
    text = np.frombuffer(b"".join(contexts), np.uint8)
    sa, _ = refined_suffixes(text, length)
    group = np.cumsum(common_prefixes(text, sa, length) < length)
    of = np.empty(len(text), np.int64)
    of[sa] = group
    many = sizes - length + 1
    start = np.repeat(np.cumsum(sizes) - sizes - (np.cumsum(many) - many), many) + np.arange(many.sum())
    return start, of[start]


def least_documents(contexts: list[bytes], docs: np.ndarray, length: int = LENGTH, shard: int = SHARD_BYTES) -> list[np.ndarray]:
    """For each context the least document of each of its windows, over all contexts.

    Contexts are cut into shards of bounded size; the sorted windows of a shard are merged
    into those so far by binary search.
    """
    sizes = np.cumsum([len(c) for c in contexts])
    cuts = [0, *np.searchsorted(sizes, np.arange(shard, sizes[-1], shard), side="left").tolist(), len(contexts)]
    shards = []
    windows, least = np.zeros(0, f"S{length + 1}"), np.zeros(0, np.int64)
    for a, b in zip(cuts, cuts[1:]):
        if a == b:
            continue
        own = contexts[a:b]
        start, group = window_groups(own, length)
        many = np.array([len(c) - length + 1 for c in own])
        order = np.argsort(group)
        heads = np.flatnonzero(np.concatenate([[True], group[order][1:] != group[order][:-1]]))
        low = np.minimum.reduceat(np.repeat(docs[a:b], many)[order], heads)
        number = np.empty(len(start), np.int64)
        number[order] = np.repeat(np.arange(len(heads)), np.diff(np.append(heads, len(start))))
        shards.append((number, many, low, None))
        if len(cuts) > 2:
            text = b"".join(own)
            mine = np.array([text[s : s + length] + b"\x01" for s in start[order[heads]]], windows.dtype)  # else zero bytes at the end are lost
            shards[-1] = (number, many, low, mine)
            at = np.searchsorted(windows, mine)
            known = np.flatnonzero(at < len(windows))
            known = known[windows[at[known]] == mine[known]]
            least[at[known]] = np.minimum(least[at[known]], low[known])
            rest = np.setdiff1d(np.arange(len(mine)), known)
            windows, least = np.insert(windows, at[rest], mine[rest]), np.insert(least, at[rest], low[rest])
    out = []
    for number, many, low, mine in shards:
        if mine is not None:
            low = least[np.searchsorted(windows, mine)]
        out += np.split(low[number], np.cumsum(many)[:-1])
    return out


def batches_of_texts(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[tuple[list[bytes], list[list]]]:
    """Texts as bytes, and other columns, of about BATCH_BYTES at a time."""
    texts: list[bytes] = []
    rest: list[list] = [[] for _ in columns]
    size = 0
    for part in slices(batches):
        for text, *other in zip(part.column("t").to_pylist(), *(part.column(c).to_pylist() for c in columns)):
            texts.append(text if isinstance(text, bytes) else text.encode("utf-8"))
            size += len(texts[-1])
            for held, x in zip(rest, other):
                held.append(x)
            if size >= BATCH_BYTES:
                yield texts, rest
                texts, rest, size = [], [[] for _ in columns], 0
    if texts:
        yield texts, rest


def groups_by(key: np.ndarray, *values: np.ndarray) -> Iterator[tuple]:
    """(key, values...) for each different key, in order."""
    order = np.argsort(key)
    cuts = np.flatnonzero(np.concatenate([[True], key[order][1:] != key[order][:-1]])) if len(key) else []
    for a, b in zip(cuts, [*cuts[1:], len(key)]):
        yield key[order[a]], *(v[order[a:b]] for v in values)


def owner_keys(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of each owner, and 32 more bits of its hash."""
    wide = np.uint64(buckets)
    return (hashes % wide) << np.uint64(32) | (hashes // wide) & np.uint64(0xFFFFFFFF)


LAST = 2**63 - 1


def planes(x: np.ndarray) -> bytes:
    """The array's first bytes, then its second bytes and so on: like bytes together compress better."""
    return x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()


def from_planes(data: bytes, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).view(kind).ravel()


def told_runs(texts: DataFrame, buckets: int) -> DataFrame:
    """who, last, covered, wanted (binaries of run names): runs that an earlier document has, and those whose bytes are needed.

    ``texts`` has who, last and t. A document is known by ``who``, its doc_id, or, where that is
    null and it comes last, a hash.
    """
    sent_names = ["bucket", "who", "last", "covered", "table", "lasts", "key", "low", "high", "row"]
    sent_types = "bucket long, who long, last boolean, covered binary, table binary, lasts binary, key binary, low binary, high binary, row binary"
    kinds_of = {"table": "<i8", "lasts": "?", "key": "<u4", "low": "<u4", "high": "u1", "row": "<u4"}
    schema = pa.schema([("bucket", pa.int64()), ("who", pa.int64()), ("last", pa.bool_()), ("covered", pa.binary()), *((k, pa.binary()) for k in kinds_of)])

    def rows_of(key: np.ndarray, digest: np.ndarray, of: np.ndarray, who: np.ndarray, last: np.ndarray) -> pa.RecordBatch:
        rank = np.where(last, LAST, who)
        order = np.lexsort((of, rank[of], digest, key))
        key, digest, of = key[order], digest[order], of[order]
        first = np.ones(len(key), bool)
        first[1:] = (key[1:] != key[:-1]) | (digest[1:] != digest[:-1])
        leader = np.maximum.accumulate(np.where(first, np.arange(len(key)), 0))
        later = rank[of] > rank[of[leader]]
        rows: list[dict] = []
        for r, k in groups_by(of[later], run_names(key[later], digest[later])):
            rows.append({"bucket": int(who[r] % buckets), "who": int(who[r]), "last": bool(last[r]), "covered": k.tobytes()})
        # documents without an id come last together: each of them has to be told, so each sends its runs
        first |= last[of] & ~later & np.append(True, of[1:] != of[:-1])
        key, digest, of = key[first], digest[first], of[first]
        cuts = np.searchsorted(key >> np.uint64(32), np.arange(buckets + 1, dtype=np.uint64))
        for bucket, (a, b) in enumerate(zip(cuts, cuts[1:])):
            if b > a:
                here, row = np.unique(of[a:b], return_inverse=True)
                parts = (who[here], last[here], key[a:b], digest[a:b], digest[a:b] >> np.uint64(32), row)
                rows.append({"bucket": bucket} | {c: planes(np.ascontiguousarray(x.astype(k))) for (c, k), x in zip(kinds_of.items(), parts)})
        return pa.RecordBatch.from_pylist(rows, schema)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = count = 0
        for texts, (who, last) in batches_of_texts(batches, ["who", "last"]):
            hashes, of, _, _, digest = owners(texts)
            held.append((owner_keys(hashes, buckets), digest, of + count, np.array(who, np.int64), np.array(last, bool)))
            size, count = size + sum(map(len, texts)), count + len(texts)
            if size >= SEND_BYTES:
                yield rows_of(*map(np.concatenate, zip(*held)))
                held, size, count = [], 0, 0
        if held:
            yield rows_of(*map(np.concatenate, zip(*held)))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in key_groups(batches, ["bucket"]):
            out: list[tuple] = []
            parts = []
            bucket = np.uint64(group.column("bucket")[0].as_py()) << np.uint64(32)
            for who, last, covered, *data in zip(*(group.column(c).to_pylist() for c in sent_names[1:])):
                if covered is not None:
                    out.append((who, last, covered, None))
                    continue
                table, lasts, key, low, high, row = (from_planes(x, k) for x, k in zip(data, kinds_of.values()))
                parts.append((key, low.astype(np.uint64) | high.astype(np.uint64) << np.uint64(32), table[row], lasts[row]))
            if parts:
                key, digest, who, last = (np.concatenate(c) for c in zip(*parts))
                rank = np.where(last, LAST, who)
                order = np.lexsort((who, rank, digest, key))
                key, digest, who, last, rank = (x[order] for x in (key, digest, who, last, rank))
                new_key = np.concatenate([[True], key[1:] != key[:-1]])
                first = new_key.copy()
                first[1:] |= digest[1:] != digest[:-1]
                leader = np.maximum.accumulate(np.where(first, np.arange(len(key)), 0))
                covered = rank > rank[leader]
                heads = np.flatnonzero(new_key)
                kinds = np.repeat(np.add.reduceat(first.astype(np.int64), heads), np.diff(np.append(heads, len(key))))
                tell = covered | ((first | last) & (kinds > 1))
                name = run_names(bucket | key.astype(np.uint64), digest)
                both = who ^ (last * np.int64(0x5BD1E995 << 31))
                for _, w, z, k, c in groups_by(both[tell], who[tell], last[tell], name[tell], covered[tell]):
                    out.append((int(w[0]), bool(z[0]), k[c].tobytes(), k[~c].tobytes()))
            columns = zip(*out) if out else [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int64(), pa.bool_(), pa.binary(), pa.binary()])], ["who", "last", "covered", "wanted"])

    sent = texts.mapInArrow(send, sent_types)
    return sent.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(ask, "who long, last boolean, covered binary, wanted binary")


def spans_of(row: np.ndarray, start: np.ndarray, end: np.ndarray) -> Iterator[tuple]:
    """(row, starts, ends) for each row: the union of its spans, as sorted spans that do not touch. Spans of a row have rising ends."""
    order = np.lexsort((start, row))
    row, start, end = row[order], start[order], end[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (start[1:] > end[:-1])
    head = np.flatnonzero(new)
    last = np.append(head[1:], len(row)) - 1
    row, start, end = row[head], start[head], end[last] if len(head) else end
    cuts = np.flatnonzero(np.append(True, row[1:] != row[:-1])) if len(row) else []
    for a, b in zip(cuts, [*cuts[1:], len(row)]):
        yield row[a], start[a:b], end[a:b]


def among(name: np.ndarray, of: np.ndarray, told: list[list[bytes | None]]) -> np.ndarray:
    """Which runs, named ``name`` and of text ``of``, their own text's lists of names hold."""
    joined = [b"".join(x for x in lists if x) for lists in told]
    text = np.repeat(np.arange(len(joined), dtype=np.uint64), [len(x) // 8 for x in joined])
    mix = np.uint64(0x9FB21C651E98DF25)
    return np.isin(name ^ of.astype(np.uint64) * mix, np.frombuffer(b"".join(joined), np.uint64) ^ text * mix)


def shared_spans(texts: DataFrame, buckets: int, length: int = LENGTH) -> DataFrame:
    """row_key, starts, ends (binary, 64-bit numbers): spans of windows of each text that start in an earlier document.

    ``texts`` has row_key, rank, z (the compressed text), covered and wanted (lists of binaries).
    """
    names = ["bucket", "row_key", "rank", "first", "context", "starts", "ends"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts, (rows, ranks, covered, wanted) in batches_of_texts(unpacked(batches), ["row_key", "rank", "covered", "wanted"]):
            hashes, of, low, high, digest = owners(texts)
            key = owner_keys(hashes, buckets)
            name = run_names(key, digest)
            out: list[list] = [[] for _ in names]

            def add(*row: object) -> None:
                for col, x in zip(out, row):
                    col.append(x)

            is_covered, is_wanted = (among(name, of, told) for told in (covered, wanted))
            for k, x, y in spans_of(of[is_covered], low[is_covered], high[is_covered] + length):
                add(rows[k] % (buckets * CONTEXT_SPLIT), rows[k], None, None, None, x.tobytes(), y.tobytes())
            for i in np.flatnonzero(is_wanted).tolist():
                k = of[i]
                add(int(key[i] >> np.uint64(32)) * CONTEXT_SPLIT + int(key[i]) % CONTEXT_SPLIT, rows[k], ranks[k], int(low[i]), texts[k][low[i] : high[i] + length], None, None)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names)

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in key_groups(batches, ["bucket"]):
            done = group.filter(pa.compute.is_valid(group.column("starts"))).select(["row_key", "starts", "ends"])
            yield from done.to_batches()
            group = group.filter(pa.compute.is_null(group.column("starts")))
            if not group.num_rows:
                continue
            rank, row, first = (group.column(c).to_numpy() for c in ("rank", "row_key", "first"))
            least = least_documents(group.column("context").to_pylist(), rank, length)
            many = np.array([len(x) for x in least])
            covered = np.concatenate(least) < np.repeat(rank, many)
            at = np.repeat(first - (np.cumsum(many) - many), many) + np.arange(many.sum())
            found = [(int(r), x.tobytes(), y.tobytes()) for r, x, y in spans_of(np.repeat(row, many)[covered], at[covered], at[covered] + length)]
            columns = zip(*found) if found else ([], [], [])
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int64(), pa.binary(), pa.binary()])], ["row_key", "starts", "ends"])

    sent = texts.mapInArrow(send, "bucket long, row_key long, rank long, first long, context binary, starts binary, ends binary")
    return sent.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(decide, "row_key long, starts binary, ends binary")


def packed(texts: DataFrame) -> DataFrame:
    """row_key, rank and z: texts compressed for the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3).compress
        for part in slices(batches):
            z = pa.array([press(t.encode("utf-8")) for t in part.column("t").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([part.column("row_key"), part.column("rank"), z], ["row_key", "rank", "z"])

    return texts.select("row_key", "rank", "t").mapInArrow(run, "row_key long, rank long, z binary")


def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches with z as the text t again, as bytes."""
    expand = zstandard.ZstdDecompressor().decompress
    for part in slices(batches):
        yield part.append_column("t", pa.array([expand(z) for z in part.column("z").to_pylist()], pa.binary())).drop_columns(["z"])


def uncovered(text: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[bytes, int, int]:
    """The bytes outside the spans, how many are inside, and how many maximal runs those form."""
    step = np.zeros(len(text) + 1, np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, ends, -1)
    inside = np.cumsum(step[:-1]) > 0
    runs = int(inside[0]) + int((inside[1:] & ~inside[:-1]).sum()) if len(inside) else 0
    return np.frombuffer(text, np.uint8)[~inside].tobytes(), int(inside.sum()), runs


def removed_spans(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Written tables: rows with their sizes and first copy, and the spans (row_key, starts, ends) of first copies."""
    row_key = F.xxhash64("doc_id", "text")
    texts = docs.select(
        "doc_id", row_key.alias("row_key"), F.col("doc_id").isNull().alias("last"),
        F.coalesce(F.col("doc_id").cast("long"), row_key).alias("who"), F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("rank"),
        F.coalesce("text", F.lit("")).alias("t"),
    )
    narrow = written(texts.select("doc_id", "row_key", "who", "last", "rank", F.octet_length("t").cast("long").alias("n_bytes"), F.sha2("t", 256).alias("digest")), "sizes")
    copies = written(narrow.groupBy("digest").agg(F.min("rank").alias("least")), "digests")
    rows = written(narrow.join(copies, "digest"), "rows")
    total = narrow.agg(F.sum("n_bytes")).first()[0] or 0
    buckets = max(12, -(-total // BUCKET_BYTES))
    told = told_runs(texts.select("who", "last", "t"), buckets)
    firsts = rows.where("rank = least").select("who", "last", "row_key").distinct()
    told = written(told.join(firsts, ["who", "last"]).groupBy("row_key").agg(F.collect_list("covered").alias("covered"), F.collect_list("wanted").alias("wanted")), "told")
    spans = shared_spans(packed(texts).join(told, "row_key").select("row_key", "rank", "z", "covered", "wanted"), buckets)
    return rows, written(spans.groupBy("row_key").agg(F.collect_list("starts").alias("starts"), F.collect_list("ends").alias("ends")), "spans")


def deduplicate(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each row."""
    rows, spans = removed_spans(docs)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in unpacked(batches):
            out = []
            for text, starts, ends in zip(*(part.column(c).to_pylist() for c in ("t", "starts", "ends"))):
                kept, n, runs = uncovered(text, *(np.frombuffer(b"".join(x), np.int64) for x in (starts, ends)))
                out.append((n, runs, hashlib.sha256(kept).hexdigest()))
            yield pa.RecordBatch.from_arrays([part.column("row_key"), *(pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.string())))], ["row_key", "removed", "runs", "sha"])

    schema = T.StructType([T.StructField("row_key", T.LongType()), T.StructField("removed", T.LongType()), T.StructField("runs", T.LongType()), T.StructField("sha", T.StringType())])
    texts = docs.select(F.xxhash64("doc_id", "text").alias("row_key"), F.lit(0).cast("long").alias("rank"), F.coalesce("text", F.lit("")).alias("t"))
    found = packed(texts).join(spans, "row_key").select("row_key", "z", "starts", "ends").mapInArrow(cut, schema).dropDuplicates(["row_key"])
    copy = (F.col("rank") > F.col("least")) & (F.col("n_bytes") >= length)
    return rows.join(written(found, "cuts"), "row_key", "left").select(
        "doc_id", "n_bytes",
        F.when(copy, F.col("n_bytes")).otherwise(F.coalesce("removed", F.lit(0))).alias("n_removed"),
        F.when(copy, F.lit(1)).otherwise(F.coalesce("runs", F.lit(0))).cast("long").alias("n_spans"),
        F.when(copy, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("sha", "digest")).alias("kept_sha256"),
    )
