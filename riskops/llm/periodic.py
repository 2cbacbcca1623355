"""Periodic runs of words, by branching tandem tests on an enhanced suffix array.

Words are numbered per batch of whole documents; each document ends in a separator, and
suffixes are sorted by document first, so nothing is compared across documents. The suffix
array is refined by doubling, where only suffixes that are not yet alone are sorted again; the
ranks of all rounds give the common prefixes. For each LCP interval of depth q, found from the
next smaller values (no tree nodes are made), the suffixes of all children but the largest ask the inverse
array whether i + q or i - q lies in the interval but in another child. If so, a branching
square of period q begins at i or i - q: the last square of its run. Rotating it to the left
while the word a period on agrees gives the run; squares of one stretch merge, and the least
period is the stretch's own.

With a least exponent k a run of period q has k suffixes with a common prefix of q words, so
smaller intervals are left out.

Defined cases: null and empty texts have no words and no runs; rows are judged one by one, so
repeated rows give equal results and null doc_ids are like any other; an empty table gives an empty result; other
columns are ignored; a long text is a batch of its own, held as numbers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tokens import by_bytes

#: A run has at least so many words and so many periods.
LEAST_WORDS, LEAST_EXPONENT = 6, 4
#: Text bytes of a batch, about; a longer text is a batch of its own.
BATCH_BYTES = 2 << 20
#: Words that all squares are rotated by side by side; beyond it each goes on alone, by growing steps.
ROTATE_TOGETHER = 24


def suffix_array(words: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Suffix array, inverse and common prefixes with the suffix before.

    ``words`` are numbers from 1 on, 0 ends each document; ``doc`` rises. Suffixes of one
    document stand together.
    """
    n = len(words)
    bits = max(int(words.max()).bit_length(), 1)
    take = max(1, min(4, (63 - int(doc[-1]).bit_length()) // bits))
    ahead = np.concatenate([words, np.zeros(take, np.int64)])
    key = doc.astype(np.int64)
    for k in range(take):
        key = key << bits | ahead[k : k + n]
    sa = np.argsort(key, kind="stable")
    sorted_key = key[sa]
    new = np.concatenate([[True], sorted_key[1:] != sorted_key[:-1]])
    # common prefixes of those that the first words part, without the document's bits
    differ = sorted_key.copy()
    differ[1:] ^= sorted_key[:-1]
    lcp = np.zeros(n, np.int64)
    for k in range(1, take):
        lcp += (differ >> (bits * (take - k))) == 0
    lcp[0] = 0
    slot = np.arange(n)
    rank = np.empty(n, np.int64)
    rank[sa] = np.maximum.accumulate(np.where(new, slot, 0))
    # a round's ranks tell suffixes apart by their first `depth` words
    levels, depth = [(take, rank)], take
    at = np.flatnonzero(~(new & np.append(new[1:], True)))
    while len(at):
        rank = levels[-1][1]
        pos = sa[at]
        group, after = rank[pos], rank[pos + depth]
        order = np.lexsort((after, group))
        sa[at] = pos = pos[order]
        group, after = group[order], after[order]
        parted = np.concatenate([[False], (group[1:] == group[:-1]) & (after[1:] != after[:-1])])
        cut = np.flatnonzero(parted)
        lcp[at[cut]] = depth + prefixes(words, levels, pos[cut - 1] + depth, pos[cut] + depth)
        new[at[cut]] = True
        rank = rank.copy()
        rank[pos] = np.maximum.accumulate(np.where(new[at], at, 0))
        depth *= 2
        levels.append((depth, rank))
        at = at[~(new[at] & np.append(new, True)[at + 1])]
    isa = np.empty(n, np.int64)
    isa[sa] = slot
    return sa, isa, lcp


def prefixes(words: np.ndarray, levels: list[tuple[int, np.ndarray]], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Common prefixes of suffixes that the last level tells apart: the greater halves first, then single words."""
    out = np.zeros(len(a), np.int64)
    for depth, rank in reversed(levels):
        out += np.where(rank[a + out] == rank[b + out], depth, 0)
    same = np.ones(len(a), bool)
    for _ in range(levels[0][0] - 1):
        same &= words[a + out] == words[b + out]
        out += same
    return out


def nearest_below(values: np.ndarray, at: np.ndarray, side: int) -> np.ndarray:
    """For each slot of ``at`` the nearest slot on one side (-1 or 1) whose value is smaller; -1 or n if none.

    Blocks of doubling width are skipped while their least value is not smaller, then ever smaller ones.
    """
    n = len(values)
    least = [np.concatenate([[-1], values, [-1]])]  # least[t][k]: of the 2**t values from k on, going to the side
    own, place = values[at], at + 1 + side
    climbed = np.zeros(len(at), np.int64)
    todo = np.arange(len(at))
    while len(todo):
        t = len(least) - 1
        todo = todo[least[t][place[todo]] >= own[todo]]
        place[todo] += side << t
        climbed[todo] = t + 1
        half, wide = 1 << t, np.full(n + 2, -1)
        if half < n + 2:
            if side > 0:
                wide[:-half] = np.minimum(least[t][:-half], least[t][half:])
            else:
                wide[half:] = np.minimum(least[t][half:], least[t][:-half])
        least.append(wide)
    for t in range(len(least) - 1, -1, -1):
        go = np.flatnonzero(climbed > t)
        go = go[least[t][place[go]] >= own[go]]
        place[go] += side << t
    return place - 1


def branching_squares(sa: np.ndarray, isa: np.ndarray, lcp: np.ndarray, least: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """(start, period) of every branching square whose interval has ``least`` suffixes at least."""
    none = np.zeros(0, np.int64)
    at = np.flatnonzero(lcp > 0)
    if not len(at):
        return none, none
    left, right = nearest_below(lcp, at, -1), nearest_below(lcp, at, 1)  # the interval is [left, right)
    keep = right - left >= least
    at, left, right = at[keep], left[keep], right[keep]
    if not len(at):
        return none, none
    depth = lcp[at]
    # slots of one interval: equal left end and depth, so also equal right end
    order = np.lexsort((at, depth, left))
    at, left, right, depth = at[order], left[order], right[order], depth[order]
    head = np.concatenate([[True], (left[1:] != left[:-1]) | (depth[1:] != depth[:-1])])
    heads = np.flatnonzero(head)
    tail = np.append(head[1:], True)
    # children: from the interval's left end to its first slot, then from each slot to the next one or the end
    low = np.concatenate([at, left[heads]])
    high = np.concatenate([np.where(tail, right, np.append(at[1:], 0)), at[heads]])
    of = np.concatenate([np.cumsum(head) - 1, np.arange(len(heads))])
    size = high - low
    order = np.lexsort((size, of))
    small = np.ones(len(order), bool)
    small[np.flatnonzero(np.append(of[order][1:] != of[order][:-1], True))] = False  # the largest child asks nothing
    child = order[small]
    low, high, of, size = low[child], high[child], of[child], size[child]
    many = size.sum()
    member = np.repeat(low - (np.cumsum(size) - size), size) + np.arange(many)
    child = np.repeat(np.arange(len(size)), size)
    first, end, q = left[heads][of][child], right[heads][of][child], depth[heads][of][child]
    i = sa[member]
    starts, periods = [], []
    for other, start in ((i + q, i), (i - q, i - q)):
        there = isa[np.clip(other, 0, len(isa) - 1)]
        found = (other >= 0) & (there >= first) & (there < end) & ((there < low[child]) | (there >= high[child]))
        starts.append(start[found])
        periods.append(q[found])
    start, period = np.concatenate(starts), np.concatenate(periods)
    _, one = np.unique(np.stack([start, period]), axis=1, return_index=True) if len(start) else (None, none)
    return start[one], period[one]


def rotated(words: np.ndarray, begin: np.ndarray, start: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Where the runs begin: each square moves left while the word before it equals the one a period on."""
    at = start.copy()
    live = np.flatnonzero(at > begin)
    for _ in range(ROTATE_TOGETHER):
        before = at[live] - 1
        live = live[words[before] == words[before + period[live]]]
        at[live] -= 1
        live = live[at[live] > begin[live]]
        if not len(live):
            return at
    for k in live.tolist():
        p, to, low, step = int(period[k]), int(at[k]), int(begin[k]), 64
        while to > low:
            a = max(low, to - step)
            differ = np.flatnonzero(words[a:to] != words[a + p : to + p])
            if len(differ):
                to = a + int(differ[-1]) + 1
                break
            to, step = a, step * 2
        at[k] = to
    return at


def runs(words: np.ndarray, ends: np.ndarray, least_words: int = LEAST_WORDS, least_exponent: int = LEAST_EXPONENT) -> tuple[np.ndarray, ...]:
    """(document, start in it, length, period) of all runs, by document, start and period.

    ``words`` holds the documents' word numbers, from 1 on, each document followed by a 0;
    ``ends`` are the places behind those.
    """
    none = np.zeros(0, np.int64)
    if not words.any():
        return none, none, none, none
    doc = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
    begins = np.concatenate([[0], ends[:-1]])
    sa, isa, lcp = suffix_array(words, doc)
    lcp[begins] = 0
    start, period = branching_squares(sa, isa, lcp, max(2, least_exponent))
    of = doc[start]
    end = start + 2 * period
    start = rotated(words, begins[of], start, period)
    length = end - start
    keep = length >= np.maximum(least_words, least_exponent * period)
    of, start, length, period = of[keep], start[keep], length[keep], period[keep]
    order = np.lexsort((period, length, start))
    of, start, length, period = of[order], start[order], length[order], period[order]
    own = np.concatenate([[True], (start[1:] != start[:-1]) | (length[1:] != length[:-1])]) if len(of) else np.zeros(0, bool)  # else the period is a multiple
    of, start, length, period = of[own], start[own], length[own], period[own]
    order = np.lexsort((period, start))
    of, start, length, period = of[order], start[order], length[order], period[order]
    return of, start - begins[of], length, period


def numbered(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The different words, the documents' word numbers with a 0 behind each, and the places behind those."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    flat = lists.flatten().cast(pa.large_binary())
    of = pc.list_parent_indices(lists).to_numpy()
    real = pc.greater(pc.binary_length(flat), 0)
    coded = flat.filter(real).dictionary_encode()
    of = of[real.to_numpy(zero_copy_only=False)]
    many = np.bincount(of, minlength=len(texts))
    ends = np.cumsum(many + 1)
    words = np.zeros(int(ends[-1]) if len(ends) else 0, np.int64)
    words[np.arange(len(of)) + of] = coded.indices.to_numpy().astype(np.int64) + 1
    return coded.dictionary, words, ends


FIELDS = "n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


def find(docs: DataFrame, least_words: int = LEAST_WORDS, least_exponent: int = LEAST_EXPONENT, text: str = "text") -> DataFrame:
    """doc_id, n_words, the runs of each text by start and period, and the text without what they repeat.

    A word goes if a run holds it behind the run's first period; the others are joined by one space.
    """
    docs = docs.select("doc_id", F.col(text).alias("text"))

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_bytes(batches, size=BATCH_BYTES):
            known, words, ends = numbered(b.column("text"))
            of, start, length, period = runs(words, ends, least_words, least_exponent)
            begins = np.concatenate([[0], ends[:-1]])
            change = np.zeros(len(words) + 1, np.int64)
            np.add.at(change, begins[of] + start + period, 1)
            np.add.at(change, begins[of] + start + length, -1)
            kept = (np.cumsum(change[:-1]) == 0) & (words > 0)
            where = np.flatnonzero(kept)
            many = np.bincount(np.searchsorted(ends, where, side="right"), minlength=len(ends))
            left = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(many)]), pa.int32()), known.take(pa.array(words[where] - 1)).cast(pa.string()))
            found = pa.StructArray.from_arrays([pa.array(start), pa.array(length), pa.array(period)], ["start", "length", "period"])
            cuts = np.searchsorted(of, np.arange(len(ends) + 1))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(np.diff(ends, prepend=0) - 1), pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), found), pc.binary_join(left, " ")],
                ["doc_id", "n_words", "runs", "collapsed"],
            )

    schema = T.StructType([docs.schema["doc_id"], *T._parse_datatype_string(FIELDS).fields])
    return docs.mapInArrow(part, schema)


def digest(found: DataFrame) -> DataFrame:
    """doc_id, n_runs, the longest run (ties: smallest start, then period) and digests of all runs and of the text that is left."""
    # the smallest of (-length, start, period) is the longest run
    top = F.array_min(F.transform("runs", lambda r: F.struct((-r.length).alias("a"), r.start.alias("b"), r.period.alias("c"))))
    lines = F.concat_ws("", F.transform("runs", lambda r: F.format_string("%d,%d,%d\n", r.start, r.length, r.period)))
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), top.alias("top"), lines.alias("lines"), "collapsed").select(
        "doc_id", "n_runs", F.col("top.b").alias("start"), (-F.col("top.a")).alias("length"), F.col("top.c").alias("period"),
        F.floor(-1000 * F.col("top.a") / F.col("top.c")).cast("long").alias("exponent_milli"),
        F.sha2("lines", 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def planted(doc_id: str = "doc_id", text: str = "text") -> Column:
    """The text, in which a tenth of the documents repeat a stretch of theirs to the end: by the CRC-32 h of the decimal doc_id.

    If h mod 10 is 0, each word from a = g mod n on becomes word a + (i - a) mod p, with
    g = h div 10 and p = 1 + (n - a) div (3 + g mod 8).
    """
    h = F.crc32(F.col(doc_id).cast("string"))
    g = F.floor(h / 10)
    words = F.array_remove(F.split(text, "[\\x20\\x09-\\x0D]+"), "")
    n = F.size(words)
    a = (g % n).cast("int")
    p = (F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))).cast("int")
    stretch = F.slice(words, a + 1, p)
    again = F.slice(F.flatten(F.array_repeat(stretch, (F.ceil((n - a) / p)).cast("int"))), F.lit(1), n - a)
    return F.when((h % 10 == 0) & (n > 0), F.array_join(F.concat(F.slice(words, F.lit(1), a), again), " ")).otherwise(F.col(text))
