"""Guideline retrieval: chunking (G7), TF-IDF postings (G8), sparse cosine top-k
(G9 / C6), lexical fall-back (G10) and answer assembly (G11).

The index is a ``postings(source, chunk_id, term, weight)`` table.  A chunk's terms are
counted, looked up in the vocabulary and normalised inside its Arrow batch, so the only
shuffle is that of the corpus counts by term.

Top-k scores chunks where they are: a batch has all terms of its chunks, so it sums their whole
scores for all queries and returns the k best of each; nothing but those is shuffled.  Queries too
many to go to the tasks are joined to the written postings and pruned by bounds (MaxScore).  A term adds at most its query weight times its greatest
weight in a block of chunks of like norm.  The chunks that a query's rarest terms like best are
scored whole; the k-th best of them is a floor.  Terms whose bounds in a block together stay
below the floor cannot bring in a chunk of it, so only the postings of the others make
candidates, and those that can still reach the floor are scored whole.  Results are those of the full product
(``similarity``).  Top-k per query is ``row_number <= k``, which Spark plans as a WindowGroupLimit
before the shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskops.functions.exprs import spread
from riskops.session import ensure_checkpoint_dir, written

# Python's str.split() whitespace, as a class both Java regex and RE2 read the same way.
PY_SPACE = ("[\\t\\n\\x0B\\f\\r\\x1C-\\x1F \\x{0085}\\x{00A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}"
            "\\x{202F}\\x{205F}\\x{3000}]+")
# Tokens of the default TfidfVectorizer pattern (two or more word characters), portable spelling.
TOKEN_PATTERN = "[\\p{L}\\p{N}_]{2,}"
TOKEN = re.compile(r"\w{2,}")  # the same tokens in Python (letters newer than the JVM's Unicode tables aside)
SCORE_DECIMALS = 9  # ranking is done on scores rounded here, so float noise cannot reorder exact ties
CHUNK_SENTINEL = ""  # marker term that counts the chunks in the statistics pass (no token or bigram is empty)
FLOOR_POSTINGS = 2_000  # postings of a query's rarest terms that give its floor, about
FLOOR_CHUNKS = 8  # chunks scored whole for a query's floor, for each of its k
BLOCKS_AN_OCTAVE = 4  # blocks of chunks whose norms differ by a factor of 2
REST_SHARE = 0.3  # part of the floor that the terms left out may add: less makes more postings, more makes more candidates
PLAIN_POSTINGS = 50_000_000  # postings of all queries' terms up to which no bounds are made
BOUND_SLACK = 1e-9  # what rounding may take from a bound, as a part of it
BROADCAST_QUERY_TERMS = 250_000  # (query_id, term, weight) rows: about 15 MB broadcast at most
COUNTER_TERMS = 4_000_000  # counts of terms that a task holds at a time, about
SCORER_CELLS = 1_000_000  # scores, or products that add up to them, that a task forms at a time


def clean_text(c: Column) -> Column:
    """``' '.join(text.split())``: collapse whitespace runs, strip the ends."""
    return F.trim(F.regexp_replace(c, PY_SPACE, " "))


def chunk_documents(docs: DataFrame, source_col: str = "source", text_col: str = "text",
                    size: int = 500, overlap: int = 80) -> DataFrame:
    """Fixed windows of ``size`` characters advancing by ``size - overlap`` over the cleaned
    text; the last window ends at the text end.  Whole texts, generated in place (narrow).

    A text is cut once into blocks of one step; a window is a block and the start of those that
    follow it.  Work and memory are linear in the text."""
    step = size - overlap
    cleaned = clean_text(F.col(text_col))
    n = F.length(F.col("_clean"))
    count = F.greatest(F.lit(0), F.ceil((n - size) / F.lit(float(step)))).cast("int") + 1
    d = spread(docs).select(F.col(source_col).alias("source"), cleaned.alias("_clean"))
    d = d.select("source", count.alias("_count"), F.regexp_extract_all("_clean", F.lit(f"(?s).{{1,{step}}}"), 0).alias("_blocks"))
    windows = F.col("_blocks")
    for k in range(1, -(-size // step)):
        after = F.slice("_blocks", F.lit(k + 1), F.size("_blocks"))
        windows = F.zip_with(windows, after, lambda a, b: F.concat(a, F.coalesce(b, F.lit(""))))
    windows = F.transform(F.slice(windows, F.lit(1), F.col("_count")), lambda w: F.substring(w, 1, size))
    # the outer form: filters on the text or the windows' number, set by the planner below the inner one, take every step on the text again
    return d.select("source", F.posexplode_outer(windows).alias("chunk_id", "text")).where(F.col("chunk_id").isNotNull())


def bigrams_of(toks: Column) -> Column:
    """Space-joined consecutive token pairs of a token-array column."""
    pairs = F.transform(F.arrays_zip(F.slice(toks, 1, F.greatest(F.size(toks) - 1, F.lit(0))),
                                     F.slice(toks, 2, F.greatest(F.size(toks) - 1, F.lit(0)))),
                        lambda z: F.concat(z.getField("0"), F.lit(" "), z.getField("1")))
    return F.when(F.size(toks) >= 2, pairs).otherwise(F.array().cast("array<string>"))


def tokens(text: Column) -> Column:
    """Lower-cased word tokens (two or more word characters), as the default vectorizer."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN_PATTERN), 0)


def term_counts(df: DataFrame, key_cols: list[str], text_col: str = "text", ngram_max: int = 2) -> DataFrame:
    """(key..., term, tf): raw unigram + bigram counts per row (partial aggregation map-side).

    Tokens are computed once per row (a separate projection) and reused for the
    bigrams, so each text is scanned by the regex exactly once.
    """
    t = df.select(*key_cols, tokens(F.col(text_col)).alias("_toks"))
    terms = F.concat(F.col("_toks"), bigrams_of(F.col("_toks"))) if ngram_max >= 2 else F.col("_toks")
    # (the explicit not-null keeps every reader of these counts on one plan, so Spark reuses
    # the exchange instead of recounting once per branch)
    return t.select(*key_cols, F.explode(terms).alias("term")).where(F.col("term").isNotNull()) \
        .groupBy(*key_cols, "term").agg(F.count(F.lit(1)).alias("tf"))


def word_pairs(texts: list[str | None]) -> tuple[list[list[str]], np.ndarray, np.ndarray]:
    """The tokens of lower-cased texts, the text of each, and the tokens that another of their text follows."""
    found = [TOKEN.findall(t) if t else [] for t in texts]
    of = np.repeat(np.arange(len(texts)), [len(f) for f in found])
    return found, of, np.flatnonzero(of[1:] == of[:-1])


class Numbers(dict):
    """Words numbered as they come."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


class TermCounter:
    """Occurrences and texts of the different tokens and bigrams of many lower-cased texts, as numbers."""

    def __init__(self) -> None:
        self.numbers, self.parts, self.texts, self.terms = Numbers(), [], 0, 0

    def add(self, texts: list[str | None]) -> None:
        found, of, pair = word_pairs(texts)
        code = np.fromiter(map(self.numbers.__getitem__, chain.from_iterable(found)), np.int64, len(of))
        size = max(len(self.numbers), 1)
        key = np.concatenate([code, (code[pair] + 1) * size + code[pair + 1]])
        of, keys = np.concatenate([of, of[pair]]), (size + 1) * size
        both = np.sort(of * keys + key)
        df = np.unique(both[np.diff(both, prepend=-1) > 0] % keys, return_counts=True)[1]
        key, cnt = np.unique(key, return_counts=True)
        self.parts.append((key // size << 32 | key % size, cnt, df))  # in the same order
        self.texts += len(texts)
        self.terms += len(key)
        if self.terms > COUNTER_TERMS:
            self.merge()

    def merge(self) -> None:
        key, cnt, df = (np.concatenate(p) for p in zip(*self.parts))
        order = np.argsort(key, kind="stable")
        start = np.flatnonzero(np.diff(key[order], prepend=-1))
        if len(order):
            key, cnt, df = key[order][start], np.add.reduceat(cnt[order], start), np.add.reduceat(df[order], start)
        self.parts, self.terms = [(key, cnt, df)], len(key)

    def full(self) -> bool:
        return max(2 * self.terms, 4 * len(self.numbers)) > COUNTER_TERMS

    def counted(self) -> Iterator[pa.RecordBatch]:
        """(term, cnt, df), with the texts as df of CHUNK_SENTINEL; the counter starts anew."""
        names = ["term", "cnt", "df"]
        if self.texts:
            self.merge()
            words = pa.array(self.numbers, pa.string())
            (key, cnt, df), step = self.parts[0], 200_000
            for at in range(0, len(key), step):
                first, second = key[at : at + step] >> 32, key[at : at + step] & 0xFFFFFFFF
                n = np.count_nonzero(first == 0)  # single words sort first
                grams = pc.binary_join_element_wise(words.take(pa.array(first[n:] - 1)), words.take(pa.array(second[n:])), " ")
                terms = pa.concat_arrays([words.take(pa.array(second[:n])), grams])
                yield pa.RecordBatch.from_arrays([terms, pa.array(cnt[at : at + step]), pa.array(df[at : at + step])], names)
            yield pa.RecordBatch.from_arrays([pa.array([CHUNK_SENTINEL]), pa.array([0], pa.int64()), pa.array([self.texts], pa.int64())], names)
        self.__init__()


def term_statistics(chunks: DataFrame) -> DataFrame:
    """(term, cnt, df) of lower-cased texts ``t``: occurrences and chunks of every term, and the number of chunks as df of CHUNK_SENTINEL."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = TermCounter()
        for b in batches:
            counter.add(b.column("t").to_pylist())
            if counter.full():
                counter.merge()
            if counter.full():
                yield from counter.counted()
        yield from counter.counted()

    own = chunks.select("t").mapInArrow(count, "term string, cnt long, df long")
    return own.groupBy("term").agg(F.sum("cnt").alias("cnt"), F.sum("df").alias("df"))


class Weigher:
    """Tf-idf weights of texts in a vocabulary: words and, with a space between two, bigrams."""

    def __init__(self, names: list[str], idf: np.ndarray):
        self.size, self.idf = max(len(names), 1), idf
        parts = [n.split(" ") for n in names]
        self.places = {w: i for i, w in enumerate(dict.fromkeys(chain.from_iterable(parts)))}
        self.words = len(self.places) + 1
        self.single = np.full(self.words, -1)  # the last entry is for words that are not known
        pairs = []
        for i, p in enumerate(parts):
            if len(p) == 1:
                self.single[self.places[p[0]]] = i
            else:
                pairs.append((self.places[p[0]] * self.words + self.places[p[1]], i))
        self.pairs, self.pair_at = np.array(sorted(pairs) or [(-1, -1)], np.int64).T

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(text, term, weight, norm) of each term of a text, by text and term; norm is that of the text before it is normalised."""
        found, of, pair = word_pairs(texts)
        code = np.fromiter(map(self.places.get, chain.from_iterable(found), repeat(-1)), np.int64, len(of))
        pair = pair[(code[pair] >= 0) & (code[pair + 1] >= 0)]
        key = code[pair] * self.words + code[pair + 1]
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        both = self.pairs[at] == key
        term = np.concatenate([self.single[code], self.pair_at[at[both]]])
        of = np.concatenate([of, of[pair[both]]])
        key, tf = np.unique((of * self.size + term)[term >= 0], return_counts=True)
        of, term = key // self.size, key % self.size
        w = tf * self.idf[term]
        norm = np.sqrt(np.bincount(of, w * w, minlength=len(texts)))[of]
        return of, term, w / norm, norm


def vocabulary(chunks: DataFrame, max_features: int) -> DataFrame:
    """(term, df, idf) of lower-cased texts ``t``: the most frequent terms, checkpointed."""
    ensure_checkpoint_dir(chunks.sparkSession)
    # the sentinel sorts first, then the max_features most frequent terms (ties: term ascending)
    top = term_statistics(chunks).orderBy((F.col("term") == CHUNK_SENTINEL).desc(), F.col("cnt").desc(), F.col("term").asc()) \
        .limit(max_features + 1).checkpoint(eager=True)
    n_row = top.where(F.col("term") == CHUNK_SENTINEL).select("df").first()
    n_chunks = int(n_row["df"]) if n_row else 0
    return top.where(F.col("term") != CHUNK_SENTINEL).select(
        "term", "df", (F.log((F.lit(1.0) + n_chunks) / (F.lit(1.0) + F.col("df"))) + 1.0).alias("idf"))


def lowered(chunks: DataFrame) -> DataFrame:
    """(source, chunk_id, t): the lower-cased chunks, written: the vocabulary and the weights each read them."""
    return written(chunks.select("source", "chunk_id", F.lower("text").alias("t")), "chunks")


def weighed(chunks: DataFrame, vocab: DataFrame, blocks: bool = False) -> DataFrame:
    """(source, chunk_id, term, weight) of lower-cased texts ``t``."""
    known = vocab.select("term", "idf").collect()  # at most max_features rows
    shared = chunks.sparkSession.sparkContext.broadcast(([r.term for r in known], np.array([r.idf for r in known], float)))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weigher, names = Weigher(*shared.value), pa.array(shared.value[0], pa.string())
        for b in batches:
            of, term, weight, norm = weigher(b.column("t").to_pylist())
            at = pa.array(of)
            out = [b.column("source").take(at), b.column("chunk_id").take(at), names.take(pa.array(term)), pa.array(weight)]
            if blocks:
                out.append(pa.array(np.floor(BLOCKS_AN_OCTAVE * np.log2(norm)).astype(np.int32)))
            yield pa.RecordBatch.from_arrays(out, schema.names)

    schema = T.StructType([chunks.schema["source"], chunks.schema["chunk_id"], T.StructField("term", T.StringType()), T.StructField("weight", T.DoubleType())])
    if blocks:
        schema = schema.add("block", T.IntegerType())
    return chunks.mapInArrow(weigh, schema)


def tfidf_index(chunks: DataFrame, max_features: int = 12000, blocks: bool = False) -> tuple[DataFrame, DataFrame]:
    """``(postings, vocab)``.

    vocab: the ``max_features`` terms with the highest corpus count (ties: term
    ascending) with smooth idf ``ln((1+n)/(1+df)) + 1``.  postings: L2-normalised
    tf-idf weight per (chunk, term).  The vocabulary is bounded by
    ``max_features``; it is checkpointed and goes to the tasks as a dictionary.  With ``blocks``,
    postings also tell the chunk's ``block``: chunks of like norm, whose terms have like weights.
    """
    chunks = lowered(chunks)  # read twice
    vocab = vocabulary(chunks, max_features)
    return weighed(chunks, vocab, blocks), vocab


def vectorize(df: DataFrame, vocab: DataFrame, id_col: str = "query_id", text_col: str = "query") -> DataFrame:
    """Query vectors with the index vocabulary and idf (unknown terms dropped), L2-normalised."""
    tc = term_counts(df, [id_col], text_col)
    p = tc.join(F.broadcast(vocab.select("term", "idf")), "term").select(
        id_col, "term", (F.col("tf") * F.col("idf")).alias("w"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(id_col)))
    return p.select(id_col, "term", (F.col("w") / norm).alias("weight"))


def similarity(qvec: DataFrame, postings: DataFrame, id_col: str = "query_id") -> DataFrame:
    """cosine = sum over shared terms of q_w * d_w (both sides L2-normalised)."""
    q = qvec.select(id_col, "term", F.col("weight").alias("qw"))
    n_q = q.count()
    if n_q <= BROADCAST_QUERY_TERMS:
        q = F.broadcast(q)  # checked size: postings stay in place, no skewed shuffle on hot terms
    j = postings.join(q, "term")
    return j.groupBy(id_col, "source", "chunk_id").agg(F.sum(F.col("weight") * F.col("qw")).alias("score"))


def top_k(scores: DataFrame, k: int = 3, id_col: str = "query_id") -> DataFrame:
    """Best ``k`` chunks per query; ties go to the later chunk (source desc, chunk_id desc)."""
    w = Window.partitionBy(id_col).orderBy(F.round("score", SCORE_DECIMALS).desc(), F.col("source").desc(),
                                           F.col("chunk_id").desc())
    return scores.where(F.col("score") > 0).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def completed(chunks: DataFrame, qvec: DataFrame, postings: DataFrame, id_col: str) -> DataFrame:
    """(id, source, chunk_id, score) of the given (id, source, chunk_id): what all terms of ``qvec`` add up to there."""
    asked = written(chunks.select(id_col, "source", "chunk_id").join(qvec.select(id_col, "term", F.col("weight").alias("qw")), id_col), "asked")
    if asked.count() <= BROADCAST_QUERY_TERMS:
        asked = F.broadcast(asked)  # checked size: postings stay in place
    return asked.join(postings, ["source", "chunk_id", "term"]).groupBy(id_col, "source", "chunk_id").agg(F.sum(F.col("weight") * F.col("qw")).alias("score"))


def bounded_terms(qvec: DataFrame, postings: DataFrame, k: int, id_col: str = "query_id",
                  floor_postings: int = FLOOR_POSTINGS) -> DataFrame:
    """(id, term, block, qw, floor, essential, rest): each query term in each block of chunks.

    The floor is the k-th best whole score of the chunks that the query's rarest terms like best. ``rest`` is what
    the terms that are not essential in a block can add there: together they stay below REST_SHARE of the floor.
    """
    stats = written(postings.groupBy("term", "block").agg(F.max("weight").alias("top"), F.count(F.lit(1)).alias("df")), "term-bounds")  # vocabulary x blocks
    q = qvec.select(id_col, "term", F.col("weight").alias("qw"))
    by_df = Window.partitionBy(id_col).orderBy("df", "term").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rare = q.join(stats.groupBy("term").agg(F.sum("df").alias("df")), "term").withColumn("before", F.sum("df").over(by_df) - F.col("df"))
    rare = rare.where(F.col("before") < floor_postings).select(id_col, "term", F.col("qw").alias("weight"))
    w = Window.partitionBy(id_col).orderBy(F.col("score").desc(), "source", "chunk_id")
    likely = similarity(rare, postings, id_col).withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= FLOOR_CHUNKS * k)
    best = completed(likely, qvec, postings, id_col).withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= k)
    floor = best.groupBy(id_col).agg(F.when(F.count(F.lit(1)) == k, F.min("score")).alias("floor"))
    q = q.join(stats.select("term", "block", "top"), "term").join(floor, id_col, "left")
    q = q.withColumn("floor", F.coalesce("floor", F.lit(0.0)) * (1 - BOUND_SLACK)).withColumn("bound", F.col("qw") * F.col("top"))
    here = Window.partitionBy(id_col, "block")
    below = F.sum("bound").over(here.orderBy("bound", "term").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    q = q.withColumn("essential", below >= F.col("floor") * REST_SHARE)
    rest = F.sum(F.when(F.col("essential"), 0.0).otherwise(F.col("bound"))).over(here)
    return q.select(id_col, "term", "block", "qw", "floor", "essential", rest.alias("rest"))


def candidates(terms: DataFrame, postings: DataFrame, id_col: str = "query_id") -> DataFrame:
    """(id, source, chunk_id, part): chunks that hold an essential term and can still reach the floor, with the essential terms' score."""
    own = terms.where("essential").select(id_col, "term", "block", "qw", "floor", "rest")
    if own.count() <= BROADCAST_QUERY_TERMS:
        own = F.broadcast(own)  # checked size: postings stay in place, no skewed shuffle on hot terms
    part = postings.join(own, ["term", "block"]).groupBy(id_col, "source", "chunk_id").agg(
        F.sum(F.col("weight") * F.col("qw")).alias("part"), F.max("floor").alias("floor"), F.max("rest").alias("rest"))
    return part.where(F.col("part") + F.col("rest") >= F.col("floor")).select(id_col, "source", "chunk_id", "part")


def pruned_top_k(qvec: DataFrame, postings: DataFrame, k: int = 3, id_col: str = "query_id",
                 floor_postings: int = FLOOR_POSTINGS, plain_postings: int = PLAIN_POSTINGS) -> DataFrame:
    """``top_k(similarity(...))`` without scoring chunks that cannot be among the best; ``postings`` is read several times.

    A product of at most ``plain_postings`` postings is cheaper than its bounds and is formed whole; the rows are the same.
    """
    many = qvec.select("term").join(postings.groupBy("term").count(), "term").agg(F.sum("count")).first()[0] or 0
    if many <= plain_postings:
        return top_k(similarity(qvec, postings, id_col), k, id_col)
    terms = written(bounded_terms(qvec, postings, k, id_col, floor_postings), "query-terms")
    found = candidates(terms, postings, id_col)
    return top_k(completed(found, qvec, postings, id_col), k, id_col)


class BatchScorer:
    """The best chunks of a batch for each query, from query vectors (query number, term number, weight) sorted by term."""

    def __init__(self, query: np.ndarray, term: np.ndarray, weight: np.ndarray, queries: int, terms: int, k: int):
        self.query, self.weight, self.queries, self.k = query, weight, queries, k
        self.first = np.searchsorted(term, np.arange(terms + 1))
        self.floor = np.zeros(queries)  # of the batches before: the k-th best score, rounded

    def __call__(self, of: np.ndarray, term: np.ndarray, weight: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(chunk, query, score) from the chunks' postings in order of the chunk; ``place`` is a chunk's rank among ties.

        Whole scores, a few chunks at a time: as many as have SCORER_CELLS scores or products.
        """
        n = self.first[term + 1] - self.first[term]  # queries that ask for each posting
        cost = np.maximum(np.bincount(of, n, minlength=len(place)), self.queries)
        part = (np.cumsum(cost) // SCORER_CELLS)
        cuts = np.append(np.flatnonzero(np.diff(part, prepend=-1)), len(place))
        ends = np.searchsorted(of, cuts)
        kept = [self.some(a, b, of[i:j], term[i:j], weight[i:j], n[i:j], place) for a, b, i, j in zip(cuts, cuts[1:], ends, ends[1:])]
        chunk, query, score = (np.concatenate(c) for c in zip(*kept))
        at = self.best(chunk, query, score, place)
        return chunk[at], query[at], score[at]

    def some(self, a: int, b: int, of: np.ndarray, term: np.ndarray, weight: np.ndarray, n: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        posting = np.repeat(np.arange(len(of)), n)
        entry = np.arange(len(posting)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.first[term], n)
        cell = (of[posting] - a) * self.queries + self.query[entry]
        score = np.bincount(cell, weight[posting] * self.weight[entry], minlength=(b - a) * self.queries).reshape(b - a, self.queries)
        chunk, query = np.nonzero((score > 0) & (np.round(score, SCORE_DECIMALS) >= self.floor))
        score = score[chunk, query]
        at = self.best(chunk + a, query, score, place)
        return chunk[at] + a, query[at], score[at]

    def best(self, chunk: np.ndarray, query: np.ndarray, score: np.ndarray, place: np.ndarray) -> np.ndarray:
        """The rows of each query's k best; they raise its floor."""
        if not len(query):
            return np.zeros(0, np.int64)
        rounded = np.round(score, SCORE_DECIMALS)
        order = np.lexsort((place[chunk], -rounded, query))
        query = query[order]
        start = np.flatnonzero(np.diff(query, prepend=-1))
        rank = np.arange(len(query)) - np.repeat(start, np.diff(start, append=len(query)))
        last = order[rank == self.k - 1]
        self.floor[query[rank == self.k - 1]] = np.maximum(self.floor[query[rank == self.k - 1]], rounded[last])
        return order[rank < self.k]


def scored_in_place(chunks: DataFrame, vocab: DataFrame, qvec: DataFrame, k: int, id_col: str = "query_id") -> DataFrame:
    """(id, source, chunk_id, score): of lower-cased chunks, at least the ``k`` best of each query, in whole scores.

    A chunk has all its terms in its batch, so its scores for all queries are summed there: no posting is
    written or shuffled, and a batch returns its ``k`` best chunks of a query.  ``qvec`` goes to the tasks: the caller bounds it.
    """
    spark = chunks.sparkSession
    known = vocab.select("term", "idf").collect()  # at most max_features rows
    number = {r.term: i for i, r in enumerate(known)}
    asked = qvec.select(id_col, "term", F.col("weight").cast("double")).toArrow().combine_chunks()
    ids = asked.column(0).combine_chunks().dictionary_encode(null_encoding="encode") if len(asked) else None
    if ids is None:
        return spark.createDataFrame([], T.StructType([qvec.schema[id_col], chunks.schema["source"], chunks.schema["chunk_id"], T.StructField("score", T.DoubleType())]))
    term = np.array([number[t] for t in asked.column(1).to_pylist()], np.int64)
    order = np.argsort(term, kind="stable")
    query, weight = ids.indices.to_numpy()[order].astype(np.int64), asked.column(2).to_numpy()[order]
    shared = spark.sparkContext.broadcast((list(number), np.array([r.idf for r in known], float), ids.dictionary, query, term[order], weight))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, idf, ids, query, term, weight = shared.value
        weigher = Weigher(names, idf)
        scorer = BatchScorer(query, term, weight, len(ids), len(names), k)
        for b in batches:
            if not b.num_rows:
                continue
            of, terms, weights, _ = weigher(b.column("t").to_pylist())
            place = np.empty(b.num_rows, np.int64)
            later = pc.sort_indices(b.select(["source", "chunk_id"]), sort_keys=[("source", "descending"), ("chunk_id", "descending")])
            place[later.to_numpy()] = np.arange(b.num_rows)
            chunk, q, s = scorer(of, terms, weights, place)
            at = pa.array(chunk)
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(q)), b.column("source").take(at), b.column("chunk_id").take(at), pa.array(s)], schema.names)

    schema = T.StructType([qvec.schema[id_col], chunks.schema["source"], chunks.schema["chunk_id"], T.StructField("score", T.DoubleType())])
    return chunks.mapInArrow(score, schema)


def rag_topk(queries: DataFrame, chunks: DataFrame, k: int = 3, id_col: str = "query_id", text_col: str = "query",
             max_features: int = 12000, in_place: int = BROADCAST_QUERY_TERMS) -> DataFrame:
    """Top-k chunks per query by tf-idf cosine; zero-score chunks are never returned.

    Up to ``in_place`` query terms go to the chunks' tasks; the postings of more are pruned by bounds.
    Rows of one (source, chunk_id) count as one chunk: those that repeat are added up from their postings.
    """
    chunks = lowered(chunks)
    vocab = vocabulary(chunks, max_features)
    qv = written(vectorize(queries, vocab, id_col, text_col), "query-vectors")
    if qv.count() > in_place:
        return pruned_top_k(qv, written(weighed(chunks, vocab, blocks=True), "postings"), k, id_col)
    again = written(chunks.groupBy("source", "chunk_id").count().where("count > 1").drop("count"), "repeated")
    if not again.take(1):
        return top_k(scored_in_place(chunks, vocab, qv, k, id_col), k, id_col)
    again = again.select(F.col("source").alias("_source"), F.col("chunk_id").alias("_chunk"))
    same = F.col("source").eqNullSafe(F.col("_source")) & F.col("chunk_id").eqNullSafe(F.col("_chunk"))
    alone = scored_in_place(chunks.join(again, same, "left_anti"), vocab, qv, k, id_col)
    return top_k(alone.unionByName(similarity(qv, weighed(chunks.join(again, same, "left_semi"), vocab), id_col)), k, id_col)


def _anchored_tokens(q: Column) -> Column:
    """Query tokens with a non-word character on both sides inside the query text.

    Any document containing the whole query contains such a token as a whole
    token, so they are exact candidate keys for the substring count.
    """
    w = "[\\p{L}\\p{N}_]"
    nw = "[^\\p{L}\\p{N}_]"
    return F.regexp_extract_all(q, F.lit(f"(?<={nw})({w}{{2,}})(?={nw})"), 1)


_RUN, _NOT_RUN = "[\\p{L}\\p{N}_]+", "[^\\p{L}\\p{N}_]"


def _unanchored_candidates(q: DataFrame, d: DataFrame, id_col: str) -> DataFrame:
    """(query, source) candidates for queries whose words may be parts of longer words.

    A document that contains the query has a word that contains the query's longest word, so
    that is looked up among the *different* words of the corpus first, by its first (up to)
    three letters in an index of all letter groups of those words.  A query without words is
    keyed on its first character.
    """
    words = d.select("source", F.explode(F.array_distinct(F.regexp_extract_all("t", F.lit(_RUN), 0))).alias("word"))
    runs = F.transform(F.regexp_extract_all("q", F.lit(_RUN), 0), lambda r: F.struct(F.length(r).alias("n"), r.alias("part")))
    q = q.where(F.length("q") > 0).withColumn("part", F.array_max(runs)["part"])

    def groups(n: int) -> Column:
        starts = F.sequence(F.lit(1), F.length("word"))
        return F.filter(F.transform(starts, lambda i: F.substr(F.col("word"), i, F.lit(n))), lambda g: F.length(g) == n)

    index = words.select("word").distinct().select("word", F.explode(F.array_distinct(F.concat(groups(1), groups(2), groups(3)))).alias("key"))
    asked = q.where("part is not null").select(id_col, "part", F.substring("part", 1, 3).alias("key"))
    found = asked.join(index, "key").where(F.contains("word", "part")).select(id_col, "word")
    signs = d.select("source", F.explode(F.array_distinct(F.regexp_extract_all("t", F.lit(_NOT_RUN), 0))).alias("key"))
    bare = q.where("part is null").select(id_col, F.substring("q", 1, 1).alias("key"))
    return words.join(found, "word").select(id_col, "source").union(signs.join(bare, "key").select(id_col, "source")).distinct()


def rag_lexical(queries: DataFrame, docs: DataFrame, k: int = 3, id_col: str = "query_id", text_col: str = "query",
                source_col: str = "source", doc_text_col: str = "text") -> DataFrame:
    """Number of whole-query occurrences in each document (case-insensitive), top-k.

    Candidates come from an inverted index keyed on the query's *rarest*
    anchored token (a document containing the query must contain every
    anchored token as a whole token), so frequent words never fan a query out
    to the whole corpus and no query x document pairs are formed; the exact
    substring count then runs on the candidates only.  A query without
    anchored tokens (one or two bare words, or signs alone) is looked up among
    the corpus's different words.  Documents with a zero count are not
    returned, nor is anything for an empty query.
    """
    q = queries.select(id_col, F.lower(F.col(text_col)).alias("q")).withColumn("_keys", F.array_distinct(_anchored_tokens(F.col("q"))))
    d = spread(docs).select(F.col(source_col).alias("source"), F.lower(F.col(doc_text_col)).alias("t"))
    dt = d.select("source", F.explode(F.array_distinct(F.regexp_extract_all("t", F.lit(TOKEN_PATTERN), 0))).alias("tok"))
    tok_df = dt.groupBy("tok").agg(F.count(F.lit(1)).alias("df"))
    qk = q.select(id_col, F.explode("_keys").alias("tok"))
    # a key token absent from every document -> no document can contain the query
    present = qk.join(tok_df, "tok", "left").groupBy(id_col).agg(
        F.min(F.struct(F.coalesce(F.col("df"), F.lit(0)).alias("df"), F.col("tok"))).alias("_best"))
    keys = present.where(F.col("_best.df") > 0).select(id_col, F.col("_best.tok").alias("tok"))
    cand = dt.join(keys, "tok").select(id_col, "source")
    cand = cand.union(_unanchored_candidates(q.where(F.size("_keys") == 0).select(id_col, "q"), d, id_col))
    full = cand.join(q.select(id_col, "q"), id_col).join(d, "source")
    cnt = ((F.length("t") - F.length(F.replace(F.col("t"), F.col("q"), F.lit("")))) / F.length("q")).cast("long")
    scored = full.select(id_col, "source", cnt.alias("score")).where(F.col("score") > 0)
    w = Window.partitionBy(id_col).orderBy(F.col("score").desc(), F.col("source").asc())
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


# Answer texts of the service.
NO_DOCS_ANSWER = "No guideline documents found. Please add trusted clinical guidance to the docs folder."
DEFAULT_DRIVERS = "the reported symptoms"


def found_chunks(topk: DataFrame, docs: DataFrame) -> DataFrame:
    """The chunks of the documents that ``topk`` names: the others are not cut again."""
    return chunk_documents(docs.join(topk.select("source").distinct(), "source", "left_semi"))


def rag_answer(topk: DataFrame, chunks: DataFrame, queries: DataFrame, id_col: str = "query_id",
               drivers: Column | None = None) -> DataFrame:
    """Answer from the best chunk's first 300 characters plus the sources list
    ``name (score=0.123)`` in rank order; queries without hits get the fixed no-docs answer."""
    t = topk.join(chunks.select("source", "chunk_id", "text"), ["source", "chunk_id"])
    snippet = F.regexp_replace(F.regexp_replace(F.substring("text", 1, 300), f"^{PY_SPACE}|{PY_SPACE}$", ""), "\n", " ")
    per = t.select(id_col, "rank", F.when(F.col("rank") == 1, snippet).alias("_snip"),
                   F.concat(F.col("source"), F.lit(" (score="), F.format_string("%.3f", F.col("score")), F.lit(")"))
                   .alias("_src"))
    agg = per.groupBy(id_col).agg(
        F.max("_snip").alias("snippet"),
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "_src"))), lambda s: s["_src"]).alias("sources"))
    q = queries.select(id_col, (drivers if drivers is not None else F.lit(None).cast("string")).alias("_drivers"))
    j = q.join(agg, id_col, "left")
    drv = F.coalesce(F.when(F.col("_drivers") != "", F.col("_drivers")), F.lit(DEFAULT_DRIVERS))
    answer = F.when(F.col("snippet").isNull(), F.lit(NO_DOCS_ANSWER)).otherwise(
        F.concat(F.lit("Based on the available guidelines and "), drv, F.lit(", consider the following: "),
                 F.col("snippet")))
    return j.select(id_col, answer.alias("answer"),
                    F.coalesce(F.col("sources"), F.array().cast("array<string>")).alias("sources"))


def assess_chat(guided: DataFrame, docs: DataFrame, id_col: str = "message_id", k: int = 3) -> DataFrame:
    """G12 end to end: (id, guidance, sources) of each triaged message with its guidance query.

    Messages with the same factors and context ask the same question, so each different question
    is answered once and the answers are joined back.  A question without hits in the index goes
    to the lexical search.  Crisis messages get the fixed emergency text and no sources.
    """
    ask = F.array_distinct("risk_factors")
    asked = guided.select(id_col, "actionable", F.col("guidance_query").alias("query"), F.concat_ws(", ", ask).alias("drivers"))
    questions = asked.where(F.col("query").isNotNull()).select(F.col("query").alias("query_id"), "query", "drivers").distinct()
    found = written(rag_topk(questions, chunk_documents(docs), k), "found")  # k rows a question, read four times
    answers = rag_answer(found, found_chunks(found, docs), questions, drivers=F.col("drivers"))
    unmet = questions.join(found.select("query_id").distinct(), "query_id", "left_anti")
    lexical = rag_lexical(unmet, docs, k)
    texts = lexical.join(docs.select("source", "text"), "source")
    plain = rag_answer_lexical(texts, unmet)
    both = answers.join(unmet.select("query_id"), "query_id", "left_anti").unionByName(plain)
    joined = asked.join(both.withColumnRenamed("query_id", "query"), "query", "left")
    return joined.select(
        id_col, F.concat(F.coalesce("answer", F.lit("")), "actionable").alias("guidance"),
        F.coalesce("sources", F.array().cast("array<string>")).alias("sources"))


def rag_answer_lexical(texts: DataFrame, queries: DataFrame) -> DataFrame:
    """G11 over lexical hits (query_id, rank, source, text): their sources carry no score."""
    snippet = F.replace(F.regexp_replace(F.substring("text", 1, 300), f"^{PY_SPACE}|{PY_SPACE}$", ""), F.lit("\n"), F.lit(" "))
    hits = texts.groupBy("query_id").agg(
        F.max(F.when(F.col("rank") == 1, snippet)).alias("snippet"),
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "source"))), lambda s: s["source"]).alias("sources"))
    drivers = F.when(F.col("drivers") != "", F.col("drivers")).otherwise(F.lit(DEFAULT_DRIVERS))
    answer = F.when(F.col("snippet").isNull(), F.lit(NO_DOCS_ANSWER)).otherwise(
        F.concat(F.lit("Based on the available guidelines and "), drivers, F.lit(", consider the following: "), F.col("snippet")))
    return queries.join(hits, "query_id", "left").select(
        "query_id", answer.alias("answer"), F.coalesce("sources", F.array().cast("array<string>")).alias("sources"))
