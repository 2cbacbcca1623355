"""Toxicity by a convolutional text classifier, trained in numpy.

Words are hashed to embeddings, each the sum of a row for the word and a row for its first
``PREFIX`` letters, which its inflections share; filters of several widths run over the whole text, the
maximum of each over all positions is pooled, and a logistic layer gives the score. Training
takes every labelled row outside the held-out fifth: rows are dealt to shards by a hash of their ids, each
shard trains a copy of the shared network on its rows, and the mean of the copies' moves (of an embedding row: over the
shards that have its words) is the network of the next round. A part of the rows calibrates a threshold for each
language (the score does not know the language). Scoring needs no multiplication: embeddings times filters are tables.

Defined cases: null and empty texts are scored by the pooled bias; labels that are null or
without a document are left out, and a document's labels count once; without labels of both
kinds every score is the share of toxic ones (0 without any); null languages have a
threshold of their own; repeated rows are scored alike; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import key_groups, slices, written

FOLDS, HELD_OUT, CALIBRATION = 5, 0, 1
#: Training rows of a shard, about, and rounds of several shards; a round of full shards is one pass over all rows.
SHARD_ROWS, ROUNDS = 8000, 2
#: Embedding rows whose moves are averaged together, and steps of the log-odds that scores are told apart by for the thresholds.
BLOCK_ROWS, ODDS_STEP = 256, 0.001
#: Bits of the map of labelled ids; texts that it rules out are not shuffled.
ID_BITS = 1 << 26
#: A word's code holds the rows of the word and of its prefix, ROW_BITS each; 0 is padding.
PREFIX, ROW_BITS = 4, 15
ROWS, DIM, WIDTHS, FILTERS = 1 << ROW_BITS, 16, (1, 2, 3), 16
#: Passes over the training rows of a single shard; LEAST_STEPS batches are done at least, about, by each shard in all its rounds.
EPOCHS, LEAST_STEPS, BATCH, RATE, SEED = 6, 400, 32, 0.05, 7
#: ASCII characters other than letters and digits part words.
PARTS = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
WORD_CACHE = 500_000


class WordCodes(dict):
    """Code of a word."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > WORD_CACHE:
            self.clear()
        prefix = word.decode("utf-8", "ignore")[:PREFIX].encode()
        whole, part = (zlib.crc32(x) % (ROWS - 1) + 1 for x in (word, b"^" + prefix))
        self[word] = code = whole << ROW_BITS | part
        return code


def word_codes(text: str | None, codes: WordCodes) -> np.ndarray:
    words = (text or "").lower().encode("utf-8").translate(PARTS).split()
    return np.fromiter(map(codes.__getitem__, words), np.int32, len(words))


def fold(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS


def both(table: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """The sum of a word's two rows."""
    out = table[codes >> ROW_BITS]
    out += table[codes & (ROWS - 1)]
    return out


class Network:
    def __init__(self, seed: int = SEED):
        r = np.random.default_rng(seed)
        self.embed = (r.normal(size=(ROWS, DIM)) * 0.3).astype(np.float32)
        self.embed[0] = 0
        self.filters = [(r.normal(size=(w, DIM, FILTERS)) / np.sqrt(w * DIM)).astype(np.float32) for w in WIDTHS]
        self.bias = np.zeros((len(WIDTHS), FILTERS), np.float32)
        self.out = (r.normal(size=len(WIDTHS) * FILTERS) * 0.3).astype(np.float32)
        self.shift = np.zeros(1, np.float32)
        self.seen = [np.full_like(p, 1e-3) for p in self.parameters()]

    def parameters(self) -> list[np.ndarray]:
        return [self.embed, *self.filters, self.bias, self.out, self.shift]

    def fit(self, texts: list[np.ndarray], labels: np.ndarray, share: float, passes: int = 1, seed: int = SEED) -> "Network":
        """Logistic loss with both labels of equal weight (``share`` of all rows are toxic), AdaGrad on all parameters."""
        r = np.random.default_rng(seed)
        weight = np.where(labels == 1, 0.5 / share, 0.5 / (1 - share))
        seen = self.seen

        def move(k: int, p: np.ndarray, g: np.ndarray, at: object = ...) -> None:
            seen[k][at] += g * g
            p[at] -= RATE * g / np.sqrt(seen[k][at])

        for _ in range(passes):
            order = r.permutation(len(texts))
            for a in range(0, len(order), BATCH):
                picked = order[a : a + BATCH]
                pooled, places = self.pool([texts[i] for i in picked])
                hidden = np.maximum(pooled + self.bias.ravel(), 0)
                p = 1 / (1 + np.exp(-np.clip(hidden @ self.out + self.shift, -30, 30)))
                slope = ((p - labels[picked]) * weight[picked] / len(picked)).astype(np.float32)
                back = slope[:, None] * self.out * (hidden > 0)
                move(len(seen) - 2, self.out, hidden.T @ slope)
                move(len(seen) - 1, self.shift, slope.sum(keepdims=True))
                move(len(seen) - 3, self.bias, back.sum(0).reshape(self.bias.shape))
                rows, slopes = [], []
                for k, w in enumerate(WIDTHS):
                    b = back[:, k * FILTERS : (k + 1) * FILTERS]
                    grad = np.empty_like(self.filters[k])
                    for o in range(w):
                        at = places[k][o]  # the words at the winning positions
                        grad[o] = np.einsum("tf,tfd->df", b, both(self.embed, at))
                        rows += [(at >> ROW_BITS).ravel(), (at & (ROWS - 1)).ravel()]
                        slopes += [(b[:, :, None] * self.filters[k][o].T).reshape(-1, DIM)] * 2
                    move(1 + k, self.filters[k], grad)
                rows, slopes = np.concatenate(rows), np.concatenate(slopes)
                used, back_to = np.unique(rows, return_inverse=True)
                total = np.zeros((len(used), DIM), np.float32)
                np.add.at(total, back_to, slopes)
                total[used == 0] = 0
                move(0, self.embed, total, used)
        return self

    def pool(self, texts: list[np.ndarray]) -> tuple[np.ndarray, list[list[np.ndarray]]]:
        """Maxima of all filters for each text, and the words at which they are reached."""
        pooled = np.zeros((len(texts), len(WIDTHS) * FILTERS), np.float32)
        places = [[np.zeros((len(texts), FILTERS), np.int64) for _ in range(w)] for w in WIDTHS]
        for t, ids in enumerate(texts):
            for k, w in enumerate(WIDTHS):
                x = np.concatenate([ids, np.zeros(w - 1 if len(ids) else w, ids.dtype)])
                n = len(x) - w + 1
                v = both(self.embed, x)
                conv = sum(v[o : o + n] @ self.filters[k][o] for o in range(w))
                best = conv.argmax(axis=0)
                pooled[t, k * FILTERS : (k + 1) * FILTERS] = conv[best, np.arange(FILTERS)]
                for o in range(w):
                    places[k][o][t] = x[best + o]
        return pooled, places

    def tables(self) -> "Tables":
        return Tables([[self.embed @ f[o] for o in range(len(f))] for f in self.filters], self.bias.ravel(), self.out, float(self.shift[0]))


class Tables:
    """A trained network as tables: the product of each embedding row with each filter column."""

    def __init__(self, products: list[list[np.ndarray]], bias: np.ndarray, out: np.ndarray, shift: float):
        self.products, self.bias, self.out, self.shift = products, bias, out, shift

    def __call__(self, texts: list[np.ndarray]) -> np.ndarray:
        """Scores of whole texts; two rows of padding part them."""
        sizes = np.array([max(len(t), 1) for t in texts])
        gap = max(WIDTHS) - 1
        ends = np.cumsum(sizes + gap)
        starts = ends - sizes - gap
        x = np.zeros(ends[-1] + gap, np.int32)
        for s, t in zip(starts, texts):
            x[s : s + len(t)] = t
        pooled = []
        inside = np.zeros(ends[-1], bool)
        for s, n in zip(starts, sizes):
            inside[s : s + n] = True
        first = np.cumsum(sizes) - sizes
        for tables in self.products:
            conv = both(tables[0], x[: ends[-1]])
            for o in range(1, len(tables)):
                conv += both(tables[o], x[o : o + ends[-1]])
            pooled.append(np.maximum.reduceat(conv[inside], first, axis=0))
        hidden = np.maximum(np.concatenate(pooled, axis=1) + self.bias, 0)
        return 1 / (1 + np.exp(-np.clip(hidden @ self.out + self.shift, -30, 30).astype(float)))


class Constant:
    def __init__(self, score: float):
        self.score = score

    def __call__(self, texts: list[np.ndarray]) -> np.ndarray:
        return np.full(len(texts), self.score)


def may_be_in(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The documents whose id's bit is set in a map of ``ids`` of fixed size (2,048 rows of 4 KB at most)."""
    place = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(ID_BITS))
    bits = ids.groupBy(F.bitmap_bucket_number(place).alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("_bits"))
    bit = F.bitmap_bit_position(place)
    near = docs.withColumn("_bucket", F.bitmap_bucket_number(place)).withColumn("_bit", bit.cast("int")).join(F.broadcast(bits), "_bucket")
    return near.where("shiftright(cast(conv(hex(substring(_bits, cast(_bit div 8 as int) + 1, 1)), 16, 10) as int), _bit % 8) & 1 = 1").select(*docs.columns)


def training_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Every labelled row outside the held-out fold: doc_id, fold, lang, toxic and its word codes (``rows``)."""
    marks = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    marks = marks.withColumn("fold", fold(F.col("doc_id"))).where((F.col("fold") != HELD_OUT) & F.col("toxic").isin(0, 1))
    texts = may_be_in(docs.select("doc_id", "text", "lang").where(fold(F.col("doc_id")) != HELD_OUT), marks)
    names = texts.join(marks.hint("merge"), "doc_id").select("doc_id", "fold", "lang", "toxic", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordCodes()
        for part in slices(batches):
            rows = pa.array([word_codes(t, known).tobytes() for t in part.column("text").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("doc_id", "fold", "lang", "toxic")), rows], ["doc_id", "fold", "lang", "toxic", "rows"])

    return names.mapInArrow(run, T.StructType([*names.schema.fields[:4], T.StructField("rows", T.BinaryType())]))


def codes_of(column: pa.Array | pa.ChunkedArray) -> list[np.ndarray]:
    return [np.frombuffer(x, np.int32) for x in column.to_pylist()]


def learn(rows: DataFrame, n: int, share: float) -> Network:
    """The network of all ``n`` rows (doc_id, toxic, rows), of which ``share`` are toxic. Only the network comes to the driver."""
    shards = max(1, -(-n // SHARD_ROWS))
    rounds, passes = (1, max(EPOCHS, -(-LEAST_STEPS * BATCH // n))) if shards == 1 else (ROUNDS, max(1, round(LEAST_STEPS * BATCH * shards / (ROUNDS * n))))
    # rows of one id differ in their texts, if at all: both deal them out
    dealt = rows.select(F.pmod(F.xxhash64("doc_id", "rows"), F.lit(shards)).cast("int").alias("shard"), "doc_id", "toxic", "rows")
    # shuffled once; a task of a round reads whole shards from its files
    dealt = written(dealt.repartition("shard").sortWithinPartitions("shard"), "toxicity-shards")
    net = Network()
    for turn in range(rounds):
        start = rows.sparkSession.sparkContext.broadcast((net.parameters(), net.seen))  # of fixed size

        def train_shard(shard: int, group: pa.Table) -> pa.RecordBatch:
            group = group.sort_by([("doc_id", "ascending"), ("rows", "ascending")])
            own = Network()
            for mine, shared in zip((*own.parameters(), *own.seen), (*start.value[0], *start.value[1])):
                mine[...] = shared
            own.fit(codes_of(group.column("rows")), group.column("toxic").to_numpy().astype(float), share, passes, SEED + turn)
            after = [*own.parameters(), *own.seen]
            moved = [a - b for a, b in zip(after, (*start.value[0], *start.value[1]))]
            half = len(moved) // 2
            both_moves = np.hstack([moved[0], moved[half]])
            at = np.flatnonzero(moved[half].any(axis=1)).astype(np.int32)  # the embedding rows that were met
            out = [(-1, b"", np.concatenate([m.ravel() for m in (*moved[1:half], *moved[half + 1 :])]).tobytes())]
            for block in np.unique(at // BLOCK_ROWS):
                met = at[at // BLOCK_ROWS == block]
                out.append((int(block), met.tobytes(), both_moves[met].tobytes()))
            block, at, move = zip(*out)
            return pa.RecordBatch.from_arrays([pa.array(block, pa.int32()), pa.array([shard] * len(out), pa.int32()), pa.array(at, pa.binary()), pa.array(move, pa.binary())],
                                              ["block", "shard", "at", "move"])

        def train_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for group in key_groups(batches, ["shard"]):
                yield train_shard(group.column("shard")[0].as_py(), group)

        def average(key: tuple, group: pa.Table) -> pa.Table:
            group = group.sort_by("shard")
            at, moves = codes_of(group.column("at")), [np.frombuffer(x, np.float32) for x in group.column("move").to_pylist()]
            if key[0].as_py() < 0:
                found, mean = np.zeros(0, np.int32), np.mean(moves, axis=0, dtype=np.float64)
            else:
                found, of = np.unique(np.concatenate(at), return_inverse=True)
                total = np.zeros((len(found), 2 * DIM))
                np.add.at(total, of, np.concatenate(moves).reshape(-1, 2 * DIM))
                mean = total / np.bincount(of)[:, None]
            return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "at": pa.array([found.tobytes()], pa.binary()),
                             "move": pa.array([mean.astype(np.float32).tobytes()], pa.binary())})

        moves = dealt.mapInArrow(train_shards, "block int, shard int, at binary, move binary")
        for r in moves.groupBy("block").applyInArrow(average, "block int, at binary, move binary").collect():  # a network's size
            move = np.frombuffer(r.move, np.float32)
            if r.block < 0:
                for p in (*net.parameters()[1:], *net.seen[1:]):
                    p += move[: p.size].reshape(p.shape)
                    move = move[p.size :]
            else:
                at, move = np.frombuffer(r.at, np.int32), move.reshape(-1, 2 * DIM)
                net.embed[at] += move[:, :DIM]
                net.seen[0][at] += move[:, DIM:]
    return net


def best_threshold(low: np.ndarray, high: np.ndarray, toxic: np.ndarray, clean: np.ndarray) -> float:
    """The threshold with the best balanced accuracy, between two scores; 0.5 without both labels.

    ``low`` and ``high`` are the ends of cells of scores, ``toxic`` and ``clean`` their rows.
    """
    if not toxic.sum() or not clean.sum():
        return 0.5
    order = np.argsort(-low, kind="stable")
    gain = np.cumsum(toxic[order]) / toxic.sum() - np.cumsum(clean[order]) / clean.sum()
    k = int(gain.argmax())
    return float((low[order[k]] + (high[order[k + 1]] if k + 1 < len(order) else 0.0)) / 2)


def thresholds(rows: DataFrame, model: Tables) -> dict:
    """The threshold of each language over all its rows ("": of all languages)."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 64):
            s = shared.value(codes_of(part.column("rows")))
            yield pa.RecordBatch.from_arrays([pa.array([str(x) for x in part.column("lang").to_pylist()]), part.column("toxic"), pa.array(s)], ["lang", "toxic", "score"])

    scored = rows.select("lang", "toxic", "rows").mapInArrow(run, "lang string, toxic int, score double")
    odds = F.round(F.log(F.col("score") / (1 - F.col("score"))) / ODDS_STEP)
    cells = (scored.select(F.explode(F.array("lang", F.lit(""))).alias("lang"), odds.alias("cell"), "toxic", "score").groupBy("lang", "cell")
             .agg(F.min("score").alias("low"), F.max("score").alias("high"), F.sum("toxic").alias("toxic"), F.sum(1 - F.col("toxic")).alias("clean")))

    def pick(key: tuple, group: pa.Table) -> pa.Table:
        best = best_threshold(*(group.column(c).to_numpy() for c in ("low", "high", "toxic", "clean")))
        return pa.table({"lang": pa.array([key[0].as_py()], pa.string()), "threshold": pa.array([best])})

    return {r.lang: r.threshold for r in cells.groupBy("lang").applyInArrow(pick, "lang string, threshold double").collect()}  # the languages


def train(docs: DataFrame, labels: DataFrame) -> tuple[Tables | Constant, dict]:
    """The scorer, and a threshold for each language ("": for languages without one)."""
    rows = written(training_rows(docs, labels), "toxicity")
    held = F.col("fold") == CALIBRATION
    sizes = rows.agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("toxic"), F.count(F.when(~held, 1)).alias("own"), F.sum(F.when(~held, F.col("toxic"))).alias("own_toxic")).first()
    if not 0 < (sizes.own_toxic or 0) < sizes.own:
        return Constant(sizes.toxic / sizes.n if sizes.n else 0.0), {}
    model = learn(rows.where(~held), sizes.own, sizes.own_toxic / sizes.own).tables()
    return model, {"": 0.5} | thresholds(rows.where(held), model)


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted (score >= 0.5), threshold of the language and toxic (score >= threshold)."""
    model, limits = train(docs, labels)
    shared = docs.sparkSession.sparkContext.broadcast((model, limits))  # tables of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, limits = shared.value
        known = WordCodes()
        for part in slices(batches, 64):
            s = model([word_codes(t, known) for t in part.column("text").to_pylist()])
            limit = np.array([limits.get(str(x), limits.get("", 0.5)) for x in part.column("lang").to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("held_out"), pa.array(s), pa.array((s >= 0.5).astype(np.int32)), pa.array(limit), pa.array(s >= limit)],
                ["doc_id", "held_out", "score", "predicted", "threshold", "toxic"],
            )

    rows = docs.select("doc_id", (fold(F.col("doc_id")) == HELD_OUT).alias("held_out"), "text", "lang")
    kinds = [("score", T.DoubleType()), ("predicted", T.IntegerType()), ("threshold", T.DoubleType()), ("toxic", T.BooleanType())]
    return rows.mapInArrow(run, T.StructType([*rows.schema.fields[:2], *(T.StructField(n, k) for n, k in kinds)]))
