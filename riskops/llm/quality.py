"""Quality rules: base statistics of each text and robust multivariate outliers.

A text's statistics are transformed into a vector (logarithms of word count, word length,
symbols per 100 words and repeated lines; share of repeated words). For each language and
source, minimum-covariance-determinant estimates of centre and scatter come from
concentration steps: the 75 % of vectors nearest to the current estimate give the next one,
from two starts, and the start with the smaller determinant is kept and reweighted. A
document whose squared Mahalanobis distance exceeds the cut-off is rejected.

Everything is DataFrame aggregation: vectors are fixed-point numbers, so sums are exact and a
step is a percentile and sums of products for each group, both combined before the shuffle;
the 5 x 5 factorisation runs on the group rows. Equal vectors of a group count once, so
copies do not decide what is normal. A group with fewer than ``min_vectors`` vectors takes
the estimate of its language, or of all documents. ``FLOORS`` are added to the spreads: a
deviation that is small in itself is no outlier however uniform the group is.

Defined cases: null text is empty and fails the base rules; null languages and sources are
groups of their own; repeated rows get equal verdicts; an empty table gives an empty result;
other columns pass through ``keep_good`` unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

WORD, SPACES = r"[^\x20\x09-\x0D]+", " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: Fixed-point units of a vector's component.
UNITS = 256
P = 5
#: Least spreads: ln words, ln word length, ln symbols per 100 words, repeated share, ln repeated lines.
FLOORS = (1.0, 0.08, 0.45, 0.15, 0.7)
SUBSET, STEPS = 0.75, 4
#: 0.75 / P(chi-square with 7 degrees <= its 0.75 quantile with 5): makes the subset's scatter consistent.
CONSISTENCY = 1.42
#: Chi-square with 5 degrees: quantiles 0.975 (reweighting) and 1 - 1e-6 (rejection).
REWEIGHT, CUTOFF = 12.83, 35.89
MIN_VECTORS = 25
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def with_statistics(docs: DataFrame) -> DataFrame:
    """``row`` (the whole row), the base counts, base_failed, the vector x1..x5, groups g1, g2, g3."""
    t = F.col("t")
    i = F.sequence(F.lit(0), F.size("words") - 3)
    df = docs.select(F.struct("*").alias("row"), F.coalesce("text", F.lit("")).alias("t"), "lang", "source")
    df = df.withColumns({
        "words": F.regexp_extract_all("t", F.lit(WORD), 0),
        "lines": F.filter(F.split("t", "\n", -1), lambda x: x.rlike(WORD)),
    })
    df = df.withColumn("grams", F.when(F.size("words") >= 3, F.transform(i, lambda k: F.xxhash64(*[F.get("words", k + d) for d in range(3)]))))
    df = df.withColumn(
        "sorted", F.when(F.size(F.array_distinct("grams")) < F.size("grams"), F.sort_array(F.transform("grams", lambda h, k: F.struct(h.alias("h"), k.alias("k")))))
    )
    twice = F.zip_with("sorted", F.slice("sorted", 2, F.size("sorted")), lambda a, b: F.when(a.h == b.h, F.array(a.k, b.k)))
    df = df.withColumn("at", F.sort_array(F.array_distinct(F.flatten(F.filter(twice, lambda x: x.isNotNull())))))
    run = F.zip_with("at", F.slice("at", 2, F.size("at")), lambda a, b: F.least(F.lit(3), F.coalesce(b - a, F.lit(3))))
    df = df.select(
        "row", "lang", "source",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.translate("t", SPACES, "")).cast("long").alias("word_chars"),
        (F.length(t) - F.length(F.translate("t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(F.aggregate(run, F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long").alias("n_repeat_words"),
    )
    n = F.greatest(F.col("n_words"), F.lit(1))
    vector = (
        F.log1p(F.col("n_words")), F.log(F.greatest("word_chars", F.lit(1)) / n), F.log1p(100 * F.col("n_symbols") / n),
        F.col("n_repeat_words") / n, F.log1p(F.col("n_dup_lines")),
    )
    lang, source = (F.coalesce(F.concat(F.lit("="), c), F.lit("~")) for c in ("lang", "source"))
    # a length before the language keeps (language, source) pairs apart
    return df.select(
        "row", *COUNTS,
        ((F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))).alias("base_failed"),
        *[F.round(v * UNITS).cast("long").alias(f"x{k}") for k, v in enumerate(vector, 1)],
        F.concat(F.length(lang), lang, source).alias("g1"), F.concat(F.lit("l"), lang).alias("g2"), F.lit("a").alias("g3"),
    )


X = [f"x{k}" for k in range(1, P + 1)]
M = [f"m{k}" for k in range(1, P + 1)]
A = {(r, c): f"a{r}{c}" for r in range(1, P + 1) for c in range(1, r + 1)}


def distance(units: int = UNITS) -> Column:
    """Squared Mahalanobis distance of x1..x5 from the estimate in the same row."""
    off = [F.col(x) / units - F.col(m) for x, m in zip(X, M)]
    rows = [sum((F.col(A[r, c]) * off[c - 1] for c in range(1, r + 1)), F.lit(0.0)) for r in range(1, P + 1)]
    return sum((y * y for y in rows), F.lit(0.0))


def estimate(sums: DataFrame, factor: float) -> DataFrame:
    """From n, the sums s<r> and products s<r><c> of each group: m<r>, the inverse Cholesky factor a<r><c>, log_det."""
    n, p = F.col("n"), range(1, P + 1)
    df = sums.withColumns({f"m{r}": F.col(f"s{r}") / n / UNITS for r in p})
    cov = {}
    for r, c in A:
        raw = F.col(f"s{r}{c}") / n / UNITS**2 - F.col(f"m{r}") * F.col(f"m{c}")
        cov[f"c{r}{c}"] = (raw * factor + FLOORS[r - 1] ** 2) if r == c else raw * factor
    df = df.withColumns(cov)
    for c in p:  # Cholesky, column by column
        less = sum((F.col(f"l{c}{k}") ** 2 for k in range(1, c)), F.lit(0.0))
        df = df.withColumn(f"l{c}{c}", F.sqrt(F.col(f"c{c}{c}") - less))
        df = df.withColumns({
            f"l{r}{c}": (F.col(f"c{r}{c}") - sum((F.col(f"l{r}{k}") * F.col(f"l{c}{k}") for k in range(1, c)), F.lit(0.0))) / F.col(f"l{c}{c}")
            for r in range(c + 1, P + 1)
        } or {f"l{c}{c}": F.col(f"l{c}{c}")})
    for r in p:  # rows of its inverse
        df = df.withColumns({A[r, c]: (F.lit(1.0) if r == c else -sum((F.col(f"l{r}{k}") * F.col(A[k, c]) for k in range(c, r)), F.lit(0.0))) / F.col(f"l{r}{r}") for c in range(1, r + 1)})
    return df.withColumn("log_det", sum((F.log(F.col(f"l{r}{r}")) for r in p), F.lit(0.0)) * 2)


def sums(df: DataFrame) -> DataFrame:
    products = [F.sum(F.col(f"x{r}") * F.col(f"x{c}")).alias(f"s{r}{c}") for r, c in A]
    return df.groupBy("g", "start").agg(F.count("*").alias("n"), *[F.sum(x).alias(f"s{x[1:]}") for x in X], *products)


ESTIMATE = ["g", "start", "n", *M, *A.values(), "log_det"]


def estimates(stats: DataFrame, subset: float = SUBSET, steps: int = STEPS) -> DataFrame:
    """The robust estimate of each group g: n, m1..m5 and the inverse factor."""
    vectors = stats.where(~F.col("base_failed")).select(F.explode(F.array("g1", "g2", "g3")).alias("g"), *X).distinct()
    cells = written(vectors.withColumn("start", F.explode(F.array(F.lit(0), F.lit(1)))), "vectors")
    # starts: the medians, with the absolute deviations from them, or with the floors alone
    middle = cells.groupBy("g", "start").agg(F.count("*").alias("n"), *[F.percentile(x, 0.5).alias(f"p{x[1:]}") for x in X])
    middle = written(middle, "medians")
    spread = cells.join(middle, ["g", "start"]).groupBy("g", "start").agg(*[F.percentile(F.abs(F.col(x) - F.col(f"p{x[1:]}")), 0.5).alias(f"d{x[1:]}") for x in X])
    now = middle.join(spread, ["g", "start"])
    wide = F.when(F.col("start") == 0, F.lit(1.4826 / UNITS)).otherwise(0.0)
    diagonal = {A[r, r]: 1 / F.sqrt((F.col(f"d{r}") * wide) ** 2 + FLOORS[r - 1] ** 2) for r in range(1, P + 1)}
    now = now.withColumns({f"m{r}": F.col(f"p{r}") / UNITS for r in range(1, P + 1)} | {a: F.lit(0.0) for a in A.values()} | diagonal)
    now = written(now.withColumn("log_det", F.lit(0.0)).select(ESTIMATE), "estimates")
    level = F.floor(F.log1p(distance()) * UNITS)  # few different values: the percentile holds counts of them
    for _ in range(steps):
        near = cells.join(now, ["g", "start"]).select("g", "start", *X, level.alias("level"))
        limit = near.groupBy("g", "start").agg(F.percentile("level", subset).alias("limit"))
        now = written(estimate(sums(near.join(limit, ["g", "start"]).where("level <= limit")), CONSISTENCY).select(ESTIMATE), "estimates")
    close = cells.join(now, ["g", "start"]).where(distance() <= REWEIGHT).select("g", "start", *X)
    # the distance is 0 at the centre, but the vectors may all be away from it: then the estimate stays
    final = written(estimate(sums(close), 1.0).select(ESTIMATE), "estimates")
    final = final.union(now.join(final, ["g", "start"], "left_anti").select(ESTIMATE))
    pick = now.groupBy("g").agg(F.min(F.struct("log_det", "start")).alias("x")).select("g", "x.start")
    total = middle.where("start = 0").select("g", F.col("n").alias("vectors"))
    return written(final.join(pick, ["g", "start"]).join(total, "g").select("g", "vectors", *M, *A.values()), "estimates")


def chosen(stats: DataFrame, found: DataFrame, min_vectors: int = MIN_VECTORS) -> DataFrame:
    """For each g1 the finest estimate with enough vectors: its own, its language's or that of all."""
    names = ["vectors", *M, *A.values()]
    groups = stats.where(~F.col("base_failed")).select("g1", "g2", "g3").distinct()
    for k, g in enumerate(("g1", "g2", "g3")):
        enough = found if g == "g3" else found.where(F.col("vectors") >= min_vectors)
        groups = groups.join(enough.select(F.col("g").alias(g), F.struct(*names).alias(f"e{k}")), g, "left")
    return written(groups.select("g1", F.coalesce("e0", "e1", "e2").alias("e")).select("g1", "e.*"), "groups")


def judged(stats: DataFrame, groups: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """``stats`` with distance (squared; null if base_failed) and kept."""
    df = stats.join(groups, "g1", "left").withColumn("distance", F.when(~F.col("base_failed"), distance()))
    return df.withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("distance") <= cutoff, F.lit(True)))


NARROW = [*COUNTS, "base_failed", *X, "g1", "g2", "g3"]


def rate(docs: DataFrame) -> DataFrame:
    """doc_id, the base counts, base_failed, distance and kept for each row."""
    stats = written(with_statistics(docs).select(F.col("row.doc_id").alias("doc_id"), *NARROW), "statistics")
    return judged(stats, chosen(stats, estimates(stats))).select("doc_id", *COUNTS, "base_failed", "distance", "kept")


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that are kept, columns as they came. Texts are read twice, not shuffled."""
    stats = written(with_statistics(docs).select(*NARROW), "statistics")
    # a filter that needs a nondeterministic column stays above the statistics: pushed below, it would
    # repeat them inside their own lambdas
    df = with_statistics(docs).withColumn("once", F.monotonically_increasing_id())
    return judged(df, chosen(stats, estimates(stats))).where("kept and once >= 0").select("row.*")
