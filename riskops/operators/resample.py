"""Splits, folds and class balancing driven by the deterministic uniform ``u(seed, id)``.

``u`` is a pure function of (seed, id), so an assignment never depends on partition
layout or task retries.  Splits and folds rank the rows of each class by ``u``, so
class sizes are exact; group folds deal out profiles sorted by their class counts; class
balancing draws row numbers by ``u``, so its sizes are exact too.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskops.functions.exprs import uniform
from riskops.operators.rank import cumulative
from riskops.session import ensure_checkpoint_dir

PROFILE_SEP = "\u001f"


#: Rows of one range of the two-level rank, about: a task sorts some ranges of whole rows, and rows may hold texts.
RANK_RANGE = 2_000


def class_rank(df: DataFrame, id_col: str, label_col: str, seed: str) -> DataFrame:
    """Adds ``class_rank`` (from 0, by u(seed, id) then id within the label) and ``class_size``.

    u is uniform, so equal ranges of it hold about equally many rows: rows are numbered within
    (label, range), and the counts of the ranges before give each range its first number.  No
    task holds a whole class.
    """
    ranges = max(1, -(-df.count() // RANK_RANGE))
    df = df.withColumn("_u", uniform(seed, id_col)).withColumn("_range", F.floor(F.col("_u") * ranges))
    # NULL labels are a class of their own; the flag keeps the join on them an equi-join
    df = df.withColumn("_none", F.col(label_col).isNull()).withColumn("_key", F.coalesce(F.col(label_col).cast("string"), F.lit("")))
    cls = ["_none", "_key"]
    before = Window.partitionBy(*cls).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = (df.groupBy(*cls, "_range").agg(F.count(F.lit(1)).alias("_n"))
              .withColumn("_first", F.coalesce(F.sum("_n").over(before), F.lit(0)))
              .withColumn("class_size", F.sum("_n").over(Window.partitionBy(*cls))))
    within = Window.partitionBy(*cls, "_range").orderBy("_u", id_col)
    return (df.withColumn("_k", F.row_number().over(within) - 1)
            .join(counts.drop("_n"), [*cls, "_range"])
            .withColumn("class_rank", F.col("_first") + F.col("_k"))
            .drop("_u", "_range", "_none", "_key", "_k", "_first"))


def stratified_split(df: DataFrame, id_col: str, label_col: str, test_size: float = 0.2,
                     seed: str = "split") -> DataFrame:
    """``split`` = 'test' for the first ``test_size`` of each class (rounded half up) by u(seed, id), else 'train'."""
    r = class_rank(df, id_col, label_col, seed)
    test = F.col("class_rank") < F.floor(F.col("class_size") * F.lit(float(test_size)) + 0.5)
    return r.withColumn("split", F.when(test, F.lit("test")).otherwise(F.lit("train"))).drop("class_rank", "class_size")


def stratified_folds(df: DataFrame, id_col: str, label_col: str, k: int = 5, seed: str = "fold") -> DataFrame:
    """``fold`` = rank within the class mod k, so a class's fold sizes differ by one at most; usable as
    ``CrossValidator(foldCol=...)``."""
    r = class_rank(df, id_col, label_col, seed)
    return r.withColumn("fold", F.pmod("class_rank", F.lit(k)).cast("int")).drop("class_rank", "class_size")


def profile_key(cols: Sequence[str]) -> Column:
    """Stringified profile (NULL -> 'nan', as ``astype(str)`` does) joined by a unit separator.

    Avoids the NULL collision of hashing columns directly (xxhash64(NULL,'a') =
    xxhash64('a',NULL))."""
    return F.concat_ws(PROFILE_SEP, *[F.coalesce(F.col(c).cast("string"), F.lit("nan")) for c in cols])


def group_folds(df: DataFrame, profile_cols: Sequence[str], k: int = 5, seed: str = "gfold",
                label_col: str | None = None, positive=1) -> DataFrame:
    """Adds ``profile`` and ``fold``; a profile's rows share a fold, and the folds share the classes.

    Profiles sorted by their positives, then their other rows (ties by u of the profile) are
    dealt out in turn, so the positives of two folds differ by one profile's at most.  The place
    in that order is the rank among profiles with the same counts plus the profiles before them:
    no task holds all profiles.  Without a label profiles are dealt by their size.
    """
    rows = df.withColumn("profile", profile_key(profile_cols))
    is_pos = F.coalesce(F.col(label_col) == F.lit(positive), F.lit(False)) if label_col else F.lit(False)
    ensure_checkpoint_dir(df.sparkSession)
    groups = (rows.groupBy("profile").agg(F.count(F.when(is_pos, 1)).alias("n_pos"), F.count(F.when(~is_pos, 1)).alias("n_neg"))
              .withColumn("mix", F.concat_ws(":", "n_pos", "n_neg")).checkpoint())
    mixes = cumulative(groups.groupBy("n_pos", "n_neg", "mix").agg(F.count(F.lit(1)).alias("n")), ["n_pos", "n_neg"], ["n"])
    ranked = class_rank(groups.select("profile", "mix"), "profile", "mix", seed)
    # nearly all profiles may have one mix, so a shuffle by it would bring them into one task; n rows have less than 2 n^(2/3) mixes
    dealt = ranked.join(F.broadcast(mixes.select("mix", (F.col("n_cum") - F.col("n")).alias("first"))), "mix")
    fold = F.pmod(F.col("first") + F.col("class_rank"), F.lit(k)).cast("int")
    folds = dealt.select("profile", fold.alias("fold")).checkpoint()
    return rows.join(folds, "profile").select(*rows.columns, "fold")


#: Draws that one row is laid out to, and ranges of them that a task lays out, about.
DRAW_RANGE, TASK_RANGES = 10_000, 25


def draws(spark: SparkSession, n: int) -> DataFrame:
    """``draw`` from 0 to n - 1, made where they are used."""
    return spark.range(0, n, 1, max(1, -(-n // (100 * DRAW_RANGE)))).withColumnRenamed("id", "draw")


def oversample(df: DataFrame, id_col: str, label_col: str, seed: str = "os") -> DataFrame:
    """random oversampling with replacement, train rows only: every class, the largest too, gets the largest class's size.

    Draw j of a class takes its row number ``floor(u(seed, class|j) * size)``. Only how often a
    number is drawn meets the rows, by a join on (class, number), so no task holds a class. ``copy`` numbers
    a row's draws from 0. Rows without a label are left out; a single class is returned as it is, with copy 0.
    """
    df = df.where(F.col(label_col).isNotNull())
    sizes = df.groupBy(F.col(label_col).cast("string").alias("_class")).agg(F.count(F.lit(1)).alias("_size"))
    total = sizes.agg(F.max("_size").alias("n"), F.count(F.lit(1)).alias("classes")).first()
    if total.classes < 2:
        return df.withColumn("copy", F.lit(0))
    # a class's draws in ranges, dealt out before they are laid out; to a number of tasks that is given, as the planner sees
    # only a few short rows and would make one task of them
    tasks = -(-total.n * total.classes // (TASK_RANGES * DRAW_RANGE))
    ranges = F.explode(F.sequence(F.lit(0), F.lit((total.n - 1) // DRAW_RANGE).cast("long"))).alias("_range")
    first = F.col("_range") * DRAW_RANGE
    j = F.explode(F.sequence(first, F.least(first + DRAW_RANGE, F.lit(total.n)) - 1)).alias("_j")
    drawn = sizes.select("_class", "_size", ranges).repartition(tasks, "_class", "_range").select("_class", "_size", j)
    number = F.floor(uniform(seed, F.concat_ws("|", "_class", "_j")) * F.col("_size"))
    drawn = drawn.groupBy("_class", number.alias("class_rank")).agg(F.count(F.lit(1)).alias("_copies"))
    rows = class_rank(df, id_col, label_col, seed).withColumn("_class", F.col(label_col).cast("string"))
    # laid-out ranges look as small to the planner as they were before: without the hint it sends all draws through the driver
    rows = rows.join(drawn.hint("merge"), ["_class", "class_rank"])
    return rows.select(*df.columns, F.explode(F.sequence(F.lit(0), (F.col("_copies") - 1).cast("int"))).alias("copy"))


def class_weights(df: DataFrame, label_col: str, positive=1) -> DataFrame:
    """``balanced`` weight n / (k * n_c) per class and XGBoost-style ``scale_pos_weight`` = neg / pos."""
    from pyspark.sql import Window

    c = df.groupBy(F.col(label_col).alias("label")).agg(F.count(F.lit(1)).alias("n_c"))
    w_all = Window.partitionBy()  # over the per-class table: one row per class
    n = F.sum("n_c").over(w_all)
    k = F.count(F.lit(1)).over(w_all)
    pos = F.sum(F.when(F.col("label") == F.lit(positive), F.col("n_c")).otherwise(0)).over(w_all)
    return c.select(
        "label", "n_c",
        (n / (k * F.col("n_c"))).alias("weight"),
        F.when(pos > 0, (n - pos) / pos).alias("scale_pos_weight"),
    )


def with_class_weight(df: DataFrame, label_col: str, out: str = "weight") -> DataFrame:
    """Attach the balanced weight per row (join with the per-class table, broadcast where its size allows)."""
    w = class_weights(df, label_col).select(F.col("label").alias(label_col), F.col("weight").alias(out))
    return df.join(w, label_col)
