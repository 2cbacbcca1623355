"""Column-expression helpers shared by the operators (all JVM-side, codegen friendly)."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_32 = 4294967296.0


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def uniform(seed: str, id_col) -> Column:
    """Deterministic uniform in [0,1) from ``md5(seed|id)``.

    Same value in Spark and DuckDB, so "random" operators (splits, folds,
    resampling, bootstrap) have an SQL twin.  It is a pure function of the row
    id: re-running a lost task reproduces it exactly.
    """
    key = F.concat(F.lit(str(seed)), F.lit("|"), col_(id_col).cast("string"))
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("bigint") / F.lit(TWO_32)


def nan_to_null(c) -> Column:
    c = col_(c)
    return F.when(F.isnan(c), F.lit(None).cast("double")).otherwise(c)


def to_double(c) -> Column:
    """``pd.to_numeric(errors='coerce')``: unparseable text -> NULL, NaN -> NULL."""
    return nan_to_null(col_(c).try_cast("double"))


def clip(c, lo: float | None = None, hi: float | None = None) -> Column:
    """Null-preserving clip (``least``/``greatest`` skip NULLs, so guard them)."""
    c = col_(c)
    out = c
    if lo is not None:
        out = F.greatest(out, F.lit(float(lo)))
    if hi is not None:
        out = F.least(out, F.lit(float(hi)))
    return F.when(c.isNull(), F.lit(None).cast("double")).otherwise(out)


def norm_text(c) -> Column:
    """``str(x).strip().lower()``."""
    return F.lower(F.trim(col_(c).cast("string")))


def is_true(pred: Column) -> Column:
    """pandas semantics for a boolean mask: NULL counts as False."""
    return F.coalesce(pred, F.lit(False))


def any_contains(text: Column, phrases: Iterable[str]) -> Column:
    """OR of ``contains`` tests; stays one codegen'd predicate, no join."""
    phrases = list(phrases)
    if not phrases:
        return F.lit(False)
    out = None
    for p in phrases:
        t = text.contains(p)
        out = t if out is None else (out | t)
    return out


def count_contains(text: Column, phrases: Iterable[str]) -> Column:
    """Number of phrases that occur at least once."""
    phrases = list(phrases)
    if not phrases:
        return F.lit(0)
    out = None
    for p in phrases:
        t = text.contains(p).cast("int")
        out = t if out is None else (out + t)
    return out


def array_join(c, sep: str = " | ") -> Column:
    return F.concat_ws(sep, col_(c))


def spread(df, min_partitions: int | None = None):
    """Round-robin an under-partitioned input (e.g. one large file = one split) across the
    cluster before CPU-heavy per-row work; a no-op when it already has enough splits."""
    try:
        sc = df.sparkSession.sparkContext
        target = min_partitions or sc.defaultParallelism
        parts = df.rdd.getNumPartitions()
    except Exception:  # no partition count on this session type (e.g. a remote client): leave as is
        return df
    if parts < target:
        return df.repartition(target)
    return df
