"""Coercion, label and validation rules (B1-B6, B8-B10): narrow projections only.

pandas semantics that differ in Spark are handled here once: unparseable text
and NaN become NULL (``try_cast``), comparisons against NULL count as False in
label masks, and text categories are trimmed and lower-cased before compare.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskops.functions.exprs import clip, col_, is_true, norm_text, to_double

# Fixed values that must equal the reference.
WEEKS_PER_MONTH = 4.345
PHQ9_POSITIVE_RESULTS = ("moderate", "moderately severe", "severe")
DATE_FORMATS_DAY_FIRST = ("d/M/yyyy", "d-M-yyyy", "d.M.yyyy", "yyyy-MM-dd", "d/M/yy")


def coerce_numeric(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """B1: text -> double, unparseable / NaN -> NULL."""
    return df.withColumns({c: to_double(c) for c in cols})


def yes_no_expr(c, yes: Iterable[str] = ("yes",), no: Iterable[str] = ("no",), numeric_fallback: bool = False) -> Column:
    """B2: 1.0 for a yes-word, 0.0 for a no-word, else NULL (or the number when ``numeric_fallback``)."""
    s = norm_text(c)
    mapped = (F.when(s.isin(*[x.lower() for x in yes]), F.lit(1.0))
              .when(s.isin(*[x.lower() for x in no]), F.lit(0.0)))
    if numeric_fallback:
        return F.coalesce(mapped, to_double(c))
    return mapped


def coerce_yes_no(df: DataFrame, cols: Mapping[str, dict] | Sequence[str]) -> DataFrame:
    """Apply :func:`yes_no_expr` to columns; ``cols`` maps name -> kwargs (yes/no/numeric_fallback)."""
    spec = cols if isinstance(cols, Mapping) else {c: {} for c in cols}
    return df.withColumns({c: yes_no_expr(c, **kw) for c, kw in spec.items()})


def ordinal_expr(c, mapping: Mapping[str, float], default: float | None = None) -> Column:
    """Category -> score after trim/lower; unmapped -> ``default`` (NULL if None)."""
    s = norm_text(c)
    out = F.lit(None if default is None else float(default)).cast("double")
    for k, v in reversed(list(mapping.items())):
        out = F.when(s == F.lit(k.lower()), F.lit(float(v))).otherwise(out)
    return out


def ordinal_map(df: DataFrame, col: str, mapping: Mapping[str, float], default: float | None = None,
                out: str | None = None) -> DataFrame:
    return df.withColumn(out or col, ordinal_expr(col, mapping, default))


def length_weeks_expr(c, unit: float = WEEKS_PER_MONTH, lo: float = 1.0, hi: float = 42.0) -> Column:
    """First number in the text x ``unit`` (months -> weeks), clipped to [lo, hi]."""
    num = F.regexp_extract(norm_text(c), r"(\d+(?:\.\d+)?)", 1)
    v = F.when(num == "", F.lit(None).cast("double")).otherwise(num.try_cast("double"))
    return clip(v * F.lit(float(unit)), lo, hi)


def parse_length_weeks(df: DataFrame, col: str, out: str = "gestational_weeks", unit: float = WEEKS_PER_MONTH) -> DataFrame:
    return df.withColumn(out, length_weeks_expr(col, unit))


def parse_day_first(c) -> Column:
    """Day-first date text -> DATE; anything unparseable -> NULL (never fails the job)."""
    s = F.trim(col_(c).cast("string"))
    return F.coalesce(*[F.to_date(F.try_to_timestamp(s, F.lit(f))) for f in DATE_FORMATS_DAY_FIRST])


def gestation_expr(eval_c, due_c) -> Column:
    """40 - (due - eval) / 7 weeks, clipped to [1, 42]."""
    days = F.datediff(parse_day_first(due_c), parse_day_first(eval_c))
    return clip(F.lit(40.0) - days / F.lit(7.0), 1.0, 42.0)


def gestation_from_dates(df: DataFrame, eval_col: str, due_col: str, out: str = "gestational_weeks") -> DataFrame:
    return df.withColumn(out, gestation_expr(eval_col, due_col))


def sleep_composite(a, b) -> Column:
    """(sleep item 1 + sleep item 2) x 1.5 with missing items as 0."""
    return (F.coalesce(col_(a), F.lit(0.0)) + F.coalesce(col_(b), F.lit(0.0))) * 1.5


def loss_flag(stillborn, miscarried) -> Column:
    """Any pregnancy loss -> 1.0 else 0.0 (missing counts as 0)."""
    return F.when(F.coalesce(to_double(stillborn), F.lit(0.0)) + F.coalesce(to_double(miscarried), F.lit(0.0)) > 0,
                  F.lit(1.0)).otherwise(F.lit(0.0))


def composite_scores(df: DataFrame, sleep1: str, sleep2: str, phq2: str, stillborn: str, miscarried: str) -> DataFrame:
    """Sleep composite, PHQ-2 x 3 low-mood score, loss flag."""
    return df.withColumns({
        "sleep_score": sleep_composite(sleep1, sleep2),
        "low_mood_score": col_(phq2) * 3.0,
        "prior_pregnancy_loss": loss_flag(stillborn, miscarried),
    })


def threshold_label(score, threshold: float) -> Column:
    return is_true(to_double(score) >= F.lit(float(threshold)))


def label_rules(df: DataFrame, rules: Sequence[Column], out: str = "target") -> DataFrame:
    """target = 1 if any rule holds; each rule is NULL-safe (NULL -> False), as pandas masks are."""
    cond = F.lit(False)
    for r in rules:
        cond = cond | is_true(r)
    return df.withColumn(out, cond.cast("int"))


def result_is(c, values: Iterable[str]) -> Column:
    return norm_text(c).isin(*[v.lower() for v in values])


def drop_incomplete(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    """Drop rows with a NULL in ``subset`` (all columns when None)."""
    return df.dropna(how="any", subset=list(subset) if subset else None)


# Request-document bounds (fixed values of the request schema).
REQUEST_BOUNDS = {
    "gestational_weeks": (1, 42),
    "sleep_quality": (0, 10),
    "appetite": (0, 10),
    "fatigue": (0, 10),
    "financial_stress": (0, 10),
    "age": (12, 55),
    "self_harm": (0, 5),
}
MESSAGE_LENGTH = (3, 5000)


def validate_inputs(df: DataFrame, bounds: Mapping[str, tuple[float, float]] = REQUEST_BOUNDS,
                    text_col: str | None = None, text_len: tuple[int, int] = MESSAGE_LENGTH) -> DataFrame:
    """``valid`` flag and the first ``reject_reason`` (quarantine split instead of HTTP 422)."""
    reason = F.lit(None).cast("string")
    checks = []
    for c, (lo, hi) in bounds.items():
        checks.append((F.col(c).isNull(), f"{c} missing"))
        checks.append(((F.col(c) < lo) | (F.col(c) > hi), f"{c} out of range [{lo}, {hi}]"))
    if text_col:
        n = F.length(F.col(text_col))
        checks.append((F.col(text_col).isNull(), f"{text_col} missing"))
        checks.append(((n < text_len[0]) | (n > text_len[1]), f"{text_col} length out of range [{text_len[0]}, {text_len[1]}]"))
    for cond, msg in reversed(checks):
        reason = F.when(cond, F.lit(msg)).otherwise(reason)
    return df.withColumn("reject_reason", reason).withColumn("valid", F.col("reject_reason").isNull())
