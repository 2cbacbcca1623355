"""Multi-source harmonisation (B7) and union.

Each source is projected to the common 10-feature schema with typed NULLs for
the features it lacks, tagged with ``source``, and unioned by name.  The
source-specific rules (B1-B6, B8) are column expressions, so the whole
assembly is one narrow plan per source plus a union: no shuffle.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskops.functions.exprs import to_double
from riskops.operators import coerce as C

# The harmonised feature schema.
COMMON_FEATURES = [
    "age",
    "gestational_weeks",
    "prior_pregnancy_loss",
    "support_score",
    "sleep_score",
    "fatigue_score",
    "low_mood_score",
    "suicidal_ideation_score",
    "economic_stress_score",
    "anxiety_score",
]
TARGET = "target"
SOURCE = "source"


def to_common_schema(df: DataFrame, source: str, exprs: Mapping[str, Column | str] | None = None,
                     id_col: str | None = None) -> DataFrame:
    """Project one source to the common schema: missing features become typed NULL doubles."""
    exprs = dict(exprs or {})
    cols = []
    if id_col:
        cols.append(F.concat(F.lit(source), F.lit(":"), F.col(id_col).cast("string")).alias("row_id"))
    for f in COMMON_FEATURES:
        e = exprs.get(f, f if f in df.columns else None)
        if e is None:
            cols.append(F.lit(None).cast("double").alias(f))
        else:
            e = F.col(e) if isinstance(e, str) else e
            cols.append(e.cast("double").alias(f))
    t = exprs.get(TARGET, TARGET)
    cols.append((F.col(t) if isinstance(t, str) else t).cast("int").alias(TARGET))
    cols.append(F.lit(source).alias(SOURCE))
    return df.select(*cols)


def harmonize_sources(sources: Mapping[str, DataFrame], include: Sequence[str] | None = None,
                      id_col: str | None = "row_id") -> DataFrame:
    """B7 + D13: union the selected sources (already carrying common-schema columns) by name."""
    names = [n for n in (include or list(sources)) if n in sources]
    if not names:
        raise ValueError("No data sources selected")
    frames = [to_common_schema(sources[n], n, id_col=id_col if id_col and id_col in sources[n].columns else None)
              for n in names]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


# --- source-specific builders for the reference's three survey layouts -------------------------


def main_source(df: DataFrame) -> DataFrame:
    """Main questionnaire layout -> common schema."""
    return to_common_schema(df, "main", {
        "age": to_double("Age"),
        "gestational_weeks": to_double("Gestational Age"),
        "prior_pregnancy_loss": C.yes_no_expr("Previous Miscarriage", ["yes"], ["no"]),
        "support_score": C.ordinal_expr("Relationship with Mother in-law", {"poor": 0.0, "moderate": 1.0, "good": 2.0}),
        "sleep_score": to_double("Trouble falling or staying sleep or sleeping too much"),
        "fatigue_score": to_double("Feeling tired or having little energy"),
        "low_mood_score": to_double("Feeling down, depressed, or hopeless"),
        "suicidal_ideation_score": to_double("Thoughts that you would be better off dead, or of hurting yourself"),
        "economic_stress_score": C.yes_no_expr("Sufficient Money for Basic Needs", ["no"], ["yes"]),
        TARGET: C.ordinal_expr("Labelling", {"depressed": 1.0, "not": 0.0}),
    })


def ppd_source(df: DataFrame, compat: bool = False) -> DataFrame:
    """Bangladesh PPD layout -> common schema.

    ``compat=True`` reproduces the reference's stringified-NaN quirk (a missing
    loss history counts as a loss); the default treats missing as 0.
    """
    loss_txt = F.trim(F.col("History of pregnancy loss").cast("string"))
    loss = (F.when(F.col("History of pregnancy loss").isNull(), F.lit(1.0 if compat else 0.0))
            .when(loss_txt != "", F.lit(1.0)).otherwise(F.lit(0.0)))
    return to_common_schema(df, "ppd", {
        "age": to_double("Age"),
        "gestational_weeks": C.length_weeks_expr("Pregnancy length"),
        "prior_pregnancy_loss": loss,
        "support_score": C.ordinal_expr("Recieved Support", {"low": 0.0, "medium": 1.0, "high": 2.0}),
        "sleep_score": C.sleep_composite(C.yes_no_expr("Relax/sleep when newborn is tended ", ["no"], ["yes"]),
                                         C.yes_no_expr("Relax/sleep when the newborn is asleep", ["no"], ["yes"])),
        "fatigue_score": C.ordinal_expr("Feeling for regular activities",
                                        {"tired": 3.0, "worried": 2.0, "afraid": 2.0}, default=1.0),
        "low_mood_score": C.yes_no_expr("Depression during pregnancy (PHQ2)", ["positive"], ["negative"]) * 3.0,
        TARGET: (C.threshold_label("EPDS Score", 13) | C.result_is("EPDS Result", ["high"])
                 | C.threshold_label("PHQ9 Score", 10) | C.result_is("PHQ9 Result", C.PHQ9_POSITIVE_RESULTS)).cast("int"),
    })


def uganda_source(df: DataFrame) -> DataFrame:
    """Uganda prenatal layout -> common schema."""
    return to_common_schema(df, "uganda", {
        "age": to_double("age"),
        "gestational_weeks": C.gestation_expr("evaluation_date", "dueDate"),
        "prior_pregnancy_loss": C.loss_flag("numStillBorn", "numMissCarry"),
        "anxiety_score": to_double("Anxiety"),
        TARGET: C.threshold_label("Total Score", 13).cast("int"),
    })
