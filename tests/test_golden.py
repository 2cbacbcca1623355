
import pytest
from pyspark.sql import functions as F

from riskops.operators import evaluate as E
from riskops.operators import fairness, triage


def _scored_from_matrix(spark, tn, fp, fn, tp, threshold=0.5):
    """Rows whose predictions at ``threshold`` reproduce a confusion matrix."""
    lo, hi = threshold - 0.1, threshold + 0.1
    cells = [(0, lo, tn), (0, hi, fp), (1, lo, fn), (1, hi, tp)]
    parts = [spark.range(n).select(F.lit(y).alias("y"), F.lit(p).alias("p")) for y, p, n in cells]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@pytest.mark.parametrize("matrix, threshold, expected", [
    ((1374, 441, 213, 772), 0.5, dict(accuracy=0.7664, precision=0.6364, recall=0.7838, f1=0.7025)),
    ((1334, 481, 165, 820), 0.415, dict(accuracy=0.7693, precision=0.6303, recall=0.8325)),
    ((189, 305, 266, 642), 0.5, dict(accuracy=0.5927, precision=0.6779, recall=0.707, f1=0.6922)),
])
def test_metrics_from_confusion_matrix(spark, matrix, threshold, expected):
    df = _scored_from_matrix(spark, *matrix, threshold=threshold)
    m = E.classification_metrics(df, "p", "y", threshold).first().asDict()
    for k, v in expected.items():
        assert round(m[k], 4) == pytest.approx(v, abs=1e-4), k


def test_weighted_report(spark):
    df = _scored_from_matrix(spark, 2741, 517, 535, 2034)
    rows = {r["class"]: r for r in E.classification_report(df, "p", "y", 0.5).collect()}
    w = rows["weighted avg"]
    assert round(w["precision"], 4) == 0.8193
    assert round(w["recall"], 4) == 0.8195
    assert round(w["f1_score"], 4) == 0.8194


def test_disparate_impact_and_status(spark):
    rates = spark.createDataFrame([("low", 0.25), ("middle", 0.30), ("high", 0.35)], "group string, positive_rate double")
    di = fairness.disparate_impact(rates, "income_band").first()
    assert di["disparate_impact_raw"] == pytest.approx(0.7142857142857143)
    assert di["bias_detected"] is True
    # the service's label; the offline report script names the same strategy "reweighting"
    assert di["mitigation_strategy"] == "reweight_and_retrain"
    st = {r["group"]: r["status"] for r in fairness.fairness_status(rates).collect()}
    assert st == {"low": "Bias", "middle": "Fair", "high": "Fair"}


def test_crisis_message(spark):
    df = spark.createDataFrame([("After delivery I want to hurt myself.",)], "message string")
    r = triage.chat_triage(df, "message").first()
    assert r["crisis_mode"] is True
    assert r["risk_percent"] == 100.0
    assert r["risk_level"] == "high"
    assert r["likely_context"] == "postpartum"


def test_two_risk_factors(spark):
    lex = triage.REFERENCE_LEXICON
    labels = list(lex.risk)[:2]
    text = " and ".join(lex.risk[lab][0][0] for lab in labels)
    r = triage.chat_triage(spark.createDataFrame([(text,)], "message string"), "message").first()
    assert set(labels) <= set(r["risk_factors"])
