"""riskops: Spark-native clinical-risk analytics (scoring, evaluation, fairness, triage, retrieval)."""

__version__ = "0.1.0"
