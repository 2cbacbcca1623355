"""DuckDB twins of the registered queries (the correctness oracle).

Only the base tables are registered on the DuckDB side, so every query
prepends the fixture views it needs as CTEs.  Literals carry ``::DOUBLE``
(DuckDB would otherwise compute in DECIMAL).  Double outputs are rounded to 6
places on both sides (``finish`` in the catalog, ``R()`` here).
"""

from __future__ import annotations


def D(x) -> str:
    return f"{float(x)!r}::DOUBLE"


def U(seed: str, id_expr: str) -> str:
    return (f"(cast(cast('0x' || substr(md5(concat('{seed}', '|', cast({id_expr} AS VARCHAR))), 1, 8) AS BIGINT)"
            f" AS DOUBLE) / 4294967296.0::DOUBLE)")


VIEWS: dict[str, tuple[list[str], str]] = {}


def view(name: str, deps: list[str], sql: str):
    VIEWS[name] = (deps, sql)


view("assessments", [], """
SELECT event_id AS prediction_id, concat('p', cast(user_id AS VARCHAR)) AS patient_id, ts,
  event_id % 42 + 1 AS gestational_weeks, k % 11 AS sleep_quality, (k*2) % 11 AS appetite, (k*9) % 11 AS fatigue,
  (k + user_id) % 11 AS financial_stress, user_id % 44 + 12 AS age,
  CASE user_id % 4 WHEN 0 THEN 'low' WHEN 1 THEN 'middle' WHEN 2 THEN 'high' END AS income_band,
  CASE WHEN event_type = 'error' AND k % 10 = 0 THEN k % 5 + 1 ELSE 0 END AS self_harm, k, event_type
FROM (SELECT *, TRY_CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k FROM events) e""")

view("scored", ["assessments"], f"""
SELECT *, k / 100.0::DOUBLE AS p,
  CASE WHEN {U('42', 'prediction_id')} < k / 100.0::DOUBLE THEN 1 ELSE 0 END AS y,
  (k * 0.7::DOUBLE + {U('p2', 'prediction_id')} * 30) / 100.0::DOUBLE AS p2
FROM assessments""")

view("feedback", [], """
SELECT event_id + CASE WHEN event_id % 25 = 0 THEN 1000000000 ELSE 0 END AS prediction_id,
  CASE event_id % 20 WHEN 0 THEN 'high' WHEN 5 THEN 'low' WHEN 10 THEN 'agree' ELSE 'medium' END AS clinician_label,
  ts + INTERVAL '1' DAY AS ts
FROM events WHERE event_id % 5 = 0""")

view("consents", ["assessments"], """
SELECT patient_id, k % 4 <> 0 AS consent_given, ts, prediction_id AS seq,
  CASE k % 3 WHEN 0 THEN list_value('risk_scoring') WHEN 1 THEN list_value('chat_assessment')
       ELSE list_value('chat_assessment', 'risk_scoring', 'model_improvement') END AS consent_scope
FROM assessments WHERE event_type = 'signup'""")

view("outcomes", ["assessments"], """
SELECT patient_id, prediction_id, ts,
  CASE k % 4 WHEN 0 THEN 'improved' WHEN 1 THEN 'stable' WHEN 2 THEN 'deteriorated' ELSE 'urgent_referral' END AS outcome_label,
  CASE k % 4 WHEN 3 THEN 1 ELSE 14 END AS follow_up_days
FROM assessments WHERE event_type = 'purchase'""")

view("messages", [], """
SELECT conv_id * 1000 + turn AS message_id, concat('p', cast(conv_id AS VARCHAR)) AS patient_id, text AS message
FROM conversations WHERE role = 'user'""")

view("patients", [], """
SELECT concat('p', cast(c_custkey AS VARCHAR)) AS patient_id, c_name AS patient_name,
  cast(coalesce(n, 0) AS BIGINT) AS recent_visits
FROM customer LEFT JOIN (SELECT o_custkey, count(o_orderkey) AS n FROM orders GROUP BY o_custkey) v
  ON v.o_custkey = c_custkey""")

view("guidelines", [], "SELECT cast(doc_id AS VARCHAR) AS source, text FROM documents")

view("profiles", [], """
SELECT l_orderkey, l_linenumber, l_quantity, l_discount, l_tax, l_returnflag, l_linestatus,
  CASE WHEN l_extendedprice >= 50000 THEN 1 ELSE 0 END AS y FROM lineitem""")

view("raw_survey", [], """
SELECT o_orderkey AS row_id,
  CASE o_orderstatus WHEN 'F' THEN ' Yes ' WHEN 'O' THEN 'no' ELSE cast(o_orderkey % 3 AS VARCHAR) END AS money,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'Poor' WHEN '2-HIGH' THEN 'moderate ' WHEN '3-MEDIUM' THEN 'GOOD'
       WHEN '5-LOW' THEN 'n/a' END AS relation,
  CASE WHEN o_orderkey % 17 = 0 THEN 'unknown' ELSE concat(cast(o_orderkey % 12 AS VARCHAR), ' months') END AS length_text,
  CASE WHEN o_orderkey % 13 = 0 THEN 'bad' ELSE strftime(o_orderdate, '%d/%m/%Y') END AS eval_date,
  CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE cast(o_orderkey % 31 AS VARCHAR) END AS epds_score,
  CASE o_orderkey % 5 WHEN 0 THEN 'High' WHEN 1 THEN 'low' END AS epds_result
FROM orders""")

view("training", ["assessments"], f"""
SELECT *, CASE WHEN {U('lab', 'prediction_id')} < heur / 100.0::DOUBLE THEN 1 ELSE 0 END AS y FROM (
  SELECT *, greatest(0.0::DOUBLE, least(100.0::DOUBLE, ((gestational_weeks / 42.0::DOUBLE * 10) * 0.25::DOUBLE
    + (10 - sleep_quality) * 0.25::DOUBLE + (10 - appetite) * 0.15::DOUBLE + fatigue * 0.2::DOUBLE
    + financial_stress * 0.15::DOUBLE) * 10.0::DOUBLE)) AS heur FROM assessments) h""")

# heuristic risk of the request log (G15 crisis override + G16), as the service scores it
RISK_EXPR = """CASE WHEN self_harm > 0 OR (sleep_quality <= 2 AND appetite <= 2 AND fatigue >= 9) THEN 100.0::DOUBLE
  ELSE greatest(0.0::DOUBLE, least(100.0::DOUBLE, (((gestational_weeks / 42.0::DOUBLE * 10.0::DOUBLE) * 0.25::DOUBLE
    + (10.0::DOUBLE - sleep_quality) * 0.25::DOUBLE + (10.0::DOUBLE - appetite) * 0.15::DOUBLE
    + cast(fatigue AS DOUBLE) * 0.2::DOUBLE + cast(financial_stress AS DOUBLE) * 0.15::DOUBLE)
    / 10.0::DOUBLE * 100.0::DOUBLE))) END"""

view("predictions", ["assessments"], f"SELECT *, {RISK_EXPR} AS risk_percent FROM assessments")


def with_views(sql: str, *names: str) -> str:
    order: list[str] = []

    def add(n):
        if n in order:
            return
        for d in VIEWS[n][0]:
            add(d)
        order.append(n)

    for n in names:
        add(n)
    if not order:
        return sql
    ctes = ",\n".join(f"{n} AS ({VIEWS[n][1]})" for n in order)
    body = sql.lstrip()
    if body[:4].upper() == "WITH":
        return f"WITH {ctes},\n{body[4:].lstrip()}"
    return f"WITH {ctes}\n{sql}"


def R(*cols: str, sql: str) -> str:
    """Round the named double columns to 6 places (the Spark side rounds all doubles)."""
    if not cols:
        return sql
    rep = ", ".join(f"round({c}, 6) AS {c}" for c in cols)
    return f"SELECT * REPLACE ({rep}) FROM ({sql}) _r"


SQL: dict[str, str] = {}


def q(name: str, sql: str, views: tuple[str, ...] = (), doubles: tuple[str, ...] = ()):
    SQL[name] = R(*doubles, sql=with_views(sql, *views))


# ------------------------------------------------------------------ fairness (minimum slice)

RATES = """SELECT coalesce(cast(income_band AS VARCHAR), 'unknown') AS "group", count(*) AS total,
  sum(CASE WHEN risk_percent >= 60.0::DOUBLE THEN 1 ELSE 0 END) AS positives
FROM predictions GROUP BY 1"""

q("group_positive_rate", f"""SELECT "group", total, positives, positives / total AS positive_rate
FROM ({RATES}) r""", ("predictions",), ("positive_rate",))

q("disparate_impact", f"""
SELECT 'income_band' AS protected_attribute, n_groups, n_nonzero_groups, min_rate, max_rate,
  CASE WHEN n_nonzero_groups >= 2 THEN min_rate / max_rate ELSE 1.0::DOUBLE END AS disparate_impact_raw,
  CASE WHEN n_nonzero_groups >= 2 THEN round_even(min_rate / max_rate, 3) ELSE 1.0::DOUBLE END AS disparate_impact,
  coalesce(n_nonzero_groups >= 2 AND min_rate / max_rate < 0.8::DOUBLE, false) AS bias_detected,
  CASE WHEN n_nonzero_groups < 2 THEN 'none' WHEN min_rate / max_rate < 0.8::DOUBLE THEN 'reweight_and_retrain'
       ELSE 'monitor_only' END AS mitigation_strategy,
  CASE WHEN n_nonzero_groups < 2 THEN 'Need at least 2 non-zero groups for bias estimation.'
       WHEN min_rate / max_rate < 0.8::DOUBLE THEN 'Bias threshold crossed (DI < 0.8). | Apply sample reweighting for under-represented group outcomes. | Re-evaluate DI and equalized odds after retraining.'
       ELSE 'Parity is within acceptable threshold. | Continue periodic fairness monitoring.' END AS mitigation_report,
  CASE WHEN n_nonzero_groups < 2 THEN 'Insufficient group data to compute disparate impact.'
       ELSE 'Disparate impact closer to 1.0 indicates parity; below 0.8 may indicate bias.' END AS summary
FROM (SELECT count(*) AS n_groups, coalesce(sum(CASE WHEN rate > 0 THEN 1 ELSE 0 END), 0) AS n_nonzero_groups,
        min(CASE WHEN rate > 0 THEN rate END) AS min_rate, max(CASE WHEN rate > 0 THEN rate END) AS max_rate
      FROM (SELECT positives / total AS rate FROM ({RATES}) r) x) a""", ("predictions",),
  ("min_rate", "max_rate", "disparate_impact_raw", "disparate_impact"))


# ------------------------------------------------------------------ evaluation (scored view)

COUNTS = """SELECT count(*) AS n,
  cast(coalesce(sum(CASE WHEN y = 1 AND p >= 0.5::DOUBLE THEN 1 ELSE 0 END), 0) AS BIGINT) AS tp,
  cast(coalesce(sum(CASE WHEN y <> 1 AND p >= 0.5::DOUBLE THEN 1 ELSE 0 END), 0) AS BIGINT) AS fp,
  cast(coalesce(sum(CASE WHEN y <> 1 AND NOT p >= 0.5::DOUBLE THEN 1 ELSE 0 END), 0) AS BIGINT) AS tn,
  cast(coalesce(sum(CASE WHEN y = 1 AND NOT p >= 0.5::DOUBLE THEN 1 ELSE 0 END), 0) AS BIGINT) AS fn FROM scored"""


def sdiv(a, b):
    return f"(CASE WHEN ({b}) = 0 THEN 0.0::DOUBLE ELSE ({a}) / ({b}) END)"


q("confusion_matrix", f"""
SELECT 0 AS actual, 0 AS predicted, tn AS n FROM ({COUNTS}) c UNION ALL
SELECT 0, 1, fp FROM ({COUNTS}) c UNION ALL SELECT 1, 0, fn FROM ({COUNTS}) c UNION ALL
SELECT 1, 1, tp FROM ({COUNTS}) c""", ("scored",))

METRICS = f"""SELECT *, {sdiv('tp + tn', 'n')} AS accuracy, {sdiv('tp', 'tp + fp')} AS precision,
  {sdiv('tp', 'tp + fn')} AS recall, {sdiv('2 * tp', '2 * tp + fp + fn')} AS f1,
  ({sdiv('tn', 'tn + fn')} + {sdiv('tp', 'tp + fp')}) / 2 AS precision_macro,
  ({sdiv('tn', 'tn + fp')} + {sdiv('tp', 'tp + fn')}) / 2 AS recall_macro,
  ({sdiv('2 * tn', '2 * tn + fn + fp')} + {sdiv('2 * tp', '2 * tp + fp + fn')}) / 2 AS f1_macro,
  {sdiv(f"{sdiv('tn', 'tn + fn')} * (tn + fp) + {sdiv('tp', 'tp + fp')} * (tp + fn)", 'tp + fp + tn + fn')} AS precision_weighted,
  {sdiv(f"{sdiv('tn', 'tn + fp')} * (tn + fp) + {sdiv('tp', 'tp + fn')} * (tp + fn)", 'tp + fp + tn + fn')} AS recall_weighted,
  {sdiv(f"{sdiv('2 * tn', '2 * tn + fn + fp')} * (tn + fp) + {sdiv('2 * tp', '2 * tp + fp + fn')} * (tp + fn)", 'tp + fp + tn + fn')} AS f1_weighted,
  tp + fn AS support_pos, tn + fp AS support_neg
FROM ({COUNTS}) c"""

MET_D = ("accuracy", "precision", "recall", "f1", "precision_macro", "recall_macro", "f1_macro",
         "precision_weighted", "recall_weighted", "f1_weighted")
q("classification_metrics", METRICS, ("scored",), MET_D)

q("classification_report", f"""
SELECT 'not' AS class, {sdiv('tn', 'tn + fn')} AS precision, {sdiv('tn', 'tn + fp')} AS recall,
  {sdiv('2 * tn', '2 * tn + fn + fp')} AS f1_score, cast(tn + fp AS DOUBLE) AS support FROM ({METRICS}) m UNION ALL
SELECT 'depressed', precision, recall, f1, cast(tp + fn AS DOUBLE) FROM ({METRICS}) m UNION ALL
SELECT 'accuracy', accuracy, accuracy, accuracy, cast(n AS DOUBLE) FROM ({METRICS}) m UNION ALL
SELECT 'macro avg', precision_macro, recall_macro, f1_macro, cast(n AS DOUBLE) FROM ({METRICS}) m UNION ALL
SELECT 'weighted avg', precision_weighted, recall_weighted, f1_weighted, cast(n AS DOUBLE) FROM ({METRICS}) m""",
  ("scored",), ("precision", "recall", "f1_score", "support"))


def hist(score: str, extra_group: str = "", weight: str = "1", src: str = "scored") -> str:
    g = f"{extra_group}, " if extra_group else ""
    return f"""SELECT {g}cast({score} AS DOUBLE) AS score,
  sum(CASE WHEN y = 1 THEN {weight} ELSE 0 END) AS pos, sum(CASE WHEN y = 1 THEN 0 ELSE {weight} END) AS neg
FROM {src} WHERE {score} IS NOT NULL AND y IS NOT NULL GROUP BY {g}cast({score} AS DOUBLE)"""


def auc_sql(score: str, group: str = "", weight: str = "1", src: str = "scored") -> str:
    part = f"PARTITION BY {group} " if group else ""
    g = f"{group}, " if group else ""
    gb = f"GROUP BY {group}" if group else ""
    return f"""SELECT {g}cast(sum(pos) AS {'DOUBLE' if weight != '1' else 'BIGINT'}) AS n_pos,
  cast(sum(neg) AS {'DOUBLE' if weight != '1' else 'BIGINT'}) AS n_neg,
  CASE WHEN sum(pos) > 0 AND sum(neg) > 0 THEN sum(pos * (neg_cum - neg + neg * 0.5::DOUBLE)) / (sum(pos) * sum(neg)) END AS roc_auc
FROM (SELECT *, sum(neg) OVER ({part}ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS neg_cum
      FROM ({hist(score, group, weight, src)}) h) c {gb}"""


q("roc_auc", auc_sql("p"), ("scored",), ("roc_auc",))

DESC = """SELECT *, sum(pos) OVER (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS tps,
  sum(neg) OVER (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS fps,
  row_number() OVER (ORDER BY score DESC) AS idx FROM ({h}) h"""

q("average_precision", f"""SELECT cast(sum(pos) AS BIGINT) AS n_pos,
  CASE WHEN sum(pos) > 0 THEN sum(pos * tps / (tps + fps)) / sum(pos) END AS average_precision
FROM ({DESC.format(h=hist('p'))}) c""", ("scored",), ("average_precision",))

q("brier_score", """SELECT count(*) AS n, avg(pow(p - CASE WHEN y = 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END, 2)) AS brier_score
FROM scored""", ("scored",), ("brier_score",))

q("roc_curve", f"""
WITH c AS ({DESC.format(h=hist('p2'))}),
t AS (SELECT sum(pos) AS P, sum(neg) AS N FROM c),
l AS (SELECT *, lead(pos) OVER (ORDER BY idx) AS next_pos, lead(neg) OVER (ORDER BY idx) AS next_neg FROM c)
SELECT cast(0 AS BIGINT) AS idx, cast(NULL AS DOUBLE) AS threshold, 0.0::DOUBLE AS fpr, 0.0::DOUBLE AS tpr
UNION ALL
SELECT idx, score, fps / N, tps / P FROM l, t
WHERE idx = 1 OR next_pos IS NULL OR next_pos <> pos OR next_neg <> neg""", ("scored",), ("threshold", "fpr", "tpr"))

q("pr_curve", f"""
WITH c AS ({DESC.format(h=hist('p'))}), t AS (SELECT sum(pos) AS P FROM c)
SELECT idx, score AS threshold, {sdiv('tps', 'tps + fps')} AS precision,
  CASE WHEN P = 0 THEN 1.0::DOUBLE ELSE tps / P END AS recall FROM c, t
UNION ALL SELECT cast(0 AS BIGINT), cast(NULL AS DOUBLE), 1.0::DOUBLE, 0.0::DOUBLE""",
  ("scored",), ("threshold", "precision", "recall"))

_Q = ", ".join(f"{i / 10!r}::DOUBLE" for i in range(1, 10))
q("calibration_curve", f"""
WITH e AS (SELECT quantile_cont(p2, [{_Q}]) AS q FROM scored)
SELECT bin, count(*) AS n, avg(CASE WHEN y = 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS prob_true, avg(p2) AS prob_pred
FROM (SELECT y, p2, ({' + '.join(f'CASE WHEN q[{i}] < p2 THEN 1 ELSE 0 END' for i in range(1, 10))}) AS bin
      FROM scored, e WHERE p2 IS NOT NULL) b GROUP BY bin""", ("scored",), ("prob_true", "prob_pred"))

q("best_accuracy_threshold", f"""
WITH h AS ({hist('p2')}),
cand AS (SELECT DISTINCT round_even(score * 10000.0::DOUBLE, 0) / 10000.0::DOUBLE AS t FROM h),
tot AS (SELECT sum(pos) AS P, sum(pos) + sum(neg) AS n FROM h),
acc AS (SELECT t, (SELECT P FROM tot) - coalesce(sum(CASE WHEN h.score < cand.t THEN h.pos END), 0)
          + coalesce(sum(CASE WHEN h.score < cand.t THEN h.neg END), 0) AS correct
        FROM cand, h GROUP BY t)
SELECT coalesce(round_even(t, 4), 0.5::DOUBLE) AS threshold, correct / (SELECT n FROM tot) AS accuracy
FROM acc ORDER BY correct DESC, t ASC LIMIT 1""", ("scored",), ("threshold", "accuracy"))


def _grid():
    from riskops.operators.evaluate import threshold_grid
    return threshold_grid()


_GRID = ", ".join(f"({i}, {t!r}::DOUBLE)" for i, t in enumerate(_grid()))


def rmet(tp, fp, P, n, pre=""):
    return (f"round_even({sdiv(f'{tp} + ({n} - {P} - {fp})', n)}, 4) AS {pre}accuracy, "
            f"round_even({sdiv(tp, f'{tp} + {fp}')}, 4) AS {pre}precision, "
            f"round_even({sdiv(tp, P)}, 4) AS {pre}recall, "
            f"round_even({sdiv(f'2 * {tp}', f'2 * {tp} + {fp} + ({P} - {tp})')}, 4) AS {pre}f1")


q("recall_tuned_threshold", f"""
WITH g(i, t) AS (VALUES {_GRID}),
tot AS (SELECT sum(CASE WHEN y = 1 THEN 1 ELSE 0 END) AS P, count(*) AS n,
          sum(CASE WHEN y = 1 AND p2 >= 0.5::DOUBLE THEN 1 ELSE 0 END) AS btp,
          sum(CASE WHEN y <> 1 AND p2 >= 0.5::DOUBLE THEN 1 ELSE 0 END) AS bfp FROM scored),
base AS (SELECT *, {rmet('btp', 'bfp', 'P', 'n', 'b_')} FROM tot),
cnt AS (SELECT i, t, sum(CASE WHEN y = 1 AND p2 >= t THEN 1 ELSE 0 END) AS tp,
          sum(CASE WHEN y <> 1 AND p2 >= t THEN 1 ELSE 0 END) AS fp FROM g, scored GROUP BY i, t),
m AS (SELECT cnt.i, cnt.t, base.b_precision, base.b_recall, {rmet('tp', 'fp', 'P', 'n')} FROM cnt, base)
SELECT t AS threshold, accuracy, precision, recall, f1,
  round_even(recall - b_recall, 4) AS recall_gain_vs_0_5, round_even(b_precision - precision, 4) AS precision_drop_vs_0_5
FROM m WHERE precision >= greatest(0.0::DOUBLE, b_precision - 0.04::DOUBLE)
ORDER BY recall DESC, f1 DESC, CASE WHEN t = 0.5::DOUBLE THEN 0 ELSE 1 END, i LIMIT 1""", ("scored",),
  ("threshold", "accuracy", "precision", "recall", "f1", "recall_gain_vs_0_5", "precision_drop_vs_0_5"))


def _mult_sql(u: str) -> str:
    from riskops.operators.evaluate import poisson1_cdf
    cdf = poisson1_cdf(10)
    return "CASE " + " ".join(f"WHEN {u} < {c!r}::DOUBLE THEN {k}" for k, c in enumerate(cdf)) + f" ELSE {len(cdf)} END"


def boot_src(n_boot: int, cols: str) -> str:
    """Rows times replicates with Poisson weights: a quadratic hash polynomial modulo 2^31 - 1 for each replicate."""
    def part(text: str, at: int) -> str:
        return f"cast('0x' || substr(md5({text}), {at}, 8) AS BIGINT) % 2147483647"
    rep = "concat('boot:', cast(range AS VARCHAR))"
    g = "((a * h + b) % 2147483647 * h + c) % 2147483647"
    return f"""(SELECT * FROM (SELECT {cols}, rep, {_mult_sql(f'(cast({g} AS DOUBLE) / 2147483647::DOUBLE)')} AS mult
   FROM (SELECT *, {part("concat('boot|', cast(prediction_id AS VARCHAR))", 1)} AS h FROM scored) s,
     (SELECT cast(range AS INTEGER) AS rep, {part(rep, 1)} AS a, {part(rep, 9)} AS b, {part(rep, 17)} AS c FROM range({n_boot})) r) x
   WHERE mult > 0)"""


q("bootstrap_auc_ci", f"""
SELECT avg(roc_auc) AS auc, quantile_cont(roc_auc, 0.025::DOUBLE) AS ci_lower,
  quantile_cont(roc_auc, 0.975::DOUBLE) AS ci_upper, stddev_pop(roc_auc) AS se, count(*) AS n_bootstraps
FROM ({auc_sql('p', 'rep', 'cast(mult AS DOUBLE)', boot_src(1000, 'prediction_id, p, y'))}) a WHERE roc_auc IS NOT NULL""",
  ("scored",), ("auc", "ci_lower", "ci_upper", "se"))

q("bootstrap_auc_diff", f"""
WITH b AS {boot_src(2000, 'prediction_id, p, p2, y')},
a1 AS ({auc_sql('p', 'rep', 'cast(mult AS DOUBLE)', 'b')}),
a2 AS ({auc_sql('p2', 'rep', 'cast(mult AS DOUBLE)', 'b')}),
d AS (SELECT a1.roc_auc - a2.roc_auc AS d FROM a1 JOIN a2 USING (rep)
      WHERE a1.roc_auc IS NOT NULL AND a2.roc_auc IS NOT NULL)
SELECT avg(d) AS auc_diff_mean, quantile_cont(d, 0.025::DOUBLE) AS ci95_low, quantile_cont(d, 0.975::DOUBLE) AS ci95_high,
  least(1.0::DOUBLE, greatest(0.0::DOUBLE, 2 * least(avg(CASE WHEN d <= 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END),
                                                    avg(CASE WHEN d >= 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)))) AS p_value_two_sided,
  count(*) AS n_bootstraps FROM d""", ("scored",), ("auc_diff_mean", "ci95_low", "ci95_high", "p_value_two_sided"))

view("folded", ["scored"], f"SELECT *, cast(floor({U('fold', 'prediction_id')} * 5) AS INTEGER) AS fold FROM scored")

q("cv_summary", f"""
WITH a AS ({auc_sql('p2', 'fold', '1', 'folded')}),
f AS (SELECT fold, {sdiv('2 * tp', '2 * tp + fp + fn')} AS f1 FROM (
   SELECT fold, sum(CASE WHEN y = 1 AND p2 >= 0.5::DOUBLE THEN 1 ELSE 0 END) AS tp,
     sum(CASE WHEN y <> 1 AND p2 >= 0.5::DOUBLE THEN 1 ELSE 0 END) AS fp,
     sum(CASE WHEN y = 1 AND NOT p2 >= 0.5::DOUBLE THEN 1 ELSE 0 END) AS fn FROM folded GROUP BY fold) c)
SELECT count(*) AS n_folds, avg(roc_auc) AS auc_mean, stddev_pop(roc_auc) AS auc_std, avg(f1) AS f1_mean,
  stddev_pop(f1) AS f1_std FROM a JOIN f USING (fold)""", ("folded",), ("auc_mean", "auc_std", "f1_mean", "f1_std"))

def class_rank(seed: str, id_expr: str) -> str:
    return f"row_number() OVER (PARTITION BY y ORDER BY {U(seed, id_expr)}, {id_expr}) - 1"


TEST_ROWS = "floor(count(*) OVER (PARTITION BY y) * 0.2::DOUBLE + 0.5::DOUBLE)"
q("stratified_split", f"""SELECT prediction_id, y,
  CASE WHEN {class_rank('split', 'prediction_id')} < {TEST_ROWS} THEN 'test' ELSE 'train' END AS split FROM scored""", ("scored",))

q("stratified_folds", f"""SELECT prediction_id, y, cast(({class_rank('fold', 'prediction_id')}) % 5 AS INTEGER) AS fold
FROM scored""", ("scored",))

PROFILE_KEY = ("concat_ws(chr(31), coalesce(cast(l_quantity AS VARCHAR), 'nan'), coalesce(cast(l_discount AS VARCHAR), 'nan'), "
               "coalesce(cast(l_tax AS VARCHAR), 'nan'), coalesce(cast(l_returnflag AS VARCHAR), 'nan'), "
               "coalesce(cast(l_linestatus AS VARCHAR), 'nan'))")

#: Profiles sorted by positives and other rows, dealt out in turn.
PROFILE_FOLDS = f"""SELECT pk, cast((row_number() OVER (ORDER BY n_pos, n_neg, {U('gfold', 'pk')}, pk) - 1) % 5 AS INTEGER) AS fold
  FROM (SELECT {PROFILE_KEY} AS pk, sum(CASE WHEN y = 1 THEN 1 ELSE 0 END) AS n_pos, sum(CASE WHEN y = 1 THEN 0 ELSE 1 END) AS n_neg
    FROM profiles GROUP BY 1) g"""

q("group_folds", f"""SELECT l_orderkey, l_linenumber, fold FROM (SELECT *, {PROFILE_KEY} AS pk FROM profiles) p
JOIN ({PROFILE_FOLDS}) f USING (pk)""", ("profiles",))


# ------------------------------------------------------------------ coercion / harmonisation / features


def norm(c):
    return f"lower(trim(cast({c} AS VARCHAR)))"


def to_dbl(c):
    return f"TRY_CAST({c} AS DOUBLE)"


def yes_no(c, yes=("yes",), no=("no",), fallback=False):
    ys = ", ".join(f"'{x}'" for x in yes)
    ns = ", ".join(f"'{x}'" for x in no)
    other = to_dbl(c) if fallback else "NULL"
    return f"(CASE WHEN {norm(c)} IN ({ys}) THEN 1.0::DOUBLE WHEN {norm(c)} IN ({ns}) THEN 0.0::DOUBLE ELSE {other} END)"


def clip_sql(x, lo, hi):
    return f"(CASE WHEN ({x}) IS NULL THEN NULL ELSE least(greatest({x}, {D(lo)}), {D(hi)}) END)"


q("coerce_numeric", f"SELECT row_id, {to_dbl('epds_score')} AS epds_score FROM raw_survey", ("raw_survey",), ("epds_score",))
q("coerce_yes_no", f"SELECT row_id, {yes_no('money', fallback=True)} AS money FROM raw_survey", ("raw_survey",), ("money",))
q("ordinal_map", f"""SELECT row_id, CASE {norm('relation')} WHEN 'poor' THEN 0.0::DOUBLE WHEN 'moderate' THEN 1.0::DOUBLE
  WHEN 'good' THEN 2.0::DOUBLE END AS support_score FROM raw_survey""", ("raw_survey",), ("support_score",))

LEN_NUM = f"NULLIF(regexp_extract({norm('length_text')}, '(\\d+(?:\\.\\d+)?)', 1), '')"
q("parse_length_weeks", f"""SELECT row_id, {clip_sql(f'TRY_CAST({LEN_NUM} AS DOUBLE) * 4.345::DOUBLE', 1, 42)} AS gestational_weeks
FROM raw_survey""", ("raw_survey",), ("gestational_weeks",))

q("gestation_from_dates", f"""SELECT row_id, {clip_sql(
    "40.0::DOUBLE - date_diff('day', CAST(try_strptime(trim(eval_date), '%d/%m/%Y') AS DATE), "
    "CAST(try_strptime(trim(due_date), '%d/%m/%Y') AS DATE)) / 7.0::DOUBLE", 1, 42)} AS gestational_weeks
FROM (SELECT *, strftime(DATE '1992-01-01' + CAST(row_id % 3000 AS INTEGER), '%d/%m/%Y') AS due_date FROM raw_survey) r""",
  ("raw_survey",), ("gestational_weeks",))

q("composite_scores", f"""SELECT row_id,
  (coalesce({yes_no('money', ('no',), ('yes',))}, 0.0::DOUBLE) + coalesce({yes_no('epds_result', ('high',), ('low',))}, 0.0::DOUBLE)) * 1.5::DOUBLE AS sleep_score,
  {yes_no('epds_result', ('high',), ('low',))} * 3.0::DOUBLE AS low_mood_score,
  CASE WHEN coalesce({to_dbl('epds_score')}, 0.0::DOUBLE) + coalesce({to_dbl('length_text')}, 0.0::DOUBLE) > 0
       THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS prior_pregnancy_loss
FROM raw_survey""", ("raw_survey",), ("sleep_score", "low_mood_score", "prior_pregnancy_loss"))

_NULLS = ("support_score", "sleep_score", "fatigue_score", "low_mood_score", "suicidal_ideation_score",
          "economic_stress_score")
_N = ", ".join(f"NULL::DOUBLE AS {c}" for c in _NULLS)
view("harmonized", [], f"""
SELECT concat('main:', cast(o_orderkey AS VARCHAR)) AS row_id, cast(c_custkey % 44 + 12 AS DOUBLE) AS age,
  cast(o_orderkey % 42 + 1 AS DOUBLE) AS gestational_weeks,
  cast(CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 0 END AS DOUBLE) AS prior_pregnancy_loss, {_N},
  NULL::DOUBLE AS anxiety_score, CAST(CASE WHEN o_totalprice >= 250000 THEN 1 ELSE 0 END AS INTEGER) AS target, 'main' AS source
FROM orders JOIN customer ON o_custkey = c_custkey
UNION ALL
SELECT concat('ppd:', cast(l_orderkey * 10 + l_linenumber AS VARCHAR)), NULL::DOUBLE, cast(l_quantity AS DOUBLE), NULL::DOUBLE,
  {_N}, NULL::DOUBLE, CAST(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS INTEGER), 'ppd' FROM lineitem
UNION ALL
SELECT concat('uganda:', cast(event_id AS VARCHAR)), cast(user_id % 44 + 12 AS DOUBLE), NULL::DOUBLE,
  cast(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS DOUBLE), {_N}, value,
  CAST(CASE WHEN value >= 60 THEN 1 ELSE 0 END AS INTEGER), 'uganda' FROM events""")

_HF = ("age", "gestational_weeks", "prior_pregnancy_loss") + _NULLS + ("anxiety_score",)
q("harmonize_sources", "SELECT * FROM harmonized", ("harmonized",), _HF)

q("label_rules", f"""SELECT row_id, CAST(coalesce({to_dbl('epds_score')} >= 13.0::DOUBLE, false)
  OR coalesce({norm('epds_result')} IN ('high'), false) AS INTEGER) AS target FROM raw_survey""", ("raw_survey",))

q("drop_incomplete", """SELECT row_id, epds_score, relation FROM raw_survey
WHERE epds_score IS NOT NULL AND relation IS NOT NULL""", ("raw_survey",))

q("validate_inputs", """SELECT message_id,
  CASE WHEN message IS NULL THEN 'message missing'
       WHEN length(message) < 3 OR length(message) > 5000 THEN 'message length out of range [3, 5000]' END AS reject_reason,
  NOT (message IS NULL OR length(message) < 3 OR length(message) > 5000) AS valid FROM messages""", ("messages",))


_REQUEST = {  # column: (shift, low, high)
    "gestational_weeks": ("+ k % 5 - 1", 1, 42), "sleep_quality": ("+ k % 3", 0, 10), "appetite": ("- k % 2", 0, 10),
    "fatigue": ("+ k % 4", 0, 10), "financial_stress": ("+ k % 2", 0, 10), "age": ("+ k % 20 - 5", 12, 55),
    "self_harm": ("+ k % 7", 0, 5),
}
_REASON = "CASE " + " ".join(
    f"WHEN {c} {d} IS NULL THEN '{c} missing' WHEN {c} {d} < {lo} OR {c} {d} > {hi} THEN '{c} out of range [{lo}, {hi}]'"
    for c, (d, lo, hi) in _REQUEST.items()) + " END"
q("validate_requests", f"SELECT prediction_id, {_REASON} IS NULL AS valid, {_REASON} AS reject_reason FROM assessments",
  ("assessments",))


def bround0(x):
    return f"round_even({x}, 0)"


def _mapped():
    s, a, f, st, sh = ("cast(sleep_quality AS DOUBLE)", "cast(appetite AS DOUBLE)", "cast(fatigue AS DOUBLE)",
                       "cast(financial_stress AS DOUBLE)", "cast(self_harm AS DOUBLE)")
    sleep = bround0(f"(10.0::DOUBLE - {s}) / 10.0::DOUBLE * 3")
    app = bround0(f"(10.0::DOUBLE - {a}) / 10.0::DOUBLE * 3")
    fat = bround0(f"{f} / 10.0::DOUBLE * 3")
    money = bround0(f"(10.0::DOUBLE - {st}) / 10.0::DOUBLE * 3")
    harm = bround0(f"{sh} / 5.0::DOUBLE * 3")
    return [
        ("Age", "cast(age AS DOUBLE)"), ("Gestational Age", "cast(gestational_weeks AS DOUBLE)"),
        ("Trouble falling or staying sleep or sleeping too much", sleep), ("Poor appetite or overeating", app),
        ("Feeling tired or having little energy", fat), ("Sufficient Money for Basic Needs", money),
        ("Thoughts that you would be better off dead, or of hurting yourself", harm),
        ("age", "cast(age AS DOUBLE)"), ("gestational_weeks", "cast(gestational_weeks AS DOUBLE)"),
        ("prior_pregnancy_loss", "0.0::DOUBLE"),
        ("support_score", bround0(f"(10.0::DOUBLE - {st}) / 10.0::DOUBLE * 2")), ("sleep_score", sleep),
        ("fatigue_score", fat), ("low_mood_score", bround0(f"((10.0::DOUBLE - {s}) + {f}) / 20.0::DOUBLE * 3")),
        ("suicidal_ideation_score", harm), ("economic_stress_score", bround0(f"{st} / 10.0::DOUBLE * 3")),
        ("anxiety_score", f"round_even(({f} + (10.0::DOUBLE - {s}) + (10.0::DOUBLE - {a})) / 30.0::DOUBLE * 10.0::DOUBLE, 2)"),
    ]


_MAPPED = [("harmonized_age" if n == "age" else n, e) for n, e in _mapped()]
q("map_features", "SELECT prediction_id, " + ", ".join(f'{e} AS "{n}"' for n, e in _MAPPED) + " FROM assessments",
  ("assessments",), tuple(f'"{n}"' for n, _ in _MAPPED))

_FB = [
    ("Age", "coalesce(cast(age AS DOUBLE), 0.0::DOUBLE)"),
    ("Gestational Age", "coalesce(cast(gestational_weeks AS DOUBLE), 0.0::DOUBLE)"),
    ("Trouble falling or staying sleep or sleeping too much",
     bround0("(10.0::DOUBLE - coalesce(cast(sleep_quality AS DOUBLE), 5.0::DOUBLE)) / 10.0::DOUBLE * 3")),
    ("Poor appetite or overeating", bround0("(10.0::DOUBLE - coalesce(cast(appetite AS DOUBLE), 5.0::DOUBLE)) / 10.0::DOUBLE * 3")),
    ("Feeling tired or having little energy", bround0("coalesce(cast(fatigue AS DOUBLE), 5.0::DOUBLE) / 10.0::DOUBLE * 3")),
    ("Sufficient Money for Basic Needs",
     bround0("(10.0::DOUBLE - coalesce(cast(financial_stress AS DOUBLE), 5.0::DOUBLE)) / 10.0::DOUBLE * 3")),
    ("Thoughts that you would be better off dead, or of hurting yourself", "coalesce(cast(self_harm AS DOUBLE), 0.0::DOUBLE)"),
]
q("feedback_features", "SELECT prediction_id, " + ", ".join(f'{e} AS "{n}"' for n, e in _FB) + " FROM assessments",
  ("assessments",), tuple(f'"{n}"' for n, _ in _FB))

q("numeric_proxy", """SELECT row_id,
  cast(dense_rank() OVER (ORDER BY coalesce(relation, 'nan')) - 1 AS DOUBLE) AS relation_proxy,
  TRY_CAST(epds_score AS DOUBLE) AS epds_proxy FROM raw_survey""", ("raw_survey",), ("relation_proxy", "epds_proxy"))

q("interaction_features", """SELECT o_orderkey,
  cast(c_custkey % 44 + 12 AS DOUBLE) * cast(o_orderkey % 6 AS DOUBLE) AS Age_x_Gravida,
  cast(c_nationkey % 5 AS DOUBLE) - cast(c_nationkey % 4 AS DOUBLE) AS Education_Gap,
  cast(o_orderkey % 4 AS DOUBLE) / (cast(c_custkey % 44 + 12 AS DOUBLE) + 1.0::DOUBLE) AS Children_to_Age,
  (CASE lower(trim(o_orderstatus)) WHEN 'f' THEN 1.0::DOUBLE WHEN 'o' THEN 0.0::DOUBLE END) * cast(o_orderkey % 6 AS DOUBLE) AS Miscarriage_x_Gravida,
  (CASE WHEN c_acctbal > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) * cast(c_custkey % 3 AS DOUBLE) AS Money_x_FamilySystem
FROM orders JOIN customer ON o_custkey = c_custkey""", (),
  ("Age_x_Gravida", "Education_Gap", "Children_to_Age", "Miscarriage_x_Gravida", "Money_x_FamilySystem"))

_RS_COLS = [("row_id", "bigint", "numeric"), ("money", "string", "categorical"), ("relation", "string", "categorical"),
            ("length_text", "string", "categorical"), ("eval_date", "string", "categorical"),
            ("epds_score", "string", "categorical"), ("epds_result", "string", "categorical")]
q("audit_schema", " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", '{t}' AS dtype, '{k}' AS kind, {str(any(w in c for w in ('date', 'time', 'year'))).lower()} AS is_temporal, "
    f"count({c}) AS non_null FROM raw_survey" for c, t, k in _RS_COLS), ("raw_survey",))

q("impute_values", """WITH r AS (SELECT row_id, TRY_CAST(epds_score AS DOUBLE) AS epds_score, relation FROM raw_survey),
med AS (SELECT quantile_cont(epds_score, 0.5::DOUBLE) AS m FROM r),
mode AS (SELECT relation AS v FROM r WHERE relation IS NOT NULL GROUP BY relation ORDER BY count(*) DESC, relation LIMIT 1)
SELECT row_id, coalesce(epds_score, (SELECT m FROM med)) AS epds_score, coalesce(relation, (SELECT v FROM mode)) AS relation
FROM r""", ("raw_survey",), ("epds_score",))

q("standard_scale", """SELECT l_orderkey, l_linenumber,
  (l_quantity - (SELECT avg(l_quantity) FROM profiles)) / (SELECT stddev_pop(l_quantity) FROM profiles) AS l_quantity,
  (l_discount - (SELECT avg(l_discount) FROM profiles)) / (SELECT stddev_pop(l_discount) FROM profiles) AS l_discount
FROM profiles""", ("profiles",), ("l_quantity", "l_discount"))

q("one_hot", "SELECT l_orderkey, l_linenumber, " + ", ".join(
    f"CASE WHEN {c} = '{v}' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS {c}_{v}"
    for c, vs in (("l_returnflag", "ANR"), ("l_linestatus", "FO")) for v in vs) + " FROM profiles", ("profiles",),
  tuple(f"{c}_{v}" for c, vs in (("l_returnflag", "ANR"), ("l_linestatus", "FO")) for v in vs))

_PR = "l_quantity, l_discount, l_tax, l_returnflag, l_linestatus, y"
q("dedup_counts", f"""SELECT sum(n) AS before_rows, count(*) AS after_rows, sum(n) - count(*) AS dropped_exact_duplicate_rows
FROM (SELECT {_PR}, count(*) AS n FROM profiles GROUP BY {_PR}) g""", ("profiles",))
SQL["dedup_counts"] = SQL["dedup_counts"].replace("SELECT sum(n) AS before_rows", "SELECT cast(sum(n) AS BIGINT) AS before_rows") \
    .replace("sum(n) - count(*) AS dropped", "cast(sum(n) - count(*) AS BIGINT) AS dropped")

q("profile_duplicates", f"""SELECT cast(sum(rws) AS BIGINT) AS after_rows, count(*) AS unique_profiles_after_dedup,
  cast(sum(rws) - count(*) AS BIGINT) AS profile_duplicate_rows_after_dedup
FROM (SELECT {PROFILE_KEY} AS p, count(*) AS rws FROM (SELECT DISTINCT {_PR} FROM profiles) d GROUP BY 1) g""", ("profiles",))

OVERSAMPLE = f"""WITH c AS (SELECT target, count(*) AS n FROM harmonized WHERE target IS NOT NULL GROUP BY target),
d AS (SELECT target, j, cast(floor({U('os', "concat(cast(target AS VARCHAR), '|', cast(j AS VARCHAR))")} * n) AS BIGINT) AS k
      FROM c, range((SELECT max(n) FROM c)) t(j)),
r AS (SELECT row_id, target, row_number() OVER (PARTITION BY target ORDER BY {U('os', 'row_id')}, row_id) - 1 AS k
      FROM harmonized WHERE target IS NOT NULL)
SELECT row_id, target, CAST(row_number() OVER (PARTITION BY target, k ORDER BY j) - 1 AS INTEGER) AS copy FROM r JOIN d USING (target, k)"""

q("oversample", OVERSAMPLE, ("harmonized",))

q("class_balance", f"""SELECT 'before' AS phase, source, target, count(*) AS n FROM harmonized GROUP BY source, target
UNION ALL SELECT 'after', 'all', target, count(*) FROM ({OVERSAMPLE.replace('WITH c AS', 'WITH c AS', 1)}) o GROUP BY target""",
  ("harmonized",))

view("vectors", [], "SELECT vec_id AS row_id, embedding, CASE WHEN label = 5 THEN 1 ELSE 0 END AS y FROM embeddings")

#: All pairs of minority rows: the brute force that the pruned join must equal.
MINORITY = """m AS (SELECT row_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM vectors
  WHERE y = 1 AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
nn AS (SELECT * FROM (SELECT a.row_id, b.row_id AS neighbor_id, list_distance(a.v, b.v) AS distance,
    CAST(row_number() OVER (PARTITION BY a.row_id ORDER BY list_distance(a.v, b.v), b.row_id) AS INTEGER) AS rank
  FROM m a JOIN m b ON a.row_id <> b.row_id) t WHERE rank <= 5)"""
q("smote_neighbors", f"WITH {MINORITY} SELECT row_id, neighbor_id, rank, distance FROM nn", ("vectors",), ("distance",))

q("smote_rows", f"""WITH {MINORITY},
r AS (SELECT *, row_number() OVER (ORDER BY {U('smote', 'row_id')}, row_id) - 1 AS k, count(*) OVER () AS n
  FROM m JOIN (SELECT row_id, max(rank) AS degree FROM nn GROUP BY row_id) g USING (row_id)),
s AS (SELECT y, count(*) AS n FROM vectors GROUP BY y),
d AS (SELECT draw FROM range((SELECT max(n) - max(CASE WHEN y = 1 THEN n END) FROM s)) t(draw)),
x AS (SELECT draw, r.*, CAST(floor({U('smote:nn', 'draw')} * degree) AS INTEGER) + 1 AS rank, {U('smote:gap', 'draw')} AS g
  FROM d JOIN r ON r.k = CAST(floor({U('smote', 'draw')} * r.n) AS BIGINT))
SELECT x.draw, x.row_id, len(x.v) AS dim, 1 AS y, list_sum(list_transform(range(1, len(x.v) + 1), lambda i: x.v[i] + x.g * (b.v[i] - x.v[i]))) AS vec_sum
FROM x JOIN nn ON nn.row_id = x.row_id AND nn.rank = x.rank JOIN m b ON b.row_id = nn.neighbor_id""", ("vectors",), ("vec_sum",))

q("class_weights", """SELECT target AS label, n_c, n / (k * n_c) AS weight, CASE WHEN pos > 0 THEN (n - pos) / pos END AS scale_pos_weight
FROM (SELECT target, count(*) AS n_c FROM harmonized GROUP BY target) c,
     (SELECT count(*) AS n, count(DISTINCT target) AS k, sum(CASE WHEN target = 1 THEN 1 ELSE 0 END) AS pos FROM harmonized) t""",
  ("harmonized",), ("weight", "scale_pos_weight"))

q("label_quality_audit", f"""SELECT count(*) AS "rows",
  avg(CASE WHEN coalesce({to_dbl('epds_score')} >= 10.0::DOUBLE, false) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS positive_rate,
  cast(sum(CASE WHEN coalesce({to_dbl('epds_score')} >= 10.0::DOUBLE, false) THEN 1 ELSE 0 END) AS BIGINT) AS positive_count,
  cast(sum(CASE WHEN coalesce({to_dbl('epds_score')} >= 10.0::DOUBLE, false) THEN 0 ELSE 1 END) AS BIGINT) AS negative_count,
  cast(sum(CASE WHEN coalesce({to_dbl('epds_score')} >= 9.0::DOUBLE AND {to_dbl('epds_score')} <= 11.0::DOUBLE, false) THEN 1 ELSE 0 END) AS BIGINT) AS near_threshold_rows,
  min({to_dbl('epds_score')}) AS score_min, max({to_dbl('epds_score')}) AS score_max FROM raw_survey""", ("raw_survey",),
  ("positive_rate", "score_min", "score_max"))

q("split_overlap", f"""WITH p AS (SELECT *, {class_rank('split', '(l_orderkey * 10 + l_linenumber)')} < {TEST_ROWS} AS is_test
  FROM (SELECT *, {PROFILE_KEY} AS pk FROM profiles) k JOIN ({PROFILE_FOLDS}) f USING (pk))
SELECT 'row_split' AS split_kind, count(*) AS overlap FROM (SELECT DISTINCT pk FROM p WHERE NOT is_test) a
  WHERE pk IN (SELECT pk FROM p WHERE is_test)
UNION ALL SELECT 'group_split', count(*) FROM (SELECT DISTINCT pk FROM p WHERE fold <> 0) a
  WHERE pk IN (SELECT pk FROM p WHERE fold = 0)""", ("profiles",))


# ------------------------------------------------------------------ sources

q("scan_contract", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem", (), ("l_quantity",))
q("scan_documents", "SELECT source, length(text) AS n_chars, len(string_split(text, chr(10))) AS n_lines FROM guidelines",
  ("guidelines",))
q("scan_prediction_log", "SELECT income_band AS group_value, risk_percent, prediction_id FROM predictions",
  ("predictions",), ("risk_percent",))
q("parse_props", """SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
  props IS NOT NULL AND json_valid(props) AS valid FROM events""")
_ORD = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]
_ROW = "concat_ws(chr(31), " + ", ".join(f"coalesce(cast({c} AS VARCHAR), 'nan')" for c in _ORD) + ")"
q("dataset_fingerprint", f"""SELECT count(*) AS n_rows,
  cast(sum(cast('0x' || substr(md5({_ROW}), 1, 8) AS BIGINT)) AS BIGINT) AS fingerprint FROM orders""")

# ------------------------------------------------------------------ risk scoring / explanation

CRISIS_REASON = """CASE WHEN self_harm > 0 THEN 'self-harm indicator'
  WHEN sleep_quality <= 2 AND appetite <= 2 AND fatigue >= 9 THEN 'critical behavioral threshold cluster' END"""
q("crisis_override", f"""SELECT prediction_id, ({CRISIS_REASON}) IS NOT NULL AS crisis_mode, {CRISIS_REASON} AS crisis_reason,
  CASE WHEN ({CRISIS_REASON}) IS NOT NULL THEN 100.0::DOUBLE END AS override_risk FROM assessments""",
  ("assessments",), ("override_risk",))

HEUR = """greatest(0.0::DOUBLE, least(100.0::DOUBLE, (((gestational_weeks / 42.0::DOUBLE * 10.0::DOUBLE) * 0.25::DOUBLE
    + (10.0::DOUBLE - sleep_quality) * 0.25::DOUBLE + (10.0::DOUBLE - appetite) * 0.15::DOUBLE
    + cast(fatigue AS DOUBLE) * 0.2::DOUBLE + cast(financial_stress AS DOUBLE) * 0.15::DOUBLE)
    / 10.0::DOUBLE * 100.0::DOUBLE)))"""
q("heuristic_risk", f"SELECT prediction_id, {HEUR} AS heuristic_risk FROM assessments", ("assessments",), ("heuristic_risk",))

_TERMS = [("gestational_weeks", "(gestational_weeks / 42.0::DOUBLE * 10.0::DOUBLE) * 0.25::DOUBLE"),
          ("sleep_quality", "(10.0::DOUBLE - sleep_quality) * 0.25::DOUBLE"),
          ("appetite", "(10.0::DOUBLE - appetite) * 0.15::DOUBLE"),
          ("fatigue", "cast(fatigue AS DOUBLE) * 0.2::DOUBLE"),
          ("financial_stress", "cast(financial_stress AS DOUBLE) * 0.15::DOUBLE")]
_TOTAL = " + ".join(f"greatest({e}, 0.0::DOUBLE)" for _, e in _TERMS)
CONTRIB = "SELECT prediction_id, feature, ord, v AS contribution, CASE WHEN total <= 0 THEN 0.0::DOUBLE ELSE " \
    "round_even(greatest(v, 0.0::DOUBLE) / total * 100.0::DOUBLE, 2) END AS contribution_percent FROM (" + \
    " UNION ALL ".join(f"SELECT prediction_id, '{n}' AS feature, {i} AS ord, {e} AS v, {_TOTAL} AS total "
                       f"FROM assessments WHERE NOT coalesce(({CRISIS_REASON}) IS NOT NULL, false)"
                       for i, (n, e) in enumerate(_TERMS)) + ") t"
q("risk_contributions", CONTRIB, ("assessments",), ("contribution", "contribution_percent"))
q("contribution_rank", f"""SELECT *, row_number() OVER (PARTITION BY prediction_id ORDER BY contribution_percent DESC, ord)
  AS rank FROM ({CONTRIB}) c""", ("assessments",), ("contribution", "contribution_percent"))
SQL["contribution_rank"] = SQL["contribution_rank"].replace("AS rank FROM", "AS rank FROM", 1)

# ------------------------------------------------------------------ more fairness

_TS = [40.0, 50.0, 60.0, 70.0]
q("di_by_threshold", "WITH g AS (SELECT coalesce(income_band, 'unknown') AS grp, count(*) AS total, " +
  ", ".join(f"sum(CASE WHEN risk_percent >= {D(t)} THEN 1 ELSE 0 END) AS c{i}" for i, t in enumerate(_TS)) +
  " FROM predictions GROUP BY 1), l AS (" +
  " UNION ALL ".join(f"SELECT {D(t)} AS threshold, c{i} / total AS rate FROM g" for i, t in enumerate(_TS)) +
  """) SELECT threshold, n_nonzero_groups, min_rate, max_rate, min_rate / max_rate AS disparate_impact_raw,
  round_even(min_rate / max_rate, 3) AS disparate_impact FROM (
  SELECT threshold, cast(sum(CASE WHEN rate > 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_nonzero_groups,
    min(CASE WHEN rate > 0 THEN rate END) AS min_rate, max(CASE WHEN rate > 0 THEN rate END) AS max_rate
  FROM l GROUP BY threshold) x WHERE n_nonzero_groups >= 2""", ("predictions",),
  ("threshold", "min_rate", "max_rate", "disparate_impact_raw", "disparate_impact"))

RATES2 = f"SELECT \"group\", positives / total AS positive_rate FROM ({RATES}) r"
q("fairness_status", f"""SELECT "group", positive_rate, CASE WHEN positive_rate >= max(positive_rate) OVER () * 0.8::DOUBLE
  THEN 'Fair' ELSE 'Bias' END AS status FROM ({RATES2}) r""", ("predictions",), ("positive_rate",))
q("fairness_deviation", f"""SELECT "group", positive_rate, deviation,
  CASE WHEN deviation > 0.2::DOUBLE THEN 'high_bias' WHEN deviation > 0.1::DOUBLE THEN 'moderate_bias' ELSE 'fair' END AS band
FROM (SELECT "group", positive_rate, CASE WHEN avg(positive_rate) OVER () > 0
  THEN abs(positive_rate - avg(positive_rate) OVER ()) / avg(positive_rate) OVER () ELSE 0.0::DOUBLE END AS deviation
  FROM ({RATES2}) r) x""", ("predictions",), ("positive_rate", "deviation"))

view("flagged", ["predictions"], """SELECT *, CAST(risk_percent >= 60.0::DOUBLE AS INTEGER) AS high_risk,
  coalesce(cast(income_band AS VARCHAR), 'unknown') AS grp FROM predictions""")
REWEIGH = """SELECT grp AS "group", high_risk AS label, n_gy, n_g, n_y, n, (n_g * n_y) / (n * n_gy) AS weight FROM (
  SELECT grp, high_risk, n_gy, sum(n_gy) OVER (PARTITION BY grp) AS n_g, sum(n_gy) OVER (PARTITION BY high_risk) AS n_y,
    sum(n_gy) OVER () AS n FROM (SELECT grp, high_risk, count(*) AS n_gy FROM flagged GROUP BY 1, 2) a) b"""
q("fairness_reweigh", REWEIGH, ("flagged",), ("weight",))
SQL["fairness_reweigh"] = SQL["fairness_reweigh"].replace("sum(n_gy) OVER (PARTITION BY grp) AS n_g",
                                                          "cast(sum(n_gy) OVER (PARTITION BY grp) AS BIGINT) AS n_g") \
    .replace("sum(n_gy) OVER (PARTITION BY high_risk) AS n_y", "cast(sum(n_gy) OVER (PARTITION BY high_risk) AS BIGINT) AS n_y") \
    .replace("sum(n_gy) OVER () AS n FROM", "cast(sum(n_gy) OVER () AS BIGINT) AS n FROM")

q("mitigation_effect", f"""WITH w AS ({REWEIGH}),
b AS (SELECT 'before' AS phase, grp, sum(1.0::DOUBLE * high_risk) / sum(1.0::DOUBLE) AS rate FROM flagged GROUP BY grp),
a AS (SELECT 'after' AS phase, f.grp, sum(w.weight * f.high_risk) / sum(w.weight) AS rate
      FROM flagged f JOIN w ON w."group" = f.grp AND w.label = f.high_risk GROUP BY f.grp),
per AS (SELECT phase, sum(CASE WHEN rate > 0 THEN 1 ELSE 0 END) AS k,
   min(CASE WHEN rate > 0 THEN rate END) / max(CASE WHEN rate > 0 THEN rate END) AS r FROM (SELECT * FROM b UNION ALL SELECT * FROM a) u
   GROUP BY phase),
d AS (SELECT max(CASE WHEN phase = 'before' THEN CASE WHEN k >= 2 THEN r ELSE 1.0::DOUBLE END END) AS before_di,
             max(CASE WHEN phase = 'after' THEN CASE WHEN k >= 2 THEN r ELSE 1.0::DOUBLE END END) AS after_di FROM per)
SELECT 'income_band' AS protected_attribute, before_di, after_di, after_di - before_di AS improvement FROM d""",
  ("flagged",), ("before_di", "after_di", "improvement"))

view("scored_g", ["scored"], "SELECT *, coalesce(cast(income_band AS VARCHAR), 'unknown') AS grp FROM scored")
q("fairness_auc_gap", f"""SELECT count(*) AS n_groups, min(roc_auc) AS min_auc, max(roc_auc) AS max_auc,
  max(roc_auc) - min(roc_auc) AS auc_gap FROM ({auc_sql('p2', 'grp', '1', 'scored_g')}) a WHERE roc_auc IS NOT NULL""",
  ("scored_g",), ("min_auc", "max_auc", "auc_gap"))

_ATTRS = [("income_band", "cast(income_band AS VARCHAR)"),
          ("age_band", "cast(cast(floor(age / 10) * 10 AS BIGINT) AS VARCHAR)"),
          ("event_type", "event_type")]
DI_ALL = " UNION ALL ".join(f"""SELECT '{n}' AS protected_attribute, n_nz >= 2 AND mn / mx < 0.8::DOUBLE AS bias_detected,
  CASE WHEN n_nz >= 2 THEN round_even(mn / mx, 3) ELSE 1.0::DOUBLE END AS disparate_impact FROM (
  SELECT sum(CASE WHEN rate > 0 THEN 1 ELSE 0 END) AS n_nz, min(CASE WHEN rate > 0 THEN rate END) AS mn,
    max(CASE WHEN rate > 0 THEN rate END) AS mx FROM (
    SELECT coalesce({e}, 'unknown') AS g, sum(CASE WHEN risk_percent >= 60.0::DOUBLE THEN 1 ELSE 0 END) / count(*) AS rate
    FROM predictions GROUP BY 1) r) s""" for n, e in _ATTRS)
q("mitigation_queue", f"""SELECT 'fairness_monitor' AS requested_by, 50 AS min_feedback_samples, 'risk_model' AS current_model,
  'queued_auto_mitigation' AS status, 'fairness_auto' AS "trigger", protected_attribute, 60.0::DOUBLE AS operating_threshold,
  disparate_impact FROM ({DI_ALL}) d WHERE bias_detected""", ("predictions",), ("operating_threshold", "disparate_impact"))

# ------------------------------------------------------------------ logs, joins, timelines

LATEST_CONSENT = """SELECT patient_id, ts, seq, consent_given, consent_scope FROM (
  SELECT *, row_number() OVER (PARTITION BY patient_id ORDER BY ts DESC, seq DESC) AS rn FROM consents) c WHERE rn = 1"""
q("consent_latest", f"""SELECT patient_id, ts, seq, consent_given, array_to_string(consent_scope, ' | ') AS consent_scope
FROM ({LATEST_CONSENT}) l""", ("consents",))

q("consent_gate", f"""SELECT a.prediction_id, a.patient_id, r.reason, r.reason IS NULL AS allowed FROM assessments a
LEFT JOIN ({LATEST_CONSENT}) c ON a.patient_id = c.patient_id,
LATERAL (SELECT CASE WHEN a.patient_id IS NULL OR a.patient_id = '' THEN NULL
  WHEN c.patient_id IS NULL THEN 'Consent record required for patient'
  WHEN NOT coalesce(c.consent_given, false) THEN 'Consent not granted by patient'
  WHEN NOT coalesce(list_contains(c.consent_scope, 'risk_scoring'), false) THEN 'Consent scope missing: risk_scoring'
  END AS reason) r""", ("assessments", "consents"))

FB_ROWS = "SELECT f.prediction_id, f.clinician_label, CASE lower(trim(f.clinician_label)) WHEN 'high' THEN 'Depressed' " \
    "WHEN 'low' THEN 'Not' END AS \"Labelling\", " + ", ".join(f'{e} AS "{n}"' for n, e in _FB) + \
    " FROM feedback f JOIN predictions p ON f.prediction_id = p.prediction_id " \
    "WHERE lower(trim(f.clinician_label)) IN ('high', 'low')"
_FBD = tuple(f'"{n}"' for n, _ in _FB)
q("feedback_training_rows", FB_ROWS, ("feedback", "predictions"), _FBD)

q("feedback_orphans", """SELECT f.prediction_id, f.clinician_label,
  CASE WHEN p.prediction_id IS NULL THEN 'rejected' ELSE 'accepted' END AS status,
  CASE WHEN p.prediction_id IS NULL THEN 'Prediction not found' END AS reason
FROM feedback f LEFT JOIN (SELECT DISTINCT prediction_id FROM assessments) p ON f.prediction_id = p.prediction_id""",
  ("feedback", "assessments"))

q("patient_summary", """SELECT i.patient_id, coalesce(s.patient_name, 'Unknown Patient') AS patient_name, 'N/A' AS dob,
  concat('MRN-', i.patient_id) AS mrn, NULL::INTEGER AS latest_epds, cast(coalesce(s.recent_visits, 0) AS BIGINT) AS recent_visits
FROM (SELECT DISTINCT patient_id FROM assessments) i LEFT JOIN patients s ON i.patient_id = s.patient_id""",
  ("assessments", "patients"))

q("followup_worklist", """SELECT o.prediction_id, o.patient_id, o.outcome_label, o.follow_up_days,
  CAST(o.ts AS DATE) + o.follow_up_days AS due_date, p.risk_percent,
  CASE WHEN CAST(o.ts AS DATE) + o.follow_up_days < DATE '2024-01-20' THEN 'overdue' ELSE 'open' END AS status
FROM outcomes o LEFT JOIN predictions p ON o.prediction_id = p.prediction_id""", ("outcomes", "predictions"), ("risk_percent",))

_BASE = "SELECT 'base' AS origin, prediction_id, CASE WHEN y = 1 THEN 'Depressed' ELSE 'Not' END AS \"Labelling\", " + \
    ", ".join(f'{e} AS "{n}"' for n, e in _mapped()[:7]) + " FROM training"
q("retrain_union", f"""{_BASE} UNION ALL SELECT 'feedback', prediction_id, "Labelling", {', '.join(f'"{n}"' for n, _ in _FB)}
FROM ({FB_ROWS}) f""", ("training", "feedback", "predictions"), _FBD)

q("retrain_gate", f"""SELECT count(*) AS feedback_rows, 50 AS min_feedback, count(*) >= 50 AS retrain,
  CASE WHEN count(*) >= 50 THEN 'retrain queued' ELSE concat('Not enough feedback rows: ', cast(count(*) AS VARCHAR),
  ' < 50. Skipping retrain.') END AS message FROM ({FB_ROWS}) f""", ("feedback", "predictions"))

q("patient_timeline", """SELECT patient_id, point, prediction_id, ts, gestational_weeks, risk_percent,
  risk_percent - lag(risk_percent) OVER (PARTITION BY patient_id ORDER BY point) AS risk_change FROM (
  SELECT coalesce(patient_id, 'unknown') AS patient_id, prediction_id, ts, gestational_weeks, risk_percent,
    row_number() OVER (PARTITION BY coalesce(patient_id, 'unknown') ORDER BY ts, prediction_id) AS point FROM predictions) t""",
  ("predictions",), ("risk_percent", "risk_change"))

q("timeline_last_n", """SELECT * FROM (SELECT coalesce(patient_id, 'unknown') AS patient_id,
  row_number() OVER (PARTITION BY coalesce(patient_id, 'unknown') ORDER BY ts DESC, prediction_id DESC) AS recency,
  prediction_id, ts, risk_percent FROM predictions) t WHERE recency <= 6""", ("predictions",), ("risk_percent",))

q("risk_trajectory", """SELECT patient_id, gestational_weeks, n, avg_risk,
  CASE WHEN avg_risk <= 40 THEN 'low' WHEN avg_risk <= 70 THEN 'moderate' ELSE 'high' END AS zone,
  CASE WHEN gestational_weeks <= 13 THEN 1 WHEN gestational_weeks <= 27 THEN 2 ELSE 3 END AS trimester
FROM (SELECT coalesce(patient_id, 'unknown') AS patient_id, gestational_weeks, count(*) AS n, avg(risk_percent) AS avg_risk
      FROM predictions GROUP BY 1, 2) g""", ("predictions",), ("avg_risk",))

q("case_status", """WITH e AS (
  SELECT patient_id, ts, 'new' AS status, 0 AS r FROM predictions
  UNION ALL SELECT p.patient_id, f.ts, 'pending_review', 1 FROM feedback f JOIN predictions p ON f.prediction_id = p.prediction_id
  UNION ALL SELECT patient_id, ts + INTERVAL 2 DAY, 'resolved', 2 FROM outcomes)
SELECT patient_id, ts, status FROM (SELECT *, row_number() OVER (PARTITION BY patient_id ORDER BY ts DESC, r DESC) AS rn FROM e) x
WHERE rn = 1""", ("predictions", "feedback", "outcomes"))

q("audit_log", """SELECT 'consent_updated' AS event, patient_id, ts, 'system' AS updated_by,
  CAST(to_json({'consent_given': consent_given, 'scope': consent_scope}) AS VARCHAR) AS detail FROM consents""", ("consents",))


# ------------------------------------------------------------------ text triage (fixture lexicon)


def _triage_sql():
    from riskops.operators.triage import FIXTURE_LEXICON as LX

    def anyc(ph):
        return "(" + " OR ".join(f"contains(t, '{p}')" for p in ph) + ")" if ph else "false"

    en = {lab: anyc(ph) for lab, (ph, _) in LX.risk.items()}
    score = "0.0::DOUBLE"
    for lab, (_, w) in LX.risk.items():
        score = f"({score} + CASE WHEN {en[lab]} THEN {D(w)} ELSE 0.0::DOUBLE END)"
    factors = [f"CASE WHEN {en[lab]} THEN '{lab}' END" for lab in LX.risk]
    for lab, ph in LX.risk_multilingual.items():
        new = f"({anyc(ph)} AND NOT {en.get(lab, 'false')})"
        factors.append(f"CASE WHEN {new} THEN '{lab}' END")
        score = f"({score} + CASE WHEN {new} THEN {D(LX.multilingual_weight)} ELSE 0.0::DOUBLE END)"
    prot = {lab: anyc(ph) for lab, ph in LX.protective.items()}
    nprot = " + ".join(f"CASE WHEN {h} THEN 1 ELSE 0 END" for h in prot.values()) or "0"
    prot_s = ", ".join(f"CASE WHEN {h} THEN '{lab}' END" for lab, h in prot.items())
    crisis = f"({anyc(LX.crisis)} OR {anyc(LX.crisis_multilingual)})"
    pp = " + ".join(f"CASE WHEN contains(t, '{p}') THEN 1 ELSE 0 END" for p in LX.postpartum)
    an = " + ".join(f"CASE WHEN contains(t, '{p}') THEN 1 ELSE 0 END" for p in LX.antenatal)
    factors.append(f"CASE WHEN {crisis} THEN '{LX.crisis_factor}' END")
    return f"""SELECT message_id, patient_id, message, rules_percent,
  CASE WHEN crisis_mode THEN 100.0::DOUBLE ELSE rules_percent END AS risk_percent,
  CASE WHEN crisis_mode THEN 'high' WHEN rules_percent >= 75 THEN 'high' WHEN rules_percent >= 45 THEN 'moderate' ELSE 'low' END AS risk_level,
  risk_factors, protective_factors, crisis_mode, 'rules_only' AS model_used, postpartum_hits, antenatal_hits,
  CASE WHEN postpartum_hits > antenatal_hits THEN 'postpartum' WHEN antenatal_hits > postpartum_hits THEN 'antenatal'
       ELSE 'unclear' END AS likely_context,
  CASE WHEN regexp_matches(message, '[^\\x00-\\x7F]') THEN 'non-english' ELSE 'english_or_romanized' END AS language
FROM (SELECT message_id, patient_id, message, {crisis} AS crisis_mode,
  round_even(greatest(0.0::DOUBLE, least(100.0::DOUBLE, ((CASE WHEN {crisis} THEN 1.0::DOUBLE ELSE {score} END)
     - ({nprot}) * {D(LX.protective_weight)}) * 100.0::DOUBLE)), 1) AS rules_percent,
  concat_ws(' | ', {', '.join(factors)}) AS risk_factors, concat_ws(' | ', {prot_s}) AS protective_factors,
  cast({pp} AS INTEGER) AS postpartum_hits, cast({an} AS INTEGER) AS antenatal_hits
  FROM (SELECT *, lower(message) AS t FROM messages) m) x"""


view("triaged", ["messages"], _triage_sql())

q("chat_triage", """SELECT message_id, rules_percent, risk_percent, risk_level, risk_factors, protective_factors, crisis_mode,
  model_used FROM triaged""", ("triaged",), ("rules_percent", "risk_percent"))
q("chat_crisis", "SELECT message_id, crisis_mode, risk_percent, risk_level, risk_factors FROM triaged", ("triaged",),
  ("risk_percent",))
q("chat_context", "SELECT message_id, postpartum_hits, antenatal_hits, likely_context FROM triaged", ("triaged",))
q("chat_language", "SELECT message_id, language FROM triaged", ("triaged",))


def _guid():
    from riskops.operators import triage as T
    fu = (f"CASE WHEN coalesce(fu, '') = '' THEN '{T.FOLLOWUP_ROUTINE}' ELSE fu END")
    return f"""SELECT message_id, crisis_mode,
  CASE WHEN crisis_mode THEN NULL ELSE concat(likely_context, ' maternal mental health guidance for ',
    CASE WHEN risk_factors = '' THEN 'mood symptoms' ELSE replace(risk_factors, ' | ', ', ') END) END AS guidance_query,
  CASE WHEN crisis_mode THEN '' ELSE {fu} END AS followups,
  CASE WHEN crisis_mode THEN '{T.CRISIS_GUIDANCE}' ELSE concat(' Actionable next steps: ', replace({fu}, ' | ', ' ')) END AS actionable
FROM (SELECT *, concat_ws(' | ',
    CASE WHEN list_contains(string_split(risk_factors, ' | '), 'sleep_disturbance') THEN '{T.FOLLOWUP_SLEEP}' END,
    CASE WHEN list_contains(string_split(risk_factors, ' | '), 'low_mood') OR list_contains(string_split(risk_factors, ' | '), 'anxiety')
         THEN '{T.FOLLOWUP_SCREENING}' END,
    CASE WHEN list_contains(string_split(risk_factors, ' | '), 'financial_stress') THEN '{T.FOLLOWUP_SOCIAL}' END) AS fu
  FROM triaged) g"""


q("chat_guidance", _guid(), ("triaged",))

JS_SPACE = "[\\t\\n\\x0B\\f\\r \\x{00A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}\\x{FEFF}]+"
q("key_points", f"""WITH n AS (SELECT doc_id, trim(regexp_replace(text, '{JS_SPACE}', ' ', 'g')) AS norm FROM documents),
p AS (SELECT doc_id, norm, list_filter(list_transform(regexp_split_to_array(norm, '\\. +|- +'), lambda x: trim(x)),
        lambda x: length(x) > 12) AS parts FROM n),
k AS (SELECT doc_id, CASE WHEN norm = '' THEN [] WHEN len(parts) = 0 THEN [norm] ELSE list_slice(parts, 1, 5) END AS kp FROM p)
SELECT doc_id, CAST(unnest(range(0, len(kp))) AS INTEGER) AS point_idx, unnest(kp) AS point FROM k""")


def _evidence():
    from riskops.operators import triage as T
    rows = " UNION ALL ".join(f"SELECT '{f}' AS factor, '{t}' AS term, {D(T.FACTOR_IMPACT.get(f, T.DEFAULT_IMPACT))} AS impact"
                              for f, ts in T.FIXTURE_EVIDENCE.items() for t in ts)
    return f"""SELECT message_id, factor, term, occurrences, impact FROM (
  SELECT message_id, kw.factor, kw.term, kw.impact,
    CAST((length(lower(message)) - length(replace(lower(message), kw.term, ''))) // length(kw.term) AS INTEGER) AS occurrences
  FROM triaged, ({rows}) kw WHERE list_contains(string_split(risk_factors, ' | '), kw.factor)) x WHERE occurrences > 0"""


q("evidence_spans", _evidence(), ("triaged",), ("impact",))
q("crisis_alerts", """SELECT message_id, coalesce(patient_id, 'unknown') AS patient_id, 'queued_local' AS status, risk_percent,
  substring(message, 1, 300) AS message_excerpt FROM triaged WHERE crisis_mode""", ("triaged",), ("risk_percent",))


# ------------------------------------------------------------------ retrieval

PY_SPACE = ("[\\t\\n\\x0B\\f\\r\\x1C-\\x1F \\x{0085}\\x{00A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}"
            "\\x{202F}\\x{205F}\\x{3000}]+")
TOK = "[\\p{L}\\p{N}_]{2,}"
view("chunks", ["guidelines"], f"""
SELECT source, CAST(start // 420 AS INTEGER) AS chunk_id, substring(clean, start + 1, 500) AS text FROM (
  SELECT source, clean, unnest(range(0, CAST(greatest(0, ceil((length(clean) - 500) / 420.0::DOUBLE)) AS INTEGER) * 420 + 1, 420)) AS start
  FROM (SELECT source, trim(regexp_replace(text, '{PY_SPACE}', ' ', 'g')) AS clean FROM guidelines) c
  WHERE length(clean) > 0) s""")


def _terms(text: str) -> str:
    return (f"list_concat(regexp_extract_all(lower({text}), '{TOK}'), CASE WHEN len(regexp_extract_all(lower({text}), '{TOK}')) >= 2 "
            f"THEN list_transform(range(1, len(regexp_extract_all(lower({text}), '{TOK}'))), lambda i: "
            f"regexp_extract_all(lower({text}), '{TOK}')[i] || ' ' || regexp_extract_all(lower({text}), '{TOK}')[i + 1]) "
            f"ELSE [] END)")


view("tc", ["chunks"], f"""SELECT source, chunk_id, term, count(*) AS tf FROM (
  SELECT source, chunk_id, unnest({_terms('text')}) AS term FROM chunks) t GROUP BY source, chunk_id, term""")
view("vocab", ["tc"], """SELECT term, df, ln((1.0::DOUBLE + (SELECT count(*) FROM chunks)) / (1.0::DOUBLE + df)) + 1.0::DOUBLE AS idf
FROM (SELECT term, sum(tf) AS cnt, count(*) AS df FROM tc GROUP BY term ORDER BY cnt DESC, term ASC LIMIT 12000) v""")
view("postings", ["vocab"], """SELECT source, chunk_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY source, chunk_id)) AS weight
FROM (SELECT source, chunk_id, term, tf * idf AS w FROM tc JOIN vocab USING (term)) p""")
view("qvec", ["vocab"], f"""SELECT query_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY query_id)) AS weight FROM (
  SELECT query_id, term, tf * idf AS w FROM (
    SELECT query_id, term, count(*) AS tf FROM (SELECT item_id AS query_id, unnest({_terms('text')}) AS term FROM benchmark) x
    GROUP BY query_id, term) t JOIN vocab USING (term)) p""")
view("topk", ["postings", "qvec"], """SELECT * FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, source DESC, chunk_id DESC) AS rank FROM (
    SELECT q.query_id, p.source, p.chunk_id, sum(p.weight * q.weight) AS score FROM postings p JOIN qvec q USING (term)
    GROUP BY q.query_id, p.source, p.chunk_id) s WHERE score > 0) r WHERE rank <= 3""")

q("chunk_documents", "SELECT source, chunk_id, text FROM chunks", ("chunks",))
q("tfidf_index", "SELECT source, chunk_id, term, weight FROM postings", ("postings",), ("weight",))
q("rag_topk", "SELECT query_id, rank, source, chunk_id, score FROM topk", ("topk",), ("score",))
q("rag_lexical", """SELECT query_id, rank, source, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, source ASC) AS rank FROM (
    SELECT b.item_id AS query_id, g.source,
      CAST((length(lower(g.text)) - length(replace(lower(g.text), lower(b.text), ''))) // length(lower(b.text)) AS BIGINT) AS score
    FROM benchmark b, guidelines g) s WHERE score > 0) r WHERE rank <= 3""", ("guidelines",))
q("rag_answer", f"""SELECT b.item_id AS query_id,
  CASE WHEN a.snippet IS NULL THEN 'No guideline documents found. Please add trusted clinical guidance to the docs folder.'
       ELSE concat('Based on the available guidelines and the reported symptoms, consider the following: ', a.snippet) END AS answer,
  coalesce(a.sources, '') AS sources
FROM benchmark b LEFT JOIN (
  SELECT t.query_id,
    max(CASE WHEN t.rank = 1 THEN replace(regexp_replace(substring(c.text, 1, 300), '^{PY_SPACE}|{PY_SPACE}$', '', 'g'), chr(10), ' ') END) AS snippet,
    string_agg(concat(t.source, ' (score=', printf('%.3f', t.score), ')'), ' | ' ORDER BY t.rank) AS sources
  FROM topk t JOIN chunks c ON c.source = t.source AND c.chunk_id = t.chunk_id GROUP BY t.query_id) a ON a.query_id = b.item_id""",
  ("topk",))


# the whole way: each different guidance query against the index, then the lexical count for those without hits
q("chat_assess", f"""WITH g AS (SELECT gq.*, t.risk_factors FROM ({_guid()}) gq JOIN triaged t USING (message_id)),
qs AS (SELECT DISTINCT guidance_query AS query_id, replace(risk_factors, ' | ', ', ') AS drivers FROM g WHERE guidance_query IS NOT NULL),
gv AS (SELECT query_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY query_id)) AS weight FROM (
  SELECT query_id, term, tf * idf AS w FROM (
    SELECT query_id, term, count(*) AS tf FROM (SELECT query_id, unnest({_terms('query_id')}) AS term FROM qs) x
    GROUP BY query_id, term) t JOIN vocab USING (term)) p),
best AS (SELECT * FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, source DESC, chunk_id DESC) AS rank FROM (
    SELECT v.query_id, p.source, p.chunk_id, sum(p.weight * v.weight) AS score FROM postings p JOIN gv v USING (term)
    GROUP BY v.query_id, p.source, p.chunk_id) s WHERE score > 0) r WHERE rank <= 3),
lexical AS (SELECT * FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, source ASC) AS rank FROM (
    SELECT query_id, source, text, (length(lower(text)) - length(replace(lower(text), lower(query_id), ''))) // length(query_id) AS score
    FROM qs, guidelines WHERE query_id NOT IN (SELECT query_id FROM best)) s WHERE score > 0) r WHERE rank <= 3),
hits AS (SELECT b.query_id, b.rank, c.text, concat(b.source, ' (score=', printf('%.3f', b.score), ')') AS src
    FROM best b JOIN chunks c ON c.source = b.source AND c.chunk_id = b.chunk_id
  UNION ALL SELECT query_id, rank, text, source FROM lexical),
answers AS (SELECT query_id,
    max(CASE WHEN rank = 1 THEN replace(regexp_replace(substring(text, 1, 300), '^{PY_SPACE}|{PY_SPACE}$', '', 'g'), chr(10), ' ') END) AS snippet,
    string_agg(src, ' | ' ORDER BY rank) AS sources FROM hits GROUP BY query_id)
SELECT message_id, concat(CASE WHEN g.guidance_query IS NULL THEN ''
    WHEN a.snippet IS NULL THEN 'No guideline documents found. Please add trusted clinical guidance to the docs folder.'
    ELSE concat('Based on the available guidelines and ', CASE WHEN risk_factors = '' THEN 'the reported symptoms'
      ELSE replace(risk_factors, ' | ', ', ') END, ', consider the following: ', a.snippet) END, actionable) AS guidance,
  coalesce(a.sources, '') AS sources
FROM g LEFT JOIN answers a ON a.query_id = g.guidance_query""", ("triaged", "postings", "chunks", "vocab", "guidelines"))


# ------------------------------------------------------------------ linear attribution (heuristic as a linear model)

_LC = {"gestational_weeks": 10 * 0.25 * 10 / 42, "sleep_quality": -2.5, "appetite": -1.5, "fatigue": 2.0,
       "financial_stress": 1.5}
LIN = "SELECT prediction_id, feature, ord, attribution, CASE WHEN tot <= 0 THEN 0.0::DOUBLE ELSE " \
    "round_even(abs(attribution) / tot * 100.0::DOUBLE, 2) END AS share_percent FROM (" \
    "SELECT *, sum(abs(attribution)) OVER (PARTITION BY prediction_id) AS tot FROM (" + " UNION ALL ".join(
        f"SELECT prediction_id, '{c}' AS feature, {i} AS ord, (cast({c} AS DOUBLE) - (SELECT avg(cast({c} AS DOUBLE)) "
        f"FROM assessments)) * {D(w)} AS attribution FROM assessments" for i, (c, w) in enumerate(_LC.items())) + ") a) b"
q("linear_attribution", LIN, ("assessments",), ("attribution", "share_percent"))
q("global_importance", f"""SELECT feature, avg(abs(attribution)) AS mean_abs_attribution, count(*) AS "rows",
  row_number() OVER (ORDER BY avg(abs(attribution)) DESC, feature) AS rank FROM ({LIN}) l GROUP BY feature""",
  ("assessments",), ("mean_abs_attribution",))
_BASE_SQL = "(40.0::DOUBLE + " + " + ".join(f"{D(w)} * (SELECT avg(cast({c} AS DOUBLE)) FROM assessments)"
                                           for c, w in _LC.items()) + ")"
q("attribution_waterfall", f"""SELECT prediction_id, feature, attribution, step, {_BASE_SQL} + run - attribution AS start,
  {_BASE_SQL} + run AS "end" FROM (
  SELECT *, row_number() OVER w AS step, sum(attribution) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run
  FROM ({LIN}) l WINDOW w AS (PARTITION BY prediction_id ORDER BY abs(attribution) DESC, feature)) x""",
  ("assessments",), ("attribution", "start", '"end"'))


# ------------------------------------------------------------------ streaming twins

_CRISIS_MSG = ("concat('Crisis mode activated: immediate support is required. Trigger: ', " + CRISIS_REASON +
               ", '. Please contact local emergency services and a clinician.')")
q("stream_risk_alerts", f"""SELECT prediction_id, patient_id, risk_percent, 'queued_local' AS status,
  substring({_CRISIS_MSG}, 1, 300) AS message_excerpt FROM predictions WHERE ({CRISIS_REASON}) IS NOT NULL""",
  ("predictions",), ("risk_percent",))
q("stream_timeline", "SELECT patient_id, prediction_id, ts, gestational_weeks, risk_percent FROM predictions",
  ("predictions",), ("risk_percent",))
q("stream_fairness_daily", f"""WITH g AS (SELECT date_trunc('day', ts) AS day, coalesce(income_band, 'unknown') AS grp,
    sum(CASE WHEN risk_percent >= 60.0::DOUBLE THEN 1 ELSE 0 END) / count(*) AS rate FROM predictions GROUP BY 1, 2)
SELECT CAST(day AS TIMESTAMP) AS day, count(*) AS n_groups, cast(sum(CASE WHEN rate > 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_nonzero_groups,
  CASE WHEN sum(CASE WHEN rate > 0 THEN 1 ELSE 0 END) >= 2 THEN min(CASE WHEN rate > 0 THEN rate END) / max(CASE WHEN rate > 0 THEN rate END)
       ELSE 1.0::DOUBLE END AS disparate_impact,
  coalesce(sum(CASE WHEN rate > 0 THEN 1 ELSE 0 END) >= 2 AND
           min(CASE WHEN rate > 0 THEN rate END) / max(CASE WHEN rate > 0 THEN rate END) < 0.8::DOUBLE, false) AS bias_detected,
  cast(0 AS BIGINT) AS late_rows
FROM g GROUP BY day""", ("predictions",), ("disparate_impact",))
q("stream_consent_gate", """SELECT a.prediction_id, a.patient_id, r.reason, r.reason IS NULL AS allowed FROM assessments a
ASOF LEFT JOIN (SELECT patient_id, ts, arg_max(consent_given, seq) AS consent_given, arg_max(consent_scope, seq) AS consent_scope
  FROM consents GROUP BY patient_id, ts) c ON a.patient_id = c.patient_id AND a.ts >= c.ts,
LATERAL (SELECT CASE WHEN a.patient_id IS NULL OR a.patient_id = '' THEN NULL
  WHEN c.patient_id IS NULL THEN 'Consent record required for patient'
  WHEN NOT coalesce(c.consent_given, false) THEN 'Consent not granted by patient'
  WHEN NOT coalesce(list_contains(c.consent_scope, 'risk_scoring'), false) THEN 'Consent scope missing: risk_scoring'
  END AS reason) r""", ("assessments", "consents"))
q("stream_feedback_join", """SELECT p.prediction_id, p.patient_id, f.clinician_label, p.ts AS prediction_ts, f.ts AS feedback_ts
FROM assessments p JOIN feedback f ON p.prediction_id = f.prediction_id
  AND f.ts >= p.ts AND f.ts <= p.ts + INTERVAL 14 DAY""", ("assessments", "feedback"))
SQL["stream_latest_state"] = SQL["consent_latest"]
q("stream_retrain_trigger", """SELECT count(*) AS feedback_rows, 50 AS min_feedback, count(*) >= 50 AS retrain
FROM feedback f WHERE lower(trim(clinician_label)) IN ('high', 'low')
  AND prediction_id IN (SELECT prediction_id FROM assessments)""", ("assessments", "feedback"))

# ------------------------------------------------------------------ written and read back

q("read_text_files", "SELECT item_id, length(text) + 1 AS n_chars, sha256(text || chr(10)) AS sha256 FROM benchmark")
q("file_fingerprints", "SELECT item_id, cast(octet_length(encode(text)) + 1 AS BIGINT) AS length, sha256(text || chr(10)) AS sha256 FROM benchmark")
q("log_append", """SELECT prediction_id, patient_id, ts, risk_percent, cast(CASE WHEN prediction_id % 3 = 0 THEN 1 ELSE 0 END AS BIGINT) AS batch_id
FROM predictions""", ("predictions",), ("risk_percent",))
q("metrics_report", f"""SELECT 'test' AS section, metric, value
FROM (UNPIVOT (SELECT accuracy, precision, recall, f1 FROM ({METRICS}) m) ON accuracy, precision, recall, f1 INTO NAME metric VALUE value) u""",
  ("scored",), ("value",))
