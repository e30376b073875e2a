"""Registered queries: drift (D01-D08), reference stats (A05, A06), drift summaries
(A19, A20), category join (J02) and key-set union (U01)."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskweave.operators import drift as dr
from riskweave.plans._sqlhelp import r9
from riskweave.plans.registry import register
from riskweave.sources.tables import read_table, transactions, with_ctes

TX_NUM = ["amount", "hour", "device_score", "country_risk"]
TX_CUT = "2024-01-21"
LI_NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
LI_CAT = ["l_returnflag", "l_linestatus"]
LI_CUT = "1998-01-01"
D08_REF_END = "2024-01-08"
D08_ALERT = 0.3


def _tx_sides(spark, sf_dir):
    tx = transactions(spark, sf_dir)
    cut = F.lit(TX_CUT).cast("timestamp_ntz")
    return tx.where(F.col("created_at") < cut), tx.where(F.col("created_at") >= cut)


def _li_sides(spark, sf_dir):
    li = read_table(spark, sf_dir, "lineitem")
    cut = F.lit(LI_CUT).cast("timestamp_ntz")
    return li.where(F.col("l_shipdate") < cut), li.where(F.col("l_shipdate") >= cut)


# ---------------------------------------------------------------- SQL builders

def _long_sql(src: str, cols: list[str], extra: str = "") -> str:
    sel = extra + ", " if extra else ""
    return " UNION ALL ".join(
        f"SELECT {sel}'{c}' AS feature, CAST({c} AS DOUBLE) AS value FROM {src} WHERE {c} IS NOT NULL" for c in cols)


def _sides_sql(base: str, ts: str, cut: str, cols: list[str]) -> list[str]:
    return [
        f"ref AS (SELECT * FROM {base} WHERE {ts} < TIMESTAMP '{cut}')",
        f"cur AS (SELECT * FROM {base} WHERE {ts} >= TIMESTAMP '{cut}')",
        f"rl AS ({_long_sql('ref', cols)})",
        f"cl AS ({_long_sql('cur', cols)})",
    ]


_KS_SQL = """ug AS (SELECT feature, value, sum(r) AS r, sum(c) AS c FROM (
      SELECT feature, value, 1 AS r, 0 AS c FROM rl UNION ALL SELECT feature, value, 0, 1 FROM cl) GROUP BY 1, 2),
uc AS (SELECT feature, sum(r) OVER w / sum(r) OVER (PARTITION BY feature) AS fr,
              sum(c) OVER w / sum(c) OVER (PARTITION BY feature) AS fc
       FROM ug WINDOW w AS (PARTITION BY feature ORDER BY value)),
ks AS (SELECT feature, max(abs(fr - fc)) AS ks_statistic FROM uc GROUP BY feature)"""

_PROBS_SQL = "[" + ", ".join(repr(p) for p in dr.PSI_PROBS) + "]"

# PSI over current rows grouped by {g} (may be empty) against reference edges.
_BIN_SQL = """CASE WHEN m <= 0 THEN NULL WHEN value = edges[len(edges)] THEN m - 1
     WHEN len(list_filter(edges, lambda e: e <= value)) BETWEEN 1 AND m
     THEN len(list_filter(edges, lambda e: e <= value)) - 1 END"""


def _psi_sql(cur_long: str = "cl", group: str = "") -> str:
    g = group + ", " if group else ""
    return f"""ed AS (SELECT feature, list_sort(list_distinct(quantile_cont(value, {_PROBS_SQL}))) AS edges FROM rl GROUP BY feature),
eb AS (SELECT feature, edges, len(edges) - 1 AS m FROM ed),
rt AS (SELECT feature, count(*) AS rt FROM rl GROUP BY feature),
rc AS (SELECT feature, bin, count(*) AS rc FROM (SELECT rl.feature, {_BIN_SQL} AS bin FROM rl JOIN eb USING (feature))
       WHERE bin IS NOT NULL GROUP BY ALL),
ct AS (SELECT {g}feature, count(*) AS ct FROM {cur_long} GROUP BY ALL),
cc AS (SELECT {g}feature, bin, count(*) AS cc FROM (SELECT {g}{cur_long}.feature, {_BIN_SQL} AS bin FROM {cur_long} JOIN eb USING (feature))
       WHERE bin IS NOT NULL GROUP BY ALL),
bins AS (SELECT feature, unnest(range(0, m)) AS bin FROM eb WHERE m > 0),
pj AS (SELECT {g}ct.feature, CASE WHEN COALESCE(rc, 0) = 0 THEN 0.0001 ELSE rc / rt END AS r,
              CASE WHEN COALESCE(cc, 0) = 0 THEN 0.0001 ELSE cc / ct END AS c
       FROM ct JOIN bins USING (feature) JOIN rt USING (feature) LEFT JOIN rc USING (feature, bin)
       LEFT JOIN cc USING ({g}feature, bin)),
psi AS (SELECT {g}ct.feature, COALESCE((SELECT sum((c - r) * ln(c / r)) FROM pj
          WHERE pj.feature = ct.feature {"AND " + " AND ".join(f"pj.{x.strip()} = ct.{x.strip()}" for x in group.split(",")) if group else ""}), 0.0) AS psi
        FROM ct)"""


def _cat_psi_sql(col: str) -> str:
    return f"""(SELECT '{col}' AS feature, sum((c - r) * ln(c / r)) AS psi FROM (
      SELECT CASE WHEN COALESCE(rf, 0) = 0 THEN 0.0001 ELSE rf END AS r,
             CASE WHEN COALESCE(cf, 0) = 0 THEN 0.0001 ELSE cf END AS c
      FROM (SELECT {col} AS v, count(*) / sum(count(*)) OVER () AS rf FROM ref WHERE {col} IS NOT NULL GROUP BY 1) a
      FULL OUTER JOIN (SELECT {col} AS v, count(*) / sum(count(*)) OVER () AS cf FROM cur WHERE {col} IS NOT NULL GROUP BY 1) b
      USING (v)))"""


_MOM_SQL = """mom AS (SELECT r.feature, r.ref_mean, c.curr_mean, r.ref_std, c.curr_std FROM
   (SELECT feature, avg(value) AS ref_mean, stddev_samp(value) AS ref_std FROM rl GROUP BY feature) r JOIN
   (SELECT feature, avg(value) AS curr_mean, stddev_samp(value) AS curr_std FROM cl GROUP BY feature) c USING (feature))"""


def _report_sql(cats: list[str]) -> str:
    num = """SELECT feature, 'numeric' AS kind, ks_statistic, psi.psi AS psi,
        greatest(ks_statistic, psi.psi / 10) AS drift_score, greatest(ks_statistic, psi.psi / 10) > 0.1 AS drift_detected,
        ref_mean, curr_mean, ref_std, curr_std
      FROM mom JOIN ks USING (feature) JOIN psi USING (feature)"""
    cat = " UNION ALL ".join(
        f"""SELECT feature, 'categorical', NULL::DOUBLE, psi, psi, psi > 0.1, NULL::DOUBLE, NULL::DOUBLE,
            NULL::DOUBLE, NULL::DOUBLE FROM {_cat_psi_sql(c)}""" for c in cats)
    return f"rep AS ({num}{' UNION ALL ' + cat if cats else ''})"


# Means and stds of lineitem prices are ~4e4: summation-order noise reaches the
# 9th decimal there, so they are compared at 6 decimals (11+ significant digits).
_REPORT_COLS = ("feature, kind, round(ks_statistic, 9) AS ks_statistic, round(psi, 9) AS psi, "
                "round(drift_score, 9) AS drift_score, drift_detected, round(ref_mean, 6) AS ref_mean, "
                "round(curr_mean, 6) AS curr_mean, round(ref_std, 6) AS ref_std, round(curr_std, 6) AS curr_std")


def _r6(c):
    return F.round(F.col(c), 6).alias(c)


def _round_report(df):
    return df.select("feature", "kind", r9("ks_statistic"), r9("psi"), r9("drift_score"), "drift_detected",
                     _r6("ref_mean"), _r6("curr_mean"), _r6("ref_std"), _r6("curr_std"))


_TX_SIDES = _sides_sql("tx", "created_at", TX_CUT, TX_NUM)
_LI_SIDES = _sides_sql("lineitem", "l_shipdate", LI_CUT, LI_NUM)
_LI_REPORT = _LI_SIDES + [_KS_SQL, _psi_sql(), _MOM_SQL, _report_sql(LI_CAT)]


def li_report(spark, sf_dir):
    ref, cur = _li_sides(spark, sf_dir)
    return dr.drift_report(ref, cur, LI_NUM, LI_CAT)


# ---------------------------------------------------------------- queries

@register("D01", with_ctes("SELECT feature, round(ks_statistic, 9) AS ks_statistic FROM ks", "tx",
                           extra=_TX_SIDES + [_KS_SQL]))
def q_d01(spark, sf_dir):
    """Two-sample KS statistic of every numeric feature, first 20 days vs the rest."""
    ref, cur = _tx_sides(spark, sf_dir)
    return dr.ks_statistics(dr.to_long(ref, TX_NUM), dr.to_long(cur, TX_NUM)).select("feature", r9("ks_statistic"))


@register("D02", with_ctes("SELECT feature, round(psi, 9) AS psi FROM psi", "tx", extra=_TX_SIDES + [_psi_sql()]))
def q_d02(spark, sf_dir):
    """Numeric PSI on reference decile edges for every numeric feature."""
    ref, cur = _tx_sides(spark, sf_dir)
    return dr.psi_numeric(dr.to_long(ref, TX_NUM), dr.to_long(cur, TX_NUM)).select("feature", r9("psi"))


@register("D03", with_ctes(f"SELECT feature, round(psi, 9) AS psi FROM {_cat_psi_sql('merchant_id')}", "tx",
                           extra=_TX_SIDES[:2]))
def q_d03(spark, sf_dir):
    """Categorical PSI of the merchant category."""
    ref, cur = _tx_sides(spark, sf_dir)
    return dr.psi_categorical(ref, cur, "merchant_id").select("feature", r9("psi"))


@register("D04", with_ctes(f"SELECT {_REPORT_COLS} FROM rep", extra=_LI_REPORT))
def q_d04(spark, sf_dir):
    """Per-feature drift check over lineitem (4 numeric, 2 categorical), shipped before 1998 vs after."""
    return _round_report(li_report(spark, sf_dir))


@register("D05", with_ctes("""SELECT feature, ks > 0.1 AS drift_detected, round(ks, 9) AS drift_score,
    round(reference_mean, 9) AS reference_mean, round(current_mean, 9) AS current_mean,
    round(reference_std, 9) AS reference_std, round(current_std, 9) AS current_std FROM (
      SELECT s.feature, s.reference_mean, s.reference_std, avg(value) AS current_mean,
             stddev_samp(value) AS current_std,
             greatest(count(*) FILTER (WHERE value < s.reference_mean) / count(*),
                      1 - count(*) FILTER (WHERE value <= s.reference_mean) / count(*)) AS ks
      FROM (SELECT feature, avg(value) AS reference_mean, stddev_samp(value) AS reference_std FROM rl GROUP BY feature) s
      JOIN cl USING (feature) GROUP BY s.feature, s.reference_mean, s.reference_std)""", "tx", extra=_TX_SIDES))
def q_d05(spark, sf_dir):
    """Summary-only drift check against reference means."""
    ref, cur = _tx_sides(spark, sf_dir)
    out = dr.summary_drift(ref, cur, TX_NUM)
    return out.select("feature", "drift_detected", r9("drift_score"), r9("reference_mean"), r9("current_mean"),
                      r9("reference_std"), r9("current_std"))


@register("D06", with_ctes("""SELECT 'warning' AS severity, 'Data drift detected in ' || count(*) || ' features' AS title,
      string_agg(feature, ',' ORDER BY feature) AS features, string_agg(feature || ':' || format('{:.9f}', drift_score), ',' ORDER BY feature) AS scores
      FROM rep WHERE drift_detected HAVING count(*) > 0
    UNION ALL
    SELECT 'critical', 'High drift detected - model rollback recommended', string_agg(feature, ',' ORDER BY feature),
      string_agg(feature || ':' || format('{:.9f}', drift_score), ',' ORDER BY feature)
      FROM rep WHERE drift_score > 0.2 AND (SELECT count(*) FROM rep WHERE drift_detected) > 0 HAVING count(*) > 0""",
                           extra=_LI_REPORT))
def q_d06(spark, sf_dir):
    """Warning / rollback alert rows from the lineitem drift check."""
    return dr.drift_alerts(li_report(spark, sf_dir))


_A22_CTE = """acc AS (SELECT model_version, avg(CASE WHEN fraud_label = is_fraud THEN 1.0 ELSE 0.0 END) AS accuracy
    FROM logs GROUP BY model_version)"""


@register("D07", with_ctes("""SELECT d.data_changed, m.metric_degraded, d.data_changed OR m.metric_degraded AS trigger_retraining
    FROM (SELECT COALESCE(bool_or(drift_detected), false) AS data_changed FROM rep) d,
         (SELECT accuracy < 0.8 AS metric_degraded FROM acc ORDER BY model_version DESC LIMIT 1) m""",
                           "logs", extra=_LI_REPORT + [_A22_CTE]))
def q_d07(spark, sf_dir):
    """Retrain trigger: lineitem drift or accuracy of the newest model version below 0.8."""
    from riskweave.operators.reports import retrain_trigger
    from riskweave.sources.tables import prediction_logs
    return retrain_trigger(li_report(spark, sf_dir), prediction_logs(spark, sf_dir), min_accuracy=0.8)


_D08_CTES = [
    f"ref AS (SELECT * FROM tx WHERE created_at < TIMESTAMP '{D08_REF_END}')",
    f"cur AS (SELECT *, date_trunc('day', created_at) AS window_start FROM tx WHERE created_at >= TIMESTAMP '{D08_REF_END}')",
    f"rl AS ({_long_sql('ref', TX_NUM)})",
    f"cw AS ({_long_sql('cur', TX_NUM, 'window_start')})",
    _psi_sql("cw", "window_start"),
]


def d08_series(spark, sf_dir):
    tx = transactions(spark, sf_dir)
    end = F.lit(D08_REF_END).cast("timestamp_ntz")
    ref = tx.where(F.col("created_at") < end)
    cur = tx.where(F.col("created_at") >= end).withColumn(
        "window_start", F.window("created_at", "1 day")["start"].cast("timestamp_ntz"))
    psi = dr.psi_numeric(dr.to_long(ref, TX_NUM), dr.to_long(cur, TX_NUM, keep=["window_start"]),
                         group=["window_start"])
    return psi.withColumn("drift_detected", F.col("psi") > F.lit(D08_ALERT))


@register("D08", with_ctes(f"""SELECT window_start, feature, round(psi, 9) AS psi, psi > {D08_ALERT} AS drift_detected
    FROM psi""", "tx", extra=_D08_CTES))
def q_d08(spark, sf_dir):
    """Daily tumbling PSI of every numeric feature against fixed first-week edges."""
    return d08_series(spark, sf_dir).select("window_start", "feature", r9("psi"), "drift_detected")


_ALERT_SQL = """string_agg(feature, ',' ORDER BY feature) AS features,
      string_agg(feature || ':' || format('{:.9f}', psi), ',' ORDER BY feature) AS scores"""


@register("D06H", with_ctes(f"""SELECT * FROM (
    SELECT window_start, 'warning' AS severity, '{dr.WARNING_TITLE[0]}' || count(*) || '{dr.WARNING_TITLE[1]}' AS title, {_ALERT_SQL}
      FROM psi WHERE psi > {D08_ALERT} GROUP BY window_start
    UNION ALL
    SELECT window_start, 'critical', '{dr.CRITICAL_TITLE}', {_ALERT_SQL} FROM psi
      WHERE psi > {dr.ROLLBACK_THRESHOLD} AND window_start IN (SELECT window_start FROM psi WHERE psi > {D08_ALERT})
      GROUP BY window_start)
    ORDER BY window_start DESC, severity LIMIT {dr.HISTORY_LENGTH}""", "tx", extra=_D08_CTES))
def q_d06h(spark, sf_dir):
    """Alert history: the newest 100 alerts of the daily drift checks."""
    report = d08_series(spark, sf_dir).withColumnRenamed("psi", "drift_score")
    return dr.alert_history(dr.drift_alerts(report, by=["window_start"]), "window_start")


@register("A19", with_ctes(f"""SELECT CASE WHEN count(*) = 0 THEN 'no_data'
      WHEN count(*) FILTER (WHERE psi > {D08_ALERT}) > 0 THEN 'drift_detected' ELSE 'stable' END AS status,
    count(*) FILTER (WHERE psi > {D08_ALERT}) AS features_with_drift, count(*) AS total_features_checked,
    round(count(*) FILTER (WHERE psi > {D08_ALERT}) / greatest(count(*), 1), 9) AS drift_rate,
    max(window_start) AS last_check FROM psi""", "tx", extra=_D08_CTES))
def q_a19(spark, sf_dir):
    """Drift summary over the daily check history."""
    s = dr.drift_history_summary(d08_series(spark, sf_dir), "window_start")
    return s.select("status", "features_with_drift", "total_features_checked", r9("drift_rate"), "last_check")


@register("A20", with_ctes("""SELECT COALESCE(max(drift_score), 0) > 0.1 AS drift_detected,
    round(COALESCE(max(drift_score), 0), 9) AS max_drift_score FROM rep""", extra=_LI_REPORT))
def q_a20(spark, sf_dir):
    """Overall drift status of the lineitem check."""
    return dr.overall_drift(li_report(spark, sf_dir)).select("drift_detected", r9("max_drift_score"))


@register("A05", with_ctes("""SELECT feature, count(*) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std,
    min(value) AS min, round(quantile_cont(value, 0.25), 6) AS q25, round(quantile_cont(value, 0.5), 6) AS q50,
    round(quantile_cont(value, 0.75), 6) AS q75, max(value) AS max FROM rl GROUP BY feature""",
                           extra=[f"rl AS ({_long_sql('lineitem', LI_NUM)})"]))
def q_a05(spark, sf_dir):
    """Reference statistics of every numeric lineitem column (exact quantiles)."""
    st = dr.reference_stats(dr.to_long(read_table(spark, sf_dir, "lineitem"), LI_NUM))
    return st.select("feature", "n", _r6("mean"), _r6("std"), "min", _r6("q25"), _r6("q50"), _r6("q75"), "max")


@register("A06", with_ctes("""SELECT merchant_id AS value, round(count(*) / sum(count(*)) OVER (), 9) AS freq
    FROM tx WHERE merchant_id IS NOT NULL GROUP BY merchant_id""", "tx"))
def q_a06(spark, sf_dir):
    """Normalised category frequencies of the merchant category."""
    tx = transactions(spark, sf_dir)
    return dr.category_frequencies(tx, "merchant_id").select("value", r9("freq"))


@register("J02", with_ctes("""SELECT COALESCE(a.v, b.v) AS value, round(COALESCE(rf, 0.0), 9) AS ref_freq,
    round(COALESCE(cf, 0.0), 9) AS cur_freq FROM
    (SELECT l_returnflag || l_linestatus AS v, count(*) / sum(count(*)) OVER () AS rf FROM ref GROUP BY 1) a
    FULL OUTER JOIN
    (SELECT l_returnflag || l_linestatus AS v, count(*) / sum(count(*)) OVER () AS cf FROM cur GROUP BY 1) b
    ON a.v = b.v""", extra=_LI_SIDES[:2]))
def q_j02(spark, sf_dir):
    """Category distributions of both periods, full outer joined (missing -> 0)."""
    ref, cur = _li_sides(spark, sf_dir)
    key = F.concat("l_returnflag", "l_linestatus").alias("rs")
    d = dr.category_distributions(ref.select(key), cur.select(key), "rs")
    return d.select("value", r9("ref_freq"), r9("cur_freq"))


@register("U01", with_ctes("""SELECT l_returnflag || l_linestatus AS value FROM ref
    UNION SELECT l_returnflag || l_linestatus FROM cur""", extra=_LI_SIDES[:2]))
def q_u01(spark, sf_dir):
    """Union of the category key sets of both periods."""
    ref, cur = _li_sides(spark, sf_dir)
    key = F.concat("l_returnflag", "l_linestatus").alias("value")
    return ref.select(key).union(cur.select(key)).distinct()
