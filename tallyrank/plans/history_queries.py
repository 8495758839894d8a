"""Queries on look-back history, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyrank.operators import features as f
from tallyrank.operators.chronology import holdout_split
from tallyrank.operators.history import history
from tallyrank.plans import oracle as o
from tallyrank.plans.fixtures import executions
from tallyrank.plans.shape import shaped, sql_select

KEY = ("build_id", "tc_key")
SK = "build_id; tc_key"


def _ev(spark, sf):
    return executions(spark, sf)


def _simple(build, *columns):
    return lambda spark, sf: shaped(build(_ev(spark, sf)), *KEY, *columns)


def _want(*columns, **options):
    return _simple(lambda e: history(e, want=list(columns), **options), *columns)


Q, S = {}, {}


def add(name, fn, sql=None):
    Q[name] = fn
    if sql:
        S[name] = sql


H, HN = o.ev_history(), o.ev_history(not_pass=True)

add("execution_counts", _want("n", "failures", "exact_passes"),
    H + sql_select("h", SK, "n; failures; exact_passes"))
add("failure_rates", _simple(f.failure_rates, "failure_rate", "rate_2", "rate_3", "rate_5", "rate_10", "rate_20"),
    H + sql_select("h", SK, "", f"{o.RATE} AS failure_rate; " + "; ".join(
        f"coalesce(rate_{k}, 0) AS rate_{k}" for k in (2, 3, 5, 10, 20))))
add("failure_rates_by_project", lambda spark, sf: shaped(
    f.failure_rates(executions(spark, sf, "li"), (5,)), "project", *KEY, "build_idx", "failure_rate", "rate_5"),
    f"WITH {o.LI}, {o.history()} " + sql_select("h", "project; " + SK, "build_idx",
                                                f"{o.RATE} AS failure_rate; coalesce(rate_5, 0) AS rate_5"))
# the oracle rebases weights to the first build of the clock, which is short here
_DECAY = """, dec AS (SELECT *, sum(exp(0.1 * build_idx) * fail) OVER p AS a, sum(exp(0.1 * build_idx)) OVER p AS b
  FROM ex WINDOW p AS (PARTITION BY project, tc_key ORDER BY build_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) """
add("decayed_failure_rate", _want("decayed_rate"),
    f"WITH {o.EV}{_DECAY}" + sql_select("dec", SK, "", "a / b AS decayed_rate"))
add("flakiness", _simple(f.flakiness, "flakiness_rate", "status_changes"),
    H + sql_select("h", SK, "", "CASE WHEN n > 1 THEN flips / (n - 1)::DOUBLE ELSE 0 END AS flakiness_rate; "
                                "exact_flips / greatest(n, 1)::DOUBLE AS status_changes"))
_RUNS = ("fail_run", "pass_run", "exact_fail_run", "exact_pass_run")
add("current_streaks", _want(*_RUNS), H + sql_select("h", SK, "; ".join(_RUNS)))
_MAXR = ("max_fail_run", "max_pass_run", "max_exact_fail_run")
add("max_streaks", _want(*_MAXR), H + sql_select("h", SK, "; ".join(_MAXR)))
add("last_event_age", _simple(f.last_event_age, "since_fail", "since_pass", "test_age", "builds_since_change"),
    H + sql_select("h", SK, "", "coalesce(build_idx - last_fail_idx, 999) AS since_fail; "
                   "coalesce(build_idx - last_pass_idx, 999) AS since_pass; "
                   "coalesce(build_idx - first_idx, 0) AS test_age; coalesce(build_idx - last_idx, 0) AS builds_since_change"))
TSF = "coalesce(least((last_idx - last_fail_idx) / 50.0::DOUBLE, 1), 1)"
add("time_since_failure", _simple(f.time_since_failure, "time_since_failure"),
    H + sql_select("h", SK, "", f"{TSF} AS time_since_failure"))
add("execution_frequency", _simple(f.execution_frequency, "execution_frequency"),
    H + sql_select("h", SK, "", "coalesce(n / (last_idx - first_idx + 1)::DOUBLE, 0.5) AS execution_frequency"))
_FR = "(failures / nullif(n, 0)::DOUBLE)"
add("trend_features", _simple(f.trend_features, "failure_trend", "acceleration", "deceleration_factor"),
    H + sql_select("h", SK, "", f"coalesce(rate_5 - {_FR}, 0) AS failure_trend; coalesce(rate_2 - rate_5, 0) AS acceleration; "
                                f"coalesce(rate_5 / nullif({_FR}, 0), 1) AS deceleration_factor"))
add("trend_features_temporal", _simple(lambda e: f.trend_features(e, as_temporal=True),
                                       "failure_trend", "acceleration", "deceleration_factor"),
    H + sql_select("h", SK, "", "coalesce(rate_5 - rate_10, 0) AS failure_trend; "
                   "CASE WHEN n >= 2 THEN rate_5 - rate_2 ELSE 0 END AS acceleration; "
                   f"coalesce(({_FR} - rate_5) / nullif({_FR}, 0), 0) AS deceleration_factor"))
add("stability_features", _simple(f.stability_features, "stability_score", "pass_fail_ratio", "recent_stability", "builds_affected"),
    H + sql_select("h", SK, "n AS builds_affected", "1 - CASE WHEN n > 1 THEN flips / (n - 1)::DOUBLE ELSE 0 END AS stability_score; "
                   "(n - failures) / (failures + 1)::DOUBLE AS pass_fail_ratio; "
                   "CASE WHEN n > 1 THEN 1 - fail_flips_5 / (least(n, 5) - 1)::DOUBLE ELSE 1 END AS recent_stability"))
CC = "greatest(n_commits + n_crs, 1)"
AVG = f"({CC} / greatest(n, 1)::DOUBLE)"
SURGE = f"CASE WHEN n > 0 AND {CC} > {AVG} * 1.5 THEN 1 ELSE 0 END"
add("novelty_and_surge", _simple(f.novelty, "test_novelty", "commit_count", "avg_commits_per_execution", "recent_commit_surge"),
    H + sql_select("h", SK, "", f"CASE WHEN n = 0 THEN 1 ELSE 0 END AS test_novelty; {CC} AS commit_count; "
                                f"{AVG} AS avg_commits_per_execution; {SURGE} AS recent_commit_surge"))


def _prio(kind):
    return " + ".join(f"{w!r}::DOUBLE * coalesce((verdict_{k} = 1)::INT, 0)" for k, w in enumerate(f.decay_weights(kind), 1))


add("priority_score", _simple(lambda e: f.priority_score(e, f.DECAYS), *[f"priority_{k}" for k in f.DECAYS]),
    H + sql_select("h", SK, "", "; ".join(f"{_prio(k)} AS priority_{k}" for k in f.DECAYS)))


def _carried(spark, sf):
    e = holdout_split(_ev(spark, sf))
    done = f.priority_score(e.filter("split = 'test'"), carried=e.filter("split <> 'test'"))
    return shaped(done, *KEY, "priority_score")


_CUT = "build_idx >= (SELECT floor((max(build_idx) + 1) * 0.8::DOUBLE) FROM ex)"
add("priority_score_carried_in", _carried,
    H + sql_select("h", SK, "", f"{_prio('exponential')} AS priority_score", _CUT))
_ST = ("status_last_1", "status_last_2", "status_last_3", "status_last_5", "status_last_10",
       "distance", "status_changes", "cycles_since_fail", "fail_rate_last_10")
add("recent_status_features", _simple(f.recent_status, *_ST),
    H + sql_select("h", SK, "", "; ".join(
        f"CASE WHEN verdict_{k} < 2 THEN verdict_{k} ELSE 0.5::DOUBLE END AS status_last_{k}" for k in (1, 2, 3, 5, 10))
        + "; CASE WHEN n >= 2 THEN abs((verdict_1 = 1)::INT - (first_verdict = 1)::INT) ELSE 0 END AS distance; "
          "exact_flips / greatest(n, 1)::DOUBLE AS status_changes; least(pass_run, 20) / 20.0::DOUBLE AS cycles_since_fail; "
          "coalesce(exact_rate_10, 0) AS fail_rate_last_10"))

# ---- feature vectors
_XR = "coalesce(exact_failures / nullif(exact_failures + exact_passes, 0)::DOUBLE, 0)"
_FL10 = "CASE WHEN n > 1 THEN raw_flips_10 / least(n, 10)::DOUBLE ELSE 0 END"


def _seen(expr, name, other=0):
    return f"CASE WHEN n > 0 THEN {expr} ELSE {other} END AS {name}"


def _v2t(published):
    cols = [_seen(e, c) for c, e in {
        "test_age": "build_idx - first_idx", "failure_rate": _XR, "recent_failure_rate": "rate_5",
        "flakiness_rate": _FL10, "execution_count": "n", "failure_count": "exact_failures", "pass_count": "exact_passes",
        "consecutive_failures": "exact_fail_run", "consecutive_passes": "exact_pass_run",
        "max_consecutive_failures": "max_exact_fail_run",
        "last_failure_age": "coalesce(last_idx - last_exact_fail_idx, -1)",
        "last_pass_age": "coalesce(last_idx - last_exact_pass_idx, -1)",
        "execution_frequency": "(exact_failures + exact_passes) / (last_idx - first_idx + 1)::DOUBLE",
        "failure_trend": "rate_5 - rate_10", "recent_execution_count": "least(n, 10)",
        "very_recent_failure_rate": "rate_2", "medium_term_failure_rate": "rate_10",
        "acceleration": "CASE WHEN n >= 2 THEN rate_5 - rate_2 ELSE 0 END",
        "deceleration_factor": f"coalesce(({_XR} - rate_5) / nullif({_XR}, 0), 0)",
        "builds_since_change": "build_idx - last_idx"}.items()]
    cols += [f"{CC} AS commit_count", "n_crs AS cr_count", "n_commits AS commit_count_actual",
             f"{AVG} AS avg_commits_per_execution", f"{SURGE} AS recent_commit_surge"]
    if published:
        cols += ["1 AS test_novelty", _seen("0", "builds_affected", 1), _seen("1", "stability_score", "0.5::DOUBLE"),
                 _seen("0", "pass_fail_ratio", 1)]
    else:
        cols += ["(n = 0)::INT AS test_novelty", _seen("n", "builds_affected", 1),
                 _seen(f"1 - {_FL10}", "stability_score", "0.5::DOUBLE"),
                 _seen("exact_passes / (exact_failures + 1)::DOUBLE", "pass_fail_ratio", 1)]
    return "; ".join(cols)


add("features_v2_temporal", _simple(f.features_v2_temporal, *f.V2_NAMES), HN + sql_select("h", SK, "", _v2t(False)))
add("features_v2_temporal_as_published", _simple(lambda e: f.features_v2_temporal(e, True), *f.V2_NAMES),
    HN + sql_select("h", SK, "", _v2t(True)))
_SEL = [f.V2_NAMES[i] for i in f.SELECTED_INDICES]
add("features_selected", _simple(lambda e: f.features_selected(f.features_v2_temporal(e)), *_SEL),
    f"SELECT build_id, tc_key, {', '.join(_SEL)} FROM (" + HN + sql_select("h", SK, "", _v2t(False)) + ")")
_DECN = _DECAY.replace("FROM ex", "FROM exn")
_V3 = {
    "test_age": ("build_idx - first_idx", 0), "failure_rate": (_FR, 0), "recent_failure_rate": ("rate_10", 0),
    "weighted_failure_rate": ("decayed", 0),
    "flakiness_rate": ("CASE WHEN n > 1 THEN flips / (n - 1)::DOUBLE ELSE 0 END", 0),
    "failure_trend": (f"rate_10 - {_FR}", 0), "last_verdict": ("1 - fail_1", 1), "time_since_failure": (TSF, 1),
    "consecutive_failures": ("fail_run", 0), "max_consecutive_failures": ("max_fail_run", 0),
    "execution_frequency": ("n / (last_idx - first_idx + 1)::DOUBLE", "0.5::DOUBLE")}
_V3X = f"(n = 0)::INT AS test_novelty; {CC} AS commit_count; n_crs AS cr_count"
add("features_v3_temporal", _simple(f.features_v3_temporal, *f.V3_NAMES),
    HN.rstrip() + _DECN + sql_select(
        "(SELECT h.*, dec.a / dec.b AS decayed FROM h JOIN dec USING (project, build_id, tc_key))", SK, "",
        "; ".join(_seen(e, c, d) for c, (e, d) in _V3.items()) + "; " + _V3X))


# snapshots: one probe row after the last execution of the training split
def _snap_sql(body, decay=False):
    return f"""WITH {o.EV},
cut AS (SELECT CAST(floor((max(build_idx) + 1) * 0.8::DOUBLE) AS BIGINT) AS c FROM ex),
tr AS (SELECT project, build_id, tc_key, build_idx, result, verdict, duration,
       CASE WHEN verdict <> 0 THEN 1 ELSE 0 END AS fail FROM ex, cut WHERE build_idx < c),
probe AS (SELECT * FROM tr UNION ALL BY NAME
          SELECT project, '' AS build_id, tc_key, max(build_idx) + 1 AS build_idx, NULL AS result, NULL AS verdict,
                 NULL AS duration, NULL AS fail FROM tr GROUP BY project, tc_key),
{o.history('probe')},
dec AS (SELECT project, tc_key, sum(exp(0.1 * build_idx) * fail) / sum(exp(0.1 * build_idx)) AS decayed FROM tr GROUP BY 1, 2),
snap AS (SELECT h.* EXCLUDE (build_id, build_idx, result, verdict, duration, fail), dec.decayed
         FROM h JOIN dec USING (project, tc_key) WHERE build_id = ''),
j AS (SELECT e.build_id, e.tc_key, e.build_idx, e.n_commits, e.n_crs, least(e.build_idx, cut.c) AS now,
             s.* EXCLUDE (project, tc_key) FROM ex e LEFT JOIN snap s USING (project, tc_key), cut),
{body}"""


_FLK = "CASE WHEN n > 1 THEN flips / (n - 1)::DOUBLE WHEN n = 1 THEN 0 END"
_NOV = "CASE WHEN n IS NULL OR now = first_idx THEN 1 ELSE 0 END"
_AVGS = f"({CC} / greatest(coalesce(n, 1), 1)::DOUBLE)"
_SV2 = {
    "test_age": "now - first_idx", "failure_rate": _FR, "recent_failure_rate": "rate_5", "flakiness_rate": _FLK,
    "execution_count": "n", "failure_count": "failures", "pass_count": "n - failures", "consecutive_failures": "fail_run",
    "consecutive_passes": "pass_run", "max_consecutive_failures": "max_fail_run",
    "last_failure_age": "CASE WHEN n > 0 THEN coalesce(last_idx - last_fail_idx, 999) END",
    "last_pass_age": "CASE WHEN n > 0 THEN coalesce(last_idx - last_pass_idx, 999) END",
    "execution_frequency": "n / (last_idx - first_idx + 1)::DOUBLE", "failure_trend": f"rate_5 - {_FR}",
    "recent_execution_count": "least(n, 5)", "very_recent_failure_rate": "rate_2", "medium_term_failure_rate": "rate_10",
    "acceleration": "rate_2 - rate_5", "deceleration_factor": f"CASE WHEN n > 0 THEN coalesce(rate_5 / nullif({_FR}, 0), 1) END",
    "builds_since_change": "now - last_idx", "commit_count": CC, "test_novelty": _NOV, "builds_affected": "n",
    "cr_count": "n_crs", "commit_count_actual": "n_commits", "avg_commits_per_execution": _AVGS,
    "recent_commit_surge": f"CASE WHEN n > 0 AND {CC} > {_AVGS} * 1.5 THEN 1 ELSE 0 END",
    "stability_score": f"1 - {_FLK}", "pass_fail_ratio": "(n - failures) / (failures + 1)::DOUBLE"}
_SV3 = {**{k: e for k, (e, _) in _V3.items()}, "test_age": "now - first_idx", "flakiness_rate": _FLK,
        "time_since_failure": f"CASE WHEN n > 0 THEN {TSF} END",
        "test_novelty": _NOV, "commit_count": CC, "cr_count": "n_crs"}


def _snapshot_sql(names, exprs, defaults):
    vec = "vec AS (SELECT build_id, tc_key, build_idx, " + ", ".join(f"({exprs[c]})::DOUBLE AS {c}" for c in names) + " FROM j)"
    st = [f"avg({c}) AS m_{c}" for c in defaults["means"]] + [f"median({c}) AS m_{c}" for c in defaults["medians"]]
    stats = f"st AS (SELECT {', '.join(st)} FROM vec, cut WHERE build_idx < c)"
    out = []
    for c in names:
        if c in defaults["means"] or c in defaults["medians"]:
            out.append(f"coalesce({c}, m_{c}) AS {c}")
        elif c in defaults["constants"]:
            out.append(f"coalesce({c}, {defaults['constants'][c]}) AS {c}")
        else:
            out.append(c)
    return _snap_sql(f"{vec}, {stats} " + sql_select("vec, st", SK, "", "; ".join(out)))


def _snap(build, names):
    def run(spark, sf):
        e = holdout_split(_ev(spark, sf))
        return shaped(build(e.filter("split <> 'test'").drop("split"), e.drop("split")), *KEY, *names)
    return run


add("features_v1", _snap(f.features_v1, f.V1_NAMES), _snapshot_sql(f.V1_NAMES, _SV2, f._V1_DEFAULTS))
add("features_v2_snapshot", _snap(f.features_v2_snapshot, f.V2_NAMES), _snapshot_sql(f.V2_NAMES, _SV2, f._V2_DEFAULTS))
add("features_v3_snapshot", _snap(f.features_v3_snapshot, f.V3_NAMES), _snapshot_sql(f.V3_NAMES, _SV3, f._V3_DEFAULTS))

_TOP = "(greatest(max_duration, 0) + 1e-6::DOUBLE)"
_N8 = {
    "last_verdict": "fail_1", "last_duration": f"last_duration / {_TOP}", "failure_rate": _FR, "recent_failure_rate": "rate_10",
    "execution_share": "n / (build_idx + 1)::DOUBLE", "mean_duration": f"duration_sum / n / {_TOP}",
    "max_duration": f"greatest(max_duration, 0) / {_TOP}", "since_failure": "pass_run / (n + 1)::DOUBLE",
    "same_verdict_run": "CASE WHEN fail_1 = 1 THEN fail_run ELSE pass_run END / (n + 1)::DOUBLE"}
_HALF = "(CASE WHEN n % 2 = 1 THEN n - 1 ELSE n - 2 END)"
_OLDF = f"floor(CASE WHEN n % 2 = 1 THEN failures ELSE failures - fail_1 END * ({_HALF} / 2.0::DOUBLE) / ({_HALF} + 1))"
_N10 = {**_N8, "failure_velocity": f"CASE WHEN n >= 3 THEN (failures - {_OLDF}) / (n - {_HALF} / 2.0::DOUBLE) - {_OLDF} / ({_HALF} / 2.0::DOUBLE) ELSE 0 END",
        "regularity": "1 - (build_idx - n) / (build_idx + 1)::DOUBLE"}
_D8 = ["last_verdict", "last_duration", "failure_rate", "recent_failure_rate", "execution_share", "mean_duration",
       "since_failure", "same_verdict_run"]
_F8 = ["failure_rate", "recent_failure_rate", "mean_duration", "max_duration", "execution_share", "last_verdict",
       "since_failure", "same_verdict_run"]
_U = {"last_verdict": "0.5::DOUBLE", "since_failure": 1}
add("features_deeporder8", _simple(f.features_deeporder8, *_D8),
    H + sql_select("h", SK, "", "; ".join(_seen(_N8[c], c, _U.get(c, 0)) for c in _D8)))
add("features_failrank8", _simple(f.features_failrank8, *_F8),
    H + sql_select("h", SK, "", "; ".join(_seen(_N8[c], c) for c in _F8)))
_X10 = [*_D8, "failure_velocity", "regularity"]
add("features_noderank10_published", _simple(lambda e: f.features_noderank10(e, True), *_X10),
    H + sql_select("h", SK, "", "; ".join(_seen(_N10[c], c, _U.get(c, 0)) for c in _X10)))
_VELOCITY = "(SELECT (h.failures - sum(e.fail)) / (h.n - floor(h.n / 2))::DOUBLE - avg(e.fail) FROM first_half e WHERE e.project = h.project AND e.tc_key = h.tc_key AND e.at <= floor(h.n / 2))"
_NX = {**_N10, "failure_velocity": f"CASE WHEN n >= 3 THEN {_VELOCITY} ELSE 0 END"}
add("features_noderank10", _simple(f.features_noderank10, *_X10),
    H.rstrip() + ", first_half AS (SELECT project, tc_key, fail, row_number() OVER (PARTITION BY project, tc_key ORDER BY build_idx) AS at FROM ex) "
    + sql_select("h", SK, "", "; ".join(_seen(_NX[c], c, _U.get(c, 0)) for c in _X10)))
_T12 = ["duration", "last_result", "status_last_2", "status_last_3", "status_last_5", "status_last_10", "failure_rate",
        "since_fail", "execution_count", "status_changes", "failure_streak", "test_age"]
add("features_tcpnet12", _simple(f.features_tcpnet12, *_T12),
    H + sql_select("h", SK, "", "duration; coalesce(fail_1, 0) AS last_result; " + "; ".join(
        f"coalesce(rate_{k}, 0) AS status_last_{k}" for k in (2, 3, 5, 10))
        + f"; {o.RATE} AS failure_rate; coalesce(build_idx - last_fail_idx, build_idx) AS since_fail; n AS execution_count; "
          "flips AS status_changes; fail_run AS failure_streak; coalesce(build_idx - first_idx, 0) AS test_age"))
STATE_SQL = (", span AS (SELECT project, build_id, min(duration) AS lo, max(duration) AS hi, count(*) AS t FROM ex GROUP BY 1, 2), "
             "state AS (SELECT h.*, CASE WHEN hi > lo AND t > 1 THEN (hi - duration) / (hi - lo) ELSE 0.5::DOUBLE END AS state_duration, "
             "CASE WHEN n = 0 THEN 0 WHEN build_idx > 1 THEN (build_idx - (build_idx - last_idx)) / (build_idx - 1)::DOUBLE "
             "ELSE 0.5::DOUBLE END AS state_recency, "
             + ", ".join(f"coalesce(1 - fail_{k}, 1) AS state_v{k}" for k in range(1, 5))
             + " FROM h JOIN span USING (project, build_id)) ")
_S6 = ["state_duration", "state_recency", "state_v1", "state_v2", "state_v3", "state_v4"]
add("state_retecs6_published", _simple(lambda e: f.state_retecs6(e, True), *_S6), H.rstrip() + STATE_SQL + sql_select("state", SK, "", "; ".join(_S6)))
_OLDEST = (", lasts AS (SELECT project, build_idx, min(last) AS oldest FROM (SELECT b.project, b.build_idx, e.tc_key, max(e.build_idx) AS last FROM "
           "(SELECT DISTINCT project, build_idx FROM ex) b JOIN ex e ON e.project = b.project AND e.build_idx < b.build_idx GROUP BY ALL) GROUP BY ALL), "
           "state6 AS (SELECT state.* REPLACE (CASE WHEN n = 0 THEN 0 WHEN build_idx - 1 > oldest THEN (last_idx - oldest) / (build_idx - 1 - oldest)::DOUBLE "
           "ELSE 0.5::DOUBLE END AS state_recency) FROM state LEFT JOIN lasts USING (project, build_idx)) ")
add("state_retecs6", _simple(f.state_retecs6, *_S6), H.rstrip() + STATE_SQL.rstrip() + _OLDEST + sql_select("state6", SK, "", "; ".join(_S6)))


def _cold(spark, sf):
    e = holdout_split(_ev(spark, sf))
    h = history(e, want=["n", "failures", "flips"]).withColumns({
        "failure_rate": F.col("failures") / F.nullif(F.col("n").cast("double"), F.lit(0.0)),
        "flakiness_rate": F.when(F.col("n") > 1, F.col("flips") / (F.col("n") - 1)),
        "since": F.when(F.col("n") > 0, F.col("n")).cast("double")})
    out = f.cold_start_defaults(h, h.filter("split <> 'test'"), ["failure_rate"], ["flakiness_rate"], {"since": 999})
    return shaped(out, *KEY, "failure_rate", "flakiness_rate", "since")


add("cold_start_defaults", _cold, H.rstrip() + f""", c AS (SELECT *, {_FR} AS fr,
    CASE WHEN n > 1 THEN flips / (n - 1)::DOUBLE END AS fl FROM h),
  st AS (SELECT avg(fr) AS mfr, median(fl) AS mfl FROM c WHERE NOT ({_CUT})) """ + sql_select(
    "c, st", SK, "", "coalesce(fr, mfr) AS failure_rate; coalesce(fl, mfl) AS flakiness_rate; "
                     "coalesce(CASE WHEN n > 0 THEN n END, 999) AS since"))
add("imputation_mask", _simple(f.imputation_mask, "needs_imputation"),
    H + sql_select("h", SK, "CASE WHEN n < 2 THEN 1 ELSE 0 END AS needs_imputation"))
_FS = ["failure_rate", "recent_failure_rate", "execution_count", "test_age"]
add("feature_stats", lambda spark, sf: shaped(f.feature_stats(f.features_v2_temporal(_ev(spark, sf)), _FS)),
    f"WITH v AS ({HN}" + "SELECT " + ", ".join(
        "(" + x.rsplit(" AS ", 1)[0] + ")::DOUBLE AS " + x.rsplit(" AS ", 1)[1] for x in _v2t(False).split("; ")
        if x.rsplit(" AS ", 1)[1] in _FS) + " FROM h), "
    "u AS (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, {c} AS value FROM v" for c in _FS) + ") "
    "SELECT feature, round(avg(value), 6) + 0 AS mean, round(stddev_pop(value), 6) + 0 AS std, round(min(value), 6) + 0 AS min, "
    "round(max(value), 6) + 0 AS max, round(median(value), 6) + 0 AS median FROM u GROUP BY feature")
_CF = ["total_executions", "total_failures", "is_new_test", "recent_executions", "recent_failures", "last_failure_recency"]
add("cumulative_features", lambda spark, sf: shaped(
    f.cumulative_features(executions(spark, sf, "li")), "project", *KEY, *_CF, "avg_duration", "failure_rate"),
    f"WITH {o.LI}, {o.history()} " + sql_select(
        "h", "project; " + SK, "n AS total_executions; failures AS total_failures; (n = 0)::INT AS is_new_test; "
        "least(n, 10) AS recent_executions; recent_fails_11 AS recent_failures; "
        "coalesce(build_idx - last_fail_idx, build_idx + 1) AS last_failure_recency",
        f"coalesce(duration_sum / nullif(n, 0), duration) AS avg_duration; {o.RATE} AS failure_rate"))


def _nodes(spark, sf):
    e = _ev(spark, sf)
    return shaped(f.node_features(f.features_deeporder8(e), e), "tc_key", "build_idx", "label", *_D8)


add("node_features", _nodes, H.rstrip() + ", r AS (SELECT *, row_number() OVER (PARTITION BY project, tc_key ORDER BY build_idx DESC) AS rn, "
    "max(fail) OVER (PARTITION BY project, tc_key) AS label FROM h) " + sql_select(
    "r", "tc_key", "build_idx; label", "; ".join(_seen(_N8[c], c, _U.get(c, 0)) for c in _D8), "rn = 1"))
