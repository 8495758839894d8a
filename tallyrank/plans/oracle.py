"""Shared SQL for the cross-check: execution tables and their running history."""

from __future__ import annotations

EV = """
raw AS (
  SELECT 'ev' AS project, strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS build_id,
         date_trunc('hour', ts) AS build_start, 'u' || user_id AS tc_key,
         CASE event_type WHEN 'error' THEN 'Fail' WHEN 'signup' THEN 'Blocked' ELSE 'Pass' END AS result,
         value AS duration, ts AS exec_ts, event_id AS exec_id,
         CAST(json_extract_string(props, '$.k') AS INT) AS k
  FROM events),
col AS (
  SELECT project, build_id, tc_key, min(build_start) AS build_start,
         arg_max(result, row(CASE result WHEN 'Fail' THEN 2 WHEN 'Pass' THEN 0 ELSE 1 END, exec_ts, exec_id)) AS result,
         arg_max(duration, row(exec_ts, exec_id)) AS duration, max(exec_ts) AS exec_ts,
         count(*) AS n_commits, count(*) FILTER (k % 3 = 0) AS n_crs, count(*) AS n_rows
  FROM raw GROUP BY 1, 2, 3),
ex AS (
  SELECT *, CASE result WHEN 'Fail' THEN 1 WHEN 'Pass' THEN 0 ELSE 2 END AS verdict,
         CASE WHEN result = 'Fail' THEN 1 ELSE 0 END AS fail,
         dense_rank() OVER (PARTITION BY project ORDER BY build_start, build_id) - 1 AS build_idx
  FROM col)"""

LI = """
raw AS (
  SELECT c_mktsegment AS project, CAST(l_orderkey AS VARCHAR) AS build_id, o_orderdate AS build_start,
         's' || l_suppkey AS tc_key,
         CASE l_returnflag WHEN 'R' THEN 'Fail' WHEN 'A' THEN 'Pass' ELSE 'Blocked' END AS result,
         l_quantity AS duration, l_shipdate AS exec_ts, l_extendedprice AS exec_id, l_linestatus AS component
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey),
col AS (
  SELECT project, build_id, tc_key, min(build_start) AS build_start,
         arg_max(result, row(CASE result WHEN 'Fail' THEN 2 WHEN 'Pass' THEN 0 ELSE 1 END, exec_ts, exec_id)) AS result,
         arg_max(duration, row(exec_ts, exec_id)) AS duration, max(exec_ts) AS exec_ts, count(*) AS n_rows
  FROM raw GROUP BY 1, 2, 3),
ex AS (
  SELECT *, CASE result WHEN 'Fail' THEN 1 WHEN 'Pass' THEN 0 ELSE 2 END AS verdict,
         CASE WHEN result = 'Fail' THEN 1 ELSE 0 END AS fail,
         dense_rank() OVER (PARTITION BY project ORDER BY build_start, build_id) - 1 AS build_idx
  FROM col)"""

_HIST = """
h1 AS (
  SELECT *,
    row_number() OVER w AS pos,
    CASE WHEN fail <> lag(fail) OVER w THEN 1 ELSE 0 END AS flip,
    CASE WHEN verdict < 2 AND lag(verdict) OVER w < 2 AND verdict <> lag(verdict) OVER w THEN 1 ELSE 0 END AS xflip,
    CASE WHEN result <> lag(result) OVER w THEN 1 ELSE 0 END AS rflip,
    sum(1 - fail) OVER w AS g_fail, sum(fail) OVER w AS g_pass,
    sum(CASE WHEN verdict = 0 THEN 1 ELSE 0 END) OVER w AS gx_fail,
    sum(CASE WHEN verdict = 1 THEN 1 ELSE 0 END) OVER w AS gx_pass
  FROM {src} WINDOW w AS (PARTITION BY project, tc_key ORDER BY build_idx)),
h2 AS (
  SELECT *,
    CASE WHEN fail = 1 THEN sum(fail) OVER (PARTITION BY project, tc_key, g_fail ORDER BY build_idx) ELSE 0 END AS rf,
    CASE WHEN fail = 0 THEN sum(1 - fail) OVER (PARTITION BY project, tc_key, g_pass ORDER BY build_idx) ELSE 0 END AS rp,
    CASE verdict WHEN 1 THEN sum((verdict = 1)::INT) OVER (PARTITION BY project, tc_key, gx_fail ORDER BY build_idx) WHEN 0 THEN 0 END AS xrf,
    CASE verdict WHEN 0 THEN sum((verdict = 0)::INT) OVER (PARTITION BY project, tc_key, gx_pass ORDER BY build_idx) WHEN 1 THEN 0 END AS xrp,
    CASE WHEN verdict < 2 THEN verdict END AS xv
  FROM h1),
h AS (
  SELECT *,
    pos - 1 AS n, coalesce(sum(fail) OVER p, 0) AS failures,
    coalesce(sum((verdict = 1)::INT) OVER p, 0) AS exact_failures,
    coalesce(sum((verdict = 0)::INT) OVER p, 0) AS exact_passes,
    coalesce(sum(flip) OVER p, 0) AS flips, coalesce(sum(xflip) OVER p, 0) AS exact_flips,
    sum(duration) OVER p AS duration_sum, max(duration) OVER p AS max_duration,
    min(build_idx) OVER p AS first_idx, max(build_idx) OVER p AS last_idx,
    max(CASE WHEN fail = 1 THEN build_idx END) OVER p AS last_fail_idx,
    max(CASE WHEN fail = 0 THEN build_idx END) OVER p AS last_pass_idx,
    max(CASE WHEN verdict = 1 THEN build_idx END) OVER p AS last_exact_fail_idx,
    max(CASE WHEN verdict = 0 THEN build_idx END) OVER p AS last_exact_pass_idx,
    first_value(verdict) OVER p AS first_verdict,
    coalesce(lag(rf) OVER w, 0) AS fail_run, coalesce(lag(rp) OVER w, 0) AS pass_run,
    coalesce(max(rf) OVER p, 0) AS max_fail_run, coalesce(max(rp) OVER p, 0) AS max_pass_run,
    coalesce(last_value(xrf IGNORE NULLS) OVER p, 0) AS exact_fail_run,
    coalesce(last_value(xrp IGNORE NULLS) OVER p, 0) AS exact_pass_run,
    coalesce(max(xrf) OVER p, 0) AS max_exact_fail_run,
    avg(fail) OVER (PARTITION BY project, tc_key ORDER BY build_idx ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING) AS rate_2,
    avg(fail) OVER (PARTITION BY project, tc_key ORDER BY build_idx ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS rate_3,
    avg(fail) OVER (PARTITION BY project, tc_key ORDER BY build_idx ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS rate_5,
    avg(fail) OVER (PARTITION BY project, tc_key ORDER BY build_idx ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS rate_10,
    avg(fail) OVER (PARTITION BY project, tc_key ORDER BY build_idx ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS rate_20,
    avg(xv) OVER (PARTITION BY project, tc_key ORDER BY build_idx ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS exact_rate_10,
    coalesce(sum(rflip) OVER (PARTITION BY project, tc_key ORDER BY build_idx ROWS BETWEEN 9 PRECEDING AND 1 PRECEDING), 0) AS raw_flips_10,
    coalesce(sum(flip) OVER (PARTITION BY project, tc_key ORDER BY build_idx ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING), 0) AS fail_flips_5,
    coalesce(sum(fail) OVER (PARTITION BY project, tc_key ORDER BY build_idx ROWS BETWEEN 11 PRECEDING AND 1 PRECEDING), 0) AS recent_fails_11,
    lag(duration) OVER w AS last_duration,
    {lags}
  FROM h2
  WINDOW w AS (PARTITION BY project, tc_key ORDER BY build_idx),
         p AS (PARTITION BY project, tc_key ORDER BY build_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""


def history(source: str = "ex", not_pass: bool = False) -> str:
    lags = ", ".join(f"lag(fail, {k}) OVER w AS fail_{k}, lag(verdict, {k}) OVER w AS verdict_{k}" for k in range(1, 11))
    if not_pass:
        pre = f"exn AS (SELECT * REPLACE (CASE WHEN verdict <> 0 THEN 1 ELSE 0 END AS fail) FROM {source}),"
        return pre + _HIST.format(src="exn", lags=lags)
    return _HIST.format(src=source, lags=lags)


def ev_history(not_pass: bool = False) -> str:
    return f"WITH {EV}, {history(not_pass=not_pass)} "


SINCE = "coalesce(build_idx - last_fail_idx - 1, build_idx)"
RATE = "coalesce(failures / nullif(n, 0)::DOUBLE, 0)"

SCORED = f"scored AS (SELECT *, {RATE} AS score FROM h)"
RANKED = (SCORED + ", ranked AS (SELECT *, row_number() OVER (PARTITION BY project, build_id "
          "ORDER BY score DESC, tc_key) AS rank FROM scored)")


def apfd(source: str = "ranked", name: str = "per", by: str = "project, build_id", plain: bool = False) -> str:
    raw = "1 - sum(CASE WHEN fail = 1 THEN rank END) / (count(*) * sum(fail))::DOUBLE + 1 / (2.0::DOUBLE * count(*))"
    value = raw if plain else f"CASE WHEN count(DISTINCT tc_key) = 1 THEN 1 ELSE greatest(0, least(1, {raw})) END"
    return (f"{name} AS (SELECT {by}, count(DISTINCT tc_key) AS count_tc, sum(fail) AS n_failures, "
            f"{value} AS apfd FROM {source} GROUP BY {by} HAVING sum(fail) > 0)")
