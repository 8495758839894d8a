"""Queries on ranking and grading, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyrank.functions.hashing import hash_int
from tallyrank.operators import features as feat
from tallyrank.operators import metrics as m
from tallyrank.operators import ranking as r
from tallyrank.operators.chronology import expanding_folds, holdout_split
from tallyrank.operators.history import history
from tallyrank.plans import oracle as o
from tallyrank.plans.fixtures import executions, table
from tallyrank.plans.history_queries import STATE_SQL
from tallyrank.plans.shape import shaped, sql_select
from tallyrank.sources.readers import STRATEGIES

Q, S = {}, {}
BT = "build_id; tc_key"
H = o.ev_history()


def add(name, fn, sql=None):
    Q[name] = fn
    if sql:
        S[name] = sql


def scored(spark, sf, kind="ev"):
    """Executions scored by the failure rate of earlier builds."""
    h = history(executions(spark, sf, kind), want=["n", "failures"])
    return h.withColumn("score", r.failure_rate_score())


def ranked(spark, sf, kind="ev"):
    return r.rank_in_build(scored(spark, sf, kind), sizes=executions(spark, sf, kind))


def rank_sql(score, extra=""):
    return (H.rstrip() + extra + f", s AS (SELECT *, {score} AS score FROM h), q AS (SELECT *, row_number() OVER "
            "(PARTITION BY project, build_id ORDER BY score DESC, tc_key) AS rank FROM s) ")


RANKED = H.rstrip() + ", " + o.RANKED
PER = RANKED + ", " + o.apfd()

add("apfd_per_build", lambda spark, sf: shaped(m.apfd_per_build(ranked(spark, sf)), "build_id", "count_tc", "n_failures", "apfd"),
    PER + sql_select(" per", "build_id", "count_tc; n_failures", "apfd"))
add("rank_in_build", lambda spark, sf: shaped(ranked(spark, sf), "build_id", "tc_key", "rank", "score"),
    RANKED + sql_select(" ranked", BT, "rank", "score"))
_HASH = "('0x' || substr(md5(project || '|' || build_id || '|' || tc_key || '|42'), 1, 15))::BIGINT"
add("rank_random", lambda spark, sf: shaped(r.rank_random(executions(spark, sf), 42), "build_id", "tc_key", "rank"),
    f"WITH {o.EV}, q AS (SELECT *, row_number() OVER (PARTITION BY project, build_id ORDER BY {_HASH} DESC, tc_key) AS rank FROM ex) "
    + sql_select("q", BT, "rank"))


def _heuristic(score, *want):
    def run(spark, sf):
        e = executions(spark, sf)
        h = history(e, want=list(want))
        h = score(h) if callable(score) else h.withColumn("score", score)
        return shaped(r.rank_in_build(h, sizes=e), "build_id", "tc_key", "rank", "score")
    return run


_out = sql_select("q", BT, "rank", "score")
add("rank_recency", lambda spark, sf: _heuristic(r.recency_score(), "last_fail_idx")(spark, sf), rank_sql(f"-({o.SINCE})") + _out)
add("rank_recency_as_published", lambda spark, sf: _heuristic(r.recency_score(True), "last_fail_idx")(spark, sf),
    rank_sql(o.SINCE) + _out)
add("rank_recent_failure_rate", lambda spark, sf: _heuristic(r.recent_rate_score(5), "rate_5")(spark, sf),
    rank_sql("coalesce(rate_5, 0)") + _out)
add("rank_failure_rate_unknown_half", lambda spark, sf: _heuristic(r.failure_rate_score(0.5), "n", "failures")(spark, sf),
    rank_sql("coalesce(failures / nullif(n, 0)::DOUBLE, 0.5::DOUBLE)") + _out)
_AGE = "coalesce(build_idx - first_idx - 1, 0)"
add("rank_greedy_historical", _heuristic(r.with_greedy_score, "n", "failures", "first_idx", "last_fail_idx"),
    rank_sql(f"0.5::DOUBLE * (1 / (1 + {o.SINCE})::DOUBLE) + 0.3::DOUBLE * {o.RATE} + 0.2::DOUBLE * (1 - {_AGE} / "
             f"greatest(max({_AGE}) OVER (PARTITION BY project, build_id), 1)::DOUBLE)") + _out)
add("top_k", lambda spark, sf: shaped(r.top_k(ranked(spark, sf), 5), "build_id", "tc_key", "rank"),
    RANKED + sql_select(" ranked", BT, "rank", where="rank <= 5"))
add("top_pct", lambda spark, sf: shaped(r.top_pct(ranked(spark, sf), 0.1), "build_id", "tc_key", "rank"),
    RANKED + ", z AS (SELECT *, count(*) OVER (PARTITION BY project, build_id) AS c FROM ranked) "
    + sql_select("z", BT, "rank", where="rank <= greatest(ceil(c * 0.1::DOUBLE), 1)"))
add("rewards_tcfail", lambda spark, sf: shaped(r.rewards(ranked(spark, sf)), "build_id", "tc_key", "reward"),
    RANKED + sql_select(" ranked", BT, "", "fail AS reward"))
_TR = (", z AS (SELECT *, CASE WHEN fail = 1 THEN sum(fail) OVER (PARTITION BY project, build_id) ELSE "
       "sum(fail) OVER (PARTITION BY project, build_id ORDER BY rank) END AS reward FROM ranked)")
add("rewards_timerank", lambda spark, sf: shaped(r.rewards(ranked(spark, sf), "timerank"), "build_id", "tc_key", "reward"),
    RANKED + _TR + sql_select(" z", BT, "", "reward"))


def _states(spark, sf):
    st = r.discretize_state(feat.state_retecs6(executions(spark, sf), as_published=True))
    rw = r.rewards(ranked(spark, sf), "timerank").select("project", "build_id", "tc_key", "reward")
    return shaped(r.mean_reward(st.join(rw, ["project", "build_id", "tc_key"])))


add("state_mean_reward", _states, RANKED + _TR + STATE_SQL
    + ", d AS (SELECT least(floor(state_duration * 3), 2) AS dur_bucket, least(floor(state_recency * 3), 2) AS time_bucket, "
      "state_v1 AS h0, state_v2 AS h1, state_v3 AS h2, state_v4 AS h3, z.reward FROM state JOIN z USING (project, build_id, tc_key)), "
      "g AS (SELECT dur_bucket, time_bucket, h0, h1, h2, h3, count(*) AS n, avg(reward) AS mean_reward FROM d GROUP BY ALL) "
    + sql_select("g", "", "dur_bucket; time_bucket; h0; h1; h2; h3; n", "mean_reward"))

# ---- grading of rankings
add("mean_apfd", lambda spark, sf: shaped(m.mean_apfd(m.apfd_per_build(ranked(spark, sf)))),
    PER + " SELECT round(avg(apfd), 6) + 0 AS mean_apfd FROM per")
_SUM = ("count(*) AS n_builds; sum(count_tc) AS total_tests; sum((apfd = 1)::INT) AS n_perfect; sum((apfd >= 0.7::DOUBLE)::INT) AS n_ge_07; "
        "sum((apfd >= 0.5::DOUBLE)::INT) AS n_ge_05; sum((apfd < 0.5::DOUBLE)::INT) AS n_lt_05")
_SUMD = ("avg(apfd) AS mean_apfd; stddev_samp(apfd) AS std_apfd; min(apfd) AS min_apfd; max(apfd) AS max_apfd; median(apfd) AS median_apfd")
add("apfd_summary", lambda spark, sf: shaped(m.apfd_summary(m.apfd_per_build(ranked(spark, sf)))),
    PER + " " + sql_select("per", "", _SUM, _SUMD))
_LIP = f"WITH {o.LI}, {o.history()}, {o.RANKED}, {o.apfd()} "
add("apfd_summary_by_project", lambda spark, sf: shaped(m.apfd_summary(m.apfd_per_build(ranked(spark, sf, "li")), ["project"])),
    _LIP + sql_select("per", "project", _SUM, _SUMD) + " GROUP BY project")
add("apfd_plain", lambda spark, sf: shaped(m.apfd_plain(ranked(spark, sf, "li")), "project", "build_id", "n_failures", "apfd"),
    f"WITH {o.LI}, {o.history()}, {o.RANKED}, {o.apfd(plain=True)} " + sql_select("per", "project; build_id", "n_failures", "apfd"))
_ATK = ", ".join(
    f"CASE WHEN count(*) >= {k} THEN CASE WHEN sum((fail = 1 AND rank <= {k})::INT) = 0 THEN 0 ELSE 1 - sum(CASE WHEN fail = 1 AND rank <= {k} "
    f"THEN rank ELSE 0 END) / ({k} * sum((fail = 1 AND rank <= {k})::INT))::DOUBLE + 1 / {2 * k}.0::DOUBLE END END AS apfd_at_{k}, "
    f"CASE WHEN count(*) >= {k} THEN sum((fail = 1 AND rank <= {k})::INT) / sum(fail)::DOUBLE END AS recall_at_{k}" for k in (5, 10))
add("apfd_recall_at_k", lambda spark, sf: shaped(
    m.at_k(ranked(spark, sf)), "build_id", "n_tests", "n_failures", "first_failure_position",
    "apfd_at_5", "recall_at_5", "apfd_at_10", "recall_at_10"),
    RANKED + f", g AS (SELECT build_id, count(*) AS n_tests, sum(fail) AS n_failures, min(CASE WHEN fail = 1 THEN rank END) AS "
    f"first_failure_position, {_ATK} FROM ranked GROUP BY project, build_id HAVING sum(fail) > 0) "
    + sql_select("g", "build_id", "n_tests; n_failures; first_failure_position", "apfd_at_5; recall_at_5; apfd_at_10; recall_at_10"))


def _index_scores():
    """Named strategies as an `index` column, as a stored ranking file would hold it."""
    return {
        "untreated": F.unix_micros(F.col("exec_ts").cast("timestamp")) / 1e6,
        "recently-failed": r.since_failure().cast("double"),
        "matrix-naive": -r.failure_rate_score(),
        "optimal-failure": -F.col("fail").cast("double"),
        # failing tests first, the shortest of them first
        "optimal-failure-duration": F.col("duration") - F.col("fail") * 1e6,
        "random": hash_int(F.col("project"), F.col("build_id"), F.col("tc_key"), 42).cast("double"),
        # how often the test failed lately, over fewer runs if it failed the last time
        "matrix-conditional-prob": -F.coalesce(F.when(F.col("fail_1") == 1, F.col("rate_5")).otherwise(F.col("rate_10")), F.lit(0.0)),
    }


def strategies(spark, sf):
    h = history(executions(spark, sf), want=["n", "failures", "last_fail_idx", "fail_1", "rate_5", "rate_10"])
    rows = h.select("project", "build_id", "tc_key", "fail", F.explode(F.array(*[
        F.struct(F.lit(k).alias("strategy"), v.alias("index")) for k, v in _index_scores().items()])).alias("s"))
    return rows.select("project", "build_id", "tc_key", "fail", "s.strategy", "s.index")


_STRAT = (H.rstrip() + ", st AS (SELECT *, 'untreated' AS strategy, epoch_us(exec_ts) / 1e6::DOUBLE AS idx FROM h UNION ALL "
          f"SELECT *, 'recently-failed', ({o.SINCE})::DOUBLE FROM h UNION ALL SELECT *, 'matrix-naive', -{o.RATE} FROM h UNION ALL "
          "SELECT *, 'optimal-failure', -fail::DOUBLE FROM h UNION ALL SELECT *, 'optimal-failure-duration', duration - fail * 1e6::DOUBLE FROM h UNION ALL "
          "SELECT *, 'random', ('0x' || substr(md5(project || '|' || build_id || '|' || tc_key || '|42'), 1, 15))::BIGINT::DOUBLE FROM h UNION ALL "
          "SELECT *, 'matrix-conditional-prob', -coalesce(CASE WHEN fail_1 = 1 THEN rate_5 ELSE rate_10 END, 0) FROM h), ranked AS (SELECT *, row_number() OVER (PARTITION BY strategy, project, "
          "build_id ORDER BY idx, tc_key) AS rank FROM st), " + o.apfd(by="strategy, project, build_id", plain=True))
STRATEGY_SQL, STRATEGY_NAMES = _STRAT, STRATEGIES
add("evaluate_strategies", lambda spark, sf: shaped(m.evaluate_strategies(strategies(spark, sf))),
    _STRAT + " " + sql_select("per", "strategy", "count(*) AS n_builds",
                              "avg(apfd) AS mean_apfd; stddev_samp(apfd) AS std_apfd; median(apfd) AS median_apfd") + " GROUP BY strategy")


def _versus(spark, sf):
    base = m.evaluate_strategies(strategies(spark, sf))
    model = m.mean_apfd(base.filter("strategy = 'matrix-naive'").withColumn("apfd", F.col("mean_apfd")))
    return shaped(m.compare_to_baselines(model, base.filter("strategy <> 'matrix-naive'")))


add("compare_to_baselines", _versus, _STRAT + ", b AS (SELECT strategy, avg(apfd) AS mean_apfd FROM per GROUP BY 1), "
    "v AS (SELECT b.strategy, b.mean_apfd, x.mean_apfd AS model_apfd FROM b, b x WHERE x.strategy = 'matrix-naive' AND b.strategy <> 'matrix-naive') "
    + sql_select("v", "strategy", "(model_apfd > mean_apfd)::INT AS model_better", "mean_apfd; model_apfd; "
                 "model_apfd - mean_apfd AS difference; (model_apfd - mean_apfd) * 100 / mean_apfd AS percent"))
_GAIN = "1 / log2(rank + 1)"
add("ndcg_recall_pct", lambda spark, sf: shaped(m.ndcg_recall(ranked(spark, sf))),
    RANKED + ", g AS (SELECT count(*) AS c, sum(fail) AS mm, "
    + ", ".join(f"sum(CASE WHEN fail = 1 AND rank <= {k} THEN {_GAIN} ELSE 0 END) AS d{k}, "
                f"list_sum(list_transform(range(1, (least(sum(fail), {k}) + 1)::BIGINT), lambda i: 1 / log2(i + 1))) AS i{k}" for k in (5, 10))
    + ", sum((fail = 1 AND rank <= greatest(ceil(cc * 0.1::DOUBLE), 1))::INT) AS rp FROM (SELECT *, count(*) OVER (PARTITION BY project, build_id) "
      "AS cc FROM ranked) GROUP BY project, build_id HAVING sum(fail) > 0) "
    + sql_select("g", "", "count(*) AS n_builds", "avg(d5 / i5) AS ndcg_at_5; avg(d10 / i10) AS ndcg_at_10; avg(rp / mm::DOUBLE) AS recall_at_10pct"))
add("ir_metrics", lambda spark, sf: shaped(m.ir_metrics(ranked(spark, sf))),
    RANKED + f", z AS (SELECT *, sum(fail) OVER (PARTITION BY project, build_id ORDER BY rank) AS hits FROM ranked), "
    f"g AS (SELECT sum(CASE WHEN fail = 1 THEN {_GAIN} END) AS dcg, list_sum(list_transform(range(1, (sum(fail) + 1)::BIGINT), lambda i: 1 / log2(i + 1))) AS ideal, "
    "1 / min(CASE WHEN fail = 1 THEN rank END)::DOUBLE AS rr, avg(CASE WHEN fail = 1 THEN hits / rank::DOUBLE END) AS ap FROM z "
    "GROUP BY project, build_id HAVING sum(fail) > 0) "
    + sql_select("g", "", "count(*) AS n_builds", "avg(dcg / ideal) AS ndcg; avg(rr) AS mrr; avg(ap) AS map"))

# ---- predicted classes: document quality by scaled length


def binary(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "n_chars")
    span = d.agg(F.min("n_chars").alias("lo"), F.max("n_chars").alias("hi"))
    j = d.join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id").crossJoin(F.broadcast(span))
    s = (F.col("n_chars") - F.col("lo")) / (F.col("hi") - F.col("lo"))
    return j.select("doc_id", F.col("quality").alias("label"), s.alias("score"), (s >= 0.05).cast("int").alias("pred"))


BIN = ("WITH b AS (SELECT doc_id, quality AS label, (n_chars - lo) / (hi - lo)::DOUBLE AS score, "
       "((n_chars - lo) / (hi - lo)::DOUBLE >= 0.05::DOUBLE)::INT AS pred FROM documents JOIN labels USING (doc_id), "
       "(SELECT min(n_chars) AS lo, max(n_chars) AS hi FROM documents))")
add("confusion", lambda spark, sf: shaped(m.confusion(binary(spark, sf))),
    BIN + " SELECT label::BIGINT AS label, pred::BIGINT AS pred, count(*) AS n FROM b GROUP BY ALL")
_PC = BIN + (", c AS (SELECT DISTINCT label AS cls FROM b UNION SELECT DISTINCT pred FROM b), pc AS (SELECT cls, "
             "sum((label = cls)::INT) AS support, sum((label = cls AND pred = cls)::INT) AS tp, sum((pred = cls)::INT) AS pr "
             "FROM b, c GROUP BY cls), f AS (SELECT cls, support, tp, coalesce(tp / nullif(pr, 0)::DOUBLE, 0) AS precision, "
             "coalesce(tp / nullif(support, 0)::DOUBLE, 0) AS recall, coalesce(2 * tp / nullif(pr + support, 0)::DOUBLE, 0) AS f1 FROM pc) ")
add("per_class_metrics", lambda spark, sf: shaped(m.per_class_metrics(binary(spark, sf))),
    _PC + sql_select("f", "", "cls; support; tp", "precision; recall; f1"))
add("classification_metrics", lambda spark, sf: shaped(m.classification_metrics(binary(spark, sf))),
    _PC + sql_select("f", "", "", "sum(tp) / sum(support)::DOUBLE AS accuracy; " + "; ".join(
        f"avg({x}) AS {x}_macro; sum({x} * support) / sum(support) AS {x}_weighted" for x in ("precision", "recall", "f1"))))
_CURVE = (", g AS (SELECT score, sum(label) AS p, sum(1 - label) AS q FROM b GROUP BY 1), c AS (SELECT score, p, "
          "sum(p) OVER (ORDER BY score DESC) AS tp, sum(q) OVER (ORDER BY score DESC) AS fp, sum(p) OVER () AS pos, sum(q) OVER () AS neg FROM g)")


def _ap(cls):
    y, s = ("label", "score") if cls else ("1 - label", "-score")
    return (f"(SELECT sum(p / pos::DOUBLE * tp / (tp + fp)) AS ap, max(pos) AS pos FROM (SELECT p, sum(p) OVER (ORDER BY s DESC) AS tp, "
            f"sum(q) OVER (ORDER BY s DESC) AS fp, sum(p) OVER () AS pos FROM (SELECT {s} AS s, sum({y}) AS p, sum(1 - ({y})) AS q FROM b GROUP BY 1)))")


add("auprc", lambda spark, sf: shaped(m.auprc(binary(spark, sf))),
    BIN + " " + sql_select(f"{_ap(0)} a, {_ap(1)} z", "", "", "a.ap AS ap_class_0; z.ap AS ap_class_1; (a.ap + z.ap) / 2 AS auprc_macro; "
                           "(a.ap * a.pos + z.ap * z.pos) / (a.pos + z.pos) AS auprc_weighted"))


def _grid(ts):
    return (f", t AS (SELECT unnest([{', '.join(repr(float(x)) + '::DOUBLE' for x in ts)}]) AS threshold), "
            "k AS (SELECT threshold, sum((score >= threshold AND label = 1)::INT) AS tp, sum((score >= threshold AND label = 0)::INT) AS fp, "
            "sum((score < threshold AND label = 0)::INT) AS tn, sum((score < threshold AND label = 1)::INT) AS fn FROM b, t GROUP BY 1), "
            "w AS (SELECT *, coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0) AS precision, coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0) AS recall, "
            "coalesce(2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE, 0) AS f1, coalesce(2 * tn / nullif(2 * tn + fp + fn, 0)::DOUBLE, 0) AS f1_neg, "
            "coalesce(tn / nullif(tn + fp, 0)::DOUBLE, 0) AS specificity FROM k) ")


_TS = [0.005, 0.01, 0.02, 0.05, 0.1, 0.2, 0.5]
add("threshold_metrics", lambda spark, sf: shaped(m.threshold_metrics(binary(spark, sf), _TS)),
    BIN + _grid(_TS) + sql_select("w", "", "tp; fp; tn; fn", "threshold; precision; recall; f1; specificity; "
                                  "(recall + specificity) / 2 AS balanced_accuracy"))
_BEST = ("threshold", "best_score", "f1_macro", "f1_minority", "recall_minority", "precision_minority", "balanced_accuracy", "tp", "fp", "tn", "fn")
# class 1 is the rarer one where it has fewer rows than class 0
_SCORES = ("(f1 + f1_neg) / 2 AS f1_macro, CASE WHEN tp + fn < tn + fp THEN f1 ELSE f1_neg END AS f1_minority, "
           "CASE WHEN tp + fn < tn + fp THEN recall ELSE coalesce(tn / nullif(tn + fp, 0)::DOUBLE, 0) END AS recall_minority, "
           "CASE WHEN tp + fn < tn + fp THEN precision ELSE coalesce(tn / nullif(tn + fn, 0)::DOUBLE, 0) END AS precision_minority, "
           "(recall + specificity) / 2 AS balanced_accuracy")


def _best_sql(metric, ts):
    return (BIN + _grid(ts) + f", x AS (SELECT threshold, tp, fp, tn, fn, {_SCORES} FROM w WHERE tp + fp > 0 AND tn + fn > 0) "
            + sql_select(f"(SELECT * FROM x ORDER BY {metric} DESC, threshold LIMIT 1)", "", "tp; fp; tn; fn",
                         f"threshold; {metric} AS best_score; f1_macro; f1_minority; recall_minority; precision_minority; balanced_accuracy"))


for _m in m.MINORITY_METRICS:
    add(f"best_threshold_{_m}", lambda spark, sf, k=_m: shaped(m.best_threshold(binary(spark, sf), k), *_BEST),
        _best_sql(_m, m.linspace(0.01, 0.99, 100)))


def _two(spark, sf):
    return shaped(m.best_threshold_two_phase(binary(spark, sf), "balanced_accuracy"), *_BEST, "coarse_threshold")


_FINE = (", c0 AS (SELECT threshold AS t0 FROM x ORDER BY balanced_accuracy DESC, threshold LIMIT 1), ab AS (SELECT t0, greatest(0.01::DOUBLE, t0 - 0.05::DOUBLE) AS a, "
         "least(0.99::DOUBLE, t0 + 0.05::DOUBLE) AS b FROM c0), nn AS (SELECT *, trunc((b - a) / 0.005::DOUBLE)::BIGINT + 1 AS n FROM ab), "
         "ft AS (SELECT t0, a + (b - a) * i / (n - 1) AS threshold FROM nn, range(100) r(i) WHERE i < n), "
         "fk AS (SELECT t0, threshold, sum((score >= threshold AND label = 1)::INT) AS tp, sum((score >= threshold AND label = 0)::INT) AS fp, "
         "sum((score < threshold AND label = 0)::INT) AS tn, sum((score < threshold AND label = 1)::INT) AS fn FROM b, ft GROUP BY 1, 2), "
         "fw AS (SELECT *, coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0) AS precision, coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0) AS recall, "
         "coalesce(2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE, 0) AS f1, coalesce(2 * tn / nullif(2 * tn + fp + fn, 0)::DOUBLE, 0) AS f1_neg, "
         f"coalesce(tn / nullif(tn + fp, 0)::DOUBLE, 0) AS specificity FROM fk), fx AS (SELECT t0, threshold, tp, fp, tn, fn, {_SCORES} FROM fw WHERE tp + fp > 0 AND tn + fn > 0) ")
_COARSE = m.linspace(0.01, 0.99, int((0.99 - 0.01) / 0.02) + 1)
add("best_threshold_two_phase", _two, BIN + _grid(_COARSE) + f", x AS (SELECT threshold, tp, fp, tn, fn, {_SCORES} FROM w WHERE tp + fp > 0 AND tn + fn > 0)" + _FINE
    + sql_select("(SELECT * FROM fx ORDER BY balanced_accuracy DESC, threshold LIMIT 1)", "", "tp; fp; tn; fn",
                 "threshold; balanced_accuracy AS best_score; f1_macro; f1_minority; recall_minority; precision_minority; balanced_accuracy; t0 AS coarse_threshold"))
add("best_threshold_youden", lambda spark, sf: shaped(m.best_threshold_youden(binary(spark, sf))),
    BIN + _CURVE + " " + sql_select("(SELECT score AS threshold, tp / pos::DOUBLE - fp / neg::DOUBLE AS youden_j FROM c UNION ALL "
                                    "SELECT 'inf'::DOUBLE, 0 ORDER BY round(youden_j, 12) DESC, threshold DESC LIMIT 1)", "", "", "threshold; youden_j"))
for _b in (1, 2):
    _pr = "(tp / (tp + fp)::DOUBLE)", "(tp / pos::DOUBLE)"
    _fs = f"({1 + _b * _b} * ({_pr[0]} * {_pr[1]}) / ({_b * _b} * {_pr[0]} + {_pr[1]} + 1e-10::DOUBLE))"
    add(f"best_threshold_f{_b}", lambda spark, sf, b=_b: shaped(m.best_threshold_fbeta(binary(spark, sf), float(b))),
        BIN + _CURVE + " " + sql_select(f"(SELECT score AS threshold, {_fs} AS f_score FROM c ORDER BY round(f_score, 12) DESC, threshold LIMIT 1)",
                                        "", "", "threshold; f_score"))
add("focal_loss", lambda spark, sf: shaped(m.focal_loss(binary(spark, sf))),
    BIN + ", p AS (SELECT label, greatest(least(score, 1 - 1e-7::DOUBLE), 1e-7::DOUBLE) AS s FROM b) "
    + sql_select("p", "", "", "avg(CASE WHEN label = 1 THEN 0.25::DOUBLE * pow(1 - s, 2) * -ln(s) ELSE 0.75::DOUBLE * pow(s, 2) * -ln(1 - s) END) AS focal_loss"))

# ---- effect sizes: failure rate against random


def two_methods(spark, sf):
    e = executions(spark, sf)
    return m.apfd_per_build(ranked(spark, sf)), m.apfd_per_build(r.rank_random(e, 42))


_TWO = (RANKED + ", " + o.apfd(name="pa") + f", rr AS (SELECT *, row_number() OVER (PARTITION BY project, build_id ORDER BY {_HASH} DESC, tc_key) AS rank FROM ex), "
        + o.apfd("rr", "pb"))
_WORD = ("CASE WHEN abs(delta) < 0.147::DOUBLE THEN 'negligible' WHEN abs(delta) < 0.33::DOUBLE THEN 'small' "
         "WHEN abs(delta) < 0.474::DOUBLE THEN 'medium' ELSE 'large' END AS magnitude")
add("cliffs_delta", lambda spark, sf: shaped(m.cliffs_delta(*two_methods(spark, sf))),
    _TWO + ", x AS (SELECT avg(sign(pa.apfd - pb.apfd)) AS delta, (SELECT count(*) FROM pa) AS n_a, (SELECT count(*) FROM pb) AS n_b FROM pa, pb) "
    + sql_select("x", _WORD, "n_a; n_b", "delta"))
_PAIR = _TWO + ", pr AS (SELECT pa.apfd AS a, pb.apfd AS b, pa.apfd - pb.apfd AS d FROM pa JOIN pb USING (project, build_id))"
add("paired_cliffs", lambda spark, sf: shaped(m.paired_cliffs(m.paired(*two_methods(spark, sf)))),
    _PAIR + ", x AS (SELECT count(*) AS n, avg(sign(d)) AS delta FROM pr) " + sql_select("x", _WORD, "n", "delta"))
_Z = "(abs(z))"
_T = "(1 / (1 + 0.2316419::DOUBLE * abs(z)))"
_TAIL = (f"exp(-z * z / 2) / sqrt(2 * pi()) * ({_T} * (0.319381530::DOUBLE + {_T} * (-0.356563782::DOUBLE + {_T} * (1.781477937::DOUBLE + "
         f"{_T} * (-1.821255978::DOUBLE + {_T} * 1.330274429::DOUBLE)))))")
add("wilcoxon_greater", lambda spark, sf: shaped(m.wilcoxon_greater(m.paired(*two_methods(spark, sf)))),
    _PAIR + ", d0 AS (SELECT round(d, 12) AS d FROM pr WHERE round(d, 12) <> 0), rk AS (SELECT d, rank() OVER (ORDER BY abs(d)) + (count(*) OVER "
    "(PARTITION BY abs(d)) - 1) / 2.0::DOUBLE AS r, count(*) OVER (PARTITION BY abs(d)) AS t FROM d0), "
    "x AS (SELECT count(*) AS n, sum(CASE WHEN d > 0 THEN r ELSE 0 END) AS w_plus, sum(t::DOUBLE * t - 1) AS tie FROM rk), "
    "y AS (SELECT n, w_plus, (w_plus - n * (n + 1) / 4.0::DOUBLE) / sqrt(n::DOUBLE * (n + 1) * (2 * n + 1) / 24 - tie / 48) AS z FROM x) "
    + sql_select("y", "", "n", f"w_plus; z; CASE WHEN z >= 0 THEN {_TAIL} ELSE 1 - {_TAIL} END AS p_value"))
add("common_builds", lambda spark, sf: shaped(m.paired(*two_methods(spark, sf)), "build_id", "a", "b", "d"),
    _TWO + " " + sql_select("pa JOIN pb USING (project, build_id)", "build_id", "", "pa.apfd AS a; pb.apfd AS b; pa.apfd - pb.apfd AS d"))

# ---- summaries over projects, variants, folds
add("grand_mean", lambda spark, sf: shaped(m.grand_mean(m.apfd_per_build(ranked(spark, sf, "li")))),
    _LIP + ", g AS (SELECT project, avg(apfd) AS m, count(*) AS c FROM per GROUP BY 1) "
    + sql_select("g", "", "count(*) AS n_projects; sum(c) AS n_builds", "avg(m) AS grand_mean; stddev_pop(m) AS std; median(m) AS median"))


def _variants(spark, sf):
    e = executions(spark, sf)
    h = history(e, want=["n", "failures", "rate_5", "last_fail_idx"])
    scores = {"full": r.failure_rate_score(), "recent_only": r.recent_rate_score(5), "recency_only": r.recency_score()}
    rows = h.select("project", "build_id", "tc_key", "fail", F.explode(F.array(*[
        F.struct(F.lit(k).alias("variant"), v.alias("score")) for k, v in scores.items()])).alias("v")).select(
        "project", F.concat_ws("|", "v.variant", "build_id").alias("build_id"), "tc_key", "fail", "v.variant", "v.score")
    return shaped(m.variant_deltas(m.apfd_per_build(r.rank_in_build(rows), ["variant"])))


add("variant_deltas", _variants, H.rstrip() + f", st AS (SELECT *, 'full' AS variant, {o.RATE} AS score FROM h UNION ALL SELECT *, 'recent_only', "
    f"coalesce(rate_5, 0) FROM h UNION ALL SELECT *, 'recency_only', -({o.SINCE})::DOUBLE FROM h), ranked AS (SELECT *, row_number() OVER "
    "(PARTITION BY variant, project, build_id ORDER BY score DESC, tc_key) AS rank FROM st), " + o.apfd(by="variant, project, build_id") + " "
    + sql_select("per", "variant", "count(*) AS n_builds", "avg(apfd) AS mean_apfd; stddev_samp(apfd) AS std_apfd; median(apfd) AS median_apfd; "
                 "avg(apfd) - (SELECT avg(apfd) FROM per WHERE variant = 'full') AS delta_vs_full") + " GROUP BY variant")


def _folds(spark, sf):
    rk = ranked(spark, sf, "li").select("project", "build_id", "tc_key", "fail", "rank", "build_idx")
    test = expanding_folds(rk, 5).filter("role = 'test'")
    return shaped(m.fold_summary(m.apfd_per_build(test, ["fold"])))


add("fold_summary", _folds, f"WITH {o.LI}, {o.history()}, {o.RANKED}, nb AS (SELECT project, floor((max(build_idx) + 1) / 5.0::DOUBLE)::BIGINT AS size FROM ex GROUP BY 1), "
    "ff AS (SELECT ranked.*, build_idx // size AS fold FROM ranked JOIN nb USING (project) WHERE build_idx // size BETWEEN 1 AND 4 AND (build_idx // size) * size >= 5), "
    + o.apfd("ff", by="project, build_id, fold") + ", g AS (SELECT project, fold, avg(apfd) AS m FROM per GROUP BY 1, 2) "
    + sql_select("g", "project", "count(*) AS n_folds", "avg(m) AS mean_apfd; stddev_samp(m) AS std_apfd") + " GROUP BY project")


def _test_builds(spark, sf):
    rk = ranked(spark, sf)
    held = holdout_split(rk.select("project", "build_id", "tc_key", "fail", "rank", "build_idx")).filter("split = 'test'")
    return shaped(m.apfd_summary(m.apfd_per_build(held)))


add("heuristic_on_held_out_builds", _test_builds, RANKED + ", rt AS (SELECT * FROM ranked WHERE build_idx >= (SELECT floor((max(build_idx) + 1) * "
    "0.8::DOUBLE) FROM ex)), " + o.apfd("rt") + " " + sql_select("per", "", _SUM, _SUMD))
