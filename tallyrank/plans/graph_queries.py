"""Queries on graphs and similarity, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyrank.operators import features as feat
from tallyrank.operators import graph as g
from tallyrank.operators import similarity as sim
from tallyrank.operators.chronology import build_table
from tallyrank.operators.clean import last_builds
from tallyrank.operators.history import history
from tallyrank.operators.ranking import failure_rate_score, recent_rate_score
from tallyrank.operators.textops import hash_embedding
from tallyrank.plans import oracle as o
from tallyrank.plans.fixtures import executions, raw_events, raw_lines, table
from tallyrank.plans.ranking_queries import scored
from tallyrank.plans.shape import shaped, sql_select

Q, S = {}, {}
EDGE = ("src", "dst", "shared", "weight")
SE = ("src; dst", "shared", "weight")
EV, LI = f"WITH {o.EV}", f"WITH {o.LI}"


def add(name, fn, sql=None):
    Q[name] = fn
    if sql:
        S[name] = sql


def _pairs(cond, name, weight, bucket="build_id", src="ex", key="project"):
    """Pair counts of distinct (node, bucket) rows with a weight."""
    return (f"{name}_m AS (SELECT DISTINCT {key}, tc_key AS node, {bucket} AS bucket FROM {src} WHERE {cond}), "
            f"{name}_n AS (SELECT {key}, node, count(*) AS n FROM {name}_m GROUP BY ALL), "
            f"{name}_p AS (SELECT a.{key}, a.node AS src, b.node AS dst, count(*) AS shared FROM {name}_m a JOIN {name}_m b "
            f"ON a.{key} = b.{key} AND a.bucket = b.bucket AND a.node < b.node GROUP BY ALL), "
            f"{name} AS (SELECT p.{key}, src, dst, shared, {weight} AS weight FROM {name}_p p "
            f"JOIN {name}_n x ON x.{key} = p.{key} AND x.node = src JOIN {name}_n y ON y.{key} = p.{key} AND y.node = dst)")


MIN_W = "shared / greatest(x.n, y.n)::DOUBLE"
MEAN_W = "(shared / x.n::DOUBLE + shared / y.n::DOUBLE) / 2"
CF = _pairs("fail = 1", "cf", MIN_W)
CS = _pairs("verdict = 0", "cs", MIN_W)

add("co_failure_edges", lambda spark, sf: shaped(g.co_failure_edges(executions(spark, sf)), *EDGE),
    f"{EV}, {_pairs('fail = 1', 'e', MEAN_W)} " + sql_select("e", *SE, "shared >= 2 AND weight >= 0.1::DOUBLE"))
add("co_failure_edges_by_project", lambda spark, sf: shaped(
    g.co_failure_edges(executions(spark, sf, "li"), 1, 0.01), "project", *EDGE),
    f"{LI}, {_pairs('fail = 1', 'e', MEAN_W)} " + sql_select("e", "project; " + SE[0], *SE[1:], "weight >= 0.01::DOUBLE"))
add("co_failure_min_edges", lambda spark, sf: shaped(g.co_outcome_edges(executions(spark, sf), 1), *EDGE),
    f"{EV}, {CF} " + sql_select("cf", *SE, "weight >= 0.05::DOUBLE"))
add("co_success_edges", lambda spark, sf: shaped(g.co_outcome_edges(executions(spark, sf), 0), *EDGE),
    f"{EV}, {CS} " + sql_select("cs", *SE, "weight >= 0.05::DOUBLE"))


def _part_runs(spark, sf):
    """Parts tested by orders: many nodes with few buckets each."""
    raw = raw_lines(spark, sf, "l_partkey").withColumn("verdict", F.lit(0))
    return shaped(g.co_outcome_edges(raw, 0, 2, 0.0), "project", "src", "dst", "shared")


add("co_run_edges_parts", _part_runs, "WITH m AS (SELECT DISTINCT c_mktsegment AS project, l_orderkey AS bucket, 'p' || l_partkey AS node FROM lineitem "
    "JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey) SELECT a.project, a.node AS src, b.node AS dst, count(*) AS shared FROM m a "
    "JOIN m b ON a.project = b.project AND a.bucket = b.bucket AND a.node < b.node GROUP BY ALL HAVING count(*) >= 2")
_RAWC = ("cm AS (SELECT project, tc_key, 'k' || k AS c FROM raw UNION ALL SELECT project, tc_key, 'CR_CR_' || (k % 5) FROM raw WHERE k % 3 = 0)")
_CE = f"{EV}, {_RAWC}, {_pairs('true', 'ce', 'shared / (SELECT max(shared) FROM ce_p)::DOUBLE', 'c', 'cm')}"
add("commit_edges", lambda spark, sf: shaped(g.commit_edges(raw_events(spark, sf)), *EDGE),
    _CE + " " + sql_select("ce", *SE, "weight >= 0.1::DOUBLE"))
_HY = (f"{EV}, {_pairs('fail = 1', 'e', MEAN_W)}, {_RAWC}, {_pairs('true', 'ce', 'shared / (SELECT max(shared) FROM ce_p)::DOUBLE', 'c', 'cm')}, "
       "u AS (SELECT src, dst, weight FROM e WHERE shared >= 2 AND weight >= 0.1::DOUBLE UNION ALL SELECT src, dst, weight FROM ce "
       "WHERE weight >= 0.1::DOUBLE), hy AS (SELECT src, dst, sum(weight) / 2 AS weight FROM u GROUP BY ALL) ")
add("hybrid_edges", lambda spark, sf: shaped(g.hybrid_edges(g.layered_edges({
    "co_failure": g.co_failure_layer(executions(spark, sf)), "commits": g.commit_layer(raw_events(spark, sf))})), "src", "dst", "weight"),
    _HY + sql_select("hy", "src; dst", "", "weight"))
_CP = _pairs("true", "cp", "shared / (x.n + y.n - shared)::DOUBLE", "'c' || (k % 7)", "raw")
add("component_edges", lambda spark, sf: shaped(g.component_edges(raw_events(spark, sf)), *EDGE),
    f"{EV}, {_CP} " + sql_select("cp", *SE, "weight >= 0.05::DOUBLE"))
_TE = ("tn AS (SELECT project, build_id, tc_key, lead(tc_key) OVER (PARTITION BY project, build_id ORDER BY exec_ts, tc_key) AS nx FROM ex), "
       "te0 AS (SELECT project, least(tc_key, nx) AS src, greatest(tc_key, nx) AS dst, count(*) AS shared FROM tn WHERE nx IS NOT NULL AND nx <> tc_key "
       "GROUP BY ALL), te AS (SELECT *, shared / (max(shared) OVER (PARTITION BY project))::DOUBLE AS weight FROM te0)")
add("temporal_edges", lambda spark, sf: shaped(g.temporal_edges(executions(spark, sf)), *EDGE),
    f"{EV}, {_TE} " + sql_select("te", *SE))

# fixed values: weights of the edge types
WEIGHTS = {"co_failure": 1.0, "co_success": 0.5, "temporal": 0.3}


def multi(spark, sf):
    e = executions(spark, sf)
    return g.layered_edges({"co_failure": g.co_outcome_layer(e, 1), "co_success": g.co_outcome_layer(e, 0)}, {"temporal": g.temporal_counts(e)})


_MULTI = (f"{EV}, {CF}, {CS}, {_TE}, mu AS (SELECT src, dst, 'co_failure' AS t, weight FROM cf WHERE weight >= 0.05::DOUBLE UNION ALL "
          "SELECT src, dst, 'co_success', weight FROM cs WHERE weight >= 0.05::DOUBLE UNION ALL SELECT src, dst, 'temporal', weight FROM te), "
          "wt AS (SELECT * FROM (VALUES ('co_failure', 1.0::DOUBLE), ('co_success', 0.5::DOUBLE), ('temporal', 0.3::DOUBLE)) v(t, w)), "
          "mg AS (SELECT src, dst, sum(weight * w) / 1.8::DOUBLE AS weight FROM mu JOIN wt USING (t) GROUP BY ALL HAVING sum(weight * w) / 1.8::DOUBLE >= 0.05::DOUBLE)")
add("combine_edges", lambda spark, sf: shaped(g.combine_edges(multi(spark, sf), WEIGHTS), "src", "dst", "weight"),
    _MULTI + " " + sql_select("mg", "src; dst", "", "weight"))
SUBSETS = {"all": ["co_failure", "co_success", "temporal"], "no_co_success": ["co_failure", "temporal"], "co_failure_only": ["co_failure"]}


def _variant_sql(name, types):
    total = sum(WEIGHTS[t] for t in types)
    names = ", ".join(f"'{t}'" for t in types)
    return (f"SELECT '{name}' AS variant, src, dst, sum(weight * w) / {total!r}::DOUBLE AS weight FROM mu JOIN wt USING (t) WHERE t IN ({names}) "
            f"GROUP BY src, dst HAVING sum(weight * w) / {total!r}::DOUBLE >= 0.05::DOUBLE")


add("edge_ablation", lambda spark, sf: shaped(g.edge_ablation(multi(spark, sf), WEIGHTS, SUBSETS), "variant", "src", "dst", "weight"),
    _MULTI + ", ab AS (" + " UNION ALL ".join(_variant_sql(k, v) for k, v in SUBSETS.items()) + ") " + sql_select("ab", "variant; src; dst", "", "weight"))


def _sub(spark, sf):
    e = executions(spark, sf)
    late = last_builds(e, 20)
    return shaped(g.subgraph(g.combine_edges(multi(spark, sf), WEIGHTS), late), "src", "dst", "weight")


add("subgraph", _sub, _MULTI + ", nd AS (SELECT DISTINCT tc_key FROM ex WHERE build_idx > (SELECT max(build_idx) - 20 FROM ex)), kp AS (SELECT * FROM mg WHERE src IN (SELECT tc_key FROM nd) "
    "AND dst IN (SELECT tc_key FROM nd)), sg AS (SELECT src, dst, weight FROM kp UNION ALL SELECT dst, src, weight FROM kp UNION ALL "
    "SELECT tc_key, tc_key, 1 FROM nd WHERE (SELECT count(*) FROM kp) = 0) " + sql_select("sg", "src; dst", "", "weight"))
add("graph_stats", lambda spark, sf: shaped(g.graph_stats(g.combine_edges(multi(spark, sf), WEIGHTS), executions(spark, sf)).drop("project")),
    _MULTI + ", st AS (SELECT (SELECT count(DISTINCT tc_key) FROM ex) AS n, (SELECT count(*) FROM (SELECT src FROM mg UNION SELECT dst FROM mg)) AS c, "
    "count(*) AS m, min(weight) AS lo, avg(weight) AS av, max(weight) AS hi FROM mg) " + sql_select(
        "st", "", "n AS n_nodes; m AS n_edges; c AS n_connected", "lo AS min_weight; av AS avg_weight; hi AS max_weight; "
        "m / (n * (n - 1) / 2.0::DOUBLE) AS density; 2.0::DOUBLE * m / n AS avg_degree; 2.0::DOUBLE * m / c AS avg_degree_connected"))
add("edge_type_counts", lambda spark, sf: shaped(g.edge_type_counts(multi(spark, sf)).drop("project")),
    _MULTI + " SELECT t AS edge_type, count(*) AS n_edges FROM mu GROUP BY 1")


def _spread(spark, sf):
    e = executions(spark, sf)
    edges = g.subgraph(g.co_outcome_edges(e, 1), e)
    feats = e.groupBy("project", "tc_key").agg(F.avg("fail").alias("rate"), F.avg("duration").alias("mean_duration"))
    return shaped(g.propagate(feats, edges, ["rate", "mean_duration"]), "tc_key", "rate", "mean_duration")


add("propagate_features", _spread, f"{EV}, {CF}, f AS (SELECT tc_key, avg(fail) AS rate, avg(duration) AS md FROM ex GROUP BY 1), "
    "b AS (SELECT src, dst, weight FROM cf WHERE weight >= 0.05::DOUBLE UNION ALL SELECT dst, src, weight FROM cf WHERE weight >= 0.05::DOUBLE), "
    "r AS (SELECT b.src AS tc_key, sum(weight * rate) / (sum(weight) + 1e-6::DOUBLE) AS rate, sum(weight * md) / (sum(weight) + 1e-6::DOUBLE) AS md "
    "FROM b JOIN f ON f.tc_key = b.dst GROUP BY 1) " + sql_select("r", "tc_key", "", "rate; md AS mean_duration"))


def hash32(*parts):
    return "('0x' || substr(md5(" + " || '|' || ".join(parts) + "), 1, 15))::BIGINT"


_NODES = "nn AS (SELECT tc_key, row_number() OVER (ORDER BY tc_key) AS no, count(*) OVER () AS sz FROM (SELECT DISTINCT tc_key FROM ex))"


def _draws(n):
    return (f"{_NODES}, dw AS (SELECT i, {hash32('i', chr(39) + 'a' + chr(39), chr(39) + '42' + chr(39))} % sz + 1 AS a, "
            f"{hash32('i', chr(39) + 'b' + chr(39), chr(39) + '42' + chr(39))} % sz + 1 AS b FROM range({n}) t(i), (SELECT max(sz) AS sz FROM nn)), "
            "dp AS (SELECT i, least(x.tc_key, y.tc_key) AS src, greatest(x.tc_key, y.tc_key) AS dst FROM dw JOIN nn x ON x.no = a "
            "JOIN nn y ON y.no = b WHERE a <> b)")


add("add_random_edges", lambda spark, sf: shaped(g.add_random_edges(
    g.co_outcome_edges(executions(spark, sf), 1), executions(spark, sf), 50), "src", "dst", "weight"),
    f"{EV}, {CF}, {_draws(50)}, rn AS (SELECT DISTINCT src, dst, 1 AS weight FROM dp UNION ALL SELECT src, dst, weight FROM cf WHERE "
    "weight >= 0.05::DOUBLE AND (src, dst) NOT IN (SELECT (src, dst) FROM dp)) " + sql_select("rn", "src; dst", "", "weight"))


def _perturbed(spark, sf):
    d = feat.features_deeporder8(executions(spark, sf))
    return shaped(g.perturb_features(d, ["failure_rate", "mean_duration"], ["build_id", "tc_key"]), "build_id", "tc_key", "failure_rate", "mean_duration")


def _pert(expr, name):
    u = hash32("build_id", "tc_key", f"'{name}'", "'42'") + " / 1152921504606846976.0::DOUBLE"
    return f"{expr} + 0.1::DOUBLE * abs({expr}) * ({u} * 2 - 1) AS {name}"


_TOP = "(greatest(max_duration, 0) + 1e-6::DOUBLE)"
add("perturb_features", _perturbed, o.ev_history() + sql_select(
    "h", "build_id; tc_key", "", _pert(o.RATE, "failure_rate") + "; " + _pert(f"coalesce(duration_sum / n / {_TOP}, 0)", "mean_duration")))
add("orphans", lambda spark, sf: shaped(g.orphans(scored(spark, sf), g.co_failure_edges(executions(spark, sf), 4, 0.1)),
                                        "build_id", "tc_key", "score", "node_index"),
    f"{EV}, {o.history()}, {o.SCORED}, {_pairs('fail = 1', 'e', MEAN_W)}, nd AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS node_index FROM (SELECT src AS v "
    "FROM e WHERE shared >= 4 AND weight >= 0.1::DOUBLE UNION SELECT dst FROM e WHERE shared >= 4 AND weight >= 0.1::DOUBLE)) " + sql_select(
        "scored LEFT JOIN nd ON v = tc_key", "build_id; tc_key", "coalesce(node_index, -1) AS node_index",
        "CASE WHEN node_index IS NULL THEN 0.5::DOUBLE ELSE score END AS score"))


def clocked(spark, sf):
    raw = raw_events(spark, sf)
    return raw.join(build_table(raw), ["project", "build_id"])


_CDAG = (f"{EV}, ck AS (SELECT DISTINCT project, build_id, build_idx FROM ex), rc AS (SELECT raw.*, ck.build_idx FROM raw JOIN ck USING (project, build_id)), "
         "fq AS (SELECT 'k' || k AS c, count(*) AS freq FROM raw GROUP BY 1 ORDER BY freq DESC, c), "
         "cb AS (SELECT DISTINCT build_idx, 'k' || k AS c FROM rc WHERE 'k' || k IN (SELECT c FROM fq)), fs AS (SELECT c, min(build_idx) AS f FROM cb GROUP BY 1), "
         "cd AS (SELECT cb.c AS src, fs.c AS dst, cb.build_idx, 'temporal' AS kind, 1 / (1 + f - build_idx)::DOUBLE AS weight FROM fs JOIN cb ON build_idx "
         "BETWEEN f - 5 AND f - 1 UNION ALL SELECT a.c, b.c, a.build_idx, 'sibling', 0.8::DOUBLE FROM cb a JOIN cb b ON a.build_idx = b.build_idx AND a.c <> b.c), "
         "cdw AS (SELECT * FROM cd WHERE kind = 'sibling' OR weight >= 0.2::DOUBLE)")
add("commit_dag", lambda spark, sf: shaped(g.commit_dag(clocked(spark, sf), None, 5, 0.2), "src", "dst", "build_idx", "kind", "weight"),
    _CDAG + " " + sql_select("cdw", "src; dst; kind", "build_idx", "weight"))
add("commit_path_lengths", lambda spark, sf: shaped(g.commit_path_lengths(g.commit_dag(clocked(spark, sf), None, 5, 0.2)),
                                                    "src", "dst", "build_idx", "kind", "path_length", "merge"),
    _CDAG + " " + sql_select("cdw", "src; dst; kind", "build_idx; (weight <= 0.7::DOUBLE)::INT AS merge", "1 / (weight + 1e-6::DOUBLE) AS path_length"))


def _t2c(spark, sf):
    raw = raw_events(spark, sf)
    m = g.test_to_commits(raw, g.frequent_commits(raw))
    return shaped(m.select("tc_key", F.array_join("commits", ",").alias("commits"), F.size("commits").alias("n")))


add("test_to_commits", _t2c, f"{EV}, fq AS (SELECT 'k' || k AS c, count(*) AS freq FROM raw GROUP BY 1 ORDER BY freq DESC, c) "
    "SELECT tc_key, string_agg(DISTINCT 'k' || k, ',' ORDER BY 'k' || k) AS commits, count(DISTINCT k) AS n FROM raw WHERE 'k' || k IN (SELECT c FROM fq) GROUP BY 1")

# ---- vectors
VEC = ("WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, label / 10.0::DOUBLE AS score, label FROM embeddings)")


def _cos(a="a.e", b="b.e"):
    return f"list_cosine_similarity({a}, {b})"


def _knn_sql(score, k, where="a.vec_id <> b.vec_id", left="v", right="v"):
    return (f", nn AS (SELECT * FROM (SELECT a.vec_id AS query, b.vec_id AS neighbor, {score} AS similarity, row_number() OVER (PARTITION BY a.vec_id "
            f"ORDER BY {score} DESC, b.vec_id) AS rank FROM {left} a, {right} b WHERE {where}) WHERE rank <= {k})")


def emb(spark, sf):
    return table(spark, sf, "embeddings")


add("knn_cosine", lambda spark, sf: shaped(sim.knn(emb(spark, sf), emb(spark, sf), 10, skip_self=True)),
    VEC + _knn_sql(_cos(), 10) + " " + sql_select("nn", "", "query; neighbor; rank", "similarity"))
add("knn_graph", lambda spark, sf: shaped(sim.knn_graph(emb(spark, sf), 10)),
    VEC + _knn_sql("-list_distance(a.e, b.e)", 10) + " " + sql_select("nn", "", "query AS src; neighbor AS dst", "1 / (1 - similarity) AS weight"))
# vectors drawn towards a direction of their label: some neighbours are near, some are not
PULL = 1.5


def grouped(spark, sf):
    own = F.transform("embedding", lambda x, i: x.cast("double") + F.when(i == F.col("label"), PULL * (F.col("vec_id") % 3)).otherwise(0.0))
    return emb(spark, sf).withColumn("embedding", own)


GROUPED = (f"WITH v AS (SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x, i: x + CASE WHEN i - 1 = label THEN {PULL}::DOUBLE * (vec_id % 3) ELSE 0 END) AS e, "
           "label / 10.0::DOUBLE AS score, label FROM embeddings)")
add("semantic_edges", lambda spark, sf: shaped(sim.semantic_edges(grouped(spark, sf), 10, 0.7)),
    GROUPED + _knn_sql(_cos(), 10) + ", se AS (SELECT least(query, neighbor) AS src, greatest(query, neighbor) AS dst, max(similarity) AS weight FROM nn "
    "WHERE similarity >= 0.7::DOUBLE GROUP BY ALL) " + sql_select("se", "", "src; dst", "weight"))
add("knn_adjacency", lambda spark, sf: shaped(sim.knn_adjacency(grouped(spark, sf))),
    GROUPED + _knn_sql(_cos(), 5) + " SELECT query AS src, neighbor AS dst FROM nn WHERE similarity >= 0.5::DOUBLE UNION SELECT neighbor, query FROM nn "
    "WHERE similarity >= 0.5::DOUBLE")
WIDTH = 64
F64 = [f"f{i}" for i in range(WIDTH)]


def structured(spark, sf):
    """Vectors with every position as a feature."""
    return grouped(spark, sf).select("vec_id", "embedding", "label", (F.col("label") / 10.0).alias("score"),
                                     *[F.col("embedding")[i].cast("double").alias(f"f{i}") for i in range(WIDTH)])


# of each class some stand outside the graph; one class has no like inside
OUTSIDE, INSIDE = "label = 0 or vec_id % 7 = 0", "not (label = 0 or vec_id % 7 = 0)"
_F64 = ", ".join(f"e[{i + 1}] AS f{i}" for i in range(WIDTH))
_STR = GROUPED + f", s AS (SELECT *, {_F64} FROM v), oq AS (SELECT * FROM s WHERE label = 0 OR vec_id % 7 = 0), ib AS (SELECT * FROM s WHERE NOT (label = 0 OR vec_id % 7 = 0))"


def _impute(spark, sf):
    s = structured(spark, sf)
    return shaped(sim.knn_impute(s.filter(OUTSIDE), s.filter(INSIDE), F64))


add("knn_impute", _impute, _STR + _knn_sql(_cos(), 10, "true", "oq", "ib") + ", im AS (SELECT query, count(*) AS nb, " + ", ".join(
    f"sum(similarity * f{i}) / sum(similarity) AS g{i}" for i in range(WIDTH)) + " FROM nn JOIN ib ON vec_id = neighbor WHERE similarity >= 0.5::DOUBLE GROUP BY 1), "
    "dm AS (SELECT " + ", ".join(f"avg(f{i}) AS d{i}" for i in range(WIDTH)) + " FROM ib) " + sql_select(
        "oq LEFT JOIN im ON query = vec_id, dm", "", "vec_id; coalesce(nb, 0) AS neighbors", "; ".join(f"coalesce(g{i}, d{i}) AS f{i}" for i in range(WIDTH))))


def _clip(spark, sf):
    v = feat.features_v2_temporal(executions(spark, sf))
    shifted = v.withColumns({c: F.col(c) * 1.5 - 0.25 for c in feat.V2_NAMES})
    return shaped(sim.clip_features(shifted, "v2"), "build_id", "tc_key", "failure_rate", "commit_count", "failure_trend", "stability_score", "pass_fail_ratio")


add("clip_features", _clip, o.ev_history(True).rstrip() + ", c AS (SELECT *, coalesce(exact_failures / nullif(exact_failures + exact_passes, 0)::DOUBLE, 0) AS fr, "
    "CASE WHEN n > 1 THEN raw_flips_10 / least(n, 10)::DOUBLE ELSE 0 END AS fl FROM h) " + sql_select(
        "c", "build_id; tc_key", "", "greatest(least(fr * 1.5::DOUBLE - 0.25::DOUBLE, 1), 0) AS failure_rate; "
        "greatest(greatest(n_commits + n_crs, 1) * 1.5::DOUBLE - 0.25::DOUBLE, 1) AS commit_count; "
        "greatest(coalesce(rate_5 - rate_10, 0) * 1.5::DOUBLE - 0.25::DOUBLE, 0) AS failure_trend; "
        "greatest(least(CASE WHEN n > 0 THEN 1 - fl ELSE 0.5::DOUBLE END * 1.5::DOUBLE - 0.25::DOUBLE, 1), 0) AS stability_score; "
        "greatest(CASE WHEN n > 0 THEN exact_passes / (exact_failures + 1)::DOUBLE ELSE 1 END * 1.5::DOUBLE - 0.25::DOUBLE, 0) AS pass_fail_ratio"))


def _orphan_scores(spark, sf):
    s = structured(spark, sf)
    return shaped(sim.score_orphans(s.filter(OUTSIDE).withColumn("base_score", F.lit(0.5)), s.filter(INSIDE), structural=F64))


def _z(src):
    return f"SELECT vec_id, e, score, [{', '.join(f'(f{i} - avg(f{i}) OVER ()) / (stddev_pop(f{i}) OVER () + 1e-8::DOUBLE)' for i in range(WIDTH))}] AS z FROM {src}"


add("score_orphans", _orphan_scores, _STR + f", zo AS ({_z('oq')}), zi AS ({_z('ib')})" + _knn_sql(
    f"0.65::DOUBLE * exp(-list_distance(a.e, b.e)) + 0.35::DOUBLE * {_cos('a.z', 'b.z')}", 20, "true", "zo", "zi")
    + ", w AS (SELECT query, count(*) AS nb, sum(exp(similarity / 0.7::DOUBLE) * score) / sum(exp(similarity / 0.7::DOUBLE)) AS ks FROM nn JOIN ib ON vec_id = neighbor "
      "WHERE similarity >= 0.05::DOUBLE GROUP BY 1) " + sql_select("oq LEFT JOIN w ON query = vec_id", "", "vec_id; coalesce(nb, 0) AS neighbors",
                                                              "coalesce(0.55::DOUBLE * ks + 0.45::DOUBLE * 0.5::DOUBLE, 0.5::DOUBLE) AS score"))
add("zscore", lambda spark, sf: shaped(sim.zscore(structured(spark, sf), F64), "vec_id", *F64),
    _STR + " " + sql_select("s", "", "vec_id", "; ".join(f"(f{i} - avg(f{i}) OVER ()) / (stddev_pop(f{i}) OVER () + 1e-8::DOUBLE) AS f{i}" for i in range(WIDTH))))


def _minmax(spark, sf):
    s = structured(spark, sf)
    return shaped(sim.minmax_transform(s, sim.minmax_fit(s.filter(INSIDE), F64), F64), "vec_id", *F64)


add("minmax_fit_transform", _minmax, _STR + ", mm AS (SELECT " + ", ".join(f"min(f{i}) AS l{i}, max(f{i}) AS u{i}" for i in range(WIDTH)) + " FROM ib) "
    + sql_select("s, mm", "", "vec_id", "; ".join(f"(f{i} - l{i}) / (u{i} - l{i}) AS f{i}" for i in range(WIDTH))))
add("minmax", lambda spark, sf: shaped(sim.minmax(structured(spark, sf), F64), "vec_id", *F64),
    _STR + " " + sql_select("s", "", "vec_id", "; ".join(f"(f{i} - min(f{i}) OVER ()) / (max(f{i}) OVER () - min(f{i}) OVER ()) AS f{i}" for i in range(WIDTH))))
ALPHAS = (0.0, 0.3, 0.5, 0.7, 1.0)


def two_scores(spark, sf):
    h = history(executions(spark, sf), want=["n", "failures", "rate_5"])
    return h.withColumns({"score_a": failure_rate_score(), "score_b": recent_rate_score(5)})


add("blend_scores", lambda spark, sf: shaped(two_scores(spark, sf).withColumn("score", sim.blend(F.col("score_a"), F.col("score_b"), 0.7)),
                                             "build_id", "tc_key", "score"),
    o.ev_history() + sql_select("h", "build_id; tc_key", "", f"0.7::DOUBLE * {o.RATE} + (1.0::DOUBLE - 0.7::DOUBLE) * coalesce(rate_5, 0) AS score"))
add("sweep_alpha", lambda spark, sf: shaped(sim.sweep_alpha(two_scores(spark, sf), ALPHAS), "n_builds", "alpha", "mean_apfd"),
    o.ev_history().rstrip() + ", al AS (SELECT unnest([" + ", ".join(f"{a}::DOUBLE" for a in ALPHAS) + "]) AS alpha), "
    f"rk AS (SELECT alpha, project, build_id, tc_key, fail, row_number() OVER (PARTITION BY alpha, project, build_id ORDER BY alpha * {o.RATE} + (1 - alpha) * "
    "coalesce(rate_5, 0) DESC, tc_key) AS rank FROM h, al), " + o.apfd("rk", by="alpha, project, build_id") + ", ma AS (SELECT alpha, avg(apfd) AS mean_apfd, count(*) AS n_builds "
    "FROM per GROUP BY 1 ORDER BY round(avg(apfd), 12) DESC, alpha LIMIT 1) " + sql_select("ma", "", "n_builds", "alpha; mean_apfd"))


def _hybrid_rows(spark, sf):
    e = executions(spark, sf)
    h = history(e, want=["n", "failures", "rate_5", *[f"verdict_{k}" for k in range(1, 11)]])
    rows = h.select("build_id", "tc_key", failure_rate_score().alias("p_fail"), F.when(F.col("n") == 0, 0.5).otherwise(
        F.col("rate_5")).alias("priority_pred"), feat.priority_expr().alias("history"))
    return rows


def _hybrid(spark, sf):
    return shaped(sim.hybrid_score(_hybrid_rows(spark, sf)), "build_id", "tc_key", "hybrid_score", "in_graph")


def text_vectors(spark, sf):
    """Test u7 is told by document 7."""
    d = table(spark, sf, "documents")
    return d.select(F.concat(F.lit("u"), "doc_id").alias("tc_key"), hash_embedding(F.col("text"), 16).alias("embedding"))


def _hybrid_whole(spark, sf):
    done = sim.hybrid_with_orphans(_hybrid_rows(spark, sf), text_vectors(spark, sf))
    return shaped(done, "build_id", "tc_key", "hybrid_score", "in_graph", "neighbors")


def _hybrid_sql():
    from tallyrank.plans.history_queries import _prio
    return (o.ev_history().rstrip() + f", r AS (SELECT build_id, tc_key, {o.RATE} AS p, CASE WHEN n = 0 THEN 0.5::DOUBLE ELSE rate_5 END AS pr, "
            f"{_prio('exponential')} AS hs FROM h), st AS (SELECT min(pr) FILTER (abs(pr - 0.5::DOUBLE) >= 0.001::DOUBLE) AS lo, max(pr) FILTER (abs(pr - 0.5::DOUBLE) >= 0.001::DOUBLE) AS hi, "
            "max(hs) AS hm FROM r), m AS (SELECT *, CASE WHEN abs(pr - 0.5::DOUBLE) >= 0.001::DOUBLE THEN 0.5::DOUBLE * p + 0.5::DOUBLE * (pr - lo) / (hi - lo) ELSE p END AS mx FROM r, st) "
            + sql_select("m", "build_id; tc_key", "(abs(pr - 0.5::DOUBLE) >= 0.001::DOUBLE)::INT AS in_graph",
                         "CASE WHEN hs > 0 THEN 0.55::DOUBLE * mx + 0.45::DOUBLE * hs / hm ELSE mx END AS hybrid_score"))


add("hybrid_score", _hybrid, _hybrid_sql())


def _hybrid_whole_sql():
    inner = _hybrid_sql()
    at = inner.rindex(" SELECT build_id")
    return (inner[:at] + ", hy AS (SELECT build_id, tc_key, (abs(pr - 0.5::DOUBLE) >= 0.001::DOUBLE)::INT AS ing, CASE WHEN hs > 0 THEN 0.55::DOUBLE * mx + 0.45::DOUBLE * hs / hm "
            "ELSE mx END AS s FROM m), hv AS (SELECT 'u' || doc_id AS tc_key, list_transform(range(0, 16), lambda i: ('0x' || substr(md5(key || '|' || i || '|42'), 1, 8))::BIGINT "
            "/ 2147483648.0::DOUBLE - 1) AS v FROM (SELECT doc_id, md5(text) AS key FROM documents)), "
            "ev AS (SELECT tc_key, list_transform(v, lambda z: z / sqrt(list_sum(list_transform(v, lambda y: y * y)))) AS e FROM hv), "
            "ins AS (SELECT tc_key, avg(s) AS score, any_value(e) AS e FROM hy JOIN ev USING (tc_key) WHERE ing = 1 GROUP BY 1), "
            "outs AS (SELECT tc_key, avg(s) AS base, any_value(e) AS e FROM hy JOIN ev USING (tc_key) WHERE ing = 0 GROUP BY 1), "
            "nn AS (SELECT * FROM (SELECT a.tc_key, a.base, b.score, exp(-list_distance(a.e, b.e)) AS similarity, row_number() OVER (PARTITION BY a.tc_key ORDER BY "
            "list_distance(a.e, b.e), b.tc_key) AS rank FROM outs a, ins b) WHERE rank <= 20), "
            "ks AS (SELECT tc_key, any_value(base) AS base, count(*) AS nb, sum(exp(similarity / 0.7::DOUBLE) * score) / sum(exp(similarity / 0.7::DOUBLE)) AS k FROM nn WHERE similarity >= 0.05::DOUBLE "
            "GROUP BY 1), fin AS (SELECT hy.build_id, hy.tc_key, ing, s, outs.base AS ob, nb, 0.55::DOUBLE * k + 0.45::DOUBLE * ks.base AS os FROM hy LEFT JOIN outs USING (tc_key) LEFT JOIN ks USING (tc_key)) "
            + sql_select("fin", "build_id; tc_key", "ing AS in_graph; CASE WHEN ing = 0 AND ob IS NOT NULL THEN coalesce(nb, 0) ELSE 0 END AS neighbors",
                         "CASE WHEN ing = 0 AND ob IS NOT NULL THEN coalesce(os, ob) ELSE s END AS hybrid_score"))


add("hybrid_with_orphans", _hybrid_whole, _hybrid_whole_sql())


def _defaults(spark, sf):
    v = feat.features_v2_temporal(executions(spark, sf))
    return shaped(sim.conservative_defaults(v, _SIX))


_SIX = ["test_age", "failure_rate", "recent_failure_rate", "flakiness_rate", "commit_count", "test_novelty"]
add("conservative_defaults", _defaults, o.ev_history(True).rstrip() + ", c AS (SELECT CASE WHEN n > 0 THEN coalesce(exact_failures / nullif(exact_failures + exact_passes, 0)::DOUBLE, 0) ELSE 0 END AS fr, "
    "CASE WHEN n > 0 THEN coalesce(rate_5, 0) ELSE 0 END AS rf, CASE WHEN n > 1 THEN raw_flips_10 / least(n, 10)::DOUBLE ELSE 0 END AS fl, greatest(n_commits + n_crs, 1) AS cc FROM h) "
    + sql_select("c", "", "", "0 AS test_age; avg(fr) AS failure_rate; avg(rf) AS recent_failure_rate; median(fl) AS flakiness_rate; avg(cc) AS commit_count; 1 AS test_novelty"))
