"""Queries on cleaning, splitting, sampling, set operations, sources, sinks, streams and
learned scorers, with SQL twins where SQL can say it."""

from __future__ import annotations

import uuid
from urllib.parse import unquote

from pyspark.sql import functions as F

from tallyrank.functions.verdict import is_failure
from tallyrank.operators import chronology as ch
from tallyrank.operators import clean as c
from tallyrank.operators import features as feat
from tallyrank.operators import graph as g
from tallyrank.operators import learn as l
from tallyrank.operators import metrics as m
from tallyrank.operators import sampling as s
from tallyrank.operators import similarity as sim
from tallyrank.operators.history import history, snapshot
from tallyrank.operators.ranking import rank_in_build
from tallyrank.operators.textops import hash_embedding
from tallyrank.plans import oracle as o
from tallyrank.plans.fit_sql import logistic_sql, ridge_sql
from tallyrank.plans.fixtures import executions, raw_events, raw_lines, table
from tallyrank.plans.graph_queries import CF, MEAN_W, VEC, _draws, _pairs, emb, hash32, structured
from tallyrank.plans.ranking_queries import BIN, PER, RANKED, STRATEGY_NAMES, STRATEGY_SQL, _TWO, binary, ranked, strategies, two_methods
from tallyrank.plans.shape import shaped, sql_select
from tallyrank.plans.tree_sql import boosted_sql, forest_sql
from tallyrank.session import checkpoint_dir, materialize
from tallyrank.sources import readers as rd
from tallyrank.sources import writers as wr
from tallyrank.streaming.history_stream import grade_waiting, stream_history, stream_rank

Q, S = {}, {}
EV, LI = f"WITH {o.EV}", f"WITH {o.LI}"
KEY = ("build_id", "tc_key")


def add(name, fn, sql=None):
    Q[name] = fn
    if sql:
        S[name] = sql


def folder(spark, name):
    """A fresh folder in the shared space of the cluster."""
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


# ---- cleaning and labels
def _with_text(spark, sf):
    """Documents as executions with gaps: no verdict without a label, no summary in French."""
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    return d.select("doc_id", F.when(F.col("lang") != "fr", F.concat(F.lit("\t "), "source", F.lit(" \r\n"))).alias("summary"), F.when(
        F.col("toxic") == 0, F.col("text")).alias("steps"), F.when(F.col("quality") == 1, "\tPass\n").when(F.col("quality") == 0, "Fail").alias("result"))


_TXT = ("WITH d AS (SELECT doc_id, CASE WHEN lang <> 'fr' THEN chr(9) || ' ' || source || ' ' || chr(13) || chr(10) END AS summary, CASE WHEN toxic = 0 THEN text END AS steps, "
        "CASE quality WHEN 1 THEN 'Pass' WHEN 0 THEN 'Fail' END AS result FROM documents LEFT JOIN labels USING (doc_id))")
_TS = "doc_id, regexp_replace(coalesce(summary, ''), '^\\s+|\\s+$', '', 'g') AS summary, md5(regexp_replace(coalesce(steps, ''), '^\\s+|\\s+$', '', 'g')) AS steps, coalesce(result, '') AS result"
add("clean_strict", lambda spark, sf: c.clean_strict(_with_text(spark, sf)).withColumn("steps", F.md5("steps")),
    _TXT + f" SELECT {_TS} FROM d WHERE summary IS NOT NULL AND result IS NOT NULL AND (steps IS NOT NULL OR (SELECT avg((regexp_replace(coalesce(steps, ''), '\\s+', '', 'g') <> '')::INT) FROM d) <= 0.1::DOUBLE)")
add("clean_lenient", lambda spark, sf: c.clean_lenient(_with_text(spark, sf)).withColumn("steps", F.md5("steps")),
    _TXT + f" SELECT {_TS}, '' AS commit FROM d")


def padded(spark, sf):
    """Verdicts as files hold them, with tabs and line breaks around."""
    return raw_events(spark, sf).withColumn("result", F.concat(F.lit("\t"), "result", F.when(F.col("exec_id") % 2 == 0, " \n").otherwise("")))


def _rules(spark, sf):
    e = padded(spark, sf)
    bad, err = F.col("result").contains("Blocked").cast("int"), F.col("result").contains("Fail").cast("int")
    return shaped(e.select("exec_id", is_failure("fail_only", F.col("result")).alias("fail_only"), is_failure("not_pass", F.col("result")).alias("not_pass"),
                           is_failure("counts", failures=bad, errors=err).alias("counts")))


add("failure_rules", _rules, f"{EV} " + sql_select("raw", "", "exec_id; (result = 'Fail')::INT AS fail_only; (result <> 'Pass')::INT AS not_pass; (result <> 'Pass')::INT AS counts"))
for _k, _cond, _lab in (("pass_vs_all", "true", "Pass"), ("pass_vs_fail", "result IN ('Pass', 'Fail')", "Pass"), ("fail_vs_all", "true", "Fail")):
    add(f"encode_{_k}", lambda spark, sf, k=_k: shaped(c.encode_binary(padded(spark, sf), k), "exec_id", "label"),
        f"{EV} " + sql_select("raw", "", f"exec_id; (result = '{_lab}')::INT AS label", where=_cond))
add("encode_multiclass", lambda spark, sf: shaped(c.encode_multiclass(raw_events(spark, sf)), "exec_id", "label"),
    f"{EV} " + sql_select("raw", "", "exec_id; dense_rank() OVER (ORDER BY result) - 1 AS label"))
add("class_weights", lambda spark, sf: shaped(c.class_weights(c.encode_binary(raw_events(spark, sf)))),
    f"{EV} " + sql_select("raw", "", "(result = 'Pass')::INT AS label; count(*) AS n", "(SELECT count(*) FROM raw) / (2 * count(*))::DOUBLE AS weight") + " GROUP BY (result = 'Pass')::INT")
add("collapse_executions", lambda spark, sf: shaped(c.collapse_executions(raw_lines(spark, sf)), "project", *KEY, "result", "duration", "fail", "n_rows"),
    f"{LI} " + sql_select("ex", "project; build_id; tc_key; result", "fail; n_rows", "duration"))
add("builds_with_failures", lambda spark, sf: shaped(c.builds_with_failures(executions(spark, sf)), *KEY, "fail"),
    f"{EV} " + sql_select("ex", "build_id; tc_key", "fail", where="build_id IN (SELECT build_id FROM ex WHERE fail = 1)"))


def _projects(spark, sf):
    e = executions(spark, sf, "li")
    mean = e.agg(F.avg("fail") * F.count(F.lit(1)) / F.count_distinct("project")).first()[0]
    return shaped(c.filter_projects(e, 10, mean).groupBy("project").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("fail").alias("n_failures")))


add("filter_projects", _projects, f"{LI}, p AS (SELECT project, count(*) AS n_rows, sum(fail) AS n_failures, count(DISTINCT build_id) AS b FROM ex GROUP BY 1) "
    + sql_select("p", "project", "n_rows; n_failures", where="b >= 10 AND n_failures >= (SELECT avg(n_failures) FROM p)"))
add("last_builds", lambda spark, sf: shaped(c.last_builds(executions(spark, sf, "li"), 50), "project", *KEY, "build_idx"),
    f"{LI} " + sql_select("ex", "project; build_id; tc_key", "build_idx", where="build_idx > (SELECT max(y.build_idx) FROM ex y WHERE y.project = ex.project) - 50"))
add("last_rows", lambda spark, sf: shaped(c.last_rows(raw_events(spark, sf), 500, [F.desc("exec_ts"), F.desc("exec_id")]), "exec_id", "tc_key"),
    f"{EV} " + sql_select("(SELECT * FROM raw ORDER BY exec_ts DESC, exec_id DESC LIMIT 500)", "tc_key", "exec_id"))
add("cap_rows", lambda spark, sf: shaped(c.cap_rows(raw_events(spark, sf), 500, ["exec_id"], 7), "exec_id", "tc_key"),
    f"{EV} " + sql_select(f"(SELECT * FROM raw ORDER BY {hash32('exec_id', chr(39) + '7' + chr(39))}, exec_id LIMIT 500)", "tc_key", "exec_id"))
_LD = "count(*) AS n_rows; sum(fail) AS n_failures; count(DISTINCT build_id) AS n_builds; count(DISTINCT tc_key) AS n_tests"
_LDI = _LD.replace("count(DISTINCT build_id)", "count(DISTINCT project || build_id)").replace("count(DISTINCT tc_key)", "count(DISTINCT project || '|' || tc_key)")
add("label_distribution", lambda spark, sf: shaped(c.label_distribution(executions(spark, sf, "li"), "result")),
    f"{LI} " + sql_select("ex", "result", _LDI, "avg(fail) AS failure_rate") + " GROUP BY result")
add("project_metadata", lambda spark, sf: shaped(c.label_distribution(executions(spark, sf, "li"), "project")),
    f"{LI} " + sql_select("ex", "project", _LD, "avg(fail) AS failure_rate") + " GROUP BY project")

# ---- chronology and splits
add("build_chronology", lambda spark, sf: shaped(ch.build_table(raw_lines(spark, sf)), "project", "build_id", "build_idx"),
    f"{LI} SELECT DISTINCT project, build_id, build_idx FROM ex")
add("build_chronology_by_number", lambda spark, sf: shaped(ch.build_table(raw_lines(spark, sf).drop("build_start")), "project", "build_id", "build_idx"),
    f"{LI} SELECT project, build_id, row_number() OVER (PARTITION BY project ORDER BY build_id::BIGINT) - 1 AS build_idx FROM (SELECT DISTINCT project, build_id FROM raw)")
_NB = ", nb AS (SELECT project, max(build_idx) + 1 AS n FROM ex GROUP BY 1)"
_TSP = "CASE WHEN build_idx < floor(n * 0.8::DOUBLE) THEN 'train' WHEN build_idx < floor(n * 0.9::DOUBLE) THEN 'val' ELSE 'test' END AS split"
add("temporal_split", lambda spark, sf: shaped(ch.temporal_split(executions(spark, sf, "li")), "project", *KEY, "split"),
    f"{LI}{_NB} " + sql_select("ex JOIN nb USING (project)", f"project; build_id; tc_key; {_TSP}"))
_HSP = "CASE WHEN build_idx >= floor(n * 0.8::DOUBLE) THEN 'test' WHEN build_idx >= floor(floor(n * 0.8::DOUBLE) * 0.9::DOUBLE) THEN 'val' ELSE 'train' END AS split"
add("holdout_split", lambda spark, sf: shaped(ch.holdout_split(executions(spark, sf, "li")), "project", *KEY, "split"),
    f"{LI}{_NB} " + sql_select("ex JOIN nb USING (project)", f"project; build_id; tc_key; {_HSP}"))
add("expanding_folds", lambda spark, sf: shaped(ch.expanding_folds(executions(spark, sf), 5).groupBy("fold", "role").agg(
    F.count(F.lit(1)).alias("n_rows"), F.min("build_idx").alias("first"), F.max("build_idx").alias("last")), "fold", "role", "n_rows", "first", "last"),
    f"{EV}{_NB}, f AS (SELECT unnest(range(1, 5)) AS fold), r AS (SELECT fold, CASE WHEN build_idx < fold * (n // 5) THEN 'train' WHEN build_idx < (fold + 1) * (n // 5) "
    "THEN 'test' END AS role, build_idx FROM ex JOIN nb USING (project), f WHERE fold * (n // 5) >= 5) SELECT fold, role, count(*) AS n_rows, min(build_idx) AS first, "
    "max(build_idx) AS last FROM r WHERE role IS NOT NULL GROUP BY ALL")
add("check_disjoint", lambda spark, sf: shaped(ch.check_disjoint(ch.temporal_split(executions(spark, sf, "li")))),
    f"{LI} SELECT count(DISTINCT project || build_id) AS n_builds, 0::BIGINT AS n_shared FROM ex")

# ---- sampling
_Q42 = "'42'"


def _balanced(spark, sf):
    b = binary(spark, sf)
    return shaped(s.balanced_sample(b, 2000, ["doc_id"]), "draw", "doc_id", "label")


add("balanced_sample", _balanced, BIN + f", k AS (SELECT label, count(*) AS n FROM b GROUP BY 1), mi AS (SELECT label AS c, n FROM k ORDER BY n, label LIMIT 1), "
    "ma AS (SELECT k.label AS c, k.n FROM k, mi WHERE k.label <> mi.c), sh AS (SELECT mi.c AS mic, mi.n AS min_n, ma.c AS mac, ma.n AS maj_n, mi.n * 10.0::DOUBLE / "
    "(mi.n * 10.0::DOUBLE + ma.n) AS share FROM mi, ma), no AS (SELECT doc_id, label, row_number() OVER (PARTITION BY label ORDER BY "
    f"{hash32('doc_id', _Q42)}, doc_id) AS no FROM b), dr AS (SELECT i AS draw, CASE WHEN {hash32('i', chr(39) + 'class' + chr(39), _Q42)} / 1152921504606846976.0::DOUBLE < share THEN mic ELSE mac END "
    f"AS label, {hash32('i', chr(39) + 'row' + chr(39), _Q42)} AS h, min_n, maj_n, mic FROM range(2000) t(i), sh) "
    + sql_select("dr JOIN no ON no.label = dr.label AND no.no = h % (CASE WHEN dr.label = mic THEN min_n ELSE maj_n END) + 1", "", "draw; doc_id; dr.label AS label"))
_SH = f"{hash32('project', 'build_id', 'tc_key', _Q42)}"
add("stratified_batches", lambda spark, sf: shaped(s.stratified_batches(executions(spark, sf)), *KEY, "fail", "batch"),
    f"{EV}, r AS (SELECT *, row_number() OVER (PARTITION BY fail ORDER BY {_SH}, project, build_id, tc_key) - 1 AS i, sum(fail) OVER () // 4 AS nb, "
    "greatest(sum(1 - fail) OVER (), 28) AS turn FROM ex), bt AS (SELECT build_id, tc_key, fail, i // 4 AS batch FROM r WHERE fail = 1 AND i // 4 < nb UNION ALL "
    "SELECT build_id, tc_key, fail, unnest(range(i::BIGINT, (nb * 28)::BIGINT, turn::BIGINT)) // 28 FROM r WHERE fail = 0 AND i < nb * 28) "
    + sql_select("bt", "build_id; tc_key", "fail; batch"))
add("build_batches", lambda spark, sf: shaped(s.build_batches(executions(spark, sf), 64), *KEY, "batch"),
    f"WITH RECURSIVE {o.EV}, bb AS (SELECT project, build_id, count(*) AS n, row_number() OVER (ORDER BY {hash32('project', 'build_id', _Q42)}, project, build_id) AS pos "
    "FROM ex GROUP BY 1, 2 HAVING sum(fail) >= 1), pk AS (SELECT pos, n AS held, 0 AS batch FROM bb WHERE pos = 1 UNION ALL SELECT bb.pos, CASE WHEN held + n <= 64 THEN held + n ELSE n END, "
    "CASE WHEN held + n <= 64 THEN batch ELSE batch + 1 END FROM pk JOIN bb ON bb.pos = pk.pos + 1) " + sql_select("ex JOIN bb USING (project, build_id) JOIN pk USING (pos)", "build_id; tc_key", "batch"))
_EDG = f"{EV}, {CF}, e AS (SELECT project, src, dst, weight FROM cf WHERE weight >= 0.05::DOUBLE)"
add("split_edges", lambda spark, sf: shaped(s.split_edges(g.co_outcome_edges(executions(spark, sf), 1)), "src", "dst", "split"),
    f"{_EDG}, n AS (SELECT *, row_number() OVER (ORDER BY {hash32('src', 'dst', _Q42)}, src, dst) AS no, floor(count(*) OVER () * 0.1::DOUBLE) AS k FROM e) "
    + sql_select("n", "src; dst; CASE WHEN no <= k THEN 'test' WHEN no <= 2 * k THEN 'val' ELSE 'train' END AS split"))
add("negative_edges", lambda spark, sf: shaped(s.negative_edges(executions(spark, sf), g.co_failure_edges(executions(spark, sf), 4, 0.1), 200), "src", "dst"),
    f"{EV}, {_pairs('fail = 1', 'e', MEAN_W)}, nn AS (SELECT tc_key, row_number() OVER (ORDER BY tc_key) AS no FROM (SELECT DISTINCT tc_key FROM ex)), "
    "fr AS (SELECT x.tc_key AS src, y.tc_key AS dst, row_number() OVER (ORDER BY x.no, y.no) - 1 AS t FROM nn x JOIN nn y ON x.no < y.no WHERE (x.tc_key, y.tc_key) NOT IN "
    "(SELECT (src, dst) FROM e WHERE shared >= 4 AND weight >= 0.1::DOUBLE)), m AS (SELECT count(*) AS m, ceil(sqrt(count(*)::DOUBLE))::BIGINT AS a FROM fr), "
    "d0 AS (SELECT x, x // a AS l, x % a AS r, a, m FROM (SELECT m, a, unnest(range(least(200 + 2 * a + 1, a * a))) AS x FROM m)), "
    + ", ".join(f"d{k + 1} AS (SELECT x, r AS l, (l + {hash32('r', repr(str(k)), _Q42)} % a) % a AS r, a, m FROM d{k})" for k in range(4))
    + " SELECT src, dst FROM (SELECT l * a + r AS t FROM d4 WHERE l * a + r < m ORDER BY x LIMIT 200) JOIN fr USING (t)")


def _smote(spark, sf):
    e = emb(spark, sf).withColumn("label", (F.col("label") == 0).cast("int"))
    made = sim.smote(e)
    return shaped(made.select("vec_id", "copy", "neighbor", "step", *[F.col("embedding")[i].cast("double").alias(f"v{i}") for i in range(64)]))


def _smote_sql():
    h = lambda *p: hash32(*p)
    qn, qs, q = "'n'", "'s'", "'smote'"
    knn = ("SELECT a.vec_id AS query, b.vec_id AS neighbor, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.e, b.e), b.vec_id) AS rank "
           "FROM sm a, sm b WHERE a.vec_id <> b.vec_id")
    return (VEC + f", sm AS (SELECT * FROM v WHERE label = 0), nn AS (SELECT * FROM ({knn}) WHERE rank <= 5), ct AS (SELECT count(*) FILTER (label = 0) AS small, "
            "count(*) FILTER (label <> 0) - count(*) FILTER (label = 0) AS missing FROM v), od AS (SELECT vec_id, row_number() OVER (ORDER BY "
            f"{h('vec_id', q, _Q42)}, vec_id) AS o FROM sm), cp AS (SELECT vec_id AS query, unnest(range(1, (missing // small + (o <= missing % small)::INT + 1)::BIGINT)) AS copy FROM od, ct), "
            f"dr AS (SELECT query, copy, {h('query', 'copy', qn, _Q42)} % 5 + 1 AS rank, {h('query', 'copy', qs, _Q42)} / 1152921504606846976.0::DOUBLE AS step FROM cp) "
            + sql_select("dr JOIN nn USING (query, rank) JOIN sm a ON a.vec_id = query JOIN sm b ON b.vec_id = neighbor", "", "query AS vec_id; copy; neighbor",
                         "step; " + "; ".join(f"CAST(a.e[{i}] + (b.e[{i}] - a.e[{i}]) * step AS FLOAT) AS v{i - 1}" for i in range(1, 65))))


add("smote", _smote, _smote_sql())

# ---- set operations


def _union(spark, sf):
    a, b = executions(spark, sf), executions(spark, sf, "li")
    return shaped(a.unionByName(b, allowMissingColumns=True).groupBy("project").agg(F.count(F.lit(1)).alias("n"), F.count("n_commits").alias("with_commits")))


add("union_projects", _union, f"{EV}, a AS (SELECT project, n_commits FROM ex), " + o.LI.replace("raw AS", "raw2 AS").replace("FROM raw ", "FROM raw2 ").replace(
    "col AS", "col2 AS").replace("FROM col)", "FROM col2)").replace("ex AS", "ex2 AS") + ", u AS (SELECT * FROM a UNION ALL SELECT project, NULL FROM ex2) "
    "SELECT project, count(*) AS n, count(n_commits) AS with_commits FROM u GROUP BY 1")


def _intersect(spark, sf):
    a, b = two_methods(spark, sf)
    return shaped(a.filter("apfd >= 0.5").select("build_id").intersect(b.filter("apfd >= 0.5").select("build_id")))


add("intersect_builds", _intersect, _TWO + " SELECT build_id FROM pa WHERE apfd >= 0.5::DOUBLE INTERSECT SELECT build_id FROM pb WHERE apfd >= 0.5::DOUBLE")


def _new_builds(spark, sf):
    """Parts as tests: many of them come late."""
    e = ch.holdout_split(ch.with_clock(raw_lines(spark, sf, "l_partkey")))
    names = lambda cond: e.filter(cond).select("project", "tc_key").distinct()
    return shaped(names("split = 'test'").exceptAll(names("split <> 'test'")))


add("unseen_tests", _new_builds, f"{LI.replace(chr(39) + 's' + chr(39) + ' || l_suppkey', chr(39) + 'p' + chr(39) + ' || l_partkey')}{_NB} SELECT project, tc_key FROM ex JOIN nb USING (project) WHERE build_idx >= floor(n * 0.8::DOUBLE) EXCEPT "
    "SELECT project, tc_key FROM ex JOIN nb USING (project) WHERE build_idx < floor(n * 0.8::DOUBLE)")
add("distinct_texts", lambda spark, sf: table(spark, sf, "conversations").select(F.md5("text").alias("text_md5")).distinct(),
    "SELECT DISTINCT md5(text) AS text_md5 FROM conversations")

# ---- sources and sinks: write, read back


def _stored_executions(spark, sf):
    """Events and document texts in the stored layout, with quotes and line breaks."""
    e = raw_events(spark, sf).withColumn("doc_id", F.col("exec_id"))
    d = table(spark, sf, "documents").select("doc_id", "text")
    j = e.join(d, "doc_id", "left").select(
        F.col("build_id").alias("Build_ID"), F.col("tc_key").alias("TC_Key"), F.col("text").alias("TE_Summary"), F.col("exec_id").cast("string").alias("TE_Key"),
        F.col("build_start").cast("timestamp").alias("Build_Test_Start_Date"), F.col("result").alias("TE_Test_Result"),
        F.concat(F.lit("['"), F.array_join("commits", "', '"), F.lit("']")).alias("commit"), F.col("component").alias("CR_Component_Name"))
    return rd.with_schema(j, rd.EXECUTION_SCHEMA)


def _read_back(fmt):
    def run(spark, sf):
        path = folder(spark, "executions")
        w = _stored_executions(spark, sf).write.format(fmt)
        (w.option("header", True).option("escape", '"') if fmt == "csv" else w).save(path)
        df = rd.read_executions(spark, path, fmt)
        return df.select("Build_ID", "TC_Key", "TE_Key", "TE_Test_Result", F.md5(F.regexp_replace("TE_Summary", "\r\n?", "\n")).alias("summary_md5"), "commit")
    return run


_RB = (f"{EV} SELECT build_id AS Build_ID, tc_key AS TC_Key, exec_id::VARCHAR AS TE_Key, result AS TE_Test_Result, md5(regexp_replace(text, '\\r\\n?', chr(10), 'g')) AS summary_md5, "
       "'[''k' || k || ''']' AS commit FROM raw LEFT JOIN documents ON doc_id = exec_id")
add("read_executions_csv", _read_back("csv"), _RB)
add("read_executions_parquet", _read_back("parquet"), _RB)


def _changes(spark, sf):
    """Commits and change requests from stored literals, plain text and nulls, in two columns."""
    k = F.get_json_object("props", "$.k").cast("int")
    e = table(spark, sf, "events").select(
        F.col("event_id").cast("string").alias("TE_Key"),
        F.when(k % 4 == 1, F.concat(F.lit("['k"), k, F.lit("', 'k"), k + 1, F.lit("', 'k"), k, F.lit("']"))).when(k % 4 != 0, F.concat(F.lit("k"), k)).alias("commit"),
        F.when(k % 3 == 0, F.concat(F.lit('["CR_'), k % 5, F.lit('"]'))).alias("CR"), F.when(k % 2 == 0, F.concat(F.lit("CR_"), k % 7)).alias("CR_y"))
    done = rd.to_executions(rd.with_schema(e, rd.EXECUTION_SCHEMA))
    return shaped(done.select("exec_id", F.array_join(F.array_sort("commits"), ",").alias("commits"), F.array_join(F.array_sort("crs"), ",").alias("crs")))


add("stored_changes", _changes, f"{EV}, i AS (SELECT exec_id, CASE WHEN k % 4 = 1 THEN ['k' || k, 'k' || (k + 1)] WHEN k % 4 <> 0 THEN ['k' || k] ELSE [] END AS c, "
    "CASE WHEN k % 3 = 0 THEN ['CR_' || (k % 5)] ELSE [] END || CASE WHEN k % 2 = 0 THEN ['CR_' || (k % 7)] ELSE [] END AS r FROM raw) "
    "SELECT exec_id::VARCHAR AS exec_id, array_to_string(list_sort(c), ',') AS commits, array_to_string(list_sort(list_distinct(r)), ',') AS crs FROM i")


def _project_files(spark, sf):
    """Order lines in the raw layout, one `<project>/<project>.csv` per project."""
    path = folder(spark, "projects")
    r = raw_lines(spark, sf, "l_partkey")
    rows = r.select("project", F.col("build_id").cast("bigint").alias("travisJobId"), F.concat(F.lit("org.acme."), "component", F.lit(".Part"), F.initcap("tc_key"), F.lit("Test")).alias("testName"),
                    F.lit(0).alias("index"), "duration", F.lit(1).alias("count"), (F.col("result") == "Fail").cast("int").alias("failures"), F.lit(0).alias("errors"), F.lit(0).alias("skipped"))
    # all projects are joined and written at once, then each folder gets its name
    rows.filter("project is not null").write.partitionBy("project").option("header", True).csv(f"{path}/_all")
    paths = spark._jvm.org.apache.hadoop.fs.Path
    root = paths(f"{path}/_all")
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    for at in [status.getPath() for status in files.listStatus(root) if status.isDirectory()]:  # few names, one folder each
        name = unquote(at.getName().partition("=")[2])
        files.mkdirs(paths(f"{path}/{name}"))
        if not files.rename(at, paths(f"{path}/{name}/{name}.csv")):
            raise OSError(f"{at} could not be renamed")
    return path


def _raw_projects(spark, sf):
    return rd.read_projects(spark, _project_files(spark, sf))


add("project_rows", lambda spark, sf: shaped(_raw_projects(spark, sf), "project", "travisJobId", "testName", "duration", "failures"),
    f"{LI.replace(chr(39) + 's' + chr(39) + ' || l_suppkey', chr(39) + 'P' + chr(39) + ' || l_partkey')} " + sql_select(
        "raw", "project; 'org.acme.' || component || '.Part' || tc_key || 'Test' AS testName", "build_id AS travisJobId; (result = 'Fail')::INT AS failures", "duration"))
add("to_canonical", lambda spark, sf: shaped(rd.to_canonical(_raw_projects(spark, sf)), "Build_ID", "TC_Key", "TE_Summary", "TE_Test_Result"),
    f"{LI.replace(chr(39) + 's' + chr(39) + ' || l_suppkey', chr(39) + 'P' + chr(39) + ' || l_partkey')} SELECT project || '_' || build_id AS Build_ID, "
    "project || '::Part' || tc_key || 'Test' AS TC_Key, 'part ' || lower(tc_key) AS TE_Summary, CASE WHEN result = 'Fail' THEN 'Fail' ELSE 'Pass' END AS TE_Test_Result FROM raw")


def _strategy_files(spark, sf):
    """Rankings of all strategies in the stored layout, read back."""
    path = folder(spark, "strategies")
    rows = strategies(spark, sf).withColumns({
        "score": -F.col("index"), "build_key": F.col("build_id"), "build_id": F.concat_ws("|", "strategy", "build_id")})
    clock = executions(spark, sf).select(F.col("build_id").alias("build_key"), "build_idx").distinct()
    r = rank_in_build(rows.drop("index")).join(clock, "build_key")
    out = materialize(r.select(
        "strategy", F.col("build_idx").alias("travisJobId"), F.col("tc_key").alias("testName"), F.col("rank").alias("index"), F.lit(1.0).alias("duration"),
        F.lit(1).alias("count"), F.col("fail").alias("failures"), F.lit(0).alias("errors"), F.lit(0).alias("skipped")))
    for name in STRATEGY_NAMES:
        out.filter(F.col("strategy") == name).drop("strategy").write.option("header", True).csv(f"{path}/ev/baseline/ev@{name}.csv")
    back = rd.read_strategy_rankings(spark, path)
    return shaped(back, "project", "strategy", "travisJobId", "testName", "index", "failures")


add("read_strategy_rankings", _strategy_files, STRATEGY_SQL + " " + sql_select(
    "ranked", "project; strategy; tc_key AS testName", 'build_idx AS travisJobId; rank AS "index"; fail AS failures'))


def _prioritized(spark, sf):
    path = folder(spark, "prioritized")
    r = ranked(spark, sf).withColumns({"probability": F.col("score"), "label": F.col("fail")})
    wr.write_prioritized(r, path, "parquet")
    return shaped(spark.read.parquet(path))


add("write_prioritized", _prioritized, RANKED + " " + sql_select("ranked", "build_id; tc_key; result", "fail AS label; rank", "score AS probability; 0 AS diversity_score; score AS priority_score"))


def _reports(spark, sf):
    path = folder(spark, "reports")
    wr.write_apfd_reports(m.apfd_per_build(ranked(spark, sf, "li")), path)
    df = spark.read.option("header", True).csv(f"{path}/per_project")
    return shaped(df.select("project", F.col("n_builds_with_failures").cast("bigint"), *[F.col(x).cast("double").alias(x) for x in ("mean_apfd", "std_apfd", "median_apfd")]))


add("write_apfd_reports", _reports, f"{LI}, {o.history()}, {o.RANKED}, {o.apfd()} " + sql_select(
    "per", "project", "count(*) AS n_builds_with_failures", "avg(apfd) AS mean_apfd; stddev_pop(apfd) AS std_apfd; median(apfd) AS median_apfd") + " GROUP BY project")


def _report_builds(spark, sf):
    path = folder(spark, "reports")
    wr.write_apfd_reports(m.apfd_per_build(ranked(spark, sf, "li")), path)
    df = spark.read.option("header", True).csv(f"{path}/per_build")
    return shaped(df.select("project", "build_id", *[F.col(x).cast("bigint").alias(x) for x in ("count_tc", "n_failures")], F.col("apfd").cast("double").alias("apfd")))


add("write_apfd_reports_builds", _report_builds, f"{LI}, {o.history()}, {o.RANKED}, {o.apfd()} " + sql_select("per", "project; build_id", "count_tc; n_failures", "apfd"))


def _report_aggregate(spark, sf):
    """The aggregate document read back, a row for each project listed in it."""
    path = folder(spark, "reports")
    wr.write_apfd_reports(m.apfd_per_build(ranked(spark, sf, "li")), path)
    df = spark.read.json(f"{path}/aggregate").withColumn("p", F.explode("per_project"))
    return shaped(df.select("n_projects", "n_builds_total", "grand_mean_apfd", "grand_std_apfd", "grand_median_apfd", "p.project", "p.n_builds_with_failures", "p.median_apfd"))


add("write_apfd_reports_aggregate", _report_aggregate, f"{LI}, {o.history()}, {o.RANKED}, {o.apfd()}, pp AS (SELECT project, count(*) AS n, avg(apfd) AS a, median(apfd) AS med FROM per GROUP BY 1), "
    "gm AS (SELECT count(*) AS k, sum(n) AS total, avg(a) AS mean, stddev_pop(a) AS sd, median(a) AS mid FROM pp) " + sql_select(
        "pp, gm", "project", "k AS n_projects; total AS n_builds_total; n AS n_builds_with_failures", "mean AS grand_mean_apfd; sd AS grand_std_apfd; mid AS grand_median_apfd; med AS median_apfd"))


def _export(spark, sf):
    path = folder(spark, "rankings")
    wr.export_rankings(c.builds_with_failures(ranked(spark, sf)), path, "parquet")
    return shaped(spark.read.parquet(path))


add("export_rankings", _export, RANKED + " " + sql_select("ranked", "build_id; tc_key AS test_id", "rank; fail AS label", where="build_id IN (SELECT build_id FROM ex WHERE fail = 1)"))


def _resume(spark, sf):
    """A first run stores two projects; the second stores only what is missing."""
    path = folder(spark, "results")
    per = wr.per_project(m.apfd_per_build(ranked(spark, sf, "li"))).withColumn("variant", F.lit("full"))
    wr.append_new_results(per.filter("project < 'F'"), path)
    wr.append_new_results(per, path)
    return shaped(spark.read.parquet(path), "project", "variant", "n_builds_with_failures", "mean_apfd")


add("append_new_results", _resume, f"{LI}, {o.history()}, {o.RANKED}, {o.apfd()} " + sql_select(
    "per", "project; 'full' AS variant", "count(*) AS n_builds_with_failures", "avg(apfd) AS mean_apfd") + " GROUP BY project")


def _state(spark, sf):
    path = folder(spark, "state")
    wr.save_table(snapshot(executions(spark, sf), want=["n", "failures", "last_idx"]), f"{path}/history")
    return shaped(wr.load_table(spark, f"{path}/history"), "tc_key", "n", "failures", "last_idx")


add("save_load_history", _state, f"{EV} " + sql_select("ex", "tc_key", "count(*) AS n; sum(fail) AS failures; max(build_idx) AS last_idx") + " GROUP BY project, tc_key")


def _graph_state(spark, sf):
    path = folder(spark, "state")
    wr.save_table(g.co_failure_edges(executions(spark, sf)), f"{path}/edges")
    return shaped(wr.load_table(spark, f"{path}/edges"), "src", "dst", "shared", "weight")


add("save_load_graph", _graph_state, f"{EV}, {_pairs('fail = 1', 'e', MEAN_W)} " + sql_select("e", "src; dst", "shared", "weight", "shared >= 2 AND weight >= 0.1::DOUBLE"))
add("dataset_fingerprint", lambda spark, sf: shaped(wr.dataset_fingerprint(table(spark, sf, "documents"), ["doc_id", "text", "lang"])),
    "SELECT count(*) AS n_rows, sum(('0x' || substr(md5(doc_id || '|' || text || '|' || lang), 1, 12))::BIGINT)::VARCHAR AS fingerprint FROM documents")

# ---- streams
_WEEK = "cast(build_idx / 168 as int)"


def _stream_source(spark, sf):
    """The executions as files in clock order, one week per micro-batch."""
    path = folder(spark, "stream")
    e = executions(spark, sf).select("project", "tc_key", "build_id", "build_idx", "fail")
    last = e.agg(F.max(F.expr(_WEEK))).first()[0]
    for week in range(last + 1):
        e.filter(f"{_WEEK} = {week}").coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(path)


def _stream_history(spark, sf):
    out, ckpt = folder(spark, "stream-out"), folder(spark, "stream-ckpt")
    q = (stream_history(_stream_source(spark, sf)).writeStream.format("parquet").option("path", out)
         .option("checkpointLocation", ckpt).trigger(availableNow=True).start())
    q.awaitTermination()
    return shaped(spark.read.parquet(out).filter("not is_late"), *KEY, "n", "failures", "rate_5", "rate_10", "fail_run", "pass_run", "last_idx", "last_fail_idx", "late")


add("stream_history", _stream_history, o.ev_history() + sql_select("h", "build_id; tc_key", "n; failures; fail_run; pass_run; last_idx; last_fail_idx; 0 AS late", "rate_5; rate_10"))


def _stream_rank(spark, sf):
    out, ckpt = folder(spark, "stream-out"), folder(spark, "stream-ckpt")
    stream_rank(stream_history(_stream_source(spark, sf)), out, ckpt).start().awaitTermination()
    grade_waiting(spark, out, ckpt)
    return shaped(spark.read.parquet(out), "build_id", "count_tc", "n_failures", "apfd")


add("stream_rank", _stream_rank, PER + " " + sql_select("per", "build_id", "count_tc; n_failures", "apfd"))

# ---- learned scorers: the twins come to the same optimum by another method
D8 = ["last_verdict", "last_duration", "failure_rate", "recent_failure_rate", "execution_share", "mean_duration", "since_failure", "same_verdict_run"]


def split_features(spark, sf):
    f8 = feat.features_deeporder8(executions(spark, sf))
    return ch.holdout_split(f8).withColumn("split", F.when(F.col("split") == "test", "test").otherwise("train"))


# fixed values: the eight features, those of a test without a past, and the cap on the weight of failures
_F8_SQL = {
    "last_verdict": ("fail_1", "0.5"), "last_duration": ("last_duration / (greatest(max_duration, 0) + 1e-6::DOUBLE)", "0"),
    "failure_rate": ("failures / n::DOUBLE", "0"), "recent_failure_rate": ("rate_10", "0"),
    "execution_share": ("n / (build_idx + 1)::DOUBLE", "0"), "mean_duration": ("duration_sum / n / (greatest(max_duration, 0) + 1e-6::DOUBLE)", "0"),
    "since_failure": ("pass_run / (n + 1)::DOUBLE", "1"),
    "same_verdict_run": ("CASE WHEN fail_1 = 1 THEN fail_run ELSE pass_run END / (n + 1)::DOUBLE", "0")}
# end of fixed values
SPLIT = "CASE WHEN build_idx >= floor((SELECT max(build_idx) + 1 FROM ex) * 0.8::DOUBLE) THEN 'test' ELSE 'train' END"
F8S = (o.ev_history().rstrip().replace("WITH", "WITH RECURSIVE", 1) + f", f8 AS MATERIALIZED (SELECT build_id, tc_key, build_idx, fail, {SPLIT} AS split, "
       + ", ".join(f"CASE WHEN n > 0 THEN {e} ELSE {other}::DOUBLE END AS {c}" for c, (e, other) in _F8_SQL.items()) + " FROM h), "
       "tr AS MATERIALIZED (SELECT *, fail AS y, CASE WHEN fail = 1 THEN (SELECT least((1 - avg(fail)) / (avg(fail) + 1e-6::DOUBLE), 50) "
       "FROM f8 WHERE split = 'train') ELSE 1 END AS w FROM f8 WHERE split = 'train')")
PROB = "1 / (1 + exp(-(b + " + " + ".join(f"b{i} * {c}" for i, c in enumerate(_F8_SQL)) + ")))"


def probability(df):
    """Four places: two methods agree to eleven, and rounding must not tell them apart."""
    return df.select(*[c for c in KEY if c in df.columns], F.round("p_fail", 4).alias("p_fail"))


def _history_scorer(kind):
    def run(spark, sf):
        f8 = split_features(spark, sf)
        model = l.fit_history_scorer(f8.filter("split = 'train'"), D8, kind=kind)
        return probability(l.score(model, f8.filter("split = 'test'")))
    return run


add("history_scorer_logistic", _history_scorer("lr"),
    f"{F8S}, {logistic_sql('tr', D8)} SELECT build_id, tc_key, round({PROB}, 4) AS p_fail FROM f8, fit WHERE split = 'test'")
_RID = "trr AS MATERIALIZED (SELECT *, build_id || '|' || tc_key AS rid, ('0x' || substr(md5(build_id || '|' || tc_key || '|row'), 1, 8))::BIGINT AS h31 FROM tr), " \
       "ter AS MATERIALIZED (SELECT *, build_id || '|' || tc_key AS rid FROM f8 WHERE split = 'test')"
add("history_scorer_boosted", _history_scorer("gbt"),
    f"{F8S}, {_RID}, {boosted_sql('trr', 'ter', D8, 'gb')} SELECT build_id, tc_key, round(p, 4) AS p_fail FROM ter JOIN gb USING (rid)")
WIDE = 16


def test_vectors(spark, sf):
    """A vector of the whole text of each test's document: test u7 is told by document 7."""
    d = table(spark, sf, "documents")
    return d.select(F.lit("ev").alias("project"), F.concat(F.lit("u"), "doc_id").alias("tc_key"), hash_embedding(F.col("text"), WIDE).alias("embedding"))


_VECTORS = (f"hv AS (SELECT 'u' || doc_id AS tc_key, list_transform(range(0, {WIDE}), lambda i: ('0x' || substr(md5(key || '|' || i || '|42'), 1, 8))::BIGINT "
            "/ 2147483648.0::DOUBLE - 1) AS v FROM (SELECT doc_id, md5(text) AS key FROM documents)), "
            "tv AS (SELECT tc_key, " + ", ".join(f"v[{i + 1}] / sqrt(list_sum(list_transform(v, lambda z: z * z))) AS v{i}" for i in range(WIDE)) + " FROM hv)")
_VS = [f"v{i}" for i in range(WIDE)]
_EXS = f"exs AS (SELECT *, {SPLIT} AS split FROM ex)"


def split_executions(spark, sf):
    e = ch.holdout_split(executions(spark, sf))
    return e.withColumn("split", F.when(F.col("split") == "test", "test").otherwise("train"))


def _text_scorer(spark, sf):
    e, v = split_executions(spark, sf), test_vectors(spark, sf)
    model = l.fit_text_scorer(e.filter("split = 'train'"), v)
    late = e.filter("split = 'test'").select("project", "tc_key").distinct()
    return probability(l.score_text(model, v.join(late, ["project", "tc_key"])))


add("text_scorer", _text_scorer, f"WITH RECURSIVE {o.EV}, {_EXS}, {_VECTORS}, "
    "tw AS (SELECT tc_key, sum(fail) AS f, sum((verdict = 0)::INT) AS p FROM exs WHERE split = 'train' GROUP BY 1), "
    "tr AS MATERIALIZED (SELECT tv.*, y, w FROM (SELECT tc_key, 1 AS y, f AS w FROM tw WHERE f > 0 UNION ALL SELECT tc_key, 0, p FROM tw WHERE p > 0) JOIN tv USING (tc_key)), "
    f"{logistic_sql('tr', _VS)} SELECT tc_key, round(1 / (1 + exp(-(b + {' + '.join(f'b{i} * v{i}' for i in range(WIDE))}))), 4) AS p_fail FROM tv, fit "
    "WHERE tc_key IN (SELECT tc_key FROM exs WHERE split = 'test')")


def _ensemble(spark, sf):
    f8 = split_features(spark, sf)
    model = l.fit_ensemble(f8.filter("split = 'train'"), D8, KEY)
    four = l.score_ensemble(model, f8.filter("split = 'test'"), parts=True)
    return four.select(*KEY, *[F.round(c, 4).alias(c) for c in ("p_logistic", "p_forest", "p_boosted", "p_fail")])


add("ensemble_scorer", _ensemble, f"{F8S}, {_RID}, plain AS MATERIALIZED (SELECT * REPLACE (1 AS w) FROM trr), {logistic_sql('tr', D8)}, {forest_sql('trr', 'ter', D8, 'rf')}, "
    f"{boosted_sql('plain', 'ter', D8, 'gb')}, three AS (SELECT build_id, tc_key, {PROB} AS a, rf.p AS b, gb.p AS c FROM ter JOIN rf USING (rid) JOIN gb USING (rid), fit) "
    "SELECT build_id, tc_key, round(a, 4) AS p_logistic, round(b, 4) AS p_forest, round(c, 4) AS p_boosted, round((a + b + c) / 3, 4) AS p_fail FROM three")


def _flags(spark, sf):
    """Features of the older builds, the label from the later ones: did the test fail there more often
    than tests do over all?"""
    e = split_executions(spark, sf)
    old, late = e.filter("split = 'train'").drop("split"), e.filter("split = 'test'")
    usual = e.agg(F.avg("fail")).first()[0]
    after = late.groupBy("project", "tc_key").agg((F.avg("fail") > F.lit(usual)).cast("int").alias("label"))
    nodes = feat.node_features(feat.features_deeporder8(old).drop("fail"), old).drop("label").join(after, ["project", "tc_key"]).select(
        "project", "tc_key", *_FLAGGED, "label")
    return shaped(l.sensitivity_flags(nodes, g.co_outcome_edges(old, 1), _FLAGGED).drop("project"))


_FLAGGED = ["failure_rate", "mean_duration", "since_failure"]
_PERTURBED = ", ".join(f"{c} + 0.1::DOUBLE * abs({c}) * ({hash32('project', 'tc_key', repr(c), _Q42)} / 1152921504606846976.0::DOUBLE * 2 - 1) AS {c}" for c in _FLAGGED)
_CLASS = "SELECT rid, (round(p, 9) >= 0.5::DOUBLE)::INT AS y FROM"


def _flags_sql():
    old = f"exo AS (SELECT * FROM ex WHERE ({SPLIT}) = 'train')"
    head = (f"WITH {o.EV}, {old}, {o.history('exo')}, f8 AS (SELECT project, tc_key, build_idx, "
            + ", ".join(f"CASE WHEN n > 0 THEN {e} ELSE {other}::DOUBLE END AS {c}" for c, (e, other) in _F8_SQL.items() if c in _FLAGGED) + " FROM h), "
            f"after AS (SELECT project, tc_key, (avg(fail) > (SELECT avg(fail) FROM ex))::INT AS y FROM ex WHERE ({SPLIT}) = 'test' GROUP BY ALL), "
            "nd AS MATERIALIZED (SELECT f8.* EXCLUDE (build_idx), y, tc_key AS rid, 1 AS w, ('0x' || substr(md5(project || '|' || tc_key || '|row'), 1, 8))::BIGINT AS h31 FROM "
            "(SELECT * FROM f8 QUALIFY row_number() OVER (PARTITION BY project, tc_key ORDER BY build_idx DESC) = 1) f8 JOIN after USING (project, tc_key))")
    edges = _pairs("fail = 1 AND verdict = 1", "cfo", "shared / greatest(x.n, y.n)::DOUBLE", src="exo")
    draws = (f"nn AS (SELECT tc_key, row_number() OVER (ORDER BY tc_key) AS no, count(*) OVER () AS sz FROM nd), dw AS (SELECT i, {hash32('i', repr('a'), _Q42)} % sz + 1 AS a, "
             f"{hash32('i', repr('b'), _Q42)} % sz + 1 AS b FROM range(5) t(i), (SELECT max(sz) AS sz FROM nn)), "
             "dp AS (SELECT DISTINCT least(x.tc_key, y.tc_key) AS src, greatest(x.tc_key, y.tc_key) AS dst FROM dw JOIN nn x ON x.no = a JOIN nn y ON y.no = b WHERE a <> b), "
             "rn AS (SELECT src, dst, 1.0::DOUBLE AS weight FROM dp UNION ALL SELECT src, dst, weight FROM cfo WHERE weight >= 0.05::DOUBLE AND (src, dst) NOT IN (SELECT (src, dst) FROM dp)), "
             "kp AS (SELECT * FROM rn WHERE src IN (SELECT tc_key FROM nd) AND dst IN (SELECT tc_key FROM nd)), "
             "bt AS (SELECT src, dst, weight FROM kp UNION ALL SELECT dst, src, weight FROM kp), "
             "sp AS (SELECT b.src AS tc_key, " + ", ".join(f"sum(weight * {c}) / (sum(weight) + 1e-6::DOUBLE) AS {c}" for c in _FLAGGED) + " FROM bt b JOIN nd ON nd.tc_key = b.dst GROUP BY 1), "
             "ng AS MATERIALIZED (SELECT rid, y, w, h31, " + ", ".join(f"coalesce(sp.{c}, 0) AS {c}" for c in _FLAGGED) + " FROM nd LEFT JOIN sp USING (tc_key)), "
             f"nf AS MATERIALIZED (SELECT rid, y, w, h31, {_PERTURBED} FROM nd)")
    fits = ", ".join(forest_sql(rows, rows, _FLAGGED, name, n, d) for rows, name, n, d in (("nd", "fb", 20, 3), ("ng", "fg", 20, 3), ("nf", "ff", 20, 3), ("nd", "fm", 30, 6)))
    return (f"{head}, {edges}, {draws}, {fits}, base AS ({_CLASS} fb), gr AS ({_CLASS} fg), fe AS ({_CLASS} ff), mo AS ({_CLASS} fm) "
            "SELECT rid AS tc_key, (gr.y <> base.y)::BIGINT AS flag_graph, (fe.y <> base.y)::BIGINT AS flag_features, (mo.y <> base.y)::BIGINT AS flag_model "
            "FROM base JOIN gr USING (rid) JOIN fe USING (rid) JOIN mo USING (rid)")


add("sensitivity_flags", _flags, _flags_sql())


def _selected(spark, sf):
    f8 = split_features(spark, sf)
    model, settings, _ = l.select_by_holdout(f8.filter("split = 'train'"), D8)
    scored = probability(l.score(model, f8.filter("split = 'test'")))
    return scored.withColumn("depth", F.lit(settings["depth"]).cast("bigint"))


_INNER = ("inn AS MATERIALIZED (SELECT * REPLACE (1 AS w) FROM trr WHERE build_idx < floor((SELECT max(build_idx) + 1 FROM tr) * 0.8::DOUBLE)), "
          "val AS MATERIALIZED (SELECT * FROM trr WHERE build_idx >= floor((SELECT max(build_idx) + 1 FROM tr) * 0.8::DOUBLE)), plain AS MATERIALIZED (SELECT * REPLACE (1 AS w) FROM trr)")
add("select_by_holdout", _selected, f"{F8S}, {_RID}, {_INNER}, " + ", ".join(
    boosted_sql("inn", "val", D8, f"v{d}", 10, d, logistic=False) + ", " + boosted_sql("plain", "ter", D8, f"g{d}", 10, d, logistic=False) for d in (2, 4))
    + ", won AS (SELECT CASE WHEN round((SELECT avg((p - y) * (p - y)) FROM v2 JOIN val USING (rid)), 9) <= round((SELECT avg((p - y) * (p - y)) FROM v4 JOIN val USING (rid)), 9) THEN 2 ELSE 4 END AS depth) "
    "SELECT build_id, tc_key, round(CASE depth WHEN 2 THEN g2.p ELSE g4.p END, 4) AS p_fail, depth::BIGINT AS depth FROM ter JOIN g2 USING (rid) JOIN g4 USING (rid), won")


def _cold_start(spark, sf):
    """History of a test from the text of its document, learned on the older builds."""
    e, v = split_executions(spark, sf), test_vectors(spark, sf)
    past = e.filter("split = 'train'").groupBy("project", "tc_key").agg(F.avg("fail").alias("failure_rate"), F.avg("duration").alias("mean_duration"))
    fitted = l.fit_cold_start(v.join(past, ["project", "tc_key"]), ["failure_rate", "mean_duration"])
    late = e.filter("split = 'test'").select("project", "tc_key").distinct()
    got = l.predict_cold_start(fitted, v.join(late, ["project", "tc_key"]))
    return got.select("tc_key", F.round("failure_rate", 6).alias("failure_rate"), F.round("mean_duration", 5).alias("mean_duration"))


add("cold_start_regression", _cold_start, f"WITH RECURSIVE {o.EV}, {_EXS}, {_VECTORS}, "
    "tr AS MATERIALIZED (SELECT tv.*, failure_rate, mean_duration FROM tv JOIN (SELECT tc_key, avg(fail) AS failure_rate, avg(duration) AS mean_duration "
    "FROM exs WHERE split = 'train' GROUP BY 1) USING (tc_key)), "
    f"{ridge_sql('tr', _VS, ['failure_rate', 'mean_duration'])} SELECT tc_key, round(o0 + {' + '.join(f'w0_{i} * v{i}' for i in range(WIDE))}, 6) AS failure_rate, "
    f"round(o1 + {' + '.join(f'w1_{i} * v{i}' for i in range(WIDE))}, 5) AS mean_duration FROM tv, fit WHERE tc_key IN (SELECT tc_key FROM exs WHERE split = 'test')")


def _slope(spark, sf):
    """One feature without a penalty is the plain regression line, a target at a time."""
    e = executions(spark, sf)
    rows = e.select(F.array(F.col("build_idx").cast("double")).alias("x"), "duration", F.col("fail").cast("double").alias("fail"))
    names, model = l.fit_cold_start(rows, ["duration", "fail"], "x", 0.0)
    return shaped(spark.createDataFrame([(n, float(model.weights[0, k]), float(model.offsets[k])) for k, n in enumerate(names)],
                                        "target string, slope double, offset double"))


add("ridge_line", _slope, f"WITH {o.EV}, two AS (SELECT 'duration' AS target, regr_slope(duration, build_idx) AS a, regr_intercept(duration, build_idx) AS b FROM ex "
    "UNION ALL SELECT 'fail', regr_slope(fail, build_idx), regr_intercept(fail, build_idx) FROM ex) " + sql_select("two", "target", "", 'a AS slope; b AS "offset"'))
