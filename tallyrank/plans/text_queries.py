"""Queries on text, lists and commits, each with its SQL twin. Long texts are compared by
their digest."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tallyrank.functions import text as t
from tallyrank.operators import textops as x
from tallyrank.operators.learn import build_commit_vector
from tallyrank.plans import oracle as o
from tallyrank.plans.fixtures import raw_events, spread, table
from tallyrank.plans.shape import shaped, sql_select

Q, S = {}, {}


def add(name, fn, sql=None):
    Q[name] = fn
    if sql:
        S[name] = sql


def docs(spark, sf):
    return spread(table(spark, sf, "documents"))


def digest(df, *columns, keys=("doc_id",)):
    out = [F.col(k) for k in keys]
    for c in columns:
        out += [F.md5(c).alias(f"{c}_md5"), F.length(c).cast("bigint").alias(f"{c}_len")]
    return df.select(*out)


def digest_sql(source, *columns, keys="doc_id"):
    return f"SELECT {keys}, " + ", ".join(f"md5({c}) AS {c}_md5, length({c}) AS {c}_len" for c in columns) + f" FROM {source}"


def clean_sql(c):
    return (f"trim(regexp_replace(regexp_replace({c}, '[\\s\\x0b\\x1c-\\x1f\\x{{85}}\\p{{Z}}]+', ' ', 'g'), "
            f"'[\\x00-\\x1f\\x7f-\\x{{9f}}]', '', 'g'))")


add("clean_text", lambda spark, sf: digest(docs(spark, sf).select("doc_id", t.clean_text(F.col("text")).alias("clean")), "clean"),
    f"WITH c AS (SELECT doc_id, {clean_sql('text')} AS clean FROM documents) " + digest_sql("c", "clean"))
add("combine_fields", lambda spark, sf: digest(docs(spark, sf).select("doc_id", t.combine_fields(
    F.col("source"), F.col("text"), F.when(F.col("lang") == "en", F.col("lang")).otherwise(""), F.col("lang")).alias("combined")), "combined"),
    f"WITH c AS (SELECT doc_id, source || ' [SEP] ' || {clean_sql('text')} || CASE WHEN lang = 'en' THEN ' [SEP] en' ELSE '' END || ' [SEP] ' || lang "
    "AS combined FROM documents) " + digest_sql("c", "combined"))


def _fields(spark, sf):
    d = docs(spark, sf)
    f = t.field_texts(F.col("source"), F.col("text"), F.lit(None), F.col("lang"), F.when(F.col("lang") != "fr", F.col("source")))
    return digest(d.select("doc_id", *[v.alias(k) for k, v in f.items()]), *f)


add("field_texts", _fields, f"WITH c AS (SELECT doc_id, {clean_sql('source')} AS summary, {clean_sql('text')} AS steps, '' AS commits, 'Type: ' || lang || "
    "CASE WHEN lang <> 'fr' THEN ' Component: ' || source ELSE '' END AS cr FROM documents) " + digest_sql("c", "summary", "steps", "commits", "cr"))


def literal(c):
    """The lines of a text as a Python list literal."""
    esc = F.regexp_replace(F.regexp_replace(c, r"\\", r"\\\\"), "'", r"\\'")
    esc = F.regexp_replace(F.regexp_replace(esc, "\t", r"\\t"), "\r", r"\\r")
    return F.concat(F.lit("['"), F.regexp_replace(esc, "\n", "', '"), F.lit("']"))


add("parse_list_literal", lambda spark, sf: digest(docs(spark, sf).select("doc_id", t.parse_list_literal(literal(F.col("text"))).alias("head"),
                                                                          t.first_of_list(literal(F.col("text"))).alias("first")), "head", "first"),
    "WITH c AS (SELECT doc_id, array_to_string(string_split(text, chr(10)), ' [SEP] ') AS head, string_split(text, chr(10))[1] AS first "
    "FROM documents) " + digest_sql("c", "head", "first"))


def _commit_json(as_objects):
    lines = F.split("text", "\n")
    if as_objects:
        return F.to_json(F.transform(lines, lambda m: F.struct(m.alias("message"), F.col("source").alias("author"), F.array(
            F.concat_ws("/", "lang", "source"), F.col("lang")).alias("files_changed"))))
    return F.to_json(lines)


def clean_commit_sql(c):
    flat = (f"regexp_replace(regexp_replace({c}, '[\\s\\x0b\\x1c-\\x1f\\x{{85}}\\p{{Z}}]+', ' ', 'g'), '[\\x00-\\x1f\\x7f-\\x{{9f}}]', '', 'g')")
    return (f"trim(regexp_replace(regexp_replace({flat}, '^(Merge|Revert|Fix|Add|Update|Remove|Refactor):\\s*', '', 'i'), "
            "'#\\d+|\\b[A-Z]+-\\d+\\b', '', 'g'))")


add("clean_commit", lambda spark, sf: digest(docs(spark, sf).select("doc_id", t.clean_commit(F.concat(F.lit("fix: "), F.col("text"))).alias("message")), "message"),
    f"WITH c AS (SELECT doc_id, {clean_commit_sql(chr(39) + 'fix: ' + chr(39) + ' || text')} AS message FROM documents) " + digest_sql("c", "message"))


def _joined(items):
    return (f"list_filter({items}, lambda m: m <> '')")


def _numbered(items):
    return f"coalesce(array_to_string(list_transform({_joined(items)}, lambda m, i: 'Commit ' || i || ': ' || m), ' | '), '')"


add("commits_text", lambda spark, sf: digest(docs(spark, sf).select("doc_id", t.commits_text(_commit_json(True)).alias("commits")), "commits"),
    "WITH c AS (SELECT doc_id, " + _numbered(
        f"list_transform(string_split(text, chr(10)), lambda l: trim({clean_commit_sql('l')} || ' Author: ' || source || ' Files: ' || source || ', ' || lang, ' '))")
    + " AS commits FROM documents) " + digest_sql("c", "commits"))
add("parse_commits", lambda spark, sf: digest(docs(spark, sf).select("doc_id", F.array_join(F.transform(
    t.parse_commits(_commit_json(False)), lambda c: c["message"]), "|").alias("messages")), "messages"),
    "WITH c AS (SELECT doc_id, array_to_string(string_split(text, chr(10)), '|') AS messages FROM documents) " + digest_sql("c", "messages"))
add("commits_text_plain", lambda spark, sf: digest(docs(spark, sf).select("doc_id", t.commits_text(F.col("text")).alias("commits")), "commits"),
    f"WITH c AS (SELECT doc_id, CASE WHEN {clean_commit_sql('text')} = '' THEN '' ELSE 'Commit 1: ' || {clean_commit_sql('text')} END AS commits FROM documents) "
    + digest_sql("c", "commits"))


def named(spark, sf):
    words = F.concat_ws("", F.initcap(F.element_at(F.split("p_name", " "), 1)), F.initcap(F.element_at(F.split("p_name", " "), 2)))
    return table(spark, sf, "part").select("p_partkey", F.concat(
        F.lit("com."), F.lower(F.regexp_replace("p_brand", "#", "")), F.lit(".HTTP"), words, F.lit("Test")).alias("name"))


_NAMED = ("nm AS (SELECT p_partkey, 'com.' || lower(replace(p_brand, '#', '')) || '.HTTP' || upper(split_part(p_name, ' ', 1)[1]) || split_part(p_name, ' ', 1)[2:] "
          "|| upper(split_part(p_name, ' ', 2)[1]) || split_part(p_name, ' ', 2)[2:] || 'Test' AS name, lower(split_part(p_name, ' ', 1)) AS w1, "
          "lower(split_part(p_name, ' ', 2)) AS w2, lower(replace(p_brand, '#', '')) AS b FROM part)")
add("split_test_name", lambda spark, sf: named(spark, sf).select("p_partkey", t.package_name(F.col("name")).alias("package"), t.class_name(F.col("name")).alias("class")),
    f"WITH {_NAMED} SELECT p_partkey, 'com.' || b AS package, split_part(name, '.', 3) AS class FROM nm")
add("camel_to_words", lambda spark, sf: named(spark, sf).select("p_partkey", t.camel_to_words(t.class_name(F.col("name"))).alias("words"),
                                                                 t.camel_to_words(F.col("name"), "dotted").alias("dotted")),
    f"WITH {_NAMED} SELECT p_partkey, 'http ' || w1 || ' ' || w2 AS words, 'com ' || b || ' h t t p ' || w1 || ' ' || w2 || ' test' AS dotted FROM nm")

_B = t.char_budget(128)


def _trunc_sql(strategy, n=_B):
    def last(s):
        return f"CASE WHEN contains({s}, ' ') THEN length(regexp_extract({s}, '(?s)^(.*) ', 1)) ELSE -1 END"

    def start(k):
        s = f"left(text, {k})"
        return f"(CASE WHEN {last(s)} > {k * 0.9}::DOUBLE THEN left(text, ({last(s)})::INT) ELSE {s} END)"

    def end(k):
        s = f"right(text, {k})"
        sp = f"(strpos({s}, ' ') - 1)"
        return f"(CASE WHEN {sp} > 0 AND {sp} < {k * 0.1}::DOUBLE THEN substr({s}, {sp} + 2) ELSE {s} END)"

    body = {"tail": f"{start(n)} || ' [TRUNCATED]'", "head": f"'[TRUNCATED] ' || {end(n)}",
            "middle": f"{start(n // 2)} || ' [...] ' || {end(n // 2)}"}[strategy]
    return f"CASE WHEN length(text) <= {n} THEN text ELSE {body} END AS {strategy}"


_ST = ("tail", "head", "middle")
add("truncate_safe", lambda spark, sf: digest(docs(spark, sf).select("doc_id", *[t.truncate_safe(F.col("text"), 128, s).alias(s) for s in _ST]), *_ST),
    "WITH c AS (SELECT doc_id, " + ", ".join(_trunc_sql(s) for s in _ST) + " FROM documents) " + digest_sql("c", *_ST))
add("embedding_texts", lambda spark, sf: digest(docs(spark, sf).select(
    "doc_id", t.tc_text(F.when(F.col("lang") != "de", F.col("source")), F.when(F.col("lang") != "es", F.col("text"))).alias("tc"),
    t.commit_template(F.when(F.col("lang") != "fr", F.col("source")), F.when(F.col("lang") != "es", F.col("text"))).alias("cm")), "tc", "cm"),
    "WITH c AS (SELECT doc_id, CASE WHEN lang = 'de' AND text <> '' THEN 'Steps: ' || text WHEN lang = 'es' THEN 'Summary: ' || source "
    "ELSE 'Summary: ' || source || chr(10) || 'Steps: ' || text END AS tc, CASE WHEN lang = 'fr' THEN 'Diff:' || chr(10) || text WHEN lang = 'es' THEN "
    "'Commit Message: ' || source ELSE 'Commit Message: ' || source || chr(10) || chr(10) || 'Diff:' || chr(10) || text END AS cm FROM documents) "
    + digest_sql("c", "tc", "cm"))


def _profile_sql(source):
    at = lambda p: f"list_sort(list(length(text)))[least(floor(count(*) * {p} / 100.0::DOUBLE), count(*) - 1)::BIGINT + 1]"
    return sql_select(f"{source}", "", "count(*) AS count; min(length(text)) AS min; max(length(text)) AS max; " + "; ".join(
        f"{at(p)} AS {n}" for n, p in [("median", 50), ("p50", 50), ("p75", 75), ("p90", 90), ("p95", 95), ("p99", 99)])
        + "; sum((length(text) > 1840)::INT) AS exceeding", "avg(length(text)) AS mean; sum((length(text) > 1840)::INT) * 100.0::DOUBLE / count(*) AS exceeding_pct")


add("length_profile_documents", lambda spark, sf: shaped(x.length_profile(docs(spark, sf), "text")), _profile_sql("documents"))
add("length_profile_conversations", lambda spark, sf: shaped(x.length_profile(table(spark, sf, "conversations"), "text")), _profile_sql("conversations"))
add("commit_count", lambda spark, sf: shaped(raw_events(spark, sf).select("exec_id", t.commit_count(F.col("commits"), F.col("crs")).alias("count_commits"))),
    f"WITH {o.EV} SELECT exec_id, 1 + (k % 3 = 0)::INT::BIGINT AS count_commits FROM raw")
add("build_commit_count", lambda spark, sf: shaped(x.build_commit_count(raw_events(spark, sf)).drop("project")),
    f"WITH {o.EV}, c AS (SELECT build_id, 'k' || k AS c FROM raw UNION SELECT build_id, 'CR_CR_' || (k % 5) FROM raw WHERE k % 3 = 0) "
    "SELECT build_id, count(*) AS count_commits FROM c GROUP BY 1")


def length_encoder(texts):
    """A stand-in for a sentence model: characters, spaces, lines."""
    return np.array([[len(s), s.count(" "), s.count("\n") + 1] for s in texts], dtype=np.float32)


def _encoded(spark, sf):
    e = x.encode_distinct(table(spark, sf, "conversations"), "text", length_encoder)
    return e.select("conv_id", "turn", *[F.col("embedding")[i].cast("bigint").alias(f"v{i}") for i in range(3)])


add("encode_distinct", _encoded, "SELECT conv_id, turn, length(text) AS v0, length(text) - length(replace(text, ' ', '')) AS v1, "
    "length(text) - length(replace(text, chr(10), '')) + 1 AS v2 FROM conversations")
DIM = 16


def _hash_vec_sql(key):
    u = f"('0x' || substr(md5({key} || '|' || i || '|42'), 1, 8))::BIGINT / 2147483648.0::DOUBLE - 1"
    return f"list_transform(range(0, {DIM}), lambda i: {u})"


def _hash_embedding(spark, sf):
    e = docs(spark, sf).select("doc_id", x.hash_embedding(F.col("text"), DIM).alias("v"))
    return shaped(e.select("doc_id", *[F.col("v")[i].alias(f"v{i}") for i in range(DIM)]))


add("hash_embedding", _hash_embedding, f"WITH k AS (SELECT doc_id, md5(text) AS key FROM documents), r AS (SELECT doc_id, {_hash_vec_sql('key')} AS v FROM k), "
    "n AS (SELECT doc_id, v, sqrt(list_sum(list_transform(v, lambda z: z * z))) AS s FROM r) " + sql_select(
        "n", "", "doc_id", "; ".join(f"v[{i + 1}] / s AS v{i}" for i in range(DIM))))


def _commit_vector(spark, sf):
    raw = raw_events(spark, sf)
    vecs = raw.select(F.explode("commits").alias("commit")).distinct().withColumn("embedding", x.hash_embedding(F.col("commit"), DIM))
    v = build_commit_vector(raw, vecs, DIM)
    return shaped(v.select("build_id", *[F.col("commit_vector")[i].alias(f"v{i}") for i in range(DIM)]))


add("build_commit_vector", _commit_vector, f"WITH {o.EV}, c AS (SELECT DISTINCT build_id, 'k' || k AS c FROM raw), kk AS (SELECT DISTINCT c, md5(c) AS key FROM c), "
    f"r AS (SELECT c, {_hash_vec_sql('key')} AS v FROM kk), n AS (SELECT c, v, sqrt(list_sum(list_transform(v, lambda z: z * z))) AS s FROM r) "
    + sql_select("c JOIN n USING (c)", "build_id", "", "; ".join(f"avg(v[{i + 1}] / s) AS v{i}" for i in range(DIM))) + " GROUP BY build_id")
