"""Samples, batches and edge splits drawn by hash, so every run draws the same."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyrank.functions.hashing import hash_int, uniform
from tallyrank.operators.clean import BUILD
from tallyrank.operators.graph import numbered_nodes
from tallyrank.operators.pairs import partitions
from tallyrank.operators.scale import number_rows, running_sums
from tallyrank.session import materialize

SCOPE = ["project"]
#: Bits of `hash_int`, and its leading ones that edges are counted by before a split.
HASH_BITS, BIN_BITS = 60, 16


def _shuffled(df: DataFrame, group: Sequence[str], key: Sequence[str], seed: int, name: str) -> DataFrame:
    h = hash_int(*[F.col(k) for k in key], seed)
    return number_rows(df.withColumn("_h", h), group, [F.col("_h"), *[F.col(k) for k in key]], name).drop("_h")


def balanced_sample(df: DataFrame, n: int, key: Sequence[str], w_min: float = 10.0, w_maj: float = 1.0,
                    seed: int = 42, label: str = "label") -> DataFrame:
    """n draws with replacement from all classes, rows weighted by class (the rarest weighs `w_min`).

    Rows of a class weigh the same, so a draw picks a class by weight and then a row
    number in it; rows are looked up by an equi-join, not by cumulative weight. Rows
    without a label are never drawn.
    """
    df = df.filter(F.col(label).isNotNull())
    counts = {r[label]: r["n"] for r in df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}
    classes = sorted(counts, key=lambda c: (counts[c], c))
    classes = classes[:1] + sorted(classes[1:])
    weights = [counts[c] * (w_min if i == 0 else w_maj) for i, c in enumerate(classes)]
    rows = _shuffled(df, [label], key, seed, "_no")
    draws = df.sparkSession.range(n if counts else 0).select(F.col("id").alias("draw"))
    u = uniform(F.col("draw"), "class", seed)
    bounds = [sum(weights[:i + 1]) / sum(weights) for i in range(len(classes))]
    pick, size = F.lit(classes[-1] if classes else None), F.lit(counts[classes[-1]] if classes else 1)
    for c, bound in list(zip(classes, bounds))[-2::-1]:
        pick, size = F.when(u < bound, F.lit(c)).otherwise(pick), F.when(u < bound, F.lit(counts[c])).otherwise(size)
    draws = draws.withColumns({label: pick.cast(dict(df.dtypes)[label]), "_no": F.pmod(hash_int(F.col("draw"), "row", seed), size) + 1})
    return draws.join(rows, [label, "_no"]).drop("_no")


def stratified_batches(df: DataFrame, size: int = 32, min_pos: int = 4, key: Sequence[str] = ("project", "build_id", "tc_key"),
                       seed: int = 42, label: str = "fail") -> DataFrame:
    """Batches of `size` rows with exactly `min_pos` failures. Failures are used once; the
    other rows follow each other in one order, over and over, from batch to batch, so that
    all are used alike. With fewer of them than a batch takes, each batch has all of them once."""
    min_pos = min(min_pos, size // 2)
    rest = size - min_pos
    rows = _shuffled(df.withColumn("_pos", (F.col(label) == 1).cast("int")), ["_pos"], key, seed, "_no")
    n = df.agg(F.sum((F.col(label) == 1).cast("bigint")).alias("_np"), F.sum((F.col(label) != 1).cast("bigint")).alias("_nn"))
    rows = rows.crossJoin(F.broadcast(n)).withColumn("_places", F.floor(F.col("_np") / min_pos) * rest)
    i = F.col("_no") - 1
    pos = rows.filter("_pos = 1").withColumn("batch", F.floor(i / min_pos)).filter(F.col("batch") * rest < F.col("_places"))
    turn = F.greatest(F.col("_nn"), F.lit(rest))
    neg = rows.filter("_pos = 0").withColumn("_i", i.cast("bigint")).filter("_i < _places")
    place = F.explode(F.sequence(F.col("_i"), (F.col("_places") - 1).cast("bigint"), turn.cast("bigint")))
    neg = neg.withColumn("_place", place).withColumn("batch", F.floor(F.col("_place") / rest))
    return pos.select(*df.columns, "batch").unionByName(neg.select(*df.columns, "batch"))


def build_batches(df: DataFrame, size: int = 32, min_fail: int = 1, seed: int = 42) -> DataFrame:
    """Whole builds in hash order packed one by one: a build that would take the batch above `size`
    rows starts the next one (a larger build has a batch of its own). Builds with fewer than
    `min_fail` failures are left out.

    Where a batch that starts with a build ends depends on that build alone, so every build points
    to the start that would follow. The starts are what the first build reaches; doubling the
    pointers finds them in as many rounds as their number has binary digits.
    """
    b = df.groupBy(*BUILD).agg(F.count(F.lit(1)).alias("_n"), F.sum("fail").alias("_f")).filter(F.col("_f") >= min_fail)
    b = b.withColumn("_h", hash_int(*[F.col(k) for k in BUILD], seed)).withColumn("_one", F.lit(1).cast("bigint"))
    cum = running_sums(b, [], [F.col("_h"), *[F.col(k) for k in BUILD]], {"_cum": "_n", "_pos": "_one"})
    cum = materialize(cum.select(*BUILD, "_n", "_cum", "_pos"), "builds")
    # builds that end at or before the last row that a batch from here may have
    ends = cum.select(F.col("_cum").alias("_at"), F.lit(1).alias("_end"), F.lit(0).cast("bigint").alias("_pos"))
    asks = cum.select((F.col("_cum") - F.col("_n") + size).alias("_at"), F.lit(0).alias("_end"), "_pos")
    seen = running_sums(ends.unionByName(asks), [], [F.col("_at"), F.desc("_end"), F.col("_pos")], {"_ended": "_end"})
    hops = seen.filter("_end = 0").select("_pos", F.greatest(F.col("_ended") + 1, F.col("_pos") + 1).alias("_to"))
    last = cum.agg(F.max("_pos")).first()[0] or 0
    doubled = [materialize(hops.filter(F.col("_to") <= last), "hops")]
    while not doubled[-1].isEmpty():
        step = doubled[-1].select(F.col("_pos").alias("_to"), F.col("_to").alias("_then"))
        doubled.append(materialize(doubled[-1].join(step, "_to").select("_pos", F.col("_then").alias("_to")), "hops"))
    starts = df.sparkSession.range(1, 2).select(F.col("id").alias("_pos"))
    for hop in reversed(doubled):
        starts = materialize(starts.unionByName(starts.join(hop, "_pos").select(F.col("_to").alias("_pos"))), "starts")
    marked = cum.join(starts.withColumn("_start", F.lit(1)), "_pos", "left").na.fill(0, ["_start"])
    batch = running_sums(marked, [], [F.col("_pos")], {"_batch": "_start"})
    return df.join(batch.select(*BUILD, (F.col("_batch") - 1).alias("batch")), BUILD)


def split_edges(edges: DataFrame, val: float = 0.1, test: float = 0.1, seed: int = 42) -> DataFrame:
    """`split` per edge: first share of a hash order is test, then validation, then train.

    Edges are counted by the leading digits of their hash, which tells on which side of both cuts an edge
    is, but for those with the same digits as a cut: only these few are put in order. Edges are made three
    times, and none is shuffled or stored but the few.
    """
    h = hash_int(F.col("src"), F.col("dst"), seed)
    rows = edges.withColumns({"_h": h, "_bin": F.coalesce(F.shiftright(h, HASH_BITS - BIN_BITS), F.lit(0)).cast("bigint")})
    bins = materialize(rows.groupBy(*SCOPE, "_bin").agg(F.count(F.lit(1)).alias("_c")), "bins")
    n = bins.groupBy(*SCOPE).agg(F.sum("_c").alias("_n"))
    upto = running_sums(bins, SCOPE, [F.col("_bin")], {"_upto": "_c"}).join(n, SCOPE)
    n_test, n_val = F.floor(F.col("_n") * F.lit(float(test))), F.floor(F.col("_n") * F.lit(float(val)))
    behind = lambda cut, what: F.min(F.when(F.col("_upto") > cut, F.struct("_bin", (F.col("_upto") - F.col("_c")).alias("_lo"))))[what]
    cuts = upto.groupBy(*SCOPE).agg(
        F.max(n_test).alias("_t"), F.max(n_test + n_val).alias("_v"),
        *[F.coalesce(behind(cut, "_bin"), F.lit(1 << BIN_BITS)).alias(f"_b{k}") for k, cut in ((1, n_test), (2, n_test + n_val))],
        *[behind(cut, "_lo").alias(f"_lo{k}") for k, cut in ((1, n_test), (2, n_test + n_val))])
    rows = rows.join(materialize(cuts, "cuts"), SCOPE)
    at_cut = (F.col("_bin") == F.col("_b1")) | (F.col("_bin") == F.col("_b2"))
    clear = F.when(F.col("_bin") < F.col("_b1"), "test").when(F.col("_bin") < F.col("_b2"), "val").otherwise("train")
    few = number_rows(materialize(rows.filter(at_cut), "cut"), [*SCOPE, "_bin"], [F.col("_h"), F.col("src"), F.col("dst")], "_no")
    no = F.col("_no") + F.when(F.col("_bin") == F.col("_b1"), F.col("_lo1")).otherwise(F.col("_lo2"))
    exact = F.when(no <= F.col("_t"), "test").when(no <= F.col("_v"), "val").otherwise("train")
    out = [*edges.columns, "split"]
    return rows.filter(~at_cut).withColumn("split", clear).select(out).unionByName(few.withColumn("split", exact).select(out))


def counted_up(rows: DataFrame, many: Column, name: str, at_once: int = 4096) -> DataFrame:
    """Every row `many` times, numbered from 0; no row becomes more than `at_once` in one place."""
    first = rows.withColumns({"_many": many.cast("bigint"), "_part": F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((many - 1) / at_once)))})
    first = first.filter("_many > 0").repartition(partitions(rows), *rows.columns, "_part")
    top = F.least(F.col("_many"), (F.col("_part") + 1) * at_once) - 1
    return first.withColumn(name, F.explode(F.sequence(F.col("_part") * at_once, top))).drop("_many", "_part")


def negative_edges(nodes: DataFrame, edges: DataFrame, n: int, seed: int = 42, node: str = "tc_key") -> DataFrame:
    """n uniform non-edges per project, or all there are, drawn without replacement. `edges` have
    src < dst, both among the nodes.

    Non-edges are numbered by their smaller node, then by the other one: a node has as many as there
    are nodes behind it, less its edges. Numbers are drawn by a keyed permutation (four rounds on two
    digits of base a, the root of their count rounded up), which leaves at most 2a + 1 numbers that are
    none, so n + 2a + 1 draws are always enough. A number is brought back to its node through buckets
    of numbers, and to the other node by counting the edges in between.
    """
    no = materialize(numbered_nodes(nodes, node), "numbered")
    size = no.groupBy(*SCOPE).agg(F.max("_no").alias("_v"))
    near = edges.select(*SCOPE, F.col("src").alias(node), "dst").distinct()
    near = near.join(no, [*SCOPE, node]).select(*SCOPE, F.col("_no").alias("_i"), F.col("dst").alias(node)).join(no, [*SCOPE, node])
    near = materialize(near.select(*SCOPE, "_i", F.col("_no").alias("_j")), "edges")
    mine = near.groupBy(*SCOPE, "_i").agg(F.count(F.lit(1)).alias("_e"))
    free = no.select(*SCOPE, F.col("_no").alias("_i")).join(size, SCOPE).join(mine, [*SCOPE, "_i"], "left")
    free = free.select(*SCOPE, "_i", (F.col("_v") - F.col("_i") - F.coalesce("_e", F.lit(0))).alias("_free")).filter("_free > 0")
    upto = running_sums(free, SCOPE, [F.col("_i")], {"_hi": "_free"})
    upto = materialize(upto.select(*SCOPE, "_i", (F.col("_hi") - F.col("_free")).alias("_lo"), "_hi"), "free")
    total = upto.groupBy(*SCOPE).agg(F.max("_hi").alias("_m"), F.count(F.lit(1)).alias("_with"))
    total = total.withColumns({"_a": F.ceil(F.sqrt(F.col("_m").cast("double"))), "_w": F.ceil(F.col("_m") / F.col("_with"))})
    draws = counted_up(total, F.least(F.lit(n) + 2 * F.col("_a") + 1, F.col("_a") * F.col("_a")), "_x")
    left, right = F.floor(F.col("_x") / F.col("_a")), F.col("_x") % F.col("_a")
    draws = draws.withColumns({"_l": left, "_r": right})
    for k in range(4):
        draws = draws.withColumns({"_l": F.col("_r"), "_r": (F.col("_l") + hash_int(F.col("_r"), k, seed) % F.col("_a")) % F.col("_a")})
    draws = draws.withColumn("_t", F.col("_l") * F.col("_a") + F.col("_r")).filter("_t < _m")
    draws = number_rows(draws.select(*SCOPE, "_x", "_t", "_w"), SCOPE, [F.col("_x")], "_k").filter(F.col("_k") <= n)
    bucket = F.floor(F.col("_t") / F.col("_w"))
    owners = upto.join(total.select(*SCOPE, "_w"), SCOPE).withColumn(
        "_b", F.explode(F.sequence(F.floor(F.col("_lo") / F.col("_w")), F.floor((F.col("_hi") - 1) / F.col("_w"))))).drop("_w")
    found = draws.withColumn("_b", bucket).join(owners, [*SCOPE, "_b"]).filter("_t >= _lo and _t < _hi").select(
        *SCOPE, "_k", "_i", (F.col("_t") - F.col("_lo")).alias("_o"))
    # the m-th edge of a node, at j, has j - i - m non-edges before it
    nth = number_rows(near, [*SCOPE, "_i"], [F.col("_j")], "_nth").select(*SCOPE, "_i", (F.col("_j") - F.col("_i") - F.col("_nth")).alias("_before"))
    passed = found.join(nth, [*SCOPE, "_i"]).filter("_before <= _o").groupBy(*SCOPE, "_k").agg(F.count(F.lit(1)).alias("_c"))
    found = found.join(passed, [*SCOPE, "_k"], "left").withColumn("_j", F.col("_i") + 1 + F.col("_o") + F.coalesce("_c", F.lit(0)))
    a = no.select(*SCOPE, F.col("_no").alias("_i"), F.col(node).alias("src"))
    b = no.select(*SCOPE, F.col("_no").alias("_j"), F.col(node).alias("dst"))
    return found.join(a, [*SCOPE, "_i"]).join(b, [*SCOPE, "_j"]).select(*SCOPE, "src", "dst")

