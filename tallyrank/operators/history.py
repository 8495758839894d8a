"""Running history of every test, read strictly before the current build.

Input: one row per (project, build, test) with `build_idx`, `verdict`, `fail`,
`result`, `duration`.

Windows run per test, and as there is one row per build, a test has at most as many
rows as the clock has ticks. While the clock is shorter than `segment`, that is the
bound on a task's group. Beyond it, tests with more than `segment` executions are cut
into clock segments of that length, so a group stays bounded whatever the skew. What a
segment needs from the past is small: the last `TAIL` executions before it, the newest
of which carries the totals of everything before. They come from one summary row per
(test, segment) and are added to the segment as extra rows, so the same window pass
sees the right past; only the segment's own rows are returned.

Run lengths need no islands: the current failure run is the number of executions so
far minus the position of the last execution that did not fail.

The decayed rate sums weights relative to the start of a short stretch of the clock
(`600 / alpha` ticks, so no exponent overflows) and adds the stretch before it; older
ones weigh less than the smallest double.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

TEST = ["project", "tc_key"]
SEGMENT = 1 << 20
TAIL = 21
MAX_EXPONENT = 600.0

# running totals: name -> value of one execution
_SUMS = {
    "n": lambda: F.lit(1),
    "failures": lambda: F.col("fail"),
    "exact_failures": lambda: (F.col("verdict") == 1).cast("int"),
    "exact_passes": lambda: (F.col("verdict") == 0).cast("int"),
    "flips": lambda: F.col("_flip"),
    "exact_flips": lambda: F.col("_xflip"),
    "duration_sum": lambda: F.col("duration"),
}
# running maxima of the clock or of a value
_MAXES = {
    "last_idx": lambda: F.col("build_idx"),
    "last_fail_idx": lambda: F.when(F.col("fail") == 1, F.col("build_idx")),
    "last_pass_idx": lambda: F.when(F.col("fail") == 0, F.col("build_idx")),
    "last_exact_fail_idx": lambda: F.when(F.col("verdict") == 1, F.col("build_idx")),
    "last_exact_pass_idx": lambda: F.when(F.col("verdict") == 0, F.col("build_idx")),
    "max_duration": lambda: F.col("duration"),
}
# positions of the last row of a kind, counted among `among` rows; used for run lengths
_RUNS = {
    "fail_run": ("n", "fail = 0", "fail = 1", "true"),
    "pass_run": ("n", "fail = 1", "fail = 0", "true"),
    "exact_fail_run": ("exact_n", "verdict = 0", "verdict = 1", "verdict < 2"),
    "exact_pass_run": ("exact_n", "verdict = 1", "verdict = 0", "verdict < 2"),
}


def _stretch(alpha: float) -> int:
    """Ticks after which a weight is zero in double precision."""
    return max(1, int(MAX_EXPONENT / alpha))


def _hot_tests(df: DataFrame, segment: int, limit: int) -> DataFrame | None:
    """Tests with more executions than the limit on a clock longer than a segment, or None."""
    top = df.agg(F.max("build_idx")).first()[0]
    if top is None or top < segment:
        return None
    hot = (
        df.groupBy(*TEST).agg(F.count(F.lit(1)).alias("_n"))
        .filter(F.col("_n") > limit).select(*TEST)
    )
    return None if hot.isEmpty() else hot


def _orders():
    """One sort serves both: a whole segment, and a stretch of the clock inside it."""
    by_segment = Window.partitionBy(*TEST, "_seg").orderBy("_stretch", "build_idx")
    by_stretch = Window.partitionBy(*TEST, "_seg", "_stretch").orderBy("build_idx")
    return by_segment, by_stretch


def _decay_parts(rows: DataFrame, alpha: float, own: Column | None = None) -> DataFrame:
    """Adds `_full_*`: decayed sums up to and including the row, as seen from the row."""
    w, ws = _orders()
    upto = ws.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rel = F.lit(float(alpha)) * (F.col("build_idx") - F.col("_stretch") * _stretch(alpha))
    rows = rows.withColumn("_lag_b", F.lag("build_idx").over(w))
    sums = {
        "_in_fail": F.sum(F.exp(rel) * F.col("fail")).over(upto) * F.exp(-rel),
        "_in_all": F.sum(F.exp(rel)).over(upto) * F.exp(-rel),
    }
    if own is not None:
        sums = {
            "_in_fail": F.when(own, sums["_in_fail"]).otherwise(F.col("c__d_fail")),
            "_in_all": F.when(own, sums["_in_all"]).otherwise(F.col("c__d_all")),
        }
    rows = rows.withColumns(sums)
    rows = rows.withColumns({f"_lag_{c}": F.lag(f"_in_{c}").over(w) for c in ("fail", "all")})
    past = {c: F.first(f"_lag_{c}").over(upto) for c in ("fail", "all")}
    past_b = F.first("_lag_b").over(upto)
    full = {
        f"_full_{c}": F.col(f"_in_{c}") + _fade(past[c], alpha, past_b, F.col("build_idx"))
        for c in ("fail", "all")
    }
    if own is not None:
        full = {k: F.when(own, v).otherwise(F.col(k.replace("_full", "_in"))) for k, v in full.items()}
    return rows.withColumns(full)


def _fade(total: Column, alpha: float, frm: Column, to: Column) -> Column:
    return F.coalesce(total * F.exp(F.lit(float(alpha)) * (frm - to)), F.lit(0.0))


def _summaries(seg: DataFrame, alpha: float, extra: Sequence[str]) -> DataFrame:
    """One row per (test, segment)."""
    w, _ = _orders()
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy(*TEST, "_seg")
    rows = _decay_parts(seg, alpha)
    rows = rows.withColumns({
        "_flip": F.coalesce((F.col("fail") != F.lag("fail").over(w)).cast("int"), F.lit(0)),
        "_pos_n": F.row_number().over(w),
        "_size": F.count(F.lit(1)).over(whole),
        "_isx": (F.col("verdict") < 2).cast("int"),
    })
    both = (F.col("_isx") == 1) & (F.lag("_isx").over(w) == 1)
    rows = rows.withColumns({
        "_pos_exact_n": F.sum("_isx").over(upto),
        "_xflip": F.coalesce((both & (F.col("verdict") != F.lag("verdict").over(w))).cast("int"), F.lit(0)),
    })
    prior = w.rowsBetween(Window.unboundedPreceding, -1)
    for run, (counter, stop, hit, _) in _RUNS.items():
        pos = F.col(f"_pos_{counter}")
        rows = rows.withColumn(f"_stop_{run}", F.max(F.when(F.expr(stop), pos)).over(prior))
        rows = rows.withColumn(
            f"_len_{run}",
            F.when(F.expr(hit), pos - F.coalesce(F.col(f"_stop_{run}"), F.lit(0))).otherwise(0),
        )
    aggs = [F.sum(v()).alias(k) for k, v in _SUMS.items()]
    aggs += [F.max(v()).alias(k) for k, v in _MAXES.items()]
    aggs += [F.sum(c).alias(f"sum_{c}") for c in extra]
    aggs += [
        F.min("build_idx").alias("first_idx"),
        F.sum("_isx").alias("exact_n"),
        F.min_by("fail", "build_idx").alias("_head_fail"),
        F.max_by("fail", "build_idx").alias("_tail_fail"),
        F.min_by("verdict", "build_idx").alias("_head_v"),
        F.max_by("verdict", "build_idx").alias("_tail_v"),
        F.min_by("fail", "build_idx").alias("first_fail"),
        F.min_by("verdict", "build_idx").alias("first_verdict"),
        F.max_by("_full_fail", "build_idx").alias("_end_fail"),
        F.max_by("_full_all", "build_idx").alias("_end_all"),
        F.array_sort(F.collect_list(F.when(
            F.col("_pos_n") > F.col("_size") - TAIL,
            F.struct("build_idx", "fail", "verdict", "result", "duration"),
        ))).alias("_tail"),
    ]
    for run, (counter, stop, _, among) in _RUNS.items():
        pos = F.col(f"_pos_{counter}")
        aggs += [
            F.max(F.when(F.expr(stop), pos)).alias(f"_last_{run}"),
            F.coalesce(
                F.min(F.when(F.expr(stop), pos)) - 1,
                F.sum(F.expr(among).cast("int")),
            ).alias(f"_head_{run}"),
            F.max(f"_len_{run}").alias(f"_max_{run}"),
        ]
    return rows.groupBy(*TEST, "_seg").agg(*aggs)


def _carries(summary: DataFrame, alpha: float, extra: Sequence[str]) -> DataFrame:
    """What holds before each segment. At most clock / segment rows per test."""
    order = Window.partitionBy(*TEST).orderBy("_seg")
    past = order.rowsBetween(Window.unboundedPreceding, -1)
    s = summary.withColumns({
        "_edge": F.coalesce((F.col("_head_fail") != F.lag("_tail_fail").over(order)).cast("int"), F.lit(0)),
        "_xedge": F.coalesce(
            ((F.col("_head_v") + F.lag("_tail_v").over(order)) == 1).cast("int"), F.lit(0)
        ),
    })
    s = s.withColumns({"flips": F.col("flips") + F.col("_edge"),
                       "exact_flips": F.col("exact_flips") + F.col("_xedge")})
    before = {k: F.coalesce(F.sum(k).over(past), F.lit(0)) for k in [*_SUMS, "exact_n"]}
    before |= {f"sum_{c}": F.coalesce(F.sum(f"sum_{c}").over(past), F.lit(0)) for c in extra}
    before |= {k: F.max(k).over(past) for k in _MAXES}
    s = s.select(
        *TEST, "_seg",
        *[F.col(c) for c in s.columns if c.startswith("_") and c != "_seg"],
        F.col("last_idx").alias("_seg_last"),
        *[v.alias(k) for k, v in before.items()],
        F.min("first_idx").over(past).alias("first_idx"),
        F.first("first_fail").over(past).alias("first_fail"),
        F.first("first_verdict").over(past).alias("first_verdict"),
    )
    for run, (counter, *_rest) in _RUNS.items():
        s = s.withColumn(
            f"stop_{run}", F.max(F.col(counter) + F.col(f"_last_{run}")).over(past)
        )
        open_run = F.col(counter) - F.coalesce(F.col(f"stop_{run}"), F.lit(0))
        through = F.when(F.col(f"_head_{run}") > 0, open_run + F.col(f"_head_{run}")).otherwise(0)
        s = s.withColumn(
            f"max_{run}", F.max(F.greatest(F.col(f"_max_{run}"), through)).over(past)
        )
    # decayed sums as seen from the last execution before the segment; a segment is at
    # least one stretch long, so two back are enough
    recent = F.collect_list(
        F.struct("_seg_last", "_end_fail", "_end_all")
    ).over(order.rowsBetween(-2, -1))

    def decayed(field: str) -> Column:
        return F.aggregate(
            recent, F.lit(0.0),
            lambda acc, x: acc + x[field] * F.exp(
                F.lit(float(alpha)) * (x["_seg_last"] - F.col("last_idx"))
            ),
        )

    tails = F.flatten(F.collect_list("_tail").over(order.rowsBetween(-TAIL, -1)))
    s = s.withColumns({
        "_d_fail": decayed("_end_fail"), "_d_all": decayed("_end_all"),
        "_tails": F.slice(tails, F.greatest(F.size(tails) - TAIL + 1, F.lit(1)), TAIL),
    })
    return s.filter(F.col("n") > 0)


def history(df: DataFrame, alpha: float = 0.1, segment: int | None = None, hot_rows: int | None = None,
            sums: Sequence[str] = (), rates: Sequence[int] = (2, 3, 5, 10, 20),
            lags: Sequence[int] = (1, 2, 3, 4, 5, 6, 7, 8, 9, 10),
            want: Sequence[str] | None = None) -> DataFrame:
    """Input rows plus history columns, all null or 0 where the test has no past.

    n, failures, exact_failures, exact_passes, flips, exact_flips, duration_sum,
    first_idx, last_idx, last_fail_idx, last_pass_idx (and exact_ forms), max_duration,
    fail_run, pass_run, exact_fail_run, exact_pass_run, their max_ forms,
    first_verdict, decayed_rate, rate_<k>, fail_<k>, verdict_<k>, last_duration,
    raw_flips_10, fail_flips_5, recent_fails_11, sum_<c>. `want` names the ones to build.
    """
    step = _stretch(alpha)
    seg_len = -(-(segment or SEGMENT) // step) * step
    hot = _hot_tests(df, seg_len, hot_rows or seg_len)
    names = list(want) if want is not None else _output_names(sums, rates, lags)
    need = _closure(names)
    carried = [*_SUMS, "exact_n", *[f"sum_{c}" for c in sums], *_MAXES, "first_idx", "first_fail",
               "first_verdict", *[f"stop_{r}" for r in _RUNS], *[f"max_{r}" for r in _RUNS],
               "_d_fail", "_d_all"]
    carried = [c for c in carried if c in need]
    rows = df.withColumns({
        "_stretch": F.floor(F.col("build_idx") / step).cast("bigint"), "_own": F.lit(True),
    })
    if hot is None:
        rows = rows.withColumn("_seg", F.lit(0).cast("bigint"))
    else:
        seg = F.when(F.col("_hot"), F.floor(F.col("build_idx") / seg_len)).otherwise(0).cast("bigint")
        rows = rows.join(hot.withColumn("_hot", F.lit(True)), TEST, "left").withColumn("_seg", seg)
        split = rows.filter("_hot")
        carry = _carries(_summaries(split, alpha, sums), alpha, sums)
        tail = carry.select(*TEST, "_seg", *carried, F.posexplode("_tails").alias("_i", "_t"),
                            (F.size("_tails") - 1).alias("_newest"))
        newest = F.col("_i") == F.col("_newest")
        tail = tail.select(
            *TEST, "_seg", F.lit(False).alias("_own"),
            F.floor(F.col("_t.build_idx") / step).cast("bigint").alias("_stretch"),
            *[F.col(f"_t.{c}").alias(c) for c in ("build_idx", "fail", "verdict", "result", "duration")],
            *[F.when(newest, F.col(c).cast(_type(c, sums))).alias(f"c_{c}") for c in carried],
        )
        rows = rows.drop("_hot").unionByName(tail, allowMissingColumns=True)
    if hot is None:
        rows = rows.withColumns({f"c_{c}": F.lit(None).cast(_type(c, sums)) for c in carried})
    out = _window_pass(rows, alpha, sums, rates, lags, need)
    return out.filter("_own").select(*df.columns, *names)


def _closure(names: Sequence[str]) -> set[str]:
    """The wanted columns and those they are computed from."""
    need = set(names)
    for run, (counter, *_rest) in _RUNS.items():
        if f"max_{run}" in need:
            need.add(run)
        if run in need:
            need |= {counter, f"stop_{run}"}
    if "decayed_rate" in need:
        need |= {"_d_fail", "_d_all"}
    return need


def _type(name: str, sums: Sequence[str]) -> str:
    return "double" if _is_double(name, sums) else "bigint"


def _is_double(name: str, sums: Sequence[str]) -> bool:
    return name in ("duration_sum", "max_duration", "_d_fail", "_d_all") or name.startswith("sum_")


def _output_names(sums, rates, lags) -> list[str]:
    return [*_SUMS, "exact_n", *_MAXES, "first_idx", "first_fail", "first_verdict",
            *_RUNS, *[f"max_{r}" for r in _RUNS], "decayed_rate", *[f"rate_{k}" for k in rates],
            *[f"exact_rate_{k}" for k in rates], *[f"fail_{k}" for k in lags],
            *[f"verdict_{k}" for k in lags], "last_duration", "raw_flips_10", "fail_flips_5",
            "recent_fails_11", *[f"sum_{c}" for c in sums]]


def _window_pass(rows, alpha, sums, rates, lags, need) -> DataFrame:
    w, _ = _orders()
    past = w.rowsBetween(Window.unboundedPreceding, -1)
    own = F.col("_own")

    def last_n(k):
        return w.rowsBetween(-k, -1)

    def own_or_carried(value: Column, name: str) -> Column:
        return F.when(own, value).otherwise(F.col(f"c_{name}"))

    exact = F.when(F.col("verdict") < 2, F.col("verdict"))
    changed = {}
    if need & {"flips", "fail_flips_5"}:
        changed["_flip"] = F.col("fail") != F.lag("fail").over(w)
    if "exact_flips" in need:
        changed["_xflip"] = (F.col("verdict") + F.lag("verdict").over(w)) == 1
    if "raw_flips_10" in need:
        changed["_rflip"] = F.col("result") != F.lag("result").over(w)
    if changed:
        rows = rows.withColumns({k: F.coalesce(v.cast("int"), F.lit(0)) for k, v in changed.items()})
    if "decayed_rate" in need:
        rows = _decay_parts(rows, alpha, own)

    zero = F.lit(0)
    totals = {k: v for k, v in _SUMS.items()} | {"exact_n": lambda: (F.col("verdict") < 2).cast("int")}
    totals |= {f"sum_{c}": (lambda c=c: F.col(c)) for c in sums}
    build = {k: (lambda k=k, v=v: F.coalesce(F.sum(own_or_carried(v(), k)).over(past), zero))
             for k, v in totals.items()}
    build |= {k: (lambda k=k, v=v: F.max(own_or_carried(v(), k)).over(past)) for k, v in _MAXES.items()}
    build["first_idx"] = lambda: F.min(own_or_carried(F.col("build_idx"), "first_idx")).over(past)
    build["first_fail"] = lambda: F.first(own_or_carried(F.col("fail"), "first_fail"), True).over(past)
    build["first_verdict"] = lambda: F.first(own_or_carried(F.col("verdict"), "first_verdict"), True).over(past)
    build["decayed_rate"] = lambda: F.lag("_full_fail").over(w) / F.lag("_full_all").over(w)
    build |= {f"rate_{k}": (lambda k=k: F.avg("fail").over(last_n(k))) for k in rates}
    build |= {f"exact_rate_{k}": (lambda k=k: F.avg(exact).over(last_n(k))) for k in rates}
    build |= {f"fail_{k}": (lambda k=k: F.lag("fail", k).over(w)) for k in lags}
    build |= {f"verdict_{k}": (lambda k=k: F.lag("verdict", k).over(w)) for k in lags}
    build["last_duration"] = lambda: F.lag("duration").over(w)
    build["raw_flips_10"] = lambda: F.coalesce(F.sum("_rflip").over(last_n(9)), zero)
    build["fail_flips_5"] = lambda: F.coalesce(F.sum("_flip").over(last_n(4)), zero)
    build["recent_fails_11"] = lambda: F.coalesce(F.sum("fail").over(last_n(11)), zero)
    rows = rows.withColumns({k: v() for k, v in build.items() if k in need})

    # run lengths need the position just computed, in the same partitioning and order
    runs = {r: spec for r, spec in _RUNS.items() if r in need}
    if runs:
        rows = rows.withColumns({
            f"_stop_{r}": F.coalesce(
                F.max(own_or_carried(F.when(F.expr(stop), F.col(counter) + 1), f"stop_{r}")).over(past), zero)
            for r, (counter, stop, _, _) in runs.items()
        })
        rows = rows.withColumns({r: F.col(c) - F.col(f"_stop_{r}") for r, (c, *_x) in runs.items()})
    peaks = {
        f"max_{r}": F.coalesce(
            F.max(own_or_carried(F.when(F.expr(hit), F.col(r) + 1).otherwise(0), f"max_{r}")).over(past), zero)
        for r, (_, _, hit, _) in runs.items() if f"max_{r}" in need
    }
    return rows.withColumns(peaks) if peaks else rows


def snapshot(df: DataFrame, want: Sequence[str] | None = None, **options) -> DataFrame:
    """History of each test after its last execution: one row per test.

    It is the look-back history of one more, empty execution.
    """
    last = df.groupBy(*TEST).agg(F.max("build_idx").alias("_hi"))
    probe = last.select(*TEST, (F.col("_hi") + 1).alias("build_idx"), F.lit(True).alias("_probe"))
    both = df.withColumn("_probe", F.lit(False)).unionByName(probe, allowMissingColumns=True)
    hist = history(both, want=want, **options)
    names = [c for c in hist.columns if c not in both.columns]
    return hist.filter("_probe").select(*TEST, *names)
