"""SQL twins of fitted models: other methods that come to the same optimum."""

from __future__ import annotations

from collections.abc import Sequence


def logistic_sql(rows: str, features: Sequence[str], name: str = "fit", ridge: float = 0.01, steps: int = 700) -> str:
    """CTEs ending in `name`, one row with weights b0.. on the raw features and the offset `b`.
    `rows` has the features, y and w. Gradient steps with constant momentum on standardised features;
    a step is one over a bound of the largest curvature: a quarter of the trace, plus the ridge."""
    d, every = len(features), range(len(features) + 1)
    col = lambda text: ", ".join(text.replace("#", str(i)) for i in every)
    stats = ", ".join(f"avg({f}) AS m{i}, CASE WHEN stddev_pop({f}) > 1e-12::DOUBLE THEN stddev_pop({f}) ELSE 1 END AS s{i}" for i, f in enumerate(features))
    std = ", ".join(f"({f} - m{i}) / s{i} AS z{i}" for i, f in enumerate(features))
    trace = " + ".join([f"sum(w * z{i} * z{i})" for i in range(d)] + ["sum(w)"])
    lin = " + ".join([f"z{i} * v{i}" for i in range(d)] + [f"v{d}"])
    slope = lambda i: f"sum(r * z{i}) / max(total) + {ridge!r}::DOUBLE * max(v{i})" if i < d else "sum(r) / max(total)"
    moved = ", ".join(f"max(v{i}) - ({slope(i)}) / max(top) AS n{i}" for i in every)
    raw = ", ".join(f"b{i} / s{i} AS b{i}" for i in range(d))
    offset = " - ".join([f"b{d}", *[f"b{i} / s{i} * m{i}" for i in range(d)]])
    return f"""{name}_s AS (SELECT {stats} FROM {rows}),
{name}_z AS MATERIALIZED (SELECT {std}, y, w FROM {rows}, {name}_s),
{name}_t AS MATERIALIZED (SELECT sum(w) AS total, ({trace}) / sum(w) / 4 + {ridge!r}::DOUBLE AS top FROM {name}_z),
{name}_it AS (
  SELECT 0 AS k, {col("0.0::DOUBLE AS b#")}, {col("0.0::DOUBLE AS v#")}
  UNION ALL
  SELECT k + 1, {col("n# AS b#")}, {col(f"n# + (sqrt(top) - sqrt({ridge!r}::DOUBLE)) / (sqrt(top) + sqrt({ridge!r}::DOUBLE)) * (n# - o#) AS v#")} FROM (
    SELECT max(k) AS k, max(top) AS top, {col("max(b#) AS o#")}, {moved} FROM (
      SELECT *, w * (1 / (1 + exp(-({lin}))) - y) AS r FROM {name}_z, {name}_it, {name}_t WHERE k < {steps}) HAVING max(k) IS NOT NULL)),
{name} AS (SELECT {raw}, {offset} AS b FROM {name}_it, {name}_s WHERE k = {steps})"""


def ridge_sql(rows: str, features: Sequence[str], targets: Sequence[str], name: str = "fit", ridge: float = 0.1) -> str:
    """CTEs ending in `name`, one row with weights w<target>_<feature> and offsets o<target>.
    Conjugate gradients on the correlation matrix, a target at a time."""
    d, all_ = len(features), [*features, *targets]
    dev = ", ".join(f"avg({c}) AS m{i}, CASE WHEN stddev_pop({c}) > 1e-9::DOUBLE THEN stddev_pop({c}) ELSE 1 END AS s{i}" for i, c in enumerate(all_))
    std = ", ".join(f"({c} - m{i}) / s{i} AS a{i}" for i, c in enumerate(all_))
    gram = "[" + ", ".join("[" + ", ".join(f"avg(a{i} * a{j})" + (f" + {ridge!r}::DOUBLE" if i == j else "") for j in range(d)) + "]" for i in range(d)) + "]"
    out = [f"{name}_s AS (SELECT {dev} FROM {rows})", f"{name}_a AS (SELECT {std} FROM {rows}, {name}_s)"]
    times = "list_transform(g, lambda q: list_dot_product(q, p))"
    add = lambda x, c, y: f"list_transform(list_zip({x}, {y}), lambda q: q[1] + ({c}) * q[2])"
    for t in range(len(targets)):
        c = "[" + ", ".join(f"avg(a{i} * a{d + t})" for i in range(d)) + "]"
        out += [f"{name}_g{t} AS (SELECT {gram} AS g, {c} AS c FROM {name}_a)",
                f"""{name}_c{t} AS (
  SELECT 0 AS k, g, list_transform(c, lambda q: 0.0::DOUBLE) AS x, c AS r, c AS p FROM {name}_g{t}
  UNION ALL
  SELECT k + 1, g, nx, nr, {add('nr', 'list_dot_product(nr, nr) / rr', 'p')} FROM (
    SELECT k, g, p, rr, {add('x', 'al', 'p')} AS nx, {add('r', '-al', 'gp')} AS nr FROM (
      SELECT k, g, x, r, p, gp, rr, rr / list_dot_product(p, gp) AS al FROM (
        SELECT k, g, x, r, p, {times} AS gp, list_dot_product(r, r) AS rr FROM {name}_c{t} WHERE k < {3 * d} AND list_dot_product(r, r) > 1e-28::DOUBLE))))""",
                f"{name}_x{t} AS (SELECT arg_max(x, k) AS x FROM {name}_c{t})"]
    weights = [f"x{t}.x[{i + 1}] * s{d + t} / s{i} AS w{t}_{i}" for t in range(len(targets)) for i in range(d)]
    offsets = [f"m{d + t}" + "".join(f" - x{t}.x[{i + 1}] * s{d + t} / s{i} * m{i}" for i in range(d)) + f" AS o{t}" for t in range(len(targets))]
    out.append(f"{name} AS (SELECT {', '.join(weights + offsets)} FROM {name}_s, " + ", ".join(f"{name}_x{t} AS x{t}" for t in range(len(targets))) + ")")
    return ",\n".join(out)
