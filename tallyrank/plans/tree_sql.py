"""SQL twins of the histogram trees: the same cuts from grouped sums, one chain of tables a level."""

from __future__ import annotations

from collections.abc import Sequence

# fixed values of the trees
BINS = 32
DRAWN = (0.36787944, 0.73575888, 0.91969860, 0.98101184, 0.99634015, 0.99940582)
PRIME, GENERATOR = 2147483647, 48271
# end of fixed values


def binned_sql(train: str, test: str, features: Sequence[str], name: str) -> list[str]:
    """Long tables of bins of both sides: <name>_b and <name>_q with rid, f, bin."""
    lim = ", ".join(f"min({c}) AS l{i}, CASE WHEN max({c}) > min({c}) THEN max({c}) - min({c}) ELSE 1 END AS s{i}" for i, c in enumerate(features))
    bins = ", ".join(f"greatest(least(floor(({c} - l{i}) / s{i} * {BINS}.0::DOUBLE), {BINS - 1}), 0)::INT" for i, c in enumerate(features))
    side = lambda rows: (f"(SELECT rid, unnest(range({len(features)})) AS f, unnest([{bins}]) AS bin FROM {rows}, {name}_lim)")
    return [f"{name}_lim AS MATERIALIZED (SELECT {lim} FROM {train})", f"{name}_b AS MATERIALIZED {side(train)}", f"{name}_q AS MATERIALIZED {side(test)}"]


def _levels(name: str, start: str, probe: str, depth: int, smooth: float, least: float, allowed: str, bins: str) -> list[str]:
    """Grows the trees of `start` (rid, tree, g, h) and sends `probe` (rid, tree) down with them.
    Ends in <name>_leaf (tree, node, value) and <name>_p<depth> (rid, tree, node)."""
    s = f"{smooth!r}::DOUBLE"
    out = [f"{name}_a0 AS MATERIALIZED (SELECT rid, tree, g, h, 1 AS node FROM {start})", f"{name}_p0 AS MATERIALIZED (SELECT rid, tree, 1 AS node FROM {probe})"]
    for k in range(depth):
        out += [f"{name}_s{k} AS MATERIALIZED (SELECT tree, node, f, bin, sum(g) AS g, sum(h) AS h FROM {name}_a{k} JOIN {bins}_b USING (rid) WHERE node >= {1 << k} GROUP BY ALL)",
                f"""{name}_c{k} AS (SELECT *, sum(g) OVER c AS lg, sum(h) OVER c AS lh, sum(g) OVER a AS ag, sum(h) OVER a AS ah FROM {name}_s{k}
  WINDOW c AS (PARTITION BY tree, node, f ORDER BY bin), a AS (PARTITION BY tree, node, f))""",
                f"""{name}_n{k} AS MATERIALIZED (SELECT tree, node, f, bin FROM (SELECT *, row_number() OVER (PARTITION BY tree, node ORDER BY gain DESC, f, bin) AS r FROM (
  SELECT tree, node, f, bin, round(lg * lg / nullif(lh + {s}, 0) + (ag - lg) * (ag - lg) / nullif(ah - lh + {s}, 0) - ag * ag / nullif(ah + {s}, 0), 6) AS gain FROM {name}_c{k}
  WHERE lh >= {least - 1e-9!r}::DOUBLE AND ah - lh >= {least - 1e-9!r}::DOUBLE AND {allowed}) WHERE gain > 1e-6::DOUBLE) WHERE r = 1)"""]
        move = "CASE WHEN n.node IS NULL THEN a.node ELSE 2 * a.node + (b.bin > n.bin)::INT END AS node"
        for table, keep, of in (("a", "a.rid, a.tree, a.g, a.h", "b"), ("p", "a.rid, a.tree", "q")):
            out.append(f"{name}_{table}{k + 1} AS MATERIALIZED (SELECT {keep}, {move} FROM {name}_{table}{k} a LEFT JOIN {name}_n{k} n ON n.tree = a.tree AND n.node = a.node "
                       f"LEFT JOIN {bins}_{of} b ON b.rid = a.rid AND b.f = n.f)")
    out.append(f"{name}_leaf AS MATERIALIZED (SELECT tree, node, CASE WHEN sum(h) + {s} > 0 THEN sum(g) / (sum(h) + {s}) ELSE 0 END AS value FROM {name}_a{depth} GROUP BY ALL)")
    return out


def forest_sql(train: str, test: str, features: Sequence[str], name: str, n_trees: int = 50, depth: int = 4, least: float = 1.0) -> str:
    """CTEs ending in `name` (rid, p). `train` has rid, h31 (the row's hash), y and w, `test` has rid."""
    width = len(features)
    most = int(-(-(width ** 0.5) // 1))
    powers = ", ".join(f"({t}, {pow(GENERATOR, t + 1, PRIME)}::BIGINT)" for t in range(n_trees))
    drawn = " + ".join(f"(u >= {c!r}::DOUBLE)::INT" for c in DRAWN)
    out = [*binned_sql(train, test, features, name),
           f"{name}_pw AS (SELECT * FROM (VALUES {powers}) v(tree, a))",
           f"{name}_d AS (SELECT rid, tree, w * y * n AS g, w * n AS h FROM (SELECT rid, y, w, tree, {drawn} AS n FROM "
           f"(SELECT rid, y, w, tree, (h31 * a % {PRIME}) / {PRIME}.0::DOUBLE AS u FROM (SELECT rid, y, w, h31 % {PRIME} AS h31 FROM {train}), {name}_pw)))",
           f"{name}_t AS (SELECT rid, tree FROM {test}, {name}_pw)",
           f"{name}_ok AS MATERIALIZED (SELECT * FROM (SELECT tree, node, f, row_number() OVER (PARTITION BY tree, node ORDER BY md5(tree || '|' || node || '|' || f)) AS r FROM "
           f"{name}_pw, range(1, {1 << depth}) x(node), range({width}) y(f)) WHERE r <= {most})"]
    out += _levels(name, f"{name}_d", f"{name}_t", depth, 0.0, least, f"(tree, node, f) IN (SELECT (tree, node, f) FROM {name}_ok)", name)
    out.append(f"{name} AS MATERIALIZED (SELECT rid, sum(value) / {n_trees} AS p FROM {name}_p{depth} JOIN {name}_leaf USING (tree, node) GROUP BY rid)")
    return ",\n".join(out)


def boosted_sql(train: str, test: str, features: Sequence[str], name: str, rounds: int = 20, depth: int = 3, rate: float = 0.1, smooth: float = 1.0,
                least: float = 1.0, logistic: bool = True) -> str:
    """CTEs ending in `name` (rid, p). `train` has rid, y and w, `test` has rid."""
    mean = "sum(w * y) / sum(w)"
    base = f"ln(({mean}) / (1 - {mean}))" if logistic else mean
    p = "1 / (1 + exp(-f))"
    out = [*binned_sql(train, test, features, name), f"{name}_z AS MATERIALIZED (SELECT {base} AS base FROM {train})",
           f"{name}_f0 AS MATERIALIZED (SELECT rid, y, w, base AS f FROM {train}, {name}_z)", f"{name}_u0 AS MATERIALIZED (SELECT rid, base AS f FROM {test}, {name}_z)"]
    for r in range(rounds):
        part = f"{name}_{r}"
        grad = f"w * (y - {p}) AS g, w * {p} * (1 - {p}) AS h" if logistic else "w * (y - f) AS g, w AS h"
        out.append(f"{part}_d AS MATERIALIZED (SELECT rid, 0 AS tree, {grad} FROM {name}_f{r})")
        out.append(f"{part}_t AS (SELECT rid, 0 AS tree FROM {name}_u{r})")
        out += _levels(part, f"{part}_d", f"{part}_t", depth, smooth, least, "true", name)
        out.append(f"{name}_f{r + 1} AS MATERIALIZED (SELECT rid, y, w, f + {rate!r}::DOUBLE * value AS f FROM {name}_f{r} JOIN {part}_a{depth} USING (rid) JOIN {part}_leaf USING (tree, node))")
        out.append(f"{name}_u{r + 1} AS MATERIALIZED (SELECT rid, f + {rate!r}::DOUBLE * coalesce(value, 0) AS f FROM {name}_u{r} JOIN {part}_p{depth} USING (rid) LEFT JOIN {part}_leaf USING (tree, node))")
    out.append(f"{name} AS MATERIALIZED (SELECT rid, {p if logistic else 'f'} AS p FROM {name}_u{rounds})")
    return ",\n".join(out)
