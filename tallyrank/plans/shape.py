"""Same rounding and types on both sides of the comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def shaped(df: DataFrame, *columns: str) -> DataFrame:
    """Doubles to 6 places, every integer to bigint."""
    types = dict(df.dtypes)
    out = []
    for c in columns or df.columns:
        t = types[c]
        col = F.col(c)
        if t in ("double", "float") or t.startswith("decimal"):
            col = F.round(col.cast("double"), 6) + F.lit(0.0)
        elif t in ("int", "smallint", "tinyint", "bigint", "boolean"):
            col = col.cast("bigint")
        out.append(col.alias(c))
    return df.select(*out)


def sql_select(source: str, s: str = "", i: str = "", d: str = "", where: str = "") -> str:
    """A SELECT with strings, integers and doubles shaped like `shaped`.

    Items are separated by semicolons: a name, or `expression AS name`.
    """
    def parts(text):
        for item in filter(None, (x.strip() for x in text.split(";"))):
            expr, _, name = item.rpartition(" AS ")
            yield (expr or item), (name or item)

    cols = [f"{e} AS {n}" for e, n in parts(s)]
    cols += [f"CAST({e} AS BIGINT) AS {n}" for e, n in parts(i)]
    cols += [f"ROUND(CAST({e} AS DOUBLE), 6) + 0.0::DOUBLE AS {n}" for e, n in parts(d)]
    tail = f" WHERE {where}" if where else ""
    return f"SELECT {', '.join(cols)} FROM {source}{tail}"
