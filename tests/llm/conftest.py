import sys
from pathlib import Path

import pytest

sys.path[:0] = [str(Path(__file__).resolve().parents[2])]

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def docs(spark):
    """The smallest documents with what real tables have besides: copies, near copies, shared
    passages, empty and null texts, null columns, a long text, and a repeated row."""
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    base = [r for r in rows if len(r[1].split()) > 120][:4]
    words = base[0][1].split()
    passage = " ".join(words[10:60])
    near = base[1][1].split()
    extra = [
        (9001, None, "en", "src0", 0), (9002, "", "en", None, 0), (9003, " \n\t ", None, "src0", 4), (None, "no id at all here", None, None, None),
        (9004, "own start of this text " + passage + " and an end", "en", "src1", 1), (9005, "x " * 20000, "en", "src1", 40000),
        (9006, base[1][1], "fr", "src2", 5), (9007, " ".join(near[:50] + ["changed"] + near[51:]), "fr", "src2", 5),
        (9008, "short text", "en", "src3", 10), (9009, "short text", "en", "src3", 10), (9009, "short text", "en", "src3", 10),
        (9010, "Ünïcode ’quotes’ and wide space \U0001f600 end", "en", "src4", 9),
    ]
    return spark.createDataFrame(rows + extra, SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def clashing(docs):
    """More columns, named like those that operators make."""
    from pyspark.sql import functions as F

    names = ("key", "cid", "root", "stats", "score", "size", "node", "shard", "chunk", "_row", "_k", "_key", "_text", "_doc", "y", "x0", "cell")
    return docs.select("*", *[F.lit("taken").alias(n) for n in names])
