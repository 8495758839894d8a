import sys
from pathlib import Path

import pytest

sys.path[:0] = [str(Path(__file__).resolve().parents[1]), str(Path(__file__).resolve().parent)]

from tallyrank.session import local_session  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    s = local_session("tests", 4)
    s.conf.set("spark.sql.shuffle.partitions", "2")
    # tables are tiny here: compiling a plan costs more than interpreting it
    s.conf.set("spark.sql.codegen.wholeStage", "false")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf():
    return SF
