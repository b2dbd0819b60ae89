import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from cuelattice.plans.session import session

    s = session(
        "tests", spark_master="local[4]", spark_ui_enabled="false", spark_sql_shuffle_partitions="4", spark_driver_memory="4g",
        spark_ui_showConsoleProgress="false", spark_checkpoint_dir=str(tmp_path_factory.mktemp("checkpoints")),
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


@pytest.fixture(scope="session")
def data():
    return DATA


def plain(x):
    if x is None or isinstance(x, float) and x != x:
        return None
    if isinstance(x, float):
        return round(x, 6)
    if hasattr(x, "tolist"):
        return plain(x.tolist())
    if isinstance(x, list):
        return [plain(y) for y in x]
    return x


def rows_of(frame):
    cols = sorted(frame.columns)
    return cols, sorted(repr(tuple(map(plain, r))) for r in frame[cols].astype(object).itertuples(index=False))


@pytest.fixture(scope="session")
def same():
    def check(df, duck, sql):
        got, want = rows_of(df.toPandas()), rows_of(duck.sql(sql).df())
        assert got[0] == want[0]
        assert got[1] == want[1]

    return check
