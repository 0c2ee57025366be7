import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from flowloom.session import session

    s = session("local[4]", 4, **{"spark.driver.memory": "4g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.checkpoint.dir": f"file://{tmp_path_factory.mktemp('shared')}"})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    """A connection with the tables of a scale as views."""
    import glob

    import duckdb

    def connect(sf_dir):
        con = duckdb.connect()
        for p in glob.glob(f"{sf_dir}/*.parquet"):
            con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
        return con

    return connect


def rows_of(columns, rows):
    """Rows with columns by name, as text that can be compared."""
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    show = lambda x: "~" if x is None or x != x else f"{x:.9g}" if isinstance(x, float) else str(x)
    return sorted(tuple(show(r[i]) for i in order) for r in rows)
