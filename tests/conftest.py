import pathlib
import sys

import pytest

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))

from coursebank.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", "local[8]", 8)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def col(spark):
    """Evaluate Column functions over literal rows: col(fn, [(args), ...]) -> list of results."""
    from pyspark.sql import functions as F

    def run(fn, rows, types=None):
        rows = [r if isinstance(r, tuple) else (r,) for r in rows]
        names = [f"c{i}" for i in range(len(rows[0]))]
        schema = ", ".join(f"{n} {t}" for n, t in zip(names, types or ["string"] * len(names)))
        df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"i int, {schema}")
        out = df.select("i", fn(*[F.col(n) for n in names]).alias("v")).collect()
        return [r.v for r in sorted(out, key=lambda r: r.i)]

    return run
