import datetime
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from filingscope.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "tests", "local[8]", **{
            "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false",
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
        })
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def day():
    return lambda text: datetime.date.fromisoformat(text)


@pytest.fixture(scope="session")
def rows(spark):
    """rows("a INT, b DATE", [...]) with ISO strings accepted for dates."""

    def make(schema, data):
        fields = [f.strip().rsplit(" ", 1) for f in schema.split(",")]
        fixed = [
            tuple(datetime.date.fromisoformat(v) if k.upper() == "DATE" and isinstance(v, str) else v for v, (_, k) in zip(r, fields))
            for r in data
        ]
        return spark.createDataFrame(fixed, schema)

    return make


@pytest.fixture(scope="session")
def got():
    """got(df, "key", "col", ...) -> {key: value or tuple}."""

    def collect(df, key, *cols):
        out = {}
        for r in df.select(key, *cols).collect():
            out[r[0]] = r[1] if len(cols) == 1 else tuple(r[1:])
        return out

    return collect
