from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from patchloom import build_session  # noqa: E402


# Column expressions at module level need a running session.
SESSION = build_session(
    "tests",
    "local[4]",
    **{
        "spark.sql.shuffle.partitions": "4",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "6g",
    },
)
SESSION.sparkContext.setLogLevel("ERROR")


@pytest.fixture(scope="session")
def spark():
    return SESSION


@pytest.fixture
def one(spark):
    """Evaluate column expressions over a one-row frame of literal texts."""

    def run(expression, **values):
        ddl = ", ".join(f"{k} STRING" for k in values) or "x STRING"
        row = tuple(values.values()) or ("",)
        return spark.createDataFrame([row], ddl).select(expression.alias("out")).first().out

    return run
