import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from logweave.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "local[4]", 4, **{"spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "4g"}
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def logs(spark):
    """Build a small log table from keyword rows."""
    import datetime as dt

    from logweave import schema

    def build(*rows, start=dt.datetime(2024, 3, 1, tzinfo=dt.timezone.utc)):
        full = []
        for i, row in enumerate(rows):
            base = {f.name: None for f in schema.LOGS.fields}
            base.update(
                id=i + 1,
                timestamp=start + dt.timedelta(seconds=i),
                hostname="h",
                severity="info",
                message="m",
                parsed_fields={},
                matched_parsers=[],
            )
            base.update(row)
            full.append(tuple(base[f.name] for f in schema.LOGS.fields))
        return spark.createDataFrame(full, schema.LOGS)

    return build
