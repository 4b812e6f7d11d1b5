import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from lumenfold.session import get_session  # noqa: E402

DATA = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    session = get_session(
        "local[4]",
        4,
        spark__driver__memory="3g",
        spark__ui__showConsoleProgress="false",
        spark__sql__adaptive__coalescePartitions__enabled="true",
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def data_dir():
    if not DATA.exists():
        pytest.skip("no test data")
    return str(DATA)


def rows_of(df, *columns):
    """The rows as a set of tuples, of the given columns or all in order."""
    chosen = df.select(*columns) if columns else df
    return {tuple(row) for row in chosen.collect()}
