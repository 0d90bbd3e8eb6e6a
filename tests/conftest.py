import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from checks.compare import session  # noqa: E402
from rollbook.operators.clean import clean  # noqa: E402
from rollbook.registration import RENAMES, registration_contract  # noqa: E402

ROWS = (
    (
        "7TSTA0EV1A",
        "Quillton",
        "Quillton",
        "WA",
        "99351",
        "2018",
        "VELOMAR",
        "LARK 2",
        "Battery Electric Vehicle (BEV)",
        "Clean Alternative Fuel Vehicle Eligible",
        "231",
        "27",
        "104020301",
        "POINT (-118.25 46.125)",
        "QUILL RIVER PUBLIC POWER",
        "53071880100",
    ),
    (
        "2XKBR8Z31L",
        "Larch",
        "Harborview",
        "WA",
        "98644",
        "2022",
        "ALDER",
        "TREKKER",
        "Plug-in Hybrid Electric Vehicle (PHEV)",
        "Eligibility unknown as battery range has not been researched",
        "0",
        "8",
        "206050403",
        "POINT (-121.5 47.75)",
        "LARCH LIGHT COOPERATIVE",
        "53059771200",
    ),
)


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    spark = session("4")
    spark.sparkContext.setLogLevel("ERROR")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("shared")))
    yield spark
    spark.stop()


@pytest.fixture(scope="session")
def contract():
    return registration_contract(2026)


class Raw:
    """Two valid rows; ``with_`` changes cells by row and column, ``more`` appends copies."""

    def __init__(self, rows=ROWS):
        self.rows = [dict(zip(RENAMES, row, strict=True)) for row in rows]

    def with_(self, row: int, **cells) -> "Raw":
        self.rows[row].update({_NAMES[k]: v for k, v in cells.items()})
        return self

    def more(self, like: int, **cells) -> "Raw":
        self.rows.append(dict(self.rows[like]))
        return self.with_(-1, **cells)

    def frame(self, spark):
        schema = ", ".join(f"`{name}` string" for name in RENAMES)
        return spark.createDataFrame([tuple(r.values()) for r in self.rows], schema)

    def clean(self, spark, contract):
        return clean(self.frame(spark), contract, validate=False)


_NAMES = {new: old for old, new in RENAMES.items()}


@pytest.fixture
def raw():
    return Raw()


def rows(df):
    return [tuple(row) for row in df.collect()]


def only(df):
    """The single row as a dictionary."""
    (row,) = df.collect()
    return row.asDict()
