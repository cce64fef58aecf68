import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from platewise.schema import WELLS  # noqa: E402
from platewise.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "tests",
        "local[8]",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.ui.enabled": "false",
            "spark.driver.memory": "4g",
            "spark.sql.maxMetadataStringLength": "2000",
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def make_wells(spark):
    """Wells from dicts; columns that are left out get plain values."""

    def make(rows):
        plain = {
            "run_id": "r1", "run_date": "", "assay_name": "", "lot_number": "", "extraction_lot": "",
            "well": "A01", "content": "Unkn", "sample_label": "X", "sample_type": "X",
            "sample_label_clean": "X", "replicate": 1, "is_control": False,
        }
        filled = [{**plain, "row_idx": i, **row} for i, row in enumerate(rows)]
        return spark.createDataFrame([[r.get(c) for c in WELLS.names] for r in filled], WELLS)

    return make


@pytest.fixture(scope="session")
def rows_of():
    """Rows as a list of dicts, in the order Spark gives them."""
    return lambda df: [r.asDict() for r in df.collect()]
