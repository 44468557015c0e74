import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .appName("cohortkit-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.maxMetadataStringLength", "10000")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def voters(spark):
    """Eight people with the cases where the variants of an operator differ."""
    return spark.createDataFrame(
        [
            (1, "MURRAY", "25", "M", "A", "Y", "$50000", "Yes"),
            (2, "MURRAY", "18", "F", "A", "N", "$1,234", None),
            (3, "MURRAY", "30", None, "B", None, "77", "No"),
            (4, "MURRAY", "31", "F", "B", "Y", None, "Yes"),
            (5, "OTHER", "25", "F", "A", "Y", "$100", "Yes"),
            (6, "MURRAY", "20", "M", None, "Y", "$20", None),
            (7, "MURRAY", "100", "M", "B", "A", "$30", "U"),
            (8, "MURRAY", None, "F", "A", "Y", "$40", "Yes"),
        ],
        "id int, county string, age string, gender string, grp string, "
        "voted string, income string, interest string",
    )
