import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .appName("tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def people(spark):
    """Eleven triples about two people and a company."""
    from trivane import TripleStore

    one, two, firm = (f"http://example.org/{n}" for n in ("person1", "person2", "company1"))
    rows = [
        (one, "ex:name", "John Smith"), (one, "ex:age", "30"), (one, "ex:email", "john@example.com"), (one, "ex:worksFor", firm),
        (two, "ex:name", "Jane Doe"), (two, "ex:age", "25"), (two, "ex:email", "jane@example.com"), (two, "ex:worksFor", firm),
        (firm, "ex:name", "ACME Corp"), (firm, "ex:founded", "2000"), (firm, "ex:industry", "Technology"),
    ]
    return TripleStore.from_rows(spark, rows + rows[:2])


@pytest.fixture(scope="session")
def make_store(spark):
    from trivane import TripleStore

    return lambda rows: TripleStore.from_rows(spark, rows)


def tuples(df, *columns):
    """Rows as a sorted list of tuples."""
    picked = df.select(*columns) if columns else df
    return sorted((tuple(r) for r in picked.collect()), key=str)
