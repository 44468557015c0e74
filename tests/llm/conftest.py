import pytest

from cohortkit.llm.ship import ship

COLUMNS = (
    "doc_id bigint, text string, lang string, source string, n_chars bigint, "
    # Extra columns with names that the operators use inside.
    "id string, hash string, size int, row int, tokens string, kept string, salt int, taken int, "
    "shard int, slot int, doc string, name string, copies int, rows int, _name string, _row string, "
    "_copy int, part int, block int, bin int, e bigint, turn int"
)
LONG = "word " * 30_000 + "x" * 70_000


def odd_rows():
    extra = ("a", "b", 1, 2, "c", "d", 3, 4, 5, 6, "e", "f", 7, 8, "g", "h", 9, 10, 11, 12, 13, 14)
    texts = [
        (1, None, "en", "s1"),
        (2, "", "en", "s2"),
        (3, "   \n\t ", None, "s1"),
        (4, "One two three four five six seven eight nine ten.", "en", "s1"),
        (5, "one two three four five six seven eight nine ten.", "en", "s2"),
        (5, "one two three four five six seven eight nine ten.", "en", "s2"),
        (6, LONG, "de", "s2"),
        (7, LONG + " end", "de", None),
        (None, "null id", "fr", "s3"),
        (None, None, None, None),
        (8, "Été ÀÉÎ 🙂 mail a.b@c.de or +1 (988) 555-2485 at 10.0.0.255", "fr", "s3"),
        (9, "line\nline\nline\n\n", "es", "s1"),
        (8, "another text with the id 8", "en", "S1"),
    ]
    return [(*t, None if t[1] is None else len(t[1]), *extra) for t in texts]


@pytest.fixture(scope="session", autouse=True)
def shipped(spark):
    ship(spark)


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in any column, empty and very long texts, ties, repeated rows, clashing names."""
    return spark.createDataFrame(odd_rows(), COLUMNS).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], COLUMNS)


def ordered(df, *columns):
    """The rows as tuples in one order, nulls first."""
    rows = [tuple(r) for r in df.select(*(columns or df.columns)).collect()]
    return sorted(rows, key=lambda r: [(x is not None, x) for x in r])
