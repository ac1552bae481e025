import pytest

from txlake.llm import blocks

LONG = " ".join(f"word{n}" for n in range(3000))
ROWS = [
    (1, "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen"),
    (2, None),
    (3, ""),
    (4, "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen"),
    (5, LONG),
    (None, "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen"),
    (6, LONG + " tail"),
    (6, LONG + " tail"),
    (7, "Ünïcode —   text\x00 with\tall\r\nkinds of\x0bspace <|endoftext|> 12345"),
    (8, "   \n\t \n"),
    (9, "x"),
]
SCHEMA = "doc_id long, text string, block string, keys int, bucket int, _gone string, _copy int, id long, component long, n int, word string, a int, b int, TEXT2 string"


@pytest.fixture(scope="session")
def edge(spark):
    """Nulls, empty and long texts, copies, a repeated row, and columns named like those of the operators."""
    return spark.createDataFrame([(i, t, "z", 1, 2, "g", 3, 4, 5, 6, "w", 7, 8, "u") for i, t in ROWS], SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(edge):
    return edge.limit(0)


@pytest.fixture(scope="session")
def texts(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    return sorted((r.doc_id, r.text or "") for r in rows)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture
def small_blocks(monkeypatch):
    """Many blocks also for little text."""
    monkeypatch.setattr(blocks, "BLOCK_BYTES", 20_000)


@pytest.fixture(scope="session")
def by_sql():
    """Rows of a query's SQL over a small frame given as its table, sorted by their text."""
    import duckdb

    from txlake.catalog.registry import ORACLES
    from txlake.llm import queries  # noqa: F401  (registers the SQL)

    def rows(query, table, frame):
        connection = duckdb.connect()
        connection.register("given", frame.toArrow())
        connection.execute(f"create table {table} as select * from given")
        result = connection.execute(ORACLES[query])
        names = sorted(range(len(result.description)), key=lambda at: result.description[at][0])
        return sorted((tuple(row[at] for at in names) for row in result.fetchall()), key=repr)

    return rows


def plain(frame):
    """The rows of a frame in the same form."""
    return sorted((tuple(row[c] for c in sorted(frame.columns)) for row in frame.collect()), key=repr)
