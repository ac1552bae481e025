import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import plain
from txlake.llm import source_mix

COLUMNS = "doc_id long, text string, source string, size int, SIZE2 string, place int, share int, draw int"


def frame(spark, rows):
    return spark.createDataFrame([(doc, text, source, 1, "x", 2, 3, 4) for doc, text, source in rows], COLUMNS).repartition(3)


def check(docs, by_sql):
    rows = source_mix.mix(docs).cache()
    assert plain(rows) == by_sql("op13_source_mix", "documents", docs.select("doc_id", "text", "source"))
    assert rows.where("taken > 3 * size or taken < 0").count() == 0 and rows.count() == docs.count()
    return rows


def test_sources_of_all_sizes(spark, by_sql):
    words = " ".join(f"w{n}" for n in range(400))
    rows = [(n, words[: 7 * (n * n % 211)], f"s{n % 7}") for n in range(300)]
    rows += [(1000 + n, "few", "tiny") for n in range(3)] + [(2000, "one two\tthree four", None), (2001, None, None), (2002, "", "nothing"), (None, words, "s1")]
    docs = frame(spark, rows)
    rows = check(docs, by_sql)
    sums = source_mix.mix(docs).groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.first("source_size").alias("size")).collect()
    assert all(abs(s.taken - s.target) <= 16 and s.target <= 3 * s["size"] + 1e-6 for s in sums)
    assert sum(s.target for s in sums) == pytest.approx(sum(s["size"] for s in sums))
    assert plain(rows) == plain(source_mix.mix(docs.repartition(5)))


def test_repeated_rows_and_shards(spark, by_sql, monkeypatch):
    docs = frame(spark, [(5, "a b c d e f g h i j", "hot")] * 700 + [(n, "k l m n o p " * (n % 5), f"s{n % 3}") for n in range(600)])
    check(docs, by_sql)
    monkeypatch.setattr(source_mix, "SHARD", 500)
    monkeypatch.setattr(source_mix, "COPIES", 16)
    rows = source_mix.mix(docs)
    sums = rows.groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect()
    assert all(abs(s.taken - s.target) <= 0.02 * s.target for s in sums)
    assert rows.count() == docs.count() and rows.where("taken > 3 * size").count() == 0


def test_no_words(spark):
    docs = frame(spark, [(1, None, "a"), (2, " \n", None)])
    assert {tuple(r) for r in source_mix.mix(docs).collect()} == {(1, "a", 0, 0, 0.0, 0), (2, None, 0, 0, 0.0, 0)}
    assert source_mix.mix(docs.limit(0)).collect() == []


def test_highest_quotients(spark):
    """Quotas as the plain walk deals them, seat by seat."""
    shares = [53.0, 24.0, 23.0, 0.0, 1.0, 1.0, 24.0]
    rows = [("g", n, share, 37, sum(shares), len(shares)) for n, share in enumerate(shares)]
    rows += [(None, n, share, 5, sum(shares), len(shares)) for n, share in enumerate(shares)]
    members = spark.createDataFrame(rows, "g string, n int, share double, seats long, group_share double, group_members long")
    got = {(r.g, r.n): r.quota for r in source_mix.apportion(members, ["g"], "n").collect()}
    for group, seats in (("g", 37), (None, 5)):
        dealt = [0] * len(shares)
        for _ in range(seats):
            best = max(range(len(shares)), key=lambda n: (shares[n] / (2 * dealt[n] + 1), -n))
            dealt[best] += 1
        assert [got[group, n] for n in range(len(shares))] == dealt


def test_main_path_is_native(documents):
    plan = source_mix.mix(documents)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
