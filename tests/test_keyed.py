"""Keyed tables: what merges touch, and several writers at once."""

import threading

import pytest
from pyspark.sql import functions as F

from txlake.session import scratch_path
from txlake.sinks import keyed
from txlake.sinks.keyed import CommitConflict, KeyedTable


def table(spark, buckets=8):
    schema = spark.createDataFrame([], "id string, n long, note string").schema
    return KeyedTable(spark, scratch_path(spark, "keyed"), schema, "id", buckets)


def rows(spark, ids, n, note="x"):
    return spark.createDataFrame([(i, n, note) for i in ids], "id string, n long, note string")


def content(store):
    return {r.id: (r.n, r.note) for r in store.read().collect()}


def test_merges(spark):
    store = table(spark)
    assert store.read().collect() == []
    assert store.upsert(rows(spark, "abcdefgh", 1)) == 1
    assert store.upsert(rows(spark, ["a", "z"], 2)) == 2
    assert store.upsert_columns(rows(spark, ["b", "y"], 3, "new"), ["n"]) == 3
    assert store.insert(rows(spark, ["c", "w"], 4)) == 4
    assert store.upsert(rows(spark, [], 5)) == 4, "nothing comes, nothing is written"
    expected = {**{i: (1, "x") for i in "cdefgh"}, "a": (2, "x"), "z": (2, "x"), "b": (3, "x"), "y": (3, "new"), "w": (4, "x")}
    assert content(store) == expected and store.read().count() == len(expected)
    store.upsert(spark.createDataFrame([(None, 7, "k"), ("a", 8, "1"), ("a", 9, "2")], "id string, n long, note string"), ["n"])
    assert content(store) == {**expected, "a": (9, "2"), None: (7, "k")}


def test_a_merge_touches_only_its_buckets_and_ranges(spark):
    store = table(spark)
    store.upsert(spark.range(4000).select(F.format_string("k%05d", "id").alias("id"), F.lit(1).cast("long").alias("n"), F.lit("x").alias("note")))
    before = {r.path: r for r in store.files()[1].collect()}
    store.upsert(rows(spark, ["k00100"], 2))
    after = {r.path: r for r in store.files()[1].collect()}
    gone = set(before) - set(after)
    assert len(gone) == 1 and len({r.bucket for r in before.values()}) == 8, "one file of one bucket is rewritten"
    # Ids beyond every file's range meet no file.
    store.upsert(rows(spark, ["z1", "z2"], 3))
    assert set(after) <= {r.path for r in store.files()[1].collect()}
    assert store.read().count() == 4002 and store.read().where("n > 1").count() == 3


def test_writers_at_once_lose_nothing(spark, monkeypatch):
    """Four writers, each with keys of its own and one that all share, over enough commits for snapshots."""
    monkeypatch.setattr(keyed, "SNAPSHOT_EVERY", 4)
    store, errors = table(spark, 4), []

    def work(writer):
        try:
            mine = KeyedTable(spark, store.base, store.schema, "id", 4)
            for turn in range(3):
                mine.upsert(rows(spark, [f"w{writer}-{turn}", "shared"], 10 * writer + turn))
        except Exception as error:  # noqa: BLE001
            errors.append(error)

    threads = [threading.Thread(target=work, args=(n,)) for n in range(4)]
    for thread in threads:
        thread.start()
    for thread in threads:
        thread.join()
    assert not errors
    found = content(store)
    assert set(found) == {"shared", *(f"w{w}-{t}" for w in range(4) for t in range(3))} and store.read().count() == 13
    assert store.files()[0] == 12 and store.folder.names("snapshots"), "each merge is one commit"


def test_a_lost_race(spark, monkeypatch):
    """A commit comes in between: of other buckets, the merge stands; of the same, it is made again; again and again, it is given up."""
    store = table(spark, 64)
    store.upsert(rows(spark, ["a", "b"], 1))
    rival = KeyedTable(spark, store.base, store.schema, "id", 64)
    write, merges = KeyedTable._write, []

    def rivalled(key, times):
        def run(self, new):
            out = write(self, new)
            if self is store and len(merges) < times:
                merges.append(key)
                rival.upsert(rows(spark, [key], 5))
            return out
        return run

    for key, times, made in (("b", 1, 1), ("a", 1, 2)):
        merges.clear()
        monkeypatch.setattr(KeyedTable, "_write", rivalled(key, times))
        before = store.files()[0]
        assert store.upsert_columns(rows(spark, ["a"], 9, "late"), ["n"]) == before + 2
        assert content(store)[key][0] == (5 if key == "b" else 9)
    monkeypatch.setattr(keyed, "RETRIES", 2)
    merges.clear()
    monkeypatch.setattr(KeyedTable, "_write", rivalled("a", 9))
    with pytest.raises(CommitConflict):
        store.upsert(rows(spark, ["a"], 9))


def test_insert_by_stored_keys(spark, monkeypatch):
    """Rows that are unique already aren't stored on the way; null keys come in each time; known keys alone write nothing."""
    store, staged, whole = table(spark), [], keyed.durable
    monkeypatch.setattr(keyed, "durable", lambda df, label: staged.append(label) or whole(df, label))
    first, more = rows(spark, ["a", "b"], 1), rows(spark, ["b", "c", None], 2)
    assert store.insert(first, keys=first) == 1 and store.insert(more, keys=more) == 2
    files = store.folder.names("data")
    assert store.insert(first, keys=first) == 2 and store.folder.names("data") == files and not staged
    assert content(store) == {"a": (1, "x"), "b": (1, "x"), "c": (2, "x"), None: (2, "x")} and store.read().count() == 4
    # The same as rows that come in any order and in several copies.
    other = table(spark)
    for part in (first, more, first):
        other.insert(part.unionByName(part.filter("id is not null")))
    assert content(other) == content(store)


def test_dealt_rows_fill_few_files(spark):
    """A task of rows dealt by the key meets few buckets."""
    store = table(spark, 8)
    many = spark.range(4000).select(F.format_string("k%05d", "id").alias("id"), F.lit(1).cast("long").alias("n"), F.lit("x").alias("note"))
    dealt = many.repartition(16, "id")
    store.insert(dealt, keys=many)
    files = store.files()[1].collect()
    assert len(files) == 16 and len({r.bucket for r in files}) == 8 and sum(r.rows for r in files) == 4000
    assert store.upsert(rows(spark, ["k00100"], 2)) == 2 and store.read().count() == 4000
    assert [r.n for r in store.of_key("k00100").collect()] == [2] and store.of_key("z").isEmpty()
