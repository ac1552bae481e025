import random

from pyspark.sql import functions as F

from tests.llm.conftest import plain
from txlake.llm import conversation_trie, ranks

COLUMNS = "conv_id long, turn long, role string, text string, place long, conv long, COUNT long"


def frame(spark, rows):
    return spark.createDataFrame([(*row, 1, 2, 3) for row in rows], COLUMNS).repartition(3)


def talks(seed):
    """Families that share first turns, chains of ever longer conversations, copies, hot first turns, long ones, and odd rows."""
    draw = random.Random(seed)
    rows = []
    for conv in range(150):
        turns = [draw.choice("ab") * draw.randint(0, 2) for _ in range(draw.randint(1, 6))]
        rows += [(conv, n, draw.choice(["user", "bot"]), text) for n, text in enumerate(turns)]
    for n in range(40):
        rows += [(1000 + 5 * n, k, "user", f"step {k}") for k in range(n + 1)]
        rows += [(3000 - 5 * n, k, "user", f"back {k} é") for k in range(n + 1)]
    for n in range(30):
        rows += [(5000 + 5 * n, k, "user", "same" if k < 3 else f"end {n % 2}") for k in range(5)]
    rows += [(7000, k, None, f"{k % 7}") for k in range(300)] + [(7005, k, "x", "y") for k in range(20)]
    rows += [(8001, None, "user", None), (8001, None, None, "z"), (8001, 3, "user", "t"), (8002, 1, "a", "b"), (8002, 1, "a", "b"), (8002, 1, "a", "b")]
    rows += [(-3, 0, "user", "minus"), (-3, 1, "bot", "one"), (-5, 0, "user", "minus"), (None, 0, "user", "nobody"), (None, None, None, None)]
    return rows


def test_against_sql(spark, by_sql, monkeypatch):
    monkeypatch.setattr(ranks, "RUN", 7)
    monkeypatch.setattr(conversation_trie, "PACK", 4)
    monkeypatch.setattr(conversation_trie, "_COPIES", 2)
    rows = frame(spark, talks(1))
    got = plain(conversation_trie.trie(rows))
    assert got == by_sql("op11_conversation_trie", "conversations", rows.select("conv_id", "turn", "role", "text"))


def test_without_turns(spark):
    empty = frame(spark, [(None, 1, "a", "b")])
    assert conversation_trie.trie(empty).collect() == []
    assert conversation_trie.trie(empty.limit(0)).collect() == []
    # crc32("1") % 9 is 1: the base is absent, so nothing is lent and the only turn is lost.
    (root,) = conversation_trie.trie(frame(spark, [(1, 0, "user", "lost")])).collect()
    assert (root.conv_id, root.depth, root.parent_conv_id, root.n_convs, root.n_children, root.n_leaves, root.saved_tokens) == (1, 0, None, 1, 0, 1, 0)


def test_subtree_sums_of_any_shape(spark):
    """Random trees, a path and a star, against a walk; a path of 200 takes eight rounds."""
    draw = random.Random(5)
    shapes = {"random": [draw.randrange(n) if n else None for n in range(200)], "path": [n - 1 if n else None for n in range(200)], "star": [0 if n else None for n in range(200)]}
    for parents in shapes.values():
        size, total, above = [1] * 200, list(range(200)), []
        for n in range(199, 0, -1):
            size[parents[n]] += size[n]
            total[parents[n]] += total[n]
        for n in range(1, 200):
            at = n
            while at:
                above.append((n, at, parents[at]))
                at = parents[at]
        vertices = spark.createDataFrame([(n, 0, size[n], n) for n in range(200)], "id long, root long, weight long, value long")
        sums = conversation_trie.subtree_sums(vertices, spark.createDataFrame(above, "id long, on_way long, parent long"), ["value"])
        assert {r.id: r.value for r in sums.collect()} == dict(enumerate(total))


def test_rank_and_running_values_over_long_groups(spark, monkeypatch):
    monkeypatch.setattr(ranks, "RUN", 3)
    rows = spark.range(200).select((F.col("id") % 2).alias("g"), F.floor(F.col("id") / 2).alias("place"), F.col("id").alias("x"), F.col("id").alias("y"))
    got = {(r.g, r.place): (r.x, r.y) for r in ranks.running(rows, ["g"], "place", {"x": "sum", "y": "xor"}).collect()}
    for g in (0, 1):
        total = bits = 0
        for place in range(100):
            total, bits = total + 2 * place + g, bits ^ (2 * place + g)
            assert got[g, place] == (total, bits)
    ids = spark.range(1000).select(F.when(F.col("id") % 3 > 0, F.lit(1)).alias("g"), F.col("id").alias("v")).repartition(7)
    ranked = ranks.numbered(ids, ["g"], [F.desc("v")], "rank").collect()
    for g in (None, 1):
        mine = sorted((r for r in ranked if r.g == g), key=lambda r: -r.v)
        assert [r["rank"] for r in mine] == list(range(len(mine)))
