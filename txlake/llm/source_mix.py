"""Mixing of sources to target weights by Sainte-Laguë apportionment. DataFrame functions only.

Sources share a budget of words by weight; no source gets more than ``MOST`` times what it has, and what such a source
leaves goes to the others by weight. The budget is cut into blocks of equally many words. Sainte-Laguë deals the blocks to
the sources: block ``k`` (from 0) of a source with target ``t`` has the quotient ``t / (2 k + 1)``, and the highest quotients
win. In the same way a source's blocks are dealt to its shards, which are documents dealt by a seeded hash. In a shard the
documents stand on a line of words in seeded order. The shard's quota takes the whole line as often as it goes in, and of
what is left, blocks of the line in a seeded order (``a j + c mod n``, with a prime ``a`` above any ``n``), the last one in
part. So reruns take the same words, and no word is taken more than ``MOST`` times.

No list of quotients is kept: with ``m`` members and ``N`` blocks, the divisors ``T / (N - m / 2)`` and ``T / (N + m / 2)``
bound every member's share from both sides, and only the at most ``4 m`` quotients between the bounds are ranked.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window, functions as F

from txlake.llm.ranks import attach, numbered
from txlake.llm.schema_guard import durable, pick

MOST = 3
WEIGHTS = (1, 2, 3)
#: Words of a block: ``BLOCK``, and fewer where a source would get under ``BLOCKS`` blocks on average.
BLOCK, BLOCKS = 16, 64
#: Words and documents, together, that a shard is made for.
SHARD = 1 << 24
#: Copies of a repeated row that are dealt to a shard together.
COPIES = 1024
# Primes above the number of blocks of any shard.
PRIMES = (2147483647, 2147483629, 2147483587, 2147483579, 2147483563, 2147483549, 2147483543, 2147483497)
_STRIDE = 4096


def _seeded(seed: int, *parts: Column) -> Column:
    """A number from 0 to 2^32 - 1."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(p.cast("string"), F.lit("-")) for p in parts])), 1, 8), 16, 10).cast("long")


def sizes(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``source``, ``size`` and ``digest`` of every distinct row, with how many rows are the same (``copies``)."""
    docs = pick(docs, doc_id="long", text="string", source="string")
    size = F.coalesce(F.regexp_count("text", F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")
    return docs.select("doc_id", "source", size.alias("size"), F.md5(F.coalesce("text", F.lit(""))).alias("digest")).groupBy(
        "doc_id", "source", "size", "digest").agg(F.count("*").alias("copies"))


def targets(sources: DataFrame, total: int) -> DataFrame:
    """``sources`` (``source``, ``source_size``, ``source_rows``) with ``place`` by code point, ``weight`` and ``target``.

    Each pass shares what capped sources leave among the others by weight and caps those above their limit, until none
    is. A pass is one sum over the sources.
    """
    ranked = numbered(sources, [], [F.col("source").asc_nulls_last()], "place")
    weight = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), (F.col("place") % len(WEIGHTS) + 1).cast("int")).cast("long")
    ranked = durable(ranked.withColumn("weight", weight), "sources")
    limit = MOST * F.col("source_size")
    capped, before = F.lit(False), -1
    while True:
        row = ranked.agg(
            F.sum(F.when(capped, limit).otherwise(0)).alias("held"), F.sum(F.when(capped, 0).otherwise(F.col("weight"))).alias("free"),
            F.sum(capped.cast("long")).alias("n")).first()
        if row["n"] in (before, None) or not row["free"]:
            break
        left, free, before = total - row["held"], row["free"], row["n"]
        exact = "decimal(38,0)"
        capped = F.lit(Decimal(left)).cast(exact) * F.col("weight") > limit.cast(exact) * F.lit(Decimal(free))
    if not row["n"] and not row["free"]:
        return ranked.withColumn("target", F.lit(0.0))
    share = F.lit(float(total - row["held"])) * F.col("weight") / F.lit(float(row["free"] or 1))
    return ranked.withColumn("target", F.when(capped, limit.cast("double")).otherwise(share))


def apportion(members: DataFrame, group: list[str], order: str) -> DataFrame:
    """``members`` with ``quota``: the ``seats`` of its group dealt by Sainte-Laguë in proportion to ``share``.

    Every row has its group's ``seats``, ``group_share`` (the sum of ``share``) and ``group_members``; ``order`` decides
    between equal quotients. Members with a share of 0 get nothing.
    """
    half = F.col("group_members") / 2.0

    def seats_at(seats: Column) -> Column:
        return F.when(F.col("group_share") > 0, F.floor(F.col("share") * seats / F.col("group_share") + 0.5)).otherwise(0).cast("long")

    # One seat more to either side, for rounding.
    low = F.greatest(seats_at(F.greatest(F.col("seats") - half, F.lit(0.0))) - 1, F.lit(0).cast("long"))
    members = members.withColumn("low", F.when(F.col("share") > 0, low).otherwise(0).cast("long"))
    high = seats_at(F.col("seats") + half) + 1
    key = [*group, order]
    sure = members.groupBy(*group).agg(F.sum("low").alias("sure"))
    open_seats = members.where("share > 0").select(*key, "share", "seats", F.explode(F.sequence("low", high)).alias("k")).select(
        *key, "seats", (F.col("share") / (2 * F.col("k") + 1)).alias("quotient"))
    ranked = numbered(open_seats, group, [F.desc("quotient"), F.col(order)], "seat")
    won = attach(ranked, sure, group).where("seat < seats - sure").groupBy(*key).agg(F.count("*").alias("won"))
    return attach(members, won, key, "left").select(
        *[c for c in members.columns if c != "low"], (F.col("low") + F.coalesce("won", F.lit(0))).alias("quota"))


def _of_blocks(first: Column, last: Column, value) -> Column:
    """Sum of ``value`` over block numbers, in strides so that no long array is made for a very long document."""
    zero = F.lit(0).cast("long")
    return F.aggregate(F.sequence(first, last, F.lit(_STRIDE).cast("long")), zero, lambda total, start: total + F.aggregate(
        F.sequence(start, F.least(start + (_STRIDE - 1), last)), zero, lambda part, block: part + value(block)))


def mix(docs: DataFrame, seed: int = 0) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``size`` (words of the text), ``source_size``, ``target`` (its source's) and
    ``taken`` (words that the mix takes, repeats counted), with ``source``.

    A null text has no words. A null source is a source. Rows with equal or null ids are rows like any other; the copies
    of one row are told apart by their number. An empty table gives no rows, and without a word all targets are 0. The
    words taken of a source differ from its target by about half a block, and by at most one block per shard.
    """
    rows = durable(sizes(docs), "sizes")
    sources = rows.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("source_size"), F.sum("copies").alias("source_rows"))
    sources = durable(sources, "source-sizes")
    row = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("total"), F.count("*").alias("n")).first()
    total, count = row["total"], row["n"]
    block = max(1, min(BLOCK, total // (BLOCKS * max(count, 1))))
    aimed = targets(sources, total).withColumns({
        "share": F.col("target"), "seats": F.lit((2 * total + block) // (2 * block)).cast("long"), "group_share": F.lit(float(total)),
        "group_members": F.lit(count).cast("long"), "all": F.lit(0)})
    aimed = durable(apportion(aimed, ["all"], "place").select(
        "source", "source_size", "target", "place", F.col("quota").alias("seats"),
        F.ceil((F.col("source_size") + F.col("source_rows")) / SHARD).cast("long").alias("shards")), "quotas")

    pieces = rows.select("doc_id", "source", "size", "digest", "copies", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1, F.lit(COPIES).cast("long"))).alias("piece"))
    pieces = attach(pieces, aimed, ["source"]).select(
        *pieces.columns, "place", "source_size", "target", "seats", "shards", _seeded(seed, F.col("doc_id"), F.col("digest"), F.col("piece")).alias("draw"))
    pieces = pieces.withColumns({
        "count": F.least(F.col("copies") - F.col("piece"), F.lit(COPIES).cast("long")), "shard": F.col("draw") % F.col("shards")})
    shards = pieces.groupBy("place", "shard").agg(F.sum(F.col("size") * F.col("count")).alias("line"), F.first("seats").alias("seats"), F.first("source_size").alias("source_size"), F.first("shards").alias("group_members"))
    shards = shards.withColumns({"share": F.col("line").cast("double"), "group_share": F.col("source_size").cast("double")})
    quotas = apportion(shards, ["place"], "shard").select("place", "shard", "line", "quota").withColumn(
        "tokens", F.least(F.col("quota") * block, MOST * F.col("line")))
    draw = _seeded(seed, F.lit("shard"), F.col("place"), F.col("shard"))
    n = F.ceil(F.col("line") / block).cast("long")
    quotas = durable(quotas.where("line > 0").select(
        "place", "shard", "line", n.alias("n"), F.floor(F.col("tokens") / F.col("line")).alias("whole"), (F.col("tokens") % F.col("line")).alias("rest"),
        F.element_at(F.array(*[F.lit(p).cast("long") for p in PRIMES]), (draw % len(PRIMES) + 1).cast("int")).alias("a"), (F.floor(draw / len(PRIMES)) % n).alias("c")), "shard-quotas")

    ahead = Window.partitionBy("place", "shard").orderBy("draw", "doc_id", "digest", "piece").rowsBetween(Window.unboundedPreceding, -1)
    placed = pieces.withColumn("begin", F.coalesce(F.sum(F.col("size") * F.col("count")).over(ahead), F.lit(0)))
    placed = placed.join(quotas, ["place", "shard"], "left")
    each = placed.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("count") - 1)).alias("copy")).withColumn(
        "start", F.col("begin") + F.col("copy") * F.col("size")).withColumn("stop", F.col("start") + F.col("size"))

    def rank(of: Column) -> Column:
        return (F.col("a") * of + F.col("c")) % F.col("n")

    def overlap(of: Column) -> Column:
        # The last block of a line may be short; blocks that come after it in the seeded order begin that much earlier.
        short = F.when(rank(of) > rank(F.col("n") - 1), F.col("n") * block - F.col("line")).otherwise(0)
        taken = F.greatest(F.least(F.col("rest") - (rank(of) * block - short), F.lit(block)), F.lit(0))
        return F.greatest(F.least(F.col("stop"), of * block + taken) - F.greatest(F.col("start"), of * block), F.lit(0)).cast("long")

    some = _of_blocks(F.floor(F.col("start") / block).cast("long"), F.floor((F.col("stop") - 1) / block).cast("long"), overlap)
    return each.select(
        "doc_id", "source", "size", "source_size", "target",
        F.when(F.col("size") > 0, F.col("whole") * F.col("size") + some).otherwise(0).cast("long").alias("taken"))
