"""Prefix trie of rebuilt conversations, rolled up by centroid decomposition of its parent edges.

A conversation begins with the first turns of its family's base conversation, as many as a hash of its id says, and goes on
with its own. A node is a distinct sequence of first turns; it is found by 128 bits of running fingerprints of (place,
SHA-256 of role and text), which windows of bounded size compute for conversations of any length.

A node is named by its smallest member and its depth. Nodes of one smallest member form a path downwards, and these paths,
one vertex each, a tree with at most one vertex per conversation, in which the number of conversations through a path's top
is the weight of all that hangs below it: no walk is needed to know it. The tree is then decomposed. In every component the
vertices that hold half of its weight or more are the way from its top to its centroid, the lightest of them. Everything
under the centroid in the component is summed up and added along that way; then the centroid goes, the trees under it and
the rest become components of at most half the weight, and after ``log2`` of the conversations, rounded up, nothing is left.
All components of a round are taken by the same few joins, whatever their number or size. Last, what hangs on each node
of a path is summed from the path's end up to it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from txlake.llm.ranks import numbered, running
from txlake.llm.schema_guard import durable, pick

FAMILY = 5
HEADS = 9
#: Ids of members per packed piece of text.
PACK = 4096
_COPIES = 1024


def _long(value: int) -> Column:
    return F.lit(value).cast("long")


def original_turns(conversations: DataFrame) -> DataFrame:
    """``conv_id``, ``place`` (from 0), ``digest`` and ``bytes`` of every turn. Equal turns of one number are ordered by digest."""
    rows = pick(conversations, conv_id="long", turn="long", role="string", text="string").where("conv_id is not null")
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = rows.select(
        "conv_id", "turn", F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256).alias("digest"), F.octet_length(text).cast("long").alias("bytes"))
    same = rows.groupBy("conv_id", "turn", "digest", "bytes").count()
    pieces = same.select("*", F.explode(F.sequence(_long(0), F.col("count") - 1, _long(_COPIES))).alias("piece"))
    each = pieces.select("conv_id", "turn", "digest", "bytes", F.explode(F.sequence("piece", F.least(F.col("piece") + (_COPIES - 1), F.col("count") - 1))).alias("copy"))
    return numbered(each, ["conv_id"], [F.col("turn").asc_nulls_first(), F.col("digest"), F.col("copy")], "place").drop("turn", "copy")


def rebuilt_turns(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The turns of the rebuilt conversations, and every conversation's ``length`` after that."""
    convs = turns.groupBy("conv_id").agg(F.count("*").alias("own")).withColumns({
        "base": F.col("conv_id") - F.col("conv_id") % FAMILY, "head": F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS})
    convs = durable(convs, "conversations")
    bases = convs.select(F.col("conv_id").alias("base"), F.col("own").alias("base_own"))
    convs = convs.join(bases, "base", "left").withColumn("lead", F.least("head", F.coalesce("base_own", _long(0))))
    convs = durable(convs.select("conv_id", "base", "head", "lead", (F.col("lead") + F.greatest(F.col("own") - F.col("head"), _long(0))).alias("length")), "rebuilt-lengths")
    own = turns.join(convs.select("conv_id", "head", "lead"), "conv_id").where("place >= head").select(
        "conv_id", (F.col("place") - F.col("head") + F.col("lead")).alias("place"), "digest", "bytes")
    first = turns.where(F.col("place") < HEADS - 1).withColumnRenamed("conv_id", "base")
    lent = first.join(convs.select("conv_id", "base", "head"), "base").where("place < head").select("conv_id", "place", "digest", "bytes")
    return own.unionByName(lent), convs.select("conv_id", "length")


def trie_nodes(turns: DataFrame, root: int, count: int) -> tuple[DataFrame, DataFrame]:
    """Nodes (``conv``, ``depth``, ``parent_conv``, ``n_convs``, ``bytes``), and for every conversation and depth the node
    (``conv_id``, ``depth``, ``conv``)."""
    own = [F.xxhash64("place", "digest"), F.xxhash64(F.lit("second"), "digest", "place")]
    keyed = turns.select("conv_id", "place", "bytes", own[0].alias("one"), own[1].alias("two"))
    keyed = running(keyed, ["conv_id"], "place", {"one": "xor", "two": "xor"})
    keyed = durable(keyed.select("conv_id", (F.col("place") + 1).alias("depth"), "bytes", "one", "two"), "prefixes")
    key = ["depth", "one", "two"]
    named = durable(keyed.groupBy(*key).agg(F.min("conv_id").alias("conv"), F.count("*").alias("n_convs"), F.min("bytes").alias("bytes")), "named")
    ways = durable(keyed.select("conv_id", *key).join(named.select(*key, "conv"), key).select("conv_id", "depth", "conv"), "ways")
    above = ways.select(F.col("conv_id").alias("conv"), (F.col("depth") + 1).alias("depth"), F.col("conv").alias("parent_conv"))
    nodes = named.drop("one", "two").join(above, ["conv", "depth"], "left").withColumn("parent_conv", F.coalesce("parent_conv", _long(root)))
    top = nodes.sparkSession.range(1).select(
        _long(root).alias("conv"), _long(0).alias("depth"), _long(count).alias("n_convs"), _long(0).alias("bytes"), F.lit(None).cast("long").alias("parent_conv"))
    nodes = nodes.unionByName(top)
    children = nodes.where("depth > 0").groupBy(F.col("parent_conv").alias("conv"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("n_children"))
    nodes = nodes.join(children, ["conv", "depth"], "left").withColumn("n_children", F.coalesce("n_children", _long(0)))
    return durable(nodes, "nodes"), ways


def subtree_sums(vertices: DataFrame, above: DataFrame, values: list[str]) -> DataFrame:
    """``id`` and ``values`` summed over the subtree of every vertex of a tree.

    ``vertices`` has ``id``, ``root``, ``weight`` (of the whole subtree; every vertex adds 1 or more) and ``values``; ``above``
    has, for every vertex ``id`` but the root and for each ``on_way`` on its way down from the root, itself included, that
    vertex's ``parent``.
    """
    state = vertices.select("id", F.col("root").alias("top"), "weight", *values)
    rounds = []
    while True:
        totals = state.where("id = top").select("top", F.col("weight").alias("total"))
        whole = state.join(totals, "top").withColumn("half", 2 * F.col("weight") >= F.col("total"))
        centroids = whole.where("half").groupBy("top").agg(F.min(F.struct("weight", "id")).alias("least")).select(
            "top", F.col("least.id").alias("centroid"), F.col("least.weight").alias("cut"))
        marked = whole.join(centroids, "top").join(
            above.withColumnRenamed("parent", "centroid"), ["id", "centroid"], "left").withColumn(
            "below", F.col("on_way").isNotNull() | (F.col("id") == F.col("centroid")))
        marked = durable(marked.select("id", "top", "weight", "half", "centroid", "cut", "on_way", "below", *values), "components")
        sums = marked.where("below").groupBy("top").agg(*[F.sum(v).alias(v) for v in values])
        rounds.append(marked.where("half").select("id", "top").join(sums, "top").select("id", *values))
        state = marked.where("id <> centroid").select(
            "id", F.coalesce("on_way", "top").alias("top"),
            F.when(F.col("half") & ~F.col("below"), F.col("weight") - F.col("cut")).otherwise(F.col("weight")).alias("weight"), *values)
        if not state.head(1):
            break
    added = rounds[0]
    for more in rounds[1:]:
        added = added.unionByName(more)
    return added.groupBy("id").agg(*[F.sum(v).alias(v) for v in values])


def _runs(batches: Iterable[pa.RecordBatch], fields: list[str]) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """Slices of equal ``conv`` and ``depth``, of rows that come sorted by them."""
    for batch in batches:
        if batch.num_rows:
            conv, depth = (batch.column(name).to_numpy() for name in fields)
            cuts = np.flatnonzero((np.diff(conv) != 0) | (np.diff(depth) != 0)) + 1
            for start, stop in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
                yield (int(conv[start]), int(depth[start])), batch.slice(start, stop - start)


def _pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out: list[tuple] = []
    for (conv, depth), rows in _runs(batches, ["conv", "depth"]):
        ids = rows.column("conv_id").to_pylist()
        for at in range(0, len(ids), PACK):
            out.append((conv, depth, ids[at], ",".join(map(str, ids[at:at + PACK]))))
        if len(out) >= 1024:
            yield _batch(out, ["conv", "depth", "first", "ids"])
            out = []
    if out:
        yield _batch(out, ["conv", "depth", "first", "ids"])


def _digest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out: list[tuple] = []
    last, state = None, None
    for key, rows in _runs(batches, ["conv", "depth"]):
        if key != last:
            if state:
                out.append((*last, state.hexdigest()))
            last, state = key, hashlib.sha256()
            comma = b""
        for text in rows.column("ids"):
            state.update(comma + text.as_py().encode())
            comma = b","
        if len(out) >= 4096:
            yield _batch(out, ["conv", "depth", "ends_sha256"])
            out = []
    if state:
        out.append((*last, state.hexdigest()))
    if out:
        yield _batch(out, ["conv", "depth", "ends_sha256"])


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(column) for column in zip(*rows)], names)


def end_digests(ends: DataFrame) -> DataFrame:
    """``conv``, ``depth`` and the digest of their ``conv_id``s in ascending order.

    Ranges of ids are put into text where they lie, also of one node in many tasks; a digest itself can only be made from
    first to last, so a node's packed texts go through one task, one at a time.
    """
    order = ["conv", "depth", "conv_id"]
    packed = ends.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_pack, "conv long, depth long, first long, ids string")
    return packed.repartition("conv", "depth").sortWithinPartitions("conv", "depth", "first").mapInArrow(
        _digest, "conv long, depth long, ends_sha256 string")


def trie(conversations: DataFrame) -> DataFrame:
    """One row per node of the trie of all rebuilt conversations: ``conv_id`` (smallest member), ``depth``, ``parent_conv_id``,
    ``n_convs``, ``n_children``, ``n_leaves``, ``saved_tokens`` and ``ends_sha256``.

    Turns without a number come first; turns of equal number are ordered by digest, and a repeated row is one more turn.
    A null role or text counts as empty. Rows without a ``conv_id`` take no part; a table without any other has no nodes.
    A conversation may lose all its turns and then ends in the root.
    """
    turns, lengths = rebuilt_turns(original_turns(conversations))
    lengths = durable(lengths, "lengths")
    whole = lengths.agg(F.min("conv_id").alias("root"), F.count("*").alias("n")).first()
    root, count = whole["root"] or 0, whole["n"]
    nodes, ways = trie_nodes(turns, root, count)
    if not count:
        nodes = nodes.limit(0)
    values = ["leaves", "saved"]
    valued = nodes.withColumns({
        "leaves": (F.col("n_children") == 0).cast("long"), "saved": (F.col("n_convs") - 1) * F.col("bytes")})

    paths = valued.groupBy("conv").agg(
        F.min(F.struct("depth", "parent_conv", "n_convs")).alias("first"), F.max("depth").alias("last"), *[F.sum(v).alias(v) for v in values])
    paths = durable(paths.select(
        F.col("conv").alias("id"), F.col("first.depth").alias("depth"), F.col("first.parent_conv").alias("parent"), F.col("first.n_convs").alias("weight"), "last", *values), "paths")
    tops = paths.where("depth > 0").select(F.col("id").alias("conv"), "depth", "parent")
    above = ways.join(tops, ["conv", "depth"]).join(paths.select(F.col("id").alias("conv_id")), "conv_id", "left_semi").select(
        F.col("conv_id").alias("id"), F.col("conv").alias("on_way"), "parent")
    sums = durable(subtree_sums(paths.withColumn("root", _long(root)), durable(above, "above"), values), "subtree-sums")

    hung = sums.join(paths.where("depth > 0").select("id", "parent", "depth"), "id").groupBy(
        F.col("parent").alias("conv"), (F.col("depth") - 1).alias("depth")).agg(*[F.sum(v).alias(f"hung_{v}") for v in values])
    along = valued.join(paths.select(F.col("id").alias("conv"), "last"), "conv").join(hung, ["conv", "depth"], "left").select(
        "conv", "depth", "parent_conv", "n_convs", "n_children", (F.col("last") - F.col("depth")).alias("place"),
        *[(F.col(v) + F.coalesce(f"hung_{v}", _long(0))).alias(v) for v in values])
    along = running(along, ["conv"], "place", dict.fromkeys(values, "sum"))

    ends = ways.join(lengths.withColumnRenamed("length", "depth"), ["conv_id", "depth"]).unionByName(
        lengths.where("length = 0").select("conv_id", F.col("length").alias("depth"), _long(root).alias("conv")))
    return along.join(end_digests(ends), ["conv", "depth"], "left").select(
        F.col("conv").alias("conv_id"), "depth", F.col("parent_conv").alias("parent_conv_id"), "n_convs", "n_children",
        F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))
