"""Near-duplicate vectors of equal label by collision counting over many one-dimensional projections.

Each unit vector is projected on ``PROJECTIONS`` random directions. A pair collides in a projection if one lies in the
window around the other; a window reaches two standard deviations of the difference of the least similar pair to be
found. A pair that collides at least as often as ``least_collisions`` asks, a number calibrated to a recall of all but
one in a hundred thousand of such pairs, is verified by its cosine in double precision.

Two more projections, sorted and cut at their quantiles, deal the vectors of a label into cells: each as a query to its
own, and as a target to all cells that its window of 4.5 deviations meets. Queries and targets of a cell are cut into chunks, and each
pair of chunks is one group, so neither a large label nor a cluster in one cell meets in one task. Groups give sums and
stars of links, never pairs. Equal vectors are one.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from txlake.llm.components import components
from txlake.llm.schema_guard import durable, pick

COSINE = 0.98
PROJECTIONS = 24
RECALL = 0.99999
WINDOW, CELL_WINDOW = 2.0, 4.5
CELL = 1500
CHUNK = 2048
_SEED = 20


def directions(dimension: int, count: int) -> np.ndarray:
    """Random unit directions, the same on every machine."""
    drawn = np.random.Generator(np.random.PCG64(_SEED)).standard_normal((count, dimension))
    return drawn / np.linalg.norm(drawn, axis=1, keepdims=True)


def deviation(cosine: float, dimension: int) -> float:
    """Of the projected difference of two unit vectors at this cosine."""
    return math.sqrt(max(0.0, 2 - 2 * cosine)) / math.sqrt(dimension)


def least_collisions(projections: int = PROJECTIONS, window: float = WINDOW, recall: float = RECALL) -> int:
    """The largest count that a pair at the threshold reaches with probability ``recall``."""
    hit = math.erf(window / math.sqrt(2))
    tail = 0.0
    for count in range(projections, -1, -1):
        tail += math.comb(projections, count) * hit ** count * (1 - hit) ** (projections - count)
        if tail >= recall:
            return count
    return 0


def _unit(rows: pa.Array) -> np.ndarray:
    flat = rows.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(rows), -1)


def usable(vectors: DataFrame) -> DataFrame:
    """``vec_id``, ``label``, ``embedding`` and its length of rows that may link: all given, finite, not zero."""
    rows = pick(vectors, vec_id="long", label="string", embedding="array<double>")
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.where("vec_id is not null and label is not null and embedding is not null").where(
        ~bad & F.exists("embedding", lambda x: x != 0)).withColumn("size", F.size("embedding"))


def _placed(rows: DataFrame) -> DataFrame:
    """The rows with two projections ``x`` and ``y``, by which they are dealt into cells."""
    def work(batches):
        for batch in batches:
            xy = np.zeros((batch.num_rows, 2))
            sizes = batch.column("size").to_numpy()
            for size in np.unique(sizes):
                at = np.flatnonzero(sizes == size)
                values = _unit(batch.column("embedding").take(pa.array(at)))
                values = values / np.abs(values).max(1, keepdims=True)
                xy[at] = values / np.linalg.norm(values, axis=1, keepdims=True) @ directions(int(size), PROJECTIONS + 2)[-2:].T
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(xy[:, 0]), pa.array(xy[:, 1])], [*batch.schema.names, "x", "y"])

    return rows.mapInArrow(work, "label string, size int, embedding array<double>, head long, n long, x double, y double")


def _dealt(heads: DataFrame, cosine: float) -> DataFrame:
    """Each vector as query and as targets, with the cell and the pair of chunks it belongs to."""
    key = ["label", "size"]
    sixteenths = [n / 16 for n in range(1, 16)]
    stats = heads.groupBy(*key).agg(
        F.count("*").alias("total"), F.percentile_approx("x", sixteenths).alias("xs"), F.percentile_approx("y", sixteenths).alias("ys"))
    side = F.sqrt(F.col("total") / CELL)
    step = F.when(side <= 1, 16).when(side <= 2, 8).when(side <= 4, 4).when(side <= 8, 2).otherwise(1)
    keep = lambda edges: F.filter(edges, lambda _, at: (at + 1) % F.col("step") == 0)
    stats = stats.withColumn("step", step).select(*key, keep("xs").alias("xs"), keep("ys").alias("ys"))
    reach = F.lit(CELL_WINDOW * math.sqrt(2 - 2 * cosine)) / F.sqrt("size")
    at = lambda edges, value: F.size(F.filter(edges, lambda edge: edge <= value))
    rows = heads.join(stats, key)
    span = lambda edges, value: F.sequence(at(edges, F.col(value) - reach), at(edges, F.col(value) + reach))
    targets = rows.withColumn("i", F.explode(span("xs", "x"))).withColumn("j", F.explode(span("ys", "y"))).withColumn("query", F.lit(False))
    queries = rows.withColumn("i", at("xs", F.col("x"))).withColumn("j", at("ys", F.col("y"))).withColumn("query", F.lit(True))
    cells = durable(queries.unionByName(targets).select(*key, "i", "j", "query", "head", "n", "embedding"), "cells")
    cell = [*key, "i", "j"]
    sizes = cells.groupBy(*cell).agg(
        F.ceil(F.count_if("query") / CHUNK).cast("int").alias("qs"), F.ceil(F.count_if(~F.col("query")) / CHUNK).cast("int").alias("ts")).where("qs > 0")
    joined = cells.join(sizes, cell)
    mine = F.pmod(F.xxhash64("head"), F.when(F.col("query"), F.col("qs")).otherwise(F.col("ts"))).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.when(F.col("query"), F.col("ts")).otherwise(F.col("qs")) - 1))
    return joined.withColumn("mine", mine).withColumn("other", other).withColumn(
        "q", F.when(F.col("query"), F.col("mine")).otherwise(F.col("other"))).withColumn(
        "t", F.when(F.col("query"), F.col("other")).otherwise(F.col("mine"))).select(*cell, "q", "t", "query", "head", "n", "embedding")


def collide(queries: np.ndarray, targets: np.ndarray, window: float, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows that collide in at least ``least`` projections (columns)."""
    counts = np.zeros((len(queries), len(targets)), np.int8)
    for n in range(queries.shape[1]):
        order = np.argsort(targets[:, n], kind="stable")
        line = targets[order, n]
        low, high = np.searchsorted(line, queries[:, n] - window), np.searchsorted(line, queries[:, n] + window, side="right")
        for row, (a, b) in enumerate(zip(low, high)):
            counts[row, order[a:b]] += 1
    return np.nonzero(counts >= least)


def _stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links from each id to the smallest that the given links reach."""
    ids, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = at[:len(a)], at[len(a):]
    low = np.arange(len(ids))
    while True:
        new = low.copy()
        np.minimum.at(new, x, low[y])
        np.minimum.at(new, y, low[x])
        new = new[new]
        if (new == low).all():
            break
        low = new
    far = low != np.arange(len(ids))
    return ids[far], ids[low[far]]


def _links(dealt: DataFrame, cosine: float) -> DataFrame:
    """Rows ``a``, ``b``, ``n``: a link from a to b (n null), or n more links of a (b null)."""
    least = least_collisions()

    def work(rows: pa.Table) -> pa.Table:
        ids, counts = rows.column("head").to_numpy(), rows.column("n").to_numpy()
        query = rows.column("query").to_numpy(zero_copy_only=False).astype(bool)
        values = _unit(rows.column("embedding").combine_chunks())
        values = values / np.abs(values).max(1, keepdims=True)
        unit = values / np.linalg.norm(values, axis=1, keepdims=True)
        projected = unit @ directions(unit.shape[1], PROJECTIONS + 2)[:PROJECTIONS].T
        q, t = np.flatnonzero(query), np.flatnonzero(~query)
        window = WINDOW * deviation(cosine, unit.shape[1]) + 1e-12
        found_a, found_b = [], []
        for at in range(0, len(q), 256):
            x, y = collide(projected[q[at:at + 256]], projected[t], window, least)
            x, y = q[at:at + 256][x], t[y]
            differ = ids[x] != ids[y]
            x, y = x[differ], y[differ]
            for part in range(0, len(x), 1 << 16):
                i, j = x[part:part + (1 << 16)], y[part:part + (1 << 16)]
                linked = np.einsum("nd,nd->n", unit[i], unit[j]) >= cosine
                found_a.append(i[linked])
                found_b.append(j[linked])
        a, b = (np.concatenate(f) if f else np.zeros(0, np.int64) for f in (found_a, found_b))
        sums = np.bincount(a, weights=counts[b], minlength=len(ids)).astype(np.int64)
        has = np.flatnonzero(sums)
        x, y = _stars(ids[a], ids[b])
        return pa.table([
            pa.array(np.concatenate((x, ids[has])), pa.int64()), pa.array([*y.tolist(), *[None] * len(has)], pa.int64()),
            pa.array([*[None] * len(x), *sums[has].tolist()], pa.int64())], ["a", "b", "n"])

    return dealt.groupBy("label", "size", "i", "j", "q", "t").applyInArrow(work, "a long, b long, n long")


def near_duplicates(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """``vec_id``, ``n_links``, ``component_id`` and ``kept`` for every row of ``vec_id``, ``embedding``, ``label``.

    Vectors link if their labels are equal and their cosine is at least ``cosine``. Null labels, null, empty or zero
    vectors and those with null or infinite components link with nothing; nor do vectors of different lengths. Equal
    vectors of a label are copies that share all links. Rows of one id count their links together and not each other.
    A null id gives 0 links, no component, and stays. Other columns are ignored.
    """
    rows = usable(vectors)
    groups = rows.groupBy("label", "size", "embedding").agg(F.min("vec_id").alias("head"), F.count_distinct("vec_id").alias("n"))
    heads = durable(_placed(groups), "heads")
    links = durable(_links(_dealt(heads, cosine), cosine), "links")
    same = ["label", "size", "embedding"]
    copies = durable(rows.select("vec_id", *same).distinct().join(heads.where("n > 1").select("head", "n", *same), same).select("vec_id", "head", "n"), "copies")
    found = components(links.where("b is not null").select("a", "b").unionByName(copies.select(F.col("vec_id").alias("a"), F.col("head").alias("b"))))
    own = links.where("b is null").groupBy("a").agg(F.sum("n").alias("n"))
    shared = copies.join(own, F.col("head") == F.col("a"), "left").select("vec_id", (F.coalesce(own["n"], F.lit(0)) + copies["n"] - 1).alias("n"))
    alone = own.join(copies.select("vec_id"), F.col("a") == F.col("vec_id"), "left_anti").select(F.col("a").alias("vec_id"), "n")
    counts = shared.unionByName(alone).groupBy(F.col("vec_id").alias("_vec")).agg(F.sum("n").alias("_n"))
    result = pick(vectors, vec_id="long").join(counts, F.col("vec_id") == F.col("_vec"), "left").join(
        found, F.col("vec_id") == F.col("id"), "left")
    component = F.coalesce("component", "vec_id")
    return result.select(
        "vec_id", F.coalesce("_n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"))
