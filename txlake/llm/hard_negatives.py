"""Hard negatives for anchors by L2AP-style threshold joins of anchors with all rows.

Anchors and rows are dealt to blocks by hash, and every block of anchors meets every block of rows in a task of its own.
There a threshold join finds the pairs that score at least an anchor's threshold. Dimensions come in strides, those that
weigh most over all rows first. A row's index covers strides only up to where the norm of what comes after, times the
anchor's, falls below the threshold; what it omits can't lift a pair over it. Partial scores are summed stride by stride,
and a pair goes as soon as its score so far plus the product of both remaining norms is below the threshold; few pairs see
the last strides. What is left has its exact score.

Thresholds begin high and are lowered for those anchors alone whose windows aren't full: first until a task has as many
rows of the anchor's own label as positives are asked for (or no lower score is possible), then, with the positives of all
tasks known, until each positive's window has its negatives or the threshold reaches the window's lower end. Every task
returns at most the rows that are asked for, of which Spark keeps the first.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from txlake.llm.schema_guard import durable, pick

POSITIVES = 5
NEGATIVES = 5
#: Negatives score between this part of the positive's score and all of it, in hundredths.
LOWEST, HIGHEST = 80, 100
SCALE = 256
ANCHOR_EVERY = 100
STRIDE = 16
#: Thresholds as parts of the highest possible score, for positives; and of a window's upper end, for negatives.
LEVELS = (0.8, 0.6, 0.45, 0.3, 0.15)
STEPS = (0.97, 0.93, 0.88)
#: Least and most anchors and rows of a block; in between they grow with the root of the table.
ANCHORS, ROWS = (1 << 10, 1 << 16), (1 << 12, 1 << 18)
#: Anchors and rows whose scores are held at once.
TILE = (512, 8192)
#: Longer vectors keep the order of their dimensions.
MOST_ORDERED = 1024
_EXACT = 2.0 ** 53
_HUGE = np.finfo(float).max
_LONG = 2 ** 63


def eligible(embeddings: DataFrame) -> DataFrame:
    """``vec_id``, ``label`` and ``v`` of the rows that take part, with ``row``, a hash that tells rows of one id apart; equal rows are one."""
    rows = pick(embeddings, vec_id="long", label="long", embedding="array<double>")
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & ~bad)
    return rows.select("vec_id", label.alias("label"), F.col("embedding").alias("v")).distinct().withColumn("row", F.xxhash64("label", "v"))


def _long(value: int) -> Column:
    return F.lit(value).cast("long")


def _parts(count: int, factor: float, least: int, most: int) -> int:
    return max(1, math.ceil(count / min(max(int(factor * math.sqrt(count)), least), most)))


class Vectors:
    """Rows of one length as whole numbers, with their norms from every stride on."""

    def __init__(self, frame: pd.DataFrame, order: np.ndarray):
        self.frame = frame.reset_index(drop=True)
        with np.errstate(over="ignore"):
            self.v = np.clip(np.floor(SCALE * np.stack(frame["v"].to_list()).astype(float)), -_HUGE, _HUGE)[:, order]
            squares = self.v * self.v
        ends = list(range(0, max(len(order), 1), STRIDE)) + [len(order)]
        rest = np.stack([squares[:, at:].sum(axis=1) for at in ends], axis=1)
        # A little more than the norm, so that rounding never cuts a pair off.
        self.rest = np.sqrt(rest) * (1 + 1e-9)
        self.ends = ends
        self.id = self.frame["vec_id"].to_numpy()
        self.row = self.frame["row"].to_numpy()
        self.label = self.frame["label"].to_numpy()

    def __len__(self) -> int:
        return len(self.frame)


def _exact(a: Vectors, i: np.ndarray, x: Vectors, j: np.ndarray) -> list[int]:
    """Scores of pairs beyond the range in which doubles count exactly."""
    return [max(-_LONG, min(_LONG - 1, sum(int(p) * int(q) for p, q in zip(a.v[m], x.v[n])))) for m, n in zip(i, j)]


def at_least(a: Vectors, wanted: np.ndarray, x: Vectors, rows: np.ndarray, threshold: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of anchors ``wanted`` and ``rows`` that score ``threshold`` (one per wanted anchor) or more: places of both, and scores."""
    cut = threshold - np.abs(threshold) * 1e-9
    score = np.zeros((len(rows), len(wanted)))
    for stride in range(len(a.ends) - 1):
        if not len(rows) or not len(wanted):
            break
        bound = score + np.outer(x.rest[rows, stride], a.rest[wanted, stride]) >= cut
        keep_rows, keep_wanted = bound.any(axis=1), bound.any(axis=0)
        if not keep_rows.all() or not keep_wanted.all():
            rows, wanted, cut, threshold = rows[keep_rows], wanted[keep_wanted], cut[keep_wanted], threshold[keep_wanted]
            score, bound = score[np.ix_(keep_rows, keep_wanted)], bound[np.ix_(keep_rows, keep_wanted)]
        if stride and bound.sum() < bound.size / 8:
            return _by_pair(a, wanted, x, rows, threshold, cut, score, bound, stride)
        part = slice(a.ends[stride], a.ends[stride + 1])
        score += x.v[rows, part] @ a.v[wanted, part].T
    j, i = np.nonzero(score >= threshold)
    return wanted[i], rows[j], score[j, i]


def _by_pair(a, wanted, x, rows, threshold, cut, score, bound, stride):
    """The rest of the strides for the few pairs that are left, one by one."""
    j, i = np.nonzero(bound)
    total = score[j, i]
    for at in range(stride, len(a.ends) - 1):
        alive = total + x.rest[rows[j], at] * a.rest[wanted[i], at] >= cut[i]
        i, j, total = i[alive], j[alive], total[alive]
        part = slice(a.ends[at], a.ends[at + 1])
        total = total + np.einsum("ij,ij->i", x.v[rows[j], part], a.v[wanted[i], part])
    alive = total >= threshold[i]
    return wanted[i[alive]], rows[j[alive]], total[alive]


def _first(group: np.ndarray, scores: np.ndarray, ids: np.ndarray, count: int) -> np.ndarray:
    """Places of the ``count`` best of each group: higher scores first, ties by smaller id."""
    order = np.lexsort((ids, -scores, group))
    sorted_group = group[order]
    start = np.flatnonzero(np.r_[True, sorted_group[1:] != sorted_group[:-1]]) if len(order) else np.zeros(0, int)
    rank = np.arange(len(order)) - np.repeat(start, np.diff(np.r_[start, len(order)]))
    return order[rank < count]


def _large(a: Vectors, x: Vectors) -> bool:
    """Whether scores may leave the whole numbers that doubles hold."""
    return not float(a.rest[:, 0].max()) * float(x.rest[:, 0].max()) < _EXACT


def _tiles(places: np.ndarray, size: int) -> list[np.ndarray]:
    return [places[at:at + size] for at in range(0, len(places), size)]


def _positives(a: Vectors, x: Vectors) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per anchor the first rows of its own label in the block: places of both, and scores."""
    found = []
    for label in np.unique(a.label):
        same = np.flatnonzero(x.label == label)
        for wanted in _tiles(np.flatnonzero(a.label == label), TILE[0]):
            held = (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
            for rows in _tiles(same, TILE[1]):
                if _large(a, x):
                    more = _all_positives(a, wanted, x, rows)
                else:
                    more = _tile_positives(a, wanted, x, rows, held)
                held = tuple(np.concatenate(pair) for pair in zip(held, more))
                best = _first(held[0], held[2], x.id[held[1]], POSITIVES)
                held = tuple(part[best] for part in held)
            found.append(held)
    return found


def _tile_positives(a: Vectors, wanted: np.ndarray, x: Vectors, rows: np.ndarray, held: tuple) -> tuple:
    """Anchors whose window is full need no score below its last one; for the others thresholds go down level by level."""
    last = np.full(len(a), -np.inf)
    counts = np.bincount(held[0], minlength=len(a))
    full = counts >= POSITIVES
    lowest = np.full(len(a), np.inf)
    np.minimum.at(lowest, held[0], held[2])
    last[full] = lowest[full]
    out = []
    top = a.rest[:, 0] * x.rest[rows, 0].max()
    for level in (*LEVELS, None):
        low = np.where(full[wanted], last[wanted], top[wanted] * level if level is not None else -2 * top[wanted] - 1)
        i, j, score = at_least(a, wanted, x, rows, low)
        other = (a.id[i] != x.id[j]) | (a.row[i] != x.row[j])
        i, j, score = i[other], j[other], score[other]
        done = full | (np.bincount(i, minlength=len(a)) >= POSITIVES) | (level is None)
        keep = done[i]
        out.append((i[keep], j[keep], score[keep]))
        wanted = wanted[~done[wanted]]
        if not len(wanted):
            break
    return tuple(np.concatenate(parts) for parts in zip(*out))


def _all_positives(a: Vectors, wanted: np.ndarray, x: Vectors, rows: np.ndarray) -> tuple:
    """For numbers too large for doubles: every score, one anchor at a time."""
    out = [(np.zeros(0, int), np.zeros(0, int), np.zeros(0, object))]
    for m in wanted:
        j = rows[(x.id[rows] != a.id[m]) | (x.row[rows] != a.row[m])]
        score = np.array(_exact(a, np.full(len(j), m), x, j), dtype=object)
        best = np.array(sorted(range(len(j)), key=lambda n: (-score[n], x.id[j[n]]))[:POSITIVES], dtype=int)
        out.append((np.full(len(best), m), j[best], score[best]))
    return tuple(np.concatenate(parts) for parts in zip(*out))


def _negatives(a: Vectors, x: Vectors) -> list[tuple]:
    """Per anchor and distinct positive score of 0 or more, the first negatives of the block: places, scores, the positive's score."""
    found = []
    for wanted in _tiles(np.arange(len(a)), TILE[0]):
        windows = {(m, int(p)): (np.zeros(0, int), np.zeros(0, object if _large(a, x) else float)) for m in wanted for p in set(a.frame["scores"][m]) if p >= 0}
        for rows in _tiles(np.arange(len(x)), TILE[1]):
            if _large(a, x):
                _all_negatives(a, x, rows, windows)
            else:
                _tile_negatives(a, x, rows, windows)
        found += [(np.full(len(j), m), j, score, np.full(len(j), p)) for (m, p), (j, score) in windows.items()]
    return found


def _fitting(x: Vectors, p: int, j: np.ndarray, score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first of candidates that lie in the window of positive score ``p``; its ends are tested with whole numbers."""
    fit = [n for n in range(len(j)) if LOWEST * p <= 100 * int(score[n]) <= HIGHEST * p]
    fit = sorted(fit, key=lambda n: (-score[n], x.id[j[n]]))[:NEGATIVES]
    return j[fit], score[fit]


def _tile_negatives(a: Vectors, x: Vectors, rows: np.ndarray, windows: dict) -> None:
    left = list(windows)
    for level in (*STEPS, LOWEST / 100):
        low: dict[int, float] = {}
        floor = {}
        for m, p in left:
            scores = windows[m, p][1]
            floor[m, p] = scores[-1] if len(scores) >= NEGATIVES else p * level
            low[m] = min(low.get(m, np.inf), floor[m, p])
        wanted = np.array(sorted(low), int)
        i, j, score = at_least(a, wanted, x, rows, np.array([low[m] for m in wanted]))
        other = a.label[i] != x.label[j]
        i, j, score = i[other], j[other], score[other]
        order = np.lexsort((x.id[j], -score, i))
        i, j, score = i[order], j[order], score[order]
        starts = dict(zip(wanted.tolist(), np.searchsorted(i, wanted).tolist()))
        ends = dict(zip(wanted.tolist(), np.searchsorted(i, wanted, "right").tolist()))
        again = []
        for m, p in left:
            mine = slice(starts[m], ends[m])
            s = score[mine]
            # Scores fall; those of the window lie between its upper end and its floor.
            begin, stop = np.searchsorted(-s, -p * HIGHEST / 100), np.searchsorted(-s, -floor[m, p], "right")
            held_j, held_score = windows[m, p]
            if len(held_j) < NEGATIVES and stop - begin < NEGATIVES and level > LOWEST / 100:
                again.append((m, p))
                continue
            # Ties at the last place are all equal but for their ids, which are in order.
            new = slice(begin, min(stop, begin + NEGATIVES))
            windows[m, p] = _fitting(x, p, np.r_[held_j, j[mine][new]], np.r_[held_score, s[new]])
        left = again
        if not left:
            return


def _all_negatives(a: Vectors, x: Vectors, rows: np.ndarray, windows: dict) -> None:
    for (m, p), (held_j, held_score) in windows.items():
        j = rows[x.label[rows] != a.label[m]]
        score = np.array(_exact(a, np.full(len(j), m), x, j), dtype=object)
        windows[m, p] = _fitting(x, p, np.r_[held_j, j], np.r_[held_score, score])


def _by_length(anchors: pd.DataFrame, rows: pd.DataFrame, order_of: dict[int, np.ndarray]):
    """Vectors of equal length; only those have inner products."""
    lengths = rows["v"].map(len)
    for length, mine in anchors.groupby(anchors["v"].map(len)):
        others = rows[lengths == length]
        if len(others):
            order = order_of.get(length, np.arange(length))
            yield Vectors(mine, order), Vectors(others, order)


def _frame(parts: list[dict], names: list[str]) -> pd.DataFrame:
    return pd.concat([pd.DataFrame(part) for part in parts], ignore_index=True)[names] if parts else pd.DataFrame({n: np.zeros(0, np.int64) for n in names})


POSITIVE_COLUMNS = ["anchor_id", "anchor_row", "other_id", "other_row", "score"]
NEGATIVE_COLUMNS = ["anchor_id", "anchor_row", "positive_score", "other_id", "other_row", "score"]


def positives_of_block(order_of: dict[int, np.ndarray]):
    def run(anchors: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for a, x in _by_length(anchors, rows, order_of):
            out += [{"anchor_id": a.id[i], "anchor_row": a.row[i], "other_id": x.id[j], "other_row": x.row[j], "score": score.astype(np.int64)} for i, j, score in _positives(a, x)]
        return _frame(out, POSITIVE_COLUMNS)
    return run


def negatives_of_block(order_of: dict[int, np.ndarray]):
    def run(anchors: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for a, x in _by_length(anchors, rows, order_of):
            out += [{"anchor_id": a.id[i], "anchor_row": a.row[i], "positive_score": p.astype(np.int64), "other_id": x.id[j], "other_row": x.row[j], "score": score.astype(np.int64)} for i, j, score, p in _negatives(a, x)]
        return _frame(out, NEGATIVE_COLUMNS)
    return run


def _heavy_first(rows: DataFrame) -> dict[int, np.ndarray]:
    """For the most frequent length, its dimensions by their sum of squares over all rows. The order changes no result."""
    common = rows.where(f"size(v) between 1 and {MOST_ORDERED}").groupBy(F.size("v").alias("length")).count().orderBy(F.desc("count"), "length").first()
    if not common:
        return {}
    length = common["length"]
    weights = rows.where(F.size("v") == length).agg(*[F.sum(F.least(F.abs(F.get("v", F.lit(at))), F.lit(1e100)) ** 2).alias(str(at)) for at in range(length)]).first()
    return {length: np.argsort(-np.array(list(weights), float), kind="stable")}


def _cells(anchors: DataFrame, rows: DataFrame, count: int, anchor_count: int, work, schema: str) -> DataFrame:
    """Every block of anchors with every block of rows, in a task of its own."""
    a_parts, x_parts = _parts(anchor_count, 16, *ANCHORS), _parts(count, 16, *ROWS)
    place = F.xxhash64("vec_id", "row")
    each_a = anchors.select("*", F.pmod(place, _long(a_parts)).alias("a_block"), F.explode(F.sequence(_long(0), _long(x_parts - 1))).alias("x_block"))
    each_x = rows.select("*", F.pmod(place, _long(x_parts)).alias("x_block"), F.explode(F.sequence(_long(0), _long(a_parts - 1))).alias("a_block"))
    cell = ["a_block", "x_block"]
    each_a = each_a.toDF(*each_a.columns)  # else its columns are those of the rows
    return each_a.groupBy(*cell).cogroup(each_x.groupBy(*cell)).applyInPandas(work, schema)


def hard_negatives(embeddings: DataFrame) -> DataFrame:
    """Per anchor and positive the first hard negatives: ``anchor_id``, ``positive_id``, ``rank``, ``negative_id``,
    ``positive_score``, ``negative_score``.

    Rows without an id, label or vector, or with a null or non-finite component, take no part. Equal rows (id, label and
    vector) are one row; rows that share only their id are different ones. Scores are inner products of whole numbers, exact
    at any size and kept within 64 bits; vectors of different lengths have none. A positive score below 0 has no negatives,
    as its window is empty. An empty table gives no rows.
    """
    rows = durable(eligible(embeddings), "vectors")
    anchors = rows.where(F.col("vec_id") % ANCHOR_EVERY == 0)
    count, anchor_count = rows.count(), anchors.count()
    order = _heavy_first(rows)
    numbers = lambda names: ", ".join(f"{name} long" for name in names)
    key = ["anchor_id", "anchor_row"]

    def best(found: DataFrame, group: list[str], most: int) -> DataFrame:
        first = Window.partitionBy(*group).orderBy(F.desc("score"), "other_id", "other_row")
        return found.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= most)

    found = _cells(anchors, rows, count, anchor_count, positives_of_block(order), numbers(POSITIVE_COLUMNS))
    positives = durable(best(found, key, POSITIVES).select(
        *key, F.col("other_id").alias("positive_id"), F.col("other_row").alias("positive_row"), F.col("score").alias("positive_score")), "positives")
    scores = positives.groupBy(*key).agg(F.collect_list("positive_score").alias("scores"))
    scores = scores.select(F.col("anchor_id").alias("vec_id"), F.col("anchor_row").alias("row"), "scores")
    found = _cells(anchors.join(scores, ["vec_id", "row"]), rows, count, anchor_count, negatives_of_block(order), numbers(NEGATIVE_COLUMNS))
    window = [*key, "positive_score"]
    negatives = best(found, window, NEGATIVES).select(*window, "rank", F.col("other_id").alias("negative_id"), F.col("score").alias("negative_score"))
    return positives.join(negatives, window).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
