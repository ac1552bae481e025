import numpy as np
import pandas as pd
import pytest

from tests.llm.conftest import plain
from txlake.llm import hard_negatives

COLUMNS = "vec_id long, embedding array<float>, label int, row long, v string, a_block int, scores string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, label, 1, "v", 2, "s") for i, v, label in rows], COLUMNS).repartition(3)


def clustered(count, seed):
    draw = np.random.default_rng(seed)
    centres = draw.normal(size=(6, 20))
    vectors = centres[draw.integers(0, 6, count)] + 0.4 * draw.normal(size=(count, 20))
    return [(n, [float(np.float32(x)) for x in vectors[n] / np.linalg.norm(vectors[n])], int(draw.integers(0, 4))) for n in range(count)]


def test_against_sql(spark, by_sql, monkeypatch):
    """Many blocks; ties, copies under other ids, zero vectors, odd rows."""
    monkeypatch.setattr(hard_negatives, "ANCHORS", (2, 2))
    monkeypatch.setattr(hard_negatives, "ROWS", (150, 150))
    rows = clustered(700, 3)
    rows += [(1000 + n, rows[n % 4 * 100][1], n % 4) for n in range(60)]
    rows += [(1100 + n, [0.0] * 20, 1) for n in range(4)] + [(1200, [0.5] * 20, 2), (1300, [-0.5] * 20, 3)]
    rows += [(1400, [0.1, 0.2], 1), (1401, [0.1, 0.2], 1), (1402, [0.1, 0.18], 2), (1500, [], 1), (1501, [], 1), (1502, [], 2)]
    rows += [rows[100]] * 3 + [(None, rows[0][1], 1), (1600, None, 1), (1700, rows[0][1], None), (1800, [None] * 20, 1), (1900, [float("nan")] * 20, 1), (1901, [float("inf")] * 20, 1)]
    docs = frame(spark, rows)
    got = plain(hard_negatives.hard_negatives(docs))
    wanted = by_sql("op12_hard_negatives", "embeddings", docs.select("vec_id", "embedding", "label"))
    assert got == wanted and len(got) > 100
    assert hard_negatives.hard_negatives(docs.limit(0)).collect() == []


@pytest.mark.parametrize("scale", [1.0, 1e-3, 1e12])
def test_blocks_against_all_scores(monkeypatch, scale):
    """Tiles that carry full windows on, levels, both kinds of numbers."""
    monkeypatch.setattr(hard_negatives, "TILE", (7, 40))
    rows = pd.DataFrame([(n, [x * scale for x in v], label, n % 5) for n, v, label in clustered(300, 7)], columns=["vec_id", "v", "label", "row"])
    anchors = rows[rows.vec_id % 20 == 0]
    whole = np.array([[int(np.floor(256 * x)) for x in v] for v in rows.v], dtype=object)
    scores = whole @ whole.T
    got = hard_negatives.positives_of_block({})(anchors, rows)
    lists = []
    for m in anchors.vec_id:
        same = [n for n in rows.vec_id if n != m and rows.label[n] == rows.label[m]]
        best = sorted(same, key=lambda n: (-scores[m, n], n))[:5]
        mine = got[got.anchor_id == m].sort_values(["score", "other_id"], ascending=[False, True])
        clip = lambda s: max(-2 ** 63, min(2 ** 63 - 1, s))
        if abs(scores).max() < 2 ** 63:
            assert list(mine.other_id) == best
        assert list(mine.score) == sorted((clip(scores[m, n]) for n in same), reverse=True)[:5]
        lists.append(list(mine.score))
    if abs(scores).max() >= 2 ** 63:
        return
    found = hard_negatives.negatives_of_block({})(anchors.assign(scores=lists), rows)
    for m, positive in zip(anchors.vec_id, lists):
        for p in set(positive):
            fit = [n for n in rows.vec_id if rows.label[n] != rows.label[m] and 80 * p <= 100 * scores[m, n] <= 100 * p]
            mine = found[(found.anchor_id == m) & (found.positive_score == p)].sort_values(["score", "other_id"], ascending=[False, True])
            assert list(mine.other_id) == sorted(fit, key=lambda n: (-scores[m, n], n))[:5]


def test_pairs_at_a_threshold():
    rows = pd.DataFrame([(n, v, label, 0) for n, v, label in clustered(200, 11)], columns=["vec_id", "v", "label", "row"])
    vectors = hard_negatives.Vectors(rows, np.arange(20)[::-1])
    scores = vectors.v @ vectors.v.T
    for threshold in (-1e9, 0.0, 20000.0, 50000.0, 65000.0, 1e9):
        i, j, score = hard_negatives.at_least(vectors, np.arange(200), vectors, np.arange(200), np.full(200, threshold))
        assert set(zip(i, j)) == set(zip(*np.nonzero(scores >= threshold)))
        assert all(scores[a, b] == s for a, b, s in zip(i, j, score))
