import math

import numpy as np

from txlake.llm import embedding_dedup

SCHEMA = "vec_id long, embedding array<float>, label int, n int, head long, x double, id long"


def expected(rows):
    good = [(i, np.array(v, float), label) for i, v, label in rows if i is not None and label is not None and v and all(
        x is not None and math.isfinite(x) for x in v) and any(v)]
    links = {(a, b) for a, u, k in good for b, w, m in good if a != b and k == m and len(u) == len(w)
             and u @ w / math.sqrt(u @ u) / math.sqrt(w @ w) >= 0.98}
    low = {i: i for i, _, _ in rows if i is not None}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            if low[b] < low[a]:
                low[a], changed = low[b], True
    return {i: (sum(a == i for a, _ in links), low[i], low[i] == i) for i in low}


def result(spark, rows):
    frame = spark.createDataFrame([(i, v, k, 1, 2, 0.5, 3) for i, v, k in rows], SCHEMA)
    return embedding_dedup.near_duplicates(frame).collect()


def test_clusters_in_cells(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "CELL", 30)
    monkeypatch.setattr(embedding_dedup, "CHUNK", 40)
    drawn = np.random.default_rng(4)
    centres = drawn.standard_normal((20, 32))
    rows = [(n, (centres[n % 20] + drawn.standard_normal(32) * drawn.choice([0.05, 0.1, 0.16])).astype("f4").tolist(), n % 20 % 3) for n in range(500)]
    rows += [(1000 + n, rows[n][1], rows[n][2]) for n in range(0, 60, 2)]
    found = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in result(spark, rows)}
    wanted = expected(rows)
    assert sum(n for n, _, _ in found.values()) >= 0.999 * sum(n for n, _, _ in wanted.values())
    assert all(found[i][0] <= wanted[i][0] for i in wanted)
    assert sum(found[i] == wanted[i] for i in wanted) >= 0.99 * len(wanted)


def test_edges(spark):
    rows = [
        (1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [1.0, 0.0], 2), (4, None, 1), (5, [0.0, 0.0], 1), (6, [1.0, None], 1), (7, [float("nan"), 1.0], 1),
        (8, [float("inf"), 1.0], 1), (9, [1.0, 0.0], None), (10, [], 1), (11, [1.0, 0.0, 0.0], 1), (12, [1.0, 0.0], 1), (None, [1.0, 0.0], 1),
        (13, [0.0, 1.0], 1), (14, [1e-30, 0.0], 1)]
    found = result(spark, rows)
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in found if r.vec_id is not None} == expected(rows)
    assert [(r.n_links, r.component_id, r.kept) for r in found if r.vec_id is None] == [(0, None, True)]
    assert result(spark, []) == []


def test_count_is_calibrated():
    least = embedding_dedup.least_collisions()
    hit = math.erf(embedding_dedup.WINDOW / math.sqrt(2))
    n = embedding_dedup.PROJECTIONS
    recall = lambda low: sum(math.comb(n, k) * hit ** k * (1 - hit) ** (n - k) for k in range(low, n + 1))
    assert recall(least) >= embedding_dedup.RECALL > recall(least + 1)
