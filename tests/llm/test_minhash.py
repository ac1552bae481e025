from collections import defaultdict

import numpy as np

from tests.llm.conftest import ROWS
from txlake.llm import prob_minhash
from txlake.llm.components import components
from txlake.llm.text_hash import mix


def jaccard(x, y):
    """The definition, term by term."""
    total = 0.0
    for i in x.keys() & y.keys():
        total += 1 / sum(max(x.get(j, 0) / x[i], y.get(j, 0) / y[i]) for j in x.keys() | y.keys())
    return total


def arrays(weights):
    keys = np.array(sorted(weights), np.uint64)
    return keys, np.array([weights[int(k)] for k in keys])


def test_similarity_is_the_definition():
    drawn = np.random.default_rng(1)
    for _ in range(30):
        x, y = ({int(k): int(drawn.integers(1, 5)) for k in drawn.integers(0, 15, 8)} for _ in range(2))
        assert abs(prob_minhash.probability_jaccard(arrays(x), arrays(y)) - jaccard(x, y)) < 1e-9


def test_signatures_agree_as_often_as_weights_are_similar():
    x, y = {n: 1 + n % 3 for n in range(60)}, {n: 1 + n % 2 for n in range(20, 80)}
    (a, wa), (b, wb) = arrays(x), arrays(y)
    owners = np.repeat([0, 1], [len(a), len(b)])
    won = prob_minhash.signatures(owners, mix(np.concatenate((a, b))), np.concatenate((wa, wb)).astype(float), 2, 6000)
    assert abs((won[0] == won[1]).mean() - jaccard(x, y)) < 0.03


def test_one_shingle_fills_all_registers():
    won = prob_minhash.signatures(np.array([0]), np.array([5], np.uint64), np.array([1.0]), 1, 80)
    assert (won == 5).all()


def expected(texts):
    weights, at = {}, defaultdict(set)
    for doc, text in texts:
        _, keys, counts, _ = prob_minhash.shingles([text.encode()])
        weights[doc] = (keys, counts)
        for key in keys.tolist():
            at[key].add(doc)
    parent = {doc: doc for doc, _ in texts}

    def root(doc):
        while parent[doc] != doc:
            doc = parent[doc]
        return doc

    for a, b in {(a, b) for docs in at.values() for a in docs for b in docs if a < b}:
        if prob_minhash.probability_jaccard(weights[a], weights[b]) >= 0.8 - 1e-12:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    return {doc: root(doc) for doc in parent}


def test_classes_of_documents(documents, texts):
    assert {r.doc_id: r.class_id for r in prob_minhash.near_duplicates(documents).collect()} == expected(texts)


def test_links_that_miss_the_hub_are_found(spark):
    """A chain: each text is similar to the next, the ends are not, and the hub of a bucket is only one of them."""
    words = [f"w{n}" for n in range(400)]
    chain = [(n + 1, " ".join(words[n * 20:n * 20 + 300])) for n in range(5)]
    rows = prob_minhash.near_duplicates(spark.createDataFrame(chain, "doc_id long, text string")).collect()
    assert {r.doc_id: r.class_id for r in rows} == expected(chain)


def test_edges(edge, empty):
    rows = prob_minhash.near_duplicates(edge).collect()
    known = [(i, t or "") for i, t in ROWS if i is not None]
    assert sorted((r.doc_id, r.class_id) for r in rows if r.doc_id is not None) == sorted((i, expected(known)[i]) for i, _ in known)
    assert [r.class_id for r in rows if r.doc_id is None] == [None]
    assert prob_minhash.near_duplicates(empty).collect() == []


def test_components(spark):
    links = [(n, n + 1) for n in range(1, 30)] + [(40, 50), (50, 45), (60, 60)]
    found = components(spark.createDataFrame(links, "a long, b long")).collect()
    assert {r.id: r.component for r in found} == {n: 1 for n in range(1, 31)} | {40: 40, 45: 40, 50: 40}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []
