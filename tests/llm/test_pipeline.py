import re

import corpus_pipeline
from txlake.catalog.registry import ORACLES, QUERIES
from txlake.llm import bpe, prob_minhash, queries

SF = "/root/testdata/sf0.001"


def test_every_operator_has_one_query():
    numbers = [int(found[1]) for name in QUERIES if (found := re.match(r"op(\d+)_", name))]
    assert sorted(numbers) == list(range(1, 14)) and "pipeline" in QUERIES and corpus_pipeline.ORACLE_SQL is None
    assert {"op3_embedding_dedup", "op5_warc_revisit", "op6_substring_dedup"} <= set(ORACLES)


def test_stages_one_by_one(spark, documents, texts):
    docs, seen = documents, []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        rows = docs.collect()
        seen.append(rows)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == documents.columns
            docs = spark.createDataFrame(rows, documents.schema)
    known, lines, unique, clean, tokens = seen
    assert {r.doc_id for r in known} == {doc for doc, text in texts if text.strip()}
    assert {r.doc_id for r in lines} == {r.doc_id for r in known} and all(r.n_chars == len(r.text) for r in lines)
    classes = prob_minhash.near_duplicates(spark.createDataFrame(lines, documents.schema)).collect()
    assert {r.doc_id for r in unique} == {r.class_id for r in classes}
    assert {r.doc_id for r in clean} <= {r.doc_id for r in unique} and len(clean) < len(unique)
    wanted = bpe.round_trip(spark.createDataFrame(clean, documents.schema), queries.public_tokenizers.path(queries.BPE_FILE))
    assert sorted(tokens) == sorted(wanted.collect())
    assert sorted(corpus_pipeline.run(spark, SF).collect()) == sorted(tokens)


def test_stages_on_edges(spark, edge):
    docs = edge.selectExpr("doc_id", "text", "case when doc_id > 4 then 'aa' else 'bb' end lang", "block source", "cast(1 as bigint) n_chars")
    for frame in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            kept = stage(spark, frame, SF)
            assert kept.columns == frame.columns
            assert kept.count() <= frame.count()
