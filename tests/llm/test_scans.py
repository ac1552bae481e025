"""Decontamination, licences, languages."""

import itertools
import zlib

import numpy as np

from tests.llm.conftest import ROWS
from txlake.llm import decontaminate, language_id, license_scan
from txlake.llm.text_hash import words


def numbers(text):
    return words([decontaminate.plain(text)])[2]


def slow_tiles(item, doc, least):
    """Greedy tiling by looking at every pair of places."""
    free_a, free_b, found = [True] * len(item), [True] * len(doc), []
    while True:
        best = (least - 1, 0, 0)
        for i in range(len(item)):
            for j in range(len(doc)):
                n = 0
                while i + n < len(item) and j + n < len(doc) and item[i + n] == doc[j + n] and free_a[i + n] and free_b[j + n]:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        n, i, j = best
        if n < least:
            return found
        free_a[i:i + n], free_b[j:j + n] = [False] * n, [False] * n
        found.append((i, j, n))


def test_tiles_are_greedy():
    drawn = np.random.default_rng(2)
    for _ in range(40):
        item, doc = drawn.integers(0, 3, 25).astype(np.uint64), drawn.integers(0, 3, 40).astype(np.uint64)
        assert sorted(decontaminate.tile(item, doc, 3)) == sorted(slow_tiles(item.tolist(), doc.tolist(), 3))


def test_leaks_in_any_order(spark):
    item = [f"q{n}" for n in range(40)]
    swapped = item[20:] + ["between"] + item[:20]
    docs = spark.createDataFrame([
        (1, "before it " + " ".join(item).upper() + ", after"), (2, " ".join(swapped)), (3, " ".join(item[:15])), (4, " ".join(reversed(item))), (5, None), (None, " ".join(item)),
        (6, "some " * 50)], "doc_id long, text string")
    bench = spark.createDataFrame([(7, " ".join(item)), (8, "too short"), (9, None), (10, "")], "item_id long, text string")
    rows = decontaminate.leaks(docs, bench).collect()
    assert sorted((r.doc_id or 0, r.item_id, r.coverage, len(r.tiles)) for r in rows) == [(0, 7, 1.0, 1), (1, 7, 1.0, 1), (2, 7, 1.0, 2)]
    assert sorted(r.doc_id or 0 for r in decontaminate.clean(docs, bench).collect()) == [0, 3, 4, 5, 6]
    assert decontaminate.leaks(docs, bench.limit(0)).collect() == []
    assert decontaminate.leaks(docs.limit(0), bench).collect() == []


def test_leaks_by_blocks_of_the_benchmark(spark, documents, monkeypatch):
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    key = lambda rows: sorted((r.doc_id, r.item_id, r.covered) for r in rows)
    whole = key(decontaminate.leaks(documents, bench).collect())
    slow = []
    items = {r.item_id: numbers(r.text).tolist() for r in bench.collect()}
    for row in documents.collect():
        mine = numbers(row.text).tolist()
        for item, there in items.items():
            if set(mine) >= set(there) and (covered := sum(t[2] for t in slow_tiles(there, mine, 5))) >= 0.6 * len(there):
                slow.append((row.doc_id, item, covered))
    assert set(slow) <= set(whole)
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 4000)
    assert key(decontaminate.leaks(documents, bench).collect()) == whole


def test_each_row_is_decontaminated_by_its_own_text(spark):
    item = " ".join(f"q{n}" for n in range(20))
    docs = spark.createDataFrame(
        [(None, item, "a"), (None, "clean", "b"), (1, item, "c"), (1, "clean too", "d"), (2, "see Tower of Hanoi.", "e"), (3, "Hanoi of tower", "f")],
        "doc_id long, text string, name string")
    bench = spark.createDataFrame([(7, item), (8, "tower of Hanoi"), (9, "?!")], "item_id long, text string")
    assert sorted(r.name for r in decontaminate.clean(docs, bench).collect()) == ["a", "b", "d", "f"]
    assert sorted((r.doc_id or 0, r.item_id) for r in decontaminate.leaks(docs, bench).collect()) == [(0, 7), (1, 7), (2, 8)]


def test_leaks_edges(edge, spark):
    bench = spark.createDataFrame([(1, ROWS[0][1])], "item_id long, text string")
    assert sorted(r.doc_id or 0 for r in decontaminate.leaks(edge, bench).collect()) == [0, 1, 4]
    assert set(decontaminate.clean(edge, bench).columns) == set(edge.columns)


def test_licences_with_changes(spark):
    text = license_scan.TEMPLATES["mit"].replace("free of charge", "at no cost").replace("sublicense, ", "")
    before = "Größe. "
    docs = spark.createDataFrame([(1, before + text + " The end."), (2, "all RIGHTS\nreserved!"), (3, "rights all reserved"), (4, None), (5, ""), (None, "All rights reserved")], "doc_id long, text string")
    rows = license_scan.licences(docs).collect()
    assert sorted((r.doc_id or 0, r.template) for r in rows) == [(0, "all-rights-reserved"), (1, "mit"), (2, "all-rights-reserved")]
    found = next(r for r in rows if r.doc_id == 1)
    assert (before + text).encode()[found.first_byte:found.end_byte].decode() == text.rstrip(".") and 0.9 < found.coverage < 1
    assert license_scan.licences(docs.limit(0)).collect() == []
    assert license_scan.licences(docs, {}).collect() == []


def test_licences_of_documents(documents, edge):
    """Whole notices, found by search, are all reported; edges give no row."""
    rows = {(r.doc_id, r.template) for r in license_scan.licences(documents).where("coverage = 1").collect()}
    for name, notice in license_scan.TEMPLATES.items():
        there = {
            (r.doc_id, name) for r in documents.collect() if b" " + b" ".join(license_scan.plain(notice).split()) + b" " in b" " + b" ".join(license_scan.plain(r.text).split()) + b" "}
        assert {x for x in rows if x[1] == name} == there
    assert license_scan.licences(edge).collect() == []


def test_licences_with_each_word_changed(spark):
    """Every choice of changed words of a notice of up to 20 words that leaves 0.8 of them, and a word put in anywhere."""
    templates = license_scan.TEMPLATES | {"fifteen": " ".join(f"w{n}" for n in range(15))}
    texts, expected = [], set()
    for name, notice in templates.items():
        there = license_scan.plain(notice).decode().split()
        if len(there) > 20:
            continue
        most = int(len(there) * 0.2 + 1e-9)
        for changed in itertools.chain.from_iterable(itertools.combinations(range(len(there)), k) for k in range(most + 1)):
            expected.add((len(texts), name, len(there) - len(changed)))
            texts.append(" ".join(f"x{n}" if n in changed else word for n, word in enumerate(there)))
        for n in range(1, len(there)):
            expected.add((len(texts), name, len(there)))
            texts.append(" ".join(there[:n] + ["really"] + there[n:]))
    docs = spark.createDataFrame([(n, f"some words {t} and more") for n, t in enumerate(texts)], "doc_id long, text string")
    rows = [(r.doc_id, r.template, r.matched) for r in license_scan.licences(docs, templates).collect()]
    assert expected <= set(rows) and len(rows) == len(set(rows))


def test_licences_that_repeat_close_by(spark):
    """Each short notice two to five times in a row, whole, with words between, and with one of the copies changed."""
    texts, expected = [], set()

    def add(name, copies, between=""):
        at, parts = len("before "), []
        for copy in copies:
            parts.append(copy)
            expected.add((len(texts), name, at, at + len(copy)))
            at += len(copy) + len(between) + 1
        texts.append("before " + f" {between}".join(parts) + " after")

    for name, notice in license_scan.TEMPLATES.items():
        there = license_scan.plain(notice).decode().split()
        if len(there) > 20:
            continue
        whole = " ".join(there)
        for count in range(2, 6):
            add(name, [whole] * count)
            add(name, [whole] * count, "and again ")
            for n in range(1, len(there) - 1) if len(there) > 4 else ():
                changed = " ".join(there[:n] + ["x"] + there[n + 1:])
                add(name, [changed] + [whole] * (count - 1))
                add(name, [whole] * (count - 1) + [changed])
                add(name, [changed] * count)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = [(r.doc_id, r.template, r.first_byte, r.end_byte) for r in license_scan.licences(docs).collect()]
    rows = [r for r in rows if r[1] in {e[1] for e in expected if e[0] == r[0]}]
    assert set(rows) == expected and len(rows) == len(expected)


def test_winnowing_keeps_one_of_each_window():
    grams = np.random.default_rng(1).integers(0, 50, 200).astype(np.uint64)
    chosen = set(license_scan.winnow(grams).tolist())
    assert all(chosen & set(range(n, n + license_scan.WINNOW)) for n in range(len(grams) - license_scan.WINNOW + 1))


def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = language_id.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == 1000 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    unseen = [r for r in rows if r.held_out]
    assert np.mean([r.lang == r.lang_pred for r in unseen]) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_edges(edge, empty):
    from pyspark.sql import functions as F

    labelled = edge.withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "aa").otherwise("bb"))
    rows = {(r.doc_id, r.lang_pred) for r in language_id.identify(labelled).collect()}
    assert {(2, "und"), (3, "und"), (8, "und")} <= rows and len(rows) == 10
    assert language_id.identify(labelled.limit(0)).collect() == []
    assert {r.lang_pred for r in language_id.identify(labelled.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    kept = language_id.keep_identified(labelled)
    assert kept.columns == labelled.columns and not {2, 3, 8} & {r.doc_id for r in kept.collect()}


def test_network_learns_places_it_pools():
    network = language_id.ByteNetwork(["a", "b"])
    drawn = np.random.default_rng(3)
    windows = drawn.integers(97, 110, (400, language_id.WINDOW)).astype(np.uint8)
    labels = np.arange(400) % 2
    windows[labels == 1, 100:103] = np.frombuffer(b"xyz", np.uint8)
    network.train(windows[:300], labels[:300], epochs=15)
    assert (network.predict(windows[300:]).argmax(1) == labels[300:]).mean() > 0.95
