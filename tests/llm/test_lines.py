import random

from tests.llm.conftest import ROWS
from txlake.llm import line_dedup


def later(lines, similarity=0.8):
    """Lines (document, number, text) in order, compared with all before them."""
    seen, found = [], set()
    for doc, number, text in lines:
        mine = set(text.translate({9: 32, 11: 32, 12: 32, 13: 32}).split(" ")) - {""}
        if not mine:
            continue
        if any(len(mine & other) / len(mine | other) >= similarity for other in seen):
            found.add((doc, number))
        seen.append(mine)
    return found


def test_texts_of_documents(documents, texts):
    found = later([(doc, n, line) for doc, text in texts for n, line in enumerate(text.split("\n"))])
    rows = line_dedup.remove_lines(documents).collect()
    assert len(rows) == len(texts)
    for row in rows:
        text = dict(texts)[row.doc_id]
        assert row.text == "\n".join(line for n, line in enumerate(text.split("\n")) if (row.doc_id, n) not in found)
        assert row.n_lines == text.count("\n") + 1 and row.n_removed == sum(doc == row.doc_id for doc, _ in found)


def test_variants_of_one_line(spark):
    words = [f"w{n}" for n in range(30)]
    rows = [(n, " ".join(words[:n % 30] + [f"x{n}"] + words[n % 30 + 1:])) for n in range(200)]
    rows += [(1000, " ".join(words[:15] + [f"y{n}" for n in range(15)]))]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    found = {(r.doc_id, r.line) for r in line_dedup.similar_lines(frame).collect()}
    assert found == later([(doc, 0, text) for doc, text in rows])


def test_edges(edge, empty):
    rows = line_dedup.remove_lines(edge).collect()
    assert len(rows) == len(ROWS) and set(edge.columns) <= set(rows[0].asDict())
    by_id = {r.doc_id: r for r in rows}
    assert by_id[2].text is None and (by_id[2].n_lines, by_id[2].n_removed) == (0, 0)
    assert (by_id[3].text, by_id[3].n_lines) == ("", 1)
    assert by_id[4].text == "" and by_id[4].n_removed == 1
    assert by_id[None].text == ROWS[0][1] and by_id[None].n_removed == 0
    assert by_id[8].text == "   \n\t \n"
    # The rows of one id follow each other; both resemble the document before them.
    assert [r.text for r in rows if r.doc_id == 6] == ["", ""]
    assert line_dedup.remove_lines(empty).collect() == []


def test_main_path_is_native(documents):
    plan = line_dedup.remove_lines(documents)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_thousands_of_variants_and_very_many_lines(spark):
    """2,000 variants of one line, similar in chains, and a document of 100,000 lines that loses half of them."""
    words = [f"w{n}" for n in range(24)]
    rows = [(n, " ".join(f"x{n % (5 + k)}" if (n * 7 + k) % 24 < 6 else words[k] for k in range(24))) for n in range(2000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    found = {(r.doc_id, r.line) for r in line_dedup.similar_lines(frame).collect()}
    assert found == later([(doc, 0, text) for doc, text in rows])
    text = "\n".join(f"number{n // 2} only" for n in range(100_000))
    (row,) = line_dedup.remove_lines(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert (row.n_lines, row.n_removed) == (100_000, 50_000)
    assert row.text == "\n".join(f"number{n} only" for n in range(50_000))


def test_only_lines_with_other_white_space_are_translated(spark):
    texts = ["a b", "a\tb", "\x0ba  b\r", "\x0c \t", "", "é\tü b"]
    frame = spark.createDataFrame([(n, t) for n, t in enumerate(texts)], "n int, content string")
    words = frame.select("n", line_dedup.line_words().alias("words"))
    assert [r.words for r in words.orderBy("n").collect()] == [["a", "b"], ["a", "b"], ["a", "b"], [], [], ["é", "ü", "b"]]
    plan = words._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("CASE WHEN") < plan.index("translate(")


def test_long_lines_of_other_words_are_no_candidates(spark, monkeypatch):
    """Lines of 150 words of 400 differ in more words than 64 bits can tell; none of them needs its whole set compared."""
    pick = random.Random(7)
    rows = [(n, " ".join(pick.sample([f"w{k:03}" for k in range(400)], 150))) for n in range(40)]
    sizes, durable = {}, line_dedup.durable

    def counted(frame, label):
        stored = durable(frame, label)
        sizes[label] = sizes.get(label, 0) + stored.count()
        return stored

    monkeypatch.setattr(line_dedup, "durable", counted)
    assert line_dedup.similar_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect() == []
    assert sizes["wanted"] == 0


def test_similar_lines_on_either_side_of_long(spark):
    """Sets just under and over the size from which a second half of the bits is made."""
    words = [f"v{k}" for k in range(90)]
    rows = [(n, " ".join(words[:size])) for n, size in enumerate((60, 71, 72, 73, 89, 57))]
    rows += [(10 + n, " ".join(words[:size - 8] + [f"u{n}x{k}" for k in range(8)])) for n, size in enumerate((66, 72, 80))]
    found = {(r.doc_id, r.line) for r in line_dedup.similar_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == later([(doc, 0, text) for doc, text in rows])


def test_other_white_space_is_looked_for_once_and_bits_come_first(spark, monkeypatch):
    """Each scan of a line and each test of a pair counts; lines of other white space only, however often, stay."""
    rows = [(n, f"\t\x0b\n\r\n \na b\tc d e{n % 2}\nf{n}\tg") for n in range(4)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    plans, durable = {}, line_dedup.durable

    def kept(frame, label):
        plans.setdefault(label, frame._jdf.queryExecution().optimizedPlan().toString())
        return durable(frame, label)

    monkeypatch.setattr(line_dedup, "durable", kept)
    found = {(r.doc_id, r.line) for r in line_dedup.similar_lines(frame).collect()}
    assert found == later([(doc, n, line) for doc, text in rows for n, line in enumerate(text.split("\n"))]) == {(2, 3), (3, 3)}
    assert plans["rarity"].count("Contains(") == 0 and plans["words"].count("Contains(") == 4
    condition = plans["later"][plans["later"].index("Join LeftSemi"):].split("\n")[0]
    assert condition.index("bit_count(") < condition.index("other_doc_id")
