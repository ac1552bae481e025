"""Removal of lines whose words an earlier line has too, by an exact set-similarity join. DataFrame functions only.

A line is the set of its words. With the words of every line in one order, rarest first, two sets of Jaccard similarity
``t`` or more share a word among the first ``n - ceil(t n) + 1`` of each (prefix filter). Pairs that meet there must have
sizes within ``t`` of each other (length filter), places that leave enough words to share (positional filter), and a
parity of their words, 64 bits or 128 for long lines, that differs in no more bits than the sets may differ in words. The
few that are left are verified on the whole sets.

Rarity is counted over all lines, in ``RARITY`` buckets of words, as a power of two; of equally rare words the longer come
first. Any order gives the same result, a good one gives fewer pairs. Lines of equal sets are one. The join gives no pairs:
only whether some earlier line is similar matters, so it is a semi-join with the filters in its condition, and gives a line
at most once per prefix word.

Words are compared by name: 52 bits of their hash behind their rarity and length. Two different words of one line pair share
a name with a probability of 2^-52 times the pairs of words at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from txlake.llm.schema_guard import durable, fresh, pick

SIMILARITY = 0.8
RARITY = 1 << 16
_MOST = 31
_NAME_BITS = 58
_MARKS = 1 << 18
_LONG = 72
_TWIN = -1


def line_table(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``line`` (from 0; rows of one id follow each other) and ``content`` of every line of every text."""
    if _repeats(docs):
        rank = F.row_number().over(Window.partitionBy("doc_id").orderBy("text")) - 1
        docs = docs.withColumn("copy", rank.cast("long"))
    else:
        docs = docs.withColumn("copy", F.lit(0).cast("long"))
    return docs.select("doc_id", "copy", F.posexplode(F.split("text", "\n", -1)).alias("at", "content")).select(
        "doc_id", (F.shiftleft("copy", 32) + F.col("at")).alias("line"), "content")


def line_words(content: str = "content") -> Column:
    """Words of a line: runs without ASCII white space."""
    return F.array_remove(F.split(_spaced(content), " ", -1), "")


def _spaced(content: str = "content") -> Column:
    """The line with spaces for its other white space. Translating goes character by character, so it is left to lines that need it."""
    other = "\t\x0b\x0c\r"
    needs = F.lit(False)
    for mark in other:
        needs = needs | F.contains(F.col(content), F.lit(mark))
    return F.when(needs, F.translate(content, other, "    ")).otherwise(F.col(content))


def _dense(sparse: DataFrame, size: int, value: str) -> DataFrame:
    """One row: column ``value`` of every ``bucket`` below ``size`` as an array, 0 where there is none."""
    every = sparse.sparkSession.range(size).select(F.col("id").cast("int").alias("bucket")).join(sparse, "bucket", "left").select(
        "bucket", F.coalesce(value, F.lit(0)).alias(value))
    return every.agg(F.array_sort(F.collect_list(F.struct("bucket", value))).getField(value).alias("values"))


def _name(word: Column) -> Column:
    """A word's number, longer words first: 6 bits of its length, then 57 of its hash."""
    short = F.lit(63) - F.least(F.octet_length(word), F.lit(63))
    return F.shiftleft(short.cast("long"), 57).bitwiseOR(F.shiftrightunsigned(F.xxhash64(word), 7))


def _bucket(name: Column) -> Column:
    return name.bitwiseAND(RARITY - 1).cast("int")


def rarity(lines: DataFrame) -> DataFrame:
    """One row: for every bucket of words how often they occur, as a power of two above ``_NAME_BITS``. Its size is fixed.

    Only spaces end words here: rarity orders words and decides nothing, so lines aren't searched for other white space.
    """
    counts = lines.select(F.explode(F.split("content", " ", -1)).alias("word")).groupBy(_bucket(F.shiftrightunsigned(F.xxhash64("word"), 7)).alias("bucket")).count()
    power = F.least(F.floor(F.log2("count")), F.lit(_MOST)).cast("long")
    return _dense(counts.select("bucket", F.shiftleft(power, _NAME_BITS).alias("power")), RARITY, "power")


def word_keys(words: Column, counts: Column) -> Column:
    """Distinct words as sorted numbers: how frequent, then the longer, then a fingerprint."""
    def key(name: Column) -> Column:
        # Never null, and said so: numbers without nulls are sorted as they are.
        return F.coalesce(F.get(counts, _bucket(name)), F.lit(0)).bitwiseOR(F.shiftrightunsigned(name, 63 - _NAME_BITS))

    # Two steps, as a function of an array's elements computes what it names twice twice. What stands inside of one isn't
    # compiled, so equal words are taken out last.
    return F.sort_array(F.array_distinct(F.transform(F.transform(words, _name), key)))


def parity(keys: Column) -> Column:
    """64 bits, each the parity of how many words fall on it."""
    return F.aggregate(keys, F.lit(0).cast("long"), lambda bits, key: bits.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), key.bitwiseAND(63).cast("int"))))


def odd_parity(keys: Column) -> Column:
    """The same of every other word only, for lines of ``_LONG`` words; 0 for others. With it, the words fall on 128 bits:
    sets that may differ in many words would pass for similar on 64 bits by chance."""
    def flip(bits: Column, key: Column) -> Column:
        return bits.bitwiseXOR(F.call_function("shiftleft", F.shiftright(key, 6).bitwiseAND(1), key.bitwiseAND(63).cast("int")))

    return F.when(F.size(keys) >= _LONG, F.aggregate(keys, F.lit(0).cast("long"), flip)).otherwise(F.lit(0).cast("long"))


def least_shared(a: Column, b: Column, similarity: float) -> Column:
    """Words that sets of these sizes share at ``similarity``."""
    return F.ceil((a + b) * (similarity / (1 + similarity)) - 1e-9)


def _maybe(df: DataFrame, wanted: DataFrame, key: list[str]) -> DataFrame:
    """``df`` without most rows whose key isn't among ``wanted``, without a shuffle: a table of bits, whose size is fixed, tells
    them. The more keys are wanted, the more others stay."""
    hashed = F.xxhash64(*key)
    bucket, bit = hashed.bitwiseAND(_MARKS - 1).cast("int"), F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(hashed, 58).cast("int"))
    marks = durable(_dense(wanted.groupBy(bucket.alias("bucket")).agg(F.bit_or(bit).alias("bits")), _MARKS, "bits"), "marks")
    return df.withColumn("marks", marks.scalar()).where(F.get("marks", bucket).bitwiseAND(bit) != 0).drop("marks")


def _keyed(lines: DataFrame, counts: DataFrame) -> DataFrame:
    # The optimizer puts the one row of counts, a scalar subquery, where the column stands.
    return lines.withColumn("counts", counts.scalar()).select("doc_id", "line", word_keys(line_words(), F.col("counts")).alias("keys"))


def similar_lines(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``doc_id`` and ``line`` of every line for which an earlier one (smaller id, or before it in the document) has a word
    set of Jaccard similarity ``similarity`` or more. Judged on the input: the earlier line may itself be one of these."""
    lines = line_table(docs.where("doc_id is not null and text is not null"))
    counts = durable(rarity(lines), "rarity")
    n = F.size("keys")
    prefix = F.slice("keys", 1, (n - F.ceil(n * similarity - 1e-9) + 1).cast("int"))
    # Looks at a line's ends only; a test on the keys would be pushed down and make them a second time. Lines of other white
    # space go below, where they have no word.
    worded = lines.where(F.trim("content") != "")
    sets = _keyed(worded, counts).select(
        "doc_id", "line", n.alias("n"), prefix.alias("prefix"), parity(F.col("keys")).alias("parity"), odd_parity(F.col("keys")).alias("odd"),
        F.xxhash64("keys").alias("set"), F.hash("keys").alias("check"))
    # Of lines of equal sets the first one goes on; each other has one row, with a word that is no name. Equal lines are sorted
    # in one task, outside its memory if they are many, and read one by one.
    copy = F.row_number().over(Window.partitionBy("set", "check", "n").orderBy("doc_id", "line"))
    # Written first: the joins below then read plain rows, which are shuffled once for both their sides.
    words = durable(sets.withColumn("copy", copy).select(
        "doc_id", "line", "n", "parity", "odd",
        F.posexplode(F.when(F.col("copy") == 1, F.col("prefix")).when(F.col("n") > 0, F.array(F.lit(_TWIN).cast("long")))).alias("at", "word")), "words")
    twins = words.where(F.col("word") == _TWIN).select("doc_id", "line")
    more = _with_similar(*_meetings(words.where(F.col("word") != _TWIN), similarity), lines, counts, similarity)
    # Written, so that what these joins shuffled is gone before whole texts are.
    return durable(twins.unionByName(more), "similar")


def _renamed(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(c).alias(f"other_{c}") for c in df.columns])


def _earlier() -> Column:
    return (F.col("other_doc_id") < F.col("doc_id")) | (F.col("other_doc_id") == F.col("doc_id")) & (F.col("other_line") < F.col("line"))


def _meetings(words: DataFrame, similarity: float) -> tuple[DataFrame, DataFrame]:
    """Words where a line meets an earlier one that the filters leave: those of the later lines and those of the earlier ones.

    Two semi-joins: a line is given once per word, whatever the number of lines that it meets there. The second one looks
    only for the lines that the first one found.
    """
    # None of them is null; said so, no side gets a filter of its own.
    rows = words.select(*[F.coalesce(c, F.lit(0)).alias(c) for c in ("word", "doc_id", "line", "n", "parity", "odd", "at")])

    def fits(mine: DataFrame, other: DataFrame) -> Column:
        n, other_n = mine["n"], other["other_n"]
        needed = least_shared(n, other_n, similarity)
        differs, odd = mine["parity"].bitwiseXOR(other["other_parity"]), mine["odd"].bitwiseXOR(other["other_odd"])
        bits = F.when(F.least(n, other_n) >= _LONG, F.bit_count(differs.bitwiseXOR(odd)) + F.bit_count(odd)).otherwise(F.bit_count(differs))
        # First what settles nearly all pairs: half of the bits, in no more places than ``needed`` leaves at any sizes.
        unlike = (1 - similarity) / (1 + similarity)
        return (mine["word"] == other["other_word"]) & (F.bit_count(differs) <= (n + other_n) * unlike + 1e-6) & _earlier() & (F.least(n, other_n) >= F.greatest(n, other_n) * similarity - 1e-9) & (
            F.least(n - mine["at"], other_n - other["other_at"]) >= needed) & (
            bits <= n + other_n - 2 * needed)

    other = _renamed(rows)
    later = durable(rows.join(other, fits(rows, other), "left_semi"), "later")
    other = _renamed(_maybe(rows, later, ["word"]))
    earlier = durable(other.join(later, fits(later, other), "left_semi").select(
        F.col("other_word").alias("word"), F.col("other_doc_id").alias("doc_id"), F.col("other_line").alias("line")), "earlier")
    return later.select("word", "doc_id", "line"), earlier


def _with_similar(later: DataFrame, earlier: DataFrame, lines: DataFrame, counts: DataFrame, similarity: float) -> DataFrame:
    """Ids of the later lines of which an earlier line, met at one of their words, is similar: whole sets are compared.

    First with the first line met at each word, which settles most lines that have many words with their like in common. What
    that leaves is compared with all, in a join that gives a line once per word at most.
    """
    key = ["doc_id", "line"]
    wanted = durable(later.select(*key).unionByName(earlier.select(*key)).distinct(), "wanted-ids")
    # Merge: lines are shuffled at any size, so small inputs show what large ones cost.
    sets = durable(_keyed(_maybe(lines, wanted, key).join(wanted.hint("merge"), key, "left_semi"), counts), "wanted")
    heads = earlier.groupBy("word").agg(F.min(F.struct(*key)).alias("head")).select(
        "word", F.col("head.doc_id").alias("other_doc_id"), F.col("head.line").alias("other_line"))
    pairs = later.join(heads, "word").where(_earlier()).drop("word").distinct()
    others = _renamed(sets)
    found = durable(pairs.join(sets, key).join(others, ["other_doc_id", "other_line"]).where(_alike(similarity)).select(*key).distinct(), "found")

    left = durable(later.join(found, key, "left_anti"), "left")
    mine = left.join(sets, key)
    met = _renamed(earlier.join(left.select("word").distinct(), "word", "left_semi").join(sets, key))
    similar = (mine["word"] == met["other_word"]) & _earlier() & _alike(similarity)
    return found.unionByName(mine.join(met, similar, "left_semi").select(*key).distinct())


def _alike(similarity: float) -> Column:
    n, other_n = F.size("keys"), F.size("other_keys")
    return (F.least(n, other_n) >= F.greatest(n, other_n) * similarity - 1e-9) & (
        F.size(F.array_intersect("keys", "other_keys")) >= least_shared(n, other_n, similarity))


def remove_lines(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Documents (all their columns) without the lines that ``similar_lines`` finds, with ``n_lines`` and ``n_removed``.

    Lines end at a line feed; what is left is joined by line feeds again. Lines without words never match and stay. A
    null text stays null and rows without an id stay whole. Rows of one id are taken in the order of their texts. Columns
    named like the two added ones are replaced.
    """
    kept = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    gone_id, gone, mine, copy = fresh(docs, "_gone_id", "_gone", "_mine", "_copy")
    found = similar_lines(pick(docs, doc_id="long", text="string"), similarity).groupBy(F.col("doc_id").alias(gone_id)).agg(
        F.collect_list("line").alias(gone))
    rows = docs.select(*[f"`{c}`" for c in kept])
    number = F.lit(0).cast("long")
    if _repeats(docs):
        number = (F.row_number().over(Window.partitionBy("doc_id").orderBy(F.col("text").cast("string"))) - 1).cast("long")
    joined = rows.withColumn(copy, number).join(found, F.col("doc_id").cast("long") == F.col(gone_id), "left")
    at = F.transform(F.filter(gone, lambda line: F.shiftright(line, 32) == F.col(copy)), lambda line: line.bitwiseAND(0xFFFFFFFF).cast("int"))
    joined = joined.withColumn(mine, F.when(F.col(gone).isNotNull(), at))
    lines = F.split("text", "\n", -1)
    # Linear in the lines, also of a document that loses many of very many; in an array of one, they are split only once.
    places = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(mine))
    whole = F.transform(F.array(F.struct(lines.alias("lines"), places.alias("places"))), lambda x: F.transform(x["places"], lambda n: F.get(x["lines"], n)))
    left = F.array_join(F.get(whole, F.lit(0)), "\n")
    some = F.coalesce(F.size(mine) > 0, F.lit(False)) & F.col("text").isNotNull()
    return joined.select(
        *[F.when(some, left).otherwise(F.col("text")).alias("text") if c == "text" else f"`{c}`" for c in kept],
        F.when(F.col("text").isNull(), 0).otherwise(F.size(lines)).cast("long").alias("n_lines"),
        F.when(some, F.size(mine)).otherwise(0).cast("long").alias("n_removed"))


def _repeats(docs: DataFrame) -> bool:
    return bool(docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").head(1))
