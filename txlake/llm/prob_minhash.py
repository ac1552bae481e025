"""Near-duplicate documents by ProbMinHash signatures of weighted word shingles, banding and exact verification.

Every shingle is a Poisson process whose rate is its weight; its arrivals fall on random registers, and a register keeps
the shingle that arrives first. A shingle's arrivals end once they come later than every register's first. Two signatures
agree in a register with the probability Jaccard similarity of the shingle weights, which verification computes exactly.

Documents of the same word sequence are one text. In a bucket of equal bands each text is first verified against the
bucket's smallest and largest id only, so a bucket with a third of all documents gives two pairs per document. Where that
leaves a bucket in several components, signatures of all its texts are compared across components. Pairs of a small
bucket are then verified like the first ones; a large bucket is cut into blocks, and each pair of blocks verifies its
pairs where they are found and gives no more than the links that join components.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from txlake.llm.components import components
from txlake.llm.schema_guard import durable, pick
from txlake.llm.text_hash import chunks, mix, window_owner, windows, words

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 20, 4
GROUP = 64
LARGE = 256
BLOCK = 512
_SLACK = 5.0
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def shingles(texts: list[bytes], size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """Distinct shingles of each document: document, fingerprint, count; and a digest of each document's words.

    A document of fewer words than a shingle has one shingle, all its words; one without words has none.
    """
    _, _, hashes, first = words(texts)
    places, owners = window_owner(first, size)
    keys = windows(hashes, size)[places]
    counts = np.diff(first)
    for n in np.flatnonzero((counts > 0) & (counts < size)):
        keys = np.append(keys, windows(hashes[first[n]:first[n + 1]], int(counts[n])))
        owners = np.append(owners, n)
    order = np.lexsort((keys, owners))
    keys, owners = keys[order], owners[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (owners[1:] != owners[:-1])
    heads = np.flatnonzero(new)
    digests = [hashlib.blake2b(hashes[a:b].tobytes(), digest_size=16).digest() for a, b in zip(first[:-1], first[1:])]
    return owners[heads], keys[heads], np.diff(np.append(heads, len(keys))), digests


def signatures(owners: np.ndarray, keys: np.ndarray, weights: np.ndarray, documents: int, registers: int) -> np.ndarray:
    """The first shingle to arrive at each register of each document; 0 where a document has no shingle."""
    times = np.full(documents * registers, np.inf)
    winners = np.zeros(documents * registers, np.uint64)
    latest = np.full(documents, np.inf)
    active, clock, done = np.arange(len(keys)), np.zeros(len(keys)), 0
    while len(active):
        count = int(min(512, max(1, 65536 // len(active))))
        draws = mix(keys[active][:, None] + np.arange(done + 1, done + count + 1, dtype=np.uint64) * _GOLDEN)
        waits = -np.log1p(-((draws >> np.uint64(11)).astype(np.float64) / 2.0 ** 53))
        arrivals = clock[:, None] + np.cumsum(waits, 1)
        at = owners[active][:, None] * registers + (mix(draws) % np.uint64(registers)).astype(np.int64)
        scaled = arrivals / weights[active][:, None]
        early = scaled < times[at]
        place, time = at[early], scaled[early]
        np.minimum.at(times, place, time)
        won = times[place] == time
        winners[place[won]] = np.broadcast_to(keys[active][:, None], at.shape)[early][won]
        latest = times.reshape(documents, registers).max(1)
        clock, done = arrivals[:, -1], done + count
        stays = scaled[:, -1] < latest[owners[active]]
        active, clock = active[stays], clock[stays]
    return winners.reshape(documents, registers)


def probability_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Exact probability Jaccard similarity of two weighted sets (sorted keys, weights); of sets it is plain Jaccard.

    The sum over shared i of 1 / sum over j of max(x_j / x_i, y_j / y_i), with all j ordered by x_j / y_j.
    """
    keys = np.union1d(a[0], b[0])
    x, y = np.zeros(len(keys)), np.zeros(len(keys))
    x[np.searchsorted(keys, a[0])], y[np.searchsorted(keys, b[0])] = a[1], b[1]
    with np.errstate(divide="ignore"):
        ratio = x / y
    order = np.argsort(ratio, kind="stable")
    x, y, ratio = x[order], y[order], ratio[order]
    first = np.searchsorted(ratio, ratio)
    above = np.concatenate((np.cumsum(x[::-1])[::-1], [0]))[first]
    below = np.concatenate(([0], np.cumsum(y)))[first]
    both = (x > 0) & (y > 0)
    return float(np.sum(1 / (above[both] / x[both] + below[both] / y[both])))


def signed(docs: DataFrame, size: int, bands: int, rows: int) -> DataFrame:
    """``doc_id``, ``words_digest``, ``signature`` (4 bytes a register) and ``buckets`` of documents that have words."""
    def work(batches):
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), [(t or "").encode() for t in batch.column(1).to_pylist()]
            for first, held in chunks(texts):
                owners, keys, counts, digests = shingles(held, size)
                won = signatures(owners, keys, counts.astype(float), len(held), bands * rows)
                has = np.bincount(owners, minlength=len(held)) > 0
                band = windows_of(won, bands, rows)
                n = [i for i in range(len(held)) if has[i] and ids[first + i] is not None]
                yield pa.RecordBatch.from_arrays([
                    pa.array([ids[first + i] for i in n], pa.int64()), pa.array([digests[i] for i in n], pa.binary()),
                    pa.array([won[i].astype("<u4").tobytes() for i in n], pa.binary()),
                    pa.array([band[i] for i in n], pa.list_(pa.int64()))], ["doc_id", "words_digest", "signature", "buckets"])

    return docs.mapInArrow(work, "doc_id long, words_digest binary, signature binary, buckets array<long>")


def windows_of(won: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One fingerprint per band of a signature; the band's number is part of it."""
    keys = np.full((len(won), bands), 0, np.uint64) + mix(np.arange(1, bands + 1, dtype=np.uint64))
    for n in range(rows):
        keys = mix(keys * _GOLDEN + won.reshape(len(won), bands, rows)[:, :, n])
    return keys.view(np.int64)


def verify(pairs: DataFrame, docs: DataFrame, size: int, similarity: float) -> DataFrame:
    """Of the pairs ``a``, ``b`` (an id may stand in ``b`` of any number) those at least as similar, with ``similarity``.

    The members of one ``b`` go to several tasks with ``b``'s text in each; a text goes only where a pair needs it.
    """
    sizes = pairs.groupBy(F.col("b").alias("hub")).agg(F.count("*").alias("n"))
    salted = pairs.join(sizes, F.col("b") == F.col("hub")).select(
        "a", "b", F.pmod(F.xxhash64("a"), F.ceil(F.col("n") / GROUP)).alias("part"))
    wanted = salted.select(F.col("a").alias("doc"), "b", "part").unionByName(
        salted.select(F.col("b").alias("doc"), "b", "part").distinct())
    # Merge: the texts are shuffled at any size, so small inputs show what large ones cost.
    rows = wanted.join(docs.hint("merge"), F.col("doc") == F.col("doc_id")).select("b", "part", "doc", "text")

    def work(group: pa.Table) -> pa.Table:
        hub = group.column("b")[0].as_py()
        ids, texts = group.column("doc").to_pylist(), group.column("text")
        weighted = lambda n: shingles([(texts[n].as_py() or "").encode()], size)[1:3]
        centre = weighted(ids.index(hub))
        found = [(i, hub, probability_jaccard(weighted(n), centre)) for n, i in enumerate(ids) if i != hub]
        found = [f for f in found if f[2] >= similarity - 1e-12]
        columns = list(zip(*found)) or [(), (), ()]
        return pa.table([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.float64())], ["a", "b", "similarity"])

    return rows.groupBy("b", "part").applyInArrow(work, "a long, b long, similarity double")


def likely(marks: np.ndarray, one: np.ndarray, there: np.ndarray, band: int, bands: int, least: float) -> np.ndarray:
    """Those of the texts whose signatures agree with ``one`` in at least ``least`` registers, and in no band before ``band``."""
    same = marks[there] == one
    there, same = there[same.sum(1) >= least], same[same.sum(1) >= least]
    return there[same.reshape(len(there), bands, len(one) // bands).all(2).argmax(1) == band]


def least_agreement(registers: int, similarity: float) -> float:
    """Agreements of a pair at ``similarity``, less five standard deviations."""
    return registers * similarity - _SLACK * np.sqrt(registers * similarity * (1 - similarity))


def band_of(marks: np.ndarray, bands: int) -> int:
    """Which band of a bucket's members is equal: the first in which all agree with the first member."""
    return int((marks == marks[0]).reshape(len(marks), bands, marks.shape[1] // bands).all((0, 2)).argmax())


def across(members: DataFrame, bands: int, rows: int, similarity: float) -> DataFrame:
    """Pairs of one small bucket and different components whose signatures agree about as often as similar texts' do."""
    least = least_agreement(bands * rows, similarity)

    def work(group: pa.Table) -> pa.Table:
        ids, parts = group.column("doc_id").to_numpy(), group.column("component").to_numpy()
        marks = np.frombuffer(b"".join(group.column("signature").to_pylist()), "<u4").reshape(len(ids), bands * rows)
        band, found = band_of(marks, bands), []
        for n in range(len(ids)):
            there = np.flatnonzero((parts != parts[n]) & (ids > ids[n]))
            found.extend((int(i), int(ids[n])) for i in ids[likely(marks, marks[n], there, band, bands, least)])
        columns = list(zip(*found)) or [(), ()]
        return pa.table([pa.array(c, pa.int64()) for c in columns], ["a", "b"])

    return members.groupBy("bucket").applyInArrow(work, "a long, b long").distinct()


def joined_across(members: DataFrame, docs: DataFrame, size: int, bands: int, rows: int, similarity: float) -> DataFrame:
    """Links between components of one large bucket. ``members`` has the bucket's size in ``n``.

    A bucket is cut into blocks of texts, and each pair of blocks is one group with the texts in it, so no group grows
    with the bucket. Pairs that a link in the group has joined meanwhile aren't compared any more.
    """
    least = least_agreement(bands * rows, similarity)
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    placed = members.withColumn("block", F.pmod(F.xxhash64("doc_id"), blocks).cast("int")).withColumn(
        "other", F.explode(F.sequence(F.lit(0), blocks - 1))).select(
        "bucket", F.col("doc_id").alias("doc"), "component", "signature", "block", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"))
    texts = placed.join(docs.hint("merge"), F.col("doc") == F.col("doc_id")).drop("doc_id")

    def work(group: pa.Table) -> pa.Table:
        ids, parts = group.column("doc").to_numpy(), group.column("component").to_numpy().copy()
        mine, x, y = group.column("block").to_numpy(), group.column("x")[0].as_py(), group.column("y")[0].as_py()
        marks = np.frombuffer(b"".join(group.column("signature").to_pylist()), "<u4").reshape(len(ids), bands * rows)
        band, found = band_of(marks, bands), []
        weighted = [shingles([(t.as_py() or "").encode()], size)[1:3] for t in group.column("text")]
        vocabulary, at = np.unique(np.concatenate([k for k, _ in weighted]), return_inverse=True)
        at = np.split(at, np.cumsum([len(k) for k, _ in weighted])[:-1])
        plain = [int(c.max()) == 1 for _, c in weighted]
        right, present = np.flatnonzero(mine == y), np.zeros(len(vocabulary), bool)
        for n in np.flatnonzero(mine == x):
            there = right[parts[right] != parts[n]]
            there = likely(marks, marks[n], there[ids[there] > ids[n]] if x == y else there, band, bands, least)
            present[at[n]] = True
            for m in there:
                if parts[m] == parts[n]:
                    continue
                if plain[n] and plain[m]:
                    both = np.count_nonzero(present[at[m]])
                    alike = both / (len(at[n]) + len(at[m]) - both)
                else:
                    alike = probability_jaccard(weighted[n], weighted[m])
                if alike >= similarity - 1e-12:
                    found.append((int(max(ids[n], ids[m])), int(min(ids[n], ids[m]))))
                    parts[parts == parts[m]] = parts[n]
            present[at[n]] = False
        columns = list(zip(*found)) or [(), ()]
        return pa.table([pa.array(c, pa.int64()) for c in columns], ["a", "b"])

    return texts.groupBy("bucket", "x", "y").applyInArrow(work, "a long, b long")


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, size: int = SHINGLE, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """``doc_id`` and ``class_id`` of every row: the smallest id that verified links of at least ``similarity`` reach.

    Shingles are ``size`` words (runs without ASCII white space, unchanged), weighted by how often they occur. A text of
    no words (null, empty, white space) is in no class but its own, as is a row without an id (``class_id`` null).
    Of an id that repeats the smallest text counts, for all its rows; other columns are ignored. Of pairs at the threshold
    the default bands miss about 3 in 100,000, of more similar ones fewer.
    """
    docs = pick(docs, doc_id="long", text="string")
    one = docs.groupBy("doc_id").agg(F.min("text").alias("text")) if _repeats(docs) else docs
    marks = durable(signed(one, size, bands, rows), "signatures")
    texts = durable(marks.groupBy("words_digest").agg(F.min("doc_id").alias("head"), F.count("*").alias("n")), "texts")
    copies = marks.select("doc_id", "words_digest").join(texts.where("n > 1"), "words_digest").where("doc_id <> head").select(
        F.col("doc_id").alias("a"), F.col("head").alias("b"))
    heads = marks.join(texts.select("head"), F.col("doc_id") == F.col("head"), "left_semi")
    banded = heads.select("doc_id", F.explode("buckets").alias("bucket"))
    shared = banded.groupBy("bucket").agg(F.min("doc_id").alias("hub"), F.max("doc_id").alias("last"), F.count("*").alias("n")).where("n > 1")
    members = durable(banded.join(shared, "bucket"), "buckets")
    pairs = members.select(F.col("doc_id").alias("a"), F.explode(F.array("hub", "last")).alias("b")).where("a <> b").distinct()
    links = durable(verify(pairs, one, size, similarity), "links")
    found = components(links.select("a", "b"))
    labelled = members.join(found, F.col("doc_id") == F.col("id"), "left").select(
        "bucket", "doc_id", "n", F.coalesce("component", "doc_id").alias("component"))
    mixed = labelled.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("bucket")
    loose = durable(labelled.join(mixed, "bucket").join(
        heads.select(F.col("doc_id").alias("_id"), "signature"), F.col("doc_id") == F.col("_id")).drop("_id"), "loose")
    pairs = durable(across(loose.where(F.col("n") <= LARGE), bands, rows, similarity), "pairs")
    more = durable(verify(pairs, one, size, similarity), "links")
    large = durable(joined_across(loose.where(F.col("n") > LARGE), one, size, bands, rows, similarity), "links")
    found = components(links.select("a", "b").unionByName(more.select("a", "b")).unionByName(large).unionByName(copies))
    return docs.select("doc_id").join(found, F.col("doc_id") == F.col("id"), "left").select(
        "doc_id", F.coalesce("component", "doc_id").alias("class_id"))


def _repeats(docs: DataFrame) -> bool:
    """Whether an id stands in several rows; only then are texts grouped by id before they are verified."""
    return bool(docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").head(1))
