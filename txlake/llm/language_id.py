"""Language of whole documents by a byte convolutional network.

Filters of several widths slide over the bytes of a fixed-length window; each filter's largest answer goes through a
rectifier into a softmax over the languages. The network is trained in numpy on a bounded sample of labelled documents.
A document is the mean of all its windows' answers, each weighed by the letters in it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window, functions as F

from txlake.llm.schema_guard import pick
from txlake.llm.text_hash import chunks

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 12
SAMPLE_PER_LANGUAGE = 400  # documents; the bound of what training sees
WINDOWS_PER_DOCUMENT = 4
EPOCHS = 6
UNKNOWN = "und"
MIN_SCORE = 0.4
_BATCH = 64
_ROWS = 512  # whose texts a task holds as Python strings at a time
_SEED = 7
_LETTER = regex.compile(r"\p{L}")
_LETTER_BYTE = np.zeros(256, np.float32)
_LETTER_BYTE[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1


class ByteNetwork:
    """Tables of what each byte adds to each filter at each of its places, and the softmax above the filters."""

    def __init__(self, languages: list[str]):
        drawn = np.random.Generator(np.random.PCG64(_SEED))
        self.languages = languages
        # Filters are ordered from wide to narrow, so that place k concerns a leading part of them.
        self.spans = [FILTERS * sum(w > k for w in WIDTHS) for k in range(max(WIDTHS))]
        self.tables = [(drawn.standard_normal((256, span)) * 0.1).astype(np.float32) for span in self.spans]
        self.bias = np.zeros(self.spans[0], np.float32)
        self.out = (drawn.standard_normal((self.spans[0], len(languages))) * 0.1).astype(np.float32)
        self.shift = np.zeros(len(languages), np.float32)

    def answers(self, windows: np.ndarray) -> np.ndarray:
        """What every filter gives at every place of the windows (rows of bytes)."""
        places = windows.shape[1] - len(self.tables) + 1
        total = self.tables[0][windows[:, :places]]
        for k, span in enumerate(self.spans[1:], 1):
            total[:, :, :span] += self.tables[k][windows[:, k:places + k]]
        return total

    def _top(self, pooled: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        hidden = np.maximum(pooled + self.bias, 0)
        scores = hidden @ self.out + self.shift
        scores = np.exp(scores - scores.max(1, keepdims=True))
        return hidden, scores / scores.sum(1, keepdims=True)

    def predict(self, windows: np.ndarray) -> np.ndarray:
        """Probability of each language for each window."""
        parts = [self._top(self.answers(windows[at:at + _BATCH]).max(1))[1] for at in range(0, len(windows), _BATCH)]
        return np.concatenate(parts) if parts else np.zeros((0, len(self.languages)), np.float32)

    def train(self, windows: np.ndarray, labels: np.ndarray, epochs: int = EPOCHS, rate: float = 0.01) -> None:
        """Adam on cross-entropy; the gradient of a filter goes to the place of its largest answer."""
        drawn = np.random.Generator(np.random.PCG64(_SEED))
        weights = [*self.tables, self.bias, self.out, self.shift]
        first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
        step = 0
        for _ in range(epochs):
            order = drawn.permutation(len(windows))
            for at in range(0, len(order), _BATCH):
                rows = order[at:at + _BATCH]
                answers = self.answers(windows[rows])
                place = answers.argmax(1)
                hidden, odds = self._top(np.take_along_axis(answers, place[:, None], 1)[:, 0])
                wrong = odds.copy()
                wrong[np.arange(len(rows)), labels[rows]] -= 1
                wrong /= len(rows)
                back = (wrong @ self.out.T) * (hidden > 0)
                slopes = [np.zeros_like(t) for t in self.tables]
                for k, span in enumerate(self.spans):
                    seen = np.take_along_axis(windows[rows], place[:, :span] + k, 1)
                    np.add.at(slopes[k], (seen, np.arange(span)[None]), back[:, :span])
                slopes += [back.sum(0), hidden.T @ wrong, wrong.sum(0)]
                step += 1
                for w, m, v, g in zip(weights, first, second, slopes):
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    w -= rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)


def windows_of(data: bytes) -> np.ndarray:
    """All bytes of a text in windows of equal length; the last one ends with the text, or with spaces in a short text."""
    bytes_ = np.frombuffer(data, np.uint8)
    if len(bytes_) <= WINDOW:
        return np.concatenate((bytes_, np.full(WINDOW - len(bytes_), 32, np.uint8)))[None]
    whole = len(bytes_) // WINDOW
    rows = bytes_[:whole * WINDOW].reshape(-1, WINDOW)
    return rows if whole * WINDOW == len(bytes_) else np.concatenate((rows, bytes_[None, -WINDOW:]))


def held_out(doc_id: str = "doc_id") -> Column:
    """Documents that training never sees: CRC-32 of the id's digits leaves 2 modulo 4."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE) -> ByteNetwork:
    """A network fitted on at most ``per_language`` documents of each language: those with the smallest hashes of their ids.

    Only ids and languages are ranked, and each task keeps no more than the sample of what it ranks; of the chosen
    documents ``WINDOWS_PER_DOCUMENT`` windows at hashed places come to the driver.
    """
    docs = pick(docs, doc_id="long", text="string", lang="string")
    known = docs.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & F.col("doc_id").isNotNull() & ~held_out())
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id"))
    chosen = known.select("doc_id", "lang").withColumn("rank", rank).where(F.col("rank") <= per_language).select(
        F.col("doc_id").alias("id")).distinct()
    size = F.length("text")
    places = [F.pmod(F.xxhash64("doc_id", F.lit(n)), F.greatest(size - WINDOW, F.lit(1))).cast("int") + 1 for n in range(WINDOWS_PER_DOCUMENT)]
    # Languages times the sample: a bounded side.
    rows = known.join(F.broadcast(chosen), F.col("doc_id") == F.col("id")).select(
        "doc_id", "lang", F.array(*[F.substring(F.col("text"), place, F.lit(WINDOW)) for place in places]).alias("parts")).orderBy("doc_id", "lang").collect()
    languages = sorted({r["lang"] for r in rows})
    network = ByteNetwork(languages or [UNKNOWN])
    if len(languages) > 1:
        pairs = sorted({(part, languages.index(r["lang"])) for r in rows for part in r["parts"] if _LETTER.search(part)})
        windows = np.concatenate([windows_of(part.encode())[:1] for part, _ in pairs])
        network.train(windows, np.array([label for _, label in pairs]))
    return network


def predict(docs: DataFrame, network: ByteNetwork) -> DataFrame:
    """``doc_id``, ``lang_pred`` and ``score`` of every row of ``doc_id``, ``text``.

    A text that is null or has no letter is ``und`` with score 0. The score is the mean probability of the language.
    Null ids are kept, repeated rows repeat, other columns are ignored.
    """
    def of_chunk(held: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        parts = [windows_of(data) for data in held]
        windows = np.concatenate(parts)
        weight = _LETTER_BYTE[windows].sum(1)
        odds = network.predict(windows) * weight[:, None]
        at = np.cumsum([0, *map(len, parts)])[:-1]
        odds = np.add.reduceat(odds, at) / np.maximum(np.add.reduceat(weight, at), 1)[:, None]
        return odds.argmax(1), odds.max(1)

    def work(batches):
        for batch in batches:
            texts = batch.column(1).to_pylist()
            named, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
            lettered = [n for n, text in enumerate(texts) if text and _LETTER.search(text)]
            for first, held in chunks(texts[n].encode() for n in lettered):
                best, odds = of_chunk(held)
                for n, language, score in zip(lettered[first:first + len(held)], best, odds):
                    named[n], scores[n] = network.languages[language], min(1.0, float(score))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(named, pa.string()), pa.array(scores)], ["doc_id", "lang_pred", "score"])

    return pick(docs, doc_id="long", text="string").mapInArrow(work, "doc_id long, lang_pred string, score double")


def identify(docs: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE) -> DataFrame:
    """``doc_id``, ``held_out``, ``lang_pred`` and ``score`` of all documents, by a network trained on them.

    Without two labelled languages everything that has letters is the one language, or ``und`` where there is none; a
    table without rows gives none.
    """
    return predict(docs, train(docs, per_language)).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """The documents, with all their columns, whose language is known with at least ``min_score``. Rows without an id go
    by the text they have."""
    network = train(docs)
    names = docs.schema.names

    def work(batches):
        for batch in (whole.slice(at, _ROWS) for whole in batches for at in range(0, whole.num_rows, _ROWS)):
            table = pa.Table.from_batches([batch])
            texts = table.column(names.index("text")).cast(pa.string()).to_pylist()
            keep = np.zeros(len(texts), bool)
            lettered = [n for n, text in enumerate(texts) if text and _LETTER.search(text)]
            for n in lettered:
                windows = windows_of(texts[n].encode())
                weight = _LETTER_BYTE[windows].sum(1)
                odds = weight @ network.predict(windows) / max(1.0, weight.sum())
                keep[n] = odds.max() >= min_score
            yield from table.filter(pa.array(keep)).to_batches()

    return docs.mapInArrow(work, docs.schema)
