"""Model features: encode, fill, scale, assemble, split."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.ml.feature import Bucketizer, VectorAssembler
from pyspark.sql import DataFrame, functions as F

from txlake.functions.calendar import weekend_flag
from txlake.functions.vocabulary import crosses_border, training_category
from txlake.operators.dictionary import dense_codes, with_code
from txlake.operators.ranking import order_statistic
from txlake.session import durable

CATEGORICAL = ["merchant_category", "payment_method"]
# Feature order of the model.
FEATURES = [
    "amount", "hour", "is_weekend", "is_international",
    "merchant_category_encoded", "payment_method_encoded", "log_amount",
]
# Fixed value: bins per feature of the boosted trees, as many as they part a feature into by default.
BINS = 32


def training_rows(tx: DataFrame) -> DataFrame:
    """Raw rows plus hour, weekend and border flags, category in the model's spelling."""
    return tx.withColumns({
        "hour": F.hour("timestamp"),
        "is_weekend": weekend_flag("timestamp"),
        "is_international": crosses_border("user_country", "merchant_country"),
        "merchant_category": training_category("merchant_category"),
    })


def stratified_split(rows: DataFrame, label: str, key: str = "transaction_id",
                     train_share: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """Train and test with the label's shares kept exactly, the same on every run.

    Rows are ordered by a hash of their key within each label; the cut is an order statistic, so no
    label is gathered in one task. The cuts, one per label, are stored as one map, so that the two parts don't rank all
    rows again, each for itself; nothing is joined on the label.
    """
    place = F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 12), 16, 10).cast("double")
    placed = rows.withColumn("_place", place)
    cut = order_statistic(
        placed, [label], "_place", lambda n: F.greatest(F.lit(1), F.floor(n * F.lit(train_share) + 0.5)), "_cut")
    cuts = durable(cut.agg(F.map_from_entries(F.collect_list(F.struct(label, "_cut"))).alias("cuts")), "cuts").scalar()
    marked = placed.filter(F.col(label).isNotNull()).withColumn("_train", F.col("_place") <= F.try_element_at(cuts, F.col(label)))
    return marked.filter("_train").select(*rows.columns), marked.filter("not _train").select(*rows.columns)


@dataclass(frozen=True)
class FeatureState:
    """What was learnt from the training rows: vocabularies (tables of label and code), means and deviations, and
    the edges between the bins of every scaled feature."""

    vocabularies: dict[str, DataFrame]
    means: dict[str, float]
    scales: dict[str, float]
    edges: dict[str, list[float]] = field(default_factory=dict)

    def encode(self, rows: DataFrame) -> DataFrame:
        """Add the encoded and derived columns. A label not seen in training becomes -1."""
        for name in CATEGORICAL:
            rows = with_code(rows, name, self.vocabularies[name], f"{name}_encoded")
        return rows.withColumn("log_amount", F.log1p("amount"))

    def scale(self, encoded: DataFrame) -> DataFrame:
        """Standardize every feature, missing ones counted as zero, and assemble the vector."""
        scaled = encoded.withColumns({
            f"{n}_scaled": (F.coalesce(F.col(n).cast("double"), F.lit(0.0)) - self.means[n]) / self.scales[n]
            for n in FEATURES
        })
        return VectorAssembler(inputCols=[f"{n}_scaled" for n in FEATURES], outputCol="features").transform(scaled)

    def bin(self, scaled: DataFrame) -> DataFrame:
        """Add the vector ``bins``: of every feature the bin its value falls in, NaN in one of its own."""
        names = [f"{n}_bin" for n in FEATURES]
        parted = Bucketizer(
            splitsArray=[[-math.inf, *self.edges[n], math.inf] for n in FEATURES], handleInvalid="keep",
            inputCols=[f"{n}_scaled" for n in FEATURES], outputCols=names).transform(scaled)
        return VectorAssembler(inputCols=names, outputCol="bins").transform(parted).drop(*names)

    def transform(self, rows: DataFrame) -> DataFrame:
        scaled = self.scale(self.encode(rows))
        return self.bin(scaled) if self.edges else scaled


def learn_vocabularies(rows: DataFrame) -> dict[str, DataFrame]:
    """Distinct labels in alphabetical order with their codes; a missing one counts as the label ``None``."""
    filled = rows.select(*[F.coalesce(F.col(c).cast("string"), F.lit("None")).alias(c) for c in CATEGORICAL])
    return {c: durable(dense_codes(filled, c), "vocabulary") for c in CATEGORICAL}


def fit_features(train: DataFrame) -> FeatureState:
    """Learn from training rows only. Reads one row of fourteen numbers; vocabularies stay tables."""
    vocabularies = learn_vocabularies(train)
    encoded = FeatureState(vocabularies, {}, {}).encode(train)
    filled = {n: F.coalesce(F.col(n).cast("double"), F.lit(0.0)) for n in FEATURES}
    row = encoded.agg(
        *[F.avg(c).alias(f"m_{n}") for n, c in filled.items()],
        *[F.stddev_pop(c).alias(f"s_{n}") for n, c in filled.items()],
    ).first()
    return FeatureState(
        vocabularies, {n: row[f"m_{n}"] for n in FEATURES},
        # A constant feature is left unscaled.
        {n: row[f"s_{n}"] or 1.0 for n in FEATURES})


def learn_edges(scaled: DataFrame) -> dict[str, list[float]]:
    """Edges between at most ``BINS`` bins per scaled feature, from all rows: halfway between neighbours where there are
    no more values than bins, else quantiles within a thousandth of all rows."""
    columns = {n: f"{n}_scaled" for n in FEATURES}
    about = scaled.agg(*[F.approx_count_distinct(c).alias(n) for n, c in columns.items()]).first()
    # The estimate may be off by some; sets of columns that may have few values are small.
    few = [n for n in FEATURES if about[n] <= 2 * BINS]
    # An aggregate of no column is none.
    sets = scaled.agg(F.count("*").alias("_n"), *[F.sort_array(F.collect_set(columns[n])).alias(n) for n in few]).first()
    edges = {}
    for name in few:
        values = [v for v in sets[name] if math.isfinite(v)]
        if len(values) <= BINS:
            edges[name] = [(a + b) / 2 for a, b in zip(values, values[1:])]
    rest = [n for n in FEATURES if n not in edges]
    if rest:
        found = scaled.approxQuantile([columns[n] for n in rest], [i / BINS for i in range(1, BINS)], 0.001)
        edges.update(zip(rest, found))
    # A feature of one value is never parted; an edge anywhere leaves it whole.
    return {n: sorted({e for e in edges[n] if math.isfinite(e)}) or [0.0] for n in FEATURES}
