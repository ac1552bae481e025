"""Landing to bronze, silver and gold."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from txlake.operators import quality
from txlake.operators.cleaning import clean
from txlake.operators.enrich import enrich, gold
from txlake.session import durable
from txlake.sinks.lake import save_layer, write_bronze, write_quality_report
from txlake.sinks.layout import LakeLayout
from txlake.sources.landing import read_landing_json


def run_medallion(spark: SparkSession, landing: DataFrame | str, layout: LakeLayout, array: bool = False,
                  fail_on: str | None = None) -> dict[str, DataFrame]:
    """Run the lake job and return the layers as read back.

    Quality is advisory unless ``fail_on`` names a severity; what the rules found is stored either way. The cleaned rows are stored once, because
    silver reads them three times; gold is a projection of the written silver, not a second run.
    """
    rows = read_landing_json(spark, landing, array) if isinstance(landing, str) else landing
    bronze = spark.read.parquet(write_bronze(rows, layout))

    results = durable(quality.evaluate(bronze, quality.LANDING_RULES), "rules")
    write_quality_report(quality.batch_counters(bronze), layout)
    write_quality_report(quality.report(results), layout, "rules")
    quality.enforce(results, fail_on)

    enriched = enrich(durable(clean(bronze), "clean"))
    silver = _read_layer(spark, save_layer(enriched, layout, "silver"), enriched)
    wanted = gold(silver)
    return {"bronze": bronze, "silver": silver, "gold": _read_layer(spark, save_layer(wanted, layout, "gold"), wanted)}


def _read_layer(spark: SparkSession, path: str, written: DataFrame) -> DataFrame:
    """A layer by the schema it was written with, so that no file is opened to infer one."""
    return spark.read.schema(written.schema).parquet(path).select(*written.columns)
