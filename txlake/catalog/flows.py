"""Streaming jobs over messages that Spark derives from the event table, and their batch twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from txlake.catalog.registry import ORACLES, profiles, query
from txlake.catalog.sqlparts import POLICY, rule_score, with_parts
from txlake.plans.serving import ServingView
from txlake.session import scratch_path
from txlake.sinks.publish import as_messages, publish, with_envelope
from txlake.sources import sample
from txlake.sources.events import read_event_log
from txlake.streaming import ingest, rates
from txlake.streaming.scoring import start_scoring

_EVENT_SCHEMA = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def _published(spark: SparkSession, folder: str) -> str:
    """The event table as a log of JSON lines: purchases sent twice, errors cut off in transit."""
    events = sample.event_transactions(spark, folder).withColumn(
        "timestamp", F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))
    kind = F.col("merchant_category")
    sent = events.withColumn("_copy", F.explode(F.when(kind == "purchase", F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))))
    at = F.col("timestamp").cast("timestamp")
    messages = as_messages(with_envelope(sent, F.concat_ws("-", "transaction_id", "_copy"), at).drop("_copy"))
    broken = F.get_json_object("value", "$.merchant_category") == "error"
    cut = messages.withColumn("value", F.when(broken, F.left("value", F.length("value") - 1)).otherwise(F.col("value")))
    path = scratch_path(spark, "log")
    publish(cut, location=path)
    return path


def _drain(query_handle) -> None:
    query_handle.awaitTermination()
    if query_handle.exception() is not None:
        raise query_handle.exception()


_GOOD = """
select transaction_id, user_id, amount, merchant_id, merchant_category, strftime(ts, '%Y-%m-%d %H:%M:%S') event_time from ev where merchant_category <> 'error'"""


def _ingested(spark: SparkSession, log: str) -> DataFrame:
    out = scratch_path(spark, "events")
    good = ingest.good_events(read_event_log(spark, log))
    _drain(ingest.start_unique(good, out, scratch_path(spark, "ckpt")))
    return spark.read.parquet(out)


def _good_view(rows: DataFrame) -> DataFrame:
    return rows.select("transaction_id", "user_id", "amount", "merchant_id", "merchant_category",
                       F.date_format("event_time", "yyyy-MM-dd HH:mm:ss").alias("event_time"))


@query("stream_ingest", with_parts("ev") + _GOOD)
def stream_ingest(spark, folder):
    """Log to files: malformed messages left out, repeated ones once."""
    return _good_view(_ingested(spark, _published(spark, folder)))


@query("stream_dead_letter", with_parts("ev") + """
select 'malformed' reason, count(*) messages from ev where merchant_category = 'error'""")
def stream_dead_letter(spark, folder):
    out = scratch_path(spark, "dead")
    dead = ingest.dead_letters(read_event_log(spark, _published(spark, folder)))
    _drain(ingest.start(dead, out, scratch_path(spark, "ckpt")))
    return spark.read.parquet(out).groupBy("reason").agg(F.count("*").alias("messages"))


@query("stream_publish", with_parts("ev") + """
select transaction_id, user_id, amount, merchant_category, true enveloped from ev""")
def stream_publish(spark, folder):
    """The event table followed as a stream and emitted as enveloped messages."""
    source = spark.readStream.schema(_EVENT_SCHEMA).option("pathGlobFilter", "events.parquet").parquet(folder)
    tx = source.select(
        F.concat(F.lit("evt-"), "event_id").alias("transaction_id"), F.concat(F.lit("user_"), "user_id").alias("user_id"),
        F.col("value").alias("amount"), F.col("event_type").alias("merchant_category"))
    out = scratch_path(spark, "published")
    _drain(ingest.publish_stream(tx, out, scratch_path(spark, "ckpt")))
    fields = "transaction_id string, user_id string, amount double, merchant_category string, event_id string, event_timestamp string"
    back = spark.read.schema(fields).json(out)
    return back.select("transaction_id", "user_id", "amount", "merchant_category",
                       (F.col("event_id").isNotNull() & F.col("event_timestamp").isNotNull()).alias("enveloped"))


def _afternoons_first(spark: SparkSession, log: str) -> tuple[str, int]:
    """A copy of the log whose older files hold the afternoons, and how many these are: a stream that takes as many at once
    reads the mornings after them. Every task writes a file of its own, so none grows with the log."""
    ordered = scratch_path(spark, "log")
    afternoon = F.coalesce(F.get_json_object("value", "$.timestamp").substr(12, 2) >= "12", F.lit(True))
    spark.read.text(log).filter(afternoon).write.text(ordered)
    files = len(spark.read.text(ordered).inputFiles())
    spark.read.text(log).filter(~afternoon).write.mode("append").text(ordered)
    return ordered, max(files, 1)


@query("stream_accounting", with_parts("ev") + """
select count(*) + count(*) filter (merchant_category = 'purchase') sent, count(*) filter (merchant_category <> 'error') good,
  count(*) filter (merchant_category = 'error') dead, count(*) filter (merchant_category = 'purchase') repeats from ev""")
def stream_accounting(spark, folder):
    """Every message sent is stored once, a dead letter, or a repeat, also when parts arrive one by one, mornings after afternoons."""
    log, out, dead = _published(spark, folder), scratch_path(spark, "events"), scratch_path(spark, "dead")
    ordered, files = _afternoons_first(spark, log)
    for _ in range(2):  # the second run, under a new checkpoint, adds nothing
        _drain(ingest.start_unique(ingest.good_events(read_event_log(spark, ordered, maxFilesPerTrigger=str(files))), out, scratch_path(spark, "ckpt")))
    _drain(ingest.start(ingest.dead_letters(read_event_log(spark, ordered)), dead, scratch_path(spark, "ckpt")))
    good = spark.read.parquet(out).agg(F.count("*").alias("good"), F.count_distinct("transaction_id").alias("ids"))
    sent = spark.read.text(log).agg(F.count("*").alias("sent"))
    lost = spark.read.parquet(dead).agg(F.count("*").alias("dead"))
    usable = ingest.decoded(spark.read.text(log)).filter("_usable").agg(F.count("*").alias("usable"))
    counts = [f.withColumn("_one", F.lit(1)) for f in (sent, good, lost, usable)]
    joined = counts[0].join(counts[1], "_one").join(counts[2], "_one").join(counts[3], "_one")
    return joined.select("sent", F.col("ids").alias("good"), "dead", (F.col("usable") - F.col("good")).alias("repeats"))


@query("replay", with_parts("ev") + _GOOD)
def replay(spark, folder):
    """The same log read again from its start under a new checkpoint."""
    log = _published(spark, folder)
    _ingested(spark, log)
    return _good_view(_ingested(spark, log))


@query("lambda_view", with_parts("ev") + """
select user_id, count(*) tx_count, round(sum(coalesce(amount, 0.0::double)::decimal(28,6)), 2)::double amount, strftime(max(ts), '%Y-%m-%d %H:%M:%S') last_time,
  true whole from ev where merchant_category <> 'error' group by 1""")
def lambda_view(spark, folder):
    """Activity per user from a batch view and the micro-batches beyond it, while both go on: before the first view, after each
    part of the log, and with a run that starts anew. ``whole`` says that each time every stored event counted once."""
    log, out, checkpoint = scratch_path(spark, "log"), scratch_path(spark, "events"), scratch_path(spark, "ckpt")
    sent, view = _published(spark, folder), ServingView(spark, out, scratch_path(spark, "serving"))
    part = F.pmod(F.xxhash64("value"), F.lit(3))
    whole = True
    for number in range(3):
        spark.read.text(sent).filter(part == number).repartition(2).write.mode("append").text(log)
        _drain(ingest.start_unique(ingest.good_events(read_event_log(spark, log, maxFilesPerTrigger="1")), out, checkpoint))
        if number == 1:  # another run over the same log finds nothing new
            _drain(ingest.start_unique(ingest.good_events(read_event_log(spark, log)), out, scratch_path(spark, "ckpt")))
        counted = view.read().agg(F.sum("tx_count")).first()[0]
        whole = whole and counted == spark.read.parquet(out).count()
        if number < 2:
            view.refresh()
    return view.read().select("user_id", "tx_count", F.round("amount_sum", 2).cast("double").alias("amount"),
                              F.date_format("last_time", "yyyy-MM-dd HH:mm:ss").alias("last_time"), F.lit(whole).alias("whole"))


def _scored_stream(spark: SparkSession, folder: str) -> str:
    base = scratch_path(spark, "online")
    events = ingest.good_events(read_event_log(spark, _published(spark, folder)))
    _drain(start_scoring(events, profiles(spark, folder), base, scratch_path(spark, "ckpt")))
    return base


# The scoring CTEs of the landed transactions, with requests taken from the events instead.
_ONLINE = with_parts("prof", "ev", "anomaly").replace("req as (select transaction_id, user_id, coalesce(amount", "req0 as (select transaction_id, user_id, coalesce(amount", 1)
_ONLINE = _ONLINE.replace(",\nctx as (", """,
req as (select transaction_id, user_id, amount, merchant_category, 'CREDIT_CARD' payment_method, cast(hour(ts) as int) as hour,
  case when isodow(ts) >= 6 then 1 else 0 end is_weekend, 0 is_international, ts from ev where merchant_category <> 'error'),
ctx as (""", 1)
_ONLINE += f""", online as (select *, {POLICY} from (select *, case when boost > 0 then least(1.0::double, base + boost) else base end score
  from (select *, {rule_score()} base from anomaly)))\n"""


@query("stream_score", _ONLINE + """
select transaction_id, user_id profile_user_id, amount, fraud_score, risk_level, array_to_string(reasons, ' | ') anomaly_reasons, profile_found from online""")
def stream_score(spark, folder):
    """Events scored online against the batch profiles: the history written by the stream."""
    rows = spark.read.parquet(f"{_scored_stream(spark, folder)}/history")
    return rows.select("transaction_id", "profile_user_id", "amount", "fraud_score", "risk_level",
                       F.array_join("anomaly_reasons", " | ").alias("anomaly_reasons"), "profile_found")


@query("stream_alerts", _ONLINE + """
select 'history' output, count(*) "rows" from online union all select 'alerts', count(*) from online where is_fraud
union all select 'notifications', count(*) from online where is_fraud""")
def stream_alerts(spark, folder):
    """Rows of each output of the fan-out."""
    base = _scored_stream(spark, folder)
    counts = [spark.read.parquet(f"{base}/{name}").agg(F.count("*").alias("rows")).select(F.lit(name).alias("output"), "rows")
              for name in ("history", "alerts", "notifications")]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


_MINUTE = "strftime(date_trunc('minute', ts), '%Y-%m-%d %H:%M:%S')"


@query("rate_1m", f"select {_MINUTE} window_start, count(*) requests, round(count(*) / 60.0::double, 6) rate from events group by 1")
def rate_1m(spark, folder):
    rows = rates.request_rates(sample.table(spark, folder, "events"), "ts")
    return rows.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "requests",
                       F.round("rate", 6).alias("rate"))


@query("rate_1m_by_type", f"""
select {_MINUTE} window_start, event_type, count(*) requests, round(count(*) / 60.0::double, 6) rate from events group by 1, 2""")
def rate_1m_by_type(spark, folder):
    rows = rates.request_rates(sample.table(spark, folder, "events"), "ts", ["event_type"])
    return rows.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "event_type", "requests",
                       F.round("rate", 6).alias("rate"))


def _quantile_sql() -> str:
    bounds = rates.LATENCY_BOUNDS
    counts = ", ".join(f"count(*) filter (value <= {b}::double) le_{i}" for i, b in enumerate(bounds))
    cases = " ".join(
        f"when le_{i} >= 0.95::double * n then {bounds[i - 1] if i else 0.0}::double + {bounds[i] - (bounds[i - 1] if i else 0.0)}::double "
        f"* ((0.95::double * n - {f'le_{i - 1}' if i else '0'}) / (le_{i} - {f'le_{i - 1}' if i else '0'}))" for i in range(len(bounds)))
    return f"""select strftime(start, '%Y-%m-%d %H:%M:%S') window_start, n requests, round(case {cases} end, 6) quantile
from (select start, count(*) n, {counts} from (
  select date_trunc('minute', ts) - to_minutes(cast(k as bigint)) start, value from events cross join range(0, 5) r(k)) group by start)"""


_SLICES = 6


def _closed_windows(spark: SparkSession, folder: str, windowed) -> DataFrame:
    """Windows that a stream over the event log closed in append mode.

    The log comes in slices of time, one file and micro-batch each. Half of a slice's events lie half a slice back, so every
    batch brings events older than those of the batch before; the watermark allows for a whole slice. Rows far in the future,
    after which nothing is open any more, come last and are left out.
    """
    log, out = scratch_path(spark, "timed"), scratch_path(spark, "windows")
    events = sample.table(spark, folder, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    ends = events.agg(F.min("ts").alias("low"), F.max("ts").alias("high")).first()
    width = max(1.0, (ends["high"] - ends["low"]).total_seconds() / _SLICES)
    place = (F.col("ts").cast("double") - F.lit(ends["low"]).cast("timestamp").cast("double")) / width
    sliced = events.withColumn("slice", F.floor(place + F.pmod(F.xxhash64("event_id"), F.lit(2)) / 2))
    for number in range(_SLICES + 2):
        sliced.where(F.col("slice") == number).drop("slice").coalesce(1).write.mode("append").parquet(log)
    far = events.limit(1).withColumn("ts", F.lit(ends["high"]).cast("timestamp") + F.expr("interval 400 days"))
    for _ in range(3):
        far.coalesce(1).write.mode("append").parquet(log)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(log).withWatermark("ts", f"{int(width) + 1} seconds")
    _drain(ingest.start(windowed(stream), out, scratch_path(spark, "ckpt")))
    return spark.read.parquet(out).where(F.col("window_start") <= F.lit(ends["high"]).cast("timestamp"))


@query("stream_rate_1m", ORACLES["rate_1m"])
def stream_rate_1m(spark, folder):
    """The rate per minute as a stream closes it, from micro-batches that are out of order."""
    rows = _closed_windows(spark, folder, lambda stream: rates.request_rates(stream, "ts"))
    return rows.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "requests", F.round("rate", 6).alias("rate"))


@query("p95_5m", _quantile_sql())
def p95_5m(spark, folder):
    rows = rates.latency_quantile(sample.table(spark, folder, "events"), "ts", "value")
    return rows.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "requests",
                       F.round("quantile", 6).alias("quantile"))


@query("stream_p95_5m", ORACLES["p95_5m"])
def stream_p95_5m(spark, folder):
    """The sliding quantile as a stream closes it: counts per step, then per window, both in append mode."""
    rows = _closed_windows(spark, folder, lambda stream: rates.latency_quantile(stream, "ts", "value"))
    return rows.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "requests", F.round("quantile", 6).alias("quantile"))
