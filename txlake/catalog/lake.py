"""Scans, adapters, cleaning, silver and gold, profiles, sinks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from txlake.catalog.registry import ORACLES, profiles, query, scored, stored, text_time
from txlake.catalog.sqlparts import exact_mean, half_even, steady, with_parts
from txlake.functions.calendar import hour_from_iso
from txlake.functions.values import integer_or, number_or
from txlake.functions.vocabulary import (
    crosses_border, payment_name, plain_category, profile_owner, strip_accents,
)
from txlake.operators import adapters, cleaning, enrich, merge, profiles as profile_ops, quality, ranking
from txlake.operators.kpis import run_summary
from txlake.plans.medallion import run_medallion
from txlake.plans.profile_state import ProfileState
from txlake.session import durable, scratch_path
from txlake.sinks.history import first_of_each_id, history_rows, new_history, rejected_history
from txlake.sinks.keyed import KeyedTable
from txlake.sinks.lake import append_json_lines, lake_readiness, write_bronze, write_quality_report
from txlake.sinks.layout import LakeLayout
from txlake.sinks.publish import as_messages, with_envelope
from txlake.sources import sample
from txlake.sources.landing import load_normalized, read_by_format, read_landing_json
from txlake.sources.oltp import as_oltp_transactions, read_table, with_profiles

# Rows before this moment play the stored table, later ones the incoming batch.
SPLIT = "1998-01-01"
_FEATURES = "amount, merchant_category, payment_method, hour, is_weekend, is_international"


def before_split(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("timestamp") < F.lit(SPLIT).cast("timestamp_ntz"))


def after_split(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("timestamp") >= F.lit(SPLIT).cast("timestamp_ntz"))


def cleaned(spark: SparkSession, folder: str) -> DataFrame:
    return cleaning.clean(sample.transactions(spark, folder))


# -- scans ----------------------------------------------------------------------

_LANDED = """select transaction_id, user_id, amount, merchant_category, strftime(ts, '%Y-%m-%d %H:%M:%S') "timestamp", is_fraud from tx"""


def _landed_view(rows: DataFrame) -> DataFrame:
    return rows.select("transaction_id", "user_id", "amount", "merchant_category", text_time("timestamp"), "is_fraud")


@query("scan_json_bronze", with_parts("tx") + _LANDED)
def scan_json_bronze(spark, folder):
    """Write the landing as JSON lines, read it back with the landing schema."""
    path = scratch_path(spark, "landing")
    append_json_lines(sample.landing(spark, folder), path)
    return _landed_view(read_landing_json(spark, path))


@query("scan_formats", with_parts("tx") + """
select f.format, count(*) "rows", count(amount) amounts, round(sum(amount), 2) amount_sum
from tx cross join (values ('csv'), ('json'), ('parquet')) f(format) group by f.format""")
def scan_formats(spark, folder):
    """The same bronze rows read as parquet, csv and json."""
    rows = sample.landing(spark, folder).select("transaction_id", "amount", "merchant_category")
    frames = []
    for fmt in ("parquet", "csv", "json"):
        path = scratch_path(spark, f"bronze-{fmt}")
        writer = rows.write.option("header", True) if fmt == "csv" else rows.write
        writer.format(fmt).save(path)
        frames.append(read_by_format(spark, path, fmt).select(F.lit(fmt).alias("format"), "amount"))
    both = frames[0].unionByName(frames[1]).unionByName(frames[2])
    return both.groupBy("format").agg(
        F.count("*").alias("rows"), F.count("amount").alias("amounts"),
        F.round(F.sum("amount"), 2).alias("amount_sum"))


@query("first_n", with_parts("clean") + """
select transaction_id, user_id, amount from clean order by transaction_id limit 500""")
def first_n(spark, folder):
    """The console's slice: the first rows by id, 500 at most."""
    return ranking.first_rows(cleaned(spark, folder), ["transaction_id"], 500).select(
        "transaction_id", "user_id", "amount")


# -- adapters -------------------------------------------------------------------

@query("adapt_csv", with_parts("tx") + """
select transaction_id, coalesce(amount, 0.0::double) amount, coalesce(merchant_category, 'Outros') merchant_category, payment_method,
  cast(hour(ts) as int) "hour", 0 is_weekend, case when user_country <> merchant_country then 1 else 0 end is_international from tx""")
def adapt_csv(spark, folder):
    """Vendor columns: some rows use the vendor's names, some the canonical ones, blanks mean missing."""
    tx = sample.transactions(spark, folder)
    vendor = F.col("currency") == "BRL"
    amount = F.coalesce(F.col("amount").cast("string"), F.lit(""))
    rows = tx.select(
        "transaction_id",
        F.when(vendor, amount).otherwise("").alias("vlr_transacao"),
        F.when(~vendor & (amount != ""), amount).alias("amount"),
        F.when(vendor, F.coalesce("merchant_category", F.lit(""))).alias("categoria"),
        F.when(~vendor, F.col("merchant_category")).alias("merchant_category"),
        F.col("payment_method").alias("meio_pagamento"),
        F.hour("timestamp").cast("string").alias("hora"),
        F.lit("").alias("fim_semana"),
        (F.col("user_country") != F.col("merchant_country")).cast("int").cast("string").alias("internacional"),
    )
    return adapters.normalize(rows, "csv", keep=["transaction_id"])


@query("adapt_api", with_parts("tx") + """
select transaction_id, amount, coalesce(merchant_category, 'Outros') merchant_category, payment_method, 12 "hour", 0 is_weekend,
  case when user_country <> merchant_country then 1 else 0 end is_international from tx""")
def adapt_api(spark, folder):
    tx = sample.transactions(spark, folder).drop("timestamp")
    return adapters.normalize(tx, "api", keep=["transaction_id"])


_SIMULATED = """
select transaction_id, coalesce(amount, 0.0::double) amount, strip_accents(coalesce(merchant_category, 'Outros')) merchant_category,
  payment_method, cast(hour(ts) as int) "hour", case when isodow(ts) >= 6 then 1 else 0 end is_weekend,
  case when user_country <> merchant_country then 1 else 0 end is_international from tx"""


@query("adapt_simulator", with_parts("tx") + _SIMULATED)
def adapt_simulator(spark, folder):
    return adapters.normalize(sample.landing(spark, folder), "simulator", keep=["transaction_id"])


@query("adapt_event", with_parts("ev") + """
select transaction_id, amount, merchant_category, 'CREDIT_CARD' payment_method,
  case when merchant_category = 'signup' then 12 else cast(hour(ts) as int) end "hour",
  case when merchant_category = 'signup' then 0 when isodow(ts) >= 6 then 1 else 0 end is_weekend, 0 is_international from ev""")
def adapt_event(spark, folder):
    """JSON messages as bytes; sign-ups carry no timestamp and take the flat form."""
    events = sample.event_transactions(spark, folder).withColumn(
        "timestamp", F.when(F.col("merchant_category") != "signup", F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss")))
    messages = events.select(F.to_json(F.struct("*")).cast("binary").alias("value"))
    return adapters.normalize(messages, "event", keep=["transaction_id"])


@query("adapt_auto", with_parts("tx") + """
select transaction_id, case when currency = 'BRL' then coalesce(amount, 0.0::double) else amount end amount,
  case when currency = 'BRL' then strip_accents(coalesce(merchant_category, 'Outros')) else coalesce(merchant_category, 'Outros') end merchant_category,
  payment_method, case when currency = 'BRL' then cast(hour(ts) as int) else 12 end "hour",
  case when currency = 'BRL' and isodow(ts) >= 6 then 1 else 0 end is_weekend,
  case when user_country <> merchant_country then 1 else 0 end is_international from tx""")
def adapt_auto(spark, folder):
    """Rows without a timestamp are taken as flat requests."""
    rows = sample.landing(spark, folder)
    mixed = rows.withColumn("timestamp", F.when(F.col("currency") == "BRL", F.col("timestamp")))
    return adapters.normalize(mixed, "auto", keep=["transaction_id"])


def _console_sql(weekend: str) -> str:
    return with_parts("tx") + f"""
select transaction_id, user_id, amount, merchant_category, payment_method, user_country, merchant_country, cast(hour(ts) as int) "hour",
  case when {weekend} then 1 else 0 end is_weekend, case when user_country <> merchant_country then 1 else 0 end is_international from tx"""


_CONSOLE = ["transaction_id", "user_id", "amount", "merchant_category", "payment_method", "user_country",
            "merchant_country", "hour", "is_weekend", "is_international"]


@query("adapt_console", _console_sql("isodow(ts) >= 6"))
def adapt_console(spark, folder):
    return adapters.to_analyze_request(sample.landing(spark, folder)).select(*_CONSOLE)


@query("adapt_console_legacy", _console_sql("isodow(ts) in (5, 6)"))
def adapt_console_legacy(spark, folder):
    """The console's own weekend, Friday and Saturday."""
    return adapters.to_analyze_request(sample.landing(spark, folder), legacy_weekend=True).select(*_CONSOLE)


@query("analyze_defaults", with_parts("req") + """
select transaction_id, amount, merchant_category, user_country, merchant_country, payment_method, "hour", is_weekend, is_international from req""")
def analyze_defaults(spark, folder):
    filled = adapters.request_defaults(sample.transactions(spark, folder), F.col("timestamp"))
    return filled.select("transaction_id", "amount", "merchant_category", "user_country", "merchant_country",
                         "payment_method", "hour", "is_weekend", "is_international")


@query("oltp_scan", with_parts("clean") + """
select transaction_id, user_id, amount::decimal(19,2)::varchar amount, currency from clean""")
def oltp_scan(spark, folder):
    """The transactional table as its reader gives it, cleaned: one row per id, exact decimal amounts, missing and negative ones as zero."""
    location = scratch_path(spark, "oltp")
    sample.transactions(spark, folder).write.parquet(location)
    rows = as_oltp_transactions(cleaning.clean(read_table(spark, location)))
    return rows.select("transaction_id", "user_id", F.col("amount").cast("string").alias("amount"), "currency")


@query("normalize_file", with_parts("tx") + "select * exclude (transaction_id) from (" + _SIMULATED.strip() + ")")
def normalize_file(spark, folder):
    """A landing file of JSON lines, loaded and normalized."""
    path = scratch_path(spark, "landing")
    append_json_lines(sample.landing(spark, folder), path)
    return load_normalized(spark, path, array=False)


@query("layer_paths", with_parts("clean") + """
select name, layer, case layer when 'bronze' then (select count(*) from tx) when 'silver' then (select count(*) from clean)
  else (select count(*) from clean where is_fraud is not null) end records
from (values ('raw', 'bronze'), ('landing', 'bronze'), ('Bronze', 'bronze'), ('processed', 'silver'), ('SILVER', 'silver'),
  ('curated', 'gold'), ('gold', 'gold')) n(name, layer)""")
def layer_paths(spark, folder):
    """Layers written under their names and read back under every name they go by."""
    layout = LakeLayout(scratch_path(spark, "lake"))
    rows = cleaned(spark, folder)
    write_bronze(sample.transactions(spark, folder).select("transaction_id"), layout)
    rows.select("transaction_id").write.parquet(layout.silver())
    rows.where("is_fraud is not null").select("transaction_id").write.parquet(layout.gold())
    frames = [spark.read.parquet(layout.path(name)).agg(F.count("*").alias("records")).select(
        F.lit(name).alias("name"), F.lit(LakeLayout.layer(name)).alias("layer"), "records")
        for name in ("raw", "landing", "Bronze", "processed", "SILVER", "curated", "gold")]
    return reduce(DataFrame.unionByName, frames)


@query("profile_lookup", with_parts("ev", "prof") + """
select e.transaction_id, e.user_id profile_user_id, p.tx_count, p.avg_amount from ev e left join prof p on e.user_id = p.user_id""")
def profile_lookup(spark, folder):
    joined = with_profiles(sample.event_transactions(spark, folder), profiles(spark, folder))
    return joined.select("transaction_id", "profile_user_id", F.col("profile.tx_count").alias("tx_count"),
                         F.col("profile.avg_amount").alias("avg_amount"))


# -- cleaning and features ------------------------------------------------------

@query("dedup_latest", with_parts("deduped") + """
select transaction_id, user_id, amount, merchant_id, merchant_category, payment_method from deduped""")
def dedup_latest(spark, folder):
    return cleaning.dedup(sample.transactions(spark, folder)).select(
        "transaction_id", "user_id", "amount", "merchant_id", "merchant_category", "payment_method")


@query("dup_count", with_parts("tx") + """
select count(*) total_records, count(*) - count(distinct transaction_id) duplicate_ids from tx""")
def dup_count(spark, folder):
    return quality.duplicate_count(sample.transactions(spark, folder))


@query("clean_silver", with_parts("clean") + """
select transaction_id, user_id, amount, merchant_category, user_country, strftime(transaction_date, '%Y-%m-%d') transaction_date,
  transaction_hour from clean""")
def clean_silver(spark, folder):
    return cleaned(spark, folder).select(
        "transaction_id", "user_id", "amount", "merchant_category", "user_country",
        F.date_format("transaction_date", "yyyy-MM-dd").alias("transaction_date"), "transaction_hour")


@query("time_features", with_parts("tx") + """
select transaction_id, strftime(ts, '%Y-%m-%d') transaction_date, cast(hour(ts) as int) transaction_hour, cast(month(ts) as int) transaction_month,
  case when isodow(ts) >= 6 then 1 else 0 end is_weekend, case when hour(ts) < 6 then 1 else 0 end is_night from tx""")
def time_features(spark, folder):
    rows = cleaning.add_time_features(cleaning.add_date_parts(sample.transactions(spark, folder)))
    return rows.select(
        "transaction_id", F.date_format("transaction_date", "yyyy-MM-dd").alias("transaction_date"), "transaction_hour",
        "transaction_month", "is_weekend", "is_night")


@query("is_international", with_parts("tx") + """
select transaction_id, case when user_country <> merchant_country then 1 else 0 end is_international from tx""")
def is_international(spark, folder):
    return sample.transactions(spark, folder).select(
        "transaction_id", crosses_border("user_country", "merchant_country").alias("is_international"))


@query("canonical_category", with_parts("tx") + """
select transaction_id, case when merchant_category is null then 'Outros' when merchant_category = 'Eletrônicos' then 'Eletronicos'
  else merchant_category end category, strip_accents(merchant_category) without_accents from tx""")
def canonical_category(spark, folder):
    return sample.transactions(spark, folder).select(
        "transaction_id", plain_category("merchant_category").alias("category"),
        strip_accents("merchant_category").alias("without_accents"))


@query("strip_accents_text", "select doc_id, strip_accents(text) plain_text from documents")
def strip_accents_text(spark, folder):
    """Diacritics stripped from whole texts in four languages."""
    return sample.table(spark, folder, "documents").select("doc_id", strip_accents("text").alias("plain_text"))


@query("payment_norm", with_parts("tx") + """
select transaction_id, case when currency = 'USD' then 'CREDIT_CARD' else payment_method end payment_method from tx""")
def payment_norm(spark, folder):
    """Spellings, blanks and instant transfers to one vocabulary."""
    rows = sample.transactions(spark, folder)
    spelled = F.when(F.col("currency") == "USD", F.when(F.col("amount").isNull(), "  ").otherwise(" pix ")).otherwise(
        F.concat(F.lit(" "), F.lower("payment_method")))
    return rows.select("transaction_id", payment_name(spelled).alias("payment_method"))


@query("iso_hour", with_parts("tx") + """
select transaction_id, case when currency = 'USD' then 12 else cast(hour(ts) as int) end "hour" from tx""")
def iso_hour(spark, folder):
    """Hour from text; texts without a time give noon."""
    text = F.when(F.col("currency") == "USD", F.date_format("timestamp", "yyyy-MM-dd")).otherwise(
        F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss"))
    return sample.transactions(spark, folder).select("transaction_id", hour_from_iso(text).alias("hour"))


@query("typed_fallback", """
select event_id, coalesce(try_cast(json_extract_string(props, '$.k') as double), 0.0::double) number,
  coalesce(try_cast(event_type as int), 12) "integer" from events""")
def typed_fallback(spark, folder):
    return sample.table(spark, folder, "events").select(
        "event_id", number_or(F.get_json_object("props", "$.k")).alias("number"),
        integer_or("event_type", 12).alias("integer"))


@query("profile_key", with_parts("tx") + """
select transaction_id, case when currency = 'BRL' then user_id when is_fraud then merchant_id else 'anonymous' end profile_user_id from tx""")
def profile_key(spark, folder):
    """Profile user, else user, else anonymous; blanks count as missing."""
    brl, fraud = F.col("currency") == "BRL", F.col("is_fraud")
    first = F.when(brl, F.concat(F.lit(" "), F.col("user_id"), F.lit(" "))).otherwise("   ")
    second = F.when(fraud, F.col("merchant_id")).otherwise("")
    return sample.transactions(spark, folder).select("transaction_id", profile_owner(first, second).alias("profile_user_id"))


# -- silver and gold ------------------------------------------------------------

_USER_STATS = (f"{steady('user_avg_amount')} user_avg_amount, user_total_transactions, "
               f"{steady('user_amount_stddev')} user_amount_stddev")
_MERCHANT_STATS = f"merchant_transaction_count, {steady('merchant_avg_amount')} merchant_avg_amount"


def _rounded(rows: DataFrame) -> DataFrame:
    names = [n for n in ("user_avg_amount", "user_amount_stddev", "merchant_avg_amount") if n in rows.columns]
    return rows.withColumns({n: F.floor(F.col(n) * 1e4 + 0.3) / 1e4 for n in names})


@query("user_stats", with_parts("user_stats") + f"select user_id, {_USER_STATS} from user_stats")
def user_stats(spark, folder):
    return _rounded(enrich.user_stats(cleaned(spark, folder)))


@query("merchant_stats", with_parts("merchant_stats") + f"select merchant_id, {_MERCHANT_STATS} from merchant_stats")
def merchant_stats(spark, folder):
    return _rounded(enrich.merchant_stats(cleaned(spark, folder)))


@query("silver_user_join", with_parts("clean", "user_stats") + f"""
select transaction_id, c.user_id, {_USER_STATS} from clean c left join user_stats u on c.user_id = u.user_id""")
def silver_user_join(spark, folder):
    return _rounded(enrich.with_user_stats(cleaned(spark, folder))).select(
        "transaction_id", "user_id", "user_avg_amount", "user_total_transactions", "user_amount_stddev")


@query("silver_merchant_join", with_parts("clean", "merchant_stats") + f"""
select transaction_id, c.merchant_id, {_MERCHANT_STATS} from clean c left join merchant_stats m on c.merchant_id = m.merchant_id""")
def silver_merchant_join(spark, folder):
    return _rounded(enrich.with_merchant_stats(cleaned(spark, folder))).select(
        "transaction_id", "merchant_id", "merchant_transaction_count", "merchant_avg_amount")


_GOLD = f"""
select transaction_id, strftime(transaction_date, '%Y-%m-%d') transaction_date, f.user_id, amount, merchant_category, is_weekend, is_night,
  {steady('user_avg_amount')} user_avg_amount, {steady('user_amount_stddev')} user_amount_stddev, merchant_transaction_count, is_fraud
from featured f left join user_stats u on f.user_id = u.user_id left join merchant_stats m on f.merchant_id = m.merchant_id
where is_fraud is not null"""


def _gold_view(gold: DataFrame) -> DataFrame:
    return _rounded(gold).withColumn("transaction_date", F.date_format("transaction_date", "yyyy-MM-dd"))


@query("gold_projection", with_parts("featured", "user_stats", "merchant_stats") + _GOLD)
def gold_projection(spark, folder):
    return _gold_view(enrich.gold(enrich.enrich(cleaned(spark, folder))))


@query("bronze_silver_gold", with_parts("featured", "user_stats", "merchant_stats") + _GOLD)
def bronze_silver_gold(spark, folder):
    """The whole lake job; the gold table as read back."""
    layout = LakeLayout(scratch_path(spark, "lake"))
    return _gold_view(run_medallion(spark, sample.transactions(spark, folder), layout)["gold"])


@query("lake_readiness", with_parts("tx") + """
select l.layer, l.layer <> 'gold' and count(*) > 0 ready from tx cross join (values ('bronze'), ('silver'), ('gold')) l(layer) group by l.layer""")
def readiness(spark, folder):
    """Two layers written, the third missing."""
    layout = LakeLayout(scratch_path(spark, "lake"))
    tx = sample.transactions(spark, folder)
    for layer in ("bronze", "silver"):
        tx.write.parquet(layout.path(layer))
    return lake_readiness(spark, layout)


# -- profiles -------------------------------------------------------------------

_PROFILE = """user_id, tx_count, avg_amount, std_amount, max_amount, p95_amount, min_amount, array_to_string(typical_categories, ',') typical_categories,
  array_to_string(typical_payment_methods, ',') typical_payment_methods, pct_international, avg_hour, historical_fraud_rate"""


def _profile_view(rows: DataFrame) -> DataFrame:
    listed = {c: F.array_join(c, ",") for c in ("typical_categories", "typical_payment_methods") if c in rows.columns}
    return rows.withColumns(listed)


@query("user_profiles", with_parts("prof") + f"select {_PROFILE}, 'batch-v1' profile_version, 'historical_json' source from prof")
def user_profiles(spark, folder):
    rows = durable(profile_ops.profile_rows(sample.transactions(spark, folder)), "profile-rows")  # the source is scanned once
    return _profile_view(profile_ops.build_profiles(rows)).drop("updated_at")


@query("profile_state", ORACLES["user_profiles"])
def profile_state(spark, folder):
    """Profiles from the state after early rows, late rows, and the late rows again under the same tag."""
    narrow = sample.transactions(spark, folder).select(
        "user_id", "amount", "merchant_category", "payment_method", "user_country", "merchant_country", "is_fraud", "timestamp")
    tx, state = durable(narrow, "narrow"), ProfileState(spark, scratch_path(spark, "profile-state"))
    for tag, part in (("early", before_split), ("late", after_split), ("late", after_split)):
        state.add(profile_ops.profile_rows(part(tx)), tag)
    return _profile_view(state.profiles()).drop("updated_at")


@query("user_p95", with_parts("p95") + "select user_id, p95_amount from p95")
def user_p95(spark, folder):
    return profile_ops.user_p95(profile_ops.profile_rows(sample.transactions(spark, folder)))


@query("user_top_categories", with_parts("top_categories") + """
select user_id, array_to_string(typical_categories, ',') typical_categories from top_categories""")
def user_top_categories(spark, folder):
    return _profile_view(profile_ops.user_top_categories(profile_ops.profile_rows(sample.transactions(spark, folder))))


@query("user_top_payments", with_parts("top_payments") + """
select user_id, array_to_string(typical_payment_methods, ',') typical_payment_methods from top_payments""")
def user_top_payments(spark, folder):
    return _profile_view(profile_ops.user_top_payments(profile_ops.profile_rows(sample.transactions(spark, folder))))


# -- sinks ----------------------------------------------------------------------

@query("jsonl_append", with_parts("tx") + """
select merchant_category, count(*) "rows", round(sum(amount), 2) amount_sum from (
  select strip_accents(coalesce(merchant_category, 'Outros')) merchant_category, coalesce(amount, 0.0::double) amount from tx)
group by merchant_category""")
def jsonl_append(spark, folder):
    """Canonical records appended as JSON lines in two batches, read back."""
    path = scratch_path(spark, "canonical")
    landing = sample.landing(spark, folder)
    for batch in (landing.filter("timestamp < '1998'"), landing.filter("timestamp >= '1998'")):
        append_json_lines(adapters.normalize(batch, "simulator"), path)
    back = spark.read.schema("merchant_category string, amount double").json(path)
    return back.groupBy("merchant_category").agg(
        F.count("*").alias("rows"), F.round(F.sum("amount"), 2).alias("amount_sum"))


@query("dq_report_write", with_parts("tx") + f"""
select total_records, null_amount, duplicate_ids, fraud_labeled, {half_even('fraud_labeled::double / total_records', 4)} fraud_rate,
  null_amount = 0 and duplicate_ids = 0 success, 2::bigint reports
from (select count(*) total_records, count(*) filter (amount is null) null_amount, count(*) - count(distinct transaction_id) duplicate_ids,
  count(*) filter (is_fraud) fraud_labeled from tx)""")
def dq_report_write(spark, folder):
    """The report written twice: the latest replaced, both kept in the history."""
    layout = LakeLayout(scratch_path(spark, "lake"))
    report = quality.batch_counters(sample.transactions(spark, folder))
    for _ in range(2):
        write_quality_report(report, layout)
    history = spark.read.json(layout.reports("dq_history"))
    latest = spark.read.json(layout.reports("dq_latest"))
    return latest.select(
        "total_records", "null_amount", "duplicate_ids", "fraud_labeled", "fraud_rate", "success",
        history.select(F.count("*")).scalar().alias("reports"))


@query("run_log", with_parts("tx") + """
select 'profile_batch' job, count(*) records_read, count(distinct user_id) profiles_written, 'completed' status from tx""")
def run_log(spark, folder):
    """The profile job against an empty store; its run record."""
    from txlake.plans.profile_batch import run_profile_batch
    from txlake.schemas import USER_PROFILE

    runs = scratch_path(spark, "runs")
    store = KeyedTable(spark, scratch_path(spark, "profile-store"), USER_PROFILE, "user_id")
    run_profile_batch(sample.transactions(spark, folder), store, runs)
    return spark.read.parquet(runs).select("job", "records_read", "profiles_written", "status")


@query("run_summary", with_parts("tx") + """
select (select count(*) from tx where ts >= timestamp '1998-01-01') records_read, count(*) profiles_written,
  count(*) filter (u in (select user_id from tx where ts < timestamp '1998-01-01')) replaced,
  count(*) filter (u not in (select user_id from tx where ts < timestamp '1998-01-01')) inserted
from (select distinct user_id u from tx where ts >= timestamp '1998-01-01')""")
def run_summary_query(spark, folder):
    tx = sample.transactions(spark, folder)
    narrow = durable(tx.select("user_id", "amount", "merchant_category", "payment_method", "user_country", "merchant_country", "is_fraud", "timestamp"), "narrow")
    existing, incoming = before_split(narrow), after_split(narrow)
    written = profile_ops.user_basics(profile_ops.profile_rows(incoming))
    return run_summary(incoming, existing.select("user_id").distinct(), written)


@query("upsert_profiles", with_parts("tx") + f"""
select user_id, tx_count, avg_amount from (
  select user_id, count(*) tx_count, {half_even(exact_mean('coalesce(amount, 0.0::double)'), 2)} avg_amount, late from (
    select *, ts >= timestamp '1998-01-01' late, max(ts) over (partition by user_id) >= timestamp '1998-01-01' has_late from tx)
  where late = has_late group by user_id, late)""")
def upsert_profiles(spark, folder):
    """Profiles of late history replace those of early history, user by user."""
    tx = sample.transactions(spark, folder)
    old = profile_ops.user_basics(profile_ops.profile_rows(before_split(tx)))
    new = profile_ops.user_basics(profile_ops.profile_rows(after_split(tx)))
    return merge.replace_by_key(old, new, "user_id").select("user_id", "tx_count", "avg_amount")


def _scores_by_id(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Scores of early and of late transactions, one row per id."""
    from txlake.plans.scoring import score_rows

    rows = score_rows(adapters.request_defaults(sample.transactions(spark, folder), F.col("timestamp")))
    early, late = (part(rows).groupBy("transaction_id").agg(
        F.max("amount").alias("amount"), F.max("fraud_score").alias("fraud_score"),
        F.bool_or("is_fraud").alias("is_fraud"), F.lit(False).alias("updated")) for part in (before_split, after_split))
    return early, late


@query("upsert_partial", with_parts("heur") + """
select coalesce(o.id, n.id) transaction_id, case when o.id is not null then o.amount else n.amount end amount,
  case when n.id is not null then n.fraud_score else o.fraud_score end fraud_score,
  case when n.id is not null then n.is_fraud else o.is_fraud end is_fraud, o.id is not null and n.id is not null updated
from (select transaction_id id, max(amount) amount, max(fraud_score) fraud_score, bool_or(is_fraud) is_fraud from heur
      where ts < timestamp '1998-01-01' group by 1) o
full join (select transaction_id id, max(amount) amount, max(fraud_score) fraud_score, bool_or(is_fraud) is_fraud from heur
      where ts >= timestamp '1998-01-01' group by 1) n on o.id = n.id""")
def upsert_partial(spark, folder):
    """Known ids take only score and flag from the incoming rows; new ids are inserted whole."""
    old, new = _scores_by_id(spark, folder)
    return merge.upsert_columns(old, new, "transaction_id", ["fraud_score", "is_fraud"], touched={"updated": F.lit(True)})


@query("history_rows", with_parts("scored") + """
select transaction_id, profile_user_id, amount, merchant_category, fraud_score, risk_level, cosmos_sync_status from scored""")
def history(spark, folder):
    return history_rows(scored(spark, folder)).select(
        "transaction_id", "profile_user_id", "amount", "merchant_category", "fraud_score", "risk_level", "cosmos_sync_status")


@query("history_append", with_parts("scored") + """
select transaction_id, count(*) documents from (select distinct transaction_id from scored) group by 1""")
def history_append(spark, folder):
    """Late rows appended to the early history: every id once."""
    rows = scored(spark, folder)
    empty = history_rows(rows).limit(0)
    early = new_history(before_split(rows), empty)
    late = new_history(after_split(rows), early)
    return early.unionByName(late).groupBy("transaction_id").agg(F.count("*").alias("documents"))


@query("history_rejects", with_parts("scored") + """
select transaction_id, n - case when stored then 0 else 1 end rejected_rows from (
  select transaction_id, count(*) n, transaction_id in (select transaction_id from scored where ts < timestamp '1998-01-01') stored
  from scored where ts >= timestamp '1998-01-01' group by 1) where n - case when stored then 0 else 1 end > 0""")
def history_rejects(spark, folder):
    rows = scored(spark, folder)
    return rejected_history(after_split(rows), before_split(rows).select("transaction_id").distinct())


# The same merges through keyed tables: what two commits leave behind, read back.

@query("store_profiles", ORACLES["upsert_profiles"])
def store_profiles(spark, folder):
    tx = sample.transactions(spark, folder)
    old, new = (profile_ops.user_basics(profile_ops.profile_rows(part(tx))) for part in (before_split, after_split))
    store = KeyedTable(spark, scratch_path(spark, "profile-store"), old.schema, "user_id")
    store.upsert(old)
    store.upsert(new)
    return store.read().select("user_id", "tx_count", "avg_amount")


@query("store_partial", ORACLES["upsert_partial"])
def store_partial(spark, folder):
    old, new = _scores_by_id(spark, folder)
    store = KeyedTable(spark, scratch_path(spark, "score-store"), old.schema, "transaction_id")
    store.insert(old)
    store.upsert_columns(new, ["fraud_score", "is_fraud"], touched={"updated": F.lit(True)})
    return store.read()


@query("store_history", ORACLES["history_append"])
def store_history(spark, folder):
    """Early history, then late; the second insert of all of it adds nothing."""
    rows = history_rows(scored(spark, folder))
    store = KeyedTable(spark, scratch_path(spark, "history-store"), rows.schema, "transaction_id")
    for part in (before_split(rows), after_split(rows), rows):
        store.insert(first_of_each_id(part), keys=part)
    return store.read().groupBy("transaction_id").agg(F.count("*").alias("documents"))


@query("event_envelope", with_parts("tx") + """
select transaction_id, user_id "key", amount, merchant_category, 36 id_length, true fresh, true timed from tx""")
def event_envelope(spark, folder):
    """Enveloped messages, decoded: the event's fields, an id of its own that no other message has, and its time."""
    messages = durable(as_messages(with_envelope(sample.landing(spark, folder))), "messages")
    fields = F.from_json("value", "transaction_id string, amount double, merchant_category string, event_id string, event_timestamp string")
    rows = messages.select("key", fields.alias("e")).select("key", "e.*")
    fresh = rows.select(F.count_distinct("event_id") == F.count("*")).scalar()
    return rows.select("transaction_id", "key", "amount", "merchant_category", F.length("event_id").alias("id_length"), fresh.alias("fresh"), F.col("event_timestamp").isNotNull().alias("timed"))
