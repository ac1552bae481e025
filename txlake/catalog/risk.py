"""Scores, anomaly, policy, alerts, review, lists, KPIs."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from txlake.catalog.lake import after_split, before_split, cleaned
from txlake.catalog.registry import profiles, query, scored, text_time
from txlake.catalog.sqlparts import POLICY, cpf_digits_sql, half_up, with_parts
from txlake.functions.behaviour import NO_PROFILE_REASON
from txlake.functions.identity import CARD_PREFIXES, FIRST_NAMES, LAST_NAMES, with_identity
from txlake.functions.risk import model_score_with_floor, policy_columns, seed_severity, severity
from txlake.functions.values import round_half_up
from txlake.operators import alerts as alert_ops, kpis, listing, ranking
from txlake.operators.adapters import request_defaults
from txlake.operators.paging import OrderedTable
from txlake.plans.scoring import analyze, profile_context, score_rows
from txlake.session import scratch_path
from txlake.sinks.publish import notifications
from txlake.sources import sample

_RESULT = "fraud_score, is_fraud, risk_level, recommended_action, review_status"
_RESULT_COLUMNS = ["fraud_score", "is_fraud", "risk_level", "recommended_action", "review_status"]


def requests(spark, folder) -> DataFrame:
    return request_defaults(sample.transactions(spark, folder), F.col("timestamp"))


# -- scoring --------------------------------------------------------------------

@query("score_heuristic", with_parts("heur") + f"select transaction_id, amount, {_RESULT} from heur")
def score_heuristic(spark, folder):
    return score_rows(requests(spark, folder)).select("transaction_id", "amount", *_RESULT_COLUMNS)


@query("score_batch", with_parts("scored") + f"""
select transaction_id, profile_user_id, amount, merchant_category, payment_method, {_RESULT},
  array_to_string(anomaly_reasons, ' | ') anomaly_reasons, profile_found, cosmos_sync_status from scored""")
def score_batch(spark, folder):
    """The whole scoring flow over all landed transactions."""
    rows = analyze(sample.transactions(spark, folder), profiles(spark, folder), F.col("timestamp"))
    return rows.select(
        "transaction_id", "profile_user_id", "amount", "merchant_category", "payment_method", *_RESULT_COLUMNS,
        F.array_join("anomaly_reasons", " | ").alias("anomaly_reasons"), "profile_found", "cosmos_sync_status")


@query("risk_summary", with_parts("scored") + """
select risk_level, recommended_action, count(*) transactions, round(sum(amount), 2) amount from scored group by 1, 2""")
def risk_summary(spark, folder):
    """Transactions and amount per risk level, from raw tables to scores in one plan."""
    rows = analyze(sample.transactions(spark, folder), profiles(spark, folder), F.col("timestamp"))
    return rows.groupBy("risk_level", "recommended_action").agg(
        F.count("*").alias("transactions"), F.round(F.sum("amount"), 2).alias("amount"))


@query("tx_with_profile", with_parts("req", "prof") + """
select transaction_id, r.user_id profile_user_id, p.tx_count, p.avg_amount, p.p95_amount from req r left join prof p on r.user_id = p.user_id""")
def tx_with_profile(spark, folder):
    from txlake.sources.oltp import with_profiles

    joined = with_profiles(requests(spark, folder), profiles(spark, folder))
    return joined.select("transaction_id", "profile_user_id",
                         *[F.col(f"profile.{n}").alias(n) for n in ("tx_count", "avg_amount", "p95_amount")])


@query("profile_anomaly", with_parts("anomaly") + """
select transaction_id, boost anomaly_score_boost, array_to_string(reasons, ' | ') anomaly_reasons, len(reasons) > 0 is_unusual,
  n historical_tx_count from anomaly""")
def profile_anomaly(spark, folder):
    rows = profile_context(requests(spark, folder), profiles(spark, folder))
    return rows.select(
        "transaction_id", "anomaly_score_boost", F.array_join("anomaly_reasons", " | ").alias("anomaly_reasons"),
        "is_unusual", "historical_tx_count")


@query("no_profile", with_parts("ev") + f"""
select transaction_id, merchant_id profile_user_id, false profile_found, 0.0::double anomaly_score_boost,
  '{NO_PROFILE_REASON}' anomaly_reasons, false is_unusual from ev""")
def no_profile(spark, folder):
    """Requests whose user has no profile: merchants' names stand for unknown users."""
    strangers = sample.event_transactions(spark, folder).withColumn("user_id", F.col("merchant_id"))
    rows = profile_context(request_defaults(strangers, F.col("timestamp")), profiles(spark, folder))
    return rows.select("transaction_id", "profile_user_id", "profile_found", "anomaly_score_boost",
                       F.array_join("anomaly_reasons", " | ").alias("anomaly_reasons"), "is_unusual")


_ENTERPRISE_PARTS = """case when amount > 10000 then 0.3::double else 0.0::double end
  + case when user_country is not null and user_country is distinct from merchant_country then 0.2::double else 0.0::double end
  + case when hour(ts) < 6 then 0.15::double else 0.0::double end"""
_ENTERPRISE = with_parts("clean") + f", ent as (select *, 0.0::double + {_ENTERPRISE_PARTS} score from clean)\n"


@query("score_enterprise", _ENTERPRISE + f"""
select transaction_id, {half_up('score', 4)} fraud_score, score >= 0.7::double is_fraud from ent""")
def score_enterprise(spark, folder):
    rows = alert_ops.enterprise_verdicts(cleaned(spark, folder))
    return rows.select("transaction_id", round_half_up("fraud_score", 4).alias("fraud_score"), "is_fraud")


@query("fraud_reason", _ENTERPRISE + """
select transaction_id, case when amount > 10000 then 'Valor alto; ' else '' end
  || case when user_country <> merchant_country then 'Transação internacional suspeita; ' else '' end
  || case when hour(ts) < 6 then 'Horário incomum; ' else '' end || format('Score: {:.2f}', score) reason from ent""")
def fraud_reason(spark, folder):
    from txlake.functions.risk import enterprise_reason

    rows = alert_ops.enterprise_verdicts(cleaned(spark, folder))
    reason = enterprise_reason("amount", "user_country", "merchant_country", F.hour("timestamp"), "fraud_score")
    return rows.select("transaction_id", reason.alias("reason"))


def _severity_sql(cuts: tuple[float, float, float]) -> str:
    return (f"case when fraud_score >= {cuts[0]} then 'CRITICAL' when fraud_score >= {cuts[1]} then 'HIGH' "
            f"when fraud_score >= {cuts[2]} then 'MEDIUM' else 'LOW' end")


@query("severity", with_parts("scored") + f"select transaction_id, fraud_score, {_severity_sql((0.9, 0.8, 0.7))} severity from scored")
def severity_query(spark, folder):
    return scored(spark, folder).select("transaction_id", "fraud_score", severity("fraud_score").alias("severity"))


@query("severity_seed", with_parts("scored") + f"select transaction_id, fraud_score, {_severity_sql((0.9, 0.7, 0.4))} severity from scored")
def severity_seed_query(spark, folder):
    return scored(spark, folder).select("transaction_id", "fraud_score", seed_severity("fraud_score").alias("severity"))


@query("policy_model", with_parts("req") + f"""
select transaction_id, {POLICY} from (select *, greatest(least(1.0::double, amount / 200000.0::double),
  case when amount >= 42000 and is_international = 1 and is_weekend = 1 and payment_method = 'CREDIT_CARD' and (hour < 6 or hour > 22) then 0.68::double
       when amount >= 40000 and is_international = 1 and is_weekend = 1 and payment_method = 'CREDIT_CARD' then 0.64::double else 0.0::double end) score from req)""")
def policy_model(spark, folder):
    """Floor and bands of the trained model's policy, on a stand-in model score."""
    rows = requests(spark, folder)
    score = F.least(F.lit(1.0), F.col("amount") / 200000.0)
    floored = rows.withColumn("_score", model_score_with_floor(
        score, "amount", "hour", "is_weekend", "is_international", "payment_method"))
    return floored.select("transaction_id", *[c.alias(n) for n, c in policy_columns("_score").items()])


# -- alerts and review ----------------------------------------------------------

@query("alerts_from_fraud", with_parts("alerts") + """
select transaction_id, fraud_score, risk_level, amount, strftime(ts, '%Y-%m-%d %H:%M:%S') "timestamp", status from alerts""")
def alerts_from_fraud(spark, folder):
    rows = alert_ops.session_alerts(scored(spark, folder))
    return rows.select("transaction_id", "fraud_score", "risk_level", "amount", text_time("timestamp"), "status")


_SEED = """, verdict as (select transaction_id, any_value(user_id) user_id, max(score) fraud_score from ent group by 1)"""


def _flagged(spark, folder) -> DataFrame:
    """One verdict per transaction; half the enterprise threshold flags enough rows to work with."""
    rows = alert_ops.enterprise_verdicts(cleaned(spark, folder))
    return rows.select("transaction_id", "user_id", "timestamp", "fraud_score",
                       (F.col("fraud_score") >= 0.35).alias("is_fraud"), F.lit("rule").alias("fraud_reason"))


@query("enterprise_alerts", _ENTERPRISE + f"""
select transaction_id, user_id, {half_up('score', 4)} fraud_score, 'rule' fraud_reason, {_severity_sql((0.9, 0.8, 0.7)).replace('fraud_score', 'score')} severity,
  'PENDING' status from ent where score >= 0.35::double""")
def enterprise_alerts(spark, folder):
    rows = alert_ops.enterprise_alerts(_flagged(spark, folder))
    return rows.select("transaction_id", "user_id", round_half_up("fraud_score", 4).alias("fraud_score"),
                       "fraud_reason", "severity", "status")


@query("insert_alerts_anti", _ENTERPRISE + f"""
select transaction_id, user_id, {half_up('score', 4)} fraud_score, {_severity_sql((0.9, 0.7, 0.4)).replace('fraud_score', 'score')} severity, 'PENDING' status
from ent t where score >= 0.35::double and not exists (select 1 from ent a where a.score >= 0.35::double and a.ts < timestamp '1998-01-01'
  and a.transaction_id = t.transaction_id)""")
def insert_alerts_anti(spark, folder):
    """Alerts for flagged rows that have none; rows of the early years have theirs already."""
    rows = _flagged(spark, folder)
    existing = alert_ops.enterprise_alerts(before_split(rows))
    return alert_ops.seeded_alerts(rows, existing).select(
        "transaction_id", "user_id", round_half_up("fraud_score", 4).alias("fraud_score"), "severity", "status")


@query("insert_audit_anti", with_parts("heur") + """
, wanted as (select distinct case when is_fraud then 'ALERT_CREATED' else 'TRANSACTION_ANALYZED' end event_type, transaction_id entity_id from heur),
audit as (select distinct 'TRANSACTION_ANALYZED' event_type, transaction_id entity_id from heur where ts < timestamp '1998-01-01')
select w.event_type, 'transaction' entity_type, w.entity_id, 'fraud-api' actor from wanted w
where not exists (select 1 from audit a where a.entity_id = w.entity_id and a.event_type = w.event_type)""")
def insert_audit_anti(spark, folder):
    """Audit rows absent by entity and event type."""
    rows = score_rows(requests(spark, folder))
    events = rows.select(
        F.when(F.col("is_fraud"), "ALERT_CREATED").otherwise("TRANSACTION_ANALYZED").alias("event_type"),
        F.lit("transaction").alias("entity_type"), F.col("transaction_id").alias("entity_id"),
        F.lit("fraud-api").alias("actor")).distinct()
    trail = before_split(rows).select(
        F.lit("TRANSACTION_ANALYZED").alias("event_type"), F.col("transaction_id").alias("entity_id")).distinct()
    return alert_ops.missing_audit_events(events, trail)


def _releases(rows: DataFrame) -> DataFrame:
    """Reviewers let go what is in review at home."""
    listed = rows.filter((F.col("recommended_action") == "REVIEW") & (F.col("user_country") == F.col("merchant_country")))
    return listed.select("transaction_id", F.lit(None).cast("string").alias("released_by")).distinct()


_RELEASED = """, rel as (select distinct transaction_id id from scored where recommended_action = 'REVIEW' and user_country = merchant_country)\n"""


@query("release", with_parts("scored") + _RELEASED + """
select s.transaction_id, s.fraud_score, case when id is null then review_status else 'RELEASED' end review_status,
  case when id is null then recommended_action else 'APPROVE' end recommended_action, case when id is null then is_fraud else false end is_fraud,
  case when id is null then risk_level else 'LOW' end risk_level, case when id is null then null else 'analyst' end released_by
from scored s left join rel on s.transaction_id = id""")
def release(spark, folder):
    rows = scored(spark, folder)
    return alert_ops.release(rows, _releases(rows)).select(
        "transaction_id", "fraud_score", "review_status", "recommended_action", "is_fraud", "risk_level", "released_by")


@query("release_alerts", with_parts("alerts") + _RELEASED + """
select a.transaction_id, a.fraud_score, case when id is null then status else 'RELEASED' end status from alerts a left join rel on a.transaction_id = id""")
def release_alerts(spark, folder):
    rows = scored(spark, folder)
    closed = alert_ops.release_alerts(alert_ops.session_alerts(rows), _releases(rows))
    return closed.select("transaction_id", "fraud_score", "status")


@query("release_unknown", with_parts("scored", "ev") + """
select transaction_id from ev where transaction_id not in (select transaction_id from scored)""")
def release_unknown(spark, folder):
    """Requests to release ids that were never scored."""
    wanted = sample.event_transactions(spark, folder).select("transaction_id")
    return alert_ops.unknown_keys(wanted, scored(spark, folder), "transaction_id")


def _reviewed(spark, folder) -> DataFrame:
    """Alerts after review: rows at home are false positives, rows abroad with a high score resolved."""
    rows = _flagged(spark, folder)
    alerts = alert_ops.enterprise_alerts(rows)
    verdict = F.when(F.col("fraud_score") < 0.5, "FALSE_POSITIVE").when(F.col("fraud_score") >= 0.65, "RESOLVED")
    reviews = alerts.select("id", verdict.alias("status"), F.lit("reviewer").alias("reviewed_by")).dropna(subset=["status"])
    return alert_ops.review_alerts(alerts, reviews)


_REVIEWED = _ENTERPRISE + """, reviewed as (select transaction_id, score, case when score < 0.5::double then 'FALSE_POSITIVE'
  when score >= 0.65::double then 'RESOLVED' else 'PENDING' end status from ent where score >= 0.35::double)\n"""


@query("review_alert", _REVIEWED + """
select transaction_id, status, case when status = 'PENDING' then null else 'reviewer' end reviewed_by from reviewed""")
def review_alert(spark, folder):
    return _reviewed(spark, folder).select("transaction_id", "status", "reviewed_by")


@query("alert_stats", _REVIEWED + """
select count(*) total, count(*) filter (status = 'PENDING') pending, count(*) filter (status = 'RESOLVED') resolved,
  count(*) filter (status = 'FALSE_POSITIVE') "falsePositive", round(count(*) filter (status = 'RESOLVED') / count(*)::double, 6) "resolutionRate" from reviewed""")
def alert_stats(spark, folder):
    stats = kpis.alert_statistics(_reviewed(spark, folder))
    return stats.withColumn("resolutionRate", F.round("resolutionRate", 6))


@query("update_fraud_status", _ENTERPRISE + f"""
select transaction_id, amount, {half_up('score', 4)} fraud_score, score >= 0.35::double is_fraud, 'rule' fraud_reason from ent""")
def update_fraud_status(spark, folder):
    """Verdicts written onto the transactions."""
    updated = alert_ops.update_fraud_status(cleaned(spark, folder), _flagged(spark, folder))
    return updated.select("transaction_id", "amount", round_half_up("fraud_score", 4).alias("fraud_score"),
                          "is_fraud", "fraud_reason")


@query("notification_rows", with_parts("scored") + """
select transaction_id, fraud_score, risk_level, recommended_action,
  format('[txlake] Fraude detectada — {} (score {:.2f})', transaction_id, fraud_score) subject from scored where is_fraud""")
def notification_rows(spark, folder):
    return notifications(scored(spark, folder)).select(
        "transaction_id", "fraud_score", "risk_level", "recommended_action", "subject")


# -- lists ----------------------------------------------------------------------

@query("optional_filters", with_parts("clean") + """
select transaction_id, user_id, amount from clean where is_fraud and currency = 'BRL'""")
def optional_filters(spark, folder):
    """Conjunction of the given arguments; those not given filter nothing."""
    rows = listing.where_equal(cleaned(spark, folder), is_fraud=True, user_id=None, currency="BRL")
    return rows.select("transaction_id", "user_id", "amount")


@query("list_filter", with_parts("scored") + """
select transaction_id, 'fraud' "list" from scored where is_fraud and review_status <> 'RELEASED' union all
select transaction_id, 'released' from scored where review_status = 'RELEASED' union all select transaction_id, 'all' from scored""")
def list_filter(spark, folder):
    rows = scored(spark, folder)
    lists = [listing.list_filter(rows, name).select("transaction_id", F.lit(name).alias("list"))
             for name in ("fraud", "released", "all")]
    return lists[0].unionByName(lists[1]).unionByName(lists[2])


@query("point_lookup", with_parts("clean") + """
select transaction_id, user_id, amount from clean where transaction_id = (select min(transaction_id) from clean)""")
def point_lookup(spark, folder):
    rows = cleaned(spark, folder)
    smallest = sample.transactions(spark, folder).select(F.min("transaction_id")).first()[0]
    return listing.lookup(rows, "transaction_id", smallest).select("transaction_id", "user_id", "amount")


_PUBLIC = """transaction_id, amount, merchant_category, payment_method, user_country, merchant_country, fraud_score, is_fraud, risk_level,
  recommended_action, review_status, array_to_string(anomaly_reasons, ' | ') anomaly_reasons, profile_found, processing_time_ms,
  cosmos_sync_status, true history_stored"""


@query("public_view", with_parts("scored") + f"select {_PUBLIC} from scored")
def public_view(spark, folder):
    """The client's view; holder fields are checked by the masks' own queries."""
    rows = listing.public_view(scored(spark, folder)).drop("timestamp", "holder_document", "card_last4")
    return rows.withColumn("anomaly_reasons", F.array_join("anomaly_reasons", " | "))


def _drawn(salt: str) -> str:
    return f"('0x' || left(md5(transaction_id || '|{salt}'), 13))::bigint"


_HOLDERS = with_parts("tx") + f""", drawn as (select transaction_id, lpad(({_drawn('document')} % 1000000000)::varchar, 9, '0') d,
  {CARD_PREFIXES}[{_drawn('prefix')} % {len(CARD_PREFIXES)} + 1] || lpad(({_drawn('card')} % 1000000000000000)::varchar, 15, '0') card,
  {FIRST_NAMES}[{_drawn('first')} % {len(FIRST_NAMES)} + 1] || ' ' || {LAST_NAMES}[{_drawn('last')} % {len(LAST_NAMES)} + 1] card_holder_name from tx),
nine as (select *, case when d = repeat(d[1], 9) then lpad(((d::bigint + 12) % 1000000000)::varchar, 9, '0') else d end base9 from drawn),
holders as ({cpf_digits_sql('nine', 'base9', 'transaction_id, card, card_holder_name')})\n"""


@query("identity_backfill", _HOLDERS + """
select transaction_id, substr(digits, 1, 3) || '.' || substr(digits, 4, 3) || '.' || substr(digits, 7, 3) || '-' || substr(digits, 10, 2) holder_document,
  substr(card, 1, 4) || ' ' || substr(card, 5, 4) || ' ' || substr(card, 9, 4) || ' ' || substr(card, 13, 4) card_number, card_holder_name from holders""")
def identity_backfill(spark, folder):
    """Missing holder fields filled from the transaction id."""
    rows = sample.transactions(spark, folder)
    return rows.select("transaction_id", *[c.alias(n) for n, c in with_identity(rows.columns).items()])


@query("display_table", with_parts("scored") + """
select transaction_id, '—' cpf_mascarado, '—' cartao_ult4, amount, merchant_category, payment_method, fraud_score, is_fraud, review_status,
  cosmos_sync_status, array_to_string(anomaly_reasons, ' | ') anomaly_reasons, recommended_action from scored""")
def display_table(spark, folder):
    """Screen table of rows that came without holder fields."""
    bare = listing.public_view(scored(spark, folder)).drop("holder_document", "card_last4")
    return listing.display_table(bare).withColumn("anomaly_reasons", F.array_join("anomaly_reasons", " | "))


@query("releasable", with_parts("scored") + """
select transaction_id, review_status <> 'RELEASED' and recommended_action = 'REVIEW' can_release from scored""")
def releasable(spark, folder):
    return listing.with_releasable(scored(spark, folder)).select("transaction_id", "can_release")


_ORDER = ["timestamp", "transaction_id", "amount", "fraud_score"]


@query("tail_n", with_parts("scored") + """
select transaction_id, amount, fraud_score, strftime(ts, '%Y-%m-%d %H:%M:%S') "timestamp" from scored
order by ts desc, transaction_id desc, amount desc, fraud_score desc limit 50""")
def tail_n(spark, folder):
    rows = ranking.last_rows(scored(spark, folder), _ORDER, 50)
    return rows.select("transaction_id", "amount", "fraud_score", text_time("timestamp"))


@query("recent_alerts", with_parts("alerts") + """
select transaction_id, amount, fraud_score, status from alerts order by ts desc, transaction_id desc, amount desc, fraud_score desc limit 5""")
def recent_alerts(spark, folder):
    alerts = alert_ops.session_alerts(scored(spark, folder))
    return ranking.last_rows(alerts, _ORDER, 5).select("transaction_id", "amount", "fraud_score", "status")


@query("page", with_parts("clean") + "select transaction_id, user_id, amount from clean order by transaction_id limit 20 offset 40")
def page(spark, folder):
    return ranking.page(cleaned(spark, folder), ["transaction_id"], 2, 20).select("transaction_id", "user_id", "amount")


@query("page_indexed", with_parts("clean") + """
select 2 number, transaction_id, user_id, amount from (select * from clean order by transaction_id limit 20 offset 40)
union all select 100, transaction_id, user_id, amount from (select * from clean order by transaction_id limit 20 offset 2000)
union all select 1000000, transaction_id, user_id, amount from (select * from clean order by transaction_id limit 20 offset 20000000)""")
def page_indexed(spark, folder):
    """Three pages, the last far beyond the end, of a table that was put in order once."""
    table = OrderedTable(spark, scratch_path(spark, "ordered")).write(cleaned(spark, folder).select("transaction_id", "user_id", "amount"), ["transaction_id"])
    first, later, beyond = (table.page(n).select(F.lit(n).alias("number"), "*") for n in (2, 100, 1_000_000))
    return first.unionByName(later).unionByName(beyond)


@query("preview", with_parts("tx") + """
select transaction_id, user_id, amount from tx order by transaction_id, ts, amount nulls first, merchant_id limit 5""")
def preview(spark, folder):
    order = ["transaction_id", "timestamp", "amount", "merchant_id"]
    return ranking.first_rows(sample.transactions(spark, folder), order, 5).select("transaction_id", "user_id", "amount")


@query("review_context", with_parts("scored") + """
, picked as (select *, row_number() over (order by ts desc, transaction_id desc, amount desc, fraud_score desc) place from scored
  where is_fraud and review_status <> 'RELEASED')
select 15 - place as position, transaction_id, recommended_action from picked where place <= 15""")
def review_context(spark, folder):
    """Lines about the last open frauds; the parts of each line that any engine can build."""
    lines = listing.review_context(scored(spark, folder), _ORDER)
    return lines.select(
        F.col("position").cast("bigint").alias("position"),
        F.regexp_extract("line", r"id=([^ ]+) ", 1).alias("transaction_id"),
        F.regexp_extract("line", r"acao=([A-Z]+) ", 1).alias("recommended_action"))


@query("list_summary", with_parts("scored") + """
select count(*) total, count(*) history_mongodb, count(*) filter (cosmos_sync_status = 'PENDING') history_cosmos_pending, 'fraud' "filter",
  least(count(*) filter (is_fraud and review_status <> 'RELEASED'), 50) returned from scored""")
def list_summary(spark, folder):
    return kpis.list_summary(scored(spark, folder), "fraud", 50)


@query("inspect", _ENTERPRISE + f"""
select transaction_id, user_id, amount, {half_up('score', 4)} fraud_score, {_severity_sql((0.9, 0.8, 0.7)).replace('fraud_score', 'score')} severity,
  'PENDING' status from ent where score >= 0.35::double""")
def inspect(spark, folder):
    """Transactions beside their alerts."""
    flagged = _flagged(spark, folder)
    alerts = alert_ops.enterprise_alerts(flagged).select("transaction_id", "severity", "status")
    tx = cleaned(spark, folder).select("transaction_id", "user_id", "amount")
    verdicts = flagged.select("transaction_id", round_half_up("fraud_score", 4).alias("fraud_score"))
    return tx.join(verdicts, "transaction_id").join(alerts, "transaction_id").select(
        "transaction_id", "user_id", "amount", "fraud_score", "severity", "status")


# -- KPIs -----------------------------------------------------------------------

@query("batch_summary", with_parts("scored") + f"""
select count(*) total_analyzed, count(*) filter (is_fraud) total_frauds_detected, {half_up('count(*) filter (is_fraud) / count(*)::double', 4)} fraud_rate from scored""")
def batch_summary(spark, folder):
    return kpis.batch_summary(scored(spark, folder))


@query("dashboard_kpis", with_parts("scored", "prof") + f"""
select count(*) total_transactions, count(*) filter (is_fraud and review_status <> 'RELEASED') total_frauds,
  count(*) filter (review_status = 'RELEASED') total_released, (select count(*) from prof) mongodb_profiles,
  round(count(*) filter (is_fraud and review_status <> 'RELEASED') / count(*)::double, 6) fraud_rate,
  {half_up('avg(processing_time_ms)', 2)} avg_processing_time_ms,
  round((select count(*) from events where event_type = 'error') / count(*)::double, 6) error_rate from scored""")
def dashboard_kpis(spark, folder):
    errors = sample.table(spark, folder, "events").filter("event_type = 'error'")
    rows = kpis.dashboard_kpis(scored(spark, folder), profiles(spark, folder), errors)
    return rows.withColumns({"fraud_rate": F.round("fraud_rate", 6), "error_rate": F.round("error_rate", 6)})


@query("category_counts", with_parts("scored") + """
select 'category' dimension, merchant_category "label", count(*) transactions, count(*) filter (is_fraud) frauds from scored group by 2
union all select 'payment', payment_method, count(*), count(*) filter (is_fraud) from scored group by 2""")
def category_counts(spark, folder):
    return kpis.breakdown(scored(spark, folder))


@query("score_distribution", with_parts("scored") + """
select count(*) filter (fraud_score < 0.60::double) approved_below_60, count(*) filter (fraud_score between 0.60::double and 0.75::double) review_60_75,
  count(*) filter (fraud_score > 0.75::double) blocked_above_75 from scored""")
def score_distribution(spark, folder):
    return kpis.score_distribution(scored(spark, folder))


@query("fraud_by_category", with_parts("scored") + """
select merchant_category, count(*) fraudes from scored where is_fraud and review_status <> 'RELEASED' group by 1""")
def fraud_by_category(spark, folder):
    return kpis.open_frauds_by_category(scored(spark, folder))


@query("alert_list", with_parts("alerts") + _RELEASED + """
select count(*) total, count(*) filter (id is null) "open" from alerts a left join rel on a.transaction_id = id""")
def alert_list(spark, folder):
    rows = scored(spark, folder)
    return kpis.alert_list_summary(alert_ops.release_alerts(alert_ops.session_alerts(rows), _releases(rows)))


@query("file_stats", with_parts("tx") + f"""
select count(*) total, count(*) filter (is_fraud) frauds, round(count(*) filter (is_fraud) / count(*)::double, 6) fraud_rate,
  {half_up('avg(coalesce(amount, 0.0::double))', 2)} amount_mean from tx""")
def file_stats(spark, folder):
    return kpis.file_statistics(sample.landing(spark, folder)).withColumn("fraud_rate", F.round("fraud_rate", 6))


@query("profile_stats", with_parts("scored", "prof") + """
select (select count(*) from prof) mongodb_profiles_loaded, count(*) transaction_history_count,
  count(*) filter (cosmos_sync_status = 'PENDING') transaction_history_cosmos_pending, (select count(*) from prof) > 0 batch_ready from scored""")
def profile_stats(spark, folder):
    return kpis.profile_statistics(profiles(spark, folder), scored(spark, folder))


@query("processing_metrics", """
select count(*) filter (k = 'transaction') transactions_processed, count(*) filter (event_type = 'purchase') frauds_detected,
  count(*) filter (k = 'false_positive') false_positives, count(*) filter (k = 'error') errors,
  round(avg(value) filter (k = 'transaction' and value > 0), 6) processing_time_avg,
  round(count(*) filter (event_type = 'purchase') / count(*) filter (k = 'transaction')::double, 6) fraud_rate,
  round(count(*) filter (k = 'error') / count(*) filter (k = 'transaction')::double, 6) error_rate,
  round((count(*) filter (event_type = 'purchase') - count(*) filter (k = 'false_positive')) / count(*) filter (event_type = 'purchase')::double, 6) "precision"
from (select *, case event_type when 'error' then 'error' when 'signup' then 'false_positive' else 'transaction' end k from events)""")
def processing_metrics(spark, folder):
    """The event table read as a processing log."""
    kind = (F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "signup", "false_positive")
            .otherwise("transaction"))
    log = sample.table(spark, folder, "events").select(
        kind.alias("kind"), (F.col("event_type") == "purchase").alias("is_fraud"), F.col("value").alias("processing_time"))
    rows = kpis.processing_metrics(log)
    return rows.withColumns({n: F.round(n, 6) for n in ("processing_time_avg", "fraud_rate", "error_rate", "precision")})
