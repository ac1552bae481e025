"""Data quality, drift, privacy and text."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from txlake.catalog.lake import after_split, before_split, cleaned
from txlake.catalog.registry import query, scored
from txlake.catalog.sqlparts import half_even, half_up, with_parts
from txlake.functions import masking
from txlake.functions.identity import cpf_from_base
from txlake.operators import alerts as alert_ops, drift, drift_preset, listing, privacy, quality
from txlake.operators.cleaning import add_time_features
from txlake.functions.rendering import transaction_line
from txlake.plans.medallion import run_medallion
from txlake.session import scratch_path
from txlake.sinks.layout import LakeLayout
from txlake.sinks.publish import notifications
from txlake.sources import sample

# -- quality --------------------------------------------------------------------


@query("dq_batch", with_parts("tx") + f"""
select total_records, null_amount, duplicate_ids, fraud_labeled, {half_even('fraud_labeled::double / total_records', 4)} fraud_rate,
  null_amount = 0 and duplicate_ids = 0 success
from (select count(*) total_records, count(*) filter (amount is null) null_amount, count(*) - count(distinct transaction_id) duplicate_ids,
  count(*) filter (is_fraud) fraud_labeled from tx)""")
def dq_batch(spark, folder):
    return quality.batch_counters(sample.transactions(spark, folder))


@query("dq_statistics", with_parts("scored") + f"""
select {half_up('avg(amount)', 2)} amount_mean, {half_up('median(amount)', 2)} amount_median, {half_up('stddev_pop(amount)', 2)} amount_stddev,
  {half_up('min(amount)', 2)} amount_min, {half_up('max(amount)', 2)} amount_max, {half_up('avg(fraud_score)', 4)} fraud_score_mean,
  {half_up('avg(is_fraud::int)', 4)} fraud_rate from scored""")
def dq_statistics(spark, folder):
    return quality.statistics(scored(spark, folder))


_RULES = """
, counts as (select count(*) n, count(*) filter (amount is null) null_amount, count(*) filter (amount < 0 or amount > 1000000) outside,
  count(transaction_id) - count(distinct transaction_id) repeated, avg(amount) mean,
  count(*) filter (currency not in ('BRL', 'USD', 'EUR', 'GBP')) odd_currency from tx),
rules as (
  select 'exists' "rule", c "column", 'error' severity, 1::bigint evaluated, 0::bigint failed from (values ('transaction_id'), ('user_id'), ('amount'), ('timestamp')) v(c)
  union all select 'unique', 'transaction_id', 'error', n, repeated from counts
  union all select 'not_null', 'amount', 'error', n, null_amount from counts
  union all select 'range', 'amount', 'error', n, outside from counts
  union all select 'in_set', 'currency', 'error', n, odd_currency from counts
  union all select 'mean_range', 'amount', 'error', n, case when mean between 100 and 5000 then 0 else 1 end from counts)\n"""


@query("dq_rules", with_parts("tx") + _RULES + 'select *, failed = 0 passed from rules')
def dq_rules(spark, folder):
    return quality.evaluate(sample.transactions(spark, folder), quality.LANDING_RULES)


@query("dq_report", with_parts("tx") + _RULES + """
select bool_and(failed = 0) success, count(*) evaluated_expectations, count(*) filter (failed = 0) successful_expectations,
  count(*) filter (failed <> 0) unsuccessful_expectations, string_agg("rule" || ':' || "column", ',' order by "rule", "column") filter (failed <> 0) failed from rules""")
def dq_report(spark, folder):
    report = quality.report(quality.evaluate(sample.transactions(spark, folder), quality.LANDING_RULES))
    names = F.transform("failed_expectations", lambda f: F.concat_ws(":", f["rule"], f["column"]))
    return report.withColumn("failed", F.array_join(names, ",")).drop("failed_expectations")


@query("dq_advisory", with_parts("tx") + _RULES + """
select bool_and(failed = 0) success, count(*) evaluated_expectations, count(*) filter (failed = 0) successful_expectations,
  count(*) filter (failed <> 0) unsuccessful_expectations from rules""")
def dq_advisory(spark, folder):
    """What a lake run that no failure stops has stored about its rules."""
    layout = LakeLayout(scratch_path(spark, "lake"))
    run_medallion(spark, sample.transactions(spark, folder), layout)
    return spark.read.json(layout.reports("rules_latest")).select(
        "success", "evaluated_expectations", "successful_expectations", "unsuccessful_expectations")


@query("dq_governance", with_parts("people") + """
select 'regex' "rule", 'email' "column", 'warning' severity, count(*) evaluated,
  count(*) filter (not regexp_matches(email, '^[^@]+@[^@]+\\.[^@]+$')) failed,
  count(*) filter (not regexp_matches(email, '^[^@]+@[^@]+\\.[^@]+$')) = 0 passed from people""")
def dq_governance(spark, folder):
    """The e-mail rule of the rule file, a warning."""
    rules = [r for r in quality.GOVERNANCE_RULES if r.column == "email"]
    return quality.evaluate(sample.people(spark, folder), rules)


@query("dq_rule_file", with_parts("tx", "people") + """
, joined as (select transaction_id, amount, email from tx left join people on tx.user_id = people.user_id),
counts as (select count(*) n, count(*) filter (amount is null) no_amount, count(*) filter (amount < 0 or amount > 1000000) outside,
  count(transaction_id) ids, count(distinct transaction_id) kinds,
  count(*) filter (not regexp_matches(email, '^[^@]+@[^@]+\\.[^@]+$')) odd_email from joined)
select 'not_null' "rule", 'amount' "column", 'error' severity, n evaluated, no_amount failed, no_amount = 0 passed from counts
union all select 'range', 'amount', 'warning', n, outside, outside = 0 from counts
union all select 'unique', 'transaction_id', 'error', ids, ids - kinds, ids = kinds from counts
union all select 'regex', 'email', 'warning', n, odd_email, odd_email = 0 from counts""")
def dq_rule_file(spark, folder):
    """All rules of the rule file, over every transaction with its holder's e-mail."""
    holders = sample.people(spark, folder).select("user_id", "email")
    rows = sample.transactions(spark, folder).join(holders, "user_id", "left")
    return quality.evaluate(rows, quality.rules_from_config(quality.RULE_FILE))


@query("dq_constraints", with_parts("tx") + """
, counts as (select count(*) n, count(transaction_id) - count(distinct transaction_id) repeated, count(*) filter (amount is null) no_amount,
  count(*) filter (amount <= 0) not_positive from tx)
select 'not_null' "rule", c "column", 'error' severity, n evaluated, 0::bigint failed, true passed
  from counts cross join (values ('transaction_id'), ('user_id'), ('currency'), ('merchant_id'), ('timestamp')) v(c)
union all select 'not_null', 'amount', 'error', n, no_amount, no_amount = 0 from counts
union all select 'unique', 'transaction_id', 'error', n, repeated, repeated = 0 from counts
union all select 'positive', 'amount', 'error', n, not_positive, not_positive = 0 from counts""")
def dq_constraints(spark, folder):
    return quality.evaluate(sample.transactions(spark, folder), quality.TRANSACTION_CONSTRAINTS)


@query("dq_api_checks", with_parts("scored") + """
, c as (select count(*) filter (amount is null) nulls, count(*) filter (amount < 0 or amount > 1000000) outside,
  count(*) - count(distinct transaction_id) repeated, count(*) filter (is_fraud) / count(*)::double rate from scored)
select 'amount_not_null' "rule", nulls = 0 passed, format('{} valores nulos encontrados', nulls) details from c
union all select 'amount_range_0_1M', outside = 0, format('{} valores fora do range', outside) from c
union all select 'transaction_id_unique', repeated = 0, format('{} IDs duplicados', repeated) from c
union all select 'fraud_rate_below_50pct', rate < 0.5::double, format('Taxa de fraude: {:.2f}%', rate * 100) from c""")
def dq_api_checks(spark, folder):
    return quality.api_checks(scored(spark, folder))


@query("dq_api_report", with_parts("scored") + """
select 'ok' status, count(*) total_records, count(*) filter (amount is null) = 0 and count(*) filter (amount < 0 or amount > 1000000) = 0
  and count(*) = count(distinct transaction_id) and count(*) filter (is_fraud) / count(*)::double < 0.5::double all_passed from scored""")
def dq_api_report(spark, folder):
    return quality.api_report(scored(spark, folder)).select("status", "total_records", "all_passed")


# -- drift ----------------------------------------------------------------------

_SIDES = """
, r as (select * from clean where ts < timestamp '1998-01-01'), c as (select * from clean where ts >= timestamp '1998-01-01')\n"""
_BINS = """, edge as (select min(amount) low, max(amount) high from r),
binned as (select greatest(0, least(9, cast(floor((amount - low) / (high - low) * 10) as bigint))) bin, ref from
  (select amount, true ref from r union all select amount, false from c) cross join edge),
amount_bins as (select bin, count(*) filter (ref) rr, count(*) filter (not ref) cr from binned group by bin),
category_bins as (select merchant_category, count(*) filter (ref) rr, count(*) filter (not ref) cr from
  (select merchant_category, true ref from r union all select merchant_category, false from c) group by 1)\n"""


def _sides(spark, folder) -> tuple[DataFrame, DataFrame]:
    rows = cleaned(spark, folder)
    return before_split(rows), after_split(rows)


@query("drift_bins", with_parts("clean") + _SIDES + _BINS + "select bin, rr reference_rows, cr current_rows from amount_bins")
def drift_bins(spark, folder):
    return drift.numeric_bins(*_sides(spark, folder), "amount")


def _psi_sql(bins: str, column: str) -> str:
    return f"""select '{column}' "column", round(sum((cs - rs) * ln(cs / rs)), 6) psi from (
  select greatest(rr / sum(rr) over ()::double, 0.0001::double) rs, greatest(cr / sum(cr) over ()::double, 0.0001::double) cs from {bins})"""


@query("drift_psi", with_parts("clean") + _SIDES + _BINS + _psi_sql("amount_bins", "amount") + "\nunion all\n"
       + _psi_sql("category_bins", "merchant_category"))
def drift_psi(spark, folder):
    rows = drift.psi(*_sides(spark, folder), ["amount"], ["merchant_category"])
    return rows.withColumn("psi", F.round("psi", 6))


@query("drift_ks", with_parts("clean") + _SIDES + """
, v as (select amount, count(*) filter (ref) rr, count(*) filter (not ref) cr from
  (select amount, true ref from r union all select amount, false from c) group by 1),
run as (select sum(rr) over (order by amount) ru, sum(cr) over (order by amount) cu from v)
select 'amount' "column", round(max(abs(ru / (select count(*) from r)::double - cu / (select count(*) from c)::double)), 9) ks from run""")
def drift_ks(spark, folder):
    rows = drift.ks(*_sides(spark, folder), ["amount"])
    return rows.select("column", F.round("ks", 9).alias("ks"))


def _chi2_sql(column: str) -> str:
    """Statistic, freedom and upper tail; the tail is 1 minus the power series of the lower incomplete gamma function."""
    return f"""
select *, 1 - list_sum(list_transform(range(500), lambda n: exp((freedom / 2.0::double + n) * ln(chi2 / 2) - chi2 / 2 - lgamma(freedom / 2.0::double + n + 1)))) p_value
from (select '{column}' "column", sum((rr - re) ** 2 / re + (cr - ce) ** 2 / ce) chi2, count(*) - 1 freedom from (
  select rr, cr, (rr + cr) * (sum(rr) over ())::double / (sum(rr) over () + sum(cr) over ()) re,
    (rr + cr) * (sum(cr) over ())::double / (sum(rr) over () + sum(cr) over ()) ce from (
    select {column}, count(*) filter (ref) rr, count(*) filter (not ref) cr from
      (select {column}, true ref from r union all select {column}, false from c) group by 1)))"""


@query("drift_chi2", with_parts("clean") + _SIDES + """
select "column", round(chi2, 6) chi2, freedom, round(p_value, 6) p_value from (""" + _chi2_sql("merchant_category") + " union all " + _chi2_sql("payment_method") + ")")
def drift_chi2(spark, folder):
    rows = drift.chi_square(*_sides(spark, folder), ["merchant_category", "payment_method"])
    return rows.select("column", F.round("chi2", 6).alias("chi2"), "freedom", F.round("p_value", 6).alias("p_value"))


@query("drift_share", with_parts("clean") + _SIDES + f"""
, v as (select amount, count(*) filter (ref) rr, count(*) filter (not ref) cr from
  (select amount, true ref from r union all select amount, false from c) group by 1),
run as (select sum(rr) over (order by amount) ru, sum(cr) over (order by amount) cu from v),
gap as (select max(abs(ru / n - cu / m)) * sqrt(n * m / (n + m)) s from run, (select count(*)::double n from r), (select count(*)::double m from c) group by n, m),
p as (select 2 * list_sum(list_transform(range(1, 101), lambda j: (-1) ** (j - 1) * exp(-2 * j * j * s * s))) p_value from gap
  union all select p_value from ({_chi2_sql("merchant_category")}) union all select p_value from ({_chi2_sql("payment_method")}))
select count(*) columns_tested, count(*) filter (p_value < {drift.P_LIMIT}) columns_drifted, count(*) filter (p_value < {drift.P_LIMIT}) / count(*)::double drifted_share,
  count(*) filter (p_value < {drift.P_LIMIT}) / count(*)::double >= {drift.DRIFTED_SHARE_LIMIT} dataset_drift from p""")
def drift_share(spark, folder):
    """Share of drifted columns."""
    return drift.drift_share(*_sides(spark, folder), ["amount"], ["merchant_category", "payment_method"])

_TAIL = "1 - list_sum(list_transform(range(500), lambda i: exp((freedom / 2.0::double + i) * ln(x2 / 2) - x2 / 2 - lgamma(freedom / 2.0::double + i + 1))))"
_PRESET_COLUMNS = (["amount", "transaction_hour", "is_weekend"], ["merchant_category", "payment_method"])


def _preset_sql(small: int) -> str:
    numeric, categorical = _PRESET_COLUMNS
    cells = " union all ".join(
        [f"select '{c}' col, true num, {c}::double v, null::varchar l, ref from both_sides where {c} is not null" for c in numeric]
        + [f"select '{c}', false, null, {c}, ref from both_sides" for c in categorical])
    return with_parts("featured") + f""", both_sides as (select *, ts < timestamp '1998-01-01' ref from featured), cell as ({cells}),
k as (select col, num, v, l, count(*) filter (ref) r, count(*) filter (not ref) c from cell group by all),
t as (select col, num, sum(r)::double n, sum(c)::double m, count(*) vals, sum(v * r) / sum(r) mean from k group by all),
o as (select col, max(gap) ks, coalesce(sum(gap * (nxt - v)), 0) area, sqrt(sum((v - mean) ** 2 * r) / sum(r)) sd from (
  select k.*, t.mean, abs(sum(r) over w / n - sum(c) over w / m) gap, lead(v) over w nxt from k join t using (col) where k.num window w as (partition by k.col order by v)) group by 1),
s as (select col, sqrt(greatest(sum(case when r > 0 then r / n * ln(r / n / ((r / n + c / m) / 2)) else 0 end + case when c > 0 then c / m * ln(c / m / ((r / n + c / m) / 2)) else 0 end) / 2, 0)) js,
  sum((r - (r + c) / (n + m) * n) ** 2 / ((r + c) / (n + m) * n) + (c - (r + c) / (n + m) * m) ** 2 / ((r + c) / (n + m) * m)) chi2,
  max(abs(r / n - c / m) / sqrt((r + c) / (n + m) * (1 - (r + c) / (n + m)) * (1 / n + 1 / m))) z from k join t using (col) group by 1),
q as (select *, case when n > {small} then case when num and vals > 5 then 'wasserstein' else 'jensen_shannon' end
  when num and vals > 5 then 'ks' when vals = 2 then 'two_proportions' else 'chi_square' end test from t join s using (col) left join o using (col)),
f as (select *, case test when 'wasserstein' then area / greatest(sd, 0.001) when 'jensen_shannon' then js when 'ks' then ks when 'two_proportions' then z else chi2 end statistic,
  case test when 'two_proportions' then z * z when 'chi_square' then chi2 end x2, case test when 'two_proportions' then 1 else vals - 1 end freedom from q),
p as (select *, case test when 'ks' then 2 * list_sum(list_transform(range(1, 101), lambda j: (-1) ** (j - 1) * exp(-2 * j * j * ks * ks * n * m / (n + m))))
  when 'two_proportions' then {_TAIL} when 'chi_square' then {_TAIL} end p_value from f)
select col "column", test, round(statistic, 6) statistic, round(p_value, 6) p_value, coalesce(p_value < 0.05, statistic >= 0.1) drifted from p"""


def _preset(spark, folder, small: int) -> DataFrame:
    rows = add_time_features(cleaned(spark, folder))
    rows = drift_preset.preset(before_split(rows), after_split(rows), *_PRESET_COLUMNS, small=small)
    return rows.withColumns({"statistic": F.round("statistic", 6), "p_value": F.round("p_value", 6)})


@query("drift_preset", _preset_sql(drift_preset.SMALL))
def drift_preset_query(spark, folder):
    """Every column by the test for many rows: distances."""
    return _preset(spark, folder, drift_preset.SMALL)


@query("drift_preset_tests", _preset_sql(10**12))
def drift_preset_tests(spark, folder):
    """The same columns by the tests for few rows: p-values."""
    return _preset(spark, folder, 10**12)



# -- privacy --------------------------------------------------------------------

def _mask_query(name: str, source: str, column: str, mask) -> None:
    @query(name, with_parts("masked") + f'select user_id, {column} masked from masked')
    def masked(spark, folder):
        return sample.people(spark, folder).select("user_id", mask(source).alias("masked"))


_mask_query("mask_cpf", "cpf", "m_cpf", masking.mask_cpf)
_mask_query("mask_email", "email", "m_email", masking.mask_email)
_mask_query("mask_phone", "phone", "m_phone", masking.mask_phone)
_mask_query("mask_name", "name", "m_name", masking.mask_name)
_mask_query("mask_card", "card_number", "m_card", masking.mask_card)
_mask_query("card_last4", "card_number", "m_last4", masking.card_last4)


@query("mask_pii", with_parts("masked") + """
select user_id, segment, m_cpf cpf, m_email email, m_phone phone, case when trim("name") = '' then "name" else m_name end "name", m_card card_number from masked""")
def mask_pii(spark, folder):
    return privacy.mask_pii(sample.people(spark, folder)).drop("cpf_base")


@query("export_masked", with_parts("masked") + """
select user_id, m_cpf cpf, m_email email, m_phone phone, m_card card_number from masked""")
def export_masked(spark, folder):
    """Read, mask, write; the export as read back."""
    from txlake.session import scratch_path

    path = scratch_path(spark, "masked")
    privacy.mask_pii(sample.people(spark, folder)).write.parquet(path)
    return spark.read.parquet(path).select("user_id", "cpf", "email", "phone", "card_number")


@query("pseudonymize", with_parts("tx") + """
select transaction_id, left(sha256(user_id), 16) user_pseudonym, left(sha256(user_id || 'salt'), 16) salted_pseudonym from tx""")
def pseudonymize(spark, folder):
    return sample.transactions(spark, folder).select(
        "transaction_id", masking.pseudonym("user_id").alias("user_pseudonym"),
        masking.pseudonym("user_id", "salt").alias("salted_pseudonym"))


@query("cpf_digits", with_parts("people") + "select user_id, digits cpf from people")
def cpf_digits(spark, folder):
    return sample.people(spark, folder).select("user_id", cpf_from_base("cpf_base").alias("cpf"))


@query("cpf_validity", with_parts("people") + """
select segment, count(*) filter (length(regexp_replace(cpf, '[^0-9]', '', 'g')) = 11) valid_documents,
  count(*) filter (length(regexp_replace(cpf, '[^0-9]', '', 'g')) <> 11) invalid_documents from people group by 1""")
def cpf_validity(spark, folder):
    return privacy.document_validity(sample.people(spark, folder), "cpf", "segment")


@query("holder_text", with_parts("masked") + """
select user_id, case when trim("name") <> '' then m_name when trim(cpf) <> '' and length(cpf) > 4 then '***' || right(cpf, 4) else '-' end holder from masked""")
def holder_text(spark, folder):
    return sample.people(spark, folder).select("user_id", masking.holder_text("name", "cpf").alias("holder"))


# -- text -----------------------------------------------------------------------

@query("tx_line", with_parts("scored") + """
select transaction_id, '- id=' || transaction_id || ' | doc=— | cartao=— | R$ ' || amount::varchar || ' | ' || merchant_category || ' | ' || payment_method
  || ' | score=' || fraud_score::varchar || ' | fraude=' || is_fraud::varchar || ' | acao=' || recommended_action || ' | status=' || review_status
  || ' | motivos=[' || array_to_string(anomaly_reasons, ', ') || ']' || chr(10) line from scored""")
def tx_line(spark, folder):
    """One line per transaction, here without holder fields."""
    rows = scored(spark, folder).withColumns({
        "holder_document": F.lit(None).cast("string"), "card_last4": F.lit(None).cast("string")})
    return rows.select("transaction_id", transaction_line().alias("line"))


@query("alert_text", with_parts("scored") + """
select transaction_id, 'Score: ' || fraud_score::varchar || chr(10) || 'Nivel de risco: ' || risk_level || chr(10) || 'Acao recomendada: '
  || recommended_action || chr(10) || 'Valor: ' || amount::varchar || chr(10) || 'Categoria: ' || merchant_category || chr(10)
  || 'Pagamento: ' || payment_method middle from scored where is_fraud""")
def alert_text(spark, folder):
    """Notification bodies; the lines between the ids and the holder."""
    rows = notifications(scored(spark, folder))
    return rows.select("transaction_id", F.regexp_extract("body", r"(?s)(Score: .*?Pagamento: [^\n]*)", 1).alias("middle"))
