"""Operators on small frames, edge rows and skewed keys against brute force."""

import math
import re
import random
import statistics
from datetime import datetime

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_module
from txlake.operators import adapters, alerts, cleaning, drift, enrich, kpis, listing, merge, privacy, profiles, quality, ranking
from txlake.operators.anomaly import with_anomaly
from txlake.sinks.history import new_history, rejected_history

random.seed(7)


def skewed_amounts():
    """One user with two thirds of the rows; cents, zeros, negatives, repeats and wide ranges."""
    rows = [("hot", round(random.choice([1, -1, 100, 1e6]) * random.random(), 2)) for _ in range(4000)]
    rows += [("hot", 7.25)] * 1500 + [("hot", 0.0)] * 500
    rows += [(f"u{i % 60}", round(random.lognormvariate(4, 2), 2)) for i in range(3000)]
    return rows + [("one", 5.0), ("two", 1.0), ("two", 2.0), ("nulls", None)]


def by_key(rows):
    groups = {}
    for key, value in rows:
        if value is not None:
            groups.setdefault(key, []).append(value)
    return {k: sorted(v) for k, v in groups.items()}


def test_p95_matches_brute_force_under_skew(spark):
    rows = skewed_amounts()
    frame = spark.createDataFrame(rows, "user_id string, amount double")
    got = {r["user_id"]: r["p"] for r in ranking.lower_p95(frame, ["user_id"], "amount", "p").collect()}
    assert got == {k: v[max(0, int(len(v) * 0.95) - 1)] for k, v in by_key(rows).items()}


@pytest.mark.parametrize("n", [1, 2, 3, 1000, 1001])
def test_median_matches_brute_force(spark, n):
    values = [round(random.uniform(-500, 90000), 2) for _ in range(n)]
    frame = spark.createDataFrame([(v,) for v in values], "amount double")
    assert ranking.exact_median(frame, "amount", "m").first()["m"] == statistics.median(values)


def test_median_of_nothing(spark):
    assert ranking.exact_median(spark.createDataFrame([], "amount double"), "amount", "m").first()["m"] is None


def test_ranks_of_large_and_small_keys_agree(spark, monkeypatch):
    """Keys around the bound of values that are put in order at once give what they gave by buckets."""
    rows = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, "wide").otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("k"),
        ((F.col("id") * 7919) % 997 - 300.5).alias("v"))
    median = {"middle": lambda n: F.floor((n + 1) / 2), "last": lambda n: n}
    found = {}
    for bound in (0, 40, 10**6):
        monkeypatch.setattr(ranking, "ORDERED_AT_ONCE", bound)
        found[bound] = sorted(map(tuple, ranking.order_statistics(rows, ["k"], "v", median).select("k", "statistic", "value").collect()))
    assert found[0] == found[40] == found[10**6] and len(found[0]) == 2 * 51


def test_ranks_of_small_keys_take_one_shuffle(spark):
    """Rows of a key are dealt once: counted and put in order by the task that then holds them."""
    rows = spark.range(100).select((F.col("id") % 7).alias("k"), F.col("id").cast("double").alias("v"))
    few, _ = ranking.few_and_many(rows, ["k"])
    plan = ranking._found_in_order(few.withColumnRenamed("v", "value").groupBy("k", "value").agg(F.count("*").alias("_copies")), ["k"], {"last": lambda n: n})
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.count("REPARTITION_BY_COL") == 1 and text.count("ENSURE_REQUIREMENTS") == 1, "the sizes have the other"
    assert sorted(r["value"] for r in plan.collect()) == [93.0, 94.0, 95.0, 96.0, 97.0, 98.0, 99.0]


def test_tidy_restores_the_setting(spark):
    from txlake import session

    before, branch = spark.conf.get(session._CLEAN_UP), spark.newSession()
    one, two, other = session.tidy(spark), session.tidy(spark), session.tidy(branch)
    one.__enter__(), other.__enter__(), two.__enter__()
    one.__exit__(None, None, None)
    assert spark.conf.get(session._CLEAN_UP) == "true", "another thread may still be inside"
    two.__exit__(None, None, None)
    assert spark.conf.get(session._CLEAN_UP) == before and branch.conf.get(session._CLEAN_UP) == "true"
    other.__exit__(None, None, None)
    assert branch.conf.get(session._CLEAN_UP) == before


@pytest.mark.parametrize("amounts,avg,std,p95", [
    ([100], 100, 0, 100), ([100, 200], 150, 50, 100), ([10, 20, 30, 40, 50], 30, 14.14, 40),
    (list(range(1, 21)), 10.5, 5.77, 19), (list(range(1, 41)), 20.5, 11.54, 38)])
def test_profile_golden_values(spark, amounts, avg, std, p95):
    rows = spark.createDataFrame([("u", float(a), "2024-01-01T10:00:00") for a in amounts], "user_id string, amount double, timestamp string")
    tx = rows.withColumns({"merchant_category": F.lit(None).cast("string"), "payment_method": F.lit(""), "is_fraud": F.lit(None).cast("boolean"),
                           "user_country": F.lit("BR"), "merchant_country": F.lit(None).cast("string")})
    p = profiles.build_profiles(profiles.profile_rows(tx)).first()
    assert (p["avg_amount"], p["std_amount"], p["p95_amount"], p["tx_count"]) == (avg, std, p95, len(amounts))
    assert (p["typical_categories"], p["typical_payment_methods"]) == (["Outros"], ["CREDIT_CARD"])
    assert (p["pct_international"], p["avg_hour"], p["historical_fraud_rate"]) == (0.0, 10.0, 0.0)


def test_top_labels_ties_and_limit(spark):
    rows = [("u", c) for c in "aaabbbccdefg"] + [("v", "z")]
    frame = spark.createDataFrame(rows, "user_id string, merchant_category string")
    got = {r[0]: r[1] for r in profiles.user_top_categories(frame).collect()}
    assert got == {"u": ["a", "b", "c", "d", "e"], "v": ["z"]}


ANOMALIES = [
    (10, 500.0, "Eletronicos", "CREDIT_CARD", 3, 0.22, 4), (4, 500.0, "Eletronicos", "CREDIT_CARD", 3, 0.1925, 3),
    (2, 500.0, "Eletronicos", "CREDIT_CARD", 3, 0.108, 1), (1, 500.0, "Eletronicos", "CREDIT_CARD", 3, 0.087, 1),
    (10, 145.0, "Alimentacao", "DEBIT_CARD", 12, 0.09, 1), (4, 145.0, "Alimentacao", "DEBIT_CARD", 12, 0.0, 0),
    (4, 155.0, "Alimentacao", "DEBIT_CARD", 12, 0.0792, 1), (10, 150.0, "Alimentacao", "DEBIT_CARD", 18, 0.13, 2),
    (10, 120.0, "Alimentação", "DEBIT_CARD", 17, 0.0, 0), (None, 500.0, "X", "Y", 3, 0.0, 1),
]


def test_profile_anomaly_golden_values(spark):
    kind = "n long, amount double, merchant_category string, payment_method string, hour int, boost double, reasons int"
    rows = spark.createDataFrame(ANOMALIES, kind).withColumn("profile", F.when(F.col("n").isNotNull(), F.struct(
        F.col("n").alias("tx_count"), F.lit(100.0).alias("avg_amount"), F.lit(20.0).alias("std_amount"),
        F.lit(140.0).alias("p95_amount"), F.lit(12.0).alias("avg_hour"),
        F.array(F.lit("Alimentação")).alias("typical_categories"), F.array(F.lit("DEBIT_CARD")).alias("typical_payment_methods"))))
    got = with_anomaly(rows)
    assert got.filter("anomaly_score_boost != boost or size(anomaly_reasons) != reasons").isEmpty()
    first = got.filter("n = 10 and amount = 500").first()["anomaly_reasons"]
    assert first == [
        "Valor R$ 500.00 acima do padrao historico (media R$ 100.00, p95 R$ 140.00)",
        "Categoria 'Eletronicos' atipica para o usuario (historico: [Alimentação])",
        "Meio de pagamento 'CREDIT_CARD' incomum no historico", "Horario 3h distante do padrao (media 12.0h)"]
    assert not got.filter("n is null").first()["is_unusual"]


def test_dedup_is_total_and_counts_null_as_one_key(spark):
    rows = [("a", 1.0, "m2"), ("a", 5.0, "m1"), ("a", 5.0, "m0"), (None, 1.0, "x"), (None, 2.0, "y"), ("b", None, "z")]
    frame = spark.createDataFrame(rows * 50, "transaction_id string, amount double, merchant_id string").withColumn(
        "timestamp", F.lit("2024-01-01"))
    kept = {r["transaction_id"]: (r["amount"], r["merchant_id"]) for r in cleaning.dedup(frame.repartition(7)).collect()}
    assert kept == {"a": (5.0, "m0"), None: (2.0, "y"), "b": (None, "z")}
    assert tuple(quality.duplicate_count(frame).first()) == (300, 297)


def test_dedup_drops_copies_before_the_shuffle(spark):
    plan = cleaning.dedup(spark.range(10).select((F.col("id") % 3).alias("transaction_id"), F.col("id").alias("amount")))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in text and "Partial" in text


def test_clean_and_enrich_edge_rows(spark):
    rows = [("1", "u", float("nan"), None, None), ("2", "u", -3.0, "A", "BR"), ("3", None, 10.0, "A", "BR"), ("4", "v", None, "A", "US")]
    frame = spark.createDataFrame(rows, "transaction_id string, user_id string, amount double, merchant_category string, user_country string")
    silver = enrich.enrich(cleaning.clean(frame.withColumn("timestamp", F.lit(datetime(2024, 1, 6, 3)))))
    got = {r["transaction_id"]: r for r in silver.collect()}
    assert [got[k]["amount"] for k in "1234"] == [0.0, 0.0, 10.0, 0.0]
    assert (got["1"]["merchant_category"], got["1"]["user_country"]) == ("UNKNOWN", "UNKNOWN")
    assert (got["1"]["is_weekend"], got["1"]["is_night"], got["1"]["transaction_month"]) == (1, 1, 1)
    assert got["3"]["user_avg_amount"] is None, "rows without a user keep null statistics"
    assert got["4"]["user_amount_stddev"] is None and got["1"]["user_total_transactions"] == 2
    assert "merchant_avg_amount" not in silver.columns and "merchant_transaction_count" not in enrich.gold(silver).columns


def test_adapters(spark):
    api = spark.createDataFrame([(150.0, None, "BR", "US", None)], "amount double, merchant_category string, user_country string, merchant_country string, hour int")
    assert tuple(adapters.normalize(api, "api").first()) == (150.0, "Outros", "CREDIT_CARD", 12, 0, 1)
    sim = spark.createDataFrame([("x", 999.0, "Eletrônicos", "2025-03-29T22:15:00", "BR", "US", "CREDIT_CARD", True)],
                                "transaction_id string, amount double, merchant_category string, timestamp string, user_country string, merchant_country string, payment_method string, is_fraud boolean")
    for source in ("simulator", "auto"):
        out = adapters.normalize(sim, source)
        assert tuple(out.first()) == (999.0, "Eletronicos", "CREDIT_CARD", 22, 1, 1) and "is_fraud" not in out.columns
    csv = spark.createDataFrame([("", "7.5", "", "", "", "9", "", "1"), ("x", None, "Viagem", None, "PIX", "z", "1", "0")],
                                "vlr_transacao string, amount string, categoria string, merchant_category string, meio_pagamento string, hora string, fim_semana string, internacional string")
    assert [tuple(r) for r in adapters.normalize(csv, "csv").collect()] == [
        (7.5, "Outros", "CREDIT_CARD", 9, 0, 1), (None, "Viagem", "PIX", 12, 1, 0)]
    messages = spark.createDataFrame([('{"amount": 5, "hour": 3}',), ('{"amount": 1, "timestamp": "2025-03-29T01:00:00", "merchant_category": "A"}',)], "value string")
    assert [r["hour"] for r in adapters.normalize(messages, "event").collect()] == [3, 1]
    with pytest.raises(ValueError):
        adapters.normalize(api, "fax")


def test_quality_rules_report_and_gate(spark):
    rows = spark.createDataFrame([("1", 5.0, "BRL"), ("1", None, "XXX"), (None, 2e6, None)], "transaction_id string, amount double, currency string")
    results = {(r["rule"], r["column"]): r for r in quality.evaluate(rows, quality.LANDING_RULES).collect()}
    assert results["exists", "user_id"]["passed"] is False and results["exists", "amount"]["passed"] is True
    assert [results[k]["failed"] for k in (("unique", "transaction_id"), ("not_null", "amount"), ("range", "amount"), ("in_set", "currency"))] == [1, 1, 1, 1]
    report = quality.report(quality.evaluate(rows, quality.LANDING_RULES)).first()
    assert (report["success"], report["evaluated_expectations"], report["unsuccessful_expectations"]) == (False, 9, 7)
    quality.enforce(quality.evaluate(rows, quality.LANDING_RULES))
    with pytest.raises(quality.DataQualityError):
        quality.enforce(quality.evaluate(rows, quality.LANDING_RULES), "error")
    config = [{"column": "transaction_id", "rules": [{"type": "uniqueness"}]}, {"column": "amount", "rules": [{"type": "range", "min": 0, "max": 9, "severity": "warning"}]}]
    rules = quality.rules_from_config(config)
    assert [(r.kind, r.severity) for r in rules] == [("unique", "error"), ("range", "warning")]
    quality.enforce(quality.evaluate(rows.filter("transaction_id is null"), rules[1:]), "error")


def test_rule_file_is_evaluated_whole(spark, small):
    assert quality.rules_from_config(quality.RULE_FILE) == quality.GOVERNANCE_RULES
    rows = entry_module.queries()["dq_rule_file"](spark, small).collect()
    whole = spark.read.parquet(f"{small}/lineitem.parquet").count()
    assert {(r["rule"], r["column"], r["severity"], r["evaluated"]) for r in rows} == {
        (r.kind, r.column, r.severity, whole) for r in quality.GOVERNANCE_RULES} and len(rows) == 4


def test_reports_without_data(spark):
    empty = spark.createDataFrame([], "transaction_id string, amount double, fraud_score double, is_fraud boolean, review_status string")
    assert quality.api_checks(empty).isEmpty()
    assert quality.api_report(empty).first()["status"] == "no_data"
    assert quality.batch_counters(empty).first()["fraud_rate"] == 0.0
    assert tuple(kpis.batch_summary(empty).first()) == (0, 0, 0.0)


def test_drift(spark):
    ref = [random.gauss(100, 10) for _ in range(3000)]
    cur = [random.gauss(112, 10) for _ in range(2000)]
    a = spark.createDataFrame([(v, "x" if v < 100 else "y") for v in ref], "amount double, label string")
    b = spark.createDataFrame([(v, "x" if v < 100 else "z") for v in cur], "amount double, label string")
    ks = drift.ks(a, b, ["amount"]).first()
    brute = max(abs(sum(x <= v for x in ref) / 3000 - sum(x <= v for x in cur) / 2000) for v in ref[::7] + cur[::7])
    assert brute <= ks["ks"] + 1e-12 and ks["ks"] - brute < 0.01 and ks["p_value"] < 1e-6
    same = drift.drift_share(a, a, ["amount"], ["label"]).first()
    assert (same["columns_drifted"], same["dataset_drift"]) == (0, False)
    moved = drift.drift_share(a, b, ["amount"], ["label"]).first()
    assert (moved["columns_tested"], moved["columns_drifted"], moved["dataset_drift"]) == (2, 2, True)
    assert drift.psi(a, a, ["amount"], ["label"]).agg(F.max("psi")).first()[0] == 0.0


def test_chi_square_tail():
    assert math.isclose(drift._chi2_tail(3.841458820694124, 1), 0.05, rel_tol=1e-9)
    assert math.isclose(drift._chi2_tail(5.991464547107979, 2), 0.05, rel_tol=1e-9)
    assert math.isclose(drift._chi2_tail(11.070497693516351, 5), 0.05, rel_tol=1e-9)
    assert drift._chi2_tail(0.0, 3) == 1.0


def test_merges_are_idempotent(spark):
    old = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y")], "k string, v int, w string")
    new = spark.createDataFrame([("b", 20, None), ("c", 30, "z")], "k string, v int, w string")
    once = merge.replace_by_key(old, new, "k")
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, merge.replace_by_key(once, new, "k").collect()))
    part = merge.upsert_columns(old, new, "k", ["w"])
    assert sorted(map(tuple, part.collect())) == [("a", 1, "x"), ("b", 2, None), ("c", 30, "z")]
    assert sorted(map(tuple, merge.upsert_columns(part, new, "k", ["w"]).collect())) == sorted(map(tuple, part.collect()))


def seed(spark):
    rows = [("demo-tx-001", "user_1001", 0.12, False), ("demo-tx-002", "user_2042", 0.91, True), ("demo-tx-003", "user_1001", 0.08, False),
            ("demo-tx-004", "user_3300", 0.97, True), ("demo-tx-005", "user_2042", 0.05, False)]
    return spark.createDataFrame(rows, "transaction_id string, user_id string, fraud_score double, is_fraud boolean").withColumn("fraud_reason", F.lit("r"))


def test_seeded_alerts_twice(spark):
    none = spark.createDataFrame([], "transaction_id string")
    made = alerts.seeded_alerts(seed(spark), none)
    assert sorted((r["transaction_id"], r["severity"], r["status"]) for r in made.collect()) == [
        ("demo-tx-002", "CRITICAL", "PENDING"), ("demo-tx-004", "CRITICAL", "PENDING")]
    assert alerts.seeded_alerts(seed(spark), made).isEmpty()


def test_release_and_review(spark):
    scored = seed(spark).withColumns({
        "review_status": F.lit("OPEN"), "recommended_action": F.lit("REVIEW"), "risk_level": F.lit("HIGH"), "amount": F.lit(1.0),
        "timestamp": F.current_timestamp()})
    asked = spark.createDataFrame([("demo-tx-002", None), ("demo-tx-002", None), ("nope", "me")], "transaction_id string, released_by string")
    after = {r["transaction_id"]: r for r in alerts.release(scored, asked).collect()}
    hit = after["demo-tx-002"]
    assert len(after) == 5 and (hit["review_status"], hit["is_fraud"], hit["released_by"], hit["risk_level"]) == ("RELEASED", False, "analyst", "LOW")
    assert after["demo-tx-004"]["released_at"] is None and hit["released_at"] is not None
    assert [r[0] for r in alerts.unknown_keys(asked, scored, "transaction_id").select("transaction_id").collect()] == ["nope"]
    opened = alerts.session_alerts(scored)
    assert {r["transaction_id"]: r["status"] for r in alerts.release_alerts(opened, asked).collect()} == {"demo-tx-002": "RELEASED", "demo-tx-004": "OPEN"}
    assert listing.with_releasable(scored).filter("can_release").count() == 5
    assert listing.list_filter(alerts.release(scored, asked), "released").count() == 1


def test_history_is_unique(spark):
    rows = spark.createDataFrame([("a", 1.0, 2), ("a", 2.0, 1), ("b", 3.0, 1)], "transaction_id string, amount double, s int").withColumn(
        "timestamp", F.timestamp_seconds("s")).drop("s")
    stored = spark.createDataFrame([("b",)], "transaction_id string")
    assert [(r["transaction_id"], r["amount"], r["cosmos_sync_status"]) for r in new_history(rows, stored.limit(0)).orderBy("transaction_id").collect()] == [
        ("a", 2.0, "PENDING"), ("b", 3.0, "PENDING")]
    assert [r["transaction_id"] for r in new_history(rows, stored).collect()] == ["a"]
    assert {r[0]: r[1] for r in rejected_history(rows, stored).collect()} == {"a": 1, "b": 1}


def test_lists(spark):
    rows = spark.range(30).select("id")
    assert [r[0] for r in ranking.last_rows(rows, ["id"], 3).collect()] == [27, 28, 29]
    assert [r[0] for r in ranking.page(rows, ["id"], 1, 4).collect()] == [4, 5, 6, 7]
    assert ranking.first_rows(rows, ["id"], 0).count() == 30 and ranking.first_rows(rows, ["id"], 900).count() == 30


def test_review_context_marks_what_it_left_out(spark):
    scored = spark.range(40).select(
        F.col("id").cast("string").alias("transaction_id"), F.col("id").alias("n"), F.lit(1.5).alias("amount"), F.lit("A").alias("merchant_category"),
        F.lit("PIX").alias("payment_method"), F.lit(0.7).alias("fraud_score"), F.lit(True).alias("is_fraud"), F.lit("OPEN").alias("review_status"),
        F.lit("REVIEW").alias("recommended_action"), F.array(F.lit("r1"), F.lit("r2")).alias("anomaly_reasons"),
        F.lit("529.982.247-25").alias("holder_document"), F.lit("1234 5678 9012 3456").alias("card_number"))
    view = listing.public_view(scored).withColumn("n", F.col("transaction_id").cast("int"))
    assert "card_number" not in view.columns and view.first()["holder_document"] == "***.982*.47-25"
    lines = [r["line"] for r in listing.review_context(scored.drop("n").withColumn("timestamp", F.timestamp_seconds(F.col("transaction_id").cast("int"))), ["timestamp"], 20).orderBy("position").collect()]
    assert len(lines) == 16 and lines[-1].startswith("... (mais") and "motivos=[r1, r2]" in lines[0] and "529.982" not in "".join(lines)


def test_mask_pii_never_shows_raw_values(spark):
    raw = ("529.982.247-25", "maria@banco.com.br", "(11) 98765-4321", "Maria Souza", "1234 5678 9012 3456", 10.0, "Maria Souza", None)
    frame = spark.createDataFrame([raw], "cpf string, email string, phone string, nome string, card_number string, amount double, card_holder_name string, name string")
    got = privacy.mask_pii(frame, cover_scored=True).first()
    assert got["amount"] == 10.0 and got["name"] is None
    for value in (v for v in raw if isinstance(v, str)):
        assert value not in [c for c in got if isinstance(c, str)]
    assert privacy.mask_pii(frame).first()["card_holder_name"] == "Maria Souza"


def test_chi_square_tail_of_many_labels():
    from txlake.operators.drift import _chi2_tail

    assert _chi2_tail(1500.0, 2000) > 0.999 and _chi2_tail(2200.0, 2000) < 0.01
    assert abs(_chi2_tail(3.841458820694124, 1) - 0.05) < 1e-12 and abs(_chi2_tail(5.991464547107979, 2) - 0.05) < 1e-12
    assert _chi2_tail(0.0, 3) == 1.0 and _chi2_tail(5.0, 0) == 1.0


def test_accents_of_all_letters(spark):
    from txlake.functions.vocabulary import strip_accents

    row = spark.createDataFrame([("Őszi Škoda ćevap Việt — ά й Ação",)], "t string").select(strip_accents("t")).first()
    assert row[0] == "Oszi Skoda cevap Viet — α и Acao"


def test_drift_of_odd_columns(spark):
    from txlake.operators import drift

    one = spark.createDataFrame([(5.0, "a"), (5.0, None), (5.0, "null")], "x double, k string")
    other = spark.createDataFrame([(5.0, "a"), (7.0, None)], "x double, k string")
    assert {r["column"]: r["psi"] is not None for r in drift.psi(one, other, ["x"], ["k"]).collect()} == {"x": True, "k": True}
    assert {r["bin"]: (r["reference_rows"], r["current_rows"]) for r in drift.category_bins(one, other, "k").collect()} == {
        "a": (1, 1), None: (1, 1), "null": (1, 0)}
    assert drift.ks(one.limit(0), other, ["x"]).first()["p_value"] is None
    assert drift.psi(one.limit(0), other, ["x"], ["k"]).count() == 2
    assert drift.chi_square(one, other.limit(0), ["k"]).count() == 1


def test_buckets_and_means_of_odd_numbers(spark):
    from txlake.functions.ordering import magnitude_bucket
    from txlake.functions.values import exact_mean, number_or

    inf, nan = float("inf"), float("nan")
    values = [-inf, -3.0, -1e-300, 0.0, 1e-300, 2.0, 1e300, inf, nan]
    rows = spark.createDataFrame([(n, v) for n, v in enumerate(values)], "n int, v double")
    buckets = [r["b"] for r in rows.select("n", magnitude_bucket("v", 16).alias("b")).orderBy("n").collect()]
    assert buckets == sorted(buckets) and len(set(buckets)) == len(buckets)
    assert rows.filter("n = 8").select(number_or("v", 4.0)).first()[0] == 4.0
    means = rows.filter("n in (1, 5)").withColumn("big", F.lit(1e30)).agg(exact_mean("v"), exact_mean("big")).first()
    assert means[0] == -0.5 and abs(means[1] - 1e30) < 1e15
    assert rows.agg(exact_mean("v").alias("m")).selectExpr("isnan(m)").first()[0]


def test_decisions_stay_whole(spark):
    from txlake.operators import alerts

    table = spark.createDataFrame([("a", "OPEN")], "id string, status string")
    reviews = spark.createDataFrame([("a", "RESOLVED", "bob", 1), ("a", "FALSE_POSITIVE", "zoe", 2)], "id string, status string, reviewed_by string, decided_at int")
    got = alerts.review_alerts(table, reviews).first()
    assert (got["status"], got["reviewed_by"]) == ("FALSE_POSITIVE", "zoe")
    got = alerts.review_alerts(table, reviews.drop("decided_at")).first()
    assert (got["status"], got["reviewed_by"]) in {("RESOLVED", "bob"), ("FALSE_POSITIVE", "zoe")}


def test_merges_of_repeated_keys(spark):
    old = spark.createDataFrame([(1, 10, 0)], "k int, w int, at int")
    new = spark.createDataFrame([(1, 20, 1), (1, 15, 2), (2, 5, 1), (2, 6, 0)], "k int, w int, at int")
    for merged in (merge.replace_by_key(old, new, "k", ["at"]), merge.upsert_columns(old, new, "k", ["w"], order=["at"])):
        assert sorted((r["k"], r["w"]) for r in merged.collect()) == [(1, 15), (2, 5)]


def test_lookup_gives_all_rows_of_a_key(spark):
    from txlake.operators import listing

    assert listing.lookup(spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "k int, v string"), "k", 1).count() == 2


def test_last_of_key_limits_rows_before_the_shuffle(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), (None, 4), (None, 5)], "k string, w int")
    last = merge.last_of_key(rows, "k", ["w"])
    assert sorted((r["k"] or "", r["w"]) for r in last.collect()) == [("", 4), ("", 5), ("a", 2), ("b", 3)]
    assert "WindowGroupLimit" in last._jdf.queryExecution().executedPlan().toString()


def test_chi_square_tail_on_a_grid():
    """Against the finite sums of the tail: exp(-x/2) (x/2)^k / k! for even freedoms, from erfc on for odd ones."""
    for freedom in (1, 2, 3, 7, 12, 13, 14, 20, 51, 200, 501, 2000, 4999, 10_000):
        for place in (0.3, 0.8, 1.0, 1.05, 1.3, 2.5):
            x = freedom * place
            even = freedom % 2 == 0
            logs = [k * math.log(x / 2) - x / 2 - math.lgamma(k + 1) for k in (range(freedom // 2) if even else [n + 0.5 for n in range(freedom // 2)])]
            wanted = (0.0 if even else math.erfc(math.sqrt(x / 2))) + math.fsum(map(math.exp, logs))
            assert math.isclose(drift._chi2_tail(x, freedom), min(1.0, wanted), rel_tol=1e-9, abs_tol=1e-11), (freedom, place)


def test_codes_of_a_million_labels(spark, monkeypatch):
    """Codes are alphabetical places; no list of labels reaches the driver."""
    from pyspark.sql import DataFrame

    from txlake.operators.dictionary import dense_codes, with_code

    rows = spark.range(1_200_000).select(F.format_string("l%07d", F.col("id") * 7 % 1_000_000).alias("label"))

    def no_collect(*_):
        raise AssertionError("labels in the driver")

    for name in ("collect", "toPandas", "toLocalIterator", "toArrow", "take", "head", "first"):
        monkeypatch.setattr(DataFrame, name, no_collect)
    coded = with_code(rows.unionByName(spark.sql("select null label union all select 'unknown'")), "label", dense_codes(rows, "label"), "code")
    wrong = coded.where("code <> coalesce(try_cast(substr(label, 2) as int), -1)").count()
    assert (wrong, coded.count(), coded.where("code = -1").count(), coded.select("code").distinct().count()) == (0, 1_200_002, 2, 1_000_001)


def test_a_page_reads_its_part_only(spark, tmp_path):
    from txlake.operators.paging import OrderedTable

    rows = spark.range(50_000).select(F.when(F.col("id") >= 3, F.col("id") * 7919 % 50_021).alias("k"), F.col("id"))
    table = OrderedTable(spark, str(tmp_path / "ordered")).write(rows, ["k"], rows_per_part=1000)
    wanted = sorted((r.k for r in rows.collect()), key=lambda k: (k is not None, k))
    for number in (0, 1, 49, 1234, 2499, 2500, 10**6):
        page = table.page(number)
        assert [r.k for r in page.collect()] == wanted[number * 20:number * 20 + 20]
        filters = re.findall(r"PartitionFilters: \[(.*)\]", page._jdf.queryExecution().executedPlan().toString())
        parts = set(re.findall(r"page_part#\d+ = (\d+)", str(filters)))
        assert len(parts) <= 2 and (parts or not page.count()), "its folders are all that is read"
    assert [r.k for r in table.page(3, 5000).collect()] == wanted[15_000:20_000], "a page may span parts"
    assert OrderedTable(spark, str(tmp_path / "none")).write(rows.limit(0), ["k"]).page().collect() == []


def test_quality_scans_once(spark, small):
    from txlake.operators import quality

    path = f"{small}/lineitem.parquet"
    rows = spark.read.parquet(path).selectExpr(
        "concat(l_orderkey, '-', l_linenumber % 3) transaction_id", "l_extendedprice amount", "l_returnflag = 'R' is_fraud", "l_linestatus currency")
    rules = [quality.Rule("transaction_id", "unique", "error", {}), quality.Rule("amount", "range", "error", {"min": 0, "max": 20_000}),
             quality.Rule("amount", "mean_range", "error", {"min": 1, "max": 2}), quality.Rule("currency", "in_set", "error", {"values": ["O"]})]
    for frame in (quality.evaluate(rows, rules), quality.batch_counters(rows)):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert plan.count("FileScan") == 1
    together = {(r["rule"], r["column"]): (r["evaluated"], r["failed"]) for r in quality.evaluate(rows, rules).collect()}
    alone = {(r["rule"], r["column"]): (r["evaluated"], r["failed"]) for rule in rules for r in quality.evaluate(rows, [rule]).collect()}
    assert together == alone and len(together) == 4
    assert {r["failed"] for r in quality.evaluate(rows.limit(0), rules).collect()} == {0, 1}, "only the mean of nothing is out of range"
