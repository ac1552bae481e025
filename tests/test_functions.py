"""Golden values of the column functions."""

import hashlib

import pytest
from pyspark.sql import functions as F

from txlake.functions import masking
from txlake.functions.calendar import hour_from_iso, weekend_flag_from_iso
from txlake.functions.identity import cpf_from_base, cpf_is_valid, not_one_digit, with_identity
from txlake.functions.risk import (
    enterprise_reason, enterprise_score, heuristic_score, policy_columns, seed_severity, severity,
)
from txlake.functions.values import exact_mean, round_half_even, round_half_up
from txlake.functions.vocabulary import (
    crosses_border, crosses_border_raw, crosses_border_strict, feature_label, payment_name, plain_category,
    profile_owner, strip_accents, training_category,
)


def apply(spark, values, function, kind="string"):
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r["r"] for r in frame.select("i", function("v").alias("r")).orderBy("i").collect()]


@pytest.mark.parametrize("mask,cases", [
    (masking.mask_cpf, {"123.456.789-00": "***.456*.89-00", "12345678900": "***.456*.89-00", "123": "123", "": ""}),
    (masking.mask_email, {
        "joao.silva@banco.com.br": "j*********@b***.com.br", "a@x": "*@x***", "@x.com": "*@x***.com",
        "none": "none", "a@": "*@***", "ab@.com": "a*@***.com", "a@b@c.d": "*@b***.d"}),
    (masking.mask_phone, {
        "(11) 98765-4321": "(11) 9****-4321", "1187654321": "(11) ****-4321", "+55 11 98765-4321": "(55) ****-4321",
        "12345": "12345"}),
    (masking.mask_name, {"Joao Silva Santos": "J*** S**** S*****", "João Silva": "J*** S****", " A  b ": "* *", "": ""}),
    (masking.mask_card, {
        "1234 5678 9012 3456": "**** **** **** 3456", "1234567890123456": "************3456", "123": "123",
        "12 345": "*234 5"}),
    (masking.card_last4, {"1234 5678 9012 3456": "**** 3456", "12": "****"}),
    (masking.pseudonym, {"user_1001": "1bbcfabaedab00a3", "": ""}),
    (cpf_from_base, {"123456789": "12345678909", "000000001": "00000000191", "529982247": "52998224725",
                     "111444777": "11144477735"}),
    (plain_category, {"Eletrônicos": "Eletronicos", "Serviços": "Servicos", " ": "Outros", None: "Outros", "X": "X"}),
    (training_category, {"0": "Outros", " Vestuário ": "Vestuario", None: "Outros"}),
    (payment_name, {" pix ": "CREDIT_CARD", "debit_card": "DEBIT_CARD", "": "CREDIT_CARD", None: "CREDIT_CARD"}),
    (strip_accents, {"Alimentação": "Alimentacao", "é": "e", "Çñ": "Cn"}),
    (feature_label, {"hour": "Hora do dia (hour)", "new_thing": "New Thing (new_thing)"}),
])
def test_text_functions(spark, mask, cases):
    assert apply(spark, list(cases), mask) == list(cases.values())


def test_salted_pseudonym(spark):
    assert apply(spark, ["user_1001"], lambda c: masking.pseudonym(c, "salt")) == ["3e4c8b26ff07d63e"]


def test_holder_text(spark):
    rows = spark.createDataFrame([("Ana Lima", "12345678909"), (" ", "12345678909"), (None, "1234"), (None, None)], "n string, d string")
    assert [r[0] for r in rows.select(masking.holder_text("n", "d")).collect()] == ["A** L***", "***8909", "-", "-"]
    assert rows.select(masking.holder_text("n", "d", hide_name=False)).first()[0] == "Ana Lima"


def test_cpf_validity_and_stand_ins(spark):
    assert apply(spark, ["529.982.247-25", "529.982.247-24", "1", None], cpf_is_valid) == [True, False, False, False]
    rows = spark.range(200).select(F.col("id").cast("string").alias("transaction_id"), F.lit(" ").alias("card_number"))
    filled = rows.select(*[c.alias(n) for n, c in with_identity(rows.columns).items()])
    assert filled.filter(~cpf_is_valid("holder_document")).isEmpty()
    assert filled.filter(~F.col("card_number").rlike(r"^[245]\d{3}( \d{4}){3}$")).isEmpty()
    assert filled.filter(~F.col("holder_document").rlike(r"^\d{3}\.\d{3}\.\d{3}-\d{2}$")).isEmpty()


def test_stand_ins_keep_their_values_without_patterns(spark):
    """Values as the document's general functions give them; patterns per row cost more than the rest of a score."""
    rows = spark.range(300).select(F.when(F.col("id") != 7, F.col("id").cast("string")).alias("transaction_id"))
    filled = rows.select("transaction_id", *[c.alias(n) for n, c in with_identity(rows.columns).items()])
    assert "regexp" not in filled._jdf.queryExecution().optimizedPlan().toString().lower()
    for row in filled.collect():
        def number(salt):
            text = "|".join([*([row.transaction_id] if row.transaction_id is not None else []), salt])
            return int(hashlib.md5(text.encode()).hexdigest()[:13], 16)

        base = f"{number('document') % 10**9:09d}"
        first = sum(int(d) * (10 - i) for i, d in enumerate(base)) * 10 % 11 % 10
        second = (sum(int(d) * (11 - i) for i, d in enumerate(base)) + 2 * first) * 10 % 11 % 10
        assert row.holder_document == f"{base[:3]}.{base[3:6]}.{base[6:]}-{first}{second}"
        card = ["4", "5", "2"][number("prefix") % 3] + f"{number('card') % 10**15:015d}"
        assert row.card_number == " ".join(card[i:i + 4] for i in range(0, 16, 4))


def test_repeated_digits_are_moved_on(spark):
    values = [111_111_111 * n for n in range(10)] + [1, 123_456_789, 111_111_112]
    assert apply(spark, values, lambda c: not_one_digit(F.col(c)), "long") == [v + 12 if v % 111_111_111 == 0 and v < 999_999_999 else 11 if v == 999_999_999 else v for v in values]


def test_time_text(spark):
    texts = ["2025-03-29T22:15:00", "2025-03-29T00:15:00Z", "2025-03-29", "rubbish", "", None, "2025-03-31T07"]
    assert apply(spark, texts, hour_from_iso) == [22, 0, 12, 12, 12, 12, 7]
    assert apply(spark, texts, weekend_flag_from_iso) == [1, 1, 1, 0, 0, 0, 0]


def test_borders(spark):
    rows = spark.createDataFrame([("BR", "US"), ("BR", None), (None, "US"), (None, None), ("US", None)], "u string, m string")
    got = rows.select(crosses_border("u", "m"), crosses_border_raw("u", "m"), crosses_border_strict("u", "m").cast("int")).collect()
    assert [tuple(r) for r in got] == [(1, 1, 1), (0, 1, 1), (1, 1, 0), (0, 0, 0), (1, 1, 1)]


def test_profile_owner(spark):
    rows = spark.createDataFrame([(" p ", "u"), (" ", "u"), (None, " ")], "p string, u string")
    assert [r[0] for r in rows.select(profile_owner("p", "u")).collect()] == ["p", "u", "anonymous"]


def test_rounding(spark):
    values = [2.675, 0.125, 1.005, 1.5, -0.001, 0.375]
    assert apply(spark, values, lambda c: round_half_even(c, 2), "double") == [round(v, 2) + 0.0 for v in values]
    assert apply(spark, [0.59996, 0.125], lambda c: round_half_up(c, 2), "double") == [0.6, 0.13]
    assert spark.range(10).agg(exact_mean(F.lit(0.1))).first()[0] == 0.1, "a plain sum of doubles falls short"


SCORES = [
    (150.0, 14, 0, 0, "PIX", "Alimentacao", 0.45, "MEDIUM", "APPROVE"),
    (45000.0, 3, 1, 1, "CREDIT_CARD", "Eletronicos", 0.82, "CRITICAL", "BLOCK"),
    (3000.0, 22, 0, 1, "DEBIT_CARD", "Viagem", 0.47, "MEDIUM", "APPROVE"),
    (50000.0, 3, 1, 1, "CREDIT_CARD", "Viagem", 0.76, "CRITICAL", "BLOCK"),
    (40000.0, 12, 1, 1, "CREDIT_CARD", "Viagem", 0.74, "HIGH", "REVIEW"),
    (9000.0, 14, 0, 1, "CREDIT_CARD", "Viagem", 0.63, "HIGH", "REVIEW"),
    (9000.0, 14, 0, 1, "CREDIT_CARD", "Eletronicos", 0.69, "HIGH", "REVIEW"),
    (10.0, 14, 0, 0, "CREDIT_CARD", "Viagem", 0.3345, "MEDIUM", "APPROVE"),
    (10.0, 14, 0, 0, "DEBIT_CARD", "Viagem", 0.2545, "LOW", "APPROVE"),
]


def test_heuristic_scores(spark):
    rows = spark.createDataFrame([r[:6] for r in SCORES], "amount double, hour int, w int, i int, p string, c string")
    scored = rows.withColumn("s", heuristic_score("amount", "hour", "w", "i", payment_name("p"), "c"))
    got = scored.select(*[c.alias(n) for n, c in policy_columns("s").items()]).collect()
    assert [(r["fraud_score"], r["risk_level"], r["recommended_action"]) for r in got] == [r[6:] for r in SCORES]


def test_score_stays_in_range_and_bands_partition(spark):
    rows = spark.createDataFrame(
        [(None, None, None, None, None, None), (-5.0, 3, 1, 1, "X", ""), (1e12, 23, 1, 1, "credit_card", "Eletrônicos")],
        "amount double, hour int, w int, i int, p string, c string")
    scored = rows.withColumn("s", heuristic_score("amount", "hour", "w", "i", "p", "c", F.lit(0.22)))
    assert scored.filter("s is null or s < 0 or s > 1").isEmpty()
    cuts = spark.createDataFrame([(0.29999,), (0.3,), (0.59996,), (0.6,), (0.75,), (0.7500001,)], "s double")
    got = cuts.select(*[c.alias(n) for n, c in policy_columns("s").items()]).collect()
    assert [r["risk_level"] for r in got] == ["LOW", "MEDIUM", "MEDIUM", "HIGH", "HIGH", "CRITICAL"]
    # cut on the unrounded score, shown rounded
    assert (got[2]["fraud_score"], got[2]["is_fraud"]) == (0.6, False)


def test_severities(spark):
    values = [0.97, 0.85, 0.75, 0.5, 0.2]
    assert apply(spark, values, severity, "double") == ["CRITICAL", "HIGH", "MEDIUM", "LOW", "LOW"]
    assert apply(spark, values, seed_severity, "double") == ["CRITICAL", "HIGH", "HIGH", "MEDIUM", "LOW"]


def test_enterprise_rules(spark):
    rows = spark.createDataFrame([(20000.0, "BR", "US", 3), (20000.0, "BR", "BR", 12), (1.0, None, "US", 6)],
                                 "a double, u string, m string, h int")
    score = enterprise_score("a", "u", "m", "h")
    got = rows.select(F.round(score, 4), enterprise_reason("a", "u", "m", "h", score)).collect()
    assert [r[0] for r in got] == [0.65, 0.3, 0.0]
    assert got[0][1] == "Valor alto; Transação internacional suspeita; Horário incomum; Score: 0.65"
    assert rows.select(enterprise_score("a", "u", "m", "h", 0.9)).first()[0] == 1.0
