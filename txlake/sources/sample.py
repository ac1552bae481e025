"""Canonical views over the sample tables (a star schema and an event table)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from txlake.functions.identity import cpf_from_base, format_cpf

# Part type to merchant category, one of them in its accented form.
_CATEGORY_OF_TYPE = {
    "ECONOMY": "Eletrônicos", "SMALL": "Alimentacao", "MEDIUM": "Vestuario", "PROMO": "Servicos",
    "STANDARD": "Viagem",
}
_COUNTRIES = ["BR", "US", "GB", "FR"]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _country(nation: str) -> Column:
    return F.element_at(F.array(*[F.lit(c) for c in _COUNTRIES]), (F.col(nation) % 4 + 1).cast("int"))


def transactions(spark: SparkSession, folder: str) -> DataFrame:
    """Landed transactions with dirt: null and negative amounts, null categories, repeated ids."""
    line, order = table(spark, folder, "lineitem"), table(spark, folder, "orders")
    customer, supplier = table(spark, folder, "customer"), table(spark, folder, "supplier")
    part = table(spark, folder, "part")
    # Only the columns that the view reads, and every row of the line items shuffled twice at most: customers
    # meet the fewer orders first.
    lines = line.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_linestatus", "l_returnflag", "l_quantity")
    sold = lines.join(part.select("p_partkey", "p_type"), line.l_partkey == part.p_partkey).drop("p_partkey", "l_partkey").join(
        supplier.select("s_suppkey", "s_nationkey"), line.l_suppkey == supplier.s_suppkey).drop("s_suppkey")
    bought = order.select("o_orderkey", "o_custkey", "o_orderdate").join(
        customer.select("c_custkey", "c_nationkey"), order.o_custkey == customer.c_custkey).drop("c_custkey")
    joined = sold.join(bought, line.l_orderkey == order.o_orderkey)
    key = F.col("l_orderkey")
    category = F.lit("Entretenimento")
    for kind, label in _CATEGORY_OF_TYPE.items():
        category = F.when(F.col("p_type") == kind, label).otherwise(category)
    return joined.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("transaction_id"),
        F.concat(F.lit("user_"), "o_custkey").alias("user_id"),
        F.when(key % 97 == 0, None).when(key % 101 == 0, -F.col("l_extendedprice"))
        .otherwise(F.col("l_extendedprice")).alias("amount"),
        F.when(key % 7 == 0, "USD").otherwise("BRL").alias("currency"),
        F.concat(F.lit("merchant_"), "l_suppkey").alias("merchant_id"),
        F.when(key % 89 == 0, None).otherwise(category).alias("merchant_category"),
        (F.col("o_orderdate") + F.make_dt_interval(hours=(key % 24).cast("int"))).alias("timestamp"),
        _country("c_nationkey").alias("user_country"),
        _country("s_nationkey").alias("merchant_country"),
        F.when(F.col("l_linestatus") == "O", "DEBIT_CARD").otherwise("CREDIT_CARD").alias("payment_method"),
        (F.col("l_returnflag") == "R").alias("is_fraud"),
        F.col("l_quantity").alias("processing_time_ms"),
    )


def landing(spark: SparkSession, folder: str) -> DataFrame:
    """The transactions as they land: time as ISO text."""
    return transactions(spark, folder).withColumn(
        "timestamp", F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss"))


def event_transactions(spark: SparkSession, folder: str) -> DataFrame:
    """Transactions of the event table."""
    return table(spark, folder, "events").select(
        F.concat(F.lit("evt-"), "event_id").alias("transaction_id"),
        F.concat(F.lit("user_"), "user_id").alias("user_id"),
        F.col("value").alias("amount"),
        F.concat(F.lit("merchant_"), F.get_json_object("props", "$.k")).alias("merchant_id"),
        F.col("event_type").alias("merchant_category"),
        F.col("ts").alias("timestamp"),
    )


def people(spark: SparkSession, folder: str) -> DataFrame:
    """Customers with personal data in many spellings, some malformed."""
    key, nation = F.col("c_custkey"), F.col("c_nationkey")
    base = F.lpad(key.cast("string"), 9, "0")
    digits = cpf_from_base(base)
    text = key.cast("string")
    tail = F.lpad((key * 7919 % 100_000_000).cast("string"), 8, "0")
    return table(spark, folder, "customer").select(
        F.concat(F.lit("user_"), text).alias("user_id"),
        F.col("c_mktsegment").alias("segment"),
        base.alias("cpf_base"),
        F.when(nation % 5 == 0, digits).when(nation % 5 == 1, base).otherwise(format_cpf(digits)).alias("cpf"),
        F.when(nation % 6 == 0, F.lower("c_mktsegment"))
        .when(nation % 6 == 1, F.concat(F.lit("u@host"), text))
        .otherwise(F.concat(F.lower("c_mktsegment"), F.lit("."), text, F.lit("@banco"), nation.cast("string"),
                            F.lit(".com.br"))).alias("email"),
        F.when(nation % 4 == 0, F.concat(F.lit("(11) 9"), F.left(tail, F.lit(4)), F.lit("-"), F.right(tail, F.lit(4))))
        .when(nation % 4 == 1, F.concat(F.lit("11 "), tail))
        .when(nation % 4 == 2, F.concat(F.lit("+55 11 9"), tail))
        .otherwise(tail).alias("phone"),
        F.when(nation % 3 == 0, F.replace("c_name", F.lit("#"), F.lit(" ")))
        .when(nation % 3 == 1, F.concat(F.lit("Ana "), F.initcap("c_mktsegment"), F.lit(" S")))
        .otherwise(F.lit("  ")).alias("name"),
        F.when(nation % 3 == 0, F.concat(F.lit("4"), F.lpad(text, 15, "0")))
        .when(nation % 3 == 1, F.concat_ws(" ", F.lit("5000"), F.left(tail, F.lit(4)), F.right(tail, F.lit(4)), F.lit("1234")))
        .otherwise(F.lit("123")).alias("card_number"),
    )
