"""Transaction tables derived from the given benchmark tables.

Each function returns a lazy frame; ``SQL`` holds the same definitions for the
oracle, to be used as common table expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spendscope.functions.calendar import parse_timestamp


# The schemas of the given tables, so that no read has to infer one.
SCHEMAS = {
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double,"
    " o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int,"
    " l_quantity double, l_extendedprice double, l_discount double, l_tax double,"
    " l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{folder}/{name}.parquet")


def _pick(number: Column, *names: str) -> Column:
    """``names[number mod len(names)]``."""
    return F.element_at(F.array(*map(F.lit, names)), (number % len(names)).cast("int") + 1)


def card_month(spark: SparkSession, folder: str) -> DataFrame:
    """T1: a month of clean transactions with times, from events and nation."""
    k = F.get_json_object("props", "$.k").cast("int")
    events = table(spark, folder, "events").withColumn("k", k)
    home = F.when(F.col("event_id") % 5 == 0, F.col("k") % 25).otherwise(
        (F.col("user_id") % 25).cast("int")
    )
    nation = table(spark, folder, "nation")
    country = F.lower("n_name")
    return (
        events.withColumn("nation_key", home)
        .join(nation, F.col("nation_key") == F.col("n_nationkey"))
        .select(
            F.col("event_id").cast("string").alias("transaction_id"),
            F.col("user_id").cast("string").alias("user_id"),
            F.concat(F.lit("M"), "k").alias("merchant_id"),
            F.concat(F.lit("merchant "), "k").alias("merchant_name"),
            F.col("event_type").alias("merchant_category"),
            F.col("value").alias("amount"),
            _pick(F.col("k"), "usd", "eur", "gbp").alias("currency"),
            country.alias("location_country"),
            F.concat(country, F.lit("_city_"), F.col("k") % 4).alias("location_city"),
            (F.col("event_id") % 3 != 0).alias("is_online"),
            _pick(F.col("event_id"), "mobile", "desktop", "tablet", "pos").alias("device_type"),
            F.when(F.col("event_type") == "error", "failed").otherwise("completed").alias("status"),
            F.col("ts").alias("timestamp"),
        )
    )


def dirty_month(spark: SparkSession, folder: str) -> DataFrame:
    """T1raw: the month with nulls, noise, bad timestamps and repeated ids in a second file."""
    clean = card_month(spark, folder).withColumn("id", F.col("transaction_id").cast("bigint"))
    i = F.col("id")
    files = F.when(i % 20 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    both = clean.withColumn("file_seq", F.explode(files))
    return both.select(
        "transaction_id",
        "user_id",
        "merchant_id",
        F.when(i % 50 == 0, None)
        .when(i % 11 == 0, F.concat(F.lit("  "), F.upper("merchant_name"), F.lit(" ")))
        .otherwise(F.col("merchant_name"))
        .alias("merchant_name"),
        "merchant_category",
        F.when(i % 37 == 0, None)
        .when(i % 211 == 0, F.col("amount") * 40)
        .otherwise(F.col("amount"))
        .alias("amount"),
        "currency",
        F.when(i % 53 == 0, None).otherwise(F.col("location_country")).alias("location_country"),
        "location_city",
        F.when(i % 41 == 0, None).otherwise(F.col("is_online")).alias("is_online"),
        "device_type",
        "status",
        F.when(i % 97 == 0, "not-a-date").otherwise(F.col("timestamp").cast("string")).alias("timestamp"),
        "file_seq",
    )


def order_years(spark: SparkSession, folder: str) -> DataFrame:
    """T2: years of history without a time of day, from orders, customer and nation."""
    return (
        table(spark, folder, "orders")
        .join(table(spark, folder, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(table(spark, folder, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .select(
            F.col("o_orderkey").cast("string").alias("transaction_id"),
            F.col("o_custkey").cast("string").alias("user_id"),
            F.col("c_mktsegment").alias("merchant_category"),
            F.col("o_totalprice").alias("amount"),
            F.col("n_name").alias("location_country"),
            F.col("o_orderstatus").alias("status"),
            F.col("o_orderpriority").alias("device_type"),
            F.col("o_orderdate").alias("timestamp"),
        )
    )


def merchant_lines(spark: SparkSession, folder: str) -> DataFrame:
    """T3: many merchants, large amounts and repeated ids, from lineitem and its dimensions."""
    return (
        table(spark, folder, "lineitem")
        .join(table(spark, folder, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(table(spark, folder, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
        .join(table(spark, folder, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        .join(table(spark, folder, "part"), F.col("l_partkey") == F.col("p_partkey"))
        .select(
            F.concat("l_orderkey", F.lit("-"), "l_linenumber").alias("transaction_id"),
            F.col("o_custkey").cast("string").alias("user_id"),
            F.col("l_suppkey").cast("string").alias("merchant_id"),
            F.col("s_name").alias("merchant_name"),
            F.col("p_type").alias("merchant_category"),
            (F.col("l_extendedprice") / 50).alias("amount"),
            F.col("n_name").alias("location_country"),
            (F.col("l_returnflag") != "N").alias("is_online"),
            F.col("o_orderpriority").alias("device_type"),
            F.col("o_orderstatus").alias("status"),
            F.col("l_shipdate").alias("timestamp"),
        )
    )


def merchant_reference(spark: SparkSession, folder: str) -> DataFrame:
    """Stand-in for the merchant reference file; joins :func:`merchant_lines`."""
    return (
        table(spark, folder, "supplier")
        .join(table(spark, folder, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        .select(
            F.col("s_suppkey").cast("string").alias("merchant_id"),
            F.col("n_name").alias("merchant_category_detailed"),
        )
    )


def parsed(raw: DataFrame) -> DataFrame:
    """The same rows with the timestamp text read as a timestamp."""
    return raw.withColumn("timestamp", parse_timestamp(F.col("timestamp")))


SQL = {
    "t1": """
select cast(e.event_id as varchar) as transaction_id, cast(e.user_id as varchar) as user_id,
       concat('M', cast(e.k as varchar)) as merchant_id,
       concat('merchant ', cast(e.k as varchar)) as merchant_name,
       e.event_type as merchant_category, e.value as amount,
       case e.k % 3 when 0 then 'usd' when 1 then 'eur' else 'gbp' end as currency,
       lower(n.n_name) as location_country,
       concat(lower(n.n_name), '_city_', cast(e.k % 4 as varchar)) as location_city,
       (e.event_id % 3 <> 0) as is_online,
       case e.event_id % 4 when 0 then 'mobile' when 1 then 'desktop' when 2 then 'tablet'
            else 'pos' end as device_type,
       case when e.event_type = 'error' then 'failed' else 'completed' end as status,
       e.ts as timestamp
from (select *, cast(json_extract_string(props, '$.k') as int) as k from events) e
join nation n
  on n.n_nationkey = case when e.event_id % 5 = 0 then e.k % 25 else cast(e.user_id % 25 as int) end
""",
    "t1raw": """
select transaction_id, user_id, merchant_id,
       case when id % 50 = 0 then null
            when id % 11 = 0 then concat('  ', upper(merchant_name), ' ')
            else merchant_name end as merchant_name,
       merchant_category,
       case when id % 37 = 0 then null when id % 211 = 0 then amount * 40 else amount end as amount,
       currency, case when id % 53 = 0 then null else location_country end as location_country,
       location_city, case when id % 41 = 0 then null else is_online end as is_online,
       device_type, status,
       case when id % 97 = 0 then 'not-a-date' else cast(timestamp as varchar) end as timestamp,
       seq as file_seq
from (select *, cast(transaction_id as bigint) as id, 1 as seq from t1
      union all
      select *, cast(transaction_id as bigint) as id, 2 as seq from t1
      where cast(transaction_id as bigint) % 20 = 0) u
""",
    "t2": """
select cast(o_orderkey as varchar) as transaction_id, cast(o_custkey as varchar) as user_id,
       c_mktsegment as merchant_category, o_totalprice as amount, n_name as location_country,
       o_orderstatus as status, o_orderpriority as device_type, o_orderdate as timestamp
from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey
""",
    "t3": """
select concat(cast(l_orderkey as varchar), '-', cast(l_linenumber as varchar)) as transaction_id,
       cast(o_custkey as varchar) as user_id, cast(l_suppkey as varchar) as merchant_id,
       s_name as merchant_name, p_type as merchant_category, l_extendedprice / 50 as amount,
       n_name as location_country, (l_returnflag <> 'N') as is_online,
       o_orderpriority as device_type, o_orderstatus as status, l_shipdate as timestamp
from lineitem join orders on l_orderkey = o_orderkey join supplier on l_suppkey = s_suppkey
join nation on s_nationkey = n_nationkey join part on l_partkey = p_partkey
""",
    "merchant_ref": """
select cast(s_suppkey as varchar) as merchant_id, n_name as merchant_category_detailed
from supplier join nation on s_nationkey = n_nationkey
""",
}
_NEEDS = {"t1raw": ("t1",)}


def with_views(names: str, body: str) -> str:
    """``body`` preceded by the views it names (space separated) as common table expressions."""
    ordered: list[str] = []
    for name in names.split():
        for each in (*_NEEDS.get(name, ()), name):
            if each not in ordered:
                ordered.append(each)
    views = ", ".join(f"{n} as ({SQL[n].strip()})" for n in ordered)
    body = body.strip()
    if body.lower().startswith("with "):
        return f"with {views}, {body[5:]}"
    return f"with {views} {body}"
