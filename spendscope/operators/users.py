"""Features per user and transactions enriched with them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendscope.functions import calendar as cal
from spendscope.functions.money import total
from spendscope.operators.aggregates import keyed
from spendscope.operators.features import most_frequent
from spendscope.operators.hotkeys import ROWS, attach_by_key
from spendscope.session import settle

# The numeric columns of user_features, in the order models use them.
FEATURE_COLUMNS = (
    "transaction_count", "avg_transaction_amount", "std_transaction_amount",
    "min_transaction_amount", "max_transaction_amount", "total_spend",
    "online_transaction_ratio", "weekend_transaction_ratio", "unique_merchants",
    "unique_categories", "unique_countries", "avg_transaction_hour",
    "std_transaction_hour", "avg_day_of_week", "avg_daily_transactions", "active_days",
)


def model_rows(rows: DataFrame) -> DataFrame:
    """Calendar numbers, weekend and online flags as 0/1 and the part of the day."""
    t = F.col("timestamp")
    out = rows.withColumns(
        {
            "hour": F.hour(t),
            "day_of_week": cal.day_of_week(t),
            "day_of_month": F.dayofmonth(t),
            "month": F.month(t),
            "year": F.year(t),
            "is_weekend": F.coalesce(cal.is_weekend(t), F.lit(False)).cast("int"),
            "time_of_day": cal.day_part(F.hour(t)),
        }
    )
    if "is_online" in rows.columns:
        out = out.withColumn("is_online", F.col("is_online").cast("int"))
    return out


def behaviour(rows: DataFrame) -> DataFrame:
    """Count, sum, mean, maximum and sample deviation (0 for one transaction) per user."""
    return (
        keyed(rows, "user_id")
        .groupBy("user_id")
        .agg(
            F.count("transaction_id").alias("transaction_count"),
            total(F.col("amount")).alias("total_amount"),
            F.avg("amount").alias("avg_amount"),
            F.max("amount").alias("max_amount"),
            F.coalesce(F.stddev_samp("amount"), F.lit(0.0)).alias("std_amount"),
        )
    )


def activity(rows: DataFrame) -> DataFrame:
    """Mean transactions per active day and number of active days per user."""
    per_day = (
        keyed(rows, "user_id")
        .where(F.col("timestamp").isNotNull())
        .groupBy("user_id", F.to_date("timestamp").alias("date"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return per_day.groupBy("user_id").agg(
        F.avg("n").alias("avg_daily_transactions"), F.count(F.lit(1)).alias("active_days")
    )


_PARTS = {"merchant_id": "unique_merchants", "merchant_category": "unique_categories", "location_country": "unique_countries"}
_BASIS = ("amount", "hour", "is_online", "is_weekend", "day_of_week")

# A user whose hash bucket holds more than 1/HOT_SHARE of the rows, or so many rows, is put together from partial sums.
HOT_SHARE = 4_000
HOT_ROWS = 1_000_000
BUCKETS = 1 << 16


def user_features(rows: DataFrame, null_std: str = "zero", hot_share: int = HOT_SHARE) -> DataFrame:
    """Feature vector per user from :func:`model_rows`.

    One scan: the columns needed are settled. Rows then move once, to their user, where all figures are made. Users
    of many rows are found by counts per hash bucket, and theirs are spread by :func:`_from_cells` instead.
    ``null_std='median'`` leaves the deviation of single-transaction users null
    for a later median fill instead of setting it to 0.
    """
    narrow = settle(
        keyed(rows, "user_id").select(
            "user_id",
            F.col("transaction_id").isNotNull().alias("has_id"),
            F.to_date("timestamp").alias("day"),
            "device_type",
            *_PARTS,
            *[F.col(c).cast("double").alias(c) for c in _BASIS],
        ),
        "user-rows",
    )
    bucket = F.pmod(F.xxhash64("user_id"), F.lit(BUCKETS))
    counted = settle(narrow.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n")), "user-buckets")
    limit = F.least(counted.agg(F.sum("n")).scalar() / hot_share, F.lit(HOT_ROWS))
    hot = counted.where(F.col("n") > limit).select("bucket")
    if hot.isEmpty():
        found = _from_rows(narrow)
    else:
        placed, hot = narrow.withColumn("bucket", bucket), F.broadcast(hot)
        few, many = (placed.join(hot, "bucket", kind) for kind in ("left_anti", "left_semi"))
        found = _from_rows(few).unionByName(_from_cells(many))
    kept = {"std_transaction_amount"} if null_std == "median" else set()
    filled = [c for c in FEATURE_COLUMNS if c not in kept]
    return found.fillna(0, filled).select("user_id", "preferred_device", *FEATURE_COLUMNS)


def _from_rows(narrow: DataFrame) -> DataFrame:
    """The figures of users whose rows one task can hold: the rows meet once and are not copied."""
    days = F.size(F.collect_set("day"))
    return narrow.repartition("user_id").groupBy("user_id").agg(
        F.count_if("has_id").alias("transaction_count"),
        F.avg("amount").alias("avg_transaction_amount"),
        F.stddev_samp("amount").alias("std_transaction_amount"),
        F.min("amount").alias("min_transaction_amount"),
        F.max("amount").alias("max_transaction_amount"),
        F.coalesce(F.sum("amount"), F.lit(0.0)).alias("total_spend"),
        F.avg("is_online").alias("online_transaction_ratio"),
        F.avg("is_weekend").alias("weekend_transaction_ratio"),
        *[F.size(F.collect_set(c)).cast("long").alias(name) for c, name in _PARTS.items()],
        F.avg("hour").alias("avg_transaction_hour"),
        F.stddev_samp("hour").alias("std_transaction_hour"),
        F.avg("day_of_week").alias("avg_day_of_week"),
        F.mode("device_type", True).alias("preferred_device"),
        F.try_divide(F.count("day"), days).alias("avg_daily_transactions"),
        F.nullif(days.cast("long"), F.lit(0).cast("long")).alias("active_days"),
    )


def _from_cells(narrow: DataFrame) -> DataFrame:
    """The figures of users of any number of rows.

    The rows are counted per user and day, with moments that add up, and per user and value of
    each column whose distinct values, most frequent value or active days are wanted. Both are one
    aggregate over narrow lines, combined before its shuffle; a second one by user finishes.
    """
    none = F.lit(None)

    def line(kind: str, value, *figures):
        names = ("id", "amount", "hour", "online", "weekend", "weekday")
        found = [x.cast("double").alias(n) for n, x in zip(names, figures or [none] * len(names))]
        return F.struct(F.lit(kind).alias("kind"), value.cast("string").alias("value"), *found)

    whole = line("day", F.col("day"), F.when(F.col("has_id"), 1), *[F.col(c) for c in _BASIS])
    lines = [whole, line("device_type", F.col("device_type")), *[line(c, F.col(c)) for c in _PARTS]]
    long = narrow.select("user_id", F.explode(F.array(*lines)).alias("l")).select("user_id", "l.*")

    def moments(c: str) -> list:
        return [F.count(c).alias(f"{c}_n"), F.avg(c).alias(f"{c}_mean"), (F.var_pop(c) * F.count(c)).alias(f"{c}_m2")]

    added = [F.count(c).alias(f"{c}_n") for c in ("online", "weekend", "weekday")]
    added += [F.sum(c).alias(f"{c}_sum") for c in ("online", "weekend", "weekday", "amount")]
    cells = long.groupBy("user_id", "kind", "value").agg(
        F.count(F.lit(1)).alias("n"), F.count("id").alias("ids"), F.min("amount").alias("low"), F.max("amount").alias("high"),
        *moments("amount"), *moments("hour"), *added,
    )

    def mean_of(c: str):
        return F.try_divide(F.sum(f"{c}_sum"), F.sum(f"{c}_n"))

    def merged(c: str) -> tuple:
        """Mean and sample deviation from those of the days: what is within them and what lies between their means."""
        n, mean, m2 = (lambda d, x=x: F.coalesce(d[f"{c}_{x}"].cast("double"), F.lit(0.0)) for x in ("n", "mean", "m2"))

        def added_up(each):
            return F.aggregate("days", F.lit(0.0), lambda so_far, d: so_far + each(d))

        count = added_up(n)
        middle = F.try_divide(added_up(lambda d: n(d) * mean(d)), count)
        squares = added_up(lambda d: m2(d) + n(d) * (mean(d) - middle) * (mean(d) - middle))
        return middle, F.when(count > 1, F.sqrt(squares / (count - 1)))

    given = F.col("value").isNotNull()
    on_day = F.col("kind") == "day"
    days = on_day & given
    devices = (F.col("kind") == "device_type") & given
    main = cells.groupBy("user_id").agg(
        F.coalesce(F.sum("ids"), F.lit(0)).alias("transaction_count"),
        F.try_divide(F.sum("amount_sum"), F.sum("amount_n")).alias("avg_transaction_amount"),
        # As many as the user has active days, and one for rows without a date.
        F.collect_list(F.when(on_day, F.struct(*[f"{c}_{x}" for c in ("amount", "hour") for x in ("n", "mean", "m2")]))).alias("days"),
        F.min("low").alias("min_transaction_amount"),
        F.max("high").alias("max_transaction_amount"),
        F.coalesce(F.sum("amount_sum"), F.lit(0.0)).alias("total_spend"),
        mean_of("online").alias("online_transaction_ratio"),
        mean_of("weekend").alias("weekend_transaction_ratio"),
        *[F.count_if((F.col("kind") == c) & given).alias(name) for c, name in _PARTS.items()],
        mean_of("weekday").alias("avg_day_of_week"),
        F.min(F.when(devices, F.struct((-F.col("n")).alias("n"), "value"))).alias("device"),
        F.avg(F.when(days, F.col("n"))).alias("avg_daily_transactions"),
        F.nullif(F.count_if(days), F.lit(0)).alias("active_days"),
    )
    named = main.withColumns({
        "preferred_device": F.col("device.value"),
        "std_transaction_amount": merged("amount")[1],
        "avg_transaction_hour": merged("hour")[0],
        "std_transaction_hour": merged("hour")[1],
    })
    return named.drop("days", "device")


def enrich_with_user_stats(rows: DataFrame, training: DataFrame | None = None) -> DataFrame:
    """Transaction count and mean amount of the user on every transaction.

    The statistics come from ``training`` when given, which keeps the amounts to
    be predicted out of the features; else from all rows.
    """
    stats = (
        keyed(rows if training is None else training, "user_id")
        .groupBy("user_id")
        .agg(
            F.count("transaction_id").alias("user_transaction_count"),
            F.avg("amount").alias("user_avg_amount"),
            *([F.count(F.lit(1)).alias(ROWS)] if training is None else []),
        )
    )
    return attach_by_key(rows, stats, "user_id")


def enrich_with_cluster(rows: DataFrame, clustered_users: DataFrame) -> DataFrame:
    """Cluster of the user on every transaction, -1 for users without one."""
    labels = clustered_users.select("user_id", "cluster")
    labelled = attach_by_key(rows, labels, "user_id")
    return labelled.withColumn("cluster", F.coalesce("cluster", F.lit(-1)))
