"""Models and file listings in a form that SQL can check: given labels, closed forms and facts that must hold.

The operators and the tables are those of the other modules.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from spendscope.operators import clustering as cl
from spendscope.operators import forest, kmeans, lookups, profiling, regression, risk, users
from spendscope.operators.users import FEATURE_COLUMNS
from spendscope.plans.registry import named
from spendscope.plans.risk_queries import SCORED_SQL
from spendscope.plans.shape import shaped
from spendscope.session import fresh_path, settle
from spendscope.sources import files
from spendscope.sources.fixtures import card_month, dirty_month, merchant_lines, merchant_reference, with_views
from spendscope.sources.schemas import TRANSACTION_COLUMNS

USERS_SQL = """
act as (select user_id, avg(n) as avg_daily_transactions, cast(count(*) as double) as active_days
  from (select user_id, cast(timestamp as date) as date, count(*) as n from t1 group by 1, 2) group by 1),
feat as (select user_id, cast(count(transaction_id) as double) as transaction_count,
  avg(amount) as avg_transaction_amount, coalesce(stddev_samp(amount), 0) as std_transaction_amount,
  min(amount) as min_transaction_amount, max(amount) as max_transaction_amount, sum(amount) as total_spend,
  avg(cast(is_online as int)) as online_transaction_ratio,
  avg(case when isodow(timestamp) >= 6 then 1 else 0 end) as weekend_transaction_ratio,
  cast(count(distinct merchant_id) as double) as unique_merchants,
  cast(count(distinct merchant_category) as double) as unique_categories,
  cast(count(distinct location_country) as double) as unique_countries, avg(hour(timestamp)) as avg_transaction_hour,
  coalesce(stddev_samp(hour(timestamp)), 0) as std_transaction_hour, avg(isodow(timestamp) - 1) as avg_day_of_week
  from t1 where user_id is not null group by user_id),
labelled as (select feat.*, avg_daily_transactions, active_days, cast(user_id as int) % 4 as cluster
  from feat left join act using (user_id))
"""


def _labelled(spark, folder):
    """User features with a label that follows from the id."""
    table = users.user_features(users.model_rows(card_month(spark, folder)))
    return settle(table.withColumn("cluster", F.col("user_id").cast("int") % 4), "labelled")


_PROFILE_SQL = f"""
{USERS_SQL.strip()},
prof as (select cluster, cast(count(*) as bigint) as size, {', '.join(f'avg({c}) as {c}' for c in FEATURE_COLUMNS)}
  from labelled group by cluster),
tagged as (select cluster, size, {', '.join(f'round({c}, 6) + 0.0 as {c}' for c in FEATURE_COLUMNS)},
  round(size * 100.0 / (select count(*) from labelled), 6) as size_pct,
  avg_transaction_amount > (select avg(avg_transaction_amount) from labelled) as is_high_value,
  transaction_count > (select avg(transaction_count) from labelled) as is_frequent,
  case when online_transaction_ratio > 0.7 then 'online' when online_transaction_ratio < 0.3 then 'in-store'
    else 'mixed' end as channel from prof)
"""


@named("cluster_profile_given", with_views("t1", f"with {_PROFILE_SQL} select * from tagged"))
def cluster_profile_given(spark, folder):
    return shaped(cl.profile(_labelled(spark, folder)))


@named(
    "cluster_profile_normalized_given",
    with_views(
        "t1",
        f"with {_PROFILE_SQL} select cluster, "
        + ", ".join(f"round(({c} - min({c}) over ()) / nullif(max({c}) over () - min({c}) over (), 0), 6) + 0.0 as {c}" for c in FEATURE_COLUMNS)
        + " from prof",
    ),
)
def cluster_profile_normalized_given(spark, folder):
    return shaped(cl.normalised_profile(cl.profile(_labelled(spark, folder))))


@named(
    "cluster_distribution_given",
    with_views(
        "t1",
        f"""with {USERS_SQL} select cluster, feature, round(min(v), 6) as min_value, round(quantile_cont(v, 0.25), 6) as q1,
        round(quantile_cont(v, 0.5), 6) as median_value, round(quantile_cont(v, 0.75), 6) as q3, round(max(v), 6) as max_value
        from (unpivot (select cluster, {', '.join(FEATURE_COLUMNS[:5])} from labelled) on {', '.join(FEATURE_COLUMNS[:5])}
              into name feature value v) group by cluster, feature""",
    ),
)
def cluster_distribution_given(spark, folder):
    return shaped(cl.distributions(_labelled(spark, folder)))


_PAYLOAD = {
    "cluster_id": "cluster", "size": "size", "percentage": "size_pct", "avg_transactions": "transaction_count",
    "avg_amount": "avg_transaction_amount", "total_spend": "total_spend", "online_ratio": "online_transaction_ratio",
}


@named(
    "insight_cluster_payload_given",
    with_views("t1", f"with {_PROFILE_SQL} select cluster, {', '.join(_PAYLOAD.values())} from tagged".replace("select cluster, cluster,", "select cluster,")),
)
def insight_cluster_payload_given(spark, folder):
    """The texts read back: the numbers must be those of the profile."""
    texts = cl.payload(shaped(cl.profile(_labelled(spark, folder))))
    kinds = ", ".join(f"{k} {'bigint' if k in ('cluster_id', 'size') else 'double'}" for k in _PAYLOAD)
    read = texts.select(F.from_json("payload", kinds).alias("p"))
    return read.select(F.col("p.cluster_id").cast("int").alias("cluster"), *[F.col(f"p.{k}").alias(c) for k, c in _PAYLOAD.items() if c != "cluster"])


@named(
    "enrich_cluster_given",
    with_views(
        "t1",
        """select transaction_id, user_id, case when cast(user_id as int) % 7 <> 0 then cast(user_id as int) % 4 else -1 end as cluster
           from t1""",
    ),
)
def enrich_cluster_given(spark, folder):
    """Some users have no label and get -1."""
    labels = _labelled(spark, folder).where(F.col("user_id").cast("int") % 7 != 0)
    return users.enrich_with_cluster(card_month(spark, folder), labels).select("transaction_id", "user_id", "cluster")


_FLAGGED_SQL = f"""{SCORED_SQL.strip()}, flagged as (select * replace (
  risk_score + case when cast(transaction_id as bigint) % 100 = 0 then 2 else 0 end as risk_score) from scored)"""


def _flagged(spark, folder):
    rows = card_month(spark, folder)
    return rows.withColumn("is_ml_anomaly", (F.col("transaction_id").cast("bigint") % 100 == 0).cast("int"))


@named("risk_score_given_flags", with_views("t1", f"with {_FLAGGED_SQL} select transaction_id, cast(risk_score as int) as risk_score from flagged"))
def risk_score_given_flags(spark, folder):
    return risk.add_risk_score(_flagged(spark, folder)).select("transaction_id", "risk_score")


@named(
    "risk_distribution_given_flags",
    with_views("t1", f"with {_FLAGGED_SQL} select cast(risk_score as int) as risk_score, cast(count(*) as bigint) as row_count from flagged group by 1"),
)
def risk_distribution_given_flags(spark, folder):
    return risk.risk_distribution(risk.risk_cells(_flagged(spark, folder)))


@named(
    "suspicious_report_given_flags",
    with_views(
        "t1",
        f"""with {_FLAGGED_SQL} select transaction_id, user_id, timestamp, round(amount, 4) as amount, cast(risk_score as int) as risk_score,
        round(z, 6) as amount_zscore, case when cast(transaction_id as bigint) % 100 = 0 then 1 else 0 end as is_ml_anomaly,
        merchant_id, merchant_category, location_country, location_city
        from flagged where risk_score >= 4 order by flagged.risk_score desc, z desc, transaction_id limit 1000""",
    ),
)
def suspicious_report_given_flags(spark, folder):
    return shaped(risk.suspicious_report(_flagged(spark, folder)), amount=4)


_LINE_SQL = """
p as (select transaction_id, cast('0x' || substr(md5(transaction_id), 1, 13) as bigint) % 100 < 20 as is_test, amount as target,
  cast(hour(timestamp) as double) as x from t1 where amount is not null),
m as (select avg(x) as mx, stddev_pop(x) as sx, avg(target) as my, cast(count(*) as double) as n from p where not is_test),
b as (select sum((x - mx) / sx * (target - my)) / (max(n) + 1.0) as beta from p, m where not is_test),
pred as (select transaction_id, target, my + beta * (x - mx) / sx as prediction, target - (my + beta * (x - mx) / sx) as residual
  from p, m, b where is_test)
"""


def _one_number(spark, folder):
    """Amounts explained by the hour alone: the ridge is a line with a known slope."""
    found = regression.prediction_features(card_month(spark, folder))
    return settle(found.select("transaction_id", "is_test", "target", "hour"), "line")


def _line(spark, folder):
    features = _one_number(spark, folder)
    return regression.fit_ridge(features).predict(features.where(F.col("is_test")))


@named(
    "ml_ridge_line_predict",
    with_views("t1", f"with {_LINE_SQL} select transaction_id, round(target, 6) as target, round(prediction, 6) as prediction, round(residual, 6) as residual from pred"),
)
def ml_ridge_line_predict(spark, folder):
    return shaped(_line(spark, folder))


@named(
    "ml_ridge_line_metrics",
    with_views(
        "t1",
        f"""with {_LINE_SQL} select cast(count(*) as bigint) as test_rows, round(sqrt(avg(residual * residual)), 6) as rmse,
        round(avg(abs(residual)), 6) as mae, round(1 - avg(residual * residual) / var_pop(target), 6) + 0.0 as r2 from pred""",
    ),
)
def ml_ridge_line_metrics(spark, folder):
    return shaped(regression.evaluate(_line(spark, folder)))


@named(
    "ml_ridge_line_histogram",
    with_views(
        "t1",
        f"""with {_LINE_SQL}, e as (select min(residual) as low, (max(residual) - min(residual)) / 30 as width from pred),
        c as (select least(29, cast(floor((residual - low) / width) as int)) as bin, count(*) as n from pred, e group by 1)
        select cast(i as int) as bin, round(low + width * i, 6) + 0.0 as bin_start, round(low + width * (i + 1), 6) + 0.0 as bin_end,
          cast(coalesce(n, 0) as bigint) as row_count
        from range(30) as r(i) left join c on c.bin = r.i, e""",
    ),
)
def ml_ridge_line_histogram(spark, folder):
    return shaped(regression.residual_histogram(_line(spark, folder)))


@named(
    "ml_ridge_line_importance",
    with_views("t1", f"with {_LINE_SQL} select 'hour' as feature, round(abs(beta), 6) as importance, round(beta, 6) + 0.0 as coefficient from b"),
)
def ml_ridge_line_importance(spark, folder):
    return shaped(regression.fit_ridge(_one_number(spark, folder)).importance(spark))


_TWO = ("transaction_count", "avg_transaction_amount")


@named(
    "ml_pca_two_columns",
    with_views(
        "t1",
        f"""with {USERS_SQL}, c as (select avg(transaction_count) as mx, avg(avg_transaction_amount) as my,
          var_samp(transaction_count) as a, var_samp(avg_transaction_amount) as d,
          covar_samp(transaction_count, avg_transaction_amount) as b from labelled),
        l as (select *, (a + d) / 2 + sqrt(((a - d) / 2) * ((a - d) / 2) + b * b) as top from c),
        v as (select *, (top - d) / sqrt((top - d) * (top - d) + b * b) as v1, b / sqrt((top - d) * (top - d) + b * b) as v2 from l),
        s as (select *, case when (case when abs(v1) >= abs(v2) then v1 else v2 end) >= 0 then 1 else -1 end as s1,
          case when (case when abs(v2) >= abs(v1) then -v2 else v1 end) >= 0 then 1 else -1 end as s2 from v)
        select user_id, round(s1 * ((transaction_count - mx) * v1 + (avg_transaction_amount - my) * v2), 6) + 0.0 as pc1,
          round(s2 * ((avg_transaction_amount - my) * v1 - (transaction_count - mx) * v2), 6) + 0.0 as pc2
        from labelled, s""",
    ),
)
def ml_pca_two_columns(spark, folder):
    """Two columns have components in closed form."""
    return shaped(cl.project(_labelled(spark, folder), _TWO))


@named("ml_kmeans_facts", with_views("t1", "select distinct user_id, true as is_nearest, true as is_numbered_by_spend from t1 where user_id is not null"))
def ml_kmeans_facts(spark, folder):
    """Every user is with the nearest centre, and clusters are numbered by the spend of their centre."""
    table = settle(users.user_features(users.model_rows(card_month(spark, folder))), "features")
    found = cl.fit_clusters(table, 4)
    points = cl.scale(table).join(found.users, "user_id")
    centres = found.centres

    def distance(k: int):
        return sum((F.pow(F.col(c) - float(x), F.lit(2.0)) for c, x in zip(FEATURE_COLUMNS, centres[k])), F.lit(0.0))

    every = F.array(*[distance(k) for k in range(len(centres))])
    own = F.element_at(every, F.col("cluster") + 1)
    spend = [c[FEATURE_COLUMNS.index("total_spend")] for c in centres]
    return points.select(
        "user_id", (own <= F.array_min(every) + 1e-9).alias("is_nearest"), F.lit(spend == sorted(spend)).alias("is_numbered_by_spend")
    )


@named(
    "ml_elbow_facts",
    "select cast(k as int) as k, true as not_rising, true as rule_agrees from range(2, 11) as r(k)",
)
def ml_elbow_facts(spark, folder):
    """More clusters do not cost more, and the number suggested is the one that the rule gives, said again in SQL."""
    found = cl.elbow(settle(users.user_features(users.model_rows(card_month(spark, folder))), "features"))
    return spark.sql(
        """with dropped as (select *, inertia - lag(inertia) over (order by k) as into_k,
                             lead(inertia) over (order by k) - inertia as after_k from {found}),
             ratios as (select *, coalesce((after_k - into_k) / into_k, double('-infinity')) as flattens from dropped),
             best as (select *, row_number() over (order by flattens desc nulls last, k) as place from ratios)
           select k, coalesce(into_k <= 0, true) as not_rising, is_suggested = (place = 1) as rule_agrees from best""",
        found=found,
    )


def _nearest(spark, folder, fit):
    table = settle(users.user_features(users.model_rows(card_month(spark, folder))), "features")
    found = fit(table)
    points = cl.scale(table).join(found.users, "user_id")

    def distance(centre):
        return sum((F.pow(F.col(c) - float(x), F.lit(2.0)) for c, x in zip(FEATURE_COLUMNS, centre)), F.lit(0.0))

    every = F.array(*[distance(c) for c in found.centres])
    own = F.element_at(every, F.col("cluster") + 1)
    return table, found, points.withColumn("is_nearest", own <= F.array_min(every) + 1e-9)


@named(
    "ml_minibatch_facts",
    with_views("t1", "select distinct user_id, true as is_nearest, true as is_close from t1 where user_id is not null"),
)
def ml_minibatch_facts(spark, folder):
    """Clusters by small batches cost at most 5 % more than by all rows from the same first centres."""
    columns = list(FEATURE_COLUMNS)
    table, found, points = _nearest(spark, folder, lambda t: cl.fit_in_batches(t, 4, batch_rows=100))
    scaled = settle(cl.scale(table), "points")
    _, costs = kmeans.full(scaled, columns, kmeans.first_centres(scaled, columns, [4]))
    return points.select("user_id", "is_nearest", F.lit(found.cost <= 1.05 * costs[4]).alias("is_close"))


@named(
    "anomaly_isolation_forest_facts",
    with_views("t1", "select transaction_id, true as flag_follows_score, true as equal_rows_score_equally, true as share_is_right from t1"),
)
def anomaly_isolation_forest_facts(spark, folder):
    """Flags are scores above the exact quantile, equal features have equal scores, one row in a hundred at most is flagged."""
    rows = settle(forest.flag_isolated(card_month(spark, folder)), "isolated")
    edge = rows.agg(F.percentile("ml_score", F.lit(1.0 - forest.CONTAMINATION)).alias("edge")).scalar()
    share = rows.agg((F.avg("is_ml_anomaly") <= forest.CONTAMINATION + 1e-9).alias("ok")).scalar()
    by_features = rows.groupBy("amount", F.hour("timestamp").alias("_hour")).agg((F.max("ml_score") == F.min("ml_score")).alias("_equal"))
    joined = rows.withColumn("_hour", F.hour("timestamp")).join(by_features, ["amount", "_hour"])
    return joined.select(
        "transaction_id",
        ((F.col("ml_score") > edge).cast("int") == F.col("is_ml_anomaly")).alias("flag_follows_score"),
        F.col("_equal").alias("equal_rows_score_equally"),
        share.alias("share_is_right"),
    )


@named("anomaly_isolation_forest_scaled", with_views("t1", "select transaction_id, true as is_same, true as same_flag from t1"))
def anomaly_isolation_forest_scaled(spark, folder):
    """Trees on standardised features give the scores and flags of trees on plain ones."""
    rows = card_month(spark, folder)
    plain, scaled = (
        forest.flag_isolated(rows, scaled=on).select("transaction_id", F.col("ml_score").alias(f"s{on:d}"), F.col("is_ml_anomaly").alias(f"f{on:d}"))
        for on in (False, True)
    )
    both = plain.join(scaled, "transaction_id")
    return both.select("transaction_id", (F.abs(F.col("s0") - F.col("s1")) < 1e-6).alias("is_same"), (F.col("f0") == F.col("f1")).alias("same_flag"))


@named(
    "ml_median_filled",
    with_views(
        "t3",
        """with s as (select user_id, stddev_samp(amount) as sd from t3 where user_id is not null group by 1)
        select user_id, round(coalesce(sd, (select quantile_cont(sd, 0.5) from s)), 6) as std_transaction_amount from s""",
    ),
)
def ml_median_filled(spark, folder):
    """Users with a single transaction have no deviation and get the median of the others."""
    table = settle(users.user_features(users.model_rows(merchant_lines(spark, folder)), null_std="median"), "features")
    return shaped(cl.fill_with_medians(table).select("user_id", "std_transaction_amount"))


def _one_file_per_day(spark, folder) -> str:
    root = fresh_path(spark, "days")
    rows = card_month(spark, folder).withColumn("day", F.to_date("timestamp")).withColumn("timestamp", F.col("timestamp").cast("string"))
    rows.select(*TRANSACTION_COLUMNS, "day").repartition("day").write.option("header", True).partitionBy("day").csv(root)
    return root


@named(
    "file_manifest_by_day",
    with_views(
        "t1",
        """select cast(cast(timestamp as date) as varchar) as source_day, cast(count(*) as bigint) as row_count, true as is_valid,
           64 as hash_length from t1 group by 1""",
    ),
)
def file_manifest_by_day(spark, folder):
    found = files.manifest(spark, _one_file_per_day(spark, folder), "*.csv")
    return shaped(found.select("source_day", "row_count", "is_valid", F.length("sha256").alias("hash_length")))


@named(
    "scan_first_three_days",
    with_views(
        "t1",
        """select transaction_id, cast(cast(timestamp as date) as varchar) as source_day from t1
           where cast(timestamp as date) in (select distinct cast(timestamp as date) from t1 order by 1 limit 3)""",
    ),
)
def scan_first_three_days(spark, folder):
    rows = files.read_first_files(spark, _one_file_per_day(spark, folder), 3, "*.csv")
    return rows.select("transaction_id", F.col("source_day").cast("string").alias("source_day"))


_NUMBERS, _TEXTS = ("amount",), ("merchant_name", "merchant_category", "currency", "location_country", "device_type", "status")


@named(
    "quality_describe_all",
    with_views(
        "t1raw",
        """with v as (select c as column_name, v as value from (unpivot (select merchant_name, merchant_category, currency,
             location_country, device_type, status from t1raw) on merchant_name, merchant_category, currency, location_country,
             device_type, status into name c value v)),
        n as (select column_name, value, count(*) as n from v group by 1, 2),
        t as (select column_name, cast(sum(n) as bigint) as value_count, cast(count(*) as bigint) as unique_values,
          arg_min(value, (-n, value)) as top_value, cast(max(n) as bigint) as top_count from n group by 1)
        select column_name, value_count, unique_values, top_value, top_count, 0.0::double as mean_value, 0.0::double as std_value,
          0.0::double as min_value, 0.0::double as q25, 0.0::double as q50, 0.0::double as q75, 0.0::double as max_value from t
        union all
        select 'amount', cast(count(amount) as bigint), 0, '', 0, round(avg(amount), 6), round(stddev_samp(amount), 6), round(min(amount), 6),
          round(quantile_cont(amount, 0.25), 6), round(quantile_cont(amount, 0.5), 6), round(quantile_cont(amount, 0.75), 6),
          round(max(amount), 6) from t1raw""",
    ),
)
def quality_describe_all(spark, folder):
    described = shaped(profiling.describe_all(dirty_month(spark, folder), _NUMBERS, _TEXTS))
    return described.fillna(0).fillna("", ["top_value"])


@named(
    "join_merchant_ref_csv",
    with_views(
        "t3 merchant_ref",
        "select transaction_id, merchant_id, merchant_category_detailed from t3 left join merchant_ref using (merchant_id)",
    ),
)
def join_merchant_ref_csv(spark, folder):
    """The reference comes from a file."""
    path = fresh_path(spark, "reference")
    merchant_reference(spark, folder).write.option("header", True).csv(path)
    joined = lookups.with_reference(merchant_lines(spark, folder), files.read_merchant_reference(spark, path))
    return joined.select("transaction_id", "merchant_id", "merchant_category_detailed")
