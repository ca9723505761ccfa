"""Amount prediction by ridge regression."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.regression import LinearRegression, LinearRegressionModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spendscope.functions.text import stable_hash
from spendscope.operators.cleaning import with_target
from spendscope.operators.quantiles import one_row, quantiles
from spendscope.operators.users import enrich_with_user_stats, model_rows
from spendscope.sources.schemas import present

# The columns that the model takes.
CATEGORIES = (
    "merchant_category", "currency", "location_country", "device_type", "time_of_day", "is_online",
)
NUMBERS = ("hour", "day_of_week", "day_of_month", "month", "year", "is_weekend")
USER_NUMBERS = ("user_transaction_count", "user_avg_amount")
TEST_PERCENT = 20


def is_test(key: str = "transaction_id", percent: int = TEST_PERCENT):
    """A fixed split by the id alone, the same however the table is partitioned."""
    return F.pmod(stable_hash(F.col(key)), F.lit(100)) < percent


def used(rows: DataFrame, target: str = "amount") -> DataFrame:
    """The columns of ``rows`` that :func:`prediction_features` reads."""
    return rows.select(present(rows, ["transaction_id", "user_id", "timestamp", target, *CATEGORIES, "cluster"]))


def prediction_features(rows: DataFrame, target: str = "amount", leak_free: bool = False) -> DataFrame:
    """Features, target and split flag of every transaction with a target.

    The user's mean amount includes the amounts to be predicted unless
    ``leak_free``, which takes it from the training rows only. Rows without a target
    count for the user's statistics and are left out afterwards.
    """
    known = model_rows(rows).withColumn("is_test", is_test())
    training = known.where(~F.col("is_test")) if leak_free else None
    enriched = with_target(enrich_with_user_stats(known, training), target)
    categories = present(enriched, [*CATEGORIES, "cluster"])
    numbers = present(enriched, [*NUMBERS, *USER_NUMBERS])
    return enriched.select(
        "transaction_id",
        "is_test",
        F.col(target).alias("target"),
        *[F.coalesce(F.col(c).cast("string"), F.lit("missing")).alias(c) for c in categories],
        *[F.col(c).cast("double").alias(c) for c in numbers],
    )


def _columns(features: DataFrame) -> tuple[list[str], list[str]]:
    return present(features, [*CATEGORIES, "cluster"]), present(features, [*NUMBERS, *USER_NUMBERS])


@dataclass(frozen=True)
class Encoder:
    """Scaled numbers and one-hot categories as fitted on the training rows.

    Columns that are constant in the training rows are left out of the vector: their
    coefficient is 0, and they would make the normal equations singular.
    """

    scaled: tuple[str, ...]
    stages: PipelineModel
    names: tuple[str, ...]
    constant: tuple[str, ...]
    label_scale: float
    training_rows: int

    def encode(self, features: DataFrame) -> DataFrame:
        return self.stages.transform(features.selectExpr("*", *self.scaled))


def _training_moments(training: DataFrame, numbers: Sequence[str]) -> dict[str, float]:
    """Means and population deviations after filling nulls with the exact median: a single row."""
    def moments(rows: DataFrame, *more) -> dict[str, float]:
        return rows.agg(
            F.expr("count(1) as n"),
            F.expr("stddev_pop(target) as target_std"),
            *[F.expr(f"avg({c}) as {c}_mean") for c in numbers],
            *[F.expr(f"stddev_pop({c}) as {c}_std") for c in numbers],
            *more,
        ).first().asDict()

    fill = {c: 0.0 for c in numbers}
    marked = training.select("target", *numbers, *[F.col(c).isNull().alias(f"{c}_gap") for c in numbers])
    found = moments(marked.fillna(fill), *[F.count_if(f"{c}_gap").alias(f"{c}_gaps") for c in numbers])
    holes = [c for c in numbers if found[f"{c}_gaps"]]
    if holes:
        long = training.select(holes).unpivot([], holes, "feature", "v")
        for row in quantiles(long, "v", {"m": 0.5}, ["feature"], few_groups=True).collect():
            fill[row["feature"]] = row["m"]
        found = moments(training.fillna(fill))
    return {**found, **{f"{c}_fill": v for c, v in fill.items()}}


def fit_encoder(training: DataFrame) -> Encoder:
    categories, numbers = _columns(training)
    m = _training_moments(training, numbers)
    varied = [c for c in numbers if m[f"{c}_std"]]
    scaled = tuple(
        f"(coalesce({c}, {m[f'{c}_fill']!r}D) - {m[f'{c}_mean']!r}D) / {m[f'{c}_std']!r}D as {c}_scaled"
        for c in varied
    )
    labels: dict[str, list[str]] = {}
    steps = []
    if categories:
        indexer = StringIndexer(
            inputCols=categories,
            outputCols=[f"{c}_index" for c in categories],
            handleInvalid="keep",
            stringOrderType="alphabetAsc",
        ).fit(training)
        labels = dict(zip(categories, indexer.labelsArray))
        steps.append(indexer)
    several = [c for c in categories if len(labels[c]) > 1]
    if several:
        # An unseen value gets the extra last index, which is the one dropped: all zeros.
        steps.append(
            OneHotEncoder(
                inputCols=[f"{c}_index" for c in several],
                outputCols=[f"{c}_hot" for c in several],
                dropLast=True,
            )
        )
    assembler = VectorAssembler(
        inputCols=[f"{c}_scaled" for c in varied] + [f"{c}_hot" for c in several],
        outputCol="features",
    )
    stages = Pipeline(stages=[*steps, assembler]).fit(training.selectExpr("*", *scaled))

    def hot_names(columns: Sequence[str]) -> list[str]:
        return [f"{c}_{value}" for c in columns for value in labels[c]]

    single = [c for c in categories if c not in several]
    constant = [*[c for c in numbers if c not in varied], *hot_names(single)]
    return Encoder(
        scaled,
        stages,
        (*varied, *hot_names(several)),
        tuple(constant),
        float(m["target_std"] or 0.0),
        int(m["n"]),
    )


@dataclass(frozen=True)
class Ridge:
    encoder: Encoder
    model: LinearRegressionModel

    def predict(self, features: DataFrame) -> DataFrame:
        return self.model.transform(self.encoder.encode(features)).select(
            "transaction_id", "target", "prediction", (F.col("target") - F.col("prediction")).alias("residual")
        )

    def importance(self, spark: SparkSession, k: int = 20) -> DataFrame:
        """Features by absolute coefficient; one row per feature, so a small frame."""
        coefficients = self.model.coefficients.toArray()
        rows = [(n, float(abs(c)), float(c)) for n, c in zip(self.encoder.names, coefficients)]
        rows += [(n, 0.0, 0.0) for n in self.encoder.constant]
        frame = spark.createDataFrame(rows, "feature string, importance double, coefficient double")
        return frame.orderBy(F.desc("importance"), "feature").limit(k)


NORMAL_FEATURES = 4096  # of which the normal-equation solver can hold the square


def fit_ridge(features: DataFrame, alpha: float = 1.0, solver: str | None = None) -> Ridge:
    """Ridge regression with penalty ``alpha`` on the squared coefficients.

    Spark divides the squared error by the rows and scales the penalty by the
    deviation of the target, hence the regularisation below. The normal-equation
    solver needs one pass over the data and no iterations; it is taken up to
    ``NORMAL_FEATURES`` features, and ``l-bfgs``, which has no such limit, beyond
    (or whatever ``solver`` names). Both minimise the same sum.
    """
    training = features.where(~F.col("is_test"))
    encoder = fit_encoder(training)
    solver = solver or ("normal" if len(encoder.names) <= NORMAL_FEATURES else "l-bfgs")
    # The solvers scale the penalty by the population and by the sample deviation of the target.
    rows = encoder.training_rows
    scale = encoder.label_scale * (1.0 if solver == "normal" or rows < 2 else (rows / (rows - 1)) ** 0.5)
    regression = LinearRegression(
        labelCol="target",
        featuresCol="features",
        elasticNetParam=0.0,
        standardization=False,
        solver=solver,
        regParam=alpha * scale / rows,
        maxIter=500,
        tol=1e-10,
    )
    return Ridge(encoder, regression.fit(encoder.encode(training).select("target", "features")))


def evaluate(predictions: DataFrame) -> DataFrame:
    """One row: test rows, root mean squared error, mean absolute error and R2."""
    r = F.col("residual")
    return predictions.agg(
        F.count(F.lit(1)).alias("test_rows"),
        F.sqrt(F.avg(r * r)).alias("rmse"),
        F.avg(F.abs(r)).alias("mae"),
        (1 - F.try_divide(F.avg(r * r), F.var_pop("target"))).alias("r2"),
    )


def residual_histogram(predictions: DataFrame, bins: int = 30) -> DataFrame:
    """Equal-width bins from the smallest to the largest residual, empty bins included."""
    ends = one_row(predictions.agg(F.min("residual").alias("low"), F.max("residual").alias("high")))
    placed = predictions.select("residual").withColumn("_e", ends)
    width = (F.col("_e.high") - F.col("_e.low")) / bins
    bin_of = F.least(
        F.lit(bins - 1), F.coalesce(F.floor(F.try_divide(F.col("residual") - F.col("_e.low"), width)), F.lit(0))
    )
    counted = placed.groupBy(bin_of.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    spine = predictions.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return (
        spine.join(F.broadcast(counted), "bin", "left")
        .withColumn("_e", ends)
        .select(
            "bin",
            (F.col("_e.low") + width * F.col("bin")).alias("bin_start"),
            (F.col("_e.low") + width * (F.col("bin") + 1)).alias("bin_end"),
            F.coalesce("n", F.lit(0)).alias("row_count"),
        )
    )
