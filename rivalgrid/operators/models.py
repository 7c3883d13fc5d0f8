"""Linear models of price and interest with Spark ML."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression, LinearRegressionModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rivalgrid.operators.neighbours import feature_stats


def _assemble(rows: DataFrame, features: Sequence[str], name: str) -> DataFrame:
    return VectorAssembler(inputCols=list(features), outputCol=name).transform(rows)


def fit_price(rows: DataFrame, features: Sequence[str], target: str = "target") -> LinearRegressionModel:
    """Least squares on log1p of the price share."""
    data = _assemble(rows.withColumn("_y", F.log1p(target)), features, "_x")
    return LinearRegression(featuresCol="_x", labelCol="_y", solver="normal", standardization=False).fit(data)


def standardize(rows: DataFrame, stats: dict[str, tuple[float, float]]) -> DataFrame:
    return rows.withColumns({f"z_{f}": (F.col(f) - m) / s for f, (m, s) in stats.items()})


def fit_interest(
    rows: DataFrame, features: Sequence[str], label: str = "label", l2: float = 1.0
) -> tuple[LogisticRegressionModel, dict[str, tuple[float, float]]]:
    """Ridge logistic regression on standardised features; a unit penalty on the summed loss is 1/n here."""
    stats = feature_stats(rows, features)
    data = _assemble(standardize(rows, stats), [f"z_{f}" for f in features], "_x")
    model = LogisticRegression(
        featuresCol="_x", labelCol=label, regParam=l2 / max(rows.count(), 1), elasticNetParam=0.0, standardization=False,
        maxIter=200, tol=1e-9).fit(data)
    return model, stats


def predict(
    rows: DataFrame, features: Sequence[str], price: LinearRegressionModel, interest_features: Sequence[str],
    interest: LogisticRegressionModel, stats: dict[str, tuple[float, float]]
) -> DataFrame:
    """Both predictions back on their own scale; a price is never negative."""
    out = price.setPredictionCol("_log_price").transform(_assemble(rows, features, "_x")).drop("_x")
    data = _assemble(standardize(out, stats), [f"z_{f}" for f in interest_features], "_x")
    model = interest.setProbabilityCol("_p").setRawPredictionCol("_raw").setPredictionCol("_label")
    scored = model.transform(data).withColumn("p_interest", vector_to_array("_p")[1])
    return scored.withColumn("price", F.greatest(F.expm1("_log_price"), F.lit(0.0))).drop(
        "_x", "_p", "_raw", "_label", "_log_price", *[f"z_{f}" for f in interest_features])


def interest_gradient(rows: DataFrame, features: Sequence[str], model: LogisticRegressionModel, stats: dict[str, tuple[float, float]],
                      label: str = "label", l2: float = 1.0) -> DataFrame:
    """(feature, gradient, n): derivative of the penalised loss per row at the fitted weights, to three digits."""
    weights = dict(zip(features, model.coefficients.toArray().tolist(), strict=True))
    z = standardize(rows, stats)
    margin = sum((F.col(f"z_{f}") * w for f, w in weights.items()), F.lit(float(model.intercept)))
    off = 1 / (1 + F.exp(-margin)) - F.col(label)
    one = z.agg(F.count(F.lit(1)).alias("n"), F.sum(off).alias("intercept"), *[F.sum(off * F.col(f"z_{f}")).alias(f) for f in features])
    parts = [F.struct(F.lit(f).alias("feature"), F.round((F.col(f) + l2 * weights.get(f, 0.0)) / F.col("n"), 3).alias("gradient")) for f in (*features, "intercept")]
    return one.select("n", F.explode(F.array(*parts)).alias("p")).select("p.feature", "p.gradient", "n")


def prediction_residuals(
    rows: DataFrame, features: Sequence[str], price: LinearRegressionModel, interest_features: Sequence[str],
    interest: LogisticRegressionModel, stats: dict[str, tuple[float, float]]
) -> DataFrame:
    """(feature, residual, n, negative): mean product of the log price residual with each feature, the gap
    between mean interest and mean label, rows with a price, and predictions below zero."""
    out = predict(rows, features, price, interest_features, interest, stats)
    raw = sum((F.col(f) * float(w) for f, w in zip(features, price.coefficients, strict=True)), F.lit(float(price.intercept)))
    left = F.when(F.col("target").isNotNull(), F.log1p("target") - raw)
    one = out.agg(
        F.count("target").alias("n"), F.sum(F.when(F.col("price") < 0, 1).otherwise(0)).alias("negative"), F.avg(left).alias("intercept"),
        F.avg(F.col("p_interest") - F.col("label")).alias("interest"), *[F.avg(left * F.col(f)).alias(f) for f in features])
    parts = [F.struct(F.lit(f).alias("feature"), F.round(F.col(f), 3).alias("residual")) for f in (*features, "intercept", "interest")]
    return one.select("n", "negative", F.explode(F.array(*parts)).alias("p")).select("p.feature", "p.residual", "n", "negative")
