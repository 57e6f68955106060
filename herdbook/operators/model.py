"""Count regression on cells, with residuals and their autocorrelation."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GeneralizedLinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from herdbook.operators.grid import local_moran
from herdbook.operators.relational import impute_mean


def poisson_fit(cells: DataFrame, count: str, area: str, features: list[str]) -> tuple[DataFrame, DataFrame]:
    """(cells with lambda, expected, resid_raw and resid_pearson; a table of coefficients).

    Poisson regression with log link and the area as exposure; missing features are replaced by their mean. There is no
    spatial random effect, so the fit isn't that of a latent Gaussian model.
    """
    df = impute_mean(cells, features).withColumn("_offset", F.log(F.col(area)))
    df = VectorAssembler(inputCols=features, outputCol="_x").transform(df)
    model = GeneralizedLinearRegression(family="poisson", link="log", labelCol=count, featuresCol="_x", offsetCol="_offset", maxIter=50).fit(df)
    out = model.transform(df).withColumnRenamed("prediction", "expected").withColumn("lambda", F.col("expected") / F.col(area))
    out = residuals(out, count, "expected").drop("_x", "_offset")
    rows = [("(Intercept)", float(model.intercept)), *zip(features, map(float, model.coefficients))]
    return out, cells.sparkSession.createDataFrame(rows, "name string, estimate double")


def residuals(df: DataFrame, observed: str, expected: str) -> DataFrame:
    """df with resid_raw = y - E and resid_pearson = (y - E) / sqrt(E), null where E isn't positive."""
    raw = F.col(observed) - F.col(expected)
    return df.withColumns({"resid_raw": raw, "resid_pearson": F.when(F.col(expected) > 0, raw / F.sqrt(F.col(expected)))})


def global_moran(cells: DataFrame, value: str) -> DataFrame:
    """One row (n, moran_i): the mean of the local statistics, which with weights summing to 1 is the global one."""
    lm = local_moran(cells, value)
    return lm.agg(F.count(F.lit(1)).alias("n"), F.avg("local_i").alias("moran_i"))
