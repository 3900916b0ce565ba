"""Chained equations with the models of ``pyspark.ml``, for comparison with those trained from ring statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .impute import flag, prepare
from .lineage import cut


def ml_mice(df: DataFrame, cont: list[str], cat: list[str], cont_null: list[str], cat_null: list[str], iterations: int = 1, lam: float = 0.0) -> DataFrame:
    """Each column from all others: linear regression for continuous, logistic regression for categorical ones, categories one-hot. Every model
    scans the table, as these estimators cannot be trained from sums."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import IndexToString, OneHotEncoder, StringIndexer, VectorAssembler
    from pyspark.ml.regression import LinearRegression

    rows = cut(prepare(df, cont_null, cat_null))
    for _ in range(iterations):
        for c in [*cat_null, *cont_null]:
            others = [x for x in cat if x != c]
            stages = [StringIndexer(inputCol=x, outputCol=f"_i_{x}", handleInvalid="keep") for x in others]
            stages += [OneHotEncoder(inputCol=f"_i_{x}", outputCol=f"_h_{x}", dropLast=False) for x in others]
            stages.append(VectorAssembler(inputCols=[*(x for x in cont if x != c), *(f"_h_{x}" for x in others)], outputCol="_x"))
            if c in cont_null:
                stages.append(LinearRegression(featuresCol="_x", labelCol=c, predictionCol="_y", regParam=lam, solver="normal"))
            else:
                labels = StringIndexer(inputCol=c, outputCol="_l", stringOrderType="alphabetAsc").fit(rows.where(~F.col(flag(c))))
                stages += [labels, LogisticRegression(featuresCol="_x", labelCol="_l", predictionCol="_p", regParam=lam), IndexToString(inputCol="_p", outputCol="_y", labels=labels.labels)]
            guessed = Pipeline(stages=stages).fit(rows.where(~F.col(flag(c)))).transform(rows)
            rows = cut(guessed.withColumn(c, F.when(F.col(flag(c)), F.col("_y").cast(rows.schema[c].dataType)).otherwise(F.col(c))).select(*rows.columns), rows)
    return rows.select(*df.columns)
