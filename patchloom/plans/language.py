"""Language of a text by a fitted classifier: naive Bayes on hashed words."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import NaiveBayes
from pyspark.ml.feature import HashingTF, IndexToString, RegexTokenizer, StringIndexer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _filled(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn("_text", F.coalesce(F.col(column), F.lit("")))


def fit_language(train: DataFrame, column: str, label: str = "lang", slots: int = 1 << 16) -> PipelineModel:
    """Fitted on rows with a label; the counts are summed on Spark, the driver gets languages x slots numbers."""
    known = _filled(train.where(F.col(label).isNotNull()), column)
    indexer = StringIndexer(inputCol=label, outputCol="_label").fit(known)
    stages = [
        indexer,
        RegexTokenizer(inputCol="_text", outputCol="_words", pattern=r"\s+"),
        HashingTF(inputCol="_words", outputCol="_counts", numFeatures=slots),
        NaiveBayes(labelCol="_label", featuresCol="_counts", predictionCol="_guess", probabilityCol="_odds"),
        IndexToString(inputCol="_guess", outputCol="language", labels=indexer.labels),
    ]
    fitted = Pipeline(stages=stages).fit(known)
    return PipelineModel(fitted.stages[1:])  # texts to judge need no label


def add_fitted_language(model: PipelineModel, df: DataFrame, column: str) -> DataFrame:
    """``language`` and ``confidence`` (the probability of it); both null for blank text."""
    out = model.transform(_filled(df, column))
    blank = F.trim(F.regexp_replace("_text", r"\s+", " ")) == ""
    confidence = F.array_max(vector_to_array(F.col("_odds")))
    return out.select(
        *df.columns,
        F.when(~blank, F.col("language")).alias("language"),
        F.when(~blank, confidence).alias("confidence"),
    )
