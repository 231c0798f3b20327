"""Binary classifiers on the feature table, their evaluation and attribution."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.ml import Model
from pyspark.ml.classification import GBTClassifier, LinearSVC, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patchloom.operators.cumulative import running_before
from patchloom.operators.ranktests import rank_sums
from patchloom.operators.sampling import hash_order, stratified_split
from patchloom.session import scratch_dir

# The second boosted model differs in depth and number of trees.
MODELS = {
    "rf": lambda seed: RandomForestClassifier(numTrees=100, seed=seed, labelCol="label"),
    "gbt": lambda seed: GBTClassifier(maxIter=20, maxDepth=5, seed=seed, labelCol="label"),
    "gbt_shallow": lambda seed: GBTClassifier(maxIter=30, maxDepth=3, seed=seed, labelCol="label"),
    "svm": lambda seed: LinearSVC(maxIter=20, labelCol="label"),
}


def assemble(matrix: DataFrame, features: Sequence[str]) -> DataFrame:
    return VectorAssembler(inputCols=list(features), outputCol="features").transform(matrix)


def fit_model(matrix: DataFrame, features: Sequence[str], name: str, seed: int = 42) -> tuple[Model, DataFrame]:
    """Fit on the training rows of ``matrix`` (pr_id, label, is_test, features …)."""
    if name not in MODELS:
        raise ValueError(f"unknown model {name}; choose from {sorted(MODELS)} or use the neighbour vote")
    ready = assemble(matrix, features)
    # Training reads its rows many times; the cache spills to disk and is dropped afterwards.
    train = ready.where(F.col("is_test") == 0).select("features", "label").persist(StorageLevel.MEMORY_AND_DISK)
    try:
        model = MODELS[name](seed).fit(train)
    finally:
        train.unpersist()
    # A fitted model may hold its training summary, and with it the session; a loaded one does not.
    path = scratch_dir(matrix.sparkSession, f"model-{name}")
    model.write().save(path)
    model = type(model).load(path)
    return model, ready.where(F.col("is_test") == 1)


def scored(model: Model, rows: DataFrame) -> DataFrame:
    """Adds ``prediction`` INT and ``score``: probability of class 1, the margin without one."""
    out = model.transform(rows)
    source = "probability" if "probability" in out.columns else "rawPrediction"
    score = vector_to_array(F.col(source))[1]
    return out.select(*rows.columns, F.col("prediction").cast("int").alias("prediction"), score.alias("score"))


def split(matrix: DataFrame, key: str = "pr_id", seed: int = 42) -> DataFrame:
    return stratified_split(matrix, "label", [key], 0.2, seed)


def confusion_metrics(pred: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Accuracy, precision, recall, F1; a ratio without denominator is 0."""
    y, p = F.col("label"), F.col("prediction")

    def hits(cond: Column) -> Column:
        return F.count(F.when(cond, 1)).cast("double")

    tp, fp = hits((y == 1) & (p == 1)), hits((y == 0) & (p == 1))
    fn, right = hits((y == 1) & (p == 0)), hits(y == p)
    zero = F.lit(0.0)
    precision = F.coalesce(F.try_divide(tp, tp + fp), zero)
    recall = F.coalesce(F.try_divide(tp, tp + fn), zero)
    return pred.groupBy(*keys).agg(
        F.coalesce(F.try_divide(right, F.count("*")), zero).alias("accuracy"),
        precision.alias("precision"),
        recall.alias("recall"),
        F.coalesce(F.try_divide(2 * tp, 2 * tp + fp + fn), zero).alias("f1"),
    )


def auc(pred: DataFrame, keys: Sequence[str] = (), score: str = "score") -> DataFrame:
    """Exact area under the ROC curve by rank sums; null unless both classes occur."""
    sums = rank_sums(pred, keys, "label", [1, 0], score)
    n1, n0 = F.col("size_0").cast("double"), F.col("size_1").cast("double")
    return sums.select(*keys, F.try_divide(F.col("ranks_0") - n1 * (n1 + 1) / 2, n1 * n0).alias("auc"))


def roc_points(pred: DataFrame, keys: Sequence[str] = (), score: str = "score") -> DataFrame:
    """(threshold, fpr, tpr) at every distinct score; the point (0, 0) is the empty start."""
    counts = (
        pred.where(F.col(score).isNotNull())
        .groupBy(*keys, (-F.col(score).cast("double")).alias("value"))
        .agg(F.count(F.when(F.col("label") == 1, 1)).alias("p"), F.count(F.when(F.col("label") == 0, 1)).alias("q"))
    )
    ranked = running_before(counts, keys, ["p", "q"])
    return ranked.select(
        *keys,
        (-F.col("value")).alias("threshold"),
        F.try_divide((F.col("before_q") + F.col("q")).cast("double"), "total_q").alias("fpr"),
        F.try_divide((F.col("before_p") + F.col("p")).cast("double"), "total_p").alias("tpr"),
    )


def evaluation(pred: DataFrame, name: str) -> DataFrame:
    """One row of metrics. Both parts have one row, keyed by the model name."""
    tagged = pred.withColumn("model_name", F.lit(name))
    return confusion_metrics(tagged, ["model_name"]).join(auc(tagged, ["model_name"]), on="model_name", how="left")


def compare_models(matrix: DataFrame, features: Sequence[str], names: Sequence[str], seed: int = 42) -> DataFrame:
    """Metric rows of several models on the same split."""
    out = None
    for name in names:
        model, test = fit_model(matrix, features, name, seed)
        row = evaluation(scored(model, test).select("label", "prediction", "score"), name)
        out = row if out is None else out.unionByName(row)
    return out


def importances(spark, model: Model, features: Sequence[str]) -> DataFrame:
    """Impurity importance per feature, largest first. One row per feature, no data involved."""
    values = [(f, float(v)) for f, v in zip(features, model.featureImportances.toArray(), strict=True)]
    return spark.createDataFrame(values, "feature STRING, importance DOUBLE").orderBy(F.desc("importance"))


def top_k(df: DataFrame, score: str, k: int) -> DataFrame:
    return df.orderBy(F.col(score).desc()).limit(k)


def attributions(
    model: Model,
    rows: DataFrame,
    background: DataFrame,
    features: Sequence[str],
    permutations: int = 8,
    seed: int = 42,
    key: str = "pr_id",
    background_rows: int = 64,
) -> DataFrame:
    """Sampled Shapley values of the score: (key, feature, feature_value, attribution, score, base_score).

    Each row walks from a background row to itself along random feature orders; one feature
    changes per step, and the score change is credited to it. A walk has one hybrid row per
    feature, all scored in one pass of the model. The background is a sample of at most
    ``background_rows`` training rows, whatever the number of walks; a walk takes one of them
    by hash. A row's attributions sum to its score minus the mean score of its backgrounds.
    """
    names = list(features)
    picked = background.orderBy(hash_order([key], seed)).limit(background_rows)
    values = [[float(v) for v in r] for r in picked.select(*[F.col(c).cast("double") for c in names]).collect()]
    if not values:
        raise ValueError("no background rows")
    walks = F.transform(
        F.sequence(F.lit(0), F.lit(permutations - 1)),
        lambda w: F.struct(
            w.alias("walk"),
            F.array_sort(
                F.transform(
                    F.sequence(F.lit(0), F.lit(len(names) - 1)),
                    lambda i: F.struct(F.xxhash64(F.col(key), w, i, F.lit(seed)).alias("h"), i.alias("i")),
                )
            ).alias("order"),
        ),
    )
    own = F.array(*[F.col(c).cast("double") for c in names])
    base = F.from_json(F.lit(json.dumps(values)), "ARRAY<ARRAY<DOUBLE>>")
    at = F.pmod(F.xxhash64(F.col(key), F.lit(seed), "w.walk"), F.lit(len(values))).cast("int")
    walked = rows.select(key, own.alias("own"), F.explode(walks).alias("w")).select(
        key, "own", "w.walk", F.transform(F.col("w.order"), lambda s: s["i"]).alias("order"), F.get(base, at).alias("base")
    )
    # Walks are dealt before a step becomes a row of its own: few files would else expand, score and sort them in few tasks.
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    walked = walked.repartition(tasks, key, "walk")
    steps = walked.select("*", F.explode(F.sequence(F.lit(0), F.lit(len(names)))).alias("step"))
    # Feature i comes from the row once its place in the order is below the step.
    hybrid = F.transform(
        F.col("own"),
        lambda v, i: F.when(F.array_position("order", i) <= F.col("step"), v).otherwise(
            F.get("base", i)
        ),
    )
    mixed = steps.select(key, "own", "walk", "step", "order", array_to_vector(hybrid).alias("features"))
    result = scored(model, mixed).select(
        key, "walk", F.struct("step", "score", "order", "own").alias("s")
    )
    # One walk has len(features)+1 rows, whatever the data size.
    walk = result.groupBy(key, "walk").agg(F.array_sort(F.collect_list("s")).alias("s"))
    gains = walk.select(
        key,
        F.get("s", len(names))["score"].alias("score"),
        F.get("s", 0)["score"].alias("base_score"),
        F.explode(
            F.transform(
                F.sequence(F.lit(1), F.lit(len(names))),
                lambda k: F.struct(
                    F.get(F.col("s")[0]["order"], k - 1).alias("i"),
                    (F.get("s", k)["score"] - F.get("s", k - 1)["score"]).alias("gain"),
                    F.get(F.col("s")[0]["own"], F.get(F.col("s")[0]["order"], k - 1)).alias("feature_value"),
                ),
            )
        ).alias("g"),
    )
    labels = F.array(*[F.lit(n) for n in names])
    return gains.groupBy(key, F.get(labels, F.col("g.i")).alias("feature")).agg(
        F.max("g.feature_value").alias("feature_value"),
        F.avg("g.gain").alias("attribution"),
        F.avg("score").alias("score"),
        F.avg("base_score").alias("base_score"),
    )


def attribution_ranking(attributed: DataFrame) -> DataFrame:
    """Mean absolute attribution per feature."""
    return attributed.groupBy("feature").agg(F.avg(F.abs("attribution")).alias("mean_abs"))
