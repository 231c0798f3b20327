"""A support-vector machine with a Gaussian kernel and probabilities, on a linear machine that scales out.

Random Fourier features stand for the kernel: the inner product of two rows' features is exp(-gamma |x - y|^2) on average.
Every row is turned on its own, so that the machine keeps working on a table of any size.
"""

from __future__ import annotations

import json
import math
from collections.abc import Sequence
from typing import NamedTuple

import numpy as np
from pyspark.ml import Model
from pyspark.ml.classification import LinearSVC
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patchloom.operators.sampling import hash_order
from patchloom.session import materialize, scratch_dir


class KernelMachine(NamedTuple):
    """A fitted machine: its directions and shifts, the linear model, and the sigmoid of its margin."""

    features: tuple[str, ...]
    directions: tuple[tuple[float, ...], ...]
    shifts: tuple[float, ...]
    model: Model
    slope: float
    offset: float


def _values(features: Sequence[str]) -> Column:
    """Nulls count as 0, as in the filled feature table."""
    return F.array(*[F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(0.0)) for c in features])


def scale_gamma(rows: DataFrame, features: Sequence[str]) -> float:
    """1 / (features x variance over all values); 1 when the values do not vary."""
    values = [F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(0.0)) for c in features]
    moments = [F.avg(v) for v in values] + [F.var_pop(v) for v in values]
    got = rows.agg(*[m.alias(f"m{i}") for i, m in enumerate(moments)]).first()
    if got[0] is None:
        return 1.0
    means, spread = np.array(got[: len(features)]), np.array(got[len(features) :])
    variance = float(spread.mean() + means.var())
    return 1.0 / (len(features) * variance) if variance > 0 else 1.0


def draw_waves(features: int, waves: int, gamma: float, seed: int = 42) -> tuple[tuple[tuple[float, ...], ...], tuple[float, ...]]:
    """Directions of variance 2 gamma and shifts in 0 to 2 pi."""
    draw = np.random.default_rng(seed)
    directions = draw.normal(0.0, 1.0, (waves, features)) * math.sqrt(2 * gamma)
    return tuple(map(tuple, directions.tolist())), tuple(draw.uniform(0.0, 2 * math.pi, waves).tolist())


def fourier_features(values: Column, directions: Sequence[Sequence[float]], shifts: Sequence[float]) -> Column:
    """sqrt(2 / D) cos(w x + b) for each of the D directions w and shifts b."""
    table = json.dumps([{"w": list(w), "b": b} for w, b in zip(directions, shifts, strict=True)])
    waves = F.from_json(F.lit(table), "ARRAY<STRUCT<w: ARRAY<DOUBLE>, b: DOUBLE>>")  # one constant of the plan
    size = math.sqrt(2.0 / len(shifts))
    return F.transform(
        waves,
        lambda wave: F.lit(size) * F.cos(F.aggregate(F.zip_with(values, wave["w"], lambda x, y: x * y), wave["b"], lambda a, t: a + t)),
    )


def _margins(rows: DataFrame, features, directions, shifts, model: Model) -> DataFrame:
    turned = rows.withColumn("_turned", array_to_vector(fourier_features(_values(features), directions, shifts)))
    out = model.transform(turned)
    return out.select(*[F.col(f"`{c}`") for c in rows.columns], vector_to_array("_raw")[1].alias("_margin"))


def fit_sigmoid(margins: DataFrame, margin: str = "margin", label: str = "label", rounds: int = 50) -> tuple[float, float]:
    """Slope and offset of P(label = 1) = 1 / (1 + exp(-(slope margin + offset))), by Newton steps on sums over all rows.

    Aims are (n1 + 1) / (n1 + 2) and 1 / (n0 + 2) instead of 1 and 0, so that separable rows have a finite answer. A step that
    raises the loss is halved. The slope is not negative: where margins are of no use the offset alone is fitted.
    """
    sizes = margins.agg(F.count(F.when(F.col(label) == 1, 1)), F.count(F.when(F.col(label) == 0, 1)), F.avg(margin), F.stddev_pop(margin)).first()
    ones, zeros, centre, spread = sizes
    prior = math.log((ones + 1) / (zeros + 1))
    if not spread or not ones or not zeros:
        return 0.0, prior
    m = (F.col(margin) - F.lit(centre)) / F.lit(spread)
    aim = F.when(F.col(label) == 1, F.lit((ones + 1) / (ones + 2))).otherwise(F.lit(1 / (zeros + 2)))

    def sums(a: float, b: float):
        z = F.lit(a) * m + F.lit(b)
        p = F.lit(1.0) / (F.lit(1.0) + F.exp(-z))
        w = p * (F.lit(1.0) - p)
        # log(1 + exp(z)) - aim z, without overflow
        loss = F.greatest(z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z))) - aim * z
        got = margins.agg(F.sum(loss), F.sum((p - aim) * m), F.sum(p - aim), F.sum(w * m * m), F.sum(w * m), F.sum(w)).first()
        return got[0], np.array(got[1:3]), np.array([[got[3], got[4]], [got[4], got[5]]])

    at = np.array([0.0, prior])
    loss, gradient, curve = sums(*at)
    for _ in range(rounds):
        step = np.linalg.solve(curve + 1e-9 * np.eye(2), gradient)
        size = 1.0
        while size > 1e-4:
            there = sums(*(at - size * step))
            if there[0] <= loss:
                break
            size /= 2
        else:
            break
        at, gained = at - size * step, loss - there[0]
        loss, gradient, curve = there
        if gained <= 1e-10 * max(1.0, loss):
            break
    slope = at[0] / spread
    return (float(slope), float(at[1] - slope * centre)) if slope > 0 else (0.0, prior)


def fit_kernel_machine(
    train: DataFrame,
    features: Sequence[str],
    gamma: float | None = None,
    waves: int = 256,
    regularisation: float = 1e-3,
    held_out: float = 0.25,
    key: str = "pr_id",
    seed: int = 42,
    iterations: int = 50,
) -> KernelMachine:
    """Fit on rows with ``label`` 0 or 1. The sigmoid is fitted to margins of the share ``held_out`` of the rows (by a hash
    of ``key``; rows with one key stay together), which the linear machine does not see. ``waves`` bounds the model."""
    if gamma is None:
        gamma = scale_gamma(train, features)
    directions, shifts = draw_waves(len(features), waves, gamma, seed)
    share = F.conv(F.substring(hash_order([key], seed), 1, 8), 16, 10).cast("double") / F.lit(float(2**32))
    turned = array_to_vector(fourier_features(_values(features), directions, shifts)).alias("_turned")
    ready = materialize(train.select(turned, F.col("label"), (share < F.lit(held_out)).alias("_later")), "waves")
    machine = LinearSVC(featuresCol="_turned", rawPredictionCol="_raw", labelCol="label", maxIter=iterations, regParam=regularisation, standardization=False)
    fitted = machine.fit(ready.where(~F.col("_later")))
    path = scratch_dir(train.sparkSession, "kernel-machine")  # loaded without its training summary
    fitted.write().save(path)
    model = type(fitted).load(path)
    later = model.transform(ready.where("_later")).select("label", vector_to_array("_raw")[1].alias("margin"))
    slope, offset = fit_sigmoid(materialize(later, "margins"))
    return KernelMachine(tuple(features), directions, shifts, model, slope, offset)


def kernel_scores(machine: KernelMachine, rows: DataFrame) -> DataFrame:
    """Adds ``margin``, ``score`` (probability of class 1) and ``prediction`` INT (by the margin); columns of these names are replaced."""
    kept = rows.drop("margin", "score", "prediction")
    out = _margins(kept, machine.features, machine.directions, machine.shifts, machine.model)
    margin = F.col("_margin")
    score = F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.lit(machine.slope) * margin + F.lit(machine.offset))))
    return out.select(
        *[F.col(f"`{c}`") for c in kept.columns], margin.alias("margin"), score.alias("score"), (margin > 0).cast("int").alias("prediction")
    )
