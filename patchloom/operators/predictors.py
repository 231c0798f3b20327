"""Model-backed columns.

A predictor is an object built once per task by a factory and called with lists of texts.
Only the text columns travel to Python; the rest of the row stays in the JVM. Any object with
``predict(list) -> list`` is a predictor. What needs no model (word overlap, hashed words) is a
column expression of ``patchloom.functions.text`` and never leaves the JVM.
"""

from __future__ import annotations

import sys
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patchloom.functions import text
from patchloom.operators.quality import require_columns

# Workers get the functions themselves; the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

def _slices(size: int, step: int) -> Iterator[slice]:
    for start in range(0, size, step):
        yield slice(start, start + step)


def _run(predictor, inputs: list, valid: list[bool], batch_size: int, attempts: int, pause: float) -> list:
    """Results in input order. A batch that keeps failing gives nulls, the job goes on."""
    results: list = [None] * len(inputs)
    for part in _slices(len(inputs), batch_size):
        at = [i for i in range(*part.indices(len(inputs))) if valid[i]]
        if not at:
            continue
        for attempt in range(attempts):
            try:
                for i, value in zip(at, predictor.predict([inputs[i] for i in at]), strict=True):
                    results[i] = value
                break
            except Exception:  # noqa: BLE001 - any model failure is recorded as missing output
                if attempt + 1 < attempts:
                    time.sleep(pause * 2**attempt)
    return results


def _filled(text) -> bool:
    return isinstance(text, str) and bool(text.strip())


def _text_udf(factory: Callable, return_type: str, batch_size: int):
    @F.pandas_udf(return_type)
    def apply(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        predictor = factory()
        for texts in batches:
            inputs = texts.tolist()
            yield pd.Series(_run(predictor, inputs, [_filled(t) for t in inputs], batch_size, 1, 0.0), dtype=object)

    return apply


def _struct_udf(
    factory: Callable, fields: list[tuple[str, str]], pair: bool, need_text: bool, batch_size: int, attempts: int, pause: float
):
    names = [n for n, _ in fields]
    ddl = ", ".join(f"{n} {t}" for n, t in fields)

    def frame(values: list) -> pd.DataFrame:
        rows = [v if v is not None else (None,) * len(names) for v in values]
        out = pd.DataFrame(rows, columns=names, dtype=object)
        for name, kind in fields:
            if kind.upper() == "INT":
                out[name] = out[name].astype("Int32")
            elif kind.upper() == "DOUBLE":
                out[name] = out[name].astype("float64")
        return out

    ok = _filled if need_text else lambda t: isinstance(t, str)
    if pair:

        @F.pandas_udf(ddl)
        def apply_pair(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
            predictor = factory()
            for left, right in batches:
                inputs = list(zip(left.tolist(), right.tolist(), strict=True))
                valid = [ok(a) and ok(b) for a, b in inputs]
                yield frame(_run(predictor, inputs, valid, batch_size, attempts, pause))

        return apply_pair

    @F.pandas_udf(ddl)
    def apply_one(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        predictor = factory()
        for texts in batches:
            inputs = texts.tolist()
            yield frame(_run(predictor, inputs, [ok(t) for t in inputs], batch_size, attempts, pause))

    return apply_one


def generate(df: DataFrame, column: str, output: str, factory: Callable, batch_size: int = 16) -> DataFrame:
    """Generated text per row; blank input and failed batches give null."""
    require_columns(df, [column])
    return df.withColumn(output, _text_udf(factory, "string", batch_size)(F.col(column)))


def add_language(df: DataFrame, column: str, factory: Callable, batch_size: int = 64) -> DataFrame:
    """``language`` and ``confidence``; both null for blank text."""
    require_columns(df, [column])
    udf = _struct_udf(factory, [("language", "STRING"), ("confidence", "DOUBLE")], False, True, batch_size, 1, 0.0)
    return df.withColumn("_lang", udf(F.col(column))).select(*df.columns, "_lang.language", "_lang.confidence")


def confident_english(df: DataFrame, minimum: float = 0.7) -> DataFrame:
    """Rows in English above the confidence; the two columns are dropped."""
    require_columns(df, ["language", "confidence"])
    kept = df.where((F.col("language") == "en") & (F.col("confidence") > F.lit(minimum)))
    return kept.drop("language", "confidence")


def add_embedding(
    df: DataFrame, column: str, output: str, factory: Callable | None = None, batch_size: int = 32, size: int = 16
) -> DataFrame:
    """ARRAY<FLOAT> per text; null for blank text. Without a factory: word counts in ``size`` hash slots."""
    require_columns(df, [column])
    if factory is None:
        return df.withColumn(output, text.hashed_words(F.col(column), size))
    return df.withColumn(output, _text_udf(factory, "array<float>", batch_size)(F.col(column)))


def score_pairs(
    df: DataFrame,
    candidate: str,
    reference: str,
    factory: Callable | None = None,
    batch_size: int = 32,
    prefix: str = "overlap",
) -> DataFrame:
    """``<prefix>_precision``, ``_recall`` and ``_f1`` per row, in place: rows keep their number, null
    pairs get null scores. Without a factory: the overlap of their distinct words."""
    require_columns(df, [candidate, reference])
    fields = [(f"{prefix}_{n}", "DOUBLE") for n in ("precision", "recall", "f1")]
    if factory is None:
        scores = text.word_overlap(F.col(candidate), F.col(reference))
    else:
        scores = _struct_udf(factory, fields, True, False, batch_size, 1, 0.0)(F.col(candidate), F.col(reference))
    return df.withColumn("_s", scores.cast(f"struct<{', '.join(f'{n}: {t}' for n, t in fields)}>")).select(
        *df.columns, "_s.*"
    )


def score_distinct_pairs(
    df: DataFrame,
    candidate: str,
    reference: str,
    factory: Callable | None = None,
    batch_size: int = 32,
    prefix: str = "overlap",
) -> DataFrame:
    """Scores joined back on the two texts. Every distinct pair is scored once; each input
    row comes back once, with ``pair_rows`` telling how often its pair occurs."""
    require_columns(df, [candidate, reference])
    pairs = df.dropna(subset=[candidate, reference]).groupBy(candidate, reference).agg(F.count("*").alias("pair_rows"))
    scored = score_pairs(pairs, candidate, reference, factory, batch_size, prefix)
    return df.join(scored, on=[candidate, reference], how="left")


def judge(
    df: DataFrame,
    factory: Callable,
    message: str = "message",
    patch: str = "patch",
    batch_size: int = 1,
    attempts: int = 3,
    pause: float = 1.0,
) -> DataFrame:
    """``what_score`` and ``why_score`` in 0..5. Blank rows are skipped; a call that fails after
    ``attempts`` tries with doubling pauses, or answers outside the range, gives null."""
    require_columns(df, [message, patch])
    fields = [("what_score", "INT"), ("why_score", "INT")]
    udf = _struct_udf(factory, fields, True, True, batch_size, attempts, pause)
    scored = df.withColumn("_s", udf(F.col(message), F.col(patch)))
    valid = F.col("_s.what_score").between(0, 5) & F.col("_s.why_score").between(0, 5)
    return scored.select(*df.columns, *[F.when(valid, F.col(f"_s.{n}")).alias(n) for n, _ in fields])


def completeness(df: DataFrame, output: str) -> DataFrame:
    """One row: rows, rows with output, and their share."""
    done = F.count(F.col(output))
    return df.agg(
        F.count("*").alias("rows"), done.alias("completed"), F.try_divide(done, F.count("*")).alias("share")
    )
