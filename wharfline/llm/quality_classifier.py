"""Quality classifier: random Fourier features, ridge regression, isotonic calibration.

Statistics of a document, brought to zero mean and unit deviation, pass through
random cosines that approximate a Gaussian kernel. Every task adds up its part of
the normal equations (a matrix of fixed size); Spark adds the parts row by row, and
the driver solves one system of that size. The ridge score is then calibrated: the
calibration rows, which the ridge fit has not seen, are counted in a fixed number
of score bins, and adjacent violators are pooled.

Labels are learnt from all labelled rows outside the held-out fold; ids, labels,
language and source are never inputs.

Defined results: a null text counts as empty and is scored; a null id gets a score
and counts as the empty text for the fold; labelled rows without a document, null
labels and repeated labels of one id are: ignored, ignored, each used; repeated rows get
equal scores; very long texts are read whole; without any label the score is 0.5; an empty
table gives an empty result. Other columns play no part, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DoubleType, StructField, StructType

from wharfline.llm.common import discard, documents, fold, labels, stage
from wharfline.llm.text_stats import RATIOS, ratio_matrix, stats_of, text_stats

FEATURES = 256
RIDGE = 1.0
SEED = 42
BINS = 512
FOLDS = 3
HELD_OUT = 1


class Kernel:
    """Random cosines over standardised statistics, and an intercept."""

    def __init__(self, mean: np.ndarray, deviation: np.ndarray, features: int, seed: int) -> None:
        random = np.random.default_rng(seed)
        self.mean, self.deviation = mean, np.where(deviation > 1e-9, deviation, 1.0)
        # the bandwidth is the usual distance of two standardised rows
        self.w = random.normal(size=(len(mean), features)) / np.sqrt(2 * len(mean)) * 2
        self.b = random.uniform(0, 2 * np.pi, features)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.deviation, -8, 8)
        return np.column_stack([np.cos(z @ self.w + self.b) * np.sqrt(2 / len(self.b)), np.ones(len(x))])


def _normal_equations(batches: Iterator[pa.RecordBatch], kernel: Kernel) -> Iterator[pa.RecordBatch]:
    """One row for each row of the matrix: its sums, with the right-hand side at the end."""
    total = None
    for batch in batches:
        if batch.num_rows:
            z = kernel(ratio_matrix(batch))
            both = np.column_stack([z, batch.column("y").to_numpy(zero_copy_only=False)])
            part = z.T @ both
            total = part if total is None else total + part
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], ["row", "sums"])


def _add(key: tuple, table: pa.Table) -> pa.Table:
    total = sum(np.asarray(x) for x in table.column("sums").to_pylist())
    return pa.table({"row": pa.array([key[0].as_py()], pa.int32()), "sums": pa.array([total], pa.list_(pa.float64()))})


def _score(batches: Iterator[pa.RecordBatch], kernel: Kernel, weights: np.ndarray, steps: tuple, id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw = kernel(ratio_matrix(batch)) @ weights
        yield pa.RecordBatch.from_arrays(
            [batch.column("id").cast(id_type), pa.array(raw), pa.array(np.interp(raw, *steps) if len(steps[0]) else np.full(len(raw), 0.5))], ["id", "raw", "score"]
        )


def isotonic(bins: list[tuple[float, float, float]]) -> tuple[np.ndarray, np.ndarray]:
    """(mean score, mean label, weight) of bins in ascending order -> points of a rising function."""
    blocks: list[list[float]] = []
    for x, y, n in bins:
        blocks.append([x * n, y * n, n])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            top = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], top, strict=True)]
    return np.array([b[0] / b[2] for b in blocks]), np.array([b[1] / b[2] for b in blocks])


def quality_scores(
    docs: DataFrame, marks: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
    features: int = FEATURES, ridge: float = RIDGE, seed: int = SEED, bins: int = BINS,
) -> DataFrame:
    """id, held_out, score of every row; marks has id_col and label_col."""
    stats = stage(stats_of(docs, id_col, text_col), "quality-stats")
    known = marks.select(F.col(id_col).alias("_id"), F.col(label_col).cast("double").alias("y")).where("y is not null")
    train = stats.join(known.hint("merge"), F.col("id") == F.col("_id")).select(fold("id", FOLDS).alias("fold"), "y", *RATIOS)
    kernel, weights, steps = learn(train, features, ridge, seed, bins)
    kind = stats.schema["id"].dataType
    schema = StructType([StructField("id", kind), StructField("raw", DoubleType()), StructField("score", DoubleType())])
    out = stats.select("id", *RATIOS).mapInArrow(partial(_score, kernel=kernel, weights=weights, steps=steps, id_type=to_arrow_type(kind)), schema)
    return out.select(F.col("id").alias(id_col), (fold("id", FOLDS) == HELD_OUT).alias("held_out"), F.least(F.lit(1.0), F.greatest(F.lit(0.0), "score")).alias("score"))


def learn(train: DataFrame, features: int = FEATURES, ridge: float = RIDGE, seed: int = SEED, bins: int = BINS) -> tuple[Kernel, np.ndarray, tuple]:
    """(kernel, ridge weights, calibration points) from rows (fold, y, RATIOS) outside the held-out fold."""
    train = stage(train.where(F.col("fold") != HELD_OUT), "quality-train")
    moments = train.agg(*[F.avg(c).alias(f"m_{c}") for c in RATIOS], *[F.stddev_pop(c).alias(f"d_{c}") for c in RATIOS]).first()
    mean, deviation = (np.array([moments[f"{k}_{c}"] or 0.0 for c in RATIOS]) for k in "md")
    kernel = Kernel(mean, deviation, features, seed)

    fit = train.where(F.col("fold") == 0).select("y", *RATIOS)
    parts = fit.mapInArrow(partial(_normal_equations, kernel=kernel), "row int, sums array<double>")
    rows = parts.groupBy("row").applyInArrow(_add, "row int, sums array<double>").collect()  # features + 1 rows
    size = features + 1
    system = np.zeros((size, size + 1))
    for r in rows:
        system[r["row"]] = r["sums"]
    weights = np.linalg.solve(system[:, :size] + ridge * np.eye(size), system[:, size])

    calibration = train.where(F.col("fold") != 0).select(F.lit(0).alias("id"), "y", *RATIOS)
    raw = calibration.mapInArrow(_labelled(partial(_score, kernel=kernel, weights=weights)), "raw double, y double")
    counted = raw.groupBy(F.greatest(F.lit(0), F.least(F.lit(bins), F.floor((F.col("raw") + 1) / 3 * bins))).alias("bin")).agg(
        F.avg("raw").alias("x"), F.avg("y").alias("y"), F.count("*").cast("double").alias("n")
    )
    steps = isotonic([(r["x"], r["y"], r["n"]) for r in counted.orderBy("bin").collect()])  # bins + 1 rows at most
    discard(train)
    return kernel, weights, steps


def _labelled(scored: partial):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = scored.keywords["kernel"](ratio_matrix(batch)) @ scored.keywords["weights"]
            yield pa.RecordBatch.from_arrays([pa.array(raw), batch.column("y")], ["raw", "y"])

    return run


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(documents(spark, sf_dir), labels(spark, sf_dir)).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_good(docs: DataFrame, marks: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """The rows of docs that the classifier doesn't reject, each judged by its own text where ids repeat or are null. Rows stay
    where they are: the statistics of labelled texts alone are joined to the labels, and the verdict is a column of each row."""
    stats = stage(stats_of(docs, id_col, text_col), "quality-stats")
    known = marks.select(F.col(id_col).alias("_id"), F.col(label_col).cast("double").alias("y")).where("y is not null")
    kernel, weights, steps = learn(stats.join(known.hint("merge"), F.col("id") == F.col("_id")).select(fold("id", FOLDS).alias("fold"), "y", *RATIOS))
    discard(stats)

    def good(texts: pd.Series) -> pd.Series:
        ratios = np.array([text_stats(t or "")[1] for t in texts])
        raw = kernel(ratios) @ weights
        return pd.Series(np.interp(raw, *steps) >= 0.5 if len(steps[0]) else np.ones(len(raw), bool))

    return docs.where(F.pandas_udf(good, "boolean")(F.col(text_col)))
