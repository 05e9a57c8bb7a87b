"""Quality rules with an isolation forest over rule statistics.

The fixed rules reject a text of fewer than 50 words, or one where more than half
of the words lie in repeated windows of three. The method's verdict comes from an
isolation forest: trees split at random statistics and values, and documents that
few splits set apart have short paths. Trees are grown on a bounded sample of
documents (`trees` times `sample` rows at most, the rows with the lowest random
keys), and every document is scored. The score above which a document is anomalous
is calibrated on labelled rows: it is the one that catches most rows of label 0 of
all those that lose no more than `max_loss` of the rows of label 1.

Defined results: a null text has no words and fails the base rule; repeated rows
get equal verdicts; without usable labels only the base rules reject; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from wharfline.llm.common import KEY_BITS, documents, labels, random_key, stage
from wharfline.llm.text_stats import COUNTS, RATIOS, ratio_matrix, stats_of

TREES = 128
SAMPLE = 256
MAX_LOSS = 0.005
BINS = 2000
SEED = 42
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50


def mean_path(n: int) -> float:
    """The mean path of an unsuccessful search among n rows."""
    return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (np.log(n - 1) + np.euler_gamma) - 2 * (n - 1) / n


class Forest:
    """Trees as arrays: feature (-1: leaf), threshold, left child (right is the next one), and a leaf's path."""

    def __init__(self, rows: np.ndarray, trees: int, sample: int, seed: int) -> None:
        random = np.random.default_rng(seed)
        self.depth = max(1, int(np.ceil(np.log2(max(2, min(sample, len(rows)))))))
        self.usual = mean_path(min(sample, len(rows))) or 1.0
        self.trees = [self._grow(rows[random.choice(len(rows), min(sample, len(rows)), replace=False)], random) for _ in range(trees)] if len(rows) else []

    def _grow(self, rows: np.ndarray, random: np.random.Generator) -> tuple[np.ndarray, ...]:
        feature, threshold, child, path, todo = [-1], [0.0], [0], [0.0], [(0, rows, 0)]
        while todo:
            at, part, depth = todo.pop()
            low, high = part.min(0), part.max(0)
            open_ = np.flatnonzero(high > low)
            if depth >= self.depth or len(part) < 2 or not len(open_):
                path[at] = depth + mean_path(len(part))
                continue
            f = int(random.choice(open_))
            t = float(random.uniform(low[f], high[f]))
            feature[at], threshold[at], child[at] = f, t, len(feature)
            for side in (part[part[:, f] < t], part[part[:, f] >= t]):
                todo.append((len(feature), side, depth + 1))
                for column, empty in ((feature, -1), (threshold, 0.0), (child, 0), (path, 0.0)):
                    column.append(empty)
                if not len(side):
                    todo.pop()
                    path[len(feature) - 1] = depth + 1
        return np.array(feature), np.array(threshold), np.array(child), np.array(path)

    def score(self, x: np.ndarray) -> np.ndarray:
        """0 to 1: near 1 for rows that few splits set apart."""
        if not self.trees or not len(x):
            return np.zeros(len(x))
        total, every = np.zeros(len(x)), np.arange(len(x))
        for feature, threshold, child, path in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                f = feature[node]
                node = np.where(f < 0, node, child[node] + (x[every, np.maximum(f, 0)] >= threshold[node]))
            total += path[node]
        return 2.0 ** (-total / len(self.trees) / self.usual)


def _scores(batches: Iterator[pa.RecordBatch], forest: Forest, id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        columns = [batch.column("id").cast(id_type), *(batch.column(c) for c in COUNTS), pa.array(forest.score(ratio_matrix(batch)))]
        yield pa.RecordBatch.from_arrays(columns, ["id", *COUNTS, "anomaly"])


def threshold(counts: list[tuple[int, float, int]], bins: int, max_loss: float) -> float:
    """(bin, label, rows) of labelled rows -> the lowest score to reject from; above 1 if labels can't tell."""
    good, bad = np.zeros(bins + 1), np.zeros(bins + 1)
    for b, y, n in counts:
        (good if y >= 0.5 else bad)[b] += n
    if not good.sum() or not bad.sum():
        return 2.0
    lost = good[::-1].cumsum()[::-1] / good.sum()
    fits = np.flatnonzero(lost <= max_loss)
    return float(fits[0] / bins) if len(fits) else 2.0


def judge(
    docs: DataFrame, marks: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
    trees: int = TREES, sample: int = SAMPLE, max_loss: float = MAX_LOSS, bins: int = BINS, seed: int = SEED,
) -> DataFrame:
    """id, the five counts, anomaly, base_failed and kept of every row; marks has id_col and label_col."""
    stats = stage(stats_of(docs, id_col, text_col), "rule-stats")
    kind = stats.schema["id"].dataType
    # rows below a key that `trees * sample` rows are expected under; the take below bounds what comes
    n, most = stats.count(), trees * sample
    keyed = stats.select(random_key(F.col("id"), seed="forest").alias("_key"), *RATIOS)
    few = keyed.where(F.col("_key") < int(min(1.0, 1.1 * most / max(n, 1)) * (1 << KEY_BITS)))
    rows = few.orderBy("_key").limit(most).select(*RATIOS).toPandas().to_numpy(np.float64)
    forest = Forest(rows, trees, sample, seed)
    schema = StructType([StructField("id", kind), *(StructField(c, LongType()) for c in COUNTS), StructField("anomaly", DoubleType())])
    scored = stage(stats.mapInArrow(partial(_scores, forest=forest, id_type=to_arrow_type(kind)), schema), "rule-scores")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    known = marks.select(F.col(id_col).alias("_id"), F.col(label_col).cast("double").alias("y")).where("y is not null")
    counts = (
        scored.where(~failed).join(known.hint("merge"), F.col("id") == F.col("_id"))
        .groupBy(F.floor(F.col("anomaly") * bins).cast("int").alias("bin"), (F.col("y") >= 0.5).cast("double").alias("y")).count().collect()  # 2 * (bins + 1) rows at most
    )
    limit = threshold([tuple(r) for r in counts], bins, max_loss)
    return scored.select(
        F.col("id").alias(id_col), *COUNTS, "anomaly", failed.alias("base_failed"), (~failed & (F.col("anomaly") < limit)).alias("kept")
    )


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(documents(spark, sf_dir), labels(spark, sf_dir))
