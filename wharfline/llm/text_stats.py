"""Statistics of whole texts for the quality operators: one Python pass, no shuffle."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from wharfline.llm.common import chunks

BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
UPPER = bytes(range(65, 91))
DIGITS = bytes(range(48, 58))
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
RATIOS = (
    "log_words", "word_length", "symbol_share", "dup_line_share", "repeat_share", "upper_share", "digit_share",
    "mark_share", "bar_share", "distinct_share", "line_words", "stop_share", "top_word_share",
)


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a window of three found twice or more in the text."""
    windows = list(zip(words, words[1:], words[2:], strict=False))
    if len(set(windows)) == len(windows):
        return 0
    found = Counter(windows)
    again = np.fromiter((found[w] > 1 for w in windows), bool, len(windows))
    covered = np.zeros(len(words), bool)
    for shift in range(3):
        covered[shift : shift + len(windows)] |= again
    return int(covered.sum())


def text_stats(text: str) -> tuple[list[int], list[float]]:
    raw = text.encode()
    words = raw.split()
    n = len(words)
    word_chars = len(text) - sum(map(text.count, BLANKS))
    n_symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    lines = [x for x in text.split("\n") if x.strip(BLANKS)]
    dup_lines = len(lines) - len(set(lines))
    repeats = repeated_words(words)
    held, chars, size = max(n, 1), max(word_chars, 1), max(len(raw), 1)
    lower = Counter(raw.lower().split())
    deleted = lambda kind: len(raw) - len(raw.translate(None, kind))
    ratios = [
        np.log1p(n), word_chars / held, n_symbols / held, dup_lines / max(len(lines), 1), repeats / held, deleted(UPPER) / size, deleted(DIGITS) / size,
        deleted(b"!?") / held, raw.count(b"|") / held, len(lower) / held ** 0.75, np.log1p(n / max(len(lines), 1)), deleted(b".,;:") / held,
        max(lower.values(), default=0) / held,
    ]
    return [n, word_chars, n_symbols, dup_lines, repeats], [float(x) for x in ratios]


def _stats(batches: Iterator[pa.RecordBatch], id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
    for ids, texts in chunks(batches):
        counts, ratios = zip(*map(text_stats, texts), strict=True)
        columns = [pa.array(ids, id_type), *(pa.array(x, pa.int64()) for x in zip(*counts, strict=True)), *(pa.array(x, pa.float64()) for x in zip(*ratios, strict=True))]
        yield pa.RecordBatch.from_arrays(columns, ["id", *COUNTS, *RATIOS])


def stats_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, the counts and the ratios of every row."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType
    schema = StructType([StructField("id", kind), *(StructField(c, LongType()) for c in COUNTS), *(StructField(c, DoubleType()) for c in RATIOS)])
    return rows.mapInArrow(partial(_stats, id_type=to_arrow_type(kind)), schema)


def ratio_matrix(batch: pa.RecordBatch) -> np.ndarray:
    return np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in RATIOS]).astype(np.float64)
