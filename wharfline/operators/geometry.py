"""Lines of skewed pages, word by word along neighbours. Straight pages are read in `sheets`."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame

NEIGHBOUR_TOLERANCE, SKEW = 4.5, 0.035


def _neighbours(page: pd.DataFrame) -> pd.DataFrame:
    """From left to right, a word joins the line whose last word is nearest in height, within a tolerance that grows with the distance."""
    page = page.sort_values(["x0", "top"], kind="stable")
    ends: list[tuple[float, float]] = []
    held = []
    for x0, top in zip(page["x0"], page["top"], strict=True):
        fits = [(abs(t - top), k) for k, (x, t) in enumerate(ends) if x0 > x and abs(t - top) <= NEIGHBOUR_TOLERANCE + SKEW * (x0 - x)]
        k = min(fits)[1] if fits else len(ends)
        ends[k : k + 1] = [(x0, top)]
        held.append(k)
    page = page.assign(line_no=held)
    order = page.groupby("line_no").agg(top=("top", "min"), x0=("x0", "min")).sort_values(["top", "x0"]).index
    return page.assign(line_no=page["line_no"].map({k: i for i, k in enumerate(order)}))


def lines_by_neighbour(words: DataFrame) -> DataFrame:
    """words with line_no, for skewed scans. A greedy pass over each page: one page is one small group."""
    columns = [f"{n} {t}" for n, t in words.dtypes if n != "line_no"]
    return words.groupBy("doc_id", "page").applyInPandas(_neighbours, ", ".join([*columns, "line_no int"]))
