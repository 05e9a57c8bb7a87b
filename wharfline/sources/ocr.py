"""Recorded OCR responses and alert payloads -> tables."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal
from functools import partial
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DataType, StructField, StructType

from wharfline.operators.sheets import PAGES as SHEETS
from wharfline.operators.sheets import in_parts, let, sizes_within

POINTS_PER_INCH = 72.0
PAGES = """struct<analyzeResult: struct<pages: array<struct<pageNumber: int, unit: string, width: double, height: double,
  words: array<struct<content: string, confidence: double, polygon: array<double>>>>>>>"""


LAID = "array<struct<seite: int, breit: double, hoch: double, words: array<struct<content: string, confidence: double, polygon: array<double>>>>>"


def _rounded(x: np.ndarray) -> np.ndarray:
    """Two decimals, halves away from zero as they are written in decimal: as Spark's round()."""
    scaled = np.abs(x) * 100
    out = np.copysign(np.floor(scaled + 0.5), x) / 100
    for k in np.flatnonzero((np.abs(scaled - np.floor(scaled) - 0.5) < 1e-4) | (scaled > 2**40)).tolist():  # too near to a half to tell, or too large
        out[k] = float(Decimal(repr(float(x[k]))).quantize(Decimal("0.01"), ROUND_HALF_UP)) if np.isfinite(x[k]) and abs(x[k]) < 1e20 else x[k]
    return out


def _laid_out(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Words of each page in points: the least and greatest corner of their polygons, times the page's scales."""
    for batch in (part for whole in batches for part in in_parts(whole, sizes_within(whole.column("_seiten"), "words"))):
        pages = batch.column("_seiten")
        page = pages.flatten()
        lists = page.field("words")
        word = lists.flatten()
        text = pc.utf8_trim(word.field("content"), " ")
        kept = (pc.is_valid(word).to_numpy(zero_copy_only=False)) & pc.fill_null(pc.not_equal(text, ""), False).to_numpy(zero_copy_only=False)
        of = np.repeat(np.arange(len(page)), lists.value_lengths().fill_null(0).to_numpy())
        polygons = word.field("polygon")
        corner, n = polygons.flatten().to_numpy(zero_copy_only=False), polygons.value_lengths().fill_null(0).to_numpy()
        begin = np.cumsum(n) - n
        odd = (np.arange(len(corner)) - np.repeat(begin, n)) % 2 == 1

        def edge(side: str, high: bool, f: np.ufunc) -> pa.Array:
            worst = -np.inf if f is np.fmax else np.inf
            some = np.flatnonzero(n)
            best = np.full(len(n), np.nan)
            if len(some):
                best[some] = f.reduceat(np.where((odd == high) & ~np.isnan(corner), corner, worst), begin[some])  # noqa: B023
            best[np.isinf(best)] = np.nan  # no corner at all
            points = _rounded((best * page.field(side).to_numpy(zero_copy_only=False)[of])[kept])  # noqa: B023
            return pa.array(points, from_pandas=True)

        sure = np.clip(np.nan_to_num(word.field("confidence").to_numpy(zero_copy_only=False)[kept], nan=0.0), 0.0, 1.0)
        words = pa.StructArray.from_arrays([edge("hoch", True, np.fmin), edge("breit", False, np.fmin), edge("breit", False, np.fmax), edge("hoch", True, np.fmax), text.filter(pa.array(kept)), pa.array(sure)], ["top", "x0", "x1", "bottom", "text", "conf"])
        starts = np.searchsorted(of[kept], np.arange(len(page) + 1))
        whole = pa.StructArray.from_arrays([page.field("seite"), pa.array(["ocr"] * len(page), pa.string()), pa.ListArray.from_arrays(pa.array(starts, pa.int32()), words, mask=lists.is_null())], ["seite", "methode", "woerter"])
        offsets = np.concatenate([[0], np.cumsum(pages.value_lengths().fill_null(0).to_numpy())])
        out = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), whole, mask=pages.is_null()).cast(schema.field("seiten").type)
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in schema.names[:-1]), out], schema=schema)


def pages_from_layout(responses: DataFrame, width: float = 595.0, height: float = 842.0) -> DataFrame:
    """responses (..., antwort: JSON of pages with words and polygons) -> the same with `seiten`: pages with their words in points, in place of the
    response. A response that isn't such JSON has null. Corners are compared for many words at a time, in Arrow."""

    def page(p: Column, k: Column) -> Column:
        scale = lambda full, side: F.when(p["unit"] == "inch", POINTS_PER_INCH).when(p["unit"] == "pixel", F.lit(full) / F.nullif(p[side], F.lit(0.0)))
        return F.struct(F.coalesce(p["pageNumber"], k + 1).alias("seite"), scale(width, "width").alias("breit"), scale(height, "height").alias("hoch"), p["words"].alias("words"))

    rows = responses.withColumn("_seiten", F.transform(F.from_json("antwort", PAGES)["analyzeResult"]["pages"], page).cast(LAID)).drop("antwort")
    schema = StructType([*[f for f in rows.schema.fields if f.name != "_seiten"], StructField("seiten", DataType.fromDDL(SHEETS))])
    return rows.mapInArrow(partial(_laid_out, schema=to_arrow_schema(schema)), schema)


def words_from_layout(responses: DataFrame, width: float = 595.0, height: float = 842.0) -> DataFrame:
    """responses (doc_id, antwort) -> words in points: doc_id, page, word_no, text, x0, top, x1, bottom, conf."""
    pages = pages_from_layout(responses, width, height).select("doc_id", F.explode("seiten").alias("p"))
    return pages.select("doc_id", F.col("p.seite").alias("page"), F.posexplode("p.woerter").alias("word_no", "w")).select("doc_id", "page", "word_no", "w.text", "w.x0", "w.top", "w.x1", "w.bottom", "w.conf")


SEGMENTS = """struct<text: string, pages: array<struct<pageNumber: int, tokens: array<struct<layout: struct<textAnchor: struct<textSegments: array<struct<startIndex: string, endIndex: string>>>, confidence: double,
  boundingPoly: struct<normalizedVertices: array<struct<x: double, y: double>>>>, detectedBreak: struct<type: string>>>>>>"""
TOKENS = "array<struct<seite: int, marken: array<struct<teile: array<struct<von: int, bis: int>>, top: double, x0: double, x1: double, bottom: double, conf: double, umbruch: boolean>>>>"


def _sliced(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Words of each page from tokens that are slices of the row's text: a token adds to the word until one ends it."""
    for batch in (part for whole in batches for part in in_parts(whole, sizes_within(whole.column("_seiten"), "marken"))):
        pages = batch.column("_seiten")
        page = pages.flatten()
        token = page.field("marken").flatten()
        of_page = np.repeat(np.arange(len(page)), page.field("marken").value_lengths().fill_null(0).to_numpy())
        of_row = np.repeat(np.arange(len(batch)), pages.value_lengths().fill_null(0).to_numpy())[of_page] if len(page) else of_page
        parts = token.field("teile")
        bounds = zip(parts.flatten().field("von").to_pylist(), parts.flatten().field("bis").to_pylist(), strict=True)
        texts, said = batch.column("_text").to_pylist(), []
        for row, n in zip(of_row.tolist(), parts.value_lengths().fill_null(0).to_pylist(), strict=True):
            said.append("".join([texts[row][a:b] for a, b in islice(bounds, n)]).strip())
        ends = token.field("umbruch").fill_null(False).to_numpy(zero_copy_only=False).astype(np.int64)
        word = np.cumsum(ends) - ends  # how many words have ended before
        kept = np.array([bool(t) for t in said], bool)
        new = np.flatnonzero(np.diff(of_page[kept], prepend=-1) + np.diff(word[kept], prepend=-1) * len(page) != 0) if kept.any() else np.zeros(0, np.int64)
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.append(new, kept.sum()), pa.int32()), pa.array([t for t in said if t], pa.string())), "") if len(new) else pa.array([], pa.string())
        least = lambda name, f: pa.array(f.reduceat(token.field(name).to_numpy(zero_copy_only=False)[kept], new) if len(new) else np.zeros(0))  # noqa: B023, E731
        words = pa.StructArray.from_arrays([least("top", np.minimum), least("x0", np.minimum), least("x1", np.maximum), least("bottom", np.maximum), joined, least("conf", np.minimum)], ["top", "x0", "x1", "bottom", "text", "conf"])
        starts = np.searchsorted(of_page[kept][new], np.arange(len(page) + 1))
        lists = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), words)
        whole = pa.StructArray.from_arrays([page.field("seite"), pa.array(["ocr"] * len(page), pa.string()), lists], ["seite", "methode", "woerter"])
        offsets = np.concatenate([[0], np.cumsum(pages.value_lengths().fill_null(0).to_numpy())])
        out = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), whole, mask=pages.is_null()).cast(schema.field("seiten").type)
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in schema.names[:-1]), out], schema=schema)


def pages_from_segments(responses: DataFrame, width: float = 595.0, height: float = 842.0) -> DataFrame:
    """responses (..., antwort: JSON of one text, and pages of tokens that are slices of it, with corners as shares of the page) -> the same with
    `seiten` in place of the response. A slice without a start begins at 0, and a token can have several. A response without a text or pages, or
    with a token that has no corners, has null."""
    a = F.from_json("antwort", SEGMENTS)

    def token(t: Column) -> Column:
        box = lambda name, side, f: F.round(f(F.transform(t["layout"]["boundingPoly"]["normalizedVertices"], lambda v: F.coalesce(v[name], F.lit(0.0)) * side)), 2)
        parts = F.transform(F.coalesce(t["layout"]["textAnchor"]["textSegments"], F.array()), lambda s: F.struct(F.coalesce(s["startIndex"].try_cast("int"), F.lit(0)).alias("von"), F.coalesce(s["endIndex"].try_cast("int"), F.lit(0)).alias("bis")))
        return F.struct(
            parts.alias("teile"), box("y", height, F.array_min).alias("top"), box("x", width, F.array_min).alias("x0"), box("x", width, F.array_max).alias("x1"), box("y", height, F.array_max).alias("bottom"),
            F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(t["layout"]["confidence"], F.lit(0.0)))).alias("conf"), t["detectedBreak"].isNotNull().alias("umbruch"),
        )

    pages = lambda d: F.when(d["text"].isNotNull(), F.transform(d["pages"], lambda p, k: F.struct(F.coalesce(p["pageNumber"], k + 1).alias("seite"), F.transform(F.coalesce(p["tokens"], F.array()), token).alias("marken"))))
    read = responses.withColumn("_d", let(a, lambda d: F.struct(d["text"].alias("text"), pages(d).alias("seiten")))).drop("antwort")
    boxless = F.exists("_d.seiten", lambda p: F.exists(p["marken"], lambda m: (F.size(m["teile"]) > 0) & m["x0"].isNull()))
    rows = read.select(*[c for c in read.columns if c != "_d"], F.col("_d.text").alias("_text"), F.when(~boxless, F.col("_d.seiten")).cast(TOKENS).alias("_seiten"))
    schema = StructType([*rows.schema.fields, StructField("seiten", DataType.fromDDL(SHEETS))])
    return rows.mapInArrow(partial(_sliced, schema=to_arrow_schema(schema)), schema).drop("_text", "_seiten")


TOKEN = "struct<text: string, umbruch: boolean, x0: double, top: double, x1: double, bottom: double, conf: double>"
JOINED = "array<struct<text: string, x0: double, top: double, x1: double, bottom: double, conf: double>>"


def _joined(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Words of each page from its tokens in order: a word ends after a token that breaks, and with the page."""
    for batch in (part for whole in batches for part in in_parts(whole, whole.column("marken").value_lengths().fill_null(0).to_numpy())):
        pages = batch.column("marken")
        token, of = pages.flatten(), np.repeat(np.arange(len(batch)), pages.value_lengths().fill_null(0).to_numpy())
        ends = token.field("umbruch").fill_null(False).to_numpy(zero_copy_only=False)
        new = np.flatnonzero((np.diff(of, prepend=-1) > 0) | np.append(True, ends[:-1])) if len(of) else np.zeros(0, np.int64)
        texts = pa.ListArray.from_arrays(pa.array(np.append(new, len(of)), pa.int32()), token.field("text").fill_null(""))
        # fmin and fmax pass over what is null
        edge = lambda name, f: pa.array(f.reduceat(token.field(name).to_numpy(zero_copy_only=False), new) if len(new) else np.zeros(0), from_pandas=True)  # noqa: B023, E731
        words = pa.StructArray.from_arrays([pc.binary_join(texts, ""), edge("x0", np.fmin), edge("top", np.fmin), edge("x1", np.fmax), edge("bottom", np.fmax), edge("conf", np.fmin)], ["text", "x0", "top", "x1", "bottom", "conf"])
        out = pa.ListArray.from_arrays(pa.array(np.searchsorted(of[new], np.arange(len(batch) + 1)), pa.int32()), words)
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in schema.names[:-1]), out.cast(schema.field("woerter").type)], schema=schema)


def pages_from_tokens(pages: DataFrame) -> DataFrame:
    """pages (..., marken: the page's tokens in order) -> the same with `woerter` in place of the tokens. A page is a row, so nothing is shuffled."""
    rows = pages.withColumn("marken", F.col("marken").cast(f"array<{TOKEN}>"))
    schema = StructType([*[f for f in rows.schema.fields if f.name != "marken"], StructField("woerter", DataType.fromDDL(JOINED))])
    return rows.select(*schema.names[:-1], "marken").mapInArrow(partial(_joined, schema=to_arrow_schema(schema)), schema)


def words_from_tokens(tokens: DataFrame) -> DataFrame:
    """tokens (doc_id, page, pos, text, umbruch: a word ends after it, x0, top, x1, bottom, conf) -> words, numbered on their page. A page's tokens
    are gathered by one shuffle; where they stand in a row already, pages_from_tokens needs none."""
    token = ["text", "umbruch", "x0", "top", "x1", "bottom", "conf"]
    pages = tokens.groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(F.struct("pos", F.struct(*token).alias("t")))).alias("_m"))
    words = pages_from_tokens(pages.select("doc_id", "page", F.transform("_m", lambda m: m["t"]).alias("marken")))
    return words.select("doc_id", "page", F.posexplode("woerter").alias("word_no", "w")).select("doc_id", "page", F.col("word_no").cast("long").alias("word_no"), "w.*")


ALERTS = "struct<alerts: array<struct<fingerprint: string, status: string, startsAt: string, endsAt: string, labels: map<string, string>, annotations: map<string, string>>>>"


def alert_rows(payloads: DataFrame) -> DataFrame:
    """payloads (payload: JSON) -> a row for each alert; the zero date is no date."""
    rows = payloads.select(F.explode(F.from_json("payload", ALERTS)["alerts"]).alias("a"))
    stamp = lambda c: F.when(~F.startswith(c, F.lit("0001")), F.try_to_timestamp(c))
    return rows.select("a.fingerprint", F.coalesce(F.try_element_at("a.labels", F.lit("alertname")), F.lit("unbekannt")).alias("name"), F.col("a.status").alias("zustand"), stamp(F.col("a.startsAt")).alias("begonnen_am"), stamp(F.col("a.endsAt")).alias("beendet_am"), F.col("a.labels").alias("labels"))


ERRORS = "struct<workflow: struct<id: string, name: string>, execution: struct<id: string, mode: string, lastNodeExecuted: string, error: struct<name: string, message: string>>>"


def error_rows(events: DataFrame) -> DataFrame:
    """events (ereignis: JSON) -> operational columns only, never a payload."""
    e = events.select(F.from_json("ereignis", ERRORS).alias("e"))
    return e.select(
        F.col("e.workflow.id").alias("workflow_id"), F.col("e.workflow.name").alias("workflow_name"), F.col("e.execution.id").alias("execution_id"), F.col("e.execution.mode").alias("modus"),
        F.col("e.execution.lastNodeExecuted").alias("knoten"), F.col("e.execution.error.name").alias("fehlerart"), F.coalesce("e.execution.error.message", F.lit("unbekannt")).alias("meldung"),
    )
