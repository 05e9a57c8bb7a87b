"""Whole documents as one row: lines, labelled values, blocks and tables as steps over arrays.

A document's pages stand in one row (`seiten`: page, method and words), so nothing of a document is
shuffled while it is read. Words become lines in one pass over many documents at a time, linear in the
words. All that follows are expressions on the row's array of lines (`zeilen`); what is found is an array of
findings with their words, exploded once by the reader of the result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema, to_arrow_type
from pyspark.sql.types import DataType, StructField, StructType

from wharfline.functions.steps import let

# Fixed values, in points: how far a word's top may be from its line's first word, the gap that ends a value, how far left
# of its label a value may begin, and what ends blocks and tables as a multiple of the height of the line before.
ANCHOR_TOLERANCE, VALUE_GAP, COLUMN_TOLERANCE = 3.0, 14.0, 6.0
BLOCK_LINES, BLOCK_GAP, TABLE_GAP = 8, 1.8, 2.5
# Marks that make a word of punctuation, the gaps to the word they belong to, and how far their tops may differ.
MARKS, GLUE_GAPS, GLUE_TOLERANCE = r"^[.,:;!?)\]}%/'\"-]+$", (-1.0, 6.0), 4.5
WORD = "struct<top: double, x0: double, x1: double, bottom: double, text: string, conf: double>"
PAGES = f"array<struct<seite: int, methode: string, woerter: array<{WORD}>>>"
LINES = f"array<struct<seite: int, methode: string, luecke: double, hoehe: double, text: string, woerter: array<{WORD}>>>"


def _list(offsets: np.ndarray, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)


def _offsets(lists: pa.ListArray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy())])


#: Words or tokens that are worked on at a time: a worker's memory doesn't grow with those of a whole batch.
PART_ITEMS = 1 << 16


def sizes_within(lists: pa.ListArray, name: str) -> np.ndarray:
    """How many items the lists `name` of each row's structs hold."""
    inner = lists.flatten().field(name).value_lengths().fill_null(0).to_numpy()
    return np.diff(np.concatenate([[0], np.cumsum(inner)])[_offsets(lists)])


def in_parts(batch: pa.RecordBatch, sizes: np.ndarray, limit: int = PART_ITEMS) -> Iterator[pa.RecordBatch]:
    """A batch in slices whose rows hold `limit` items at most, or one row that holds more."""
    ends, at = np.cumsum(sizes), 0
    while at < len(ends):
        to = max(at + 1, int(np.searchsorted(ends, limit + (ends[at - 1] if at else 0), "right")))
        yield batch.slice(at, to - at)
        at = to
    pa.default_memory_pool().release_unused()


def _numbers(words: pa.StructArray, name: str) -> np.ndarray:
    return words.field(name).to_numpy(zero_copy_only=False)


def lines_of(words: pa.ListArray, tolerance: float) -> tuple[np.ndarray, pa.ListArray]:
    """Lists of words -> where each list's lines start, and the lines as lists of words from left to right.
    A word joins the line whose first word's top is within the tolerance, from the top down."""
    flat = words.flatten()
    top, x0 = _numbers(flat, "top"), _numbers(flat, "x0")
    sizes = np.diff(_offsets(words))
    of = np.repeat(np.arange(len(sizes)), sizes)
    order = np.lexsort((x0, top, of))
    pages, tops = of[order], top[order]
    # words of equal tops are of one line, so only the first of them is looked at
    firsts = np.flatnonzero((np.diff(pages, prepend=-1) != 0) | (np.diff(tops, prepend=0.0) != 0.0))
    starts, last, anchor = [], -1, 0.0
    for place, page, at in zip(firsts.tolist(), pages[firsts].tolist(), tops[firsts].tolist(), strict=True):
        if page != last or at - anchor > tolerance:
            starts.append(place)
            last, anchor = page, at
    begun = np.array(starts, np.int64)
    if len(begun) < len(firsts):  # some line has words of several tops, which stand by their tops so far
        line = np.zeros(len(order), np.int64)
        line[begun] = 1
        order = order[np.lexsort((x0[order], np.cumsum(line)))]
    sorted_words = flat if (order == np.arange(len(order))).all() else flat.take(pa.array(order))
    return np.searchsorted(pages[begun], np.arange(len(sizes) + 1)), _list(np.append(begun, len(order)), sorted_words)


def _by_line(lines: pa.ListArray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Upper and lower edge and text of each line; no line is empty."""
    words, starts = lines.flatten(), _offsets(lines)[:-1]
    if not len(lines):
        return np.zeros(0), np.zeros(0), pa.array([], pa.string())
    texts = pc.binary_join(_list(_offsets(lines), words.field("text").fill_null("")), " ")
    return np.minimum.reduceat(_numbers(words, "top"), starts), np.maximum.reduceat(_numbers(words, "bottom"), starts), texts


def glued(words: pa.ListArray) -> pa.ListArray:
    """Lists of words where words of punctuation have joined the word before them, if it is near; that word may have grown already."""
    flat = words.flatten()
    text = flat.field("text").fill_null("")
    x0, top, x1, bottom, conf = (_numbers(flat, c).copy() for c in ("x0", "top", "x1", "bottom", "conf"))
    sizes = np.diff(_offsets(words))
    of = np.repeat(np.arange(len(sizes)), sizes)
    joins: dict[int, list[int]] = {}
    root = {}
    for k in np.flatnonzero(pc.match_substring_regex(text, MARKS).to_numpy(zero_copy_only=False)).tolist():
        r = root.get(k - 1, k - 1)
        if r >= 0 and of[r] == of[k] and GLUE_GAPS[0] <= x0[k] - x1[r] <= GLUE_GAPS[1] and abs(top[k] - top[r]) <= GLUE_TOLERANCE:
            root[k] = r
            joins.setdefault(r, [r]).append(k)
            x1[r], top[r], bottom[r], conf[r] = max(x1[r], x1[k]), min(top[r], top[k]), max(bottom[r], bottom[k]), min(conf[r], conf[k])
    kept = np.ones(len(of), bool)
    kept[list(root)] = False
    texts = text.to_pylist() if joins else None
    if joins:
        for r, parts in joins.items():
            texts[r] = "".join(texts[k] for k in parts)
    new = {"top": pa.array(top), "x1": pa.array(x1), "bottom": pa.array(bottom), "conf": pa.array(conf), "text": pa.array(texts, pa.string()) if joins else text}
    fields = [f.name for f in flat.type]
    whole = pa.StructArray.from_arrays([new.get(n, flat.field(n)) for n in fields], fields)
    starts = np.concatenate([[0], np.cumsum(np.bincount(of[kept], minlength=len(sizes)))])
    return _list(starts, whole.take(pa.array(np.flatnonzero(kept))))


def _lined_documents(batches: Iterator[pa.RecordBatch], schema: pa.Schema, tolerance: float) -> Iterator[pa.RecordBatch]:
    for batch in (part for whole in batches for part in in_parts(whole, sizes_within(whole.column("seiten"), "woerter"))):
        pages = batch.column("seiten")
        flat = pages.flatten()
        line_starts, lines = lines_of(flat.field("woerter"), tolerance)
        page = np.repeat(np.arange(len(flat)), np.diff(line_starts))
        top, bottom, text = _by_line(lines)
        first = np.diff(page, prepend=-1) > 0
        gap, high = np.where(first, 0.0, top - np.roll(bottom, 1)), np.where(first, 1.0, np.maximum(np.roll(bottom - top, 1), 1.0))
        columns = [flat.field("seite").take(pa.array(page)), flat.field("methode").take(pa.array(page)), pa.array(gap), pa.array(high), text, lines]
        found = pa.StructArray.from_arrays(columns, ["seite", "methode", "luecke", "hoehe", "text", "woerter"])
        out = _list(line_starts[_offsets(pages)], found).cast(schema.field("zeilen").type)
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in schema.names[:-1]), out], schema=schema)


def with_lines(documents: DataFrame, tolerance: float = ANCHOR_TOLERANCE, pages: bool = True) -> DataFrame:
    """documents with `seiten` -> the same with `zeilen`: page, method, distance to the line above on its page (0 without one), that line's
    height (1 at least), text, words from left to right. A document without pages has no lines. Without pages `seiten` is left out: all words
    come back from Python in their lines already."""
    cast = documents.withColumn("seiten", F.col("seiten").cast(PAGES))
    schema = StructType([*[f for f in cast.schema.fields if pages or f.name != "seiten"], StructField("zeilen", DataType.fromDDL(LINES))])
    return cast.mapInArrow(partial(_lined_documents, schema=to_arrow_schema(schema), tolerance=tolerance), schema)


def _lined_pages(batches: Iterator[pa.RecordBatch], schema: pa.Schema, tolerance: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        starts, lines = lines_of(batch.column("_w"), tolerance)
        page = np.repeat(np.arange(len(batch)), np.diff(starts))
        number = np.arange(len(page)) - starts[page]
        keys = [batch.column(c).take(pa.array(page)) for c in schema.names[:-3]]
        yield pa.RecordBatch.from_arrays([*keys, pa.array(number, pa.int32()), lines.cast(schema.field("words").type), _by_line(lines)[2]], schema=schema)


def lines_by_anchor(words: DataFrame, tolerance: float = ANCHOR_TOLERANCE) -> DataFrame:
    """words (doc_id, page, text, x0, top, x1, bottom, conf) -> doc_id, page, line_no, words, text."""
    item = F.struct("top", "x0", "x1", "bottom", "text", "conf").cast(WORD)
    pages = words.groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(item)).alias("_w"))
    keys = [f for f in pages.schema.fields if f.name != "_w"]
    schema = StructType([*keys, *DataType.fromDDL(f"line_no int, words array<{WORD}>, text string").fields])
    return pages.mapInArrow(partial(_lined_pages, schema=to_arrow_schema(schema), tolerance=tolerance), schema)


def _glued_pages(batches: Iterator[pa.RecordBatch], kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield batch.set_column(batch.schema.get_field_index("_w"), "_w", glued(batch.column("_w")).cast(kind))


def glue_marks(words: DataFrame) -> DataFrame:
    """words (doc_id, page, word_no, ...) where words of punctuation have joined their left neighbour."""
    item = F.struct("word_no", "text", "x0", "top", "x1", "bottom", "conf")
    pages = words.groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(item)).alias("_w"))
    out = pages.mapInArrow(partial(_glued_pages, kind=to_arrow_type(pages.schema["_w"].dataType)), pages.schema)
    return out.select("doc_id", "page", F.explode("_w").alias("w")).select("doc_id", "page", "w.*")


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """rows dealt over all cores by keys. Adaptive execution joins partitions by their bytes, which leaves few tasks where small rows become large ones or take long."""
    spark = rows.sparkSession
    return rows.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism), *keys)


def first_of(items: Column, test: Callable[[Column], Column]) -> Column:
    """The place of the first item that passes, from 1; 0 where none does."""
    return F.coalesce(F.array_position(F.transform(items, lambda x: F.coalesce(test(x), F.lit(False))), True), F.lit(0)).cast("int")


def _until(items: Column, ends: Callable[[Column], Column]) -> Column:
    """The items before the first one that ends them."""
    cut = lambda xs, at: F.when(at == 0, xs).otherwise(F.slice(xs, F.lit(1), F.greatest(at - 1, F.lit(0))))
    return let(items, lambda xs: let(first_of(xs, ends), lambda at: cut(xs, at)))


def _to_gap(words: Column) -> Column:
    """The words up to the first gap that is too wide."""
    wide = lambda ws: F.transform(ws, lambda w, k: (k > 0) & (w["x0"] - F.get(ws, k - 1)["x1"] > VALUE_GAP))
    at = lambda ws: F.coalesce(F.array_position(wide(ws), True), F.lit(0)).cast("int")
    return let(words, lambda ws: let(at(ws), lambda k: F.when(k == 0, ws).otherwise(F.slice(ws, F.lit(1), F.greatest(k - 1, F.lit(0))))))


def _group(text: Column, pattern: Column) -> Column:
    return F.call_function("regexp_extract", text, pattern, F.lit(1))


def _words_in(text: Column) -> Column:
    """How many words begin in a text of words with one blank between them."""
    return F.when(F.trim(text) == "", F.lit(0)).otherwise(F.size(F.split(F.rtrim(text), " ")))


def _blanks(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


#: Stands between lines where a document's text is searched as a whole; no pattern crosses it.
BETWEEN = "\u0001"


def whole_text(lines: Column) -> Column:
    return F.array_join(F.transform(lines, lambda z: z["text"]), BETWEEN)


def label_patterns(label: str) -> dict[str, str]:
    """Patterns of a text up to a label that no letter stands before, and of what is before and through it on its line."""
    return {"bis": rf"(?i)^(?s:.*?)(?<![A-Za-z])(?:{label})", "vor": rf"(?i)^(.*?)(?<![A-Za-z])(?:{label})", "durch": rf"(?i)^(.*?(?<![A-Za-z])(?:{label})\s*[:.]?)"}


class Label:
    """A label by its pattern, or by a column with its label_patterns."""

    def __init__(self, label: str | Column) -> None:
        self.upto, self.before, self.through = [F.lit(p) for p in label_patterns(label).values()] if isinstance(label, str) else [label[n] for n in ("bis", "vor", "durch")]

    def place(self, text: Column) -> Column:
        """The first line that has it, from 1, by the whole text; 0 where none does."""
        upto = F.call_function("regexp_extract", text, self.upto, F.lit(0))
        return let(upto, lambda t: F.when(t == "", 0).otherwise(F.length(t) - F.length(F.replace(t, F.lit(BETWEEN), F.lit(""))) + 1))

    def first_word(self, line: Column) -> Column:
        return F.get(line["woerter"], _blanks(_group(line["text"], self.before)))

    def next_word(self, line: Column) -> Column:
        """The place of the first word after it, from 0."""
        return _words_in(_group(line["text"], self.through))


def _found(line: Column, words: Column) -> Column:
    return F.struct(line["seite"].alias("seite"), line["methode"].alias("methode"), words.alias("woerter"))


def value_after_label(lines: Column, label: str | Column, text: Column | None = None) -> Column:
    """The words right of the label in the first line that has it, up to a gap; else those below it on the page's next line. Null without a value:
    a later line with the label isn't looked at. text: whole_text(lines), where several labels share it."""
    at = Label(label)

    def value(pair: Column) -> Column:
        line, below = pair["line"], pair["below"]
        rest = F.slice(line["woerter"], at.next_word(line) + 1, F.greatest(F.size(line["woerter"]), F.lit(1)))
        left = at.first_word(line)["x0"] - COLUMN_TOLERANCE
        under = let(left, lambda x: F.filter(below["woerter"], lambda w: w["x0"] >= x))
        lower = let(_to_gap(under), lambda ws: F.when((below["seite"] == line["seite"]) & (F.size(ws) > 0), _found(below, ws)))
        return let(_to_gap(F.filter(rest, lambda w: ~w["text"].isin(":", "."))), lambda ws: F.when(F.size(ws) > 0, _found(line, ws)).otherwise(lower))

    return let(at.place(whole_text(lines) if text is None else text), lambda k: F.when(k > 0, let(F.struct(F.get(lines, k - 1).alias("line"), F.get(lines, k).alias("below")), value)))


def block_below_label(lines: Column, label: str) -> Column:
    """An array of findings: what is right of the label in its column, then up to eight lines below, until the distance grows or a line has no word there.
    The column begins under the label and ends before the next words on its line that stand apart."""
    at = Label(label)

    def column(line: Column, k: Column) -> Column:
        end = F.get(line["woerter"], at.next_word(line) - 1)["x1"]
        apart = lambda e: F.array_min(F.transform(F.filter(line["woerter"], lambda w: w["x0"] > e + VALUE_GAP), lambda w: w["x0"]))
        bounds = F.struct((at.first_word(line)["x0"] - COLUMN_TOLERANCE).alias("l"), F.coalesce(let(end, apart) - COLUMN_TOLERANCE, F.lit(float("inf"))).alias("r"))
        return let(bounds, lambda b: block(line, k, b))

    def block(line: Column, k: Column, b: Column) -> Column:
        inside = lambda words: F.filter(words, lambda w: (w["x0"] >= b["l"]) & (w["x0"] < b["r"]))
        rest = inside(F.slice(line["woerter"], at.next_word(line) + 1, F.greatest(F.size(line["woerter"]), F.lit(1))))
        under = F.filter(F.slice(lines, k + 1, F.lit(BLOCK_LINES)), lambda z: z["seite"] == line["seite"])
        cut = F.transform(under, lambda z: F.struct((z["luecke"] > BLOCK_GAP * z["hoehe"]).alias("weit"), _found(z, inside(z["woerter"])).alias("f")))
        kept = F.transform(_until(cut, lambda c: c["weit"] | (F.size(c["f"]["woerter"]) == 0)), lambda c: c["f"])
        return F.concat(F.filter(F.array(_found(line, rest)), lambda f: F.size(f["woerter"]) > 0), kept)

    # k is 0 where there is no such line: then nothing is the first line, and nothing is below it
    found = lambda k: F.filter(F.array(F.get(lines, k - 1)), lambda z: z.isNotNull())
    return let(at.place(whole_text(lines)), lambda k: F.flatten(F.transform(found(k), lambda line: column(line, k))))


def table_cells(lines: Column, patterns: dict[str, str], end: str, first: str) -> Column:
    """An array of cells (row from 0, column, page, words) of a document's first table.

    The heading is the first line where two thirds of the patterns are found; columns meet halfway between headings. Lines follow on the same
    page up to the end pattern or a wide gap. A line without the first column continues the row above it."""
    needed = max(2, (2 * len(patterns) + 2) // 3)
    hits = lambda text: reduce(lambda a, b: a + b, [F.regexp_like(text, F.lit(f"(?i){p}")).cast("int") for p in patterns.values()])

    def heading(head: Column, name: str, pattern: str) -> Column:
        word = lambda group: F.get(head["woerter"], _blanks(_group(head["text"], F.lit(group))))
        left, right = word(f"(?i)^(.*?)(?:{pattern})")["x0"], word(f"(?i)^(.*?(?:{pattern}))")["x1"]
        return F.when(F.regexp_like(head["text"], F.lit(f"(?i){pattern}")), F.struct(left.alias("x0"), right.alias("x1"), F.lit(name).alias("spalte")))

    def under(head: Column, k: Column) -> Column:
        heads = F.array_sort(F.array_compact(F.array(*[heading(head, *p) for p in patterns.items()])))
        left = lambda hs: F.transform(hs, lambda h, j: F.struct(F.when(j == 0, F.lit(0.0)).otherwise((F.get(hs, j - 1)["x1"] + h["x0"]) / 2).alias("x"), h["spalte"].alias("spalte")))
        below = F.filter(F.slice(lines, k + 1, F.greatest(F.size(lines), F.lit(1))), lambda z: z["seite"] == head["seite"])
        body = _until(below, lambda z: F.regexp_like(z["text"], F.lit(f"(?i){end}")) | (z["luecke"] > TABLE_GAP * z["hoehe"]))
        return let(let(heads, left), lambda bounds: let(placed(body, bounds), lambda ps: rows(ps, head)))

    def placed(body: Column, bounds: Column) -> Column:
        column = lambda w: F.element_at(F.filter(bounds, lambda h: h["x"] <= (w["x0"] + w["x1"]) / 2), -1)["spalte"]
        inside = lambda words: F.filter(words, lambda w: w["x0"] + w["x1"] >= 0)
        return F.transform(body, lambda z: F.transform(inside(z["woerter"]), lambda w: F.struct(column(w).alias("spalte"), w.alias("w"))))

    def rows(lines_of_cells: Column, head: Column) -> Column:
        begins = F.array_compact(F.transform(lines_of_cells, lambda ws, k: F.when((k == 0) | F.exists(ws, lambda w: w["spalte"] == first), k + 1)))
        size = lambda bs, k: F.coalesce(F.get(bs, k + 1), F.size(lines_of_cells) + 1) - F.get(bs, k)
        return let(begins, lambda bs: F.flatten(F.transform(bs, lambda b, k: let(F.flatten(F.slice(lines_of_cells, b, size(bs, k))), lambda ws: cells(ws, k, head)))))

    def cells(ws: Column, k: Column, head: Column) -> Column:
        of = lambda name: F.transform(F.filter(ws, lambda w: w["spalte"] == name), lambda w: w["w"])
        every = F.array(*[F.struct(k.cast("int").alias("zeile"), F.lit(name).alias("spalte"), head["seite"].alias("seite"), head["methode"].alias("methode"), of(name).alias("woerter")) for name in patterns])
        return F.filter(every, lambda c: F.size(c["woerter"]) > 0)

    found = lambda k: F.filter(F.array(F.get(lines, k - 1)), lambda z: z.isNotNull())
    return let(first_of(lines, lambda z: hits(z["text"]) >= needed), lambda k: F.flatten(F.transform(found(k), lambda head: under(head, k))))
