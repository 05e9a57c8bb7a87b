from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import functions as F

from wharfline.operators import geometry, sheets
from wharfline.sources import cases, ocr, xml_invoices


def test_invoice_xml_round_trip(spark, tmp_path):
    heads = spark.createDataFrame([("a", "R-1", "handelsrechnung", "EUR", 5.0, 2.0), ("b", "R-2", "proformarechnung", "USD", 0.0, 0.0)], "akte_id string, nummer string, typ string, waehrung string, zuschlaege double, rabatte double")
    lines = spark.createDataFrame([("a", 2, "Ventil", "848420", "DE", 3.0, 2.5, 7.5), ("a", 1, "Pumpe", "841330", "CN", 1.0, 100.0, 100.0), ("b", 1, "X", "841330", "DE", 1.0, 1.0, 1.0)], "akte_id string, nr int, beschreibung string, hs6 string, ursprung string, menge double, einzelpreis double, netto double")
    for r in xml_invoices.write_invoices(heads, lines).collect():
        (tmp_path / f"{r.akte_id}.xml").write_text(r.xml, encoding="utf-8")
    (tmp_path / "c.xml").write_text("<CrossIndustryInvoice><broken>", encoding="utf-8")
    (tmp_path / "d.xml").write_text("no xml", encoding="utf-8")
    read = xml_invoices.read_invoices(spark, str(tmp_path)).cache()
    assert {r.datei: (r.typ, r.gueltig) for r in read.collect()} == {"a.xml": ("handelsrechnung", True), "b.xml": ("proformarechnung", True), "c.xml": ("unclassified", False), "d.xml": ("unclassified", False)}
    said = {(r.dokument, r.pfad): r.txt if r.kind == "txt" else r.num for r in xml_invoices.invoice_assertions(read).collect()}
    assert said["a.xml", "rechnung.gesamt"] == 110.5 and said["a.xml", "rechnung.nummer"] == "R-1" and said["a.xml", "rechnung.positionen.0.ursprung"] == "CN"
    assert said["a.xml", "rechnung.positionen.1.hs6"] == "848420" and said["a.xml", "rechnung.positionen.1.einheit"] == "PCE" and said["b.xml", "rechnung.waehrung"] == "USD"


def test_words_from_responses(spark):
    word = lambda t, x, y, c=0.9: {"content": t, "confidence": c, "polygon": [x, y, x + 1, y, x + 1, y + 0.2, x, y + 0.2]}
    answer = {"analyzeResult": {"pages": [{"pageNumber": 1, "unit": "inch", "width": 8, "height": 11, "words": [word("No", 1, 1), word(".:", 2.02, 1, 0.4), word("X", 4, 1, 3.0)]}]}}
    words = ocr.words_from_layout(spark.createDataFrame([("d", json.dumps(answer))], "doc_id string, antwort string"))
    first = words.orderBy("word_no").first()
    assert (first.x0, first.top, first.x1, first.bottom) == (72.0, 72.0, 144.0, 86.4) and words.where("text = 'X'").first().conf == 1.0
    glued = sheets.glue_marks(words).orderBy("word_no").collect()
    assert [(w.text, w.conf) for w in glued] == [("No.:", 0.4), ("X", 1.0)]


def test_words_from_tokens(spark):
    rows = [("d", 1, k, t, b, float(k), 1.0, k + 1.0, 2.0, c) for k, (t, b, c) in enumerate([("In", False, 0.9), ("voice", True, 0.5), ("1", True, 1.0)])]
    tokens = spark.createDataFrame(rows, "doc_id string, page int, pos int, text string, umbruch boolean, x0 double, top double, x1 double, bottom double, conf double")
    assert [(w.text, w.x0, w.x1, w.conf) for w in ocr.words_from_tokens(tokens).orderBy("word_no").collect()] == [("Invoice", 0.0, 2.0, 0.5), ("1", 2.0, 3.0, 1.0)]


def words(spark, rows):
    return spark.createDataFrame([("d", 1, t, float(x), float(y), float(x + 10), float(y + 8), 0.9) for t, x, y in rows], "doc_id string, page int, text string, x0 double, top double, x1 double, bottom double, conf double")


def test_lines(spark):
    w = words(spark, [("a", 0, 10), ("b", 20, 12.5), ("c", 40, 14.5), ("d", 0, 30)])
    assert [r.text for r in sheets.lines_by_anchor(w).orderBy("line_no").collect()] == ["a b", "c", "d"]
    skewed = words(spark, [(f"w{k}", 30 * k, 10 + k) for k in range(8)] + [(f"v{k}", 30 * k, 30 + k) for k in range(8)])
    lines = geometry.lines_by_neighbour(skewed).collect()
    assert {r.line_no for r in lines if r.text[0] == "w"} == {0} and {r.line_no for r in lines if r.text[0] == "v"} == {1}


def test_words_from_slices_of_a_text(spark):
    text = "Größe MAEU-HH 7 rest"
    corner = lambda x, y: [{"x": x, "y": y}, {"x": x + 0.1, "y": y + 0.01}]

    def token(*parts, ends=True, conf=0.9, x=0.1, boxed=True):
        segments = [{k: str(v) for k, v in (("startIndex", a), ("endIndex", b)) if k == "endIndex" or v} for a, b in parts]
        return {"layout": {"textAnchor": {"textSegments": segments}, "confidence": conf, "boundingPoly": {"normalizedVertices": corner(x, 0.2)} if boxed else {}}} | ({"detectedBreak": {"type": "SPACE"}} if ends else {})

    first = [token((0, 6)), token((6, 10), ends=False, conf=0.5), token((10, 11), ends=False, x=0.3), token((5, 6)), token((11, 13), (14, 15), conf=3.0), token((15, 20), ends=False)]
    answers = [("a", {"text": text, "pages": [{"pageNumber": 4, "tokens": first}, {"tokens": []}, {"tokens": [token((0, 2))]}]}), ("none", {"text": text}), ("no text", {"pages": [{"tokens": first}]}), ("no box", {"text": text, "pages": [{"tokens": [token((0, 2), boxed=False)]}]}), ("empty", {"text": "", "pages": []})]
    rows = spark.createDataFrame([(k, json.dumps(a)) for k, a in answers] + [("no json", "{"), ("null", None)], "doc_id string, antwort string")
    got = {r.doc_id: r.seiten for r in ocr.pages_from_segments(rows, 100.0, 200.0).collect()}
    assert [(p.seite, [(w.text, w.conf, w.x0, w.x1) for w in p.woerter]) for p in got["a"]] == [(4, [("Größe", 0.9, 10.0, 20.0), ("MAEU-", 0.5, 10.0, 40.0), ("HH7", 1.0, 10.0, 20.0), ("rest", 0.9, 10.0, 20.0)]), (2, []), (3, [("Gr", 0.9, 10.0, 20.0)])]
    assert got["a"][0].woerter[0].top == 40.0 and got["empty"] == [] and all(got[k] is None for k in ("none", "no text", "no box", "no json", "null"))


def test_long_texts_are_sliced_in_linear_time(spark):
    n = 60_000
    token = {"layout": {"textAnchor": {"textSegments": [{"startIndex": "%d", "endIndex": "%d"}]}, "confidence": 1, "boundingPoly": {"normalizedVertices": [{"x": 0.1, "y": 0.1}]}}, "detectedBreak": {"type": "SPACE"}}
    one = json.dumps(token)
    answer = json.dumps({"text": "ab " * n, "pages": [{"tokens": []}]}).replace("[]", "[" + ",".join(one % (3 * k, 3 * k + 3) for k in range(n)) + "]")
    got = ocr.pages_from_segments(spark.createDataFrame([("d", answer)], "doc_id string, antwort string")).first().seiten[0].woerter
    assert len(got) == n and {w.text for w in got} == {"ab"}


def test_case_folders(spark, tmp_path):
    for folder, files in {"one": {"akte.json": '{"akte_id": "ZP-1", "stichtag": "2026-09-12", "sachverhalt": {"richtung": "x"}}', "b.pdf": "bb", "a.pdf": "a"}, "bare": {"a.pdf": "x"}, "deep/two": {"akte.json": "no json", "a.pdf": "x"}, "only": {"akte.json": '{"akte_id": "ZP-2"}'}}.items():
        (tmp_path / folder).mkdir(parents=True)
        for name, text in files.items():
            (tmp_path / folder / name).write_text(text, encoding="utf-8")
    got = sorted((r.ordner.rpartition("/")[2], r.datei or "", r.ord, r.akte_id, r.laenge, r.hinweis, r.stammdaten and r.stammdaten.sachverhalt and r.stammdaten.sachverhalt.richtung) for r in cases.read_case_folders(spark, str(tmp_path)).collect())
    assert got == [
        ("bare", "a.pdf", 0, None, 1, "keine Stammdaten im Ordner", None), ("one", "a.pdf", 0, "ZP-1", 1, None, "x"), ("one", "b.pdf", 1, "ZP-1", 2, None, "x"), ("only", "", 0, "ZP-2", None, "keine Dateien im Ordner", None), ("two", "a.pdf", 0, None, 1, "Stammdaten nicht lesbar", None),
    ]


def test_payloads(spark):
    p = json.dumps({"alerts": [{"fingerprint": "f", "status": "firing", "startsAt": "2024-01-01T00:00:00Z", "endsAt": "0001-01-01T00:00:00Z", "labels": {"alertname": "X"}}]})
    a = ocr.alert_rows(spark.createDataFrame([(p,)], "payload string")).first()
    assert (a.fingerprint, a.name, a.zustand, a.beendet_am) == ("f", "X", "firing", None) and a.begonnen_am.year == 2024
    e = ocr.error_rows(spark.createDataFrame([('{"workflow": {"name": "w"}, "secret": 1}',)], "ereignis string")).first()
    assert e.workflow_name == "w" and e.meldung == "unbekannt" and len(e) == 7


def test_layout_edges(spark):
    """Halves in decimal, a page in pixels, an unknown unit, words without a polygon, text or confidence; null where there is nothing."""
    word = lambda t, p, **c: {"content": t, "polygon": p} | c
    pages = [
        {"pageNumber": 3, "unit": "pixel", "width": 595, "height": 842, "words": [word(" a ", [1.005, 2.675, -1.005, None, 0.125, 8.0], confidence=-2), word("  ", [1.0, 1.0]), None, word("b", None), word("c", []), word("d", [1.0])]},
        {"unit": "pixel", "width": 0, "words": [word("e", [1.0, 2.0])]}, {"unit": "ell"}, None, {"words": []},
    ]
    rows = [("x", json.dumps({"analyzeResult": {"pages": pages}})), ("none", "{}"), ("bad", "no json"), ("null", None), ("empty", '{"analyzeResult": {"pages": []}}')]
    got = {r.doc_id: r.seiten for r in ocr.pages_from_layout(spark.createDataFrame(rows, "doc_id string, antwort string")).collect()}
    assert [(p.seite, p.woerter if p.woerter is None else [tuple(w) for w in p.woerter]) for p in got["x"]] == [
        (3, [(2.68, -1.01, 1.01, 8.0, "a", 0.0), (None, None, None, None, "b", 0.0), (None, None, None, None, "c", 0.0), (None, 1.0, 1.0, None, "d", 0.0)]),
        (2, [(None, None, None, None, "e", 0.0)]), (3, None), (4, None), (5, []),
    ]
    assert got["empty"] == [] and all(got[k] is None for k in ("none", "bad", "null"))


def test_batches_are_worked_on_in_parts(spark):
    words = pa.array([[{"w": [1] * n} for n in sizes] for sizes in ([3, 2], [], [9], [1], [1, 1])], pa.list_(pa.struct([("w", pa.list_(pa.int64()))])))
    batch = pa.RecordBatch.from_arrays([words], ["p"])
    assert sheets.sizes_within(words, "w").tolist() == [5, 0, 9, 1, 2] and sheets.sizes_within(words[1:4], "w").tolist() == [0, 9, 1]
    parts = list(sheets.in_parts(batch, sheets.sizes_within(words, "w"), 6))
    assert [p.num_rows for p in parts] == [2, 1, 2] and pa.Table.from_batches(parts).column("p").to_pylist() == words.to_pylist()


def test_pages_from_tokens(spark):
    rows = [(1, [("a", False, 2.0), ("b", None, 1.0), (None, True, None), ("c", False, 5.0)]), (2, []), (3, None), (4, [("", True, None), ("d", True, 7.0)])]
    pages = spark.createDataFrame(rows, "page int, m array<struct<t: string, u: boolean, x: double>>")
    marks = F.transform("m", lambda t: F.struct(t["t"].alias("text"), t["u"].alias("umbruch"), *[t["x"].alias(c) for c in ("x0", "top", "x1", "bottom", "conf")]))
    got = {r.page: [(w.text, w.x0, w.x1) for w in r.woerter] for r in ocr.pages_from_tokens(pages.select("page", marks.alias("marken"))).collect()}
    assert got == {1: [("ab", 1.0, 2.0), ("c", 5.0, 5.0)], 2: [], 3: [], 4: [("", None, None), ("d", 7.0, 7.0)]}
