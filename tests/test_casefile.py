"""Documents as rows and cases from their files: geometry at its edges, every way a file can go, and the eight cases read from pages."""

from __future__ import annotations

import time

import pytest
from pyspark.sql import functions as F

from tests import pages
from tests.fixtures import CASES
from wharfline.operators import casefile, decision, facts, metrics, sheets
from wharfline.sources.catalog import load_catalog

WORDS = "array<struct<top: double, x0: double, x1: double, bottom: double, text: string, conf: double>>"
PAGES = f"array<struct<seite: int, methode: string, woerter: {WORDS}>>"
FILES = f"akte_id string, ord int, datei string, hash string, xml string, seiten {PAGES}, fehler string"


def lined(spark, **documents):
    return sheets.with_lines(spark.createDataFrame(list(documents.items()), f"doc_id string, seiten {PAGES}"))


def test_lines_of_documents(spark):
    wavering = (1, "ocr", [(10.0, 40.0, 50.0, 18.0, "b", 0.9), (12.9, 0.0, 20.0, 20.0, "a", 0.8), (13.1, 0.0, 9.0, 22.0, "c", 0.7), (30.0, 0.0, 9.0, 41.0, "d", 1.0)])
    got = {r.doc_id: r.zeilen for r in lined(spark, two=[wavering, (2, "textebene", []), (3, "ocr", [(1.0, 0.0, 5.0, 9.0, "e", 1.0)])], none=None, bare=[]).collect()}
    assert [(z.seite, z.methode, z.text, round(z.luecke, 3), round(z.hoehe, 3)) for z in got["two"]] == [(1, "ocr", "a b", 0.0, 1.0), (1, "ocr", "c", -6.9, 10.0), (1, "ocr", "d", 8.0, 8.9), (3, "ocr", "e", 0.0, 1.0)]
    assert got["none"] == [] and got["bare"] == []


def test_long_pages_are_read_in_linear_time(spark):
    took = []
    for n in (20_000, 100_000):
        words = spark.range(n).select(F.lit("d").alias("doc_id"), F.lit(1).alias("page"), F.when(F.col("id") % 7 == 3, ".").otherwise(F.col("id").cast("string")).alias("text"), (F.col("id") % 20 * 30.0).alias("x0"), F.floor(F.col("id") / 20).cast("double").alias("z"), F.col("id").cast("int").alias("word_no"))
        words = words.select("doc_id", "page", "word_no", "text", "x0", (F.col("z") * 12 + F.col("word_no") % 3).alias("top"), (F.col("x0") + 26).alias("x1"), (F.col("z") * 12 + 9).alias("bottom"), F.lit(0.9).alias("conf"))
        began = time.time()
        assert sheets.lines_by_anchor(words).agg(F.count("*"), F.sum(F.size("words"))).first() == (n // 20, n)
        marks = sum(k % 7 == 3 and k % 20 > 0 for k in range(n))
        assert sheets.glue_marks(words).count() == n - marks
        took.append(time.time() - began)
    assert took[1] < 15 * max(took[0], 0.5)


def test_marks_join_what_has_grown(spark):
    row = lambda k, text, x0, x1, top=0.0, conf=0.9: ("d", 1, k, text, x0, top, x1, top + 8, conf)
    rows = [row(0, "a", 0.0, 5.0), row(1, ")", 6.0, 8.0, 1.0, 0.5), row(2, ".", 13.9, 15.0), row(3, ",", 22.0, 23.0), row(4, "!", 22.5, 24.0, 6.0), row(5, "-", 24.0, 25.0, 6.0), row(6, "b", 30.0, 31.0)]
    words = spark.createDataFrame([*rows, ("e", 1, 0, ".", 0.0, 0.0, 1.0, 8.0, 0.9)], "doc_id string, page int, word_no int, text string, x0 double, top double, x1 double, bottom double, conf double")
    got = sheets.glue_marks(words).orderBy("doc_id", "word_no").collect()
    assert [(r.text, r.x1, r.conf) for r in got] == [("a).", 15.0, 0.5), (",", 23.0, 0.9), ("!-", 25.0, 0.9), ("b", 31.0, 0.9), (".", 1.0, 0.9)]


def value(spark, label, *lines):
    f = lined(spark, d=[pages.page(list(lines))]).select(sheets.value_after_label(F.col("zeilen"), label).alias("f")).first().f
    return f and " ".join(w.text for w in f.woerter)


def test_values_and_labels(spark):
    assert value(spark, "total", "Subtotal 5", "Total: 99 EUR") == "99 EUR"
    assert value(spark, "container", [(0, "Container : MSKU 1"), (200, "Seal 5")]) == "MSKU 1"
    assert value(spark, "date", "Date:", "8.9.2026 here", "Date: 1.1.2020") == "8.9.2026 here"  # the line below counts before a later label
    assert value(spark, "date", [(100, "Date")], [(0, "left")], "Date: 1.1.2020") is None  # nothing below it, and later lines don't count
    assert value(spark, "date", "no such thing") is None
    assert value(spark, "a|bb", "x bb: 7") == "7"


def test_blocks_in_columns(spark):
    block = lambda label, *lines: [" ".join(w.text for w in f.woerter) for f in lined(spark, d=[pages.page(list(lines))]).select(sheets.block_below_label(F.col("zeilen"), label).alias("f")).first().f]
    two = ([(0, "Seller"), (200, "Buyer")], [(0, "Muster GmbH"), (200, "Sample Inc.")], [(0, "Hamburg"), (200, "Boston")], [(200, "United States")], 30, "far away")
    assert block("seller", *two) == ["Muster GmbH", "Hamburg"]
    assert block("buyer", *two) == ["Sample Inc.", "Boston", "United States"]
    assert block("seller", [(0, "Seller: Muster"), (45, "GmbH")], "Hamburg") == ["Muster GmbH", "Hamburg"]
    assert block("seller", "Seller", *[f"line {k}" for k in range(12)]) == [f"line {k}" for k in range(8)]
    assert block("shipper", *two) == []


def test_tables_end_and_continue(spark):
    patterns = {"nr": r"\bpos\b", "text": r"\bdescription\b", "menge": r"\bqty\b"}
    cells = lambda *lines: {(c.zeile, c.spalte): " ".join(w.text for w in c.woerter) for c in lined(spark, d=[pages.page(list(lines))]).select(sheets.table_cells(F.col("zeilen"), patterns, r"^\s*total", "nr").alias("c")).first().c}
    head = [(0, "Pos"), (60, "Description"), (200, "Qty")]
    assert cells("x", head, [(0, "1"), (60, "blue"), (200, "5")], [(60, "pump")], [(0, "2"), (200, "7")], "Total 12", [(0, "9")]) == {(0, "nr"): "1", (0, "text"): "blue pump", (0, "menge"): "5", (1, "nr"): "2", (1, "menge"): "7"}
    assert cells(head, [(60, "without a number")], [(0, "1")], 40, [(0, "2")]) == {(0, "text"): "without a number", (1, "nr"): "1"}
    assert cells("Pos alone", "nothing") == {} and cells(head) == {}


def files_of(case):
    """The files of a case of the fixtures, as pages."""
    by = {}
    for a in case["assertions"]:
        by.setdefault(a["dokument"], {})[a["pfad"]] = a["wert"]
    status = {d["id"]: d["status"] for d in case["dokumente"]}
    unsure = {a["pfad"] for a in case["assertions"] if a["konfidenz"] < 0.8}
    made = [("INV-1", lambda f: pages.invoice(f, "URS-1" in by)), ("PAC-1", lambda f: pages.packing_list(f, unsure)), ("BOL-1", lambda f: pages.bill_of_lading(f, status["BOL-1"] == "draft")), ("ABD-1", pages.export_document)]
    return [(case["akte_id"], k, f"{d}.pdf", f"h{k}", None, make(by[d]), None) for k, (d, make) in enumerate(made) if d in by]


@pytest.fixture(scope="module")
def assembled(spark):
    rows = [f for c in CASES for f in files_of(c)]
    return casefile.numbered(casefile.read_files(spark.createDataFrame(rows, FILES))).cache()


def test_cases_are_read_from_pages(spark, assembled):
    """All that the fixtures' documents say is read again, and every decision is the same."""
    documents = casefile.case_documents(assembled)
    got = {(r.akte_id, r.pfad): (r.txt if r.num is None else r.num) if r.bool is None else r.bool for r in casefile.case_assertions(assembled).collect()}
    for case in CASES:
        for a in case["assertions"]:
            if a["wert"] is not None:
                assert got.get((case["akte_id"], a["pfad"])) == a["wert"], (case["akte_id"], a["pfad"])
    first = {k[1]: v for k, v in got.items() if k[0] == CASES[0]["akte_id"]}
    assert (first["rechnung.verkaeufer.name"], first["rechnung.verkaeufer.land"], first["rechnung.verkaeufer.eori"], first["rechnung.kaeufer.name"], first["rechnung.kaeufer.land"]) == ("Muster Maschinen GmbH", "DE", "DE123456789012345", "Sample Import Inc.", "US")
    assert (first["rechnung.datum"], first["rechnung.positionen.0.beschreibung"], first["abd.ausfuehrer.eori"], first["bill_of_lading.seal"]) == ("2026-09-08", "Pump housing stainless", "DE123456789012345", "ML-1")
    numbered = documents.withColumns({"n": F.col("ord") * 10 + F.col("teil")}).select("akte_id", F.col("n").alias("ord"), "dokument_id", "typ", "status")
    said = casefile.case_assertions(assembled).withColumn("ord", F.col("ord") * 1000 + F.col("teil") * 500 + F.col("platz"))
    master = spark.createDataFrame([(c["akte_id"], c["stichtag"], c["sachverhalt"], c["anmeldung"]) for c in CASES], "akte_id string, stichtag string, sachverhalt struct<richtung: string, verkehrstraeger: string, praeferenz_beansprucht: boolean, incoterm: struct<code: string, named_place: string, named_place_unlocode: string, edition: int>, route: struct<pol: string, pod: string>>, anmeldung struct<richtung: string, warennummern: array<string>>")
    rows = facts.case_rows(master.withColumn("stichtag", F.col("stichtag").cast("date")), facts.facts_long(said, numbered), numbered, facts.not_final(said, numbered))
    found = decision.all_findings(rows, load_catalog())
    expected = spark.createDataFrame([(c["akte_id"], c["erwartung"]["freigabe"], c["erwartung"]["regeln"], c["erwartung"]["pflicht"]) for c in CASES], "akte_id string, freigabe string, regeln array<string>, pflicht array<string>")
    quality = metrics.decision_quality(expected, decision.decide(found, master), found).collect()
    assert len(quality) == 8 and all(r.korrekt for r in quality), [r for r in quality if not r.korrekt]


def test_documents_and_what_carries_them(assembled):
    first = [r for r in casefile.case_documents(assembled).orderBy("ord", "teil").collect() if r.akte_id == CASES[0]["akte_id"]]
    assert [(r.dokument_id, r.typ, r.status, r.traeger, r.aussteller) for r in first] == [
        ("INV-1", "handelsrechnung", "final", None, "Muster Maschinen GmbH"), ("UE-1", "origin_declaration", "final", "INV-1", "Muster Maschinen GmbH"), ("PL-1", "packliste", "final", None, "Muster Maschinen GmbH"),
        ("BL-1", "bill_of_lading", "final", None, "Sea Line"), ("ABD-1", "abd", "final", None, "Muster Maschinen GmbH"),
    ]
    value = next(r for r in casefile.case_assertions(assembled).where("pfad = 'praeferenznachweis.ursprungswert'").collect() if r.akte_id == CASES[0]["akte_id"])
    assert (value.dokument, value.num, value.methode, value.konfidenz, value.bbox) == ("UE-1", 18420.0, "abgeleitet", 0.99, None) and value.herleitung.startswith("Summe")
    drafts = {r.akte_id for r in casefile.case_documents(assembled).where("status = 'draft'").collect()}
    assert drafts == {CASES[4]["akte_id"]}


def test_no_file_is_lost(spark):
    xml = "<rsm:CrossIndustryInvoice xmlns:rsm='r' xmlns:ram='a'><rsm:ExchangedDocument><ram:ID>R-9</ram:ID><ram:TypeCode>{}</ram:TypeCode></rsm:ExchangedDocument></rsm:CrossIndustryInvoice>"
    letter = [pages.page(["Dear all,", "kind regards"])]
    draft = [pages.page(["PRO FORMA INVOICE", "Entwurf", "The exporter of the products covered by this document", "declares that these are of Community preferential origin"])]
    rows = [
        ("A", 0, "r.xml", "h0", xml.format("380"), None, None), ("A", 1, "p.xml", "h1", xml.format("325"), None, None), ("A", 2, "odd.xml", "h2", xml.format("999"), None, None), ("A", 3, "broken.xml", "h3", "<rsm:CrossIndustryInvoice><a>", None, None),
        ("A", 4, "letter.pdf", "h4", None, letter, None), ("A", 5, "scan.pdf", "h5", None, [(1, "ocr", []), *letter, (3, "ocr", [])], None), ("A", 6, "bad.pdf", "h6", None, None, "kein lesbares PDF: no header"), ("A", 7, "none.pdf", "h7", None, None, None),
        ("A", 8, "blank.pdf", "h8", None, [], None), ("B", 0, "pro.pdf", "h9", None, draft, None), ("B", 1, "atr.pdf", "h10", None, [pages.page(["A.TR movement certificate"])], None), (None, 0, "lost.pdf", None, None, letter, None),
    ]
    files = casefile.numbered(casefile.read_files(spark.createDataFrame(rows, FILES)))
    got = {(r.akte_id, r.dokument_id): r for r in casefile.case_documents(files).collect()}
    assert {k for k in got if k[0] == "A"} == {("A", x) for x in ("INV-1", "INV-2", "PRO-1", "UNK-1", "UNK-2", "UNK-3", "UNK-4", "UNK-5", "UNK-6")} and (None, "UNK-1") in got
    assert (got["A", "INV-2"].hinweis, got["A", "UNK-1"].hinweis) == ("TypeCode unbekannt: 999", casefile.NO_XML)
    assert got["A", "UNK-3"].hinweis == "Seite(n) 1, 3 ohne lesbaren Text (OCR abgeschaltet oder leer); Belegtyp nicht erkannt; bleibt an der Akte und wird gemeldet"
    assert (got["A", "UNK-4"].hinweis, got["A", "UNK-5"].hinweis, got["A", "UNK-3"].n_seiten, got["A", "INV-1"].n_seiten) == ("kein lesbares PDF: no header", casefile.NO_READING, 3, None)
    assert (got["B", "PRO-1"].status, got["B", "UE-1"].status, got["B", "UE-1"].traeger) == ("draft", "draft", "PRO-1")
    assert got["B", "EUR1-1" if ("B", "EUR1-1") in got else "ATR-1"].hinweis.endswith("erkannt, aber kein Extraktor vorhanden")
    notes = sorted((r.akte_id or "", r.ord, r.notiz) for r in casefile.case_notes(files).collect())
    assert notes == [
        ("", 0, "lost.pdf: Belegtyp nicht erkannt"), ("A", 3, f"broken.xml: {casefile.NO_XML}"), ("A", 4, "letter.pdf: Belegtyp nicht erkannt"), ("A", 5, "scan.pdf: Belegtyp nicht erkannt"), ("A", 6, "bad.pdf: kein lesbares PDF"),
        ("A", 7, f"none.pdf: {casefile.NO_READING}"), ("A", 8, "blank.pdf: Belegtyp nicht erkannt"),
    ]
    said = {(r.dokument, r.pfad): (r.roh, r.txt, r.kind, r.konfidenz) for r in casefile.case_assertions(files).where("akte_id <> 'X' or akte_id is null").collect()}
    assert said["INV-1", "rechnung.nummer"] == ("R-9", "R-9", "txt", 1.0)
    assert said["UE-1", "praeferenznachweis.ursprung"] == ("Community", None, "null", 0.99)


def test_no_files(spark):
    files = casefile.numbered(casefile.read_files(spark.createDataFrame([], FILES)))
    assert [f(files).count() for f in (casefile.case_documents, casefile.case_assertions, casefile.case_notes)] == [0, 0, 0]
