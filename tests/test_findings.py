"""What a review found: work that was done more than once, tasks that read everything, and SQL that states another rule."""

from __future__ import annotations

from pathlib import Path

import duckdb
from pyspark.sql import functions as F

from tests import pages
from tests.test_casefile import FILES
from wharfline.functions.identifiers import container_ok
from wharfline.functions.steps import numbered_path
from wharfline.operators import casefile, decision, extraction, rules, sheets
from wharfline.plans import case_queries, mapping, ops_queries, paper_queries, stream_queries
from wharfline.sources.catalog import load_catalog

SMALL = "/root/testdata/sf0.001"


def test_values_are_worked_out_once(spark):
    catalog = load_catalog()
    assert str(container_ok(F.col("c"))).count("regexp_replace") == 1
    on = {r: str(rules.RULES[r](catalog, catalog.rule(r)).on) for r in ("CLS-01", "CUS-05", "QTY-01")}
    assert on["CLS-01"].count("filter(") == 2 and on["CUS-05"].count("filter(") == 2 and on["QTY-01"].count("filter(") == 2


def test_deliveries_are_written_and_read_in_parts(spark, tmp_path):
    spark.read.parquet(f"{SMALL}/lineitem.parquet").repartition(4).write.parquet(str(tmp_path / "lineitem.parquet"))
    before = set(Path(spark.conf.get("spark.checkpoint.dir")).glob("rechecked-*"))
    got = {tuple(r) for r in stream_queries.rechecked_cases(spark, str(tmp_path)).collect()}
    (folder,) = set(Path(spark.conf.get("spark.checkpoint.dir")).glob("rechecked-*")) - before
    assert all(len(list(d.glob("part-*"))) > 1 for d in folder.glob("in/*"))
    assert got == set(duckdb.sql(stream_queries.ORACLES["rechecked_cases"].replace("FROM lineitem", f"FROM '{SMALL}/lineitem.parquet'")).fetchall())


def test_classes_and_their_sql_read_the_text(spark, tmp_path):
    texts = [None, "", "bill of lading, port of loading", "A.TR und EUR. 1", "an\tinvoiceé draft", "Entwurf Packliste net weight", "copy only: B/L, mrn", "proforma b/l", "İnvoice no 7", "draftß export accompanying  document"]
    spark.createDataFrame([(7 * k + m, t) for m in range(7) for k, t in enumerate(texts)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(tuple(r) for r in ops_queries.classes(spark, str(tmp_path)).collect())
    assert got == sorted(duckdb.sql(ops_queries.CLASS_SQL.replace("FROM documents", f"FROM '{tmp_path}/documents.parquet/*.parquet'")).fetchall())
    assert len({r[1] for r in got}) > 6


def test_documents_are_had_without_their_values(spark):
    wide = [pages.page(["Commercial Invoice", [(0, "Seller"), (200, "Buyer")], [(0, "Muster GmbH"), (200, "Sample Inc.")]])]
    rows = [("A", 0, "i.pdf", "h0", None, wide, None), ("A", 1, "p.pdf", "h1", None, [pages.page(["Packing List", "Shipper: Lager Nord"])], None), ("A", 2, "l.pdf", "h2", None, [pages.page(["Dear all"])], None)]
    read = casefile.read_files(spark.createDataFrame(rows, FILES))
    documents = casefile.case_documents(casefile.numbered(read))
    assert [r.aussteller for r in documents.orderBy("ord").collect()] == ["Muster GmbH", "Lager Nord", None]
    plan = documents._jdf.queryExecution().optimizedPlan().toString()
    assert "rechnung.positionen" not in plan and "rechnung.kaeufer" not in plan
    lined = sheets.with_lines(spark.createDataFrame(rows, FILES))
    for typ in ("handelsrechnung", "packliste", "bill_of_lading", "abd", "proformarechnung"):
        both = lined.select(extraction.issuer(F.lit(typ), extraction.document_values(F.lit(typ), F.col("zeilen"))).alias("a"), extraction.issuer_of_lines(F.lit(typ), F.col("zeilen")).alias("b"))
        assert all(r.a == r.b for r in both.collect())


def test_notes_make_the_text_of_a_file_once(spark):
    """a condition on the note was pushed down to the lines as all features of all types, each with the text made anew."""
    files = casefile.numbered(casefile.read_files(spark.createDataFrame([("A", 0, "l.pdf", "h0", None, [pages.page(["Dear all"])], None)], FILES), values=False))
    plan = casefile.case_notes(files)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("array_join(") == 1 and plan.count("ausfuhrbegleitdokument") == 1


def test_values_and_declarations_come_of_one_reading(spark):
    """what invoices say and what their declarations say were two readings of all files."""
    files = casefile.numbered(casefile.read_files(spark.createDataFrame([("A", 0, "l.pdf", "h0", None, [pages.page(["Dear all"])], None)], FILES)))
    assert casefile.case_assertions(files)._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1


def test_audits_judge_what_overrides_name_once(spark):
    """a condition on the findings' size was pushed down as all rules, worked out a second time for all cases, whether they have overrides or not."""
    plan = case_queries.audit_query(spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert "Filter (size(transform(" not in plan and "LeftSemi" in plan
    cases, catalog, own = mapping.case_rows(spark, SMALL), load_catalog(), case_queries.overrides(spark, SMALL)
    rows = lambda overridden: sorted(map(str, decision.overridden_findings(decision.judge(cases, catalog, own, overridden)).collect()))
    assert rows(True) == rows(False) != []


def test_paths_of_items_are_no_concat(spark):
    """concat isn't compiled in a lambda and takes a lazy list for each call."""
    item = F.col("i")
    assert "concat" not in str(rules.item_involved("abd.positionen", item, "nr"))
    got = spark.createDataFrame([(7,), (None,)], "k int").select(numbered_path("a.b.#.c", F.col("k")).alias("p")).collect()
    assert [r.p for r in got] == ["a.b.7.c", None]


def test_words_come_back_once(spark):
    """F5, F7, F8: pages came back from Python with all their words, beside the lines with the same words."""
    page = (1, "ocr", [(0.0, 9.0, 12.0, 8.0, "b", 0.9), (0.0, 1.0, 4.0, 8.0, "a", 0.9), (9.0, 5.0, 8.0, 17.0, "d", 0.9), (11.0, 1.0, 4.0, 19.0, "c", 0.9)])
    pages_of = spark.createDataFrame([("d", [page, (2, "ocr", [])]), ("n", None)], f"doc_id string, seiten {sheets.PAGES}")
    both, lean = sheets.with_lines(pages_of), sheets.with_lines(pages_of, pages=False)
    assert lean.columns == ["doc_id", "zeilen"] and lean.orderBy("doc_id").collect() == both.drop("seiten").orderBy("doc_id").collect()
    assert [z.text for z in lean.where("doc_id = 'd'").first().zeilen] == ["a b", "c d"]
    assert "seiten" not in paper_queries._lined(spark, SMALL).columns
