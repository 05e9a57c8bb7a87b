from __future__ import annotations

import copy
import json
import random

import pytest
from pyspark.sql import functions as F

from tests.fixtures import CASES, case
from wharfline.operators import decision, facts, metrics, reasons, requests, rules
from wharfline.sources import cases as source
from wharfline.sources.catalog import condition, load_catalog

CATALOG = load_catalog()


@pytest.fixture(scope="module")
def load(spark, tmp_path_factory):
    def put(*found):
        folder = tmp_path_factory.mktemp("cases")
        for k, c in enumerate(found):
            (folder / f"{k}.json").write_text(json.dumps(c), encoding="utf-8")
        return source.read_cases(spark, str(folder))

    return put


def statuses(raw):
    return {(r.akte_id, r.regel): r for r in rules.findings(source.case_rows(raw), CATALOG).collect()}


def test_golden_cases(load):
    raw = load(*CASES)
    rows = source.case_rows(raw)
    found = decision.all_findings(rows, CATALOG)
    decided = decision.decide(found, source.case_table(raw))
    expected = source.case_table(raw).select("akte_id", "erwartung.*")
    quality = metrics.decision_quality(expected, decided, found).collect()
    assert len(quality) == 8 and all(r.korrekt for r in quality), [r for r in quality if not r.korrekt]


def test_each_rule_alone_agrees_with_the_joint_pass(load):
    rows = source.case_rows(load(*CASES))
    joint = {(r.akte_id, r.kennung): (r.status, r.haerte) for r in decision.all_findings(rows, CATALOG).where("art = 'regel'").collect()}
    assert joint == {(r.akte_id, r.regel): (r.status, r.haerte_effektiv) for r in rules.findings(rows, CATALOG).collect()}
    assert len(joint) == 8 * 14 and rules.not_implemented(rows.sparkSession, CATALOG).count() == 0


SAMPLES = [
    # change, confidence, rule, status, hardness
    ({"packliste.positionen.0.menge": 11}, {}, "QTY-01", "verletzt", "hard"),
    ({"packliste.positionen.0.menge": 11}, {"packliste.positionen.0.menge": 0.4}, "QTY-01", "re_extraction_required", "hard"),
    ({"packliste.positionen.0.menge": 11}, {"packliste.positionen.0.menge": 0.8}, "QTY-01", "verletzt", "hard"),
    ({"packliste.positionen.0.menge": 11}, {"rechnung.positionen.1.menge": 0.1}, "QTY-01", "verletzt", "hard"),
    ({"packliste.positionen.0.nr": 9}, {"rechnung.positionen.0.menge": 0.1}, "QTY-01", "verletzt", "hard"),
    ({"packliste.positionen.0.menge": 13, "packliste.backorders.0.nr": 1, "packliste.backorders.0.menge": 1}, {}, "QTY-01", "ok", "hard"),
    ({"bill_of_lading.brutto_kg": 1092}, {}, "QTY-02", "verletzt", "soft"),
    ({"bill_of_lading.brutto_kg": 1200}, {}, "QTY-02", "verletzt", "hard"),
    ({"bill_of_lading.brutto_kg": 1200}, {"bill_of_lading.brutto_kg": 0.5}, "QTY-02", "re_extraction_required", "soft"),
    ({"packliste.brutto_gesamt_kg": 0}, {}, "QTY-02", "verletzt", "hard"),
    ({"packliste.brutto_gesamt_kg": None}, {}, "QTY-03", "verletzt", "hard"),
    ({"packliste.packstuecke.0.netto_kg": 990}, {}, "QTY-03", "verletzt", "hard"),
    ({"rechnung.gesamt": 18420.01}, {}, "VAL-01", "ok", "hard"),
    ({"rechnung.gesamt": 18420.02}, {}, "VAL-01", "verletzt", "hard"),
    ({"rechnung.gesamt": 18420.02}, {"rechnung.rabatte": 0.1}, "VAL-01", "verletzt", "hard"),
    ({"rechnung.gesamt": None}, {}, "VAL-01", "nicht_pruefbar", "hard"),
    ({"praeferenznachweis.ursprungswert": None, "praeferenznachweis.rex_nummer": None}, {}, "ORG-06", "ok", "hard"),
    ({"praeferenznachweis.rex_nummer": "DEX1"}, {}, "ORG-06", "verletzt", "hard"),
    ({"rechnung.waehrung": "USD"}, {}, "ORG-06", "nicht_pruefbar", "hard"),
    ({"praeferenznachweis.typ": "atr"}, {}, "ORG-03", "verletzt", "hard"),
    ({"rechnung.positionen.0.hs6": "999999"}, {}, "CLS-01", "verletzt", "hard"),
    ({"rechnung.positionen.0.hs6": None}, {}, "CLS-01", "verletzt", "hard"),
    ({"packliste.positionen.0.hs6": None}, {}, "CLS-01", "ok", "hard"),
    ({"packliste.positionen.0.hs6": "84x"}, {}, "CLS-01", "verletzt", "hard"),
    ({"abd.container_id": "msku 123456-5"}, {}, "CUS-05", "ok", "hard"),
    ({"abd.positionen.0.warennummer": "unlesbar"}, {}, "CUS-05", "verletzt", "hard"),
    ({"abd.positionen.0.nr": 7}, {}, "CUS-05", "verletzt", "hard"),
    ({"bill_of_lading.container_id": "MSKU1234568"}, {}, "TRN-02", "verletzt", "hard"),
]


def test_rule_samples(load):
    raw = load(*[case(k + 1, change=c, konf=f) for k, (c, f, *_) in enumerate(SAMPLES)])
    got = statuses(raw)
    for k, (_, _, rule, status, hardness) in enumerate(SAMPLES):
        r = got[f"ZP-2026-{k + 1:04d}", rule]
        assert (r.status, r.haerte_effektiv) == (status, hardness), SAMPLES[k]


def test_facts_come_from_final_documents_and_the_last_assertion(load):
    c = copy.deepcopy(CASES[0])
    c["dokumente"].append({"id": "BOL-2", "typ": "bill_of_lading", "status": "draft"})
    c["assertions"] += [
        {"dokument": "BOL-2", "pfad": "bill_of_lading.brutto_kg", "wert": 1}, {"dokument": "NIX", "pfad": "abd.mrn", "wert": "x"},
        {"dokument": "BOL-1", "pfad": "bill_of_lading.brutto_kg", "wert": 1047},
    ]
    raw = load(c)
    docs, said = source.document_table(raw), source.assertion_table(raw)
    held = {r.pfad: r for r in facts.facts_long(said, docs).collect()}
    assert held["bill_of_lading.brutto_kg"].num == 1047 and held["bill_of_lading.brutto_kg"].konf == 1.0 and held["abd.mrn"].txt.startswith("26DE")
    assert facts.not_final(said, docs).count() == 1 and facts.orphans(said, docs).count() == 1
    assert facts.documents_by_type(docs, "bill_of_lading").count() == 2 and facts.documents_by_type(docs, "bill_of_lading", True).count() == 1
    assert source.stored_case(source.case_table(raw), docs, said).first().dokumente[0].dokument_id == "INV-1"


def test_no_rule_before_its_date(load):
    early = copy.deepcopy(CASES[3]) | {"stichtag": "2026-09-11"}
    rows = source.case_rows(load(early))
    assert rules.findings(rows, CATALOG).count() == 0 and decision.evidence(rows, CATALOG).count() == 7


def test_evidence_scope_and_source(load):
    other = copy.deepcopy(CASES[0])
    other["sachverhalt"]["verkehrstraeger"] = "air"
    wrong = copy.deepcopy(CASES[1]) | {"akte_id": "W"}
    wrong["dokumente"][2]["typ"] = "handelsrechnung"
    got = {(r.akte_id, r.id): r.status for r in decision.evidence(source.case_rows(load(other, wrong)), CATALOG).collect()}
    assert len(got) == 7 and got["W", "PFL-04"] == "falscher_nachweis" and got["W", "PFL-05"] == "fehlt"
    assert condition("a.b == true") == ("a.b", True)
    with pytest.raises(ValueError):
        condition("a > b")


def test_overrides(load):
    o = lambda **x: {"regel": "TRN-01", "benutzer": "u", "begruendung": "x" * 11, "fassung": "0.1.0@2026-09-12"} | x
    found = [copy.deepcopy(CASES[3]) | {"akte_id": k, "overrides": v} for k, v in {"a": [o()], "b": [o(begruendung=" " + "x" * 10 + " ")], "c": [o(fassung="0")], "d": [o(benutzer="first"), o(benutzer="second")], "e": []}.items()]
    raw = load(*found)
    marked = decision.attach_overrides(decision.all_findings(source.case_rows(raw), CATALOG), source.override_table(raw))
    decided = {r.akte_id: r for r in decision.decide(marked, source.case_table(raw)).collect()}
    assert all(r.freigabe == "blockiert" for r in decided.values())
    assert {k: r.freigabe_nach_override for k, r in decided.items()} == {"a": "freigabereif", "b": "blockiert", "c": "blockiert", "d": "freigabereif", "e": "blockiert"}
    audit = sorted((r.akte_id, r.wirkung, r.benutzer) for r in decision.override_audit(marked).collect())
    assert audit == [("a", "angewandt", "u"), ("b", "verbraucht", "u"), ("c", "verbraucht", "u"), ("d", "angewandt", "first"), ("d", "verbraucht", "second")]


def test_requests_reconciliation_and_escalation(spark, load):
    raw = load(*CASES)
    rows = source.case_rows(raw)
    made = requests.formulate(rules.findings(rows, CATALOG), decision.evidence(rows, CATALOG), rows, CATALOG)
    got = {(r.akte_id[-1], r.grund): r for r in made.collect()}
    assert got["2", "PFL-05"].adressat == "Exporteur/Lieferant" and got["6", "TRN-01"].adressat == "Extraktion (Nachlesen)"
    assert got["4", "TRN-01"].feld == "bill_of_lading.container_id" and "Container HLXU8765430" in got["4", "TRN-01"].text
    assert got["5", "REF-03"].feld == "REF-03" and got["5", "REF-03"].adressat == "Sachbearbeitung Export"
    now = F.lit("2026-09-13 16:00:00").cast("timestamp")
    held = [("ZP-2026-0002", "PFL-05", "praeferenznachweis.ursprung", "erinnerung_0", "2026-09-11 00:00:00"), ("ZP-2026-0002", "VAL-01", "rechnung.gesamt", "stop", None), ("ZP-2026-0002", "ORG-02", "praeferenznachweis.ursprung", "erinnerung_0", "2026-09-13 00:00:00")]
    open_ = spark.createDataFrame(held, "akte_id string, grund string, feld string, stufe string, letzter_versand_am string").withColumns(
        {"letzter_versand_am": F.col("letzter_versand_am").cast("timestamp"), "eroeffnet_am": F.lit("2026-09-10").cast("timestamp"), **{c: F.lit("alt") for c in ("betreff", "text", "adressat", "adressat_kopie")}}
    )
    both = requests.reconcile(open_, made, now)
    action = {(r.akte_id[-1], r.grund): r for r in both.collect()}
    assert action["2", "PFL-05"].aktion == "behalten" and action["2", "PFL-05"].stufe == "erinnerung_0" and action["2", "PFL-05"].text != "alt"
    assert action["2", "VAL-01"].aktion == "schliessen" and action["4", "TRN-01"].aktion == "eroeffnen"
    deadlines = source.case_table(raw).select("akte_id", "customs_cutoff", "carrier_cutoff", "eta")
    due = requests.due_stage(both.where("status = 'offen'"), deadlines, CATALOG, now)
    plan = {(r.akte_id[-1], r.grund): r for r in due.collect()}
    assert plan["2", "PFL-05"].faellig and plan["2", "PFL-05"].neue_stufe == "erinnerung_1"
    assert not plan["2", "ORG-02"].faellig and plan["2", "ORG-02"].grund_text == "Mindestabstand"
    assert plan["4", "TRN-01"].neue_stufe == "erinnerung_0" and plan["4", "TRN-01"].faellig
    sent = {(r.akte_id[-1], r.grund): r for r in requests.dispatch_plan(due, CATALOG).collect()}
    assert sent["4", "TRN-01"].an == ["spediteur@example.test", "sachbearbeitung@example.test"] and sent["4", "TRN-01"].betreff.startswith("[erinnerung_0] ACTION REQUIRED")
    early = requests.due_stage(open_.limit(1), deadlines, CATALOG, F.lit("2026-09-12 10:00:00").cast("timestamp")).first()
    assert not early.faellig and early.grund_text == "noch nicht"


def test_reasons_and_contradictions(load):
    rows = source.case_rows(load(*CASES))
    why = {(r.akte_id[-1], r.regel): r for r in reasons.explained(rows, CATALOG).collect()}
    plain = {(r.akte_id[-1], r.regel): r.status for r in rules.findings(rows, CATALOG).collect()}
    assert {k: r.status for k, r in why.items()} == plain and set(reasons.REASONS) == set(rules.RULES)
    assert all(r.begruendung and "undefined" not in r.begruendung for r in why.values())
    total = why["1", "VAL-01"]
    assert total.begruendung == f"Summe {total.eingaben['berechnet']} entspricht Endbetrag {total.eingaben['rechnung.gesamt']}" and "E" not in total.eingaben["berechnet"]
    assert json.loads(total.eingaben["rechnung.positionen"])[0]["nr"] == 1
    bl, pack = (why["4", "TRN-01"].eingaben[p] for p in ("bill_of_lading.container_id", "packliste.container_id"))
    assert why["4", "TRN-01"].begruendung.startswith("B/L nennt ") and bl != pack
    assert why["6", "TRN-01"].begruendung.endswith(", aber Konfidenz unter 0.8: zuerst nachlesen")
    made = {(r.akte_id[-1], r.grund): r for r in requests.formulate(reasons.explained(rows, CATALOG), decision.evidence(rows, CATALOG), rows, CATALOG).collect()}
    request = made["4", "TRN-01"]
    assert request.widerspruch == why["4", "TRN-01"].begruendung and request.stufe == "erinnerung_0"
    assert f"\n\nBenötigt:\n- Dokument/Feld: {request.feld}\n" in request.text and f"\n- Gefundener Widerspruch: {request.widerspruch}\n- Akzeptierte Nachweise: " in request.text
    assert made["2", "PFL-05"].widerspruch.endswith(": kein Nachweis in der Akte")


def test_reply_is_merged_once(spark):
    docs = spark.createDataFrame([("a", "INV-1", "h1"), ("a", "PAC-1-E1", "h2")], "akte_id string, dokument_id string, hash string")
    said = spark.createDataFrame([("a", "INV-1", "p", "1")], "akte_id string, dokument string, pfad string, txt string")
    new = spark.createDataFrame([("a", "INV-1", "h1"), ("a", "BOL-1", "h3"), ("a", "X-1", None)], "akte_id string, dokument_id string, hash string")
    more = spark.createDataFrame([("a", "INV-1", "p", "2"), ("a", "BOL-1", "q", "3")], "akte_id string, dokument string, pfad string, txt string")
    d, s = source.merge_reply(docs, said, new, more)
    assert sorted(r.dokument_id for r in d.collect()) == ["BOL-1-E2", "INV-1", "PAC-1-E1", "X-1-E2"]
    assert sorted((r.dokument, r.txt) for r in s.collect()) == [("BOL-1-E2", "3"), ("INV-1", "1")]


def test_append_with_two_unique_keys(spark, tmp_path):
    """As inserts one after the other: a row that stays out keeps nobody out, nulls share nothing, and chains are as long as they are."""
    rng = random.Random(3)
    pick = lambda n: rng.choice([None, *[f"v{k}" for k in range(n)]])
    rows = [(f"c{rng.randrange(6)}", pick(9), pick(9), k) for k in range(400)] + [("chain", f"d{k // 2}", f"h{(k + 1) // 2}", 1000 + k) for k in range(12)]
    stored = [("c0", "v1", None, -1), ("c1", "v2", "v3", -2)]
    docs, hashes, want = {(c, d) for c, d, _, _ in stored if d}, {(c, h) for c, _, h, _ in stored if h}, []
    for c, d, h, k in rows:
        if (d is None or (c, d) not in docs) and (h is None or (c, h) not in hashes):
            want.append((c, d, h, k))
            docs |= {(c, d)} if d else set()
            hashes |= {(c, h)} if h else set()
    schema = "akte_id string, dokument_id string, hash string, ord int"
    keys = [["akte_id", "dokument_id"], ["akte_id", "hash"]]
    got = metrics.append_unique(spark.createDataFrame(rows, schema).repartition(3), spark.createDataFrame(stored, schema), keys, ["ord"], str(tmp_path / "rounds"))
    assert sorted(map(tuple, got.collect()), key=lambda r: r[3]) == want
    assert metrics.append_unique(spark.createDataFrame([], schema), spark.createDataFrame(stored, schema), keys, ["ord"], str(tmp_path / "none")).count() == 0


def test_joins_of_facts_and_deadlines_stay_spread_over_all_cores(spark):
    ids = spark.range(40).select(F.col("id").alias("akte_id"))
    asked = ids.select("akte_id", F.lit(None).cast("string").alias("stufe"), F.lit(None).cast("timestamp").alias("letzter_versand_am"))
    deadlines = ids.select("akte_id", *[F.lit("2026-09-13 10:00:00").cast("timestamp").alias(c) for c in ("customs_cutoff", "carrier_cutoff", "eta")])
    due = requests.due_stage(asked, deadlines, load_catalog(), F.lit("2026-09-13 10:00:00").cast("timestamp"))
    value = {"txt": F.lit(None).cast("string"), "num": F.lit(1.0), "bool": F.lit(None).cast("boolean"), "kind": F.lit("num"), "konfidenz": F.lit(0.9), "seite": F.lit(1), "methode": F.lit("m"), "ord": F.lit(1)}
    said = ids.select("akte_id", F.concat(F.lit("A"), "akte_id").alias("dokument"), F.concat(F.lit("abd."), "akte_id").alias("pfad")).withColumns(value)
    papers = ids.select("akte_id", F.concat(F.lit("A"), "akte_id").alias("dokument_id"), F.lit("abd").alias("typ"), F.lit("final").alias("status"))
    least = 4 * spark.sparkContext.defaultParallelism  # adaptive execution leaves one task of so few rows
    for found in (due, facts.facts_long(said, papers)):
        assert found.count() == 40 and found.rdd.getNumPartitions() >= least
