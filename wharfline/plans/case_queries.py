"""Rule, evidence, decision and request queries over the derived cases, with SQL for the same rows."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wharfline.operators import decision, reasons, requests, rules
from wharfline.plans import mapping
from wharfline.sources.catalog import load_catalog

#: rule -> (joins to cases c and heads h, cannot be checked, violated, rests on an uncertain value)
RULE_SQL = {
    "VAL-01": (
        "LEFT JOIN (SELECT akte_id, sum(netto) AS s, min(konf) AS k FROM lines GROUP BY akte_id) x ON x.akte_id = c.akte_id",
        "h.n_lines IS NULL", "abs(x.s + h.zuschlaege - h.rabatte - h.gesamt) > 0.010000001", "h.konf < 0.8 OR x.k < 0.8",
    ),
    "VAL-03": (
        "LEFT JOIN (SELECT akte_id, min(konf) AS k FROM lines WHERE einzelpreis = 0 AND zollwert IS NULL AND methode IS NULL GROUP BY akte_id) x ON x.akte_id = c.akte_id",
        "h.n_lines IS NULL", "x.akte_id IS NOT NULL", "x.k < 0.8",
    ),
    "ORG-02": (
        """LEFT JOIN (SELECT l.akte_id, min(CASE WHEN s.akte_id IS NULL THEN l.hs_konf ELSE 1 END) AS k FROM lines l
           LEFT JOIN (SELECT DISTINCT akte_id, hs6 FROM scope) s ON s.akte_id = l.akte_id AND s.hs6 = l.hs6
           WHERE s.akte_id IS NULL OR l.ursprung <> 'DE' GROUP BY l.akte_id) x ON x.akte_id = c.akte_id""",
        "c.praeferenz AND (h.n_lines IS NULL OR h.nachweis_ursprung IS NULL)", "c.praeferenz AND x.akte_id IS NOT NULL", "x.k < 0.8",
    ),
    "ORG-03": ("", "FALSE", "h.nachweis_typ = 'atr' OR (c.praeferenz AND c.akte_id % 17 = 0 AND h.nachweis_typ IS NULL)", "FALSE"),
    "ORG-06": (
        "", "h.nachweis_typ = 'origin_declaration' AND (h.gesamt IS NULL OR h.waehrung <> 'EUR')",
        "h.nachweis_typ = 'origin_declaration' AND h.gesamt > 6000 AND NOT coalesce(h.rex LIKE 'DEREX%', FALSE) AND NOT h.ermaechtigt", "h.konf < 0.8",
    ),
    "CLS-01": (
        """LEFT JOIN (SELECT l.akte_id, min(l.hs_konf) AS k FROM lines l
           LEFT JOIN packing p ON p.akte_id = l.akte_id AND p.nr = l.nr LEFT JOIN scope s ON s.akte_id = l.akte_id AND s.pos = l.nr
           WHERE p.hs6 <> l.hs6 OR s.hs6 <> l.hs6 GROUP BY l.akte_id) x ON x.akte_id = c.akte_id""",
        "h.n_lines IS NULL", "x.akte_id IS NOT NULL", "x.k < 0.8",
    ),
    "CLS-02": (
        "", "c.anm_richtung IS NULL OR h.n_lines IS NULL OR c.anm_richtung = 'transit'",
        "c.anm_richtung = 'import_de' OR c.akte_id % 31 = 0", "FALSE",
    ),
    "QTY-01": (
        """LEFT JOIN (SELECT l.akte_id, min(CASE WHEN p.akte_id IS NULL THEN 1 ELSE l.konf END) AS k FROM lines l
           LEFT JOIN packing p ON p.akte_id = l.akte_id AND p.nr = l.nr
           WHERE p.akte_id IS NULL OR l.menge <> p.menge - coalesce(p.offen, 0) GROUP BY l.akte_id) x ON x.akte_id = c.akte_id""",
        "h.n_lines IS NULL OR h.brutto_summe IS NULL", "x.akte_id IS NOT NULL", "x.k < 0.8",
    ),
    "QTY-02": (
        "", "h.brutto_gesamt IS NULL OR h.bl_brutto IS NULL",
        "abs(h.brutto_gesamt - h.bl_brutto) > greatest(CAST(2 AS DOUBLE), 0.01E0 * h.brutto_gesamt)", "h.konf < 0.8",
    ),
    "QTY-03": (
        """LEFT JOIN (SELECT akte_id, min(konf) AS k, min(CASE WHEN brutto_kg < netto_kg THEN konf END) AS swapped, sum(brutto_kg) AS s FROM packing GROUP BY akte_id) x ON x.akte_id = c.akte_id""",
        "h.brutto_summe IS NULL", "x.swapped IS NOT NULL OR x.s > h.brutto_gesamt", "x.swapped < 0.8 OR (x.s > h.brutto_gesamt AND x.k < 0.8)",
    ),
    "TRN-01": ("", "h.bl_container IS NULL", "h.bl_container <> h.pack_container", "h.konf < 0.8"),
    "TRN-02": (
        "", "FALSE", "c.akte_id % 37 = 0 AND (h.bl_container IS NOT NULL OR c.akte_id % 33 <> 0)",
        "h.bl_container IS NOT NULL AND h.konf < 0.8",
    ),
    "REF-03": ("", "FALSE", "c.akte_id % 29 = 0", "FALSE"),
    "CUS-05": (
        """LEFT JOIN (SELECT l.akte_id, min(CASE WHEN d.akte_id IS NULL THEN 1 ELSE least(l.hs_konf, d.hs_konf) END) AS k FROM lines l
           LEFT JOIN declared d ON d.akte_id = l.akte_id AND d.nr = l.nr
           WHERE d.akte_id IS NULL OR substr(d.warennummer, 1, 6) <> l.hs6 GROUP BY l.akte_id) x ON x.akte_id = c.akte_id""",
        "h.n_lines IS NULL", "x.akte_id IS NOT NULL OR h.abd_container <> h.pack_container", "x.k < 0.8",
    ),
}
HARDNESS = {"QTY-02": "CASE WHEN status = 'verletzt' AND abs(brutto_gesamt - bl_brutto) / brutto_gesamt >= 0.1E0 THEN 'hard' ELSE 'soft' END"}


def rule_select(rule: str) -> str:
    joins, gap, bad, unsure = RULE_SQL[rule]
    return f"""SELECT akte_id, '{rule}' AS regel, status, {HARDNESS.get(rule, "'hard'")} AS haerte_effektiv FROM (
  SELECT c.akte_id, h.brutto_gesamt, h.bl_brutto, CASE WHEN {gap} THEN 'nicht_pruefbar' WHEN NOT coalesce({bad}, FALSE) THEN 'ok'
         WHEN coalesce({unsure}, FALSE) THEN 're_extraction_required' ELSE 'verletzt' END AS status
  FROM cases c JOIN heads h ON h.akte_id = c.akte_id {joins} WHERE c.tag >= 0) r"""


def _entry(k: str, value: str, hardness: str = "hard") -> str:
    return f"""SELECT c.akte_id, '{k}' AS id, CASE WHEN {value} IS NULL THEN 'fehlt' ELSE 'ok' END AS status, '{hardness}' AS haerte
  FROM cases c JOIN heads h ON h.akte_id = c.akte_id WHERE c.richtung = 'export_third_country' AND c.verkehrstraeger = 'sea' AND c.praeferenz"""


EVIDENCE_SQL = "\nUNION ALL ".join(
    [
        _entry("PFL-01", "h.gesamt"), _entry("PFL-02", "h.n_lines"), _entry("PFL-03", "h.brutto_gesamt"), _entry("PFL-04", "h.bl_container"),
        _entry("PFL-05", "h.nachweis_ursprung"), _entry("PFL-07", "c.akte_id"), _entry("PFL-06", "c.incoterm", "soft"),
    ]
)
RULES_SQL = "\nUNION ALL ".join(map(rule_select, RULE_SQL))
#: Overrides derived from the cases: some of the version in force, some of an older one, some with too short a reason.
OVERRIDES_SQL = """
SELECT akte_id, CASE akte_id % 3 WHEN 0 THEN 'QTY-01' WHEN 1 THEN 'CLS-02' ELSE 'CUS-05' END AS regel, 'user' || CAST(akte_id % 5 AS STRING) AS benutzer,
       CASE WHEN akte_id % 7 = 0 THEN 'zu kurz' ELSE 'Rücksprache mit Verlader' END AS begruendung,
       CASE WHEN akte_id % 5 = 0 THEN '0.0.9@2025-01-01' ELSE '0.1.0@2026-09-12' END AS fassung
FROM cases WHERE akte_id % 4 < 2
"""
LEVEL = """CASE WHEN haerte = 'hard' AND ((art = 'regel' AND status IN ('verletzt', 'nicht_pruefbar')) OR (art = 'nachweis' AND status <> 'ok')) THEN 3
    WHEN status = 're_extraction_required' THEN 2 WHEN status <> 'ok' THEN 1 ELSE 0 END"""
NAME = "CASE {0} WHEN 3 THEN 'blockiert' WHEN 2 THEN 'nachextraktion_erforderlich' WHEN 1 THEN 'freigabe_mit_warnungen' ELSE 'freigabereif' END"
FOUND_SQL = f"""+ found AS (
  SELECT akte_id, regel AS kennung, 'regel' AS art, status, haerte_effektiv AS haerte FROM ({RULES_SQL}) r
  UNION ALL SELECT akte_id, id, 'nachweis', status, haerte FROM ({EVIDENCE_SQL}) e
), overrides AS ({OVERRIDES_SQL}),
valid AS (SELECT DISTINCT akte_id, regel AS kennung FROM overrides WHERE length(trim(begruendung)) >= 11 AND fassung = '0.1.0@2026-09-12')
"""
DECISION_SQL = f"""{FOUND_SQL}, levels AS (
  SELECT f.akte_id, max({LEVEL}) AS a, max(CASE WHEN v.akte_id IS NULL THEN {LEVEL} END) AS b
  FROM found f LEFT JOIN valid v ON v.akte_id = f.akte_id AND v.kennung = f.kennung GROUP BY f.akte_id
)
SELECT c.akte_id, {NAME.format("l.a")} AS freigabe, {NAME.format("l.b")} AS freigabe_nach_override FROM cases c LEFT JOIN levels l ON l.akte_id = c.akte_id
"""


def overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(OVERRIDES_SQL.replace("FROM cases", "FROM {cases}"), cases=mapping.cases(spark, sf_dir)).withColumns({"ord": F.lit(0), "erzeugt_am": F.lit(None).cast("string"), "identitaet": F.lit(None).cast("string")})


def rule_query(rule: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.findings(mapping.case_rows(spark, sf_dir), load_catalog(), [rule]).select("akte_id", "regel", "status", "haerte_effektiv")


def evidence_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decision.evidence(mapping.case_rows(spark, sf_dir), load_catalog()).select("akte_id", "id", "status", "haerte")


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decision.judge(mapping.case_rows(spark, sf_dir), load_catalog(), overrides(spark, sf_dir))


def decision_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decision.decide_judged(judged(spark, sf_dir))


def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decision.all_findings(mapping.case_rows(spark, sf_dir), load_catalog())
    return found.groupBy("kennung", "status").agg(F.count("*").alias("n"))


def audit_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged_ones = decision.judge(mapping.case_rows(spark, sf_dir), load_catalog(), overrides(spark, sf_dir), overridden=True)
    return decision.override_audit(decision.overridden_findings(judged_ones)).groupBy("wirkung", "kennung").agg(F.count("*").alias("n"))


AUDIT_SQL = f"""{FOUND_SQL}
SELECT CASE WHEN length(trim(o.begruendung)) >= 11 AND o.fassung = '0.1.0@2026-09-12' THEN 'angewandt' ELSE 'verbraucht' END AS wirkung, o.regel AS kennung, count(*) AS n
FROM overrides o JOIN found f ON f.akte_id = o.akte_id AND f.kennung = o.regel GROUP BY ALL
"""
COUNTS_SQL = FOUND_SQL + "SELECT kennung, status, count(*) AS n FROM found GROUP BY ALL"


def request_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases, catalog = mapping.case_rows(spark, sf_dir), load_catalog()
    made = requests.formulate(rules.findings(cases, catalog), decision.evidence(cases, catalog), cases, catalog)
    return made.groupBy("grund", (F.col("adressat") == catalog.owners["rereading"]["primaer"]).alias("nachlesen")).agg(F.count("*").alias("n"))


REQUEST_SQL = FOUND_SQL + """SELECT kennung AS grund, status = 're_extraction_required' AS nachlesen, count(*) AS n FROM found WHERE status <> 'ok' GROUP BY ALL"""


LATER = "Konfidenz unter 0.8: zuerst nachlesen"
MOVED = "CASE WHEN h.abd_container <> h.pack_container THEN 'Container: ABD ' || h.abd_container || ', Packliste ' || h.pack_container END"
#: rule -> (join of texts t of lines, text if it cannot be checked, if it holds, if it doesn't, and after rereading is asked for; null: the violation and a remark)
REASON_SQL = {
    "VAL-03": (
        "LEFT JOIN (SELECT akte_id, string_agg(CAST(nr AS STRING), ', ' ORDER BY nr) AS list FROM lines WHERE einzelpreis = 0 AND zollwert IS NULL AND methode IS NULL GROUP BY akte_id) t ON t.akte_id = c.akte_id",
        "'Rechnungspositionen fehlen'", "'Jede kostenlose Position ist bewertet'", "'Position(en) ' || t.list || ' mit Preis 0 ohne Zollwert und ohne Bewertungsmethode'", None,
    ),
    "ORG-03": (
        "", "NULL", "CASE WHEN c.akte_id % 17 = 0 THEN 'A.TR liegt vor, setzt aber keinen Ursprung' ELSE 'Keine A.TR in der Akte' END",
        "CASE WHEN h.nachweis_typ = 'atr' THEN 'Der Präferenznachweis ist als A.TR erfasst; A.TR ist ein Freiverkehrs-, kein Ursprungsnachweis' ELSE 'Präferenz beansprucht, aber nur eine A.TR liegt vor — sie setzt keinen Präferenzursprung' END", None,
    ),
    "ORG-06": (
        "", "CASE WHEN h.gesamt IS NULL THEN 'Wert der Ursprungserzeugnisse fehlt' ELSE 'Schwelle in EUR, Rechnung in ' || h.waehrung || ': Umrechnung nicht implementiert' END",
        """CASE WHEN h.nachweis_typ IS DISTINCT FROM 'origin_declaration' THEN 'Kein Ursprungserklärungs-Nachweis, Wertgrenze nicht einschlägig' WHEN h.gesamt <= 6000 THEN 'Ursprungswert unter der Schwelle, jeder Ausführer darf erklären'
           WHEN h.rex LIKE 'DEREX%' THEN 'Über der Schwelle, REX ' || h.rex || ' strukturell gültig' ELSE 'Über der Schwelle, Ermächtigter Ausführer erfasst' END""",
        "CASE WHEN h.rex IS NOT NULL THEN 'REX-Nummer ' || h.rex || ' entspricht nicht dem Format' ELSE 'Ursprungswert über 6000 EUR ohne REX-Nummer oder Ermächtigten Ausführer' END", None,
    ),
    "CLS-02": (
        """LEFT JOIN (SELECT akte_id, string_agg(code, ', ' ORDER BY nr) AS every_code, string_agg(CASE WHEN length(code) <> 8 THEN code END, ', ' ORDER BY nr) AS short_codes
           FROM (SELECT akte_id, nr, CASE WHEN akte_id % 31 = 0 AND nr = 1 THEN hs6 ELSE hs6 || '00' END AS code FROM lines) coded GROUP BY akte_id) t ON t.akte_id = c.akte_id""",
        "CASE WHEN c.anm_richtung IS NULL OR h.n_lines IS NULL THEN 'Anmeldedaten fehlen' ELSE 'Keine Stellenzahl für Richtung ' || c.anm_richtung || ' hinterlegt' END",
        "'Alle Warennummern 8-stellig'",
        "'Warennummer(n) ' || CASE WHEN c.anm_richtung = 'import_de' THEN t.every_code || ' nicht 11-stellig für ' ELSE t.short_codes || ' nicht 8-stellig für ' END || c.anm_richtung", None,
    ),
    "QTY-01": (
        """LEFT JOIN (SELECT l.akte_id, string_agg(CASE WHEN p.akte_id IS NULL THEN 'Position ' || CAST(l.nr AS STRING) || ' fehlt in der Packliste' WHEN l.menge <> p.menge - coalesce(p.offen, 0)
           THEN 'Position ' || CAST(l.nr AS STRING) || ': Rechnung ' || CAST(CAST(l.menge AS BIGINT) AS STRING) || ' ≠ Packliste ' || CAST(CAST(p.menge AS BIGINT) AS STRING) || CASE WHEN p.offen IS NULL THEN '' ELSE ' − Backorder 1' END END, '; ' ORDER BY l.nr) AS list
           FROM lines l LEFT JOIN packing p ON p.akte_id = l.akte_id AND p.nr = l.nr GROUP BY l.akte_id) t ON t.akte_id = c.akte_id""",
        "'Rechnungs- oder Packlistenpositionen fehlen'", "'Mengen je Position identisch'", "t.list", None,
    ),
    "TRN-01": (
        "", "'Containernummer auf B/L oder Packliste fehlt'", "'Container ' || h.bl_container || ' auf beiden Belegen'", "'B/L nennt ' || h.bl_container || ', Packliste ' || h.pack_container",
        f"'B/L nennt ' || h.bl_container || ', Packliste ' || h.pack_container || ', aber {LATER}'",
    ),
    "REF-03": ("", "NULL", "'Alle Fakten stammen aus finalen Dokumenten'", "'Nur Entwurf vorhanden für: bill_of_lading (bill_of_lading, Status draft) — Draft darf keine Anmeldegrundlage sein'", None),
    "CUS-05": (
        """LEFT JOIN (SELECT l.akte_id, string_agg(CASE WHEN substr(d.warennummer, 1, 6) <> l.hs6 THEN 'Position ' || CAST(l.nr AS STRING) || ': Rechnung ' || l.hs6 || ', ABD ' || substr(d.warennummer, 1, 6) END, '; ' ORDER BY l.nr) AS other,
           string_agg(CASE WHEN d.akte_id IS NULL THEN 'Position ' || CAST(l.nr AS STRING) || ' nur auf der Rechnung' END, '; ' ORDER BY l.nr) AS alone
           FROM lines l LEFT JOIN declared d ON d.akte_id = l.akte_id AND d.nr = l.nr GROUP BY l.akte_id) t ON t.akte_id = c.akte_id""",
        "'Rechnungspositionen fehlen'", "CAST(h.n_lines AS STRING) || ' Positionen auf HS-6 angemeldet wie berechnet; Container ' || h.abd_container || ' auf ABD und Packliste'", f"concat_ws('; ', t.other, t.alone, {MOVED})", None,
    ),
}


def reason_select(rule: str) -> str:
    joins, gap, bad, unsure = RULE_SQL[rule]
    texts, unchecked, fine, broken, reread = REASON_SQL[rule]
    again = reread or f"{broken} || ' — {LATER}'"
    return f"""SELECT c.akte_id, '{rule}' AS regel, CASE WHEN {gap} THEN {unchecked} WHEN NOT coalesce({bad}, FALSE) THEN {fine} WHEN coalesce({unsure}, FALSE) THEN {again} ELSE {broken} END AS begruendung
  FROM cases c JOIN heads h ON h.akte_id = c.akte_id {joins} {texts} WHERE c.tag >= 0"""


def reason_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reasons.explained(mapping.case_rows(spark, sf_dir), load_catalog(), list(REASON_SQL)).select("akte_id", "regel", "begruendung")


def _register() -> tuple[dict, dict]:
    queries, sql = {}, {}
    for rule in RULE_SQL:
        name = "rule_" + rule.lower().replace("-", "_")
        queries[name], sql[name] = partial(rule_query, rule), mapping.oracle(rule_select(rule))
    queries |= {"evidence_matrix": evidence_query, "case_decision": decision_query, "finding_status_counts": status_counts, "override_audit": audit_query, "request_reasons": request_query, "finding_reasons": reason_query}
    sql |= {"evidence_matrix": mapping.oracle(EVIDENCE_SQL), "case_decision": mapping.oracle(DECISION_SQL), "finding_status_counts": mapping.oracle(COUNTS_SQL), "override_audit": mapping.oracle(AUDIT_SQL), "request_reasons": mapping.oracle(REQUEST_SQL), "finding_reasons": mapping.oracle("\nUNION ALL ".join(map(reason_select, REASON_SQL)))}
    return queries, sql


QUERIES, ORACLES = _register()
