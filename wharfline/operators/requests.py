"""Requests to owners, their reconciliation with open ones, and the escalation plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wharfline.operators.rules import OK, REREAD
from wharfline.operators.sheets import spread
from wharfline.sources.catalog import Catalog

OPEN, KEEP, CLOSE = "eroeffnen", "behalten", "schliessen"
HOUR = 3600
#: Inputs of a rule that count as its field when no path is named: the dotted ones, in the rule's order.
INPUT_FIELDS = {
    "VAL-01": "rechnung.positionen", "ORG-02": "rechnung.positionen", "ORG-03": "praeferenznachweis.typ", "ORG-06": "praeferenznachweis.typ", "CLS-02": "anmeldung.richtung",
    "QTY-01": "rechnung.positionen", "QTY-02": "packliste.brutto_gesamt_kg", "QTY-03": "packliste.brutto_gesamt_kg", "TRN-01": "bill_of_lading.container_id",
}


def formulate(rule_findings: DataFrame, evidence_findings: DataFrame, cases: DataFrame, catalog: Catalog) -> DataFrame:
    """A request for each finding that isn't ok: akte_id, ord, grund, feld, adressat, adressat_kopie, anforderung, widerspruch, folge, stufe, betreff, text.

    The contradiction is the reason of the finding, where rule_findings have one (reasons.explained)."""
    spark = cases.sparkSession
    why = lambda found: (F.col("begruendung") if "begruendung" in found.columns else F.lit(None)).cast("string").alias("widerspruch")
    from_evidence = evidence_findings.where(F.col("status") != OK).select(
        "akte_id", F.col("ordnung").alias("ord"), F.col("id").alias("grund"), F.col("required_data").alias("feld"), F.col("label").alias("anforderung"), "status",
        F.col("akzeptierte_nachweise").alias("nachweise"), why(evidence_findings), F.when(F.col("haerte") == "hard", "Keine Freigabe der Akte").otherwise("Freigabe mit Vermerk").alias("folge"),
    )
    default = F.lit(None).cast("string")
    for rule, field in INPUT_FIELDS.items():
        default = F.when(F.col("regel") == rule, field).otherwise(default)
    # two checks name the broken fields themselves
    default = F.when(F.col("regel") == "TRN-02", F.get("pfade", F.lit(0))).otherwise(default)
    named = F.coalesce("fehlende_pfade", "nachzulesende_pfade")
    field = F.when(named.isNotNull(), F.get(named, F.lit(0))).otherwise(default)
    from_rules = rule_findings.where(F.col("status") != OK).select(
        "akte_id", (F.col("rang") + 100).alias("ord"), F.col("regel").alias("grund"), F.coalesce(field, "regel").alias("feld"), F.col("name").alias("anforderung"), "status", F.col("inputs").alias("nachweise"), why(rule_findings),
        F.concat(F.when(F.col("haerte_effektiv") == "hard", "Keine Freigabe: ").otherwise("Warnung: "), F.col("konsequenz")).alias("folge"),
    )
    again = catalog.owners["rereading"]
    both = from_evidence.unionByName(from_rules).withColumn("praefix", F.split("feld", r"\.")[0])
    owned = both.join(F.broadcast(catalog.owner_table(spark)), "praefix", "left")
    reread = F.col("status") == REREAD
    named_refs = cases.select("akte_id", F.col("rechnung_nummer.v").alias("_inv"), F.col("bill_of_lading_nummer.v").alias("_bl"), F.coalesce("bill_of_lading_container_id.v", "packliste_container_id.v").alias("_con"))
    out = owned.join(named_refs, "akte_id").withColumns(
        {
            "adressat": F.when(reread, again["primaer"]).otherwise(F.coalesce("primaer", F.lit(catalog.owners["default_owner"]))),
            "adressat_kopie": F.when(reread, again["sekundaer"]).otherwise(F.col("sekundaer")),
            "betreff": F.concat(F.lit("ACTION REQUIRED – "), "anforderung", F.lit(" – Shipment "), F.col("akte_id").cast("string")),
        }
    )
    part = lambda name, c: F.when(F.coalesce(F.col(c), F.lit("")) != "", F.concat(F.lit(f"{name} "), F.col(c)))
    refs = F.array_join(F.array_compact(F.array(part("Invoice", "_inv"), part("B/L", "_bl"), part("Container", "_con"))), " / ")
    text = F.concat_ws(
        "\n", F.concat(F.lit("An: "), "adressat", F.coalesce(F.concat(F.lit(" (Kopie: "), "adressat_kopie", F.lit(")")), F.lit(""))), F.lit("\nBenötigt:"), F.concat(F.lit("- Dokument/Feld: "), "feld"),
        F.concat(F.lit("- Grund der Anforderung: "), "anforderung", F.lit(" ("), "grund", F.lit(")")), F.concat(F.lit("- Gefundener Widerspruch: "), "widerspruch"),
        F.concat(F.lit("- Akzeptierte Nachweise: "), F.when(F.size("nachweise") > 0, F.array_join("nachweise", ", ")).otherwise("siehe Regel")),
        F.concat(F.lit("- Folge bei Fristüberschreitung: "), "folge"), F.concat(F.lit("\nReferenzen: "), F.when(refs != "", refs).otherwise(F.col("akte_id").cast("string"))),
    )
    return out.select("akte_id", "ord", "grund", "feld", "adressat", "adressat_kopie", "anforderung", "widerspruch", "folge", "status", F.lit(catalog.owners["escalation"][0]["stufe"]).alias("stufe"), "betreff", text.alias("text"))


def last_per_key(rows: DataFrame, order: str = "ord") -> DataFrame:
    """One row for each case, reason and field: the last one, at the place of the first."""
    others = [c for c in rows.columns if c not in ("akte_id", "grund", "feld", order)]
    return rows.groupBy("akte_id", "grund", "feld").agg(F.max_by(F.struct(*others), order).alias("_r"), F.min(order).alias(order)).select("akte_id", "grund", "feld", order, "_r.*")


def reconcile(open_: DataFrame, new: DataFrame, as_of: Column) -> DataFrame:
    """open_ (akte_id, grund, feld, stufe, letzter_versand_am, eroeffnet_am, betreff, text) against new requests:
    opened, kept (stage and dispatch stay, texts are the new ones) or closed."""
    o = open_.select("akte_id", "grund", "feld", F.struct("stufe", "letzter_versand_am", "eroeffnet_am", "betreff", "text", "adressat", "adressat_kopie").alias("o"))
    n = last_per_key(new).select("akte_id", "grund", "feld", F.struct("betreff", "text", "adressat", "adressat_kopie").alias("n"))
    both = o.join(n, ["akte_id", "grund", "feld"], "full_outer")
    action = F.when(F.col("o").isNull(), OPEN).when(F.col("n").isNull(), CLOSE).otherwise(KEEP)
    return both.select(
        "akte_id", "grund", "feld", action.alias("aktion"), F.when(action == CLOSE, "erledigt").otherwise("offen").alias("status"), F.col("o.stufe").alias("stufe"), F.col("o.letzter_versand_am").alias("letzter_versand_am"),
        F.coalesce("o.eroeffnet_am", as_of).alias("eroeffnet_am"), F.when(action == CLOSE, as_of).alias("geschlossen_am"),
        *[F.coalesce(f"n.{c}", f"o.{c}").alias(c) for c in ("betreff", "text", "adressat", "adressat_kopie")],
    )


def due_stage(requests: DataFrame, deadlines: DataFrame, catalog: Catalog, as_of: Column) -> DataFrame:
    """Adds faellig, neue_stufe, grund_text and stufe_adressat. deadlines: akte_id, customs_cutoff, carrier_cutoff, eta."""
    spark = requests.sparkSession
    stages = catalog.stage_table(spark)
    last = F.broadcast(stages.select(F.col("stufe_nr").alias("_nr"), F.col("stufe").alias("_stufe")))
    following = F.broadcast(stages.withColumnRenamed("stufe", "neue_stufe"))
    known = requests.join(last, F.col("stufe") == F.col("_stufe"), "left").withColumn("_next", F.when(F.col("stufe").isNull(), 0).otherwise(F.col("_nr") + 1))
    # rows of requests and deadlines shrink to few bytes, so adaptive execution would sort very many of them in one task
    planned = spread(known.join(following, F.col("_next") == F.col("stufe_nr"), "left"), "akte_id").join(spread(deadlines, "akte_id"), "akte_id", "left")
    gap = catalog.owners["dispatch"]["min_gap_hours"]
    seconds = lambda c: F.unix_timestamp(c)
    cutoff = F.when(F.col("bezug") == "customs_cutoff", F.col("customs_cutoff")).when(F.col("bezug") == "carrier_cutoff", F.col("carrier_cutoff")).when(F.col("bezug") == "eta", F.col("eta"))
    due_from = seconds(cutoff) - F.col("vorlauf_stunden") * HOUR
    reason = (
        F.when(as_of.isNull(), "kein Zeitpunkt").when(F.col("stufe").isNotNull() & F.col("_nr").isNull(), "unbekannte Stufe").when(F.col("stufe_nr").isNull(), "letzte Stufe erreicht")
        .when(seconds(as_of) - seconds(F.col("letzter_versand_am")) < gap * HOUR, "Mindestabstand").when(F.col("bezug").isNull(), "sofort").when(cutoff.isNull(), "Frist fehlt")
        .when(seconds(as_of) >= due_from, "Frist erreicht").otherwise("noch nicht")
    )
    return planned.withColumns({"grund_text": reason, "faellig": reason.isin("sofort", "Frist erreicht")}).drop("_nr", "_stufe", "_next", "stufe_nr", "bezug", "vorlauf_stunden", "customs_cutoff", "carrier_cutoff", "eta")


def dispatch_plan(due: DataFrame, catalog: Catalog) -> DataFrame:
    """The due requests with their recipients in order of first naming, subject and text of the stage."""
    boxes = catalog.owners["dispatch"]["mailboxes"]
    table = F.create_map(*[F.lit(x) for pair in boxes.items() for x in pair])
    box = lambda role: F.when(role.isNotNull(), F.coalesce(F.try_element_at(table, role), F.lit(boxes.get("standard"))))
    extra = F.when(F.col("stufe_adressat") != "primaer", F.col("stufe_adressat"))
    to = F.array_distinct(F.array_compact(F.array(box(F.col("adressat")), box(F.col("adressat_kopie")), box(extra))))
    return due.where("faellig").withColumns(
        {"an": to, "betreff": F.concat(F.lit("["), "neue_stufe", F.lit("] "), F.coalesce("betreff", "grund")), "text": F.concat(F.coalesce("text", F.lit("")), F.lit("\n\nStufe: "), "neue_stufe")}
    )


def split_due(due: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(requests whose stage is due, those that wait with the reason why)."""
    return due.where("faellig"), due.where(~F.coalesce("faellig", F.lit(False)))


def dispatched(dispatches: DataFrame, requests: DataFrame) -> DataFrame:
    """Dispatches (akte_id, grund, feld, stufe, versandt_am) of known requests, with the state of the request."""
    return dispatches.join(requests.select("akte_id", "grund", "feld", "status", F.col("stufe").alias("letzte_stufe")), ["akte_id", "grund", "feld"])


def escalation_run(open_: DataFrame, deadlines: DataFrame, catalog: Catalog, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """A daily run as of a given time: (what is to be sent, the requests after it, each due one with its new stage and dispatch)."""
    due = due_stage(open_, deadlines, catalog, as_of)
    sent = F.coalesce("faellig", F.lit(False))
    after = due.withColumns({"stufe": F.when(sent, F.col("neue_stufe")).otherwise(F.col("stufe")), "letzter_versand_am": F.when(sent, as_of).otherwise(F.col("letzter_versand_am"))})
    return dispatch_plan(due, catalog), after.select(*open_.columns)


def close_latest(items: DataFrame, outcomes: DataFrame, key: str = "execution_id", when: str = "angelegt_am") -> DataFrame:
    """The retry queue after outcomes (key, ergebnis): the latest open retry of each gets its outcome as status; all other rows stay."""
    turn = Window.partitionBy(key, F.col("status") == "offen").orderBy(F.col(when).desc())
    ranked = items.withColumn("_latest", (F.col("status") == "offen") & (F.row_number().over(turn) == 1))
    both = ranked.join(outcomes.select(key, "ergebnis"), key, "left")
    closed = F.col("_latest") & F.col("ergebnis").isNotNull()
    return both.withColumn("status", F.when(closed, F.col("ergebnis")).otherwise(F.col("status"))).select(*items.columns)


def route_mail(mails: DataFrame, cases: DataFrame) -> DataFrame:
    """mails (mail_id, betreff, text, anhaenge) -> akte_id or a reason why none is assigned."""
    number = F.regexp_extract(F.concat_ws(" ", "betreff", "text"), r"ZP-\d{4}-\d{4}", 0)
    found = mails.withColumn("nummer", F.when(number != "", number)).join(cases.select("akte_id", F.col("akte_id").alias("nummer")).distinct(), "nummer", "left")
    reason = F.when(F.col("nummer").isNull(), "keine Vorgangsnummer").when(F.coalesce("anhaenge", F.lit(0)) == 0, "keine Anhänge").when(F.col("akte_id").isNull(), "unbekannte Akte").otherwise("zugeordnet")
    return found.withColumn("ergebnis", reason).withColumn("akte_id", F.when(reason == "zugeordnet", F.col("akte_id")))


def latest_open(items: DataFrame, key: str = "execution_id", when: str = "angelegt_am") -> DataFrame:
    """The latest open retry of each execution."""
    turn = Window.partitionBy(key).orderBy(F.col(when).desc())
    return items.where(F.col("status") == "offen").withColumn("_n", F.row_number().over(turn)).where("_n = 1").drop("_n")
