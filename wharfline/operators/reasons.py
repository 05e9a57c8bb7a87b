"""Why a rule found what it found, and the values it looked at.

Texts are expressions over the case row that the rules are evaluated on, so findings
with reasons need no join and no further shuffle. Decisions don't need them and don't
work them out. Numbers are written without an exponent, to twelve places.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wharfline.functions.identifiers import FORMATS, commodity_code, container_digit, container_id, container_ok, country_code
from wharfline.operators.facts import FINAL, LISTS
from wharfline.operators.rules import CONTAINERS, OK, REREAD, RULES, UNCHECKABLE, fact, first, items, results, rows, there, with_catalog
from wharfline.sources.catalog import Catalog

#: Text of a value that isn't there.
NO_VALUE = "undefined"


@dataclass
class Reason:
    """Texts of a finding by its status. reread: what stands there when the values were read with low confidence
    (default: the violation and a remark); inputs: the values looked at."""

    ok: Column
    gap: Column
    bad: Column
    inputs: dict[str, Column]
    reread: Column | None = None


REASONS: dict[str, Callable[[Catalog, dict], Reason]] = {}


def reason_of(rule_id: str) -> Callable:
    def put(f: Callable[[Catalog, dict], Reason]) -> Callable[[Catalog, dict], Reason]:
        REASONS[rule_id] = f
        return f

    return put


def number(c: Column) -> Column:
    return F.coalesce(F.regexp_replace(c.cast("decimal(38,12)").cast("string"), r"\.?0+$", ""), F.lit(NO_VALUE))


def say(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else F.coalesce(p, F.lit(NO_VALUE)) for p in parts])


def joined(clauses: Column, by: str = "; ") -> Column:
    return F.array_join(F.array_compact(clauses), by)


def heads(*paths: str) -> dict[str, Column]:
    return {p: fact(p).cast("string") for p in paths}


def lists(*paths: str) -> dict[str, Column]:
    """Lists as JSON of their values."""
    values = lambda path: lambda x: F.struct(*[x[f]["v"].alias(f) for f in LISTS[path]])
    return {p: F.to_json(F.transform(items(p), values(p))) for p in paths}


def place(item: Column) -> Column:
    return (item["idx"] + 1).cast("string")


def same_number(path: str, p: Column, key: str = "nr") -> Column:
    return first(rows(path), lambda q: q[key]["v"].eqNullSafe(p["nr"]["v"]))


def each(path: str, clause: Callable[[Column], Column]) -> Column:
    return F.transform(rows(path), clause)


def later(catalog: Catalog) -> Column:
    return F.lit(f"Konfidenz unter {catalog.low_confidence_below}: zuerst nachlesen")


INVOICE, PACKED, PACKAGES, SCOPE, DECLARED = "rechnung.positionen", "packliste.positionen", "packliste.packstuecke", "praeferenznachweis.warenkreis", "abd.positionen"
NO_LINES = "Rechnungspositionen fehlen"

# The texts below are fixed values: they are part of a finding.


@reason_of("VAL-01")
def invoice_total(catalog: Catalog, rule: dict) -> Reason:
    extra, less, total = F.coalesce(fact("rechnung.zuschlaege"), F.lit(0.0)), F.coalesce(fact("rechnung.rabatte"), F.lit(0.0)), number(fact("rechnung.gesamt"))
    made = number(F.aggregate(rows(INVOICE), F.lit(0.0), lambda s, p: s + F.coalesce(p["netto"]["v"], F.lit(0.0))) + extra - less)
    inputs = lists(INVOICE) | {"rechnung.zuschlaege": number(extra), "rechnung.rabatte": number(less), "rechnung.gesamt": total, "berechnet": made}
    return Reason(
        say("Summe ", made, " entspricht Endbetrag ", total), F.lit("Rechnungspositionen oder Endbetrag fehlen"), say("Summe der Positionen ", made, " ≠ Endbetrag ", total), inputs,
        say("Summe ", made, " ≠ Endbetrag ", total, ", aber ", later(catalog)),
    )


@reason_of("VAL-03")
def free_lines(catalog: Catalog, rule: dict) -> Reason:
    free = F.filter(rows(INVOICE), lambda p: F.coalesce(p["einzelpreis"]["v"] == 0, F.lit(False)))
    bare = F.filter(free, lambda p: ~F.coalesce(p["zollwert"]["v"] > 0, F.lit(False)) & (F.coalesce(p["bewertungsmethode"]["v"], F.lit("")) == ""))
    bad = say("Position(en) ", joined(F.transform(bare, place), ", "), " mit Preis 0 ohne Zollwert und ohne Bewertungsmethode")
    return Reason(F.lit("Jede kostenlose Position ist bewertet"), F.lit(NO_LINES), bad, {"kostenlose_positionen": F.size(free).cast("string")})


@reason_of("ORG-02")
def origin_covers(catalog: Catalog, rule: dict) -> Reason:
    digits = catalog.rule("CLS-01")["parameters"]["digits"]
    proof = country_code(fact("praeferenznachweis.ursprung"))
    covered = F.transform(rows(SCOPE), lambda w: commodity_code(w["hs6"]["v"], digits))

    def of_line(p: Column) -> Column:
        own, code = country_code(p["ursprung"]["v"]), commodity_code(p["hs6"]["v"], digits)
        origin = F.when(~own.eqNullSafe(proof), say("Position ", place(p), ": Ursprung ", F.coalesce(own, F.lit("fehlt")), " ≠ Nachweis ", proof))
        return F.array(origin, F.when(~F.exists(covered, lambda s: s.eqNullSafe(code)), say("Position ", place(p), ": HS ", p["hs6"]["v"], " nicht im Warenkreis des Nachweises")))

    claimed = F.coalesce(F.col("sachverhalt.praeferenz_beansprucht"), F.lit(False))
    fine = F.when(claimed, say("Nachweis deckt alle Positionen mit Ursprung ", proof)).otherwise("Keine Präferenz beansprucht, Regel nicht einschlägig")
    return Reason(fine, F.lit("Präferenznachweis oder Rechnungspositionen fehlen"), joined(F.flatten(each(INVOICE, of_line))), lists(INVOICE, SCOPE) | heads("praeferenznachweis.ursprung"))


@reason_of("ORG-03")
def atr(catalog: Catalog, rule: dict) -> Reason:
    there_ = F.coalesce(F.exists("dokumente", lambda d: d["typ"] == "atr"), F.lit(False))
    own = F.coalesce(fact("praeferenznachweis.typ") == "atr", F.lit(False))
    bad = F.when(own, "Der Präferenznachweis ist als A.TR erfasst; A.TR ist ein Freiverkehrs-, kein Ursprungsnachweis").otherwise("Präferenz beansprucht, aber nur eine A.TR liegt vor — sie setzt keinen Präferenzursprung")
    inputs = {"atr_vorhanden": there_.cast("string")} | heads("praeferenznachweis.typ") | {"praeferenz_beansprucht": F.coalesce(F.col("sachverhalt.praeferenz_beansprucht"), F.lit(False)).cast("string")}
    return Reason(F.when(there_, "A.TR liegt vor, setzt aber keinen Ursprung").otherwise("Keine A.TR in der Akte"), F.lit(None).cast("string"), bad, inputs)


@reason_of("ORG-06")
def origin_limit(catalog: Catalog, rule: dict) -> Reason:
    limit = rule["parameters"]["threshold"]
    value, rex, typ = fact("praeferenznachweis.ursprungswert"), fact("praeferenznachweis.rex_nummer"), fact("praeferenznachweis.typ")
    ok = (
        F.when(~typ.eqNullSafe("origin_declaration"), F.lit("Kein Ursprungserklärungs-Nachweis, Wertgrenze nicht einschlägig"))
        .when(F.coalesce(value, F.lit(0.0)) <= limit["value"], "Ursprungswert unter der Schwelle, jeder Ausführer darf erklären")
        .when(F.coalesce(rex.rlike(FORMATS["rex"]), F.lit(False)), say("Über der Schwelle, REX ", rex, " strukturell gültig"))
        .otherwise("Über der Schwelle, Ermächtigter Ausführer erfasst")
    )
    foreign = say(f"Schwelle in {limit['currency']}, Rechnung in ", fact("rechnung.waehrung"), ": Umrechnung nicht implementiert")
    gap = F.when(~there("praeferenznachweis.ursprungswert"), "Wert der Ursprungserzeugnisse fehlt").otherwise(foreign)
    bad = F.when(F.coalesce(rex, F.lit("")) != "", say("REX-Nummer ", rex, " entspricht nicht dem Format")).otherwise(f"Ursprungswert über {limit['value']} {limit['currency']} ohne REX-Nummer oder Ermächtigten Ausführer")
    inputs = heads("praeferenznachweis.typ", "praeferenznachweis.rex_nummer", "praeferenznachweis.ermaechtigter_ausfuehrer")
    return Reason(ok, gap, bad, inputs | {"praeferenznachweis.ursprungswert": F.when(value.isNotNull(), number(value)), "schwelle": F.lit(f"{limit['value']} {limit['currency']}")})


@reason_of("CLS-01")
def codes_agree(catalog: Catalog, rule: dict) -> Reason:
    digits = rule["parameters"]["digits"]

    def of_line(p: Column) -> Column:
        own = commodity_code(p["hs6"]["v"], digits)

        def against(path: str, key: str, name: str) -> Column:
            stated = same_number(path, p, key)["hs6"]["v"]
            code = commodity_code(stated, digits)
            return F.when(F.coalesce(stated != "", F.lit(False)) & ~code.eqNullSafe(own), say("Position ", place(p), ": Rechnung ", own, f" ≠ {name} ", F.coalesce(code, F.lit("null"))))

        both = F.array(against(PACKED, "nr", "Packliste"), against(SCOPE, "pos", "Präferenznachweis"))
        return F.when(own.isNull(), F.array(say("Position ", place(p), ": HS-Code auf der Rechnung fehlt"))).otherwise(both)

    inputs = {"stellen": F.lit(str(digits)), "positionen": F.size(rows(INVOICE)).cast("string")}
    return Reason(F.lit(f"HS-{digits} über alle Belege identisch"), F.lit(NO_LINES), joined(F.flatten(each(INVOICE, of_line))), inputs)


@reason_of("CLS-02")
def code_length(catalog: Catalog, rule: dict) -> Reason:
    way, codes = F.col("anmeldung.richtung"), F.col("anmeldung.warennummern")
    length = F.lit(None).cast("string")
    for name, n in rule["parameters"]["length_by_direction"].items():
        length = F.when(way == name, str(n)).otherwise(length)
    clean = lambda n: F.regexp_replace(n, r"\s", "")
    wrong = F.filter(codes, lambda n: (F.length(clean(n)) != length.cast("int")) | ~clean(n).rlike("^[0-9]+$"))
    absent = (F.coalesce(way, F.lit("")) == "") | codes.isNull()
    gap = F.when(absent, "Anmeldedaten fehlen").otherwise(say("Keine Stellenzahl für Richtung ", way, " hinterlegt"))
    bad = say("Warennummer(n) ", joined(wrong, ", "), " nicht ", length, "-stellig für ", way)
    return Reason(say("Alle Warennummern ", length, "-stellig"), gap, bad, {"anmeldung.richtung": way, "anmeldung.warennummern": F.to_json(codes)})


@reason_of("QTY-01")
def quantities(catalog: Catalog, rule: dict) -> Reason:
    def of_line(p: Column) -> Column:
        pack = same_number(PACKED, p)
        open_ = F.coalesce(same_number("packliste.backorders", p)["menge"]["v"], F.lit(0.0))
        less = F.when(open_ != 0, say(" − Backorder ", number(open_))).otherwise("")
        differs = say("Position ", place(p), ": Rechnung ", number(p["menge"]["v"]), " ≠ Packliste ", number(pack["menge"]["v"]), less)
        equal = F.coalesce(p["menge"]["v"] == pack["menge"]["v"] - open_, F.lit(False))
        return F.when(pack.isNull(), say("Position ", place(p), " fehlt in der Packliste")).when(~equal, differs)

    return Reason(F.lit("Mengen je Position identisch"), F.lit("Rechnungs- oder Packlistenpositionen fehlen"), joined(each(INVOICE, of_line)), lists(INVOICE, PACKED))


@reason_of("QTY-02")
def gross_weights(catalog: Catalog, rule: dict) -> Reason:
    pack, bl = fact("packliste.brutto_gesamt_kg"), fact("bill_of_lading.brutto_kg")
    apart, tolerance = F.abs(pack - bl), F.greatest(F.lit(float(rule["tolerance"]["absolute_kg"])), rule["tolerance"]["relative"] * pack)
    share = F.when(pack > 0, apart / F.when(pack > 0, pack))
    percent = F.when(share.isNull(), "Infinity %").otherwise(say(F.round(share * 100, 1).cast("decimal(38,1)").cast("string"), " %"))
    harder = F.when(F.coalesce(share >= rule["escalate_to_hard_at"]["relative"], F.lit(True)), ", über Eskalationsschwelle: hart").otherwise("")
    bad = say("Abweichung ", number(apart), " kg (", percent, ") über Toleranz ", number(tolerance), " kg", harder)
    inputs = {"packliste.brutto_gesamt_kg": number(pack), "bill_of_lading.brutto_kg": number(bl), "differenz_kg": number(apart), "differenz_relativ": number(F.round(share, 4)), "toleranz_kg": number(tolerance)}
    return Reason(say("Abweichung ", number(apart), " kg innerhalb ", number(tolerance), " kg"), F.lit("Bruttogewicht auf Packliste oder B/L fehlt"), bad, inputs)


@reason_of("QTY-03")
def package_weights(catalog: Catalog, rule: dict) -> Reason:
    def of_package(p: Column) -> Column:
        net, gross = p["netto_kg"]["v"], p["brutto_kg"]["v"]
        light = say(p["id"]["v"], ": netto ", number(net), " nicht > 0")
        return F.when(~F.coalesce(net > 0, F.lit(False)), light).when(~F.coalesce(gross >= net, F.lit(False)), say(p["id"]["v"], ": brutto ", number(gross), " < netto ", number(net)))

    total, stated = F.aggregate(rows(PACKAGES), F.lit(0.0), lambda s, p: s + F.coalesce(p["brutto_kg"]["v"], F.lit(0.0))), fact("packliste.brutto_gesamt_kg")
    over = F.when(there("packliste.brutto_gesamt_kg") & (total > F.coalesce(stated, F.lit(0.0))), say("Summe der Packstücke ", number(total), " kg > Bruttogesamt ", F.when(stated.isNull(), "null").otherwise(number(stated)), " kg"))
    inputs = {"packstuecke": F.size(rows(PACKAGES)).cast("string"), "brutto_summe_kg": number(total), "packliste.brutto_gesamt_kg": F.when(stated.isNotNull(), number(stated))}
    return Reason(F.lit("brutto ≥ netto > 0 für alle Packstücke"), F.lit("Packstücke fehlen"), joined(F.concat(each(PACKAGES, of_package), F.array(over))), inputs)


@reason_of("TRN-01")
def containers(catalog: Catalog, rule: dict) -> Reason:
    bl, pack = (container_id(fact(p)) for p in CONTAINERS)
    bad = say("B/L nennt ", bl, ", Packliste ", pack)
    return Reason(say("Container ", bl, " auf beiden Belegen"), F.lit("Containernummer auf B/L oder Packliste fehlt"), bad, heads(*CONTAINERS), say(bad, ", aber ", later(catalog)))


@reason_of("TRN-02")
def container_digits(catalog: Catalog, rule: dict) -> Reason:
    def of(path: str) -> Column:
        cid = container_id(fact(path))
        why = F.when(F.coalesce(cid.rlike(FORMATS["container"]), F.lit(False)), say("Prüfziffer erwartet ", container_digit(cid).cast("string"))).otherwise("Format ungültig")
        return F.when(fact(path).isNotNull() & ~container_ok(fact(path)), say(f"{path}: ", cid, " (", why, ")"))

    again = F.lit(f"Prüfziffer falsch bei Konfidenz unter {catalog.low_confidence_below}: Nachextraktion vor fachlicher Ablehnung")
    return Reason(F.lit("Prüfziffer ISO 6346 gültig"), F.lit("Keine Containernummer in der Akte"), joined(F.array(*map(of, CONTAINERS))), heads(*CONTAINERS), again)


@reason_of("REF-03")
def only_drafts(catalog: Catalog, rule: dict) -> Reason:
    drafts = F.coalesce(F.col("nicht_final"), F.array().cast("array<struct<dokument: string, dok_typ: string, dok_status: string, pfad: string>>"))
    bare = F.filter(drafts, lambda a: ~F.coalesce(F.exists("dokumente", lambda d: (d["status"] == FINAL) & d["typ"].eqNullSafe(a["dok_typ"])), F.lit(False)))
    named = F.array_distinct(F.transform(bare, lambda a: say(a["dok_typ"], " (", a["dokument"], ", Status ", a["dok_status"], ")")))
    n = F.size(drafts)
    ok = F.when(n > 0, say(n.cast("string"), " Assertions aus Drafts ignoriert, finale Fassungen liegen vor")).otherwise("Alle Fakten stammen aus finalen Dokumenten")
    bad = say("Nur Entwurf vorhanden für: ", joined(named, ", "), " — Draft darf keine Anmeldegrundlage sein")
    return Reason(ok, F.lit(None).cast("string"), bad, {"assertions_nicht_final": n.cast("string"), "typen_ohne_finale_fassung": F.to_json(named)})


@reason_of("CUS-05")
def export_document(catalog: Catalog, rule: dict) -> Reason:
    digits = rule["parameters"]["digits"]

    def of_declared(p: Column) -> Column:
        line, nr = same_number(INVOICE, p), number(p["nr"]["v"])
        declared, invoiced = commodity_code(p["warennummer"]["v"], digits), commodity_code(line["hs6"]["v"], digits)
        return (
            F.when(line.isNull(), say("Position ", nr, " nur im ABD")).when(declared.isNull(), say("Position ", nr, ": Warennummer auf dem ABD fehlt oder ist unlesbar"))
            .when(F.coalesce(declared != invoiced, F.lit(False)), say("Position ", nr, ": Rechnung ", invoiced, ", ABD ", declared))
        )

    def of_invoiced(q: Column) -> Column:
        return F.when(~F.exists(rows(DECLARED), lambda p: p["nr"]["v"].eqNullSafe(q["nr"]["v"])), say("Position ", number(q["nr"]["v"]), " nur auf der Rechnung"))

    abd, pack = (container_id(F.when(fact(p) != "", fact(p))) for p in ("abd.container_id", "packliste.container_id"))
    moved = F.when(abd != pack, say("Container: ABD ", abd, ", Packliste ", pack))
    at = F.when(abd == pack, say("Container ", abd, " auf ABD und Packliste")).otherwise("Container nicht vergleichbar, Packliste oder ABD nennt keinen")
    n = F.size(rows(INVOICE)).cast("string")
    nothing = items(DECLARED).isNull() & (F.coalesce(fact("abd.container_id"), F.lit("")) == "")
    return Reason(
        say(n, f" Positionen auf HS-{digits} angemeldet wie berechnet; ", at), F.when(nothing, "Kein Ausfuhrbegleitdokument in der Akte").otherwise(NO_LINES),
        joined(F.concat(each(DECLARED, of_declared), each(INVOICE, of_invoiced), F.array(moved))), {"stellen": F.lit(str(digits)), "positionen_abd": F.size(rows(DECLARED)).cast("string"), "positionen_rechnung": n},
    )


def explained(cases: DataFrame, catalog: Catalog, only: list[str] | None = None) -> DataFrame:
    """As rules.findings, with begruendung and eingaben (name -> value as text, null where there is none)."""
    wanted = [r for r in catalog.rules["rules"] if r["id"] in RULES and r["id"] in REASONS and (only is None or r["id"] in only)]
    checked, found = results(cases, catalog, wanted)
    fields = ("regel", "status", "haerte_effektiv", "fehlende_pfade", "nachzulesende_pfade", "pfade")
    full = []
    for rule, f in zip(wanted, found, strict=True):
        why, s = REASONS[rule["id"]](catalog, rule), F.col(f"`_s_{rule['id']}`")
        again = say(why.bad, " — ", later(catalog)) if why.reread is None else why.reread
        text = F.when(s == OK, why.ok).when(s == UNCHECKABLE, why.gap).when(s == REREAD, again).otherwise(why.bad)
        inputs = F.create_map(*[x for k, v in why.inputs.items() for x in (F.lit(k), v)]).cast("map<string, string>")
        full.append(F.struct(*[f[c].alias(c) for c in fields], text.alias("begruendung"), inputs.alias("eingaben")))
    return with_catalog(checked.select("akte_id", "stichtag", F.explode(F.array(*full)).alias("x")).select("akte_id", "stichtag", "x.*"), catalog)
