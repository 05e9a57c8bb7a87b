"""The rules, as expressions over case rows (operators.facts.case_rows).

A rule is a function (catalog, rule data) -> finding, a struct of status,
haerte_effektiv, fehlende_pfade, nachzulesende_pfade and pfade (what a violation
rests on). All rules are evaluated in one projection, so a case is shuffled once
however many rules there are. A violation that rests on a value read with a
confidence below the threshold asks for reading again instead.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wharfline.functions.identifiers import FORMATS, commodity_code, container_id, container_ok, country_code
from wharfline.functions.steps import let, numbered_path
from wharfline.operators.facts import FINAL, column_of, list_type
from wharfline.sources.catalog import Catalog

OK, VIOLATED, UNCHECKABLE, REREAD = "ok", "verletzt", "nicht_pruefbar", "re_extraction_required"
PATHS = "array<string>"
INVOLVED = "array<struct<pfad: string, konf: double>>"

RULES: dict[str, Callable[[Catalog, dict], Check]] = {}


def register_rule(rule_id: str) -> Callable:
    def put(f: Callable[[Catalog, dict], Check]) -> Callable[[Catalog, dict], Check]:
        RULES[rule_id] = f
        return f

    return put


def fact(path: str) -> Column:
    return F.col(f"{column_of(path)}.v")


def there(path: str) -> Column:
    return F.coalesce(F.col(f"{column_of(path)}.da"), F.lit(False))


def items(path: str) -> Column:
    return F.col(column_of(path))


def rows(path: str) -> Column:
    """The list, empty where the case has none."""
    return F.coalesce(items(path), F.array().cast(list_type(path)))


def involved(path: str | Column, konf: Column) -> Column:
    return F.struct((F.lit(path) if isinstance(path, str) else path).alias("pfad"), F.coalesce(konf, F.lit(1.0)).alias("konf"))


def head_involved(path: str) -> Column:
    return involved(path, F.col(f"{column_of(path)}.konf"))


def item_involved(path: str, item: Column, field: str) -> Column:
    return involved(numbered_path(f"{path}.#.{field}", item["idx"]), item[field]["konf"])


@dataclass
class Check:
    """What a rule says about a case row, as expressions.

    fine: the rule has nothing to say; gaps: paths that are missing, if any; unchecked: it can't be
    checked though nothing is missing; on: what a violation rests on; bad: there is one (default: it
    rests on something); certain: confidence plays no part; hardness: of a certain violation."""

    gaps: Column | None = None
    on: Column | None = None
    bad: Column | None = None
    fine: Column | None = None
    unchecked: Column | None = None
    hardness: Column | None = None


def no_items() -> Column:
    return F.array().cast(INVOLVED)


def missing(*found: tuple[str, Column]) -> Column:
    """The paths whose condition holds."""
    return F.array_compact(F.array(*[F.when(is_missing, F.lit(p)) for p, is_missing in found]))


def null_paths(*names: str) -> Column:
    return missing(*[(p, fact(p).isNull()) for p in names])


def first(array: Column, matches: Callable[[Column], Column]) -> Column:
    """The first item that matches, or null."""
    return F.get(F.filter(array, matches), F.lit(0))


@register_rule("VAL-01")
def invoice_total(catalog: Catalog, rule: dict) -> Check:
    lines = rows("rechnung.positionen")
    total = F.aggregate(lines, F.lit(0.0), lambda s, p: s + F.coalesce(p["netto"]["v"], F.lit(0.0)))
    total = total + F.coalesce(fact("rechnung.zuschlaege"), F.lit(0.0)) - F.coalesce(fact("rechnung.rabatte"), F.lit(0.0))
    equal = F.abs(total - fact("rechnung.gesamt")) <= rule["tolerance"]["amount"] + 1e-9
    rests_on = F.concat(F.array(head_involved("rechnung.gesamt")), F.transform(lines, lambda p: item_involved("rechnung.positionen", p, "netto")))
    gaps = missing(("rechnung.positionen", items("rechnung.positionen").isNull()), ("rechnung.gesamt", fact("rechnung.gesamt").isNull()))
    return Check(gaps, rests_on, ~equal)


@register_rule("VAL-03")
def free_lines_valued(catalog: Catalog, rule: dict) -> Check:
    bare = F.filter(
        rows("rechnung.positionen"),
        lambda p: F.coalesce((p["einzelpreis"]["v"] == 0) & ~F.coalesce(p["zollwert"]["v"] > 0, F.lit(False)) & (F.coalesce(p["bewertungsmethode"]["v"], F.lit("")) == ""), F.lit(False)),
    )
    rests_on = F.flatten(F.transform(bare, lambda p: F.array(item_involved("rechnung.positionen", p, "einzelpreis"), item_involved("rechnung.positionen", p, "zollwert"))))
    return Check(missing(("rechnung.positionen", items("rechnung.positionen").isNull())), rests_on)


@register_rule("ORG-02")
def origin_covers_goods(catalog: Catalog, rule: dict) -> Check:
    digits = catalog.rule("CLS-01")["parameters"]["digits"]
    proof = country_code(fact("praeferenznachweis.ursprung"))
    scope = F.transform(rows("praeferenznachweis.warenkreis"), lambda w: commodity_code(w["hs6"]["v"], digits))

    def of_line(p: Column, covered: Column) -> Column:
        other = F.when(~country_code(p["ursprung"]["v"]).eqNullSafe(covered["ursprung"]), F.array(item_involved("rechnung.positionen", p, "ursprung"), head_involved("praeferenznachweis.ursprung")))
        outside = F.when(~let(commodity_code(p["hs6"]["v"], digits), lambda code: F.exists(covered["codes"], lambda s: s.eqNullSafe(code))), F.array(item_involved("rechnung.positionen", p, "hs6")))
        none = F.array().cast(INVOLVED)
        return F.flatten(F.array(F.coalesce(other, none), F.coalesce(outside, none)))

    # the proof is read once a case, not once a line
    rests_on = let(F.struct(proof.alias("ursprung"), scope.alias("codes")), lambda covered: F.flatten(F.transform(rows("rechnung.positionen"), lambda p: of_line(p, covered))))
    gaps = missing(
        ("rechnung.positionen", items("rechnung.positionen").isNull()),
        ("praeferenznachweis.ursprung", fact("praeferenznachweis.ursprung").isNull()),
        ("praeferenznachweis.warenkreis", items("praeferenznachweis.warenkreis").isNull()),
    )
    claimed = F.coalesce(F.col("sachverhalt.praeferenz_beansprucht"), F.lit(False))
    return Check(gaps, rests_on, fine=~claimed)


@register_rule("ORG-03")
def atr_is_no_origin(catalog: Catalog, rule: dict) -> Check:
    typ = F.coalesce(fact("praeferenznachweis.typ"), F.lit(""))
    atr = F.coalesce(F.exists("dokumente", lambda d: d["typ"] == "atr"), F.lit(False))
    claimed = F.coalesce(F.col("sachverhalt.praeferenz_beansprucht"), F.lit(False))
    return Check(bad=(typ == "atr") | (claimed & atr & (typ == "")))


@register_rule("ORG-06")
def origin_value_limit(catalog: Catalog, rule: dict) -> Check:
    limit = rule["parameters"]["threshold"]
    value, rex = fact("praeferenznachweis.ursprungswert"), fact("praeferenznachweis.rex_nummer")
    currency = fact("rechnung.waehrung")
    fine = (
        (F.coalesce(value, F.lit(0.0)) <= limit["value"])
        | F.coalesce(rex.rlike(FORMATS["rex"]), F.lit(False))
        | F.coalesce(fact("praeferenznachweis.ermaechtigter_ausfuehrer"), F.lit(False))
    )
    rests_on = F.array(head_involved("praeferenznachweis.ursprungswert"), head_involved("praeferenznachweis.rex_nummer"))
    no_value = ~there("praeferenznachweis.ursprungswert")
    foreign = F.coalesce((currency != limit["currency"]) & (currency != ""), F.lit(False))
    gaps = missing(("praeferenznachweis.ursprungswert", no_value), ("rechnung.waehrung", ~no_value & foreign))
    return Check(gaps, rests_on, ~fine, fine=~fact("praeferenznachweis.typ").eqNullSafe("origin_declaration"))


@register_rule("CLS-01")
def commodity_codes_agree(catalog: Catalog, rule: dict) -> Check:
    digits = rule["parameters"]["digits"]
    none = F.array().cast(INVOLVED)

    def of_line(p: Column, code: Column) -> Column:
        def compared(path: str, other: Column) -> Column:
            has = F.coalesce(other["hs6"]["v"] != "", F.lit(False))
            differs = has & ~commodity_code(other["hs6"]["v"], digits).eqNullSafe(code)
            return F.when(differs, F.array(item_involved("rechnung.positionen", p, "hs6"), item_involved(path, other, "hs6"))).otherwise(none)

        # a line's counterpart is looked for once
        against = lambda path, key: let(first(rows(path), lambda q: q[key]["v"].eqNullSafe(p["nr"]["v"])), lambda q: compared(path, q))
        both = F.flatten(F.array(against("packliste.positionen", "nr"), against("praeferenznachweis.warenkreis", "pos")))
        return F.when(code.isNull(), F.array(item_involved("rechnung.positionen", p, "hs6"))).otherwise(both)

    rests_on = F.flatten(F.transform(rows("rechnung.positionen"), lambda p: let(commodity_code(p["hs6"]["v"], digits), lambda code: of_line(p, code))))
    return Check(missing(("rechnung.positionen", items("rechnung.positionen").isNull())), rests_on)


@register_rule("CLS-02")
def commodity_code_length(catalog: Catalog, rule: dict) -> Check:
    way, codes = F.col("anmeldung.richtung"), F.col("anmeldung.warennummern")
    expected = F.lit(None).cast("int")
    for name, length in rule["parameters"]["length_by_direction"].items():
        expected = F.when(way == name, length).otherwise(expected)
    clean = lambda n: F.regexp_replace(n, r"\s", "")
    wrong = F.exists(codes, lambda n: (F.length(clean(n)) != expected) | ~clean(n).rlike("^[0-9]+$"))
    gaps = missing(("anmeldung.richtung", F.coalesce(way, F.lit("")) == ""), ("anmeldung.warennummern", codes.isNull()))
    return Check(gaps, bad=F.coalesce(wrong, F.lit(False)), unchecked=expected.isNull())


@register_rule("QTY-01")
def quantities_agree(catalog: Catalog, rule: dict) -> Check:
    none = F.array().cast(INVOLVED)

    def of_line(p: Column) -> Column:
        same = lambda q: q["nr"]["v"].eqNullSafe(p["nr"]["v"])
        open_ = F.coalesce(first(rows("packliste.backorders"), same)["menge"]["v"], F.lit(0.0))
        return let(F.struct(first(rows("packliste.positionen"), same).alias("pack"), open_.alias("offen")), lambda d: compared(p, d["pack"], d["offen"]))

    def compared(p: Column, pack: Column, open_: Column) -> Column:
        equal = F.coalesce(p["menge"]["v"] == pack["menge"]["v"] - open_, F.lit(False))
        rests_on = F.array(item_involved("rechnung.positionen", p, "menge"), item_involved("packliste.positionen", pack, "menge"))
        return F.struct((pack.isNull() | ~equal).alias("bad"), F.when(pack.isNull() | equal, none).otherwise(rests_on).alias("on"))

    lines = F.transform(rows("rechnung.positionen"), of_line)
    gaps = missing(("rechnung.positionen", items("rechnung.positionen").isNull()), ("packliste.positionen", items("packliste.positionen").isNull()))
    rests_on = F.flatten(F.transform(lines, lambda x: x["on"]))
    return Check(gaps, rests_on, F.exists(lines, lambda x: x["bad"]))


@register_rule("QTY-02")
def gross_weights_agree(catalog: Catalog, rule: dict) -> Check:
    pack, bl = fact("packliste.brutto_gesamt_kg"), fact("bill_of_lading.brutto_kg")
    apart = F.abs(pack - bl)
    tolerance = F.greatest(F.lit(float(rule["tolerance"]["absolute_kg"])), rule["tolerance"]["relative"] * pack)
    relative = F.when(pack > 0, apart / F.when(pack > 0, pack)).otherwise(F.lit(float("inf")))
    hardness = F.when(relative >= rule["escalate_to_hard_at"]["relative"], "hard").otherwise("soft")
    names = ("packliste.brutto_gesamt_kg", "bill_of_lading.brutto_kg")
    return Check(null_paths(*names), F.array(*map(head_involved, names)), ~(apart <= tolerance), hardness=hardness)


@register_rule("QTY-03")
def package_weights(catalog: Catalog, rule: dict) -> Check:
    path, none = "packliste.packstuecke", F.array().cast(INVOLVED)

    def of_package(p: Column) -> Column:
        net, gross = p["netto_kg"]["v"], p["brutto_kg"]["v"]
        heavy = F.coalesce(net > 0, F.lit(False))
        return (
            F.when(~heavy, F.array(item_involved(path, p, "netto_kg")))
            .when(~F.coalesce(gross >= net, F.lit(False)), F.array(item_involved(path, p, "brutto_kg"), item_involved(path, p, "netto_kg")))
            .otherwise(none)
        )

    single = F.flatten(F.transform(rows(path), of_package))
    total = F.aggregate(rows(path), F.lit(0.0), lambda s, p: s + F.coalesce(p["brutto_kg"]["v"], F.lit(0.0)))
    # a total that is stated as null counts as 0
    over = there("packliste.brutto_gesamt_kg") & (total > F.coalesce(fact("packliste.brutto_gesamt_kg"), F.lit(0.0)))
    all_gross = F.concat(F.array(head_involved("packliste.brutto_gesamt_kg")), F.transform(rows(path), lambda p: item_involved(path, p, "brutto_kg")))
    rests_on = F.concat(single, F.when(over, all_gross).otherwise(none))
    return Check(missing((path, items(path).isNull())), rests_on)


CONTAINERS = ("bill_of_lading.container_id", "packliste.container_id")


@register_rule("TRN-01")
def containers_agree(catalog: Catalog, rule: dict) -> Check:
    a, b = (container_id(fact(p)) for p in CONTAINERS)
    return Check(null_paths(*CONTAINERS), F.array(*map(head_involved, CONTAINERS)), a != b)


@register_rule("TRN-02")
def container_digits(catalog: Catalog, rule: dict) -> Check:
    wrong = F.array_compact(F.array(*[F.when(fact(p).isNotNull() & ~container_ok(fact(p)), head_involved(p)) for p in CONTAINERS]))
    nothing = fact(CONTAINERS[0]).isNull() & fact(CONTAINERS[1]).isNull()
    return Check(missing(*[(p, nothing) for p in CONTAINERS]), wrong)


@register_rule("REF-03")
def final_documents_only(catalog: Catalog, rule: dict) -> Check:
    final = F.transform(F.filter(F.coalesce(F.col("dokumente"), F.array().cast("array<struct<ord: int, id: string, typ: string, status: string>>")), lambda d: d["status"] == FINAL), lambda d: d["typ"])
    bad = F.exists("nicht_final", lambda a: ~F.exists(final, lambda t: t.eqNullSafe(a["dok_typ"])))
    return Check(bad=F.coalesce(bad, F.lit(False)))


@register_rule("CUS-05")
def export_document_covers(catalog: Catalog, rule: dict) -> Check:
    digits, none = rule["parameters"]["digits"], F.array().cast(INVOLVED)
    declared, invoiced = rows("abd.positionen"), rows("rechnung.positionen")

    def of_declared(p: Column) -> Column:
        return let(first(invoiced, lambda q: q["nr"]["v"].eqNullSafe(p["nr"]["v"])), lambda line: compared(p, line))

    def compared(p: Column, line: Column) -> Column:
        code, other = commodity_code(p["warennummer"]["v"], digits), commodity_code(line["hs6"]["v"], digits)
        return (
            F.when(line.isNull(), F.array(item_involved("abd.positionen", p, "nr")))
            .when(code.isNull(), F.array(item_involved("abd.positionen", p, "warennummer")))
            .when(F.coalesce(code != other, F.lit(False)), F.array(item_involved("abd.positionen", p, "warennummer"), item_involved("rechnung.positionen", line, "hs6")))
            .otherwise(none)
        )

    only_invoiced = F.filter(invoiced, lambda q: ~F.exists(declared, lambda p: p["nr"]["v"].eqNullSafe(q["nr"]["v"])))
    abd, pack = fact("abd.container_id"), fact("packliste.container_id")
    moved = F.coalesce((abd != "") & (pack != "") & (container_id(abd) != container_id(pack)), F.lit(False))
    rests_on = F.concat(
        F.flatten(F.transform(declared, of_declared)),
        F.transform(only_invoiced, lambda q: item_involved("rechnung.positionen", q, "nr")),
        F.when(moved, F.array(head_involved("abd.container_id"), head_involved("packliste.container_id"))).otherwise(none),
    )
    nothing = items("abd.positionen").isNull() & (F.coalesce(abd, F.lit("")) == "")
    gaps = missing(("abd.positionen", nothing), ("abd.container_id", nothing), ("rechnung.positionen", ~nothing & items("rechnung.positionen").isNull()))
    return Check(gaps, rests_on)


def results(cases: DataFrame, catalog: Catalog, wanted: list[dict], asked: Callable[[str], Column] | None = None) -> tuple[DataFrame, list[Column]]:
    """cases with each rule's parts as columns, worked out once, and an expression of each rule's finding over them.

    asked: whether a case asks for a rule by its id; its parts are null and not worked out where it doesn't."""
    parts, found = {}, []
    for r in wanted:
        check, k = RULES[r["id"]](catalog, r), r["id"]
        none, no, on = F.lit(None), F.lit(False), f"_on_{k}"
        parts[on] = no_items() if check.on is None else check.on
        parts[f"_gaps_{k}"] = (none if check.gaps is None else let(check.gaps, lambda g: F.when(F.size(g) > 0, g))).cast(PATHS)
        if check.bad is not None:
            parts[f"_bad_{k}"] = F.coalesce(check.bad, no)
        fine = no if check.fine is None else check.fine
        unchecked = no if check.unchecked is None else check.unchecked
        bad = F.size(F.col(f"`{on}`")) > 0 if check.bad is None else F.col(f"`_bad_{k}`")
        unsure = F.exists(F.col(f"`{on}`"), lambda p: p["konf"] < catalog.low_confidence_below)
        gaps = F.col(f"`_gaps_{k}`")
        status = F.when(fine, OK).when(gaps.isNotNull() | unchecked, UNCHECKABLE).when(~bad, OK).when(unsure, REREAD).otherwise(VIOLATED)
        parts[f"_s_{k}"], s = status, F.col(f"`_s_{k}`")
        names = F.transform(F.col(f"`{on}`"), lambda p: p["pfad"])
        reread = F.transform(F.filter(F.col(f"`{on}`"), lambda p: p["konf"] < catalog.low_confidence_below), lambda p: p["pfad"])
        found.append(
            F.struct(
                F.lit(k).alias("regel"), s.alias("status"), F.when(s == VIOLATED, none if check.hardness is None else check.hardness).cast("string").alias("haerte_effektiv"),
                F.when(s == UNCHECKABLE, F.coalesce(gaps, F.array().cast(PATHS))).alias("fehlende_pfade"), F.when(s == REREAD, reread).alias("nachzulesende_pfade"),
                F.when(s.isin(VIOLATED, REREAD), names).alias("pfade"),
            )
        )
    status = {c: e for c, e in parts.items() if c.startswith("_s_")}
    rest = {c: e for c, e in parts.items() if c not in status}
    if asked is not None:
        status, rest = ({c: F.when(asked(c.rpartition("_")[2]), e) for c, e in of.items()} for of in (status, rest))
    return cases.withColumns(rest).withColumns(status), found


def findings(cases: DataFrame, catalog: Catalog, only: list[str] | None = None) -> DataFrame:
    """A row for each case and rule that is in force on the case's date, with the rule's data from the catalogue."""
    wanted = [r for r in catalog.rules["rules"] if r["id"] in RULES and (only is None or r["id"] in only)]
    checked, found = results(cases, catalog, wanted)
    return with_catalog(checked.select("akte_id", "stichtag", F.explode(F.array(*found)).alias("x")).select("akte_id", "stichtag", "x.*"), catalog)


def with_catalog(long: DataFrame, catalog: Catalog) -> DataFrame:
    """Findings of rules that are in force, with the rule's data; hard rules first, each in catalogue order."""
    spark = long.sparkSession
    valid = (F.col("valid_from").isNull() | (F.col("stichtag") >= F.col("valid_from"))) & (F.col("valid_to").isNull() | (F.col("stichtag") < F.col("valid_to")))
    return (
        long.join(F.broadcast(catalog.rule_table(spark)), "regel").where(valid)
        .withColumn("haerte_effektiv", F.coalesce("haerte_effektiv", "haerte"))
        .withColumn("regelversion", F.concat(F.lit(f"{catalog.version}@"), F.date_format("valid_from", "yyyy-MM-dd")))
        .withColumn("rang", F.when(F.col("haerte") == "hard", F.col("ordnung")).otherwise(F.col("ordnung") + 1000))
    )


def not_implemented(spark, catalog: Catalog) -> DataFrame:  # noqa: ANN001
    """Rules of the catalogue that no function is registered for."""
    known = spark.createDataFrame([(r,) for r in RULES], "regel string")
    return catalog.rule_table(spark).join(F.broadcast(known), "regel", "left_anti").select("regel", "name")
