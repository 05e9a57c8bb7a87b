"""Evidence matrix, overrides, release decisions and their audit trail."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wharfline.functions.steps import let
from wharfline.operators.facts import HEADER, LISTS, column_of, list_type
from wharfline.operators.rules import OK, REREAD, RULES, UNCHECKABLE, VIOLATED, first, results
from wharfline.sources.catalog import Catalog, condition

READY, WARNINGS, READ_AGAIN, BLOCKED = "freigabereif", "freigabe_mit_warnungen", "nachextraktion_erforderlich", "blockiert"
ABSENT, WRONG_EVIDENCE = "fehlt", "falscher_nachweis"
#: Characters that a reason for an override needs.
MIN_REASON = 11


def _value(path: str) -> tuple[Column, Column | None]:
    """(value as text, type of the document it comes from or None for master data)."""
    if path in HEADER:
        c = F.col(column_of(path))
        return c["v"].cast("string"), c["dok_typ"]
    head, _, field = path.rpartition(".")
    liste, _, index = head.rpartition(".")
    if liste in LISTS and index.isdigit():
        item = first(F.coalesce(F.col(column_of(liste)), F.expr(f"cast(array() as {list_type(liste)})")), lambda x: x["idx"] == int(index))[field]
        return item["v"].cast("string"), item["dok_typ"]
    return F.col(path).cast("string"), None


def in_scope(scope: dict | None) -> Column:
    """Direction, mode and preference of the case; what the scope doesn't name is open."""
    fits = F.lit(True)
    for key, name in (("direction", "richtung"), ("mode", "verkehrstraeger")):
        if scope and scope.get(key):
            fits &= F.coalesce(F.col(f"sachverhalt.{name}") == scope[key], F.lit(False))
    if scope and "preference_claimed" in scope:
        fits &= F.coalesce(F.col("sachverhalt.praeferenz_beansprucht"), F.lit(False)) == scope["preference_claimed"]
    return fits


def entries(catalog: Catalog) -> list[Column]:
    """A struct for each entry of the matrix, null where it doesn't apply to the case."""
    found = []
    for k, entry in enumerate(catalog.evidence["entries"]):
        value, source = _value(entry["required_data"])
        accepted = F.array(*map(F.lit, entry["required_evidence"]))
        status = F.when(F.coalesce(value, F.lit("")) == "", ABSENT)
        if source is not None:
            status = status.when(source.isNotNull() & ~F.array_contains(accepted, F.coalesce(source, F.lit(""))), WRONG_EVIDENCE)
        status = status.otherwise(OK)
        # fixed texts
        wrong = F.concat(F.lit(f"{entry['label']}: stammt aus "), F.lit("stammdaten") if source is None else source, F.lit(", zugelassen sind " + ", ".join(entry["required_evidence"])))
        reason = F.when(status == ABSENT, f"{entry['label']}: kein Nachweis in der Akte").when(status == WRONG_EVIDENCE, wrong).otherwise(f"{entry['label']} nachgewiesen")
        when = condition(entry.get("condition"))
        applies = F.lit(True) if when is None else F.coalesce(F.col(when[0]) == when[1], F.lit(False))
        found.append(
            F.when(
                applies,
                F.struct(
                    F.lit(entry["id"]).alias("id"), F.lit(k).alias("ordnung"), F.lit(entry["required_data"]).alias("required_data"), F.lit(entry["label"]).alias("label"), F.lit(entry["hardness"]).alias("haerte"),
                    accepted.alias("akzeptierte_nachweise"), status.alias("status"), F.coalesce(source if source is not None else F.lit(None), F.lit("stammdaten")).alias("quelle"), reason.alias("begruendung"),
                ),
            )
        )
    return found


def evidence(cases: DataFrame, catalog: Catalog) -> DataFrame:
    """A row for each case in scope and entry that applies: akte_id, id, status, haerte, quelle, begruendung, ..."""
    rows = cases.where(in_scope(catalog.evidence.get("scope"))).select("akte_id", F.explode(F.array_compact(F.array(*entries(catalog)))).alias("e"))
    return rows.select("akte_id", "e.*").withColumn("fassung", F.lit(catalog.evidence_version))


def _all(cases: DataFrame, catalog: Catalog, asked: Callable[[str], Column] | None = None) -> tuple[DataFrame, Column]:
    """cases with the rules' parts, and an array of all findings of a case: rules in force, then entries of the matrix; of those asked for, if asked is given."""
    checked, found = results(cases, catalog, [r for r in catalog.rules["rules"] if r["id"] in RULES], asked)
    of = {r["id"]: r for r in catalog.rules["rules"]}
    day = lambda d: F.lit(d).cast("date")
    all_ = []
    for f, r in zip(found, [r for r in of.values() if r["id"] in RULES], strict=True):
        valid = F.lit(True) if asked is None else asked(r["id"])
        if r.get("valid_from"):
            valid &= F.col("stichtag") >= day(r["valid_from"])
        if r.get("valid_to"):
            valid &= F.col("stichtag") < day(r["valid_to"])
        fassung = F.lit(f"{catalog.version}@{r.get('valid_from')}")
        all_.append(F.when(valid, _common(F.lit(r["id"]), "regel", f["status"], F.coalesce(f["haerte_effektiv"], F.lit(r["hardness"])), fassung)))
    scope = in_scope(catalog.evidence.get("scope"))
    for entry, e in zip(catalog.evidence["entries"], entries(catalog), strict=True):
        of_entry = lambda x: F.when(x.isNotNull(), _common(F.lit(entry["id"]), "nachweis", x["status"], F.lit(entry["hardness"]), F.lit(catalog.evidence_version)))  # noqa: B023, E731
        all_.append(F.when(scope if asked is None else asked(entry["id"]) & scope, let(e, of_entry)))
    return checked, F.array_compact(F.array(*all_))


def all_findings(cases: DataFrame, catalog: Catalog) -> DataFrame:
    """Findings of rules in force and of the matrix as one long table, from one pass over the cases:
    akte_id, kennung, art, status, haerte, fassung."""
    checked, found = _all(cases, catalog)
    return checked.select("akte_id", F.explode(found).alias("x")).select("akte_id", "x.*")


def judge(cases: DataFrame, catalog: Catalog, overrides: DataFrame, overridden: bool = False) -> DataFrame:
    """akte_id, befunde: a case's findings with their overrides, as an array. Overrides come to the case's row, so
    decisions and audits read one table that is neither exploded nor shuffled again. overridden: only cases that have
    overrides, with the findings that these name; nothing else is judged."""
    named = lambda kennung: F.coalesce(F.exists("_overrides", lambda x: x["o"]["kennung"] == kennung), F.lit(False))
    # the semi join goes below the columns of the cases' rows, which are only made for what it leaves
    wanted = cases.join(overrides.select("akte_id"), "akte_id", "left_semi") if overridden else cases
    checked, found = _all(wanted.join(_by_case(overrides), "akte_id", "left"), catalog, named if overridden else None)
    own = lambda x: [x[c].alias(c) for c in ("kennung", "art", "status", "haerte", "fassung")]
    applied = lambda x: F.when(named(x["kennung"]), _applied(x["kennung"], x["fassung"]))
    with_overrides = F.transform("_found", lambda x: let(applied(x), lambda a: F.struct(*own(x), a["uebersteuert"].alias("uebersteuert"), a["verbraucht"].alias("verbraucht"))))
    return checked.select("akte_id", "_overrides", found.alias("_found")).select("akte_id", with_overrides.alias("befunde"))


def overridden_findings(judged: DataFrame) -> DataFrame:
    """A row for each finding of judged cases that an override names."""
    # of a filtered array: of the bare column, a condition on its size would be pushed down as all rules, worked out once more
    return judged.select("akte_id", F.inline(F.filter("befunde", lambda x: x["uebersteuert"].isNotNull() | x["verbraucht"].isNotNull())))


def _common(kennung: Column, art: str, status: Column, haerte: Column, fassung: Column) -> Column:
    return F.struct(kennung.alias("kennung"), F.lit(art).alias("art"), status.alias("status"), haerte.alias("haerte"), fassung.alias("fassung"))


def reason_ok(reason: Column) -> Column:
    return F.coalesce(F.length(F.trim(reason)) >= MIN_REASON, F.lit(False))


def form_errors(overrides: DataFrame) -> DataFrame:
    """Adds `formfehler`: what an override lacks."""
    gap = lambda c: F.when(F.coalesce(F.col(c), F.lit("")) == "", F.lit(f"{c} fehlt"))
    reason = F.when(~reason_ok(F.col("begruendung")), F.lit(f"begruendung braucht mindestens {MIN_REASON} Zeichen"))
    return overrides.withColumn("formfehler", F.array_compact(F.array(gap("regel"), gap("benutzer"), gap("fassung"), reason)))


def _by_case(overrides: DataFrame) -> DataFrame:
    """The overrides of each case as an array, in their order; `nr` tells them apart."""
    formed = form_errors(overrides).select("akte_id", F.struct("ord", F.col("regel").alias("kennung"), "fassung", "benutzer", "erzeugt_am", "begruendung", F.coalesce("identitaet", F.lit("angegeben")).alias("identitaet"), (F.size("formfehler") == 0).alias("formrichtig")).alias("o"))
    gathered = formed.groupBy("akte_id").agg(F.array_sort(F.collect_list("o")).alias("_o"))
    return gathered.select("akte_id", F.transform("_o", lambda o, k: F.struct(k.alias("nr"), o.alias("o"))).alias("_overrides"))


def _applied(kennung: Column, fassung: Column) -> Column:
    """uebersteuert (the first well-formed override of the same version, or null) and verbraucht (all others of the finding).
    The finding's overrides and the one in force are looked for once."""

    def split(own: Column, valid: Column) -> Column:
        o = valid["o"]
        held = F.when(valid.isNotNull(), F.struct(o["benutzer"].alias("benutzer"), o["erzeugt_am"].alias("erzeugt_am"), o["begruendung"].alias("begruendung"), o["identitaet"].alias("identitaet")))
        used = F.transform(F.filter(own, lambda x: ~x["nr"].eqNullSafe(valid["nr"])), lambda x: F.struct(*[x["o"][c].alias(c) for c in ("ord", "benutzer", "fassung", "erzeugt_am")]))
        return F.struct(held.alias("uebersteuert"), F.when(F.size(own) > 0, used).alias("verbraucht"))

    in_force = lambda own: first(own, lambda x: x["o"]["formrichtig"] & F.coalesce(x["o"]["fassung"] == fassung, F.lit(False)))
    return let(F.filter("_overrides", lambda x: x["o"]["kennung"] == kennung), lambda own: let(in_force(own), lambda valid: split(own, valid)))


def attach_overrides(found: DataFrame, overrides: DataFrame) -> DataFrame:
    """found with the overrides of its case and identifier: the first well-formed one of the same version is
    in force, all others are used up and stay listed."""
    applied = found.join(_by_case(overrides), "akte_id", "left").withColumn("_applied", _applied(F.col("kennung"), F.col("fassung")))
    return applied.select(*found.columns, "_applied.uebersteuert", "_applied.verbraucht")


def _level(x: Column) -> Column:
    """How far a finding stands in the way of a release: 3 blocks, 2 asks for reading again, 1 warns."""
    rule = x["art"] == "regel"
    blocks = (x["haerte"] == "hard") & F.when(rule, x["status"].isin(VIOLATED, UNCHECKABLE)).otherwise(x["status"] != OK)
    return F.when(blocks, 3).when(rule & (x["status"] == REREAD), 2).when(x["status"] != OK, 1).otherwise(0)


def _decision(level: Column) -> Column:
    return F.when(level == 3, BLOCKED).when(level == 2, READ_AGAIN).when(level == 1, WARNINGS).otherwise(READY)


def decide_judged(judged: DataFrame) -> DataFrame:
    """akte_id, freigabe, freigabe_nach_override of judged cases: a column of each row, no shuffle."""
    kept = F.filter("befunde", lambda x: x["uebersteuert"].isNull())
    return judged.select("akte_id", _decision(F.array_max(F.transform("befunde", _level))).alias("freigabe"), _decision(F.array_max(F.transform(kept, _level))).alias("freigabe_nach_override"))


def decide(found: DataFrame, cases: DataFrame) -> DataFrame:
    """Decision of each case from a long table of findings, and the one that leaves overridden findings out."""
    level = _level({c: F.col(c) for c in ("art", "haerte", "status")})
    over = F.col("uebersteuert").isNull() if "uebersteuert" in found.columns else F.lit(True)
    levels = found.groupBy("akte_id").agg(F.max(level).alias("_a"), F.max(F.when(over, level)).alias("_b"))
    return cases.select("akte_id").join(levels, "akte_id", "left").select("akte_id", _decision(F.col("_a")).alias("freigabe"), _decision(F.col("_b")).alias("freigabe_nach_override"))


def with_case_data(decided: DataFrame, cases: DataFrame, passed: tuple[str, ...] = ("customs_cutoff", "carrier_cutoff", "eta", "extraktion")) -> DataFrame:
    """Decisions with the deadlines and the extraction's notes of their case, handed on as they are."""
    return decided.join(cases.select("akte_id", *[c for c in passed if c in cases.columns]), "akte_id", "left")


def override_audit(found: DataFrame) -> DataFrame:
    """Overrides in force and used up, as one table (angewandt and verbraucht), from one pass over findings with overrides."""
    row = lambda who, effect: F.struct(who.alias("benutzer"), F.lit(effect).alias("wirkung"))
    applied = F.when(F.col("uebersteuert").isNotNull(), F.array(row(F.col("uebersteuert.benutzer"), "angewandt")))
    used = F.transform("verbraucht", lambda v: row(v["benutzer"], "verbraucht"))
    none = F.array().cast("array<struct<benutzer: string, wirkung: string>>")
    return found.select("akte_id", "kennung", F.explode(F.concat(F.coalesce(applied, none), F.coalesce(used, none))).alias("v")).select("akte_id", "kennung", "v.*")


def with_identity(overrides: DataFrame, header_user: str = "kopf_benutzer") -> DataFrame:
    """A name that the proxy vouches for replaces a typed one."""
    return overrides.withColumn("identitaet", F.when(F.col(header_user).isNotNull(), "proxy").otherwise("angegeben")).withColumn("benutzer", F.coalesce(header_user, "benutzer")).drop(header_user)
