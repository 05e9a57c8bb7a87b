"""From what documents say to what a case holds true.

Assertions are long rows (akte_id, ord, dokument, pfad, value, konfidenz, ...). Only
final documents feed facts, and the last assertion of a path wins. Facts become one
row for each case: header facts are structs, lists are arrays of structs in the
order of their index. A case has few lines, so its row is small, and one shuffle by
akte_id serves all rules.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wharfline.operators.sheets import spread

FINAL = "final"

#: Header facts and their types. Paths are fixed values.
HEADER = {
    "rechnung.nummer": "string", "rechnung.waehrung": "string", "rechnung.zuschlaege": "double", "rechnung.rabatte": "double", "rechnung.gesamt": "double",
    "packliste.container_id": "string", "packliste.brutto_gesamt_kg": "double",
    "bill_of_lading.nummer": "string", "bill_of_lading.container_id": "string", "bill_of_lading.brutto_kg": "double",
    "praeferenznachweis.typ": "string", "praeferenznachweis.ursprung": "string", "praeferenznachweis.rex_nummer": "string",
    "praeferenznachweis.ermaechtigter_ausfuehrer": "boolean", "praeferenznachweis.ursprungswert": "double",
    "abd.mrn": "string", "abd.container_id": "string",
}
#: Lists and the types of their items' fields.
LISTS = {
    "rechnung.positionen": {"nr": "double", "hs6": "string", "ursprung": "string", "menge": "double", "einzelpreis": "double", "netto": "double", "zollwert": "double", "bewertungsmethode": "string"},
    "packliste.positionen": {"nr": "double", "hs6": "string", "menge": "double"},
    "packliste.packstuecke": {"id": "string", "brutto_kg": "double", "netto_kg": "double"},
    "packliste.backorders": {"nr": "double", "menge": "double"},
    "praeferenznachweis.warenkreis": {"pos": "double", "hs6": "string"},
    "abd.positionen": {"nr": "double", "warennummer": "string"},
}
VALUE = {"string": "txt", "double": "num", "boolean": "bool"}
FACT = "v {0}, konf double, dok_typ string, dok string, da boolean"


def column_of(path: str) -> str:
    return path.replace(".", "_")


def fact_type(kind: str) -> str:
    return f"struct<v: {kind}, konf: double, dok_typ: string, dok: string, da: boolean>"


def list_type(path: str) -> str:
    return "array<struct<idx: int, " + ", ".join(f"{f}: {fact_type(kind)}" for f, kind in LISTS[path].items()) + ">>"


def assertion_document(assertions: DataFrame, documents: DataFrame) -> DataFrame:
    """Assertions with their document's status and type (null: unknown document)."""
    docs = documents.select("akte_id", F.col("dokument_id").alias("dokument"), F.col("typ").alias("dok_typ"), F.col("status").alias("dok_status"), F.lit(True).alias("dok_bekannt"))
    # rows of documents shrink to few bytes, so adaptive execution would sort very many of them in one task
    return spread(assertions, "akte_id", "dokument").join(spread(docs, "akte_id", "dokument"), ["akte_id", "dokument"], "left")


def facts_long(assertions: DataFrame, documents: DataFrame) -> DataFrame:
    """One row for each case and path: the last assertion of a final document, with its provenance."""
    final = spread(assertion_document(assertions, documents).where(F.col("dok_status") == FINAL), "akte_id", "pfad")
    last = F.max_by(F.struct("txt", "num", "bool", "kind", F.coalesce("konfidenz", F.lit(1.0)).alias("konf"), "dokument", "dok_typ", "seite", "methode"), F.col("ord"))
    return final.groupBy("akte_id", "pfad").agg(last.alias("f")).select("akte_id", "pfad", "f.*")


def not_final(assertions: DataFrame, documents: DataFrame) -> DataFrame:
    """Assertions of documents that are known but not final."""
    return assertion_document(assertions, documents).where(F.col("dok_bekannt") & ~F.col("dok_status").eqNullSafe(FINAL))


def orphans(assertions: DataFrame, documents: DataFrame) -> DataFrame:
    """Assertions of documents that the case doesn't have."""
    docs = documents.select("akte_id", F.col("dokument_id").alias("dokument"))
    return assertions.join(docs, ["akte_id", "dokument"], "left_anti")


def documents_by_type(documents: DataFrame, typ: str, final_only: bool = False) -> DataFrame:
    found = documents.where(F.col("typ") == typ)
    return found.where(F.col("status") == FINAL) if final_only else found


def unclassified(documents: DataFrame) -> DataFrame:
    """akte_id, nicht_klassifiziert: the ids of a case's documents that no type was found for, in their order."""
    found = documents.where(F.col("typ") == "unclassified")
    return found.groupBy("akte_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "dokument_id"))), lambda d: d["dokument_id"]).alias("nicht_klassifiziert"))


def split_path(path: Column) -> dict[str, Column]:
    """bereich.liste.idx.feld of a list path; idx is null for other paths."""
    pattern = r"^(\w+\.\w+)\.(\d+)\.(\w+)$"
    return {"liste": F.regexp_extract(path, pattern, 1), "idx": F.regexp_extract(path, pattern, 2).try_cast("int"), "feld": F.regexp_extract(path, pattern, 3)}


def _fact(kind: str) -> Column:
    return F.struct(F.col(VALUE[kind]).cast(kind).alias("v"), F.col("konf"), F.col("dok_typ"), F.col("dokument").alias("dok"), F.lit(True).alias("da")).cast(fact_type(kind))


def case_rows(cases: DataFrame, facts: DataFrame, documents: DataFrame, drafts: DataFrame) -> DataFrame:
    """cases (akte_id, stichtag, sachverhalt, anmeldung, ...) with all facts: the input of the rules."""
    parts = facts.withColumns(split_path(F.col("pfad")))
    head = parts.where("idx is null").groupBy("akte_id").agg(*[F.max_by(_fact(kind), F.when(F.col("pfad") == p, 1)).alias(column_of(p)) for p, kind in HEADER.items()])
    item = parts.where("idx is not null").groupBy("akte_id", "liste", "idx")
    fields = {(f, kind) for kinds in LISTS.values() for f, kind in kinds.items()}
    item = item.agg(*[F.max_by(_fact(kind), F.when(F.col("feld") == f, 1)).alias(f"{f}_{kind}") for f, kind in sorted(fields)])
    lists = item.groupBy("akte_id").agg(
        *[
            F.array_sort(F.collect_list(F.when(F.col("liste") == p, F.struct("idx", *[F.col(f"{f}_{k}").alias(f) for f, k in kinds.items()])))).cast(list_type(p)).alias(column_of(p))
            for p, kinds in LISTS.items()
        ]
    ).withColumns({column_of(p): F.when(F.size(column_of(p)) > 0, F.col(column_of(p))) for p in LISTS})
    docs = documents.groupBy("akte_id").agg(F.array_sort(F.collect_list(F.struct("ord", F.col("dokument_id").alias("id"), "typ", "status"))).alias("dokumente"))
    entwurf = drafts.groupBy("akte_id").agg(F.collect_list(F.struct("dokument", "dok_typ", "dok_status", "pfad")).alias("nicht_final"))
    return cases.join(head, "akte_id", "left").join(lists, "akte_id", "left").join(docs, "akte_id", "left").join(entwurf, "akte_id", "left")
