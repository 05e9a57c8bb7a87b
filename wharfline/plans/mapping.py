"""Trade cases derived from the star-schema tables: an order is a case, its lines are
invoice lines, and deviations come from the keys. The derivation is SQL that Spark and
the oracle both run; the rules on top of it are written apart for each.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wharfline.operators.facts import HEADER, LISTS, column_of, fact_type, list_type

CASES = """
SELECT o_orderkey AS akte_id, o_orderdate,
       o_orderkey % 30 - 3 AS tag,
       CASE WHEN o_orderkey % 19 = 0 THEN 'import_de' ELSE 'export_third_country' END AS richtung,
       CASE WHEN o_orderkey % 23 = 0 THEN 'air' ELSE 'sea' END AS verkehrstraeger,
       o_orderkey % 3 <> 0 AS praeferenz,
       CASE WHEN o_orderkey % 27 = 0 THEN NULL ELSE 'FCA' END AS incoterm,
       CASE WHEN o_orderkey % 43 = 0 THEN NULL WHEN o_orderkey % 10 = 0 THEN 'import_de' WHEN o_orderkey % 10 = 1 THEN 'transit' ELSE 'export' END AS anm_richtung
FROM {orders}
"""

LINES = """
SELECT akte_id, nr, menge, netto, hs6, ursprung, konf, hs_konf,
       CASE WHEN (akte_id * 7 + nr) % 97 = 0 THEN 0.0E0 ELSE netto / menge END AS einzelpreis,
       CASE WHEN (akte_id * 7 + nr) % 97 = 0 AND nr % 2 = 0 THEN NULL ELSE netto END AS zollwert,
       CASE WHEN (akte_id * 7 + nr) % 97 = 0 AND akte_id % 4 = 0 THEN 'folgemethode' END AS methode
FROM (
  SELECT akte_id, nr, menge, netto, ursprung, lpad(CAST((partkey * 7919) % 1000000 AS STRING), 6, '0') AS hs6,
         CASE WHEN (akte_id * 31 + nr * 17) % 20 = 0 THEN 0.55E0 ELSE 0.99E0 END AS konf,
         CASE WHEN (akte_id * 13 + nr * 7) % 25 = 0 THEN 0.6E0 ELSE 0.99E0 END AS hs_konf
  FROM (
    SELECT l_orderkey AS akte_id, l_partkey AS partkey, CAST(l_quantity AS DOUBLE) AS menge, round(CAST(l_extendedprice AS DOUBLE), 2) AS netto,
           CASE WHEN l_orderkey % 9 = 0 THEN substr(n_name, 1, 2) ELSE 'DE' END AS ursprung,
           row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_shipdate) AS nr
    FROM {lineitem} JOIN {supplier} ON l_suppkey = s_suppkey JOIN {nation} ON s_nationkey = n_nationkey
  ) numbered
) priced
"""

PACKING = """
SELECT akte_id, nr, konf, hs_konf,
       CASE WHEN (akte_id + nr) % 53 = 0 THEN menge - 1 ELSE menge END AS menge,
       CASE WHEN (akte_id + nr) % 61 = 0 THEN '999999' ELSE hs6 END AS hs6,
       CASE WHEN (akte_id + nr) % 83 = 0 THEN menge ELSE menge * 2 + 1 END AS brutto_kg, menge * 2 AS netto_kg,
       CASE WHEN (akte_id + nr) % 67 = 0 THEN 1.0E0 END AS offen
FROM lines WHERE (akte_id + nr) % 71 <> 0
"""

SCOPE = """
SELECT akte_id, nr AS pos, hs_konf, CASE WHEN (akte_id + nr) % 59 = 0 THEN '888888' ELSE hs6 END AS hs6
FROM lines WHERE akte_id % 13 <> 0
"""

DECLARED = """
SELECT akte_id, nr, hs_konf, CASE WHEN (akte_id + nr) % 79 = 0 THEN '77777700' ELSE hs6 || '00' END AS warennummer
FROM lines WHERE (akte_id + nr) % 73 <> 0
"""

SUMS = """
SELECT l.akte_id, CAST(sum(CAST(round(l.netto * 100) AS BIGINT)) AS DOUBLE) / 100 AS netto_summe, count(*) AS n_lines, sum(p.brutto_kg) AS brutto_summe
FROM lines l LEFT JOIN packing p ON p.akte_id = l.akte_id AND p.nr = l.nr GROUP BY l.akte_id
"""

HEADS = """
SELECT {carry}, s.netto_summe, s.n_lines, s.brutto_summe,
       s.netto_summe + c.akte_id % 5 - c.akte_id % 3 + CASE WHEN c.akte_id % 41 = 0 THEN 1 ELSE 0 END AS gesamt,
       CAST(c.akte_id % 5 AS DOUBLE) AS zuschlaege, CAST(c.akte_id % 3 AS DOUBLE) AS rabatte,
       s.brutto_summe - CASE WHEN c.akte_id % 47 = 0 THEN 1 ELSE 0 END AS brutto_gesamt,
       CASE WHEN c.akte_id % 29 = 0 THEN NULL ELSE s.brutto_summe * (1 + (c.akte_id % 7) * 0.02E0) END AS bl_brutto,
       CASE WHEN c.akte_id % 29 = 0 THEN NULL ELSE container END AS bl_container,
       CASE WHEN c.akte_id % 33 = 0 THEN 'HLXU8765430' ELSE container END AS pack_container,
       CASE WHEN c.akte_id % 101 = 0 THEN 'HLXU8765430' ELSE container END AS abd_container,
       CASE WHEN c.akte_id % 17 = 0 THEN 'atr' WHEN c.akte_id % 13 = 0 THEN NULL ELSE 'origin_declaration' END AS nachweis_typ,
       CASE WHEN c.akte_id % 13 = 0 THEN NULL ELSE 'DE' END AS nachweis_ursprung,
       CASE WHEN c.akte_id % 11 = 0 THEN NULL WHEN c.akte_id % 11 = 1 THEN 'DEX1' ELSE 'DEREX' || CAST(c.akte_id AS STRING) END AS rex,
       c.akte_id % 22 = 0 AS ermaechtigt,
       CASE WHEN c.akte_id % 37 = 5 THEN 'USD' ELSE 'EUR' END AS waehrung,
       CASE WHEN c.akte_id % 20 = 7 THEN 0.55E0 ELSE 0.99E0 END AS konf
FROM (
  SELECT *, 'MSKU' || ziffern || CAST(CASE WHEN akte_id % 37 = 0 THEN (pruefziffer + 1) % 10 ELSE pruefziffer END AS STRING) AS container
  FROM (
    SELECT *, (424 + 16 * CAST(substr(ziffern, 1, 1) AS INT) + 32 * CAST(substr(ziffern, 2, 1) AS INT) + 64 * CAST(substr(ziffern, 3, 1) AS INT)
           + 128 * CAST(substr(ziffern, 4, 1) AS INT) + 256 * CAST(substr(ziffern, 5, 1) AS INT) + 512 * CAST(substr(ziffern, 6, 1) AS INT)) % 11 % 10 AS pruefziffer
    FROM (SELECT *, lpad(CAST(akte_id % 1000000 AS STRING), 6, '0') AS ziffern FROM cases) digits
  ) checked
) c
LEFT JOIN sums s ON c.akte_id = s.akte_id
"""

VIEWS = {"cases": CASES, "lines": LINES, "packing": PACKING, "scope": SCOPE, "declared": DECLARED, "sums": SUMS, "heads": HEADS}
SOURCES = ("orders", "lineitem", "supplier", "nation")


def oracle(query: str, *names: str) -> str:
    """SQL of the derived tables that a query needs, then the query."""
    wanted = [n for n in VIEWS if n in names] if names else list(VIEWS)
    parts = ",\n".join(f"{n} AS ({VIEWS[n].format(carry="c.akte_id", **{s: s for s in SOURCES})})" for n in wanted)
    return f"WITH {parts}{',' if query.lstrip().startswith('+') else ''}\n{query.lstrip().removeprefix('+')}"


def _sql(spark: SparkSession, sql: str, **found: DataFrame) -> DataFrame:
    """A view's SQL over given tables."""
    text = sql.format(carry="c.*, s._lines", **{s: f"{{{s}}}" for s in SOURCES})
    for name in found:
        text = re.sub(rf"(FROM|JOIN) {name}\b", rf"\1 {{{name}}}", text)
    return spark.sql(text, **{k: v for k, v in found.items() if f"{{{k}}}" in text})


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, CASES, orders=spark.read.parquet(f"{sf_dir}/orders.parquet"))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Invoice lines, each with what the packing list, the proof of origin and the export document say of it."""
    found = {s: spark.read.parquet(f"{sf_dir}/{s}.parquet") for s in ("lineitem", "supplier", "nation")}
    # a nation has a few bytes; a supplier table beyond a broadcast's size is left to a shuffle join
    own = _sql(spark, LINES, **found)
    at = F.col("akte_id") + F.col("nr")
    return own.withColumns(
        {
            "packed": at % 71 != 0, "p_menge": F.when(at % 53 == 0, F.col("menge") - 1).otherwise(F.col("menge")), "p_hs6": F.when(at % 61 == 0, "999999").otherwise(F.col("hs6")),
            "brutto_kg": F.when(at % 83 == 0, F.col("menge")).otherwise(F.col("menge") * 2 + 1), "netto_kg": F.col("menge") * 2, "offen": F.when(at % 67 == 0, 1.0),
            "in_scope": F.col("akte_id") % 13 != 0, "s_hs6": F.when(at % 59 == 0, "888888").otherwise(F.col("hs6")),
            "declared": at % 73 != 0, "warennummer": F.when(at % 79 == 0, "77777700").otherwise(F.concat("hs6", F.lit("00"))),
        }
    )


def _fact(kind: str, value: Column, konf: Column, dok: str) -> Column:
    return F.when(value.isNotNull(), F.struct(value.cast(kind).alias("v"), konf.alias("konf"), F.lit(dok).alias("dok_typ"), F.lit(dok).alias("dok"), F.lit(True).alias("da"))).cast(fact_type(kind))


def _list(path: str, keep: str | None, values: dict[str, tuple[str, str | None]], dok: str) -> Column:
    """A list of the case from its gathered lines; the index is the place in the list, as lines may be missing."""
    kinds = LISTS[path]
    rows = F.col("_lines") if keep is None else F.filter("_lines", lambda x: x[keep] if keep != "offen" else x["packed"] & x["offen"].isNotNull())

    def item(x: Column, i: Column) -> Column:
        fields = {f: (x[v], x[k] if k else F.lit(0.99)) for f, (v, k) in values.items()}
        return F.struct(i.cast("int").alias("idx"), *[_fact(kind, *fields[f], dok).alias(f) for f, kind in kinds.items()])

    # the size is that of the rows: asked of what is made of them, the list would be made twice
    return F.when(F.size(rows) > 0, F.transform(rows, item)).cast(list_type(path))


def case_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Case rows, the input of the rules, from the star-schema tables. Lines are shuffled by their case once and
    gathered there; the other documents' lists are made from the gathered lines."""
    every = lines(spark, sf_dir)
    fields = [c for c in every.columns if c != "akte_id"]
    gathered = every.groupBy("akte_id").agg(
        F.array_sort(F.collect_list(F.struct("nr", *[c for c in fields if c != "nr"]))).alias("_lines"),
        (F.sum(F.round(F.col("netto") * 100).cast("long")).cast("double") / 100).alias("netto_summe"), F.count("*").alias("n_lines"), F.sum(F.when(F.col("packed"), F.col("brutto_kg"))).alias("brutto_summe"),
    )
    # cases meet their gathered lines once; the header facts are columns over that row
    wide = _sql(spark, HEADS, cases=cases(spark, sf_dir), sums=gathered)
    col, one = F.col, F.lit(0.99)
    value = {
        "rechnung.waehrung": (col("waehrung"), one, "handelsrechnung"), "rechnung.zuschlaege": (col("zuschlaege"), one, "handelsrechnung"), "rechnung.rabatte": (col("rabatte"), one, "handelsrechnung"), "rechnung.gesamt": (col("gesamt"), col("konf"), "handelsrechnung"),
        "packliste.container_id": (col("pack_container"), one, "packliste"), "packliste.brutto_gesamt_kg": (col("brutto_gesamt"), one, "packliste"),
        "bill_of_lading.container_id": (col("bl_container"), col("konf"), "bill_of_lading"), "bill_of_lading.brutto_kg": (col("bl_brutto"), col("konf"), "bill_of_lading"),
        "praeferenznachweis.typ": (col("nachweis_typ"), one, "origin_declaration"), "praeferenznachweis.ursprung": (col("nachweis_ursprung"), one, "origin_declaration"), "praeferenznachweis.rex_nummer": (col("rex"), one, "origin_declaration"),
        "praeferenznachweis.ermaechtigter_ausfuehrer": (col("ermaechtigt"), one, "origin_declaration"), "praeferenznachweis.ursprungswert": (col("gesamt"), col("konf"), "origin_declaration"),
        "abd.mrn": (F.concat(F.lit("26DE"), col("akte_id").cast("string")), one, "abd"), "abd.container_id": (col("abd_container"), one, "abd"),
    }
    heads = [(_fact(kind, *value[p]) if p in value else F.lit(None).cast(fact_type(kind))).alias(column_of(p)) for p, kind in HEADER.items()]
    none = None
    lists = {
        "rechnung.positionen": (none, {"nr": ("nr", none), "hs6": ("hs6", "hs_konf"), "ursprung": ("ursprung", none), "menge": ("menge", "konf"), "einzelpreis": ("einzelpreis", "konf"), "netto": ("netto", "konf"), "zollwert": ("zollwert", none), "bewertungsmethode": ("methode", none)}, "handelsrechnung"),
        "packliste.positionen": ("packed", {"nr": ("nr", none), "hs6": ("p_hs6", none), "menge": ("p_menge", none)}, "packliste"),
        "packliste.packstuecke": ("packed", {"id": ("nr", none), "brutto_kg": ("brutto_kg", "konf"), "netto_kg": ("netto_kg", none)}, "packliste"),
        "packliste.backorders": ("offen", {"nr": ("nr", none), "menge": ("offen", none)}, "packliste"),
        "praeferenznachweis.warenkreis": ("in_scope", {"pos": ("nr", none), "hs6": ("s_hs6", none)}, "origin_declaration"),
        "abd.positionen": ("declared", {"nr": ("nr", none), "warennummer": ("warennummer", "hs_konf")}, "abd"),
    }
    draft = col("akte_id") % 29 == 0
    codes = F.transform("_lines", lambda x: F.when((col("akte_id") % 31 == 0) & (x["nr"] == 1), x["hs6"]).otherwise(F.concat(x["hs6"], F.lit("00"))))
    doc = lambda k, typ, status: F.struct(F.lit(k).alias("ord"), F.lit(typ).alias("id"), F.lit(typ).alias("typ"), status.alias("status"))
    final = F.lit("final")
    return wide.select(
        "akte_id",
        F.date_add(F.lit("2026-09-12").cast("date"), col("tag").cast("int")).alias("stichtag"),
        F.struct("richtung", "verkehrstraeger", col("praeferenz").alias("praeferenz_beansprucht"), F.struct(col("incoterm").alias("code")).alias("incoterm")).alias("sachverhalt"),
        F.struct(col("anm_richtung").alias("richtung"), codes.alias("warennummern")).alias("anmeldung"),
        F.array_compact(F.array(doc(1, "handelsrechnung", final), doc(2, "packliste", final), doc(3, "bill_of_lading", F.when(draft, "draft").otherwise("final")), F.when(col("akte_id") % 17 == 0, doc(4, "atr", final)), doc(5, "abd", final))).alias("dokumente"),
        F.when(draft, F.array(F.struct(F.lit("bill_of_lading").alias("dokument"), F.lit("bill_of_lading").alias("dok_typ"), F.lit("draft").alias("dok_status"), F.lit("bill_of_lading.container_id").alias("pfad")))).alias("nicht_final"),
        *heads, *[_list(p, *how).alias(column_of(p)) for p, how in lists.items()],
    )
