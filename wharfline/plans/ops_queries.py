"""Queries on identifiers, values, documents, metrics and windows, with SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wharfline.functions import identifiers, parsing
from wharfline.operators import documents, metrics, requests, sheets


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def derived(spark: SparkSession, sf_dir: str, sql: str, *names: str) -> DataFrame:
    """SQL that Spark and the oracle both run to derive an input from the tables."""
    return spark.sql(sql.format(**{n: f"{{{n}}}" for n in names}), **{n: read(spark, sf_dir, n) for n in names})


def plain(sql: str, *names: str) -> str:
    return sql.format(**{n: n for n in names})


# identifiers: container, waybill and VAT numbers of customers, some with a wrong digit, some malformed
IDS = """
SELECT c_custkey AS k, 'container' AS kind, CASE WHEN c_custkey % 50 = 0 THEN 'MSKA1234565' WHEN c_custkey % 9 = 0 THEN 'msku 123456-5' WHEN c_custkey % 7 = 0 THEN 'CSQU3054383' WHEN c_custkey % 5 = 0 THEN 'MSKU1234568' ELSE 'MSKU1234570' END AS raw FROM {customer}
UNION ALL
SELECT c_custkey, 'awb', '020-' || lpad(CAST(c_custkey % 10000000 AS STRING), 7, '0') || CAST((c_custkey % 7 + CASE WHEN c_custkey % 11 = 0 THEN 1 ELSE 0 END) % 10 AS STRING) FROM {customer}
UNION ALL
SELECT c_custkey, 'ustid_de', CASE WHEN c_custkey % 3 = 0 THEN 'DE136695976' WHEN c_custkey % 3 = 1 THEN 'DE123456789' ELSE 'DE12345' END FROM {customer}
UNION ALL
SELECT c_custkey, 'eori', CASE WHEN c_custkey % 8 = 0 THEN 'D123' ELSE 'DE' || CAST(c_custkey AS STRING) END FROM {customer}
"""


def identifier_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, bad formats and bad check digits by kind."""
    ids = derived(spark, sf_dir, IDS, "customer")
    kind, raw = F.col("kind"), F.col("raw")
    digit = identifiers.identifier_digit(kind, raw)
    last = F.right(F.regexp_replace(raw, r"[\s-]", ""), F.lit(1)).try_cast("int")
    checked = ids.withColumns({"fmt": identifiers.identifier_format(kind, raw), "bad": F.coalesce(digit != last, F.lit(False))})
    return checked.groupBy("kind").agg(F.count("*").alias("n"), F.count_if(~F.col("fmt")).alias("format_falsch"), F.count_if(F.col("fmt") & F.col("bad")).alias("ziffer_falsch"))


IDENTIFIER_SQL = """
SELECT kind, count(*) AS n,
  count(*) FILTER (CASE kind WHEN 'container' THEN k % 50 = 0 WHEN 'awb' THEN FALSE WHEN 'ustid_de' THEN k % 3 = 2 ELSE k % 8 = 0 END) AS format_falsch,
  count(*) FILTER (CASE kind WHEN 'container' THEN k % 50 <> 0 AND k % 9 <> 0 AND k % 7 <> 0 AND k % 5 = 0 WHEN 'awb' THEN k % 11 = 0 WHEN 'ustid_de' THEN k % 3 = 1 ELSE FALSE END) AS ziffer_falsch
FROM (""" + plain(IDS, "customer") + ") ids GROUP BY kind"

# amounts of line items in German, English and plain form, with currencies
CENTS = "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(round(l_extendedprice * 100) AS BIGINT) AS cents FROM {lineitem}"


def amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean distance of parsed amounts from the stated ones, by written form: both parsers."""
    rows = derived(spark, sf_dir, CENTS, "lineitem").withColumn("form", F.col("l_partkey") % 4)
    whole, rest = F.floor(F.col("cents") / 100).cast("long"), F.lpad((F.col("cents") % 100).cast("string"), 2, "0")
    german = F.regexp_replace(F.format_number(whole, 0), ",", ".")
    written = (
        F.when(F.col("form") == 0, F.concat(F.lit("EUR "), german, F.lit(","), rest)).when(F.col("form") == 1, F.concat(F.format_number(whole, 0), F.lit("."), rest, F.lit(" USD")))
        .when(F.col("form") == 2, F.concat(whole.cast("string"), F.lit("."), rest)).otherwise(F.concat(whole.cast("string"), F.lit(" PCE PAL-1")))
    )
    rows = rows.withColumn("w", written).withColumns({"loose": parsing.amount_loose("w"), "strict": parsing.amount_strict("w")})
    return rows.groupBy("form").agg(
        F.count("*").alias("n"), F.count_if(F.abs(F.col("strict") - F.col("cents") / 100) < 1e-6).alias("strict_ok"), F.count_if(F.abs(F.col("loose") - F.col("cents") / 100) < 1e-6).alias("loose_ok"), F.count_if(F.col("strict").isNull()).alias("strict_null")
    )


AMOUNT_SQL = """
SELECT l_partkey % 4 AS form, count(*) AS n, count(*) FILTER (l_partkey % 4 <> 3) AS strict_ok, count(*) FILTER (l_partkey % 4 <> 3) AS loose_ok, count(*) FILTER (l_partkey % 4 = 3) AS strict_null
FROM lineitem GROUP BY 1"""


def dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order dates written in four ways and read again, by day."""
    rows = read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("d"))
    month = F.get(F.array(*[F.lit(m) for m in ("Januar", "Februar", "März", "April", "Mai", "Juni", "Juli", "August", "September", "Oktober", "November", "Dezember")]), F.month("d") - 1)
    form = F.col("o_orderkey") % 4
    written = (
        F.when(form == 0, F.date_format("d", "yyyy-MM-dd")).when(form == 1, F.date_format("d", "'Datum: 'd.M.yyyy")).when(form == 2, F.date_format("d", "d/M/yyyy"))
        .otherwise(F.concat_ws(" ", F.concat(F.dayofmonth("d").cast("string"), F.lit(".")), month, F.year("d").cast("string")))
    )
    return rows.select(parsing.date_text(written).alias("datum")).groupBy("datum").agg(F.count("*").alias("n"))


DATE_SQL = "SELECT strftime(CAST(o_orderdate AS DATE), '%Y-%m-%d') AS datum, count(*) AS n FROM orders GROUP BY 1"


#: Places that end with a country, as a name, a code, a name in brackets and the end of an address; one in seven names none.
PLACES = """
SELECT s_suppkey % 4 AS form, CASE s_suppkey % 4 WHEN 0 THEN name WHEN 1 THEN kuerzel WHEN 2 THEN 'Lager (' || name || ')' ELSE '12345 Ort, ' || name END AS ort
FROM (SELECT s_suppkey, CASE s_nationkey % 7 WHEN 0 THEN 'Germany' WHEN 1 THEN 'China' WHEN 2 THEN 'France' WHEN 3 THEN 'Japan' WHEN 4 THEN 'United Kingdom' WHEN 5 THEN 'USA' ELSE 'Nirgendwo' END AS name,
  CASE s_nationkey % 7 WHEN 0 THEN 'DE' WHEN 1 THEN 'CN' WHEN 2 THEN 'FR' WHEN 3 THEN 'JP' WHEN 4 THEN 'GB' WHEN 5 THEN 'US' ELSE '1X' END AS kuerzel FROM {supplier}) named
"""


def countries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers by the country code that their nation's name, as the end of an address, is read as."""
    rows = derived(spark, sf_dir, PLACES, "supplier")
    return rows.groupBy("form", parsing.country("ort").alias("land")).agg(F.count("*").alias("n"))


COUNTRY_SQL = """
SELECT s_suppkey % 4 AS form, CASE WHEN s_suppkey % 4 = 1 AND s_nationkey % 7 = 6 THEN NULL ELSE CASE s_nationkey % 7 WHEN 0 THEN 'DE' WHEN 1 THEN 'CN' WHEN 2 THEN 'FR' WHEN 3 THEN 'JP' WHEN 4 THEN 'GB' WHEN 5 THEN 'US' END END AS land, count(*) AS n
FROM supplier GROUP BY 1, 2"""


def companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplier names with legal forms, normalised."""
    form = F.get(F.array(*[F.lit(x) for x in ("GmbH & Co. KG", "Ltd.", "S.A.", "B.V.", "(Hamburg)")]), (F.col("s_suppkey") % 5).cast("int"))
    return read(spark, sf_dir, "supplier").select("s_suppkey", parsing.company_name(F.concat_ws(" ", F.lit("Supplier"), F.col("s_suppkey").cast("string"), form)).alias("name"))


COMPANY_SQL = """SELECT s_suppkey, 'supplier ' || s_suppkey::VARCHAR || CASE s_suppkey % 5 WHEN 2 THEN ' s a' WHEN 3 THEN ' b v' WHEN 4 THEN ' hamburg' ELSE '' END AS name FROM supplier"""

HEADED = """
SELECT doc_id, CASE doc_id % 7 WHEN 0 THEN 'COMMERCIAL INVOICE Invoice No ' WHEN 1 THEN 'PACKING LIST gross weight ' WHEN 2 THEN 'DRAFT Bill of Lading ' WHEN 3 THEN 'Pro-Forma Commercial Invoice '
  WHEN 4 THEN 'Export Accompanying Document MRN ' WHEN 5 THEN 'Invoice ' ELSE '' END || coalesce(text, '') AS text FROM {documents}
"""


def classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.classify(derived(spark, sf_dir, HEADED, "documents")).select("doc_id", "typ", "konfidenz", "status")


# DuckDB's \\b and \\s know ASCII alone, so borders of words and blanks are spelled out
_BLANKS = r"[\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
_NO_WORD = r"[^\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}\x{200C}\x{200D}]"


def _has(pattern: str) -> str:
    """That a text t has a pattern; a border stands before or after each word."""
    parts = [part.removeprefix(r"\b").removesuffix(r"\b") for part in pattern.split("|")]
    bounded = [(rf"(?:^|{_NO_WORD})" if p.startswith(r"\b") else "") + f"(?:{part})" + (rf"(?:$|{_NO_WORD})" if p.endswith(r"\b") else "") for p, part in zip(pattern.split("|"), parts, strict=True)]
    return f"regexp_matches(t, '{'|'.join(bounded)}')"


def _whole(pattern: str) -> str:
    """The same for a feature, whose alternatives stand in a group."""
    inner = pattern.removeprefix(r"\b").removesuffix(r"\b")
    return f"regexp_matches(t, '{rf'(?:^|{_NO_WORD})' if pattern.startswith(chr(92) + 'b') else ''}{inner}{rf'(?:$|{_NO_WORD})' if pattern.endswith(chr(92) + 'b') else ''}')"


_TYPES = list(dict.fromkeys(typ for typ, _, _ in documents.FEATURES))
_POINTS = {typ: " + ".join(f"CASE WHEN {_whole(p)} THEN {w} ELSE 0 END" for k, p, w in documents.FEATURES if k == typ) for typ in _TYPES}
#: The rule of documents.classify on the same texts: features give points, a pro forma is no invoice, the best type counts from two points on.
CLASS_SQL = f"""
WITH n AS (SELECT doc_id, trim(regexp_replace(lower(replace(text, 'İ', 'i̇')), '{_BLANKS}', ' ', 'g')) AS t FROM ({plain(HEADED, "documents")}) h),
p AS (SELECT doc_id, t, {", ".join(f"({sql})::DOUBLE AS {typ}" for typ, sql in _POINTS.items())} FROM n),
r AS (SELECT doc_id, t, list_reverse_sort([{", ".join(f"{{'p': {f'CASE WHEN proformarechnung >= {documents.MIN_POINTS} THEN 0 ELSE handelsrechnung END' if typ == 'handelsrechnung' else typ}, 'o': {-k}, 'typ': '{typ}'}}" for k, typ in enumerate(_TYPES))}]) AS l FROM p)
SELECT doc_id, CASE WHEN l[1].p >= {documents.MIN_POINTS} THEN l[1].typ ELSE 'unclassified' END AS typ,
  CASE WHEN l[1].p >= {documents.MIN_POINTS} THEN round(l[1].p / (l[1].p + l[2].p), 3) ELSE 0 END::DOUBLE AS konfidenz, CASE WHEN {_has(documents.DRAFT)} THEN 'draft' ELSE 'final' END AS status FROM r"""


def mail_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Placeholders of mail addresses in each text, numbered by first appearance."""
    done = documents.pseudonymise(read(spark, sf_dir, "documents").select("doc_id", "text"), categories=("MAIL",))
    pairs = done.select("doc_id", F.explode("zuordnung").alias("platzhalter", "original"))
    return pairs.where(F.startswith("platzhalter", F.lit("[MAIL-"))).select("doc_id", "platzhalter", "original")


MAIL_SQL = r"""
WITH found AS (SELECT doc_id, unnest(list_distinct(m)) AS original, m FROM (SELECT doc_id, regexp_extract_all(text, '[\w.+-]+@[\w-]+\.[\w.-]+') AS m FROM documents) x),
placed AS (SELECT doc_id, original, row_number() OVER (PARTITION BY doc_id ORDER BY list_position(m, original)) AS n FROM found)
SELECT doc_id, '[MAIL-' || n::VARCHAR || ']' AS platzhalter, original FROM placed"""

EVENTS = """
SELECT event_id, ts, user_id, event_type, value, CASE WHEN user_id % 6 = 0 THEN NULL ELSE 'flow' || CAST(user_id % 5 AS STRING) END AS workflow_name,
       CASE WHEN event_id % 3 = 0 THEN 'offen' ELSE 'erledigt' END AS status, 'eingang' || CAST(user_id % 3 AS STRING) AS eingang FROM {events}
"""


def errors_by_workflow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.count_by(derived(spark, sf_dir, EVENTS, "events").where(F.col("event_type") == "error"), "workflow_name", unknown="unbekannt")


def retries_by_entrance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.open_by_entrance(derived(spark, sf_dir, EVENTS, "events"))


def last_check_age(spark: SparkSession, sf_dir: str) -> DataFrame:
    checks = read(spark, sf_dir, "events").where(F.col("event_type") == "purchase")
    return metrics.age_of_last(checks, F.lit("2024-02-01 00:00:00").cast("timestamp"), "ts")


def latest_retry(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = derived(spark, sf_dir, EVENTS, "events").withColumnsRenamed({"user_id": "execution_id", "ts": "angelegt_am"})
    return requests.latest_open(rows).select("execution_id", "event_id")


def error_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    errors = read(spark, sf_dir, "events")
    return metrics.share_in_window(errors, F.col("event_type") == "error", "1 hour").select(F.date_format("von", "yyyy-MM-dd HH:mm").alias("von"), "treffer", F.round("anteil", 6).alias("anteil"))


def value_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.cumulated_histogram(read(spark, sf_dir, "events"), "value", "event_type", (10.0, 50.0, 100.0, 500.0))


def sustained_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of events of a user with a value of at least 50 that last an hour."""
    runs = metrics.sustained(read(spark, sf_dir, "events"), F.col("value") >= 50, 3600, "user_id")
    return runs.select("user_id", F.date_format("beginn", "yyyy-MM-dd HH:mm:ss").alias("beginn"), "proben")


GOLD = """
SELECT l_orderkey AS akte_id, CAST(l_linenumber AS STRING) || '-' || CAST(l_partkey AS STRING) || '-' || CAST(l_suppkey AS STRING) || '-' || CAST(CAST(round(l_extendedprice * 100) AS BIGINT) AS STRING) AS dokument, 'menge' AS pfad, 'typ' || CAST(l_orderkey % 5 AS STRING) AS typ,
       CAST(CAST(l_quantity AS BIGINT) AS STRING) AS wert, (l_orderkey * 31 + l_partkey) % 50 AS m FROM {lineitem}
"""


def extraction_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Golden fields against a copy with gaps, deviations and surplus fields."""
    gold = derived(spark, sf_dir, GOLD, "lineitem")
    read_ = gold.where("m <> 0").withColumn("wert", F.when(F.col("m") == 1, F.lit("-1")).otherwise(F.concat("wert", F.lit(".0"))))
    extra = gold.where("m = 2").withColumn("pfad", F.lit("zusatz"))
    return metrics.field_quality(metrics.field_status(gold, read_.unionByName(extra)))


GOLD_SQL = "SELECT coalesce(typ, 'gesamt') AS typ, erwartet, exakt, fehlend, abweichend, ueberzaehlig, round(exakt / erwartet, 4) AS quote FROM (SELECT typ, count(*) AS erwartet, count(*) FILTER (m > 1) AS exakt, count(*) FILTER (m = 0) AS fehlend, count(*) FILTER (m = 1) AS abweichend, count(*) FILTER (m = 2) AS ueberzaehlig FROM (" + plain(GOLD, "lineitem") + ") g GROUP BY ROLLUP (typ)) s"

MAILS = """
SELECT conv_id * 1000 + turn AS mail_id, 'Re: ' || CASE WHEN conv_id % 3 = 0 THEN (CASE WHEN conv_id % 7 = 0 THEN 'ZP-1999-' ELSE 'ZP-2026-' END) || lpad(CAST(conv_id % 10000 AS STRING), 4, '0') ELSE 'Anfrage' END AS betreff, text, turn % 4 AS anhaenge, conv_id FROM {conversations}
"""


def mail_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    mails = derived(spark, sf_dir, MAILS, "conversations")
    known = read(spark, sf_dir, "orders").select(F.concat(F.lit("ZP-2026-"), F.lpad((F.col("o_orderkey") % 10000).cast("string"), 4, "0")).alias("akte_id"))
    return requests.route_mail(mails, known).groupBy("ergebnis").agg(F.count("*").alias("n"))


MAIL_ROUTE_SQL = """
SELECT CASE WHEN conv_id % 3 <> 0 THEN 'keine Vorgangsnummer' WHEN anhaenge = 0 THEN 'keine Anhänge' WHEN k IS NULL THEN 'unbekannte Akte' ELSE 'zugeordnet' END AS ergebnis, count(*) AS n
FROM (""" + plain(MAILS, "conversations") + ") m LEFT JOIN (SELECT DISTINCT o_orderkey % 10000 AS k FROM orders) o ON o.k = m.conv_id % 10000 AND m.conv_id % 7 <> 0 GROUP BY 1"


# words of documents, set on pages of 40 lines: a word every 30 points, a line every 12. Tops waver: every fifth word stands too low for its line and makes one of its own
def page_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines and words that the page geometry finds in each document."""
    words = lambda line, z: F.transform(F.filter(F.split(line, " "), lambda w: w != ""), lambda w, k: word(w, z, k))
    top = lambda z, k: (z % 40) * 12.0 + k % 5
    word = lambda w, z, k: F.struct(top(z, k).alias("top"), (k * 30.0).alias("x0"), (k * 30.0 + 20).alias("x1"), (top(z, k) + 8).alias("bottom"), w.alias("text"), F.lit(0.9).alias("conf"))
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    of_page = lambda p: F.flatten(F.transform(F.slice(lines, p * 40 + 1, F.lit(40)), lambda line, z: words(line, z)))
    pages = F.transform(F.sequence(F.lit(0), F.floor((F.size(lines) - 1) / 40).cast("int")), lambda p: F.struct((p + 1).alias("seite"), F.lit("textebene").alias("methode"), of_page(p).alias("woerter")))
    found = sheets.with_lines(read(spark, sf_dir, "documents").select("doc_id", pages.alias("seiten"))).where("size(zeilen) > 0")
    return found.select("doc_id", F.size("zeilen").cast("long").alias("zeilen"), F.aggregate("zeilen", F.lit(0), lambda a, z: a + F.size(z["woerter"])).cast("long").alias("woerter"))


PAGE_SQL = """
SELECT doc_id, sum(CASE WHEN n > 4 THEN 2 ELSE 1 END) AS zeilen, sum(n) AS woerter
FROM (SELECT doc_id, len(list_filter(string_split(zeile, ' '), lambda w: w <> '')) AS n FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS zeile FROM documents) l) c
WHERE n > 0 GROUP BY doc_id"""

def newest_unassigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 latest mails that no case was found for."""
    mails = derived(spark, sf_dir, MAILS, "conversations").withColumn("eingegangen_am", F.col("conv_id"))
    known = read(spark, sf_dir, "orders").select(F.concat(F.lit("ZP-2026-"), F.lpad((F.col("o_orderkey") % 10000).cast("string"), 4, "0")).alias("akte_id"))
    return metrics.newest_unassigned(requests.route_mail(mails, known)).select("mail_id", "ergebnis")


UNASSIGNED_SQL = """
SELECT mail_id, ergebnis FROM (SELECT mail_id, conv_id, CASE WHEN conv_id % 3 <> 0 THEN 'keine Vorgangsnummer' WHEN anhaenge = 0 THEN 'keine Anhänge' WHEN k IS NULL THEN 'unbekannte Akte' ELSE 'zugeordnet' END AS ergebnis
FROM (""" + plain(MAILS, "conversations") + """) m LEFT JOIN (SELECT DISTINCT o_orderkey % 10000 AS k FROM orders) o ON o.k = m.conv_id % 10000 AND m.conv_id % 7 <> 0) r
WHERE ergebnis <> 'zugeordnet' ORDER BY conv_id DESC, mail_id LIMIT 50"""

REQUESTS = "SELECT l_orderkey AS akte_id, CASE WHEN l_returnflag = 'R' THEN 'erledigt' ELSE 'offen' END AS status, CASE WHEN l_linestatus = 'F' THEN 'stufe' || CAST(l_linenumber AS STRING) END AS stufe, CAST(l_partkey AS BIGINT) * 100000 + CAST(l_suppkey AS BIGINT) AS letzter_versand_am FROM {lineitem}"
CHECKS = "SELECT o_orderkey AS akte_id, CASE o_orderkey % 4 WHEN 0 THEN 'blockiert' WHEN 1 THEN 'freigabereif' ELSE 'freigabe_mit_warnungen' END AS freigabe, o_orderdate AS geprueft_am FROM {orders} WHERE o_orderkey % 5 <> 0"


def _overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("akte_id"))
    docs = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("akte_id"))
    return metrics.overview(cases, docs, derived(spark, sf_dir, REQUESTS, "lineitem"), derived(spark, sf_dir, CHECKS, "orders"))


def overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _overview(spark, sf_dir).select("akte_id", "dokumente", "offene_faelle", F.coalesce("letzter_versand", F.lit(0)).alias("letzter_versand"), "freigabe")


def overview_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.totals(_overview(spark, sf_dir))


OVERVIEW_SQL = f"""
SELECT o.o_orderkey AS akte_id, coalesce(d.n, 0) AS dokumente, coalesce(r.n, 0) AS offene_faelle, coalesce(r.letzter_versand, 0) AS letzter_versand, c.freigabe
FROM orders o LEFT JOIN (SELECT l_orderkey AS k, count(*) AS n FROM lineitem GROUP BY 1) d ON d.k = o.o_orderkey
LEFT JOIN (SELECT akte_id, count(*) FILTER (status = 'offen') AS n, max(letzter_versand_am) AS letzter_versand FROM ({plain(REQUESTS, "lineitem")}) q GROUP BY 1) r ON r.akte_id = o.o_orderkey
LEFT JOIN ({plain(CHECKS, "orders")}) c ON c.akte_id = o.o_orderkey"""


def append_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an idempotent append adds: lines of odd suppliers (the batch) against those of even ones (stored), one for each part and order."""
    rows = read(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_orderkey")
    batch, stored = rows.where("l_suppkey % 2 = 1"), rows.where("l_suppkey % 2 = 0")
    return metrics.append_new(batch, stored, ["l_partkey", "l_orderkey"], "l_suppkey").select("l_partkey", "l_orderkey", "l_suppkey")


APPEND_SQL = """SELECT l_partkey, l_orderkey, min(l_suppkey) AS l_suppkey FROM lineitem b WHERE l_suppkey % 2 = 1
  AND NOT EXISTS (SELECT 1 FROM lineitem s WHERE s.l_suppkey % 2 = 0 AND s.l_partkey = b.l_partkey AND s.l_orderkey = b.l_orderkey) GROUP BY 1, 2"""


def reconciled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open requests (orders of three weekdays) against new ones: opened, kept, closed by priority."""
    rows = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("akte_id"), F.col("o_orderpriority").alias("grund"), F.lit("f").alias("feld"), F.lit(0).alias("ord"))
    texts = {c: F.lit("x") for c in ("betreff", "text", "adressat", "adressat_kopie")}
    held = rows.where("akte_id % 7 < 3").drop("ord").withColumns({"stufe": F.lit(None).cast("string"), "letzter_versand_am": F.lit(None).cast("timestamp"), "eroeffnet_am": F.lit(None).cast("timestamp"), **texts})
    new = rows.where("akte_id % 7 > 1").withColumns(texts)
    return requests.reconcile(held, new, F.lit("2026-09-13").cast("timestamp")).groupBy("grund", "aktion").agg(F.count("*").alias("n"))


RECONCILE_SQL = """SELECT o_orderpriority AS grund, CASE WHEN o_orderkey % 7 < 2 THEN 'schliessen' WHEN o_orderkey % 7 = 2 THEN 'behalten' ELSE 'eroeffnen' END AS aktion, count(*) AS n FROM orders GROUP BY 1, 2"""

QUERIES = {
    "page_lines": page_lines, "case_overview": overview, "overview_totals": overview_totals, "idempotent_append": append_once, "request_reconciliation": reconciled, "newest_unassigned_mails": newest_unassigned,
    "identifier_quality": identifier_quality, "amount_parsing": amounts, "date_parsing": dates, "country_parsing": countries, "company_names": companies,
    "document_classes": classes, "mail_pseudonyms": mail_addresses, "errors_by_workflow": errors_by_workflow, "retries_by_entrance": retries_by_entrance, "last_check_age": last_check_age,
    "latest_retry": latest_retry, "error_windows": error_windows, "value_histogram": value_histogram, "sustained_values": sustained_errors, "extraction_quality": extraction_quality, "mail_routes": mail_routes,
}
E_SQL = "(" + plain(EVENTS, "events") + ") e"
ORACLES = {
    "page_lines": PAGE_SQL, "case_overview": OVERVIEW_SQL, "idempotent_append": APPEND_SQL, "request_reconciliation": RECONCILE_SQL, "newest_unassigned_mails": UNASSIGNED_SQL,
    "overview_totals": f"SELECT count(*) AS akten, count(*) FILTER (freigabe = 'blockiert') AS blockiert, count(*) FILTER (freigabe = 'freigabereif') AS freigabereif, sum(offene_faelle) AS offene_faelle FROM ({OVERVIEW_SQL}) o",
    "identifier_quality": IDENTIFIER_SQL, "amount_parsing": AMOUNT_SQL, "date_parsing": DATE_SQL, "country_parsing": COUNTRY_SQL, "company_names": COMPANY_SQL,
    "document_classes": CLASS_SQL, "mail_pseudonyms": MAIL_SQL,
    "errors_by_workflow": f"SELECT coalesce(workflow_name, 'unbekannt') AS workflow_name, count(*) AS anzahl FROM {E_SQL} WHERE event_type = 'error' GROUP BY 1",
    "retries_by_entrance": f"SELECT eingang, count(*) AS anzahl FROM {E_SQL} WHERE status = 'offen' GROUP BY 1",
    "last_check_age": "SELECT coalesce(CAST(floor(epoch(TIMESTAMP '2024-02-01 00:00:00')) - floor(epoch(max(ts))) AS BIGINT), 0) AS alter_sekunden FROM events WHERE event_type = 'purchase'",
    "latest_retry": f"SELECT user_id AS execution_id, max_by(event_id, ts) AS event_id FROM {E_SQL} WHERE status = 'offen' GROUP BY 1",
    "error_windows": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS von, count(*) FILTER (event_type = 'error') AS treffer, round(count(*) FILTER (event_type = 'error') / count(*), 6) AS anteil FROM events GROUP BY 1",
    "value_histogram": "SELECT event_type, le, count(*) FILTER (value <= le) AS anzahl FROM events, (VALUES (10.0::DOUBLE), (50.0::DOUBLE), (100.0::DOUBLE), (500.0::DOUBLE)) b(le) GROUP BY 1, 2",
    "sustained_values": """WITH f AS (SELECT *, sum(CASE WHEN value >= 50 THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts) AS run FROM events)
      SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS beginn, count(*) AS proben FROM f WHERE value >= 50 GROUP BY user_id, run HAVING floor(epoch(max(ts))) - floor(epoch(min(ts))) >= 3600""",
    "extraction_quality": GOLD_SQL, "mail_routes": MAIL_ROUTE_SQL,
}
