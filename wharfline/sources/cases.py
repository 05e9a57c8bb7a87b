"""Case files: one JSON document each -> the tables of the engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wharfline.operators import facts

SCHEMA = """
akte_id string, beschreibung string, stichtag string,
erwartung struct<freigabe: string, regeln: array<string>, pflicht: array<string>>,
fristen struct<customs_cutoff: string, carrier_cutoff: string, eta: string>,
sachverhalt struct<richtung: string, verkehrstraeger: string, praeferenz_beansprucht: boolean,
  incoterm: struct<code: string, named_place: string, named_place_unlocode: string, edition: int>, route: struct<pol: string, pod: string>>,
anmeldung struct<richtung: string, warennummern: array<string>>,
dokumente array<struct<id: string, typ: string, status: string, version: int, aussteller: string, hash: string, traeger: string, hinweis: string>>,
assertions array<struct<dokument: string, pfad: string, wert: string, roh: string, konfidenz: double, seite: int, methode: string>>,
overrides array<struct<regel: string, benutzer: string, begruendung: string, erzeugt_am: string, fassung: string, identitaet: string>>
"""


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """Case files as they are; `wert` keeps the JSON text of the value (a string with its quotes)."""
    raw = spark.read.text(path, wholetext=True)
    # a value is a string, number, boolean or null: only a raw JSON reader can tell "1" from 1
    loose = SCHEMA.replace("wert: string", "wert: variant")
    return raw.select(F.from_json("value", loose).alias("c")).select("c.*")


def case_table(raw: DataFrame) -> DataFrame:
    stamp = lambda c: F.try_to_timestamp(F.col(f"fristen.{c}"))
    return raw.select("akte_id", F.col("stichtag").cast("date").alias("stichtag"), "sachverhalt", "anmeldung", "erwartung", *[stamp(c).alias(c) for c in ("customs_cutoff", "carrier_cutoff", "eta")])


def document_table(raw: DataFrame) -> DataFrame:
    rows = raw.select("akte_id", F.posexplode("dokumente").alias("ord", "d"))
    return rows.select("akte_id", "ord", F.col("d.id").alias("dokument_id"), "d.typ", "d.status", "d.version", "d.aussteller", "d.hash")


def assertion_table(raw: DataFrame) -> DataFrame:
    """Long rows with the value split by kind; an explicit null keeps its row."""
    rows = raw.select("akte_id", F.posexplode("assertions").alias("ord", "a")).select("akte_id", "ord", "a.dokument", "a.pfad", "a.wert", "a.roh", "a.konfidenz", "a.seite", "a.methode")
    kind = F.coalesce(F.schema_of_variant("wert"), F.lit("VOID"))
    number = kind.rlike("^(BIGINT|DOUBLE|DECIMAL|INT|SMALLINT|TINYINT)")
    return rows.withColumns(
        {
            "kind": F.when(kind == "STRING", "txt").when(kind == "BOOLEAN", "bool").when(number, "num").otherwise("null"),
            "txt": F.when(kind == "STRING", F.try_variant_get("wert", "$", "string")).when(number, F.try_variant_get("wert", "$", "string")),
            "num": F.when(number, F.try_variant_get("wert", "$", "double")), "bool": F.when(kind == "BOOLEAN", F.try_variant_get("wert", "$", "boolean")),
        }
    ).drop("wert")


def override_table(raw: DataFrame) -> DataFrame:
    return raw.select("akte_id", F.posexplode("overrides").alias("ord", "o")).select("akte_id", "ord", "o.*")


def case_rows(raw: DataFrame) -> DataFrame:
    """The rules' input from case files."""
    documents, assertions = document_table(raw), assertion_table(raw)
    return facts.case_rows(case_table(raw), facts.facts_long(assertions, documents), documents, facts.not_final(assertions, documents))


def stored_case(cases: DataFrame, documents: DataFrame, assertions: DataFrame) -> DataFrame:
    """Stored tables back to one row for each case, with its documents and assertions in order."""
    gathered = lambda table, name: table.groupBy("akte_id").agg(F.array_sort(F.collect_list(F.struct("ord", *[c for c in table.columns if c not in ("akte_id", "ord")]))).alias(name))
    return cases.join(gathered(documents, "dokumente"), "akte_id", "left").join(gathered(assertions, "assertions"), "akte_id", "left")


def flatten_record(frame: DataFrame, key: str, columns: dict[str, str]) -> DataFrame:
    """Wide columns -> (key, pfad, wert) rows; columns maps a path to its column, nulls give no row."""
    pairs = F.array(*[F.struct(F.lit(p).alias("pfad"), F.col(c).cast("string").alias("wert")) for p, c in columns.items()])
    return frame.select(key, F.explode(pairs).alias("p")).select(key, "p.*").where("wert is not null")


MASTER = "akte.json"


def read_folder(spark: SparkSession, path: str) -> DataFrame:
    """All files below a folder of cases: akte (its folder's name), datei, inhalt, sha256."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    parts = F.split("path", "/")
    return files.select(F.element_at(parts, -2).alias("akte"), F.element_at(parts, -1).alias("datei"), F.col("content").alias("inhalt"), F.sha2("content", 256).alias("sha256"))


def read_case_folders(spark: SparkSession, path: str) -> DataFrame:
    """A row for each file of each case folder: ordner, akte_id and stammdaten (from the folder's akte.json), ord (by name), datei, pfad, laenge, sha256, hinweis.

    A folder without master data, or with some that aren't JSON or name no case, keeps its files and says so; one with master data alone has a row without a
    file. Contents are hashed where they are read and aren't shuffled with their folders: who reads a file opens it by its path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    folder, name = F.regexp_extract("path", "^(.*)/[^/]*$", 1), F.element_at(F.split("path", "/"), -1)
    rows = files.select(folder.alias("ordner"), name.alias("datei"), "path", "length", F.sha2("content", 256).alias("sha256"), F.when(name == MASTER, F.col("content").cast("string")).alias("_json"))
    kept = SCHEMA.split("dokumente array")[0].rstrip().rstrip(",")
    master = rows.where(F.col("datei") == MASTER).select("ordner", F.lit(True).alias("_da"), F.from_json("_json", kept).alias("stammdaten"))
    papers = rows.where(F.col("datei") != MASTER).drop("_json")
    both = papers.join(master.hint("merge"), "ordner", "full_outer")
    note = F.when(F.col("_da").isNull(), "keine Stammdaten im Ordner").when(F.col("stammdaten.akte_id").isNull(), "Stammdaten nicht lesbar").when(F.col("datei").isNull(), "keine Dateien im Ordner")
    turn = Window.partitionBy("ordner").orderBy("datei")
    return both.select("ordner", F.col("stammdaten.akte_id").alias("akte_id"), "stammdaten", (F.row_number().over(turn) - 1).alias("ord"), "datei", F.col("path").alias("pfad"), F.col("length").alias("laenge"), "sha256", note.alias("hinweis"))


def merge_reply(stored_documents: DataFrame, stored_assertions: DataFrame, new_documents: DataFrame, new_assertions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New documents of a reply into the stored case: known contents are left out, ids get the batch's suffix -E<n>
    (n: one more than the stored ids that have one), and assertions follow their documents."""
    known = stored_documents.where("hash is not null").select("akte_id", "hash").distinct()
    batch = stored_documents.groupBy("akte_id").agg((F.count_if(F.col("dokument_id").rlike(r"-E\d+$")) + 1).alias("_n"))
    fresh = new_documents.join(known, ["akte_id", "hash"], "left_anti").join(batch, "akte_id", "left")
    fresh = fresh.withColumn("_neu", F.concat("dokument_id", F.lit("-E"), F.coalesce("_n", F.lit(1)).cast("string")))
    names = fresh.select("akte_id", F.col("dokument_id").alias("dokument"), "_neu")
    assertions = new_assertions.join(names, ["akte_id", "dokument"]).withColumn("dokument", F.col("_neu")).drop("_neu")
    documents = fresh.withColumn("dokument_id", F.col("_neu")).drop("_n", "_neu")
    return stored_documents.unionByName(documents, allowMissingColumns=True), stored_assertions.unionByName(assertions, allowMissingColumns=True)
