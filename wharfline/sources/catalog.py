"""The rule catalogue, evidence matrix and responsibilities: data files, validated on load."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache
from pathlib import Path

import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CONF = Path(__file__).resolve().parent.parent / "conf"
RULE_SCHEMA = "regel string, name string, haerte string, risiko string, inputs array<string>, rechtsgrundlage string, rechtsquelle_status string, konsequenz string, valid_from date, valid_to date, ordnung int"


@dataclass(frozen=True)
class Catalog:
    rules: dict
    evidence: dict
    owners: dict

    def rule(self, rule_id: str) -> dict:
        return next(r for r in self.rules["rules"] if r["id"] == rule_id)

    @property
    def version(self) -> str:
        return self.rules["catalog"]["version"]

    @property
    def low_confidence_below(self) -> float:
        return float(self.rules["defaults"]["low_confidence_below"])

    @property
    def evidence_version(self) -> str:
        return f"{self.evidence['version']}@{self.evidence['valid_from']}"

    def rule_table(self, spark: SparkSession) -> DataFrame:
        """A row for each rule, in catalogue order: small by construction, to be broadcast."""
        rows = [
            (r["id"], r["name"], r["hardness"], r["risk"], r["inputs"], r["legal_basis"], r.get("legal_source", "secondary"), r["consequence"], r.get("valid_from"), r.get("valid_to"), k)
            for k, r in enumerate(self.rules["rules"])
        ]
        raw = RULE_SCHEMA.replace("valid_from date", "valid_from string").replace("valid_to date", "valid_to string")
        return spark.createDataFrame(rows, raw).withColumns({c: F.col(c).cast("date") for c in ("valid_from", "valid_to")})

    def owner_table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(k, v["primaer"], v.get("sekundaer")) for k, v in self.owners["owners"].items()], "praefix string, primaer string, sekundaer string")

    def stage_table(self, spark: SparkSession) -> DataFrame:
        rows = [(k, e["stufe"], e["bezug"], int(e["vorlauf_stunden"]), e["adressat"]) for k, e in enumerate(self.owners["escalation"])]
        return spark.createDataFrame(rows, "stufe_nr int, stufe string, bezug string, vorlauf_stunden int, stufe_adressat string")

    def mailbox_table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(self.owners["dispatch"]["mailboxes"].items()), "rolle string, postfach string")


@lru_cache(4)
def load_catalog(folder: Path = CONF) -> Catalog:
    return Catalog(*(yaml.safe_load((folder / f"{name}.yaml").read_text(encoding="utf-8")) for name in ("rules", "evidence", "owners")))


def condition(text: str | None) -> tuple[str, object] | None:
    """`path == literal` -> (path, value); true and false are booleans."""
    if not text:
        return None
    found = re.fullmatch(r"([\w.]+)\s*==\s*(\S+)", text)
    if not found:
        raise ValueError(f"not a condition: {text}")
    return found[1], {"true": True, "false": False}.get(found[2], found[2])
