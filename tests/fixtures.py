"""Eight small cases with known outcomes, built from one sound case."""

from __future__ import annotations

import copy

DOCS = [("INV-1", "handelsrechnung"), ("PAC-1", "packliste"), ("BOL-1", "bill_of_lading"), ("URS-1", "origin_declaration"), ("ABD-1", "abd")]
FACTS = {
    "INV-1": {
        "rechnung.nummer": "R-1", "rechnung.waehrung": "EUR", "rechnung.gesamt": 18420, "rechnung.zuschlaege": 0, "rechnung.rabatte": 0,
        **{f"rechnung.positionen.{k}.{f}": v for k, p in enumerate([{"nr": 1, "hs6": "841330", "ursprung": "DE", "menge": 12, "einzelpreis": 1450, "netto": 17400}, {"nr": 2, "hs6": "848420", "ursprung": "DE", "menge": 12, "einzelpreis": 85, "netto": 1020}]) for f, v in p.items()},
    },
    "PAC-1": {
        "packliste.container_id": "MSKU1234565", "packliste.brutto_gesamt_kg": 1040,
        **{f"packliste.positionen.{k}.{f}": v for k, p in enumerate([{"nr": 1, "menge": 12, "hs6": "841330"}, {"nr": 2, "menge": 12, "hs6": "848420"}]) for f, v in p.items()},
        **{f"packliste.packstuecke.{k}.{f}": v for k, p in enumerate([{"id": "P1", "brutto_kg": 980, "netto_kg": 900}, {"id": "P2", "brutto_kg": 60, "netto_kg": 48}]) for f, v in p.items()},
    },
    "BOL-1": {"bill_of_lading.nummer": "B-1", "bill_of_lading.container_id": "MSKU1234565", "bill_of_lading.brutto_kg": 1046},
    "URS-1": {
        "praeferenznachweis.typ": "origin_declaration", "praeferenznachweis.ursprung": "DE", "praeferenznachweis.rex_nummer": "DEREX12345678", "praeferenznachweis.ursprungswert": 18420,
        "praeferenznachweis.warenkreis.0.pos": 1, "praeferenznachweis.warenkreis.0.hs6": "841330", "praeferenznachweis.warenkreis.1.pos": 2, "praeferenznachweis.warenkreis.1.hs6": "848420",
    },
    "ABD-1": {"abd.mrn": "26DE5100001234567A", "abd.container_id": "MSKU1234565", "abd.positionen.0.nr": 1, "abd.positionen.0.warennummer": "84133080", "abd.positionen.1.nr": 2, "abd.positionen.1.warennummer": "84842000"},
}


def case(number: int, status: dict | None = None, drop: tuple = (), change: dict | None = None, konf: dict | None = None, expect: tuple = ("freigabereif", [], []), overrides: list | None = None) -> dict:
    facts = copy.deepcopy(FACTS)
    for path, value in (change or {}).items():
        doc = next(d for d in facts if path.split(".")[0] in {p.split(".")[0] for p in facts[d]})
        facts[doc][path] = value
    return {
        "akte_id": f"ZP-2026-{number:04d}", "stichtag": "2026-09-12", "erwartung": {"freigabe": expect[0], "regeln": expect[1], "pflicht": expect[2]},
        "fristen": {"customs_cutoff": "2026-09-15T16:00:00Z", "carrier_cutoff": "2026-09-17T12:00:00Z", "eta": "not a date"},
        "sachverhalt": {"richtung": "export_third_country", "verkehrstraeger": "sea", "praeferenz_beansprucht": True, "incoterm": {"code": "FOB", "named_place": "Hamburg", "edition": 2020}},
        "anmeldung": {"richtung": "export", "warennummern": ["84133080", "84842000"]},
        "dokumente": [{"id": d, "typ": t, "status": (status or {}).get(d, "final"), "version": 1} for d, t in DOCS if d not in drop],
        "assertions": [{"dokument": d, "pfad": p, "wert": v, "konfidenz": (konf or {}).get(p, 0.99), "seite": 1, "methode": "textebene"} for d, fs in facts.items() if d not in drop for p, v in fs.items()],
        "overrides": overrides or [],
    }


FREE = {f"rechnung.positionen.2.{f}": v for f, v in {"nr": 3, "hs6": "848420", "ursprung": "DE", "menge": 1, "einzelpreis": 0, "netto": 0, "zollwert": None, "bewertungsmethode": None}.items()}
FREE |= {"packliste.positionen.2.nr": 3, "packliste.positionen.2.menge": 1, "packliste.positionen.2.hs6": "848420", "praeferenznachweis.warenkreis.2.pos": 3, "praeferenznachweis.warenkreis.2.hs6": "848420", "abd.positionen.2.nr": 3, "abd.positionen.2.warennummer": "84842000"}
CASES = [
    case(1),
    case(2, drop=("URS-1",), expect=("blockiert", ["ORG-02"], ["PFL-05"])),
    case(3, change={"rechnung.positionen.1.ursprung": "CN"}, expect=("blockiert", ["ORG-02"], [])),
    case(4, change={"bill_of_lading.container_id": "HLXU8765430"}, expect=("blockiert", ["TRN-01"], [])),
    case(5, status={"BOL-1": "draft"}, expect=("blockiert", ["QTY-02", "REF-03", "TRN-01"], ["PFL-04"])),
    case(6, change={"packliste.container_id": "MSKU1234568"}, konf={"packliste.container_id": 0.55}, expect=("nachextraktion_erforderlich", ["CUS-05", "TRN-01", "TRN-02"], [])),
    case(7, change=FREE, expect=("blockiert", ["VAL-03"], [])),
    case(8, change={"abd.container_id": "HLXU8765430"}, expect=("blockiert", ["CUS-05"], [])),
]
