"""Pages for tests: lines of text segments at given places, and the documents of a case set on them."""

from __future__ import annotations


def page(lines, number=1, method="textebene", conf=0.99, step=12.0):
    """lines: text, or a list of (x, text); a number alone is extra space. Words are five points a letter."""
    words, top = [], 20.0
    for line in lines:
        if isinstance(line, (int, float)):
            top += line
            continue
        for x, text in [(0.0, line)] if isinstance(line, str) else line:
            for word in text.split(" "):
                sure, word = (0.55, word[1:]) if word.startswith("~") else (conf, word)
                words.append((top, float(x), x + 5.0 * len(word), top + 8, word, sure))
                x += 5.0 * len(word) + 4
        top += step
    return (number, method, words)


def invoice(f, declaration=True):
    rows = sorted({k.split(".")[2] for k in f if k.startswith("rechnung.positionen.")}, key=int)
    at = lambda k, name: str(f.get(f"rechnung.positionen.{k}.{name}", ""))
    lines = [
        "COMMERCIAL INVOICE", [(0, f"Invoice No: {f['rechnung.nummer']}"), (300, f"Currency: {f['rechnung.waehrung']}")], "Date: 8. September 2026", 10,
        [(0, "Seller"), (300, "Buyer")], [(0, "Muster Maschinen GmbH"), (300, "Sample Import Inc.")], [(0, "Hafenweg 1"), (300, "1 Main Street")], [(0, "20457 Hamburg, Germany"), (300, "Boston, United States")], [(0, "EORI: DE123456789012345")], 20,
        [(0, "Pos"), (40, "Description"), (160, "HS Code"), (230, "Origin"), (300, "Qty"), (350, "Unit"), (400, "Unit price"), (480, "Amount")],
    ]
    for k in rows:
        price = "no charge" if at(k, "einzelpreis") == "0" else at(k, "einzelpreis")
        lines += [[(0, at(k, "nr")), (40, "Pump housing"), (160, at(k, "hs6")), (230, {"DE": "Germany", "CN": "China"}[at(k, "ursprung")]), (300, at(k, "menge")), (350, "pce"), (400, price), (480, at(k, "netto"))], [(40, "stainless")]]
    lines += [10, [(0, "Surcharges:"), (480, str(f["rechnung.zuschlaege"]))], [(0, "Discounts:"), (480, str(f["rechnung.rabatte"]))], [(0, "Total amount:"), (480, str(f["rechnung.gesamt"]))]]
    if declaration:
        lines += [20, "The exporter of the products covered by this document", "(customs authorization No DEREX12345678) declares that, except where", "otherwise indicated, these products are of German preferential origin."]
    return [page(lines)]


def packing_list(f, unsure=()):
    of = lambda name, cell: [[str(f[f"packliste.{name}.{k}.{c}"]) for c in cell] for k in range(9) if f"packliste.{name}.{k}.{cell[0]}" in f]
    mark = "~" if "packliste.container_id" in unsure else ""
    lines = ["PACKING LIST No: PL-7", [(0, f"Container No: {mark}{f['packliste.container_id']}")], "Issued by: Muster Maschinen GmbH", 20, [(0, "Pos"), (60, "HS Code"), (140, "Qty"), (200, "Unit"), (260, "Packed in")]]
    lines += [[(0, nr), (60, hs), (140, n), (200, "pce"), (260, "crate")] for nr, hs, n in of("positionen", ("nr", "hs6", "menge"))]
    lines += ["Packages", [(0, "Package ID"), (100, "Type"), (200, "Gross"), (300, "Net")]] + [[(0, i), (100, "crate"), (200, g), (300, n)] for i, g, n in of("packstuecke", ("id", "brutto_kg", "netto_kg"))]
    return [page([*lines, "Total gross weight: " + str(f["packliste.brutto_gesamt_kg"]) + " kg"])]


def bill_of_lading(f, draft=False):
    return [page([
        "BILL OF LADING" + (" DRAFT" if draft else ""), [(0, f"B/L No: {f['bill_of_lading.nummer']}"), (300, "Carrier: Sea Line")], [(0, f"Container No: {f['bill_of_lading.container_id']}"), (300, "Seal No: ML-1")],
        "Port of loading: Hamburg (DEHAM)", "Port of discharge: Boston (USBOS)", f"Gross weight: {f['bill_of_lading.brutto_kg']} kg", "Shipped on board: 8.9.2026",
    ])]


def export_document(f):
    rows = [(f[f"abd.positionen.{k}.nr"], f[f"abd.positionen.{k}.warennummer"]) for k in range(9) if f"abd.positionen.{k}.nr" in f]
    return [page([
        "AUSFUHRBEGLEITDOKUMENT", f"MRN: {f['abd.mrn']}", f"Container Nr: {f['abd.container_id']}", [(0, "Ausführer / Versender")], "Muster Maschinen GmbH", "EORI DE123456789012345", 20,
        [(0, "Pos"), (60, "Warennummer"), (160, "Warenbezeichnung"), (300, "Menge"), (360, "Einheit")], *[[(0, str(nr)), (60, str(code)), (160, "Pumpe"), (300, "12"), (360, "pce")] for nr, code in rows], "Dieses Dokument begleitet die Ware",
    ])]
