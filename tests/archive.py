"""A small archive of raw files: master data, mails, invoices, a letter, bank files, indexes and a daily drop."""

from __future__ import annotations

import json
from pathlib import Path

MASTER = {
    "liegenschaft": {"id": "LIE-001", "name": "WEG Park", "strasse": "Parkweg 1", "plz": "01234", "ort": "Berg", "verwalter_email": "verwaltung@example.org", "weg_bankkonto_iban": "DE1"},
    "gebaeude": [{"id": "HAUS-12", "hausnr": "12"}, {"id": "HAUS-14", "hausnr": "14"}],
    "einheiten": [{"id": "EH-016", "haus_id": "HAUS-12", "einheit_nr": "WE 16"}],
    "eigentuemer": [{"id": "EIG-001", "vorname": "Ana", "nachname": "Beck", "email": "ana@example.org", "einheit_ids": ["EH-016"]}],
    "mieter": [{"id": "MIE-001", "vorname": "Tom", "nachname": "Rau", "einheit_id": "EH-016", "eigentuemer_id": "EIG-001", "mietbeginn": "2024-02-01", "mietende": "2024-12-31", "email": "tom@example.org"}],
    "dienstleister": [{"id": "DL-007", "firma": "Rohr & Co", "email": "rohr@example.org"}],
}
MAIL = "From: {}\r\nTo: verwaltung@example.org\r\nSubject: {}\r\nDate: {}\r\nMessage-ID: <{}@Mail>\r\n{}Content-Transfer-Encoding: quoted-printable\r\n\r\n{}\r\n"
FILES = {
    "data/stammdaten/stammdaten.json": json.dumps(MASTER),
    "data/emails/2024-03/20240301_080000_EMAIL-00001.eml": MAIL.format("Tom <tom@example.org>", "Wasserschaden in WE 16", "Fri, 1 Mar 2024 08:00:00 +0100", "a1", "", "Die Heizung ist defekt, Frist=\r\n bis zum Montag. MIE-001"),
    "data/emails/2024-03/20240302_080000_EMAIL-00002.eml": MAIL.format("verwaltung@example.org", "Re: Wasserschaden in WE 16", "Sat, 2 Mar 2024 08:00:00 +0100", "a2", "In-Reply-To: <A1@mail>\r\nReferences:\r\n <a0@mail> <a1@mail>\r\n", "Danke."),
    "data/emails/2024-03/20240303_080000_EMAIL-00003.eml": MAIL.format("news@example.net", "Newsletter", "Sun, 3 Mar 2024 08:00:00 +0000", "a3", "", "Werbung"),
    "data/rechnungen/2024-03/20240310_DL-007_INV-00009.pdf": "pdf-9",
    "data/rechnungen/2024-03/20240310_DL-007_INV-DUP-00009.pdf": "pdf-9",
    "data/rechnungen/2024-04/20240401_DL-FAKE-7_INV-FAKE-2.pdf": "pdf-f",
    "data/briefe/2024-05/20240502_etv_protokoll_LTR-00003.pdf": "pdf-3",
    "data/bank/kontoauszug.csv": '﻿Buchungstag;Buchungstext;Betrag;Verwendungszweck;Kundenreferenz (End-to-End)\r\n05.03.2024;DEBIT;-12,50;"Rg ""9""\nTeil";TX-00001\r\n;;;;\r\n',
    "data/bank/bank_index.csv": "id,datum,typ,betrag,kategorie,gegen_name,verwendungszweck,referenz_id,error_types\nTX-00001,2024-03-05,DEBIT,12.50,repair,Rohr & Co,Rg 9,INV-00009,\nTX-00002,2024-03-06,CREDIT,700,rent,Tom Rau,Miete,,amount\n",
    "data/bank/camt.xml": "<Document/>",
    "data/incremental/day-01/rechnungen_index.csv": "id,rechnungsnr,datum,dienstleister_id,netto,mwst,brutto\nINV-00010,RE-10,2025-01-02,DL-007,10.00,1.90,11.90\n",
    "data/incremental/day-01/incremental_manifest.json": '{"day_index": 1}',
    "data/incremental/day-02/emails/20250103_080000_EMAIL-00004.eml": MAIL.format("tom@example.org", "Miete", "Fri, 3 Jan 2025 08:00:00 +0000", "a4", "", "bezahlt"),
    "data/other/readme.txt": "nothing",
}
TEXTS = [
    ("data/rechnungen/2024-03/20240310_DL-007_INV-00009.pdf", "Rohr & Co\nRechnung RE-9\nRechnungsnr.: RE-9\nKundennr.: K1 \nDatum:   10.03.2024\nSumme netto: 1.000,00 EUR\nzzgl. 19% MwSt: 190,00 EUR\nGesamtbetrag brutto: 1.190,00 EUR\nIBAN DE02 1203 0000 0000 2020 51\n", 1),
    ("data/rechnungen/2024-04/20240401_DL-FAKE-7_INV-FAKE-2.pdf", "leer", 1),
    ("data/briefe/2024-05/20240502_etv_protokoll_LTR-00003.pdf", "Kopf\nProtokoll der Eigentuemerversammlung\nDatum: 02.05.2024\nTOP 1: Dach\nTOP 2: Wirtschaftsplan 100,00 EUR\n", 2),
]


def write(root: Path, without: tuple[str, ...] = ()) -> str:
    """The archive below ``root``; returns the path of its data folder."""
    for name, content in FILES.items():
        if name not in without:
            path = root / name
            path.parent.mkdir(parents=True, exist_ok=True)
            path.write_bytes(content.encode())
    return str(root / "data")
