"""Crafted rows that the registered queries add to the tables: most patterns never occur there."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lethe.sources.tables import document_pages, read

TEXTS = (
    "AHV: 756.1234.5678.90", "AHV 756 1234 5678 90, end", "x756.1234.5678.90 and 756.1111.2222.33", "IBAN CH56 0483 5012 3456 7800 9 here",
    "Code: ABCD-EFgh-IJKL-MNop", "Address: 8003 Zurich", "8003 8004 Zug", "id 12-3456-78 ok", "ref 1234567890123 end", "12345678901",
    "Insurance no. 100 452 956", "SSN: 123-45-6789", "NI AB123456C ok", "at sw1a 1aa today", "nir 185057800608436 x", "cf RSSMRA85M01H501Z .",
    "dni 12345678Z nie x1234567l", "pass AB1234567 now", "Contact info@example.com today", "😀 a@b.com and c.d@e.org|", "call +41 79 123 45 67 now",
    "iban DE44 5001 0517 5407 3249 31 ok", "4111 1111 1111 1111 foo", "4111-1111-1111-1112 bad", "host 192.168.1.255 and 256.1.1.1",
    "Born 15.03.1990 in Zurich", "on 2020-02-30 or 2020-13-01", "Name: Anna Muster\nPatient = Bob", "Physician: John Smith here", "Policy no: 100 452 956  \nnext",
    "Geburtsdatum: 1.2.1990", "Passport No: X1234567", "Adresse: Bahnhofstrasse 14, 8001 Zug\r\nmore", "Adresse: " + "long " * 20, "code J45.1 and U99 and B20",
    "Diagnosis: Asthma bronchiale\nok", "Medication: Aspirin 100 mg", "Allergies: none known", "Blutgruppe: A+", "blood type AB-",
    "Premium region BE 3 and BE 3", "abbreviation AB is not a name: AB", "Charles Muster met Charles Muster and Charles Muster", "", "Name: A. Policy: x",
)


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents, and the crafted texts under negative ids."""
    own = spark.createDataFrame([(-1 - i, 0, t) for i, t in enumerate(TEXTS)], "doc_id long, page_num int, text string")
    return document_pages(read(spark, sf_dir, "documents")).union(own)


def literal(x) -> str:
    if x is None:
        return "NULL"
    if isinstance(x, bool):
        return str(x).upper()
    if isinstance(x, float):
        return f"{x!r}::DOUBLE"
    return str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"


def values(name: str, columns: str, rows) -> str:
    """A CTE of literal rows."""
    body = ", ".join("(" + ", ".join(map(literal, r)) + ")" for r in rows)
    return f"{name} AS (SELECT * FROM (VALUES {body}) AS v({columns}))"


SRC_SQL = (
    "src AS (SELECT doc_id, page_num, text, translate(text, chr(1)||chr(2)||chr(28)||chr(29)||chr(30)||chr(31), chr(3)||chr(3)||'    ') AS scan FROM "
    "(SELECT doc_id, 0 AS page_num, coalesce(text, '') AS text FROM documents UNION ALL SELECT * FROM (VALUES "
    + ", ".join(f"({-1 - i}, 0, {literal(t)})" for i, t in enumerate(TEXTS))
    + ") AS f(doc_id, page_num, text)))"
)
