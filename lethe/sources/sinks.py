"""Outputs: de-identified text, key files, audit records and benchmark tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lethe.operators.deid import labels_of
from lethe.operators.report import audit_bytes
from lethe.operators.vault import key_file, sealed


def write_deidentified(result: DataFrame, folder: str) -> None:
    """The rewritten text only: mappings go to the vault."""
    result.drop("mapping").write.mode("errorifexists").parquet(f"{folder}/redacted")


def write_vault(mappings: DataFrame, folder: str) -> None:
    """Key files of rows (doc_id, mapping, key[, pk, salt])."""
    locked = "pk" in mappings.columns
    blob = key_file(F.col("key"), sealed(F.col("mapping"), F.col("key")), F.col("pk") if locked else None, F.col("salt") if locked else None)
    mappings.filter(F.size(labels_of(F.col("mapping"))) > 0).select("doc_id", blob.alias("blob")).write.mode("errorifexists").parquet(f"{folder}/redaction_key")


def write_audit(records: DataFrame, folder: str) -> None:
    audit_bytes(records).select("doc_id", F.decode("content", "UTF-8").alias("record")).write.mode("errorifexists").parquet(f"{folder}/audit")
    records.drop("doc_id").write.mode("errorifexists").json(f"{folder}/audit_json")


def write_benchmark(tables: dict[str, DataFrame], folder: str) -> None:
    """Each table as JSON and as CSV with a header."""
    for name, df in tables.items():
        df.write.mode("overwrite").json(f"{folder}/{name}.json")
        df.write.mode("overwrite").option("header", True).csv(f"{folder}/{name}.csv")
