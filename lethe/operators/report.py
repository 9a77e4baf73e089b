"""Audit records, risk summaries and review figures, per document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lethe.functions import catalog as C

VERSION = "1.0.0"


def severity(kind: Column) -> Column:
    return F.when(kind.isin(*C.CRITICAL_TYPES), "critical").when(kind.isin(*C.MODERATE_TYPES), "moderate").otherwise("low")


def type_counts(ents: DataFrame) -> DataFrame:
    """doc_id, entity_type, n, first (place of the first one): partial counts before the shuffle."""
    place = F.struct("page_num", "start", "entity_type")
    return ents.groupBy("doc_id", "entity_type").agg(F.count("*").alias("n"), F.min(place).alias("first"))


def audit(ents: DataFrame, names: DataFrame, action: str, model: str, verified: bool, clock: Column | None = None) -> DataFrame:
    """A content-free record for each document of names (doc_id, filename): the name only as a hash."""
    per = type_counts(ents).groupBy("doc_id").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("entity_type"), F.struct(F.col("n").cast("int").alias("count"), severity(F.col("entity_type")).alias("severity")))))).alias("entity_summary"),
        F.sum("n").alias("total"),
    )
    none = F.create_map().cast("map<string,struct<count:int,severity:string>>")
    at = F.date_format(F.current_timestamp() if clock is None else clock, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return names.join(per, "doc_id", "left").select(
        "doc_id", at.alias("timestamp"), F.sha2("filename", 256).alias("filename_hash"), F.lit(model).alias("model"), F.lit(verified).alias("llm_verified"),
        F.coalesce("entity_summary", none).alias("entity_summary"), F.lit(action).alias("action"), F.coalesce("total", F.lit(0)).alias("total_entities_redacted"),
        F.lit(VERSION).alias("app_version"),
    )


def audit_bytes(records: DataFrame) -> DataFrame:
    fields = [c for c in records.columns if c != "doc_id"]
    return records.select("doc_id", F.encode(F.to_json(F.struct(*fields), {"pretty": "true"}), "UTF-8").alias("content"))


def _said(kind: Column, n: Column) -> Column:
    name = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in C.TYPE_LABELS.items() for x in kv)), kind), F.replace(F.lower(kind), F.lit("_"), F.lit(" ")))
    many = F.when(name.endswith("s") | name.endswith("x"), F.lit("es")).otherwise(F.lit("s"))
    return F.concat(n.cast("string"), F.lit(" "), name, F.when(n == 1, F.lit("")).otherwise(many))


def risk(ents: DataFrame, docs: DataFrame) -> DataFrame:
    """doc_id, sentence, severity, critical_types_found, counts of each document of docs (doc_id)."""
    entry = F.struct((-F.col("n")).alias("neg"), "first", "entity_type", "n")
    per = type_counts(ents).groupBy("doc_id").agg(F.array_sort(F.collect_list(entry)).alias("e"))
    x = docs.select("doc_id").join(per, "doc_id", "left")
    kinds = F.transform("e", lambda e: e["entity_type"])
    said = F.transform("e", lambda e: _said(e["entity_type"], e["n"]))
    joined = F.when(F.size(said) == 1, F.element_at(said, 1)).otherwise(F.concat(F.array_join(F.slice(said, 1, F.size(said) - 1), ", "), F.lit(" and "), F.element_at(said, -1)))
    critical = F.array_sort(F.filter(kinds, lambda k: k.isin(*C.CRITICAL_TYPES)))
    people = F.aggregate("e", F.lit(0).cast("bigint"), lambda a, e: a + F.when(e["entity_type"].isin("PERSON", "LOCATION"), e["n"]).otherwise(0))
    return x.select(
        "doc_id",
        F.when(F.col("e").isNull(), "No personally identifiable information was detected.").otherwise(F.concat(F.lit("This document contains "), joined, F.lit("."))).alias("sentence"),
        F.when(F.coalesce(F.size(critical), F.lit(0)) > 0, "critical").when(F.coalesce(people, F.lit(0)) > 2, "moderate").otherwise("low").alias("severity"),
        F.coalesce(critical, F.array().cast("array<string>")).alias("critical_types_found"),
        F.coalesce(F.map_from_entries(F.transform("e", lambda e: F.struct(e["entity_type"], e["n"].cast("int")))), F.create_map().cast("map<string,int>")).alias("counts"),
    )


def page_stats(pages: DataFrame) -> DataFrame:
    blank = F.length(F.regexp_replace("text", r"(?U)\s+", "")) == 0
    return pages.groupBy("doc_id").agg(F.count("*").alias("pages"), F.count_if("is_ocr").alias("ocr_pages"), F.count_if(F.col("is_ocr") & blank).alias("failed_pages"))


def active_counts(reviewed: DataFrame) -> DataFrame:
    return reviewed.groupBy("doc_id", "page_num").agg(F.count("*").alias("found"), F.sum(F.col("approved").cast("int")).alias("active"))


def model_runs(ents: DataFrame, docs: DataFrame, model: str) -> DataFrame:
    """A model's run over docs (document, pages, seconds) from the entities (doc_id, entity_type) that it found: model,
    document, ord (0 for the first document, which loads the model), pages, seconds, seconds_per_page, entities, types (a
    map of counts). The first document is found by one minimum, not by an order of all."""
    counts = ents.groupBy("doc_id", "entity_type").agg(F.count("*").alias("n")).groupBy(F.col("doc_id").alias("document"))
    per = counts.agg(F.sum("n").alias("entities"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("entity_type", "n")))).alias("types"))
    first = docs.agg(F.min("document").alias("first"))
    x = docs.join(per, "document", "left").crossJoin(F.broadcast(first))  # one row
    return x.select(
        F.lit(model).alias("model"), "document", F.when(F.col("document") == F.col("first"), 0).otherwise(1).alias("ord"), "pages", "seconds",
        F.round(F.col("seconds") / F.greatest("pages", F.lit(1)), 3).alias("seconds_per_page"), F.coalesce("entities", F.lit(0)).alias("entities"),
        F.coalesce("types", F.create_map().cast("map<string,bigint>")).alias("types"),
    )


def run_counts(runs: DataFrame) -> DataFrame:
    """model, entity_type, n over all documents of runs."""
    return runs.select("model", F.explode("types").alias("entity_type", "n")).groupBy("model", "entity_type").agg(F.sum("n").alias("n"))


def bench_tables(runs: DataFrame, kinds: tuple[str, ...]) -> dict[str, DataFrame]:
    """The three tables of a benchmark: a summary of each model, its documents, and its types."""
    return {"summary": bench_summary(runs), "documents": runs.withColumn("types", F.to_json("types")), "types": type_pivot(run_counts(runs), kinds)}


def bench_summary(rows: DataFrame) -> DataFrame:
    """Per model of rows (model, document, ord, pages, entities, seconds): the first document warms up."""
    steady = F.col("ord") > 0
    return rows.groupBy("model").agg(
        F.sum("pages").alias("pages"), F.sum("entities").alias("entities"), F.round(F.avg("entities"), 1).alias("avg_entities"),
        F.round(F.avg("seconds"), 3).alias("avg_s"), F.min("seconds").alias("min_s"), F.max("seconds").alias("max_s"),
        F.round(F.avg(F.when(steady, F.col("seconds"))), 3).alias("steady_s"), F.max(F.when(~steady, F.col("seconds"))).alias("cold_s"),
    )


def steady_range(rows: DataFrame) -> DataFrame:
    """Least and most seconds of documents after the first, and distinct types, of rows with a column types."""
    s = F.when(F.col("ord") > 0, F.col("seconds"))
    kinds = rows.select("model", F.explode("types").alias("t")).groupBy("model").agg(F.count_distinct("t").alias("types"))
    return rows.groupBy("model").agg(F.min(s).alias("min_s"), F.max(s).alias("max_s")).join(kinds, "model")


def type_shares(counts: DataFrame) -> DataFrame:
    """Percent of each model's total; 0 where there is none."""
    total = F.sum("n").over(Window.partitionBy("model"))
    return counts.withColumn("pct", F.when(total > 0, F.round(100.0 * F.col("n") / total, 1)).otherwise(F.lit(0.0)))


def type_pivot(counts: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    return counts.groupBy("model").pivot("entity_type", list(kinds)).agg(F.sum("n")).fillna(0)

