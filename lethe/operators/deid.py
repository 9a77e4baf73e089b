"""De-identification: seven modes, labels, permanent and reversible rewriting, restoring."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lethe.functions import catalog as C
from lethe.functions.text import looked_up
from lethe.operators.detect import kept_hits, with_hits
from lethe.operators.vault import hmac_sha256, opened, read_key_files
from lethe.sources.shared import stored

LABEL_HEX = 12
#: The mapping's entry of a document's key of hashes.
HMAC_ENTRY = "__hmac_key__"


def label(kind: Column, salt: str, *place: Column) -> Column:
    """[TYPE_hex]: derived from the salt and the place, so a retried task makes the same one."""
    h = F.sha2(F.concat_ws("\u0001", F.lit(salt), *(p.cast("string") for p in place), kind), 256)
    return F.concat(F.lit("["), kind, F.lit("_"), F.substring(h, 1, LABEL_HEX), F.lit("]"))


def replacement(approach: Column | str, kind: Column, text: Column, tag: Column, key: Column | None = None) -> Column:
    """What stands for an entity; an unknown mode gives its type. Without a key the hash is a plain one."""
    a = F.lit(approach) if isinstance(approach, str) else approach
    body = F.encode(text, "UTF-8")
    digest = F.sha2(body, 256) if key is None else F.when(key.isNull(), F.sha2(body, 256)).otherwise(hmac_sha256(key, body))
    short = F.when(tag.startswith("["), F.substring(tag, 2, 8)).otherwise(F.substring(tag, 1, 8))
    named = F.concat(F.lit("<"), kind, F.lit(">"))
    return (
        F.when(a == "redact", F.lit("")).when(a == "replace", named).when(a == "mask", F.repeat(F.lit("*"), F.length(text)))
        .when(a == "hash", F.concat(F.lit("[#"), F.substring(digest, 1, 12), F.lit("]")))
        .when(a == "encrypt", F.concat(F.lit("[enc:"), short, F.lit("]"))).when(a == "highlight", text)
        .when(a == "synthesize", looked_up(C.SYNTHETIC, kind, "<REDACTED>")).otherwise(named)
    )


def rewritten(page: Column, swaps: Column) -> Column:
    """page with every occurrence of each swap's text replaced, by slicing at offsets and never by a pattern.

    swaps: array<struct<text, overlay>>. Longer texts go first. A text is first swapped for a mark that the page
    cannot hold, then the marks for the overlays, so an overlay is never searched again.
    """
    order = F.transform(F.array_sort(F.transform(swaps, lambda s: F.struct((-F.length(s["text"])).alias("n"), s["text"].alias("text"), s["overlay"].alias("overlay")))), lambda s, i: F.struct(s["text"].alias("text"), s["overlay"].alias("overlay"), i.alias("i")))
    clean = F.translate(page, "\u0001\u0002", "\u0003\u0003")
    mark = lambda s: F.concat(F.lit("\u0001"), F.translate(s["i"].cast("string"), "0123456789", "\u0010\u0011\u0012\u0013\u0014\u0015\u0016\u0017\u0018\u0019"), F.lit("\u0002"))
    marked = F.aggregate(order, clean, lambda acc, s: F.when(F.length(s["text"]) == 0, acc).otherwise(F.replace(acc, s["text"], mark(s))))
    return F.aggregate(order, marked, lambda acc, s: F.replace(acc, mark(s), s["overlay"]))


def deidentified(pages: DataFrame, ents: DataFrame, approach: str = "replace", salt: str = "", keys: DataFrame | None = None) -> DataFrame:
    """Permanent mode: doc_id, page_num, text (rewritten), mapping label -> original of approved entities.

    keys: doc_id, key BINARY for the hash mode, kept in a table and never in a plan.
    """
    e = ents.withColumn("label", label(F.col("entity_type"), salt, F.col("doc_id"), F.col("page_num"), F.col("start")))
    key = None
    if keys is not None:
        e, key = e.join(keys, "doc_id", "left"), F.col("key")
    e = e.withColumn("overlay", replacement(approach, F.col("entity_type"), F.col("text"), F.col("label"), key))
    per = e.groupBy("doc_id", "page_num").agg(F.collect_list(F.struct("text", "overlay")).alias("swaps"), F.map_from_entries(F.collect_list(F.struct("label", "text"))).alias("mapping"))
    if keys is not None and approach == "hash":  # kept with the labels, so that hashes can be repeated
        named = keys.select("doc_id", F.create_map(F.lit(HMAC_ENTRY), F.lower(F.hex("key"))).alias("own"))
        per = per.join(named, "doc_id", "left").withColumn("mapping", F.when(F.col("own").isNull(), F.col("mapping")).otherwise(F.map_concat("mapping", "own"))).drop("own")
    out = pages.join(per, ["doc_id", "page_num"], "left")
    text = F.when(F.col("swaps").isNull(), F.col("text")).otherwise(rewritten(F.col("text"), F.col("swaps")))
    return out.select("doc_id", "page_num", text.alias("text"), F.coalesce("mapping", F.create_map().cast("map<string,string>")).alias("mapping"))


def _with_kept(pages: DataFrame) -> DataFrame:
    """Adds kept, the hits of each page that stay, as a column that later ones use and do not compute again."""
    return with_hits(pages).withColumn("kept", F.explode(F.array(kept_hits(F.col("hits"), F.col("text"))))).drop("hits")


def _place(h: Column, salt: str) -> Column:
    return label(h["type"], salt, F.col("doc_id"), F.col("page_num"), h["start"])


def deidentified_pages(pages: DataFrame, approach: str = "replace", salt: str = "") -> DataFrame:
    """deidentified() of all entities that detection finds, in one projection of each page: no exchange."""
    x = _with_kept(pages)
    swaps = F.transform("kept", lambda h: F.struct(h["text"].alias("text"), replacement(approach, h["type"], h["text"], _place(h, salt)).alias("overlay")))
    mapping = F.map_from_entries(F.transform("kept", lambda h: F.struct(_place(h, salt), h["text"])))
    text = F.when(F.size("kept") == 0, F.col("text")).otherwise(rewritten(F.col("text"), swaps))
    return x.select("doc_id", "page_num", text.alias("text"), mapping.alias("mapping"))


def overlaid_pages(pages: DataFrame, approach: str = "replace", salt: str = "") -> DataFrame:
    """overlaid() of all entities that detection finds, in one projection of each page: no exchange."""
    def overlay(h: Column) -> Column:
        tag = _place(h, salt)
        said = F.lit("") if approach == "highlight" else replacement(approach, h["type"], h["text"], tag)
        return F.struct(tag.alias("label"), h["start"].alias("start"), h["end"].alias("end"), said.alias("overlay"))

    return _with_kept(pages).withColumn("overlays", F.array_sort(F.transform("kept", overlay)).cast(f"array<{OVERLAY}>")).drop("kept")


def document_keys(docs: DataFrame) -> DataFrame:
    """doc_id, key: 32 random bytes for each document, stored, so that every use and retry sees the same ones."""
    ids = docs.select("doc_id").distinct()
    return stored(ids.select("doc_id", F.unhex(F.sha2(F.concat(F.uuid(), F.uuid()), 256)).alias("key")), "hash-keys")


OVERLAY = "struct<label:string,start:int,end:int,overlay:string>"


def overlaid(pages: DataFrame, ents: DataFrame, approach: str = "replace", salt: str = "") -> DataFrame:
    """Reversible mode: the text stays, overlays carry labels and never an original."""
    e = ents.withColumn("label", label(F.col("entity_type"), salt, F.col("doc_id"), F.col("page_num"), F.col("start")))
    e = e.withColumn("overlay", F.when(F.lit(approach) == "highlight", F.lit("")).otherwise(replacement(approach, F.col("entity_type"), F.col("text"), F.col("label"))))
    per = e.groupBy("doc_id", "page_num").agg(F.array_sort(F.collect_list(F.struct("label", "start", "end", "overlay"))).alias("overlays"))
    return pages.join(per, ["doc_id", "page_num"], "left").withColumn("overlays", F.coalesce("overlays", F.array().cast(f"array<{OVERLAY}>")))


def labels_of(mapping: Column) -> Column:
    """Labels of a mapping without its own entries, whose keys begin with two underscores."""
    return F.filter(F.map_keys(mapping), lambda k: ~k.startswith("__"))


def redaction_mode(overlays: Column, mapping: Column) -> Column:
    known = labels_of(mapping)
    return F.when(F.exists(overlays, lambda o: F.array_contains(known, o["label"])), "reversible").otherwise("permanent")


def restored(overlays: Column, mapping: Column) -> Column:
    """The overlays that the mapping does not know: foreign ones stay."""
    known = labels_of(mapping)
    return F.filter(overlays, lambda o: ~F.array_contains(known, o["label"]))


def deredacted(redacted: DataFrame, key_files: DataFrame, **reading) -> DataFrame:
    """Redacted documents (doc_id, page_num, text, overlays) with what their key files open: adds mode, left (the overlays
    that stay), removed and error. key_files: doc_id, blob, passphrase; a blank passphrase is none. A document without a
    key file, or whose file does not open, keeps its overlays and says why. One join, on doc_id."""
    opened_files = read_key_files(key_files.withColumn("passphrase", F.when(F.col("passphrase") != "", F.col("passphrase"))), **reading)
    maps = opened_files.withColumn("mapping", opened(F.col("ciphertext"), F.col("key")))
    failed = F.when(F.col("error").isNull() & F.col("mapping").isNull(), "decryption failed").otherwise(F.col("error"))
    x = redacted.join(maps.select("doc_id", "mapping", failed.alias("error"), F.lit(True).alias("given")), "doc_id", "left")
    x = x.withColumn("error", F.when(F.col("given").isNull(), "no key file").otherwise(F.col("error"))).withColumn("mapping", F.coalesce("mapping", F.create_map().cast("map<string,string>")))
    x = x.withColumn("mode", redaction_mode(F.col("overlays"), F.col("mapping"))).withColumn("left", restored(F.col("overlays"), F.col("mapping")))
    return x.select(*redacted.columns, "mode", "left", (F.size("overlays") - F.size("left")).alias("removed"), "error")


def reviewed(ents: DataFrame, overrides: DataFrame, custom: DataFrame) -> DataFrame:
    """Entities with approved (true unless overridden), and rows that a reviewer added."""
    on = ["doc_id", "page_num", "start", "end"]
    rows = ents.join(overrides, on, "left").withColumn("approved", F.coalesce("approved", F.lit(True)))
    added = custom.select("doc_id", "page_num", F.lit("CUSTOM").alias("entity_type"), "text", F.lit(0).alias("start"), F.length("text").alias("end"), F.lit(1.0).alias("score"), F.lit("NER").alias("source"), F.lit("").alias("analysis"), F.lit(True).alias("approved"))
    return rows.select(*added.columns).unionByName(added)


def first_of_page(ents: DataFrame) -> DataFrame:
    """Review order: the least certain last, then by page and place."""
    w = Window.partitionBy("doc_id").orderBy(F.desc("score"), "page_num", "start", "entity_type")
    return ents.withColumn("position", F.row_number().over(w))


def flattened(pages: DataFrame, redacted: DataFrame) -> DataFrame:
    """Recognised pages that were redacted keep neither their word boxes nor an image: nothing else could show what
    was there. redacted: doc_id, page_num."""
    gone = redacted.select("doc_id", "page_num", F.lit(True).alias("gone")).distinct()
    x = pages.join(gone, ["doc_id", "page_num"], "left").withColumn("gone", F.coalesce("gone", F.lit(False)) & F.col("is_ocr"))
    held = [c for c in ("word_boxes", "content") if c in pages.columns]
    return x.withColumns({c: F.when(~F.col("gone"), F.col(c)) for c in held}).select(*pages.columns)
