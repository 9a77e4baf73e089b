"""More registered queries: vault, audit and risk, verdicts, layout, benchmark summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lethe.functions import catalog as C
from lethe.functions.text import strip
from lethe.operators import deid, filters, layout, providers, report, vault, verify
from lethe.plans import fixtures
from lethe.plans.fixtures import literal, values
from lethe.plans.hits_sql import ENTS_SQL, case_map, in_list
from lethe.plans.hits_sql import strip as strip_sql
from lethe.plans.suite import CONV_SQL, conv, ents, query, rows
from lethe.sources import tables

CLOCK = "2024-01-02T03:04:05Z"


# Vault -----------------------------------------------------------------------------------------------------
def _mappings(spark, sf_dir) -> DataFrame:
    e = ents(spark, sf_dir)
    tag = deid.label(F.col("entity_type"), "salt", F.col("doc_id"), F.col("page_num"), F.col("start"))
    m = e.groupBy("doc_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(tag, F.col("text"))))).alias("mapping"))
    return m.withColumn("key", F.unhex(F.sha2(F.col("doc_id").cast("string"), 256)))


@query("c2_encrypt_round_trip", f"WITH {ENTS_SQL} SELECT doc_id, count(*) AS entries, true AS same, true AS wrong_key_fails, 0::BIGINT AS overhead FROM ents GROUP BY doc_id")
def _(spark, sf_dir):
    m = _mappings(spark, sf_dir).withColumn("sealed", vault.sealed(F.col("mapping"), F.col("key")))
    back, other = vault.opened(F.col("sealed"), F.col("key")), vault.opened(F.col("sealed"), F.unhex(F.sha2(F.lit("other"), 256)))
    size = F.octet_length(F.to_json("mapping")) + C.NONCE_BYTES + 16
    return m.select("doc_id", F.size("mapping").cast("long").alias("entries"), (F.to_json(back) == F.to_json("mapping")).alias("same"), other.isNull().alias("wrong_key_fails"), (F.octet_length("sealed") - size).cast("long").alias("overhead"))


def _key_files(spark, sf_dir) -> DataFrame:
    m = _mappings(spark, sf_dir).withColumn("sealed", vault.sealed(F.col("mapping"), F.col("key")))
    phrase = F.when(F.pmod("doc_id", F.lit(64)) == 0, F.lit("correct horse"))
    m = m.withColumn("passphrase", phrase).withColumn("salt", F.unhex(F.md5(F.encode(F.col("doc_id").cast("string"), "UTF-8"))))
    m = m.withColumn("pk", vault.derive("passphrase", "salt", F.lit(C.PBKDF2_ROUNDS)))
    return m.withColumn("blob", vault.key_file(F.col("key"), F.col("sealed"), F.col("pk"), F.col("salt")))


@query("c5_key_files", f"WITH {ENTS_SQL} SELECT doc_id, (doc_id % 64 + 64) % 64 = 0 AS locked, true AS same_key, true AS same_map FROM ents GROUP BY doc_id")
def _(spark, sf_dir):
    files = _key_files(spark, sf_dir).select("doc_id", "blob", "passphrase", F.col("key").alias("own"), F.to_json("mapping").alias("m"))
    x = vault.read_key_files(files)
    return x.select("doc_id", F.col("passphrase").isNotNull().alias("locked"), F.coalesce(F.col("key") == F.col("own"), F.lit(False)).alias("same_key"), F.coalesce(F.to_json(vault.opened(F.col("ciphertext"), F.col("key"))) == F.col("m"), F.lit(False)).alias("same_map"))


_OLD_MAP = '{"[X_1]":"Anna"}'


def _old_token(body: Column, key: Column) -> Column:
    """A token of the older layouts, at time 0 and with a fixed IV."""
    head = F.concat(F.lit(bytearray(b"\x80" + bytes(8))), F.aes_encrypt(body, F.substring(key, 17, 16), F.lit("CBC"), F.lit("PKCS"), F.lit(bytearray(range(16)))))
    raw = F.concat(head, F.unhex(vault.hmac_sha256(F.substring(key, 1, 16), head)))
    return F.encode(F.translate(F.base64(raw), "+/", "-_"), "UTF-8")


_KEY_FILE_CASES = (
    ("not a key file", "unrecognised format", None), ("cut short", "truncated or corrupt", None), ("cut short, locked", "truncated or corrupt", None), ("wrong passphrase", "wrong passphrase or corrupted file", None),
    ("whole", None, _OLD_MAP), ("old, plain", None, _OLD_MAP), ("old, locked", None, _OLD_MAP), ("old, no passphrase", "needs its passphrase", None), ("old, wrong", "wrong passphrase or corrupted file", None), ("old, cut", "truncated or corrupt", None),
)


@query("c6_key_file_errors", f"WITH {values('v', 'kind, error, mapping', _KEY_FILE_CASES)} SELECT * FROM v")
def _(spark, sf_dir):
    key, salt = bytes(range(32)), b"0123456789abcdef"
    pk = vault.derived_key("right", salt)
    one = rows(spark, [(bytearray(key), bytearray(pk), bytearray(salt), _OLD_MAP)], "key binary, pk binary, salt binary, map string")
    one = one.withColumn("ct", vault.sealed(F.from_json("map", "map<string,string>"), F.col("key")))
    # the older layouts' key is text, of which the bytes sign and encrypt
    own = F.encode(F.base64("key"), "UTF-8")
    token, wrapped = _old_token(F.encode("map", "UTF-8"), F.col("key")), _old_token(own, F.col("pk"))
    size = F.unhex(F.lpad(F.hex(F.length(wrapped)), 8, "0"))
    old = F.concat(F.lit(bytearray(vault.OLD_LOCKED)), F.col("salt"), size, wrapped, token)
    blobs = one.select(vault.key_file(F.col("key"), F.col("ct")).alias("plain"), vault.key_file(F.col("key"), F.col("ct"), F.col("pk"), F.col("salt")).alias("locked"), old.alias("old"), F.concat(own, F.lit(bytearray(vault.OLD_PLAIN)), token).alias("older"))
    kinds = (
        ("not a key file", F.encode(F.lit("whatever"), "UTF-8"), None), ("cut short", F.substring("plain", 1, 20), None), ("cut short, locked", F.substring("locked", 1, 50), "right"),
        ("wrong passphrase", F.col("locked"), "wrong"), ("whole", F.col("locked"), "right"), ("old, plain", F.col("older"), None), ("old, locked", F.col("old"), "right"),
        ("old, no passphrase", F.col("old"), ""), ("old, wrong", F.col("old"), "wrong"), ("old, cut", F.substring("old", 1, 40), "right"),
    )
    cases = blobs.select(F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), b.alias("blob"), F.lit(p).cast("string").alias("passphrase")) for k, b, p in kinds))).alias("x")).select("x.*")
    return vault.read_key_files(cases).select("kind", "error", F.to_json(vault.opened(F.col("ciphertext"), F.col("key"))).alias("mapping"))


# Audit and risk --------------------------------------------------------------------------------------------
_SEVERITY = f"CASE WHEN {in_list('entity_type', C.CRITICAL_TYPES)} THEN 'critical' WHEN {in_list('entity_type', C.MODERATE_TYPES)} THEN 'moderate' ELSE 'low' END"
_NAMES = "names AS (SELECT doc_id, 'file-' || doc_id || '.pdf' AS filename FROM documents)"


def _names(spark, sf_dir) -> DataFrame:
    return tables.read(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("file-"), F.col("doc_id").cast("string"), F.lit(".pdf")).alias("filename"))


@query("a1_audit", f"""WITH {ENTS_SQL}, {_NAMES}, c AS (SELECT doc_id, entity_type, count(*) AS n, {_SEVERITY} AS severity FROM ents GROUP BY doc_id, entity_type),
p AS (SELECT doc_id, string_agg(entity_type || '=' || n || '/' || severity, ',' ORDER BY entity_type) AS s, sum(n) AS total FROM c GROUP BY doc_id)
SELECT n.doc_id, '{CLOCK}' AS timestamp, sha256(filename) AS filename_hash, 'patterns' AS model, false AS llm_verified, coalesce(s, '') AS entity_summary, 'replace' AS action, CAST(coalesce(total, 0) AS BIGINT) AS total_entities_redacted, '1.0.0' AS app_version FROM names n LEFT JOIN p USING (doc_id)""")
def _(spark, sf_dir):
    clock = F.lit("2024-01-02 03:04:05").cast("timestamp")
    a = report.audit(ents(spark, sf_dir), _names(spark, sf_dir), "replace", "patterns", False, clock)
    said = F.array_join(F.array_sort(F.transform(F.map_entries("entity_summary"), lambda e: F.concat(e["key"], F.lit("="), e["value"]["count"].cast("string"), F.lit("/"), e["value"]["severity"]))), ",")
    return a.withColumn("entity_summary", said).withColumn("total_entities_redacted", F.col("total_entities_redacted").cast("long"))


@query("k4_audit_bytes", f"WITH {_NAMES} SELECT doc_id, sha256(filename) AS filename_hash, true AS parses FROM names")
def _(spark, sf_dir):
    a = report.audit_bytes(report.audit(ents(spark, sf_dir), _names(spark, sf_dir), "mask", "patterns", False, F.lit("2024-01-02 03:04:05").cast("timestamp")))
    text = F.decode("content", "UTF-8")
    return a.select("doc_id", F.get_json_object(text, "$.filename_hash").alias("filename_hash"), (F.get_json_object(text, "$.action") == "mask").alias("parses"))


@query("a3_counts", f"WITH {ENTS_SQL} SELECT doc_id, entity_type, count(*) AS n FROM ents GROUP BY doc_id, entity_type")
def _(spark, sf_dir):
    return report.type_counts(ents(spark, sf_dir)).select("doc_id", "entity_type", "n")


_RISK = f"""{ENTS_SQL}, c AS (SELECT doc_id, entity_type, count(*) AS n, min(page_num) AS p, min("start") AS s FROM ents GROUP BY doc_id, entity_type),
l AS (SELECT *, {case_map('entity_type', C.TYPE_LABELS, '?')} AS known FROM c), w AS (SELECT *, CASE known WHEN '?' THEN replace(lower(entity_type), '_', ' ') ELSE known END AS name FROM l),
said AS (SELECT *, n || ' ' || name || CASE WHEN n = 1 THEN '' WHEN ends_with(name, 's') OR ends_with(name, 'x') THEN 'es' ELSE 's' END AS said FROM w),
docs AS (SELECT DISTINCT doc_id FROM src), per AS (SELECT doc_id, list(said ORDER BY -n, p, s, entity_type) AS parts, bool_or({in_list('entity_type', C.CRITICAL_TYPES)}) AS critical,
  sum(CASE WHEN entity_type IN ('PERSON', 'LOCATION') THEN n ELSE 0 END) AS people, list(entity_type ORDER BY entity_type) FILTER ({in_list('entity_type', C.CRITICAL_TYPES)}) AS kinds FROM said GROUP BY doc_id)"""


def _risk(spark, sf_dir) -> DataFrame:
    pages = fixtures.pages(spark, sf_dir)
    return report.risk(ents(spark, sf_dir), pages.select("doc_id").distinct())


@query("a4_severity", f"WITH {_RISK} SELECT doc_id, CASE WHEN critical THEN 'critical' WHEN people > 2 THEN 'moderate' ELSE 'low' END AS severity FROM docs LEFT JOIN per USING (doc_id)")
def _(spark, sf_dir):
    return _risk(spark, sf_dir).select("doc_id", "severity")


@query("a5_critical", f"WITH {_RISK} SELECT doc_id, coalesce(array_to_string(kinds, ','), '') AS critical_types FROM docs LEFT JOIN per USING (doc_id)")
def _(spark, sf_dir):
    return _risk(spark, sf_dir).select("doc_id", F.array_join("critical_types_found", ",").alias("critical_types"))


@query("a6_sentence", f"""WITH {_RISK} SELECT doc_id, CASE WHEN parts IS NULL THEN 'No personally identifiable information was detected.' WHEN len(parts) = 1 THEN 'This document contains ' || parts[1] || '.'
ELSE 'This document contains ' || array_to_string(parts[:-2], ', ') || ' and ' || parts[-1] || '.' END AS sentence FROM docs LEFT JOIN per USING (doc_id)""")
def _(spark, sf_dir):
    return _risk(spark, sf_dir).select("doc_id", "sentence")


@query("a8_page_stats", f"WITH {CONV_SQL} SELECT doc_id, count(*) AS pages, count(*) FILTER (page_num % 3 = 0) AS ocr_pages, count(*) FILTER (page_num % 3 = 0 AND regexp_replace(text, '\\s+', '', 'g') = '') AS failed_pages FROM pages GROUP BY doc_id")
def _(spark, sf_dir):
    return report.page_stats(conv(spark, sf_dir).withColumn("is_ocr", F.col("page_num") % 3 == 0))


@query("a9_active", f"WITH {ENTS_SQL} SELECT doc_id, page_num, count(*) AS found, count(*) FILTER (entity_type <> 'EMAIL') AS active FROM ents GROUP BY doc_id, page_num")
def _(spark, sf_dir):
    return report.active_counts(ents(spark, sf_dir).withColumn("approved", F.col("entity_type") != "EMAIL"))


@query("g1_filename_hash", f"WITH {_NAMES} SELECT doc_id, sha256(filename) AS filename_hash FROM names")
def _(spark, sf_dir):
    return _names(spark, sf_dir).select("doc_id", F.sha2("filename", 256).alias("filename_hash"))


@query("g2_type_severity", f"WITH {ENTS_SQL} SELECT DISTINCT entity_type, {_SEVERITY} AS severity FROM ents")
def _(spark, sf_dir):
    return ents(spark, sf_dir).select("entity_type", report.severity(F.col("entity_type")).alias("severity")).distinct()


# Verdicts --------------------------------------------------------------------------------------------------
RAW = (
    (1, "CONFIRMED - Anna Muster\nFALSE_POSITIVE - Jean-Luc - brand\nfalse_positive - Zurich - a city - really\nCONFIRMED\nNEW - PERSON - Bob Ray\nNEW - X\nNEW - ADDRESS - Bahnhofstrasse"),
    (2, "FALSE_POSITIVE - ACME\nCONFIRMED - ACME\n\n  CONFIRMED -  zurich  \nNEW - location - Main Street 5\nNEW - PERSON - B\nNEWS - A - B - C"),
    (3, "nothing to say"), (4, ""), (5, "FALSE_POSITIVE - ACME - company\r\nFALSE_POSITIVE - Bob - the name\nNEW - ORG - ACME"),
)
_RAW = values("r", "doc_id, raw", RAW)
_LINES = f"""{_RAW}, s AS (SELECT doc_id, regexp_split_to_array(raw, '\\r\\n|[\\n\\r]') AS l FROM r), l0 AS (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS ord FROM s),
lines AS (SELECT doc_id, ord, trim(line) AS line, string_split(trim(line), '-') AS p FROM l0 WHERE trim(line) <> '')"""
_REST = lambda i: f"trim(array_to_string(p[{i}:], '-'))"


def _raw(spark) -> DataFrame:
    return rows(spark, RAW, "doc_id long, raw string")


_VERDICTS = f"""{_LINES}, v AS (SELECT doc_id, ord, CASE WHEN starts_with(upper(line), 'CONFIRMED') THEN 'confirmed' ELSE 'false_positive' END AS verdict,
lower(CASE WHEN starts_with(upper(line), 'CONFIRMED') THEN {_REST(2)} ELSE trim(p[2]) END) AS key, CASE WHEN starts_with(upper(line), 'FALSE_POSITIVE') AND len(p) > 2 THEN {_REST(3)} END AS reason
FROM lines WHERE starts_with(upper(line), 'CONFIRMED') OR starts_with(upper(line), 'FALSE_POSITIVE')),
verdicts AS (SELECT doc_id, key, verdict, reason FROM v WHERE key <> '' QUALIFY row_number() OVER (PARTITION BY doc_id, key ORDER BY ord DESC) = 1)"""


@query("l5_parse_lines", f"WITH {_VERDICTS} SELECT * FROM verdicts")
def _(spark, sf_dir):
    return verify.verdicts(_raw(spark))


_NEW = f"{_LINES}, new AS (SELECT doc_id, ord, upper(trim(p[2])) AS entity_type, {_REST(3)} AS text FROM lines WHERE starts_with(upper(line), 'NEW') AND len(p) >= 3 AND length({_REST(3)}) >= 2)"


@query("l6_parse_new", f"WITH {_NEW} SELECT doc_id, entity_type, text FROM new")
def _(spark, sf_dir):
    return verify.new_entities(_raw(spark)).select("doc_id", "entity_type", "text")


JSONS = (
    (1, '{"verified": [{"text": "A", "verdict": "CONFIRMED"}], "additional": [{"text": "B", "type": "PERSON", "start": 3}]}'), (2, 'Sure:\n```json\n{"additional": [{"text": "C", "type": "X"}]}\n``` done'),
    (3, "no json"), (4, '{"verified": [broken'), (5, "[1, 2]"), (6, '{"entities": [{"text": "D", "type": "Y"}, {"text": "E", "type": "Z"}]}'), (7, 'here [{"text": "F", "type": "W"}]'), (8, ""),
)
_JSON = values("j", "doc_id, raw", JSONS)


@query("l7_parse_json", f"""WITH {_JSON}, x AS (SELECT doc_id, regexp_extract(raw, '(?s)\\{{.*\\}}') AS o FROM j), y AS (SELECT doc_id, CASE WHEN json_valid(o) THEN o ELSE '{{}}' END AS o FROM x)
SELECT doc_id, coalesce(json_array_length(o, '$.verified'), 0)::BIGINT AS verified, coalesce(json_array_length(o, '$.additional'), 0)::BIGINT AS additional, coalesce(json_extract_string(o, '$.additional[0].text'), '') AS first FROM y""")
def _(spark, sf_dir):
    a = rows(spark, JSONS, "doc_id long, raw string").select("doc_id", verify.json_answer(F.col("raw")).alias("a"))
    return a.select("doc_id", F.size("a.verified").cast("long").alias("verified"), F.size("a.additional").cast("long").alias("additional"), F.coalesce(F.get("a.additional", F.lit(0))["text"], F.lit("")).alias("first"))


@query("l8_parse_detected", f"""WITH {_JSON}, x AS (SELECT doc_id, regexp_extract(raw, '(?s)\\{{.*\\}}') AS o, regexp_extract(raw, '(?s)\\[.*\\]') AS a FROM j),
y AS (SELECT doc_id, CASE WHEN json_valid(o) AND json_array_length(o, '$.entities') IS NOT NULL THEN json_extract(o, '$.entities') WHEN json_valid(a) AND a <> '' THEN a::JSON ELSE '[]'::JSON END AS l FROM x)
SELECT doc_id, coalesce(json_extract_string(l, '$[0].text'), '') AS first FROM y""")
def _(spark, sf_dir):
    a = rows(spark, JSONS, "doc_id long, raw string").select("doc_id", verify.json_detected(F.col("raw")).alias("l"))
    return a.select("doc_id", F.coalesce(F.get("l", F.lit(0))["text"], F.lit("")).alias("first"))


CASES = (
    ("PERSON", "ner", "FALSE_POSITIVE", "brand"), ("ORGANIZATION", "regex", "FALSE_POSITIVE", "brand"), ("ORGANIZATION", "ner", "FALSE_POSITIVE", None), ("ORGANIZATION", "ner", "false_positive", "  "),
    ("ORGANIZATION", "ner", "false_positive", "brand"), ("LOCATION", "LLM", "CONFIRMED", "x"), ("CREDIT_CARD", "ner", "FALSE_POSITIVE", "x"),
)


@query("l3_verdict", f"""WITH {values('c', 'type, source, verdict, reason', CASES)} SELECT type, source, verdict, reason, CASE WHEN upper(verdict) = 'FALSE_POSITIVE' AND NOT {in_list('type', C.NEVER_DISPUTED)}
AND lower(source) <> 'regex' AND trim(coalesce(reason, '')) <> '' THEN 'false_positive' ELSE 'confirmed' END AS status FROM c""")
def _(spark, sf_dir):
    c = rows(spark, CASES, "type string, source string, verdict string, reason string")
    return c.withColumn("status", verify.verdict_status(F.col("verdict"), F.col("reason"), F.col("type"), F.col("source")))


MODEL_ENTS = (
    (1, 0, "PERSON", "Anna Muster", 0, 0.9, "ner"), (1, 1, "ORGANIZATION", "Jean", 3, 0.6, "ner"), (1, 0, "LOCATION", "Zurich", 20, 0.6, "ner"), (2, 0, "ORGANIZATION", "ACME", 0, 0.55, "ner"),
    (5, 0, "ORGANIZATION", "Acme", 0, 0.55, "ner"), (5, 0, "PERSON", "Bob", 9, 0.5, "ner"), (5, 0, "ORGANIZATION", "acme", 30, 0.5, "regex"),
)
_MODEL = values("m", 'doc_id, page_num, entity_type, text, "start", score, source', MODEL_ENTS)


def _model_ents(spark) -> DataFrame:
    e = rows(spark, MODEL_ENTS, "doc_id long, page_num int, entity_type string, text string, start int, score double, source string")
    return e.withColumn("end", F.col("start") + F.length("text")).withColumn("analysis", F.concat_ws(" | ", "source", "entity_type"))


@query("j5_verdict_join", f"""WITH {_VERDICTS.replace(_RAW, f'{_RAW}, {_MODEL}', 1)} SELECT m.doc_id, m.text, m."start", CASE WHEN v.verdict = 'false_positive' AND NOT {in_list('entity_type', C.NEVER_DISPUTED)} AND source <> 'regex'
AND trim(coalesce(reason, '')) <> '' THEN 'review: ' || reason ELSE 'LLM verified' END AS analysis FROM m LEFT JOIN verdicts v ON v.doc_id = m.doc_id AND v.key = lower(trim(m.text))""")
def _(spark, sf_dir):
    return verify.verified(_model_ents(spark), verify.verdicts(_raw(spark))).select("doc_id", "text", "start", "analysis")


@query("l11_entity_lines", f"""WITH {_MODEL} SELECT doc_id, string_agg('- [p' || (page_num + 1) || '] [' || entity_type || '] "' || text || '"', chr(10) ORDER BY page_num, "start") AS lines FROM m GROUP BY doc_id""")
def _(spark, sf_dir):
    return verify.entity_lines(_model_ents(spark))


MODEL_PAGES = ((1, 0, "Anna Muster met someone."), (1, 1, "Here Bob Ray and Bob Ray on Bahnhofstrasse."), (2, 0, "ACME at Main Street 5, Main Street 5"), (5, 0, "ACME and Bob"))
_PAGES = values("pg", "doc_id, page_num, page", MODEL_PAGES)


@query("l10_additions", f"""WITH {_NEW.replace(_RAW, f'{_RAW}, {_MODEL}, {_PAGES}', 1)}, one AS (SELECT * FROM new QUALIFY row_number() OVER (PARTITION BY doc_id, lower(text) ORDER BY ord) = 1),
ok AS (SELECT * FROM one o WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.doc_id = o.doc_id AND lower(trim(m.text)) = lower(o.text)) AND NOT (entity_type IN ('LOCATION', 'ADDRESS') AND ({' OR '.join(f"ends_with(lower(text), {literal(w)}) OR starts_with(lower(text), {literal(w)})" for w in C.STREET_WORDS)}) AND NOT regexp_matches(text, '\\d')))
SELECT o.doc_id, page_num, entity_type, text, CAST(strpos(page, text) - 1 AS INTEGER) AS "start", 0.3::DOUBLE AS score, 'LLM' AS source FROM ok o JOIN pg USING (doc_id) WHERE contains(page, text) QUALIFY row_number() OVER (PARTITION BY o.doc_id, lower(text) ORDER BY page_num) = 1""")
def _(spark, sf_dir):
    pages = rows(spark, MODEL_PAGES, "doc_id long, page_num int, text string")
    return verify.additions(verify.new_entities(_raw(spark)), pages, _model_ents(spark)).select("doc_id", "page_num", "entity_type", "text", "start", "score", "source")


@query("j6_unknown_texts", f"WITH {_NEW.replace(_RAW, f'{_RAW}, {_MODEL}', 1)} SELECT doc_id, text FROM new n WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.doc_id = n.doc_id AND lower(trim(m.text)) = lower(n.text))")
def _(spark, sf_dir):
    key = F.lower(strip(F.col("text")))
    known = _model_ents(spark).select("doc_id", key.alias("key"))
    return verify.new_entities(_raw(spark)).withColumn("key", key).join(known, ["doc_id", "key"], "left_anti").select("doc_id", "text")


@query("j7_first_page", f"""WITH {CONV_SQL}, n AS (SELECT doc_id, split_part({strip_sql('any_value(text ORDER BY page_num DESC)')}, ' ', 1) AS needle FROM pages GROUP BY doc_id)
SELECT doc_id, needle, CAST(coalesce(min(page_num), 0) AS INTEGER) AS page_num FROM n JOIN pages USING (doc_id) WHERE contains(text, needle) GROUP BY doc_id, needle""")
def _(spark, sf_dir):
    p = conv(spark, sf_dir)
    n = p.groupBy("doc_id").agg(F.max_by("text", "page_num").alias("t")).select("doc_id", F.substring_index(strip(F.col("t")), " ", 1).alias("needle"))
    return p.join(n, "doc_id").filter(F.col("text").contains(F.col("needle"))).groupBy("doc_id", "needle").agg(F.min("page_num").alias("page_num"))


@query("w6_budget", f"""WITH {CONV_SQL}, b AS (SELECT *, coalesce(sum(length(text)) OVER (PARTITION BY doc_id ORDER BY page_num ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM pages)
SELECT doc_id, md5(string_agg('--- Page ' || (page_num + 1) || ' ---' || chr(10) || substr(text, 1, CAST(8000 - before AS BIGINT)), chr(10) || chr(10) ORDER BY page_num)) AS combined_md5 FROM b WHERE before < 8000 GROUP BY doc_id""")
def _(spark, sf_dir):
    return verify.combined_text(conv(spark, sf_dir)).select("doc_id", F.md5(F.encode("combined", "UTF-8")).alias("combined_md5"))


PLACES = (("John and John and John", "John", 20), ("John and John", "John", 4), ("aaaa", "aa", 2), ("abc", "x", 0), ("😀 é John", "John", 0), ("", "a", 0))


@query("w7_nearest", f"""WITH {values('p', 'text, needle, reported', PLACES)}, o AS (SELECT *, list_filter(range(0, length(text)), lambda k: substr(text, k + 1, length(needle)) = needle) AS places FROM p)
SELECT text, needle, reported, CAST(coalesce(list_sort(list_transform(places, lambda k: {{'d': abs(k - reported), 'k': k}}))[1].k, -1) AS INTEGER) AS idx FROM o""")
def _(spark, sf_dir):
    p = rows(spark, PLACES, "text string, needle string, reported int")
    return p.withColumn("idx", verify.nearest(F.col("text"), F.col("needle"), F.col("reported")).cast("int"))


# Layout: boxes from the words of conversations ---------------------------------------------------------------
_WORDS = f"""{CONV_SQL}, l AS (SELECT doc_id, page_num, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS l FROM pages),
words AS (SELECT doc_id, page_num, CAST(unnest(range(0, len(l))) AS INTEGER) AS index, unnest(l) AS text FROM l),
boxed AS (SELECT *, index // 40 AS block, index // 10 AS line, CASE WHEN index % 17 = 5 THEN -1 ELSE 90 END AS conf, (index % 10) * 50.0 AS x0, (index // 10) * 12.0 + (index % 3) AS y0,
(index % 10) * 50.0 + 45.0 AS x1, (index // 10) * 12.0 + (index % 3) + 10.0 AS y1 FROM words)"""


def _words(spark, sf_dir) -> DataFrame:

    w = tables.words(conv(spark, sf_dir))
    i = F.col("index")
    line = F.floor(i / 10)
    y = line * 12.0 + i % 3
    return w.withColumn("ord", i).withColumn("block", F.floor(i / 40)).withColumn("line", line).withColumn("conf", F.when(i % 17 == 5, -1).otherwise(90)).withColumn("x0", (i % 10) * 50.0).withColumn("y0", y).withColumn("x1", (i % 10) * 50.0 + 45.0).withColumn("y1", y + 10.0)


_READ = f"""{_WORDS}, lagged AS (SELECT *, lag(block) OVER w AS pb, lag(line) OVER w AS pl FROM boxed WHERE conf >= 0 WINDOW w AS (PARTITION BY doc_id, page_num ORDER BY index)),
sep AS (SELECT *, CASE WHEN pb IS NULL THEN '' WHEN pb <> block THEN chr(10) || chr(10) WHEN pl <> line THEN chr(10) ELSE ' ' END AS sep FROM lagged),
placed AS (SELECT *, sum(length(sep) + length(text)) OVER (PARTITION BY doc_id, page_num ORDER BY index) AS e FROM sep)"""


@query("w4_separators", f"WITH {_READ} SELECT doc_id, page_num, md5(string_agg(sep || text, '' ORDER BY index)) AS text_md5 FROM placed GROUP BY doc_id, page_num")
def _(spark, sf_dir):
    return layout.read_text(_words(spark, sf_dir)).select("doc_id", "page_num", F.md5(F.encode("text", "UTF-8")).alias("text_md5"))


@query("w3_offsets", f"WITH {_READ} SELECT doc_id, page_num, index, text, CAST(e - length(text) AS BIGINT) AS char_start, CAST(e AS BIGINT) AS char_end FROM placed")
def _(spark, sf_dir):
    x = layout.read_words(_words(spark, sf_dir))
    return x.select("doc_id", "page_num", F.col("ord").alias("index"), "text", F.col("char_start").cast("long").alias("char_start"), F.col("char_end").cast("long").alias("char_end"))


@query("s3_line_words", f"""WITH {_WORDS}, ln AS (SELECT doc_id, page_num, line, string_agg(text, ' ' ORDER BY index) AS text FROM boxed GROUP BY ALL),
b AS (SELECT *, coalesce(sum(length(text) + 1) OVER (PARTITION BY doc_id, page_num ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base, string_split(text, ' ') AS l FROM ln),
u AS (SELECT doc_id, page_num, line, base, length(text) AS n, unnest(l) AS word, generate_subscripts(l, 1) AS k FROM b), p AS (SELECT *, coalesce(sum(length(word) + 1) OVER (PARTITION BY doc_id, page_num, line ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS place FROM u)
SELECT doc_id, page_num, word AS text, CAST(base + place AS BIGINT) AS char_start, round(CAST(100.0 / n * place AS DOUBLE), 6) AS x0 FROM p WHERE word <> ''""")
def _(spark, sf_dir):
    w = _words(spark, sf_dir)
    lines = w.groupBy("doc_id", "page_num", F.col("line").alias("ord")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("index", "text"))), lambda x: x["text"]), " ").alias("text"))
    lines = lines.withColumn("x0", F.lit(0.0)).withColumn("x1", F.lit(100.0)).withColumn("y0", F.lit(0.0)).withColumn("y1", F.lit(10.0))
    return layout.line_words(lines).select("doc_id", "page_num", "text", F.col("char_start").cast("long").alias("char_start"), F.round("x0", 6).alias("x0"))


@query("s9_percent_boxes", f"WITH {_WORDS} SELECT doc_id, page_num, index, CAST(x0 / 600 * 100 AS DOUBLE) AS x_pct, CAST((x1 - x0) / 600 * 100 AS DOUBLE) AS w_pct FROM boxed")
def _(spark, sf_dir):
    w = _words(spark, sf_dir).withColumn("width", F.lit(600.0)).withColumn("height", F.lit(800.0))
    return layout.percent_boxes(w).select("doc_id", "page_num", "index", "x_pct", "w_pct")


# one entity over the words 8 to 21 of each page, and one over word 3
_RECTS = f"""{_READ}, ent AS (SELECT doc_id, page_num, 0 AS entity, min(e - length(text)) FILTER (index >= 8) AS s, max(e) FILTER (index <= 21) AS t FROM placed GROUP BY doc_id, page_num
UNION ALL SELECT doc_id, page_num, 1, min(e - length(text)) FILTER (index = 3), max(e) FILTER (index = 3) FROM placed GROUP BY doc_id, page_num),
covered AS (SELECT ent.entity, placed.* FROM ent JOIN placed USING (doc_id, page_num) WHERE e - length(text) < t AND e > s)"""


def _boxes(spark, sf_dir):
    w = _words(spark, sf_dir)
    placed = layout.read_words(w).withColumnRenamed("ord", "index")
    boxes = placed.join(w.select("doc_id", "page_num", "index", "x0", "y0", "x1", "y1", "line"), ["doc_id", "page_num", "index"])
    g = placed.groupBy("doc_id", "page_num")
    a = g.agg(F.min(F.when(F.col("index") >= 8, F.col("char_start"))).alias("start"), F.max(F.when(F.col("index") <= 21, F.col("char_end"))).alias("end")).withColumn("entity", F.lit(0))
    b = g.agg(F.min(F.when(F.col("index") == 3, F.col("char_start"))).alias("start"), F.max(F.when(F.col("index") == 3, F.col("char_end"))).alias("end")).withColumn("entity", F.lit(1))
    return a.unionByName(b), boxes


@query("j2_interval", f"WITH {_RECTS} SELECT doc_id, page_num, entity, index FROM covered")
def _(spark, sf_dir):
    e, boxes = _boxes(spark, sf_dir)
    return layout.covered_boxes(e, boxes).select("doc_id", "page_num", "entity", "index")


# y0 of a line's words differs by less than half a height, of neighbouring lines by more: lines are y0 // 12
_LINE_RECTS = f"{_RECTS}, rects AS (SELECT doc_id, page_num, entity, CAST(min(x0) AS DOUBLE) AS x0, CAST(min(y0) AS DOUBLE) AS y0, CAST(max(x1) AS DOUBLE) AS x1, CAST(max(y1) AS DOUBLE) AS y1 FROM covered GROUP BY doc_id, page_num, entity, line)"


@query("w5_line_rects", f"WITH {_LINE_RECTS} SELECT * FROM rects")
def _(spark, sf_dir):
    return layout.entity_rects(*_boxes(spark, sf_dir)).select("doc_id", "page_num", "entity", "x0", "y0", "x1", "y1")


@query("j3_point_in_rect", f"""WITH {_LINE_RECTS} SELECT b.doc_id, b.page_num, b.index, min(entity) AS entity, min(entity) = 0 AS redacted FROM boxed b JOIN rects r ON b.doc_id = r.doc_id AND b.page_num = r.page_num
AND (b.x0 + b.x1) / 2 BETWEEN r.x0 AND r.x1 AND (b.y0 + b.y1) / 2 BETWEEN r.y0 AND r.y1 GROUP BY ALL""".replace("GROUP BY ALL", "GROUP BY b.doc_id, b.page_num, b.index"))
def _(spark, sf_dir):
    e, boxes = _boxes(spark, sf_dir)
    approved = e.select("doc_id", "entity", (F.col("entity") == 0).alias("approved")).distinct()
    w = _words(spark, sf_dir).select("doc_id", "page_num", "index", "x0", "y0", "x1", "y1")
    return layout.words_of_entities(w, layout.entity_rects(e, boxes), approved)


@query("a16_rect_union", f"WITH {_WORDS} SELECT doc_id, page_num, CAST(line AS BIGINT) AS line, CAST(min(x0) AS DOUBLE) AS x0, CAST(min(y0) AS DOUBLE) AS y0, CAST(max(x1) AS DOUBLE) AS x1, CAST(max(y1) AS DOUBLE) AS y1 FROM boxed GROUP BY doc_id, page_num, line")
def _(spark, sf_dir):
    return _words(spark, sf_dir).groupBy("doc_id", "page_num", "line").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))


@query("u4_types", f"WITH {ENTS_SQL} SELECT DISTINCT entity_type FROM ents")
def _(spark, sf_dir):
    return ents(spark, sf_dir).select("entity_type").distinct()


@query("f9_approved", f"WITH {ENTS_SQL} SELECT doc_id, count(*) AS n FROM ents WHERE entity_type <> 'EMAIL' AND page_num = 0 GROUP BY doc_id")
def _(spark, sf_dir):
    e = ents(spark, sf_dir).withColumn("approved", F.col("entity_type") != "EMAIL")
    return e.filter("approved AND page_num = 0").groupBy("doc_id").agg(F.count("*").alias("n"))


@query("f13_present", f"WITH {_NEW.replace(_RAW, f'{_RAW}, {_PAGES}', 1)} SELECT DISTINCT n.doc_id, n.text FROM new n JOIN pg USING (doc_id) WHERE contains(page, text)")
def _(spark, sf_dir):
    pages = rows(spark, MODEL_PAGES, "doc_id long, page_num int, page string")
    return verify.new_entities(_raw(spark)).join(pages, "doc_id").filter(F.col("page").contains(F.col("text"))).select("doc_id", "text").distinct()


@query("f15_disputed", f"WITH {_MODEL} SELECT doc_id, text, contains(CASE WHEN entity_type = 'PERSON' THEN 'Review: ' || text WHEN score > 0.5 THEN 'LLM verified' ELSE 'ner | x' END, 'Review') AS disputed, source = 'LLM' AS only_model FROM m")
def _(spark, sf_dir):
    e = _model_ents(spark)
    return e.select("doc_id", "text", (filters.badge(F.when(F.col("entity_type") == "PERSON", F.concat(F.lit("Review: "), F.col("text"))).when(F.col("score") > 0.5, "LLM verified").otherwise("ner | x")) == "review").alias("disputed"), (F.col("source") == "LLM").alias("only_model"))


# Steps with a provider, on crafted rows; their SQL states the expected rows ----------------------------------
@query("m8_page_additions", "SELECT 1::BIGINT AS doc_id, 0 AS page_num, 'PERSON' AS entity_type, 'Bob' AS text, 17 AS start")
def _(spark, sf_dir):
    pages = rows(spark, [(1, 0, "Anna met Bob and Bob at Bahnhofstrasse near info@x.org")], "doc_id long, page_num int, text string")
    known = rows(spark, [(1, 0, "EMAIL", "info@x.org", 44, 54, 1.0, "regex"), (1, 0, "PERSON", "Anna", 0, 4, 0.8, "ner")], "doc_id long, page_num int, entity_type string, text string, start int, end int, score double, source string")
    raw = '{"additional": [{"text": "Bob", "type": "PERSON", "start": 16}, {"text": "x.org", "type": "ORG", "start": 0}, {"text": "Anna", "type": "PERSON"}, {"text": "Bahnhofstrasse", "type": "ADDRESS"}]}'
    answers = rows(spark, [(1, 0, raw)], "doc_id long, page_num int, raw string")
    return verify.page_additions(answers, pages, known).select("doc_id", "page_num", "entity_type", "text", "start")


@query("s2_recognition", "SELECT * FROM (VALUES (1::BIGINT, 0, 'has text', false, NULL), (1, 1, 'seen', true, NULL), (1, 2, '', true, NULL), (1, 3, '', true, 'an image was not read: UnicodeDecodeError')) AS v(doc_id, page_num, text, is_ocr, warning)")
def _(spark, sf_dir):
    images = rows(spark, [(1, 0, "has text", bytearray(b"")), (1, 1, " ", bytearray(b"seen")), (1, 2, None, bytearray(b"")), (1, 3, None, bytearray(b"\xff"))], "doc_id long, page_num int, text string, content binary")
    return providers.read_pages(images, [lambda: lambda c: bytes(c).decode()])


@query("n6_language", "SELECT doc_id, CASE WHEN length(trim(coalesce(text, ''))) < 20 THEN 'en' WHEN contains(substr(text, 1, 2000), 'ß') THEN 'de' ELSE 'xx' END AS lang FROM documents")
def _(spark, sf_dir):
    pages = tables.document_pages(tables.read(spark, sf_dir, "documents"))
    return providers.language(pages, lambda: lambda t: "de" if "ß" in t else "xx").select("doc_id", "lang")


@query("l1_batch_verify", "SELECT * FROM (VALUES (1::BIGINT, 'ACME', 'review: a company'), (1, 'Jean', 'LLM verified'), (1, 'Bob Ray', 'Found by LLM only'), (2, 'x', 'c')) AS v(doc_id, text, analysis)")
def _(spark, sf_dir):
    pages = rows(spark, [(1, 0, "Jean met ACME. Bob Ray too."), (2, 0, "x")], "doc_id long, page_num int, text string")
    known = rows(spark, [(1, 0, "ORGANIZATION", "ACME", 9, 13, 0.6, "ner", "a"), (1, 0, "PERSON", "Jean", 0, 4, 0.8, "ner", "b"), (2, 0, "EMAIL", "x", 0, 1, 1.0, "regex", "c")], "doc_id long, page_num int, entity_type string, text string, start int, end int, score double, source string, analysis string")
    answer = lambda: lambda p: "FALSE_POSITIVE - ACME - a company\nFALSE_POSITIVE - Jean - x\nNEW - PERSON - Bob Ray"
    return providers.verified_documents(known, pages, answer).select("doc_id", "text", "analysis")


@query("n10_reworded", "SELECT * FROM (VALUES (1::BIGINT, 'A better sentence.'), (2, 'This document contains 1 name.')) AS v(doc_id, sentence)")
def _(spark, sf_dir):
    risks = rows(spark, [(1, "This document contains 2 names."), (2, "This document contains 1 name.")], "doc_id long, sentence string")
    return providers.reworded(risks, lambda: lambda p: "A better sentence." if "2" in p else "Sorry, I cannot.")


@query("x13_flattened", "SELECT conv_id AS doc_id, CAST(turn AS INTEGER) AS page_num, turn % 2 = 0 AS hidden FROM conversations")
def _(spark, sf_dir):
    pages = conv(spark, sf_dir).withColumn("is_ocr", F.col("page_num") % 4 != 3).withColumn("content", F.encode("text", "UTF-8"))
    flat = deid.flattened(pages, pages.filter("page_num % 2 = 0").select("doc_id", "page_num"))
    return flat.select("doc_id", "page_num", F.col("content").isNull().alias("hidden"))
