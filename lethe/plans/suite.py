"""The registered queries: one for each operator, with the same computation as SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lethe.functions import catalog as C
from lethe.functions.text import occurrences, strip
from lethe.operators import deid, filters, layout, report, resolve, score, spans, verify
from lethe.operators import detect as detection
from lethe.plans import fixtures
from lethe.plans.fixtures import SRC_SQL, literal, values
from lethe.plans.hits_sql import BASE_SQL, ENTS_SQL, HITS_SQL, PLAUSIBLE_SQL, any_of, around, case_map, in_list, merged_sql, pattern_sql
from lethe.plans.hits_sql import strip as strip_sql
from lethe.sources import tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def ents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detection.entities(fixtures.pages(spark, sf_dir))


def rows(spark: SparkSession, data, schema: str) -> DataFrame:
    return spark.createDataFrame(list(data), schema)


# Sources ---------------------------------------------------------------------------------------------------
CONV_SQL = "pages AS (SELECT conv_id AS doc_id, CAST(turn AS INTEGER) AS page_num, coalesce(text, '') AS text FROM conversations)"


def conv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.conversation_pages(tables.read(spark, sf_dir, "conversations"))


@query("s1_pages", f"WITH {CONV_SQL} SELECT doc_id, page_num, text FROM pages")
def _(spark, sf_dir):
    return conv(spark, sf_dir)


@query("s7_size_gate", """WITH f AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'x.pdf' WHEN 1 THEN 'x.PDF' ELSE 'x.docx' END AS path, octet_length(encode(coalesce(text, ''))) * 20000 AS n FROM documents)
SELECT doc_id, path LIKE '%.pdf' OR path LIKE '%.PDF' AS kind, CASE WHEN n > 50 * 1024 * 1024 THEN 'too large' WHEN path LIKE '%.docx' THEN 'not a PDF' END AS reason FROM f""")
def _(spark, sf_dir):
    path = F.when(F.col("doc_id") % 3 == 0, "x.pdf").when(F.col("doc_id") % 3 == 1, "x.PDF").otherwise("x.docx")
    found = tables.read(spark, sf_dir, "documents").select("doc_id", path.alias("path"), (F.octet_length(F.coalesce("text", F.lit(""))).cast("long") * 20000).alias("length"))
    taken, refused = tables.uploads(found)
    both = taken.withColumn("reason", F.lit(None).cast("string")).union(refused)
    return both.select("doc_id", (F.lower("path").endswith(".pdf")).alias("kind"), "reason")


@query("s8_page_count", f"WITH {CONV_SQL} SELECT doc_id, count(*) AS pages, count(*) > 500 AS over_cap FROM pages GROUP BY doc_id")
def _(spark, sf_dir):
    return tables.page_counts(conv(spark, sf_dir))


@query("s9_words", f"""WITH {CONV_SQL}, w AS (SELECT doc_id, page_num, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS l FROM pages)
SELECT doc_id, page_num, CAST(unnest(range(0, len(l))) AS INTEGER) AS index, unnest(l) AS text FROM w""")
def _(spark, sf_dir):
    return tables.words(conv(spark, sf_dir))


@query("s10_html_pages", r"""SELECT page_id AS doc_id, 0 AS page_num, trim(regexp_replace(replace(replace(replace(replace(replace(replace(
regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '(?is)<script\b.*?</script\s*>', ' ', 'g'), '(?is)<style\b.*?</style\s*>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'),
'&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '[ \t\r\n]+', ' ', 'g')) AS text FROM pages""")
def _(spark, sf_dir):
    return tables.html_pages(tables.read(spark, sf_dir, "pages"))


@query("o7_first_files", "SELECT doc_id, url FROM (SELECT page_id AS doc_id, url FROM pages) ORDER BY url, doc_id LIMIT 30")
def _(spark, sf_dir):
    return tables.first_files(tables.read(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), "url", F.struct("url", "page_id").alias("path")), 30).drop("path")


# Patterns --------------------------------------------------------------------------------------------------
def _pattern_query(seq: int, p: C.Pattern) -> None:
    @query(p.id, f'WITH {SRC_SQL} SELECT doc_id, "start", "end", text FROM ({pattern_sql(p, seq)})')
    def _(spark, sf_dir):
        pages = fixtures.pages(spark, sf_dir).withColumn("scan", spans.scannable(F.col("text")))
        return pages.select("doc_id", F.explode(spans.hits_of(F.col("text"), F.col("scan"), p, seq)).alias("h")).select("doc_id", F.col("h.start").cast("long").alias("start"), F.col("h.end").cast("long").alias("end"), "h.text")


for _seq, _p in enumerate(C.PATTERNS):
    _pattern_query(_seq, _p)


@query("r00_counts", f"WITH {SRC_SQL}, {HITS_SQL} SELECT type, count(*) AS n, count(DISTINCT doc_id) AS docs FROM hits GROUP BY type")
def _(spark, sf_dir):
    hits = detection.with_hits(fixtures.pages(spark, sf_dir)).select("doc_id", F.explode_outer("hits").alias("h"))
    return hits.filter("h.type IS NOT NULL").groupBy(F.col("h.type").alias("type")).agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("docs"))


# Detection -------------------------------------------------------------------------------------------------
@query("m10_detect", f'WITH {ENTS_SQL} SELECT doc_id, page_num, entity_type, text, CAST("start" AS INTEGER) AS "start", CAST("end" AS INTEGER) AS "end", score, source, analysis FROM ents')
def _(spark, sf_dir):
    return ents(spark, sf_dir)


_HTML_SRC = SRC_SQL[: SRC_SQL.index("(SELECT doc_id, 0 AS page_num")] + "(" + ORACLES["s10_html_pages"] + "))"


@query("m11_detect_web_pages", f"""WITH {ENTS_SQL.replace(SRC_SQL, _HTML_SRC)} SELECT doc_id, entity_type, text, CAST("start" AS INTEGER) AS "start" FROM ents""")
def _(spark, sf_dir):
    return detection.entities(tables.html_pages(tables.read(spark, sf_dir, "pages"))).select("doc_id", "entity_type", "text", "start")


@query("m10_replace_counts", f"WITH {ENTS_SQL} SELECT entity_type, '<' || entity_type || '>' AS overlay, count(*) AS n FROM ents GROUP BY ALL")
def flagship(spark, sf_dir):
    e = ents(spark, sf_dir).withColumn("overlay", deid.replacement("replace", F.col("entity_type"), F.col("text"), F.lit("")))
    return e.groupBy("entity_type", "overlay").agg(F.count("*").alias("n"))


# Resolution on crafted hits: page, text, start, end, type, priority, source, score
HITS = (
    (1, "Anna Muster", 0, 11, "PERSON", 7, "regex", None), (1, "Anna Muster", 0, 11, "PERSON", 6, "ner", 0.9), (1, "anna muster", 0, 11, "PERSON", 6, "llm", 0.3),
    (2, "abc", 0, 10, "ORGANIZATION", 4, "ner", 0.5), (2, "abcd", 3, 8, "PERSON", 6, "ner", 0.9), (2, "x", 8, 12, "LOCATION", 5, "ner", 0.7),
    (3, "a", 0, 5, "PERSON", 6, "ner", 0.5), (3, "b", 5, 10, "PERSON", 6, "ner", 0.5), (3, " B ", 12, 15, "PERSON", 6, "llm", 0.4), (3, "zürich", 20, 26, "LOCATION", 5, "ner", 0.8),
    (4, "Zürich", 0, 6, "LOCATION", 5, "ner", 0.4), (4, "ZÜRICH", 30, 36, "ADDRESS", 5, "llm", 0.3), (4, "12345678901", 10, 21, "CH_REFERENCE_ID", 9, "regex", None), (4, "12345678901", 10, 21, "DE_STEUER_ID", 9, "regex", None),
    (5, "GI", 0, 2, "ORGANIZATION", 4, "ner", 0.9), (5, "---", 3, 6, "LOCATION", 5, "ner", 0.6), (5, "Bob", 8, 11, "PERSON", 6, "ner", 0.6), (5, "  ", 12, 14, "PERSON", 6, "ner", 0.6),
)
_HIT_COLUMNS = 'seq, doc_id, text, "start", "end", type, priority, source, score'
HITS_VALUES = values("h", _HIT_COLUMNS, [(i, *r) for i, r in enumerate(HITS)]) + ", hr AS (SELECT *, CASE source WHEN 'regex' THEN 0 WHEN 'ner' THEN 1 ELSE 2 END AS rank FROM h)"


def crafted(spark: SparkSession) -> DataFrame:
    h = rows(spark, [(i, *r) for i, r in enumerate(HITS)], "seq int, doc_id long, text string, start int, end int, type string, priority int, source string, score double")
    return h.withColumn("rank", F.when(F.col("source") == "regex", 0).when(F.col("source") == "ner", 1).otherwise(2)).withColumn("neg", -F.col("priority"))


def crafted_lists(spark: SparkSession) -> DataFrame:
    s = F.struct("neg", "rank", "start", "seq", "end", "text", "type", "priority", "source", "score")
    return crafted(spark).groupBy("doc_id").agg(F.collect_list(s).cast(f"array<{spans.HIT}>").alias("hits"))


def _flat(df: DataFrame) -> DataFrame:
    return df.select("doc_id", F.explode_outer("hits").alias("h")).filter("h.type IS NOT NULL").select("doc_id", "h.text", "h.start", "h.end", "h.type", "h.source")


_FLAT = 'doc_id, text, "start", "end", type, source'


@query("m1_span_merge", f"WITH {HITS_VALUES}, {merged_sql('hr', 'doc_id')} SELECT {_FLAT} FROM kept")
def _(spark, sf_dir):
    return _flat(crafted_lists(spark).withColumn("hits", resolve.spans_merged(F.col("hits"))))


@query("m2_text_dedup", f"WITH {HITS_VALUES}, {merged_sql('hr', 'doc_id')} SELECT {_FLAT} FROM merged")
def _(spark, sf_dir):
    return _flat(crafted_lists(spark).withColumn("hits", resolve.merged(F.col("hits"))))


@query("m1_merge_documents", f'WITH {BASE_SQL} SELECT doc_id, text, CAST("start" AS INTEGER) AS "start", CAST("end" AS INTEGER) AS "end", type, source FROM merged')
def _(spark, sf_dir):
    return _flat(detection.with_hits(fixtures.pages(spark, sf_dir)).withColumn("hits", resolve.merged(F.col("hits"))))


@query("m4_ner_priority", f"WITH {HITS_VALUES} SELECT type, CAST({case_map('type', C.NER_PRIORITIES, C.NER_PRIORITY)} AS INTEGER) AS priority, count(*) AS n FROM h GROUP BY ALL")
def _(spark, sf_dir):
    return crafted(spark).groupBy("type", resolve.ner_priority(F.col("type")).alias("priority")).agg(F.count("*").alias("n")).select("type", F.col("priority").cast("int").alias("priority"), "n")


SCORED = ((1, 0, 10, 0.5), (1, 3, 8, 0.9), (2, 0, 5, 0.5), (2, 5, 10, 0.5), (3, 0, 9, 0.5), (3, 2, 4, 0.5), (3, 3, 20, 0.6), (3, 15, 30, 0.6), (3, 19, 25, 0.7))
_SCORED = values("e", 'doc_id, "start", "end", score', SCORED)


def _scored_lists(spark: SparkSession) -> DataFrame:
    e = rows(spark, [(*r, i) for i, r in enumerate(SCORED)], "doc_id long, start int, end int, score double, i int")
    s = F.struct("start", (-F.col("score")).alias("neg_score"), "i", "end", F.lit("PERSON").alias("entity_type"), F.lit("x").alias("text"), "score", F.lit("NER").alias("source"))
    return e.groupBy("doc_id").agg(F.collect_list(s).cast(f"array<{resolve.SCORED}>").alias("l"))


_M5_SQL = f"""WITH {_SCORED}, l AS (SELECT doc_id, list({{'s': "start", 'e': "end", 'p': score}} ORDER BY "start", -score) AS l FROM e GROUP BY doc_id),
r AS (SELECT doc_id, unnest(list_reduce(list_transform(l, lambda x: [x]), lambda a, x: CASE WHEN x[1].s >= a[-1].e THEN list_concat(a, x) WHEN x[1].p > a[-1].p THEN list_concat(a[:-2], x) ELSE a END)) AS k FROM l)
SELECT doc_id, k.s AS "start", k.e AS "end", k.p AS score FROM r"""


@query("m5_score_dedup", _M5_SQL)
def _(spark, sf_dir):
    x = _scored_lists(spark).select("doc_id", F.explode(resolve.score_merged(F.col("l"))).alias("k"))
    return x.select("doc_id", F.col("k.start").alias("start"), F.col("k.end").alias("end"), F.col("k.score").alias("score"))


@query("n3_chunk_dedup", f"""WITH {HITS_VALUES}, l AS (SELECT doc_id, list({{'s': "start", 'e': "end", 't': text, 'p': score}} ORDER BY -score, seq) AS l FROM h WHERE score IS NOT NULL GROUP BY doc_id),
r AS (SELECT doc_id, unnest(list_reduce(list_transform(l, lambda x: [x]), lambda a, x: CASE WHEN len(list_filter(a, lambda y: (y.s < x[1].e AND x[1].s < y.e) OR lower(trim(y.t)) = lower(trim(x[1].t)))) > 0 THEN a ELSE list_concat(a, x) END)) AS k FROM l)
SELECT doc_id, k.s AS "start", k.e AS "end", k.t AS text, k.p AS score FROM r""")
def _(spark, sf_dir):
    h = crafted(spark).filter("score IS NOT NULL")
    s = F.struct((-F.col("score")).alias("neg_score"), F.col("seq").alias("i"), "start", "end", "text", "type", "score")
    x = h.groupBy("doc_id").agg(F.collect_list(s).cast(f"array<{resolve.CHUNKED}>").alias("l")).select("doc_id", F.explode(resolve.chunks_merged(F.col("l"))).alias("k"))
    return x.select("doc_id", F.col("k.start").alias("start"), F.col("k.end").alias("end"), "k.text", "k.score")


# Filters ---------------------------------------------------------------------------------------------------
@query("f1_luhn", f"""WITH {SRC_SQL}, hits AS ({pattern_sql(C.PATTERNS[20], 20)}) SELECT doc_id, text, length(regexp_replace(text, '[^0-9]', '', 'g')) AS digits FROM hits""")
def _(spark, sf_dir):
    pages = fixtures.pages(spark, sf_dir).withColumn("scan", spans.scannable(F.col("text")))
    found = pages.select("doc_id", "text", F.explode(spans.find(F.col("scan"), C.PATTERNS[20])).alias("s")).select("doc_id", F.expr("substring(text, s.start + 1, s.end - s.start)").alias("text"))
    return found.filter(spans.luhn_ok(F.col("text"))).select("doc_id", "text", F.length(F.regexp_replace("text", "[^0-9]", "")).cast("long").alias("digits"))


@query("f2_plausible", f"WITH {HITS_VALUES} SELECT seq, doc_id, text FROM h WHERE {PLAUSIBLE_SQL}")
def _(spark, sf_dir):
    return crafted(spark).filter(filters.plausible(F.col("text"))).select("seq", "doc_id", "text")


CONTEXT = (
    ("Switzerland", "LOCATION", 30, 41, "Our plan offers protection in Switzerland and more."), ("Switzerland", "PERSON", 30, 41, "Our plan offers protection in Switzerland and more."),
    ("France", "LOCATION", 0, 6, "France has protection"), ("AB", "ORGANIZATION", 18, 20, "abbreviation list AB means A. Brown"), ("VVG", "ORGANIZATION", 0, 3, "VVG is the Federal Law on contracts"),
    ("ABCDE", "ORGANIZATION", 18, 23, "abbreviation list ABCDE"), ("BE 3", "LOCATION", 15, 19, "Premium region BE 3 applies"), ("BE3", "ICD_CODE", 8, 11, "Regions BE3"), ("BE 3", "LOCATION", 0, 4, "BE 3 " + "x" * 60 + " region"),
)
_CTX = values("c", 'text, type, "start", "end", page', CONTEXT)


def context(spark: SparkSession) -> DataFrame:
    return rows(spark, CONTEXT, "text string, type string, start int, end int, page string")


@query("f3_country", f"WITH {_CTX} SELECT text, type, page FROM c WHERE type = 'LOCATION' AND {in_list('lower(text)', C.COUNTRIES)} AND {any_of(around('"start"', '"start"', 60, 0), C.SCOPE_WORDS)}")
def _(spark, sf_dir):
    return context(spark).filter(filters.out_of_scope_country(F.col("text"), F.col("type"), F.col("start"), F.col("page"))).select("text", "type", "page")


@query("f4_abbreviation", f"WITH {_CTX} SELECT text, type, page FROM c WHERE regexp_matches(text, '^[A-Z]{{2,4}}$') AND {any_of(around('"start"', '"end"', 60, 60), C.LEGEND_WORDS)}")
def _(spark, sf_dir):
    return context(spark).filter(filters.legend_entry(F.col("text"), F.col("start"), F.col("end"), F.col("page"))).select("text", "type", "page")


@query("f5_region", f"WITH {_CTX} SELECT text, type, page FROM c WHERE regexp_matches(text, '^[A-Z]{{1,2}}\\s?\\d{{1,2}}$') AND {any_of(around('"start"', '"end"', 40, 40), C.REGION_WORDS)}")
def _(spark, sf_dir):
    return context(spark).filter(filters.region_code(F.col("text"), F.col("start"), F.col("end"), F.col("page"))).select("text", "type", "page")


STREETS = ("Bahnhofstrasse", "Bahnhofstrasse 14", "Rue de Lausanne", "Main Street", "Weggasse 3", "Viale", "Zurich", " Hauptweg ", "")
_STREETS_SQL = " OR ".join(f"ends_with(lower(trim(text)), {literal(w)}) OR starts_with(lower(trim(text)), {literal(w)})" for w in C.STREET_WORDS)


@query("f6_street", f"WITH {values('s', 'text', [(t,) for t in STREETS])} SELECT text, ({_STREETS_SQL}) AND NOT regexp_matches(text, '\\d') AS generic FROM s")
def _(spark, sf_dir):
    return rows(spark, [(t,) for t in STREETS], "text string").select("text", filters.generic_street(F.col("text")).alias("generic"))


@query("f7_threshold", f"WITH {HITS_VALUES} SELECT seq, score FROM h WHERE score >= 0.35")
def _(spark, sf_dir):
    return crafted(spark).filter(F.col("score") >= C.NER_THRESHOLD).select("seq", "score")


@query("f8_protected", f"WITH {HITS_VALUES} SELECT seq, source = 'regex' OR {in_list('type', C.ALWAYS_PROTECTED)} OR (type = 'PERSON' AND coalesce(score, 0) >= 0.85) AS protected FROM h")
def _(spark, sf_dir):
    return crafted(spark).select("seq", filters.protected(F.col("source"), F.col("type"), F.coalesce("score", F.lit(0.0))).alias("protected"))


NOTES = ("see <document_content> now </document_content> end", "none", "FileNotFoundError: /home/a/b/c.txt is gone", "x: C:\\temp\\d\\e.txt", "plain", "")


@query("f11_tags", f"WITH {values('n', 'raw', [(t,) for t in NOTES])} SELECT raw, replace(replace(raw, '<document_content>', ''), '</document_content>', '') AS text FROM n")
def _(spark, sf_dir):
    return rows(spark, [(t,) for t in NOTES], "raw string").select("raw", filters.without_tags(F.col("raw")).alias("text"))


@query("f12_truncation", "SELECT doc_id, length(substr(coalesce(text, ''), 1, 5000)) AS page_chars, md5(substr(coalesce(text, ''), 1, 2000)) AS head FROM documents")
def _(spark, sf_dir):
    d = tables.document_pages(tables.read(spark, sf_dir, "documents"))
    return d.select("doc_id", F.length(F.substring("text", 1, C.PAGE_CHARS)).cast("long").alias("page_chars"), F.md5(F.encode(F.substring("text", 1, C.CLASSIFY_CHARS), "UTF-8")).alias("head"))


@query("f17_paths", f"WITH {values('n', 'raw', [(t,) for t in NOTES])} SELECT raw, regexp_replace(raw, '(/[^\\s:]+/|[A-Z]:\\\\[^\\s:]+\\\\)', '<path>/', 'g') AS text FROM n")
def _(spark, sf_dir):
    return rows(spark, [(t,) for t in NOTES], "raw string").select("raw", filters.without_paths(F.col("raw")).alias("text"))


@query("f18_bands", f"WITH {HITS_VALUES} SELECT seq, CASE WHEN coalesce(score, 1) >= 0.9 THEN 'High' WHEN coalesce(score, 1) >= 0.7 THEN 'Medium' ELSE 'Low' END AS band FROM h")
def _(spark, sf_dir):
    return crafted(spark).select("seq", filters.band(F.coalesce("score", F.lit(1.0))).alias("band"))


PASSPHRASES = ("", "short", "   seven7  ", "long enough", " long enough ", "12345678")


@query("f19_passphrase", f"WITH {values('p', 'p', [(t,) for t in PASSPHRASES])} SELECT p, CASE WHEN p = '' THEN 'empty' WHEN length(trim(p)) < 8 THEN 'too short' WHEN trim(p) <> p THEN 'edge spaces' ELSE 'ok' END AS state FROM p")
def _(spark, sf_dir):
    return rows(spark, [(t,) for t in PASSPHRASES], "p string").select("p", filters.passphrase_state(F.col("p")).alias("state"))


@query("f20_badge", f"WITH {values('a', 'analysis', [('review: x',), ('LLM verified',), ('regex | EMAIL',), ('',)])} SELECT analysis, CASE WHEN contains(lower(analysis), 'review') THEN 'review' WHEN contains(lower(analysis), 'verified') THEN 'verified' ELSE 'raw' END AS badge FROM a")
def _(spark, sf_dir):
    return rows(spark, [("review: x",), ("LLM verified",), ("regex | EMAIL",), ("",)], "analysis string").select("analysis", filters.badge(F.col("analysis")).alias("badge"))


# Windows of tokens, labels, document types, confidence -----------------------------------------------------
@query("n1_windows", """WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '\\s+'), lambda x: x <> '') AS w FROM documents), n AS (SELECT doc_id, len(w) AS n FROM t WHERE len(w) > 0)
SELECT doc_id, CAST(i * 410 AS INTEGER) AS token_start, CAST(least(i * 410 + 460, n) - i * 410 AS BIGINT) AS tokens FROM (SELECT doc_id, n, unnest(range(0, CASE WHEN n <= 460 THEN 1 ELSE CAST(ceil((n - 460) / 410.0) AS BIGINT) + 1 END)) AS i FROM n)""")
def _(spark, sf_dir):
    d = tables.document_pages(tables.read(spark, sf_dir, "documents"))
    w = d.select("doc_id", F.explode(detection.token_windows(F.col("text"))).alias("w"))
    return w.select("doc_id", "w.token_start", F.size(F.split("w.text", r"(?U)\s+")).cast("long").alias("tokens"))


LABELS = ("B-PER", "I-LOC", "ORG", "DATE", "MISC", "B-MISC")


@query("n2_labels", f"WITH {values('l', 'label', [(t,) for t in LABELS])} SELECT label, CASE regexp_replace(label, '^[BI]-', '') WHEN 'PER' THEN 'PERSON' WHEN 'LOC' THEN 'LOCATION' WHEN 'ORG' THEN 'ORGANIZATION' WHEN 'DATE' THEN 'DATE_TIME' ELSE regexp_replace(label, '^[BI]-', '') END AS type FROM l")
def _(spark, sf_dir):
    return rows(spark, [(t,) for t in LABELS], "label string").select("label", detection.model_label(F.col("label")).alias("type"))


@query("n7_classify_text", f"""WITH {CONV_SQL}, p AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page_num) AS k FROM pages),
x AS (SELECT doc_id, max(CASE WHEN k = 1 THEN text END) AS a, max(CASE WHEN k = 2 THEN text END) AS b FROM p GROUP BY doc_id)
SELECT doc_id, CASE WHEN length({strip_sql('substr(a, 1, 2000)')}) < 100 AND b IS NOT NULL THEN substr(substr(a, 1, 2000) || chr(10) || b, 1, 2000) ELSE substr(a, 1, 2000) END AS text FROM x""")
def _(spark, sf_dir):
    return verify.classify_text(conv(spark, sf_dir))


ANSWERS = ("Insurance", "insurance and medical", "A MEDICAL document", "police report", "tax", "unknown", "general government")


@query("n8_doc_type", f"WITH {values('a', 'raw', [(t,) for t in ANSWERS])} SELECT raw, CASE " + " ".join(f"WHEN contains(lower(raw), '{t}') THEN '{t}'" for t in C.DOC_TYPES) + " ELSE 'general' END AS doc_type FROM a")
def _(spark, sf_dir):
    return rows(spark, [(t,) for t in ANSWERS], "raw string").select("raw", verify.doc_type(F.col("raw")).alias("doc_type"))


@query("a7_repetition", f"""WITH {ENTS_SQL} SELECT doc_id, e.text, CAST((length(lower(s.text)) - length(replace(lower(s.text), lower(e.text), ''))) / length(e.text) AS BIGINT) AS n FROM ents e JOIN src s USING (doc_id, page_num)""")
def _(spark, sf_dir):
    pages = fixtures.pages(spark, sf_dir).withColumnRenamed("text", "page")
    return ents(spark, sf_dir).join(pages, ["doc_id", "page_num"]).select("doc_id", "text", occurrences(F.lower("page"), F.lower("text")).cast("long").alias("n"))


NER = (
    ("Charles Muster", "PERSON", 0, 14, 0.5, "Charles Muster Charles Muster Charles Muster"), ("Zurich", "LOCATION", 3, 9, 0.4, "in Zurich"), ("Dr Anna B Muster", "PERSON", 8, 24, 0.7, "insured Dr Anna B Muster"),
    ("ACME", "ORGANIZATION", 0, 4, 0.9, "ACME"), ("x@y.zz", "EMAIL", 0, 6, 0.2, "x@y.zz client"), ("thing", "OTHER", 0, 5, 0.1, "thing"), ("Bob Ray", "OTHER", 0, 7, 0.95, "Bob Ray and mr Bob Ray, Bob Ray"),
)
_Q1 = f"greatest(score, {case_map('type', C.TYPE_FLOORS, C.TYPE_FLOOR)})"
_Q2 = f"CASE WHEN len(string_split(text, ' ')) >= 3 THEN least({_Q1} + 0.15, 1.0) WHEN len(string_split(text, ' ')) = 2 THEN least({_Q1} + 0.10, 1.0) ELSE {_Q1} END"


@query("q1_confidence", f"""WITH {values('n', 'text, type, "start", "end", score, page', NER)}, a AS (SELECT *, CAST({_Q2} AS DOUBLE) AS s FROM n),
b AS (SELECT *, CASE WHEN {any_of(around('"start"', '"end"', 80, 80), C.CONFIDENCE_WORDS)} THEN least(s + 0.10, 1.0) ELSE s END AS s2 FROM a)
SELECT text, type, round(CAST(CASE WHEN (length(page) - length(replace(lower(page), lower(text), ''))) / length(text) >= 3 THEN least(s2 + 0.10, 1.0) ELSE s2 END AS DOUBLE), 2) AS confidence FROM b""")
def _(spark, sf_dir):
    n = rows(spark, NER, "text string, type string, start int, end int, score double, page string")
    return n.select("text", "type", score.confidence(F.col("text"), F.col("type"), F.lit("ner"), F.col("score"), F.col("start"), F.col("end"), F.col("page")).alias("confidence"))


# De-identification -----------------------------------------------------------------------------------------
_OVERLAYS = {
    "redact": "''", "replace": "'<' || entity_type || '>'", "mask": "repeat('*', length(text))", "hash": "'[#' || substr(sha256(text), 1, 12) || ']'",
    "encrypt": "'[enc:' || substr('[' || entity_type || '_x]', 2, 8) || ']'", "highlight": "text", "synthesize": case_map("entity_type", C.SYNTHETIC, "<REDACTED>"), "unknown": "'<' || entity_type || '>'",
}


def _mode_query(i: int, mode: str) -> None:
    @query(f"x{i}_{mode}", f'WITH {ENTS_SQL} SELECT doc_id, CAST("start" AS INTEGER) AS "start", entity_type, {_OVERLAYS[mode]} AS overlay FROM ents')
    def _(spark, sf_dir):
        tag = F.concat(F.lit("["), F.col("entity_type"), F.lit("_x]"))
        return ents(spark, sf_dir).select("doc_id", "start", "entity_type", deid.replacement(mode, F.col("entity_type"), F.col("text"), tag).alias("overlay"))


for _i, _mode in enumerate((*C.APPROACHES, "unknown"), 1):
    _mode_query(_i, _mode)

HMAC_KEY = bytes(range(32))


@query("x4_keyed_hash", f"""WITH {ENTS_SQL}, k AS (SELECT '{''.join(f'{b ^ 0x36:02X}' for b in HMAC_KEY.ljust(64, b'\0'))}' AS i, '{''.join(f'{b ^ 0x5C:02X}' for b in HMAC_KEY.ljust(64, b'\0'))}' AS o)
SELECT doc_id, entity_type, '[#' || substr(sha256(unhex(o || sha256(unhex(i || hex(text))))), 1, 12) || ']' AS overlay FROM ents, k""")
def _(spark, sf_dir):
    e = ents(spark, sf_dir).withColumn("key", F.lit(bytearray(HMAC_KEY)))
    return e.select("doc_id", "entity_type", deid.replacement("hash", F.col("entity_type"), F.col("text"), F.lit(""), F.col("key")).alias("overlay"))


@query("x8_labels", f"""WITH {ENTS_SQL} SELECT doc_id, CAST("start" AS INTEGER) AS "start", '[' || entity_type || '_' || substr(sha256(concat_ws(chr(1), 'salt', doc_id, page_num, "start", entity_type)), 1, 12) || ']' AS label FROM ents""")
def _(spark, sf_dir):
    return ents(spark, sf_dir).select("doc_id", "start", deid.label(F.col("entity_type"), "salt", F.col("doc_id"), F.col("page_num"), F.col("start")).alias("label"))


@query("x11_permanent", f"""WITH {ENTS_SQL}, o AS (SELECT doc_id, page_num, list(text ORDER BY -length(text), text) AS l FROM ents GROUP BY doc_id, page_num)
SELECT s.doc_id, CASE WHEN l IS NULL THEN s.text ELSE list_reduce(list_concat([translate(s.text, chr(1)||chr(2), chr(3)||chr(3))], l), lambda a, t: replace(a, t, repeat('*', length(t)))) END AS text, coalesce(len(l), 0) AS labels FROM src s LEFT JOIN o USING (doc_id, page_num)""")
def _(spark, sf_dir):
    pages = fixtures.pages(spark, sf_dir)
    out = deid.deidentified_pages(pages, "mask", "salt")
    return out.select("doc_id", "text", F.size("mapping").cast("long").alias("labels"))


def _overlays(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deid.overlaid_pages(fixtures.pages(spark, sf_dir), "replace", "salt")


@query("x12_reversible", f"""WITH {ENTS_SQL} SELECT s.doc_id, md5(any_value(s.text)) AS text_md5, count(e.text) AS overlays FROM src s LEFT JOIN ents e USING (doc_id, page_num) GROUP BY s.doc_id""")
def _(spark, sf_dir):
    return _overlays(spark, sf_dir).select("doc_id", F.md5(F.encode("text", "UTF-8")).alias("text_md5"), F.size("overlays").cast("long").alias("overlays"))


@query("x14_mode", f"""WITH {ENTS_SQL} SELECT s.doc_id, CASE WHEN count(e.text) FILTER (e.entity_type <> 'EMAIL') > 0 AND s.doc_id % 2 = 0 THEN 'reversible' ELSE 'permanent' END AS mode FROM src s LEFT JOIN ents e USING (doc_id, page_num) GROUP BY s.doc_id""")
def _(spark, sf_dir):
    """The known labels come from a vault that holds every second document, and no e-mail addresses."""
    e = ents(spark, sf_dir).filter("entity_type <> 'EMAIL' AND doc_id % 2 = 0")
    tag = deid.label(F.col("entity_type"), "salt", F.col("doc_id"), F.col("page_num"), F.col("start"))
    held = e.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct(tag, F.col("text")))).alias("mapping"))
    x = _overlays(spark, sf_dir).join(held, "doc_id", "left").withColumn("mapping", F.coalesce("mapping", F.create_map().cast("map<string,string>")))
    return x.select("doc_id", deid.redaction_mode(F.col("overlays"), F.col("mapping")).alias("mode"))


@query("x15_unredact", f"""WITH {ENTS_SQL} SELECT s.doc_id, count(e.text) AS removed, 1::BIGINT AS foreign_left FROM src s LEFT JOIN ents e USING (doc_id, page_num) GROUP BY s.doc_id""")
def _(spark, sf_dir):
    o = _overlays(spark, sf_dir)
    known = F.map_from_entries(F.transform("overlays", lambda x: F.struct(x["label"], F.lit("?"))))
    foreign = F.array(F.struct(F.lit("a note").alias("label"), F.lit(0).alias("start"), F.lit(1).alias("end"), F.lit("note").alias("overlay")))
    o = o.withColumn("all", F.concat("overlays", foreign)).withColumn("left", deid.restored(F.col("all"), known))
    return o.select("doc_id", (F.size("all") - F.size("left")).cast("long").alias("removed"), F.size("left").cast("long").alias("foreign_left"))


@query("i1_overrides", f"""WITH {ENTS_SQL}, a AS (SELECT doc_id, page_num, entity_type, CAST("start" AS INTEGER) AS "start", NOT (entity_type = 'EMAIL') AS approved FROM ents UNION ALL SELECT -1, 0, 'CUSTOM', 0, true) SELECT * FROM a""")
def _(spark, sf_dir):
    e = ents(spark, sf_dir)
    off = e.filter("entity_type = 'EMAIL'").select("doc_id", "page_num", "start", "end", F.lit(False).alias("approved"))
    custom = rows(spark, [(-1, 0, "AHV")], "doc_id long, page_num int, text string")
    return deid.reviewed(e, off, custom).select("doc_id", "page_num", "entity_type", "start", "approved")


@query("o4_review_order", f"""WITH {ENTS_SQL} SELECT doc_id, entity_type, CAST("start" AS INTEGER) AS "start", CAST(row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, page_num, "start", entity_type) AS INTEGER) AS position FROM ents""")
def _(spark, sf_dir):
    return deid.first_of_page(ents(spark, sf_dir)).select("doc_id", "entity_type", "start", "position")
