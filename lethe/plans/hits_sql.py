"""The detection of the engine as DuckDB SQL, generated from the same registry: the oracle of most queries."""

from __future__ import annotations

from lethe.functions.catalog import LEAST_LENGTH, PATTERNS, Pattern
from lethe.plans.fixtures import SRC_SQL, literal

STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"


def strip(x: str) -> str:
    return STRIP.format(x)


def any_of(x: str, words) -> str:
    return "(" + " OR ".join(f"contains({x}, {literal(w)})" for w in words) + ")"


def in_list(x: str, words) -> str:
    return f"{x} IN ({', '.join(map(literal, words))})"


def case_map(x: str, mapping: dict, default) -> str:
    return f"CASE {x} " + " ".join(f"WHEN {literal(k)} THEN {literal(v)}" for k, v in mapping.items()) + f" ELSE {literal(default)} END"


def luhn(digits: str) -> str:
    d = f"CAST(substr({digits}, length({digits}) - i + 1, 1) AS INTEGER)"
    return f"(length({digits}) >= 13 AND list_sum(list_transform(range(1, length({digits}) + 1), lambda i: CASE WHEN i % 2 = 1 THEN {d} WHEN {d} > 4 THEN {d} * 2 - 9 ELSE {d} * 2 END)) % 10 = 0)"


def pattern_sql(p: Pattern, seq: int) -> str:
    """SELECT doc_id, page_num, seq, start, end, text, type, priority of one pattern's hits over src."""
    flags = "(?i)" if p.ignore_case else ""
    after = f"({p.after})" if p.after else "()"
    re = (f"{flags}({p.before})({p.value}){after}").replace("'", "''")
    # RE2's boundaries are of ASCII: for core patterns other letters become one that no class holds
    scan = r"regexp_replace(regexp_replace(scan, '[^\P{L}\x00-\x7F]', '_', 'g'), '[^\P{N}\x00-\x7F]', '_', 'g')" if p.tier == "core" and p.id != "r18_email" else "scan"
    cut = f"string_split(regexp_replace({scan}, '{re}', '\\1' || chr(1) || '\\2' || chr(2) || '\\3', 'g'), chr(1))"
    value = "raw" if p.tier == "core" else strip("raw")
    keep = [f"length({value}) >= {n}"] if (n := LEAST_LENGTH[p.tier]) else []
    if p.type == "CREDIT_CARD":
        keep.append(luhn("regexp_replace(raw, '[^0-9]', '', 'g')"))
    where = " AND ".join(["k > 1", *keep])
    return f"""
SELECT doc_id, page_num, {seq} AS seq, s AS "start", s + n AS "end", {value} AS text, '{p.type}' AS type, {p.priority} AS priority
FROM (SELECT *, substr(text, s + 1, n) AS raw FROM (
  SELECT doc_id, page_num, text, k, length(split_part(part, chr(2), 1)) AS n,
    CAST(coalesce(sum(CASE WHEN k = 1 THEN length(part) ELSE length(part) - 1 END) OVER (PARTITION BY doc_id, page_num ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS s
  FROM (SELECT doc_id, page_num, text, unnest(parts) AS part, generate_subscripts(parts, 1) AS k
        FROM (SELECT doc_id, page_num, text, {cut} AS parts FROM src WHERE regexp_matches({scan}, '{re}'))))) WHERE {where}"""


HITS_SQL = "hits AS (" + " UNION ALL ".join(pattern_sql(p, i) for i, p in enumerate(PATTERNS)) + ")"
ORDER = "-priority, rank, \"start\", seq"


def merged_sql(source: str, page: str = "doc_id, page_num") -> str:
    """CTEs kept and merged: greedy by span, then the first of equal texts. source has a column rank too."""
    return f"""
listed AS (SELECT {page}, list({{'start': "start", 'end': "end", 'text': text, 'type': type, 'priority': priority, 'rank': rank, 'seq': seq, 'source': source, 'score': score}} ORDER BY {ORDER}) AS l FROM {source} GROUP BY {page}),
kept AS (SELECT {page}, unnest(list_reduce(list_transform(l, lambda x: [x]), lambda a, x: CASE WHEN len(list_filter(a, lambda y: y.start < x[1].end AND x[1].start < y.end)) > 0 THEN a ELSE list_concat(a, x) END), recursive := true) FROM listed),
merged AS (SELECT * FROM kept QUALIFY row_number() OVER (PARTITION BY {page}, lower({strip('text')}) ORDER BY {ORDER}) = 1)"""


BASE_SQL = f"{SRC_SQL}, {HITS_SQL}, ranked AS (SELECT *, 0 AS rank, 'regex' AS source, NULL::DOUBLE AS score FROM hits), {merged_sql('ranked')}"


def around(start: str, end: str, before: int, after: int) -> str:
    return f"lower(substr(page, greatest({start} - {before}, 0) + 1, {end} + {after} - greatest({start} - {before}, 0)))"


def context_sql() -> str:
    from lethe.functions import catalog as C

    t = strip("text")
    a = f"(type = 'LOCATION' AND {in_list(f'lower({t})', C.COUNTRIES)} AND {any_of(around('"start"', '"start"', 60, 0), C.SCOPE_WORDS)})"
    b = f"(regexp_matches({t}, '^[A-Z]{{2,4}}$') AND {any_of(around('"start"', '"end"', 60, 60), C.LEGEND_WORDS)})"
    c = f"(regexp_matches({t}, '^[A-Z]{{1,2}}\\s?\\d{{1,2}}$') AND {any_of(around('"start"', '"end"', 40, 40), C.REGION_WORDS)})"
    return f"({a} OR {b} OR {c})"


PLAUSIBLE_SQL = f"(length({strip('text')}) >= 3 AND regexp_matches({strip('text')}, '[\\p{{L}}\\p{{N}}]'))"
ENTS_SQL = f"""{BASE_SQL},
ents AS (SELECT doc_id, page_num, type AS entity_type, text, "start", "end", 1.0::DOUBLE AS score, 'regex' AS source, 'regex | ' || type AS analysis
         FROM (SELECT m.*, s.text AS page FROM merged m JOIN src s USING (doc_id, page_num)) WHERE NOT {context_sql()} AND {PLAUSIBLE_SQL})"""
