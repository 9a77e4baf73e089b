"""Secret scans with DataFrame functions only.

Base kinds are patterns. Beside them, every run of 20 or more characters of the base-64 alphabets is put to a
battery of randomness tests: the encoding is inferred (hex of either case, base 32, digits, letters or both of either
case or mixed, base 64; runs with separators that lack one of digits, upper and lower case are tested with their
separators removed; whatever is left is taken for base 64, so no run goes untested), then

* the uniformity of its alphabet: chi-squared, as the number of equal pairs of characters, whose mean, variance and
  third moment under randomness are exact for each length and alphabet (Pearson's third type fits them);
* the runs about the middle symbol, given how many characters are above it;
* the serial correlation of neighbours

give three p-values against randomness, which Simes' rule combines. The same count of equal pairs gives a p-value
against text-like characters, whose power grows with the length. Benjamini-Hochberg is applied to both within each
class of lengths, over all runs of the corpus: a run is a secret (kind `random`) if text is rejected there, randomness
is not, and no base span overlaps it. Runs under 20 characters are not tested: at that length hardly any could be told
from text.

Offsets are code points, ends exclusive. Null and empty texts have no spans: counts 0, spans empty, the hash that
of no bytes. Repeated rows are scanned each; runs that tie in p are kept or dropped together. An empty table gives an
empty result. Other columns are never read. The matches of a document are numbered in one row and summed by a window,
and the battery is two folds over a run's characters, so very long texts and runs take linear time.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lethe.llm.common import stored

#: Fixed patterns, with the group and least length that a match must have (no retry for those that fail).
_LETTERS = "[A-Za-z0-9+/_.=-]"
_KEY = "[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]"
ASSIGN = rf"""({_KEY})["']?\x20*[:=]\x20*["']?({_LETTERS}+)"""
ACCESS = "AKIA[A-Z0-9]+"
KINDS = (("assign", ASSIGN, 2, 8), ("access", ACCESS, 0, 16), ("hex", "(?<![0-9a-f])[0-9a-f]{32,}+", 0, 32))
LEAST_RUN = 20
RUN = rf"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{{{LEAST_RUN},}}+=*"

#: Share of false discoveries among the runs told from text, and among those told from random ones; classes of lengths.
FALSE_SHARE, FALSE_REJECTED, LENGTHS = 0.01, 0.05, (20, 28, 40, 64)
#: Name, pattern, symbols in order, and the rate at which two characters of text-like strings are equal.
DIGITS, UPPER, LOWER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ENCODINGS = (
    ("hex", "^(?=.*[0-9])(?=.*[a-f])[0-9a-f]+$", DIGITS + "abcdef", 0.125),
    ("HEX", "^(?=.*[0-9])(?=.*[A-F])[0-9A-F]+$", DIGITS + "ABCDEF", 0.125),
    ("base32", "^(?=.*[2-7])(?=.*[A-Z])[A-Z2-7]+$", UPPER + "234567", 0.075),
    ("digits", "^[0-9]+$", DIGITS, 0.2),
    ("lower", "^[a-z]+$", LOWER, 0.065),
    ("upper", "^[A-Z]+$", UPPER, 0.065),
    ("letters", "^[A-Za-z]+$", UPPER + LOWER, 0.06),
    ("lower36", "^[a-z0-9]+$", DIGITS + LOWER, 0.06),
    ("upper36", "^[A-Z0-9]+$", DIGITS + UPPER, 0.06),
    ("alnum", "^(?=.*[0-9])(?=.*[A-Za-z])[A-Za-z0-9]+$", DIGITS + UPPER + LOWER, 0.06),
    ("base64", "^.*$", DIGITS + UPPER + LOWER + "+/", 0.06),
)
#: Letters of text are uneven: the sum of their cubed shares less the square of the rate above widens the coincidences of
#: runs of letters only, so that one-case letters are told from text when long (about 90) and no slug is a discovery.
EXCESS, _UNEVEN = 0.0013, [i for i, (name, *_) in enumerate(ENCODINGS) if name in ("lower", "upper", "letters")]
#: Runs with these are base 64 if all three of its classes stand in them; else they separate parts that are tested joined.
SEPARATORS, _MIXED = "+/_-", "^(?=.*[0-9])(?=.*[A-Z])(?=.*[a-z])"


def _marked(text: Column, kind: int, pattern: str, group: int, least: int, keep: bool) -> Column:
    """array of (k, i, len, m, ok, tok): text cut before each match; len of the part, m of its match."""
    none = F.array().cast("array<struct<k:int,i:int,len:int,m:int,ok:boolean,tok:string>>")
    cut = F.split(F.regexp_replace(text, f"(?:{pattern})", "\u0001$0\u0002"), "\u0001", -1)

    def part(p: Column, i: Column) -> Column:
        match = F.substring_index(p, "\u0002", 1)
        ok = F.length(F.regexp_extract(match, pattern, group)) >= least if group else F.length(match) >= least
        return F.struct(
            F.lit(kind).alias("k"), i.cast("int").alias("i"), F.when(i == 0, F.length(p)).otherwise(F.length(p) - 1).cast("int").alias("len"),
            F.when(i == 0, 0).otherwise(F.length(match)).cast("int").alias("m"), ((i > 0) & ok).alias("ok"),
            F.when((i > 0) & F.lit(keep), match).alias("tok"),
        )

    return F.when(F.regexp_like(text, F.lit(f"(?:{pattern})")), F.transform(cut, part)).otherwise(none)


#: Abramowitz and Stegun 26.2.17: scale, then coefficients of the tail of a normal variable.
_SCALE, _TAIL = 0.2316419, (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)


def _upper_tail(z: Column) -> Column:
    """P(Z > z) of a normal variable."""
    x = F.least(F.abs(z), F.lit(37.0))
    t = 1 / (1 + _SCALE * x)
    poly = reduce(lambda acc, c: acc * t + c, reversed(_TAIL[:-1]), F.lit(_TAIL[-1])) * t
    q = F.exp(-x * x / 2) / math.sqrt(2 * math.pi) * poly
    return F.when(z > 0, q).otherwise(1 - q)


def _once(rows: DataFrame, **cols: Column) -> DataFrame:
    """Adds columns by a generator, behind which they are computed once: plain ones would be put, with all that they
    are made of, into every lambda that names them."""
    return rows.select("*", F.inline(F.array(F.struct(*(c.alias(n) for n, c in cols.items())))))


def battery(runs: DataFrame) -> DataFrame:
    """Adds encoding, p_random (against randomness, combined) and p_text to rows with a column tok."""
    body = F.regexp_replace("tok", "=+$", "")
    joined = F.translate(body, SEPARATORS, "")
    # a run of little but separators is tested as it is
    body = F.when(F.regexp_like(body, F.lit(_MIXED)) | (F.length(joined) < LEAST_RUN // 2), body).otherwise(joined)
    encoding = F.coalesce(*(F.when(F.regexp_like("body", F.lit(p)), F.lit(i)) for i, (_, p, _, _) in enumerate(ENCODINGS)))
    pick = lambda at: F.element_at(F.array(*(F.lit(at(e)) for e in ENCODINGS)), F.col("e") + 1)
    x = _once(_once(runs, body=body), e=encoding)
    x = _once(x, symbols=pick(lambda e: e[2]), a=pick(lambda e: float(len(e[2]))), kappa=pick(lambda e: e[3]), encoding=pick(lambda e: e[0]))
    letters = F.filter(F.split(F.translate("body", "-_", "+/"), ""), lambda c: c != "")
    x = _once(x, x=F.transform(letters, lambda c: F.instr(F.col("symbols"), c).cast("double") - 1))
    x = _once(x, sorted=F.sort_array("x"), size=F.size("x").cast("double"))

    zero = F.lit(0.0)
    half = F.col("a") / 2

    def equal(acc: Column, v: Column) -> Column:
        """In order, each character makes a pair with all equal ones before it."""
        run = F.when(v == acc["prev"], acc["run"] + 1).otherwise(zero)
        return F.struct(v.alias("prev"), run.alias("run"), (acc["pairs"] + run).alias("pairs"))

    def moments(acc: Column, v: Column) -> Column:
        turn = (acc["n"] > 0) & ((acc["prev"] >= half) != (v >= half))
        return F.struct(
            (acc["n"] + 1).alias("n"), v.alias("prev"), F.when(acc["n"] > 0, acc["first"]).otherwise(v).alias("first"),
            (acc["s"] + v).alias("s"), (acc["ss"] + v * v).alias("ss"), (acc["uv"] + F.when(acc["n"] > 0, acc["prev"] * v).otherwise(zero)).alias("uv"),
            (acc["high"] + (v >= half).cast("double")).alias("high"), (acc["turns"] + turn.cast("double")).alias("turns"),
        )

    pairs = F.aggregate("sorted", F.struct(F.lit(-1.0).alias("prev"), zero.alias("run"), zero.alias("pairs")), equal, lambda acc: acc["pairs"])
    names = ("n", "prev", "first", "s", "ss", "uv", "high", "turns")
    x = _once(x, pairs=pairs, m=F.aggregate("x", F.struct(*(zero.alias(n) for n in names)), moments))

    n, a, m = F.col("size"), F.col("a"), {k: F.col(f"m.{k}") for k in names}
    mean = m["s"] / n
    two, three, q = n * (n - 1) / 2, n * (n - 1) * (n - 2) / 6, 1 / a
    sd = F.sqrt(two * q * (1 - q))
    skew = (two * q * (1 - q) * (1 - 2 * q) + 6 * three * q * q * (1 - q)) / (sd * sd * sd)
    shape = 4 / (skew * skew)
    gamma = F.greatest(shape + F.sqrt(shape) * (F.col("pairs") - 0.5 - two * q) / sd, zero)
    p_chi = _upper_tail(3 * F.sqrt(shape) * (F.pow(gamma / shape, F.lit(1 / 3)) - 1 + 1 / (9 * shape)))
    mu = 2 * m["high"] * (n - m["high"]) / n + 1
    variance = (mu - 1) * (mu - 2) / (n - 1)
    off = F.greatest(F.abs(m["turns"] + 1 - mu) - 0.5, zero)
    # characters all on one side have no runs to test; the uniformity of a long enough run tells
    p_runs = F.when(variance > 0, F.least(2 * _upper_tail(off / F.sqrt(variance)), F.lit(1.0))).otherwise(F.pow(F.lit(2.0), 1 - n))
    spread = m["ss"] - n * mean * mean
    lagged = m["uv"] - mean * (2 * m["s"] - m["first"] - m["prev"]) + (n - 1) * mean * mean
    p_serial = F.when(spread > 1e-9, F.least(2 * _upper_tail(F.abs((lagged / spread + 1 / n) * F.sqrt(n))), F.lit(1.0))).otherwise(zero)
    p = F.array_sort(F.array(p_chi, p_runs, p_serial))
    simes = F.least(3 * p[0], 1.5 * p[1], p[2])
    kappa = F.col("kappa")
    extra = F.when(F.col("e").isin(_UNEVEN), 4 * (n - 2) * EXCESS).otherwise(zero)
    z_text = (F.col("pairs") / two - kappa) / F.sqrt((2 * kappa * (1 - kappa) + extra) / (n * (n - 1)))
    return x.select(*runs.columns, "size", "encoding", simes.alias("p_random"), _upper_tail(-z_text).alias("p_text"))


def _bin(p: str) -> Column:
    """Twentieths of a decade below 1, downwards: a bin's largest p is 10 ** -(bin / 20)."""
    return F.floor(F.least(-F.log10(F.greatest(F.col(p), F.lit(1e-60))), F.lit(60.0)) * 20)


def rejected_from(tested: DataFrame, p: str, share: float) -> DataFrame:
    """(stratum, limit): the bin of p from which Benjamini-Hochberg rejects within a class of lengths, if any.

    The ranks come from a histogram of log p with at most 1200 bins for each of the few classes.
    """
    bins = tested.groupBy("stratum", _bin(p).alias("bin")).count()
    down = Window.partitionBy("stratum").orderBy(F.desc("bin"))
    ranked = bins.withColumn("rank", F.sum("count").over(down)).withColumn("runs", F.sum("count").over(Window.partitionBy("stratum")))
    return ranked.filter(F.pow(F.lit(10.0), -F.col("bin") / 20) <= share * F.col("rank") / F.col("runs")).groupBy("stratum").agg(F.min("bin").alias(f"limit_{p}"))


def discoveries(tested: DataFrame, share: float = FALSE_SHARE, rejected: float = FALSE_REJECTED) -> DataFrame:
    """Rows of tested (stratum, p_text, p_random) that are told from text and not from randomness."""
    x = tested
    for p, level in (("p_text", share), ("p_random", rejected)):
        x = x.join(F.broadcast(rejected_from(tested, p, level)), "stratum", "left")  # a row for each class of lengths
    random = F.coalesce(_bin("p_random") < F.col("limit_p_random"), F.lit(True))
    return x.filter((_bin("p_text") >= F.col("limit_p_text")) & random).select(*tested.columns)


def secret_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: float = FALSE_SHARE) -> DataFrame:
    """A row for each row of docs: id, n_assign, n_access, n_hex, n_random, base_sha256, spans."""
    # the two marks become another character that no pattern knows, so offsets stay
    text = F.coalesce(F.col(text_col), F.lit(""))
    text = F.when(text.contains("\u0001") | text.contains("\u0002"), F.translate(text, "\u0001\u0002", "\u0003\u0003")).otherwise(text)
    found = [_marked(F.col("text"), k, p, group, least, False) for k, (_, p, group, least) in enumerate(KINDS)]
    found.append(_marked(F.col("text"), len(KINDS), RUN, 0, LEAST_RUN, True))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    rows = rows.select("doc_id", F.monotonically_increasing_id().alias("uid"), F.concat(*found).alias("seg"))
    rows = stored(rows, "segments")

    before = Window.partitionBy("uid", "k").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    segs = rows.filter(F.size("seg") > 0).select("uid", F.explode("seg").alias("x")).select("uid", "x.*")
    segs = segs.withColumn("start", F.coalesce(F.sum("len").over(before), F.lit(0)).cast("long")).filter("ok")
    segs = segs.select("uid", "k", "start", (F.col("start") + F.col("m")).alias("end"), "tok")
    by_start = Window.partitionBy("uid").orderBy("start", "k").rowsBetween(Window.unboundedPreceding, -1)
    by_end = Window.partitionBy("uid").orderBy(F.desc("start"), F.desc("k")).rowsBetween(Window.unboundedPreceding, -1)
    is_base = F.col("k") < len(KINDS)
    segs = segs.withColumn("last_end", F.max(F.when(is_base, F.col("end"))).over(by_start)).withColumn("next_start", F.min(F.when(is_base, F.col("start"))).over(by_end))
    clear = ~(F.coalesce("last_end", F.lit(0)) > F.col("start")) & ~(F.coalesce("next_start", F.col("end")) < F.col("end"))
    segs = stored(segs.filter(is_base | clear).select("uid", "k", "start", "end", "tok"), "spans")

    stratum = sum((F.when(F.col("end") - F.col("start") >= n, 1).otherwise(0) for n in LENGTHS), F.lit(0)).alias("stratum")
    # a document of very many runs is tested by many tasks
    tested = battery(segs.filter(~is_base).select("uid", "k", "start", "end", "tok", stratum).repartition(F.xxhash64("uid", "start")))
    tested = stored(tested.select("uid", "k", "start", "end", "stratum", "p_text", "p_random"), "tested")
    kept = discoveries(tested, share).select("uid", "k", "start", "end")
    spans = segs.filter(is_base).select("uid", "k", "start", "end").union(kept)
    names = F.array(*(F.lit(n) for n, *_ in KINDS), F.lit("random"))
    said = lambda x: F.concat_ws(":", F.element_at(names, x["k"] + 1), x["start"].cast("string"), x["end"].cast("string"))
    per = spans.groupBy("uid").agg(F.array_sort(F.collect_list(F.struct("start", "k", "end"))).alias("s"))
    out = rows.select("doc_id", "uid").join(per, "uid", "left").withColumn("s", F.coalesce("s", F.array().cast("array<struct<start:bigint,k:int,end:bigint>>")))
    count = lambda k: F.size(F.filter("s", lambda x: x["k"] == k)).cast("long")
    base = F.array_join(F.transform(F.filter("s", lambda x: x["k"] < len(KINDS)), said), ",")
    return out.select(
        F.col("doc_id").alias(id_col), *(count(k).alias(f"n_{n}") for k, (n, *_) in enumerate(KINDS)), count(len(KINDS)).alias("n_random"),
        F.sha2(base, 256).alias("base_sha256"), F.array_join(F.transform("s", said), ",").alias("spans"),
    )
