"""Jaccard similarity join on word shingles: classes of linked documents, no link lost.

1. One pass turns every text into its shingle set and keeps the set's name (64 bits of a hash) and prefix: the
   tokens that hash lowest. Two sets that share at least the needed overlap share at least l tokens of prefixes
   of length size - overlap + l, whatever the order of tokens. Equal sets in one task keep one prefix. A task
   takes groups of up to GROUP_TOKENS prefix tokens: those met in several sets of a group are known to be shared
   at once, and one of these sets, the token's leader, speaks for them. So what is shuffled has one row for each
   token and group, and a token that a third of all documents hold has as few as any.
2. An aggregation finds the tokens that different sets announced. Sets with fewer than l shared prefix tokens
   have no partner and are done.
3. The others' texts are read again (a Bloom filter of bounded size passes the rest by), now with their whole
   sets, and announce their prefixes among each other. Shared tokens connect them into islands; every link lies
   inside one, and the whole sets are dealt out by island.
4. Inside an island a signature tree finds the linked pairs, see signature_tree. An island too large for a task
   is cut by size class and hash into blocks. Each block is joined on its own first, together with PIVOTS sets of
   the island of like size, so that a large group of near copies is one class at once. Then only pairs of blocks of
   like size meet that still hold different classes; sets known to be connected are not compared again.
5. Components of the links, with equal sets as one node, are the classes.

A set is named by 64 bits of its hash. Another 64 bits are held against each other wherever sets have one name; should
they differ, the whole join is done again under other names.

Links join only sets of different texts or names; copies are never expanded into pairs. A text without words has
an empty set and is linked with nothing, null texts likewise. Rows of a repeated id are separate nodes; their
class is named by the least id in it (null where all ids of a class are null). An empty table gives an empty
result. Very long texts are read whole, in passes over their words. Ties have no say: a class is named by its least id.
Other columns are never read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lethe.llm.common import bloom, dropped, in_bloom, joined_by_hubs, map_rows, stored, without
from lethe.llm.graph import components
from lethe.llm.shingles import shingle_sets
from lethe.llm.signature_tree import similar

#: Tokens of the sets that one task joins at a time; tokens that a short set counts for, as pairs cost more than tokens.
UNIT_TOKENS, LEAST_WEIGHT = 2_000_000, 256
#: Sets of an island and size class that are joined with each of its blocks.
PIVOTS = 16
#: Prefix tokens among which a task finds the shared ones by itself.
GROUP_TOKENS = 500_000


def least_overlap(size: int, num: int, den: int) -> int:
    """What a set of `size` tokens shares with any partner, at least."""
    return -(-num * size // den)


def extra(size: int) -> int:
    """l: how many tokens of the prefixes any linked pair shares, as far as this size asks for: the more, the fewer
    sets stay that share only a common token with others."""
    return max(1, min(3, size // 3), size // 8)


def prefix_length(size: int, num: int, den: int) -> int:
    return min(size, size - least_overlap(size, num, den) + extra(size))


def names(sets: list[np.ndarray], seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each set: its name and what equal names are checked by."""
    salt = seed.to_bytes(4, "little")
    both = np.frombuffer(b"".join(hashlib.blake2b(s.tobytes(), digest_size=16, salt=salt).digest() for s in sets), "<i8").reshape(-1, 2)
    return both[:, 0].copy(), both[:, 1].copy()


def announce(heads: list[np.ndarray | None], name: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray], list[np.ndarray], np.ndarray]:
    """For each set of a group: tokens it alone holds, tokens it leads, the leaders of its shared tokens (other
    than itself), and how many of its tokens are shared."""
    sizes = np.array([0 if h is None else len(h) for h in heads])
    flat = np.concatenate([h for h in heads if h is not None] or [np.zeros(0, np.uint64)])
    owner = np.repeat(np.arange(len(heads)), sizes)
    order = np.argsort(flat, kind="stable")
    token, own = flat[order], owner[order]
    new = np.ones(len(token), bool)
    new[1:] = token[1:] != token[:-1]
    start = np.flatnonzero(new)
    count = np.diff(np.append(start, len(token)))
    single = start[count == 1]
    lead = start[count > 1]
    run = np.repeat(np.arange(len(start)), count)
    leader = own[start][run]
    shared = count[run] > 1
    follow = np.unique(np.stack([own[shared & ~new], leader[shared & ~new]], 1), axis=0) if (shared & ~new).any() else np.zeros((0, 2), np.int64)

    def dealt(keys: np.ndarray, values: np.ndarray) -> list[np.ndarray]:
        at = np.argsort(keys, kind="stable")
        return np.split(values[at], np.cumsum(np.bincount(keys, minlength=len(heads)))[:-1])

    sure = np.bincount(own[shared], minlength=len(heads))
    return dealt(own[single], token[single]), dealt(own[lead], token[lead]), dealt(follow[:, 0], name[follow[:, 1]]), sure


def lists(parts: list[np.ndarray]) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    flat = np.concatenate([p.view(np.int64) for p in parts] or [np.zeros(0, np.int64)])
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))


def prefixes(rows: DataFrame, k: int, num: int, den: int, group_tokens: int, only: tuple[np.ndarray, int] | None = None, seed: int = 0) -> DataFrame:
    """(doc_id, row_hash, n, s, check) of each row, and for the first of equal sets: tokens to announce, leaders, sure.

    With `only`, a Bloom filter of names, rows that it passes and their whole sets instead; once for each task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        held: list[tuple] = []
        size = 0

        def flush() -> pa.RecordBatch:
            name = np.array([r[3] for r in held], np.int64)
            single, lead, leaders, sure = announce([r[4] for r in held], name)
            cols = [pa.array([r[i] for r in held], t) for i, t in ((0, id_type), (1, pa.int64()), (6, pa.int64()), (2, pa.int64()), (3, pa.int64()))]
            cols += [lists([np.concatenate(p) for p in zip(single, lead, strict=True)]), lists(leaders), pa.array(sure, pa.int64())]
            fields = ["doc_id", "row_hash", "check", "n", "s", "said", "leaders", "sure"]
            if only:
                cols, fields = [*cols[3:], pa.array([r[5] for r in held], pa.binary())], [*fields[3:], "tokens"]
            return pa.RecordBatch.from_arrays(cols, fields)

        for b in batches:
            id_type = b.schema.field("doc_id").type
            sets = list(shingle_sets([t or b"" for t in b.column("body").to_pylist()], k))
            name, check = names(sets, seed)
            passed = in_bloom(*only, name.view(np.uint64)).tolist() if only else [True] * len(sets)
            for d, h, s, x, y, ok in zip(b.column("doc_id").to_pylist(), b.column("row_hash").to_pylist(), sets, name.tolist(), check.tolist(), passed, strict=True):
                new = len(s) > 0 and x not in seen
                if only and not (ok and new):
                    continue
                seen.add(x)
                head = s[: prefix_length(len(s), num, den)].copy() if new else None
                held.append((d, h, len(s), x, head, s.tobytes() if only else None, y))
                size += (8 if head is None else len(head)) + (len(s) // 4 if only else 0)
            if size > group_tokens:
                yield flush()
                held.clear()
                size = 0
            if len(seen) > 1 << 20:
                seen.clear()
        if held:
            yield flush()

    kind = rows.schema["doc_id"].dataType.simpleString()
    said = "said array<long>, leaders array<long>, sure long"
    return map_rows(rows, run, f"n long, s long, {said}, tokens binary" if only else f"doc_id {kind}, row_hash long, check long, n long, s long, {said}")


def met_by(first: DataFrame) -> DataFrame:
    """(s, hub, met): how many tokens that s announced were also announced by other sets, the least of which is hub.

    A token has a row for each group at most; both uses read one exchange.
    """
    said = first.select("s", F.explode("said").alias("token")).repartition("token")
    shared = said.groupBy("token").agg(F.min("s").alias("hub"), F.max("s").alias("other")).filter("hub < other").select("token", "hub")
    return stored(said.join(shared.hint("shuffle_hash"), "token").groupBy("s", "hub").agg(F.count("*").alias("met")), "met")


def with_partners(first: DataFrame, met: DataFrame, num: int, den: int) -> DataFrame:
    """(s, n) of the sets that may have a partner, by the shared tokens of their prefixes."""
    hits = first.filter("sure > 0 OR size(said) > 0").select("s", "n", F.col("sure").alias("met")).union(met.select("s", F.lit(None).cast("long"), "met"))
    least = F.ceil(F.col("n") * num / den)
    hits = hits.groupBy("s").agg(F.max("n").alias("n"), F.sum("met").alias("met"))
    return stored(hits.filter(F.col("met") >= F.greatest(F.lit(1), F.least(F.lit(3), F.floor(least / 3)), F.floor(least / 8))).select("s", "n"), "alive")


def unit_links(rows: DataFrame, num: int, den: int) -> DataFrame:
    """Links inside each unit of (unit, side, s, label, tokens), whose rows stand together; sides 0 and 1 are
    joined with each other, a unit of side 0 alone with itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, met = None, [], set()

        def out() -> list[tuple[int, int]]:
            held.sort(key=lambda r: (r[0], r[1]))
            split = sum(r[0] == 0 for r in held)
            pairs = similar([np.frombuffer(r[3], np.uint64) for r in held], num, den, np.array([r[2] for r in held]), None if split == len(held) else split)
            return [(held[i][1], held[j][1]) for i, j in pairs]

        for b in batches:
            found: list[tuple[int, int]] = []  # links of units that end in this batch
            for unit, side, s, label, tokens in zip(*(b.column(c).to_pylist() for c in ("unit", "side", "s", "label", "tokens")), strict=True):
                if unit != at:
                    found += out() if len(held) > 1 else []
                    at, held, met = unit, [], set()
                if s not in met:  # equal sets of different tasks come once from each
                    met.add(s)
                    held.append((side, s, label, tokens))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in found], pa.int64()) for i in (0, 1)], ["a", "b"])
        if len(held) > 1 and (found := out()):
            yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in found], pa.int64()) for i in (0, 1)], ["a", "b"])

    return map_rows(rows.repartition("unit").sortWithinPartitions("unit").select("unit", "side", "s", "label", "tokens"), run, "a long, b long")


def joined(sets: DataFrame, islands: DataFrame, num: int, den: int, unit_tokens: int) -> DataFrame:
    """Links (a, b), a forest for each class, of sets (s, tokens) dealt out by islands (s, island, n)."""
    size_class = F.floor(F.log("n") / float(np.log(den / num) * 1.0000001)) if num < den else F.col("n")
    classed = islands.withColumn("class", size_class.cast("long"))
    weight = F.sum(F.greatest("n", F.lit(LEAST_WEIGHT)))
    parts = classed.groupBy("island", "class").agg(weight.alias("part"))
    whole = parts.groupBy("island").agg(F.sum("part").alias("whole"))
    parts = parts.join(whole, "island").select("island", "class", F.when(F.col("whole") <= unit_tokens, F.lit(0)).otherwise(F.ceil(F.col("part") / unit_tokens)).cast("int").alias("blocks"))
    block = F.when(F.col("blocks") == 0, F.lit(-1)).otherwise(F.pmod(F.xxhash64("s"), F.col("blocks")).cast("int"))
    dealt = stored(classed.join(parts, ["island", "class"]).withColumn("block", block).withColumn("class", F.when(F.col("blocks") == 0, F.lit(-1)).otherwise(F.col("class"))), "dealt")
    unit = lambda *c: F.xxhash64(F.struct(*c))
    units = dealt.select("s", unit("island", "class", "block").alias("unit"), F.lit(0).alias("side"), F.col("s").alias("label"))
    many = dealt.filter("blocks > 0")
    several = bool(many.limit(1).count())
    if several:  # the pivots of a size class go to every block of it and of the next larger one
        pivots = many.groupBy("island", "class", F.pmod(F.xxhash64("s", F.lit(1)), F.lit(PIVOTS)).alias("p")).agg(F.min("s").alias("s")).drop("p")
        pivots = pivots.select("s", "island", F.explode(F.array("class", F.col("class") + 1)).alias("class"))
        at = pivots.join(many.select("island", "class", "block").distinct(), ["island", "class"])
        units = units.union(at.select("s", unit("island", "class", "block").alias("unit"), F.lit(0), F.col("s")))
    links = stored(unit_links(sets.join(units, "s"), num, den), "links")
    if not several:
        return links

    # pairs of blocks of one island, of the same size class or neighbours, that hold more than one class
    labels = components(links)
    cut = dealt.filter("blocks > 0").join(labels.withColumnRenamed("node", "s"), "s", "left").withColumn("label", F.coalesce("label", "s"))
    cut = stored(cut, "cut")
    blocks = cut.groupBy("island", "class", "block").agg(F.min("label").alias("lo"), F.max("label").alias("hi"))
    x, y = blocks.alias("x"), blocks.alias("y")
    pairs = x.join(y, F.expr("x.island = y.island AND (x.class = y.class AND x.block < y.block OR y.class = x.class + 1) AND NOT (x.lo = x.hi AND y.lo = y.hi AND x.lo = y.lo)"))
    ends = [F.struct(F.col(f"{t}.island"), F.col(f"{t}.class"), F.col(f"{t}.block")) for t in "xy"]
    pairs = stored(pairs.select(F.xxhash64(*ends).alias("unit"), *(e.alias(t) for e, t in zip(ends, "xy", strict=True))), "pairs")
    sides = pairs.select("unit", F.lit(0).alias("side"), "x.*").union(pairs.select("unit", F.lit(1).alias("side"), "y.*"))
    units = cut.join(sides, ["island", "class", "block"]).select("s", "unit", "side", "label")
    return links.union(stored(unit_links(sets.join(units, "s"), num, den), "across"))


def shingle_join(
    docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text",
    unit_tokens: int = UNIT_TOKENS, group_tokens: int = GROUP_TOKENS,
) -> DataFrame:
    """(doc_id, row_hash, n_shingles, component_id, first) of every row; sets link when den * shared >= num * union.

    row_hash is the 64-bit hash of id and text; first marks the row that a class keeps.
    """
    rows = docs.selectExpr(f"`{id_col}` AS doc_id", f"xxhash64(`{id_col}`, coalesce(`{text_col}`, '')) AS row_hash", f"cast(`{text_col}` AS binary) AS body")
    for seed in range(8):
        first = stored(prefixes(rows, k, num, den, group_tokens, seed=seed), "prefixes")
        own = stored(first.select("doc_id", "row_hash", F.col("n").alias("n_shingles"), "s", "check"), "own")
        if not own.groupBy("s").agg(F.min("check").alias("lo"), F.max("check").alias("hi")).filter("lo <> hi").limit(1).count():
            break
        dropped(first)
    else:
        raise RuntimeError("different sets have one name under every seed")
    own = own.drop("check")
    met = met_by(first)
    alive = with_partners(first, met, num, den)
    dropped(first)
    if not (count := alive.count()):
        return _classes(own.withColumn("label", F.col("s")))

    first = stored(prefixes(rows, k, num, den, group_tokens, bloom(alive, "s", count), seed), "sets")
    met = met_by(first)
    alive = with_partners(first, met, num, den)
    islands = components(met.select(F.col("s").alias("a"), F.col("hub").alias("b")).union(first.select("s", F.explode("leaders"))))
    islands = stored(alive.join(islands, alive["s"] == islands["node"]).select("s", "n", F.col("label").alias("island")), "islands")
    several = islands.groupBy("island").agg(F.count("*").alias("c")).filter("c > 1").select("island")
    islands = stored(islands.join(several, "island"), "several")
    labels = components(joined(first.select("s", "tokens"), islands, num, den, unit_tokens))
    dropped(first)
    own = own.join(labels.withColumnRenamed("node", "s"), "s", "left")
    return _classes(own.withColumn("label", F.coalesce("label", "s")))


def _classes(own: DataFrame) -> DataFrame:
    """The least id of each class: rows whose sets have one label; rows without shingles stand alone."""
    own = stored(own, "own")
    full = own.filter("n_shingles > 0")
    least = full.groupBy("label").agg(F.min("doc_id").alias("component_id"), F.min(F.struct("doc_id", "row_hash")).alias("first"), F.count("*").alias("members"))
    first = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("row_hash") == F.col("first.row_hash"))
    out = joined_by_hubs(full, least, ["label"], "members", own.count()).select("doc_id", "row_hash", "n_shingles", "component_id", first.alias("first"))
    return out.union(own.filter("n_shingles = 0").select("doc_id", "row_hash", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(True)))


def near_dup_kept(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of docs, all columns, of which each class keeps the one with the least (doc_id, hash)."""
    return without(docs, shingle_join(docs, k, num, den).filter("NOT first").select("doc_id", "row_hash"))
