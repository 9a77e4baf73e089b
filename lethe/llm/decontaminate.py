"""Benchmark decontamination: CGK embedding, bit-sampling LSH over item-sized windows, exact edit verification.

Texts and items are lower-cased, and their runs of white space made one space; distances count UTF-8 bytes.
An item matches where its edit distance to a substring is at most k, EDITS of its length rounded down.

1. Embedding: a walk reads a window byte by byte for a fixed number of steps; each step gives the byte it stands on as
   a coordinate and then stays or moves on, as a random function of step and byte says. Walks of two strings that
   differ by few edits read different bytes for a while after an edit and then meet again, so edit distance becomes
   Hamming distance. Several walks repeat the embedding.
2. LSH: a key samples sixteen neighbouring coordinates of one walk (neighbours agree together: at 15 % edits they do
   some ten times as often as scattered ones). Keys begin at every eighth coordinate and have a table each; a window
   and an entry that share as many keys as their class of lengths asks for meet.
3. Windows are laid over all of every text at a stride, and over the items at every shift below that stride, so a
   place of an item always has a window at the shift of an entry. Window and stride go by the length of items (SIZES);
   longer items are cut into pieces of that size, of which one has at most its share of the edits.
4. Windows that meet an entry are compared by edits in bit-parallel search, many in step, and pass with
   at most LOOSE of their length; then the least edit distance of the whole item to a substring about the place
   decides.

Exact copies are always found, and edited ones at the recall that the README tables. Items shorter than LEAST_ITEM
bytes after normalisation match exactly only, as whole words: neither end of the place is inside a word, where scripts
without spaces have an end at each character. Null and empty items have no hits; ids may be of any type.
Items are broadcast in blocks of at most BLOCK_BYTES, as text; each worker builds the tables of a block once. A
larger benchmark takes one pass for each block. Null and empty texts have no hits; very long texts are searched with
a window's width of their neighbours' bytes, a pass of PASS_BYTES or one text at a time. Rows with repeated ids, of
either table, are each reported. Of places that tie in distance the first counts. Empty tables give an empty result.
Other columns are never read.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from lethe.llm.common import map_rows, texts

EDITS = 0.15
LEAST_ITEM = 40
BLOCK_BYTES = 2 << 20
#: Bytes of text that are searched together, and that one pass holds.
GROUP_BYTES, PASS_BYTES = 8 << 20, 1 << 20
#: Least length of an item, width and stride of its windows, walks, and keys that a window shares with an entry at least.
#: Items of a class are cut into pieces of its least length.
SIZES = ((80, 52, 28, 6, 2), (40, 32, 8, 6, 1))
#: Share of edits at which a window passes, bytes whose windows are walked together, pairs of windows and entries held.
LOOSE, SEGMENT, MOST_PAIRS = 0.35, 1 << 19, 1 << 21
_TABLE_BITS, _PAD = 20, 256
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def _symbol_classes() -> np.ndarray:
    """Digits, letters and the space have classes of their own among 64; other bytes share the rest."""
    out = np.arange(256) % 27 + 37
    out[48:58], out[97:123], out[32] = np.arange(10), np.arange(10, 36), 36
    return out.astype(np.uint8)


_CLASS = _symbol_classes()


def _steps(width: int) -> int:
    """Coordinates of a walk over a window: it moves on at every second step, about."""
    return width * 2 - 8


@functools.lru_cache(maxsize=8)
def _moves(walk: int, width: int) -> np.ndarray:
    """For each step the classes at which the walk moves on, as bits."""
    return np.random.default_rng([walk, width]).integers(0, 1 << 64, _steps(width), dtype=np.uint64)


def walk_keys(classes: np.ndarray, starts: np.ndarray, walk: int, width: int) -> Iterator[np.ndarray]:
    """The keys of each window, one array for each table: `classes` of a text, windows from `starts` on."""
    at, n, one = starts.astype(np.int64), len(starts), np.uint64(1)
    rows, move, before = np.empty((8, n), np.uint8), np.empty(n, np.uint64), None
    for j, bits in enumerate(_moves(walk, width)):
        c = rows[j % 8]
        np.take(classes, at, out=c, mode="clip")
        np.right_shift(bits, c, out=move)
        np.bitwise_and(move, one, out=move)
        np.add(at, move.view(np.int64), out=at)
        if j % 8 == 7:
            word = np.ascontiguousarray(rows.T).view(np.uint64).ravel()
            if before is not None:
                h = before * _MIX[0] ^ (word + (before >> np.uint64(29))) * _MIX[1]
                yield h
            before = word


def _slot(keys: np.ndarray) -> np.ndarray:
    return (keys * _MIX[0]) >> np.uint64(64 - _TABLE_BITS)


def normalised(text: str | None) -> bytes:
    return b" ".join((text or "").lower().encode("utf-8", "replace").split())


def best_match(item: bytes, region: bytes) -> tuple[int, int]:
    """The least edit distance of item to a substring of region, and where the first such substring ends."""
    if (at := region.find(item)) >= 0:
        return 0, at + len(item)
    m = len(item)
    full, high = (1 << m) - 1, 1 << (m - 1)
    eq: dict[int, int] = {}
    for i, c in enumerate(item):
        eq[c] = eq.get(c, 0) | 1 << i
    pv, mv, score, best, end = full, 0, m, m, 0
    for j, c in enumerate(region):
        e = eq.get(c, 0)
        xv = e | mv
        xh = (((e & pv) + pv) ^ pv) | e
        ph, mh = mv | ~(xh | pv) & full, pv & xh
        if ph & high:
            score += 1
        elif mh & high:
            score -= 1
        ph, mh = ph << 1 & full, mh << 1 & full
        pv, mv = mh | ~(xv | ph) & full, ph & xv
        if score < best:
            best, end = score, j + 1
    return best, end


def least_distances(pieces: np.ndarray, lengths: np.ndarray, regions: np.ndarray) -> np.ndarray:
    """best_match's distance of each row of pieces (at most 64 symbols under 64, those past a length left out) and of
    regions (likewise), all rows in step."""
    one, n = np.uint64(1), len(pieces)
    rows = np.arange(n) * 64
    eq = np.zeros(n * 64, np.uint64)
    for j in range(pieces.shape[1]):
        eq[rows + pieces[:, j]] |= np.where(j < lengths, one << np.uint64(j), np.uint64(0))
    high = (lengths - 1).astype(np.uint64)
    pv, mv = np.full(n, ~np.uint64(0)), np.zeros(n, np.uint64)
    score = lengths.astype(np.int64)
    best, columns = score.copy(), np.ascontiguousarray(regions.T)
    for c in columns:
        e = eq[rows + c]
        xv = e | mv
        xh = (((e & pv) + pv) ^ pv) | e
        ph, mh = mv | ~(xh | pv), pv & xh
        score += ((ph >> high) & one).view(np.int64)
        score -= ((mh >> high) & one).view(np.int64)
        ph, mh = ph << one, mh << one
        pv, mv = mh | ~(xv | ph), ph & xv
        np.minimum(best, score, out=best)
    return best


def _spaced(c: str) -> bool:
    """Whether c is of a word in a script that puts spaces between words."""
    return c.isalnum() and not ("\u0e00" <= c <= "\u109f" or "\u1780" <= c <= "\u17ff" or "\u2e80" <= c <= "\uabff" or "\uf900" <= c <= "\ufaff" or c >= "\U00020000")


def between_words(body: bytes, at: int) -> bool:
    """Whether at, the beginning of a character or the end of body, is not inside a word."""
    if not 0 < at < len(body):
        return True
    before, after = body[max(0, at - 4) : at].decode("utf-8", "ignore"), body[at : at + 4].decode("utf-8", "ignore")
    return not (before and after and _spaced(before[-1]) and _spaced(after[0]))


@dataclass
class Places:
    """Where an item stands in a text: (start, length, distance) of each place, kept apart by its allowed edits."""

    near: int
    at: list[tuple[int, int, int]] = field(default_factory=list)

    def add(self, start: int, length: int, distance: int) -> None:
        for j, (s, _, d) in enumerate(self.at):
            if abs(s - start) <= self.near:
                if (distance, start) < (d, s):
                    self.at[j] = (start, length, distance)
                return
        self.at.append((start, length, distance))

    def row(self) -> tuple[int, int, int, int]:
        """places, start and length of the first, least distance"""
        start, length, _ = min(self.at)
        return len(self.at), start, length, min(d for _, _, d in self.at)


@dataclass
class Tables:
    """The entries of one class of lengths: windows of items by the keys of every walk and run."""

    width: int
    stride: int
    walks: int
    shared: int
    #: Of each entry: its item and the place of the window there.
    item: np.ndarray
    offset: np.ndarray
    bits: int
    #: For each table: flags of the keys' leading bits, the distinct keys in order, where each begins and how many entries
    #: it has, and the entries.
    keys: list[tuple[np.ndarray, ...]]


class Items:
    """A block of the benchmark: what workers get is ids and texts, and each builds the tables on first use."""

    def __init__(self, ids: list, bodies: list[bytes], edits: float = EDITS):
        self.ids, self.bodies, self.edits = ids, bodies, edits
        self._built = False

    def __getstate__(self):
        return self.ids, self.bodies, self.edits

    def __setstate__(self, state):
        self.__init__(*state)

    def allowed(self, i: int) -> int:
        return int(self.edits * len(self.bodies[i]))

    def build(self) -> None:
        if self._built:
            return
        pad = bytes(_PAD)
        self.begin = np.cumsum([_PAD] + [len(b) + _PAD for b in self.bodies])
        self.size = np.array([len(b) for b in self.bodies], np.int64)
        self.flat = np.frombuffer(pad + b"".join(b + pad for b in self.bodies), np.uint8)
        classes, self.tables, most = _CLASS[self.flat], [], None
        for least, width, stride, walks, shared in SIZES:
            entries = []
            for i, b in enumerate(self.bodies):
                if len(b) >= least and (most is None or len(b) < most):
                    pieces = len(b) // least
                    firsts = [len(b) * p // pieces for p in range(pieces)]
                    entries += [(i, first + shift) for first in firsts for shift in range(stride)]
            most = least
            if not entries:
                continue
            item, offset = np.array(entries, np.int64).T
            keys, bits = [], min(23, max(16, (32 * len(entries)).bit_length()))
            for walk in range(walks):
                for k in walk_keys(classes, self.begin[item] + offset, walk, width):
                    order, flags = np.argsort(k, kind="stable"), np.zeros(1 << bits - 3, np.uint8)
                    np.bitwise_or.at(flags, (k >> np.uint64(67 - bits)).view(np.int64), np.uint8(1) << ((k >> np.uint64(64 - bits)).astype(np.uint8) & np.uint8(7)))
                    known, begin, count = np.unique(k[order], return_index=True, return_counts=True)
                    keys.append((flags, known, begin, count, order.astype(np.int32)))
            self.tables.append(Tables(width, stride, walks, shared, item, offset, bits, keys))
        self.short: dict[bytes, list[int]] = {}
        self.heads: dict[int, tuple[np.ndarray, np.ndarray, list[list[int]]]] = {}
        lengths: dict[int, dict[int, set[int]]] = {}
        for i, b in enumerate(self.bodies):
            if len(b) < LEAST_ITEM:
                self.short.setdefault(b, []).append(i)
                lengths.setdefault(min(8, len(b)), {}).setdefault(int.from_bytes(b[:8], "little"), set()).add(len(b))
        for size, heads in lengths.items():
            known, flags = np.array(sorted(heads), np.uint64), np.zeros(1 << _TABLE_BITS, bool)
            flags[_slot(known)] = True
            self.heads[size] = flags, known, [sorted(heads[k]) for k in sorted(heads)]
        self._built = True

    def met(self, x: np.ndarray, t: Tables) -> np.ndarray:
        """(item, start of the item) of each window of x that shares keys with an entry and is like it."""
        out = [np.zeros((0, 2), np.int64)]
        step = t.stride * max(256, MOST_PAIRS * 256 // len(t.item))
        for first in range(_PAD, len(x) - _PAD, min(step, SEGMENT)):
            last = min(first + min(step, SEGMENT), len(x) - _PAD)
            classes = _CLASS[x[first : last + 2 * t.width]]
            out.append(self.like(x, t, *self.sharing(classes, np.arange(0, last - first, t.stride), t), first))
        return np.unique(np.concatenate(out), axis=0)

    def sharing(self, classes: np.ndarray, starts: np.ndarray, t: Tables) -> tuple[np.ndarray, np.ndarray]:
        """Windows by their starts, and entries that share t.shared keys with them."""
        tables, found, total = iter(t.keys), [], 0
        for walk in range(t.walks):
            for k in walk_keys(classes, starts, walk, t.width):
                flags, known, begin, count, entry = next(tables)
                slot = k >> np.uint64(64 - t.bits)
                byte = np.take(flags, (slot >> np.uint64(3)).view(np.int64), mode="clip")
                at = np.flatnonzero(byte >> (slot.astype(np.uint8) & np.uint8(7)) & np.uint8(1))
                k = k[at]
                j = np.minimum(np.searchsorted(known, k), len(known) - 1)
                met = known[j] == k
                at, lo, n = at[met], begin[j[met]], count[j[met]]
                total += int(n.sum())
                if total > MOST_PAIRS and len(starts) > 64:  # texts of one symbol and the like: fewer windows at a time
                    half = len(starts) // 2
                    parts = [self.sharing(classes, part, t) for part in (starts[:half], starts[half:])]
                    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
                e = entry[np.arange(n.sum()) + np.repeat(lo - np.cumsum(n) + n, n)]
                found.append(np.repeat(at, n) * len(t.item) + e)
        pairs = np.sort(np.concatenate(found))
        pairs = np.unique(pairs[t.shared - 1 :][pairs[t.shared - 1 :] == pairs[: len(pairs) - t.shared + 1]])
        at, e = np.divmod(pairs, len(t.item))
        # one of the entries of an item that lie within eight bytes of each other stands for all
        _, first = np.unique((at * len(self.bodies) + t.item[e]) * (1 << 20) + t.offset[e] // 8, return_index=True)
        return starts[at[first]], e[first]

    def like(self, x: np.ndarray, t: Tables, at: np.ndarray, e: np.ndarray, first: int) -> np.ndarray:
        """(item, start of the item) of the windows within LOOSE of their entries."""
        i, p = t.item[e], at + first
        passed, slack = np.zeros(len(e), bool), t.width // 4
        for a in range(0, len(e), 4096):
            s = slice(a, a + 4096)
            size = np.minimum(t.width, self.size[i[s]] - t.offset[e[s]])
            pieces = _CLASS[self.flat[(self.begin[i[s]] + t.offset[e[s]])[:, None] + np.arange(t.width)]]
            regions = _CLASS[x[np.clip((p[s] - slack)[:, None] + np.arange(t.width + 2 * slack), 0, len(x) - 1)]]
            passed[s] = least_distances(pieces, size, regions) <= LOOSE * size
        return np.unique(np.stack([i[passed], p[passed] - t.offset[e[passed]] - _PAD], 1), axis=0)

    def edited_places(self, bodies: list[bytes], found: list[dict[int, Places]]) -> None:
        """Adds to found the places of items of LEAST_ITEM bytes or more."""
        begin = np.concatenate([[0], np.cumsum([len(b) + 1 for b in bodies])])
        x = np.frombuffer(bytes(_PAD) + b"\0".join(bodies) + bytes(_PAD), np.uint8)
        for t in self.tables:
            rows, at = self.met(x, t).tolist(), 0
            while at < len(rows):  # starts within the edits of the first are verified together
                i, start = rows[at]
                last, k = start, self.allowed(i)
                while at < len(rows) and rows[at][0] == i and rows[at][1] - start <= k:
                    last = rows[at][1]
                    at += 1
                # a start before a text can only be that of its item by edits at the beginning
                ends = {int(np.searchsorted(begin, max(s, 0), "right")) - 1 for s in (start, last, last + k)}
                for d in {min(e, len(bodies) - 1) for e in ends}:
                    s, e = start - int(begin[d]), last - int(begin[d])
                    if s < len(bodies[d]):
                        self.verify(bodies[d], max(0, s), max(0, e), i, found[d])

    def verify(self, body: bytes, start: int, last: int, i: int, found: dict[int, Places]) -> None:
        k, n = self.allowed(i), len(self.bodies[i])
        first = max(0, start - k)
        distance, end = best_match(self.bodies[i], body[first : last + n + k])
        if distance <= k:
            at = first + max(0, end - n)
            found.setdefault(i, Places(k)).add(at, first + end - at, distance)

    def exact_places(self, bodies: list[bytes], found: list[dict[int, Places]]) -> None:
        """Adds to found the places of the short items."""
        if not self.heads:
            return
        begin = np.concatenate([[0], np.cumsum([len(b) + 1 for b in bodies])])
        x = np.frombuffer(b"\0".join(bodies) + bytes(9), np.uint8)
        # not inside an ASCII word, nor inside a character
        word = ((x >= 48) & (x <= 57)) | ((x >= 97) & (x <= 122))
        starts = (x & 0xC0) != 0x80
        starts[1:] &= ~(word[1:] & word[:-1])
        starts = np.flatnonzero(starts[: begin[-1]])
        text = np.ndarray((len(x) - 7,), "<u8", x.data, 0, (1,))[starts].astype(np.uint64)
        for size, (flags, keys, lengths) in self.heads.items():
            h = text & np.uint64((1 << 8 * size) - 1)
            pos = np.flatnonzero(flags[_slot(h)])
            number = np.minimum(np.searchsorted(keys, h[pos]), len(keys) - 1)
            met = keys[number] == h[pos]
            pos, number = starts[pos[met]], number[met]
            doc = np.searchsorted(begin, pos, "right") - 1
            for d, at, k in zip(doc.tolist(), (pos - begin[doc]).tolist(), number.tolist(), strict=True):
                body, clear = bodies[d], None
                for n in lengths[k]:
                    items = self.short.get(body[at : at + n]) if at + n <= len(body) else None
                    if not items:
                        continue
                    clear = between_words(body, at) if clear is None else clear
                    if clear and between_words(body, at + n):
                        for i in items:
                            found[d].setdefault(i, Places(0)).add(at, n, 0)

    def search(self, bodies: list[bytes]) -> list[dict[int, tuple[int, int, int, int]]]:
        """For each text: item -> (places, first start, its length, least distance)."""
        self.build()
        found: list[dict[int, Places]] = [{} for _ in bodies]
        first, size = 0, 0
        for last, body in enumerate(bodies, 1):
            size += len(body)
            if size >= PASS_BYTES or last == len(bodies):
                self.edited_places(bodies[first:last], found[first:last])
                self.exact_places(bodies[first:last], found[first:last])
                first, size = last, 0
        return [{i: p.row() for i, p in f.items()} for f in found]


def item_blocks(benchmark: DataFrame, edits: float = EDITS, block_bytes: int = BLOCK_BYTES, id_col: str = "item_id", text_col: str = "text") -> Iterator[Items]:
    """The benchmark in blocks of about block_bytes, so that what is broadcast is bounded."""
    rows = benchmark.select(F.col(id_col).alias("item"), F.col(text_col).alias("text")).filter("text IS NOT NULL")
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    blocks = -(-size // block_bytes)
    for b in range(blocks):
        part = rows.filter(F.pmod(F.xxhash64("text", "item"), F.lit(blocks)) == b).collect()
        part = [(r["item"], normalised(r["text"])) for r in part]
        part = sorted(((i, t) for i, t in part if t), key=lambda x: (x[0] is not None, *([x[0]] if x[0] is not None else []), x[1]))
        if part:
            yield Items([i for i, _ in part], [t for _, t in part], edits)


def searched(batches: Iterator[pa.RecordBatch], items: Items) -> Iterator[tuple[pa.RecordBatch, list[dict]]]:
    """Each batch with what its texts hold; several small batches are searched together."""
    group: list[pa.RecordBatch] = []
    bodies: list[bytes] = []
    size = 0

    def flush() -> Iterator[tuple[pa.RecordBatch, list[dict]]]:
        found, at = items.search(bodies), 0
        for b in group:
            yield b, found[at : at + b.num_rows]
            at += b.num_rows

    for b in batches:
        group.append(b)
        bodies += [normalised(t) for t in texts(b)]
        size += b.nbytes
        if size >= GROUP_BYTES:
            yield from flush()
            group, bodies, size = [], [], 0
    if group:
        yield from flush()


def _shared(docs: DataFrame, items: Items):
    """The block as a broadcast value: a worker that runs several tasks builds its tables once."""
    return docs.sparkSession.sparkContext.broadcast(items)


def benchmark_hits(docs: DataFrame, benchmark: DataFrame, edits: float = EDITS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, item_id, places, start, length, distance) of each document and item that it holds; start and
    length are bytes of the normalised text, those of the first place, and distance is the least of all."""
    kind, item_kind = docs.schema["doc_id"].dataType.simpleString(), benchmark.schema["item_id"].dataType.simpleString()
    schema = f"doc_id {kind}, item_id {item_kind}, places int, start long, length long, distance int"
    item_type = to_arrow_type(benchmark.schema["item_id"].dataType)
    out = docs.sparkSession.createDataFrame([], schema)
    for items in item_blocks(benchmark, edits, block_bytes):

        def run(batches: Iterator[pa.RecordBatch], block=_shared(docs, items)) -> Iterator[pa.RecordBatch]:
            items = block.value
            for b, found in searched(batches, items):
                rows = [(d, items.ids[i], *x) for d, hits in zip(b.column("doc_id").to_pylist(), found, strict=True) for i, x in sorted(hits.items())]
                if rows:
                    cols = [list(c) for c in zip(*rows, strict=True)]
                    types = (b.schema.field("doc_id").type, item_type, pa.int32(), pa.int64(), pa.int64(), pa.int32())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["doc_id", "item_id", "places", "start", "length", "distance"])

        out = out.union(map_rows(docs.select("doc_id", "text"), run, schema))
    return out


def without_hits(docs: DataFrame, benchmark: DataFrame, edits: float = EDITS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of docs, all columns, that hold no item of the benchmark."""
    for items in item_blocks(benchmark, edits, block_bytes):

        def run(batches: Iterator[pa.RecordBatch], block=_shared(docs, items)) -> Iterator[pa.RecordBatch]:
            for b, found in searched(batches, block.value):
                yield b.filter(pa.array([not x for x in found], pa.bool_()))

        docs = map_rows(docs, run, docs.schema)
    return docs
