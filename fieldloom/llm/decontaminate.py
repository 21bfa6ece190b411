"""Benchmark decontamination by the q-gram lemma.

Texts and items are compared in lower case with runs of white space as one blank. A region of a text that is within k
edits of an item of m characters shares at least m + 1 - q - k * q of its q-grams, and these lie on diagonals (place in
the text less place in the item) no more than k apart. Shared q-grams are counted in overlapping bands of diagonals of
twice that width, each starting k + 1 after the one before, so that every window of k + 1 diagonals lies within one
band. Bands in which as many of the item's q-grams occur are verified by banded alignment: bit-parallel edit distances
of the item along the band's text tell whether a region is there, and a table of costs tells where it begins and ends.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import as_rows, bounded_batches, written

#: Characters of items whose q-grams a worker holds at a time (about 30 bytes each); larger benchmarks are dealt into groups.
GROUP_CHARS = 4_000_000
#: Characters of texts that a worker holds to search them for one group after the other.
HELD_CHARS = 8_000_000
#: Characters of items that go to the tasks at once; only beyond that are the documents read again.
SENT_CHARS = 32_000_000
#: Characters of a text that are searched at a time, besides the overlap.
WINDOW = 65_536
#: Largest q; the bound must stay above zero, so that items with a tight budget per character take less.
LARGEST_Q = 12
_A = np.uint64(0x9E3779B97F4A7C15)
_SPACE = re.compile(r"\s")


def normalised(text: str) -> tuple[np.ndarray, np.ndarray | None]:
    """Code points in lower case with single blanks, and the place in the text of each (None: its own)."""
    low = text.lower()
    if len(low) != len(text):  # a few letters grow
        low = "".join(c if len(x := c.lower()) != 1 else x for c in text)
    c = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), "<u4")
    blank = (c == 32) | ((c >= 9) & (c <= 13)) | (c == 0xA0) | (c == 0x3000)
    if blank.any():
        drop = np.zeros(len(c), bool)
        drop[1:] = blank[1:] & blank[:-1]
        if (blank & (c != 32)).any() or drop.any():
            c = np.where(blank, 32, c).astype("<u4")[~drop]
            return c, np.flatnonzero(~drop)
    return c, None


def grams(c: np.ndarray, q: int) -> np.ndarray:
    """64-bit hashes of the q-grams, by doubling."""
    if len(c) < q:
        return np.empty(0, np.uint64)
    h, width = (c.astype(np.uint64) + np.uint64(1)) * _A, 1
    out, done = None, 0
    while True:
        if q & width:
            part = h[done : done + len(c) - q + 1]
            out = part.copy() if out is None else (out ^ (out >> np.uint64(31))) * _A + part
            done += width
        if done == q:
            return (out ^ (out >> np.uint64(32))) * _A
        h = (h[:-width] ^ (h[:-width] >> np.uint64(29))) * _A + h[width:]
        width *= 2


@dataclass
class Item:
    id: object
    chars: np.ndarray
    edits: int
    q: int
    least: int
    masks: dict[int, int]


def plan(item_id: object, text: str, rate: Fraction, shortest: int) -> Item | None:
    """q is the largest up to LARGEST_Q for which the lemma still asks for at least an eighth of the item's q-grams."""
    c, _ = normalised(text.strip())
    m, k = len(c), int(len(c) * rate)
    if m < max(1, shortest):
        return None
    for q in range(min(LARGEST_Q, m), 0, -1):
        if (least := m + 1 - q - k * q) >= max(1, (m + 1 - q) // 8):
            return Item(item_id, c, k, q, least, masks(c))
    return None


def masks(chars: np.ndarray) -> dict[int, int]:
    """For each character the item's places that hold it, as bits."""
    out: dict[int, int] = {}
    for k, c in enumerate(chars.tolist()):
        out[c] = out.get(c, 0) | 1 << k
    return out


def holds(at: dict[int, int], m: int, text: np.ndarray, k: int) -> bool:
    """Whether a part of the text is within k edits of the item: costs of the last row by vertical differences in bits."""
    every, last = (1 << m) - 1, 1 << (m - 1)
    up, down, cost = every, 0, m
    for c in text.tolist():
        same = at.get(c, 0)
        diagonal = (((same & up) + up) ^ up) | same | down
        right, left = (down | ~(diagonal | up)) & every, up & diagonal
        if right & last:
            cost += 1
        elif left & last:
            cost -= 1
            if cost <= k:
                return True
        right = (right << 1) & every
        down, up = right & (same | down), ((left << 1) | ~(right | same | down)) & every
    return m <= k


def align(item: np.ndarray, text: np.ndarray, k: int) -> tuple[int, int, int] | None:
    """(start, end, edits) of the part of text nearest to the item, the first of exact ones, or None beyond k edits."""
    n, raw, own = len(text), text.tobytes(), item.tobytes()
    same = raw.find(own)
    while same >= 0:
        if same % 4 == 0:
            return same // 4, same // 4 + len(item), 0
        same = raw.find(own, same + 1)
    at = np.arange(n + 1)
    cost, start = np.zeros(n + 1, np.int64), at.copy()
    for i, c in enumerate(item.tolist(), 1):
        sub = cost[:-1] + (text != c)
        up = cost[1:] + 1
        new = np.concatenate([[i], np.minimum(sub, up)])
        begin = np.concatenate([[0], np.where(sub <= up, start[:-1], start[1:])])
        # insertions run from left to right: the least of cost less place so far
        low = new - at
        best = np.minimum.accumulate(low)
        origin = np.maximum.accumulate(np.where(low == best, at, 0))
        cost, start = best + at, begin[origin]
        if cost.min() > k:  # costs of a row only grow further down
            return None
    end = int(cost.argmin())
    return (int(start[end]), end, int(cost[end])) if cost[end] <= k else None


class Searcher:
    """Regions of texts near items. All q-grams of all items are looked up at once by their size."""

    def __init__(self, items: list[tuple[object, str]], rate: Fraction, shortest: int):
        self.items = [p for i, t in items if (p := plan(i, t or "", rate, shortest))]
        self.tables = []
        self.width = np.array([p.edits + 1 for p in self.items], np.int64)
        self.least = np.array([p.least for p in self.items], np.int64)
        self.longest = max((len(p.chars) + p.edits for p in self.items), default=0)
        for q in sorted({p.q for p in self.items}):
            own = [k for k, p in enumerate(self.items) if p.q == q]
            codes = [grams(self.items[k].chars, q) for k in own]
            code = np.concatenate(codes)
            owner = np.repeat(np.array(own, np.int32), [len(c) for c in codes])
            place = np.concatenate([np.arange(len(c), dtype=np.int32) for c in codes])
            order = np.argsort(code, kind="stable")
            shift = np.uint64(64 - max(16, int(len(code) * 8).bit_length()))
            filled = np.zeros(1 << (64 - int(shift)), bool)
            filled[(code >> shift).astype(np.int64)] = True
            self.tables.append((q, code[order], owner[order], place[order], filled, shift))

    def hits(self, c: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(item, first diagonal, last diagonal) of bands that reach the item's bound.

        Hits are counted in bands of k + 1 diagonals, only those that have any; two neighbours make one of the overlapping
        bands. In a band that reaches the bound, each of the item's q-grams counts once.
        """
        reach = self.longest
        for q, code, owner, place, filled, shift in self.tables:
            g = grams(c, q)
            at = np.flatnonzero(filled[(g >> shift).astype(np.int64)]) if len(g) else g
            if not len(at):
                continue
            lo, hi = np.searchsorted(code, g[at], "left"), np.searchsorted(code, g[at], "right")
            at, lo, n = at[hi > lo], lo[hi > lo], (hi - lo)[hi > lo]
            if not len(n):
                continue
            rows = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
            item, own = owner[rows].astype(np.int64), place[rows]
            stride = len(c) + 2 * reach + 2
            key = item * stride + (np.repeat(at + reach, n) - own) // self.width[item]
            order = np.argsort(key, kind="stable")
            key, own = key[order], own[order]
            first = np.flatnonzero(np.diff(key, prepend=-1))
            bands, stop = key[first], np.append(first[1:], len(key))
            both = stop.copy()  # the end of the next band, if it is a neighbour
            near = np.flatnonzero(np.diff(bands) == 1)
            both[near] = stop[near + 1]
            item = bands // stride
            for k in np.flatnonzero(both - first >= self.least[item]).tolist():
                i = int(item[k])
                if len(np.unique(own[first[k] : both[k]])) >= self.least[i]:
                    low = int(bands[k] % stride) * int(self.width[i]) - reach
                    yield i, low, low + 2 * int(self.width[i]) - 1

    def windows(self, n: int) -> Iterator[tuple[int, int]]:
        """Overlapping parts of a text, so that every region lies within one."""
        over = 3 * self.longest
        for a in range(0, max(1, n - over), WINDOW):
            yield a, min(n, a + WINDOW + over)

    def __call__(self, text: str) -> list[tuple[object, int, int, int, int]]:
        """(item id, start, end, edits, item's characters), places in the text as it is; overlapping finds of an item once."""
        c, places = normalised(text)
        found: dict[int, list[tuple[int, int, int]]] = {}
        for begin, stop in self.windows(len(c)):
            for item, low, high in self.hits(c[begin:stop]):
                p = self.items[item]
                a, b = max(0, begin + low - p.edits), min(len(c), begin + high + len(p.chars) + p.edits)
                if any(begin + low - p.edits <= s <= begin + high + p.edits for _, s, _ in found.get(item, ())):
                    continue  # the neighbouring band's find: another one here would overlap it
                if a < b and holds(p.masks, len(p.chars), c[a:b], p.edits) and (hit := align(p.chars, c[a:b], p.edits)):
                    found.setdefault(item, []).append((hit[2], a + hit[0], a + hit[1]))
        out = []
        for item, hits in found.items():
            taken: list[tuple[int, int, int]] = []
            for e, s, t in sorted(hits):
                if all(t <= x or y <= s for _, x, y in taken):
                    taken.append((e, s, t))
            for e, s, t in taken:
                start, end = (s, t) if places is None else (int(places[s]), int(places[t - 1]) + 1)
                out.append((self.items[item].id, start, end, e, len(self.items[item].chars)))
        return sorted(out, key=lambda x: (x[1], x[2], str(x[0])))


def _search(groups: list[list[tuple[object, str]]], rate: Fraction, shortest: int, item_type: pa.DataType):
    """Documents are read once: with several groups of items, a share of them is held while each group goes by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(search: Searcher, batch: pa.RecordBatch) -> pa.RecordBatch:
            out = [(k, *hit) for k, t in enumerate(batch.column(1).to_pylist()) if t for hit in search(t)]
            columns = list(zip(*out, strict=True)) if out else [()] * 6
            return pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(columns[0], pa.int64())), pa.array(columns[1], item_type), *(pa.array(x, pa.int32()) for x in columns[2:])],
                ["doc_id", "item_id", "start", "end", "edits", "item_chars"],
            )

        if len(groups) == 1:
            search = Searcher(groups[0], rate, shortest)
            for batch in batches:
                yield found(search, batch)
            return
        held: list[pa.RecordBatch] = []

        def searched() -> Iterator[pa.RecordBatch]:
            for rows in groups if held else ():
                search = Searcher(rows, rate, shortest)
                for batch in held:
                    yield found(search, batch)
            held.clear()

        for batch in batches:
            held.append(batch)
            if sum(b.nbytes for b in held) > HELD_CHARS:
                yield from searched()
        yield from searched()

    return run


def _dealt(rows: list[tuple[object, str]], size: int) -> list[list[tuple[object, str]]]:
    """The rows in groups of about size characters."""
    groups, room = [[]], size
    for row in rows:
        if room < 0:
            groups.append([])
            room = size
        groups[-1].append(row)
        room -= len(row[1])
    return groups


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, rate: str = "0.1", shortest: int = 20,
    id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """doc_id, item_id, start, end, edits, item_chars: a row for each region of a document within rate * m edits of an item.

    start and end (exclusive) are code points of the document's text. Null, empty and shorter items than `shortest`
    characters are not searched; items with equal texts are found each; repeated documents have their rows each; null
    and empty texts have none. Ids are of any type that Arrow has. The benchmark is checked for its size: a worker holds
    the q-grams of GROUP_CHARS of its characters at a time, and up to SENT_CHARS the documents are read once.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    items = benchmark.select(F.col(item_col).alias("item_id"), F.col(item_text_col).alias("text")).where(F.length("text") >= shortest)
    total = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    passes = max(1, -(-total // SENT_CHARS))
    id_type, item_type = (df.schema[c].dataType for df, c in ((source, "doc_id"), (items, "item_id")))
    schema = f"doc_id {id_type.simpleString()}, item_id {item_type.simpleString()}, start int, end int, edits int, item_chars int"
    found = None
    for k in range(passes):
        part = items if passes == 1 else items.where(F.pmod(F.xxhash64("text"), F.lit(passes)) == k)
        rows = sorted(((r[0], r[1]) for r in part.collect()), key=lambda r: (str(r[0]), r[1]))
        one = source.mapInArrow(_search(_dealt(rows, GROUP_CHARS), Fraction(rate), shortest, to_arrow_type(item_type)), schema)
        one = one if passes == 1 else written(one, f"leaks-{k}")
        found = one if found is None else found.unionByName(one)
    return found


def drop_leaked(docs: DataFrame, benchmark: DataFrame, rate: str = "0.1", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, all columns, without the rows that hold a region near an item. Rows with a null id are judged by their text.

    Null and empty texts stay, repeated rows share their verdict; an empty benchmark drops nothing; no rows: no rows.
    """
    row = F.col("row")
    key = F.concat_ws(":", F.coalesce(row[id_col].cast("string"), F.lit("null")), F.xxhash64(row[text_col]).cast("string"))
    keyed = as_rows(docs).withColumn("key", key)
    leaks = find_leaks(keyed.select("key", row[text_col].alias("text")), benchmark, rate, id_col="key").select(F.col("doc_id").alias("key")).distinct()
    return keyed.join(written(leaks, "leaked"), "key", "left_anti").select("row.*")
