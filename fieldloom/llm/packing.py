"""Packing of tokenized documents into sequences by a grouping genetic algorithm on islands.

Pieces are dealt into blocks of a few thousand by a hash. Several islands evolve groupings of each block: crossover
injects whole well-filled bins of one parent into the other, drops the bins that then hold a piece twice, and
best-fits the displaced pieces. Between epochs each island receives its neighbour's elite. A block is done once its
bins reach the bound ceil(tokens / capacity). Afterwards the emptiest bins of each block are opened again and their
pieces are packed together with those of other blocks, in ever fewer blocks.
"""

from __future__ import annotations

import json
import random
import re
import struct
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, written

#: Distinct pieces that a worker remembers before it starts anew.
MEMORY = 800_000
#: Expected pieces of a block.
BLOCK = 3000
#: Sequences' worth of tokens that a block has at least.
FULL = 64
#: Share of a block's bins, the emptiest ones, that are packed again with those of other blocks.
REOPENED = 0.05
ISLANDS = 3
#: Islands that a task evolves one after the other.
ISLANDS_IN_TASK = 16
EPOCHS = 2

_SPACE = re.compile(r"[ \n\t\r]+")
# Characters below U+0180 but for controls and a dotted capital I: composed, with one lower case each, and of known class.
_PLAIN = re.compile(r"[\t\n\r -~\xa0-\u012f\u0131-\u017f]*")
_LETTERS = "a-zA-Z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u017f"
_DIGITS = "0-9\xb2\xb3\xb9\xbc-\xbe"
_PIECE = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_DIGITS}]|[^ \t\n\r\xa0{_LETTERS}{_DIGITS}]+")


def byte_letters() -> dict[int, str]:
    """The letters that byte-level models write for bytes: printable ones for themselves, the others from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}


class WordIds:
    """Ids of texts, piece by piece.

    The tokenizer must compose, lower the case, drop white space and cut by letters, single digits and other signs, so
    that no token spans two pieces. Texts of plain characters are cut here and each distinct piece goes through the
    library's model once; any other word (or one that may hold a special string) goes through the library as it is.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        spec = json.load(open(path, encoding="utf-8"))
        cut = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        kinds = [n["type"] for n in spec["normalizer"]["normalizers"]]
        if kinds != ["NFC", "Replace", "Lowercase"] or cut != r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+":
            raise ValueError("a lower-case word tokenizer that drops white space is needed")
        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.letters = self.tokenizer.model, byte_letters()
        self.pieces: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}

    def _learn(self, piece: str) -> bytes:
        if len(self.pieces) > MEMORY:
            self.pieces.clear()
        spelled = piece.encode().decode("latin-1").translate(self.letters)
        ids = self.pieces[piece] = struct.pack(f"<{len(t := self.model.tokenize(spelled))}I", *[x.id for x in t])
        return ids

    def _plain(self, text: str) -> bytes:
        pieces = _PIECE.findall(text.lower())
        ids = list(map(self.pieces.get, pieces))
        if None in ids:
            for k, x in enumerate(ids):
                if x is None:
                    ids[k] = self.pieces.get(pieces[k]) or self._learn(pieces[k])
        return b"".join(ids)

    def _word(self, word: str) -> bytes:
        if _PLAIN.fullmatch(word) and "<|" not in word:
            return self._plain(word)
        if (ids := self.words.get(word)) is None:
            if len(self.words) > MEMORY:
                self.words.clear()
            ids = self.words[word] = np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes()
        return ids

    def __call__(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        if _PLAIN.fullmatch(text) and "<|" not in text:
            return self._plain(text)
        return b"".join(map(self._word, _SPACE.split(text)))


def _cut_pieces(path: str, capacity: int, end_id: int):
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = WordIds(path)
        for batch in batches:
            at, piece, start, length, crc = [], [], [], [], []
            for k, text in enumerate(batch.column(1).to_pylist()):
                own = ids(text or "") + end
                for p, b in enumerate(range(0, len(own), 4 * capacity)):
                    part = own[b : b + 4 * capacity]
                    at.append(k)
                    piece.append(p)
                    start.append(b // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return run


def cut_pieces(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of each document's ids and the end id, cut at the capacity. Null text: empty."""
    bounded_batches(docs.sparkSession)
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return source.mapInArrow(_cut_pieces(tokenizer, capacity, end_id), f"doc_id {source.schema['doc_id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long")


# --- one island ------------------------------------------------------------------------------------------------------


def best_fit(lengths: list[int], items: list[int], capacity: int, bins: list[list[int]]) -> list[list[int]]:
    """Adds items, longest first, each to the fullest bin that still takes it."""
    left = sorted((capacity - sum(lengths[i] for i in b), k) for k, b in enumerate(bins))
    for i in sorted(items, key=lambda i: (-lengths[i], i)):
        at = bisect_left(left, (lengths[i], -1))
        if at == len(left):
            room, k = capacity, len(bins)
            bins.append([])
        else:
            room, k = left.pop(at)
        bins[k].append(i)
        if room > lengths[i]:
            insort(left, (room - lengths[i], k))
    return bins


def _fitness(fills: list[int], capacity: int) -> float:
    """Falkenauer's measure: mean squared fill; higher for fewer and fuller bins."""
    return sum((f / capacity) ** 2 for f in fills) / max(1, len(fills))


def _crossover(rng: random.Random, a: list[list[int]], b: list[list[int]], lengths: list[int], capacity: int) -> list[list[int]]:
    fills = [sum(lengths[i] for i in x) for x in b]
    full = sorted(range(len(b)), key=lambda k: -fills[k])[: max(1, len(b) // 2)]
    given = [b[k] for k in rng.sample(full, max(1, len(full) // 2))]
    taken = {i for x in given for i in x}
    kept, loose = [], []
    for x in a:
        if taken.isdisjoint(x):
            kept.append(x[:])
        else:
            loose += [i for i in x if i not in taken]
    return best_fit(lengths, loose, capacity, kept + [x[:] for x in given])


def _mutate(rng: random.Random, a: list[list[int]], lengths: list[int], capacity: int) -> list[list[int]]:
    """Opens the emptiest bin and a few others and best-fits their pieces in random pairs' order."""
    fills = [sum(lengths[i] for i in x) for x in a]
    opened = {min(range(len(a)), key=fills.__getitem__), *rng.sample(range(len(a)), min(len(a), 3 + len(a) // 20))}
    loose = [i for k in opened for i in a[k]]
    return best_fit(lengths, loose, capacity, [x[:] for k, x in enumerate(a) if k not in opened])


def evolve(lengths: list[int], capacity: int, seed: int, population: list[list[list[int]]], generations: int, size: int = 5) -> list[list[list[int]]]:
    """The population after some generations, best first; it ends early at the lower bound."""
    rng, bound = random.Random(seed), -(-sum(lengths) // capacity)

    def rank(x: list[list[int]]) -> tuple[int, float]:
        return len(x), -_fitness([sum(lengths[i] for i in b) for b in x], capacity)

    pool = sorted(population or [best_fit(lengths, list(range(len(lengths))), capacity, [])], key=rank)
    while len(pool) < size and len(pool[0]) > bound:
        head = list(range(len(lengths)))
        rng.shuffle(head)
        cut = rng.randrange(len(head) // 2 + 1)
        pool.append(best_fit(lengths, head[cut:], capacity, best_fit(lengths, head[:cut], capacity, [])))
    pool.sort(key=rank)
    for _ in range(generations):
        if len(pool[0]) <= bound or len(pool) < 2:
            break
        a, b = rng.sample(pool, 2)
        child = _crossover(rng, a, b, lengths, capacity)
        if rng.random() < 0.5:
            child = _mutate(rng, child, lengths, capacity)
        pool = sorted([*pool, child], key=rank)[:size]
    return pool


def _as_labels(bins: list[list[int]], n: int) -> list[int]:
    out = [0] * n
    for k, b in enumerate(bins):
        for i in b:
            out[i] = k
    return out


def _as_bins(labels) -> list[list[int]]:
    out: list[list[int]] = [[] for _ in range(max(labels, default=-1) + 1)]
    for i, k in enumerate(labels):
        out[k].append(i)
    return out


def _island_epoch(capacity: int, generations: int, epoch: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for block, island, lengths, groupings in zip(pdf["block"], pdf["island"], pdf["lengths"], pdf["groupings"], strict=True):
                lengths = [int(x) for x in lengths]
                start = [_as_bins([int(k) for k in g]) for g in groupings] if groupings is not None else []
                if island and not start:  # the first island starts from plain best fit, the others from shuffled orders
                    rng = random.Random(hash((block, island)))
                    order = list(range(len(lengths)))
                    rng.shuffle(order)
                    start = [best_fit(lengths, order[len(order) // 3 :], capacity, best_fit(lengths, order[: len(order) // 3], capacity, []))]
                pool = evolve(lengths, capacity, hash((epoch, block, island)), start, generations)
                out.append((block, island, lengths, [_as_labels(x, len(lengths)) for x in pool[:2]], len(pool[0])))
            yield pd.DataFrame(out, columns=["block", "island", "lengths", "groupings", "bins"])

    return run


_ISLAND = "block long, island int, lengths array<int>, groupings array<array<int>>, bins int"


def group_blocks(blocks: DataFrame, n: int, capacity: int, islands: int = ISLANDS, epochs: int = EPOCHS, generations: int = 24) -> DataFrame:
    """block, labels (a bin number for each length) for the n blocks of (block long, lengths array<int>)."""
    tasks = max(1, n * islands // ISLANDS_IN_TASK)
    state = (
        blocks.select("block", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"), "lengths")
        .withColumn("groupings", F.lit(None).cast("array<array<int>>"))
        .repartition(tasks, "block", "island")
        .mapInPandas(_island_epoch(capacity, generations, 0), _ISLAND)
    )
    for epoch in range(1, epochs):  # each island goes on with its own elite and its neighbour's best
        ring = state.groupBy("block").agg(F.first("lengths").alias("lengths"), F.sort_array(F.collect_list(F.struct("island", "groupings"))).alias("ring"))
        state = (
            ring.select("block", "lengths", "ring", F.posexplode("ring").alias("island", "own"))
            .select("block", "island", "lengths", F.concat("own.groupings", F.slice(F.element_at("ring", (F.col("island") + islands - 1) % islands + 1)["groupings"], 1, 1)).alias("groupings"))
            .repartition(tasks, "block", "island")
            .mapInPandas(_island_epoch(capacity, generations, epoch), _ISLAND)
        )
    best = state.groupBy("block").agg(F.min(F.struct("bins", "island", "groupings")).alias("best"))
    return best.select("block", F.col("best.groupings")[0].alias("labels"))


def _one_round(pieces: DataFrame, blocks: int, capacity: int, level: int) -> DataFrame:
    """pieces with their sequence_id, packed within hash blocks."""
    item = F.struct("length", "doc_id", "piece", "start", "ids_crc32")
    dealt = (
        pieces.withColumn("block", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.monotonically_increasing_id(), F.lit(level)), F.lit(blocks)))
        .groupBy("block").agg(F.sort_array(F.collect_list(item), asc=False).alias("items"))
    )
    dealt = written(dealt, f"pack-blocks-{level}")
    labels = group_blocks(dealt.select("block", F.col("items.length").cast("array<int>").alias("lengths")), blocks, capacity)
    placed = (
        dealt.join(labels, "block")
        .select("block", F.inline(F.arrays_zip("items", "labels")).alias("item", "label"))
        .select("item.*", (F.lit(level << 56) + (F.col("block") * (1 << 20)) + F.col("label")).alias("sequence_id"))
    )
    return written(placed, f"pack-placed-{level}")


def pack(pieces: DataFrame, capacity: int = 4096) -> DataFrame:
    """Pieces (doc_id, piece, start, length, ids_crc32) with sequence_id and offset, gapless from 0.

    Every piece is placed once, repeated rows and null ids included; no length may exceed the capacity. No pieces: no
    rows. Sequence numbers tell the round, block and bin.
    """
    pieces = pieces.select("doc_id", "piece", "start", "length", "ids_crc32")
    done, level, most = None, 0, 1 << 31
    while True:
        n, tokens = pieces.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
        # enough pieces for a good search, and enough sequences that reopening one leaves little; fewer blocks each round
        blocks = max(1, min(-(-n // BLOCK), tokens // (FULL * capacity), most))
        placed = _one_round(pieces, blocks, capacity, level)
        if blocks == 1:
            rest = None
        else:  # each block's emptiest bins are opened again; a block has some hundred bins
            fills = placed.groupBy("sequence_id").agg(F.sum("length").alias("fill")).withColumn("block", F.shiftright("sequence_id", 20))
            place = F.row_number().over(Window.partitionBy("block").orderBy("fill", "sequence_id"))
            last = F.ceil(F.count("*").over(Window.partitionBy("block")) * REOPENED)
            opened = written(fills.withColumns({"place": place, "last": last}).where((F.col("fill") < capacity) & (F.col("place") <= F.col("last"))).select("sequence_id"), f"pack-open-{level}")
            rest = placed.join(opened, "sequence_id", "left_semi").drop("sequence_id")
            placed = placed.join(opened, "sequence_id", "left_anti")
        done = placed if done is None else done.unionByName(placed)
        if rest is None:
            break
        pieces = written(rest, f"pack-rest-{level}")
        level, most = level + 1, blocks // 2
    ordered = F.sort_array(F.collect_list(F.struct(-F.col("length"), "doc_id", "piece", "start", "length", "ids_crc32")))
    bins = done.groupBy("sequence_id").agg(ordered.alias("items"))
    starts = F.aggregate(
        "items", F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<bigint>").alias("all")),
        lambda a, x: F.struct((a["at"] + x["length"]).alias("at"), F.concat(a["all"], F.array(a["at"])).alias("all")), lambda a: a["all"],
    )
    return bins.select("sequence_id", F.inline(F.arrays_zip("items", starts.alias("starts"))).alias("i", "offset")).select(
        "i.doc_id", "i.piece", "i.start", "i.length", "i.ids_crc32", "sequence_id", "offset"
    )


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents cut and packed. Null, empty and blank texts: a piece of the end id alone."""
    return pack(written(cut_pieces(docs, tokenizer, capacity, end_id, id_col, text_col), "pieces"), capacity)
