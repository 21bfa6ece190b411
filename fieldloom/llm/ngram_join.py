"""Jaccard self-join of documents on word n-grams by MinHash banding.

Documents of equal n-gram sets form a copy class and go on as one. Band and row counts are chosen for the target
recall; class signatures are dealt by band hash, and classes that meet in a band are candidates. For locality, classes
that are connected by such meetings form groups, cut into blocks; a class goes to the cell of its own and another block
only if it meets a class of that block in a band, so that the work is bounded by the candidates and not by the group's
square. All pairs of a cell are verified on the full n-gram sets; results are each class's number of links and the
cell's linked sets, never the pairs. Linked classes then form the near-duplicate classes.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.graph import connected_components
from .common import as_rows, bounded_batches, heavy_keys, join_heavy, written

#: Expected classes of a verification block.
BLOCK = 128
#: Distinct words whose hashes a worker remembers before it starts anew.
MEMORY = 1_000_000

_M1, _M2, _P = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def choose_bands(threshold: float, recall: float, hashes: int) -> tuple[int, int]:
    """(bands, rows): the most rows, thus the fewest false candidates, that reach the recall at the threshold within hashes."""
    best = None
    for rows in range(1, hashes + 1):
        bands = max(1, math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))) if threshold**rows < 1 else 1
        if bands * rows <= hashes:
            best = (bands, rows)
    if best is None:
        raise ValueError("no banding reaches this recall with so few hashes")
    return best


class Grams:
    """Sets of 64-bit hashes of word n-grams. Words end at blanks and at the control characters 9 to 13."""

    def __init__(self, n: int):
        self.n, self.words = n, {}

    def __call__(self, text: str) -> np.ndarray:
        """Sorted distinct hashes; a text of fewer than n words is one n-gram, one without words none."""
        import xxhash

        words = text.encode("utf-8", "surrogatepass").split()
        if not words:
            return np.empty(0, np.uint64)
        got = list(map(self.words.get, words))
        if None in got:
            if len(self.words) > MEMORY:
                self.words.clear()
            for k, x in enumerate(got):
                if x is None:
                    got[k] = self.words[words[k]] = xxhash.xxh64_intdigest(words[k])
        w = np.array(got, np.uint64)
        n = min(self.n, len(w))
        h = np.full(len(w) - n + 1, n, np.uint64)
        for k in range(n):
            h = (h ^ w[k : len(w) - n + 1 + k]) * _M1
            h ^= h >> np.uint64(29)
        h = (h ^ (h >> np.uint64(30))) * _M2
        return np.unique(h ^ (h >> np.uint64(31)))


def _factors(hashes: int) -> np.ndarray:
    """Odd multipliers from a fixed sequence."""
    x = (np.arange(1, hashes + 1, dtype=np.uint64) * _P) ^ _M1
    x = (x ^ (x >> np.uint64(30))) * _M1
    return ((x ^ (x >> np.uint64(27))) * _M2) | np.uint64(1)


def min_hashes(grams: np.ndarray, factors: np.ndarray) -> np.ndarray:
    out = np.full(len(factors), np.iinfo(np.uint64).max, np.uint64)
    for b in range(0, len(grams), 4096):
        part = grams[b : b + 4096, None] * factors[None, :]
        part ^= part >> np.uint64(32)
        np.minimum(out, (part * _P).min(axis=0), out=out)
    return out


def _sign(n: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams_of, factors = Grams(n), _factors(bands * rows)
        for batch in batches:
            digests, signs = [], []
            for text in batch.column(2).to_pylist():
                grams = grams_of(text or "")
                digests.append(hashlib.blake2b(grams.tobytes(), digest_size=16).digest())
                if not len(grams):
                    signs.append([])
                    continue
                mins = min_hashes(grams, factors).reshape(bands, rows)
                band = np.arange(bands, dtype=np.uint64) * _P
                for k in range(rows):
                    band = (band ^ mins[:, k]) * _M2
                    band ^= band >> np.uint64(31)
                signs.append(band.view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(digests, pa.binary()), pa.array(signs, pa.list_(pa.int64()))], ["doc_id", "text_hash", "copy", "bands"])

    return run


def _gram_rows(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams_of = Grams(n)
        for batch in batches:
            grams = pa.array([grams_of(t or "").tobytes() for t in batch.column("text").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], grams], ["group", "copy", "blocks", "own", "grams"])

    return run


def _linked(sets: list[np.ndarray], cut: int, ratio: Fraction) -> np.ndarray:
    """Which pairs reach the ratio: within the sets when cut is 0, else between the first cut and the others."""
    sizes = np.array([len(s) for s in sets], np.int64)
    _, columns, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rows = np.repeat(np.arange(len(sets)), sizes)
    shared = times[columns] > 1  # the others are in one set only
    rows, columns = rows[shared], np.unique(columns[shared], return_inverse=True)[1]
    order = np.argsort(columns, kind="stable")
    rows, columns = rows[order], columns[order]
    a, b = (len(sets), 0) if cut == 0 else (cut, cut)
    both = np.zeros((a, len(sets) - b), np.float64)
    width = 4096
    for lo in range(0, int(columns[-1]) + 1 if len(columns) else 0, width):
        x, y = np.searchsorted(columns, [lo, lo + width])
        m = np.zeros((len(sets), width), np.float32)
        m[rows[x:y], columns[x:y] - lo] = 1
        both += m[:a] @ m[b:].T
    both = np.rint(both).astype(np.int64)
    union = sizes[:a, None] + sizes[None, b:] - both
    linked = both * ratio.denominator >= union * ratio.numerator
    if cut == 0:
        np.fill_diagonal(linked, False)
    else:  # as a square matrix
        square = np.zeros((len(sets), len(sets)), bool)
        square[:cut, cut:], square[cut:, :cut] = linked, linked.T
        linked = square
    return linked


def _roots(linked: np.ndarray) -> np.ndarray:
    """For each row the first row of its component."""
    root = np.full(len(linked), -1)
    for k in range(len(linked)):
        if root[k] >= 0:
            continue
        root[k], front = k, np.array([k])
        while len(front):
            reached = linked[front].any(axis=0) & (root < 0)
            root[reached] = k
            front = np.nonzero(reached)[0]
    return root


def _verify(ratio: Fraction):
    def one(copies: list[bytes], first: list[bool], grams: list[bytes]):
        order = sorted(range(len(copies)), key=lambda k: (not first[k], copies[k]))
        sets = [np.frombuffer(grams[k], np.uint64) for k in order]
        cut = sum(first) if not all(first) else 0
        if not cut and not all(first) or len(sets) < 2:
            return
        linked = _linked(sets, cut, ratio)
        for k, (n, r) in enumerate(zip(linked.sum(axis=1).tolist(), _roots(linked).tolist(), strict=True)):
            if n:
                yield copies[order[k]], n, copies[order[r]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

        def emit(out):
            return pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.binary()), pa.array([o[1] for o in out], pa.int64()), pa.array([o[2] for o in out], pa.binary())], ["copy", "links", "root"])

        out, now, held = [], None, ([], [], [])
        for group, i, j, own, copy, grams in rows():
            if (group, i, j) != now:
                if now:
                    # a block against itself, or one against another of which there may be no member
                    out += one(*held) if now[1] == now[2] or not all(held[1]) else []
                now, held = (group, i, j), ([], [], [])
                if len(out) > 10_000:
                    yield emit(out)
                    out = []
            held[0].append(copy)
            held[1].append(own == i)
            held[2].append(grams)
        if now:
            out += one(*held) if now[1] == now[2] or not all(held[1]) else []
        if out:
            yield emit(out)

    return run


def _candidates(classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(meets, placed). meets: band, copy of the classes that meet others in a band. placed: copy, group, blocks, own:
    the classes connected by meetings, the number of the group's blocks and the class's own one."""
    dealt = classes.select("copy", F.explode("bands").alias("band"))
    pivots = written(dealt.groupBy("band").agg(F.min("copy").alias("pivot"), F.count("*").alias("n")).where("n > 1"), "bands")
    met = join_heavy(dealt, pivots.select("band", "pivot"), ["band"], heavy_keys(pivots, ["band"]), "inner")
    meets = written(met.select("band", "copy", "pivot"), "meets")
    groups = connected_components(meets, "copy", "pivot").select(F.col("node").alias("copy"), F.col("root").alias("group"))
    sizes = written(groups.groupBy("group").agg(F.count("*").alias("n")).withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int")), "groups")
    placed = join_heavy(groups, sizes.select("group", "blocks"), ["group"], heavy_keys(sizes, ["group"]), "inner")
    return meets.select("band", "copy"), written(placed.withColumn("own", F.pmod(F.xxhash64("copy"), "blocks").cast("int")), "placed")


def _cells(meets: DataFrame, placed: DataFrame, members: DataFrame) -> DataFrame:
    """group, i, j, own, copy, grams: the members of each cell, i <= j."""
    small = members.where("blocks = 1").select("group", F.lit(0).alias("i"), F.lit(0).alias("j"), "own", "copy", "grams")
    met = meets.join(placed.where("blocks > 1").select("copy", "own"), "copy")
    present = met.groupBy("band").agg(F.collect_set("own").alias("owns"))  # blocks, not classes
    reach = met.join(present, "band").groupBy("copy").agg(F.array_distinct(F.flatten(F.collect_list("owns"))).alias("others"))  # a class is in few bands
    large = members.where("blocks > 1").join(reach, "copy").withColumn("other", F.explode("others"))
    return small.unionByName(large.select("group", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "copy", "grams"))


def jaccard_classes(
    docs: DataFrame, threshold: str = "0.8", n: int = 5, recall: float = 0.9995, hashes: int = 128, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per row of docs: doc_id, class_id, copy_id, n_links, and text_hash (of the text, 64 bits).

    copy_id: the least doc_id among equal n-gram sets. n_links: the number of other n-gram sets in docs at a Jaccard
    similarity of the threshold or more. class_id: the least doc_id among documents connected by links. Null and empty
    texts have no n-grams: they are copies of each other, without links. A text of fewer than n words counts as one
    n-gram. Null ids: kept, and never the least of a class unless all are null. Repeated rows: a row each, which count
    once as links. threshold: a decimal string, compared exactly.
    """
    bounded_batches(docs.sparkSession)
    ratio = Fraction(threshold)
    bands, rows = choose_bands(float(ratio), recall, hashes)
    source = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("text_hash"), F.col(text_col).alias("text"))
    id_type = source.schema["doc_id"].dataType.simpleString()
    signed = written(source.mapInArrow(_sign(n, bands, rows), f"doc_id {id_type}, text_hash long, copy binary, bands array<long>"), "signatures")

    first = F.min(F.struct(F.isnull("doc_id").alias("none"), "doc_id", "text_hash", "bands"))
    classes = written(signed.groupBy("copy").agg(first.alias("one"), F.count("*").alias("n")).select("copy", "n", "one.*"), "copies")
    meets, placed = _candidates(classes)
    chosen = placed.join(classes.select("copy", "doc_id", "text_hash"), "copy")
    texts = source.withColumnRenamed("doc_id", "d").withColumnRenamed("text_hash", "h")
    sets = (
        chosen.join(texts, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("h")))
        .select("group", "copy", "blocks", "own", "text").mapInArrow(_gram_rows(n), "group binary, copy binary, blocks int, own int, grams binary")
    )
    members = written(sets.dropDuplicates(["copy"]), "members")  # of a class's repeated rows one stands for all
    cells = _cells(meets, placed, members).repartition("group", "i", "j").sortWithinPartitions("group", "i", "j", "copy")
    found = written(cells.mapInArrow(_verify(ratio), "copy binary, links long, root binary"), "links")
    links = found.groupBy("copy").agg(F.sum("links").alias("n_links"))
    near = written(connected_components(found, "copy", "root").select(F.col("node").alias("copy"), "root"), "near")

    least = F.min(F.struct(F.isnull("doc_id").alias("none"), "doc_id"))["doc_id"]
    heads = written(near.join(classes.select("copy", "doc_id"), "copy").groupBy("root").agg(least.alias("class_id"), F.count("*").alias("n")), "heads")
    linked = join_heavy(near, heads.drop("n"), ["root"], heavy_keys(heads, ["root"]), "inner").select("copy", "class_id").join(links, "copy")
    labels = classes.select("copy", F.col("doc_id").alias("copy_id")).join(linked, "copy", "left").select(
        "copy", "copy_id", F.when(F.col("n_links").isNull(), F.col("copy_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links")
    )
    labels = written(labels, "labels")
    return join_heavy(signed.select("doc_id", "text_hash", "copy"), labels, ["copy"], heavy_keys(classes, ["copy"]), "inner").select("doc_id", "class_id", "copy_id", "n_links", "text_hash")


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """docs without the near duplicates of its class head (the least doc_id), all its columns kept.

    Rows of the same id and text are one document; of them the first by all columns, written as JSON, stays. Where the
    head's id names several texts of its class, each stays. Null and
    empty texts are copies of each other: one of them stays. No rows: no rows.
    """
    id_col, text_col = options.get("id_col", "doc_id"), options.get("text_col", "text")
    heads = jaccard_classes(docs, **options).where(F.col("doc_id").eqNullSafe(F.col("class_id"))).select("doc_id", "text_hash").distinct()
    rows = as_rows(docs).select("row", F.col("row")[id_col].alias("id"), F.xxhash64(F.col("row")[text_col]).alias("hash"))
    kept = rows.join(heads, F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("hash") == F.col("text_hash")), "left_semi")
    once = Window.partitionBy("id", "hash").orderBy(F.to_json("row"))
    return kept.withColumn("n", F.row_number().over(once)).where("n = 1").select("row.*")
