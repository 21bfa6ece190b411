"""Token counts by distinct pre-token.

The texts are cut into pre-tokens by the tokenizer's own rules. Pre-tokens that are single entries of the fixed
vocabulary are summed where they are found (the vocabulary is the bounded side of that join). The others are listed by
block of documents: each distinct one with the documents that have it, as often as they have it. The lists are dealt
by a hash of the pre-token, so that all that blocks know of a pre-token meets in one bucket; there its pieces are
counted once, joined to the lists, and the sums by document go back to the block. No ids are kept.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, written

#: Distinct words and pre-tokens that a worker remembers before it starts anew.
MEMORY = 500_000
#: Words from which on a block of documents is closed.
BLOCK_WORDS = 5_000_000
#: And documents; their numbers in a block take two bytes.
BLOCK_DOCS = 60_000

_WORD = re.compile(r"[ \n]?[^ \n]+|[ \n]+?(?=[ \n][^ \n]|\Z)")
_OTHER_SPACE = re.compile(r"[^\S \n]")

NAMES = ["bucket", "block", "n", "pieces", "sizes", "docs", "ids", "n_bytes", "known"]
_SCHEMA = "bucket int, block long, n int, pieces binary, sizes binary, docs binary, ids array<{id}>, n_bytes array<long>, known array<long>"


class Cutter:
    """Pre-tokens of texts, as the tokenizer file has them.

    Words (an optional blank or newline and what follows up to the next one) are cut by the library once each.
    A white-space run gives its last character to the word after it in byte-level patterns, so cutting there
    changes nothing; texts with any other white space are cut by the library as a whole. Special strings in a text
    are one token each, the library's default.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        spec = json.load(open(path, encoding="utf-8"))
        if spec["normalizer"] is not None or spec["pre_tokenizer"]["type"] != "ByteLevel":
            raise ValueError("a byte-level tokenizer without a normalizer is needed")
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError("special strings that absorb their surroundings are not supported")
        special = [t["content"] for t in spec["added_tokens"]]
        self.special = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.forget()

    def forget(self) -> None:
        self.words: dict[str, int] = {}
        self.known: list[int] = []  # by word: tokens of its single-entry pre-tokens
        self.first: list[int] = []  # by word: its first other pre-token, or -1
        self.rest: dict[int, list[int]] = {}  # by word: the further ones
        self.pieces: dict[str, int] = {}
        self.names: list[str] = []

    def learn(self, word: str) -> int:
        known, others = 0, []
        for piece, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(word):
            if piece in self.vocabulary and len(self.tokenizer.model.tokenize(piece)) == 1:
                known += 1
                continue
            if (at := self.pieces.get(piece)) is None:
                at = self.pieces[piece] = len(self.names)
                self.names.append(piece)
            others.append(at)
        at = self.words[word] = len(self.known)
        self.known.append(known)
        self.first.append(others[0] if others else -1)
        if len(others) > 1:
            self.rest[at] = others[1:]
        return at

    def cut(self, text: str) -> tuple[np.ndarray, int]:
        """Word numbers of a text, and its special strings' number."""
        parts, n = [text], 0
        if self.special and self.special.search(text):
            parts = self.special.split(text)
            n = len(parts) - 1
        out: list[int] = []
        for part in parts:
            words = [part] if _OTHER_SPACE.search(part) else _WORD.findall(part)
            got = list(map(self.words.get, words))
            if None in got:
                for k, at in enumerate(got):
                    if at is None:
                        at = self.words.get(words[k])
                        got[k] = self.learn(words[k]) if at is None else at
            out += got
        return np.array(out, np.int32), n


class Block:
    """Documents whose pre-tokens are listed together."""

    def __init__(self, number: int):
        self.number, self.words, self.docs, self.n = number, [], 0, 0

    def add(self, words: np.ndarray) -> None:
        self.words.append(words)
        self.docs += 1
        self.n += len(words)

    def lists(self, cutter: Cutter, buckets: int) -> Iterator[tuple]:
        """bucket, block, number of documents, and for the bucket's distinct pre-tokens: names, list sizes, documents."""
        if not self.n:
            return
        words = np.concatenate(self.words)
        owner = np.repeat(np.arange(self.docs, dtype=np.int64), [len(w) for w in self.words])
        first = np.array(cutter.first, np.int64)[words]
        key = first[first >= 0] << 32 | owner[first >= 0]
        if cutter.rest:
            has = np.zeros(len(cutter.first), bool)
            has[list(cutter.rest)] = True
            more = [(rest, o) for w, o in zip(words[has[words]].tolist(), owner[has[words]].tolist(), strict=True) for rest in cutter.rest[w]]
            if more:
                also = np.array(more, np.int64)
                key = np.concatenate([key, also[:, 0] << 32 | also[:, 1]])
        if not len(key):
            return
        bucket_of = np.fromiter((zlib.crc32(x.encode()) % buckets for x in cutter.names), np.int64, len(cutter.names))
        bucket = bucket_of[key >> 32]
        order = np.lexsort((key, bucket))
        key, bucket = key[order], bucket[order]
        piece, doc = key >> 32, (key & 0xFFFFFFFF).astype("<u2")
        starts = np.nonzero(np.diff(piece, prepend=-1))[0]
        sizes, own = np.diff(np.append(starts, len(key))), bucket[starts]
        edges = np.nonzero(np.diff(own, prepend=-1))[0]
        for lo, hi in zip(edges.tolist(), [*edges[1:].tolist(), len(starts)], strict=True):
            x, y = int(starts[lo]), int(starts[lo] + sizes[lo:hi].sum())
            names = "\n".join([cutter.names[k] for k in piece[starts[lo:hi]].tolist()]).encode()  # blanks and line ends are spelled in letters
            yield int(own[lo]), self.number, self.docs, *(zlib.compress(x, 1) for x in (names, sizes[lo:hi].astype("<i4").tobytes(), doc[x:y].tobytes()))


def _cut_batches(path: str, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter, number = Cutter(path), TaskContext.get().partitionId() << 24
        block, held = Block(number), []

        def close() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            ids, n_bytes, known = (pa.concat_arrays(x) for x in zip(*held, strict=True))
            n, whole = len(ids), lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
            yield pa.RecordBatch.from_arrays([
                pa.array([-1], pa.int32()), pa.array([block.number]), pa.array([n], pa.int32()), *[pa.nulls(1, pa.binary())] * 3,
                whole(ids), whole(n_bytes), whole(known),
            ], NAMES)
            for row in block.lists(cutter, buckets):
                columns = [pa.array([x], t) for x, t in zip(row, (pa.int32(), pa.int64(), pa.int32(), *[pa.binary()] * 3), strict=True)]
                yield pa.RecordBatch.from_arrays([*columns, pa.nulls(1, pa.list_(ids.type)), pa.nulls(1, pa.list_(pa.int64())), pa.nulls(1, pa.list_(pa.int64()))], NAMES)

        for whole_batch in batches:
            for at in range(0, whole_batch.num_rows, 500):
                batch = whole_batch.slice(at, 500)
                if block.n > BLOCK_WORDS or block.docs > BLOCK_DOCS or len(cutter.words) > MEMORY:
                    yield from close()
                    number, held = number + 1, []
                    block = Block(number)
                    if len(cutter.words) > MEMORY:
                        cutter.forget()
                cut = [cutter.cut(t or "") for t in batch.column(1).to_pylist()]
                of = np.array(cutter.known, np.int64)
                for w, _ in cut:
                    block.add(w)
                n_bytes = pc.fill_null(pc.cast(pc.binary_length(batch.column(1)), pa.int64()), 0)
                held.append((batch.column(0), n_bytes, pa.array([int(of[w].sum()) + n for w, n in cut], pa.int64())))
        yield from close()

    return run


def _join_bucket(path: str):
    """Pieces of each distinct pre-token of a bucket, joined to its lists: block and its documents' sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tokenizers import Tokenizer

        model, counts, now = Tokenizer.from_file(path).model, {}, None
        for batch in batches:
            blocks, sums = [], []
            for bucket, block, n, pieces, sizes, docs in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if bucket != now or len(counts) > MEMORY:
                    now, counts = bucket, {}
                pieces = zlib.decompress(pieces).decode().split("\n")
                for p in pieces:
                    if p not in counts:
                        counts[p] = len(model.tokenize(p))
                each = np.repeat(np.fromiter(map(counts.__getitem__, pieces), np.int64, len(pieces)), np.frombuffer(zlib.decompress(sizes), "<i4"))
                blocks.append(block)
                sums.append(np.bincount(np.frombuffer(zlib.decompress(docs), "<u2"), each, n).astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int64()), pa.array(sums, pa.binary())], ["block", "sums"])

    return run


def _add_up(limit: int):
    """Rows of a block, its documents first, then the buckets' sums: one row per document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def close() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([ids, n_bytes, pa.array(total), pa.array(total > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

        ids = None
        for batch in batches:
            for k in range(batch.num_rows):
                if batch.column("sums")[k].is_valid:
                    total += np.frombuffer(batch.column("sums")[k].as_py(), "<u4")
                    continue
                if ids is not None:
                    yield close()
                ids, n_bytes = batch.column("ids")[k].values, batch.column("n_bytes")[k].values
                total = np.array(batch.column("known")[k].values.to_numpy(zero_copy_only=False), np.int64)
        if ids is not None:
            yield close()

    return run


def count_tokens(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 512) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_tokens, over_limit.

    tokenizer: path of a byte-level .json file. Null and empty texts: 0 bytes, 0 tokens. Null or repeated ids: a
    row each. No rows: no rows. Other columns of docs are ignored.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    buckets = max(64, int(spark.conf.get("spark.sql.shuffle.partitions")))
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    id_type = source.schema["doc_id"].dataType.simpleString()
    cut = written(source.mapInArrow(_cut_batches(tokenizer, buckets), _SCHEMA.format(id=id_type)), "token-lists")
    lists = cut.where("bucket >= 0").select("bucket", "block", "n", "pieces", "sizes", "docs")
    sums = lists.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_join_bucket(tokenizer), "block long, sums binary")
    rows = cut.where("bucket < 0").select("block", F.lit(None).cast("binary").alias("sums"), "ids", "n_bytes", "known")
    both = rows.unionByName(sums, allowMissingColumns=True)
    return (
        both.repartition("block").sortWithinPartitions("block", F.isnotnull("sums"))
        .mapInArrow(_add_up(limit), f"doc_id {id_type}, n_bytes long, n_tokens long, over_limit boolean")
    )
