"""Chat formatting as a prefix tree.

A turn becomes a segment of text between marks, with the control signs inside role and text escaped. Conversations with
equal first turns share those nodes of a tree; a node is named by a hash of all segments up to it. Trees are emitted
depth first, each node's tokens once, with position ids that count along the conversation and, for each node, the
intervals of its ancestors' tokens, which together with the causal order inside the node are all that it may attend to.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, heavy_keys, join_heavy, written
from .packing import byte_letters
from .token_count import _OTHER_SPACE, _WORD, MEMORY

# The template.
OPEN, AFTER_ROLE, CLOSE = "### ", ": ", "</turn>\n"
ESCAPED = r"([\\#<:])"
_SEGMENT = re.compile(r"### ((?:\\.|[^\\#<:])*): ((?:\\.|[^\\#<:])*)</turn>\n", re.S)
_ESCAPE = re.compile(r"\\(.)", re.S)
_CONTROL, BACK = re.compile(ESCAPED), r"\\\1"

#: Bytes of a node's name, and of its part in the sorting path.
NAME, STEP = 16, 6

_LAYOUT = "part int, rank long, depth int, root binary, node binary, offset long, position long, attends array<struct<start:bigint,end:bigint>>"


@dataclass
class Forest:
    """The emitted trees, in the order of part, rank, depth: that is depth first.

    tokens: part, rank, depth, node, ends (a conversation ends here), tokens, loss_from, loss_to (tokens of the node under
    the loss). layout: part, rank, depth, root, node, offset (in its tree's tokens), position (id of the first token),
    attends (start, end in the tree's tokens of its ancestors). ancestors: part, depth, node of the nodes above each
    part's first one. conversations: conv_id, end (its last node), n_turns."""

    tokens: DataFrame
    layout: DataFrame
    ancestors: DataFrame
    conversations: DataFrame

    @property
    def nodes(self) -> DataFrame:
        """One row per node: all of layout and tokens, and position_ids, one for each token."""
        n = F.size("tokens")
        ids = F.when(n > 0, F.sequence(F.col("position"), F.col("position") + n - 1)).otherwise(F.array().cast("array<bigint>"))
        return self.tokens.drop("part", "rank", "depth").join(self.layout, "node").withColumn("position_ids", ids)


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPED, r"\\$1")


def unescaped(text: str) -> str:
    return _ESCAPE.sub(r"\1", text)


class Codec:
    """Ids of texts and back, for byte-level tokenizers.

    Words are cut as token_count.Cutter does and go through the library once each; special strings are text. Ids are
    read back by the bytes that the vocabulary has for them.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # a special string in a text is text
        spec = json.load(open(path, encoding="utf-8"))
        if spec["normalizer"] is not None or spec["pre_tokenizer"]["type"] != "ByteLevel":
            raise ValueError("a byte-level tokenizer without a normalizer is needed")
        letters = {c: b for b, c in byte_letters().items()}
        self.spelled = {k: bytes(letters[c] for c in token) for token, k in self.tokenizer.get_vocab(with_added_tokens=False).items() if all(c in letters for c in token)}
        self.words: dict[str, bytes] = {}

    def _learn(self, word: str) -> bytes:
        if len(self.words) > MEMORY:
            self.words.clear()
        own = self.words[word] = np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, "<i4").tobytes()
        return own

    def ids(self, text: str) -> bytes:
        """Little-endian 32-bit ids."""
        if _OTHER_SPACE.search(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<i4").tobytes()
        words = _WORD.findall(text)
        found = list(map(self.words.get, words))
        if None in found:
            for k, x in enumerate(found):
                if x is None:
                    found[k] = self.words.get(words[k]) or self._learn(words[k])
        return b"".join(found)

    def text(self, ids: list[int]) -> str:
        return b"".join(map(self.spelled.__getitem__, ids)).decode("utf-8")


def _tokenize(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, heads = Codec(path), {}
        close = codec.ids(CLOSE)
        for batch in batches:
            tokens, start, end = [], [], []
            for role, body in zip(batch.column("role").to_pylist(), batch.column("body").to_pylist(), strict=True):
                if len(heads) > 10_000:
                    heads.clear()
                h = heads.get(role) or heads.setdefault(role, codec.ids(f"{OPEN}{_CONTROL.sub(BACK, role)}{AFTER_ROLE}"))
                b = codec.ids(body)
                tokens.append(h + b + close)
                lost = role == "assistant"
                start.append(len(h) // 4 if lost else 0)
                end.append((len(h) + len(b)) // 4 if lost else 0)
            offsets = np.cumsum([0, *(len(t) // 4 for t in tokens)])
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.frombuffer(b"".join(tokens), "<i4")))
            kept = [batch.column(c) for c in ("part", "rank", "depth", "node", "ends")]
            yield pa.RecordBatch.from_arrays([*kept, lists, pa.array(start, pa.int32()), pa.array(end, pa.int32())], ["part", "rank", "depth", "node", "ends", "tokens", "loss_from", "loss_to"])

    return run


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Depth first through a part's nodes, the ancestors of its first one before them: what each node attends to.

    Ancestors that follow each other in the tree's tokens are one interval, so that a chain has one however long it is.
    """
    stack: list[tuple[int, int, list[tuple[int, int]], int, bytes]] = []  # end, position, intervals, begin of the tree, root
    for batch in batches:
        out = []
        for part, rank, depth, node, at, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            del stack[depth:]
            _, position, spans, begin, root = stack[-1] if stack else (0, 0, [], at, node)
            if rank >= 0:
                out.append((part, rank, depth, root, node, at - begin, position, [{"start": x, "end": y} for x, y in spans]))
            start = at - begin
            held = [*spans[:-1], (spans[-1][0], start + n)] if spans and spans[-1][1] == start else [*spans, (start, start + n)]
            stack.append((start + n, position + n, held, begin, root))
        interval = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        kinds = (pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), interval)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [()] * 8, kinds, strict=True)], ["part", "rank", "depth", "root", "node", "offset", "position", "attends"])


def _in_order(rows: DataFrame) -> DataFrame:
    return rows.repartition("part").sortWithinPartitions("part", "rank", "depth")


def build(conversations: DataFrame, tokenizer: str, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> Forest:
    """The prefix trees of all conversations.

    Rows of a conversation go by turn, then role, then text; null roles and texts are empty, rows with a null id are one
    conversation. Repeated rows are turns of their own. tokenizer: path of a byte-level .json file. Texts are shuffled
    twice, by conversation and by node; all else carries names and numbers. All steps are linear in the turns, however
    deep a conversation is or however many begin alike.
    """
    spark = conversations.sparkSession
    bounded_batches(spark)
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    turns = conversations.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), empty(role_col).alias("role"), empty(text_col).alias("text"))
    whole = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    id_type = whole.schema["conv_id"].dataType.simpleString()
    named = whole.select("conv_id", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), escaped(t["text"]).alias("body"))).alias("turns"))
    named = written(named.mapInArrow(_name, f"conv_id {id_type}, end binary, path binary, turns array<struct<node:binary,role:string,body:string>>"), "chat-turns")

    # equal conversations are one path; sorted paths are the leaves of the trees from left to right
    paths = named.groupBy("end").agg(F.first("path").alias("path"), F.first("turns.node").alias("nodes"))
    order = written(paths.repartitionByRange("path").withColumn("part", F.spark_partition_id()), "chat-order")
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = lambda sizes: F.broadcast(sizes.withColumn("base", before(Window.orderBy("part"))).select("part", "base"))  # noqa: E731  as many rows as partitions
    ranked = order.withColumn("k", F.row_number().over(Window.partitionBy("part").orderBy("path"))).join(bases(order.groupBy("part").agg(F.count("*").alias("n"))), "part")
    steps = written(ranked.select("end", (F.col("base") + F.col("k")).alias("rank"), "nodes"), "chat-steps")

    # a node is emitted with the first path that holds it, parents before children: the depth-first order
    every = steps.select("rank", "end", F.posexplode("nodes").alias("depth", "node"))
    place = every.groupBy("node").agg(F.min(F.struct("rank", "depth")).alias("place"), F.max(F.col("node") == F.col("end")).alias("ends")).select("node", "place.*", "ends")
    laid = written(place.repartitionByRange("rank", "depth").withColumn("part", F.spark_partition_id()), "chat-laid")
    texts = named.select(F.inline("turns")).groupBy("node").agg(F.first(F.struct("role", "body")).alias("turn")).select("node", "turn.*")
    emitted = texts.join(laid, "node").mapInArrow(_tokenize(tokenizer), "part int, rank long, depth int, node binary, ends boolean, tokens array<int>, loss_from int, loss_to int")
    emitted = written(emitted, "chat-tokens")

    sizes = emitted.select("part", "rank", "depth", "node", F.size("tokens").cast("long").alias("n"))
    inside = sizes.withColumn("at", before(Window.partitionBy("part").orderBy("rank", "depth")))
    placed = inside.join(bases(sizes.groupBy("part").agg(F.sum("n").alias("n"))), "part").select("part", "rank", "depth", "node", (F.col("base") + F.col("at")).alias("at"), "n")
    placed = written(placed, "chat-places")
    first = placed.groupBy("part").agg(F.min(F.struct("rank", "depth")).alias("first")).select("part", "first.*")  # one row per part
    above = first.join(steps, "rank").select("part", F.posexplode(F.slice("nodes", F.lit(1), F.col("depth"))).alias("depth", "node"))
    above = written(above, "chat-ancestors")
    ancestors = above.join(placed.select("node", "at", "n"), "node").select("part", F.lit(-1).cast("long").alias("rank"), "depth", "node", "at", "n")
    layout = written(_in_order(placed.unionByName(ancestors)).mapInArrow(_walk, _LAYOUT), "chat-layout")
    return Forest(emitted, layout, above, named.select("conv_id", "end", F.size("turns").cast("long").alias("n_turns")))


def _name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """conv_id, the last node's name, the sorting path, and the turns with their nodes' names: chained hashes of the turns."""
    turn = pa.struct([("node", pa.binary()), ("role", pa.string()), ("body", pa.string())])
    for batch in batches:
        ends, paths, out = [], [], []
        for turns in batch.column(1).to_pylist():
            name, own = b"", []
            for t in turns:
                raw = t["role"].encode("utf-8", "surrogatepass")
                name = hashlib.blake2b(b"%b%d:%b%b" % (name, len(raw), raw, t["body"].encode("utf-8", "surrogatepass")), digest_size=NAME).digest()
                own.append({"node": name, "role": t["role"], "body": t["body"]})
            ends.append(name)
            paths.append(b"".join(t["node"][:STEP] for t in own))
            out.append(own)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ends, pa.binary()), pa.array(paths, pa.binary()), pa.array(out, pa.list_(turn))], ["conv_id", "end", "path", "turns"])


class _Told:
    """What has been read along a path, up to a node."""

    def __init__(self, before: _Told | None = None):
        self.turns = before.turns.copy() if before else hashlib.sha256()
        self.loss = before.loss.copy() if before else hashlib.sha256()
        self.n, self.loss_chars, self.chars, self.position = (before.n, before.loss_chars, before.chars, before.position) if before else (0, 0, 0, 0)
        self.seen: list[tuple[int, int]] = before.seen if before else []


def _digest(tokenizer_path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = Codec(tokenizer_path).text
        raw = lambda s: s.encode("utf-8", "surrogatepass")
        stack: list[_Told] = []
        held = None
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if row["tokens"] is None:  # the layout of the node that comes next
                    held = row
                    continue
                depth, ids = row["depth"], row["tokens"]
                if held is None or held["node"] != row["node"]:
                    raise ValueError("a node has no layout")
                del stack[depth:]
                told = _Told(stack[-1] if depth else None)
                if len(stack) != depth or held["position"] != told.position or (row["rank"] >= 0 and [(a["start"], a["end"]) for a in held["attends"]] != told.seen):
                    raise ValueError("a node attends to other tokens than its ancestors'")
                text = decode(ids)
                if (found := _SEGMENT.fullmatch(text)) is None:
                    raise ValueError("a formatted conversation can't be read back")
                lost = unescaped(decode(ids[row["loss_from"] : row["loss_to"]]))
                told.turns.update(raw(f"{unescaped(found[1])}\n{unescaped(found[2])}\n"))
                told.loss.update(raw(lost))
                told.n, told.loss_chars, told.chars, told.position = told.n + 1, told.loss_chars + len(lost), told.chars + len(text), told.position + len(ids)
                start, stop = held["offset"], held["offset"] + len(ids)
                told.seen = [*told.seen[:-1], (told.seen[-1][0], stop)] if told.seen and told.seen[-1][1] == start else [*told.seen, (start, stop)]
                stack.append(told)
                if row["ends"] and row["rank"] >= 0:
                    out.append((row["node"], told.n, told.turns.hexdigest(), told.loss_chars, told.loss.hexdigest(), told.chars))
            columns = list(zip(*out, strict=True)) if out else [()] * 6
            kinds = (pa.binary(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["end", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return run


def read_back(forest: Forest, tokenizer: str) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, from the emitted tokens alone.

    Each part is read once from left to right, with the path to its first node before it; a conversation is the path to
    the node that ends it. Every node's intervals and position must be those of the tokens above it.
    """
    names, rank = ["part", "depth", "node"], F.lit(-1).cast("long").alias("rank")
    tokens = forest.tokens.unionByName(forest.ancestors.join(forest.tokens.drop("part", "rank", "depth"), "node").select(*forest.tokens.columns[:1], rank, "depth", "node", "ends", "tokens", "loss_from", "loss_to"))
    layout = forest.layout.select(*names, "rank", "offset", "position", "attends")
    layout = layout.unionByName(forest.ancestors.join(layout.drop("part", "rank", "depth"), "node").select(*names, rank, "offset", "position", "attends"))
    both = layout.unionByName(tokens, allowMissingColumns=True).withColumn("kind", F.isnotnull("tokens"))
    rows = both.repartition("part").sortWithinPartitions("part", "rank", "depth", "kind").drop("kind")
    read = rows.mapInArrow(_digest(tokenizer), "end binary, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
    read, ends = written(read, "chat-read"), forest.conversations.select("conv_id", "end")
    heavy = heavy_keys(ends.groupBy("end").agg(F.count("*").alias("n")), ["end"])
    return join_heavy(ends, read, ["end"], heavy, "inner").drop("end")
