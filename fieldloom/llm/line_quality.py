"""Quality rules: fixed base rules, and lines that many documents of a host share.

Every text is read once: its base figures and its distinct normalised lines' hashes are written. Documents with equal
texts count as one, so that copies don't make their own lines frequent. For each host and line the distinct documents
are counted; lines over the limit are taken out, and a document that loses more than the allowed share of its words,
or keeps fewer than the least, is rejected. judge() says so by row, strip_lines() gives the documents that are left.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_rows, bounded_batches, heavy_keys, join_heavy, written

#: Words that a worker remembers before it starts anew.
MEMORY = 1_000_000

_SYMBOLS = re.compile(r"[#*$%&|<>]")
_BLANKS = " \t\n\x0b\x0c\r"

_FIGURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
_LINES = "array<struct<line:bigint,words:int>>"


def figures(text: str, numbers: dict[bytes, int]) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words; numbers: a number for each word met so far."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    blanks = sum(map(text.count, _BLANKS))
    symbols = len(_SYMBOLS.findall(text))
    seen, dup = set(), 0
    for line in text.split("\n"):
        if line in seen:
            dup += 1
        elif line.strip(_BLANKS):
            seen.add(line)
    if n < 4:
        return n, len(text) - blanks, symbols, dup, 0
    got = list(map(numbers.get, words))
    if None in got:
        for k, x in enumerate(got):
            if x is None:
                got[k] = numbers.setdefault(words[k], len(numbers))
    w = np.array(got, np.int64)
    if len(numbers) < 1 << 21:
        key = (w[:-2] << 42) | (w[1:-1] << 21) | w[2:]
    else:  # pairs get numbers of their own, so that both halves of a key have 32 bits
        _, local = np.unique(w, return_inverse=True)
        _, pairs = np.unique((local[:-1] << 32) | local[1:], return_inverse=True)
        key = (pairs[:-1] << 32) | local[2:]
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    again = np.zeros(len(key), bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    covered = np.zeros(n, bool)
    covered[:-2] |= again
    covered[1:-1] |= again
    covered[2:] |= again
    return n, len(text) - blanks, symbols, dup, int(covered.sum())


def line_hash(line: str) -> tuple[int, int]:
    """Hash and words of a normalised line: lower case, single blanks. Words end at the blanks of the base rules."""
    import xxhash

    words = line.encode("utf-8", "surrogatepass").split()
    return xxhash.xxh64_intdigest(b" ".join(words).decode("utf-8", "surrogatepass").lower().encode("utf-8", "surrogatepass")) - (1 << 63), len(words)


def lines_of(text: str) -> list[tuple[int, int]]:
    """(hash, words) of the distinct normalised lines with a word, words summed over repeats."""
    out: dict[int, int] = {}
    for line in text.split("\n"):
        h, n = line_hash(line)
        if n:
            out[h] = out.get(h, 0) + n
    return list(out.items())


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    numbers: dict[bytes, int] = {}
    for batch in batches:
        texts = [t or "" for t in batch.column(3).to_pylist()]
        rows = []
        for t in texts:
            if len(numbers) > MEMORY:
                numbers.clear()
            rows.append(figures(t, numbers))
        lines = [lines_of(t) for t in texts]
        offsets = pa.array(np.cumsum([0, *map(len, lines)]), pa.int32())
        flat = [x for own in lines for x in own]
        pairs = pa.StructArray.from_arrays([pa.array([x[0] for x in flat], pa.int64()), pa.array([x[1] for x in flat], pa.int32())], ["line", "words"])
        columns = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)] if rows else [pa.array([], pa.int64())] * 5
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], *columns, pa.ListArray.from_arrays(offsets, pairs)], ["doc_id", "host", "text_hash", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lines"])


def _read_docs(docs: DataFrame, id_col: str, text_col: str, host_col: str) -> DataFrame:
    """The written figures and lines of every row."""
    bounded_batches(docs.sparkSession)
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(host_col).cast("string").alias("host"), F.xxhash64(F.col(text_col)).alias("text_hash"), F.col(text_col).alias("text"))
    id_type = source.schema["doc_id"].dataType.simpleString()
    read = source.mapInArrow(_read, f"doc_id {id_type}, host string, text_hash long, {_FIGURES}, lines {_LINES}")
    return written(read, "line-figures").withColumn("host", F.coalesce("host", F.lit("\x00")))


def _frequent(read: DataFrame, limit: int) -> DataFrame:
    """host, text_hash, lost_words, lines: the frequent lines of each text that has any, and their words."""
    # documents of equal texts on a host have equal lines: one of them stands for all
    texts = read.where("size(lines) > 0").groupBy("host", "text_hash").agg(F.first("lines").alias("lines"))
    lines = texts.select("host", "text_hash", F.inline("lines"))
    counts = written(lines.groupBy("host", "line").agg(F.count("*").alias("n")).where(F.col("n") > limit), "line-counts")
    frequent = join_heavy(lines, counts.select("host", "line"), ["host", "line"], heavy_keys(counts, ["host", "line"]), "inner")
    return written(frequent.groupBy("host", "text_hash").agg(F.sum("words").alias("lost_words"), F.collect_set("line").alias("frequent")), "frequent-lines")


def _verdict(most_lost: float, least_words: int) -> tuple[Column, Column, Column]:
    """base_failed, lost_words, kept."""
    n, repeat = F.col("n_words"), F.col("n_repeat_words")
    failed = (n < 50) | (100 * repeat > 50 * n)
    lost_words = F.coalesce("lost_words", F.lit(0)).cast("long")
    return failed, lost_words, ~failed & (lost_words <= most_lost * n) & (n - lost_words >= least_words)


def judge(
    docs: DataFrame, limit: int = 20, most_lost: float = 0.5, least_words: int = 50,
    id_col: str = "doc_id", text_col: str = "text", host_col: str = "source",
) -> DataFrame:
    """One row per row of docs: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    lost_words, kept.

    A line is frequent if more than `limit` documents of different texts on its host have it. kept: the base rules hold,
    at most the share `most_lost` of the words is in frequent lines, and `least_words` remain. Null texts have no words;
    null hosts are one host; null ids and repeated rows have a row each.
    """
    read = _read_docs(docs, id_col, text_col, host_col)
    lost = _frequent(read, limit).drop("frequent")
    copies = read.groupBy("host", "text_hash").agg(F.count("*").alias("n"))
    failed, lost_words, kept = _verdict(most_lost, least_words)
    return join_heavy(read.drop("lines"), lost, ["host", "text_hash"], heavy_keys(copies, ["host", "text_hash"])).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), lost_words.alias("lost_words"), kept.alias("kept")
    )


def _strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for text, gone in zip(batch.column("text").to_pylist(), batch.column("frequent").to_pylist(), strict=True):
            drop = set(gone or ())
            out.append("\n".join(x for x in text.split("\n") if line_hash(x)[0] not in drop) if drop and text else text)
        yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(out, pa.string())], ["row", "text"])


def strip_lines(
    docs: DataFrame, limit: int = 20, most_lost: float = 0.5, least_words: int = 50,
    id_col: str = "doc_id", text_col: str = "text", host_col: str = "source",
) -> DataFrame:
    """The rows of docs that judge() keeps, all columns, without the frequent lines in their texts.

    Repeated rows are kept alike. No rows, or none that is kept: no rows.
    """
    failed, _, kept = _verdict(most_lost, least_words)
    key = lambda row: (F.coalesce(row[host_col].cast("string"), F.lit("\x00")).alias("host"), F.xxhash64(row[text_col]).alias("text_hash"))
    read = _read_docs(docs, id_col, text_col, host_col)
    lost = _frequent(read, limit)
    # rows of equal hosts and texts have equal figures
    texts = written(read.groupBy("host", "text_hash").agg(F.first("n_words").alias("n_words"), F.first("n_repeat_words").alias("n_repeat_words"), F.count("*").alias("n")), "text-figures")
    chosen = texts.join(lost, ["host", "text_hash"], "left").where(kept).select("host", "text_hash", "frequent")
    rows = as_rows(docs)
    rows = rows.select("row", F.col("row")[text_col].alias("text"), *key(F.col("row")))
    kind = rows.schema["row"].dataType.simpleString()
    held = join_heavy(rows, chosen, ["host", "text_hash"], heavy_keys(texts, ["host", "text_hash"]), "inner")
    stripped = held.select("row", "text", "frequent").mapInArrow(_strip, f"row {kind}, text string")
    return stripped.select(*(F.col("text") if c == text_col else F.col("row")[c] for c in docs.columns)).toDF(*docs.columns)
