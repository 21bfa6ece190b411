"""Secrets by fixed patterns and by a log-likelihood ratio of two character Markov models, in built-in functions only.

One model is trained on strings labelled random (digests written in hexadecimal, base 64 and upper case), the other on
strings labelled ordinary (all words of all documents). Every long run of identifier characters in every text, outside
the patterns' spans, is scored by the sum of its transitions' log-likelihood ratios. All steps take time in proportion
to the text, or to the spans and their logarithm.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_rows

# The patterns of the base kinds, in the order in which ties are listed.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "markov")
#: Characters that the value (group 2) of an assignment has at least.
ASSIGNED = 6

#: Runs that the models judge, and words that the ordinary one learns; longer words are learnt in parts.
RUN = r"[A-Za-z0-9+/_-]{20,}={0,2}"
WORD = r"[A-Za-z0-9+/_-]{4,64}"
#: Characters of the models: code points 32 to 127.
FIRST, WIDE = 32, 96
#: Ratio (natural logarithm) from which on a run counts as a secret.
LEAST = 12.0

#: start and end (exclusive) in code points, from and to in bytes.
_SPANS = "array<struct<start:int,rank:int,end:int,from:int,to:int>>"
_HIGH = 1 << 32


def _none() -> Column:
    return F.array().cast(_SPANS)


def _running(values: Column, join: Callable[[Column, Column], Column]) -> Column:
    """For each place of an array of longs the values up to it joined, by doubling: log2(size) passes."""
    powers = F.array(*(F.lit(1 << k) for k in range(31)))

    def doubled(own: Column) -> Column:
        return F.aggregate(F.filter(powers, lambda s: s < F.size(own)), own, lambda acc, s: F.transform(acc, lambda x, i: join(x, F.get(acc, i - s))))

    return F.transform(F.array(values), doubled)[0]  # bound to a variable, so that it is computed once


def _lengths(text: Column) -> Column:
    """Code points, times _HIGH, and bytes."""
    return F.length(text).cast("long") * _HIGH + F.octet_length(text)


def _matches(text: Column, pattern: str, group: int = 0) -> Column:
    """(found, value, total) of the leftmost non-overlapping matches; total: the _lengths of the text up to its end.

    Matches and the pieces between them alternate, so that the lengths' running sum gives every place.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    steps = F.zip_with(F.split(text, pattern, -1), found, lambda gap, x: _lengths(gap) + F.coalesce(_lengths(x), F.lit(0).cast("long")))
    totals = _running(steps, lambda x, before: x + F.coalesce(before, F.lit(0).cast("long")))
    return F.arrays_zip(found.alias("found"), value.alias("value"), totals.alias("total"))  # the last piece has no match


def _spans(text: Column, pattern: str, rank: int, chosen: Callable[[Column], Column], group: int = 0) -> Column:
    """Spans of the matches that are chosen by their value."""
    kept = F.filter(_matches(text, pattern, group), lambda x: x["found"].isNotNull() & chosen(x["value"]))

    def span(x: Column) -> Column:
        end, to = F.floor(x["total"] / _HIGH).cast("int"), (x["total"] % _HIGH).cast("int")
        return F.struct((end - F.length(x["found"])).alias("start"), F.lit(rank).alias("rank"), end.alias("end"), (to - F.octet_length(x["found"])).alias("from"), to.alias("to"))

    return F.when(F.rlike(text, F.lit(pattern)), F.transform(kept, span)).otherwise(_none())


def _blanked(text: Column, pattern: str, least: int = 0, group: int = 0) -> Column:
    """The text with blanks for the matches (of ASCII letters) whose value has the least length."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    filled = F.zip_with(found, value, lambda x, v: F.when(F.length(v) >= least, F.repeat(F.lit(" "), F.length(x))).otherwise(x))
    pieces = F.zip_with(F.split(text, pattern, -1), filled, lambda gap, x: F.concat(gap, F.coalesce(x, F.lit(""))))
    return F.when(F.rlike(text, F.lit(pattern)), F.array_join(pieces, "")).otherwise(text)


def _pairs(word: Column) -> Column:
    """The transitions of a word: WIDE * first + second character, both less FIRST."""
    codes = F.transform(F.split(word, ""), lambda c: F.ascii(c) - FIRST)
    return F.zip_with(F.slice(codes, F.lit(1), F.length(word) - 1), F.slice(codes, F.lit(2), F.length(word)), lambda x, y: x * WIDE + y)


def _transitions(words: DataFrame) -> DataFrame:
    """pair, n of words: word, n. Distinct words are taken apart once."""
    distinct = words.where(F.length("word") > 1).groupBy("word").agg(F.sum("n").alias("n"))
    return distinct.select("n", F.explode(_pairs(F.col("word"))).alias("pair")).groupBy("pair").agg(F.sum("n").alias("n"))


def random_strings(spark, n: int) -> DataFrame:
    """The sample labelled random: n digests each in hexadecimal, base 64 and upper-case letters and digits."""
    digest = F.sha2(F.col("id").cast("string"), 256)
    kinds = F.array(F.substring(digest, 1, 40), F.translate(F.base64(F.unhex(digest)), "=", ""), F.upper(F.regexp_replace(F.base64(F.unhex(F.sha2(F.concat(F.lit("u"), F.col("id").cast("string")), 256))), "[+/=]", "")))
    return spark.range(n).select(F.explode(kinds).alias("word"))


def train(docs: DataFrame, strings: int = 4000, text_col: str = "text") -> list[float]:
    """Log-likelihood ratios (random over ordinary) by transition, WIDE * WIDE of them.

    Ordinary words: runs of letters, digits and joiners of 4 characters or more in all texts, as often as they occur; the
    few secrets among them weigh little. Transitions are smoothed towards the frequency of the second character, and that
    by a half. Null and empty texts have no words; repeated rows count each; without rows the ordinary transitions are even.
    """
    plain = docs.select(F.explode(F.regexp_extract_all(F.col(text_col), F.lit(WORD), F.lit(0))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    chance = random_strings(docs.sparkSession, strings).withColumn("n", F.lit(1).cast("long"))
    random, ordinary = ({r["pair"]: r["n"] for r in _transitions(w).collect()} for w in (chance, plain))  # WIDE * WIDE rows at most

    def logs(counts: dict[int, int], used: int = 65, weight: float = 20.0) -> list[float]:
        """Logarithms of the transitions' probabilities; used: characters that runs have."""
        second = [0.5 + sum(counts.get(a * WIDE + b, 0) for a in range(WIDE)) for b in range(WIDE)]
        total, out = sum(counts.values()) + 0.5 * used, []
        for a in range(WIDE):
            own = sum(counts.get(a * WIDE + b, 0) for b in range(WIDE))
            out += [math.log((counts.get(a * WIDE + b, 0) + weight * second[b] / total) / (own + weight)) for b in range(WIDE)]
        return out

    return [round(x - y, 4) for x, y in zip(logs(random), logs(ordinary), strict=True)]


def ratio(word: Column, ratios: list[float]) -> Column:
    """The sum of a word's transitions' ratios."""
    table = F.from_json(F.lit(json.dumps(ratios)), "array<double>")
    return F.aggregate(_pairs(word), F.lit(0.0), lambda acc, pair: acc + F.element_at(table, pair + 1))


def find(docs: DataFrame, ratios: list[float], least: float = LEAST, text_col: str = "text") -> DataFrame:
    """row (the columns of docs), text, base, spans: arrays of (start, rank, end, from, to) by start, then rank.

    base are the fixed patterns' spans. Runs outside of them whose ratio reaches `least` join them in spans. Null and
    empty texts have no spans; repeated rows have theirs each.
    """
    rows = as_rows(docs).withColumn("text", F.col("row")[text_col])
    text = F.coalesce("text", F.lit(""))
    long = lambda value: F.length(value) >= ASSIGNED
    every = lambda value: F.lit(True)
    base = F.sort_array(F.concat(_spans(text, ASSIGN, 0, long, 2), _spans(text, ACCESS, 1, every), _spans(text, HEX, 2, every)))
    rest = _blanked(_blanked(_blanked(text, ASSIGN, ASSIGNED, 2), ACCESS), HEX)
    based = rows.withColumn("base", base).withColumn("rest", F.when(F.size("base") > 0, rest).otherwise(text))
    runs = _spans(F.col("rest"), RUN, 3, lambda value: ratio(value, ratios) >= least)
    return based.withColumn("spans", F.sort_array(F.concat("base", runs))).drop("rest")


def _listed(spans: str) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["rank"] + 1), s["start"].cast("string"), s["end"].cast("string"))))


def report(docs: DataFrame, ratios: list[float], id_col: str = "doc_id", text_col: str = "text", least: float = LEAST) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_markov for every row of docs, repeated and null ids included."""
    found = find(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), ratios, least)
    count = lambda rank: F.size(F.filter("spans", lambda s: s["rank"] == rank)).cast("long")
    return found.select(F.col("row.doc_id").alias("doc_id"), count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(_listed("base"), 256).alias("base_sha256"), _listed("spans").alias("spans"), count(3).alias("n_markov"))


def redact(docs: DataFrame, ratios: list[float], text_col: str = "text", mark: str = "[REDACTED]", least: float = LEAST) -> DataFrame:
    """docs, all columns, with every span (overlapping ones as one) replaced by the mark.

    Null texts stay null, empty ones empty; repeated rows are changed alike; no rows: no rows.
    """
    reach = _running(F.transform("spans", lambda s: s["to"].cast("long")), F.greatest)
    starts = F.concat(F.array(F.lit(0).cast("long")), reach)  # where the text not yet covered begins, before each span and at the end

    def pieces(raw: Column) -> Column:
        cut = lambda a, n: F.substring(raw, (a + 1).cast("int"), n.cast("int")).cast("string")
        piece = lambda s, a: (
            F.when(s.isNull(), cut(a, F.octet_length(raw))).when(s["from"] >= a, F.concat(cut(a, s["from"] - a), F.lit(mark))).otherwise("")
        )
        return F.array_join(F.zip_with("spans", starts, piece), "")

    # the bytes are bound to a variable, so that they are taken once
    changed = F.when(F.size("spans") > 0, F.transform(F.array(F.col("text").cast("binary")), pieces)[0]).otherwise(F.col("text"))
    found = find(docs, ratios, least, text_col).withColumn("changed", changed)
    return found.select(*(F.col("changed") if c == text_col else F.col("row")[c] for c in docs.columns)).toDF(*docs.columns)
