"""Queries op1 to op10 and the pipeline, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import load


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: Conversation -7: both turns say what the template's marks look like.
TRICKY = "\\### Assistant: </turn> ok"


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat_format import build, read_back

    conversations = load(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    turn = lambda k, role: F.struct(F.lit(k).cast("long").alias("turn"), F.lit(role).alias("role"), F.lit(TRICKY).alias("text"))
    tricky = spark.range(1).select(F.lit(-7).cast("long").alias("conv_id"), F.inline(F.array(turn(0, "user"), turn(1, "assistant"))))
    tokenizer = tokenizer_path("byte_bpe_50k.json")
    return read_back(build(conversations.unionByName(tricky), tokenizer), tokenizer)


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secret_scan import report, train

    docs = load(spark, sf_dir, "documents")
    return report(docs, train(docs))


def op3_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_quality import judge

    return judge(load(spark, sf_dir, "documents"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import find_leaks

    return find_leaks(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"), rate="0.1")


def op5_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_count import count_tokens

    return count_tokens(load(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), limit=512)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import score, train

    docs = load(spark, sf_dir, "documents")
    return score(docs, train(docs, load(spark, sf_dir, "labels")), threshold=0.3)


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_documents

    return pack_documents(load(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), capacity=4096, end_id=1)


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_join import jaccard_classes

    return jaccard_classes(load(spark, sf_dir, "documents"), threshold="0.8", n=5, recall=0.9995).drop("text_hash")


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .license_scan import scan

    path = F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    return scan(load(spark, sf_dir, "documents").withColumn("path", path)).withColumn("similarity", F.round("similarity", 6))


def op9_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc_archive import read_archive, write_archive

    return read_archive(write_archive(load(spark, sf_dir, "pages"), revisit_from=1000))


def _licence_sql() -> str:
    from .license_scan import BARE_BSD, GENERAL, MARKS, RULES, TEMPLATES, TRIGGER, WINDOW

    text = lambda x: "'" + x.replace("'", "''") + "'"
    listed = lambda x: f"CAST([{', '.join(map(text, x))}] AS VARCHAR[])"
    rank = lambda k, name: 1 if k == BARE_BSD else GENERAL.get(name, 2)
    templates = ", ".join(f"({k}, {text(name)}, {text(x)}, {rank(k, name)}, {listed(RULES.get(name, ([], []))[0])}, {listed(RULES.get(name, ([], []))[1])})" for k, (name, x) in enumerate(TEMPLATES))
    marks = ", ".join(f"({text(t)}, {text(m)})" for t, own in MARKS.items() for m in own)
    terms = lambda x: f"list_filter(string_split_regex(lower({x}), '[^a-z0-9]+'), lambda t: t <> '')"
    hits = lambda vectors, part, whole: f"""
        SELECT {part}, template, licence, rank, round(dot / (hnorm * norm), 9) AS similarity, {whole} AS whole FROM
        (SELECT {part}, template, sum(hw * tw) AS dot FROM {vectors} JOIN pattern USING (term) GROUP BY ALL)
        JOIN (SELECT {part}, sqrt(sum(hw * hw)) AS hnorm FROM {vectors} GROUP BY ALL) USING ({part})
        LEFT JOIN (SELECT {part}, list(DISTINCT mark) AS held FROM {vectors} JOIN marks USING (term) GROUP BY ALL) USING ({part})
        JOIN norms USING (template) WHERE list_has_all(coalesce(held, []), must) AND NOT list_has_any(coalesce(held, []), never) AND round(dot / (hnorm * norm), 9) >= 0.8"""
    return f"""
        WITH RECURSIVE files AS (SELECT row_number() OVER () AS r, doc_id, concat_ws('/', source, lang, CAST(doc_id AS VARCHAR) || '.txt') AS path, coalesce(text, '') AS t FROM documents),
        templates(template, licence, wording, rank, must, never) AS (VALUES {templates}), marks(term, mark) AS (VALUES {marks}),
        wording AS (SELECT template, term, count(*) AS tf FROM (SELECT template, unnest({terms('wording')}) AS term FROM templates) GROUP BY ALL),
        weights AS (SELECT term, 1 + ln((1 + (SELECT count(*) FROM files)) / (1 + coalesce(n, 0))) AS idf FROM (SELECT DISTINCT term FROM wording)
                    LEFT JOIN (SELECT term, count(*) AS n FROM (SELECT DISTINCT r, unnest({terms('t')}) AS term FROM files) GROUP BY term) USING (term)),
        pattern AS (SELECT template, term, tf * idf AS tw FROM wording JOIN weights USING (term)),
        norms AS (SELECT template, licence, rank, must, never, sqrt(sum(tw * tw)) AS norm FROM pattern JOIN templates USING (template) GROUP BY ALL),
        held AS (SELECT r, sha256(t) AS key, t FROM files WHERE regexp_matches(t, {text(TRIGGER)})),
        pieces AS (SELECT key, unnest(w) AS x, generate_subscripts(w, 1) AS piece FROM (SELECT key, string_split_regex(regexp_replace(any_value(t), '([.!?])["'')]*[ \t\n\x0B\f\r]+', '\1' || chr(10), 'g'), '[\r\n]+') AS w FROM held GROUP BY key)),
        terms AS (SELECT key, piece, licence_word, term, count(*) AS tf FROM (SELECT key, piece, regexp_matches(x, {text(TRIGGER)}) AS licence_word, unnest({terms('x')}) AS term FROM pieces) GROUP BY ALL),
        words AS (SELECT key, dense_rank() OVER (PARTITION BY key ORDER BY piece) AS piece, licence_word, term, tf, coalesce(idf, (SELECT max(idf) FROM weights)) AS w FROM terms LEFT JOIN weights USING (term)),
        wholes AS (SELECT key, term, sum(tf) * any_value(w) AS hw FROM words GROUP BY ALL),
        whole AS ({hits('wholes', 'key', 'true')}),
        rest AS (SELECT * FROM words ANTI JOIN (SELECT key FROM whole WHERE rank = 2) USING (key)),
        own AS (SELECT *, sum(licence_word) OVER (PARTITION BY key ORDER BY piece) AS so_far FROM (SELECT key, piece, max(CAST(licence_word AS INT)) AS licence_word FROM rest GROUP BY ALL)),
        runs AS (SELECT a.key, a.piece AS x, b.piece AS y, row_number() OVER () AS run FROM own a JOIN own b ON a.key = b.key AND b.piece BETWEEN a.piece AND a.piece + {WINDOW - 1} WHERE b.so_far - a.so_far + a.licence_word > 0),
        parts AS (SELECT run, term, sum(tf) * any_value(w) AS hw FROM runs JOIN rest ON rest.key = runs.key AND piece BETWEEN x AND y GROUP BY ALL),
        part AS ({hits('parts', 'run', 'false')}),
        found AS (SELECT key, max(struct_pack(rank := rank, whole := whole, similarity := similarity, place := -template, licence := licence)) AS hit FROM
                  (SELECT key, template, licence, rank, similarity, whole FROM whole UNION ALL SELECT key, template, licence, rank, similarity, part.whole FROM part JOIN runs USING (run)) GROUP BY key),
        judged AS (SELECT files.doc_id, path, regexp_replace(path, '/?[^/]*$', '') AS folder, hit.licence AS licence, hit.similarity AS similarity, coalesce(hit.whole, false) AS whole FROM files LEFT JOIN held USING (r) LEFT JOIN found USING (key)),
        given AS (SELECT folder, arg_min(licence, struct_pack(n := -n, licence := licence)) AS folder_licence FROM (SELECT folder, licence, count(*) AS n FROM judged WHERE whole AND licence IS NOT NULL GROUP BY ALL) GROUP BY folder),
        up(leaf, folder, steps) AS (SELECT DISTINCT folder, folder, 0 FROM judged UNION ALL SELECT leaf, regexp_replace(folder, '/?[^/]*$', ''), steps + 1 FROM up WHERE folder <> ''),
        near AS (SELECT leaf, arg_min(folder, steps) AS inherited_from, arg_min(folder_licence, steps) AS folder_licence FROM up JOIN given USING (folder) GROUP BY leaf)
        SELECT doc_id, path, licence AS own_licence, round(similarity, 6) AS similarity, whole AS licence_file, CASE WHEN licence IS NULL THEN inherited_from END AS inherited_from, coalesce(licence, folder_licence) AS licence
        FROM judged LEFT JOIN near ON leaf = judged.folder
    """


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_chat_format": op1_chat_format,
    "op2_secret_scan": op2_secret_scan,
    "op3_line_quality": op3_line_quality,
    "op4_decontaminate": op4_decontaminate,
    "op5_token_count": op5_token_count,
    "op6_toxicity": op6_toxicity,
    "op7_best_fit_packing": op7_best_fit_packing,
    "op8_license_scan": op8_license_scan,
    "op9_warc_archive": op9_warc_archive,
    "op10_ngram_jaccard": op10_ngram_jaccard,
}

_SEEN = r"[^\x20\x09-\x0D]"


def _secret_sql() -> str:
    from .secret_scan import ACCESS, ASSIGN, ASSIGNED, HEX, KINDS, LEAST, RUN, WORD

    quoted = lambda pattern: "'" + pattern.replace("'", "''") + "'"
    cut = lambda p, group: f"string_split_regex(t, {quoted(p)}) AS gaps, regexp_extract_all(t, {quoted(p)}) AS f, regexp_extract_all(t, {quoted(p)}, {group}) AS v"
    size = "lambda x: length(x)"

    def spans(rank: int, source: str, p: str, group: int = 0, least: int = 0) -> str:
        start = f"list_sum(list_transform(gaps[1:i], {size})) + coalesce(list_sum(list_transform(f[1:i - 1], {size})), 0)"
        return (
            f"SELECT r, {rank} AS rank, f[i] AS w, CAST({start} AS BIGINT) AS a, CAST({start} + length(f[i]) AS BIGINT) AS b FROM "
            f"(SELECT *, unnest(range(1, len(f) + 1)) AS i FROM (SELECT r, {cut(p, group)} FROM {source} WHERE regexp_matches(t, {quoted(p)}))) WHERE length(v[i]) >= {least}"
        )

    def blanked(source: str, p: str, group: int = 0, least: int = 0) -> str:
        piece = f"lambda z: z[1] || coalesce(CASE WHEN length(z[3]) >= {least} THEN repeat(' ', length(z[2])) ELSE z[2] END, '')"
        return f"SELECT r, array_to_string(list_transform(list_zip(gaps, f, v), {piece}), '') AS t FROM (SELECT r, {cut(p, group)} FROM {source})"

    pair = "(ascii(w[k]) - 32) * 96 + ascii(w[k + 1]) - 32"
    listed = lambda rank: f"coalesce(string_agg({list(KINDS)}[rank + 1] || ':' || a || ':' || b, ',' ORDER BY a, rank) FILTER (rank < {rank}), '')"
    return rf"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
        o AS (SELECT w, count(*) AS n FROM (SELECT unnest(regexp_extract_all(t, {quoted(WORD)})) AS w FROM d) GROUP BY w),
        u AS (SELECT unnest([substring(sha256(id), 1, 40), replace(base64(unhex(sha256(id))), '=', ''), upper(regexp_replace(base64(unhex(sha256('u' || id))), '[+/=]', '', 'g'))]) AS w, 1 AS n
              FROM (SELECT CAST(range AS VARCHAR) AS id FROM range(4000))),
        p AS (SELECT m, {pair} AS pair, sum(n) AS n FROM (SELECT m, w, n, unnest(range(1, length(w))) AS k FROM (SELECT 'o' AS m, * FROM o UNION ALL SELECT 'u', * FROM u)) GROUP BY 1, 2),
        g AS (SELECT m, a, b, coalesce(n, 0) AS n FROM (SELECT x.m, y.range AS a, z.range AS b FROM (VALUES ('o'), ('u')) x(m), range(96) y, range(96) z) LEFT JOIN (SELECT m, pair // 96 AS a, pair % 96 AS b, n FROM p) USING (m, a, b)),
        h AS (SELECT *, 0.5::DOUBLE + sum(n) OVER (PARTITION BY m, b) AS second, sum(n) OVER (PARTITION BY m, a) AS own, sum(n) OVER (PARTITION BY m) + 32.5::DOUBLE AS total FROM g),
        l AS (SELECT m, a, b, ln((n + 20::DOUBLE * second / total) / (own + 20::DOUBLE)) AS v FROM h),
        q AS (SELECT x.a * 96 + x.b AS pair, round(x.v - y.v, 4) AS v FROM l x JOIN l y ON x.a = y.a AND x.b = y.b AND x.m = 'u' AND y.m = 'o'),
        base AS ({spans(0, "d", ASSIGN, 2, ASSIGNED)} UNION ALL {spans(1, "d", ACCESS)} UNION ALL {spans(2, "d", HEX)}),
        t1 AS ({blanked("d", ASSIGN, 2, ASSIGNED)}), t2 AS ({blanked("t1", ACCESS)}), t3 AS ({blanked("t2", HEX)}),
        runs AS ({spans(3, "t3", RUN)}),
        hit AS (SELECT r, a FROM (SELECT r, a, {pair} AS pair FROM (SELECT *, unnest(range(1, length(w))) AS k FROM runs)) JOIN q USING (pair) GROUP BY r, a HAVING sum(v) >= {LEAST}),
        s AS (SELECT r, rank, a, b FROM base UNION ALL SELECT r, rank, a, b FROM runs SEMI JOIN hit USING (r, a))
        SELECT doc_id, count(*) FILTER (rank = 0) AS n_assign, count(*) FILTER (rank = 1) AS n_access, count(*) FILTER (rank = 2) AS n_hex,
               sha256({listed(3)}) AS base_sha256, {listed(4)} AS spans, count(*) FILTER (rank = 3) AS n_markov
        FROM d LEFT JOIN s USING (r) GROUP BY r, doc_id
    """



ORACLE_SQL: dict[str, str] = {
    "op1_chat_format": r"""
        WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
                   UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok')
        SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
               CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
               sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
               CAST(sum(length('### : </turn>') + 1 + length(regexp_replace(role || text, '[\\#<:]', 'xx', 'g'))) AS BIGINT) AS formatted_chars
        FROM c GROUP BY conv_id
    """,
    "op2_secret_scan": _secret_sql(),
    "op3_line_quality": rf"""
        WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
        w AS (SELECT doc_id, unnest(l) AS w, generate_subscripts(l, 1) AS k FROM (SELECT doc_id, regexp_extract_all(t, '{_SEEN}+') AS l FROM d)),
        g AS (SELECT doc_id, k, w, lead(w, 1) OVER p AS w1, lead(w, 2) OVER p AS w2 FROM w WINDOW p AS (PARTITION BY doc_id ORDER BY k)),
        r AS (SELECT DISTINCT doc_id, k + j AS k FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, w, w1, w2) AS n FROM g WHERE w2 IS NOT NULL), range(3) x(j) WHERE n > 1),
        l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM d),
        b AS (SELECT d.doc_id, source, t, (SELECT count(*) FROM w WHERE w.doc_id = d.doc_id) AS n_words, (SELECT coalesce(sum(length(w)), 0) FROM w WHERE w.doc_id = d.doc_id) AS word_chars,
                     length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, (SELECT count(*) - count(DISTINCT l) FROM l WHERE l.doc_id = d.doc_id AND regexp_matches(l, '{_SEEN}')) AS n_dup_lines,
                     (SELECT count(*) FROM r WHERE r.doc_id = d.doc_id) AS n_repeat_words FROM d),
        u AS (SELECT source, t, lower(array_to_string(q, ' ')) AS line, sum(len(q)) AS words FROM (SELECT source, t, regexp_extract_all(unnest(string_split(t, chr(10))), '{_SEEN}+') AS q FROM (SELECT DISTINCT source, t FROM d)) WHERE len(q) > 0 GROUP BY 1, 2, 3),
        f AS (SELECT source, line FROM u GROUP BY 1, 2 HAVING count(*) > 20),
        o AS (SELECT source, t, sum(words) AS lost FROM u JOIN f USING (source, line) GROUP BY 1, 2)
        SELECT doc_id, n_words, CAST(word_chars AS BIGINT) AS word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
               CAST(coalesce(lost, 0) AS BIGINT) AS lost_words, NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND coalesce(lost, 0) <= 0.5 * n_words AND n_words - coalesce(lost, 0) >= 50 AS kept
        FROM b LEFT JOIN o ON o.source = b.source AND o.t = b.t
    """,
    "op8_license_scan": _licence_sql(),
    "op9_warc_archive": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS h, encode(coalesce(html, '')) AS b FROM pages),
        q AS (SELECT page_id, octet_length(b) AS n, sha1(h) AS d, max(page_id) OVER (PARTITION BY h) AS top FROM p)
        SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest,
               CASE WHEN n >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN n >= 1000 AND page_id <> top THEN top END AS refers_to
        FROM q
    """,
    "op10_ngram_jaccard": rf"""
        WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_SEEN}+') AS w FROM documents),
        s AS (SELECT doc_id, list_sort(list_distinct(list_transform(range(1, greatest(2, len(w) - 3)), lambda k: array_to_string(w[k:k + 4], ' ')))) AS g FROM d WHERE len(w) > 0),
        c AS (SELECT g, min(doc_id) AS c, len(any_value(g)) AS n FROM s GROUP BY g),
        x AS (SELECT c, n, unnest(g) AS h FROM c),
        p AS (SELECT a.c AS p, b.c AS q FROM x a JOIN x b ON a.h = b.h AND a.c <> b.c GROUP BY a.c, b.c, a.n, b.n HAVING 5 * count(*) >= 4 * (a.n + b.n - count(*))),
        r(c, root) AS (SELECT c, c FROM c UNION SELECT p.q, r.root FROM r JOIN p ON p.p = r.c),
        m AS (SELECT c, min(root) AS root FROM r GROUP BY c), k AS (SELECT p AS c, count(*) AS n FROM p GROUP BY 1)
        SELECT doc_id, root AS class_id, c.c AS copy_id, coalesce(k.n, 0) AS n_links FROM s JOIN c USING (g) JOIN m ON m.c = c.c LEFT JOIN k ON k.c = c.c
    """,
}
