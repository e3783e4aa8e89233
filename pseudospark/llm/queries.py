"""The registered queries of the operators, each over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pseudospark.llm.conversations import damaged, repaired
from pseudospark.llm.decontamination import contamination
from pseudospark.llm.divergence import source_divergence
from pseudospark.llm.html_text import main_texts
from pseudospark.llm.licenses import license_scan
from pseudospark.llm.line_dedup import without_repeated_lines
from pseudospark.llm.near_dup import near_duplicates
from pseudospark.llm.quality import quality_scores
from pseudospark.llm.sharding import Tree, sharded
from pseudospark.llm.tables import read_table
from pseudospark.llm.token_counts import TokenCache, token_counts
from pseudospark.llm.tokens import encoded
from pseudospark.llm.topk import top_inner_products
from pseudospark.llm.toxicity import toxicity_scores
from pseudospark.sources.files import Workspace

SHARDS = 40


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    done = without_repeated_lines(docs, Workspace(spark))
    return done.select(
        "doc_id",
        F.col("line_count").cast("long").alias("n_lines"),
        F.size("removed_lines").cast("long").alias("n_removed"),
        F.col("deduplicated").alias("text"),
    )


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharded(read_table(spark, sf_dir, "documents"), Tree.even(SHARDS), Workspace(spark))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(
        read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"), Workspace(spark)
    )
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_inner_products(read_table(spark, sf_dir, "embeddings"), Workspace(spark), query_modulus=50)


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = read_table(spark, sf_dir, "documents")
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return encoded(docs, path, public_tokenizers.PATTERN, with_ids=False)


def op7_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"), Workspace(spark), shingle=2)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(read_table(spark, sf_dir, "documents"))


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_texts(read_table(spark, sf_dir, "pages"), Workspace(spark))


def op11_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repaired(damaged(read_table(spark, sf_dir, "conversations")), Workspace(spark))
    return found.drop("n_turns", "system_first")


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    workspace = Workspace(spark)
    path = public_tokenizers.path("word_bpe_49k.json")
    cache = TokenCache(spark, workspace.path("cache"))
    return token_counts(read_table(spark, sf_dir, "documents"), path, cache, workspace).drop("digest")


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(read_table(spark, sf_dir, "documents"), Workspace(spark))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    f.__name__: f
    for f in (
        op1_quality, op2_line_dedup, op3_sharding, op4_decontamination, op5_topk,
        op6_bpe, op7_near_dup, op8_toxicity, op9_licenses, op10_html,
        op11_conversations, op12_token_counts, op13_divergence, pipeline,
    )
}

_WORDS_SQL = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{}')"
_CONTAMINATION_WORDS = _WORDS_SQL.format(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_SHINGLE_WORDS = _WORDS_SQL.format(r"[^\x20\x09-\x0D]+")

#: crc32 of an ASCII string: its table by rule, then one step for each character.
_CRC_BIT = "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
_CRC_TABLE = f"list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: {_CRC_BIT}))"
_CRC32_SQL = f"""
    xor(list_reduce(list_prepend(4294967295, list_transform(string_split(key, ''), lambda x: CAST(ascii(x) AS BIGINT))),
        lambda c, b: xor(c >> 8, entries[CAST(xor(c, b) & 255 AS INTEGER) + 1])), 4294967295)
"""

ORACLE = {
    "op2_line_dedup": """
        WITH lines AS (
            SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
                   unnest(range(len(string_split(text, chr(10))))) AS place
            FROM documents),
        windows AS (
            SELECT *, lead(line, 1) OVER w AS second, lead(line, 2) OVER w AS third, lead(place, 2) OVER w AS last
            FROM lines WINDOW w AS (PARTITION BY doc_id ORDER BY place)),
        ordered AS (
            SELECT *, row_number() OVER (PARTITION BY line, second, third ORDER BY doc_id, place) AS nth
            FROM windows WHERE last IS NOT NULL AND trim(line || second || third) <> ''),
        gone AS (
            SELECT DISTINCT doc_id, place + i AS place
            FROM ordered, (SELECT unnest(range(3)) AS i) WHERE nth > 1),
        kept AS (
            SELECT l.doc_id, count(*) AS n_lines, count(g.place) AS n_removed,
                   string_agg(line, chr(10) ORDER BY l.place) FILTER (WHERE g.place IS NULL) AS text
            FROM lines l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.place = g.place GROUP BY l.doc_id)
        SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed,
               CASE WHEN d.text IS NOT NULL THEN coalesce(k.text, '') END AS text
        FROM documents d LEFT JOIN kept k USING (doc_id)
    """,
    "op4_decontamination": f"""
        WITH doc_words AS (SELECT doc_id, coalesce({_CONTAMINATION_WORDS}, []) AS words FROM documents),
        item_words AS (SELECT item_id, {_CONTAMINATION_WORDS} AS words FROM benchmark),
        item_windows AS (
            SELECT DISTINCT item_id, size, array_to_string(words[i + 1 : i + size], ' ') AS gram
            FROM (SELECT item_id, words, least(10, len(words)) AS size,
                         unnest(range(len(words) - least(10, len(words)) + 1)) AS i
                  FROM item_words WHERE len(words) > 0)),
        sizes AS (SELECT DISTINCT size FROM item_windows),
        doc_windows AS (
            SELECT doc_id, size, i, array_to_string(words[i + 1 : i + size], ' ') AS gram
            FROM (SELECT doc_id, words, size, unnest(range(len(words) - size + 1)) AS i
                  FROM doc_words, sizes WHERE len(words) >= size)),
        found AS (SELECT DISTINCT doc_id, item_id, i, size FROM doc_windows JOIN item_windows USING (size, gram)),
        hit AS (
            SELECT doc_id, count(DISTINCT place) AS n_hit
            FROM (SELECT doc_id, unnest(range(i, i + size)) AS place FROM found) GROUP BY doc_id),
        items AS (
            SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed
            FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY doc_id)
        SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit,
               coalesce(n_items, 0) AS n_items, sha256(coalesce(listed, '')) AS items_sha256,
               coalesce(n_hit, 0) > 0 AS contaminated
        FROM doc_words LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
    """,
    "op5_topk": """
        WITH parts AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS c
            FROM embeddings),
        scores AS (
            SELECT q.vec_id AS query_id, v.vec_id,
                   CAST(list_sum(list_transform(list_zip(q.c, v.c), lambda p: p[1] * p[2])) AS BIGINT) AS score
            FROM parts q JOIN parts v ON q.vec_id <> v.vec_id WHERE q.vec_id % 50 = 0),
        ranked AS (
            SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS place FROM scores)
        SELECT query_id, CAST(place AS INTEGER) AS rank, vec_id, score FROM ranked WHERE place <= 5
    """,
    "op7_near_dup": f"""
        WITH RECURSIVE words AS (SELECT doc_id, coalesce({_SHINGLE_WORDS}, []) AS w FROM documents),
        shingles AS (
            SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 2
                THEN list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])
                WHEN len(w) = 1 THEN w ELSE [] END) AS s
            FROM words),
        sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
        common AS (
            SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n_common
            FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
        links AS (
            SELECT x, y FROM common JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y
            WHERE 100 * n_common >= 80 * (p.n + q.n - n_common)),
        reached(doc_id, other) AS (
            SELECT doc_id, doc_id FROM documents
            UNION SELECT r.doc_id, l.y FROM reached r JOIN links l ON l.x = r.other),
        components AS (SELECT doc_id, min(other) AS component_id FROM reached GROUP BY doc_id)
        SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept
        FROM components LEFT JOIN sizes USING (doc_id)
    """,
    "op11_conversations": f"""
        WITH RECURSIVE plain AS (
            SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                   coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key
            FROM conversations),
        kinds AS (SELECT *, ({_CRC32_SQL}) % 20 AS kind FROM plain, (SELECT {_CRC_TABLE} AS entries)),
        damaged AS (
            SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
                   CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
                   unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy
            FROM kinds WHERE kind <> 0),
        ordered AS (
            SELECT *, row_number() OVER w AS place, lag(left(role, 1)) OVER w AS before,
                   row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS nth,
                   rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS said
            FROM damaged WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy)),
        judged AS (
            SELECT *, CASE WHEN said = '' THEN 'blank' WHEN nth > 1 THEN 'duplicate'
                           WHEN right(said, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault
            FROM ordered),
        counts AS (
            SELECT conv_id, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps,
                   count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
                   count(*) FILTER (fault = 'truncated') AS truncated,
                   count(*) FILTER (place > 1 AND before || left(role, 1) NOT IN ('su', 'ua', 'au')) AS illegal,
                   list(struct_pack(role := role, text := text, bad := fault IN ('blank', 'duplicate'),
                                    extra := CAST(fault = 'truncated' AS INTEGER)) ORDER BY place) AS turns
            FROM judged GROUP BY conv_id),
        -- Edits one by one; a place is what was said last. At most two insertions follow each other.
        steps AS (
            SELECT * FROM (VALUES
                ('', 'K', 's'), ('', 'K', 'u'), ('s', 'K', 'u'), ('u', 'K', 'a'), ('a', 'K', 'u'),
                ('', 'R', 'u'), ('s', 'R', 'u'), ('u', 'R', 'a'), ('a', 'R', 'u'),
                ('', 'I', 'u'), ('s', 'I', 'u'), ('u', 'I', 'a'), ('a', 'I', 'u'),
                ('', 'D', ''), ('s', 'D', 's'), ('u', 'D', 'u'), ('a', 'D', 'a')) AS t(here, edit, there)),
        walk(conv_id, used, added, here, cost, audit, said) AS (
            SELECT conv_id, 0, 0, '', 0, '', CAST([] AS VARCHAR[]) FROM counts
            UNION ALL
            SELECT conv_id, used, added, here, cost, audit, said FROM (
                SELECT w.conv_id, w.used + CAST(s.edit <> 'I' AS INTEGER) AS used,
                       CASE WHEN s.edit = 'I' THEN w.added + 1 ELSE 0 END AS added, s.there AS here,
                       w.cost + CASE s.edit WHEN 'K' THEN t.extra WHEN 'R' THEN 2 + t.extra WHEN 'D' THEN 3 ELSE 2 END
                           AS cost,
                       w.audit || s.edit AS audit,
                       CASE s.edit WHEN 'D' THEN w.said WHEN 'K' THEN list_append(w.said, t.role || ':' || t.text)
                           ELSE list_append(w.said, CASE s.there WHEN 'u' THEN 'user:' ELSE 'assistant:' END
                                                    || CASE s.edit WHEN 'R' THEN t.text ELSE '' END) END AS said
                FROM (SELECT walk.*, turns[used + 1] AS t, len(turns) AS n FROM walk JOIN counts
                      ON walk.conv_id IS NOT DISTINCT FROM counts.conv_id) w
                JOIN steps s ON s.here = w.here
                WHERE CASE s.edit WHEN 'I' THEN w.added < 2 WHEN 'D' THEN w.used < w.n
                      WHEN 'R' THEN w.used < w.n AND NOT t.bad
                      ELSE w.used < w.n AND NOT t.bad AND left(t.role, 1) = s.there END)
            QUALIFY row_number() OVER (PARTITION BY conv_id, used, added, here ORDER BY cost, audit) = 1),
        finished AS (
            SELECT w.conv_id, w.cost, w.audit, w.said
            FROM walk w JOIN counts c ON w.conv_id IS NOT DISTINCT FROM c.conv_id
            WHERE w.used = len(c.turns) AND (w.here = 'a' OR len(w.said) = 0)
            QUALIFY row_number() OVER (PARTITION BY w.conv_id ORDER BY w.cost, w.audit) = 1)
        SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
               coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
               CAST(coalesce(cost, 0) AS BIGINT) AS cost, coalesce(audit, '') AS audit,
               sha256(coalesce(array_to_string(said, chr(10)), '')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM conversations) o
        LEFT JOIN counts c ON o.conv_id IS NOT DISTINCT FROM c.conv_id
        LEFT JOIN finished f ON o.conv_id IS NOT DISTINCT FROM f.conv_id
    """,
    "op13_divergence": r"""
        WITH docs AS (
            SELECT row_number() OVER () AS id, coalesce(text, '') AS text, coalesce(lang, '') AS lang,
                   coalesce(source, '') AS source
            FROM documents),
        words AS (
            SELECT id, lang, source, unnest(regexp_extract_all(
                translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term
            FROM docs),
        kept AS (SELECT lang, term, count(*) AS n FROM words GROUP BY ALL HAVING count(DISTINCT id) >= 3),
        langs AS (SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY lang),
        used AS (SELECT lang, source, term, count(*) AS n FROM words SEMI JOIN kept USING (lang, term) GROUP BY ALL),
        groups AS (SELECT DISTINCT lang, source FROM docs),
        totals AS (SELECT lang, source, sum(n) AS total FROM used GROUP BY ALL),
        dense AS (
            SELECT g.lang, g.source, k.term, coalesce(u.n, 0) AS n,
                   1 + CAST(1000000000 AS HUGEINT) * (coalesce(u.n, 0) + 1) // (coalesce(t.total, 0) + l.v) AS p,
                   1 + CAST(1000000000 AS HUGEINT) * (k.n + 1) // (l.total + l.v) AS q
            FROM groups g JOIN kept k USING (lang) JOIN langs l USING (lang)
            LEFT JOIN totals t USING (lang, source) LEFT JOIN used u USING (lang, source, term)),
        found AS (
            SELECT a.lang, a.source, 'pair' AS part, b.source AS item,
                   CAST(coalesce(sum((x.p - y.p) * (x.p - y.p) // y.p), 0) AS BIGINT) AS value
            FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
            LEFT JOIN dense x ON x.lang = a.lang AND x.source = a.source
            LEFT JOIN dense y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term
            GROUP BY ALL
            UNION ALL
            SELECT lang, source, 'term', term, CAST((p - q) * (p - q) // q AS BIGINT) FROM dense WHERE n > 0 AND p > q),
        ranked AS (
            SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER)
                AS rank
            FROM found)
        SELECT * FROM ranked WHERE part = 'pair' OR rank <= 200
    """,
}
