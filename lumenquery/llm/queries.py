"""Registered queries of this subpackage and their SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .io import table


def op1_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ann import nearest

    return nearest(table(spark, sf_dir, "embeddings"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .token_count import token_counts

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lang_id import identify_documents

    return identify_documents(table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")).selectExpr("cast(doc_id as long) doc_id", "lang_id", "posterior", "accepted")


def language_id_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lang_id import identify_pages

    return identify_pages(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents")).select("page_id", "url", "lang_id", "posterior", "accepted")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring_dedup import remove_repeats

    out = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.selectExpr("cast(doc_id as long) doc_id", "n_words", "n_removed", "sha2(kept_text, 256) kept_sha256")


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_main import extract

    return extract(table(spark, sf_dir, "pages"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import contaminated

    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import toxicity

    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_dup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat import digests, format_conversations, linear_messages

    said = "<|im_end|><|im_start|>assistant ok"
    more = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").selectExpr("cast(conv_id as long) conv_id", "cast(turn as long) turn", "role", "text")
    return digests(format_conversations(linear_messages(rows.unionByName(more))))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_nearest": op1_nearest,
        "op2_mixing": op2_mixing,
        "op3_token_counts": op3_token_counts,
        "op4_language_id": op4_language_id,
        "language_id_pages": language_id_pages,
        "op5_substring_dedup": op5_substring_dedup,
        "op6_html_extraction": op6_html_extraction,
        "op7_decontamination": op7_decontamination,
        "op8_toxicity": op8_toxicity,
        "op9_chat_formatting": op9_chat_formatting,
        "op10_near_dup": op10_near_dup,
    }


OP2_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5('mix:' || coalesce(doc_id::VARCHAR, 'null')) AS perm FROM documents),
per AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3)::INT + 1] AS w
  FROM sized GROUP BY source),
lev AS (
  SELECT *, 2.0::DOUBLE * source_size AS cap,
         (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(2.0::DOUBLE * source_size) OVER r, 0.0)) / sum(w) OVER f AS level
  FROM per
  WINDOW r AS (ORDER BY 2.0::DOUBLE * source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
         f AS (ORDER BY 2.0::DOUBLE * source_size / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
goal AS (
  SELECT source, source_size, CASE WHEN level * w >= cap THEN cap ELSE
         (SELECT arg_min(level, cap / w) FROM lev WHERE level * w < cap) * w END AS target FROM lev),
run AS (
  SELECT s.doc_id, s.size, g.source_size, g.target, floor(g.target)::BIGINT AS quota,
         coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.perm, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM sized s JOIN goal g ON s.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target,
       (CASE WHEN source_size > 0 THEN (quota // source_size) * size ELSE 0 END
        + greatest(0, least(size, CASE WHEN source_size > 0 THEN quota % source_size ELSE 0 END - before)))::BIGINT AS taken
FROM run
"""

OP9_SQL = r"""
WITH rows_ AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '<|im_end|><|im_start|>assistant ok'), (-1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok')),
x AS (
  SELECT *, 2 + length('<|im_start|>') + length(role) + length('<|im_end|>') + length(regexp_replace(text, '<(\\*)\|', '<\1\\|', 'g')) AS n FROM rows_)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(n)::BIGINT AS formatted_chars
FROM x GROUP BY conv_id
"""


OP5_SQL = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, unnest(range(1, len(w) - 33)) AS i, w FROM words WHERE len(w) >= 35),
hashed AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 34], ' ')) AS h FROM win),
again AS (SELECT h FROM hashed GROUP BY h HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS p FROM hashed SEMI JOIN again USING (h)),
gl AS (SELECT doc_id, list(p) AS ps FROM gone GROUP BY doc_id),
x AS (SELECT doc_id, w, coalesce(ps, []) AS ps FROM words LEFT JOIN gl USING (doc_id)),
k AS (SELECT doc_id, unnest(w) AS t, unnest(range(1, len(w) + 1)) AS p FROM words),
kept AS (SELECT k.doc_id, string_agg(t, ' ' ORDER BY k.p) AS s FROM k ANTI JOIN gone g ON k.doc_id = g.doc_id AND k.p = g.p GROUP BY k.doc_id)
SELECT x.doc_id, len(x.w)::BIGINT AS n_words, len(x.ps)::BIGINT AS n_removed, sha256(coalesce(kept.s, '')) AS kept_sha256
FROM x LEFT JOIN kept ON kept.doc_id = x.doc_id
"""

OP10_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT DISTINCT doc_id, s FROM (
    SELECT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
                               WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM words)),
n AS (SELECT doc_id, count(*)::BIGINT AS n_shingles FROM sets GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n_shingles + y.n_shingles - c)),
reach(doc, other) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT r.doc, l.b FROM reach r JOIN links l ON l.a = r.other),
least AS (SELECT doc, min(other) AS component_id FROM reach GROUP BY doc)
SELECT d.doc_id, coalesce(n.n_shingles, 0)::BIGINT AS n_shingles, l.component_id, d.doc_id = l.component_id AS kept
FROM documents d JOIN least l ON l.doc = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_mixing": OP2_SQL, "op5_substring_dedup": OP5_SQL, "op9_chat_formatting": OP9_SQL, "op10_near_dup": OP10_SQL}
