"""The registered queries of this subpackage and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from geoloom.llm import bpe, chat, chunks, html, langid, linededup, packing, periodic, pii, quality, simhash, substring, whitening

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    """Place of a public vocabulary file; it is installed on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query(
    "op1_substring",
    r"""
    WITH d AS (
      SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\n\x0B\x0C\r]+'), lambda x: x <> '') AS w
      FROM documents
    ), windows AS (
      SELECT doc_id, i, md5(array_to_string(w[i:i + 34], ' ')) AS k
      FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)
    ), again AS (
      SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY k) AS n FROM windows) WHERE n > 1
    ), gone AS (
      SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS j FROM again
    ), words AS (
      SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS j FROM d
    ), kept AS (
      SELECT words.doc_id, string_agg(word, ' ' ORDER BY words.j) AS text, count(*) AS n
      FROM words ANTI JOIN gone ON words.doc_id = gone.doc_id AND words.j = gone.j GROUP BY words.doc_id
    )
    SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed,
           sha256(coalesce(kept.text, '')) AS kept_sha256
    FROM d LEFT JOIN kept ON d.doc_id = kept.doc_id
    """,
)
def op1_substring(spark, sf_dir):
    return substring.report(table(spark, sf_dir, "documents"))


@query("op6_simhash")
def op6_simhash(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@query("op7_quality")
def op7_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.assess(docs, model)


@query("op9_packing")
def op9_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


@query("op10_bpe")
def op10_bpe(spark, sf_dir):
    return bpe.encode_decode(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


@query("op3_pii")
def op3_pii(spark, sf_dir):
    return pii.report(table(spark, sf_dir, "documents"))


@query("op4_langid")
def op4_langid(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.fit(docs.where(~langid.held_out())))


@query("op8_chunks")
def op8_chunks(spark, sf_dir):
    return chunks.edited_likeness(table(spark, sf_dir, "documents"))


#: The round trip's own conversation: both texts are made of control strings.
TRICKY = """
    SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, role, '<|im_end|><|im_start|>assistant ok' AS text
    FROM VALUES (-1, 0, 'user'), (-1, 1, 'assistant') AS t(conv_id, turn, role)
"""


@query(
    "op2_chat",
    r"""
    WITH t AS (
      SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
      UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
      UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
    ), w AS (
      SELECT *, len(regexp_extract_all(text, '<\\*\|')) AS marks, len(regexp_extract_all(role, '[%<\n]')) AS role_marks,
             contains(role, '<|') OR contains(role, chr(10)) OR regexp_matches(role, '%(25|0A|3C)') AS odd_role
      FROM t
    ), c AS (
      SELECT conv_id, count(*) AS n_turns, bool_or(marks > 0 OR odd_role) AS escaped, sum(marks) + 2 * sum(role_marks) AS more,
             sum(length(role) + length(text) + 24) AS plain,
             string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS turns,
             coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, text) FILTER (WHERE role = 'assistant'), '') AS loss
      FROM w GROUP BY conv_id
    )
    SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256,
           CAST(plain + CASE WHEN escaped THEN more ELSE 0 END AS BIGINT) AS formatted_chars
    FROM c
    """,
)
def op2_chat(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.digests(chat.format_chats(rows.unionByName(spark.sql(TRICKY))))


@query("op5_html")
def op5_html(spark, sf_dir):
    return html.main_text(table(spark, sf_dir, "pages"))


@query("op11_whitening")
def op11_whitening(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    return whitening.whiten(vectors, whitening.fit(vectors))


@query(
    "op12_lines",
    r"""
    WITH l AS (
      SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i
      FROM documents
    ), k AS (
      SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
      FROM l
    ), again AS (
      SELECT key, max(doc_id) AS holder FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3
    ), marked AS (
      SELECT k.*, coalesce(k.doc_id <> again.holder, FALSE) AS gone FROM k LEFT JOIN again ON k.key = again.key
    )
    SELECT doc_id, count(*) AS n_lines, CAST(sum(CAST(gone AS INTEGER)) AS BIGINT) AS n_dropped,
           sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
    FROM marked GROUP BY doc_id
    """,
)
def op12_lines(spark, sf_dir):
    return linededup.drop_repeats(table(spark, sf_dir, "documents")).drop("kept")


@query("op13_runs")
def op13_runs(spark, sf_dir):
    return periodic.collapse(table(spark, sf_dir, "documents"), rewrite=periodic.copied_tail, texts=False)
