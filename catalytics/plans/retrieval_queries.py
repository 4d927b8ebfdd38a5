"""Registered retrieval / prompt queries and their DuckDB oracles.

Corpus: ``documents`` as catalogue rows (title = "doc <id>", body_html =
text, product_type = lang, vendor = source). Questions: whole ``benchmark``
passages (retrieval) and whole user turns of ``conversations`` (terms,
categories, previews, transcripts).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed
from ..operators import retrieval as RT
from ..session import read_table
from . import fixtures
from . import sql as S


def corpus(spark, sf):
    d = read_table(spark, sf, "documents").repartition("doc_id")  # the table is one row group: one task
    return d.select(F.col("doc_id").alias("row_seq"),
                    F.concat(F.lit("doc "), F.col("doc_id").cast("string")).alias("title"),
                    F.col("text").alias("body_html"), F.col("lang").alias("product_type"),
                    F.col("source").alias("vendor"))


def bench_questions(spark, sf, with_category: bool):
    b = read_table(spark, sf, "benchmark")
    cat = RT.category_phrase("text") if with_category else F.lit(None).cast("string")
    return b.select(F.col("item_id").alias("qid"), F.col("text").alias("question"), cat.alias("category"))


def user_turns(spark, sf):
    c = read_table(spark, sf, "conversations").where(F.col("role") == "user")
    return c.select("conv_id", "turn", F.col("text").alias("question"),
                    (F.col("conv_id") * 1000 + F.col("turn")).alias("qid"))


def q_query_terms(spark, sf):
    t = user_turns(spark, sf).withColumn("terms", RT.query_terms("question"))
    return t.select("conv_id", "turn", F.array_join("terms", " ").alias("terms"),
                    F.size("terms").cast("bigint").alias("n_terms"))


def q_query_category(spark, sf):
    return user_turns(spark, sf).select("conv_id", "turn", RT.category_phrase("question").alias("category"))


def q_retrieve_topn(spark, sf):
    return RT.retrieve(corpus(spark, sf), bench_questions(spark, sf, False), category=None)


def q_prompts(spark, sf):
    qs = bench_questions(spark, sf, True)
    c = corpus(spark, sf)
    hits = RT.retrieve(c, qs, category="category")
    return RT.prompts(qs, RT.context_lines(hits, c))


def part_questions(spark, sf):
    """Questions that name real types, ask for words of real products, or hold no search word; all parts are searched for each."""
    p = read_table(spark, sf, "part").where(F.col("p_partkey") % 40 == 1)
    kind = F.lower("p_type")
    text = (F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("show me the best "), F.col("p_name"), F.lit(" in "), kind))
            .when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("some good "), F.col("p_name"), F.lit(" from "), F.col("p_brand")))
            .otherwise(F.lit("what is the best in a ")))
    return p.select(F.col("p_partkey").alias("qid"), text.alias("question")).withColumn("category", RT.category_phrase("question"))


def part_corpus(spark, sf):
    p = read_table(spark, sf, "part").repartition("p_partkey")
    return p.select(F.col("p_partkey").alias("row_seq"), F.col("p_name").alias("title"), F.col("p_brand").alias("vendor"),
                    F.col("p_type").alias("product_type"))


def q_retrieve_by_category(spark, sf):
    return RT.retrieve(part_corpus(spark, sf), part_questions(spark, sf), category="category")


def q_preview_prompt(spark, sf):
    table = fixtures.listings_raw(spark, sf)
    return RT.preview_prompts(table, user_turns(spark, sf))


def q_transcripts(spark, sf):
    return RT.transcripts(read_table(spark, sf, "conversations"))


QUERIES = {
    "q_query_terms": q_query_terms,
    "q_query_category": q_query_category,
    "q_retrieve_topn": q_retrieve_topn,
    "q_prompts": q_prompts,
    "q_retrieve_by_category": q_retrieve_by_category,
    "q_preview_prompt": q_preview_prompt,
    "q_transcripts": q_transcripts,
}


# --- oracles ------------------------------------------------------------------------------

def _sq(s: str) -> str:
    return s.replace("'", "''")


_STOP = "[" + ", ".join(f"'{w}'" for w in fixed.STOP_WORDS) + "]"
_TERMS = (r"list_filter(regexp_split_to_array(lower({x}), '[^\p{{L}}\p{{N}}_]+'), "
          r"lambda w: length(w) > 2 AND NOT list_contains(" + _STOP + ", w))")
_CAT = (r"nullif(regexp_replace(regexp_extract({x}, '(?i)(?:in|for|category|type)\s+([a-zA-Z\s\-]+)(?:\s|$)', 1),"
        r" '^\s+|\s+$', '', 'g'), '')")

_DOCS = """d AS (SELECT doc_id, 'doc ' || CAST(doc_id AS VARCHAR) AS title, text AS body_html, lang AS product_type,
              source AS vendor, lower('doc ' || CAST(doc_id AS VARCHAR)) AS l1, lower(coalesce(text, '')) AS l2,
              lower(coalesce(lang, '')) AS l3, lower(coalesce(source, '')) AS l4 FROM documents)"""


_PARTS = """d AS (SELECT p_partkey AS doc_id, lower(p_name) AS l1, '' AS l2, lower(p_type) AS l3, lower(p_brand) AS l4 FROM part)"""
_PART_QUESTIONS = """(SELECT p_partkey AS item_id, CASE p_partkey % 3 WHEN 0 THEN 'show me the best ' || p_name || ' in ' || lower(p_type)
           WHEN 1 THEN 'some good ' || p_name || ' from ' || p_brand ELSE 'what is the best in a ' END AS text
    FROM part WHERE p_partkey % 40 = 1)"""


def _retrieve_sql(with_category: bool, questions: str = "benchmark", docs: str = _DOCS) -> str:
    cat = _CAT.format(x="text") if with_category else "CAST(NULL AS VARCHAR)"
    return f"""q AS (SELECT item_id AS qid, text AS question, {_TERMS.format(x="text")} AS words, {cat} AS category
           FROM {questions}),
{docs},
pairs AS (SELECT q.qid, d.doc_id,
            list_sum(list_transform(q.words, lambda w: CAST(contains(d.l1, w) AS INTEGER) + CAST(contains(d.l2, w) AS INTEGER)
                                        + CAST(contains(d.l3, w) AS INTEGER) + CAST(contains(d.l4, w) AS INTEGER))) AS score
          FROM q, d
          WHERE len(q.words) > 0 AND (q.category IS NULL OR contains(d.l3, lower(q.category)))),
ranked AS (SELECT qid, doc_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank
           FROM pairs WHERE score > 0),
fallback AS (SELECT q.qid, d.doc_id, 0 AS score,
               row_number() OVER (PARTITION BY q.qid ORDER BY d.doc_id) AS rank
             FROM q, d WHERE len(q.words) = 0 AND (q.category IS NULL OR contains(d.l3, lower(q.category)))),
hits AS (SELECT qid, CAST(rank AS INTEGER) AS rank, doc_id AS row_seq, CAST(score AS BIGINT) AS score
         FROM ranked WHERE rank <= 5
         UNION ALL SELECT qid, CAST(rank AS INTEGER), doc_id, CAST(score AS BIGINT) FROM fallback WHERE rank <= 5)"""


_PREVIEW_COLS = ["page_number", "url", "name", "price", "original_price", "discount_percentage", "rating",
                 "sales_info", "image_url", "additional_badges"]
_PREVIEW_CELLS = ", ".join(f"coalesce(CAST({c} AS VARCHAR), '')" for c in _PREVIEW_COLS)
_PREVIEW_HEADER = "| " + " | ".join(_PREVIEW_COLS) + " |"
_PREVIEW_SEP = "|".join("---" for _ in _PREVIEW_COLS)
_V_PRE, _vrest = fixed.PREVIEW_TEMPLATE.split("{preview}")
_V_MID, _V_POST = _vrest.split("{question}")
_HEADER = "| title | vendor | product_type |\\n|---|---|---|"
_P_PRE, _rest = fixed.PROMPT_TEMPLATE.split("{context}")
_P_MID, _P_POST = _rest.split("{question}")
_NOHIT_CAT_PRE, _NOHIT_CAT_POST = fixed.NO_HIT_WITH_CATEGORY.split("{category}")

ORACLE = {
    "q_query_terms": f"""
SELECT conv_id, turn, array_to_string(t, ' ') AS terms, len(t) AS n_terms
FROM (SELECT conv_id, turn, {_TERMS.format(x="text")} AS t FROM conversations WHERE role = 'user')""",
    "q_query_category": f"""
SELECT conv_id, turn, {_CAT.format(x="text")} AS category FROM conversations WHERE role = 'user'""",
    "q_retrieve_topn": "WITH " + _retrieve_sql(False) + "\nSELECT * FROM hits",
    "q_retrieve_by_category": "WITH " + _retrieve_sql(True, _PART_QUESTIONS, _PARTS) + "\nSELECT * FROM hits",
    "q_prompts": "WITH " + _retrieve_sql(True) + f""",
ctx AS (SELECT h.qid, '{_sq(fixed.CONTEXT_HEADER)}' || replace('{_HEADER}', '\\n', chr(10)) || chr(10)
              || string_agg('| ' || d.title || ' | ' || coalesce(d.vendor, '') || ' | ' || coalesce(d.product_type, '')
                            || ' |', chr(10) ORDER BY h.rank) AS context
        FROM hits h JOIN d ON d.doc_id = h.row_seq GROUP BY h.qid),
fullctx AS (SELECT q.qid, q.question, coalesce(ctx.context,
           CASE WHEN q.category IS NOT NULL THEN '{_sq(_NOHIT_CAT_PRE)}' || q.category || '{_sq(_NOHIT_CAT_POST)}'
                ELSE '{_sq(fixed.NO_HIT)}' END) AS context
         FROM q LEFT JOIN ctx ON ctx.qid = q.qid)
SELECT qid, context, '{_sq(fixed.SYSTEM_MESSAGE)}' AS system, '{_sq(_P_PRE)}' || context || '{_sq(_P_MID)}' || question || '{_sq(_P_POST)}' AS prompt
FROM fullctx""",
    "q_preview_prompt": S.with_ctes(S.LISTINGS_RAW, f"""
, head AS (SELECT string_agg('| ' || concat_ws(' | ', {_PREVIEW_CELLS}) || ' |', chr(10) ORDER BY row_seq) AS t
           FROM (SELECT * FROM listings_raw ORDER BY row_seq LIMIT 20))
SELECT conv_id * 1000 + turn AS qid,
       '{_sq(_V_PRE)}' || '{_PREVIEW_HEADER}' || chr(10) || '|{_PREVIEW_SEP}|' || chr(10) || head.t
       || '{_sq(_V_MID)}' || text || '{_sq(_V_POST)}' AS prompt
FROM conversations, head WHERE role = 'user'"""),
    "q_transcripts": f"""
SELECT DISTINCT conv_id, CAST(-1 AS BIGINT) AS turn, 'assistant: {_sq(fixed.GREETING)}' AS line FROM conversations
UNION ALL
SELECT conv_id, CAST(turn AS BIGINT) AS turn, role || ': ' || text AS line FROM conversations""",
}
