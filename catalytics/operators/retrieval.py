"""Batch keyword retrieval and prompt assembly.

Relevance of a corpus row for a question is the number of (column, word)
pairs where the column text contains the word, case-insensitively, summed
over the question's words (duplicates count twice). Only rows with relevance
> 0 are kept; the best ``n`` per question win, ties in corpus order.

Exact, and no (question, row) pair is written:

* a word holds only word characters, so it occurs in a text iff it occurs
  inside one of the text's word tokens; the corpus vocabulary is matched to the distinct
  query words through a q-gram index (``substrings``), so one row per key and query word is left (``postings``);
* questions with the same words are one *bag*, scored once; words of a question with a category are terms of their own, whose
  postings are those of rows of the category's types only (F8: phrases are matched the same way against distinct ``product_type``);
* rows are dealt to shards of some ``SEED_POSTINGS`` postings by a hash of their key, bags to chunks of ``CHUNK``; a task meets one
  shard with one chunk, adds up the scores in an array over the shard's keys and gives out the ``n`` best per bag (``best_of_cell``).

Shuffled are the postings once per chunk and the bags once per shard, and ``n`` rows per bag and shard.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed, parse
from ..session import materialise
from .substrings import contains_pairs

#: Postings of a shard and bags of a chunk, about: they bound the memory of a task. The result is the same for any of them.
SEED_POSTINGS, CHUNK = 1 << 18, 1 << 12

# Python's ``\W`` on text: anything but a letter, a number or "_". Java's
# ``(?U)\W`` would also keep combining marks and every connector punctuation.
WORD_SPLIT = r"[^\p{L}\p{N}_]+"


# --- question scalars -----------------------------------------------------------

def query_terms(q, stop_words: list[str] | None = None) -> Column:
    """Lower-case words longer than 2 characters, stop words removed, duplicates kept."""
    stop = F.array(*[F.lit(s) for s in (stop_words or fixed.STOP_WORDS)])
    words = F.split(F.lower(parse._c(q)), WORD_SPLIT)
    return F.filter(words, lambda w: (F.length(w) > 2) & ~F.array_contains(stop, w))


def category_phrase(q) -> Column:
    """P25: first ``in|for|category|type <letters, blanks, hyphens>`` phrase, stripped."""
    grp = F.regexp_extract(parse._c(q), "(?iU)" + fixed.CATEGORY_PATTERN, 1)
    return F.nullif(parse.pystrip(grp), F.lit(""))


# --- retrieval ----------------------------------------------------------------------

def _tokens(corpus: DataFrame, key: str, kind: Column, columns: list[str]) -> DataFrame:
    """(key, kind, bit of the column, token): the distinct tokens of each searched text, of three characters and more.

    One pass over the corpus: the searched columns become an array of
    (bit, text) pairs that is exploded, then each text is split once.
    """
    texts = F.array(*[F.struct(F.lit(1 << i).alias("bit"), F.col(c).cast("string").alias("txt")) for i, c in enumerate(columns)])
    pairs = corpus.select(F.col(key).alias("key"), kind.alias("kind"), F.explode(texts).alias("p"))
    found = F.filter(F.array_distinct(F.split(F.lower(F.coalesce(F.col("p.txt"), F.lit(""))), WORD_SPLIT)), lambda t: F.length(t) >= 3)
    return pairs.select("key", "kind", F.col("p.bit").alias("bit"), F.explode(found).alias("token"))


def postings(tokens: DataFrame, words: DataFrame) -> DataFrame:
    """``(key, kind, word, hits)``: the ``words`` that occur in a row of the corpus, and the number of columns that contain them.

    The pairs of token and word are written first, so that the size of what meets the corpus is known. Rows without a key are left out.
    """
    match = materialise(contains_pairs(tokens.select(F.col("token").alias("value")), words.select(F.col("word").alias("needle"))), "word-tokens")
    found = tokens.where(F.col("key").isNotNull()).join(match, F.col("token") == F.col("value"))
    return found.groupBy("key", "kind", F.col("needle").alias("word")).agg(F.bit_count(F.bit_or("bit")).alias("hits"))


def bags(words: DataFrame, terms: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(qid, bag)`` and the distinct bags ``(bag, content)``: the terms of a question and how often it has them."""
    own = words.join(terms, F.col("word").eqNullSafe(F.col("term_word")) & F.col("cat").eqNullSafe(F.col("term_cat")))
    own = own.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("term", "mult"))).alias("content"))
    own = materialise(own, "question-terms")
    distinct = materialise(own.select("content").distinct().withColumn("bag", F.monotonically_increasing_id()), "bags")
    return own.join(distinct, "content").select("qid", "bag"), distinct


def best_of_cell(n: int):
    """The ``n`` best keys of a shard for each bag of a chunk: ``(bag, key, score)``, ties to the smaller key."""
    def run(hits: pa.Table, asked: pa.Table) -> pa.Table:
        out = [(np.zeros(0, np.int64),) * 3]
        if hits.num_rows:
            keys, slot = np.unique(hits["key"].to_numpy(), return_inverse=True)
            order = np.argsort(hits["term"].to_numpy(), kind="stable")
            slot, weight = slot[order], hits["hits"].to_numpy()[order].astype(np.int64)
            terms, first = np.unique(hits["term"].to_numpy()[order], return_index=True)
            last = np.append(first[1:], len(order))
            for bag, content in zip(asked["bag"].to_pylist(), asked["content"].to_pylist(), strict=True):
                score = np.zeros(len(keys), np.int64)
                for item in content:
                    at = np.searchsorted(terms, item["term"])
                    if at < len(terms) and terms[at] == item["term"]:
                        rows = slice(first[at], last[at])
                        np.add.at(score, slot[rows], weight[rows] * item["mult"])
                least = max(1, np.partition(score, -n)[-n]) if len(score) > n else 1
                above, equal = np.flatnonzero(score > least), np.flatnonzero(score == least)
                best = np.append(above, equal[:n - len(above)])  # slots are in the order of the keys
                out.append((np.full(len(best), bag), keys[best], score[best]))
        return pa.table([np.concatenate(c) for c in zip(*out, strict=True)], ["bag", "key", "score"])

    return run


def scored_rows(words: DataFrame, hits: DataFrame, n: int, kinds: DataFrame | None = None) -> DataFrame:
    """``(qid, key, score)``: of each shard of the corpus the ``n`` best rows of every question, with exact scores.

    ``words``: ``(qid, cat, word, mult)``, distinct words of each question; ``kinds``: the types ``(cat, kind)`` of each category.
    """
    terms = words.select(F.col("cat").alias("term_cat"), F.col("word").alias("term_word")).distinct()
    terms = materialise(terms.withColumn("term", F.monotonically_increasing_id()), "terms")
    of_question, content = bags(words, terms)
    chunks = -(-content.count() // CHUNK) or 1
    asked = content.withColumn("chunk", F.pmod("bag", F.lit(chunks)))

    hits = hits.select(F.col("key").cast("long").alias("key"), "kind", "word", F.col("hits").cast("long").alias("hits"))
    wanted = terms.where(F.col("term_cat").isNull()).select(F.col("term_word").alias("word"), "term")
    found = hits.join(wanted, "word").select("key", "term", "hits")
    if kinds is not None:
        bound = kinds.join(terms, F.col("cat") == F.col("term_cat")).select("kind", F.col("term_word").alias("word"), "term")
        found = found.unionByName(hits.join(materialise(bound, "bound-terms"), ["kind", "word"]).select("key", "term", "hits"))
    found = materialise(found, "postings")  # a key of several types has a row for each
    shards = -(-found.count() // SEED_POSTINGS) or 1
    used = materialise(asked.select("chunk", F.explode("content.term").alias("term")).distinct(), "chunk-terms")
    cells = found.join(used, "term").withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards)))
    everywhere = asked.withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))))
    best = (cells.groupBy("shard", "chunk").cogroup(everywhere.groupBy("shard", "chunk"))
            .applyInArrow(best_of_cell(n), "bag long, key long, score long"))
    return of_question.join(best, "bag").select("qid", "key", "score")


def retrieve(corpus: DataFrame, questions: DataFrame, key: str = "row_seq", qid: str = "qid",
             question: str = "question", category: str | None = "category", n: int = fixed.RETRIEVE_TOP_N,
             search_columns: list[str] | None = None) -> DataFrame:
    """R1 over a table of questions: ``(qid, rank, key, score)``, at most ``n`` per question.

    ``category`` names a column of ``questions`` holding the category phrase
    (None or a null value: no category filter). Questions without search
    words get the first ``n`` rows (of their category) with score 0. ``key`` is a whole number.
    """
    cols = [c for c in (search_columns or fixed.SEARCH_COLUMNS) if c in corpus.columns]
    has_type = "product_type" in corpus.columns  # without it the category filter is skipped
    use_category = category is not None and has_type
    q = questions.select(F.col(qid).alias("qid"), query_terms(F.col(question)).alias("words"),
                         (F.lower(F.col(category)) if use_category else F.lit(None).cast("string")).alias("cat"))
    words = q.select("qid", "cat", F.explode("words").alias("word")).groupBy("qid", "cat", "word").agg(F.count(F.lit(1)).alias("mult"))
    words = materialise(words, "question-words")
    kind = F.lower(F.coalesce(F.col("product_type").cast("string"), F.lit(""))) if use_category else F.lit("")
    cats = q.where(F.col("cat").isNotNull()).select(F.col("cat").alias("needle"))
    kinds = None
    if use_category:
        kinds = contains_pairs(corpus.select(kind.alias("value")), cats).select(F.col("value").alias("kind"), F.col("needle").alias("cat"))
        kinds = materialise(kinds, "category-types")
    hits = postings(_tokens(corpus, key, kind, cols), words)
    if use_category:
        hits = materialise(hits, "hits")  # read for questions with and without a category
    scored = scored_rows(words, hits, n, kinds)
    w = Window.partitionBy("qid").orderBy(F.desc("score"), F.col("key"))
    best = (scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
            .select("qid", "rank", F.col("key").alias(key), F.col("score").cast("bigint").alias("score")))

    # questions without words: the first n rows of their (category-filtered) corpus
    empty = q.where(F.size("words") == 0).select("qid", "cat",
                                                  F.explode(F.sequence(F.lit(1), F.lit(n))).alias("rank"))
    rows = corpus.select(F.col(key), kind.alias("kind"))
    first_all = rows.orderBy(key).limit(n).withColumn(
        "rank", F.row_number().over(Window.orderBy(key))).select("rank", key)  # n rows only
    fallback = empty.where(F.col("cat").isNull()).join(first_all, "rank").select("qid", "rank", key)
    if use_category:
        by_cat = rows.join(kinds, "kind").withColumn(
            "rank", F.row_number().over(Window.partitionBy("cat").orderBy(key))).where(F.col("rank") <= n) \
            .select("cat", "rank", key)
        fallback = fallback.unionByName(empty.where(F.col("cat").isNotNull()).join(by_cat, ["cat", "rank"]).select("qid", "rank", key))
    return best.unionByName(fallback.withColumn("score", F.lit(0).cast("bigint")))


# --- context and prompts ------------------------------------------------------------

def context_lines(hits: DataFrame, corpus: DataFrame, key: str = "row_seq",
                  columns: list[str] | None = None) -> DataFrame:
    """R2: per question, the retrieved rows rendered as a pipe table (ordered by rank).

    Output ``(qid, context)``; questions without hits are absent.
    """
    cols = [c for c in (columns or fixed.CONTEXT_COLUMNS) if c in corpus.columns]
    header = "| " + " | ".join(cols) + " |\n|" + "|".join("---" for _ in cols) + "|"
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols]
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))
    rows = hits.join(corpus.select(key, *cols), key).select("qid", "rank", line.alias("line"))
    agg = rows.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "line"))).alias("ls"))
    table = F.array_join(F.transform("ls", lambda s: s["line"]), "\n")
    return agg.select("qid", F.concat(F.lit(fixed.CONTEXT_HEADER + header + "\n"), table).alias("context"))


def prompts(questions: DataFrame, contexts: DataFrame, qid: str = "qid", question: str = "question",
            category: str = "category") -> DataFrame:
    """R2 fallback messages + R3 messages per question: ``(qid, context, system, prompt)``."""
    no_hit = F.when(F.col(category).isNotNull(),
                    F.replace(F.lit(fixed.NO_HIT_WITH_CATEGORY), F.lit("{category}"), F.col(category))) \
        .otherwise(F.lit(fixed.NO_HIT))
    j = questions.join(contexts, qid, "left")
    ctx = F.coalesce(F.col("context"), no_hit)
    pre, mid = fixed.PROMPT_TEMPLATE.split("{context}")
    mid, post = mid.split("{question}")
    prompt = F.concat(F.lit(pre), ctx, F.lit(mid), F.col(question), F.lit(post))
    return j.select(F.col(qid), ctx.alias("context"), F.lit(fixed.SYSTEM_MESSAGE).alias("system"), prompt.alias("prompt"))


def preview_prompts(table: DataFrame, questions: DataFrame, order_key: str = "row_seq",
                    rows: int = fixed.PREVIEW_ROWS, qid: str = "qid", question: str = "question") -> DataFrame:
    """T7 + R4: the first ``rows`` rows of a table as text, in a prompt per question.

    The preview is one bounded string (``rows`` lines), computed once as a
    scalar subquery and placed into every question's prompt.
    """
    cols = [c for c in table.columns if c != order_key]
    head = table.orderBy(order_key).limit(rows)
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit(""))
                                                      for c in cols]), F.lit(" |"))
    header = "| " + " | ".join(cols) + " |\n|" + "|".join("---" for _ in cols) + "|\n"
    text = head.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order_key), line.alias("l")))),
                                             lambda s: s["l"]), "\n").alias("t"))
    preview = F.concat(F.lit(header), text.select("t").scalar())
    pre, mid = fixed.PREVIEW_TEMPLATE.split("{preview}")
    mid, post = mid.split("{question}")
    return questions.select(F.col(qid), F.concat(F.lit(pre), preview, F.lit(mid), F.col(question), F.lit(post))
                            .alias("prompt"))


def transcripts(conversations: DataFrame, greeting: str = fixed.GREETING) -> DataFrame:
    """Each conversation as ordered transcript lines - the greeting, then the turns.

    Output ``(conv_id, turn, line)`` with the greeting at ``turn = -1``; order
    by ``(conv_id, turn)`` to read a transcript. Lines stay separate rows, so a
    very long conversation is never gathered into one value or one task.
    """
    greet = conversations.select("conv_id").distinct().select(
        "conv_id", F.lit(-1).cast("bigint").alias("turn"), F.lit("assistant: " + greeting).alias("line"))
    turns = conversations.select("conv_id", F.col("turn").cast("bigint").alias("turn"),
                                 F.concat(F.col("role"), F.lit(": "), F.col("text")).alias("line"))
    return greet.unionByName(turns)
