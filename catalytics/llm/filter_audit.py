"""How filters of a chain act together: survivors of every subset of the filters, and what follows from them.

With five filters there are 32 subsets. A document becomes one 32-bit word: bit s is set if the document
survives all filters of subset s. How many words of a part have each bit set - a positional popcount, by
carry-save adders over whole arrays of words - are the survivors of all subsets; kept, removed, redundant and
unique documents of any order of the filters and their Shapley sums are differences of survivors.

The filters of the query: A under 200 words; B less than half of the words distinct; C more than 3 % capital
letters; D holds one of ``#$%&*|``; E equals the text of a smaller doc_id. A to D look at one text at a time. For
E a text is named by its SHA-256: the smallest id of each digest is found by an aggregate that combines
before its shuffle, and a document passes if its own (id, digest) is among those pairs - a join whose keys
are spread evenly, however many documents share a text.

Defined cases: a null text is an empty text (no words: fails A only, and E after another empty one). A null
doc_id equals no label and is never after another row, so it passes E; it is no first copy either. Rows that
share a doc_id count each; none of them is a copy of another. A null language is the part ``''``, as the empty
one. Null labels are not 1; a document counts as good or toxic if any of its label rows says so. An empty table has no
parts and gives no rows. Only ``doc_id``, ``text``, ``lang`` and ``doc_id``, ``quality``, ``toxic`` are read.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import read_table
from .common import documents, landed, per_batch, tidy

FILTERS = "ABCDE"
SUBSETS = 1 << len(FILTERS)
MIN_WORDS = 200
CAPITALS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SYMBOLS = b"#$%&*|"
#: Words that are counted in one go.
COUNTED = 1 << 16
#: The populations whose survivors are counted: all documents, those of quality 1, the toxic ones.
POPULATIONS = 3

FACTS = "doc_id long, part string, digest binary, failed int"
COUNTS = "part string, at int, n long"
REPORT = ("part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, "
          "toxic_lost long, shapley long")


def failed_filters(text: bytes) -> int:
    """Bits 0 to 3: the text fails A, B, C, D."""
    words = text.split()  # at ASCII white space: \x20 and \x09-\x0D
    capitals = len(text) - len(text.translate(None, CAPITALS))
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    code_points = len(text.translate(None, CONTINUATION))
    return ((len(words) < MIN_WORDS) | (100 * len(set(words)) < 50 * len(words)) << 1
            | (100 * capitals > 3 * code_points) << 2 | (symbols > 0) << 3)


CONTINUATION = bytes(range(0x80, 0xC0))


def _facts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    digests, failed = [], []
    for text in batch.column(2).cast(pa.binary()):
        text = text.as_py()
        digests.append(hashlib.sha256(text).digest())
        failed.append(failed_filters(text))
    yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(digests, pa.binary()), pa.array(failed, pa.int32())],
                                     ["doc_id", "part", "digest", "failed"])


def failures(docs: DataFrame) -> DataFrame:
    """``(doc_id, part, failed)``: one row per document with the bits of the filters that it fails."""
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["lang"].cast("string"), F.lit("")).alias("part"),
                       F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text"))
    facts = landed(per_batch(_facts, FACTS)(rows), "filter-facts")
    named = facts.where(F.col("doc_id").isNotNull())
    firsts = named.groupBy(F.col("digest").alias("text_")).agg(F.min("doc_id").alias("first_"))
    copy = F.lit(1 << FILTERS.index("E"))
    judged = (named.join(firsts, (F.col("doc_id") == F.col("first_")) & (F.col("digest") == F.col("text_")), "left")
              .withColumn("failed", F.when(F.col("first_").isNull(), F.col("failed").bitwiseOR(copy)).otherwise(F.col("failed"))))
    return judged.select("doc_id", "part", "failed").unionByName(facts.where(F.col("doc_id").isNull()).select("doc_id", "part", "failed"))


def survival_words(filters: int = len(FILTERS)) -> np.ndarray:
    """Per set of failed filters the word of the subsets that a document survives: those with no failed filter in them."""
    subsets = np.arange(1 << filters)
    alive = (subsets[:, None] & subsets[None, :]) == 0
    return (alive.astype(np.uint64) << subsets.astype(np.uint64)).sum(axis=1).astype(np.uint32)


def positional_popcount(words: np.ndarray) -> np.ndarray:
    """How many of the 32-bit words have each bit set, bit 0 first.

    Three words of one weight become a sum word of that weight and a carry word of the double weight, all triples
    of an array at once, until two words at most are left of a weight.
    """
    counts = np.zeros(32, np.int64)
    planes: list[list[np.ndarray]] = [[words.astype(np.uint32)]]
    weight = 0
    while weight < len(planes):
        level = np.concatenate(planes[weight])
        while len(level) > 2:
            third = len(level) // 3
            a, b, c = level[:third], level[third:2 * third], level[2 * third:3 * third]
            half = a ^ b
            if weight + 1 == len(planes):
                planes.append([])
            planes[weight + 1].append((a & b) | (half & c))
            level = np.concatenate([half ^ c, level[3 * third:]])
        counts += ((level[:, None] >> np.arange(32, dtype=np.uint32)) & 1).sum(axis=0, dtype=np.int64) << weight
        weight += 1
    return counts


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words, held, rows = survival_words(), [], 0

    def counted():
        table = pa.Table.from_batches(held).combine_chunks()
        parts = table["part"].chunk(0).dictionary_encode()
        which = parts.indices.to_numpy()
        word = words[table["failed"].to_numpy()]
        chosen = [np.ones(len(word), bool), table["good"].to_numpy(), table["toxic"].to_numpy()]
        names, at, n = [], [], []
        for code, part in enumerate(parts.dictionary.to_pylist()):
            mine = which == code
            names += [part] * (POPULATIONS * SUBSETS)
            at.append(np.arange(POPULATIONS * SUBSETS, dtype=np.int32))
            n += [positional_popcount(word[mine & population]) for population in chosen]
        return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(np.concatenate(at)), pa.array(np.concatenate(n))], ["part", "at", "n"])

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            rows += batch.num_rows
        if rows >= COUNTED:
            yield counted()
            held, rows = [], 0
    if held:
        yield counted()


def survivors(failed: DataFrame, labels: DataFrame) -> DataFrame:
    """``(part, n array<long>)``: survivors of the 32 subsets among all documents, the good and the toxic ones (96 numbers)."""
    marks = (labels.where(labels["doc_id"].isNotNull()).select(labels["doc_id"].cast("long").alias("id_"), (F.col("quality") == 1).alias("good_"),
                                                                (F.col("toxic") == 1).alias("toxic_"))
             .where(F.col("good_") | F.col("toxic_")).groupBy("id_").agg(F.max("good_").alias("good_"), F.max("toxic_").alias("toxic_")))
    named = failed.where(F.col("doc_id").isNotNull()).join(marks, F.col("doc_id") == F.col("id_"), "left")
    rows = named.select("part", "failed", F.coalesce("good_", F.lit(False)).alias("good"), F.coalesce("toxic_", F.lit(False)).alias("toxic"))
    rows = rows.unionByName(failed.where(F.col("doc_id").isNull()).select("part", "failed", F.lit(False).alias("good"), F.lit(False).alias("toxic")))
    counts = rows.mapInArrow(tidy(_count), COUNTS).groupBy("part", "at").agg(F.sum("n").alias("n"))
    return counts.groupBy("part").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "n"))), lambda x: x["n"]).alias("n"))  # 96 a part


def shapley_sums(alive: np.ndarray, filters: int = len(FILTERS)) -> np.ndarray:
    """Per filter what it removes, summed over all orders: an order puts it after subset s in |s|! (f-1-|s|)! ways."""
    orders = int(np.prod(np.arange(1, filters + 1)))
    out = np.zeros(filters, np.int64)
    for f, s in itertools.product(range(filters), range(1 << filters)):
        if not s >> f & 1:
            out[f] += (alive[s] - alive[s | 1 << f]) * (orders // (filters * comb(filters - 1, s.bit_count())))
    return out


def _report(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    orders = list(itertools.permutations(range(len(FILTERS))))
    place = np.array([f for order in orders for f in order])
    before = np.array([sum(1 << f for f in order[:i]) for order in orders for i in range(len(order))])
    after = before | 1 << place
    names = ["".join(FILTERS[f] for f in order) for order in orders for _ in order]
    steps = np.tile(np.arange(1, len(FILTERS) + 1, dtype=np.int32), len(orders))
    for part, numbers in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
        every, good, toxic = np.array(numbers, np.int64).reshape(POPULATIONS, SUBSETS)
        removed = every[before] - every[after]
        columns = {"kept": every[after], "removed": removed, "redundant": every[0] - every[1 << place] - removed,
                   "unique_fails": every[SUBSETS - 1 - (1 << place)] - every[SUBSETS - 1], "good_lost": good[before] - good[after],
                   "toxic_lost": toxic[before] - toxic[after], "shapley": shapley_sums(every)[place]}
        yield pa.RecordBatch.from_arrays([pa.array([part] * len(names), pa.string()), pa.array(names, pa.string()), pa.array(steps),
                                          *(pa.array(c, pa.int64()) for c in columns.values())], ["part", "filter_order", "step", *columns])


def audit(alive: DataFrame) -> DataFrame:
    """All orders of the filters and their steps per part (600 rows), from the survivors of the subsets."""
    return per_batch(_report, REPORT)(alive)


def op11_survival_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Survivors, redundancy and Shapley sums of five filters in every order, per language of the whole ``documents``."""
    return audit(survivors(failures(documents(spark, sf_dir)), read_table(spark, sf_dir, "labels")))


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, part, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words FROM d),
l AS (SELECT doc_id, max(CAST(quality = 1 AS INTEGER)) AS good, max(CAST(toxic = 1 AS INTEGER)) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT w.part, coalesce(l.good, 0) AS good, coalesce(l.toxic, 0) AS toxic,
        MAP {'A': len(words) < 200, 'B': 100 * len(list_distinct(words)) < 50 * len(words),
             'C': 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t), 'D': regexp_matches(t, '[#$%&*|]'),
             'E': coalesce(min(w.doc_id) OVER (PARTITION BY t) < w.doc_id, false)} AS fails
      FROM w LEFT JOIN l ON l.doc_id = w.doc_id),
c AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c),
o AS (SELECT a.c || b.c || x.c || y.c || z.c AS filter_order FROM c a, c b, c x, c y, c z
      WHERE len(list_distinct([a.c, b.c, x.c, y.c, z.c])) = 5),
kinds AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY ALL),
steps AS (SELECT filter_order, step, substr(filter_order, step, 1) AS letter,
            string_split(substr(filter_order, 1, step - 1), '') AS before FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
judged AS (SELECT part, filter_order, step, letter, n, good, toxic, fails[letter] AS failing,
             len(list_filter(before, lambda b: b <> '' AND fails[b])) > 0 AS gone,
             len(list_filter(['A', 'B', 'C', 'D', 'E'], lambda b: fails[b])) AS n_failed FROM kinds, steps),
r AS (SELECT part, filter_order, step, letter, sum(CASE WHEN NOT gone AND NOT failing THEN n ELSE 0 END) AS kept,
        sum(CASE WHEN NOT gone AND failing THEN n ELSE 0 END) AS removed, sum(CASE WHEN gone AND failing THEN n ELSE 0 END) AS redundant,
        sum(CASE WHEN failing AND n_failed = 1 THEN n ELSE 0 END) AS unique_fails,
        sum(CASE WHEN NOT gone AND failing THEN good ELSE 0 END) AS good_lost,
        sum(CASE WHEN NOT gone AND failing THEN toxic ELSE 0 END) AS toxic_lost
      FROM judged GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
  CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
  CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley
FROM r"""
