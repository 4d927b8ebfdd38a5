"""Benchmark decontamination by winnowing.

Texts are lower-cased (A-Z) and cut into words. The fingerprints of a text are
the hashes of its k-grams of words that are smallest in some window of w
consecutive k-grams; with ``k + w - 1 = WINDOW`` any span of ``WINDOW`` words that two texts share
holds a fingerprint at the same place in both. Documents and benchmark items
meet on fingerprints, and every meeting is extended word by word, so that hits
are exact. Items shorter than a window are one window of their own length.

The corpus is read once. A bitmap of the benchmark's fingerprints, of bounded size
whatever the benchmark's, drops nearly all document fingerprints before the shuffle;
a fuller bitmap only lets more of them through.

Defined cases: null or empty texts have no words, and items without words have
no windows. Items with a null id make words hit but stand in no list; repeated
items count once. Repeated documents get equal results. With an empty benchmark
nothing is hit. Only id and text columns are read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from . import kernels as K, prefilter
from .common import documents, landed, per_batch, read_table, same_row, texts

WINDOW = 10
GRAM = 5  # k; the winnowing window is WINDOW - GRAM + 1 grams
SALTS = 16

PRINT = pa.struct([("hash", pa.int64()), ("kind", pa.int32()), ("pos", pa.int32()), ("left", pa.int32()), ("context", pa.string())])
PRINT_SQL = "array<struct<hash: long, kind: int, pos: int, left: int, context: string>>"


def winnowed(grams: np.ndarray, fits: np.ndarray, w: int) -> np.ndarray:
    """Positions of the (rightmost) smallest gram of each window of w grams; ``fits`` marks usable windows."""
    n = len(fits)
    best, at = grams[:n].copy(), np.zeros(n, np.int8)
    for j in range(1, w):
        other = grams[j:j + n]
        lower = other <= best
        best[lower], at[lower] = other[lower], j
    chosen = np.zeros(len(grams), bool)
    chosen[(np.arange(n) + at)[fits]] = True
    return np.flatnonzero(chosen)


def fingerprints(hashes: np.ndarray, first: np.ndarray, kinds) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """Per kind ``(kind, positions, hashes)``: kind WINDOW is winnowed, a shorter kind takes every gram of its length."""
    out = []
    for kind in kinds:
        if kind == WINDOW:
            _, fits = K.gram_docs(first, WINDOW, max(0, len(hashes) - WINDOW + 1))
            grams = K.grams(hashes, GRAM, kind)
            at = winnowed(grams, fits, WINDOW - GRAM + 1)
        else:
            grams = K.grams(hashes, kind, kind)
            at = np.flatnonzero(K.gram_docs(first, kind, len(grams))[1])
        out.append((kind, at, grams[at]))
    return out


def _prints(batch: pa.RecordBatch, kinds_of, passes):
    """``n_words`` and the fingerprints (with their word context) of each text of a batch."""
    for rows, data, offsets in K.runs(batch, "text"):
        data = K.ASCII_LOWER[data]
        starts, ends, first = K.words(data, offsets, K.ALNUM)
        hashes = K.word_hash(data, starts, ends)
        found = []
        for kind, at, h in fingerprints(hashes, first, kinds_of(first)):
            doc = np.searchsorted(first, at, "right") - 1
            keep = passes(kind, np.diff(first)[doc], h)
            at, h, doc = at[keep], h[keep], doc[keep]
            reach = WINDOW - GRAM if kind == WINDOW else 0
            size = GRAM if kind == WINDOW else kind
            low, high = np.maximum(first[doc], at - reach), np.minimum(first[doc + 1], at + size + reach)
            raw = data.tobytes() if len(at) else b""
            for i in range(len(at)):
                text = b" ".join(raw[starts[j]:ends[j]] for j in range(low[i], high[i])).decode()
                found.append((int(doc[i]), {"hash": int(h[i].view(np.int64)), "kind": kind, "pos": int(at[i] - first[doc[i]]),
                                            "left": int(at[i] - low[i]), "context": text}))
        lists: list[list] = [[] for _ in range(rows.num_rows)]
        for doc, entry in found:
            lists[doc].append(entry)
        yield pa.RecordBatch.from_arrays(
            [*(rows.column(i) for i in range(rows.num_columns) if rows.schema.names[i] != "text"),
             pa.array(np.diff(first), pa.int64()), pa.array(lists, pa.list_(PRINT))],
            [*(c for c in rows.schema.names if c != "text"), "n_words", "prints"])


def item_prints(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of benchmark items: ``item_id, hash, kind, left, context``, one row each."""
    def passes(kind, length, h):  # a short item is one window; a longer one is winnowed
        return length >= WINDOW if kind == WINDOW else length == kind

    read = per_batch(lambda b: _prints(b, lambda first: range(1, WINDOW + 1), passes), f"item_id string, n_words long, prints {PRINT_SQL}")
    plain = items.select(items[id_col].cast("string").alias("item_id"), F.coalesce(items[text_col].cast("string"), F.lit("")).alias("text"))
    return (read(plain).select("item_id", F.explode("prints").alias("p"))
            .select("item_id", "p.hash", "p.kind", "p.left", "p.context").distinct())


def document_prints(docs: DataFrame, kinds: list[int], packed: np.ndarray) -> DataFrame:
    """``doc_id, tkey, n_words`` of every document, with those fingerprints that the bitmap lets pass."""
    shared = docs.sparkSession.sparkContext.broadcast(packed)

    def passes(kind, length, h):
        return prefilter.passes(shared.value, h)

    return per_batch(lambda b: _prints(b, lambda first: kinds, passes), f"doc_id long, tkey long, n_words long, prints {PRINT_SQL}")(
        texts(docs).select("doc_id", "tkey", "text"))


def _extend(batch: pa.RecordBatch):
    """Grow each meeting of two fingerprints word by word; keep those that fill a window."""
    out = []
    for r in batch.to_pylist():
        mine, theirs = r["context"].split(" "), r["item_context"].split(" ")
        size = GRAM if r["kind"] == WINDOW else r["kind"]
        a, b = r["left"], r["item_left"]
        if mine[a:a + size] != theirs[b:b + size]:
            continue
        back = ahead = 0
        while back < min(a, b) and mine[a - back - 1] == theirs[b - back - 1]:
            back += 1
        while a + size + ahead < len(mine) and b + size + ahead < len(theirs) and mine[a + size + ahead] == theirs[b + size + ahead]:
            ahead += 1
        if back + size + ahead >= r["kind"]:
            out.append((r["doc_id"], r["tkey"], r["item_id"], r["pos"] - back, r["pos"] + size + ahead))
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int32()), strict=True)],
                                         ["doc_id", "tkey", "item_id", "start", "stop"])


@F.pandas_udf(T.LongType())
def _covered(spans: pd.Series) -> pd.Series:
    def one(rows):
        pairs = np.array([(r["start"], r["stop"]) for r in rows], np.int64).reshape(-1, 2)
        starts, ends = K.merge_spans(pairs[:, 0], pairs[:, 1])
        return int((ends - starts).sum())

    return spans.map(one)


def hits(prints: DataFrame, items: DataFrame) -> DataFrame:
    """``doc_id, tkey, item_id, start, stop`` (words) of every extended meeting.

    A passage that very many documents quote, copies of one text among them, is one key: documents are salted by id and text and the
    benchmark's rows repeated for each salt.
    """
    mine = (prints.where(F.size("prints") > 0).select("doc_id", "tkey", F.explode("prints").alias("p"))
            .select("doc_id", "tkey", "p.*", F.pmod(F.xxhash64("doc_id", "tkey"), F.lit(SALTS)).cast("int").alias("salt")))
    theirs = items.select("hash", "kind", "item_id", F.col("left").alias("item_left"), F.col("context").alias("item_context"),
                          F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    met = mine.join(theirs, ["hash", "kind", "salt"]).select(
        "doc_id", "tkey", "kind", "pos", "left", "context", "item_id", "item_left", "item_context")
    return per_batch(_extend, "doc_id long, tkey long, item_id string, start int, stop int")(met)


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per document: n_words, n_hit, n_items, items_sha256, contaminated (and tkey)."""
    items = landed(item_prints(benchmark), "benchmark-prints")
    kinds = sorted(r["kind"] for r in items.select("kind").distinct().collect())  # WINDOW rows at most
    prints = landed(document_prints(docs, kinds, prefilter.bitmap(items)), "document-prints")
    found = (hits(prints, items).groupBy("doc_id", "tkey")
             .agg(F.collect_set(F.struct("start", "stop")).alias("spans"), F.collect_set("item_id").alias("ids"))
             .select("doc_id", "tkey", _covered("spans").alias("n_hit"), F.size("ids").cast("long").alias("n_items"),
                     F.array_join(F.array_sort("ids"), ",").alias("list")))
    counted = prints.select("doc_id", "tkey", "n_words")
    none = F.lit(0).cast("long")
    return counted.join(found, same_row(counted, found), "left").select(
        counted["doc_id"], "n_words", F.coalesce("n_hit", none).alias("n_hit"), F.coalesce("n_items", none).alias("n_items"),
        F.sha2(F.coalesce("list", F.lit("")), 256).alias("items_sha256"),
        (F.coalesce("n_hit", none) > 0).alias("contaminated"), counted["tkey"])


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Filter: the rows of ``docs`` without any hit, all columns as they are."""
    bad = decontaminate(docs, benchmark).where("contaminated").select(F.col("doc_id").alias("bad_id"), F.col("tkey").alias("bad_key")).distinct()
    mine = F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit("")))
    return docs.join(bad, mine.eqNullSafe(bad["bad_key"]) & docs["doc_id"].cast("long").eqNullSafe(bad["bad_id"]), "left_anti")


def op8_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(documents(spark, sf_dir), read_table(spark, sf_dir, "benchmark")).drop("tkey")


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLE_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_WORDS} AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(10, len(w)) AS k,
              array_to_string(list_slice(w, i, i + least(10, len(w)) - 1), ' ') AS g
       FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT rid, i, k, array_to_string(list_slice(w, i, i + k - 1), ' ') AS g
       FROM (SELECT rid, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM bw) WHERE len(w) >= k)),
hit AS (SELECT rid, i, k, item_id FROM dw JOIN bw USING (k, g)),
hw AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + k)) AS p FROM hit) GROUP BY rid),
hi AS (SELECT rid, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS list
       FROM (SELECT DISTINCT rid, item_id FROM hit WHERE item_id IS NOT NULL) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(list, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hw USING (rid) LEFT JOIN hi USING (rid)
"""
