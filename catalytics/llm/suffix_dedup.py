"""Suffix-array dedup: collection BWT and common prefixes, built column by column.

Removes every byte covered by a string of ``LENGTH`` bytes that also starts anywhere
else. The construction inserts one symbol per string and round, from the right: the order of
all strings' suffixes in a column follows from the order in the column to the
right by one stable sort on the inserted symbols (the column of the transform), and common prefixes of
neighbours grow by one where the symbols agree. A window is repeated where a
neighbour shares ``LENGTH`` symbols.

Whole documents as strings would need as many rounds as the longest one has bytes,
each over everything inserted so far. So the strings are *contexts*: winnowing picks
anchors (``GRAM`` bytes) such that equal windows hold the same anchor at the same place, and
the context of an anchor is the at most ``2 * REACH + GRAM`` bytes which windows with that anchor can
cover. Contexts are aligned at their anchors, windows only meet in equal columns, and
each group of contexts is built by itself: ``2 * REACH + GRAM`` rounds whatever the documents' lengths.
Groups are the contexts that share an anchor and ``HALF`` bytes on its right, or on its left: equal
windows share one of the two. The tables between the steps are the sequential external files.

Equal contexts are counted, not compared: of each distinct one a single copy is
fetched, and only where its group holds another. Successive anchors of a text whose contexts are equal and touch
are one counted row: a stretch of short period has an anchor in every period. Groups above ``HOT`` contexts count window
hashes instead, an aggregation that no hot group can clog.

Defined cases: a null text has no bytes; texts shorter than ``LENGTH`` stay whole. Repeated rows are
places of their own, so texts of ``LENGTH`` bytes that occur twice lose all. Only id and text are read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import kernels as K, prefilter
from .common import attach, documents, landed, per_batch, same_row, texts, tidy_group

LENGTH = 400
GRAM = 100
REACH = LENGTH - GRAM  # bytes on either side of an anchor that a window with it can cover
HALF = REACH // 2
WIDTH = 2 * REACH + GRAM
HOT = 1 << 15
COPIED = 2048  # places from which a context's join is dealt over several tasks
GROUPED = 1 << 13  # contexts that one call builds at once

ANCHOR = "doc_id long, tkey long, pos int, hash long, context long, right long, left long, before int, after int, until int, n int"
CONTEXT = "context long, anchor_at int, bytes binary"


def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, tuple]:
    """Winnowed anchors of a run: positions, hashes, and the prefix sums for further hashes."""
    sums, inverse = K.prefix(data)
    n = len(data) - GRAM + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), (sums, inverse)
    at = np.arange(n)
    hashes = K.span_hash(sums, inverse, at, at + GRAM, seed=11)
    span = REACH + 1  # anchors in a window
    low = np.uint64((1 << max(22, n.bit_length())) - 1)
    # smallest hash, rightmost first: the position is part of the key; minima over blocks from both ends give every window's
    key = (hashes & ~low) | (low - at.astype(np.uint64))
    padded = np.full(-(-n // span) * span, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = key
    blocks = padded.reshape(-1, span)
    ahead = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    windows = len(data) - LENGTH + 1
    chosen = np.zeros(n, bool)
    if windows > 0:
        least = np.minimum(back[:windows], ahead[span - 1:span - 1 + windows])
        stop = np.repeat(offsets[1:], np.diff(offsets))[:windows]
        fits = np.arange(windows) + LENGTH <= stop
        chosen[(low - (least[fits] & low)).astype(np.int64)] = True
    at = np.flatnonzero(chosen)
    return at, hashes[at], (sums, inverse)


def _anchor_hashes(batch: pa.RecordBatch):
    for _, data, offsets in K.runs(batch, "text"):
        yield pa.RecordBatch.from_arrays([pa.array(K.signed(anchors(data, offsets)[1]))], ["hash"])


def equal_runs(doc: np.ndarray, context: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last index of each run of successive equal contexts of a document that touch (``low`` to ``high``)."""
    new = (doc[1:] != doc[:-1]) | (context[1:] != context[:-1]) | (low[1:] > high[:-1])
    edge = np.concatenate([np.full(min(1, len(doc)), True), new, np.full(min(1, len(doc)), True)])
    return np.flatnonzero(edge[:-1]), np.flatnonzero(edge[1:])


def _anchor_rows(shared):
    def run(batch: pa.RecordBatch):
        for rows, data, offsets in K.runs(batch, "text"):
            at, h, (sums, inverse) = anchors(data, offsets)
            keep = prefilter.passes(shared.value, h)
            at, h = at[keep], h[keep]
            doc = np.searchsorted(offsets, at, "right") - 1
            begin, end = offsets[doc], offsets[doc + 1]
            low, high = np.maximum(begin, at - REACH), np.minimum(end, at + GRAM + REACH)
            of = lambda a, b, seed: K.span_hash(sums, inverse, a, b, seed)
            context = K.mix(of(low, high, 12) + (at - low).astype(np.uint64) * np.uint64(K.BASE))
            first, last = equal_runs(doc, context, low, high)
            until, n = (at - begin)[last], last - first + 1
            at, h, doc, context, begin, end, low, high = (x[first] for x in (at, h, doc, context, begin, end, low, high))
            has_right, has_left = at + GRAM + HALF <= end, at - HALF >= begin
            right = of(at, np.minimum(at + GRAM + HALF, end), 13)
            left = of(np.maximum(at - HALF, begin), at + GRAM, 14)
            yield pa.RecordBatch.from_arrays(
                [rows.column(0).take(pa.array(doc)), rows.column(1).take(pa.array(doc)), pa.array((at - begin).astype(np.int32)),
                 pa.array(K.signed(h)), pa.array(K.signed(context)), pa.array(K.signed(right), mask=~has_right),
                 pa.array(K.signed(left), mask=~has_left), pa.array((at - low).astype(np.int32)), pa.array((high - at).astype(np.int32)),
                 pa.array(until.astype(np.int32)), pa.array(n.astype(np.int32))],
                [c.split()[0] for c in ANCHOR.split(", ")])

    return run


def _cut_contexts(batch: pa.RecordBatch):
    """Bytes of the wanted contexts (list column ``wanted``) of each text."""
    for row in batch.to_pylist():
        raw = row["text"].encode()
        yield pa.RecordBatch.from_arrays(
            [pa.array([w["context"] for w in row["wanted"]], pa.int64()), pa.array([w["before"] for w in row["wanted"]], pa.int32()),
             pa.array([raw[w["pos"] - w["before"]:w["pos"] + w["after"]] for w in row["wanted"]], pa.binary())],
            ["context", "anchor_at", "bytes"])


def aligned(raw: list[bytes], anchor_at: np.ndarray) -> np.ndarray:
    """Contexts as rows of symbols with their anchors in column REACH; 256 where the document has no byte."""
    out = np.full((len(raw), WIDTH), 256, np.uint16)
    for i, (piece, at) in enumerate(zip(raw, anchor_at.tolist(), strict=True)):
        out[i, REACH - at:REACH - at + len(piece)] = np.frombuffer(piece, np.uint8)
    return out


def repeated_windows(symbols: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last column at which a window of each row also starts in another row of its group (-1: none).

    One round per column, from the right: insert the column's symbols, sort stably by group
    and symbol, and update the common prefixes of neighbours by range minima over the
    order before.
    """
    m = len(symbols)
    first, last = np.full(m, -1, np.int64), np.full(m, -1, np.int64)
    order = np.argsort(group, kind="stable")
    common = np.zeros(m, np.int64)  # with the row before in the order; 0 across groups
    for column in range(WIDTH - 1, -1, -1):
        symbol = symbols[order, column].astype(np.int64)
        key = group[order] * 257 + symbol
        step = np.argsort(key, kind="stable")
        grouped = key[step]
        joins = np.zeros(m, bool)
        joins[1:] = (grouped[1:] == grouped[:-1]) & (symbol[step[1:]] < 256)
        at = np.flatnonzero(joins)
        new = np.zeros(m, np.int64)
        if len(at):
            new[at] = 1 + _range_min(common, step[at - 1] + 1, step[at] + 1)
        order, common = order[step], new
        if column <= REACH:
            hit = common >= LENGTH
            hit[:-1] |= hit[1:]
            rows = order[hit]
            first[rows] = column
            last[rows] = np.maximum(last[rows], column)
    return first, last


def _range_min(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Minimum of ``values[low:high]`` for each pair, by doubling."""
    out = np.empty(len(low), np.int64)
    level = np.frexp((high - low).astype(float))[1] - 1  # floor of the binary logarithm
    table, size = values, 1
    for k in range(int(level.max()) + 1):
        here = level == k
        out[here] = np.minimum(table[low[here]], table[high[here] - size])
        table = np.minimum(table[:-size], table[size:]) if len(table) > size else table
        size *= 2
    return out


def _build(table: pa.Table) -> pa.Table:
    """Column-wise construction over the groups of one call: ``context, first, last`` of those with a repeat."""
    group = np.unique(table["key"].to_numpy(), return_inverse=True)[1]
    symbols = aligned(table["bytes"].to_pylist(), table["anchor_at"].to_numpy())
    first, last = repeated_windows(symbols, group)
    hit = first >= 0
    return pa.table({"context": pa.array(table["context"].to_numpy()[hit]), "first": pa.array(first[hit].astype(np.int32)),
                     "last": pa.array(last[hit].astype(np.int32))})


def _window_hashes(batch: pa.RecordBatch):
    """Every window of a hot group's contexts: ``key, context, column, window``."""
    raw, at, key, context = (batch.column(batch.schema.get_field_index(c)) for c in ("bytes", "anchor_at", "key", "context"))
    for i in range(batch.num_rows):
        data = np.frombuffer(raw[i].as_py(), np.uint8)
        n = max(0, len(data) - LENGTH + 1)
        start = np.arange(n)
        window = K.span_hash(*K.prefix(data), start, start + LENGTH)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(n, key[i].as_py(), np.int64)), pa.array(np.full(n, context[i].as_py(), np.int64)),
             pa.array((start + REACH - at[i].as_py()).astype(np.int32)), pa.array(K.signed(window))], ["key", "context", "column", "window"])


def repeated_spans(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """``doc_id, tkey, start, stop``: byte spans of texts that repeated windows cover (they overlap)."""
    plain = texts(docs)
    found = per_batch(_anchor_hashes, "hash long")(plain.select("text")).groupBy("hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    seen = prefilter.bitmap(landed(found.select("hash"), "suffix-hashes"))
    shared = docs.sparkSession.sparkContext.broadcast(seen)
    marks = landed(per_batch(_anchor_rows(shared), ANCHOR)(plain.select("doc_id", "tkey", "text")), "suffix-anchors")
    distinct = landed(marks.groupBy("context").agg(
        F.sum("n").alias("times"), F.min(F.struct("doc_id", "tkey", "pos")).alias("at"), F.first("right").alias("right"),
        F.first("left").alias("left"), F.first("before").alias("before"), F.first("after").alias("after")), "suffix-contexts")
    keyed = distinct.select("context", "times", F.explode(F.array("right", "left")).alias("key")).where("key is not null")
    groups = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("many"), F.min("times").alias("least")).where("many > 1 and least = 1")
    members = landed(keyed.join(groups.select(F.col("key").alias("k"), "many"), F.col("key") == F.col("k")).select("key", "context", "many"), "suffix-groups")
    # fetch one copy of each context that meets another
    wanted = (distinct.join(members.select(F.col("context").alias("c")).distinct(), F.col("context") == F.col("c"))
              .select("at.doc_id", "at.tkey", F.struct(F.col("context"), F.col("at.pos").alias("pos"), "before", "after").alias("w"))
              .groupBy("doc_id", "tkey").agg(F.collect_list("w").alias("wanted")))
    wanted = landed(wanted, "suffix-wanted")
    holders, _ = prefilter.split(plain, "tkey", prefilter.bitmap(wanted, "tkey"))
    fetched = per_batch(_cut_contexts, CONTEXT)(
        holders.join(wanted, same_row(holders, wanted)).select("text", "wanted")).dropDuplicates(["context"])
    contexts = landed(fetched, "suffix-bytes")
    rows = members.join(contexts.withColumnRenamed("context", "c"), F.col("context") == F.col("c")).select("key", "context", "many", "anchor_at", "bytes")
    calls = max(1, -(-members.count() // GROUPED))
    built = (rows.where(F.col("many") <= hot).groupBy(F.pmod(F.xxhash64("key"), F.lit(calls)).alias("call"))
             .applyInArrow(tidy_group(_build), "context long, first int, last int"))
    windows = per_batch(_window_hashes, "key long, context long, column int, window long")(rows.where(F.col("many") > hot))
    met = windows.groupBy("key", "column", "window").agg(F.min("context").alias("a"), F.max("context").alias("b")).where("a <> b")
    again = windows.join(met.select(F.col("key").alias("mk"), F.col("column").alias("mc"), F.col("window").alias("mw")),
                         (F.col("key") == F.col("mk")) & (F.col("column") == F.col("mc")) & (F.col("window") == F.col("mw")))
    hot_built = again.groupBy("context").agg(F.min("column").alias("first"), F.max("column").alias("last"))
    if members.where(F.col("many") > hot).limit(1).count():
        built = built.unionByName(hot_built)
    built = built.groupBy("context").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    of = distinct.select(F.col("context").alias("c"), "times").join(
        built.select(F.col("context").alias("bc"), "first", "last"), F.col("c") == F.col("bc"), "left").where("times > 1 or first is not null")
    copied = prefilter.bitmap(landed(distinct.where(F.col("times") >= COPIED).select("context"), "suffix-copied"), "context")
    spans = prefilter.hot_join(marks, "context", of.drop("bc"), "c", copied)
    whole = F.col("times") > 1
    return spans.select("doc_id", "tkey",
                        F.when(whole, F.col("pos") - F.col("before")).otherwise(F.col("pos") - REACH + F.col("first")).alias("start"),
                        F.when(whole, F.col("until") + F.col("after")).otherwise(F.col("pos") + GRAM + F.col("last")).alias("stop"))


def cut(raw: bytes, spans: list) -> tuple[bytes, int, int]:
    """What is left of ``raw`` without the spans, the bytes removed and the number of removed runs."""
    pairs = np.array([(s["start"], s["stop"]) for s in spans], np.int64).reshape(-1, 2)
    starts, stops = K.merge_spans(pairs[:, 0], pairs[:, 1])
    edges = [0, *np.column_stack([starts, stops]).reshape(-1).tolist(), len(raw)]
    return b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)), int((stops - starts).sum()), len(starts)


def _digest(batch: pa.RecordBatch):
    names = batch.schema.names
    spans = batch.column(names.index("spans")).to_pylist() if "spans" in names else [[]] * batch.num_rows
    out = []
    for text, own in zip(batch.column(names.index("text")), spans, strict=True):
        raw = text.as_buffer()
        kept, removed, number = cut(raw.to_pybytes(), own) if own else (raw, 0, 0)
        out.append((len(raw) if raw is not None else 0, removed, number, hashlib.sha256(kept).hexdigest()))
    yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([o[i] for o in out], pa.string() if i == 3 else pa.int64()) for i in range(4))],
                                     ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def _remove(batch: pa.RecordBatch):
    kept = [cut(text.encode(), own)[0] if own else text.encode()
            for text, own in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
    yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kept, pa.binary())], ["doc_id", "kept"])


def with_spans(docs: DataFrame, spans: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents with their list of spans, and those that have none."""
    return attach(docs, spans.groupBy("doc_id", "tkey").agg(F.collect_list(F.struct("start", "stop")).alias("spans")))


def remove_repeats(docs: DataFrame) -> DataFrame:
    """``doc_id, kept`` (binary: cuts may fall within characters)."""
    some, none = with_spans(docs, repeated_spans(docs))
    return per_batch(_remove, "doc_id long, kept binary")(some).unionByName(none.select("doc_id", F.col("text").cast("binary").alias("kept")))


def removal_report(docs: DataFrame) -> DataFrame:
    """Per document: n_bytes, n_removed, n_spans and the digest of what is left."""
    some, none = with_spans(docs, repeated_spans(docs))
    report = per_batch(_digest, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    return report(some).unionByName(report(none.select("doc_id", "text")))


def op2_column_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removal_report(documents(spark, sf_dir))
