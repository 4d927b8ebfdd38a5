"""Near-duplicates by DartMinHash: weighted signatures, banding, exact check, classes.

A document is the set of its shingles of five words (weight 1 each; ``signatures`` takes
any weights). Every element owns a region of the plane, as wide as its weight,
into which its hash throws darts at unit density; of the darts that land below a
rank bound, each of k coordinates keeps the earliest. Two documents agree in a
coordinate with the probability of their weighted Jaccard similarity, and a
document costs time in proportion to its elements plus k log k darts.

``BANDS`` bands of ``ROWS`` coordinates are joined: a pair of similarity 0.8 shares none of
them with probability 3e-6. Candidates are checked on their shingle sets.
Documents of equal sets are one node from the start, so copies are never paired.

Per bucket every node is first checked against the bucket's hub (the node that
meets most others) and classes are formed. Nodes that may still have a link
across classes are then checked against all nodes of their buckets, in blocks, within
tasks: no link is lost and pairs are not written out.

Defined cases: null and empty texts are the empty set, and copies of each other. Texts
of fewer than five words are one shingle. A null doc_id is like any other;
the class id is the smallest id of the class (null if it has none). Repeated
rows are copies.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from . import kernels as K, prefilter
from .common import documents, landed, per_batch, same_row, texts
from .components import components

SHINGLE = 5
SIMILAR = 0.8
BANDS, ROWS = 24, 4
BLOCK = 1024
RUN_BYTES = 1 << 20  # the number of throws of a run is that of its smallest document: long runs share them


def shingles(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each document of a run, sorted, and ``first`` as in ``words``."""
    starts, ends, first = K.words(data, offsets, K.NOT_SPACE)
    hashes, counts = K.word_hash(data, starts, ends), np.diff(first)
    grams = K.grams(hashes, SHINGLE)
    doc, fits = K.gram_docs(first, SHINGLE, len(grams))
    parts, owners = [grams[fits]], [doc[fits]]
    for m in range(1, SHINGLE):
        short = np.flatnonzero(counts == m)
        parts.append(K.grams(hashes, m)[first[short]])
        owners.append(short)
    value, doc = np.concatenate(parts), np.concatenate(owners)
    order = np.lexsort((value, doc))
    value, doc = value[order], doc[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])
    value, doc = value[new], doc[new]
    return value, np.searchsorted(doc, np.arange(len(offsets)))


def signatures(value: np.ndarray, weight: np.ndarray, first: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """Dart signatures ``documents x k`` of weighted sets: id of the earliest dart per coordinate.

    An element of weight w owns unit strips 0 .. ceil(w)-1 of which it fills the last in part.
    The darts of a strip arrive at ranks with exponential gaps; those of rank below
    ``(k ln k + 2k) / total weight`` are thrown, and documents that miss a coordinate throw again
    under a doubled bound. Rows of empty documents are zero.
    """
    docs = len(first) - 1
    out = np.zeros((docs, k), np.uint64)
    sizes = np.diff(first)
    of = np.repeat(np.arange(docs), sizes)
    total = np.bincount(of, weight, docs)
    todo, bound = np.flatnonzero(total > 0), k * np.log(k) + 2 * k
    strips = np.ceil(weight).astype(np.int64)
    while len(todo):
        rank_bound = np.zeros(docs)
        rank_bound[todo] = bound / total[todo]
        at = K.ragged(first[todo], sizes[todo])
        element = np.repeat(at, strips[at])
        strip = K.ragged(np.zeros(len(at), np.int64), strips[at])
        doc, width = of[element], np.minimum(1.0, weight[element] - strip)
        state = K.mix(value[element] + strip.astype(np.uint64) * np.uint64(0xA0761D6478BD642F) + K.seeded(seed))
        rank, limit = np.zeros(len(state)), rank_bound[doc]
        slots, ranks, ids = [], [], []
        while len(state):
            state = K.mix(state + np.uint64(0x9E3779B97F4A7C15))
            rank = rank - np.log(((state >> np.uint64(11)).astype(np.float64) + 1.0) * 2.0 ** -53)
            alive = rank < limit
            state, rank, limit, doc, width = state[alive], rank[alive], limit[alive], doc[alive], width[alive]
            dart = K.mix(state ^ np.uint64(0xE7037ED1A0B428DB))
            lands = (dart >> np.uint64(40)).astype(np.float64) * 2.0 ** -24 < width
            slots.append(doc[lands] * k + (dart[lands] & np.uint64(0xFFFFFFFF)).astype(np.int64) % k)
            ranks.append(rank[lands])
            ids.append(state[lands])
        slot, rank, dart = np.concatenate(slots), np.concatenate(ranks), np.concatenate(ids)
        order = np.lexsort((rank, slot))
        slot, dart = slot[order], dart[order]
        earliest = np.ones(len(slot), bool)
        earliest[1:] = slot[1:] != slot[:-1]
        slot, dart = slot[earliest], dart[earliest]
        full = np.bincount(slot // k, minlength=docs) == k
        mine = full[slot // k]
        out.reshape(-1)[slot[mine]] = dart[mine]
        todo, bound = todo[~full[todo]], bound * 2
    return out


def node_keys(value: np.ndarray, first: np.ndarray) -> pa.Array:
    """16 bytes per document that name its shingle set."""
    docs = len(first) - 1
    key = np.zeros((docs, 2), np.uint64)
    some = np.flatnonzero(np.diff(first))
    if len(some):
        key[some, 0] = np.add.reduceat(K.mix(value ^ np.uint64(0x8EBC6AF09C88C6E3)), first[some])
        key[some, 1] = np.bitwise_xor.reduceat(K.mix(value ^ np.uint64(0x589965CC75374CC3)), first[some]) + np.diff(first)[some].astype(np.uint64)
    raw = key.astype(">u8").tobytes()
    return pa.array([raw[16 * i:16 * i + 16] for i in range(docs)], pa.binary())


def _sign(batch: pa.RecordBatch):
    for rows, data, offsets in K.runs(batch, "text", RUN_BYTES):
        value, first = shingles(data, offsets)
        signed = signatures(value, np.ones(len(value)), first, BANDS * ROWS)
        bands = np.zeros((len(first) - 1, BANDS), np.uint64)
        for b in range(BANDS):
            h = np.full(len(bands), K.seeded(b), np.uint64)
            for r in range(ROWS):
                h = K.mix(h + signed[:, b * ROWS + r])
            bands[:, b] = h
        some = np.diff(first) > 0
        yield pa.RecordBatch.from_arrays(
            [rows.column(0), rows.column(1), node_keys(value, first), pa.array(np.diff(first), pa.int64()),
             K.list_column(K.signed(bands[some].reshape(-1)), np.where(some, BANDS, 0), pa.int64())],
            ["doc_id", "tkey", "node", "size", "bands"])


def _sets(batch: pa.RecordBatch):
    for rows, data, offsets in K.runs(batch, "text"):
        value, first = shingles(data, offsets)
        yield pa.RecordBatch.from_arrays([rows.column(0), K.list_column(K.signed(value), np.diff(first), pa.int64())], ["node", "shingles"])


def checked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs ``a, b`` whose shingle sets are similar enough."""
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    return (pairs.join(left, "a").join(right, "b")
            .where(both >= SIMILAR * (F.size("sa") + F.size("sb") - both)).select("a", "b"))


def _probe(rows: pd.DataFrame) -> pd.DataFrame:
    """Check the probes of a bucket's block against its members; one link per probe and other class is enough."""
    base, probes = rows[~rows["probe"]], rows[rows["probe"]]
    value = np.concatenate([np.asarray(s, np.int64) for s in base["shingles"]])
    size = base["shingles"].map(len).to_numpy()
    owner = np.repeat(np.arange(len(base)), size)
    order = np.argsort(value, kind="stable")
    value, owner = value[order], owner[order]
    nodes, labels = base["node"].to_numpy(), base["label"].to_numpy()
    found = []
    for node, label, mine in zip(probes["node"], probes["label"], probes["shingles"], strict=True):
        mine = np.asarray(mine, np.int64)
        low, high = np.searchsorted(value, mine, "left"), np.searchsorted(value, mine, "right")
        both = np.bincount(owner[K.ragged(low, high - low)], minlength=len(base))
        close = {}
        for i in np.flatnonzero(both >= SIMILAR * (size + len(mine) - both)):
            if labels[i] != label:
                close.setdefault(labels[i], nodes[i])
        found += [(node, other) for other in close.values()]
    return pd.DataFrame(found, columns=["a", "b"])


def links(nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """Labels of all nodes with a link: ``node, label``.

    ``nodes``: node, size, bands, and doc_id, tkey of a row of ``docs`` that has the node's shingle set. Only
    texts of nodes that share a bucket are fetched; a bitmap keeps most others out of that join.
    """
    spread = nodes.select("node", "size", F.explode("bands").alias("bucket"))
    buckets = spread.groupBy("bucket").agg(F.count(F.lit(1)).alias("many")).where("many > 1")
    members = landed(spread.join(buckets, "bucket"), "dup-members")
    # hubs: nodes that meet the most others over all their buckets
    busy = members.groupBy("node").agg(F.sum("many").alias("meets"))
    members = members.join(busy, "node")
    hubs = members.groupBy("bucket").agg(F.max(F.struct("meets", "node", "size")).alias("hub")).select(
        F.col("bucket").alias("of"), F.col("hub.node").alias("hub"), F.col("hub.size").alias("hub_size"))
    members = landed(members.join(hubs, F.col("bucket") == F.col("of")).select("bucket", "many", "node", "size", "hub", "hub_size"), "dup-hubs")
    may = F.least("size", "hub_size") >= SIMILAR * F.greatest("size", "hub_size")
    pairs = members.where((F.col("node") != F.col("hub")) & may).select(
        F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct()
    wanted = landed(nodes.select("node", "doc_id", "tkey").join(members.select("node").distinct(), "node"), "dup-wanted")
    holders, _ = prefilter.split(texts(docs), "tkey", prefilter.bitmap(wanted, "tkey"))
    fetched = holders.join(wanted, same_row(holders, wanted)).select("node", "text")
    sets = landed(per_batch(_sets, "node binary, shingles array<long>")(fetched).dropDuplicates(["node"]), "dup-sets")  # repeated rows
    edges = landed(checked(pairs, sets), "dup-edges")
    labels = landed(components(edges), "dup-labels")
    # what a bucket's hub leaves open: members, other than the hub, of different classes
    own = labels.select(F.col("node").alias("n"), "label")
    named = members.join(own, F.col("node") == F.col("n"), "left").select(
        "bucket", "many", "node", "size", (F.col("node") == F.col("hub")).alias("is_hub"), F.coalesce("label", "node").alias("label"))
    open_buckets = (named.where("not is_hub").groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("c"))
                    .groupBy("bucket").agg(F.sum("c").alias("total"), F.max(F.struct("c", "label")).alias("main"))
                    .where("total > main.c").select(F.col("bucket").alias("open"), F.col("main.label").alias("main"),
                                                    F.ceil(F.col("total") / BLOCK).cast("int").alias("blocks"),
                                                    F.ceil((F.col("total") - F.col("main.c")) / BLOCK).cast("int").alias("probe_blocks")))
    named = named.where("not is_hub").join(open_buckets, F.col("bucket") == F.col("open"))
    part, every = lambda n: F.pmod(F.xxhash64("node"), n).cast("int"), lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    base = named.select("bucket", "node", "label", F.lit(False).alias("probe"), part(F.col("blocks")).alias("block"),
                        every("probe_blocks").alias("probe_block"))
    probes = named.where("label <> main").select("bucket", "node", "label", F.lit(True).alias("probe"), every("blocks").alias("block"),
                                                 part(F.col("probe_blocks")).alias("probe_block"))
    rows = base.unionByName(probes).join(sets, "node")
    late = rows.groupBy("bucket", "block", "probe_block").applyInPandas(_probe, "a binary, b binary")
    late = landed(late.distinct(), "dup-late-edges")
    if late.isEmpty():
        return labels
    bridged = labels.select(F.col("node").alias("a"), F.col("label").alias("b"))
    return landed(components(bridged.unionByName(late)), "dup-labels")


def classes(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, class_id, class_size (rows), and the internal tkey and label."""
    plain = texts(docs)
    signed = landed(per_batch(_sign, "doc_id long, tkey long, node binary, size long, bands array<long>")(
        plain.select("doc_id", "tkey", "text")), "dup-signatures")
    one = F.min(F.struct("doc_id", "tkey")).alias("one")
    nodes = landed(signed.groupBy("node").agg(one, F.first("size").alias("size"), F.first("bands").alias("bands")), "dup-nodes")
    labels = links(nodes.where(F.size("bands") > 0).select("node", "size", "bands", "one.doc_id", "one.tkey"), docs)
    named = signed.select("doc_id", "tkey", "node").join(labels.withColumnRenamed("node", "n"), F.col("node") == F.col("n"), "left").select(
        "doc_id", "tkey", "node", F.coalesce("label", "node").alias("label"))
    named = landed(named, "dup-named")
    groups = named.groupBy("label").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("class_size"))
    return named.join(groups, "label").select("doc_id", "class_id", "class_size", "tkey", "label")


def keep_one(docs: DataFrame) -> DataFrame:
    """Filter: of every class the row with the smallest id (and text hash), all columns as they are."""
    found = classes(docs)
    first = found.groupBy("label").agg(F.min(F.struct(F.coalesce("doc_id", F.lit(-(1 << 63))), "tkey", "doc_id")).alias("one"))
    # ids as texts, so that a null id is a value: the window then finds the join's partitioning in place
    name = lambda c: F.coalesce(c.cast("string"), F.lit("null"))
    kept = first.select(name(F.col("one.doc_id")).alias("kept_id"), F.col("one.tkey").alias("kept_key"))
    names = docs.columns
    mine = docs.select(F.struct(*(docs[f"`{c}`"] for c in names)).alias("row"), name(docs["doc_id"].cast("long")).alias("id"),
                       F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit(""))).alias("key"))
    met = mine.join(kept, (mine["id"] == kept["kept_id"]) & (mine["key"] == kept["kept_key"]))
    nth = F.row_number().over(Window.partitionBy("id", "key").orderBy(F.lit(1)))  # repeated rows: one stays
    return met.withColumn("nth", nth).where("nth = 1").select("row.*")


def op1_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(documents(spark, sf_dir)).drop("tkey", "label")
