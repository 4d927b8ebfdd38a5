"""Substring dedup with difference-cover anchors.

Removes each word covered by a window of ``WINDOW`` words whose word sequence also starts in
a document with a smaller id. ``COVER`` is a difference cover modulo ``PERIOD``: for any two
positions i and j there is a shift below ``PERIOD`` that takes both to cover positions. So only
the ``GRAM``-word anchors at cover positions are hashed and compared: of any two equal
windows, some shift within them shows the same anchor in both. Anchors that occur in one
document only are dropped; around the others the match is extended to whole windows.

Both comparisons move packed arrays. A task sends the distinct hashes of some hundred
thousand windows, sorted, to buckets of the hash space, with the smallest document id it has for each;
the bucket answers with one bit for each hash: whether another task has a smaller one. A passage that a third of all documents
share thus reaches a bucket once per such block, not once per document.

Memory: a task holds one block or one bucket, whose sizes are bounded whatever the input, the number of shuffle partitions or the size
of a split: there are more buckets for more hashes, and written blocks are read and written two at a time. The
filter of repeated anchors has at most ``2**prefilter.MAX_BITS`` bits; up to four of them stand for an anchor, as many as suit its filling.

Defined cases: null or empty texts have no words. A null doc_id counts as larger than all others.
Rows with equal ids never remove from each other; repeated rows get equal results.
Texts of fewer than ``WINDOW`` words stay whole. Window equality rests on 96 hash bits.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import kernels as K, prefilter
from .common import attach, documents, landed, per_batch, texts, tidy, tidy_group

WINDOW = 13
PERIOD = 7
COVER = (1, 2, 4)  # every difference modulo 7 is one of two members
GRAM = WINDOW - PERIOD + 1
BLOCK = 1 << 18  # hashes that a task gathers before it sends them
BUCKET_BYTES = 1 << 24  # of text, whose anchors share a bucket
BUCKET_HASHES = 1 << 19  # of windows, sent to a bucket
PAGE = 12  # bits of a place within a page of the filter of anchors
#: Written blocks are long rows: Parquet's writer would gather a hundred of them before it looks at their size.
LONG_ROWS = {"parquet.block.row.count.limit": 2, "parquet.enable.dictionary": "false", "compression": "zstd"}
LAST = np.iinfo(np.int64).max

BLOCK_ROW = ("block long, n long, doc_ids array<long>, tkeys array<long>, counts array<int>, positions binary, entries binary, local binary, "
             "hashes binary, checks binary, least binary")


def cover_anchors(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word index and hash of the anchors at cover positions of each document."""
    grams = K.grams(hashes, GRAM)
    doc, fits = K.gram_docs(first, GRAM, len(grams))
    cover = np.zeros(PERIOD, bool)
    cover[list(COVER)] = True
    fits &= cover[(np.arange(len(grams)) - first[doc]) % PERIOD] & (np.diff(first)[doc] >= WINDOW)
    at = np.flatnonzero(fits)
    return at, grams[at]


def _bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket of each hash; sorted hashes have sorted buckets."""
    return ((hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _pack(hashes: np.ndarray) -> bytes:
    """Upper 48 bits of sorted hashes, byte plane by byte plane (the upper planes compress)."""
    return hashes.astype(">u8").view(np.uint8).reshape(-1, 8)[:, :6].T.tobytes()


def _unpack(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(raw, np.uint8).reshape(6, -1).T
    return out.reshape(-1).view(">u8").astype(np.uint64)


def _planes(values: np.ndarray) -> bytes:
    """Numbers byte plane by byte plane: planes of zeros and of few values compress."""
    return values.view(np.uint8).reshape(-1, values.itemsize).T.tobytes()


def _from_planes(raw: bytes, kind: str) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).reshape(-1)


def _buckets(spark: SparkSession, amount: int, most: int) -> int:
    """As many buckets as there are shuffle partitions, or more, so that one has about ``most`` of ``amount``."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-amount // most))


def _anchor_blocks(buckets: int):
    def flush(held):
        h = np.concatenate([x[0] for x in held])
        doc = np.concatenate([x[1] for x in held])
        order = np.argsort(h, kind="stable")
        h, doc = h[order], doc[order]
        new = np.ones(len(h), bool)
        new[1:] = h[1:] != h[:-1]
        shared = np.zeros(len(h), bool)
        shared[1:] = ~new[1:] & (doc[1:] != doc[:-1])
        own, multi = h[new], np.unique(h[shared])
        cuts = np.searchsorted(_bucket(own, buckets), np.arange(buckets + 1))
        multi_cuts = np.searchsorted(_bucket(multi, buckets), np.arange(buckets + 1))
        full = np.flatnonzero(np.diff(cuts))
        return pa.RecordBatch.from_arrays(
            [pa.array(full.astype(np.int32)), pa.array([_pack(own[cuts[b]:cuts[b + 1]]) for b in full], pa.binary()),
             pa.array([_pack(multi[multi_cuts[b]:multi_cuts[b + 1]]) for b in full], pa.binary())], ["bucket", "own", "multi"])

    def run(batches):
        held, size, docs = [], 0, 0
        for batch in batches:
            for rows, data, offsets in K.runs(batch, "text"):
                starts, ends, first = K.words(data, offsets, K.NOT_SPACE)
                at, h = cover_anchors(K.word_hash(data, starts, ends), first)
                held.append((h, docs + np.searchsorted(first, at, "right") - 1))
                size, docs = size + len(h), docs + rows.num_rows
                if size >= 2 * BLOCK:
                    yield flush(held)
                    held, size = [], 0
        if size:
            yield flush(held)

    return run


def _repeated(table: pa.Table) -> pa.Table:
    """Hashes of a bucket that two blocks sent, or one block from two documents."""
    h = np.sort(np.concatenate([_unpack(x) for x in table["own"].to_pylist()]))
    twice = h[1:][h[1:] == h[:-1]]
    multi = [_unpack(x) for x in table["multi"].to_pylist()]
    found = np.unique(np.concatenate([twice, *multi]))
    return pa.table({"n": pa.array([len(found)], pa.int64()), "hashes": pa.array([_pack(found)], pa.binary())})


def _place(hashes: np.ndarray, bits: int, j: int) -> np.ndarray:
    """The j-th bit of a filter that stands for each hash: the upper bits name a page, the others, mixed, a place in it."""
    hashes = hashes & np.uint64((1 << 64) - (1 << 16))  # what is sent of them
    page = hashes >> np.uint64(64 - bits + PAGE) << np.uint64(PAGE)
    return (page | K.mix(hashes) >> np.uint64(PAGE * j) & np.uint64((1 << PAGE) - 1)).astype(np.int64)


def _filter(found: DataFrame) -> tuple[np.ndarray, int]:
    """Packed bits for the hashes of all buckets, and how many stand for a hash; a bucket's hashes fill one stretch of pages."""
    rows = found.agg(F.sum("n")).first()[0] or 0
    bits = int(min(prefilter.MAX_BITS, max(20, 4 + int(np.ceil(np.log2(rows + 1))))))
    k = int(np.clip(round(0.69 * (1 << bits) / (rows + 1)), 1, 4))

    def stretch(batch: pa.RecordBatch):
        for raw in batch.column(0).to_pylist():
            hashes = _unpack(raw)
            if len(hashes):
                low, high = (int(x >> np.uint64(64 - bits + PAGE)) << PAGE for x in (hashes[0], hashes[-1]))
                marks = np.zeros(high - low + (1 << PAGE), np.uint8)
                for j in range(k):
                    marks[_place(hashes, bits, j) - low] = 1
                yield pa.RecordBatch.from_arrays([pa.array([low // 8]), pa.array([np.packbits(marks, bitorder="little").tobytes()], pa.binary())], ["at", "bits"])

    out = np.zeros((1 << bits) // 8, np.uint8)
    for r in per_batch(stretch, "at long, bits binary")(found.select("hashes")).collect():  # 2**MAX_BITS bits and a page a bucket
        piece = np.frombuffer(bytes(r["bits"]), np.uint8)
        out[r["at"]:r["at"] + len(piece)] |= piece
    return out, k


def _passing(packed: np.ndarray, k: int, hashes: np.ndarray) -> np.ndarray:
    """Positions of the hashes that may be in the filter."""
    left = np.arange(len(hashes))
    for j in range(k):
        at = _place(hashes[left], (len(packed) * 8).bit_length() - 1, j)
        left = left[(packed[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1]
    return left


def _window_blocks(shared):
    """Windows around repeated anchors, as blocks of distinct hashes and the places that have them."""
    def flush(held, block):
        h, c, start = (np.concatenate([x[i] for x in held]) for i in (0, 1, 2))
        counts = np.concatenate([x[3] for x in held])
        ids, keys = pa.concat_arrays([x[4] for x in held]), pa.concat_arrays([x[5] for x in held])
        rank = ids.fill_null(LAST).to_numpy(zero_copy_only=False)[np.repeat(np.arange(len(counts)), counts)]
        order = np.lexsort((c, h))
        new = np.ones(len(h), bool)
        new[1:] = (h[order][1:] != h[order][:-1]) | (c[order][1:] != c[order][:-1])
        entry = np.empty(len(h), np.int64)
        entry[order] = np.cumsum(new) - 1
        least = np.minimum.reduceat(rank[order], np.flatnonzero(new))
        one = lambda x, kind: pa.array([x], kind)
        lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in (ids, keys, pa.array(counts.astype(np.int32)))]
        blobs = [start.astype("<u4"), entry.astype("<u4"), np.packbits(rank > least[entry]), h[order][new].astype("<u8"), c[order][new].astype("<u4"), least.astype("<i8")]
        return pa.RecordBatch.from_arrays([one(block, pa.int64()), one(len(least), pa.int64()), *lists, *(one(_planes(x), pa.binary()) for x in blobs)],
                                          [x.split()[0] for x in BLOCK_ROW.split(", ")])

    def run(batches):
        from pyspark import TaskContext

        packed, k = shared.value
        block, held, size = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            for rows, data, offsets in K.runs(batch, "text"):
                starts, ends, first = K.words(data, offsets, K.NOT_SPACE)
                hashes = K.word_hash(data, starts, ends)
                at, h = cover_anchors(hashes, first)
                at = at[_passing(packed, k, h)]
                doc, fits = K.gram_docs(first, WINDOW, max(0, len(hashes) - WINDOW + 1))
                if not len(at) or not len(fits):
                    continue
                near = K.cover_counts(np.maximum(at - PERIOD + 1, 0), at + 1, len(hashes))[:len(fits)]
                at = np.flatnonzero(near & fits)
                counts = np.bincount(doc[at], minlength=rows.num_rows)
                some = pa.array(np.flatnonzero(counts))  # taken, as a slice would hold the whole batch with its texts
                held.append((K.grams(hashes, WINDOW)[at], (K.grams(hashes, WINDOW, 1)[at] >> np.uint64(32)).astype(np.uint32),
                             at - first[doc[at]], counts[counts > 0], rows.column(0).take(some), rows.column(1).take(some)))
                size += len(at)
                if size >= BLOCK:
                    yield flush(held, block)
                    block, held, size = block + 1, [], 0
        if size:
            yield flush(held, block)

    return run


def _questions(buckets: int):
    def run(batch: pa.RecordBatch):
        for i in range(batch.num_rows):
            block, h, c, m = (batch.column(j)[i].as_py() for j in range(4))
            h, c, m = _from_planes(h, "<u8"), _from_planes(c, "<u4"), _from_planes(m, "<i8")
            cuts = np.searchsorted(_bucket(h.astype(np.uint64), buckets), np.arange(buckets + 1))
            full = np.flatnonzero(np.diff(cuts))
            cut = lambda x: pa.array([_planes(x[cuts[b]:cuts[b + 1]]) for b in full], pa.binary())  # noqa: E731, B023
            yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array(np.full(len(full), block)), cut(h), cut(c), cut(m)],
                                             ["bucket", "block", "hashes", "checks", "least"])

    return run


def _answers(table: pa.Table) -> pa.Table:
    """For each hash that a block sent: does another block know a smaller document?"""
    blobs = table.sort_by("block")
    read = lambda c, kind: [_from_planes(x, kind) for x in blobs[c].to_pylist()]
    hashes, checks, least = read("hashes", "<u8"), read("checks", "<u4"), read("least", "<i8")
    h, c, m = np.concatenate(hashes), np.concatenate(checks), np.concatenate(least)
    order = np.lexsort((c, h))
    new = np.ones(len(h), bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (c[order][1:] != c[order][:-1])
    smallest = np.minimum.reduceat(m[order], np.flatnonzero(new))
    bit = np.empty(len(h), bool)
    bit[order] = smallest[np.cumsum(new) - 1] < m[order]
    ends = np.cumsum([len(x) for x in hashes])
    return pa.table({"of": blobs["block"].combine_chunks(), "bucket": blobs["bucket"].combine_chunks(),
                     "n": pa.array([len(x) for x in hashes], pa.int32()),
                     "bits": pa.array([np.packbits(bit[e - len(x):e]).tobytes() for x, e in zip(hashes, ends, strict=True)], pa.binary())})


def _decide(batch: pa.RecordBatch):
    """Spans of words to remove, per document of a block."""
    for i in range(batch.num_rows):
        row = {name: batch.column(j)[i].as_py() for j, name in enumerate(batch.schema.names)}
        bits = np.concatenate([np.unpackbits(np.frombuffer(a["bits"], np.uint8), count=a["n"]) for a in row["answers"]]).astype(bool)
        start, entry = _from_planes(row["positions"], "<u4"), _from_planes(row["entries"], "<u4")
        gone = bits[entry] | np.unpackbits(np.frombuffer(row["local"], np.uint8), count=len(entry)).astype(bool)
        ends = np.cumsum(row["counts"])
        out: list[list] = [[], [], []]
        for doc_id, tkey, n, end in zip(row["doc_ids"], row["tkeys"], row["counts"], ends.tolist(), strict=True):
            at = start[end - n:end][gone[end - n:end]].astype(np.int64)
            if len(at):
                a, b = K.merge_spans(at, at + WINDOW)
                for column, value in zip(out, (doc_id, tkey, [{"start": x, "stop": y} for x, y in zip(a.tolist(), b.tolist(), strict=True)]), strict=True):
                    column.append(value)
        if out[0]:
            kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], kind)], ["doc_id", "tkey", "spans"])


def repeated_words(docs: DataFrame) -> DataFrame:
    """``doc_id, tkey, spans``: word spans of each document that smaller documents hold already."""
    spark = docs.sparkSession
    plain = texts(docs)
    buckets = _buckets(spark, plain.agg(F.sum(F.octet_length("text"))).first()[0] or 0, BUCKET_BYTES)
    sent = plain.select("text").mapInArrow(tidy(_anchor_blocks(buckets)), "bucket int, own binary, multi binary")
    found = landed(sent.groupBy("bucket").applyInArrow(tidy_group(_repeated), "n long, hashes binary"), "cover-anchors")
    shared = spark.sparkContext.broadcast(_filter(found))
    blocks = landed(plain.select("doc_id", "tkey", "text").mapInArrow(tidy(_window_blocks(shared)), BLOCK_ROW), "cover-windows", **LONG_ROWS)
    buckets = _buckets(spark, blocks.agg(F.sum("n")).first()[0] or 0, BUCKET_HASHES)
    asked = per_batch(_questions(buckets), "bucket int, block long, hashes binary, checks binary, least binary")(
        blocks.select("block", "hashes", "checks", "least"))
    answers = asked.groupBy("bucket").applyInArrow(tidy_group(_answers), "of long, bucket int, n int, bits binary")
    answers = answers.groupBy("of").agg(F.sort_array(F.collect_list(F.struct("bucket", "n", "bits"))).alias("answers"))
    met = blocks.join(answers, F.col("block") == F.col("of")).select("doc_ids", "tkeys", "counts", "positions", "entries", "local", "answers")
    return per_batch(_decide, "doc_id long, tkey long, spans array<struct<start: int, stop: int>>")(met).dropDuplicates(["doc_id", "tkey"])


def kept_words(raw: bytes, spans: list) -> tuple[list[bytes], int]:
    """Words outside the spans, and the number of all words."""
    own = raw.split()  # for bytes: runs of everything but \\x20 and \\x09-\\x0D
    edges = [0, *(x for s in spans for x in (s["start"], s["stop"])), len(own)]
    return [w for a, b in zip(edges[::2], edges[1::2], strict=True) for w in own[a:b]], len(own)


def _each(batch: pa.RecordBatch):
    names = batch.schema.names
    spans = batch.column(names.index("spans")).to_pylist() if "spans" in names else [[]] * batch.num_rows
    for text, own in zip(batch.column(names.index("text")), spans, strict=True):
        raw = text.as_buffer()
        yield kept_words(raw.to_pybytes() if raw is not None else b"", own)


def _digest(batch: pa.RecordBatch):
    out = [(n, n - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()) for kept, n in _each(batch)]
    yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([o[i] for o in out], pa.string() if i == 2 else pa.int64()) for i in range(3))],
                                     ["doc_id", "n_words", "n_removed", "kept_sha256"])


def _remove(batch: pa.RecordBatch):
    yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([b" ".join(kept).decode() for kept, _ in _each(batch)], pa.string())], ["doc_id", "kept"])


def remove_repeats(docs: DataFrame) -> DataFrame:
    """``doc_id, kept``: the remaining words of each text, joined by one space."""
    some, none = attach(docs, repeated_words(docs))
    return per_batch(_remove, "doc_id long, kept string")(some).unionByName(per_batch(_remove, "doc_id long, kept string")(none.select("doc_id", "text")))


def removal_report(docs: DataFrame) -> DataFrame:
    """Per document: n_words, n_removed and the digest of what is left."""
    some, none = attach(docs, repeated_words(docs))
    report = per_batch(_digest, "doc_id long, n_words long, n_removed long, kept_sha256 string")
    return report(some).unionByName(report(none.select("doc_id", "text")))


def op3_cover_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removal_report(documents(spark, sf_dir))


ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT rid, doc_id, i, sha256(array_to_string(list_slice(w, i, i + 12), ' ')) AS g
        FROM (SELECT rid, doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)),
least_doc AS (SELECT g, min(doc_id) AS m FROM win GROUP BY g),
gone AS (SELECT DISTINCT rid, p FROM (SELECT rid, unnest(range(i, i + 13)) AS p
         FROM win JOIN least_doc USING (g) WHERE m < doc_id OR (doc_id IS NULL AND m IS NOT NULL))),
word AS (SELECT rid, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS x FROM d),
kept AS (SELECT rid, string_agg(x, ' ' ORDER BY p) AS t, count(*) AS n FROM word ANTI JOIN gone USING (rid, p) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) AS BIGINT) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (rid)
"""
