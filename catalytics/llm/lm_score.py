"""Language-model scoring by cross-entropy difference.

Two word bigram models, one of a target (documents labelled good), one of the background (all
documents), share one vocabulary: words, in lower case, and bigrams, each with its own 64-bit key. They
are matched: same order, same smoothing, and background
counts brought to the target's number of tokens, so that neither gains by size. A document's score is the mean
over its tokens of target loss minus background loss, in nats: low where it reads like the target.

Every document is counted, whole. Texts are written in chunks of some megabytes; a chunk's distinct
words and bigrams, with their counts, go in packed rows to the owners of stretches of the keys. An owner adds
up all chunks' counts of its keys and returns to every chunk the sums of the keys it sent, in the
order it sent them; with them the chunk's documents are scored. So the tables grow with the corpus,
no task holds one of them, and a frequent key is one entry a chunk. A document is scored without its
own counts: they are taken off both models where they are in.

Defined cases: null and empty texts have no tokens and losses of 0. Labels with null ids or quality are ignored,
an id with several labels counts with its smallest. Rows with equal ids share labels; repeated rows each
count. Without any target document the target model is uniform. The smoothing reckons with all distinct
words of the documents.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import kernels as K, prefilter
from .common import documents, landed, read_table, texts, tidy

CHUNK_BYTES = 1 << 23  # text of a chunk (one longer text is a chunk of its own)
MIX = 0.7  # weight of the bigram estimate where its context is known
PRIOR = 0.1  # added to every word's count
STRETCH_BITS = {"words": 9, "pairs": 11}  # stretches of the keys by their first bits; those of the pairs are numbered after the words'
STRETCH_CHUNKS = 1 << 12  # for so many chunks; there are twice as many stretches for twice the chunks, so that one stays some 20 MB
GAP_BYTES = 6  # keys are sent as their distances; a chunk's are mostly this near
FAR = (1 << 8 * GAP_BYTES) - 1
COUNTS = ("low0", "high0", "low1", "high1")
REQUEST = "chunk long, stretch int, gaps binary, far binary, low0 binary, high0 binary, low1 binary, high1 binary"
REPLY = "chunk long, stretch int, low0 binary, high0 binary, low1 binary, high1 binary, words long, n0 long, n1 long"


def slots(data: np.ndarray, offsets: np.ndarray):
    """Keys of word, context and bigram of every token of a run, its document, and ``first``."""
    data = K.ASCII_LOWER[data]
    starts, ends, first = K.words(data, offsets, K.NOT_SPACE)
    word = K.word_hash(data, starts, ends)
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    context = np.empty_like(word)
    context[1:] = word[:-1]
    context[first[:-1][np.diff(first) > 0]] = K.seeded(77)  # the start of a text
    return word, context, K.mix(context * np.uint64(K.BASE) + word), doc, first


def stretch_bits(chunks: int) -> dict[str, int]:
    """First bits of a key that name its stretch, for words and for pairs: more stretches the more chunks there are."""
    more = max(0, (max(chunks, 1) - 1) // STRETCH_CHUNKS).bit_length()
    return {name: bits + more for name, bits in STRETCH_BITS.items()}


def _whole(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    """All rows as one batch; Arrow raises an error where a column leaves 32-bit offsets."""
    return batches[0] if len(batches) == 1 else pa.concat_batches(batches)


def _together(batches, column: str):
    """Cut batches that are sorted by a column anew, so that rows of one value come in one batch."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        values = batch.column(column).to_numpy()
        last = int(np.searchsorted(values, values[-1]))
        if held and not last and held[-1].column(column)[-1].as_py() == values[0]:
            held.append(batch)
            continue
        done = held + ([batch.slice(0, last)] if last else [])
        held = [batch.slice(last)]
        if done:
            yield _whole(done)
    if held:
        yield _whole(held)


def _chunk(batches):
    """Rows ``chunk, docs``: some documents as one Arrow stream."""
    task, number, held, size = TaskContext.get().partitionId(), 0, [], 0

    def row():
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, held[0].schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=6))) as out:
            out.write_batch(_whole(held))
        return pa.RecordBatch.from_arrays([pa.array([task << 32 | number], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["chunk", "docs"])

    for batch in batches:
        for rows, data, _ in K.runs(batch, "text", CHUNK_BYTES):
            if held and size + len(data) > CHUNK_BYTES:
                yield row()
                number, held, size = number + 1, [], 0
            held.append(rows)
            size += len(data)
    if held:
        yield row()


def _tokens(docs: pa.RecordBatch):
    """Word key, bigram key and document of every token, tokens of each document, whether it is of the target."""
    parts, lengths, at = [], [], 0
    for rows, data, offsets in K.runs(docs, "text"):
        word, _, pair, doc, first = slots(data, offsets)
        parts.append((word, pair, doc + at))
        lengths.append(np.diff(first))
        at += rows.num_rows
    good = docs.column("good").fill_null(False).to_numpy(zero_copy_only=False).astype(bool)
    return *(np.concatenate(x) for x in zip(*parts, strict=True)), np.concatenate(lengths), good


def _binary(values: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """Binary column of ``values[cuts[i]:cuts[i + 1]]``."""
    if cuts[-1] * values.itemsize > np.iinfo(np.int32).max:
        raise OverflowError("a column of a stretch leaves 32-bit offsets")
    offsets = (cuts * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))])


def _packed(n: np.ndarray, cuts: np.ndarray) -> list[pa.Array]:
    """Counts as two binary columns: a byte each, and in full those that do not fit below 255."""
    wide = n >= 255
    before = np.zeros(len(n) + 1, np.int64)
    np.cumsum(wide, out=before[1:])
    return [_binary(np.minimum(n, 255).astype(np.uint8), cuts), _binary(n[wide].astype("<i8"), before[cuts])]


def _counts(rows: pa.RecordBatch, model: int) -> np.ndarray:
    n = K.buffer(rows.column(f"low{model}"))[0].astype(np.int64)
    n[n == 255] = np.frombuffer(K.buffer(rows.column(f"high{model}"))[0].tobytes(), "<i8")
    return n


def _gaps(keys: np.ndarray, cuts: np.ndarray, base: np.ndarray) -> list[pa.Array]:
    """Ascending keys as distances, each stretch's first from its ``base``: ``GAP_BYTES`` each, and in full those that need more."""
    gap = np.diff(keys, prepend=keys[:1])
    gap[cuts[:-1]] = keys[cuts[:-1]] - base
    wide = gap >= FAR
    before = np.zeros(len(gap) + 1, np.int64)
    np.cumsum(wide, out=before[1:])
    near = np.where(wide, np.uint64(FAR), gap).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :GAP_BYTES]
    return [_binary(np.ascontiguousarray(near).reshape(-1), cuts * GAP_BYTES), _binary(gap[wide].astype("<u8"), before[cuts])]


def _keys(rows: pa.RecordBatch, bits: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all rows of requests, and where each row's begin."""
    data, offsets = K.buffer(rows.column("gaps"))
    near = np.zeros((len(data) // GAP_BYTES, 8), np.uint8)
    near[:, :GAP_BYTES] = data.reshape(-1, GAP_BYTES)
    gap, cuts = near.reshape(-1).view("<u8"), offsets // GAP_BYTES
    gap[gap == FAR] = np.frombuffer(K.buffer(rows.column("far"))[0].tobytes(), "<u8")
    sums = np.cumsum(gap)
    stretch = rows.column("stretch").to_numpy()
    base = np.where(stretch < 1 << bits["words"], stretch.astype(np.uint64) << np.uint64(64 - bits["words"]),
                    (stretch - (1 << bits["words"])).astype(np.uint64) << np.uint64(64 - bits["pairs"]))
    return sums + np.repeat(base + gap[cuts[:-1]] - sums[cuts[:-1]], np.diff(cuts)), cuts


def _docs(value) -> pa.RecordBatch:
    return _whole(list(pa.ipc.open_stream(value.as_buffer())))


def _ask(bits: dict[str, int]):
    """A chunk's distinct keys, in order, and their counts in it, by stretch."""
    def run(batches):
        for batch in batches:
            for chunk, docs in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                word, pair, doc, _, good = _tokens(_docs(docs))
                inside = good[doc]
                for name, key, number in (("words", word, 0), ("pairs", pair, 1 << bits["words"])):
                    keys, n = np.unique(key, return_counts=True)
                    some, n_some = np.unique(key[inside], return_counts=True)
                    target = np.zeros(len(keys), np.int64)
                    target[np.searchsorted(keys, some)] = n_some
                    shift = np.uint64(64 - bits[name])
                    at, first = np.unique(keys >> shift, return_index=True)
                    cuts = np.append(first, len(keys)).astype(np.int64)
                    if len(at):
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), chunk, np.int64)), pa.array(at.astype(np.int32) + np.int32(number), pa.int32()), *_gaps(keys, cuts, at << shift),
                                                          *_packed(n, cuts), *_packed(target, cuts)], ["chunk", "stretch", "gaps", "far", *COUNTS])

    return run


def _reply(bits: dict[str, int]):
    """Add up each key's counts over all chunks; every row gets the sums of its keys.

    ``words`` adds up to the number of distinct words, ``n0`` and ``n1`` to the tokens of both models.
    """
    def run(batches):
        for rows in _together(batches, "stretch"):
            key, cuts = _keys(rows, bits)
            _, which = np.unique(key, return_inverse=True)
            of_words = rows.column("stretch").to_numpy() < 1 << bits["words"]
            words, columns, tokens = np.zeros(rows.num_rows, np.int64), [], []
            if of_words.any():  # they come first
                words[0] = len(np.unique(key[:cuts[np.count_nonzero(of_words)]]))
            for model in (0, 1):
                n = _counts(rows, model)
                columns += _packed(np.bincount(which, n).astype(np.int64)[which], cuts)
                tokens.append(pa.array(np.where(of_words, np.add.reduceat(n, cuts[:-1]), 0)))
            yield pa.RecordBatch.from_arrays([rows.column("chunk"), rows.column("stretch"), *columns, pa.array(words), *tokens],
                                             ["chunk", "stretch", *COUNTS, "words", "n0", "n1"])

    return run


def _own(doc: np.ndarray, which: np.ndarray) -> np.ndarray:
    """How often each token's key occurs in its document."""
    _, at, n = np.unique((doc.astype(np.int64) << 32) | which, return_inverse=True, return_counts=True)
    return n[at]


def _before(values: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """The value of the token before, 0 at the start of a text."""
    out = np.zeros_like(values)
    out[1:] = np.where(doc[1:] == doc[:-1], values[:-1], 0)
    return out


def losses(docs: pa.RecordBatch, words: list, pairs: list, tokens: list[int], vocabulary: int):
    """Tokens of each document, its mean loss under the background and under the target.

    ``words`` and ``pairs`` have, for both models, the counts of the distinct keys of ``docs`` in their
    order. A document's own counts are left out; both models are scaled to one number of tokens.
    """
    word, pair, doc, length, good = _tokens(docs)
    (_, word), (_, pair) = (np.unique(x, return_inverse=True) for x in (word, pair))
    own_word, own_pair = _own(doc, word), _own(doc, pair)
    inside = good[doc]
    tokens = [max(1, n) for n in tokens]
    out = [length]
    for model, scale in ((0, min(1.0, tokens[1] / tokens[0])), (1, 1.0)):
        without = inside if model else np.ones(len(doc), bool)
        total = np.maximum(scale * (tokens[model] - np.where(without, length[doc], 0)), 0)
        single = scale * np.maximum(words[model][word] - np.where(without, own_word, 0), 0)
        seen = _before(single, doc)
        both = np.minimum(scale * np.maximum(pairs[model][pair] - np.where(without, own_pair, 0), 0), seen)
        weight = MIX * seen / (seen + 1.0)
        loss = -np.log(weight * both / np.maximum(seen, 1e-9) + (1 - weight) * (single + PRIOR) / (total + PRIOR * vocabulary))
        out.append(np.bincount(doc, loss, minlength=len(length)) / np.maximum(length, 1))
    return out


def score(chunks: DataFrame, replies: DataFrame, bits: dict[str, int]) -> DataFrame:
    """``doc_id, n_tokens, target_loss, background_loss, score`` of all documents of the chunks."""
    sums = replies.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n0", "n1", "words"))).first()
    tokens, vocabulary = [sums["n0"], sums["n1"]], max(1, sums["words"])

    def run(batches):
        for rows in _together(batches, "chunk"):
            chunk = rows.column("chunk").to_numpy()
            cuts = np.append(np.flatnonzero(np.append(True, chunk[1:] != chunk[:-1])), len(chunk))
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                docs, rest = _docs(rows.column("docs")[a]), rows.slice(a + 1, b - a - 1)  # stretch -1 comes first
                split = int(np.searchsorted(rest.column("stretch").to_numpy(), 1 << bits["words"]))
                words, pairs = ([_counts(part, model) for model in (0, 1)] for part in (rest.slice(0, split), rest.slice(split)))
                n, background, target = losses(docs, words, pairs, tokens, vocabulary)
                yield pa.RecordBatch.from_arrays([docs.column("doc_id"), pa.array(n, pa.int64()), pa.array(target), pa.array(background), pa.array(target - background)],
                                                 ["doc_id", "n_tokens", "target_loss", "background_loss", "score"])

    both = (replies.select("chunk", "stretch", *COUNTS, F.lit(None).cast("binary").alias("docs"))
            .unionByName(chunks.select("chunk", F.lit(-1).alias("stretch"), *(F.lit(b"").alias(c) for c in COUNTS), "docs")))
    return both.repartition("chunk").sortWithinPartitions("chunk", "stretch").mapInArrow(
        tidy(run), "doc_id long, n_tokens long, target_loss double, background_loss double, score double")


def mark(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, good, text``: whether a document belongs to the target.

    Only texts whose id may be that of a target document (a bitmap of bounded size tells) are
    shuffled to meet their labels, with tables of any size by the same join.
    """
    good = (labels.select(labels["doc_id"].cast("long").alias("label_id"), labels["quality"].cast("int").alias("q"))
            .where("label_id is not null and q is not null").groupBy("label_id").agg(F.min("q").alias("q")).where("q = 1")
            .select("label_id", F.xxhash64("label_id").alias("hash")))
    good = landed(good, "lm-target")
    plain = texts(docs).select("doc_id", "text", F.xxhash64("doc_id").alias("hash"))
    some, none = prefilter.split(plain, "hash", prefilter.bitmap(good))
    met = some.join(good.select("label_id").hint("merge"), some["doc_id"] == good["label_id"], "left")
    return met.select("doc_id", F.col("label_id").isNotNull().alias("good"), "text").unionByName(
        none.select("doc_id", F.lit(False).alias("good"), "text"))


def cross_entropy_difference(docs: DataFrame, labels: DataFrame) -> DataFrame:
    chunks = landed(mark(docs, labels).mapInArrow(tidy(_chunk), "chunk long, docs binary"), "lm-chunks")
    bits = stretch_bits(chunks.count())
    requests = chunks.mapInArrow(tidy(_ask(bits)), REQUEST).repartition("stretch").sortWithinPartitions("stretch", "chunk")
    return score(chunks, landed(requests.mapInArrow(tidy(_reply(bits)), REPLY), "lm-counts"), bits)


def op6_cross_entropy_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cross_entropy_difference(documents(spark, sf_dir), read_table(spark, sf_dir, "labels"))
