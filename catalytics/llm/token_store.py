"""Token ids in grammar-compressed shards (Re-Pair) with random access.

``write_tokens`` encodes texts, appends the end id, orders documents by id and
stores shards of at most about ``SHARD_TOKENS`` ids. Within a shard the frequent pairs of
adjacent ids (never across documents) are replaced by nonterminals, round after
round; stored are the rules, the expansion length of every rule, and the
remaining symbols, 16 bits each. ``read_documents`` expands whole shards,
``read_range`` only the symbols that overlap a range of ids.

Shards are rows of a Parquet table (``shards``), so that any file system Spark
writes to will do; ``manifest`` holds the global start of each shard.

Defined cases: a null text is an empty text: its ids are the end id alone. A
null doc_id comes first. Rows with equal ids follow each other in the order of
their text hash; repeated rows are written as often as they occur. An empty
table gives empty ones. Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..session import scratch_path
from . import kernels as K
from .common import documents, texts, tidy

TOKENIZER = "word_bpe_49k.json"
VOCABULARY = 49408
END = 1
SHARD_TOKENS = 1 << 20
MAX_RULES = (1 << 16) - VOCABULARY  # symbols are 16 bits wide
MIN_COUNT = 24  # a pair less frequent than this does not pay for its rule
PAIR_BITS = 20  # size of the table that counts pairs
CACHED_PIECES = 600_000
RUN_BYTES = 1 << 21  # longer runs hold fewer distinct pieces

SHARD = ("part int, shard int, first_id long, last_id long, n_tokens long, doc_ids array<long>, doc_symbols array<int>, "
         "doc_tokens array<int>, rules binary, rule_lengths binary, symbols binary")

# classes of bytes for cutting texts where the tokenizer's own pattern must cut:
# 0 white space, 1 letter, 2 digit, 3 other ASCII, 4 anything that needs the tokenizer's eye
_CLASS = np.full(256, 4, np.uint8)
_CLASS[:128] = 3
_CLASS[[9, 10, 11, 12, 13, 32]] = 0
_CLASS[65:91] = _CLASS[97:123] = 1
_CLASS[48:58] = 2
_CLASS[[39, 60]] = 4  # apostrophes start contractions, '<' the special tokens


def pieces(data: np.ndarray, offsets: np.ndarray):
    """Cut texts into pieces that the tokenizer encodes independently of each other.

    Runs of Latin-1 letters, of digits and of other ASCII are pieces (the tokenizer
    lower-cases, so letters come out in lower case and repeat more); a
    blank-separated chunk with any other character is one piece, unchanged.
    Returns the bytes, piece starts, piece ends and ``first`` as in ``words``.
    """
    kind = _CLASS[data]
    lead = np.flatnonzero(data[:-1] == 0xC3) if len(data) else np.zeros(0, int)
    follow = data[lead + 1]
    good = (follow >= 0x80) & (follow != 0x97) & (follow != 0xB7)
    lead, follow = lead[good], follow[good]
    kind[lead] = kind[lead + 1] = 1
    starts, ends, _ = K.words(data, offsets, K.NOT_SPACE)
    odd = np.concatenate([[0], np.cumsum(kind == 4)])
    odd = (odd[ends] - odd[starts]) > 0
    strange = K.ragged(starts[odd], ends[odd] - starts[odd])
    kind[strange] = 4
    plain = K.ASCII_LOWER[data]
    upper = lead[(follow <= 0x9E)] + 1
    plain[upper] += 0x20
    plain[strange] = data[strange]
    edge = np.ones(len(data) + 1, bool)
    edge[1:-1] = kind[1:] != kind[:-1]
    edge[offsets] = True
    cuts = np.flatnonzero(edge)
    inside = kind[cuts[:-1]] != 0
    starts, ends = cuts[:-1][inside], cuts[1:][inside]
    return plain, starts, ends, np.searchsorted(starts, offsets)


def _worker_state() -> dict:
    """Tokenizers and piece caches of this Python worker, kept for its later tasks."""
    import sys
    import types

    name = "catalytics_worker_state"
    return sys.modules.setdefault(name, types.ModuleType(name)).__dict__


class Encoder:
    """Encodes runs of texts; equal pieces are encoded once and kept (at most ``CACHED_PIECES``)."""

    def __init__(self, tokenizer: str):
        state = _worker_state().setdefault(("tokenizer", tokenizer), {})
        if not state:
            import os

            os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
            import public_tokenizers
            from tokenizers import Tokenizer

            state["library"] = Tokenizer.from_file(tokenizer if "/" in tokenizer else public_tokenizers.path(tokenizer))
            state["known"] = {}
        self.library, self.known = state["library"], state["known"]

    def run(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all documents of a run, each with the end id, and the ids per document."""
        plain, starts, ends, first = pieces(data, offsets)
        hashes = K.word_hash(plain, starts, ends)
        _, where, which = np.unique(hashes, return_index=True, return_inverse=True)
        raw, known = plain.tobytes(), self.known
        keys = [raw[a:b] for a, b in zip(starts[where].tolist(), ends[where].tolist(), strict=True)]
        new = [k for k in keys if k not in known]
        if new:
            if len(known) + len(new) > CACHED_PIECES:
                known.clear()
                new = keys
            for key, e in zip(new, self.library.encode_batch_fast([k.decode() for k in new], add_special_tokens=False), strict=True):
                known[key] = np.array(e.ids, np.uint16).tobytes()
        coded = [known[k] for k in keys]
        lengths = np.fromiter(map(len, coded), np.int64, len(coded)) // 2
        flat = np.frombuffer(b"".join(coded), np.uint16)
        at = np.cumsum(lengths) - lengths
        ids = flat[K.ragged(at[which], lengths[which])]
        running = np.concatenate([[0], np.cumsum(lengths[which])])
        counts = np.diff(running[first])
        doc_end = np.cumsum(counts + 1)
        out = np.full(len(ids) + len(counts), END, np.uint32)
        body = np.ones(len(out), bool)
        body[doc_end - 1] = False
        out[body] = ids
        return out, counts + 1


def repair(ids: np.ndarray, doc_lengths: np.ndarray, vocabulary: int = VOCABULARY, max_rules: int = MAX_RULES, min_count: int = MIN_COUNT):
    """Re-Pair: symbols, symbols per document, and the rules (pairs of symbols) in order of creation.

    Pairs within a factor eight of the most frequent become rules together and are replaced from left to right, until no pair
    occurs ``min_count`` times. Symbols stay at the position of their first id, linked to their neighbours, and a round
    counts only the pairs of positions that are awake: a pair of old symbols never gets more frequent, so the positions of one below
    ``min_count`` retire for good, those of one below the level sleep until the level falls, and both wake only when a neighbour
    becomes a new symbol, which makes a new pair. Pairs are counted in a table by hash; where two share a slot the round
    counts one of them exactly and leaves the other awake for the next round, which hashes differently.
    """
    n = len(ids)
    seq = ids.astype(np.uint32)
    after, before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
    begins = np.cumsum(doc_lengths) - doc_lengths
    final = np.zeros(n, bool)  # the last symbol of a document has no pair
    final[begins[1:] - 1] = True
    final[n - 1:] = True
    alive = np.ones(n, bool)
    state = np.where(final, OUT, AWAKE).astype(np.uint8)
    rules: list[np.ndarray] = []
    made, level, turn = 0, None, 0
    while made < max_rules:
        turn += 1
        at = np.flatnonzero(state == AWAKE).astype(np.int32)
        if not len(at):
            asleep = state == ASLEEP
            if not asleep.any():
                break
            state[asleep], level = AWAKE, None
            continue
        code = seq[at].astype(np.uint64)
        code <<= np.uint64(32)
        code |= seq[after[at]]
        bits = min(PAIR_BITS, max(8, int(len(at)).bit_length() + 1))
        slot = (code * np.uint64(K.BASE + 2 * turn) >> np.uint64(64 - bits)).astype(np.int64)
        bound = np.bincount(slot, minlength=1 << bits)
        if level is None:
            level = max(min_count, int(bound.max()) // 8)
        state[at] = _RESTS[(bound >= min_count).astype(np.int8) + (bound >= level)][slot]
        near = bound[slot] >= level
        at, slot, code = at[near], slot[near], code[near]
        held = np.zeros(1 << bits, np.uint64)
        held[slot] = code
        same = held[slot] == code  # the others stay awake
        at, slot = at[same], slot[same]
        count = np.bincount(slot, minlength=1 << bits)
        good = count >= level
        state[at] = _RESTS[(count >= min_count).astype(np.int8) + good][slot]
        chosen = np.flatnonzero(good)
        if len(chosen) > max_rules - made:
            chosen = np.sort(chosen[np.argsort(-count[chosen], kind="stable")[:max_rules - made]])
            good[:] = False
            good[chosen] = True
        if not len(chosen):
            continue
        symbol = (np.cumsum(good) - 1 + vocabulary + made).astype(np.uint32)
        mine = good[slot]
        at, new = at[mine], symbol[slot[mine]]
        # of pairs that overlap, take every other one from the left
        index = np.arange(len(at))
        run_start = np.concatenate([[True], at[1:] != after[at[:-1]]])
        take = (index - np.maximum.accumulate(np.where(run_start, index, 0))) % 2 == 0
        at, new = at[take], new[take]
        pairs = held[chosen]
        rules.append(np.column_stack([pairs >> np.uint64(32), pairs & np.uint64(0xFFFFFFFF)]).astype(np.uint32))
        made += len(chosen)
        second = after[at]
        seq[at], final[at], after[at] = new, final[second], after[second]
        alive[second], state[second] = False, OUT
        follows = after[at]
        inside = follows < n
        before[follows[inside]] = at[inside]
        previous = before[at]
        state[at] = np.where(final[at], OUT, AWAKE)
        previous = previous[previous >= 0]
        state[previous[~final[previous]]] = AWAKE
    symbols = seq[alive]
    per_doc = np.add.reduceat(alive, begins, dtype=np.int64) if len(begins) else np.zeros(0, np.int64)
    return symbols, per_doc, np.concatenate(rules) if rules else np.zeros((0, 2), np.uint32)


#: States of a position: no pair, or one that is too rare; to be counted; to be counted when the level falls.
OUT, AWAKE, ASLEEP = 0, 1, 2
#: What a position becomes whose pair reaches neither the least count nor the level, the least count only, or both.
_RESTS = np.array([OUT, ASLEEP, AWAKE], np.uint8)


def rule_lengths(rules: np.ndarray, vocabulary: int = VOCABULARY) -> np.ndarray:
    """Ids that each rule expands to; rules only refer to earlier ones."""
    out = np.zeros(len(rules), np.int64)
    todo = np.arange(len(rules))
    while len(todo):
        sides = rules[todo].astype(np.int64) - vocabulary
        sizes = np.where(sides < 0, 1, out[np.maximum(sides, 0)])
        out[todo] = np.where((sizes > 0).all(axis=1), sizes.sum(axis=1), 0)
        todo = todo[out[todo] == 0]
    return out


def expand(symbols: np.ndarray, rules: np.ndarray, vocabulary: int = VOCABULARY) -> np.ndarray:
    """Ids of a sequence of symbols: those of each symbol are looked up in a table of all expansions."""
    lengths = np.concatenate([np.ones(vocabulary, np.int64), rule_lengths(rules, vocabulary)])
    starts = np.cumsum(lengths) - lengths
    table = np.empty(int(lengths.sum()), np.uint32)
    table[:vocabulary] = np.arange(vocabulary)
    todo, ready = np.arange(len(rules)), np.ones(len(lengths), bool)
    ready[vocabulary:] = False
    while len(todo):  # rules whose sides are in the table
        good = ready[rules[todo]].all(axis=1)
        now = todo[good]
        for side, skip in ((rules[now, 0], 0), (rules[now, 1], lengths[rules[now, 0]])):
            table[K.ragged(starts[vocabulary + now] + skip, lengths[side])] = table[K.ragged(starts[side], lengths[side])]
        ready[vocabulary + now] = True
        todo = todo[~good]
    return table[K.ragged(starts[symbols], lengths[symbols])]


def _shard_rows(tokenizer: str):
    def run(batches):
        from pyspark import TaskContext

        part, number, encoder = TaskContext.get().partitionId(), 0, Encoder(tokenizer)
        held: list[tuple] = []

        def flush():
            nonlocal number, held
            ids = np.concatenate([h[1] for h in held])
            lengths = np.concatenate([h[2] for h in held])
            doc_ids = pa.concat_arrays([h[0] for h in held])
            held = []
            symbols, doc_symbols, rules = repair(ids, lengths)
            row = {"part": part, "shard": number, "first_id": doc_ids[0].as_py(), "last_id": doc_ids[-1].as_py(), "n_tokens": len(ids),
                   "rules": rules.astype("<u2").tobytes(), "rule_lengths": rule_lengths(rules).astype("<u4").tobytes(),
                   "symbols": symbols.astype("<u2").tobytes()}
            number += 1
            types = {"part": pa.int32(), "shard": pa.int32(), "rules": pa.binary(), "rule_lengths": pa.binary(), "symbols": pa.binary()}
            one = {k: pa.array([v], types.get(k, pa.int64())) for k, v in row.items()}
            n = np.array([len(doc_ids)])
            lists = {"doc_ids": pa.ListArray.from_arrays(pa.array([0, len(doc_ids)], pa.int32()), doc_ids),
                     "doc_symbols": K.list_column(doc_symbols.astype(np.int32), n, pa.int32()),
                     "doc_tokens": K.list_column(lengths.astype(np.int32), n, pa.int32())}
            every = one | lists
            names = [c.split()[0] for c in SHARD.split(", ")]
            return pa.RecordBatch.from_arrays([every[c] for c in names], names)

        for batch in batches:
            for rows, data, offsets in K.runs(batch, "text", RUN_BYTES):
                ids, lengths = encoder.run(data, offsets)
                held.append((rows.column(0), ids, lengths))
                if sum(len(h[1]) for h in held) >= SHARD_TOKENS:
                    yield flush()
        if held:
            yield flush()

    return run


def write_tokens(docs: DataFrame, path: str, tokenizer: str = TOKENIZER) -> None:
    """Write ``docs`` in ascending doc_id order as ``path/shards`` and ``path/manifest``."""
    spark = docs.sparkSession
    ordered = texts(docs).repartitionByRange("doc_id", "tkey").sortWithinPartitions("doc_id", "tkey").select("doc_id", "text")
    ordered.mapInArrow(tidy(_shard_rows(tokenizer)), SHARD).write.parquet(f"{path}/shards")
    shards = spark.read.schema(SHARD).parquet(f"{path}/shards").select("part", "shard", "first_id", "last_id", "n_tokens")
    # global starts: running sums within a part, on top of the totals of the parts before (one row a part)
    parts = shards.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    before = F.coalesce(F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select(F.col("part").alias("p"), before.alias("before"))
    own = F.coalesce(F.sum("n_tokens").over(Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    (shards.withColumn("own", own).join(parts, F.col("part") == F.col("p"))
     .select("part", "shard", "first_id", "last_id", (F.col("before") + F.col("own")).alias("start"), "n_tokens")
     .write.parquet(f"{path}/manifest"))


def _tables(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    manifest = spark.read.schema("part int, shard int, first_id long, last_id long, start long, n_tokens long").parquet(f"{path}/manifest")
    return spark.read.schema(SHARD).parquet(f"{path}/shards"), manifest


def _unpack(row: dict):
    return np.frombuffer(row["symbols"], "<u2").astype(np.uint32), np.frombuffer(row["rules"], "<u2").astype(np.uint32).reshape(-1, 2)


def read_documents(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every stored document (and its ids)."""
    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                symbols, rules = _unpack(row)
                ids = expand(symbols, rules).astype("<u4")
                raw, lengths = ids.tobytes(), np.array(row["doc_tokens"], np.int64)
                ends = np.cumsum(lengths)
                crc = [zlib.crc32(raw[4 * (e - n):4 * e]) for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
                n = len(lengths)
                columns = [pa.array(row["doc_ids"], pa.int64()), pa.array(np.full(n, row["part"], np.int32)), pa.array(np.full(n, row["shard"], np.int32)),
                           pa.array(ends - lengths), pa.array(lengths), pa.array(crc, pa.int64())]
                names = ["doc_id", "part", "shard", "within", "n_tokens", "ids_crc32"]
                if with_ids:
                    columns.append(K.list_column(ids.astype(np.int32), lengths, pa.int32()))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    shards, manifest = _tables(spark, path)
    schema = "doc_id long, part int, shard int, within long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    rows = shards.mapInArrow(tidy(run), schema)
    return rows.join(manifest.select("part", "shard", F.col("start").alias("shard_start")), ["part", "shard"]).select(
        "doc_id", (F.col("shard_start") + F.col("within")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)


def read_range(spark: SparkSession, path: str, start: int, count: int) -> DataFrame:
    """Random access: ``(start, ids)`` pieces covering ids ``start .. start + count - 1`` of the whole store.

    Only shards that overlap are read; in each, expansion lengths locate the symbols
    of the range and only those are expanded.
    """
    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                symbols, rules = _unpack(row)
                lengths = np.concatenate([np.ones(VOCABULARY, np.int64), np.frombuffer(row["rule_lengths"], "<u4").astype(np.int64)])[symbols]
                ends = np.cumsum(lengths)
                low, high = max(0, start - row["start"]), min(row["n_tokens"], start + count - row["start"])
                a, b = int(np.searchsorted(ends, low, "right")), int(np.searchsorted(ends, high, "left")) + 1
                skip = low - int(ends[a] - lengths[a])
                ids = expand(symbols[a:b], rules)[skip:skip + high - low]
                yield pa.RecordBatch.from_arrays([pa.array([row["start"] + low]), pa.array([ids.astype(np.int32).tolist()], pa.list_(pa.int32()))], ["start", "ids"])

    shards, manifest = _tables(spark, path)
    wanted = manifest.where((F.col("start") < start + count) & (F.col("start") + F.col("n_tokens") > start))
    met = shards.join(wanted.select("part", "shard", "start"), ["part", "shard"])
    return met.select("start", "n_tokens", "rules", "rule_lengths", "symbols").mapInArrow(tidy(run), "start long, ids array<int>")


def encode_and_read(docs: DataFrame) -> DataFrame:
    """Write the ids of ``docs`` to a new store in the shared folder and return its documents."""
    spark = docs.sparkSession
    path = scratch_path(spark, "token-store")
    write_tokens(docs, path)
    return read_documents(spark, path)


def op4_repair_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_and_read(documents(spark, sf_dir))
