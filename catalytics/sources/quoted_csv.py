"""CSV whose quoted fields hold line breaks, read in splits.

Spark's own reader gives such a file to one task, because a line break only ends a record outside of quotes. A quote character
always toggles between inside and outside (an escaped quote is two of them), so a part of a file that holds an odd number
of quotes toggles the state and one with an even number keeps it, whatever the state at its start:

1. each split of a file, as the text source cuts it, is reduced to the parity of its quotes;
2. the parities of the splits before it, composed in file order, give the state in which a split starts: one row per split;
3. each split puts its lines together to records. The lines before its first record start, and the record that is open at its
   end, are fragments; a record over several splits is put together from its fragments, which are few;
4. records are parsed by Spark's CSV expression, column by column.

Neither lines nor records are shuffled, but for the fragments. Memory of a task is bounded by a batch of lines
and the longest record. Files that no split cuts within quotes, such as compressed ones, which are a split each, are not read for fragments.

Defined cases: blank lines outside of quotes are skipped, as by Spark's reader; a carriage return before the line break
that ends a record belongs to it, one inside of quotes stays; an unfinished record at the end of a file ends with the
file; empty files give no rows; quotes within unquoted fields are not supported (they would toggle the state). A record with too
few fields has nulls, one with too many loses the rest, an empty field is null, a quoted empty one is empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from ..session import materialise

OPTIONS = {"escape": '"', "mode": "PERMISSIVE", "multiLine": "true"}
_RECORDS = "number long, side int, first boolean, record string"
#: Of a split: lines of a record that an earlier split opened; a whole record; lines of a record that stays open.
HEAD, WHOLE, TAIL = 0, 1, 2


def lines(source: DataFrame) -> DataFrame:
    """``(line, odd, file, split)`` of a text source (``read.text`` or ``readStream.text`` with ``lineSep`` newline) with its
    ``_metadata``: whether the line has an odd number of quotes, its file and the start of its split."""
    quotes = F.octet_length("value") - F.octet_length(F.replace("value", F.lit('"'), F.lit("")))
    return source.select(F.col("value").alias("line"), (quotes % 2 == 1).alias("odd"), F.col("_metadata.file_path").alias("file"),
                         F.col("_metadata.file_block_start").alias("split"))


def split_states(found: DataFrame) -> DataFrame:
    """``(file, split, number, inside, open)``: a split's number, and whether it starts and whether it ends within quotes.

    One row per split, as many as the scan itself plans; numbers follow the order of files and splits.
    """
    parity = found.groupBy("file", "split").agg((F.count_if("odd") % 2).alias("p"))
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum("p").over(before), F.lit(0))
    number = F.row_number().over(Window.orderBy("file", "split")).cast("long")
    return parity.select("file", "split", number.alias("number"), (start % 2 == 1).alias("inside"), ((start + F.col("p")) % 2 == 1).alias("open"))


def _assemble(batches: Iterator[pa.RecordBatch], wholes: bool) -> Iterator[pa.RecordBatch]:
    """Whole records or fragments of splits, each a consecutive range of the lines of a task."""
    # the split; its state after the lines so far; whether ``held`` began here; whether the next record is the file's first
    at, inside, opened, held, first = None, False, False, [], False

    def out(side, records):
        nonlocal first
        n, top = len(records), first
        first = False
        if (side == WHOLE) != wholes:
            return
        marks = np.zeros(n, bool)
        marks[:1] = top
        yield pa.RecordBatch.from_arrays([pa.array(np.full(n, at)), pa.array(np.full(n, side, np.int32)), pa.array(marks), pa.array(records, pa.string())],
                                          ["number", "side", "first", "record"])

    def rest():
        """What is held at the end of a split: lines of a record without its end."""
        if held:
            yield from out(TAIL if opened else HEAD, ["\n".join(held)])

    for batch in batches:
        numbers = batch.column(2).to_numpy()
        edges = np.flatnonzero(np.diff(numbers, prepend=-1, append=-1))
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
            if numbers[a] != at:
                yield from rest()
                at, inside, held = int(numbers[a]), bool(batch.column(3)[a].as_py()), []
                opened, first = not inside, bool(batch.column(4)[a].as_py())
            text = batch.column(0).slice(a, b - a)
            state = (np.cumsum(batch.column(1).slice(a, b - a).to_numpy(zero_copy_only=False)) + inside) % 2 == 1  # after each line
            ends = np.flatnonzero(~state)
            if not len(ends):
                held += text.to_pylist()
                continue
            inside = bool(state[-1])
            top = int(ends[0]) + 1
            yield from out(WHOLE if opened else HEAD, ["\n".join([*held, *text.slice(0, top).to_pylist()])])
            opened = True
            if len(ends) > 1 and wholes:
                offsets = ends + 1 - top
                grouped = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), text.slice(top, int(offsets[-1])))
                yield from out(WHOLE, pc.binary_join(grouped, "\n"))
            held = text.slice(int(ends[-1]) + 1).to_pylist()
    yield from rest()


def records(source: DataFrame, header: bool = True) -> DataFrame:
    """``(record)``: the text of each record of the files of a text source, without their header lines if asked."""
    found = lines(source)
    written = materialise(split_states(found), "csv-splits")
    states = F.broadcast(written)  # one row per split of the scan; used twice, found by one read
    placed = found.join(states, ["file", "split"]).select("line", "odd", "number", "inside", (F.col("split") == 0).alias("top"), "open")
    whole = placed.drop("open").mapInArrow(lambda batches: _assemble(batches, True), _RECORDS)
    every = whole.select("first", "record")
    if not written.where(F.col("inside") | F.col("open")).isEmpty():
        every = every.unionByName(_from_fragments(placed, states))
    if header:
        every = every.where(~F.col("first"))
    # "$" is also before a last line terminator; the other records are not searched
    ended = F.lit(False)
    for mark in "\r\n\x85\u2028\u2029":
        ended = ended | F.endswith("record", F.lit(mark))
    return every.select(F.when(ended, F.regexp_replace("record", r"\r$", "")).otherwise(F.col("record")).alias("record")).where(F.trim("record") != "")


def _from_fragments(placed: DataFrame, states: DataFrame) -> DataFrame:
    """``(first, record)``: the records that lie in several splits, or that a file's end leaves open."""
    cut = placed.where(F.col("inside") | F.col("open")).drop("open").mapInArrow(lambda batches: _assemble(batches, False), _RECORDS)
    # a record's fragments: the open end of a split, splits without an end, the head that ends it
    turn = F.sum(F.when(F.col("side") == TAIL, 1).otherwise(0)).over(Window.partitionBy("file").orderBy("number", "side"))
    joined = cut.join(states.select("file", "number"), "number").withColumn("turn", turn).groupBy("file", "turn").agg(
        F.max("first").alias("first"), F.array_sort(F.collect_list(F.struct("number", "side", "record"))).alias("in_order"))  # one record
    return joined.select("first", F.array_join(F.transform("in_order", lambda x: x["record"]), "\n").alias("record"))


def parse(found: DataFrame, schema: T.StructType) -> DataFrame:
    """Columns of records, by Spark's CSV parser."""
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    return found.select(F.from_csv("record", ddl, OPTIONS).alias("r")).select("r.*")


def read(spark: SparkSession, path: str, schema: T.StructType, header: bool = True) -> DataFrame:
    """Files of quoted CSV, each read by as many tasks as it has splits."""
    return parse(records(spark.read.text(path, lineSep="\n"), header), schema)
