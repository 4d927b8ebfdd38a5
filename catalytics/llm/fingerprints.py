"""Document fingerprints: invertible Bloom lookup sketches of piece digests. DataFrame and SQL functions only.

A text is the set of its piece digests: paragraphs (lines), cut further at those sentence ends that
follow a letter from a to g, so that an edit within a long paragraph leaves the rest of it
recognisable. A sketch has
three subtables of s cells; a digest is added to one cell of each: count, xor of digests, xor of
check values. Subtracting two sketches cancels what both hold, and peeling
(cells that hold one digest give it away, which frees further cells) recovers the differing
digests of both sides. When cells are left over the sketches were too small and both are made anew,
larger. The likeness of two texts is the Jaccard similarity that the recovered digests imply.

The fingerprint is the sketch of ``BASE`` cells a subtable, in hexadecimal. Long texts are
compared in groups of about ``GROUP`` digests (by digest bits), each with sketches of its own,
which keeps the work per text near linear.

Defined cases: null and empty texts have no pieces; two such texts have likeness 1. Repeated pieces
count once. Rows are ordered by descending id, null ids last, equal ids by
text hash and text; repeated rows follow each other. The document after the last is the first; a single
document follows itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import documents, landed, texts

BASE = 5
GROUP = 12
ATTEMPTS = 6
ROUNDS = 16
PIECE = r"\n|(?<=[a-g][.!?]) "

_CHECK = "shiftrightunsigned(xxhash64({0}, 1), 32)"


def _slots(k: str, s: str, turn: str) -> str:
    """The three cell numbers of digest ``k``; every attempt uses other bits."""
    return ", ".join(f"'c{j}', {j} * {s} + pmod(shiftrightunsigned({k}, {3 + 17 * j} + {turn}), {s})" for j in range(3))


def _sketch(digests: str, s: str, turn: str) -> str:
    """SQL for the cells of the sketch of an array of digests."""
    items = f"transform({digests}, d -> named_struct('k', d, 'h', {_CHECK.format('d')}, {_slots('d', s, turn)}))"
    empty = "named_struct('n', 0L, 'k', 0L, 'h', 0L)"
    add = "(a, x) -> named_struct('n', a.n + 1L, 'k', a.k ^ x.k, 'h', a.h ^ x.h)"
    tables = ", ".join(f"transform(sequence({j} * {s}, {j + 1} * {s} - 1), c -> aggregate(filter(it, x -> x.c{j} = c), {empty}, {add}))" for j in range(3))
    return f"transform(array({items}), it -> concat({tables}))[0]"


def _difference(a: str, b: str, s: str, turn: str) -> str:
    """SQL for the number of digests that peeling recovers from the subtracted sketches; null when cells are left over."""
    subtracted = (f"zip_with({_sketch(a, s, turn)}, {_sketch(b, s, turn)}, "
                  "(p, q) -> named_struct('n', p.n - q.n, 'k', p.k ^ q.k, 'h', p.h ^ q.h))")
    pure = (f"array_distinct(transform(filter(st.t, c -> abs(c.n) = 1 and c.h = {_CHECK.format('c.k')}), "
            f"c -> named_struct('k', c.k, 'n', c.n, 'h', c.h, {_slots('c.k', s, turn)})))")
    taken = ("transform(st.t, (c, i) -> if(c.n = 0 and c.k = 0, c, aggregate(filter(p, q -> q.c0 = i or q.c1 = i or q.c2 = i), c, "
             "(a, q) -> named_struct('n', a.n - q.n, 'k', a.k ^ q.k, 'h', a.h ^ q.h))))")
    step = f"transform(array({pure}), p -> named_struct('t', {taken}, 'found', st.found + size(p), 'live', size(p) > 0))[0]"
    start = f"named_struct('t', {subtracted}, 'found', 0, 'live', true)"
    left_over = "exists(st.t, c -> c.n <> 0 or c.k <> 0 or c.h <> 0)"
    return f"aggregate(sequence(1, {ROUNDS}), {start}, (st, r) -> if(st.live, {step}, st), st -> if({left_over}, cast(null as int), st.found))"


def _recovered(a: str, b: str) -> str:
    """SQL for the number of differing digests: the fingerprint's size first, or what half the digests need, then doubled while peeling fails."""
    size = f"greatest({BASE}, (size({a}) + size({b})) div 4 + 3) * shiftleft(1, at)"
    attempt = f"transform(array({size}), s -> {_difference(a, b, 's', 'at')})[0]"
    tries = f"aggregate(sequence(0, {ATTEMPTS}), cast(null as int), (done, at) -> if(done is null, {attempt}, done))"
    return f"coalesce({tries}, size(array_except({a}, {b})) + size(array_except({b}, {a})))"


def likeness(a: str, b: str) -> str:
    """SQL for the likeness (0 to 1) of two arrays of digests."""
    group = "filter({0}, d -> pmod(shiftrightunsigned(d, 48), groups) = g)"
    pair = f"named_struct('a', {group.format(a)}, 'b', {group.format(b)})"
    count = f"if(v.a = v.b, 0, {_recovered('v.a', 'v.b')})"
    groups = f"transform(array((size({a}) + size({b})) div {GROUP} + 1), groups -> "
    groups += f"aggregate(sequence(0, groups - 1), 0, (sum, g) -> sum + transform(array({pair}), v -> {count})[0]))[0]"
    total = f"size({a}) + size({b})"
    return f"if({total} = 0, 1D, transform(array({groups}), d -> ({total} - d) / cast({total} + d as double))[0])"


def fingerprint(digests: str) -> str:
    """SQL for the hexadecimal text of the base sketch."""
    cell = "concat(lpad(hex(c.n), 8, '0'), lpad(hex(c.k), 16, '0'), lpad(hex(c.h), 8, '0'))"
    return f"lower(concat_ws('', transform({_sketch(digests, str(BASE), '0')}, c -> {cell})))"


def digests(text) -> F.Column:
    """Distinct digests of the non-empty pieces of a text."""
    pieces = F.filter(F.split(text, PIECE), lambda p: p != "")
    return F.array_distinct(F.transform(pieces, lambda p: F.xxhash64(p)))


def _stretch(doc_id, bounds: list[int]):
    """Which stretch between sorted bounds an id falls in, by bisection; null ids come before all."""
    if not bounds:
        return F.when(doc_id.isNull(), -1).otherwise(0)
    listed = F.array(*(F.lit(b).cast("long") for b in bounds))
    steps = len(bounds).bit_length()

    def halve(state, _):
        middle = F.floor((state["low"] + state["high"]) / 2).cast("int")
        beyond = F.element_at(listed, F.least(middle, F.lit(len(bounds) - 1)) + 1) < doc_id
        more = (state["low"] < state["high"]) & beyond
        return F.struct(F.when(more, middle + 1).otherwise(state["low"]).alias("low"),
                        F.when((state["low"] < state["high"]) & ~beyond, middle).otherwise(state["high"]).alias("high"))

    found = F.aggregate(F.sequence(F.lit(1), F.lit(steps + 1)), F.struct(F.lit(0).alias("low"), F.lit(len(bounds)).alias("high")), halve, lambda s: s["low"])
    return F.when(doc_id.isNull(), -1).otherwise(found)


def with_next(rows: DataFrame, parts: int) -> DataFrame:
    """``rows`` (doc_id, text, tkey, ...) with ``next``: the struct of the row that follows by descending id, cyclically.

    Rows are dealt to stretches of ids; a copy of the next stretch's head closes each of
    them, so that one window per stretch suffices and nothing is ordered as a whole.
    """
    ids = rows.select("doc_id")
    probes = [i / parts for i in range(1, parts)]
    bounds = sorted({b for b in (ids.agg(F.percentile_approx("doc_id", probes, 10 * parts)).first()[0] or [])}) if probes else []
    dealt = rows.withColumn("stretch", _stretch(F.col("doc_id"), bounds)).withColumn("closing", F.lit(0))
    heads = {r["stretch"]: r["head"] for r in dealt.groupBy("stretch").agg(F.max("doc_id").alias("head")).collect()}  # parts rows at most
    order = sorted(heads, reverse=True)
    after = {heads[s]: order[i - 1] for i, s in enumerate(order)}  # head -> the stretch before, which it closes
    found = dealt.where(F.col("doc_id").isin([h for h in after if h is not None]) | (F.col("doc_id").isNull() if None in after else F.lit(False)))
    first = Window.partitionBy("doc_id").orderBy("tkey", "text")
    closes = F.lit(None).cast("int")
    for head, stretch in after.items():
        closes = F.when(F.col("doc_id").isNull() if head is None else F.col("doc_id") == head, stretch).otherwise(closes) if len(after) <= 64 else closes
    if len(after) > 64:  # as a lookup instead of nested branches
        pairs = [x for h, s in after.items() if h is not None for x in (F.lit(h).cast("long"), F.lit(s))]
        closes = F.when(F.col("doc_id").isNull(), after.get(None)).otherwise(F.element_at(F.create_map(*pairs), F.col("doc_id")))
    closing = landed(found.withColumn("rank", F.row_number().over(first)).where("rank = 1").drop("rank")
                     .withColumn("stretch", closes).withColumn("closing", F.lit(1)), "fingerprint-heads")
    carried = F.struct(*(c for c in rows.columns if c not in ("doc_id", "tkey")))
    w = Window.partitionBy("stretch").orderBy("closing", F.col("doc_id").desc_nulls_last(), "tkey", "text")
    return (dealt.unionByName(closing).withColumn("next", F.lead(carried).over(w)).where("closing = 0").drop("stretch", "closing"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """Per document: n_chars, the digest of its edited text, both fingerprints, and likeness to the edited and the next text."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = with_next(texts(docs).withColumn("pieces", digests(F.col("text"))), parts)
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring("next.text", F.lit(1), half))
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), "pieces", F.col("next.pieces").alias("next_pieces"), edited.alias("edited"))
    rows = rows.withColumn("edited_pieces", digests(F.col("edited")))
    return rows.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), F.expr(fingerprint("pieces")).alias("fingerprint"),
        F.expr(fingerprint("edited_pieces")).alias("edited_fingerprint"), F.expr(likeness("pieces", "edited_pieces")).alias("near_edited"),
        F.expr(likeness("pieces", "next_pieces")).alias("near_next"))


def op9_iblt_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(documents(spark, sf_dir))
