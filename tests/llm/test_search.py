"""Filter audit, exact top-k and hard negatives against brute force."""

import itertools
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F, types as T

from catalytics.llm import exact_topk, filter_audit, hard_negatives, vectors as V

from .conftest import CLASHES, frame

LABELS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("quality", T.IntegerType()), T.StructField("toxic", T.IntegerType()),
                       *(T.StructField(c, T.StringType()) for c in ("part", "failed", "good", "id_"))])


# --- filter audit -----------------------------------------------------------------------

def brute_audit(rows, labels):
    docs = []
    for doc_id, text, lang, _ in rows:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t),
                 "D": bool(re.search(r"[#$%&*|]", t)),
                 "E": doc_id is not None and any(i is not None and i < doc_id and (x or "") == t for i, x, _, _ in rows)}
        mine = [x for x in labels if x[0] is not None and x[0] == doc_id]
        docs.append((lang or "", fails, any(x[1] == 1 for x in mine), any(x[2] == 1 for x in mine)))
    out, shapley = {}, {}
    for part in {d[0] for d in docs}:
        for order in itertools.permutations("ABCDE"):
            alive = [d for d in docs if d[0] == part]
            gone = []
            for step, f in enumerate(order, 1):
                hit = [d for d in alive if d[1][f]]
                alive = [d for d in alive if not d[1][f]]
                everyone = [d for d in docs if d[0] == part]
                only = sum(d[1][f] and sum(d[1].values()) == 1 for d in everyone)
                out[part, "".join(order), step] = [len(alive), len(hit), sum(d[1][f] for d in gone), only, sum(d[2] for d in hit), sum(d[3] for d in hit)]
                shapley[part, f] = shapley.get((part, f), 0) + len(hit)
                gone += hit
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def audit_rows(rows):
    rng = random.Random(3)
    langs = ["en", "fr", None, ""]
    out = [(i, t, langs[n % 4], s) for n, (i, t, _, s) in enumerate(rows)]
    out += [(500 + i, " ".join(f"w{rng.randrange(900)}" for _ in range(230)) + ["", " #", " A" * 60][i % 3], langs[i % 4], None) for i in range(12)]
    out += [(600 + i, "a copy that a third of all rows share", langs[i % 3], None) for i in range(40)]
    return out + [(3, "a copy that a third of all rows share", "en", None)] * 2


def test_audit_equals_brute_force(spark, rows):
    rows = audit_rows(rows)
    labels = [(i, i % 2, int(i % 5 == 0)) for i in range(0, 700, 3)] + [(None, 1, 1), (600, None, 1), (600, 1, None), (600, 0, 0), (3, 1, 1), (9, None, None)]
    table = spark.createDataFrame([(*x, "a", "b", "c", "d") for x in labels], LABELS)
    found = filter_audit.audit(filter_audit.survivors(filter_audit.failures(frame(spark, rows)), table)).collect()
    got = {(r["part"], r["filter_order"], r["step"]): tuple(r)[3:] for r in found}
    assert len(got) == len(found)
    assert got == brute_audit(rows, labels)


def test_audit_of_empty_tables(spark, none, docs):
    empty = spark.createDataFrame([], LABELS)
    assert filter_audit.audit(filter_audit.survivors(filter_audit.failures(none), empty)).count() == 0
    rows = filter_audit.audit(filter_audit.survivors(filter_audit.failures(docs), empty)).collect()
    assert len(rows) == 2 * 600 and not any(r["good_lost"] or r["toxic_lost"] for r in rows)


def test_audit_of_a_very_long_text(spark):
    long = frame(spark, [(1, "word " * 400_000 + "tail", "en", None), (2, "x" * 3_000_000, "en", None), (3, "x" * 3_000_000, "en", None)])
    assert sorted(map(tuple, filter_audit.failures(long).select("doc_id", "failed").collect())) == [(1, 0b00010), (2, 0b00001), (3, 0b10001)]


@pytest.mark.parametrize("n", [0, 1, 2, 3, 5, 1000, 4097])
def test_positional_popcount(n):
    words = np.random.default_rng(n).integers(0, 1 << 32, n, dtype=np.uint64).astype(np.uint32)
    assert filter_audit.positional_popcount(words).tolist() == [int(((words >> np.uint32(b)) & 1).sum()) for b in range(32)]


# --- vectors ----------------------------------------------------------------------------

VECTORS = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("label", T.IntegerType()),
                        *(T.StructField(c, T.StringType()) for c in ("vector", "block", "g", "salt", "row", "score", *CLASHES[:2]))])


def vector_rows(n=400, width=12, seed=1):
    rng = random.Random(seed)
    rows = [(i, [rng.gauss(0, 0.4) for _ in range(width)], rng.randrange(4)) for i in range(n)]
    rows += [(n + i, rows[7][1], 1) for i in range(n // 2)]  # ties: a third of all rows agree
    rows += [(2000, None, 1), (2050, [0.5, None], 1), (2100, [math.nan, 1.0], 0), (2150, [math.inf], 2), (2200, [], 1), (2250, [0.25, -1.0], 3),
             (2300, [0.5] * (width + 3), None), (2350, [0.1] * (width + 3), 2), (None, [1.0] * width, 1), (2400, [0.0] * width, 1)]
    return rows


def table_of(spark, rows):
    return spark.createDataFrame([(*r, *["clash"] * 8) for r in rows], VECTORS).repartition(3)


def integers(rows, scale, need_label=False):
    width = max([len(v) for _, v, _ in rows if v] or [0])
    out = {}
    for i, v, label in rows:
        if i is None or v is None or any(x is None or not math.isfinite(x) for x in v) or (need_label and label is None):
            continue
        x = [math.floor(scale * float(np.float32(c))) for c in v]
        out[i] = (np.array(x + [0] * (width - len(x)), object), label)
    return out


def brute_top(rows, scale, chosen, k):
    have = integers(rows, scale)
    out = []
    for q in sorted(i for i in have if chosen(i)):
        scores = sorted((-int(have[q][0] @ v), i) for i, (v, _) in have.items() if i != q)[:k]
        out += [(q, r, i, -s) for r, (s, i) in enumerate(scores, 1)]
    return out


def brute_negatives(rows, scale, chosen):
    have = integers(rows, scale, True)
    out = []
    for a in sorted(i for i in have if chosen(i)):
        scores = sorted((-int(have[a][0] @ v), i) for i, (v, _) in have.items() if i != a)
        for p, positive in [x for x in scores if have[x[1]][1] == have[a][1]][:5]:
            window = [(-s, i) for s, i in scores if have[i][1] != have[a][1] and 50 * -p <= 100 * -s <= 95 * -p][:3]
            out += [(a, positive, r, i, -p, s) for r, (s, i) in enumerate(window, 1)]
    return sorted(out)


@pytest.fixture(scope="module")
def small_blocks():
    patch = pytest.MonkeyPatch()
    patch.setattr(V, "GROUP_BYTES", 1000)  # several groups
    yield
    patch.undo()


@pytest.mark.parametrize("scale", [4, 1024, 1 << 24])
def test_top_k_equals_brute_force(spark, small_blocks, scale):
    rows = vector_rows()
    found = exact_topk.top_k(V.integer_rows(table_of(spark, rows), scale), F.col("vec_id") % 25 == 0, 7)
    assert sorted(map(tuple, found.collect())) == brute_top(rows, scale, lambda i: i % 25 == 0, 7)


def test_top_k_gives_all_candidates_if_few(spark):
    rows = vector_rows(10)[:4]
    found = exact_topk.top_k(V.integer_rows(table_of(spark, rows), 8), F.col("vec_id") >= 0, 10)
    assert sorted(map(tuple, found.collect())) == sorted(brute_top(rows, 8, lambda i: True, 10))


def test_top_k_stops_early_on_proof():
    """Where few rows are near a query, most segments stay unread, and the result is that of all of them."""
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((400, 32))
    rows = np.floor(300 * (np.repeat(centres, 10, axis=0) + 0.2 * rng.standard_normal((4000, 32)))).astype(np.int32)
    r, ends, impacts = exact_topk.segments(rows)
    block = exact_topk.Block(np.arange(4000).tobytes(), rows.tobytes(), r.tobytes(), ends.tobytes(), impacts.tobytes())
    query, row, score, used = exact_topk.search_block(block, np.arange(40), rows[:40], 3)
    scores = rows[:40].astype(np.int64) @ rows.T.astype(np.int64)
    for q in range(40):
        want = sorted((-scores[q, i], i) for i in range(4000) if i != q)[:3]
        assert [(-s, i) for i, s in zip(row[query == q], score[query == q])] == want
    assert used.max() < 0.9 * (np.diff(ends, prepend=0) > 0).sum()


def test_repeated_ids_are_one_row(spark):
    rows = [(1, [1.0, 2.0], 0), (1, [1.0, 2.0], 0), (2, [3.0], 0), (2, [1.0], 0), (3, [5.0, 1.0], 1)]
    found = exact_topk.top_k(V.integer_rows(table_of(spark, rows), 1), F.col("vec_id") == 3, 10).collect()
    assert sorted(map(tuple, found)) == [(3, 1, 1, 7), (3, 2, 2, 5)]


@pytest.mark.parametrize("scale", [2, 256, 1 << 23])
def test_negatives_equal_brute_force(spark, small_blocks, scale):
    rows = vector_rows(seed=4)
    found = hard_negatives.mine(V.integer_rows(table_of(spark, rows), scale, label=F.col("label")), F.col("vec_id") % 10 == 0)
    got = sorted((r["anchor_id"], r["positive_id"], r["rank"], r["negative_id"], r["positive_score"], r["negative_score"]) for r in found.collect())
    assert got == brute_negatives(rows, scale, lambda i: i % 10 == 0)


def test_empty_vector_tables(spark):
    empty = V.integer_rows(table_of(spark, []), 256, label=F.col("label"))
    assert exact_topk.top_k(empty, F.col("vec_id") % 5 == 0).count() == 0
    assert hard_negatives.mine(empty, F.col("vec_id") % 5 == 0).count() == 0


@pytest.mark.parametrize("size", [10, 10_000, 50_000_000])
def test_residue_products_are_exact(size):
    rng = np.random.default_rng(size)
    a, b = (rng.integers(-size, size + 1, (n, 150)) for n in (20, 30))
    want = np.array([[sum(int(x) * int(y) for x, y in zip(r, s)) for s in b] for r in a], object)
    got = hard_negatives.rns_scores(a.astype(np.int32), b.astype(np.int32))
    assert (got == want).all()


def test_scores_beyond_64_bits_raise():
    with pytest.raises(OverflowError):
        V.score_bound(np.full((1, 8), 2**31 - 1, np.int32), np.full((1, 8), 2**31 - 1, np.int32))
