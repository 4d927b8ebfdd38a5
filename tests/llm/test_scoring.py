"""Operators 6-8: classifier, language-model scores, decontamination."""

import collections
import hashlib
import re
import zlib

import numpy as np

from catalytics.llm import decontaminate, lm_score, quality
from conftest import SF_SMALL

MIDDLE = "/root/testdata/sf0.01"


def labels_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_quality_held_out_accuracy(spark):
    got = quality.op7_qda_quality(spark, MIDDLE)
    marks = spark.read.parquet(f"{MIDDLE}/labels.parquet")
    rows = got.join(marks, "doc_id").where("held_out").collect()
    assert len(rows) > 80
    assert np.mean([r["predicted"] == r["quality"] for r in rows]) > 0.97
    assert all((zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) == r["held_out"] for r in got.collect())


def test_quality_never_learns_from_held_out_rows(spark):
    docs, marks = spark.read.parquet(f"{SF_SMALL}/documents.parquet"), spark.read.parquet(f"{SF_SMALL}/labels.parquet")
    turned = marks.selectExpr("doc_id", "case when crc32(cast(cast(doc_id as string) as binary)) % 3 = 1 then 1 - quality else quality end as quality")
    a, b = (sorted((r["doc_id"], round(r["score"], 9)) for r in quality.classify(docs, m).collect()) for m in (marks, turned))
    assert a == b


def test_quality_edge_cases(spark, docs, none, rows):
    marks = labels_of(spark, [(0, 1, 0), (7, 0, 0), (None, 1, 0), (14, None, 0), (7, 1, 0), (21, 1, 0), (28, 0, 1), (35, 1, 0)])
    got = quality.classify(docs, marks).collect()
    assert len(got) == len(rows)
    assert all(0.0 <= r["score"] <= 1.0 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    assert quality.classify(none, marks).count() == 0
    kept = quality.keep_good(docs, marks)
    assert kept.columns == docs.columns and kept.count() == sum(r["predicted"] for r in got)
    for one_class, predicted in ((1, 1), (0, 0)):
        only = quality.classify(docs, labels_of(spark, [(0, one_class, 0), (7, one_class, 0)])).collect()
        assert {r["predicted"] for r in only} == {predicted}
    assert {r["predicted"] for r in quality.classify(docs, labels_of(spark, [])).collect()} == {1}


def test_far_margins_stay_apart():
    s = quality.score_of(np.array([-1e6, -1e3, 0.0, 1e3, 1e6, 1e6 + 10]))
    assert (np.diff(s) > 0).all() and 0 < s[0] and s[-1] < 1 and s[2] == 0.5


def brute_decontaminate(rows, items):
    word = lambda t: re.findall(r"[0-9a-z\u0080-\U0010FFFF]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = collections.defaultdict(set)
    for item_id, text in items:
        w = word(text)
        size = min(10, len(w))
        for j in range(len(w) - size + 1 if size else 0):
            windows[tuple(w[j:j + size])].add(item_id)
    sizes = {len(k) for k in windows}
    out = collections.Counter()
    for i, text, *_ in rows:
        w, hit, found = word(text), set(), set()
        for size in sizes:
            for j in range(len(w) - size + 1):
                if (key := tuple(w[j:j + size])) in windows:
                    hit.update(range(j, j + size))
                    found |= windows[key]
        names = sorted(str(x) for x in found if x is not None)
        out[i, len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit)] += 1
    return out


def test_decontamination_equals_brute_force(spark, docs, none, rows):
    item = lambda n, a, b: " ".join((rows[n][1] or "").split()[a:b])
    items = [(1, item(3, 0, 40)), (2, item(5, 2, 30)), (10, item(5, 2, 30)), (3, ""), (4, None), (5, "one"), (6, "Two  WORDS"), (None, item(8, 0, 25)),
             (7, "same same same same same same same same same same same same"), (8, "same " * 4), (9, item(9, 0, 9)), (9, item(9, 0, 9)), (11, item(41, 25, 60))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    names = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    got = collections.Counter(tuple(r) for r in decontaminate.decontaminate(docs, bench).select(*names).collect())
    assert got == brute_decontaminate(rows, items)
    kept = decontaminate.keep_clean(docs, bench)
    assert kept.columns == docs.columns and kept.count() == sum(n for k, n in got.items() if not k[-1])
    empty = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.decontaminate(docs, empty).where("contaminated or n_hit > 0 or n_items > 0").count() == 0
    assert decontaminate.decontaminate(none, bench).count() == 0


def test_winnowing_keeps_a_fingerprint_of_every_window():
    rng = np.random.default_rng(1)
    hashes = rng.integers(0, 5, 400).astype(np.uint64)  # many ties
    ((_, at, _),) = decontaminate.fingerprints(hashes, np.array([0, 400]), [decontaminate.WINDOW])
    chosen = set(at.tolist())
    for i in range(400 - decontaminate.WINDOW + 1):
        assert any(j in chosen for j in range(i, i + decontaminate.WINDOW - decontaminate.GRAM + 1))


def brute_losses(rows, good):
    """The models of ``lm_score`` with dictionaries, over the same slots."""
    slots = []
    for _, text, *_ in rows:
        raw = np.frombuffer((text or "").encode(), np.uint8)
        word, context, pair, _, _ = lm_score.slots(raw, np.array([0, len(raw)]))
        slots.append((word.tolist(), context.tolist(), pair.tolist()))
    out = []
    tables = []
    for member in ([True] * len(rows), good):
        words, pairs = collections.Counter(), collections.Counter()
        for (w, _, p), m in zip(slots, member, strict=True):
            if m:
                words.update(w)
                pairs.update(p)
        tables.append((words, pairs))
    tokens = [max(1, sum(t[0].values())) for t in tables]
    scales = (min(1.0, tokens[1] / tokens[0]), 1.0)
    for (i, *_), (w, c, p), m in zip(rows, slots, good, strict=True):
        losses = []
        for (words, pairs), scale, n, inside in zip(tables, scales, tokens, (True, m), strict=True):
            own_w, own_p = (collections.Counter(w), collections.Counter(p)) if inside else (collections.Counter(), collections.Counter())
            total = max(scale * n - scale * len(w) * inside, 0)
            loss = 0.0
            for a, b, x in zip(w, c, p, strict=True):
                single = (scale * max(words[a] - own_w[a], 0) + lm_score.PRIOR) / (total + lm_score.PRIOR * max(1, len(tables[0][0])))
                seen = scale * max(words[b] - own_w[b], 0)
                both = min(scale * max(pairs[x] - own_p[x], 0), seen)
                weight = lm_score.MIX * seen / (seen + 1)
                loss -= np.log(weight * both / max(seen, 1e-9) + (1 - weight) * single)
            losses.append(loss / max(len(w), 1))
        out.append((i, len(w), round(losses[1], 6), round(losses[0], 6), round(losses[1] - losses[0], 6)))
    return sorted(out, key=str)


def test_losses_equal_brute_force(spark, docs, none, rows):
    marks = labels_of(spark, [(0, 1, 0), (7, 1, 0), (14, 0, 0), (21, 1, 0), (21, 0, 0), (None, 1, 0), (28, None, 0), (35, 1, 0)])
    good = [i in (0, 7, 35) for i, *_ in rows]
    got = sorted(((r[0], r[1], *(round(x, 6) for x in r[2:])) for r in lm_score.cross_entropy_difference(docs, marks).collect()), key=str)
    want = brute_losses(rows, good)
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert a[:2] == b[:2] and np.allclose(a[2:], b[2:], atol=2e-6)
    assert lm_score.cross_entropy_difference(none, marks).count() == 0
    assert lm_score.cross_entropy_difference(docs, labels_of(spark, [])).where("isnan(score)").count() == 0


def test_many_batches_and_stretches(spark, docs, rows, monkeypatch):
    """One text a chunk, rows of a stretch in many Arrow batches, and more stretches than for few chunks: the same losses."""
    marks = labels_of(spark, [(0, 1, 0), (7, 1, 0)])
    want = sorted((tuple(r)[:2] + tuple(round(x, 9) for x in tuple(r)[2:]) for r in lm_score.cross_entropy_difference(docs, marks).collect()), key=str)
    monkeypatch.setattr(lm_score, "CHUNK_BYTES", 1)
    monkeypatch.setattr(lm_score, "STRETCH_BITS", {"words": 1, "pairs": 2})
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    for chunks in (1, 20):
        monkeypatch.setattr(lm_score, "STRETCH_CHUNKS", chunks)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 2)
        found = lm_score.cross_entropy_difference(docs, marks).collect()
        assert sorted((tuple(r)[:2] + tuple(round(x, 9) for x in tuple(r)[2:]) for r in found), key=str) == want
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


def test_stretches_grow_with_the_chunks():
    assert lm_score.stretch_bits(0) == lm_score.stretch_bits(lm_score.STRETCH_CHUNKS) == lm_score.STRETCH_BITS
    assert lm_score.stretch_bits(lm_score.STRETCH_CHUNKS * 8) == {k: v + 3 for k, v in lm_score.STRETCH_BITS.items()}


def test_scores_tell_good_from_bad(spark):
    marks = spark.read.parquet(f"{MIDDLE}/labels.parquet").selectExpr("doc_id as i", "quality")
    rows = lm_score.op6_cross_entropy_difference(spark, MIDDLE).join(marks, marks["i"] == lm_score.F.col("doc_id")).collect()
    mean = {q: np.mean([r["score"] for r in rows if r["quality"] == q]) for q in (0, 1)}
    assert mean[1] < mean[0]


def test_losses_count_words_and_pairs_themselves(spark):
    """More distinct words and bigrams than 2**18 and 2**21, against dictionaries keyed by the words."""
    rng = np.random.default_rng(6)
    texts = [" ".join(f"w{x}" for x in np.where(rng.random(4000) < 0.3, rng.integers(0, 50, 4000), rng.integers(0, 1 << 20, 4000))) for _ in range(700)]
    texts += ["", " w1  W1 w2\n", "the the the"]
    good = [i % 3 == 0 for i in range(len(texts))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)
    marks = labels_of(spark, [(i, int(g), 0) for i, g in enumerate(good)])
    tables = [(collections.Counter(), collections.Counter()) for _ in range(2)]
    split = [t.lower().split() for t in texts]
    for w, g in zip(split, good, strict=True):
        for words, pairs in tables[:1 + g]:
            words.update(w)
            pairs.update(zip(w, w[1:]))
    distinct = len(tables[0][0])
    assert distinct > 1 << 18 and len(tables[0][1]) > 1 << 21
    tokens = [sum(t[0].values()) for t in tables]
    got = {r["doc_id"]: r for r in lm_score.cross_entropy_difference(docs, marks).collect()}
    assert len(got) == len(texts)
    for i in [0, 1, 2, 350, 699, 700, 701, 702]:
        w, losses = split[i], []
        for (words, pairs), scale, n, inside in zip(tables, (tokens[1] / tokens[0], 1.0), tokens, (True, good[i]), strict=True):
            own_w, own_p = (collections.Counter(w), collections.Counter(zip(w, w[1:]))) if inside else ({}, {})
            loss = 0.0
            for before, a in zip([None, *w], w):
                single = (scale * (words[a] - (own_w[a] if inside else 0)) + lm_score.PRIOR) / (scale * (n - len(w) * inside) + lm_score.PRIOR * distinct)
                seen = scale * (words[before] - (own_w[before] if inside else 0))
                both = min(scale * (pairs[before, a] - (own_p[before, a] if inside else 0)), seen)
                weight = lm_score.MIX * seen / (seen + 1)
                loss -= np.log(weight * both / max(seen, 1e-9) + (1 - weight) * single)
            losses.append(loss / max(len(w), 1))
        assert got[i]["n_tokens"] == len(w)
        assert np.allclose([got[i]["background_loss"], got[i]["target_loss"], got[i]["score"]], [*losses, losses[1] - losses[0]], atol=1e-6)
