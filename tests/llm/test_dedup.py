"""Operators 1-3 against brute force."""

import collections
import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq

from catalytics.llm import components, cover_dedup, near_dup, suffix_dedup
from conftest import SF_SMALL
from .conftest import frame, words


def bag(df, *columns):
    return collections.Counter(tuple(r) for r in df.select(*columns).collect())


def shingle_set(text):
    w = words(text)
    return frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute_members(rows):
    """Lists of row numbers, one per class."""
    sets = [shingle_set(t) for _, t, *_ in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] == sets[j] or (both and both >= 0.8 * (len(sets[i]) + len(sets[j]) - both)):
                parent[find(i)] = find(j)
    members = collections.defaultdict(list)
    for i in range(len(rows)):
        members[find(i)].append(i)
    return list(members.values())


def brute_classes(rows):
    out = collections.Counter()
    for own in brute_members(rows):
        ids = [rows[i][0] for i in own if rows[i][0] is not None]
        out.update((rows[i][0], min(ids) if ids else None, len(own)) for i in own)
    return out


def test_near_dup_classes_equal_brute_force(docs, rows):
    assert bag(near_dup.classes(docs), "doc_id", "class_id", "class_size") == brute_classes(rows)


def test_links_across_classes_of_a_bucket_are_found(spark, monkeypatch):
    """Chains: neighbours are similar, the ends and the hub are not; blocks of two force the block-wise check."""
    monkeypatch.setattr(near_dup, "BLOCK", 2)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(24):
        w = list(base)
        for k in range(i + 1):
            w[k * 5] = f"e{k}"
        rows.append((i, " ".join(w), "en", "s"))
    assert bag(near_dup.classes(frame(spark, rows)), "doc_id", "class_id", "class_size") == brute_classes(rows)


def test_keep_one_keeps_all_columns_and_one_row_a_class(docs, rows):
    kept = near_dup.keep_one(docs)
    assert kept.columns == docs.columns
    assert kept.count() == len(brute_members(rows))


def test_signature_agreement_estimates_weighted_similarity():
    rng = np.random.default_rng(0)
    value = rng.integers(0, 1 << 62, 60).astype(np.uint64)
    a, b = rng.uniform(0.1, 3, 60), rng.uniform(0.1, 3, 60)
    signed = near_dup.signatures(np.concatenate([value, value]), np.concatenate([a, b]), np.array([0, 60, 120]), 2048)
    want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    assert abs((signed[0] == signed[1]).mean() - want) < 0.04


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 12)] + [(100, i) for i in range(101, 130)] + [(7, 7)]
    got = dict(components.components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {**{i: 0 for i in range(13)}, **{i: 100 for i in range(100, 130)}}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_bytes(rows, length):
    raw = [(i, (t or "").encode()) for i, t, *_ in rows]
    seen = collections.Counter(b[j:j + length] for _, b in raw for j in range(len(b) - length + 1))
    out = collections.Counter()
    for i, b in raw:
        gone = np.zeros(len(b), bool)
        for j in range(len(b) - length + 1):
            if seen[b[j:j + length]] > 1:
                gone[j:j + length] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out[i, len(b), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()] += 1
    return out


COLUMNS_2 = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def test_suffix_dedup_equals_brute_force(docs, rows):
    assert bag(suffix_dedup.removal_report(docs), *COLUMNS_2) == brute_bytes(rows, suffix_dedup.LENGTH)


def test_suffix_dedup_counts_windows_of_hot_groups(docs, rows):
    spans = suffix_dedup.repeated_spans(docs, hot=0)
    some, none = suffix_dedup.with_spans(docs, spans)
    removed = sum(suffix_dedup.cut(r["text"].encode(), r["spans"])[1] for r in some.collect() if r["spans"])
    assert removed == sum(k[2] * n for k, n in brute_bytes(rows, suffix_dedup.LENGTH).items())


def test_suffix_dedup_leaves_the_same_bytes_as_its_report(docs):
    kept = collections.Counter((r["doc_id"], hashlib.sha256(r["kept"]).hexdigest()) for r in suffix_dedup.remove_repeats(docs).collect())
    assert kept == bag(suffix_dedup.removal_report(docs), "doc_id", "kept_sha256")


def periodic_rows():
    """Stretches of short period: alone, inside other text, cut in two, in several texts, and just too short."""
    rng = np.random.default_rng(3)
    noise = lambda n: "".join(map(chr, rng.integers(97, 123, n)))
    texts = ["the of " * 900, noise(500) + "the of " * 300 + noise(700), "the of " * 200 + noise(1500) + "the of " * 200, "a" * 3000,
             noise(350) + "b" * 450, noise(200) + "c" * 399 + noise(200), "d" * 400, "e" * 401, "fgh" * 133 + "f", noise(1700),
             (noise(333) * 9)[:2600], "é" * 650, "the of " * 900, "", None]
    return [(i, t, "en", "s") for i, t in enumerate(texts)]


def test_suffix_dedup_of_periodic_texts_equals_brute_force(spark):
    rows = periodic_rows()
    assert bag(suffix_dedup.removal_report(frame(spark, rows)), *COLUMNS_2) == brute_bytes(rows, suffix_dedup.LENGTH)


def test_a_stretch_of_short_period_is_one_counted_row():
    class Full:
        value = np.full(1 << 17, 255, np.uint8)  # passes every anchor

    text = "the of " * 900
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array([5, 6]), pa.array([text, "x" * 300 + text])], ["doc_id", "tkey", "text"])
    got = pa.Table.from_batches(list(suffix_dedup._anchor_rows(Full)(batch))).to_pandas()
    assert len(got) < 400
    assert got["n"].sum() > 1000  # an anchor in every period
    assert (got["until"] - got["pos"] == 7 * (got["n"] - 1)).all()


def brute_words(rows, window):
    own = [(i, words(t)) for i, t, *_ in rows]
    rank = lambda i: float("inf") if i is None else i
    least = {}
    for i, w in own:
        for j in range(len(w) - window + 1):
            key = tuple(w[j:j + window])
            least[key] = min(least.get(key, float("inf")), rank(i))
    out = collections.Counter()
    for i, w in own:
        gone = set()
        for j in range(len(w) - window + 1):
            if least[tuple(w[j:j + window])] < rank(i):
                gone.update(range(j, j + window))
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        out[i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()] += 1
    return out


def test_cover_dedup_equals_brute_force(docs, rows, monkeypatch):
    want = brute_words(rows, cover_dedup.WINDOW)
    columns = ("doc_id", "n_words", "n_removed", "kept_sha256")
    assert bag(cover_dedup.removal_report(docs), *columns) == want
    monkeypatch.setattr(cover_dedup, "BLOCK", 50)  # many small blocks
    assert bag(cover_dedup.removal_report(docs), *columns) == want


def test_cover_dedup_in_many_buckets_with_a_full_filter(docs, rows, monkeypatch):
    """One shuffle partition holds many buckets, of a few hashes each; most anchors pass the filter."""
    tables = {}
    monkeypatch.setattr(cover_dedup, "BUCKET_BYTES", 500)
    monkeypatch.setattr(cover_dedup, "BUCKET_HASHES", 50)
    monkeypatch.setattr(cover_dedup.prefilter, "MAX_BITS", 13)
    made = cover_dedup.landed
    monkeypatch.setattr(cover_dedup, "landed", lambda df, name, **options: tables.setdefault(name, made(df, name, **options)))
    assert bag(cover_dedup.removal_report(docs), "doc_id", "n_words", "n_removed", "kept_sha256") == brute_words(rows, cover_dedup.WINDOW)
    assert tables["cover-anchors"].count() > 10 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def test_written_blocks_of_windows_are_in_small_row_groups(spark, docs, monkeypatch):
    """Parquet's writer held a hundred rows of 6 MB each before it looked at their size."""
    monkeypatch.setattr(cover_dedup, "BLOCK", 20)
    tables = {}
    made = cover_dedup.landed
    monkeypatch.setattr(cover_dedup, "landed", lambda df, name, **options: tables.setdefault(name, made(df, name, **options)))
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    cover_dedup.removal_report(docs.coalesce(1)).count()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    groups = [pq.ParquetFile(f.removeprefix("file://")).metadata for f in tables["cover-windows"].inputFiles()]
    rows = [m.row_group(i).num_rows for m in groups for i in range(m.num_row_groups)]
    assert sum(rows) > 4 and max(rows) <= 2


def test_filter_of_anchors(spark, monkeypatch):
    """Every hash that was put in passes; at six bits a hash a twentieth of the others does, with one bit a hash a seventh did."""
    monkeypatch.setattr(cover_dedup.prefilter, "MAX_BITS", 20)
    rng = np.random.default_rng(3)
    held = np.unique(rng.integers(0, 1 << 64, (1 << 20) // 6, dtype=np.uint64))
    parts = [(len(x), cover_dedup._pack(x)) for x in np.array_split(held, 7)]
    packed, k = cover_dedup._filter(spark.createDataFrame(parts, "n long, hashes binary"))
    assert len(packed) == 1 << 17 and k > 1
    assert len(cover_dedup._passing(packed, k, held)) == len(held)
    assert len(cover_dedup._passing(packed, k, rng.integers(0, 1 << 64, 100_000, dtype=np.uint64))) < 7_000


def test_byte_planes():
    for kind in ("<u8", "<u4", "<i8"):
        for n in (0, 1, 5):
            x = np.arange(n).astype(kind) * 3 - (kind == "<i8")
            assert (cover_dedup._from_planes(cover_dedup._planes(x), kind) == x).all() and len(cover_dedup._planes(x)) == n * x.itemsize


def test_cover_is_a_difference_cover():
    period, cover = cover_dedup.PERIOD, cover_dedup.COVER
    for i in range(period):
        for j in range(period):
            assert any((i + s) % period in cover and (j + s) % period in cover for s in range(period))


def test_empty_tables(none):
    assert near_dup.classes(none).count() == 0
    assert near_dup.keep_one(none).count() == 0
    assert suffix_dedup.removal_report(none).count() == 0
    assert cover_dedup.removal_report(none).count() == 0


def test_near_dup_query_on_the_given_table(spark):
    rows = [(r["doc_id"], r["text"], None, None) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()]
    assert bag(near_dup.op1_dart_minhash(spark, SF_SMALL), "doc_id", "class_id", "class_size") == brute_classes(rows)


def test_suffix_dedup_query_on_the_given_table(spark):
    rows = [(r["doc_id"], r["text"], None, None) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()]
    assert bag(suffix_dedup.op2_column_suffix_dedup(spark, SF_SMALL), *COLUMNS_2) == brute_bytes(rows, suffix_dedup.LENGTH)
