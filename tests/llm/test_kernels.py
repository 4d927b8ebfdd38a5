"""Vectorised text kernels and bitmaps against plain Python."""

import random

import numpy as np
import pyarrow as pa

from catalytics.llm import kernels as K
from catalytics.llm import prefilter
from .conftest import words


def test_words_of_runs_and_slices():
    rng = random.Random(0)
    texts = ["", "a b  c", None, " x", "y ", "é ñ\n\tzz", "ab"] + ["".join(rng.choice("ab é\n") for _ in range(rng.randint(0, 40))) for _ in range(200)]
    for kind in (pa.string(), pa.large_string()):
        batch = pa.RecordBatch.from_arrays([pa.array(texts, kind)], ["text"]).slice(1)
        got = []
        for rows, data, offsets in K.runs(batch, "text", 300):
            starts, ends, first = K.words(data, offsets, K.NOT_SPACE)
            got += [[bytes(data[starts[j]:ends[j]]).decode() for j in range(first[r], first[r + 1])] for r in range(rows.num_rows)]
        assert got == [words(t) for t in texts[1:]]


def test_hashes_depend_on_content_only():
    data = np.frombuffer(b"abc xyz abc xy abcabc", np.uint8)
    sums = K.prefix(data)
    spans = [(0, 3), (8, 11), (15, 18), (18, 21), (4, 7), (12, 14)]
    h = K.span_hash(*sums, np.array([a for a, _ in spans]), np.array([b for _, b in spans]))
    assert h[0] == h[1] == h[2] == h[3] and len(set(h.tolist())) == 3
    grams = K.grams(np.array([5, 6, 7, 5, 6, 7, 8], np.uint64), 3)
    assert grams[0] == grams[3] and len(set(grams.tolist())) == 4


def test_merge_spans_and_ragged():
    starts, ends = K.merge_spans(np.array([5, 0, 2, 9, 20]), np.array([8, 3, 4, 12, 21]))
    assert list(zip(starts.tolist(), ends.tolist())) == [(0, 4), (5, 8), (9, 12), (20, 21)]
    assert K.merge_spans(np.zeros(0, int), np.zeros(0, int))[0].size == 0
    assert K.ragged(np.array([3, 0, 10]), np.array([2, 0, 3])).tolist() == [3, 4, 10, 11, 12]


def test_bitmap_passes_all_its_hashes_and_few_others(spark):
    values = [(x * 0x9E3779B97F4A7C15 + 7) % (1 << 64) - (1 << 63) for x in range(5000)]
    packed = prefilter.bitmap(spark.createDataFrame([(v,) for v in values], "hash long"))
    assert prefilter.passes(packed, np.array(values, np.int64)).all()
    others = np.random.default_rng(1).integers(-(1 << 62), 1 << 62, 20000)
    assert prefilter.passes(packed, others).mean() < 0.1
    some, none = prefilter.split(spark.createDataFrame([(v, "t") for v in values[:50]], "hash long, t string"), "hash", packed)
    assert some.count() == 50 and none.count() == 0
