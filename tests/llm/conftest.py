"""Small corpora with planted cases, shared by the operator tests."""

import random
import re

import pytest
from pyspark.sql import types as T

#: Further columns with names that operators use inside.
CLASHES = ["tkey", "score", "size", "hash", "label", "copies", "row", "spans", "node", "bucket", "next", "start", "word", "n_words", "class_id"]
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                       T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
                       *(T.StructField(c, T.StringType()) for c in CLASHES)])


def prose(rng, n, size=400):
    return " ".join("".join(rng.choice("abcdeéñ") for _ in range(rng.randint(2, 6))) + rng.choice(["", "", "", ".", ","]) for _ in range(n))[:size * 20]


def rows_with_cases(seed=5):
    """(doc_id, text, lang, source): copies, near copies, shared passages, long repeats, odd texts, null ids, repeated rows."""
    rng = random.Random(seed)
    texts = [prose(rng, rng.randint(1, 160)) for _ in range(40)]
    passage = prose(rng, 90)
    texts += [texts[3], texts[3], texts[4] + " tail", " ".join(texts[5].split()), texts[6].upper()]
    for i in range(6):  # a passage in many documents
        texts.append(prose(rng, 20) + " " + passage + " " + prose(rng, 15))
    near = prose(rng, 150).split()
    for i in range(8):  # near copies of each other
        w = list(near)
        w[rng.randrange(len(w))] = f"edit{i}"
        texts.append(" ".join(w))
    texts += ["", None, " \n\t ", "one", "two words", "same same same same " * 60, "x" * 900, "\n".join(["line that repeats here."] * 30),
              prose(rng, 3000), "ünï çödé text \U0001f600 " * 40, "a\x0bb\x0cc\x1cd"]
    rows = [(i * 7 % 1009, t, "en", f"src{i % 4}" if i % 9 else None) for i, t in enumerate(texts)]
    rows += [(None, texts[7], "en", "src1"), (None, None, None, None), rows[2], rows[2], (rows[10][0], "another text of an id used twice", "en", "src0")]
    return rows


def frame(spark, rows):
    full = [(i, t, lang, source, len(t or ""), *["clash"] * len(CLASHES)) for i, t, lang, source in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def rows():
    return rows_with_cases()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return frame(spark, rows)


@pytest.fixture(scope="session")
def none(spark):
    return frame(spark, [])


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")
