"""Retrieval equals a brute-force evaluation of the substring rule."""

import random

import pytest
from pyspark.sql import functions as F

from catalytics.operators import retrieval as RT, substrings


def brute(corpus, questions, n=5, stop=None):
    import re
    from catalytics.functions import fixed
    stop = stop or fixed.STOP_WORDS
    out = []
    for qid, q, cat in questions:
        words = [w.lower() for w in re.split(r"\W+", q) if w.lower() not in stop and len(w) > 2]
        rows = [r for r in corpus if not cat or cat.lower() in (r["product_type"] or "").lower()]
        if not words:
            out += [(qid, i + 1, r["row_seq"], 0) for i, r in enumerate(sorted(rows, key=lambda r: r["row_seq"])[:n])]
            continue
        scored = []
        for r in rows:
            s = sum(int(w in (r[c] or "").lower()) for c in ("title", "tags", "body_html", "product_type", "vendor")
                    for w in words)
            if s > 0:
                scored.append((-s, r["row_seq"]))
        out += [(qid, i + 1, rs, -s) for i, (s, rs) in enumerate(sorted(scored)[:n])]
    return sorted(out)


CORPUS = [
    {"row_seq": 1, "title": "Merino T-Shirts", "tags": "wool, basics", "body_html": "<p>Soft</p>",
     "product_type": "Apparel", "vendor": "Allbirds"},
    {"row_seq": 2, "title": "Running Shoes", "tags": "shoes", "body_html": "light shirt-like mesh",
     "product_type": "Shoes", "vendor": "Acme"},
    {"row_seq": 3, "title": "Summer Dress", "tags": None, "body_html": None, "product_type": "Dresses",
     "vendor": "Acme"},
    {"row_seq": 4, "title": "shirt shirt", "tags": "shirt", "body_html": "", "product_type": None, "vendor": "X"},
]
QUESTIONS = [
    (1, "good t-shirts from Allbirds, preferably merino?", None),
    (2, "shirt shirt", None),
    (3, "what is the best", None),
    (4, "anything for running", "shoes"),
    (5, "zzz qqq", None),
    (6, "the", "dress"),
]


def test_retrieve_equals_brute_force(spark):
    corpus = spark.createDataFrame(CORPUS, "row_seq long, title string, tags string, body_html string, "
                                           "product_type string, vendor string")
    qs = spark.createDataFrame(QUESTIONS, "qid long, question string, category string")
    got = sorted(tuple(r) for r in RT.retrieve(corpus, qs, category="category", n=2).collect())
    assert got == brute(CORPUS, QUESTIONS, n=2)


def test_contains_pairs_is_substring_relation(spark):
    values = ["t-shirts", "shirt", "mesh", "a", "", None, "ab\ncd", "naïve café", "\U0001f600smile\U0001f600", "aaaa", "mesh"]
    needles = ["shirt", "hirts", "mes", "xyz", "a", "sh", "b\nc", "ïve", "\U0001f600s", "e\U0001f600", "aaa", "", None, "mes", "t-shirts and more"]
    vals = spark.createDataFrame([(v,) for v in values], "value string")
    found = substrings.contains_pairs(vals, spark.createDataFrame([(n,) for n in needles], "needle string")).collect()
    want = {(v, n) for v in values for n in needles if v is not None and n and n in v}
    assert {tuple(r) for r in found} == want and len(found) == len(want)


def test_contains_pairs_of_long_values(spark, monkeypatch):
    """Values are indexed in pieces; a needle across their edges is found once."""
    monkeypatch.setattr(substrings, "PIECE", 8)
    rng = random.Random(1)
    values = ["".join(rng.choice("ab") for _ in range(n)) for n in (5, 8, 9, 16, 17, 100, 100)]
    needles = ["".join(rng.choice("ab") for _ in range(n)) for n in (1, 2, 3, 4, 5, 6, 6, 6, 7, 7, 7)] + [values[5][5:15], values[3]]
    found = substrings.contains_pairs(spark.createDataFrame([(v,) for v in values], "value string"),
                                      spark.createDataFrame([(n,) for n in needles], "needle string")).collect()
    want = {(v, n) for v in values for n in needles if n in v}
    assert {tuple(r) for r in found} == want and len(found) == len(want)


def test_a_token_of_a_megabyte_is_harmless(spark):
    token = "".join(random.Random(2).choices("abcdefgh", k=1_000_000))
    needles = [token[i:i + 9] for i in range(0, 999_000, 111_000)] + ["zzz", "hgfedcba" * 3]
    found = substrings.contains_pairs(spark.createDataFrame([(token,), ("abc",)], "value string"),
                                      spark.createDataFrame([(n,) for n in needles], "needle string")).collect()
    assert sorted(r["needle"] for r in found) == sorted(n for n in set(needles) if n in token)
    assert all(r["value"] == token for r in found)


def random_corpus(seed, rows=600):
    """Words of very different frequency; a third of all rows repeat one text; some rows repeat a question's words."""
    rng = random.Random(seed)
    words = [f"w{i:03d}" for i in range(300)]

    def text(n):
        return " ".join(words[min(int(rng.expovariate(1) * 40), 299)] for _ in range(n))

    asked = [text(rng.randint(1, 25)) for _ in range(25)]
    same = text(30)
    corpus = []
    for i in range(rows):
        body = same if i % 3 == 0 else " ".join(rng.sample(rng.choice(asked).split(), 1)) + " " + text(rng.randint(0, 40))
        if i % 50 == 7:
            body = asked[i % 25] + " " + text(5)
        corpus.append({"row_seq": i * 3 - 100, "title": rng.choice(words), "tags": None, "body_html": body, "product_type": rng.choice(["Shoes", "Hats", "hat racks", None]),
                       "vendor": rng.choice(["w001", "W002 w003", "x"])})
    questions = [(i, t, [None, "hat", "shoes", "none of these", None][i % 5]) for i, t in enumerate(asked)]
    return corpus, questions + [(100, "of the", None), (101, "in the", "hat"), (102, "w0", None), (103, "w001 w001 w001 w002", "shoe")]


@pytest.mark.parametrize("seed, n, seeds", [(1, 5, 1024), (3, 7, 20)])
def test_pruned_retrieval_equals_brute_force(spark, monkeypatch, seed, n, seeds):
    monkeypatch.setattr(RT, "SEED_POSTINGS", seeds)
    corpus, questions = random_corpus(seed)
    c = spark.createDataFrame(corpus, "row_seq long, title string, tags string, body_html string, product_type string, vendor string").repartition(3)
    qs = spark.createDataFrame(questions, "qid long, question string, category string")
    assert sorted(tuple(r) for r in RT.retrieve(c, qs, n=n).collect()) == brute(corpus, questions, n=n)


def test_few_rows_are_scored(spark):
    """Of the rows that share a word with a question, only a small part gets a score, and those scores are exact."""
    rng = random.Random(9)
    words = [f"w{i:03d}" for i in range(400)]
    corpus = [(i, " ".join(rng.choices(words, k=40))) for i in range(3000)]
    questions = [(q, " ".join(rng.sample(words, 20))) for q in range(10)]
    corpus += [(5000 + 10 * q + j, " ".join(rng.sample(t.split(), 17))) for q, t in questions for j in range(6)]
    c = spark.createDataFrame(corpus, "key long, body_html string")
    w = spark.createDataFrame([(q, x) for q, t in questions for x in t.split()], "qid long, word string")
    w = w.select("qid", F.lit(None).cast("string").alias("cat"), "word", F.lit(1).cast("long").alias("mult"))
    tokens = RT._tokens(c, "key", F.lit(""), ["body_html"])
    scored = {(r["qid"], r["key"]): r["score"] for r in RT.scored_rows(w, RT.postings(tokens, w), 5).collect()}
    every = {(q, k): sum(x in t.split() for x in question.split()) for q, question in questions for k, t in corpus}
    assert all(scored[p] == every[p] for p in scored)
    assert len(scored) < 0.1 * sum(s > 0 for s in every.values())


def test_empty_corpus_and_no_questions(spark):
    schema = "row_seq long, title string, tags string, body_html string, product_type string, vendor string"
    c, none = spark.createDataFrame(CORPUS, schema), spark.createDataFrame([], schema)
    qs = spark.createDataFrame(QUESTIONS, "qid long, question string, category string")
    assert RT.retrieve(none, qs).count() == 0
    assert RT.retrieve(c, qs.limit(0)).count() == 0


def test_category_questions_are_every_fortieth_part(spark, tmp_path):
    """The query set of q_retrieve_by_category, in code and SQL: no smaller than it was first."""
    from catalytics.plans import retrieval_queries as RQ
    rows = [(k, f"red part {k}", "Brand#1", "SMALL TIN") for k in range(1, 2001)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_type string").write.parquet(f"{tmp_path}/part.parquet")
    got = sorted(r.qid for r in RQ.part_questions(spark, str(tmp_path)).collect())
    assert got == list(range(1, 2001, 40))
    assert "FROM part WHERE p_partkey % 40 = 1" in RQ.ORACLE["q_retrieve_by_category"]


def test_no_question_and_row_pair_is_written(spark, tmp_path, monkeypatch):
    """Words that every row has: what is written grows with rows plus questions, not with their product; ties go to the smaller key."""
    monkeypatch.setattr(RT, "CHUNK", 16)
    names = [f"{a}{b}" for a in "cdefghij" for b in ("ane", "olt", "ing", "ear", "late", "idget")]
    corpus = [(k, "common", f"{names[k % 48]} {names[k * 7 % 47]}", ["Big", "Bigger", "Small", None][k % 4]) for k in range(1200)]
    questions = [(q, f"common {names[q % 48]} {names[q * 5 % 47]} common", [None, "big", "small"][q % 3]) for q in range(150)]
    c = spark.createDataFrame(corpus, "row_seq long, vendor string, title string, product_type string")
    qs = spark.createDataFrame(questions, "qid long, question string, category string")
    written = []
    plain = RT.materialise

    def counted(df, name):
        out = plain(df, name)
        written.append((name, out.count()))
        return out

    monkeypatch.setattr(RT, "materialise", counted)
    got = sorted(tuple(r) for r in RT.retrieve(c, qs).collect())
    rows = [{"row_seq": k, "vendor": v, "title": t, "tags": None, "body_html": None, "product_type": p} for k, v, t, p in corpus]
    assert got == brute(rows, questions)
    assert max(n for _, n in written) < 8 * len(corpus) < len(corpus) * len(questions) / 10, written
