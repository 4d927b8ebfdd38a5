"""Operators 4, 5, 9, 10 and the pipeline."""

import collections
import hashlib
import importlib
import re
import time
import zlib

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from catalytics.llm import fingerprints, html_text, mixing, near_dup, quality, registry, token_store
from catalytics.session import scratch_path
from conftest import SF_SMALL
from .conftest import frame, words
from .test_dedup import brute_classes
from .test_scoring import brute_decontaminate

LIBRARY = Tokenizer.from_file(public_tokenizers.path(token_store.TOKENIZER))


def ids_of(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids + [token_store.END]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_token_store_round_trip(spark, docs, rows, monkeypatch):
    path = scratch_path(spark, "test-tokens")
    token_store.write_tokens(docs, path)
    got = token_store.read_documents(spark, path, with_ids=True).orderBy("start").collect()
    want = collections.Counter((i, tuple(ids_of(t))) for i, t, *_ in rows)
    assert collections.Counter((r["doc_id"], tuple(r["ids"])) for r in got) == want
    at, order = 0, []
    for r in got:
        assert r["start"] == at and r["n_tokens"] == len(r["ids"]) and r["ids_crc32"] == crc(r["ids"])
        at += r["n_tokens"]
        order.append(-1 if r["doc_id"] is None else r["doc_id"])
    assert order == sorted(order)
    every = [x for r in got for x in r["ids"]]
    for start, count in ((0, 1), (5, 700), (at - 3, 3), (at // 2, 50), (0, at)):
        pieces = token_store.read_range(spark, path, start, count).orderBy("start").collect()
        assert [x for p in pieces for x in p["ids"]] == every[start:start + count]


def test_pieces_encode_like_whole_texts():
    rng = np.random.default_rng(2)
    parts = [*"abAZ09 ,.'<|>\n\t!%&", "é", "À", "×", "÷", "ß", "́", "Σ", "ς", "日", "\xa0", "<|endoftext|>", "'ll", "\x1c", " ", "“", "İ", "K", "​"]
    texts = ["".join(rng.choice(parts, rng.integers(0, 50))) for _ in range(1500)]
    raw = [t.encode() for t in texts]
    ids, counts = token_store.Encoder(token_store.TOKENIZER).run(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    ends = np.cumsum(counts)
    for t, n, e in zip(texts, counts, ends, strict=True):
        assert ids[e - n:e].tolist() == ids_of(t), repr(t)


def test_grammar_leaves_no_frequent_pair():
    rng = np.random.default_rng(4)
    ids = np.minimum(rng.zipf(1.3, 1_000_000) - 1, 40_000).astype(np.uint32)
    lengths = np.full(1000, 1000)
    symbols, per_doc, rules = token_store.repair(ids, lengths)
    assert len(rules) < token_store.MAX_RULES and (token_store.expand(symbols, rules) == ids).all()
    inside = np.ones(len(symbols) - 1, bool)
    inside[np.cumsum(per_doc)[:-1] - 1] = False
    codes = ((symbols[:-1].astype(np.int64) << 32) | symbols[1:])[inside]
    assert np.unique(codes, return_counts=True)[1].max() < token_store.MIN_COUNT


def test_grammar_round_trip_and_gain():
    rng = np.random.default_rng(3)
    ids = np.concatenate([np.tile(rng.integers(0, 50, 9), 300), rng.integers(0, 4, 5000), np.full(999, 7)]).astype(np.uint32)
    lengths = np.array([1, 2699, 5000, 998, 1])
    symbols, per_doc, rules = token_store.repair(ids, lengths, vocabulary=60, max_rules=500, min_count=4)
    assert (token_store.expand(symbols, rules, 60) == ids).all()
    assert len(symbols) + 2 * len(rules) < len(ids) / 2
    sizes = token_store.rule_lengths(rules, 60)
    assert [len(token_store.expand(np.array([60 + i], np.uint32), rules, 60)) for i in range(len(rules))] == sizes.tolist()
    ends = np.cumsum(per_doc)
    back = [len(token_store.expand(symbols[e - n:e], rules, 60)) for n, e in zip(per_doc, ends, strict=True)]
    assert back == lengths.tolist()  # rules never cross documents


def brute_targets(sizes, weights=mixing.WEIGHTS):
    """Shares by weight; what is above three times a source's size is shared anew."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), {}
    while True:
        rest = [s for s in names if s not in capped]
        free = total - sum(capped.values())
        share = {s: free * weight[s] / sum(weight[x] for x in rest) for s in rest}
        over = [s for s in rest if share[s] > 3 * sizes[s] + 1e-9]
        if not over:
            return {**capped, **share}
        capped.update({s: 3.0 * sizes[s] for s in over})


def test_mix_meets_targets(spark, docs, none, rows, monkeypatch):
    size = collections.Counter()
    for _, t, _, s in rows:
        size[s] += len(words(t))
    want = brute_targets(size)
    for block in (mixing.BLOCK, 3):  # small blocks: several levels of residuals
        monkeypatch.setattr(mixing, "BLOCK", block)
        got = mixing.mix(docs).collect()
        assert collections.Counter((r["doc_id"], r["size"]) for r in got) == collections.Counter((i, len(words(t))) for i, t, *_ in rows)
        taken, largest = collections.Counter(), collections.Counter()
        for r in got:
            assert abs(r["target"] - want[r["source"]]) < 1e-6 and r["source_size"] == size[r["source"]]
            assert r["taken"] == r["size"] * r["copies"] and 0 <= r["copies"] <= 3
            taken[r["source"]] += r["taken"]
            largest[r["source"]] = max(largest[r["source"]], r["size"])
        assert all(abs(taken[s] - want[s]) <= largest[s] for s in want)
    again = mixing.mix(frame(spark, rows[::-1]).repartition(7))
    assert collections.Counter(r[:6] for r in map(tuple, again.collect())) == collections.Counter(r[:6] for r in map(tuple, got))
    assert mixing.mix(none).count() == 0
    assert mixing.repeat_rows(docs, mixing.mix(docs)).columns == docs.columns


def test_repeated_rows_follow_the_mix(docs):
    mixed = mixing.mix(docs)
    want = collections.Counter()
    for r in mixed.collect():
        want[r["doc_id"]] += r["copies"]
    got = collections.Counter(r["doc_id"] for r in mixing.repeat_rows(docs, mixed).select("doc_id").collect())
    assert got == +want


def test_rounding_keeps_expectations():
    rng = np.random.default_rng(4)
    size, share = np.sort(rng.integers(1, 900, 40).astype(float))[::-1], rng.random(40)
    block, chain = np.zeros(40), np.zeros(40)
    for _ in range(3000):
        one = mixing.pivot_block(size, 0.3, rng.random(40))
        assert ((one > 0) & (one < 1)).sum() <= 1 and abs((one * size).sum() - 0.3 * size.sum()) < 1e-6
        two = mixing.pivot(size, share, rng.random(40))
        assert ((two > 0) & (two < 1)).sum() <= 1 and abs((two * size).sum() - (share * size).sum()) < 1e-4
        block, chain = block + one, chain + two
    assert np.abs(block / 3000 - 0.3).max() < 0.04 and np.abs(chain / 3000 - share).max() < 0.04


def pieces(text):
    return {p for p in re.split(fingerprints.PIECE, text or "") if p}


def likeness(a, b):
    return 1.0 if not a | b else len(a & b) / len(a | b)


def brute_fingerprints(ordered):
    out = []
    for k, (i, t) in enumerate(ordered):
        t, after = t or "", ordered[(k + 1) % len(ordered)][1] or ""
        half = len(t) // 2
        edited = t[:len(t) - half] + after[:half]
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), round(likeness(pieces(t), pieces(edited)), 9),
                    round(likeness(pieces(t), pieces(after)), 9)))
    return collections.Counter(out)


def test_fingerprints_equal_brute_force(spark, rows):
    seen, unique = set(), []
    for i, t, lang, source in rows:  # one row per id: the order of equal ids is by hash
        if i not in seen:
            seen.add(i)
            unique.append((i, t, lang, source))
    ordered = sorted(((i, t) for i, t, *_ in unique), key=lambda r: -1 if r[0] is None else r[0], reverse=True)
    got = fingerprints.fingerprints(frame(spark, unique)).collect()
    assert collections.Counter((r["doc_id"], r["n_chars"], r["edited_sha256"], round(r["near_edited"], 9), round(r["near_next"], 9)) for r in got) == brute_fingerprints(ordered)
    by_text = collections.defaultdict(set)
    for r in got:
        by_text[frozenset(pieces(dict(ordered)[r["doc_id"]]))].add(r["fingerprint"])
    assert all(len(x) == 1 for x in by_text.values()) and len(set.union(*by_text.values())) == len(by_text)


def test_fingerprints_of_equal_ids_and_single_rows(spark, docs, none, rows):
    assert fingerprints.fingerprints(docs).count() == len(rows)
    assert fingerprints.fingerprints(none).count() == 0
    (only,) = fingerprints.fingerprints(frame(spark, [(3, "abcd. efgh", None, None)])).collect()
    assert only["near_next"] == 1.0 and only["edited_sha256"] == hashlib.sha256(b"abcd.abcd.").hexdigest()


def test_fingerprint_plan_has_no_python(spark):
    plan = fingerprints.op9_iblt_fingerprints(spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


ARTICLE = """<!DOCTYPE html><html><head><title>T</title><style>p{a:b}</style></head><body class="no-sidebar"><header><h1>Site</h1></header>
<nav><ul><li><a href=/a>Home</a><li><a href=/b>News</a></ul></nav><div class="ad">Buy now, it is cheap!</div><main><article><header><h1>Head &amp; line</h1></header>
<p>First  paragraph,\n with <b>bold</b> text.<p>Second &lt;one&gt; &#233; &eacute;.<script>var x = "</p>";</script><aside>Side note.</aside>
<ul><li>a<li>b</ul><form><p>Name?</p></form></article><section class="comments"><p>Great article, thank you very much, really.</p></section></main>
<div id="cookie-notice">Cookies, cookies.</div><footer>&copy; x</footer></body></html>"""


def test_main_text_of_articles():
    assert html_text.main_text(ARTICLE) == "Head & line\nFirst paragraph, with bold text.\nSecond <one> é é.\na\nb"


def test_main_text_without_article():
    body = "".join(f"<p>Paragraph {i} has a good number of words, and marks too.</p>" for i in range(5))
    page = f"<body><div class=menu><a>x</a><a>y</a></div><div id=c>{body}<p>Short.</p></div><div>a</div><div>b</div></body>"
    assert html_text.main_text(page) == "\n".join([f"Paragraph {i} has a good number of words, and marks too." for i in range(5)] + ["Short."])


def test_main_text_of_unmarked_pages_is_whole():
    long = " ".join(["Some long sentence, with marks."] * 31)
    paragraph = "A short paragraph, which has about as many as eighty characters of text in all."
    menu = "<ul class=menu><li><a>Home</a><li><a>News</a></ul>"
    page = f"<body>{menu}<div><h1>Head</h1><p>{long}</p><p>{paragraph}</p><p>{paragraph}</p></div></body>"
    assert html_text.main_text(page) == "\n".join(["Head", long, paragraph, paragraph])
    page = f"<body>{menu}<div><div><p>{long}</p></div><div><p>{paragraph}</p></div></div></body>"
    assert html_text.main_text(page) == f"{long}\n{paragraph}"
    page = f"<body>{menu}<h1>Head</h1><p>{long}</p><h2>Next</h2><ul><li>a</li><li>b</li></ul><p>{paragraph}</p><p>{long}</p><h2>End</h2><p>So.</p></body>"
    assert html_text.main_text(page) == "\n".join(["Head", long, "Next", "a", "b", paragraph, long, "End", "So."])
    page = f"<body>{menu}<div><article><h2>One</h2><p>{long}</p></article><article><h2>Two</h2><p>Tiny.</p></article></div><div>x</div></body>"
    assert html_text.main_text(page) == f"One\n{long}\nTwo\nTiny."
    page = f"<body>{menu}<main><h1>Head</h1><article><p>{long}</p></article><article><p>{paragraph}</p></article></main></body>"
    assert html_text.main_text(page) == f"Head\n{long}\n{paragraph}"
    page = f"<table><tr><td><a>Home</a></td><td><h1>Head</h1><p>{long}</p><p>{paragraph}</p></td></tr></table>"
    assert html_text.main_text(page) == f"Head\n{long}\n{paragraph}"


def test_slug_names_do_not_remove_article_text():
    long = " ".join(["Some long sentence, with marks."] * 12)
    slugs = ["related-work", "legal-history", "search-results", "social-effects", "dialog", "commentary", "promoting-peace"]
    for open_page, close_page in (("<body><article>", "</article></body>"), ("<body><div>", "</div></body>"), ("<body>", "</body>")):
        for slug in slugs:
            page = f"{open_page}<h1>Head</h1><p>{long}</p><section id={slug}><h2 id='{slug}-2'>Next</h2><p id={slug}-3>{long}</p></section><h2 id={slug}-4>End</h2><p>{long}</p>{close_page}"
            assert html_text.main_text(page) == "\n".join(["Head", long, "Next", long, "End", long]), page
    page = f"<article><p>{long}</p><section id=legal-history><h2>Then</h2><p>Short.</p></section><div class=commentary><p>{long}</p></div></article>"
    assert html_text.main_text(page) == f"{long}\nThen\nShort.\n{long}"
    links = "<ul><li><a href=/a>One more story to read</a><li><a href=/b>Another story to read</a></ul>"
    for name in ("id=related-stories", "class='related-stories'", "class=comments-area", "id=comments", "class=ad", "id=cookie-notice", "class=share-links"):
        page = f"<article><p>{long}</p><div {name}><h3>Related</h3>{links}</div><p>{long}</p></article>"
        assert html_text.main_text(page) == f"{long}\n{long}"
    assert html_text.main_text(f"<body><p>{long}</p><div id=search-results><article><p>{long} Yes.</p></article></div></body>") == f"{long} Yes."
    assert html_text.main_text(f"<article><p>{long}</p><div class=comments-area><h3>Comments</h3><p>{long}</p></div></article>") == long


def test_only_hidden_elements_are_hidden():
    kept = ['style="overflow:hidden"', 'title="Hidden gems"', 'data-hidden="no"', "style='display:block'", 'aria-hidden="false"', 'data-note="display:none"']
    for attribute in kept:
        assert html_text.main_text(f"<article><h1>Head</h1><div {attribute}><p>All of this text, it stays.</p></div></article>") == "Head\nAll of this text, it stays."
    link = "<article><p>See <a href=/the-hidden-city.html>the city</a> and <a href='/hidden'>more</a>, today.</p></article>"
    assert html_text.main_text(link) == "See the city and more, today."
    for attribute in ["hidden", "hidden=''", "HIDDEN=until-found", 'aria-hidden="true"', 'style="color:red; display : none"', "style='visibility:hidden'"]:
        assert html_text.main_text(f"<article><h1>Head</h1><div {attribute}><p>None of this text, it goes.</p></div></article>") == "Head"


def test_main_text_of_odd_pages(spark):
    odd = [None, "", "plain &lt; text", "<p", "<script>x", "<!-- a", "</p></div>", "<div>" * 30000 + "deep, text." + "</div>" * 5, "<b>" * 5 + "x" + "</i>" * 5]
    want = ["", "", "plain < text", "<p", "", "", "", "deep, text.", "x"]
    pages = spark.createDataFrame([(i, f"u{i}", h, "t") for i, h in enumerate(odd)] + [(8, "u8", odd[8], "t"), (None, None, "y", "t")],
                                  "page_id long, url string, html string, text string")
    got = sorted(html_text.extract(pages).collect(), key=str)
    assert collections.Counter((r["page_id"], r["text"], r["n_chars"]) for r in got) == collections.Counter(
        [(i, w, len(w)) for i, w in enumerate(want)] + [(8, "x", 1), (None, "y", 1)])
    assert html_text.extract(pages.limit(0)).count() == 0


def test_main_text_leaves_unmarked_furniture_and_comments_out():
    long = " ".join(["Some long sentence, with marks."] * 12)
    menu = "<ul><li><a href=/>Home</a></li><li><a href=/n>News</a></li></ul>"
    assert html_text.main_text(f"<body>{menu}<h1>Head</h1><p>{long}</p><p>{long}</p><p>All rights reserved</p></body>") == f"Head\n{long}\n{long}"
    assert html_text.main_text(f"<body><div><p>{long}</p></div><div>Win a prize</div><div><p>{long}</p></div></body>") == f"{long}\n{long}"
    assert html_text.main_text(f"<article><p>{long}</p><p>All rights reserved.</p></article>") == f"{long}\nAll rights reserved."
    for extra in (f"<ol class=responses><li>{long}</ol>", f"<div class=responses><p>{long}</p></div>", "<div class=related-posts><p>Another story, here.</p></div>",
                  f"<h2>Comments</h2><ol class=thread><li>{long}</ol>", f"<h3>12 comments</h3><p>{long}</p>"):
        assert html_text.main_text(f"<main><h1>Head</h1><p>{long}</p>{extra}</main>") == f"Head\n{long}", extra
    assert html_text.main_text(f"<article><!--><p>{long}</p><!---><p>x</p><!-- <p>no</p> --!><p>y</p></article>") == f"{long}\nx\ny"


def test_main_text_comes_from_the_path_scores(spark, monkeypatch):
    pages = [r["html"] for r in spark.read.parquet(f"{SF_SMALL}/pages.parquet").collect()]
    want = [html_text.main_text(page) for page in pages]
    for names in ("article", "article|nav|footer"):
        bare = [re.sub(rf"<(/?)(?:{names})\b", r"<\1div", page) for page in pages]
        assert sum(html_text.main_text(page) == text for page, text in zip(bare, want)) >= 0.95 * len(pages)
    monkeypatch.setattr(html_text, "path_scores", lambda paths, *rest: (np.ones(len(paths)), np.ones(len(paths))))
    assert not any(html_text.main_text(page) == text for page, text in zip(pages, want))


def test_path_scores_by_hand():
    paths, lengths, marks = np.array([1, 2, 1, 3]), np.array([10.0, 4.0, 30.0, 6.0]), np.array([1.0, 0.0, 3.0, 6.0])
    own, smooth = html_text.path_scores(paths, lengths, marks, np.array([1.0, 1.0, 1.0, 0.0]), np.zeros(4, bool))
    assert np.allclose(own, [20 * 3 * 40 / 44, 4 * 4 / 44, 20 * 3 * 40 / 44, 0]) and smooth[3] == 0
    kernel = np.exp([-2.0, -0.5, 0, -0.5, -2.0])
    first = [own[0], own[0], own[0], own[1], own[2]]
    assert np.isclose(smooth[0], (kernel * first).sum() / kernel.sum())
    boosted, _ = html_text.path_scores(paths, lengths, marks, np.ones(4), np.array([True, False, True, False]))
    assert boosted[1] < own[1] and boosted[0] > boosted[3]


def test_broken_markup_takes_linear_time():
    for piece in ("<h1 class=ad x", "<p a='", "<!--", "<a b=\"'", "</script x", "<p a='\" >", "<script>", "<a"):
        start = time.perf_counter()
        html_text.main_text(piece * (1_000_000 // len(piece)))
        html_text.main_text(piece * (500_000 // len(piece)) + "<!--")
        assert time.perf_counter() - start < 10, piece


def test_main_text_query_equals_the_marked_articles(spark):
    import html as entities

    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{SF_SMALL}/pages.parquet").collect()}
    for r in html_text.op10_tag_path_text(spark, SF_SMALL).collect():
        page = pages[r["page_id"]]
        article = page[page.index("<article>") + 9:page.index("</article>")]
        parts = (re.sub(r"\s+", " ", entities.unescape(re.sub("<[^>]*>", "", x))).strip() for x in re.split("</?p>|</?h1>", article))
        assert r["text"] == "\n".join(x for x in parts if x)


def test_pipeline_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    marks, bench = (spark.read.parquet(f"{SF_SMALL}/{t}.parquet") for t in ("labels", "benchmark"))
    rows = {r["doc_id"]: (r["doc_id"], r["text"], r["lang"], r["source"]) for r in docs.collect()}
    good = {r["doc_id"] for r in quality.classify(docs, marks).where("predicted = 1").select("doc_id").collect()}
    left = [rows[i] for i in sorted(good)]
    left = [rows[i] for i in sorted({c for _, c, _ in brute_classes(left)})]
    items = [(r["item_id"], r["text"]) for r in bench.collect()]
    clean = {k[0] for k in brute_decontaminate(left, items) if not k[-1]}
    got = corpus_pipeline.run(spark, SF_SMALL).orderBy("start").collect()
    assert {r["doc_id"] for r in got} <= clean
    taken = collections.Counter(r["doc_id"] for r in got)
    size, words_taken = collections.Counter(), collections.Counter()
    for i in clean:
        size[rows[i][3]] += len(words(rows[i][1]))
        words_taken[rows[i][3]] += taken[i] * len(words(rows[i][1]))
    want = brute_targets(size)
    longest = max(len(words(rows[i][1])) for i in clean)
    assert max(taken.values()) <= 3 and all(abs(words_taken[s] - want[s]) <= longest for s in want)
    at = 0
    for r in got:
        ids = ids_of(rows[r["doc_id"]][1])
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(ids), crc(ids))
        at += len(ids)


def test_stages_return_the_columns_of_documents(spark, docs):
    import os
    import tempfile

    folder = tempfile.mkdtemp(prefix="stages-")
    spark.createDataFrame([(0, 1, 0), (7, 1, 0), (14, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(os.path.join(folder, "labels.parquet"))
    spark.createDataFrame([(1, "one two three")], "item_id long, text string").write.parquet(os.path.join(folder, "benchmark.parquet"))
    now = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = corpus_pipeline.landed(stage(spark, now, folder), "test-stage")
        assert now.columns == docs.columns
    assert corpus_pipeline.STAGES[-1][1](spark, now, folder).columns == ["doc_id", "start", "n_tokens", "ids_crc32"]


def test_stages_on_an_empty_table(spark, docs):
    now = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = corpus_pipeline.landed(stage(spark, now, SF_SMALL), "test-empty")
        assert now.columns == docs.columns and now.count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, now, SF_SMALL).count() == 0


def test_copies_of_one_quoting_text_are_spread_over_the_salts(spark):
    from catalytics.llm import decontaminate

    item = " ".join(f"w{i}" for i in range(30))
    copies = spark.range(400).select(F.col("id").alias("doc_id"), F.lit(f"before {item} after").alias("text"))
    found = decontaminate.decontaminate(copies, spark.createDataFrame([("a", item)], "item_id string, text string")).collect()
    assert len(found) == 400 and all(r["contaminated"] and r["n_hit"] == 30 and r["n_words"] == 32 for r in found)


def test_registry_has_one_query_per_operator():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in registry.queries()) == list(range(1, 14))
    assert set(registry.oracle_sql()) <= set(registry.queries())
    assert importlib.import_module("__spark_entry__").queries()["pipeline"] is corpus_pipeline.run
    assert near_dup.SIMILAR >= 0.8 and near_dup.SHINGLE == 5
