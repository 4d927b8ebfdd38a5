"""Main text of web pages by tag-path ratios.

A page is read as a sequence of text nodes with their root-to-leaf tag paths. Per path the
lengths of its texts (link texts count a tenth), their punctuation and the number of its nodes are summed; text and
punctuation per node and the path's share of the page's text are fused to one score, times a prior from the path's names:
none for menus, footers, adverts and other furniture, and little for paths outside article and main elements if those inside have
most of the score. The scores are smoothed over the sequence of nodes and compared with their spread: nodes above it are content.
The main text is all text that scores at all in the innermost container (no paragraph, heading or list) around all content
nodes, or, if they all lie in article or main elements, in those. Link lists, notices and bare boxes beside the content, and what
follows a heading that announces reader comments, are left out.

Defined cases: null, empty and text-less pages give an empty text. Unclosed, misnested and
unknown tags are tolerated, nesting may be of any depth, an unclosed comment or script
ends with the page. Repeated pages give equal rows. Only page_id, url and html are read.
"""

from __future__ import annotations

import html
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import per_batch, read_table, small_batches

# fixed values: element names and name parts of the HTML standard and common page furniture
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title xmp iframe noembed noframes".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong "
             "sub sup time tt u var wbr img".split())
FURNITURE = set("nav footer aside form button select option textarea script style noscript template iframe svg canvas object "
                "dialog menu head title audio video map fieldset".split())
UNSEEN = set("script style noscript template iframe object head title textarea select option svg canvas audio video map".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
HOLDERS = set("ul ol dl table tbody thead tfoot select body article main section div td th blockquote".split())
# elements of a text rather than around one
LEAVES = INLINE | set("p h1 h2 h3 h4 h5 h6 hgroup li ul ol dl dt dd pre blockquote figure figcaption address caption tr thead tbody tfoot table".split())
PARTS = set("ad ads adslot adbox adsense adunit banner consent gdpr notice notices popup modal overlay subscribe subscription signup "
            "login widget widgets menu menus nav navbar navigation pagination pager footer disqus replies reply respond share sharing "
            "responses social related recommended recommendations toolbar search skip masthead topbar copyright disclaimer legal contentinfo "
            "complementary alert dialog".split())
STEMS = re.compile(r"(?:advert(?:s|ise|isements?|ising)?|breadcrumbs?|comment(?:s|list|box|form|area)?|cookie(?:s|bar|box|banner|notice|consent)?|"
                   r"newsletters?|promo(?:s|box|banner)?|sidebars?|sponsor(?:s|ed)?)\d*")
# words that are as often the topic of a section as the name of furniture, and words that add nothing to a name
TOPICS = set("advertising banner consent notice notices subscribe subscription login navigation replies reply respond share sharing social related "
             "recommended recommendations search copyright cookies disclaimer legal complementary alert dialog sponsors".split())
PLAIN = set("area bar block bottom box button buttons col column container content form group icon icons inner item items left link links "
            "list main outer page panel post posts primary right row secondary section site slot thread title top unit wrap wrapper".split())
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
TEXTS = HEADINGS | set("p li dt dd blockquote pre figcaption".split())

TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+)>")
UNQUOTED = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
OPENING = re.compile(r"<(?:[a-zA-Z!?]|/[a-zA-Z!?])")
COMMENT_END = re.compile(r"--!?>")
READERS = re.compile(r"\W*(?:\d+\s+)?(?:(?:reader|user|readers'?|all|recent)\s+)?(?:comments?|kommentare?|commentaires?|comentarios?)(?:\s+(?:section|from readers))?\W*(?:\(?\d+\)?)?\W*"
                     r"|(?:leave|post|add|write)\s+a\s+(?:reply|comment)\b.{0,20}", re.I)
RIGHTS = re.compile(r"(?:\u00a9|\(c\)\s|copyright\b).*|.*\ball rights reserved\b.*", re.I)
ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
HIDING = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*hidden)\b", re.I)
MARKS = re.compile(r"[^\w\s]")
WORD_SPLIT = re.compile(r"[^a-z0-9]+")
SPACE = re.compile(r"\s+")


def _judge(tag: str, key: str, name: str) -> int:
    """Whether a class, id or role names page furniture for sure (3), perhaps (2), a header (1) or nothing (0)."""
    parts = [p for p in WORD_SPLIT.split(name) if p]
    if name.startswith(("no-", "has-", "with-", "without-")) or (key == "id" and tag in TEXTS):  # an id there is an anchor
        return 0
    named = [p for p in parts if p in PARTS or STEMS.fullmatch(p)]
    if named:
        only = key != "id" and len(named) == len(parts)
        plain = all(p in named or p in PLAIN or p.isdigit() for p in parts)
        if only or (plain and (key == "class" or not TOPICS.issuperset(named))):
            return 3
        return 0 if tag in TEXTS else 2
    return int("header" in parts and tag not in HEADINGS and (key != "id" or PLAIN.issuperset(p for p in parts if p != "header")))


def _named(tag: str, attributes: str) -> tuple[str, int]:
    """Label part of an element's class, id and role, and what they name, as in ``_judge``."""
    label, furniture = "", 0
    for m in ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), (m[2] or "").strip("\"'")
        if key == "hidden" or (key == "aria-hidden" and value.strip().lower() == "true") or (key == "style" and HIDING.search(value)):
            furniture = 4  # hidden from readers
            continue
        for name in value.lower().split() if key in ("class", "id", "role") else ():
            found = _judge(tag, key, name)
            if key != "id" or (tag not in TEXTS and found != 2):  # an anchor does not set a path apart
                label += "." + name
            furniture = max(furniture, found)
    return label, furniture


class Page:
    """Text nodes of a page: text, tag path, block, element, whether furniture (1) or something unseen (2) holds it.

    Paths and elements are numbered; ``parents`` gives the element an element is in, ``doubtful`` whether
    its names may be those of furniture, ``in_article`` whether an article or main element is around it.
    """

    def __init__(self, source: str):
        self.texts: list[str] = []
        self.paths: list[int] = []
        self.blocks: list[int] = []
        self.holders: list[int] = []
        self.furniture: list[int] = []
        self.links: list[bool] = []
        self.headings: list[bool] = []
        self.parents, self.tags, self.doubtful, self.in_article = [-1], [""], [False], [False]
        numbers: dict = {}
        stack = [("", 0, 0, 0, False)]  # tag, path, element, in furniture, in an article
        open_tags: dict[str, int] = {}
        block, at, end, start = 0, 0, len(source), 0
        closed = source.rfind(">")  # no tag ends after it
        comment = source.find("<!--", closed + 1)  # one that never ends
        tags = TAG
        while at < end:
            m = OPENING.search(source, start, closed + 1) if start <= closed else None
            if not m and comment >= at:
                m = OPENING.match(source, comment)
            stop = m.start() if m else end
            found, after = None, end
            if m and source[stop + 1] in "!?" or m and source[stop + 1:stop + 3] in ("/!", "/?"):
                if source.startswith(("<!-->", "<!--->"), stop):
                    after = source.index(">", stop) + 1
                elif source.startswith("<!--", stop):
                    over = COMMENT_END.search(source, stop + 4)
                    after = over.end() if over else end
                else:
                    after = source.index(">", stop) + 1
            elif m:
                found = tags.match(source, stop)
                if not found:  # a quote that never ends: from here on quotes do not hide the end of a tag
                    tags = UNQUOTED
                    found = tags.match(source, stop)
                if not found:
                    start = stop + 1
                    continue
                after = found.end()
            if stop > at:
                raw = source[at:stop]
                tag, path, element, furniture, _ = stack[-1]
                self.texts.append(html.unescape(raw) if "&" in raw else raw)
                self.paths.append(path)
                self.blocks.append(block)
                self.holders.append(element)
                self.furniture.append(furniture)
                self.links.append(bool(open_tags.get("a")))
                self.headings.append(any(open_tags.get(h) for h in HEADINGS))
            if not m:
                break
            at = start = after
            if not found:
                continue
            m = found
            tag = m[2].lower()
            if tag == "br":
                if self.texts:
                    self._space(stack[-1], block)
                continue
            if tag not in INLINE:
                block += 1
            if m[1]:  # end tag
                if open_tags.get(tag):
                    while True:
                        name = stack.pop()[0]
                        open_tags[name] -= 1
                        if name == tag:
                            break
                continue
            if tag in VOID:
                continue
            closing = {"p"} if tag not in INLINE and open_tags.get("p") else set()
            closing = closing | CLOSES.get(tag, set())
            if closing:
                depth = len(stack) - 1
                while depth and stack[depth][0] not in closing and stack[depth][0] not in HOLDERS:
                    depth -= 1
                if depth and stack[depth][0] in closing:
                    for name, *_ in stack[depth:]:
                        open_tags[name] -= 1
                    del stack[depth:]
            _, path, element, furniture, article = stack[-1]
            label, named = _named(tag, m[3]) if m[3].strip() else ("", 0)
            article = article or tag in ("article", "main")
            named = 0 if tag in ("html", "body", "article", "main") and named < 4 else max(named, int(tag == "header"))
            # an article's own header holds its headline
            furniture = max(furniture, 2 * (tag in UNSEEN or named == 4), int(tag in FURNITURE or named == 3 or (named == 1 and not article)))
            number = numbers.setdefault((path, tag + label), len(numbers) + 1)
            self.parents.append(element)
            self.tags.append(tag)
            self.doubtful.append(named == 2)
            self.in_article.append(article)
            stack.append((tag, number, len(self.parents) - 1, furniture, article))
            open_tags[tag] = open_tags.get(tag, 0) + 1
            if tag in RAW:
                close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(source, at)
                at = start = close.start() if close else end
        self.size = len(self.texts)

    def _space(self, top, block):
        self.texts.append(" ")
        self.paths.append(top[1])
        self.blocks.append(block)
        self.holders.append(top[2])
        self.furniture.append(top[3])
        self.links.append(False)
        self.headings.append(False)


def path_scores(paths: np.ndarray, lengths: np.ndarray, marks: np.ndarray, priors: np.ndarray, marked: np.ndarray,
                width: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """Score of each node's path, and the scores smoothed over the sequence of nodes that have any.

    Text per node of the path, raised by its punctuation per node, times the path's share of the text, times
    the prior of its names (0 for furniture). If paths in article or main elements (``marked``) have
    at least half of all scored text, the others' prior is a hundredth.
    """
    _, at = np.unique(paths, return_inverse=True)
    nodes, text = np.bincount(at), np.bincount(at, lengths * priors)
    ratio = text / nodes * (1.0 + np.bincount(at, marks) / nodes) * (text / max(text.sum(), 1.0))
    own = ratio[at] * priors
    if 2 * (own * lengths)[marked].sum() >= (own * lengths).sum():
        own = own * np.where(marked, 1.0, 0.01)
    kernel = np.exp(-0.5 * np.arange(-width, width + 1) ** 2)
    smooth, some = np.zeros(len(own)), own > 0
    if some.any():
        smooth[some] = np.convolve(np.pad(own[some], width, mode="edge"), kernel / kernel.sum(), mode="valid")
    return own, smooth


def claims_rights(page: Page, i: int) -> bool:
    """Whether a text is a copyright line of a box outside articles (one in a paragraph may be the author's)."""
    e = page.holders[i]
    return page.tags[e] in ("div", "section", "center") and not page.in_article[e] and len(page.texts[i]) < 200 and bool(RIGHTS.fullmatch(page.texts[i].strip()))


def before_comments(page: Page) -> list[int]:
    """Per element the number of the first text node in it that reader comments begin with: what follows a heading that announces them."""
    limits = [page.size] * len(page.parents)
    for i in range(page.size):
        e = page.holders[i]
        if page.headings[i] and page.tags[e] in HEADINGS and READERS.fullmatch(page.texts[i].strip()[:80]):
            limits[page.parents[e]] = min(limits[page.parents[e]], i)
    for e in range(1, len(page.parents)):
        limits[e] = min(limits[e], limits[page.parents[e]])
    return limits


def beside(page: Page, good: list[int], lengths: np.ndarray, weights: np.ndarray) -> list[bool]:
    """Which elements outside articles are or are in a list of links or a bare box: no content, no heading, and
    four fifths of the text links, or text of its own in a div or section."""
    text, linked, content, headed = ([0.0] * len(page.parents) for _ in range(4))
    own = [False] * len(page.parents)
    for i, n, w in zip(good, lengths.tolist(), weights.tolist(), strict=True):
        e = page.holders[i]
        own[e] = True
        text[e] += n
        linked[e] += n * page.links[i]
        content[e] += w
        headed[e] += page.headings[i]
    for sums in (text, linked, content, headed):
        for e in range(len(page.parents) - 1, 0, -1):
            sums[page.parents[e]] += sums[e]
    out = [False] * len(page.parents)
    for e in range(1, len(page.parents)):
        bare = page.tags[e] in ("div", "section", "center") and own[e]
        links = page.tags[e] in ("ul", "ol", "div", "section", "table", "p") and 5 * linked[e] >= 4 * text[e] > 0
        # nothing but links, text of its own only next to content
        out[e] = out[page.parents[e]] or (not page.in_article[e] and not content[e] and not headed[e] and (links or bare))
    return out


def boilerplate(page: Page, good: list[int], lengths: np.ndarray, weights: np.ndarray) -> tuple[list[bool], list[bool]]:
    """Which elements are or are in a doubtful one that its own text tells to be furniture, and which outside articles are or are in any.

    It is furniture if half of its text is links; else in an article if less than half is content and
    it has no heading, elsewhere if either. One around an article is furniture by its links only.
    """
    text, linked, content, headed = ([0.0] * len(page.parents) for _ in range(4))
    for i, n, w in zip(good, lengths.tolist(), weights.tolist(), strict=True):
        e = page.holders[i]
        text[e] += n
        linked[e] += n * page.links[i]
        content[e] += w
        headed[e] += page.headings[i]
    around = [float(tag in ("article", "main")) for tag in page.tags]
    for sums in (text, linked, content, headed, around):
        for e in range(len(page.parents) - 1, 0, -1):
            sums[page.parents[e]] += sums[e]
    dropped, doubted = [False] * len(page.parents), [False] * len(page.parents)
    for e in range(1, len(page.parents)):
        dropped[e], doubted[e] = dropped[page.parents[e]], doubted[page.parents[e]]
        if page.doubtful[e]:
            signs = (2 * content[e] >= text[e], headed[e] > 0)
            outside = not page.in_article[e] and not around[e]
            dropped[e] |= 2 * linked[e] >= text[e] or (outside and not all(signs)) or (page.in_article[e] and not any(signs))
            doubted[e] |= outside
    return dropped, doubted


def main_elements(page: Page, holders: list[int], weights: list[float]) -> set[int]:
    """The elements whose text is the main one; ``holders`` are those of the text nodes, ``weights`` the content in each."""
    content, some = [0.0] * len(page.parents), [False] * len(page.parents)
    for e, w in zip(holders, weights, strict=True):
        content[e] += w
        some[e] = True
    direct = [w > 0 for w in content]
    for e in range(len(page.parents) - 1, 0, -1):  # parents have smaller numbers
        content[page.parents[e]] += content[e]
        some[page.parents[e]] |= some[e]
    marks: list[set[int]] = [set(), set()]  # outermost articles and main elements
    above = [False] * len(page.parents)
    for e in range(1, len(page.parents)):
        marked = page.tags[e] in ("article", "main")
        if marked and not above[page.parents[e]] and some[e]:
            marks[page.tags[e] == "main"].add(e)
        above[e] = marked or above[page.parents[e]]
    found = marks[0] | marks[1]
    if content[0] and sum(content[e] for e in found) == content[0]:  # all content is in them
        return marks[1] if max(found, key=lambda e: (content[e], -e)) in marks[1] else found
    common = max(e for e in range(len(page.parents)) if content[e] == content[0])  # the innermost around all
    while page.tags[common] in LEAVES or (page.tags[common] in ("td", "th") and direct[common]):
        common = page.parents[common]
    return {common}


def main_text(source: str | None) -> str:
    """Blocks of the main text of one page, joined by line breaks."""
    if not source:
        return ""
    page = Page(source)
    limits = before_comments(page)
    good = [i for i in range(page.size) if page.furniture[i] < 2 and i < limits[page.holders[i]] and page.texts[i] and not page.texts[i].isspace()]
    if not good:
        return ""
    sizes = np.array([len(page.texts[i]) for i in good], float)
    marks = np.array([len(MARKS.findall(page.texts[i])) for i in good], float)
    linked = np.array([page.links[i] for i in good])
    holders = [page.holders[i] for i in good]
    own, score = path_scores(np.array([page.paths[i] for i in good]), np.where(linked, 0.1, 1.0) * sizes, marks,
                             np.array([0.0 if page.furniture[i] or claims_rights(page, i) else 1.0 for i in good]), np.array([page.in_article[e] for e in holders]))
    if not own.any():
        return ""
    least = min(score[own > 0].std(), score.max())
    chosen = (score >= least) & (own >= least) & (own > 0)  # not for their neighbours alone
    if not chosen.any():
        chosen = (score >= least) & (own > 0)
    weights = np.where(chosen, sizes, 0.0)
    dropped = None
    if any(page.doubtful):
        dropped, doubted = boilerplate(page, good, sizes, weights)
        sure = np.array([not dropped[e] and not doubted[e] for e in holders])
        if weights[sure].any():
            weights = weights * sure
        else:  # no other content
            dropped = None
    main = main_elements(page, holders, weights.tolist())
    inside = [e in main for e in range(len(page.parents))]
    for element in range(1, len(page.parents)):
        inside[element] |= inside[page.parents[element]]
    bare = beside(page, good, sizes, weights)
    silent = {i for i, value in zip(good, own.tolist(), strict=True) if value <= 0}
    blocks: dict[int, list[str]] = {}
    for i in range(page.size):
        e = page.holders[i]
        if inside[e] and page.furniture[i] < 2 and i not in silent and i < limits[e] and not bare[e] and not (dropped and dropped[e]):
            blocks.setdefault(page.blocks[i], []).append(page.texts[i])
    lines = [line for line in (SPACE.sub(" ", "".join(parts)).strip() for parts in blocks.values()) if line]
    if all(page.tags[e] in ("", "html", "body") for e in main):  # no container holds the content only
        while len(lines) > 1 and len(lines[-1]) < 200 and RIGHTS.fullmatch(lines[-1]):
            lines.pop()
    return "\n".join(lines)


def _extract(batch: pa.RecordBatch):
    found = [main_text(source) for source in batch.column(2).to_pylist()]
    yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())],
                                     ["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of every page."""
    small_batches(pages.sparkSession)
    plain = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].cast("string").alias("url"), pages["html"].cast("string").alias("html"))
    return per_batch(_extract, "page_id long, url string, text string, n_chars long")(plain)


def op10_tag_path_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read_table(spark, sf_dir, "pages"))
