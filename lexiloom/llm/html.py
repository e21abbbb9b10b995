"""HTML extraction by gradient-boosted trees over DOM nodes.

Every element becomes a row of features: density of text, links and tags in its
subtree, what the tokens of its class and id say, depth, and what its siblings
are like. What a token says is learned: the log-odds of content among the labelled
elements that bear it. Boosted trees give each element's log-odds of being content. Decoding is
hierarchical: of all labellings in which no content lies below an element that
is not content, the one of the greatest total log-odds is found by dynamic
programming from the leaves up.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import trees
from .common import chunks, if_small, short_batches

#: Bounds of the labelled sample: pages, and characters of a page or of its text.
TRAIN_PAGES, TRAIN_CHARS = 300, 1 << 16
FOLDS = 4
NAME = re.compile(r"[a-zA-Z][\w:-]*")
QUOTE_OR_END = re.compile("[>\"']")
RAW = {t: re.compile(f"</{t}\\s*>", re.I) for t in ("script", "style", "template", "noscript")}
ATTRIBUTE = re.compile(r"(class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article aside blockquote body dd div dl dt fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section table tbody td tfoot th thead tr ul title".split())
#: Elements that an opening tag of a key closes if they are open.
CLOSES = {t: frozenset(["p"]) for t in BLOCKS - {"body", "html", "title", "td", "th", "tr", "tbody"}} | {"li": frozenset(["li", "p"]), "td": frozenset(["td", "th", "p"]), "th": frozenset(["td", "th", "p"]), "tr": frozenset(["tr", "td", "th", "p"]), "dt": frozenset(["dt", "dd", "p"]), "dd": frozenset(["dt", "dd", "p"]), "body": frozenset(["head"])}
SCOPES = frozenset("table ul ol div article section body html main nav aside footer header".split())
TAGS = ("p", "div", "li", "a", "b", "h1", "article", "nav", "footer", "ul", "span", "td", "section", "title", "head", "br")


@dataclass
class Node:
    tag: str
    parent: int
    depth: int
    tokens: frozenset = frozenset()
    children: list[int] = field(default_factory=list)
    #: Own text, and before which child it stands.
    texts: list[tuple[int, str]] = field(default_factory=list)


def pieces(page: str) -> Iterator[tuple[str, str, str]]:
    """("text" or "open" or "close", text or tag, what stands between the tag and its >) in the order of the page.

    Comments, declarations and the contents of scripts and the like are left out. In linear time: no character is
    looked at more than a few times, whatever quotes and brackets are left open.
    """
    last, at, text = page.rfind(">"), 0, 0
    hopeless: set[int] = set()  # quotes that open what never closes before a >

    def tag_end(k: int) -> int:
        seen = []
        while m := QUOTE_OR_END.search(page, k):
            if m.group() == ">":
                return m.start()
            seen.append(m.start())
            close = -1 if m.start() in hopeless else page.find(m.group(), m.end())
            if close < 0:
                break
            k = close + 1
        hopeless.update(seen)
        return page.find(">", start)  # quotes mean nothing then

    while (at := page.find("<", at)) >= 0:
        if page.startswith("<!--", at):
            start, end = at, page.find("-->", at + 4)
            end = len(page) if end < 0 else end + 3
            kind = ("", "", "")
        elif at > last:
            break  # no tag ends any more
        elif page[at + 1 : at + 2] in ("!", "?"):
            start, end = at, page.find(">", at) + 1
            kind = ("", "", "")
        elif page[at + 1 : at + 2] == "/" and (m := NAME.match(page, at + 2)):
            start, end = at, page.find(">", m.end()) + 1
            kind = ("close", m.group().lower(), "")
        elif m := NAME.match(page, at + 1):
            start = m.end()
            end = tag_end(start) + 1
            kind = ("open", m.group().lower(), page[start : end - 1])
            start = at
        else:
            at += 1
            continue
        if text < start:
            yield "text", page[text:start], ""
        if kind[0]:
            yield kind
        if kind[0] == "open" and kind[1] in RAW:
            m = RAW[kind[1]].search(page, end)
            end = m.end() if m else len(page)
        at = text = end
    if text < len(page):
        yield "text", page[text:], ""


def parse(page: str | None) -> list[Node]:
    """Elements in the order of their opening tags; the first is the document. Never fails: stray and unclosed tags are mended."""
    nodes = [Node("#", -1, 0)]
    open_: list[int] = [0]
    #: How many elements of each tag are open, in all and within the innermost scope.
    every: Counter = Counter()
    inner: list[Counter] = [Counter()]

    def pop() -> str:
        tag = nodes[open_.pop()].tag
        every[tag] -= 1
        if tag in SCOPES:
            inner.pop()
        else:
            inner[-1][tag] -= 1
        return tag

    for kind, what, rest in pieces(page or ""):
        if kind == "text":
            text = entities.unescape(what)
            if text.strip():
                x = nodes[open_[-1]]
                x.texts.append((len(x.children), text))
        elif kind == "close":
            if every[what] > 0:
                while pop() != what:
                    pass
        elif what in RAW:
            continue
        else:
            shut = CLOSES.get(what, ())
            left = sum(inner[-1][t] for t in shut)
            while left:
                left -= pop() in shut
            names = " ".join(a or b or c for _, a, b, c in ATTRIBUTE.findall(rest)).lower() if rest else ""
            nodes.append(Node(what, open_[-1], nodes[open_[-1]].depth + 1, frozenset(re.findall(r"[a-z]+", names)) if names else frozenset()))
            nodes[open_[-1]].children.append(len(nodes) - 1)
            if what not in VOID and not rest.endswith("/"):
                open_.append(len(nodes) - 1)
                every[what] += 1
                if what in SCOPES:
                    inner.append(Counter())
                else:
                    inner[-1][what] += 1
    return nodes


def token_counts(nodes: list[Node], y: np.ndarray) -> tuple[Counter, Counter]:
    """How many elements that are content, and others, bear each token; the tag counts as one."""
    yes, no = Counter(), Counter()
    for x, label in zip(nodes[1:], y[1:]):
        (yes if label else no).update({*x.tokens, f"<{x.tag}>"})
        (yes if label else no)[""] += 1
    return yes, no


def token_weights(yes: Counter, no: Counter) -> dict[str, float]:
    """Log-odds of content of each token's bearers over those of all elements, drawn to 0 where there are few."""
    base = np.log((yes[""] + 1) / (no[""] + 1))
    share = (yes[""] + 1) / (yes[""] + no[""] + 2)
    return {t: float(np.log((yes[t] + 4 * share) / (no[t] + 4 * (1 - share))) - base) for t in {*yes, *no} - {""}}


def features(nodes: list[Node], weights: dict[str, float]) -> np.ndarray:
    n = len(nodes)
    parent = np.array([x.parent for x in nodes])
    own = np.array([sum(len(t) for _, t in x.texts) for x in nodes], float)
    words = np.array([sum(t.count(" ") + 1 for _, t in x.texts) for x in nodes], float)
    stops = np.array([sum(t.count(". ") + t.count(", ") + t.count(".") for _, t in x.texts) for x in nodes], float)
    link = np.array([x.tag == "a" for x in nodes])
    text, linked, tags, marks, size = own.copy(), np.where(link, own, 0.0), np.ones(n), stops.copy(), words.copy()
    for k in range(n - 1, 0, -1):  # children come after their parents
        p = parent[k]
        text[p] += text[k]
        linked[p] += text[k] if link[k] else linked[k]
        tags[p] += tags[k]
        marks[p] += marks[k]
        size[p] += size[k]
    whole = max(text[0], 1.0)
    up = np.maximum(parent, 0)
    place, among, alike = np.zeros(n), np.ones(n), np.ones(n)
    best, worst, above, below = np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n)
    for k, x in enumerate(nodes):
        if k:
            told = [weights[t] for t in (*x.tokens, f"<{x.tag}>") if t in weights] or [0.0]
            best[k], worst[k] = max(told), min(told)
            above[k], below[k] = max(above[x.parent], best[x.parent]), min(below[x.parent], worst[x.parent])
        count: dict[str, int] = {}
        for c in x.children:
            count[nodes[c].tag] = count.get(nodes[c].tag, 0) + 1
        for j, c in enumerate(x.children):
            place[c], among[c], alike[c] = j / max(1, len(x.children) - 1), len(x.children), count[nodes[c].tag]
    before, after = np.zeros(n), np.zeros(n)
    for x in nodes:
        for a, b in zip(x.children, x.children[1:]):
            before[b], after[a] = text[a], text[b]
    one = np.array([[x.tag == t for t in TAGS] for x in nodes], float).reshape(n, len(TAGS))
    numbers = [np.log1p(own), np.log1p(text), text / whole, linked / np.maximum(text, 1), text / tags, marks / np.maximum(size, 1), np.log1p(size), np.array([x.depth for x in nodes], float), place, np.log1p(among), np.log1p(alike), np.log1p(before), np.log1p(after), text / np.maximum(text[up], 1), best, worst, above, below, np.array([len(x.children) for x in nodes], float), linked[up] / np.maximum(text[up], 1)]
    return np.concatenate([np.stack(numbers, axis=1), one], axis=1)


@dataclass(frozen=True)
class Extractor:
    trees: trees.Boosted
    weights: dict[str, float]

    def score(self, pages: list[list[Node]]) -> list[np.ndarray]:
        """Log-odds of each page's elements."""
        x = [features(n, self.weights) for n in pages]
        return np.split(self.trees.score(np.concatenate(x)), np.cumsum([len(f) for f in x])[:-1]) if x else []


def decode(nodes: list[Node], odds: np.ndarray) -> np.ndarray:
    """The consistent labelling of the greatest total log-odds: content needs content above it."""
    gain = odds.copy()
    gain[0] = max(0.0, gain[0])  # the document itself may always hold content
    for k in range(len(nodes) - 1, 0, -1):
        gain[nodes[k].parent] += max(0.0, gain[k])
    keep = np.zeros(len(nodes), bool)
    keep[0] = True
    for k in range(1, len(nodes)):
        keep[k] = keep[nodes[k].parent] and gain[k] > 0
    return keep


def render(nodes: list[Node], keep: np.ndarray) -> str:
    """Text of the kept elements: blocks and line breaks on lines of their own, white space joined."""
    out: list[str] = []
    stack: list[tuple[int, int, int]] = [(0, 0, 0)]
    while stack:
        k, step, told = stack.pop()
        x = nodes[k]
        if step == 0 and (x.tag in BLOCKS or x.tag == "br"):
            out.append("\n")
        while told < len(x.texts) and x.texts[told][0] <= step:
            if keep[k]:
                out.append(x.texts[told][1])
            told += 1
        if step < len(x.children):
            stack.append((k, step + 1, told))
            if keep[x.children[step]]:
                stack.append((x.children[step], 0, 0))
        elif x.tag in BLOCKS:
            out.append("\n")
    lines = (" ".join(line.split()) for line in "".join(out).replace("\r", "\n").split("\n"))
    return "\n".join(line for line in lines if line)


def teach(nodes: list[Node], truth: str) -> np.ndarray:
    """1 for elements whose own text occurs in ``truth`` or that hold such ones, else 0."""
    flat = " ".join(truth.split())
    y = np.zeros(len(nodes))
    for k in range(len(nodes) - 1, -1, -1):
        own = " ".join(" ".join(t for _, t in nodes[k].texts).split())
        if (own and own in flat and nodes[k].tag not in ("title", "a")) or y[k]:
            y[k] = 1
            if nodes[k].parent >= 0:
                y[nodes[k].parent] = 1
    for k, x in enumerate(nodes):
        if not x.texts and not x.children and k and y[x.parent]:
            y[k] = 1  # line breaks
    return y


def training_pairs(pages: DataFrame, docs: DataFrame, n: int = TRAIN_PAGES, max_chars: int = TRAIN_CHARS) -> list:
    """(html, text) of at most ``n`` pages, by a hash of their ids, whose URL's path ends in the id of a document.

    Pages or texts of more than ``max_chars`` characters aren't used, nor null ones or those without an id; of
    rows that share an id the least html, or text, is used.
    """
    number = F.regexp_extract("url", r"/([0-9]{1,18})(?:[.]html|/|$|[?#])", 1)
    few = pages.filter(F.length("html") <= max_chars).select(F.col("page_id").cast("long").alias("id"), number.alias("d")).filter("d <> '' and id is not null").distinct().orderBy(F.xxhash64("id"), "id", "d").limit(n)
    few = if_small(few.select("id", F.col("d").cast("long").alias("d")))
    with_page = few.join(pages.select(F.col("page_id").cast("long").alias("id"), "html").filter(F.length("html") <= max_chars), "id").groupBy("id", "d").agg(F.min("html").alias("html"))
    texts = docs.select(F.col("doc_id").cast("long").alias("d"), "text").filter(F.length("text") <= max_chars).join(few.select("d").distinct(), "d", "left_semi").groupBy("d").agg(F.min("text").alias("text"))
    return with_page.join(texts, "d").filter("html is not null and text is not null").orderBy("id", "d").select("html", "text").collect()


def fit(pairs: list) -> Extractor:
    """Trees and token weights. A training page's own features have the weights that other pages taught."""
    parsed = [(n, teach(n, t)) for n, t in ((parse(h), t) for h, t in pairs)]
    counted = [token_counts(n, y) for n, y in parsed]

    def weights(skip: int) -> dict[str, float]:
        used = [c for k, c in enumerate(counted) if k % FOLDS != skip]
        return token_weights(sum((c[0] for c in used), Counter()), sum((c[1] for c in used), Counter()))

    folds = [weights(k) for k in range(FOLDS)]
    x = [features(n, folds[k % FOLDS]) for k, (n, _) in enumerate(parsed)]
    y = [y for _, y in parsed]
    return Extractor(trees.fit(np.concatenate(x) if x else np.zeros((0, 1)), np.concatenate(y) if y else np.zeros(0)), weights(-1))


def extract(page: str | None, model: Extractor) -> tuple[str, int, int]:
    nodes = parse(page)
    keep = decode(nodes, model.score([nodes])[0])
    return render(nodes, keep), len(nodes) - 1, int(keep[1:].sum())


def extract_pages(pages: DataFrame, model: Extractor, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id, text, n_elements, n_kept) of each row.

    A null page has a null text and 0 elements, an empty one an empty text; one without tags, and text outside
    all elements, is content. Broken markup is mended, and takes no longer than other pages of its length. Ids
    may be null or repeat; they are cast to LONG. Pages are parsed whole and each by itself.
    """
    short_batches(pages.sparkSession)
    held = pages.sparkSession.sparkContext.broadcast(model)  # some 60 trees of depth 3, and the tokens of the sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for t in chunks(iter([whole]), 8 << 20):
                pages_ = t.column(1).to_pylist()
                parsed = [parse(p) for p in pages_]
                keeps = [decode(n, s) for n, s in zip(parsed, held.value.score(parsed))]
                texts = [None if p is None else render(n, k) for p, n, k in zip(pages_, parsed, keeps)]
                yield pa.RecordBatch.from_arrays([t.column(0).combine_chunks(), pa.array(texts, pa.string()), pa.array([len(n) - 1 for n in parsed], pa.int32()), pa.array([int(k[1:].sum()) for k in keeps], pa.int32())], names=["id", "text", "n_elements", "n_kept"])

    df = pages.select(F.col(id_col).cast("long").alias("id"), F.col(html_col).cast("string").alias("html"))
    return df.mapInArrow(run, "id long, text string, n_elements int, n_kept int").withColumnRenamed("id", id_col)
