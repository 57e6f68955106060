"""The main body of web pages: boosted trees over DOM-node features, decoded down the tree so that no node contradicts its ancestors."""

from __future__ import annotations

import hashlib
import html as H
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from herdbook.llm.boosting import BoostedTrees
from herdbook.runtime import cut

#: The most pages that a model is trained on, chosen by a hash of their id.
SAMPLE_PAGES = 1_200
#: Pages whose nodes are scored together; bounds a worker's memory.
CHUNK = 256
#: A line's text is looked up in the statistics if it is on at least this share of all pages: a bounded number of texts.
SHARE = 0.0005
#: Slots that attribute tokens are hashed to.
SLOTS = 64
#: HTML's own names for the parts of a page, its containers, elements that only hold text, and those that hide it.
MAIN_TAGS, OTHER_TAGS = ("main", "article"), ("nav", "aside", "footer", "section", "header")
CONTAINERS = frozenset(("div", "ul", "ol", "table", "thead", "tbody", "tfoot", "tr", "form", "fieldset", "details", "dl", "figure", "blockquote", *MAIN_TAGS, *OTHER_TAGS))
LEAVES = frozenset(("p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "td", "th", "dt", "dd", "button", "option", "caption", "figcaption", "legend", "summary", "pre", "address"))
VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"))
HIDDEN = frozenset(("script", "style", "noscript", "template", "head", "title", "svg", "textarea", "select"))
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6", "strong", "b")

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][\w:-]*)((?:"[^"<>]*"|'[^'<>]*'|[^'"<>]|["'])*?)>|([^<]+)|<""", re.S)
_STEP = re.compile(r"\S\s*(?:>|»|›|→|::|\||/)\s+\S")
_TIME = re.compile(r"\d{1,2}[:.]\d{2}\D{1,5}\d{1,2}[:.]\d{2}")
_END = re.compile(r"[.?!…]+[\"”»')]*(?:\s|$)")


@dataclass
class Line:
    """A piece of text: all that one block element shows on one line of the source, and where it stands."""

    no: int
    tag: str
    attrs: str
    text: str
    linked: int
    depth: int
    parent: int
    norm: str = ""
    sentences: int = 0


@dataclass
class Box:
    """A container: its element, its parent among the containers, and the range of pieces in its subtree."""

    tag: str
    attrs: str
    parent: int
    depth: int
    opened: int = 0
    start: int = 0
    end: int = 0

    @property
    def lines(self) -> range:
        """The pieces of its subtree."""
        return range(self.start, self.end)


def parse(html: str) -> tuple[list[Line], list[Box]]:
    """The pieces of text of the body and the containers around them, in document order; box 0 is the body.

    A tree is built whatever the line breaks: a page on one line gives the same containers. Text elements that aren't closed
    end with their line, list items and cells with the next one; a closing tag closes what is open inside it, one that closes
    nothing is ignored. A container that opens and shows a single piece on one line is that piece's own element.
    """
    boxes = [Box("body", "", -1, 0)]
    stack: list[tuple[str, str, int, int]] = []  # tag, attributes, box or -1, number of pieces before it
    inside, lines, parts, owner = [0], [], [], []
    no, at, end, last = 0, 0, len(html), None

    def pop() -> str:
        tag, _, box, _ = stack.pop()
        if box >= 0:
            boxes[box].end = len(lines)
            inside.pop()
        return tag

    while at < end:
        m = _TOKEN.match(html, at)
        at = m.end()
        token, tag = m[0], (m[2] or "").lower()
        if tag and not m[1]:
            if tag in HIDDEN:
                if not m[3].endswith("/"):
                    close = re.compile(rf"</{tag}\s*>" + ("|(?=<body\\b)" if tag == "head" else ""), re.I).search(html, at)
                    stop = close.end() if close else end
                    no += html.count("\n", at, stop)
                    at = stop
            elif tag in CONTAINERS or tag in LEAVES:
                last = None
                while stack and stack[-1][0] not in CONTAINERS and (stack[-1][0] in ("p", tag) or tag in CONTAINERS and stack[-1][0] not in LEAVES):
                    pop()
                if tag in CONTAINERS:
                    boxes.append(Box(tag, m[3], inside[-1], len(inside), no, len(lines)))
                    inside.append(len(boxes) - 1)
                    stack.append((tag, m[3], len(boxes) - 1, len(lines)))
                else:
                    stack.append((tag, m[3], -1, len(lines)))
            elif tag not in VOID and tag not in ("html", "body") and not m[3].endswith("/"):
                stack.append((tag, m[3], -1, len(lines)))
            elif tag in ("br", "hr") and last is not None:
                parts[last].append(" ")
        elif tag:
            if any(x[0] == tag for x in stack):
                while pop() != tag:
                    pass
                if tag in CONTAINERS or tag in LEAVES:
                    last = None
        else:
            for k, chunk in enumerate([""] if token.startswith("<") and len(token) > 1 else token.split("\n")):
                if k:
                    no += 1
                    last = None
                    while stack and stack[-1][2] < 0 and len(lines) > stack[-1][3]:
                        pop()  # a text element ends with its line
                if chunk.strip():
                    if last is None:
                        opened = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][2] >= 0), -1) + 1
                        leaf = next((x for x in stack[opened:] if x[0] != "a"), ("", "", -1, 0))
                        last = len(lines)
                        lines.append(Line(no, leaf[0], leaf[1], "", 0, len(inside), inside[-1]))
                        parts.append([])
                    text = H.unescape(chunk)
                    parts[last].append(text)
                    if any(x[0] == "a" for x in stack):
                        lines[last].linked += len(text.strip())
                elif chunk and last is not None:
                    parts[last].append(" ")
            if token.startswith("<!--"):
                no += token.count("\n")
    while stack:
        pop()
    boxes[0].end = len(lines)
    for x, some in zip(lines, parts):
        x.text = re.sub(r"\s+", " ", "".join(some)).strip()
        x.linked = min(x.linked, len(x.text))
        x.sentences = len(_END.findall(x.text))
        x.norm = ("@" if 2 * x.linked > len(x.text) else "") + re.sub(r"\d+", "9", x.text.lower())  # a menu's link isn't the title it leads to
        if len(x.norm) > 100:
            x.norm = hashlib.md5(x.norm.encode("utf-8", "surrogatepass")).hexdigest()
    return _flat(lines, boxes)


def _flat(lines: list[Line], boxes: list[Box]) -> tuple[list[Line], list[Box]]:
    """Without containers that show a single piece on the line on which they open."""
    children = Counter(b.parent for b in boxes)
    for i in range(len(boxes) - 1, 0, -1):
        b = boxes[i]
        if not children[i] and b.end - b.start == 1 and lines[b.start].no == b.opened and b.tag not in MAIN_TAGS:
            x = lines[b.start]
            x.tag, x.attrs, x.parent, x.depth = x.tag or b.tag, f"{b.attrs} {x.attrs}", b.parent, b.depth
            children[b.parent] -= 1
            boxes[i] = None
    number = {}
    for i, b in enumerate(boxes):
        if b is not None:
            number[i] = len(number)
    for x in lines:
        x.parent = number[x.parent]
    kept = [b for b in boxes if b is not None]
    for b in kept:
        b.parent = number.get(b.parent, -1)
    return lines, kept


def _slots(attrs: str) -> list[int]:
    """The slots of the words of an element's class, id and role."""
    return [crc32(w.encode()) % SLOTS for w in re.split(r"[^a-z]+", " ".join(re.findall(r"(?:class|id|role)\s*=\s*[\"']?([^\"'>]*)", attrs.lower()))) if w]


def is_heading(line: Line) -> bool:
    """True for a heading element, or a short line without a full stop that isn't a link or entry."""
    return line.tag in HEADINGS or (line.sentences == 0 and not line.linked and line.tag in ("div", "p", "span", "") and len(line.text) < 80)


def _features(lines: list[Line], boxes: list[Box], stats: dict[str, tuple[float, float]], tags: bool) -> tuple[np.ndarray, np.ndarray]:
    """(one row a line, one row a box). stats: text -> (log share of pages, log odds of being main in marked pages)."""
    n = len(lines)
    lex = np.array([stats.get(x.norm, (-9.0, 0.0)) for x in lines]).reshape(n, 2)
    base = np.array([[len(x.text), np.log1p(len(x.text)), x.linked / max(1, len(x.text)), x.sentences, x.text[-1:] in ".?!", x.text.endswith(("...", "…")), bool(_TIME.search(x.text)), bool(_STEP.search(x.text)) and len(x.text) < 90,
                      "©" in x.text, sum(map(str.isdigit, x.text)) / max(1, len(x.text)), x.tag in HEADINGS, x.tag == "h1", x.tag == "li", x.tag == "p", x.tag == "td", x.tag == "span", x.tag == "button", x.tag == "small", is_heading(x), x.depth,
                      "active" in x.attrs, len(x.attrs)] for x in lines], float).reshape(n, -1)
    own = np.column_stack([base, lex])
    box_rows = []
    chars = np.concatenate([[0.0], np.cumsum(base[:, 0])]) if n else np.zeros(1)
    sizes = [float(chars[b.end] - chars[b.start]) for b in boxes]
    beside: dict[int, list[float]] = {}
    for b, size in zip(boxes, sizes):
        beside.setdefault(b.parent, []).append(size)
    for v in beside.values():
        v.sort()
    slots = np.zeros((len(boxes), SLOTS))
    for k, b in enumerate(boxes):
        slots[k, _slots(b.attrs)] = 1
        at = b.lines
        if at:
            f = own[b.start:b.end]
            size = f[:, 0].sum()
            stat = [len(at), np.log1p(size), size / len(at), (f[:, 2] * f[:, 0]).sum() / max(1, size), f[:, 3].sum(), f[:, 6].mean(), f[:, 5].mean(), f[:, 8].max(), f[:, 16].mean(), f[:, 14].sum(), f[:, 11].max(), f[:, 18].sum(), f[:, 22].mean(), f[:, 23].mean(), f[:, 23].min(), f[:, 7].mean(), f[0, 18], f[0, 23], f[-1, 23]]
        else:
            stat = [0.0] * 19
        same, mine = beside[b.parent], sizes[k]
        named = [b.tag in MAIN_TAGS, b.tag in OTHER_TAGS] if tags else [0, 0]
        box_rows.append([*stat, b.depth, len(same), mine / max(1, same[-1]), len(same) - bisect_right(same, mine), at[0] / max(1, n) if at else 0, at[-1] / max(1, n) if at else 0, *named])
    box = np.column_stack([np.array(box_rows, float), slots])
    parent = np.array([x.parent for x in lines], int)
    pos = np.arange(n)
    inside = np.array([(i - boxes[x.parent].lines[0]) / max(1, len(boxes[x.parent].lines)) for i, x in enumerate(lines)])
    near = []
    for k in (-2, -1, 1, 2):  # the neighbours in the same container
        j = np.clip(pos + k, 0, max(0, n - 1))
        ok = (pos + k >= 0) & (pos + k < n)
        ok &= parent[j] == parent if n else ok
        near.append(np.where(ok[:, None], own[j][:, [1, 2, 3, 5, 6, 18, 23]], -1.0))
    first = np.array([i == boxes[x.parent].lines[0] for i, x in enumerate(lines)])
    heads = np.zeros((n, 2))  # how far the heading is under which the line stands, and what is known of its text
    for i, x in enumerate(lines):
        j = i
        while j > 0 and lines[j - 1].parent == x.parent and not is_heading(lines[j]):
            j -= 1
        heads[i] = min(20, i - j), lex[j, 1]
    return np.column_stack([own, box[parent], inside, first, *near, heads]) if n else np.zeros((0, 1)), box


def teach(lines: list[Line], boxes: list[Box], odds: dict[str, tuple[float, float]]) -> tuple[np.ndarray, np.ndarray] | None:
    """Labels (lines, boxes) of a page whose markup names its parts; None for others.

    Main are the lines of <main> or <article> but paths, sharing lines and inserted blocks: a run at the start (all before
    the title) or at the end that begins with a text known from other parts (opening hours, latest posts).
    """
    mains = [i for i, b in enumerate(boxes) if b.tag in MAIN_TAGS]
    if len(mains) != 1:
        return None
    at = boxes[mains[0]].lines
    known = lambda i: lines[i].tag != "h1" and (odds.get(lines[i].norm, (0, 0.0))[1] < 0 or bool(_TIME.search(lines[i].text)) or lines[i].text.endswith(("...", "…")) and lines[i].linked > 0)
    path = lambda i: bool(_STEP.search(lines[i].text)) and len(lines[i].text) < 90 and lines[i].sentences == 0 and not lines[i].linked
    keep = [i for i in at if not path(i)]
    start = 0
    if keep and not (is_heading(lines[keep[0]]) and not known(keep[0])):
        while start < len(keep) and not (is_heading(lines[keep[start]]) and not known(keep[start])):
            start += 1
        start = 0 if start == len(keep) else start
    body = keep[start:]
    end = len(body)
    while end > 1 and (known(body[end - 1]) or (lines[body[end - 1]].sentences > 0 and not lines[body[end - 1]].linked)):
        end -= 1
    stop = next((k for k in range(end, len(body)) if known(body[k]) and is_heading(lines[body[k]]) and len(body) - k > 1), len(body))
    label = np.zeros(len(lines))
    label[[i for i in body[:stop] if not known(i)]] = 1
    inside = np.zeros(len(boxes))
    inside[mains[0]] = 1
    return label, inside


def decode(lines: list[Line], boxes: list[Box], line_odds: np.ndarray, box_odds: np.ndarray, leave: float = 2.0) -> list[int]:
    """Indices of the main body's pieces: the likeliest choice of which no node contradicts its ancestors, by a dynamic
    programme over the tree.

    The body hangs from one container and is one stretch of what stands directly in it, pieces and inner containers; nothing
    is main before, behind or outside of it. Within it a piece, or an inner container with all below it, may be left out at a
    cost; of an inner container that stays, each part again may stay or be left out.
    """
    inner: list[list[tuple[int, int]]] = [[] for _ in boxes]  # what stands directly in a container: (first piece, node); boxes are below 0
    for i, x in enumerate(lines):
        inner[x.parent].append((i, i))
    for b in range(1, len(boxes)):
        inner[boxes[b].parent].append((boxes[b].start, -b))
    worth = [0.0] * len(boxes)  # of a container that stays, below it
    gain = lambda node: max(float(line_odds[node]) if node >= 0 else worth[-node], -leave)
    best, chosen = 0.0, []
    for b in range(len(boxes) - 1, -1, -1):  # inner containers come before those around them
        inner[b].sort(key=lambda t: (t[0], t[1] >= 0))
        nodes = [node for _, node in inner[b]]
        gains = [gain(node) for node in nodes]
        worth[b] = sum(gains)
        top, run, since, span = 0.0, 0.0, 0, (0, 0)
        for k, g in enumerate(gains):  # the stretch of the highest sum
            if run <= 0:
                run, since = 0.0, k
            run += g
            if run > top:
                top, span = run, (since, k + 1)
        total = top + 3 * float(box_odds[b])
        if top > 0 and (not chosen or total > best):
            best, chosen = total, nodes[slice(*span)]
    out, todo = [], list(chosen)
    while todo:
        node = todo.pop()
        if node >= 0:
            if line_odds[node] > 0:
                out.append(node)
        elif worth[-node] > -leave:
            todo += [x for _, x in inner[-node]]
    return sorted(out)


def _page_lines(pages: DataFrame, page: str, site: str, html: str) -> DataFrame:
    return pages.select(F.col(page).alias("_p"), F.col(site).cast("string").alias("_s"), F.col(html).alias("_h")).where(F.col("_h").isNotNull() & F.col("_h").rlike(r"\S"))


def _statistics(pages: DataFrame) -> dict[str, tuple[float, float]]:
    """Text -> (log share of pages, log odds main to other in marked pages), over all pages; texts on SHARE of them or more."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            counts: Counter = Counter()
            for h in b["_h"]:
                lines, boxes = parse(h)
                marked = any(x.tag in MAIN_TAGS for x in boxes)
                for t, where in {(x.norm, boxes[x.parent].tag) for x in lines}:
                    counts["t", t, "main" if where in MAIN_TAGS else "other" if marked else ""] += 1
                counts["n", "", ""] += 1
            yield pd.DataFrame([(*k, n) for k, n in counts.items()], columns=["kind", "text", "where", "n"])

    counts = pages.select("_h").mapInPandas(run, "kind string, text string, where string, n bigint").groupBy("kind", "text").agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("where") == "main", F.col("n")).otherwise(0)).alias("main"), F.sum(F.when(F.col("where") == "other", F.col("n")).otherwise(0)).alias("other"))
    counts = cut(counts)
    total = counts.where("kind = 'n'").agg(F.sum("n")).first()[0] or 1
    rows = counts.where((F.col("kind") == "t") & (F.col("n") >= SHARE * total)).collect()
    return {r["text"]: (float(np.log(r["n"] / total)), float(np.log((r["main"] + 0.3) / (r["other"] + 0.3))) if r["main"] + r["other"] else 0.0) for r in rows}


def _train(sample: list[str], stats: dict[str, tuple[float, float]]) -> tuple[BoostedTrees, BoostedTrees] | None:
    """(lines' model, boxes' model). Each page is shown twice, with and without the names of its parts."""
    xs, ys, bx, by = [], [], [], []
    for h in sample:
        lines, boxes = parse(h)
        taught = teach(lines, boxes, stats)
        if taught is None or not lines:
            continue
        for tags in (True, False):
            x, box = _features(lines, boxes, stats, tags)
            xs.append(x)
            ys.append(taught[0])
            bx.append(box[1:])
            by.append(taught[1][1:])
    if not xs:
        return None
    return BoostedTrees().fit(np.vstack(xs), np.concatenate(ys)), BoostedTrees(rounds=50, depth=3).fit(np.vstack(bx), np.concatenate(by))


def main_lines(pages: DataFrame, page: str, site: str, html: str, sample_pages: int = SAMPLE_PAGES) -> DataFrame:
    """(page, line_no, text): the lines of each page's own main body; lines are split at line feeds, the first is 0.

    Nodes (lines and containers) get features: text and subtree density, link share, attribute tokens, depth, place among
    siblings, the neighbours' looks, and how common the text is over all pages. Two models of boosted trees score lines and
    containers. They learn from pages whose markup names the parts (<main>, <nav>, ...), at most sample_pages of them; the
    names are hidden in half of the examples, so that pages of bare <div>s can be judged. Decoding (decode) picks the container
    and what stays in it, down the tree. Statistics cover all pages. A page is parsed once for them and once to be scored. Null and empty pages give no rows; a page
    of any length is read whole. If no page names its parts, there is nothing to learn from, and all pages give no rows.
    """
    pages = _page_lines(pages, page, site, html)
    stats = _statistics(pages)
    marked = pages.where(F.lower("_h").rlike(r"<(main|article)[\s>]"))
    sample = marked.orderBy(F.xxhash64("_p"), "_p").limit(sample_pages).select("_h").collect()  # the same pages on every run
    models = _train([r["_h"] for r in sample], stats)
    kind = dict(pages.dtypes)["_p"]
    if models is None:
        return pages.where("false").select(F.col("_p").alias(page), F.lit(0).alias("line_no"), F.lit("").alias("text"))
    shared = pages.sparkSession.sparkContext.broadcast((stats, [vars(m) for m in models]))  # plain data: workers need no copy of this package

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stats, states = shared.value
        line_model, box_model = map(BoostedTrees.of, states)
        for b, at in ((b, at) for b in batches for at in range(0, len(b), CHUNK)):
            parsed, xs, bx = [], [], []
            for p, h in zip(b["_p"][at:at + CHUNK], b["_h"][at:at + CHUNK]):
                lines, boxes = parse(h)
                if lines:
                    x, box = _features(lines, boxes, stats, True)
                    parsed.append((p, lines, boxes))
                    xs.append(x)
                    bx.append(box)
            rows = []
            if parsed:
                odds, box_odds = line_model.score(np.vstack(xs)), box_model.score(np.vstack(bx))
                i = j = 0
                for p, lines, boxes in parsed:
                    mine, his = odds[i:i + len(lines)], box_odds[j:j + len(boxes)]
                    i, j = i + len(lines), j + len(boxes)
                    shown: dict[int, list[str]] = {}
                    for k in decode(lines, boxes, mine, his):
                        shown.setdefault(lines[k].no, []).append(lines[k].text)
                    rows += [(p, no, " ".join(some)) for no, some in shown.items()]
            yield pd.DataFrame(rows, columns=[page, "line_no", "text"])

    return pages.select("_p", "_h").mapInPandas(run, f"{page} {kind}, line_no int, text string")
