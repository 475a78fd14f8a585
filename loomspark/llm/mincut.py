"""Main text of web pages by minimum-cut labelling of blocks.

A page is cut into blocks of text at block-level tags. A logistic classifier, trained here, gives
each block a score; scores become terminal capacities, and neighbouring blocks and blocks with a
common parent are joined by smoothness edges. The minimum cut (from a maximum flow) separates
content from boilerplate; content blocks in page order are the text.

Training labels are weak: blocks inside article or main count as content, blocks inside menus,
headers, footers, sidebars, forms and elements named for adverts, notices or comments as
boilerplate, others are left out. Half of the sample is shown without the structural features, so
that the words' own features have weights too. Equal rows of features weigh by the logarithm of their
number, so that a page of many like blocks does not outweigh all others. The sample is bounded (SAMPLE_PAGES).

Edge cases: a null or empty page has an empty text; broken markup is read as far as it goes (an
unclosed comment, script or style takes the rest; an unclosed tag is text); equal costs go to
content; repeated rows give equal results; extra columns are ignored.
"""

from __future__ import annotations

import bisect
import html
import re
from collections import Counter, deque
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SAMPLE_PAGES = 400
#: Capacities of the smoothness edges, and the largest terminal capacity.
NEIGHBOUR = 0.6
SIBLING = 0.8
CLIP = 8.0
EPS = 1e-9

#: Tags that end a block, tags whose content is no text, tags without content, and names of page parts.
BLOCK_TAGS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split())
SILENT_TAGS = frozenset("head script style noscript template title iframe canvas audio video select option textarea".split())
#: Elements that may close themselves.
FOREIGN_TAGS = frozenset(["svg", "math"])
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CONTENT_TAGS = frozenset(["article", "main"])
OTHER_TAGS = frozenset("nav header footer aside form menu dialog fieldset".split())
OTHER_NAMES = re.compile(r"(?:^|[-_ ])(?:nav|navbar|menu|header|footer|sidebar|side|aside|breadcrumbs?|cookies?|consent|notice|banner|popup|modal|overlay|ads?|adverts?|advertisement|advertising|sponsor(?:ed)?|promo(?:tion)?|comments?|replies|reply|disqus|respond|share|sharing|social|related|recommended|newsletter|subscribe|signup|login|search|toolbar|widget|pagination|pager|tags|copyright|legal|skip)(?=$|[-_ 0-9])", re.I)
CONTENT_NAMES = re.compile(r"(?:^|[-_ ])(?:article|post|entry|story|content|main|body|text)(?=$|[-_ 0-9])", re.I)

NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
#: What stands in a tag: quoted values, and anything but its end.
INSIDE = re.compile(r"(?:[^>\"']++|\"[^\"]*\"|'[^']*')*+")
QUOTE_OR_END = re.compile(r"[>\"']")
COMMENT_END = re.compile(r"--!?>")
RAW = {t: re.compile(rf"</{t}\s*>|\Z", re.I) for t in ("script", "style", "textarea", "title", "noscript", "template", "iframe")}
ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
#: Elements that a head may hold; any other one, or text, ends it.
HEAD_TAGS = frozenset("base link meta title style script noscript template head html".split())
#: Classes that describe the layout of what they stand on (has-sidebar, sidebar-right), rather than name a part of the page.
LAYOUT_NAMES = re.compile(r"(?:nav|navbar|menu|header|footer|sidebar|side|aside|banner|search|toolbar|widget)", re.I)
SPACE = re.compile(r"\s+")


class Block(NamedTuple):
    text: str
    tag: str
    parent: int
    depth: int
    linked: int
    inside: bool  # in an article or main element
    other: bool  # in an element of another part of the page
    named: bool  # in an element named as content


class _Open(NamedTuple):
    tag: str
    number: int
    inside: bool
    other: bool
    layout: bool  # below a layout class, and no article or main since
    named: bool
    silent: bool
    shown: int  # place of the innermost open element that is not silent


class Tags:
    """Finds the tags of a page one after the other, in time in proportion to the page, whatever is left open in it."""

    def __init__(self, page: str):
        self.page = page
        #: Places of quotes and ends, and where a tag that reaches them ends; made when a tag is found open.
        self.places: list[int] | None = None
        self.ends: list[int] = []
        self.no_end = self.no_section_end = False

    def end(self, at: int) -> int:
        """Where the tag ends whose inside begins here; -1 if it is left open."""
        if self.places is None:
            stop = INSIDE.match(self.page, at).end()
            if stop < len(self.page) and self.page[stop] == ">":
                return stop
            found = [(m.start(), m[0]) for m in QUOTE_OR_END.finditer(self.page, at)]
            self.places, self.ends = [x for x, _ in found], [-1] * (len(found) + 1)
            closing = {'"': -1, "'": -1}
            for k in range(len(found) - 1, -1, -1):
                where, kind = found[k]
                if kind == ">":
                    self.ends[k] = where
                else:
                    self.ends[k] = self.ends[closing[kind] + 1] if closing[kind] >= 0 else -1
                    closing[kind] = k
        return self.ends[bisect.bisect_left(self.places, at)]

    def next(self, at: int) -> tuple[int, int, str, str, str, str | None] | None:
        """Start, end, slash, name and inside of the next tag, and the text of a section; comments and declarations have no name."""
        page = self.page
        while (start := page.find("<", at)) >= 0:
            at = start + 1
            if page.startswith("<!--", start):
                m = COMMENT_END.search(page, start + 4)
                return start, m.end() if m else len(page), "", "", "", None
            if page.startswith("<![CDATA[", start) and not self.no_section_end:
                stop = page.find("]]>", start + 9)
                if stop >= 0:
                    return start, stop + 3, "", "", "", page[start + 9 : stop]
                self.no_section_end = True
            kind = page[at : at + 1]
            if kind in ("!", "?") and not self.no_end:
                stop = page.find(">", at)
                if stop >= 0:
                    return start, stop + 1, "", "", "", None
                self.no_end = True
            elif kind == "/" or (kind.isascii() and kind.isalpha()):
                stop = self.end(at)
                if stop >= 0 and (m := NAME.match(page, start, stop)):
                    return start, stop + 1, m[1], m[2].lower(), page[m.end() : stop], None
        return None


def _marks(label: str) -> tuple[bool, bool]:
    """Whether a label names another part of the page, and whether it has a layout class."""
    other = layout = False
    for token in label.split():
        if OTHER_NAMES.search(token):
            parts = {x for x in re.split(r"[-_]", token) if OTHER_NAMES.search(x)}
            soft = not OTHER_NAMES.fullmatch(token) and all(LAYOUT_NAMES.fullmatch(x) for x in parts)
            other, layout = other or not soft, layout or soft
    return other, layout


def blocks(page: str) -> list[Block]:
    """Blocks of visible text in page order."""
    out: list[Block] = []
    stack = [_Open("", 0, False, False, False, False, False, 0)]
    held: Counter[str] = Counter()  # how many elements of each tag are open
    words: list[str] = []
    links = opened = at = linked = 0
    tags = Tags(page)

    def close() -> None:
        nonlocal linked
        if words:
            text = SPACE.sub(" ", html.unescape("".join(words))).strip()
            # words are held only while they show; a silent element that is still open takes none of them back
            k = stack[-1].shown
            top = stack[k]
            if text:
                out.append(Block(text, top.tag, stack[k - 1].number if k else 0, k + 1, linked, top.inside, top.other or top.layout, top.named))
        words.clear()
        linked = 0

    def say(text: str) -> None:
        nonlocal linked
        if text and not stack[-1].silent:
            words.append(text)
            if links:
                linked += len(text)

    def leave() -> str:
        held[stack[-1].tag] -= 1
        return stack.pop().tag

    while at < len(page):
        tag = tags.next(at)
        until = tag[0] if tag else len(page)
        if stack[-1].tag == "head" and page[at:until].strip():
            leave()
        say(page[at:until])
        if not tag:
            break
        start, at, slash, name, inside, section = tag
        if not name:
            if section is not None:
                say(html.escape(section))
            continue
        if stack[-1].tag == "head" and not slash and name not in HEAD_TAGS:
            leave()
        if name == "a":
            links = 0 if slash else 1
        elif name == "br":
            say(" ")
        if name in RAW and not slash:
            if name in BLOCK_TAGS:
                close()
            at = RAW[name].search(page, at).end()
            continue
        silent = name in SILENT_TAGS
        if name not in BLOCK_TAGS and not silent:
            continue
        if name in BLOCK_TAGS:
            close()
        if slash:
            if held[name]:
                while leave() != name:
                    pass
            continue
        if name in VOID_TAGS or name in FOREIGN_TAGS and inside.endswith("/"):
            continue
        if stack[-1].tag == "p" and name in BLOCK_TAGS or stack[-1].tag == name and name in ("li", "dt", "dd", "tr", "td", "th", "option"):
            leave()
        opened += 1
        found: dict[str, str] = {}
        for a, b, c, d in ATTRIBUTE.findall(inside):
            found.setdefault(a.lower(), b or c or d)
        label = " ".join(found.get(k, "") for k in ("class", "id", "role"))
        top = stack[-1]
        main = name in CONTENT_TAGS or found.get("role") == "main"
        own, layout = _marks(label) if name not in ("html", "body") else (False, False)
        other = top.other or name in OTHER_TAGS and not (name == "header" and top.inside) or own
        named = top.named or bool(label and CONTENT_NAMES.search(label))
        hidden = top.silent or silent or "hidden" in found
        stack.append(_Open(name, opened, top.inside or main, other, layout or top.layout and not main, named, hidden, top.shown if hidden else len(stack)))
        held[name] += 1
    close()
    return out


# --- the classifier ---------------------------------------------------------------------------

FEATURES = 12
STRUCTURE = slice(1, 5)


def features(page: list[Block]) -> np.ndarray:
    out = np.zeros((len(page), FEATURES))
    for i, b in enumerate(page):
        n = len(b.text)
        words = b.text.count(" ") + 1
        out[i] = (1, b.inside, b.other, b.named, b.tag in ("nav", "footer", "li"), min(np.log1p(n), 8) / 4, min(b.linked / max(n, 1), 1), words < 5, words >= 20, b.text[-1] in ".!?:…\"»”", b.tag in ("p", "blockquote", "pre"), b.tag in ("h1", "h2", "h3", "h4", "h5", "h6"))
    return out


def fit(x: np.ndarray, y: np.ndarray, times: np.ndarray, steps: int = 400, ridge: float = 1e-3) -> np.ndarray:
    """Logistic regression by gradient ascent; each row counts so many times, and also without its structure."""
    bare = x.copy()
    bare[:, STRUCTURE] = 0
    x, y, times = np.concatenate([x, bare]), np.concatenate([y, y]), np.concatenate([times, times])
    times = times / times.sum()
    w, m, v = np.zeros(FEATURES), np.zeros(FEATURES), np.zeros(FEATURES)
    for k in range(1, steps + 1):
        slope = x.T @ (times * (y - 1 / (1 + np.exp(-np.clip(x @ w, -30, 30))))) - ridge * w
        m, v = 0.9 * m + 0.1 * slope, 0.99 * v + 0.01 * slope**2
        w = w + 0.1 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
    return w


#: Used where no page gives training labels: content if in an article, or if long and little linked.
PLAIN = np.array([-1.0, 4.0, -5.0, 1.0, -2.0, 0.5, -3.0, -1.0, 1.5, 1.0, 1.0, 0.5])


def train(pages: DataFrame, sample_pages: int = SAMPLE_PAGES) -> np.ndarray:
    """Weights from a bounded sample of pages, chosen by a hash of page_id; only features leave the tasks."""
    some = pages.select("page_id").filter("page_id is not null").distinct().orderBy(F.xxhash64("page_id"), "page_id").limit(sample_pages)
    found = pages.select("page_id", F.col("html").cast("string").alias("html")).join(F.broadcast(some), "page_id")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = [], []
            for page in batch.column("html").to_pylist():
                cut = blocks(page or "")
                keep = [b.inside or b.other for b in cut]
                x += features(cut)[np.array(keep, bool)].tolist() if cut else []
                y += [int(b.inside and not b.other) for b, k in zip(cut, keep, strict=True) if k]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), pa.array(y, pa.int32())], ["x", "y"])

    counted = found.select("html").mapInArrow(run, "x array<double>, y int").groupBy("x", "y").count().orderBy("x", "y").collect()
    if len({r.y for r in counted}) < 2:
        return PLAIN
    return fit(np.array([r.x for r in counted]), np.array([r.y for r in counted], float), 1 + np.log([float(r["count"]) for r in counted]))


# --- the cut ----------------------------------------------------------------------------------


def minimum_cut(gain: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes are content, so that the gains lost and the edges cut cost least.

    gain[i] > 0 is what node i costs as boilerplate, -gain[i] what it costs as content. Flow goes
    from nodes with a gain to those with a loss, in phases: a breadth-first search gives each node its
    distance, and all paths along growing distances are filled before the next one. A node from which
    a loss that is left over can still be reached is boilerplate, all others are content.
    """
    n, left = len(gain), list(gain)
    to: list[int] = []
    cap: list[float] = []
    out: list[list[int]] = [[] for _ in range(n)]
    for a, b, c in edges:  # each way is the other's way back
        for x, y in ((a, b), (b, a)):
            out[x].append(len(to))
            to.append(y)
            cap.append(c)
    while True:
        level = [0 if x > EPS else -1 for x in left]
        queue = deque(i for i in range(n) if not level[i])
        reached = False
        while queue:
            i = queue.popleft()
            for e in out[i]:
                j = to[e]
                if level[j] < 0 and cap[e] > EPS:
                    level[j] = level[i] + 1
                    reached = reached or left[j] < -EPS
                    queue.append(j)
        if not reached:
            break
        turn = [0] * n
        for source in range(n):
            path: list[int] = []  # edges from the source
            at = source
            while left[source] > EPS:
                if left[at] < -EPS and path:
                    flow = min(left[source], -left[at], *(cap[e] for e in path))
                    left[source] -= flow
                    left[at] += flow
                    keep = len(path)
                    for k, e in enumerate(path):
                        cap[e] -= flow
                        cap[e ^ 1] += flow
                        if cap[e] <= EPS and k < keep:
                            keep = k
                    if keep < len(path):
                        at = to[path[keep] ^ 1]
                        del path[keep:]
                elif turn[at] < len(out[at]):
                    e = out[at][turn[at]]
                    if cap[e] > EPS and level[to[e]] == level[at] + 1:
                        path.append(e)
                        at = to[e]
                    else:
                        turn[at] += 1
                elif path:
                    at = to[path.pop() ^ 1]
                    turn[at] += 1
                else:
                    break
    # boilerplate: nodes from which a node with a loss left over can still be reached
    lost = [left[i] < -EPS for i in range(n)]
    queue = deque(i for i in range(n) if lost[i])
    while queue:
        j = queue.popleft()
        for e in out[j]:
            if not lost[to[e]] and cap[e ^ 1] > EPS:
                lost[to[e]] = True
                queue.append(to[e])
    return [not x for x in lost]


def smoothness(page: list[Block]) -> list[tuple[int, int, float]]:
    """Edges between neighbours, stronger at equal depth, and between consecutive blocks of one parent."""
    edges, latest = [], {}
    for i, b in enumerate(page):
        if i:
            a = page[i - 1]
            edges.append((i - 1, i, NEIGHBOUR / (1 + abs(a.depth - b.depth) + (a.parent != b.parent))))
        if b.parent in latest:
            edges.append((latest[b.parent], i, SIBLING))
        latest[b.parent] = i
    return edges


def main_text(page: str, weights: np.ndarray) -> str:
    cut = blocks(page)
    if not cut:
        return ""
    gain = np.clip(features(cut) @ weights, -CLIP, CLIP).tolist()
    kept = minimum_cut(gain, smoothness(cut)) if min(gain) < 0 < max(gain) else [x >= 0 for x in gain]
    return "\n".join(b.text for b, k in zip(cut, kept, strict=True) if k)


def extract(pages: DataFrame, weights: np.ndarray) -> DataFrame:
    """page_id, url and the main text of every row of pages(page_id, url, html)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, 500):
                batch = whole.slice(first, 500)
                texts = [main_text(p or "", weights) for p in batch.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(run, "page_id long, url string, text string")


def op8_minimum_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return extract(pages, train(pages)).withColumn("n_chars", F.length("text").cast("long"))
