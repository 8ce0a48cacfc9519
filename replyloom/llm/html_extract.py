"""Main text of HTML pages by gradient-boosted trees over DOM nodes.

Each element gets features of its subtree (text length, link density, tag density), its own tag and attribute tokens,
those of its ancestors, its depth and its place among siblings. Boosted trees give the probability that the element belongs to the
main text. Decoding is hierarchical: on every path from the root an element is outside, then inside, then
cut out, and never comes back, so no choice contradicts that of an ancestor; the best such labelling is found by dynamic
programming over the tree.

The trees are trained on a bounded sample of the pages. Their labels come from elements whose meaning the
tag states (article, main, nav, footer ...). Copies of these pages with other tags and class names for the same
parts, and with further parts that do not belong to the text, teach the model layouts without such tags.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from dataclasses import dataclass
from itertools import cycle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from replyloom.llm.blocks import free_name

#: Pages learned from at most, and changed copies of each.
SAMPLE_PAGES, COPIES = 240, 3
TREES, DEPTH, BINS, RATE = 40, 4, 32, 0.2

#: Fixed values of HTML: elements without content, with raw content, and those that break lines.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: An open element of the first kind ends where one of the second begins.
ENDED_BY = {
    "p": BLOCKS - {"td", "th", "tr", "tbody", "thead", "tfoot", "body", "html"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"},
    "tr": {"tr", "tbody", "tfoot"}, "td": {"td", "th", "tr", "tbody", "tfoot"}, "th": {"td", "th", "tr", "tbody", "tfoot"}, "option": {"option"},
}
#: The same by the beginning element, and the elements that such an end does not reach through.
ENDS = {name: [k for k, v in ENDED_BY.items() if name in v] for name in frozenset().union(*ENDED_BY.values())}
HOLDERS = ("table", "ul", "ol", "dl", "div", "section", "article", "main", "body")
#: Words of tags and attributes whose meaning labels the learned pages.
MAIN_TAGS = ("article", "main")
OTHER_TAGS = (
    "nav", "aside", "footer", "form", "menu", "dialog", "button", "label", "input", "textarea", "select", "datalist", "template", "noscript", "head",
)
OTHER_WORDS = frozenset(
    "ad ads advert advertisement sponsor sponsored promo banner nav navbar navigation menu breadcrumb breadcrumbs footer sidebar aside "
    "widget related share sharing social comment comments reply replies discussion cookie cookies consent notice alert popup modal "
    "newsletter subscribe signup login form search pagination pager tags copyright legal masthead topbar header".split()
)
#: Other names for the main text in changed copies.
MAIN_NAMES = (
    "content", "main-content", "post", "post-body", "entry", "entry-content", "article-body", "article", "story", "text", "body-text", "page-content",
)

#: Every repeat is possessive, so a match takes linear time. A quote that never closes is met by the loose form.
_OTHER = r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>"
_NAME = r"<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*+)"
_TOKEN = re.compile(rf"{_OTHER}|{_NAME}(?P<attr>(?:[^'\">]++|\"[^\"]*+\"|'[^']*+')*+)>", re.S)
_LOOSE = re.compile(rf"{_OTHER}|{_NAME}(?P<attr>[^>]*+)>", re.S)
_ATTR = re.compile(r"\b(?:class|id|role|itemprop|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


@dataclass
class Page:
    """Elements of a page in document order, as parallel lists, and its text runs."""

    tag: list[str]
    words: list[tuple[str, ...]]
    parent: list[int]
    depth: list[int]
    #: (element, text, whether a block begins) for each run of text
    runs: list[tuple[int, str, bool]]


def parse(source: str) -> Page:
    """Elements and text runs, in time linear in the page; unclosed, crossed and stray tags are tolerated.

    A tag whose quotes never close ends at the next ``>``, and so does every tag after it; a tag without any ``>`` is text. The
    content of script, style, title and textarea is left out, to the end of the page where they are not closed.
    """
    page = Page(["#root"], [()], [-1], [0], [])
    stack = [0]
    names = ["#root"]
    open_at: dict[str, list[int]] = defaultdict(list)  # places of each name on the stack
    at, fresh = 0, True
    find_end: dict[str, re.Pattern] = {}
    last = source.rfind(">")
    token = _TOKEN

    def text(piece: str) -> None:
        nonlocal fresh
        if piece and not piece.isspace():
            page.runs.append((stack[-1], piece, fresh))
            fresh = False
        elif piece and page.runs and not fresh:
            page.runs.append((page.runs[-1][0], " ", False))

    def top(kinds) -> int:
        return max((open_at[k][-1] for k in kinds if open_at[k]), default=0)

    def cut(place: int) -> None:
        while len(names) > place:
            open_at[names.pop()].pop()
            stack.pop()

    pos = 0
    while True:
        begin = source.find("<", pos)
        if begin < 0 or begin > last and not source.startswith("<!--", begin):
            text(source[at:])
            return page
        m = token.match(source, begin)
        if m is None and token is _TOKEN and (m := _LOOSE.match(source, begin)):
            token = _LOOSE  # the quotes do not close up to the end of the page
        if m is None:
            pos = begin + 1
            continue
        text(source[at : m.start()])
        at = pos = m.end()
        name = m["tag"]
        if name is None:
            continue
        name = name.lower()
        if m["close"]:
            if name in BLOCKS:
                fresh = True
            if open_at[name]:
                cut(open_at[name][-1])
            continue
        if name in RAW:
            if not m["attr"].endswith("/"):
                end = find_end.get(name) or find_end.setdefault(name, re.compile(rf"</{name}\s*+>", re.I))
                hit = end.search(source, at)
                at = pos = hit.end() if hit else len(source)
            continue
        if name == "br" or name in VOID:
            fresh = fresh or name == "hr"
            text(" ")
            continue
        if name in BLOCKS:
            fresh = True
        for _ in range(4):  # a new cell ends a paragraph, a cell and so on
            place = top(ENDS[name]) if name in ENDS else 0
            if not place or place < top(HOLDERS):
                break
            cut(place)
        words = ()
        if m["attr"]:
            found = " ".join(a or b or c for a, b, c in _ATTR.findall(m["attr"]))
            words = tuple(w.lower() for w in _WORD.findall(found))
        page.tag.append(name)
        page.words.append(words)
        page.parent.append(stack[-1])
        page.depth.append(len(stack))
        open_at[name].append(len(names))
        stack.append(len(page.tag) - 1)
        names.append(name)


@dataclass
class Model:
    """Token evidence and boosted trees; small and of fixed size."""

    tags: dict[str, float]
    words: dict[str, float]
    edges: np.ndarray
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]]
    base: float


def _below(page: Page, own: np.ndarray) -> np.ndarray:
    """Sums of ``own`` (one row for each element) over subtrees."""
    out = own.copy()
    for i in range(len(page.tag) - 1, 0, -1):
        out[page.parent[i]] += out[i]
    return out


def features(page: Page, tags: dict[str, float], words: dict[str, float]) -> np.ndarray:
    """One row for each element."""
    n = len(page.tag)
    own = np.zeros((n, 6))  # characters, characters in links, words, sentence marks, elements, paragraphs
    tag_at = [tags.get(t, 0.0) for t in page.tag]
    word_sum, word_min = [0.0] * n, [0.0] * n
    up_tag_min, up_tag_max, up_word_min, up_word_max, linked = [0.0] * n, [0.0] * n, [0.0] * n, [0.0] * n, [False] * n
    order, count = [0] * n, [0] * n
    for i in range(1, n):
        values = [words[w] for w in page.words[i] if w in words]
        word_sum[i], word_min[i] = sum(values), min(values, default=0.0)
        p = page.parent[i]
        order[i] = count[p]
        count[p] += 1
        linked[i] = linked[p] or page.tag[i] == "a"
        up_tag_min[i], up_tag_max[i] = min(up_tag_min[p], tag_at[p]), max(up_tag_max[p], tag_at[p])
        up_word_min[i], up_word_max[i] = min(up_word_min[p], word_min[p]), max(up_word_max[p], word_sum[p])
    own[:, 4] = 1
    own[:, 5] = [t == "p" for t in page.tag]
    for i, t, _ in page.runs:
        k = len(t)
        own[i, 0] += k
        if linked[i]:
            own[i, 1] += k
        own[i, 2] += t.count(" ") + 1
        own[i, 3] += t.count(".") + t.count(",")
    total = _below(page, own)
    chars = total[:, 0]
    parent = np.maximum(np.array(page.parent), 0)
    before = np.cumsum(own[:, 0]) - own[:, 0]
    return np.column_stack([
        tag_at, word_sum, word_min, up_tag_min, up_tag_max, up_word_min, up_word_max,
        page.depth, order, np.array(count)[parent], np.log1p(chars), np.log1p(own[:, 0]),
        total[:, 1] / np.maximum(chars, 1), total[:, 4] / np.maximum(chars, 1) * 100, total[:, 3] / np.maximum(total[:, 2], 1),
        total[:, 5], before / max(chars[0], 1), chars / max(chars[0], 1), chars / np.maximum(chars[parent], 1),
    ])


def _stated(page: Page) -> np.ndarray | None:
    """1 for elements of the main text as the tags state it, or None if they do not."""
    mains = [i for i, t in enumerate(page.tag) if t in MAIN_TAGS]
    if not mains:
        return None
    y = np.zeros(len(page.tag), np.int8)
    out = np.zeros(len(y), bool)  # whatever lies under a part that is cut out is out as well
    for i in range(1, len(y)):
        p = page.parent[i]
        other = page.tag[i] in OTHER_TAGS or any(w in OTHER_WORDS for w in page.words[i])
        other = other or (page.tag[i] == "header" and y[p] == 0)
        out[i] = out[p] or other
        y[i] = not out[i] and (page.tag[i] in MAIN_TAGS or y[p] == 1)
    return y


def _changed(page: Page, y: np.ndarray, texts: list[str], rng: np.random.Generator, turn) -> tuple[Page, np.ndarray]:
    """A copy of a labelled page in another layout: other names for its parts, and further parts.

    ``turn`` gives the words of parts outside the main text one after the other, so that all are met.
    """
    copy = Page(list(page.tag), list(page.words), list(page.parent), list(page.depth), list(page.runs))
    label = y.copy()
    rename = rng.random() < 0.7
    for i in range(1, len(y)):
        p = page.parent[i]
        if page.tag[i] in MAIN_TAGS and rename:
            copy.tag[i] = str(rng.choice(["div", "section", "div", "td"]))
            copy.words[i] = tuple(str(rng.choice(MAIN_NAMES)).split("-")) if rng.random() < 0.8 else ()
        elif page.tag[i] in ("nav", "footer", "aside", "header", "form") and y[p] == 0 and rename:
            copy.words[i] = (page.tag[i],) if rng.random() < 0.5 else (next(turn),)
            copy.tag[i] = "div"

        elif y[i] and page.tag[i] == "p" and rng.random() < 0.3:
            copy.tag[i] = str(rng.choice(["h2", "h3", "li", "blockquote", "div", "pre", "section", "td"]))
    added: list[int] = []

    def add(tag: str, words: tuple[str, ...], parent: int, y: int) -> int:
        copy.tag.append(tag)
        copy.words.append(words)
        copy.parent.append(parent)
        copy.depth.append(copy.depth[parent] + 1)
        added.append(y)
        return len(copy.tag) - 1

    def text(short: float) -> str:
        found = texts[int(rng.integers(len(texts)))] if texts else "more"
        return " ".join(found.split()[: int(rng.integers(1, 12))]) if rng.random() < short else found

    def other_part(parent: int) -> None:
        tag = str(rng.choice(["div", "aside", "section", "ul", "form", "nav", "header", "footer"]))
        named = tag in ("div", "section", "ul") or rng.random() < 0.5
        top = add(tag, (next(turn),) if named else (), parent, 0)
        for _ in range(int(rng.integers(1, 6))):
            inner = {"ul": ["li"], "form": ["label", "button", "p", "legend"]}.get(tag, ["p", "div", "span", "h3"])
            at = add(str(rng.choice(inner)), (), top, 0)
            if rng.random() < 0.3:
                at = add("a", (), at, 0)
            copy.runs.append((at, text(0.5), True))

    def main_part(parent: int) -> None:
        tag = str(rng.choice(["ul", "ol", "div", "section", "blockquote", "table", "figure", "h2"]))
        top = add(tag, (), parent, 1)
        inner = {"ul": "li", "ol": "li", "table": "tr", "figure": "figcaption"}.get(tag, "p")
        for _ in range(1 if tag == "h2" else int(rng.integers(1, 5))):
            at = top if tag == "h2" else add(inner, (), top, 1)
            if inner == "tr":
                at = add("td", (), at, 1)
            if rng.random() < 0.2:
                at = add(str(rng.choice(["a", "em", "b", "span", "code"])), (), at, 1)
            copy.runs.append((at, text(0.5 if tag != "section" else 0.1), True))

    mains = [i for i in range(1, len(y)) if y[i] and not y[page.parent[i]]]
    body = next((i for i, t in enumerate(page.tag) if t == "body"), 0)
    for _ in range(int(rng.integers(1, 7))):
        other_part(body)
    for _ in range(int(rng.integers(0, 3))):
        if mains:
            other_part(mains[0])
    for _ in range(int(rng.integers(0, 4))):
        if mains:
            main_part(mains[0])
    if mains and body and rng.random() < 0.12:  # the text lies in the body without an element of its own
        copy.parent = [body if p == mains[0] else p for p in copy.parent]
        copy.tag[mains[0]], copy.words[mains[0]], label[mains[0]] = "div", (), 0
    return copy, np.concatenate([label, np.array(added, np.int8)])


def _ordered(page: Page, y: np.ndarray) -> tuple[Page, np.ndarray]:
    """Elements in document order again, after parts were added at the end."""
    below: list[list[int]] = [[] for _ in page.tag]
    for i in range(1, len(page.tag)):
        below[page.parent[i]].append(i)
    order, stack = [], [0]
    while stack:
        i = stack.pop()
        order.append(i)
        stack.extend(reversed(below[i]))
    place = {i: k for k, i in enumerate(order)}
    out = Page(
        [page.tag[i] for i in order], [page.words[i] for i in order], [place.get(page.parent[i], -1) for i in order],
        [page.depth[i] for i in order], sorted(((place[i], t, f) for i, t, f in page.runs), key=lambda r: r[0]),
    )
    return out, y[order]


def _evidence(pages: list[tuple[Page, np.ndarray]], of) -> dict[str, float]:
    """Log odds of tokens seen at least five times."""
    yes: dict[str, float] = {}
    no: dict[str, float] = {}
    for page, y in pages:
        for i in range(1, len(y)):
            for w in of(page, i):
                side = yes if y[i] else no
                side[w] = side.get(w, 0) + 1
    a, b = sum(yes.values()) + 2, sum(no.values()) + 2
    keys = [w for w in sorted({*yes, *no}) if yes.get(w, 0) + no.get(w, 0) >= 5]
    return {w: float(np.log((yes.get(w, 0) + 1) / a) - np.log((no.get(w, 0) + 1) / b)) for w in keys}


def _boost(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, list, float]:
    """Histogram gradient boosting with the logistic loss; trees of fixed depth as arrays."""
    edges = np.quantile(x, np.linspace(0, 1, BINS + 1)[1:-1], axis=0).T
    binned = np.stack([np.searchsorted(edges[j], x[:, j], "left") for j in range(x.shape[1])], axis=1)
    rate = np.clip((weight * y).sum() / max(weight.sum(), 1e-9), 1e-3, 1 - 1e-3)
    base = float(np.log(rate / (1 - rate)))
    f = np.full(len(y), base)
    trees = []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-f))
        g, h = weight * (y - p), weight * p * (1 - p)
        feature, cut = np.zeros(2**DEPTH, np.int64), np.full(2**DEPTH, BINS, np.int64)
        node = np.ones(len(y), np.int64)
        for level in range(DEPTH):
            width = 2**level
            best = np.full(2 * width, 1e-6)
            for j in range(x.shape[1]):
                key = node * BINS + binned[:, j]
                gs = np.cumsum(np.bincount(key, weights=g, minlength=2 * width * BINS).reshape(-1, BINS)[width : 2 * width], axis=1)
                hs = np.cumsum(np.bincount(key, weights=h, minlength=2 * width * BINS).reshape(-1, BINS)[width : 2 * width], axis=1)
                gt, ht = gs[:, -1:], hs[:, -1:]
                gain = gs**2 / (hs + 1) + (gt - gs) ** 2 / (ht - hs + 1) - gt**2 / (ht + 1)
                gain[(hs < 1e-3) | (ht - hs < 1e-3)] = 0
                at = gain.argmax(axis=1)
                for k in range(width):
                    if gain[k, at[k]] > best[width + k]:
                        best[width + k] = gain[k, at[k]]
                        feature[width + k], cut[width + k] = j, at[k]
            node = 2 * node + (binned[np.arange(len(y)), feature[node]] > cut[node])
        leaf = node - 2**DEPTH
        value = RATE * np.bincount(leaf, weights=g, minlength=2**DEPTH) / (np.bincount(leaf, weights=h, minlength=2**DEPTH) + 1)
        f = f + value[leaf]
        trees.append((feature, cut, value))
    return edges, trees, base


def fit(sources: list[str], copies: int = COPIES, seed: int = 7) -> Model:
    """A model from the given pages (few: they are all held at once)."""
    rng = np.random.default_rng(seed)
    pages: list[tuple[Page, np.ndarray]] = []
    known = [(p, y) for p in map(parse, sources) if (y := _stated(p)) is not None]
    texts = [t for p, y in known for i, t, _ in p.runs if len(t) > 20][:2000]
    turn = cycle(sorted(OTHER_WORDS))
    for page, y in known:
        pages.append((page, y))
        pages.extend(_ordered(*_changed(page, y, texts, rng, turn)) for _ in range(copies))
    tags = _evidence(pages, lambda p, i: (p.tag[i],))
    words = _evidence(pages, lambda p, i: p.words[i])
    if not pages:
        return Model(tags, words, np.zeros((19, BINS - 1)), [], 0.0)
    x = np.concatenate([features(p, tags, words) for p, _ in pages])
    y = np.concatenate([y for _, y in pages]).astype(np.float64)
    return Model(tags, words, *_boost(x, y, 1.0 + x[:, 11]))


def probabilities(model: Model, x: np.ndarray) -> np.ndarray:
    """Probability of the main text for each element; without any tree by the density of its text."""
    f = np.full(len(x), model.base)
    if not model.trees:
        links, marks, own = x[:, 12], x[:, 14], x[:, 11]
        f = own - 3.0 - 6.0 * links + 5.0 * marks
    if model.trees:
        binned = np.stack([np.searchsorted(model.edges[j], x[:, j], "left") for j in range(x.shape[1])], axis=1)
        row = np.arange(len(x))
        for feature, cut, value in model.trees:
            node = np.ones(len(x), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + (binned[row, feature[node]] > cut[node])
            f += value[node - 2**DEPTH]
    return 1 / (1 + np.exp(-f))


def decode(page: Page, p: np.ndarray) -> list[bool]:
    """Which elements are inside: the labelling (outside, inside, cut out) of largest likelihood."""
    n = len(page.tag)
    own = [0.5] * n
    for i, t, _ in page.runs:
        own[i] += len(t)
    log_in = np.log(np.clip(p, 1e-6, 1)) * own
    log_out = np.log(np.clip(1 - p, 1e-6, 1)) * own
    score_in, score_out, score_cut = log_in.tolist(), log_out.tolist(), log_out.tolist()
    for i in range(n - 1, 0, -1):
        k = page.parent[i]
        score_cut[k] += score_cut[i]
        score_in[k] += max(score_in[i], score_cut[i])
        score_out[k] += max(score_out[i], score_in[i])
    state = [0] * n  # 0 outside, 1 inside, 2 cut out
    state[0] = 1 if score_in[0] > score_out[0] else 0
    for i in range(1, n):
        above = state[page.parent[i]]
        if above == 2:
            state[i] = 2
        elif above == 1:
            state[i] = 1 if score_in[i] >= score_cut[i] else 2
        else:
            state[i] = 1 if score_in[i] > score_out[i] else 0
    return [s == 1 for s in state]


def main_text(page: Page, inside: list[bool]) -> str:
    """Blocks of the text inside, in page order, joined by an empty line."""
    blocks: list[list[str]] = []
    begun = True
    for i, t, fresh in page.runs:
        begun = begun or fresh
        if not inside[i]:
            continue
        if begun or not blocks:
            blocks.append([])
            begun = False
        blocks[-1].append(html.unescape(t) if "&" in t else t)
    joined = (" ".join("".join(b).split()) for b in blocks)
    return "\n\n".join(b for b in joined if b)


def fit_pages(pages: DataFrame, source: str = "html", page_id: str = "page_id", sample: int = SAMPLE_PAGES) -> Model:
    """Learn from at most ``sample`` of the pages that state their main part, chosen by a hash of their id.

    Without any such page the model has no trees and goes by the density of text alone.
    """
    stated = F.col(source).rlike(rf"(?i)<({'|'.join(MAIN_TAGS)})[\s>]")
    picked = pages.where(stated).select(
        F.xxhash64(F.col(page_id)).alias("_h"), F.xxhash64(source).alias("_t"), F.col(source).alias("_html")
    )
    return fit([r["_html"] for r in picked.orderBy("_h", "_t").limit(sample).collect()])


def extract(pages: DataFrame, model: Model, source: str = "html") -> DataFrame:
    """``pages`` with ``text`` and ``n_chars`` instead of the source (replaced if present).

    Null, empty and textless pages have an empty text. Every row is kept.
    """
    context = pages.sparkSession.sparkContext
    shared = context.broadcast((model.tags, model.words, model.edges, model.trees, model.base))
    kept = [c for c in pages.columns if c not in (source, "text", "n_chars")]

    def work(batches):
        model = Model(*shared.value)
        for batch in batches:
            texts: list[str] = []
            held: list[tuple[Page, np.ndarray]] = []

            def flush() -> None:
                if held:
                    p = probabilities(model, np.concatenate([x for _, x in held]))
                    at = 0
                    for page, x in held:
                        texts.append(main_text(page, decode(page, p[at : at + len(x)])))
                        at += len(x)
                    held.clear()

            size = 0
            for doc in batch.column(batch.num_columns - 1).to_pylist():
                page = parse(doc or "")
                held.append((page, features(page, model.tags, model.words)))
                size += len(page.tag)
                if size > 20_000:
                    flush()
                    size = 0
            flush()
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], [*kept, "text", "n_chars"]
            )

    schema = [f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema if f.name in kept]
    return pages.select(*kept, F.col(source).cast("string").alias(free_name(pages, "_html"))).mapInArrow(
        work, ", ".join([*schema, "text string", "n_chars long"])
    )
