"""Main text of web pages: a bidirectional LSTM labels every block of a page in the light of all others.

A page's leaves (runs of text between block-level tags) form a sequence. Each leaf has a vector of its tag path (names,
classes, ids), of its hashed words and of a few measures of its text. The network reads the sequence both ways and labels
every leaf as article or not. It learns from a bounded sample of pages; their labels follow from telling markup (article,
nav, aside, class names, ...), and copies of the sample with other containers and inserted boilerplate, or without any
telling names, teach layouts that the sample lacks.

Rows: null or empty html gives an empty text; so does a page without main text. Rows that repeat are treated alike. No
pages to learn from: every text is empty. An empty table gives no rows. Broken markup is read as far as it goes: unclosed
paragraphs end at the next block, unknown end tags are ignored, an unclosed comment, script or style hides the rest of
the page. A quote begins a value only after an equals sign, and only if the value ends; where no bracket closes any more,
the rest is text. A head ends at its end tag or where text or a tag stands that no head holds. Of other elements that hold no text
of the page (svg, canvas, iframe, ...), one that closes itself or has no end tag hides nothing.
"""

from __future__ import annotations

import html
import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialise
from . import text as tx

# ---- leaves -----------------------------------------------------------------

#: Elements that do not end a run of text, that hold none, and that have no end tag.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
HIDDEN = frozenset("script style noscript template svg iframe object canvas textarea select head".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSED_BY_BLOCK = frozenset(("p",))
#: Of the hidden, those that reach to their first end tag whatever stands between, and those that hold each other.
RAW = frozenset("noscript iframe textarea title".split())
NESTED = frozenset("template svg object canvas select".split())
#: Tags that leave a head open, and end tags that close it.
IN_HEAD = frozenset("base basefont bgsound head link meta title".split())
ENDS_HEAD = frozenset("head body html br".split())
_NAME = re.compile(r"(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
#: What ends a tag, or begins a quoted value: a quote counts after an equals sign only.
_STOP = re.compile(r">|=[ \t\n\f\r]*([\"'])")
_ENDS = {name: re.compile(rf"</{name}\s*>", re.I) for name in (*RAW, "script", "style")}
_BARE_VALUE = re.compile(r"=\s*[^\s\"']+\Z")
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_WORD = re.compile(r"[a-z]+")


WHOLE = ("html", "body")  # whose names speak of the layout
DEEP = 32  # elements of a path from either end


class Leaf:
    __slots__ = ("path", "text", "linked")

    def __init__(self, path: tuple, text: str, linked: int):
        self.path, self.text, self.linked = path, text, linked


def _markup(page: str) -> Iterator[tuple[int, int, str, str, str]]:
    """(from, to, slash, name, rest) of all tags, and of comments and the like, without name, in one pass. Send the place
    from which to go on. Where no bracket closes any more there are no tags; a quoted value without end is none."""
    at, lost = 0, set()
    last = page.rfind(">")
    while (start := page.find("<", at)) >= 0:
        if page.startswith("<!--", start):
            end = page.find("-->", start + 4)
            at = (yield start, end + 3 if end >= 0 else len(page), "", "", "")
        elif page[start + 1 : start + 2] in ("!", "?"):
            end = page.find(">", start)
            at = (yield start, end + 1 if end >= 0 else len(page), "", "", "")
        elif m := _NAME.match(page, start + 1):
            end = m.end()
            while end <= last and (stop := _STOP.search(page, end)) and (quote := stop.group(1)):
                close = -1 if quote in lost else page.find(quote, stop.end())
                if close < 0:
                    lost.add(quote)  # nor is there one further on
                end = close + 1 if close >= 0 else stop.end()
            if end > last:
                at = start + 1
                if (start := page.find("<!--", at)) < 0:
                    return
                at = start
                continue
            end = stop.end()
            at = (yield start, end, m.group(1), m.group(2).lower(), page[m.end() : end - 1])
        else:
            at = start + 1


def _pieces(page: str) -> tuple[list[tuple], dict[int, int]]:
    """Everything that is no text, as (from, to, slash, name, rest of the tag; no name: nothing to look at), and where the
    hidden elements that have an end tag of their own end, by where they begin."""
    out: list[tuple] = []
    ends: dict[int, int] = {}
    opened: dict[str, list[int]] = {name: [] for name in NESTED}
    unclosed: set[str] = set()
    markup, at = _markup(page), None
    while True:
        try:
            start, at, slash, name, rest = markup.send(at)
        except StopIteration:
            return out, ends
        if name in ("script", "style") and not slash:
            end = _ENDS[name].search(page, at)
            at, name = end.end() if end else len(page), ""
        out.append((start, at, slash, name, rest))
        if name in NESTED:
            if slash and opened[name]:
                ends[opened[name].pop()] = at
            elif not slash and not _closes_itself(rest):
                opened[name].append(start)
        elif name in RAW and not slash and name not in unclosed and not _closes_itself(rest) and not (name == "title" and opened["svg"]):
            if end := _ENDS[name].search(page, at):
                ends[start] = end.end()
                at = end.start()  # what stands between is no markup
            else:
                unclosed.add(name)


def _closes_itself(rest: str) -> bool:
    return rest.endswith("/") and not _BARE_VALUE.search(rest)


def leaves(page: str | None) -> list[Leaf]:
    """Runs of text in page order, character references decoded, white space single. A path has one tuple per open
    block element: its name, then its class, id and role words with a dot in front; of more than 2 x ``DEEP`` elements the
    outermost and the innermost."""
    out: list[Leaf] = []
    stack: list[tuple] = []
    opened: Counter = Counter()
    parts: list[str] = []
    linked, in_link, in_head, at, page = 0, False, False, 0, page or ""

    def close():
        nonlocal linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                out.append(Leaf(tuple(stack if len(stack) <= 2 * DEEP else stack[:DEEP] + stack[-DEEP:]), text, linked))
            parts.clear()
        linked = 0

    pieces, ends = _pieces(page)
    for start, end, slash, name, rest in pieces:
        if start < at:
            continue
        if start > at:
            piece = page[at:start]
            in_head = in_head and not piece.strip()
            parts.append(piece)
            if in_link:
                linked += len(piece.strip())
        at = end
        if not name:
            continue
        if name == "head" and not slash:
            in_head = True
            continue
        if name in HIDDEN and name != "head" or name == "title" and in_head and not slash:
            at = ends.get(start, end)
            continue
        if in_head:
            in_head = name not in ENDS_HEAD if slash else name in IN_HEAD
            if in_head or name == "head":
                continue
        if name in INLINE:
            if name == "a":
                in_link = not slash
            elif name == "br":
                parts.append(" ")
            continue
        close()
        if slash:
            while opened[name]:
                opened[top := stack.pop()[0]] -= 1
                if top == name:
                    break
        else:
            if stack and stack[-1][0] in CLOSED_BY_BLOCK or stack and stack[-1][0] == name == "li":
                opened[stack.pop()[0]] -= 1
            if name not in VOID:
                opened[name] += 1
                words = {w for x in _NAMES.findall(rest) for w in _WORD.findall("".join(x).lower())} if "=" in rest and name not in WHOLE else ()
                stack.append((name, *("." + w for w in sorted(words))))
        in_link = False
    if at < len(page):
        parts.append(page[at:])
    close()
    return settled(out)


# ---- labels that telling markup gives ---------------------------------------

#: Names of elements and of classes that hold something else than the article, and that hold it.
OTHER = frozenset("nav footer aside form menu dialog button fieldset label title".split())
OTHER_NAMES = frozenset(
    ".ad .ads .advert .advertisement .alert .banner .breadcrumb .breadcrumbs .comment .comments .consent .cookie .cookies .copyright .disqus .footer .gdpr .login .menu .modal .nav .navbar .navigation .newsletter .notice .pagination .pager .popup .promo .promoted .recommended .related .replies .reply .respond .search .share .sharing .sidebar .signup .skip .social .sponsor .sponsored .subscribe .tags .toolbar .topbar .widget".split()
)
MAIN, MAIN_NAMES = frozenset(("article", "main")), frozenset((".article", ".content", ".entry", ".main", ".post", ".story"))
RUNNING = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dd dt td th figcaption".split())


def _tells(part: tuple) -> bool:
    return part[0] == "form" or part[0] not in OTHER and not OTHER_NAMES.isdisjoint(part[1:])


def settled(page: list[Leaf]) -> list[Leaf]:
    """The page with plain containers for forms and for classes of boilerplate around over nine tenths of its text: such
    names speak of the layout (a form around the page, a wrapper called after its sidebar)."""
    telling = {part for part in set().union(*(x.path for x in page)) if _tells(part)}
    if not telling:
        return page
    sizes: Counter = Counter()
    for x in page:
        for k, part in enumerate(x.path):
            if part in telling:
                sizes[x.path[: k + 1]] += len(x.text)
    most = 0.9 * sum(len(x.text) for x in page)
    wide = {p for p, n in sizes.items() if n > most}
    if not wide:
        return page
    return [Leaf(tuple(("div",) if x.path[: k + 1] in wide else part for k, part in enumerate(x.path)), x.text, x.linked) for x in page]


def told(leaf: Leaf, any_main: bool) -> bool:
    """Whether markup says that the leaf belongs to the article; ``any_main``: the page marks its article."""
    inside = False
    for name, *words in leaf.path:
        if name in OTHER or not OTHER_NAMES.isdisjoint(words) or name == "header" and not inside:
            return False
        inside = inside or name in MAIN or not MAIN_NAMES.isdisjoint(words)
    return inside or not any_main and bool(leaf.path) and leaf.path[-1][0] in RUNNING


def labels(page: list[Leaf]) -> np.ndarray:
    marked = any(name in MAIN or not MAIN_NAMES.isdisjoint(words) for x in page for name, *words in x.path)
    return np.array([told(x, marked) for x in page], bool)


_CONTAINERS = (
    (("main",),),
    (("main",), ("article", ".post")),
    (("div", ".content"),),
    (("div", ".article", ".body"),),
    (("div", ".post", ".text"),),
    (("div", ".wrapper"), ("div", ".main", ".story")),
    (("section", ".entry"),),
    (("article", ".entry"), ("section",)),
)
_INSERTS = (
    (("aside",), ("p",)),
    (("aside", ".sidebar"), ("ul",), ("li",)),
    (("div", ".sidebar"), ("div",)),
    (("div", ".sidebar", ".widget"), ("p",)),
    (("div", ".comments"), ("div", ".comment"), ("p",)),
    (("section", ".comments"), ("p",)),
    (("section", ".comments"), ("h2",)),
    (("ol", ".comment", ".list"), ("li", ".comment"), ("p",)),
    (("ul", ".comments"), ("li",)),
    (("div", ".comment"),),
    (("div", ".cookie", ".notice"),),
    (("div", ".cookie", ".banner"), ("p",)),
    (("div", ".alert", ".notice"), ("p",)),
    (("div", ".notice"),),
    (("div", ".ad"),),
    (("div", ".ad"), ("p",)),
    (("div", ".advert", ".promo"), ("p",)),
    (("div", ".banner"),),
    (("form",),),
    (("form",), ("label",)),
    (("form", ".newsletter", ".subscribe"), ("p",)),
    (("form", ".search"), ("button",)),
    (("div", ".newsletter"), ("h3",)),
    (("div", ".related"), ("ul",), ("li",)),
    (("div", ".share", ".social"),),
    (("header",), ("h1",)),
    (("header",), ("p",)),
    (("header", ".site"), ("div",)),
    (("div", ".header", ".menu"),),
    (("nav", ".breadcrumbs"), ("ul",), ("li",)),
    (("div", ".menu"), ("ul",), ("li",)),
    (("footer", ".site"), ("p",)),
    (("div", ".footer"), ("p",)),
)


def varied(page: list[Leaf], rng: np.random.Generator) -> list[Leaf]:
    """The page in another container, with boilerplate made of its own text at random places."""
    container = _CONTAINERS[rng.integers(len(_CONTAINERS))]
    out = [Leaf(tuple(y for x in leaf.path for y in (container if x[0] == "article" else (x,))), leaf.text, leaf.linked) for leaf in page]
    for _ in range(int(rng.integers(2, 8))):
        path, source = _INSERTS[rng.integers(len(_INSERTS))], page[rng.integers(len(page))]
        words = source.text.split()
        k, where = int(rng.integers(1, 5)), int(rng.integers(0, len(out) + 1))
        # Within the article or beside it, as the neighbour is.
        near = out[where - 1].path if where else (("html",), ("body",))
        base = tuple(x for x in near if x[0] in ("html", "body") or x in container and path[0][0] != "header" and "site" not in path[0])
        for j in range(k):
            some = words[: int(rng.integers(1, len(words) + 1))]
            out.insert(where + j, Leaf(base + path, " ".join(some), int(rng.integers(0, 2)) * len(source.text)))
    return out


def stripped(page: list[Leaf], rng: np.random.Generator) -> list[Leaf]:
    """The page without telling names: only text, links, headings, lists and neighbours are left to decide."""
    plain = MAIN | OTHER | {"section", "header"} - {"button", "label", "title"}
    if rng.random() < 0.5:
        plain = plain | {"p"}
    return [Leaf(tuple(("div" if x[0] in plain else x[0],) for x in leaf.path), leaf.text, leaf.linked) for leaf in page]


# ---- vectors ----------------------------------------------------------------

PATH, LAST, WORDS, MEASURES = 96, 48, 32, 8
WIDTH = PATH + LAST + WORDS + MEASURES
_paths: dict[tuple, np.ndarray] = {}


def _path_vector(path: tuple) -> np.ndarray:
    if path not in _paths:
        if len(_paths) > 50_000:
            _paths.clear()
        v = np.zeros(PATH + LAST, np.float32)
        for part in path:
            for word in part:
                v[zlib.crc32(word.encode()) % PATH] = 1
        for word in path[-1] if path else ():
            v[PATH + zlib.crc32(b"last " + word.encode()) % LAST] = 1
        _paths[path] = v
    return _paths[path]


def vectors(pages: list[list[Leaf]]) -> np.ndarray:
    """One row per leaf of all pages."""
    flat = [x for page in pages for x in page]
    out = np.zeros((len(flat), WIDTH), np.float32)
    if not flat:
        return out
    out[:, : PATH + LAST] = np.stack([_path_vector(x.path) for x in flat])
    texts = pa.array([x.text for x in flat], pa.large_string())
    words, at = tx.split_words(tx.translated(texts, tx.LOWER))
    codes, distinct = tx.coded(words)
    n = np.maximum(np.diff(at), 1)
    if len(words):
        h = tx.hashed(distinct)[codes]
        owner = np.repeat(np.arange(len(flat)), np.diff(at))
        sign = np.where(h >> np.uint64(63), 1.0, -1.0)
        counts = np.bincount(owner * WORDS + (h % np.uint64(WORDS)).astype(np.int64), weights=sign, minlength=len(flat) * WORDS)
        out[:, PATH + LAST : -MEASURES] = counts.reshape(len(flat), WORDS) / np.sqrt(n)[:, None] / 4
    size = pc.utf8_length(texts).to_numpy(zero_copy_only=False)
    commas = pc.count_substring(texts, ",").to_numpy(zero_copy_only=False)
    stops = pc.match_substring_regex(texts, "[.!?][\"')]?$").to_numpy(zero_copy_only=False)
    linked = np.minimum([x.linked for x in flat], size)
    place = np.concatenate([np.arange(len(p)) / max(1, len(p) - 1) for p in pages])
    out[:, -MEASURES:] = np.stack([np.log1p(size) / 8, np.log1p(n) / 6, linked / np.maximum(size, 1), stops, commas / n, place, 1 - place, np.ones(len(flat))], 1)
    return out


# ---- network ----------------------------------------------------------------

HIDDEN_UNITS, EPOCHS, BATCH, RATE = 24, 10, 32, 0.01
SAMPLE_PAGES, VARIANTS = 400, 2
CELLS = 4096


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fresh(rng: np.random.Generator, width: int = WIDTH, units: int = HIDDEN_UNITS) -> dict[str, np.ndarray]:
    p = {}
    for d in "fb":
        p["x" + d] = (rng.standard_normal((width, 4 * units)) / np.sqrt(width)).astype(np.float32)
        p["h" + d] = (rng.standard_normal((units, 4 * units)) / np.sqrt(units)).astype(np.float32)
        p["c" + d] = np.zeros(4 * units, np.float32)
        p["c" + d][units : 2 * units] = 1
    return p | {"v": (rng.standard_normal(2 * units) / np.sqrt(units)).astype(np.float32), "o": np.zeros(1, np.float32)}


def _run(p: dict, x: np.ndarray, mask: np.ndarray, d: str, keep: list | None = None) -> np.ndarray:
    """Hidden states (time, batch, units) of one direction; states stand still where the mask is 0."""
    steps, batch, _ = x.shape
    units = p["h" + d].shape[0]
    into = x @ p["x" + d] + p["c" + d]
    h = c = np.zeros((batch, units), np.float32)
    out = np.empty((steps, batch, units), np.float32)
    for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
        a = into[t] + h @ p["h" + d]
        gates = _sigmoid(a[:, : 3 * units])
        i, f, o, g = gates[:, :units], gates[:, units : 2 * units], gates[:, 2 * units :], np.tanh(a[:, 3 * units :])
        m = mask[t][:, None]
        new = f * c + i * g
        shown = np.tanh(new)
        if keep is not None:
            keep.append((t, h, c, i, f, o, g, shown, m))
        c = m * new + (1 - m) * c
        h = m * (o * shown) + (1 - m) * h
        out[t] = h
    return out


def logits(p: dict, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
    units = p["hf"].shape[0]
    return _run(p, x, mask, "f") @ p["v"][:units] + _run(p, x, mask, "b") @ p["v"][units:] + p["o"]


def gradients(p: dict, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    """Of the mean cross entropy over unmasked leaves, back through time."""
    units, grads = p["hf"].shape[0], {k: np.zeros_like(v) for k, v in p.items()}
    kept: dict[str, list] = {"f": [], "b": []}
    states = {d: _run(p, x, mask, d, kept[d]) for d in "fb"}
    z = states["f"] @ p["v"][:units] + states["b"] @ p["v"][units:] + p["o"]
    dz = ((_sigmoid(z) - y) * mask / max(1.0, float(mask.sum()))).astype(np.float32)
    grads["v"] = np.concatenate([np.einsum("tb,tbu->u", dz, states[d]) for d in "fb"])
    grads["o"][0] = dz.sum()
    for d, v in (("f", p["v"][:units]), ("b", p["v"][units:])):
        dh = dc = np.zeros_like(states[d][0])
        into = np.zeros(x.shape[:2] + (4 * units,), np.float32)
        for t, h0, c0, i, f, o, g, shown, m in reversed(kept[d]):
            dh = dh + dz[t][:, None] * v
            moved, still = m * dh, (1 - m) * dh
            inner = m * dc + moved * o * (1 - shown**2)
            a = np.concatenate([inner * g * i * (1 - i), inner * c0 * f * (1 - f), moved * shown * o * (1 - o), inner * i * (1 - g**2)], 1)
            into[t] = a
            grads["h" + d] += h0.T @ a
            dh, dc = a @ p["h" + d].T + still, inner * f + (1 - m) * dc
        grads["x" + d] = np.einsum("tbw,tbg->wg", x, into, optimize=True)
        grads["c" + d] = into.sum((0, 1))
    return grads


def batches_of(counts: np.ndarray, most_pages: int, most_cells: int) -> Iterator[np.ndarray]:
    """Pages of similar length together, within bounds on pages and on padded leaves; a longer page alone."""
    order = np.argsort(counts, kind="stable")
    order, at = order[counts[order] > 0], 0
    while at < len(order):
        to = at + 1
        while to < len(order) and to - at < most_pages and counts[order[to]] * (to - at + 1) <= most_cells:
            to += 1
        yield order[at:to]
        at = to


def padded(rows: np.ndarray, starts: np.ndarray, counts: np.ndarray, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    steps = int(counts[some].max())
    x, mask = np.zeros((steps, len(some), rows.shape[1]), np.float32), np.zeros((steps, len(some)), np.float32)
    for k, page in enumerate(some):
        x[: counts[page], k] = rows[starts[page] : starts[page] + counts[page]]
        mask[: counts[page], k] = 1
    return x, mask


def learn(pages: list[list[Leaf]], epochs: int = EPOCHS, seed: int = 5) -> dict[str, np.ndarray]:
    """Adam on batches of pages, of varied copies and of copies without telling names, which keep their labels."""
    rng = np.random.default_rng(seed)
    pages = [p for p in pages if p]
    plain = [stripped(p, rng) for p in pages]
    marks = [labels(p) for p in pages]
    copies = [varied(p, rng) for p in pages for _ in range(VARIANTS)]
    pages, marks = pages + copies + plain, marks + [labels(p) for p in copies] + marks
    p = fresh(rng)
    rows, counts = vectors(pages), np.array([len(x) for x in pages], np.int64)
    starts = np.cumsum(counts) - counts
    truth = np.concatenate(marks).astype(np.float32)[:, None] if pages else np.zeros((0, 1), np.float32)
    groups = list(batches_of(counts, BATCH, CELLS))
    first, second, step = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}, 0
    for epoch in range(epochs):
        for k in rng.permutation(len(groups)):
            x, mask = padded(rows, starts, counts, groups[k])
            y, _ = padded(truth, starts, counts, groups[k])
            grads, step = gradients(p, x, mask, y[:, :, 0]), step + 1
            size = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
            for name, g in grads.items():
                g = g * min(1.0, 1.0 / max(size, 1e-9))
                first[name] = 0.9 * first[name] + 0.1 * g
                second[name] = 0.999 * second[name] + 0.001 * g * g
                rate = RATE * (1 - epoch / epochs) + 1e-4
                p[name] = p[name] - rate * (first[name] / (1 - 0.9**step)) / (np.sqrt(second[name] / (1 - 0.999**step)) + 1e-8)
    return p


def classify(p: dict, pages: list[list[Leaf]]) -> list[np.ndarray]:
    """For every page, which leaves are article."""
    rows, counts = vectors(pages), np.array([len(x) for x in pages], np.int64)
    starts, out = np.cumsum(counts) - counts, [np.zeros(n, bool) for n in counts]
    for some in batches_of(counts, 256, 4 * CELLS):
        x, mask = padded(rows, starts, counts, some)
        z = logits(p, x, mask)
        for k, page in enumerate(some):
            out[page] = z[: counts[page], k] > 0
    return out


# ---- tables -----------------------------------------------------------------


def train(pages: DataFrame, most: int = SAMPLE_PAGES) -> dict[str, np.ndarray] | None:
    """The network, from the ``most`` pages with the smallest hash of their id and url."""
    rows = pages.select(F.col("html").cast("string").alias("html"), F.xxhash64(F.col("page_id").cast("string"), F.col("url").cast("string")).alias("k"))
    rows = rows.where("html is not null")
    picked = materialise(rows.select("k").distinct().orderBy("k").limit(most))
    rows = rows.join(F.broadcast(picked), "k").dropDuplicates(["k"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = [leaves(h) for b in batches for h in b.column("html").to_pylist()]
        if read:
            p = learn(read)
            yield pa.RecordBatch.from_pydict({"name": list(p), "shape": [list(v.shape) for v in p.values()], "data": [v.astype("<f4").tobytes() for v in p.values()]})

    one = rows.repartition(1).sortWithinPartitions("k").select("html")
    found = one.mapInArrow(run, "name string, shape array<long>, data binary").collect()
    return {r.name: np.frombuffer(bytes(r.data), "<f4").reshape(r.shape) for r in found} or None


def extract(pages: DataFrame, model: dict[str, np.ndarray] | None) -> DataFrame:
    """page_id, url, text (blocks of the article, two line breaks between them), n_chars."""
    columns = pages.select("page_id", "url", F.col("html").cast("string").alias("html"))
    schema = T.StructType([*columns.schema.fields[:2], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tx.slices(batches, "html"):
            read = [leaves(h) for h in batch.column("html").to_pylist()]
            marks = classify(model, read) if model else [np.zeros(len(x), bool) for x in read]
            texts = ["\n\n".join(x.text for x, keep in zip(page, mark) if keep) for page, mark in zip(read, marks)]
            own = [pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), *own], names=["page_id", "url", "text", "n_chars"])

    return columns.mapInArrow(run, schema)
