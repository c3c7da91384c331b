"""Main text of web pages by a recurrent block labeller: a bidirectional LSTM in numpy over the leaves of a page."""

from __future__ import annotations

import html
import math
import random
import re
from collections import Counter
from dataclasses import dataclass, field
from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.llm.common import blocks

# Element names by how they are read.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNREAD = "script|style|noscript|template|svg|canvas|iframe|object|title|textarea"
#: Names, classes and ids (their word parts) that mark parts outside the article, for training labels only.
OUTSIDE = frozenset(
    "ad ads adsense advert advertisement advertising aside banner breadcrumb breadcrumbs button comment comments consent cookie cookies dialog discussion disqus footer form gdpr header login masthead menu modal nav navbar navigation newsletter notice option popup promo promoted related respond search select share sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split()
)

# Start tags that end open elements without an end tag, and the elements that such ends don't pass.
ENDS = {
    **dict.fromkeys(["dd", "dt"], (frozenset({"dd", "dt"}), frozenset({"dl"}))), **dict.fromkeys(["td", "th"], (frozenset({"td", "th"}), frozenset({"table", "tr"}))),
    **dict.fromkeys(["tbody", "tfoot", "thead"], (frozenset({"td", "th", "tr", "tbody", "tfoot", "thead"}), frozenset({"table"}))), "tr": (frozenset({"td", "th", "tr"}), frozenset({"table"})),
    "li": (frozenset({"li"}), frozenset({"ul", "ol", "menu"})), "option": (frozenset({"option"}), frozenset({"select", "datalist"})), "optgroup": (frozenset({"option", "optgroup"}), frozenset({"select"})),
}
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul li dd dt".split())
P_SCOPE = frozenset("table td th button caption".split())
#: Elements whose classes describe the page, and what starts a class that tells of a state.
WHOLE = frozenset(["html", "body", "main"])
STATE = re.compile(r"(?:has|with|without|no|is|show|shows|hide|hides|enable|enabled|disable|disabled)[-_]", re.I)
#: Of the names above a block the outermost and the innermost are its path, so that deep pages stay linear.
OUTER, INNER = 16, 48
#: An element with this share of a page's text out of links is the page's container, whatever its name.
CONTAINER = 0.8

#: Attributes as HTML's tokeniser takes them: values may be bare and then hold quotes; a quote that is never closed is part of a name.
VALUE = r"""(?:"[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+)"""
REST = rf"(?:[\s/]++|=?[^\s/>=]++(?:\s*+=\s*+{VALUE})?+|=)*+"
TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<svg(?=[\s/>]){REST}(?<=/)>|<(?P<raw>{UNREAD})(?=[\s/>])(?:{REST}>|[^>]*>).*?(?:</(?P=raw)\s*>|\Z)|<(?P<tag>/?[a-zA-Z][^\s/>]*)(?P<rest>{REST})>|<[!?/][^>]*>", re.S | re.I
)
ATTRIBUTE = re.compile(r"""(=?[^\s/>=]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>"'][^\s>]*+)))?+""")
PARTS = re.compile(r"[a-z]+")
PATHS, WORDS, FIGURES = 4096, 512, 6
PIECE = 1 << 17


@dataclass
class Block:
    path: tuple[str, ...]
    text: str
    linked: float  # share of its characters inside links


def names_of(tag: str, rest: str) -> tuple[str, ...]:
    """An element's name and the word parts of its classes, id and role.

    Those of a page's own elements say what the page has and not what the element is, as do classes like ``has-comments``; an article
    is a part of another kind only by a whole class.
    """
    if tag in WHOLE:
        return (tag,)
    told = [v.lower() for m in ATTRIBUTE.finditer(rest) if m[1].lower() in ("class", "id", "role") for v in (m[2] or m[3] or m[4] or "").split() if not STATE.match(v)]
    parts = [v for v in told if v.isalpha()] if tag == "article" else [p for v in told for p in PARTS.findall(v)]
    return tuple(dict.fromkeys((tag, *parts)))


class Stack:
    """Open elements, each (tag, number); looking for one that isn't open costs nothing."""

    def __init__(self):
        self.open: list[tuple[str, int]] = []
        self.count: Counter[str] = Counter()

    def push(self, tag: str, number: int) -> None:
        self.open.append((tag, number))
        self.count[tag] += 1

    def cut(self, at: int) -> None:
        for tag, _ in self.open[at:]:
            self.count[tag] -= 1
        del self.open[at:]

    def end(self, tag: str) -> None:
        if self.count[tag]:
            at = len(self.open) - 1
            while self.open[at][0] != tag:
                at -= 1
            self.cut(at)

    def implied(self, ended: frozenset, held: frozenset) -> None:
        """End all open elements of these names that no element of ``held`` keeps open."""
        left = 0
        for t in ended:
            left += self.count.get(t, 0)
        found, at = None, len(self.open) - 1
        while left and self.open[at][0] not in held:
            if self.open[at][0] in ended:
                found, left = at, left - 1
            elif found is None and len(self.open) - at > OUTER + INNER:
                break
            at -= 1
        if found is not None:
            self.cut(found)


def leaves(page: str | None) -> list[Block]:
    """Text blocks of a page in order, each with the element names, classes and ids above it."""
    texts: list[tuple[tuple[int, ...], str, float]] = []  # numbers of the elements above, text, linked share
    names: list[tuple[str, ...]] = []
    stack, held = Stack(), []
    state = {"links": 0, "linked": 0}
    weight: list[float] = []  # by element: its text out of links, its own at first
    parent: list[int] = []

    def close() -> None:
        if not held:
            state["linked"] = 0
            return
        text = " ".join(html.unescape("".join(held)).split())
        if text:
            above = stack.open if len(stack.open) <= OUTER + INNER else stack.open[:OUTER] + stack.open[-INNER:]
            linked = min(len(text), state["linked"])
            texts.append((tuple(k for _, k in above), text, linked / len(text)))
            if stack.open:
                weight[stack.open[-1][1]] += len(text) - linked
        held.clear()
        state["linked"] = 0

    def take(text: str) -> None:
        held.append(text)
        if state["links"]:
            state["linked"] += len(text)

    page, at = page or "", 0
    for m in TOKEN.finditer(page):
        if m.start() > at:
            take(page[at : m.start()])
        at = m.end()
        if not m["tag"]:
            continue
        tag = m["tag"].lower()
        if tag.lstrip("/") in INLINE:
            if tag in ("a", "/a"):
                state["links"] = int(tag == "a")
            continue
        close()
        if tag[0] == "/":
            state["links"] = 0
            stack.end(tag[1:])
            continue
        if tag in ENDS_P:
            stack.implied(frozenset({"p"}), P_SCOPE)
        if tag in ENDS:
            stack.implied(*ENDS[tag])
        if tag not in VOID and tag != "head":  # what may stand in a head is unread; the first other element or text ends it
            names.append(names_of(tag, m["rest"]))
            weight.append(0)
            parent.append(stack.open[-1][1] if stack.open else -1)
            stack.push(tag, len(names) - 1)
    if at < len(page):
        take(page[at:])
    close()
    for k in range(len(names) - 1, -1, -1):
        if parent[k] >= 0:
            weight[parent[k]] += weight[k]
    most = CONTAINER * sum(len(t) * (1 - linked) for _, t, linked in texts)
    plain = [("div",) if 0 < most <= w and not OUTSIDE.isdisjoint(n) else n for n, w in zip(names, weight, strict=True)]
    return [Block(tuple(n for k in above for n in plain[k]), text, linked) for above, text, linked in texts]


@lru_cache(1 << 16)
def hashed(name: str, size: int) -> int:
    return crc32(name.encode()) % size


#: Where the hash of a word goes on from, so that a word and a name of the same letters differ.
WORD_START = crc32(b"w")


def word_slots(text: str) -> list[int]:
    return [crc32(w.strip(".,;:!?").encode(), WORD_START) % WORDS for w in text.lower().split()]


@dataclass
class Sequence:
    """Inputs of the blocks of some pages, one page after another."""

    size: list[int] = field(default_factory=list)
    paths: list[list[int]] = field(default_factory=list)
    words: list[list[int]] = field(default_factory=list)
    figures: list[list[float]] = field(default_factory=list)

    def add(self, page: list[Block]) -> None:
        self.size.append(len(page))
        for k, b in enumerate(page):
            words = word_slots(b.text)
            letters = len(b.text) - len(words) + 1  # blocks have single spaces
            self.paths.append([hashed(n, PATHS) for n in b.path] or [hashed("", PATHS)])
            self.words.append(words)
            self.figures.append([math.log1p(len(b.text)) / 5, b.linked, min(1.0, len(words) / 20), b.text[-1] in ".!?…", letters / len(words) / 10, k / len(page)])


class Labeller:
    """Embeddings of path names and words, an LSTM each way over a page's blocks, one logit a block."""

    def __init__(self, embed: int = 12, hidden: int = 12, seed: int = 5):
        rng = np.random.default_rng(seed)
        small = lambda *s: rng.standard_normal(s) / np.sqrt(s[0])
        width = 2 * embed + FIGURES
        self.hidden, self.embed = hidden, embed
        self.p = {"path": rng.standard_normal((PATHS, embed)) * 0.3, "word": rng.standard_normal((WORDS, embed)) * 0.05, "out": small(2 * hidden + width), "bias": np.zeros(1)}
        for way in "fb":
            self.p |= {f"in_{way}": small(width, 4 * hidden), f"rec_{way}": small(hidden, 4 * hidden), f"bias_{way}": np.repeat([0.0, 1.0, 0.0, 0.0], hidden)}

    def inputs(self, s: Sequence):
        parts = []
        for name, lists in (("path", s.paths), ("word", s.words)):
            n = np.fromiter(map(len, lists), np.int64, len(lists))
            flat = np.fromiter((i for x in lists for i in x), np.int64, n.sum())
            parts.append((name, flat, np.repeat(np.arange(len(n)), n), 1 / np.repeat(np.maximum(n, 1), n) ** (0.5 if name == "path" else 1)))
        x = np.zeros((len(s.paths), 2 * self.embed + FIGURES))
        for k, (name, flat, owner, share) in enumerate(parts):
            for a in range(0, len(flat), PIECE):  # so that working memory doesn't follow the text
                p = slice(a, a + PIECE)
                first = np.flatnonzero(np.append(True, owner[p][1:] != owner[p][:-1]))
                x[owner[p][first], k * self.embed : (k + 1) * self.embed] += np.add.reduceat(self.p[name][flat[p]] * share[p, None], first)
        x[:, 2 * self.embed :] = np.array(s.figures, float).reshape(-1, FIGURES)
        return x, parts

    def layout(self, size: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """(place of each page's block at each step, whether there is one)."""
        size_ = np.array(size)
        step = np.arange(size_.max(initial=0))
        live = step < size_[:, None]
        return np.where(live, (size_.cumsum() - size_)[:, None] + step, 0), live

    def run(self, x: np.ndarray, place: np.ndarray, live: np.ndarray, way: str, keep: list | None = None) -> np.ndarray:
        h_, rec = self.hidden, self.p[f"rec_{way}"]
        gates = x @ self.p[f"in_{way}"] + self.p[f"bias_{way}"]
        h, c, out = np.zeros((len(place), h_)), np.zeros((len(place), h_)), np.zeros((len(x), h_))
        for t in range(place.shape[1]) if way == "f" else range(place.shape[1] - 1, -1, -1):
            on = live[:, t, None]
            a = gates[place[:, t]] + h @ rec
            i, f, o = (1 / (1 + np.exp(-np.clip(a[:, k * h_ : (k + 1) * h_], -30, 30))) for k in range(3))
            g = np.tanh(a[:, 3 * h_ :])
            c2 = np.where(on, f * c + i * g, c)
            tc = np.tanh(c2)
            h2 = np.where(on, o * tc, h)
            if keep is not None:
                keep.append((t, h, c, i, f, o, g, tc))
            h, c = h2, c2
            out[place[live[:, t], t]] = h[live[:, t]]
        return out

    def logits(self, s: Sequence) -> np.ndarray:
        if not s.paths:
            return np.zeros(0)
        x, _ = self.inputs(s)
        place, live = self.layout(s.size)
        return np.hstack([*(self.run(x, place, live, w) for w in "fb"), x]) @ self.p["out"] + self.p["bias"][0]

    def gradient(self, s: Sequence, labels: np.ndarray) -> dict[str, np.ndarray]:
        x, parts = self.inputs(s)
        place, live = self.layout(s.size)
        kept = {"f": [], "b": []}
        top = np.hstack([*(self.run(x, place, live, w, kept[w]) for w in "fb"), x])
        d = (1 / (1 + np.exp(-np.clip(top @ self.p["out"] + self.p["bias"][0], -30, 30))) - labels) / len(labels)
        g = {"out": top.T @ d, "bias": d.sum(keepdims=True)}
        d_top = d[:, None] * self.p["out"]
        h_ = self.hidden
        d_x = d_top[:, 2 * h_ :].copy()
        for k, way in enumerate("fb"):
            rec, d_gates = self.p[f"rec_{way}"], np.zeros((len(x), 4 * h_))
            g[f"rec_{way}"] = np.zeros_like(rec)
            d_h, d_c = np.zeros((len(place), h_)), np.zeros((len(place), h_))
            for t, h, c, i, f, o, gg, tc in reversed(kept[way]):
                on = live[:, t, None]
                d_h = d_h + np.where(on, d_top[place[:, t], k * h_ : (k + 1) * h_], 0)
                d_c2 = d_c + d_h * o * (1 - tc * tc) * on
                d_a = np.hstack([d_c2 * gg * i * (1 - i), d_c2 * c * f * (1 - f), d_h * tc * o * (1 - o), d_c2 * i * (1 - gg * gg)]) * on
                g[f"rec_{way}"] += h.T @ d_a
                d_gates[place[live[:, t], t]] = d_a[live[:, t]]
                d_h = np.where(on, d_a @ rec.T, d_h)
                d_c = np.where(on, d_c2 * f, d_c)
            g[f"in_{way}"], g[f"bias_{way}"] = x.T @ d_gates, d_gates.sum(0)
            d_x += d_gates @ self.p[f"in_{way}"].T
        for k, (name, flat, owner, share) in enumerate(parts):
            g[name] = np.zeros_like(self.p[name])
            for a in range(0, len(flat), PIECE):
                p = slice(a, a + PIECE)
                np.add.at(g[name], flat[p], d_x[owner[p], k * self.embed : (k + 1) * self.embed] * share[p, None])
        return g

    def fit(self, pages: list[list[Block]], labels: list[list[int]], rounds: int = 12, batch: int = 16, rate: float = 0.01, seed: int = 3) -> None:
        rng = np.random.default_rng(seed)
        first, second = ({n: np.zeros_like(v) for n, v in self.p.items()} for _ in range(2))
        steps, step = rounds * -(-len(pages) // batch), 0
        for _ in range(rounds):
            order = rng.permutation(len(pages))
            for at in range(0, len(order), batch):
                s, y = Sequence(), []
                for i in order[at : at + batch]:
                    s.add(pages[i])
                    y += labels[i]
                step += 1
                if not y:
                    continue
                for n, g in self.gradient(s, np.array(y, float)).items():
                    first[n] += 0.1 * (g - first[n])
                    second[n] += 0.001 * (g * g - second[n])
                    self.p[n] -= rate * (1 - (step - 1) / steps) * (first[n] / (1 - 0.9**step)) / (np.sqrt(second[n] / (1 - 0.999**step)) + 1e-8)


def weak_labels(page: list[Block]) -> list[int]:
    return [int(OUTSIDE.isdisjoint(b.path)) for b in page]


def altered(page: list[Block], rng: random.Random, said: list[str]) -> list[Block]:
    """A page with other parts around and within its article, and the article in another container.

    Parts are named by words of OUTSIDE and hold sentences of any page, so the labels of both kinds follow from the path and
    its surroundings and not from the words.
    """
    names = sorted(OUTSIDE)
    inside = rng.choice([("article",), ("main",), ("main", "article"), ("div", "content"), ("div", "post", "body"), ("div", "entry", "content"), ("section",), ("div", "id", "story"), ("div",), ()])
    block_names = rng.choice([("p",), ("p",), ("div",), ("section", "p"), ("blockquote", "p"), ("ul", "li")])

    def part() -> list[Block]:
        name = rng.choice(names)
        above = rng.choice([("div", name), ("section", name), ("ul", name), ("div", "id", name), (name,), ("div", name, "box"), ("div", rng.choice(names), name)])
        below = rng.choice([("p",), ("li",), ("div",), ("a",), ("h3",), ()])
        return [Block(("html", "body", *(inside if rng.random() < 0.3 else ()), *above, *below), rng.choice(said), rng.choice([0.0, 0.0, 1.0])) for _ in range(rng.randint(1, 5))]

    article = [Block(("html", "body", *inside, *(block_names if rng.random() < 0.5 else b.path[-1:])), b.text, b.linked) for b in page if OUTSIDE.isdisjoint(b.path)]
    out: list[Block] = []
    for _ in range(rng.randint(0, 3)):
        out += part()
    for b in article:
        out.append(b)
        if rng.random() < 0.08:
            out += part()
    for _ in range(rng.randint(0, 3)):
        out += part()
    return out


def train(pages: DataFrame, text: str, sample: int, most_chars: int) -> Labeller:
    """A labeller fitted to ``sample`` pages at most, those of the least hash, as long as they have ``most_chars`` characters at most in all, so no page
    of more; as they are and altered.  A page's own labels come from element names, classes and ids."""
    rows = pages.select(F.col(text).alias("page")).withColumns({"h": F.xxhash64("page"), "n": F.length("page")}).where("n > 0")
    sizes = [(r.h, r.n) for r in rows.select("h", "n").orderBy("h", "n").limit(sample).collect()]
    total = np.cumsum([n for _, n in sizes])
    count = int(np.searchsorted(total, most_chars, "right"))
    found = rows.where(F.col("h") <= sizes[count - 1][0]).orderBy("h", "page").limit(count).toArrow().column("page").to_pylist() if count else []
    rng = random.Random(17)
    own = [p for p in map(leaves, found) if p]
    said = [b.text for p in own for b in p]
    whole = own + [altered(p, rng, said) for p in own for _ in range(4)]
    model = Labeller()
    model.fit(whole, [weak_labels(p) for p in whole])
    return model


def extract(pages: DataFrame, text: str = "html", sample: int = 240, most_chars: int = 4_800_000) -> DataFrame:
    """All columns of pages but ``text``, with text (the article's blocks in page order, joined by spaces) and n_chars.

    Every block of a page is labelled with all its blocks in view.  Tags are read as HTML's tokeniser does, and what ends without an end
    tag is ended, so very long and deep pages take time in proportion; of the names above a block the outer 16 and the inner 48 count.
    An element that holds four fifths of the text is the page's container under any name.  Columns named text and n_chars are replaced.
    Scripts, styles, titles, comments of the source and other
    elements that aren't read give no blocks; a head has no others, and ends where another element or text begins.  White space inside a block is one space, character references are decoded.
    Null and empty pages give empty text.  Repeated rows stay.  Without pages to train on the labeller is as it starts.
    """
    model = pages.sparkSession.sparkContext.broadcast(train(pages, text, sample, most_chars))
    rest = [c for c in pages.columns if c not in ("text", "n_chars") or c == text]

    def run(batches):
        for whole in batches:
            for batch in blocks(whole, text, 4_000_000):
                own = [leaves(p) for p in batch.column(text).to_pylist()]
                keep: list[np.ndarray] = [np.zeros(0)] * len(own)
                order = sorted(range(len(own)), key=lambda i: len(own[i]))
                for at in range(0, len(order), 128):  # pages of like length together
                    part, s = order[at : at + 128], Sequence()
                    for i in part:
                        s.add(own[i])
                    for i, y in zip(part, np.split(model.value.logits(s), np.cumsum(s.size)[:-1]), strict=True):
                        keep[i] = y >= 0
                texts = [" ".join(b.text for b, k in zip(page, y, strict=True) if k) for page, y in zip(own, keep, strict=True)]
                columns = [batch.column(c) for c in rest if c != text]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*(c for c in rest if c != text), "text", "n_chars"])

    kind = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in pages.schema.fields if f.name in rest and f.name != text)
    return pages.select(*rest).mapInArrow(run, kind + "text string, n_chars long")
