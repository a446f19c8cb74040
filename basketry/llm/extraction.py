"""Main text of HTML pages by a tree-structured graphical model over the page's blocks.

Every node of a page's tree, and every text segment below it, has a hidden label: article or not.  A potential of its own weighs what is seen of it
(tag, names, length, links, place), and a potential of each parent and child says how likely labels pass on.  Sum-product messages, first up and
then down the tree, give each one's marginal exactly.  The weights are trained on labelled pages by the gradient of the log-likelihood: seen minus
expected counts, from the same messages.
"""

from __future__ import annotations

import functools
import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.llm import labelled_pages
from basketry.llm import textscan as ts
from basketry.llm.common import small_batches, text_or_empty, unused
from basketry.llm.dom import Page, joined, parse

#: Hashed features of nodes.
WIDTH = 1 << 15
#: Kinds of children that have pair potentials of their own; others share the last.
KINDS = {k: i for i, k in enumerate(["#text", "p", "h1", "h2", "h3", "h4", "div", "section", "article", "main", "aside", "nav", "header", "footer", "form", "ul", "ol", "li", "dl", "dd", "dt", "table", "tr", "td", "blockquote", "pre", "figure", "figcaption", "span", "a", "dialog", "fieldset", "label", "#other"])}
#: Labelled pages that a model is trained on if none are given, and steps of training.
PAGES, STEPS = 1200, 200
#: Bytes of HTML whose trees are worked on together.
BATCH = 1 << 20

_PART, _TOKEN = re.compile(r"[A-Za-z0-9]+"), re.compile(r"[a-z]+|[A-Z]+[a-z]*")
#: Signs of a text that say something in any language; words aren't looked at, as there are too few labelled pages to learn these from.
SAYING = ("©",)
#: Elements that hold articles, the likelier first, and those whose text counts for the container that they are in.
ARTICLES, CONTAINERS = ("article", "main"), frozenset("html div section article main td aside form center".split())


def _hash(name: str) -> int:
    return zlib.crc32(name.encode("utf-8", "replace")) % WIDTH


@functools.lru_cache(20_000)
def _named(tag: str, names: str, role: str, hidden: bool) -> tuple[int, ...]:
    """Features of a tag and of its names: tokens of class and id, and runs of four characters of these."""
    out = {f"tag:{tag}"}
    if role:
        out.add(f"role:{role}")
    if hidden:
        out.add("hidden")
    # parts with digits inside are made by machines and say nothing
    parts = [part.rstrip("0123456789") for part in _PART.findall(names)]
    tokens = [t.lower() for part in parts if part.isalpha() for t in _TOKEN.findall(part)][:60]
    for t in tokens:
        out.add(f"name:{t}")
        padded = f"<{t}>"
        out |= {f"gram:{padded[i : i + 4]}" for i in range(min(len(padded) - 3, 24))}
    return tuple(_hash(f) for f in out)


@functools.lru_cache(100_000)
def _measured(what: str, *values: int) -> int:
    return _hash(f"{what}:{values}")


def _bin(n: float) -> int:
    return int(n).bit_length()


@dataclass
class Forest:
    """Trees of several pages laid end to end: parents come before children, segments are leaves."""

    parent: np.ndarray
    depth: np.ndarray
    kind: np.ndarray
    #: Features of all nodes end to end, and the node of each.
    features: np.ndarray
    owner: np.ndarray
    #: Where each page's segments are.
    segments: list[np.ndarray]


def forest(pages: list[Page]) -> Forest:
    parent, kind, features, count, segments, depth = [], [], [], [], [], []
    for page in pages:
        base, n, m = len(parent), len(page.tags), len(page.texts)
        size, links, parts, first = [0] * n, [0] * n, [0] * n, [-1] * n
        before, all_ = 0, sum(map(len, page.texts)) or 1
        place = []
        for node, text, linked in zip(page.nodes, page.texts, page.linked, strict=True):
            place.append(before)
            size[node] += len(text)
            links[node] += linked
            parts[node] += 1
            if first[node] < 0:
                first[node] = before
            before += len(text)
        controls = [0] * n
        for node in page.controls:
            controls[node] += 1
        depths = [0] * n
        for i in range(1, n):
            depths[i] = depths[page.parents[i]] + 1
        for i in range(n - 1, 0, -1):
            up = page.parents[i]
            size[up] += size[i]
            links[up] += links[i]
            parts[up] += parts[i]
            controls[up] += controls[i]
            if first[i] >= 0 and (first[up] < 0 or first[i] < first[up]):
                first[up] = first[i]
        last = list(range(n))
        for i in range(n - 1, 0, -1):
            last[page.parents[i]] = max(last[page.parents[i]], last[i])
        named = [[i for i in range(n) if page.tags[i] == tag and size[i]] for tag in ARTICLES]
        marked = max(named[0] or named[1], key=lambda i: size[i], default=-1)
        kind_of = 4 * (1 if len(named[0]) > 1 else 2 if marked >= 0 and not named[0] else 0)
        titled = [page.tags[i] == "h1" for i in range(n)]
        for i in range(n - 1, 0, -1):
            titled[page.parents[i]] |= titled[i]
        direct = [0] * n
        for node, text, linked in zip(page.nodes, page.texts, page.linked, strict=True):
            while page.tags[node] not in CONTAINERS:
                node = page.parents[node]
            direct[node] += len(text) - linked
        densest = max(range(n), key=direct.__getitem__)
        beside = [[3 if at < 0 else 1 if at <= i <= last[at] else 2 if i < at <= last[i] else 0 for i in range(n)] for at in (marked, densest)]
        beside[0] = [b + kind_of for b in beside[0]]
        for i in range(n):
            a = page.attributes[i] or {}
            style = a.get("style", "").replace(" ", "").lower()
            hidden = "hidden" in a or a.get("aria-hidden") == "true" or "display:none" in style or "visibility:hidden" in style
            share = size[i] / all_
            link = int(4 * links[i] / size[i] + 0.5) if size[i] else 5
            mine = [*_named(page.tags[i], f"{a.get('class', '')} {a.get('id', '')} {a.get('itemprop', '')}"[:400], a.get("role", "")[:40].lower(), hidden)]
            mine += [_measured("size", _bin(size[i])), _measured("share", int(share * 8)), _measured("links", link), _measured("links,size", link, _bin(size[i]) // 2), _measured("mean", _bin(size[i] / max(parts[i], 1))), _measured("place", int(4 * max(first[i], 0) / all_)), _measured("depth", min(depths[i], 6)), _measured("controls", min(controls[i], 3), _bin(parts[i]) // 2)]
            mine += [_measured("marked", beside[0][i]), _measured("densest", beside[1][i]), _measured("both", beside[0][i], beside[1][i]), _hash(f"marked:{beside[0][i]}:{page.tags[i]}"), _measured("titled", titled[i], beside[0][i]), _hash(f"titled:{titled[i]}:{page.tags[i]}")]
            parent.append(base + page.parents[i] if i else -1)
            depth.append(depths[i])
            kind.append(KINDS.get(page.tags[i], len(KINDS) - 1))
            features += mine
            count.append(len(mine))
        for j, (node, text, linked) in enumerate(zip(page.nodes, page.texts, page.linked, strict=True)):
            n_ = len(text)
            marks = sum(text.count(c) for c in ".,;:!?")
            link = int(4 * linked / n_ + 0.5)
            mine = [_measured("#size", _bin(n_)), _measured("#links", link), _measured("#links,size", link, _bin(n_) // 2), _measured("#marks", min(marks, 2), _bin(n_) // 2), _measured("#place", int(6 * place[j] / all_)), _measured("#share", int(8 * n_ / all_)), _hash(f"#in:{page.tags[node]}"), _measured("#both", beside[0][node], beside[1][node])]
            mine += [_hash(f"#says:{w}") for w in SAYING if w in text]
            parent.append(base + node)
            depth.append(depths[node] + 1)
            kind.append(0)
            features += mine
            count.append(len(mine))
        segments.append(np.arange(base + n, base + n + m))
    return Forest(np.array(parent, np.int64), np.array(depth, np.int64), np.array(kind, np.int64), np.array(features, np.int64), np.repeat(np.arange(len(parent)), count), segments)


@dataclass
class Model:
    weights: np.ndarray  # of each feature, for the label article
    pairs: np.ndarray  # log potentials by kind of the child, label of the parent, label of the child

    def messages(self, f: Forest) -> tuple[np.ndarray, np.ndarray]:
        """Marginals of the labels of each node, and of each node's label with its parent's (kinds of roots: zero)."""
        n = len(f.parent)
        own = np.zeros((n, 2))
        own[:, 1] = np.bincount(f.owner, weights=self.weights[f.features], minlength=n)
        order = np.argsort(f.depth, kind="stable")
        edge = np.searchsorted(f.depth[order], np.arange(int(f.depth.max(initial=0)) + 2))
        levels = [order[a:b] for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]
        up, below, above = np.zeros((n, 2)), own.copy(), np.zeros((n, 2))
        for level in reversed(levels[1:]):
            # what the children say: for each label of the parent, over the labels of the child
            joint = below[level][:, None, :] + self.pairs[f.kind[level]]
            up[level] = np.logaddexp(joint[:, :, 0], joint[:, :, 1])
            low, high = (int(x) for x in (f.parent[level].min(), f.parent[level].max() + 1))
            for label in (0, 1):
                below[low:high, label] += np.bincount(f.parent[level] - low, weights=up[level, label], minlength=high - low)
        both = np.zeros((n, 2, 2))
        for level in levels[1:]:
            rest = above[f.parent[level]] + below[f.parent[level]] - up[level]
            joint = rest[:, :, None] + self.pairs[f.kind[level]]
            above[level] = np.logaddexp(joint[:, 0], joint[:, 1])
            joint = joint + below[level][:, None, :]
            joint -= joint.max(axis=(1, 2), keepdims=True)
            joint = np.exp(joint)
            both[level] = joint / joint.sum(axis=(1, 2), keepdims=True)
        total = above + below
        return np.exp(total - np.logaddexp(total[:, 0], total[:, 1])[:, None]), both

    def marginals(self, f: Forest) -> np.ndarray:
        """Per node, how likely it belongs to the article."""
        return self.messages(f)[0][:, 1]


def labels(page: Page, main: str) -> np.ndarray:
    """1 for the segments that the main text holds, in its order, and for nodes of whose text these are half or more.

    A segment counts if the main text goes on with it; where nothing does any more, as with texts that were put together otherwise, long segments that are anywhere in
    it count too.
    """
    main = " ".join(main.split())
    at, said = 0, []
    for text in page.texts:
        text = " ".join(text.split())
        while main[at : at + 1] == " ":
            at += 1
        good = bool(text) and main.startswith(text, at)
        at += len(text) if good else 0
        said.append(good)
    if at < len(main):
        said = [s or (len(t) > 25 and " ".join(t.split()) in main) for s, t in zip(said, page.texts, strict=True)]
    size, article = np.zeros(len(page.tags)), np.zeros(len(page.tags))
    for node, text, good in zip(page.nodes, page.texts, said, strict=True):
        size[node] += len(text)
        article[node] += len(text) * good
    for i in range(len(page.tags) - 1, 0, -1):
        size[page.parents[i]] += size[i]
        article[page.parents[i]] += article[i]
    return np.concatenate([(2 * article >= size) & (size > 0), said]).astype(np.int64)


def fit(labelled: Iterable[tuple[str, str]] | None = None, steps: int = STEPS, penalty: float = 2e-5, rate: float = 0.08) -> Model:
    """A model trained on labelled pages (html, main text), of which there may be as many as the driver holds; without any, on PAGES composed ones.

    Maximum likelihood with a squared penalty, by steps of Adam over all pages.  The same pages give the same model.
    """
    pairs = list(labelled if labelled is not None else labelled_pages.pages(PAGES))
    pages = [parse(source or "") for source, _ in pairs]
    f = forest(pages)
    truth = np.concatenate([labels(p, main or "") for p, (_, main) in zip(pages, pairs, strict=True)]) if pages else np.zeros(0, np.int64)
    model = Model(np.zeros(WIDTH), np.zeros((len(KINDS), 2, 2)))
    child = np.flatnonzero(f.parent >= 0)
    seen = np.zeros_like(model.pairs)
    np.add.at(seen, (f.kind[child], truth[f.parent[child]], truth[child]), 1)
    first, second = [np.zeros(WIDTH), np.zeros_like(seen)], [np.zeros(WIDTH), np.zeros_like(seen)]
    scale = 1 / max(len(pages), 1)
    for step in range(1, steps + 1 if pages else 1):
        single, both = model.messages(f)
        expected = np.stack([np.bincount(f.kind[child], weights=both[child, a, b], minlength=len(KINDS)) for a in (0, 1) for b in (0, 1)], 1).reshape(-1, 2, 2)
        slopes = [np.bincount(f.features, weights=(truth - single[:, 1])[f.owner], minlength=WIDTH) * scale - penalty * len(pages) * scale * model.weights, (seen - expected) * scale - penalty * model.pairs]
        for i, (slope, values) in enumerate(zip(slopes, (model.weights, model.pairs), strict=True)):
            first[i] = 0.9 * first[i] + 0.1 * slope
            second[i] = 0.99 * second[i] + 0.01 * slope * slope
            values += rate * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.99**step)) + 1e-8)
    return model


@functools.cache
def composed() -> Model:
    """The model trained on composed pages, once for each process."""
    return fit()


def texts(model: Model, sources: list[str | None], least: float = 0.5) -> list[str]:
    """Main text of each page: the segments whose marginal is least or more."""
    pages = [parse(s or "") for s in sources]
    f = forest(pages)
    likely = model.marginals(f) >= least
    return [joined(page, likely[at].tolist()) for page, at in zip(pages, f.segments, strict=True)]


def extract(pages: DataFrame, model: Model, html: str = "html", out: str = "text", least: float = 0.5) -> DataFrame:
    """pages with the main text of the column html in out, which replaces a column of that name.

    Character references are decoded, white space (Unicode's) inside a block is one space, blocks are trimmed and joined by one space in page order.  Scripts, styles, titles,
    comments of the markup, and what is to be filled in or chosen, are no text.  Null and empty pages have an empty text, like pages without any.  Tags left open or closed
    twice are read as the HTML standard says, and elements deeper than 400 as siblings.  Every row stays, once.
    """
    small_batches(pages.sparkSession)
    source = unused(pages, "source")
    rest = [c for c in pages.columns if c != out]
    rows = pages.withColumn(source, text_or_empty(html)).select(*[F.col(f"`{c}`") for c in rest], source)
    kept = pages.select(*[F.col(f"`{c}`") for c in rest], F.lit("").alias(out)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in ts.slices(whole, source, BATCH):
                found = texts(model, batch.column(len(rest)).to_pylist(), least)
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, pa.string())], [*rest, out])

    return rows.mapInArrow(ts.thrifty(run), kept)
