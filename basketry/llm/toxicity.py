"""Toxicity by a lexicon that tolerates misspellings, scored in context windows.

The lexicon holds given terms, and terms and word beginnings that labelled texts show to be marks of abuse.  Terms
lie in a trie; a word matches if the trie and the word's Levenshtein automaton have a path in common, so that terms
with a typing error or two are caught.  Each match weighs what the labels say its term is worth, less for
errors, and is judged in the window of words around it: other matches nearby and direct address add to it, marks of
quotation and report take from it.  A logistic layer, fitted to the labels, turns the windows' scores into the text's.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basketry.llm import textscan as ts
from basketry.llm.common import small_batches, written

#: Terms that are abusive whatever the labels say.
GIVEN = ("idiot", "moron", "stupid", "worthless", "pathetic", "disgusting", "loser", "scum", "trash", "clown", "imbecile", "filth", "vermin", "retard", "bastard", "bitch")
#: Words that report or quote, and words that address somebody.
REPORT = ("said", "says", "wrote", "writes", "quote", "quoted", "quotes", "called", "reported", "term", "word", "sagte", "schrieb", "dijo", "escribió", "dit", "écrit")
ADDRESS = ("you", "your", "youre", "u", "du", "dich", "dein", "tu", "te", "toi", "ton", "vous", "eres", "usted")
WINDOW = 10
#: Most labelled texts of either kind that the lexicon and the layer are learned from (smallest hash of the key).
SAMPLE = 4000
#: Terms and beginnings that are learned, at most, and in how many toxic texts each must be.
LEARNED, LEAST_TEXTS = 1500, 4
#: A learned term is in this share of the toxic texts at least.
LEAST_SHARE = 0.015
BEGINNINGS = range(4, 9)

#: Letters, digits, marks that stand for letters and all bytes above ASCII are part of a word.
SEPARATOR = ts.NOT_ALNUM.copy()
SEPARATOR[list(b"@$*")] = False
_QUOTES = np.zeros(256, bool)
_QUOTES[list(b"\"`>")] = True


class Automaton:
    """The words within some errors of a term of the lexicon: Levenshtein automata on its trie, made deterministic.

    A position is a node of the trie, the errors left, and the letter that an open swap of neighbours waits for.  A state
    is the set of positions that a word's letters lead to; states and steps are made when a word first needs them.
    """

    def __init__(self, tries: dict[int, dict], most: int = 200_000):
        self.tries, self.most = tries, most
        self.clear()

    def clear(self) -> None:
        self.ids: dict[frozenset, int] = {}
        self.positions: list[dict] = []
        self.steps: list[dict[str, int]] = []
        self.worth: list[float] = []
        self.made = 0
        self.start = self.state({(id(root), left, ""): (root, left) for left, root in self.tries.items()})

    def state(self, found: dict) -> int:
        """The number of the state with these positions and those that missing letters lead to."""
        todo = list(found.items())
        while todo:
            (_, left, wait), (node, limit) = todo.pop()
            if left and not wait:
                for c, child in node.items():
                    key = (id(child), left - 1, "")
                    if c and key not in found:
                        found[key] = (child, limit)
                        todo.append((key, found[key]))
        name = frozenset(found)
        if name not in self.ids:
            self.ids[name] = len(self.positions)
            self.positions.append(found)
            self.steps.append({})
            ends = [node[""][1] * 0.6 ** (limit - left) for (_, left, wait), (node, limit) in found.items() if "" in node and not wait]
            self.worth.append(max(ends, default=0.0))
        return self.ids[name]

    def step(self, state: int, letter: str) -> int:
        found: dict = {}
        for (_, left, wait), (node, limit) in self.positions[state].items():
            if wait:
                if wait == letter:
                    found[id(node), left, ""] = (node, limit)
                continue
            if letter in node:
                found[id(node[letter]), left, ""] = (node[letter], limit)
            if left:
                found[id(node), left - 1, ""] = (node, limit)
                for c, child in node.items():
                    if c and c != letter:
                        found[id(child), left - 1, ""] = (child, limit)
                        if letter in child:
                            found[id(child[letter]), left - 1, c] = (child[letter], limit)
        after = self.steps[state][letter] = self.state(found)
        self.made += 1
        return after

    def weight(self, word: str) -> float:
        """The greatest worth of a term that the word is, less for errors; 0 if it is none."""
        if self.made > self.most:
            self.clear()
        steps, positions, state = self.steps, self.positions, self.start
        for c in word:
            after = steps[state].get(c)
            state = self.step(state, c) if after is None else after
            if not positions[state]:
                return 0.0
        return self.worth[state]


def trie(terms: dict[str, float]) -> dict:
    root: dict = {}
    for term, weight in terms.items():
        node = root
        for c in term:
            node = node.setdefault(c, {})
        node[""] = (term, weight)
    return root


def errors_allowed(length: int) -> int:
    """Errors that a term of so many letters may have: short ones are too close to other words."""
    return 0 if length < 5 else 1 if length < 8 else 2


@dataclass
class Lexicon:
    """terms: whole words; beginnings: of words, exactly; layer: weights of the text's features."""

    terms: dict[str, float]
    beginnings: dict[str, float]
    name: str = field(default_factory=lambda: uuid.uuid4().hex)
    layer: np.ndarray = field(default_factory=lambda: np.array([-3.0, 1.0, 1.0, 0.5]))


class Matcher:
    """Weights of words, with a memory of the words seen."""

    def __init__(self, lexicon: Lexicon):
        self.lexicon = lexicon
        self.automaton = Automaton({limit: trie({t: w for t, w in lexicon.terms.items() if errors_allowed(len(t)) == limit}) for limit in (1, 2)})
        self.seen: dict[int, float] = {}

    def weight(self, word: str) -> float:
        exact = self.lexicon.terms.get(word, 0.0)
        if exact:
            return exact
        best = max((self.lexicon.beginnings.get(word[:n], 0.0) for n in BEGINNINGS if len(word) >= n), default=0.0)
        return max(best, self.automaton.weight(word))

    def weights(self, hashes: np.ndarray, spelled) -> np.ndarray:
        """Of words by hash; spelled(i) spells the i-th."""
        distinct, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.seen) > 400_000:
            self.seen.clear()
        out = np.empty(len(distinct))
        for i, h in enumerate(distinct.tolist()):
            w = self.seen.get(h)
            if w is None:
                w = self.seen[h] = self.weight(spelled(int(first[i])))
            out[i] = w
        return out[inverse]


_matchers: dict[str, Matcher] = {}


def matcher_of(lexicon: Lexicon) -> Matcher:
    """The matcher of a lexicon, made once in each Python worker: what it remembers serves later tasks too."""
    if lexicon.name not in _matchers:
        _matchers.clear()
        _matchers[lexicon.name] = Matcher(lexicon)
    return _matchers[lexicon.name]


def _hash_of(words: tuple[str, ...]) -> np.ndarray:
    raw = [w.encode() for w in words]
    ends = np.cumsum([len(w) for w in raw])
    return np.sort(ts.span_hashes(np.frombuffer(b"".join(raw), np.uint8), ends - [len(w) for w in raw], ends))


def windows(data: np.ndarray, offsets: np.ndarray, matcher: Matcher) -> np.ndarray:
    """Features of each text: 1, greatest window score, log of their sum, log of their density."""
    n = len(offsets) - 1
    out = np.zeros((n, 4))
    out[:, 0] = 1
    low = ts.folded(data)
    starts, ends, doc = ts.words(low, offsets, SEPARATOR)
    if not len(starts):
        return out
    hashes = ts.span_hashes(low, starts, ends)
    weight = matcher.weights(hashes, lambda i: bytes(low[starts[i] : ends[i]]).decode("utf-8", "replace"))
    hits = np.flatnonzero(weight > 0)
    if not len(hits):
        return out
    first = np.searchsorted(doc, np.arange(n + 1))
    a = np.maximum(hits - WINDOW, first[doc[hits]])
    b = np.minimum(hits + WINDOW + 1, first[doc[hits] + 1])
    total = np.concatenate([[0.0], np.cumsum(weight)])
    report = np.concatenate([[0], np.cumsum(np.isin(hashes, _hash_of(REPORT)))])
    address = np.concatenate([[0], np.cumsum(np.isin(hashes, _hash_of(ADDRESS)))])
    quotes = np.concatenate([[0], np.cumsum(_QUOTES[data])])
    near = total[b] - total[a] - weight[hits]
    quoted = (quotes[starts[hits]] - quotes[starts[a]] > 0) & (quotes[ends[b - 1]] - quotes[ends[hits] - 1] > 0) | (report[b] > report[a])
    value = (weight[hits] + 0.3 * near) * np.where(quoted, 0.4, 1.0) * np.where(address[b] > address[a], 1.2, 1.0)
    np.maximum.at(out[:, 1], doc[hits], value)
    sums = np.bincount(doc[hits], value, n)
    out[:, 2] = np.log1p(sums)
    out[:, 3] = np.log1p(100 * sums / np.maximum(np.diff(first), 1))
    return out


def sample(docs: DataFrame, labels: DataFrame, label: str, key: str = "doc_id", text: str = "text", rows: int = SAMPLE, fold: tuple[int, int] | None = None) -> DataFrame:
    """At most rows labelled texts of either class (__k: hash of the key, __y, __text); fold (m, r): none whose crc32(key) mod m is r.

    Keys may be of any type; labels other than 0 and 1 are left out; of a key that repeats, the least label and the least text count.
    """
    known = labels.filter(F.col(label).isin(0, 1)).select(F.col(key).alias("__k"), F.col(label).cast("int").alias("__y")).dropna()
    if fold:
        known = known.filter(F.crc32(F.col("__k").cast("string").cast("binary")) % fold[0] != fold[1])
    known = known.groupBy("__k").agg(F.min("__y").alias("__y"))
    pick = lambda y: known.filter(F.col("__y") == y).orderBy(F.xxhash64("__k"), "__k").limit(rows)
    chosen = pick(1).unionByName(pick(0))
    found = docs.select(F.col(key).alias("__k"), F.coalesce(F.col(text), F.lit("")).alias("__text")).join(F.broadcast(chosen), "__k")
    return found.groupBy(F.xxhash64("__k").alias("__k"), "__y").agg(F.min("__text").alias("__text"))


def distinct(examples: DataFrame) -> DataFrame:
    """examples without near copies: of texts with the same smallest hash of four words in a row, one stays.

    Three hash functions are used one after the other.  Copies of one text would otherwise make its rare words look like marks
    of its class.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = ts.column_bytes(batch.column(2))
            starts, ends, doc = ts.words(ts.folded(data), offsets)
            rolled = ts.window_hashes(ts.span_hashes(ts.folded(data), starts, ends), 4)
            inside = np.flatnonzero(doc[: len(rolled)] == doc[3:]) if len(rolled) else np.zeros(0, np.int64)
            least = np.repeat(batch.column(0).to_numpy()[:, None], 3, 1)
            for k in range(3):
                mixed = (ts.mix(rolled[inside] ^ np.uint64(k * 0x9E3779B97F4A7C15 & (2**64 - 1))) >> np.uint64(1)).astype(np.int64)
                smallest = np.full(batch.num_rows, np.iinfo(np.int64).max)
                np.minimum.at(smallest, doc[inside], mixed)
                least[:, k] = np.where(smallest < np.iinfo(np.int64).max, smallest, least[:, k])
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(least[:, k]) for k in range(3))], [*batch.schema.names, "m0", "m1", "m2"])

    out = examples.select(F.col("__k").cast("long"), "__y", "__text").mapInArrow(ts.thrifty(run), "__k long, __y int, __text string, m0 long, m1 long, m2 long")
    for k in range(3):
        order = Window.partitionBy("__y", f"m{k}").orderBy("__k")
        out = out.withColumn("n", F.row_number().over(order)).filter("n = 1").drop("n")
    return written(out.select("__k", "__y", "__text"))


def _counted(examples: DataFrame) -> DataFrame:
    """Per word or beginning (with a trailing blank if a whole word): texts of either class that hold it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: tuple[Counter, Counter] = (Counter(), Counter())
        for batch in batches:
            for y, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = {w for w in re.findall(r"[^\W\d_]+", text.lower()) if len(w) > 3}
                seen[y].update({w[:n] for w in words for n in BEGINNINGS if len(w) > n} | {w + " " for w in words})
        terms = list(seen[1] | seen[0])
        for at in range(0, len(terms), 50_000):
            part = terms[at : at + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), pa.array([seen[1][t] for t in part], pa.int64()), pa.array([seen[0][t] for t in part], pa.int64())], ["term", "toxic", "clean"])

    return examples.select("__y", "__text").mapInArrow(ts.thrifty(run), "term string, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def learn(examples: DataFrame) -> Lexicon:
    """A lexicon from examples (__k, __y, __text), at most SAMPLE of either class.

    Terms are counted on the executors; at most LEARNED of them, those with the clearest surplus in toxic texts,
    come to the driver.  Without examples of both classes the given terms stand alone.
    """
    small_batches(examples.sparkSession)
    examples = distinct(examples)
    size = {r["__y"]: r["n"] for r in examples.groupBy("__y").agg(F.count(F.lit(1)).alias("n")).collect()}
    toxic, clean = size.get(1, 0), size.get(0, 0)
    lexicon = Lexicon({t: 3.0 for t in GIVEN}, {})
    if not toxic or not clean:
        return lexicon
    worth = F.log(((F.col("toxic") + 0.5) / toxic) / ((F.col("clean") + 0.5) / clean))
    found = _counted(examples).withColumn("worth", worth).filter((F.col("toxic") >= max(LEAST_TEXTS, LEAST_SHARE * toxic)) & (F.col("worth") > 2.5)).orderBy((F.col("worth") * F.sqrt("toxic")).desc(), "term").limit(LEARNED).collect()
    whole = {r["term"][:-1]: r for r in found if r["term"].endswith(" ")}
    for r in sorted((r for r in found if not r["term"].endswith(" ")), key=lambda r: len(r["term"])):
        if not any(r["term"][:n] in lexicon.beginnings for n in BEGINNINGS if n < len(r["term"])):
            lexicon.beginnings[r["term"]] = float(r["worth"])
    # a given term, or a word without a learned beginning, takes the place of the beginnings that are nearly all of it
    alone = [*lexicon.terms, *(t for t in whole if not any(t[:n] in lexicon.beginnings for n in BEGINNINGS))]
    # a word that may have errors is a term also where a beginning covers it, which still stands for the other words
    for term, r in whole.items():
        if term in alone or errors_allowed(len(term)):
            lexicon.terms[term] = max(float(r["worth"]), lexicon.terms.get(term, 0.0))
    for term in alone:
        for n in BEGINNINGS:
            lexicon.beginnings.pop(term[:n], None) if n >= len(term) - 1 else None
    features, y = _features(examples, lexicon)
    lexicon.layer = _fit(features, y)
    return lexicon


def _features(examples: DataFrame, lexicon: Lexicon) -> tuple[np.ndarray, np.ndarray]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = matcher_of(lexicon)
        for batch in batches:
            x = windows(*ts.column_bytes(batch.column(1)), matcher)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x[:, k]) for k in range(1, 4))], ["y", "a", "b", "c"])

    t = examples.select("__y", "__text").mapInArrow(ts.thrifty(run), "y int, a double, b double, c double").toArrow().sort_by([(c, "ascending") for c in "abcy"])
    return np.stack([np.ones(t.num_rows), *(t.column(c).to_numpy() for c in "abc")], 1), t.column("y").to_numpy()


def _fit(x: np.ndarray, y: np.ndarray, steps: int = 50) -> np.ndarray:
    """Logistic regression by Newton steps, with a small ridge."""
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        ridge = np.full(x.shape[1], 0.01)
        w = w - np.linalg.solve((x.T * (p * (1 - p) + 1e-6)) @ x + np.diag(ridge), x.T @ (p - y) + ridge * w)
    return w


def score(docs: DataFrame, lexicon: Lexicon, text: str = "text", out: str = "score") -> DataFrame:
    """docs with the probability that a text is toxic; null and empty texts get that of a text without matches.

    Narrow: the lexicon (of bounded size) is broadcast, texts are read whole.  Case is ignored for ASCII and Latin-1.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)
    kept = docs.drop(out)
    schema = kept.withColumn(out, F.lit(0.0)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        matcher = matcher_of(known)
        for whole in batches:
            for batch in ts.slices(whole, text, ts.SEGMENT):
                x = windows(*ts.column_bytes(batch.column(batch.schema.get_field_index(text))), matcher)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(1 / (1 + np.exp(-np.clip(x @ known.layer, -30, 30))))], [*batch.schema.names, out])

    return kept.mapInArrow(ts.thrifty(run), schema)
