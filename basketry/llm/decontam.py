"""Benchmark decontamination: every passage is a query to a BM25 index of the test items.

Weights are divided by an item's own total, so that a score is the share of the item that a passage accounts for and
one threshold serves items of all lengths.  Retrieval is block-max WAND over posting lists in item order, cut into
blocks of items: a query's frequent terms, whose greatest weights together stay below a part of the threshold, count as a
constant; the block maxima of its other terms are summed, and only blocks whose sum reaches the threshold are live.  WAND's
cursors move over the lists from live block to live block.  Every item retrieved is then verified: enough n-grams of
its question and of its answer must be in the passage.

Passages are windows of words that overlap by half; half a window is a power of two and as long as the item, so every whole
item lies in one.  Items of one such length go to shards of bounded size, which executors build and which are
broadcast one at a time.  Frequencies and the mean length are those of all items: a score doesn't depend on the shards.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.llm import textscan as ts
from basketry.llm.common import small_batches, unused, written

K1, B = 1.2, 0.75
#: Items in a block.
BLOCK = 4
#: The part of the threshold that a query's frequent terms may reach together.
FREQUENT = 0.1
#: Words of half a passage, if its items aren't longer.
HALF = 64
NGRAM = 5
#: Items and bytes of items in a shard of the index, on average.
SHARD_ITEMS, SHARD_BYTES = 20_000, 16_000_000


def split_item(text: str) -> tuple[str, str]:
    """Question and answer: the answer is the last line, or else the last sentence, if anything stands before it."""
    body = text.strip()
    head, _, tail = body.rpartition("\n")
    if not head.strip():
        m = re.match(r"(.*[.?!])\s+(\S.*)$", body, re.DOTALL)
        head, tail = (m[1], m[2]) if m else (body, "")
    return head.strip(), tail.strip()


def terms(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, and the text each is in."""
    raw = [t.encode() for t in texts]
    data = ts.folded(np.frombuffer(b"".join(raw), np.uint8))
    starts, ends, doc = ts.words(data, np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64), ts.NOT_ALNUM)
    return ts.word_hashes(data, starts, ends), doc


def grams(words: np.ndarray) -> np.ndarray:
    """Hashes of the distinct n-grams of NGRAM words, or of all words if these are fewer."""
    n = min(NGRAM, len(words))
    return np.unique(ts.sequence_hashes(words, n)) if n else np.zeros(0, np.uint64)


@dataclass
class Index:
    ids: list
    vocabulary: np.ndarray  # sorted hashes
    edge: np.ndarray  # of each term's list in items and weights
    items: np.ndarray
    weights: np.ndarray
    top: np.ndarray  # greatest weight of each list
    block_edge: np.ndarray  # of each term's blocks in blocks and maxima
    blocks: np.ndarray
    maxima: np.ndarray
    question: list[np.ndarray]
    answer: list[np.ndarray]
    shortest: list[tuple[int, int]]  # words of an n-gram of question and answer
    half: int

    @classmethod
    def build(cls, ids: list, texts: list[str], known: tuple[np.ndarray, np.ndarray, int, float] | None = None, half: int | None = None) -> Index:
        """known: terms and their frequencies in all items, the number of items and their mean length; by default those of texts."""
        hashes, doc = terms(texts)
        vocabulary, term = np.unique(hashes, return_inverse=True)
        n, length = len(texts), np.bincount(doc, minlength=len(texts))
        pair, tf = np.unique(term.astype(np.int64) * n + doc, return_counts=True) if len(term) else (np.zeros(0, np.int64), np.zeros(0))
        t, d = pair // max(n, 1), pair % max(n, 1)
        df, total, mean = np.bincount(t, minlength=len(vocabulary)), n, float(length.mean()) if n else 0.0
        if known is not None:
            df, total, mean = known[1][np.searchsorted(known[0], vocabulary)], known[2], known[3]
        idf = np.log(1 + (total - df + 0.5) / (df + 0.5))
        weight = idf[t] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[d] / max(mean, 1e-9)))
        weight = weight / np.bincount(d, weight, n)[d] if n else weight
        edge = np.searchsorted(t, np.arange(len(vocabulary) + 1))
        new = np.flatnonzero(np.diff(t * (n // BLOCK + 1) + d // BLOCK, prepend=-1))
        parts = [split_item(x) for x in texts]
        sides = []
        for k in (0, 1):
            h, of = terms([p[k] for p in parts])
            at = np.searchsorted(of, np.arange(n + 1))
            sides.append([h[at[i] : at[i + 1]] for i in range(n)])
        return cls(
            ids, vocabulary, edge, d, weight, np.maximum.reduceat(weight, edge[:-1]) if len(t) else weight, np.searchsorted(new, edge), d[new] // BLOCK, np.maximum.reduceat(weight, new) if len(new) else weight,
            [grams(x) for x in sides[0]], [grams(x) for x in sides[1]], [(min(NGRAM, len(a)), min(NGRAM, len(b))) for a, b in zip(*sides, strict=True)], half or half_of(int(length.max(initial=0))),
        )

    def live(self, passage: np.ndarray, term: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
        """Passages and their live blocks, in order, from the distinct terms of each passage (in order of passages)."""
        order = np.lexsort((self.top[term], passage))
        passage, term = passage[order], term[order]
        top = self.top[term]
        first = np.flatnonzero(np.diff(passage, prepend=-1))
        running = np.cumsum(top)
        running -= np.repeat(running[first] - top[first], np.diff(np.append(first, len(passage))))
        frequent = running <= FREQUENT * threshold
        constant = np.bincount(passage, np.where(frequent, top, 0.0), int(passage.max(initial=0)) + 1)
        passage, term = passage[~frequent], term[~frequent]
        count = self.block_edge[term + 1] - self.block_edge[term]
        at = ts.ragged(self.block_edge[term], count)
        key = np.repeat(passage, count) * (len(self.ids) // BLOCK + 1) + self.blocks[at]
        order = np.argsort(key, kind="stable")
        start = np.flatnonzero(np.diff(key[order], prepend=-1))
        bound = np.add.reduceat(self.maxima[at][order], start) if len(start) else np.zeros(0)
        key = key[order][start]
        of = key // (len(self.ids) // BLOCK + 1)
        some = bound + constant[of] >= threshold - 1e-9
        return of[some], key[some] % (len(self.ids) // BLOCK + 1)

    def retrieve(self, query: np.ndarray, threshold: float, live: np.ndarray | None = None) -> list[tuple[int, float]]:
        """Items whose weights of the query's distinct terms sum to the threshold or more, by block-max WAND.

        live: the blocks that may hold such items, in order; found from the block maxima if not given.
        """
        if live is None:
            live = self.live(np.zeros(len(query), np.int64), query, threshold)[1]
        live = live.tolist()
        cursors: list[list[int]] = []  # item, place in items, term

        def moved(goal: int, part: list[list[int]]) -> list[list[int]]:
            """The cursors at the first item from goal on."""
            out = []
            for item, at, t in part:
                if item < goal:
                    at += int(np.searchsorted(self.items[at : self.edge[t + 1]], goal))
                    if at >= self.edge[t + 1]:
                        continue
                    item = int(self.items[at])
                out.append([item, at, t])
            return out

        found: list[tuple[int, float]] = []
        if not live:
            return found
        cursors = moved(live[0] * BLOCK, [[-1, int(self.edge[t]), t] for t in query.tolist()])
        block = 0
        while cursors:
            cursors.sort()
            bound, pivot = 0.0, -1
            for k, (_, _, t) in enumerate(cursors):
                bound += self.top[t]
                if bound >= threshold - 1e-9:
                    pivot = k
                    break
            if pivot < 0:
                break
            item = cursors[pivot][0]
            while block < len(live) and live[block] < item // BLOCK:
                block += 1
            if block == len(live):
                break
            if live[block] > item // BLOCK:  # no item of the pivot's block can reach the threshold
                cursors = moved(live[block] * BLOCK, cursors)
                continue
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == item:
                pivot += 1
            if cursors[0][0] == item:
                score = sum(float(self.weights[at]) for _, at, _ in cursors[: pivot + 1])
                if score >= threshold - 1e-9:
                    found.append((item, score))
                item += 1
            cursors = [*moved(item, cursors[: pivot + 1]), *cursors[pivot + 1 :]]
        return found

    def overlaps(self, item: int, words: np.ndarray) -> tuple[float, float]:
        """Shares of the question's and the answer's n-grams among those of the words."""
        out = []
        for side, n in zip((self.question[item], self.answer[item]), self.shortest[item], strict=True):
            out.append(float(np.isin(side, ts.sequence_hashes(words, n)).mean()) if n else 1.0)
        return out[0], out[1]


def half_of(words: int) -> int:
    """Words of half a passage for an item of so many words."""
    return max(HALF, 1 << max(words - 1, 0).bit_length())


def search(index: Index, data: np.ndarray, offsets: np.ndarray, threshold: float, least: tuple[float, float]) -> dict[tuple[int, int], tuple[float, float, float]]:
    """(text, item): score and overlaps of the best passage, of items that are verified."""
    low = ts.folded(data)
    starts, ends, doc = ts.words(low, offsets, ts.NOT_ALNUM)
    if not len(starts) or not len(index.vocabulary):
        return {}
    words = ts.word_hashes(low, starts, ends)
    first = np.searchsorted(doc, np.arange(len(offsets)))
    at = np.minimum(np.searchsorted(index.vocabulary, words), len(index.vocabulary) - 1)
    hit = np.flatnonzero(index.vocabulary[at] == words)
    if not len(hit):
        return {}
    term, of = at[hit], doc[hit]
    # passages of all texts are numbered in a row; the words of half k are in passages k - 1 and k
    halves = (np.diff(first) + index.half - 1) // index.half
    base = np.concatenate([[0], np.cumsum(halves)])
    k = base[of] + (hit - first[of]) // index.half
    before = k > base[of]
    key = np.unique(np.concatenate([k, k[before] - 1]) * len(index.vocabulary) + np.concatenate([term, term[before]]))
    passage, term = key // len(index.vocabulary), key % len(index.vocabulary)
    rough = np.bincount(passage, index.top[term], base[-1]) >= threshold - 1e-6
    pick = rough[passage]
    passage, term = passage[pick], term[pick]
    found: dict[tuple[int, int], tuple[float, float, float]] = {}
    if not len(passage):
        return found
    edge = np.flatnonzero(np.concatenate([[True], passage[1:] != passage[:-1], [True]]))
    for a in range(0, len(edge) - 1, 4096):
        b = min(len(edge) - 1, a + 4096)
        mine = slice(edge[a], edge[b])
        whose, block = index.live(np.repeat(np.arange(b - a), np.diff(edge[a : b + 1])), term[mine], threshold)
        cut = np.flatnonzero(np.diff(whose, prepend=-1, append=-1))
        for x, y in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            i = a + int(whose[x])
            p = passage[edge[i]]
            d = int(np.searchsorted(base, p, "right")) - 1
            begin = first[d] + (p - base[d]) * index.half
            near = words[begin : min(begin + 2 * index.half, first[d + 1])]
            for item, score in index.retrieve(term[edge[i] : edge[i + 1]], threshold, block[x:y]):
                q, r = index.overlaps(item, near)
                if q >= least[0] and r >= least[1] and (score, q, r) > found.get((d, item), (0.0, 0.0, 0.0)):
                    found[d, item] = (score, q, r)
    return found


def indexes(items: DataFrame, key: str, text: str) -> DataFrame:
    """Indexes of all items, pickled, one a row (half, index), each of bounded size and built by a task.

    Items without words match nothing; equal items are all kept.
    """
    spark = items.sparkSession
    small_batches(spark)
    known = items.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    kind = known.schema["k"].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, doc = terms(batch.column(1).to_pylist())
            length = np.bincount(doc, minlength=batch.num_rows)
            pairs = np.unique(np.stack([doc.astype(np.uint64), hashes], 1), axis=0)
            at = np.searchsorted(pairs[:, 0], np.arange(batch.num_rows + 1))
            own = [pairs[at[i] : at[i + 1], 1].view(np.int64) for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own, pa.list_(pa.int64())), pa.array(length, pa.int64())], ["k", "t", "terms", "words"])

    counted = written(known.mapInArrow(ts.thrifty(count), f"k {kind}, t string, terms array<long>, words long").filter("words > 0").withColumn("id", F.monotonically_increasing_id()))
    n, mean, size = counted.agg(F.count(F.lit(1)), F.avg("words"), F.sum(F.octet_length("t"))).first()
    shards = max(1, -(-n // SHARD_ITEMS), -(-(size or 0) // SHARD_BYTES))
    frequency = counted.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    placed = counted.withColumns({"half": F.greatest(F.lit(HALF), F.expr("shiftleft(1, length(bin(words - 1)))")), "shard": F.pmod(F.xxhash64("id"), F.lit(shards))})
    both = placed.select("half", "shard", "id", F.explode("terms").alias("term")).join(frequency, "term").groupBy("half", "shard", "id").agg(F.collect_list(F.struct("term", "df")).alias("df"))

    def build(group: pa.Table) -> pa.Table:
        group = group.sort_by("id")
        pairs = group.column("df").combine_chunks().flatten()
        term, first = np.unique(pairs.field("term").to_numpy().view(np.uint64), return_index=True)
        index = Index.build(group.column("k").to_pylist(), group.column("t").to_pylist(), (term, pairs.field("df").to_numpy()[first], n, mean), group.column("half")[0].as_py())
        return pa.table({"half": group.column("half").slice(0, 1), "index": pa.array([pickle.dumps(index)], pa.binary())})

    whole = placed.select("half", "shard", "id", "k", "t").join(both, ["half", "shard", "id"])
    return written(whole.groupBy("half", "shard").applyInArrow(build, "half int, index binary"))


def matches(docs: DataFrame, items: DataFrame, text: str = "text", item_key: str = "item_id", item_text: str = "text", threshold: float = 0.5, least: tuple[float, float] = (0.6, 0.6), out: str = "leaks") -> DataFrame:
    """docs with the test items that each text holds: an array of (item, score, question, answer), by item, empty if none.

    An item is found if some passage's share of its BM25 weight is threshold or more and the passage has at least these
    shares of the n-grams of its question and its answer.  Null and empty texts hold none.  Narrow; whole texts.  A column
    named as out is replaced.  With several indexes, docs are written after each but the last, so that a task holds one.
    """
    small_batches(docs.sparkSession)
    leak = f"array<struct<item:{items.schema[item_key].dataType.simpleString()},score:double,question:double,answer:double>>"
    made = unused(docs, "leaks")
    found = docs.drop(out).withColumn(made, F.array().cast(leak))
    number = 0
    for row in indexes(items, item_key, item_text).toLocalIterator():
        found = _with(written(found) if number else found, pickle.loads(row["index"]), text, threshold, least, made)
        number += 1
    return found.withColumn(made, F.array_sort(made)).withColumnRenamed(made, out)


def _with(docs: DataFrame, index: Index, text: str, threshold: float, least: tuple[float, float], out: str) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for whole in batches:
            for batch in ts.slices(whole, text, ts.SEGMENT):
                names = batch.schema.names
                at = names.index(out)
                leaks = batch.column(at).to_pylist()
                for (d, item), (score, q, a) in sorted(search(known, *ts.column_bytes(batch.column(names.index(text))), threshold, least).items()):
                    leaks[d] = [*leaks[d], {"item": known.ids[item], "score": score, "question": q, "answer": a}]
                yield pa.RecordBatch.from_arrays([*(c for i, c in enumerate(batch.columns) if i != at), pa.array(leaks, batch.schema.field(at).type)], names)

    return docs.mapInArrow(ts.thrifty(run), docs.schema)
