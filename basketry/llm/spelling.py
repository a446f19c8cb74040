"""Groups of spelling variants: words at distance one, found by intersecting Levenshtein automata with tries.

The words of the corpus, counted by Spark, are dealt to shards of bounded size, each built into a compact trie by a task.  A few shards at a time are broadcast, and each
word's automaton of distance one walks every one of them depth-first.  What a walk finds is reduced to a count and a best form at once.
"""

from __future__ import annotations

import itertools
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.llm import textscan as ts
from basketry.llm.common import small_batches, written

#: Runs of letters that are words, and the capitals that are lower-cased.
RUN, CAPITALS = "[A-Za-z\\u00C0-\\u00FF]+", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Letters of the words of a shard.  A trie takes some 28 bytes a letter at most, half of that where words share beginnings.
SHARD_LETTERS = 4_000_000
#: Bytes of the tries that are broadcast at a time, but for a single one that is larger.
GROUP_BYTES = 64 << 20
#: States of the walks that take a step together, and words that set out together.
BLOCK, WORDS = 1 << 17, 4096


def _automaton() -> list[int]:
    """Moves of the automaton of distance one, whatever the word.

    A state has two sets of three places each, around as many letters of the word as the trie's path is long: one letter behind it, level with it, one ahead.
    Bits 0 to 2 are places reached without an error, bits 3 to 5 those with one.  Entry 8 * state + seen is the next state, where
    seen tells at which of the three places the word goes on with the trie's letter.
    """
    moves = []
    for state in range(64):
        clean, failed = state & 7, state >> 3
        for seen in range(8):
            matched = clean & seen
            # a letter too many stays in its place, a letter replaced goes on, a letter left out goes one further
            wrong = (failed & seen) | (clean >> 1) | clean | (matched << 1 & 7)
            moves.append(matched | wrong << 3)
    return moves


MOVES = np.array(_automaton())
#: Before any letter: level without an error, one ahead with one.
START = 0b010 | 0b100 << 3


class Trie:
    """Sorted distinct words with a number each.  Nodes are numbered level by level, so a node's children lie side by side and edges are sorted by node and letter:
    ``labels[first[n]:first[n + 1]]`` are the letters of node n's children and ``first[n] + 1`` is the first of these."""

    def __init__(self, words: list[str], counts: list[int]) -> None:
        self.words, self.counts = words, np.array(counts, np.int64)
        shared = np.array([0, *(_common(a, b) for a, b in itertools.pairwise(words))][: len(words)], np.int64)
        codes, start, length = _codes(words)
        new = length - shared
        word = np.repeat(np.arange(len(words)), new)
        depth = ts.ragged(shared, new)
        order = np.argsort(depth, kind="stable")
        word, depth = word[order], depth[order]
        self.labels = codes[start[word] + depth].astype(np.uint32)
        self.entry = np.concatenate([[0 if words and not words[0] else -1], np.where(depth + 1 == length[word], word, -1)]).astype(np.int32)
        level = np.searchsorted(depth, np.arange(int(depth.max(initial=-1)) + 2))
        children = np.zeros(len(word) + 1, np.int64)
        children[0] = level[1] if len(level) > 1 else 0
        for low, high, end in zip(level[:-2].tolist(), level[1:-1].tolist(), level[2:].tolist(), strict=True):
            parent = np.searchsorted(word[low:high], word[high:end], "right") + low
            children[low + 1 : high + 1] = np.bincount(parent - low - 1, minlength=high - low)
        self.first = np.concatenate([[0], np.cumsum(children)]).astype(np.uint32)
        #: For each node a bit for each of its children's letters, modulo 64.
        self.seen = np.zeros(len(self.first) - 1, np.uint64)
        np.bitwise_or.at(self.seen, np.repeat(np.arange(len(children)), children), np.uint64(1) << (self.labels % 64).astype(np.uint64))
        self.edges = np.repeat(np.arange(len(children)), children) << 21 | self.labels.astype(np.int64)

    def near(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (number of the word given, entry) of words at distance one exactly, in code points.

        The walks of the words go depth-first in blocks: a block of states takes one step together, and of what comes of it
        BLOCK states at a time go on before others do.
        """
        codes, start, length = _codes(words)
        codes = np.append(codes, 0)
        none = np.zeros(0, np.int64)
        found: list[tuple[np.ndarray, np.ndarray]] = [(none, none)]
        n = len(words)
        stack = [(np.arange(n), np.zeros(n, np.int64), np.zeros(n, np.int64), np.full(n, START, np.int64))]
        while stack:
            of, node, depth, state = stack.pop()
            if len(of) > BLOCK:
                stack.append((of[BLOCK:], node[BLOCK:], depth[BLOCK:], state[BLOCK:]))
                of, node, depth, state = of[:BLOCK], node[:BLOCK], depth[:BLOCK], state[:BLOCK]
            bit = length[of] - depth + 1
            at_end = (self.entry[node] >= 0) & (bit >= 0) & (bit <= 2)
            place = np.clip(bit, 0, 2)
            at_end &= (state >> (3 + place) & 1 == 1) & (state >> place & 1 == 0)
            found.append((of[at_end], self.entry[node[at_end]].astype(np.int64)))
            ahead = np.stack([_letter(codes, start, length, of, depth + k) for k in (-1, 0, 1)])
            clean = np.flatnonzero(state & 7)
            low = self.first[node[clean]].astype(np.int64)
            size = self.first[node[clean] + 1] - low
            mine, edge = np.repeat(clean, size), ts.ragged(low, size)
            # with an error made, only the word's own letters lead on
            failed = np.flatnonzero(state & 7 == 0)
            mines, edges = [mine], [edge]
            for k in range(3):
                some = failed[(state[failed] >> (3 + k) & 1 == 1) & (ahead[k, failed] > 0)]
                for j in range(k):
                    some = some[(ahead[j, some] != ahead[k, some]) | (state[some] >> (3 + j) & 1 == 0)]
                some = some[self.seen[node[some]] >> (ahead[k, some] % 64).astype(np.uint64) & np.uint64(1) == 1]
                key = node[some] << 21 | ahead[k, some]
                i = np.minimum(np.searchsorted(self.edges, key), max(len(self.edges) - 1, 0))
                there = self.edges[i] == key if len(self.edges) else np.zeros(len(some), bool)
                mines.append(some[there])
                edges.append(i[there])
            mine, edge = np.concatenate(mines), np.concatenate(edges)
            letter = self.labels[edge]
            sees = sum((ahead[k, mine] == letter).astype(np.int64) << k for k in range(3))
            after = MOVES[state[mine] << 3 | sees]
            alive = after > 0
            if alive.any():
                stack.append((of[mine[alive]], edge[alive] + 1, depth[mine[alive]] + 1, after[alive]))
        of, entry = (np.concatenate(x) for x in zip(*found, strict=True))
        return of, entry


def _common(a: str, b: str) -> int:
    n = min(len(a), len(b))
    return next((i for i in range(n) if a[i] != b[i]), n)


def _codes(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words' code points end to end, and where each starts and how long it is."""
    length = np.array([len(w) for w in words], np.int64)
    return np.frombuffer("".join(words).encode("utf-32-le"), "<u4").astype(np.int64), np.cumsum(length) - length, length


def _letter(codes: np.ndarray, start: np.ndarray, length: np.ndarray, of: np.ndarray, place: np.ndarray) -> np.ndarray:
    inside = (place >= 0) & (place < length[of])
    return np.where(inside, codes[np.where(inside, start[of] + place, len(codes) - 1)], 0)


def words(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = 6, damage: int = 199) -> DataFrame:
    """Each distinct word of at least so many code points, and n, how often it is there.

    Words are the maximal runs of letters, A-Z lower-cased.  A run loses the code point h % length where damage divides h, the CRC-32 of ``<key>:<run>``; damage=0
    leaves all as they are.  A null key is an empty text there.  Null and empty texts have no words; equal rows count once each.
    """
    run = F.translate(F.col("r"), CAPITALS, CAPITALS.lower())
    runs = docs.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("k"), F.explode(F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(RUN), F.lit(0))).alias("r")).select("k", run.alias("r"))
    word = F.col("r")
    if damage:
        h = F.crc32(F.concat("k", F.lit(":"), "r").cast("binary"))
        at = (h % F.char_length("r")).cast("int")
        word = F.when(h % damage == 0, F.concat(F.substring("r", F.lit(1), at), F.substring("r", at + 2, F.char_length("r")))).otherwise(word)
    return runs.select(word.alias("word")).filter(F.char_length("word") >= least).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def tries(vocabulary: DataFrame) -> DataFrame:
    """shard, size and trie (pickled) of shards of the vocabulary (word, n), dealt by a hash of the word so that none grows with it."""
    letters = vocabulary.agg(F.sum(F.char_length("word"))).first()[0] or 0
    shards = int(letters // SHARD_LETTERS) + 1

    def build(group: pa.Table) -> pa.Table:
        rows = sorted(zip(group.column("word").to_pylist(), group.column("n").to_pylist(), strict=True))
        raw = pickle.dumps(Trie([w for w, _ in rows], [n for _, n in rows]))
        return pa.table({"shard": [group.column("shard")[0].as_py()], "size": [len(raw)], "trie": [raw]}, schema=pa.schema([("shard", pa.int32()), ("size", pa.int64()), ("trie", pa.binary())]))

    dealt = vocabulary.select("word", "n", F.pmod(F.xxhash64("word"), F.lit(shards)).cast("int").alias("shard"))
    return dealt.groupBy("shard").applyInArrow(build, "shard int, size long, trie binary")


def neighbours(vocabulary: DataFrame) -> DataFrame:
    """word, n_near, and best (n and form) of each word that has words at distance one."""
    spark = vocabulary.sparkSession
    small_batches(spark)
    shards = written(tries(vocabulary))
    groups, room = [[]], 0
    for r in shards.select("shard", "size").orderBy("shard").collect():
        if groups[-1] and room + r["size"] > GROUP_BYTES:
            groups.append([])
            room = 0
        groups[-1].append(r["shard"])
        room += r["size"]
    found = []
    for group in groups:
        shared = spark.sparkContext.broadcast([r["trie"] for r in shards.filter(F.col("shard").isin(group)).select("trie").collect()])

        def walk(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            held = [pickle.loads(raw) for raw in shared.value]
            for batch in ts.gathered(batches, "word", WORDS * 8):
                words = batch.column(0).to_pylist()
                for trie in held:
                    of, entry = trie.near(words)
                    # the most frequent first, then in code-point order, which is that of the entries
                    order = np.lexsort((entry, -trie.counts[entry], of))
                    of, entry = of[order], entry[order]
                    lead, hits = np.unique(of, return_index=True, return_counts=True)[1:]
                    best = entry[lead]
                    yield pa.RecordBatch.from_arrays([pa.array([words[i] for i in of[lead]], pa.string()), pa.array(hits, pa.int64()), pa.array(trie.counts[best], pa.int64()), pa.array([trie.words[i] for i in best], pa.string())], ["word", "hits", "n", "form"])

        found.append(written(vocabulary.select("word").mapInArrow(walk, "word string, hits long, n long, form string")))
        shared.destroy()
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    return every.groupBy("word").agg(F.sum("hits").alias("n_near"), F.min(F.struct((-F.col("n")).alias("less"), "form")).alias("best")).select("word", "n_near", F.struct((-F.col("best.less")).alias("n"), "best.form").alias("best"))


def group(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = 6, seen: int = 5, times: int = 5, damage: int = 199) -> DataFrame:
    """Per word of ``words`` seen so often: word, n, n_near (words at distance one), form, form_n and root.

    The form is the near word with the largest n, ties to the smallest in code-point order, if that n is at least so many times the word's; else null.  The root is
    what the forms lead to in the end, the word itself if it has none.  A form is always seen more often than its word, so forms never lead back.
    """
    vocabulary = written(words(docs, key, text, least, damage).filter(F.col("n") >= seen))
    near = neighbours(vocabulary)
    chosen = F.col("best.n") >= times * F.col("n")
    full = written(vocabulary.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(chosen, F.col("best.form")).alias("form"), F.when(chosen, F.col("best.n")).alias("form_n")))
    roots = full.filter("form is not null").select("word", F.col("form").alias("root"))
    # each round doubles the length of the way that a root stands for
    while True:
        onward = roots.select(F.col("word").alias("root"), F.col("root").alias("further"))
        step = written(roots.join(onward, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        roots = step.select("word", "root")
        if step.filter("moved").isEmpty():
            break
    return full.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
