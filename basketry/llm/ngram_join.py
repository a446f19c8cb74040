"""Exact Jaccard join of documents on their sets of word n-grams, by PartEnum signatures.

Sizes form bands [l, l / t].  Two sets of similarity t have sizes in one band or in neighbouring ones, so a set signs for its
own band and for the one above.  Sets of a band that reach t differ in k elements at most.  The domain of n-gram hashes is cut
into n1 parts, each of these into three smaller ones, and of these all subsets of two are enumerated: a signature is the
hash of what a set has in two of the three.  A part in which two sets differ in one element at most gives a common
signature, and so many parts must be like that, that a link has ``need`` signatures in common: with d differences,
3 * n1 - 2 * d of them, or 2 * n1 - d if d exceeds n1, less those subsets in which the set has nothing, which aren't signed.
Sets for which this leaves none sign again by other cuts of the domain, and those for which three cuts leave none by
their elements: of two such sets, both do, so nothing is left to chance.

A signature that few sets share gives all their pairs.  One that many share gives a star around one of them, and another star
around a second one.  What stars leave apart is found in three steps, each without loss: signatures whose sets are all
in one component by now are done; a set that has fewer of the others than ``need`` can't lose a link; and the sets that
remain are joined by their rarest elements, between components only, each component's sets against those of the lesser
ones.  That goes in rounds: one link joins a set to a component, so a set meets a few sets of a large component first, and all
of them only if it has no link with these.  Pairs found by fewer signatures than any link shares are dropped; of each of the others a byte an element is
compared first, which gives no less in common than there is, and what may reach the threshold by that is verified on the sets, unless its ends are in one component by then.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basketry.llm import textscan as ts
from basketry.llm.common import buckets_for, content_key, small_batches, text_or_empty, unused, written
from basketry.llm.components import components

#: First-level parts of the domain, as a share of the greatest number of differences; half of it is the least that finds all.
PARTS = 0.7
#: Cuts of the domain that a set signs by, one after the other, before it signs elements.
CUTS = 3
#: A signature of so many sets at most gives all pairs of them.
FEW = 8
#: Bits of the filter that keeps texts without a candidate out of the verification: at most 32 MB are broadcast.
FILTER_BITS = 1 << 28
BATCH = 1 << 20
#: Elements of a set that a row of it carries to see whether a pair was made before: what is written grows with a set's size, not its square.
BEFORE = 64
#: What stars leave apart meets one in so many sets of a component that has more than LARGE, then more of them, then all.
ROUNDS = (16, 4, 1)
LARGE = 200
#: Names of sets that a task remembers to have signed.
SIGNED = 500_000
#: How many places the brief form of a set has for each element, at least: steps between them fit a byte then, but for a few.
SPARSE = 64


def shingles(data: np.ndarray, offsets: np.ndarray, n: int, key: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Text and hash of each distinct n-gram of lower-cased words; a text of fewer words has its whole sequence."""
    low = ts.LOWER[data]
    starts, ends, doc = ts.words(low, offsets)
    words = ts.word_hashes(low, starts, ends, key)
    rolled = ts.sequence_hashes(words, n, key)
    inside = np.flatnonzero(doc[: len(rolled)] == doc[n - 1 :]) if len(rolled) else np.zeros(0, np.int64)
    count = np.bincount(doc, minlength=len(offsets) - 1)
    first = np.concatenate([[0], np.cumsum(count)])
    short = np.flatnonzero((count > 0) & (count < n))
    whole = [int(ts.sequence_hashes(words[first[i] : first[i + 1]], int(count[i]), key + int(count[i]))[0]) for i in short]
    docs = np.concatenate([doc[inside], short])
    hashes = np.concatenate([rolled[inside], np.array(whole, np.uint64)])
    order = np.argsort(hashes)
    order = order[np.argsort(docs[order].astype(np.uint16) if len(offsets) <= 65536 else docs[order], kind="stable")]
    docs, hashes = docs[order], hashes[order]
    new = np.ones(len(docs), bool)
    new[1:] = (docs[1:] != docs[:-1]) | (hashes[1:] != hashes[:-1])
    return docs[new], hashes[new]


def bands(threshold: Fraction, largest: int) -> np.ndarray:
    """Greatest size of each band, until one holds the largest size."""
    highs, low = [], 1
    while not highs or highs[-1] < largest:
        highs.append(max(low, low * threshold.denominator // threshold.numerator))
        low = highs[-1] + 1
    return np.array(highs)


def set_names(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A name for each set: a hash of its elements in any order, and its size."""
    edge = np.concatenate([[0], np.cumsum(sizes)])
    one, two = (np.concatenate([[np.uint64(0)], np.cumsum(ts.mix(hashes ^ np.uint64(c)))]) for c in (0x5851F42D4C957F2D, 0x14057B7EF767814F))
    return ts.mix((one[edge[1:]] - one[edge[:-1]]) ^ ts.mix((two[edge[1:]] - two[edge[:-1]]) + sizes.astype(np.uint64))).view(np.int64)


def signatures(hashes: np.ndarray, sizes: np.ndarray, threshold: Fraction) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Per band and cut: signatures and their sets; and for each set the group (band and cut) and how many
    signatures of the group any link of it has in common with it at least.
    """
    num, den = threshold.numerator, threshold.denominator
    partner = sizes * den // num
    highs = bands(threshold, int(partner.max(initial=1)))
    highs = np.append(highs, highs[-1] * den // num + 1)
    own = np.searchsorted(highs, sizes)
    edge = np.concatenate([[0], np.cumsum(sizes)])
    for up in (0, 1):
        band = own + up
        high = highs[band]
        differ = (sizes + np.minimum(partner, high)) * (den - num) // (den + num)
        most = 2 * high * (den - num) // (den + num)
        parts = np.maximum(most // 2 + 1, np.ceil(PARTS * most).astype(np.int64))
        base = np.where(differ <= parts, 3 * parts - 2 * differ, 2 * parts - differ)
        active = np.flatnonzero((sizes > 0) & ((up == 0) | (partner > highs[own])))
        for cut in range(CUTS + 1):
            if not len(active):
                break
            owner = np.repeat(active, sizes[active])
            element = hashes[ts.ragged(edge[active], sizes[active])] if len(active) < len(sizes) else hashes
            salt = ts.mix((band * 8 + cut + 1).astype(np.uint64))
            group = band * 8 + cut
            if cut == CUTS:
                yield ts.mix(element ^ salt[owner]), owner, group, -(-sizes * num // den)
                break
            at = np.zeros(len(sizes) + 1, np.int64)
            at[active + 1] = 3 * parts[active]
            at = np.cumsum(at)
            n = (3 * parts)[owner].astype(np.uint64)
            place = at[owner] + ((ts.mix(element ^ np.uint64(0x2545F4914F6CDD1D + cut)) >> np.uint64(32)) * n >> np.uint64(32)).astype(np.int64)
            sums = np.zeros(at[-1], np.uint64)
            np.add.at(sums, place, ts.mix(element))
            sums = sums.reshape(-1, 3)
            filled = np.bincount(place, minlength=at[-1]).reshape(-1, 3) > 0
            of = np.repeat(active, parts[active])
            number = (np.arange(len(of)) - at[of] // 3).astype(np.uint64) * np.uint64(3)
            signs, owners, empty = [], [], np.zeros(len(sizes), np.int64)
            for left_out in range(3):
                a, b = (left_out + 1) % 3, (left_out + 2) % 3
                some = filled[:, a] | filled[:, b]
                mine = of[some]
                signs.append(ts.mix(sums[some, a] + sums[some, b] + ts.mix(number[some] + np.uint64(left_out) + salt[mine])))
                owners.append(mine)
                empty += np.bincount(of[~some], minlength=len(sizes))
            need = base - empty
            yield np.concatenate(signs), np.concatenate(owners), group, np.maximum(need, 1)
            active = active[need[active] < 1]


def _sets(batches: Iterator[pa.RecordBatch], n: int, key: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """Batch, hashes, sizes and names of its sets."""
    for batch in ts.gathered(batches, "__text", BATCH):
        docs, hashes = shingles(*ts.column_bytes(batch.column(batch.schema.get_field_index("__text"))), n, key)
        sizes = np.bincount(docs, minlength=batch.num_rows)
        yield batch, hashes, sizes, set_names(hashes, sizes)


def _filter(nodes: DataFrame, column: str) -> Broadcast:
    """A bit for each value of the column, which holds hashes: bounded, and all that is broadcast."""
    size = 1 << 20
    while size < min(16 * nodes.count(), FILTER_BITS):
        size *= 2
    at = F.pmod(F.col(column), F.lit(size)) + 1
    rows = nodes.groupBy(F.bitmap_bucket_number(at).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits")).collect()
    bits = np.zeros((size // 32768, 4096), np.uint8)
    for r in rows:
        bits[r["b"] - 1] = np.frombuffer(r["bits"], np.uint8)
    return nodes.sparkSession.sparkContext.broadcast(bits.ravel())


def _passes(shared: Broadcast, names: np.ndarray) -> np.ndarray:
    bits = shared.value
    at = np.mod(names, 8 * len(bits))
    return (bits[at // 8] >> (at % 8).astype(np.uint8)) & 1 == 1


def described(docs: DataFrame, text: str, n: int, key: int) -> DataFrame:
    """docs with __hash (of the text), n_shingles and __set (name of the set)."""
    small_batches(docs.sparkSession)
    kept = docs.select(*[c for c in docs.columns if c != text], text_or_empty(text).alias("__text")).withColumn("__hash", F.xxhash64("__text"))
    columns = [c for c in kept.columns if c != "__text"]
    schema = kept.select(*columns, F.lit(0).cast("long").alias("n_shingles"), F.lit(0).cast("long").alias("__set")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _, sizes, names in _sets(batches, n, key):
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in columns), pa.array(sizes, pa.int64()), pa.array(names)], [*columns, "n_shingles", "__set"])

    return kept.mapInArrow(ts.thrifty(run), schema)


#: What a bucket of signatures says.  A pair x < y of sets: the group it was found in, by how many signatures (n), and how many of
#: these (hot) are shared by many sets, x being the star's centre; qx, qy: what any link of either needs.  Or, with a post, that
#: set y is one of many that share the signature, x the star's centre, size y's.
FOUND = "post long, x long, y long, grp int, n int, hot int, qx int, qy int, size int"


def _found(texts: DataFrame, n: int, threshold: Fraction, buckets: int, key: int) -> DataFrame:
    num, den = threshold.numerator, threshold.denominator

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signed: set[int] = set()
        for _, hashes, sizes, names in _sets(batches, n, key):
            # of equal sets in a task, one signs: copies of one text don't fill a bucket
            _, one = np.unique(names, return_index=True)
            if len(signed) > SIGNED:
                signed.clear()
            one = np.array(sorted(i for i in one.tolist() if sizes[i] and names[i] not in signed), np.int64)
            if not len(one):
                continue
            signed.update(names[one].tolist())
            edge = np.concatenate([[0], np.cumsum(sizes)])
            hashes = hashes[ts.ragged(edge[one], sizes[one])]
            sizes, names = sizes[one], names[one]
            signs, claims, about = [], [], []
            for s, owners, group, need in signatures(hashes, sizes, threshold):
                claims.append(owners + len(about) * len(sizes))
                signs.append(s)
                about.append((group, need))
            signs, claims = np.concatenate(signs), np.concatenate(claims)
            groups, needs = (np.concatenate(x) for x in zip(*about, strict=True))
            bucket = ((signs >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
            order = np.argsort(bucket.astype(np.uint16) if buckets < 65536 else bucket, kind="stable")
            edges = np.append(np.flatnonzero(np.diff(bucket[order], prepend=-1)), len(order))
            for low, high in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                pick = order[low:high]
                mine, slot = np.unique(claims[pick], return_inverse=True)
                by = np.argsort(slot, kind="stable")
                # five bytes and the bucket tell signatures apart; what they confuse is verified away
                short = np.ascontiguousarray(signs[pick[by]].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5])
                whose = mine % len(sizes)
                # low bytes first, then the next ones: those that are all 0 are compressed away
                about_them = np.stack([np.bincount(slot, minlength=len(mine)), sizes[whose], groups[mine], needs[mine]]).astype("<u4").view(np.uint8).reshape(-1, 4).T
                yield pa.RecordBatch.from_arrays([pa.array([int(bucket[pick[0]])], pa.int32()), pa.array([short.tobytes()], pa.binary()), pa.array([names[whose].astype("<i8").tobytes()], pa.binary()), pa.array([about_them.tobytes()], pa.binary())], ["bucket", "signs", "names", "about"])

    def meet(group: pa.Table) -> pa.Table:
        signs = np.zeros((sum(len(x.as_py()) for x in group.column("signs")) // 5, 8), np.uint8)
        signs[:, :5] = np.frombuffer(b"".join(group.column("signs").to_pylist()), np.uint8).reshape(-1, 5)
        names = np.frombuffer(b"".join(group.column("names").to_pylist()), "<i8")
        about = np.concatenate([np.ascontiguousarray(np.frombuffer(x, np.uint8).reshape(4, -1).T).view("<u4").reshape(4, -1) for x in group.column("about").to_pylist()], axis=1).astype(np.int64)
        first = int(group.column("bucket")[0].as_py()) << 40
        return met(signs.view("<i8").ravel() + first, np.repeat(np.arange(len(names)), about[0]), names, *about[1:], (num, den))

    sent = texts.select("__text").mapInArrow(ts.thrifty(send), "bucket int, signs binary, names binary, about binary")
    return sent.groupBy("bucket").applyInArrow(meet, FOUND)


def met(signs: np.ndarray, claims: np.ndarray, names: np.ndarray, sizes: np.ndarray, groups: np.ndarray, needs: np.ndarray, limit: tuple[int, int]) -> pa.Table:
    """What FOUND says of signatures, given the claim of each, and the claims' sets."""
    order = np.argsort(signs, kind="stable")
    signs, claims = signs[order], claims[order]
    alone = np.ones(len(signs), bool)
    same = signs[1:] == signs[:-1]
    alone[1:][same] = False
    alone[:-1][same] = False
    signs, claims = signs[~alone], claims[~alone]
    order = np.lexsort((names[claims], signs))
    signs, claims = signs[order], claims[order]
    new = np.ones(len(signs), bool)
    new[1:] = (signs[1:] != signs[:-1]) | (names[claims[1:]] != names[claims[:-1]])
    signs, claims = signs[new], claims[new]
    start = np.flatnonzero(np.concatenate([[True], signs[1:] != signs[:-1]])) if len(signs) else np.zeros(0, np.int64)
    size = np.diff(np.append(start, len(signs)))
    of = np.repeat(np.arange(len(start)), size)
    rank = np.arange(len(signs)) - np.repeat(start, size)
    many = size[of] > FEW
    member = np.flatnonzero(many & (rank > 0))
    centre = claims[start[of]]
    found = [(centre[member], claims[member], np.ones(len(member), np.int64))]
    # the k-th of few sets meets those before it, in steps of rank
    for back in range(1, int(min(FEW, size.max(initial=0)))):
        later = np.flatnonzero((rank >= back) & ~many)
        found.append((claims[later - back], claims[later], np.zeros(len(later), np.int64)))
    x, y, hot = (np.concatenate(c) for c in zip(*found, strict=True))
    near = limit[0] * np.maximum(sizes[x], sizes[y]) <= limit[1] * np.minimum(sizes[x], sizes[y])
    x, y, hot = x[near], y[near], hot[near]
    # a set's claims have different groups, so pairs of names and groups are told apart by one claim's group
    order = np.lexsort((groups[y], names[y], names[x]))
    x, y, hot = x[order], y[order], hot[order]
    new = np.ones(len(x), bool)
    new[1:] = (names[x[1:]] != names[x[:-1]]) | (names[y[1:]] != names[y[:-1]]) | (groups[y[1:]] != groups[y[:-1]])
    first = np.flatnonzero(new)
    x, y, n = x[first], y[first], np.diff(np.append(first, len(x)))
    hot = np.add.reduceat(hot, first) if len(first) else hot
    post = np.flatnonzero(many)
    c, m, zero = centre[post], claims[post], np.zeros(len(post), np.int64)
    columns = {
        "post": pa.concat_arrays([pa.nulls(len(x), pa.int64()), pa.array(signs[post], pa.int64())]),
        "x": np.concatenate([names[x], names[c]]), "y": np.concatenate([names[y], names[m]]), "grp": np.concatenate([groups[y], groups[m]]),
        "n": np.concatenate([n, zero]), "hot": np.concatenate([hot, zero]), "qx": np.concatenate([needs[x], needs[c]]), "qy": np.concatenate([needs[y], needs[m]]), "size": np.concatenate([sizes[y], sizes[m]]),
    }
    kinds = [pa.int64()] * 3 + [pa.int32()] * 6
    return pa.table([v if isinstance(v, pa.Array) else pa.array(v, t) for v, t in zip(columns.values(), kinds, strict=True)], names=list(columns))


def _likely(found: DataFrame) -> DataFrame:
    """The pairs that may be links: found by as many signatures of a group as any link of either set has in common.

    Signatures of many sets for which x isn't the centre of y's star don't show in the pair; they are no more than either set's
    memberships, which are added.  So no link is lost.
    """
    pairs = found.filter("post is null").groupBy("x", "y", "grp").agg(F.sum("n").alias("n"), F.sum("hot").alias("hot"), F.max("qx").alias("qx"), F.max("qy").alias("qy"))
    member = found.filter("post is not null and x <> y").groupBy("y", "grp").agg(F.count(F.lit(1)).alias("h"))
    of = lambda c: member.select(F.col("y").alias(c), "grp", F.col("h").alias(f"h{c}"))
    hidden = F.least(F.coalesce("hx", F.lit(0)), F.coalesce("hy", F.lit(0)) - F.col("hot"))
    return pairs.join(of("x"), ["x", "grp"], "left").join(of("y"), ["y", "grp"], "left").filter(F.col("n") + hidden >= F.greatest("qx", "qy")).select("x", "y").distinct()


def brief(elements: np.ndarray) -> bytes:
    """A byte an element, about: the steps between the elements' places, in order, among SPARSE to 2 * SPARSE places an element; a step of 255 or more has bytes of 255 before it."""
    bits = (SPARSE * max(1, len(elements)) - 1).bit_length()
    steps = np.diff(np.sort(ts.mix(elements) >> np.uint64(64 - bits)).astype(np.int64), prepend=0)
    at = np.cumsum(steps // 255 + 1) - 1
    out = np.full(int(at[-1]) + 1 if len(at) else 0, 255, np.uint8)
    out[at] = steps % 255
    return out.tobytes()


def places(raw: np.ndarray) -> np.ndarray:
    """The places that brief tells of, in order."""
    return np.cumsum(raw.astype(np.int64))[raw != 255]


def most_common(one: np.ndarray, other: np.ndarray) -> tuple[int, int]:
    """How many elements two sets of these places have, and in common at most: what differs may share a place, what is equal does."""
    small = min(len(one), len(other))
    bits = [(SPARSE * max(1, len(x)) - 1).bit_length() for x in (one, other)]
    one, other = (x >> max(0, b - min(bits)) for x, b in zip((one, other), bits, strict=True))
    both = np.concatenate([one, other])
    both.sort(kind="stable")
    # a place that one set has several times and the other too counts for each pair of neighbours: no less than the lesser count
    return len(both), min(small, int((both[1:] == both[:-1]).sum()))


def _elements(texts: DataFrame, rows: DataFrame, nodes: DataFrame, n: int, key: int) -> DataFrame:
    """The nodes' sets: name, size, elements (64-bit hashes) and their brief form.  Texts that no node has, by a filter, aren't cut into words."""
    by_text = _filter(rows.select(F.col("__set").alias("node"), "__hash").join(nodes, "node", "left_semi").groupBy("node").agg(F.min("__hash").alias("h")), "h")
    by_set = _filter(nodes, "node")

    def passing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = batch.filter(pa.array(_passes(by_text, batch.column(batch.schema.get_field_index("__hash")).to_numpy())))
            if hit.num_rows:
                yield hit

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, hashes, sizes, names in _sets(passing(batches), n, key):
            _, one = np.unique(names, return_index=True)
            one = one[_passes(by_set, names[one]) & (sizes[one] > 0)]
            edge = np.concatenate([[0], np.cumsum(sizes)])
            for low in range(0, len(one), 200):
                part = one[low : low + 200]
                yield pa.RecordBatch.from_arrays([pa.array(names[part]), pa.array(sizes[part], pa.int32()), pa.array([hashes[edge[i] : edge[i + 1]].tobytes() for i in part], pa.binary()), pa.array([brief(hashes[edge[i] : edge[i + 1]]) for i in part], pa.binary())], ["name", "size", "elements", "brief"])

    made = texts.mapInArrow(ts.thrifty(emit), "name long, size int, elements binary, brief binary")
    return made.join(nodes, made["name"] == nodes["node"], "left_semi").dropDuplicates(["name"])


def _compared(sets: DataFrame, pairs: DataFrame, column: str, reaches: Callable[[np.ndarray, np.ndarray], bool]) -> DataFrame:
    """The pairs x, y of sets whose bytes in the column reach the threshold."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column(2), batch.column(3)
            good = [reaches(np.frombuffer(a[i].as_buffer(), np.uint8), np.frombuffer(b[i].as_buffer(), np.uint8)) for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["x", "y"]).filter(pa.array(good, pa.bool_()))

    # sets of no pair aren't sent
    of = lambda c, d: sets.join(pairs.select(F.col(c).alias("name")).distinct(), "name", "left_semi").select(F.col("name").alias(c), F.col(column).alias(d))
    both = pairs.select("x", "y").join(of("x", "a"), "x").join(of("y", "b"), "y")
    return both.select("x", "y", "a", "b").mapInArrow(ts.thrifty(check), "x long, y long")


def _near(sets: DataFrame, pairs: DataFrame, threshold: Fraction) -> DataFrame:
    """The pairs x, y that may reach the threshold by the brief form of their sets."""
    num, den = threshold.numerator, threshold.denominator

    def reaches(a: np.ndarray, b: np.ndarray) -> bool:
        total, common = most_common(places(a), places(b))
        return common * den >= num * (total - common)

    return _compared(sets, pairs, "brief", reaches)


def _exact(sets: DataFrame, pairs: DataFrame, threshold: Fraction) -> DataFrame:
    """The pairs x, y whose sets reach the threshold."""
    num, den = threshold.numerator, threshold.denominator

    def reaches(a: np.ndarray, b: np.ndarray) -> bool:
        both = np.sort(np.concatenate([a.view(np.uint64), b.view(np.uint64)]), kind="stable")
        common = int((both[1:] == both[:-1]).sum())
        return common * den >= num * (len(both) - common)

    return _compared(sets, pairs, "elements", reaches)


def _verified(sets: DataFrame, pairs: DataFrame, threshold: Fraction) -> DataFrame:
    """Links among the pairs x < y, enough of them to join all that the links among the pairs join.

    Where many pairs come near the threshold, one pair of each set is verified first, and of the others those between the components that these make.
    """
    near = written(_near(sets, pairs, threshold))
    first = written(near.groupBy("y").agg(F.min("x").alias("x")).select("x", "y"))
    if near.count() <= 2 * first.count():
        return _exact(sets, near, threshold)
    links = written(_exact(sets, first, threshold))
    labels = components(links)
    of = lambda c: labels.select(F.col("node").alias(c), F.col("label").alias(f"c{c}"))
    ends = near.join(first, ["x", "y"], "left_anti").join(of("x"), "x", "left").join(of("y"), "y", "left")
    apart = written(ends.filter(F.coalesce("cx", "x") != F.coalesce("cy", "y")).select("x", "y"))
    return links.unionByName(_exact(sets, apart, threshold))


def _joined(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """labels (node, label) after these edges too: components of the labels that they join."""
    of = lambda c: labels.select(F.col("node").alias(c), F.col("label").alias(f"c{c}"))
    known = edges.join(of("x"), "x", "left").join(of("y"), "y", "left")
    ends = written(known.select("x", "y", F.coalesce("cx", "x").alias("cx"), F.coalesce("cy", "y").alias("cy")))
    moved = components(ends.select(F.col("cx").alias("x"), F.col("cy").alias("y")))
    nodes = labels.unionByName(ends.select(F.col("x").alias("node"), F.col("cx").alias("label"))).unionByName(ends.select(F.col("y").alias("node"), F.col("cy").alias("label"))).distinct()
    return written(nodes.join(moved.select(F.col("node").alias("label"), F.col("label").alias("l")), "label", "left").select("node", F.coalesce("l", "label").alias("label")))


def _open(posts: DataFrame, labels: DataFrame) -> DataFrame:
    """Memberships (post, node, grp, need, size, label) of the signatures whose sets are in several components."""
    mine = posts.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    apart = mine.groupBy("post").agg(F.min("label").alias("l"), F.max("label").alias("m")).filter("l <> m").select("post")
    return mine.join(apart, "post", "left_semi")


def _second_star(open_: DataFrame, threshold: Fraction) -> DataFrame:
    """Pairs of each open signature's second centre and the sets apart from it, if they come often enough to be likely."""
    at = F.xxhash64("node", F.lit(1))
    centre = open_.groupBy("post").agg(F.min(F.struct(at.alias("a"), F.col("node").alias("c"), F.col("label").alias("cl"), F.col("size").alias("cs"))).alias("s")).select("post", "s.c", "s.cl", "s.cs")
    near = F.greatest("size", "cs") * threshold.numerator <= F.least("size", "cs") * threshold.denominator
    pairs = open_.join(centre, "post").filter((F.col("label") != F.col("cl")) & near)
    counted = pairs.groupBy(F.least("c", "node").alias("x"), F.greatest("c", "node").alias("y"), "grp").agg(F.count(F.lit(1)).alias("n"), F.max("need").alias("q"))
    return counted.filter("4 * n >= q").select("x", "y").distinct()


def _part(size: Column, up: int, of: int) -> Column:
    """How many of a set's first elements one of a share up / of of them must be among."""
    return size - F.floor((size * up + of - 1) / of) + 1


def _beginnings(sets: DataFrame, nodes: DataFrame, threshold: Fraction) -> DataFrame:
    """The rarest elements of each of the nodes' sets: node, size, e, place p and the elements before it.

    Of sets with similarity t, each has a share t of its elements in common with the other at least, and the smaller one a
    share 2t / (1 + t), so they meet in the first size - ceil(share * size) + 1 elements of any one order.  With rare
    elements first, what a set has for itself fills its beginning, and a passage that many sets hold comes last.
    """

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for node, size, raw in zip(*batch.columns, strict=True):
                mine = np.frombuffer(raw.as_buffer(), "<i8")
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(mine), x.as_py(), t)) for x, t in ((node, np.int64), (size, np.int32))] + [pa.array(mine)], ["node", "size", "e"])

    own = sets.join(nodes, sets["name"] == nodes["node"]).select("node", "size", "elements")
    parts = written(own.mapInArrow(ts.thrifty(emit), "node long, size int, e long"))
    ranked = parts.join(parts.groupBy("e").agg(F.count(F.lit(1)).alias("f")).filter("f > 1"), "e", "left").withColumn("f", F.coalesce("f", F.lit(1)))
    place = F.row_number().over(Window.partitionBy("node").orderBy("f", "e"))
    first = ranked.withColumn("p", place).filter(F.col("p") <= _part(F.col("size"), threshold.numerator, threshold.denominator)).filter("f > 1")
    return written(first.withColumn("before", F.collect_list("e").over(Window.partitionBy("node").orderBy("p").rowsBetween(-BEFORE, -1))).select("node", "size", "e", "p", "before"))


def _rarest(beginnings: DataFrame, nodes: DataFrame, threshold: Fraction, one_in: int = 1) -> DataFrame:
    """Pairs x < y of nodes (node, label) in different components that share one of the rarest elements of each.

    For each element, the sets of the component that has most of them meet those of the other components only; a pair is made
    at the first element that both have, as far as the BEFORE elements ahead of each tell.

    one_in: with more than 1, of components of more than LARGE nodes only one node in so many counts, by a hash of its name, and only pairs with these
    are made; what has no element of theirs is left out at once.
    """
    num, den = threshold.numerator, threshold.denominator
    if one_in > 1:
        large = nodes.groupBy("label").count().filter(F.col("count") > LARGE).select("label", F.lit(1).alias("large"))
        nodes = written(nodes.join(large, "label", "left").withColumn("large", F.coalesce("large", F.lit(0))).filter((F.col("large") == 0) | (F.pmod(F.xxhash64("node", F.lit(2)), F.lit(one_in)) == 0)))
        theirs = beginnings.join(nodes.filter("large = 1"), "node", "left_semi").select("e").distinct()
        beginnings = beginnings.join(theirs, "e", "left_semi")
    else:
        nodes = nodes.withColumn("large", F.lit(0))
    first = written(beginnings.join(nodes, "node"))
    blocks = first.groupBy("e", "label", "large").agg(F.count(F.lit(1)).alias("n")).groupBy("e").agg(F.max_by("label", F.struct("large", "n", "label")).alias("main"), F.count(F.lit(1)).alias("k")).filter("k > 1").select("e", "main")
    # written, so that Spark can split the join below where many sets have an element
    tagged = written(first.join(blocks, "e"))
    of = lambda df, c: df.select(F.col("node").alias(c), "e", F.col("main").alias(f"m{c}"), F.col("label").alias(f"c{c}"), F.col("size").alias(f"s{c}"), F.col("p").alias(f"p{c}"), F.col("before").alias(f"b{c}"))
    x, y = of(tagged.filter("label <> main"), "x"), of(tagged.filter("large = 1 and label = main") if one_in > 1 else tagged, "y")
    near = F.greatest("sx", "sy") * num <= F.least("sx", "sy") * den
    once = (F.col("cx") != F.col("cy")) & ((F.col("cy") == F.col("my")) | (F.col("x") < F.col("y")))
    early = F.when(F.col("sx") <= F.col("sy"), F.col("px") <= _part(F.col("sx"), 2 * num, num + den)).otherwise(F.col("py") <= _part(F.col("sy"), 2 * num, num + den))
    # from the first element in common on, neither set may have fewer elements left than a link has in common
    left = F.least(F.col("sx") - F.col("px"), F.col("sy") - F.col("py")) + 1
    met_first = near & once & early & (left * (num + den) >= (F.col("sx") + F.col("sy")) * num) & ~F.arrays_overlap("bx", "by")
    pairs = x.join(y, (x["e"] == y["e"]) & met_first)
    return pairs.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()


def join(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = 5, threshold: float = 0.75) -> DataFrame:
    """Per row: key, n_shingles, component_id (the smallest key reachable by links, its own included).

    Two rows link if their sets of distinct n-grams of words have a Jaccard similarity of threshold or more.  Words are
    runs of bytes other than 0x20, 0x09-0x0D, A-Z lower-cased; a text of fewer words has its whole sequence as its one
    n-gram; null and empty texts link with nothing.  Equal rows link like others.  A null key counts last, and
    is the component of a row that reaches no other key.  Keys may be of any type that has an order.
    """
    limit = Fraction(threshold).limit_denominator(10_000)
    texts = docs.select(text_or_empty(text).alias("__text")).withColumn("__hash", F.xxhash64("__text"))
    hash_key = ts.fresh_key()
    rows = written(described(docs.select(F.col(key).alias("__key"), F.col(text).alias("__t")), "__t", n, hash_key))
    buckets = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), buckets_for(texts, F.col("__text")) // 2)
    found = written(_found(texts, n, limit, buckets, hash_key))
    labels = _labels(texts, rows, found, n, limit, hash_key)
    label = rows.join(labels.withColumnRenamed("node", "__set"), "__set", "left").withColumn("__c", F.when(F.col("n_shingles") > 0, F.coalesce("label", "__set")))
    least = label.filter("__c is not null").groupBy("__c").agg(F.min("__key").alias("least"))
    return label.join(least, "__c", "left").select(F.col("__key").alias(key), "n_shingles", F.coalesce("least", "__key").alias("component_id"))


def _labels(texts: DataFrame, rows: DataFrame, found: DataFrame, n: int, limit: Fraction, key: int) -> DataFrame:
    """Per set with a link: node and label, which all sets that it reaches have."""
    likely = written(_likely(found))
    posts = found.filter("post is not null").select("post", F.col("y").alias("node"), "grp", F.col("qy").alias("need"), "size")
    enough = posts.groupBy("node", "grp").agg(F.count(F.lit(1)).alias("n"), F.max("need").alias("q")).filter("n >= q")
    nodes = written(likely.select(F.explode(F.array("x", "y")).alias("node")).unionByName(enough.select("node")).distinct())
    sets = written(_elements(texts, rows, nodes, n, key))
    labels = written(components(written(_verified(sets, likely, limit))))
    # a set with fewer memberships than a link needs can't have lost one
    posts = written(posts.join(enough.select("node", "grp"), ["node", "grp"], "left_semi"))
    open_ = written(_open(posts, labels))
    if open_.isEmpty():
        return labels
    again = written(_verified(sets, _second_star(open_, limit), limit))
    if not again.isEmpty():
        labels = _joined(labels, again)
        open_ = written(_open(posts, labels))
    beginnings = None
    for one_in in ROUNDS:
        apart = written(open_.groupBy("node", "grp").agg(F.count(F.lit(1)).alias("n"), F.max("need").alias("q"), F.max("label").alias("label")).filter("n >= q").select("node", "label").distinct())
        if one_in > 1 and (apart.groupBy("label").count().agg(F.max("count")).first()[0] or 0) <= LARGE:
            continue
        # later rounds have no other nodes than the first, and any one order of the elements does
        beginnings = _beginnings(sets, apart.select("node"), limit) if beginnings is None else beginnings
        more = written(_verified(sets, written(_rarest(beginnings, apart, limit, one_in)), limit))
        if one_in > 1 and not more.isEmpty():
            labels = _joined(labels, more)
            open_ = written(_open(posts, labels))
    return labels if more.isEmpty() else _joined(labels, more)


def deduplicate(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = 5, threshold: float = 0.75) -> DataFrame:
    """docs with one row of each group of linked rows: that with the smallest key.

    Rows that link with nothing stay, null and empty texts included; of rows that repeat both key and text one stays.  Rows and
    columns that stay are unchanged.
    """
    k, number = unused(docs, "k"), unused(docs, "n")
    groups = join(docs, key, text, n, threshold)
    stay = groups.filter(F.col(key).eqNullSafe(F.col("component_id"))).select(F.col(key).alias(k)).distinct()
    kept = docs.join(stay, F.col(key).eqNullSafe(F.col(k)), "left_semi")
    first = Window.partitionBy(key, content_key(F.coalesce(F.concat(F.lit("1"), F.col(text)), F.lit("")))).orderBy(F.lit(1))
    return kept.withColumn(number, F.row_number().over(first)).filter(F.col(number) == 1).drop(number)
