"""Near-duplicate documents by SimHash fingerprints and vantage-point trees.

A fingerprint bit is 1 where more than half of a document's shingle hashes have it (XXH64 of the
words joined by a space, A-Z lower-cased, repeats included). Documents are linked if their
fingerprints differ in at most `bits` bits, and linked documents form components.

1. Equal fingerprints are one from here on, however many documents have them.
2. Vantage-point trees: of `bits` differing bits at most one falls in one of three parts of the
   fingerprint, whatever the pair. So there is a tree for each part, and its distances are Hamming
   distances within that part, which may be off by one between linked fingerprints, or over all 64
   bits, off by `bits`. A node has a vantage point and a radius: fingerprints within the radius go
   to one side, the others to the other side. By the triangle inequality only fingerprints at the
   boundary can be linked across it, and those of one side go to the other side, too; everything
   else is pruned. (Distances over all bits alone would be at the boundary for half of all random
   fingerprints at every node; within a part they rarely are.)
3. The upper nodes are fitted on a sample of SAMPLE fingerprints, those of the least hash; every
   fingerprint is sent through them to its shards. A shard's task grows the tree on down to leaves
   of LEAF fingerprints and compares what is in a leaf pair by pair, exactly, so no link is lost.
   Only the links to the least fingerprint of each connected group of a leaf leave the task.
4. The links of all trees are joined to components.

Words are runs of characters other than space and tab to carriage return. A text of fewer words
than a shingle is one shingle; null text, empty text and text without words have fingerprint zero
and are linked like any other. Texts are read whole, a megabyte of words at a time. The component id
is its least document id; null ids come after all others, and a component of null ids alone has a
null id. Repeated rows each give a row. Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallylog.llm.components import connected
from tallylog.llm.shared import cut, split_join, whole_text

SHINGLE_WORDS = 4
#: Bits in which linked fingerprints may differ; below six, so that three parts have one of at most one.
BITS = 4
SEED = 42
#: The parts of a fingerprint.
PARTS = (0x00000000001FFFFF, 0x000003FFFFE00000, 0xFFFFFC0000000000)
EVERY_BIT = (1 << 64) - 1
#: Fingerprints that the upper nodes are fitted on, and the fewest of them at a node that is split.
SAMPLE, LEAST_SAMPLE = 4096, 32
#: Fingerprints of a shard as the sample suggests, and of a leaf compared pair by pair.
SHARD, LEAF = 1 << 14, 256
#: Vantage points tried at a node.
TRIES = 6
PIECE_BYTES = 1 << 20
_SPACE = re.compile(rb"[\x09-\x0D\x20]")


def _word_runs(data: bytes) -> Iterator[list[bytes]]:
    """The words of a text in order, about PIECE_BYTES of text at a time."""
    low = 0
    while low < len(data):
        found = _SPACE.search(data, low + PIECE_BYTES)
        high = found.start() if found else len(data)
        yield data[low:high].lower().split()  # both know ASCII only
        low = high


def fingerprint(data: bytes, words: int = SHINGLE_WORDS) -> int:
    """The 64 bits of a UTF-8 text, as an unsigned number."""
    ones, n, digest = np.zeros(64, np.int64), 0, xxhash.xxh64_digest
    tail: list[bytes] = []
    for run in _word_runs(data):
        run = tail + run
        tail = run[len(run) - words + 1 :] if len(run) >= words else run
        if len(run) < words:
            continue
        line = b" ".join(run)
        ends = np.cumsum(np.fromiter(map(len, run), np.int64, len(run)) + 1) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])[: len(run) - words + 1]
        hashes = b"".join([digest(line[a:b], SEED) for a, b in zip(starts.tolist(), islice(ends.tolist(), words - 1, None))])
        bits = np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int64)
        n += len(bits)
    if n == 0 and tail:
        return int.from_bytes(digest(b" ".join(tail), SEED), "big")
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, words: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id and fingerprint (the 64 bits as a long) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(text.as_py(), words) for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.array(found, np.uint64).view(np.int64))], ["doc_id", "fingerprint"]
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, fingerprint long")


@dataclass(frozen=True)
class Split:
    """Points within `radius` of `vantage` on the bits of `mask` are inside. Linked points' distances
    differ by `slack` at most; the points at the boundary of one side are on both."""

    vantage: np.uint64
    mask: np.uint64
    radius: int
    slack: int
    guests_outside: bool

    def sides(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which points go inside, and which outside."""
        far = np.bitwise_count((points ^ self.vantage) & self.mask).astype(np.int64)
        if self.guests_outside:
            return far <= self.radius, far > self.radius - self.slack
        return far <= self.radius + self.slack, far > self.radius


def best_split(points: np.ndarray, part: int, bits: int, rng: np.random.Generator) -> Split | None:
    """The split with the smallest sides among a few vantage points, all radii and both masks; none
    if all leave nearly everything on one side."""
    n = len(points)
    # slack 1 is all that three parts leave for one of them
    masks = ((np.uint64(part), bits // len(PARTS)), (np.uint64(EVERY_BIT), bits))
    best, least = None, 2 * (0.9 * n) ** 1.5
    for vantage in points[rng.integers(0, n, TRIES)]:
        for mask, slack in masks:
            at = np.bincount(np.bitwise_count((points ^ vantage) & mask), minlength=66)
            within = np.concatenate([np.cumsum(at), np.full(slack, n)])  # points at up to each distance
            radius = np.arange(65)
            for guests_outside in (True, False):
                if guests_outside:
                    before = np.where(radius >= slack, within[np.maximum(radius - slack, 0)], 0)
                    sides = within[radius], n - before
                else:
                    sides = within[radius + slack], n - within[radius]
                cost = sides[0].astype(float) ** 1.5 + sides[1].astype(float) ** 1.5
                cost[np.maximum(*sides) > 0.95 * n] = np.inf
                r = int(cost.argmin())
                if cost[r] < least:
                    best, least = Split(vantage, mask, r, slack, guests_outside), cost[r]
    return best


#: A node of the upper tree: a split with its inner and outer node, or the number of a shard.
Node = tuple[Split, "Node", "Node"] | int


def fit_tree(sample: np.ndarray, part: int, bits: int, share: float, first: int) -> tuple[Node, int]:
    """The upper tree of a part, its shards numbered from `first`, and the next number. A fingerprint
    of the sample stands for `share` ones."""
    rng = np.random.default_rng(part % 1000)
    shards = first

    def grow(points: np.ndarray) -> Node:
        nonlocal shards
        split = best_split(points, part, bits, rng) if len(points) >= LEAST_SAMPLE and len(points) * share > SHARD else None
        if split is None:
            shards += 1
            return shards - 1
        inside, outside = split.sides(points)
        return split, grow(points[inside]), grow(points[outside])

    return grow(sample), shards


def _near_groups(points: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Points that are linked, directly or through others, and the least point of their group."""
    if len(points) <= LEAF:
        near = np.bitwise_count(points[:, None] ^ points[None, :]) <= bits
        label = points
        while True:
            least = np.where(near, label[None, :], np.uint64(EVERY_BIT)).min(axis=1)
            if np.array_equal(least, label):
                break
            label = least
    else:
        # too near each other for a split: breadth first, each point with all that are not reached yet
        label, left = points.copy(), np.arange(len(points))
        while len(left):
            seed, queue = left[0], [left[0]]
            left = left[1:]
            while queue and len(left):
                near = np.bitwise_count(points[left] ^ points[queue.pop()]) <= bits
                label[left[near]] = points[seed]
                queue += left[near].tolist()
                left = left[~near]
    moved = label != points
    return points[moved], label[moved]


def shard_links(points: np.ndarray, part: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of the distinct points of a shard: each with the least of its group in a leaf."""
    rng = np.random.default_rng(len(points))
    found, waiting = [], [points]
    while waiting:
        own = waiting.pop()
        split = best_split(own, part, bits, rng) if len(own) > LEAF else None
        if split is None:
            found.append(_near_groups(np.sort(own), bits))
        else:
            inside, outside = split.sides(own)
            waiting += [own[inside], own[outside]]
    links = np.unique(np.concatenate([np.stack(x, axis=1) for x in found]), axis=0)
    return links[:, 0], links[:, 1]


def near_links(sets: DataFrame, bits: int = BITS) -> DataFrame:
    """Links (a, b) that connect all distinct fingerprints which differ in at most `bits` bits."""
    if not 0 <= bits < 2 * len(PARTS):
        raise ValueError("more bits than the parts allow")
    n = sets.count()
    chosen = sets.select("fingerprint").orderBy(F.xxhash64("fingerprint"), "fingerprint").limit(SAMPLE).collect()
    sample = np.array([r.fingerprint for r in chosen], np.int64).view(np.uint64)
    trees, shards = [], 0
    for part in PARTS:
        tree, shards = fit_tree(sample, part, bits, n / max(len(sample), 1), shards)
        trees.append((tree, shards))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def walk(node: Node, points: np.ndarray) -> Iterator[pa.RecordBatch]:
            if isinstance(node, int):
                if len(points):
                    where = pa.array(np.full(len(points), node, np.int32))
                    yield pa.RecordBatch.from_arrays([where, pa.array(points.view(np.int64))], ["shard", "point"])
                return
            split, inner, outer = node
            inside, outside = split.sides(points)
            yield from walk(inner, points[inside])
            yield from walk(outer, points[outside])

        for batch in batches:
            points = batch.column(0).to_numpy().view(np.uint64)
            for tree, _ in trees:
                yield from walk(tree, points)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held = None, []

        def done() -> pa.RecordBatch:
            part = PARTS[next(i for i, (_, end) in enumerate(trees) if shard < end)]
            a, b = shard_links(np.concatenate(held).view(np.uint64), part, bits)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        for batch in batches:
            shards_, points = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            edges = np.flatnonzero(np.diff(shards_)) + 1
            for low, high in zip([0, *edges.tolist()], [*edges.tolist(), len(shards_)]):
                if low < high:
                    if shards_[low] != shard and held:
                        yield done()
                        held = []
                    shard = int(shards_[low])
                    held.append(points[low:high])
        if held:
            yield done()

    dealt = sets.select("fingerprint").mapInArrow(deal, "shard int, point long")
    placed = dealt.repartition("shard").sortWithinPartitions("shard")
    return placed.mapInArrow(compare, "a long, b long")


def near_duplicates(docs: DataFrame, words: int = SHINGLE_WORDS, bits: int = BITS) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id of every row."""
    signed = cut(fingerprints(docs, words))  # numbers only; read again below
    sets = cut(signed.groupBy("fingerprint").agg(F.min("doc_id").alias("least_id")))
    labels = connected(near_links(sets, bits)).withColumnRenamed("node", "fingerprint")
    named = sets.join(labels, "fingerprint", "left").withColumn("label", F.coalesce("label", "fingerprint"))
    ids = named.groupBy("label").agg(F.min("least_id").alias("component_id"))
    by_print = named.join(ids, "label").select("fingerprint", "component_id")
    # many rows may share a fingerprint, so both sides are dealt out for this join
    found = split_join(signed.withColumn("shown", F.lower(F.lpad(F.hex("fingerprint"), 16, "0"))), by_print, ["fingerprint"])
    return found.select("doc_id", F.col("shown").alias("fingerprint"), "component_id")
