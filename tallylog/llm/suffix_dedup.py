"""Removing byte strings that stand anywhere else, by sorting suffixes deep and shallow.

A window of `width` bytes that also starts at another place, in the same document or another one,
is a repeat; every byte under a repeat is removed, at all its places. Windows lie within one text.

1. Screening by content-defined segments (`repeats`) decides what is no repeat and what repeats
   with its surroundings; open are stretches around the edges of repeated passages.
2. Stretches with one anchor are brought together, as only their suffixes can be equal that far,
   and their suffixes are sorted:
   * shallow: multikey quicksort on super-characters of 8 bytes, to a depth of 32 bytes; a
     suffix that is alone is finished;
   * deep: suffixes that still agree are put into a blind trie, which holds branching bytes only.
     A suffix finds its leaf by these bytes, is compared with that leaf once, and branches off at
     the byte where they differ. Suffixes that agree for the whole width share a leaf.
   A leaf with two suffixes or more is an interval of the suffix array whose common prefixes are
   as long as a window: a repeat.
3. An anchor with more than HOT_STRETCHES different stretches is too large for one task. Its
   stretches are cut into pieces of a few windows, always at the same distances from the anchor;
   pieces that stand twice are decided as a whole, and of the others, with one of each kind, the
   windows are counted by hash, with partial counts before each shuffle.

Texts are bytes in UTF-8; what stays may end inside a character. Null or empty text and texts
shorter than a window lose nothing and repeat nothing. Rows with equal texts are repeats of each
other, also where they share an id; of rows with one id and text the segments are listed, and
sorted, once; null ids are kept apart by text. Other columns are ignored.
An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallylog.llm.repeats import PLACE_BITS, by_document, byte_units, covered, keyed, own_id, screen, with_lists
from tallylog.llm.shared import binary, split_join, text_slices
from tallylog.llm.words import BYTE, prefix_sums, stretches

WIDTH = 200
#: Bytes of an anchor's k-gram in the screening.
GRAM = 40
SHALLOW_BYTES = 32
#: Different stretches of an anchor that one task sorts: some 15 MB of text and 300 MB of places.
HOT_STRETCHES = 50_000
#: Windows of a piece of a hot anchor's stretch.
PIECE_WINDOWS = 8
#: Bytes of stretches sorted at once; stretches of one anchor stay together.
SORT_BYTES = 1 << 20


def shallow_groups(data: np.ndarray, places: np.ndarray, depth: int) -> list[np.ndarray]:
    """Groups (of numbers of `places`) of two or more suffixes that agree for `depth` bytes.

    Multikey quicksort with 8 bytes for a character: a level sorts what the levels before left
    together, and goes on with what is still together. `data` has `depth` bytes behind each place.
    """
    tied = np.arange(len(places))
    group = np.zeros(len(places), np.int64)
    for at in range(0, depth, 8):
        if not len(tied):
            return []
        key = np.zeros(len(tied), np.uint64)
        for i in range(8):
            key = (key << np.uint64(8)) | data[places[tied] + (at + i)]
        order = np.lexsort((key, group))
        tied, group, key = tied[order], group[order], key[order]
        new = np.ones(len(tied), bool)
        new[1:] = (group[1:] != group[:-1]) | (key[1:] != key[:-1])
        group = np.cumsum(new) - 1
        again = np.bincount(group)[group] > 1
        tied, group = tied[again], group[again]
    if not len(tied):
        return []
    return np.split(tied, np.flatnonzero(np.diff(group)) + 1)


class BlindTrie:
    """Suffixes of `text` by their first `width` bytes. An inner node is [depth, {byte: child}],
    a leaf the list of suffixes that agree for the whole width."""

    def __init__(self, text: bytes, width: int) -> None:
        self.text, self.width = text, width
        self.root: list | None = None

    def _agree(self, a: int, b: int) -> int:
        """Bytes in which two suffixes agree, at most the width."""
        x, y = self.text[a : a + self.width], self.text[b : b + self.width]
        if x == y:
            return self.width
        differ = int.from_bytes(x) ^ int.from_bytes(y)
        return (8 * self.width - differ.bit_length()) // 8

    @staticmethod
    def _inner(node: list) -> bool:
        return len(node) == 2 and type(node[1]) is dict

    def insert(self, place: int) -> None:
        if self.root is None:
            self.root = [place]
            return
        text, node = self.text, self.root
        while self._inner(node):  # blindly: any child will do where the byte has none
            children = node[1]
            node = children.get(text[place + node[0]]) or next(iter(children.values()))
        depth = self._agree(place, node[0])
        if depth == self.width:
            node.append(place)
            return
        # again from the top, to the node below which it branches off
        above, node = None, self.root
        while self._inner(node) and node[0] < depth:
            above, node = node, node[1][text[place + node[0]]]
        if self._inner(node) and node[0] == depth:
            node[1][text[place + depth]] = [place]
            return
        some = node
        while self._inner(some):
            some = next(iter(some[1].values()))
        branch = [depth, {text[some[0] + depth]: node, text[place + depth]: [place]}]
        if above is None:
            self.root = branch
        else:
            above[1][text[place + above[0]]] = branch

    def leaves(self) -> Iterator[list[int]]:
        """Leaves in the order of their suffixes."""
        stack = [self.root] if self.root is not None else []
        while stack:
            node = stack.pop()
            if self._inner(node):
                stack += [child for _, child in sorted(node[1].items(), reverse=True)]
            else:
                yield node


def repeated_suffixes(text: bytes, places: np.ndarray, width: int, shallow: int = SHALLOW_BYTES) -> np.ndarray:
    """Which of the suffixes at `places` (each with `width` bytes left) agree with another one for
    `width` bytes."""
    out = np.zeros(len(places), bool)
    data = np.frombuffer(text, np.uint8)
    groups = shallow_groups(data, places, min(shallow, width // 8 * 8))
    pairs = np.array([g for g in groups if len(g) == 2], np.int64).reshape(-1, 2)
    span = np.arange(width)
    for low in range(0, len(pairs), 4096):  # two suffixes need no trie
        a, b = pairs[low : low + 4096].T
        same = (data[places[a][:, None] + span] == data[places[b][:, None] + span]).all(axis=1)
        out[a], out[b] = same, same
    number = None
    for group in groups:
        if len(group) == 2:
            continue
        trie = BlindTrie(text, width)
        at = places[group].tolist()
        for place in at:
            trie.insert(place)
        number = dict(zip(at, group.tolist()))
        for leaf in trie.leaves():
            if len(leaf) > 1:
                out[[number[p] for p in leaf]] = True
    return out


def _stretch_rows(rows: DataFrame, open_: DataFrame, width: int) -> DataFrame:
    """The bytes under open segments."""
    listed = by_document(open_, "anchor", "single")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = binary(batch.column(2))
            out: list[tuple] = []
            held = 0
            for i in range(batch.num_rows):
                text = texts[i].as_buffer()
                k_id, k_th = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                for s in batch.column(3)[i].as_py():
                    size = s["count"] + width - 1
                    out.append((s["anchor"], k_id, k_th, s["start"], s["count"], s["single"], text.slice(s["start"], size).to_pybytes()))
                    held += size
                if held > 4 << 20:
                    yield batch_of(out)
                    out, held = [], 0
            yield batch_of(out)

    def batch_of(out: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.binary()]
        names = ["anchor", "k_id", "k_th", "start", "count", "single", "stretch"]
        return pa.RecordBatch.from_arrays([pa.array([r[j] for r in out], kind) for j, kind in enumerate(kinds)], names)

    return with_lists(rows, listed).mapInArrow(run, "anchor long, k_id long, k_th long, start int, count int, single boolean, stretch binary")


def _sorted_repeats(stretch_rows: DataFrame, width: int) -> DataFrame:
    """Repeated windows of the single stretches, as segments, by sorting the suffixes of each
    anchor's stretches."""

    def found(rows: list[dict]) -> pa.RecordBatch:
        text = b"".join(r["stretch"] for r in rows)
        count = np.array([r["count"] for r in rows], np.int64)
        base = np.cumsum([0, *(len(r["stretch"]) for r in rows)])[:-1]
        owner = np.repeat(np.arange(len(rows)), count)
        step = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
        again = repeated_suffixes(text, base[owner] + step, width)
        again &= np.array([r["single"] for r in rows], bool)[owner]
        owner, step = owner[again], step[again]
        # consecutive windows as one segment
        new = np.ones(len(owner), bool)
        new[1:] = (owner[1:] != owner[:-1]) | (step[1:] != step[:-1] + 1)
        first = np.flatnonzero(new)
        n = np.diff(np.append(first, len(owner)))
        own = [rows[i] for i in owner[first].tolist()]
        return pa.RecordBatch.from_arrays(
            [
                pa.array([r["k_id"] for r in own], pa.int64()),
                pa.array([r["k_th"] for r in own], pa.int64()),
                pa.array([r["start"] + s for r, s in zip(own, step[first].tolist())], pa.int32()),
                pa.array(n, pa.int32()),
            ],
            ["k_id", "k_th", "start", "count"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        size, before = 0, None
        for batch in batches:
            for low in range(0, batch.num_rows, 1000):
                for row in batch.slice(low, 1000).to_pylist():
                    place = (row["anchor"], row["k_id"], row["k_th"], row["start"])
                    if place == before:  # a copy of the row
                        continue
                    before = place
                    if size > SORT_BYTES and row["anchor"] != held[-1]["anchor"]:
                        yield found(held)
                        held, size = [], 0
                    held.append(row)
                    size += len(row["stretch"])
        if held:
            yield found(held)

    together = stretch_rows.repartition("anchor").sortWithinPartitions("anchor", "k_id", "k_th", "start")
    return together.mapInArrow(run, "k_id long, k_th long, start int, count int")


def _anchor_of(sums: np.ndarray, first: int, width: int, gram: int) -> int:
    """Place of the anchor of the window at `first`: its least k-gram, the leftmost of equal ones."""
    places = np.arange(first, first + width - gram + 1)
    shift = np.uint64(PLACE_BITS)
    return first + int(np.argmin(stretches(sums, places, places + gram) >> shift))


def _pieces(rows: DataFrame, open_: DataFrame, width: int, gram: int, windows: int) -> DataFrame:
    """Hashes (hash, k_id, k_th, start, count) of the listed segments' pieces of up to `windows`
    windows, cut at multiples of that many bytes from the anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, data, offsets in text_slices(batch.column(2)):
                sums = prefix_sums(BYTE[data])
                for i in range(low, high):
                    place, count = [], []
                    for s in batch.column(3)[i].as_py():
                        first, end = s["start"], s["start"] + s["count"]
                        align = _anchor_of(sums, int(offsets[i - low]) + first, width, gram) if windows > 1 else 0
                        cuts = [x for x in range(first, end) if x == first or (x + offsets[i - low] - align) % windows == 0]
                        place += cuts
                        count += [b - a for a, b in zip(cuts, [*cuts[1:], end])]
                    place, count = np.array(place, np.int64), np.array(count, np.int64)
                    first = offsets[i - low] + place
                    hashes = stretches(sums, first, first + count + width - 1, seed=2)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(hashes.view(np.int64)),
                            pa.array([batch.column(0)[i].as_py()] * len(place), pa.int64()),
                            pa.array([batch.column(1)[i].as_py()] * len(place), pa.int64()),
                            pa.array(place.astype(np.int32)),
                            pa.array(count.astype(np.int32)),
                        ],
                        ["hash", "k_id", "k_th", "start", "count"],
                    )

    return with_lists(rows, by_document(open_)).mapInArrow(run, "hash long, k_id long, k_th long, start int, count int")


def _counted_repeats(rows: DataFrame, open_: DataFrame, width: int, gram: int) -> DataFrame:
    """Repeated windows of open segments, as segments, by counting pieces, then windows."""
    names = ["k_id", "k_th", "start", "count"]

    def twice(found: DataFrame) -> DataFrame:
        again = found.groupBy("hash").agg(F.count("*").alias("_n")).where("_n > 1").select("hash")
        return split_join(found, again, ["hash"], "left_semi").select(names)

    pieces = _pieces(rows, open_, width, gram, PIECE_WINDOWS)
    kinds = pieces.groupBy("hash").agg(F.min(F.struct(*names)).alias("_first"))
    return twice(pieces).unionByName(twice(_pieces(rows, kinds.select("_first.*"), width, gram, 1)))


def find_repeats(rows: DataFrame, width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """Repeats of keyed rows as lists per row key: k_id, k_th and segments (start, count), each
    `count` windows that stand elsewhere, too, from byte `start` on."""
    decided, open_ = screen(rows, byte_units, width, gram)
    hot = open_.groupBy("anchor").agg(F.count("*").alias("_n")).where(F.col("_n") > HOT_STRETCHES).select("anchor")
    sorted_ = _sorted_repeats(_stretch_rows(rows, split_join(open_, hot, ["anchor"], "left_anti"), width), width)
    counted = _counted_repeats(rows, split_join(open_, hot, ["anchor"], "left_semi"), width, gram)
    return by_document(decided.unionByName(sorted_).unionByName(counted))


def kept_bytes(docs: DataFrame, width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """Each document's bytes without repeats: doc_id, n_bytes, n_removed, n_spans (maximal removed
    runs) and kept (the bytes that stay)."""
    rows = keyed(docs)
    repeats = find_repeats(rows, width, gram)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, data, offsets in text_slices(batch.column(1)):
                out = []
                for i in range(low, high):
                    own = data[offsets[i - low] : offsets[i - low + 1]]
                    gone = covered(batch.column(2)[i].as_py(), len(own), width)
                    spans = int(np.count_nonzero(gone[1:] & ~gone[:-1])) + int(len(gone) > 0 and gone[0])
                    out.append((batch.column(0)[i].as_py(), len(own), int(gone.sum()), spans, own[~gone].tobytes()))
                kinds = [pa.int64()] * 4 + [pa.binary()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[j] for r in out], kind) for j, kind in enumerate(kinds)],
                    ["k_id", "n_bytes", "n_removed", "n_spans", "kept"],
                )

    joined = with_lists(rows, repeats, "left").select("k_id", "text", "segments")
    made = joined.mapInArrow(run, "k_id long, n_bytes long, n_removed long, n_spans long, kept binary")
    return made.select(own_id(), "n_bytes", "n_removed", "n_spans", "kept")
