"""Which windows of documents stand twice, screened by content-defined segments.

A window is `width` consecutive units (words or bytes) of one document. The least hash among its
k-grams, the leftmost of equal ones, is its anchor: it depends on the window's content alone, so
equal windows have equal anchors at equal places in them. Consecutive windows with one anchor form
a segment; the stretch of units under a segment covers its windows and nothing else.

* An anchor k-gram that stands once: no window of its segment stands twice.
* All segments of an anchor k-gram have equal stretches: all their windows stand twice.
* Otherwise the segments are mixed. Those whose own stretch stands twice are decided, too; one of
  each kind stays as a witness for the rest, whose windows are still open.

So all but the edges of repeated passages are decided with one row per segment, about
2 / (width - k + 2) of the units, and the operators that use this decide the open windows each by
its own method. Rows are summed up by k-gram before any join; the join on a k-gram that many
documents share is split by Spark.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallylog.llm.shared import cut, row_key, split_join, text_slices, whole_text
from tallylog.llm.words import BYTE, prefix_sums, split_words, stretches

PLACE_BITS = 24
#: Units of one text worked on at once; windows of longer ones are cut into pieces of so many.
PIECE_UNITS = 1 << 23
#: Stands for a null id.
NO_ID = -(2**63)


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Least of each `width` consecutive values, by doubling."""
    out, reach = values, 1
    while 2 * reach <= width:
        out = np.minimum(out[:-reach], out[reach:])
        reach *= 2
    rest = width - reach
    return np.minimum(out[:-rest], out[rest:]) if rest else out


@dataclass(frozen=True)
class Segments:
    """Segments of several texts: text, first window, number of windows, hash of the anchor k-gram
    and of the whole stretch."""

    text: np.ndarray
    start: np.ndarray
    count: np.ndarray
    anchor: np.ndarray
    stretch: np.ndarray


def segments(values: np.ndarray, bounds: np.ndarray, width: int, k: int) -> Segments:
    """Segments of the texts values[bounds[i]:bounds[i + 1]]."""
    parts = []
    for low in range(0, max(len(values), 1), PIECE_UNITS):
        high = min(len(values), low + PIECE_UNITS + width - 1)
        if high - low >= width:
            parts.append(_segments(values[low:high], bounds, low, width, k))
    if not parts:
        none = np.zeros(0, np.int64)
        return Segments(none, none, none, none.view(np.uint64), none.view(np.uint64))
    return Segments(*(np.concatenate(x) for x in zip(*parts)))


def _segments(values: np.ndarray, bounds: np.ndarray, low: int, width: int, k: int) -> tuple:
    n = len(values)
    sums = prefix_sums(values)
    places = np.arange(n - k + 1, dtype=np.int64)
    grams = stretches(sums, places, places + k)
    shift = np.uint64(PLACE_BITS)
    least = sliding_least((grams >> shift << shift) | places.astype(np.uint64), width - k + 1)
    inside = np.ones(len(least), bool)  # windows that lie within one text
    for edge in (bounds[(bounds > low) & (bounds < low + n)] - low).tolist():
        inside[max(0, edge - width + 1) : edge] = False
    starts = np.flatnonzero(inside)
    anchor = (least[starts] & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64)
    new = np.ones(len(starts), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (starts[1:] != starts[:-1] + 1)
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(starts)))
    start = starts[first]
    whole = stretches(sums, start, start + count + width - 1, seed=1)
    text = np.searchsorted(bounds, start + low, "right") - 1
    return text, start + low - bounds[text], count, grams[anchor[first]], whole


def keyed(docs: DataFrame) -> DataFrame:
    """k_id, k_th and text of each row (`row_key`)."""
    return docs.select(*row_key(), whole_text().alias("text"))


def own_id() -> Column:
    return F.when(F.col("k_id") != NO_ID, F.col("k_id")).alias("doc_id")


def word_units(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    words = split_words(data, offsets)
    return words.hashes, words.word_at


def byte_units(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return BYTE[data], offsets


Units = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def segment_rows(rows: DataFrame, units: Units, width: int, k: int) -> DataFrame:
    """Segments of keyed rows: anchor, stretch, k_id, k_th, start, count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, data, offsets in text_slices(batch.column(2)):
                found = segments(*units(data, offsets), width, k)
                row = pa.array(low + found.text)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(found.anchor.view(np.int64)),
                        pa.array(found.stretch.view(np.int64)),
                        batch.column(0).take(row),
                        batch.column(1).take(row),
                        pa.array(found.start.astype(np.int32)),
                        pa.array(found.count.astype(np.int32)),
                    ],
                    ["anchor", "stretch", "k_id", "k_th", "start", "count"],
                )

    return rows.mapInArrow(run, "anchor long, stretch long, k_id long, k_th long, start int, count int")


def screen(rows: DataFrame, units: Units, width: int, k: int) -> tuple[DataFrame, DataFrame]:
    """(decided, open) segments of keyed rows.

    decided: k_id, k_th, start, count of segments all of whose windows stand twice.
    open: anchor, k_id, k_th, start, count of segments whose windows are to be compared with each
    other, one segment for each stretch, and `single` where its own windows are undecided.
    """
    found = segment_rows(rows, units, width, k)
    by_anchor = found.groupBy("anchor").agg(
        F.count("*").alias("_n"), F.min("stretch").alias("_low"), F.max("stretch").alias("_high")
    )
    shared = by_anchor.where("_n > 1").select("anchor", (F.col("_low") != F.col("_high")).alias("mixed"))
    # read several times below, so written once to the shared folder
    candidates = cut(split_join(found, shared, ["anchor"]))
    alike = candidates.where(~F.col("mixed"))
    mixed = candidates.where("mixed")
    place = F.struct("k_id", "k_th", "start", "count")
    kinds = mixed.groupBy("anchor", "stretch").agg(F.count("*").alias("_n"), F.min(place).alias("_first"))
    twice = split_join(mixed, kinds.where("_n > 1").select("anchor", "stretch"), ["anchor", "stretch"], "left_semi")
    names = ["k_id", "k_th", "start", "count"]
    decided = alike.select(names).unionByName(twice.select(names))
    return decided, kinds.select("anchor", "_first.*", (F.col("_n") == 1).alias("single"))


def by_document(segments_: DataFrame, *also: str) -> DataFrame:
    """Lists of (start, count, ...) per row key. Rows of one key have the same segments, which are
    listed once, so a list is no longer than its text has windows, however many copies there are."""
    return segments_.groupBy("k_id", "k_th").agg(F.collect_set(F.struct("start", "count", *also)).alias("segments"))


def with_lists(rows: DataFrame, lists: DataFrame, how: str = "inner") -> DataFrame:
    """k_id, k_th, text and segments of keyed rows; a key with very many rows is split by Spark.

    The keys are rewritten for the join (see `split_join`) and back, so that every such join deals
    out the same three columns of the rows, which Spark then does once.
    """
    keys = [F.bitwise_not("k_id").alias("_i"), F.bitwise_not("k_th").alias("_t")]
    joined = rows.select(*keys, "text").join(lists.select(*keys, "segments"), ["_i", "_t"], how)
    return joined.select(F.bitwise_not("_i").alias("k_id"), F.bitwise_not("_t").alias("k_th"), "text", "segments")


def covered(segments_: list[dict] | None, n: int, width: int) -> np.ndarray:
    """Which of a document's n units the windows of these segments cover."""
    edge = np.zeros(n + 1, np.int64)
    if segments_ is not None and len(segments_):
        start = np.fromiter((s["start"] for s in segments_), np.int64, len(segments_))
        count = np.fromiter((s["count"] for s in segments_), np.int64, len(segments_))
        np.add.at(edge, start, 1)
        np.add.at(edge, np.minimum(start + count - 1 + width, n), -1)
    return np.cumsum(edge[:-1]) > 0
