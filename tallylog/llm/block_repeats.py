"""Removing passages of words that stand anywhere else, by fixed-block anchors.

A window of `width` words that also starts at another place, in the same document or another one,
is a repeat; every word under a repeat is removed, at all its places.

1. Screening by content-defined segments (`repeats`) decides what is no repeat and what repeats
   with its surroundings; open are stretches around the edges of repeated passages.
2. Fixed-block anchors for these: the documents' non-overlapping blocks of half a window (aligned
   to the document's start) are the index; a window of `width` words always contains one of them.
   Every rolling block of the open stretches probes the index. A hit is a block that is indexed
   and found at another place, too.
3. Hits are extended to maximal repeats: the windows around a hit that contain it are compared
   with those around its other places, one word further at a time, which is a count of equal
   windows; touching repeats are one maximal repeat.

No pair of places is ever made: probes and windows are counted by hash (64 bits), and partial
counts are made before each shuffle, so passages in a third of all documents cost what rows they
have.

Words are runs of characters other than space and tab to carriage return, unchanged. Null or empty
text, and texts shorter than a window, lose nothing and repeat nothing. Rows with equal texts are
repeats of each other, also where they share an id; of rows with one id and text the segments are
listed once. Null ids are kept apart by text. Other columns
are ignored by `find_repeats` and kept by `remove_repeats`. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallylog.llm.repeats import by_document, covered, keyed, own_id, screen, with_lists, word_units
from tallylog.llm.shared import row_key, split_join, text_slices
from tallylog.llm.words import prefix_sums, split_words, stretches

WIDTH = 35
#: Words of an anchor's k-gram in the screening.
GRAM = 8


def block_words(width: int) -> int:
    """The longest block of which every window contains an aligned one."""
    return (width + 1) // 2


def _word_places(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """All of starts[i] .. starts[i] + counts[i] - 1, once each, sorted."""
    if not len(starts):
        return np.zeros(0, np.int64)
    ends = np.cumsum(counts)
    return np.unique(np.arange(ends[-1]) - np.repeat(ends - counts, counts) + np.repeat(starts, counts))


def _lists(column: pa.Array, row: int, first: str, second: str) -> tuple[np.ndarray, np.ndarray]:
    values = column[row].values
    return (
        values.field(first).to_numpy(zero_copy_only=False).astype(np.int64),
        values.field(second).to_numpy(zero_copy_only=False).astype(np.int64),
    )


def _rolling(rows: DataFrame, listed: DataFrame, width: int, block: int, probes: bool) -> DataFrame:
    """Hashes of rolling blocks (`probes`) or of windows of the listed segments, with their places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            for low, high, data, offsets in text_slices(batch.column(2)):
                words = split_words(data, offsets)
                sums = prefix_sums(words.hashes)
                row, place = [], []
                for i in range(low, high):
                    start, count = _lists(lists, i, "start", "count")
                    # a segment's stretch is count + width - 1 words
                    found = _word_places(start, count + (width - block if probes else 0))
                    row.append(np.full(len(found), i))
                    place.append(found)
                row, place = np.concatenate(row), np.concatenate(place)
                first = words.word_at[row - low] + place
                size = block if probes else width
                fits = first + size <= words.word_at[row - low + 1]
                row, place, first = row[fits], place[fits], first[fits]
                hashes = stretches(sums, first, first + size, seed=2)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(hashes.view(np.int64)),
                        batch.column(0).take(pa.array(row)),
                        batch.column(1).take(pa.array(row)),
                        pa.array(place.astype(np.int32)),
                    ],
                    ["hash", "k_id", "k_th", "place"],
                )

    return with_lists(rows, listed).mapInArrow(run, "hash long, k_id long, k_th long, place int")


def find_repeats(rows: DataFrame, width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """Repeats of keyed rows as lists per row key: k_id, k_th and segments (start, count), each
    `count` windows that stand elsewhere, too, from word `start` on."""
    block = block_words(width)
    decided, open_ = screen(rows, word_units, width, gram)

    # blocks of the open stretches against every rolling block of them
    probes = _rolling(rows, by_document(open_), width, block, probes=True)
    aligned = F.col("place") % block == 0
    index = probes.groupBy("hash").agg(F.count("*").alias("_n"), F.max(aligned).alias("_indexed"))
    hits = split_join(probes, index.where("_n > 1 and _indexed").select("hash"), ["hash"], "left_semi")
    # the windows that contain a hit start up to width - block words before it
    start = F.greatest(F.col("place") - (width - block), F.lit(0))
    around = hits.select("k_id", "k_th", start.alias("start"), (F.col("place") - start + 1).alias("count"))

    windows = _rolling(rows, by_document(around), width, block, probes=False)
    again = windows.groupBy("hash").agg(F.count("*").alias("_n")).where("_n > 1").select("hash")
    repeats = split_join(windows, again, ["hash"], "left_semi")
    return by_document(
        decided.unionByName(repeats.select("k_id", "k_th", F.col("place").alias("start"), F.lit(1).alias("count")))
    )


def _digests(rows: DataFrame, repeats: DataFrame, width: int) -> DataFrame:
    """doc_id, n_words, n_removed, and kept: the words that stay, joined by a space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for low, high, data, offsets in text_slices(batch.column(1)):
                words = split_words(data, offsets)
                raw = data.tobytes()
                for i in range(low, high):
                    at = slice(words.word_at[i - low], words.word_at[i - low + 1])
                    first, end = words.first[at], words.end[at]
                    gone = covered(batch.column(2)[i].as_py(), len(first), width)
                    kept = b" ".join(raw[a:b] for a, b in zip(first[~gone].tolist(), end[~gone].tolist()))
                    out.append((batch.column(0)[i].as_py(), len(first), int(gone.sum()), kept))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[j] for r in out], kind) for j, kind in enumerate(kinds)],
                ["k_id", "n_words", "n_removed", "kept"],
            )

    joined = with_lists(rows, repeats, "left").select("k_id", "text", "segments")
    made = joined.mapInArrow(run, "k_id long, n_words long, n_removed long, kept binary")
    return made.select(own_id(), "n_words", "n_removed", "kept")


def kept_words(docs: DataFrame, width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """Each document's words without repeats: doc_id, n_words, n_removed, kept (UTF-8, the words
    that stay joined by one space)."""
    rows = keyed(docs)
    return _digests(rows, find_repeats(rows, width, gram), width)


def remove_repeats(docs: DataFrame, width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """The documents with repeats cut out of `text`; what lies between the words that stay is kept
    as it is, but for the space behind a cut. Other columns, n_chars included, stay as they are."""
    repeats = find_repeats(keyed(docs), width, gram)
    names = docs.columns
    whole = docs.select(F.struct(*names).alias("_row"))
    rows = whole.select(*row_key("_row.doc_id", "_row.text"), "_row")
    joined = split_join(rows, repeats, ["k_id", "k_th"], "left")

    @F.pandas_udf("string")
    def cut_out(texts: pd.Series, segments: pd.Series) -> pd.Series:
        out = []
        for value, listed in zip(texts, segments):
            if value is None or listed is None or not len(listed):
                out.append(value)
                continue
            data = value.encode()
            words = split_words(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
            gone = covered(listed, len(words.first), width)
            # from the first removed word of a run to the next word that stays
            edge = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
            next_word = np.append(words.first, len(data))
            parts, at = [], 0
            for a, b in edge.reshape(-1, 2).tolist():
                parts.append(data[at : words.first[a]])
                at = int(next_word[b])
            out.append(b"".join([*parts, data[at:]]).decode())
        return pd.Series(out, dtype=object)

    found = joined.select("_row", cut_out(F.col("_row.text"), F.col("segments")).alias("_text"))
    return found.select(*[F.col("_text").alias("text") if c == "text" else F.col("_row")[c].alias(c) for c in names])
