"""Packing documents into as few sequences of a fixed number of tokens as possible.

Lengths are whole numbers up to the capacity, so the plan is made on how many pieces there are of
each length, a table of `capacity` rows at most, whatever the number of documents:

1. Pieces above a third of the capacity ("large") fit two to a sequence at most. They are matched
   greedily, the longest first with the longest that still fits beside it.
2. Smaller pieces, the longest first, go where they leave the smallest gap (best fit); what fits
   nowhere opens new sequences.

A step of the plan deals with all sequences of one gap at once: "each of these sequences gets one
(or k) of the pieces of this length". Pieces of a length are interchangeable, so carrying out the
plan is to number the pieces of each length and look the number up in the plan. Numbering counts
each (length, block of rows) first and adds up the counts, so that a length which a third of all
pieces share is spread over many tasks.

Null text is an empty document: its end-of-document id alone. A document longer than the capacity
is cut into pieces of full capacity; what is left over is its first piece. Null ids, repeated ids
and equal rows are packed row by row. Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import bisect
import json
import math
import zlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallylog.llm.shared import cut, whole_text

CAPACITY = 2048
#: Plan rows up to which the plan is broadcast: 40 bytes each. Beyond, Spark joins as it sees fit.
BROADCAST_STEPS = 200_000


def byte_of() -> dict[str, int]:
    """The byte behind each character of a byte-level vocabulary: printable ones stand for
    themselves, the others, in order, for the characters from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


@lru_cache(maxsize=2)
def byte_level_encoding(path: str, pattern: str) -> tiktoken.Encoding:
    """An encoder with the ids of a byte-level BPE tokenizer file, its added tokens being special
    ones. It needs the file's merges to be in the order of their ids, so that an id is a rank, and
    added tokens that take no part of the text around them, and refuses other files."""
    with open(path, encoding="utf-8") as file:
        content = json.load(file)
    model, added = content["model"], content.get("added_tokens") or []
    if any(t.get(option) for t in added for option in ("single_word", "lstrip", "rstrip")):
        raise ValueError(f"{path}: added tokens depend on the text around them")
    special = {t["content"]: t["id"] for t in added}
    byte = byte_of()
    vocabulary: dict[str, int] = model["vocab"]
    merges = [pair.split(" ") if isinstance(pair, str) else pair for pair in model["merges"]]
    made = [vocabulary[left + right] for left, right in merges]
    if made != sorted(made) or len(made) + 256 != len({*made, *(vocabulary[c] for c in byte)}):
        raise ValueError(f"{path}: ids do not follow the merges")
    ranks = {
        bytes(byte[c] for c in token): rank
        for token, rank in vocabulary.items()
        if token not in special and all(c in byte for c in token)
    }
    return tiktoken.Encoding("vocabulary", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)


def tokenize_pieces(
    docs: DataFrame, tokenizer: str, pattern: str, capacity: int = CAPACITY, end_id: int = 0, keep_ids: bool = False
) -> DataFrame:
    """Each document's ids, with `end_id` behind, as pieces of up to `capacity` ids: doc_id, piece,
    start, length, ids_crc32 (of the ids as little-endian unsigned 32-bit integers) and, if asked
    for, the ids themselves."""
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = byte_level_encoding(tokenizer, pattern)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                ids = code.encode_to_numpy(text.as_py(), allowed_special="all").astype("<u4").tobytes() + end
                n = len(ids) // 4
                start, stop, piece = 0, n % capacity or capacity, 0
                while start < n:
                    part = ids[4 * start : 4 * stop]
                    rows.append((doc_id.as_py(), piece, start, stop - start, zlib.crc32(part), part))
                    start, stop, piece = stop, stop + capacity, piece + 1
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()][: 5 + keep_ids]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: 5 + keep_ids]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    return rows.mapInArrow(run, schema)


def plan_packing(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Steps (length, first rank, end rank, first sequence, offset, copies): the pieces of a length
    with ranks from first to end go, `copies` to a sequence, to consecutive sequences from the
    first on, behind one another from the offset on. The last sequence of a step may get fewer."""
    left = {n: c for n, c in counts.items() if c > 0}
    if any(not 0 < n <= capacity for n in left):
        raise ValueError("lengths are from 1 to the capacity")
    used = dict.fromkeys(left, 0)
    steps: list[tuple[int, int, int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = {}  # by gap: (first sequence, number of sequences)
    open_gaps: list[int] = []  # the keys of gaps, sorted
    opened = 0

    def take(length: int, number: int, first: int, offset: int, copies: int = 1) -> None:
        steps.append((length, used[length], used[length] + number, first, offset, copies))
        used[length] += number
        left[length] -= number
        if not left[length]:
            del left[length]

    def leave(gap: int, first: int, number: int) -> None:
        if gap and number:
            if gap not in gaps:
                bisect.insort(open_gaps, gap)
            gaps.setdefault(gap, []).append((first, number))

    large = sorted(n for n in left if 3 * n > capacity)
    while large:
        length = large[-1]
        if length not in left:
            large.pop()
            continue
        beside = bisect.bisect_right(large, capacity - length)
        while beside and large[beside - 1] not in left:
            del large[beside - 1]
            beside -= 1
        partner = large[beside - 1] if beside else None
        if partner == length and left[length] == 1:
            partner = large[beside - 2] if beside > 1 else None
            if partner is not None and partner not in left:
                del large[beside - 2]
                continue
        if partner is None:
            number = left[length]
            take(length, number, opened, 0)
            leave(capacity - length, opened, number)
        else:
            number = left[length] // 2 if partner == length else min(left[length], left[partner])
            take(length, number, opened, 0)
            take(partner, number, opened, length)
            leave(capacity - length - partner, opened, number)
        opened += number

    for length in sorted(left, reverse=True):
        while length in left:
            at = bisect.bisect_left(open_gaps, length)
            if at == len(open_gaps):
                copies = min(capacity // length, left[length])
                number = left[length] // copies
                take(length, number * copies, opened, 0, copies)
                leave(capacity - copies * length, opened, number)
                opened += number
                continue
            gap = open_gaps[at]
            first, number = gaps[gap].pop()
            if not gaps[gap]:
                del gaps[gap], open_gaps[at]
            copies = min(gap // length, left[length])
            filled = min(number, left[length] // copies)
            take(length, filled * copies, first, capacity - gap, copies)
            leave(gap - copies * length, first, filled)
            leave(gap, first + filled, number - filled)
    return steps


def number_pieces(pieces: DataFrame, n_rows: int) -> DataFrame:
    """The pieces with `rank`, 0, 1, ... among those of the same length, in no meant order."""
    blocks = math.isqrt(n_rows) + 1  # as many blocks as a block has rows
    blocked = pieces.withColumn("_block", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(blocks)))
    counts = blocked.groupBy("length", "_block").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("length").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        "length", "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")
    )
    inside = Window.partitionBy("length", "_block").orderBy("doc_id", "piece")
    return (
        blocked.withColumn("_inside", F.row_number().over(inside) - 1)
        .join(offsets, ["length", "_block"])
        .withColumn("rank", F.col("_before") + F.col("_inside"))
        .drop("_block", "_before", "_inside")
    )


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The pieces (any columns, with doc_id, piece, length and ids_crc32) with sequence_id and
    offset. The pieces are written once to the shared folder, as several passes read them."""
    spark: SparkSession = pieces.sparkSession
    held = cut(pieces)
    # at most `capacity` rows, whatever the input
    counts = {r["length"]: r["count"] for r in held.groupBy("length").count().collect()}
    steps = plan_packing(counts, capacity)
    plan = spark.createDataFrame(
        steps, "_length long, _low long, _high long, _first long, _offset long, _copies long"
    )
    if len(steps) <= BROADCAST_STEPS:
        plan = F.broadcast(plan)
    ranked = number_pieces(held, sum(counts.values()))
    in_step = (F.col("length") == F.col("_length")) & F.col("rank").between(F.col("_low"), F.col("_high") - 1)
    nth = F.col("rank") - F.col("_low")
    return ranked.join(plan, in_step).select(
        *pieces.columns,
        (F.col("_first") + F.floor(nth / F.col("_copies")).cast("long")).alias("sequence_id"),
        (F.col("_offset") + F.pmod(nth, F.col("_copies")) * F.col("length")).alias("offset"),
    )


def pack_documents(docs: DataFrame, tokenizer: str, pattern: str, capacity: int = CAPACITY) -> DataFrame:
    """All documents as packed pieces: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack(tokenize_pieces(docs, tokenizer, pattern, capacity), capacity)
