"""Byte-level BPE: whole texts to token ids and back.

Encoding is by overlapping chunks. A long text is cut into chunks that overlap their successor;
chunks are dealt out over the tasks and each is split into pre-tokens on its own. Two neighbours
may see their common stretch differently: the later one starts inside a pre-token, the earlier one
ends inside one. From the first boundary on that both have, they agree; there they are stitched.
A boundary after white space is not taken, as what ends before it depends on what follows. The
pieces between stitches are encoded by merging the pair of lowest rank first. A chunk's overlap
is made long enough to hold a place where a non-space meets a space, which every split has as a
boundary, so there always is a stitch. A text up to a chunk's length is one chunk and does not
leave its task. Decoding looks up the bytes of each id and concatenates them.

Null text is empty and has no ids. Ids, repeated rows and other columns do not matter: each row
is encoded by itself, and rows with the same id and text have equal results. An empty table gives
an empty result. Memory is bounded by a batch of texts and one long text's ids.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import struct
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallylog.llm.shared import whole_text

#: Characters of a chunk and of the stretch it shares with the next, at least.
CHUNK_CHARS = 1 << 16
OVERLAP_CHARS = 256
#: Pre-tokens whose ids a task remembers; beyond that it starts anew.
REMEMBERED = 500_000

EDGE = regex.compile(r"\S\s")
#: White space in front of a space: where it stands, single spaces do not tell boundaries.
UNSURE = regex.compile(r"\s ")


def load_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a vocabulary file with a base64 token and its rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Token ids of one pre-token: of all adjacent pairs the one of lowest rank, leftmost first,
    is merged until no pair has a rank. Links and a heap keep long pieces at n log n."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    end = list(range(1, n + 1))  # of the part that starts at i
    before = list(range(-1, n - 1))
    alive = bytearray(b"\x01" * n)
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = end[i] if alive[i] else n
        if j >= n or end[j] != stop:
            continue  # one of the two has been merged since
        alive[j], end[i] = 0, stop
        if stop < n:
            before[stop] = i
            if (r := ranks.get(piece[i : end[stop]])) is not None:
                heapq.heappush(heap, (r, i, end[stop]))
        if (k := before[i]) >= 0 and (r := ranks.get(piece[k:stop])) is not None:
            heapq.heappush(heap, (r, k, stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


class PieceEncoder:
    """Ids of texts as little-endian unsigned 32-bit integers.

    A place where a non-space meets a single space that a non-space or the text's end follows is
    a boundary of every split, whatever surrounds it. So a text is first taken apart at single
    spaces; the stretches between are split into pre-tokens, and these are merged. Ids of
    stretches and of pre-tokens are remembered, up to a number of each.
    """

    def __init__(self, pattern: str, merged: Callable[[list[str]], Iterable[list[int]]]) -> None:
        self.split, self.merged = regex.compile(pattern), merged
        self.pieces: dict[str, bytes] = {}
        self.stretches: dict[str, bytes] = {}  # by what follows the space

    def encode_pieces(self, pieces: list[str]) -> bytes:
        known = self.pieces
        try:
            return b"".join(map(known.__getitem__, pieces))
        except KeyError:
            pass
        if len(known) > REMEMBERED:
            known.clear()
        new = list(set(pieces).difference(known))
        for piece, ids in zip(new, self.merged(new)):
            known[piece] = struct.pack(f"<{len(ids)}I", *ids)
        return b"".join(map(known.__getitem__, pieces))

    def encode(self, text: str) -> bytes:
        if UNSURE.search(text):
            return self.encode_pieces(self.split.findall(text))
        first, *rest = text.split(" ")
        known = self.stretches
        if len(known) > REMEMBERED:
            known.clear()
        new = list(set(rest).difference(known))
        if new:
            split = self.split.findall
            parts = [split(" " + stretch) for stretch in new]
            self.encode_pieces(list(chain.from_iterable(parts)))  # all missing ones at once
            for stretch, pieces in zip(new, parts):
                known[stretch] = b"".join(map(self.pieces.__getitem__, pieces))
        return self.encode_pieces(self.split.findall(first)) + b"".join(map(known.__getitem__, rest))


class ByteDecoder:
    """Bytes of token ids."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.tokens = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> PieceEncoder:
    """One per worker process and vocabulary."""
    ranks = load_ranks(path)
    return PieceEncoder(pattern, lambda pieces: [merge(p.encode(), ranks) for p in pieces])


@lru_cache(maxsize=2)
def decoder(path: str) -> ByteDecoder:
    """One per worker process and vocabulary."""
    return ByteDecoder(load_ranks(path))


def cut_chunks(text: str, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> Iterator[tuple[int, int, str]]:
    """(start, end, text from start to some way behind the end) of a text's chunks.

    Behind each end but the last there is a place, `overlap` characters on at most, at which a
    non-space meets a space; the chunk's text reaches that far. A stretch without such a place
    stays in one chunk.
    """
    n, start = len(text), 0
    while True:
        edge = EDGE.search(text, start + chunk) if start + chunk < n else None
        if edge is None:
            yield start, n, text[start:]
            return
        end = max(start + chunk, edge.start() - overlap)
        yield start, end, text[start : max(end + overlap, edge.end())]
        start = end


def split_chunk(start: int, end: int, text: str, last: bool, code: PieceEncoder) -> dict:
    """A chunk's ids, and its pre-tokens' boundaries that may be stitches: their places in the
    whole text and the number of ids in front of them, for the first and the last stretch."""
    pieces = code.split.findall(text)
    ids = [code.encode_pieces([p]) for p in pieces]
    place = start + np.cumsum([0, *map(len, pieces)])
    count = np.cumsum([0, *map(len, ids)]) // 4
    takes = np.array([True, *(not p[-1].isspace() for p in pieces)])
    if not last:
        takes &= place < start + len(text)  # the last pre-token may be cut
    heads = takes & (place <= start + 2 * OVERLAP_CHARS + 2)
    tails = takes & (place >= end)
    return {
        "start": start,
        "ids": b"".join(ids),
        "head_at": place[heads].tolist(),
        "head_ids": count[heads].tolist(),
        "tail_at": place[tails].tolist(),
        "tail_ids": count[tails].tolist(),
    }


def stitch(chunks: list[dict]) -> bytes:
    """Ids of a text from its chunks in order, each taken from one stitch to the next."""
    out, begin = [], 0
    for here, following in zip(chunks, [*chunks[1:], None]):
        if following is None:
            out.append(here["ids"][4 * begin :])
            break
        other = dict(zip(following["head_at"], following["head_ids"]))
        stop, after = next(
            (n, other[at]) for at, n in zip(here["tail_at"], here["tail_ids"]) if at in other
        )
        out.append(here["ids"][4 * begin : 4 * stop])
        begin = after
    return b"".join(out)


CHUNK_SCHEMA = "start long, ids binary, head_at array<long>, head_ids array<long>, tail_at array<long>, tail_ids array<long>"


def encode(
    docs: DataFrame, vocabulary: str, pattern: str, decoded: bool = False, chunk: int = CHUNK_CHARS
) -> DataFrame:
    """Token ids of each whole text: doc_id, ids (binary, little-endian unsigned 32-bit integers)
    and n_tokens, with `decoded` also the bytes that the ids stand for.

    `vocabulary` is the path of a rank file that every worker has, `pattern` what splits text into
    pre-tokens. Only texts longer than a chunk are shuffled: their chunks, then the chunks' ids.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    size = F.length("text")
    one = rows.where(size <= chunk).mapInArrow(
        lambda batches: _encode_whole(batches, vocabulary, pattern, decoded), _schema(decoded)
    )
    cut = (
        rows.where(size > chunk)
        .mapInArrow(
            lambda batches: _cut_batches(batches, chunk),
            "doc_id long, text_hash string, start long, end long, last boolean, text string",
        )
        .repartition("doc_id", "text_hash", "start")
        .mapInArrow(
            lambda batches: _split_batches(batches, vocabulary, pattern),
            "doc_id long, text_hash string, " + CHUNK_SCHEMA,
        )
    )
    many = cut.groupBy("doc_id", "text_hash").applyInArrow(
        lambda group: _stitch_group(group, vocabulary, decoded), _schema(decoded)
    )
    return one.unionByName(many)


def _schema(decoded: bool) -> str:
    return "doc_id long, ids binary, n_tokens long" + ", decoded binary" * decoded


def _batch(rows: list[tuple], decoded: bool) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.binary(), pa.int64(), pa.binary()][: 3 + decoded]
    names = ["doc_id", "ids", "n_tokens", "decoded"]
    return pa.RecordBatch.from_arrays(
        [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names[: len(kinds)]
    )


def _encode_whole(
    batches: Iterator[pa.RecordBatch], vocabulary: str, pattern: str, decoded: bool
) -> Iterator[pa.RecordBatch]:
    code, back = encoder(vocabulary, pattern), decoder(vocabulary)
    for batch in batches:
        rows, held = [], 0
        for doc_id, text in zip(batch.column(0), batch.column(1)):
            ids = code.encode(text.as_py())
            rows.append((doc_id.as_py(), ids, len(ids) // 4, back.decode(ids) if decoded else None))
            held += 2 * len(ids)
            if held > 4 << 20:
                yield _batch(rows, decoded)
                rows, held = [], 0
        yield _batch(rows, decoded)


def _cut_batches(batches: Iterator[pa.RecordBatch], chunk: int) -> Iterator[pa.RecordBatch]:
    """Chunks of texts; text_hash tells rows that share an id apart. It also has the row's place
    in the input, so that of equal rows (id and text) each keeps its own chunks."""
    part_id = TaskContext.get().partitionId()
    for number, batch in enumerate(batches):
        for row, (doc_id, text) in enumerate(zip(batch.column(0), batch.column(1))):
            text = text.as_py()
            # whatever the place, a row's chunks are made together and share their name
            name = f"{hashlib.blake2b(text.encode(), digest_size=12).hexdigest()}-{part_id}-{number}-{row}"
            cuts = list(cut_chunks(text, chunk))
            for low in range(0, len(cuts), 16):
                part = cuts[low : low + 16]
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": pa.array([doc_id.as_py()] * len(part), pa.int64()),
                        "text_hash": [name] * len(part),
                        "start": [c[0] for c in part],
                        "end": [c[1] for c in part],
                        "last": [c[1] == len(text) for c in part],
                        "text": [c[2] for c in part],
                    }
                )


def _split_batches(
    batches: Iterator[pa.RecordBatch], vocabulary: str, pattern: str
) -> Iterator[pa.RecordBatch]:
    code = encoder(vocabulary, pattern)
    longs = pa.list_(pa.int64())
    schema = pa.schema(
        [("doc_id", pa.int64()), ("text_hash", pa.string()), ("start", pa.int64()), ("ids", pa.binary())]
        + [(n, longs) for n in ("head_at", "head_ids", "tail_at", "tail_ids")]
    )
    for batch in batches:
        for row in range(batch.num_rows):
            doc_id, name, start, end, last, text = (c[row].as_py() for c in batch.columns)
            part = split_chunk(start, end, text, last, code)
            yield pa.RecordBatch.from_pylist([{"doc_id": doc_id, "text_hash": name} | part], schema)


def _stitch_group(group: pa.Table, vocabulary: str, decoded: bool) -> pa.Table:
    rows = group.sort_by("start").to_pylist()
    ids = stitch(rows)
    row = (rows[0]["doc_id"], ids, len(ids) // 4, decoder(vocabulary).decode(ids) if decoded else None)
    return pa.Table.from_batches([_batch([row], decoded)])


def decode(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id and the bytes that the ids stand for, concatenated; null ids are none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = decoder(vocabulary)
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                out = [code.decode(ids.as_py() or b"") for ids in part.column(1)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(out, pa.binary())], ["doc_id", "decoded"]
                )

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(
        run, "doc_id long, decoded binary"
    )
