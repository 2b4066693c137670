"""Fingerprints of documents: every shingle hash below a fixed fraction of the hash range.

Shingles are five words, A-Z lower-cased; a text of fewer words is one shingle. Which hashes stay
depends on the shingle alone, not on the document, so fingerprints can be merged, and the overlap
of two of them estimates the overlap of the texts however unequal these are. A text none of whose
hashes is below the bound has its smallest hash as a stand-in (marked by "~"); it is dropped when
the fingerprint is merged with one that has hashes.

A fingerprint is a string: the first 48 of the hash bits that the bound leaves open, in base64, in
order. Equal texts have equal fingerprints. Null or empty text, or one of white space, has an empty
fingerprint, which is like nothing (0), not even another empty one.

A likeness is a share of the retained hashes, one in four of the shingles: from some 40 shingles on it
is off by 0.15 at most as a rule, below that it is coarse, and a text of under ten may share no
retained hash with a close edit.

Neighbours (`compare_with_next`): rows follow one another by descending id, null ids last, rows
that share an id by a digest of the text; after the last comes the first, a single row follows
itself. Other columns are ignored. An empty table gives an empty result. Rows are dealt out by ranges
of ids, and where one id, or none, has more rows than a range, of ids and digests; the first row of
each range is also given to the range before, so each text is shuffled once and no task sees more
than its range. Rows with one id and one text stay together.
"""

from __future__ import annotations

import base64
import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallylog.llm.shared import text_slices, whole_text
from tallylog.llm.words import distinct_pairs, split_words

SHINGLE_WORDS = 5
#: One hash in so many stays.
SCALE = 4
#: Rows that are compared at once, as far as their texts are short.
ROWS, CHARS = 400, 1 << 20


def sketches(texts: list[str], words: int = SHINGLE_WORDS, scale: int = SCALE) -> list[tuple[np.ndarray, bool]]:
    """For each text the retained hashes, sorted, and whether these are a stand-in."""
    out: list[tuple[np.ndarray, bool]] = []
    bound = np.uint64((1 << 64) // scale - 1)
    for _, _, data, offsets in text_slices(pa.array(texts, pa.string())):
        text, hashes = distinct_pairs(*split_words(data, offsets, lower=True).shingles(words))
        low = np.searchsorted(text, np.arange(len(offsets)))  # hashes of a text are sorted
        for i in range(len(offsets) - 1):
            own = hashes[low[i] : low[i + 1]]
            n = int(np.searchsorted(own, bound, "right"))
            out.append((own[:n] if n or not len(own) else own[:1], not n and len(own) > 0))
    return out


def as_text(sketch: tuple[np.ndarray, bool], scale: int = SCALE) -> str:
    hashes, stand_in = sketch
    spare = 0 if stand_in else int(scale).bit_length() - 1
    top = ((hashes << np.uint64(spare)) >> np.uint64(16)).astype(">u8")
    packed = top.view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()
    return "~" * stand_in + base64.b64encode(packed).decode()


def resemblance(a: tuple[np.ndarray, bool], b: tuple[np.ndarray, bool]) -> float:
    """Estimated share of common shingles among those of either text."""
    if not len(a[0]) or not len(b[0]):
        return 0.0
    both = len(np.intersect1d(a[0], b[0], assume_unique=True))
    return both / (len(a[0]) + len(b[0]) - both)


def containment(a: tuple[np.ndarray, bool], b: tuple[np.ndarray, bool]) -> float:
    """Estimated share of the first text's shingles that the second has."""
    return len(np.intersect1d(a[0], b[0], assume_unique=True)) / len(a[0]) if len(a[0]) else 0.0


def merge(a: tuple[np.ndarray, bool], b: tuple[np.ndarray, bool]) -> tuple[np.ndarray, bool]:
    """Fingerprint of two texts taken together."""
    if a[1] != b[1]:
        a, b = (a, b) if b[1] else (b, a)
        if len(a[0]):
            return a
    both = np.union1d(a[0], b[0])
    return (both[:1], True) if a[1] and b[1] else (both, False)


def fingerprint(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint and n_hashes of each document; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = sketches(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([as_text(s) for s in made], pa.string()), pa.array([len(s[0]) for s in made], pa.int64())],
                ["doc_id", "fingerprint", "n_hashes"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    return rows.mapInArrow(run, "doc_id long, fingerprint string, n_hashes long")


def _chunk(digest: Column, parts: int) -> Column:
    """Which of `parts` equal ranges of digests one lies in."""
    share = (digest.cast("double") + 2.0**63) / 2.0**64
    return F.least(F.floor(share * parts), F.lit(parts - 1)).cast("int")


def _range_number(bounds: list[tuple[int, int]], null_parts: int) -> Column:
    """Number of a row's range. A bound (id, parts), in descending order, is the least id of its
    range; the rows of an id with several parts are dealt out to them by digest, as are null ids."""
    doc_id, digest = F.col("doc_id"), F.col("digest")
    offsets = [0]
    for _, parts in bounds:
        offsets.append(offsets[-1] + parts)

    def tree(low: int, high: int) -> Column:
        """A balanced tree of comparisons."""
        if low == high:
            if low == len(bounds):
                return F.lit(offsets[low])
            bound, parts = bounds[low]
            return F.lit(offsets[low]) + (F.when(doc_id == bound, _chunk(digest, parts)).otherwise(0) if parts > 1 else 0)
        middle = (low + high) // 2
        return F.when(doc_id >= bounds[middle][0], tree(low, middle)).otherwise(tree(middle + 1, high))

    last = F.lit(offsets[-1] + 1) + _chunk(digest, null_parts)
    return F.when(doc_id.isNull(), last).otherwise(tree(0, len(bounds)))


def with_follower(docs: DataFrame) -> DataFrame:
    """Rows (part, guest, doc_id, text) in partitions by descending id. A part's rows stand
    together in order, behind them as a guest the row that follows its last one."""
    spark = docs.sparkSession
    text = whole_text()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("digest"))
    parts = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    sizes = rows.agg(F.count("*").alias("n"), F.count("doc_id").alias("named")).first()
    if not sizes["n"]:
        return rows.select(F.lit(0).alias("part"), F.lit(0).alias("guest"), "doc_id", "text")
    # ranges in proportion to what has an id and what has none; an id that fills several gets as many
    null_parts = max(1, round(parts * (sizes["n"] - sizes["named"]) / sizes["n"]))
    id_parts = max(2, parts - null_parts)
    shares = [i / id_parts for i in range(1, id_parts)]
    quantiles = rows.select("doc_id").approxQuantile("doc_id", shares, min(0.01, 0.25 / parts))
    bounds = sorted(Counter(map(int, quantiles)).items(), reverse=True)
    numbered = rows.withColumn("part", _range_number(bounds, null_parts))
    # the first row of a range has the greatest id, and the least digest among its rows
    order = F.struct(F.col("doc_id").alias("id"), F.bitwise_not("digest").alias("low"))
    tops = {r["part"]: r["top"] for r in numbered.groupBy("part").agg(F.max(order).alias("top")).collect()}
    used = sorted(tops)
    before = dict(zip(used, [used[-1], *used[:-1]]))
    n = used[-1] + 1
    by_part = lambda value: F.array(*[F.lit(value(p)).cast("long") for p in range(n)])
    top_id = by_part(lambda p: tops[p]["id"] if p in tops else None)
    top_low = by_part(lambda p: tops[p]["low"] if p in tops else None)
    host = by_part(lambda p: before.get(p, p))
    part = F.col("part")
    first = F.get(top_id, part).eqNullSafe(F.col("doc_id")) & (F.get(top_low, part) == F.bitwise_not("digest"))
    places = F.array_compact(
        F.array(
            F.struct(part.cast("long").alias("part"), F.lit(0).alias("guest")),
            F.when(first, F.struct(F.get(host, part).alias("part"), F.lit(1).alias("guest"))),
        )
    )
    placed = numbered.select(F.explode(places).alias("place"), "doc_id", "text", "digest")
    return (
        placed.select("place.part", "place.guest", "doc_id", "text", "digest")
        .repartitionByRange(n, "part")
        .sortWithinPartitions("part", "guest", F.col("doc_id").desc_nulls_last(), "digest", "text")
        .drop("digest")
    )


def compare_with_next(docs: DataFrame) -> DataFrame:
    """Each document against an edited form of itself and against the next document.

    The edited text has its last third (rounded down, in code points) replaced by as many first
    code points of the next document, or all it has. Columns: doc_id, n_chars, edited_sha256,
    fingerprint, edited_fingerprint, near_edited, near_next, contained_next.
    """
    names = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, contained_next double"
    kinds = {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}
    schema = pa.schema([(n, kinds[k]) for n, k in (x.split() for x in names.split(", "))])

    def compared(rows: list[tuple[int | None, str, bool]]) -> pa.RecordBatch:
        """All but the last row, each against the one behind it."""
        texts = [r[1] for r in rows]
        edited = []
        for text, following in zip(texts, texts[1:]):
            cut = len(text) // 3
            edited.append(text[: len(text) - cut] + following[:cut])
        made, changed = sketches(texts), sketches(edited)
        out = []
        for i, (doc_id, text, guest) in enumerate(rows[:-1]):
            if guest:
                continue
            own, new, following = made[i], changed[i], made[i + 1]
            digest = hashlib.sha256(edited[i].encode()).hexdigest()
            out.append((doc_id, len(text), digest, as_text(own), as_text(new), resemblance(own, new), resemblance(own, following), containment(own, following)))
        columns = zip(*out) if out else [[]] * len(schema)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int | None, str, bool]] = []
        part, chars = None, 0
        for batch in batches:
            for of, guest, doc_id, text in zip(*(c for c in batch.columns)):
                if of.as_py() != part:
                    if len(held) > 1:
                        yield compared(held)
                    held, part, chars = [], of.as_py(), 0
                held.append((doc_id.as_py(), text.as_py(), guest.as_py() == 1))
                chars += len(held[-1][1])
                if len(held) > 1 and (len(held) > ROWS or chars > CHARS):
                    yield compared(held)
                    held = held[-1:]
                    chars = len(held[0][1])
        if len(held) > 1:
            yield compared(held)

    return with_follower(docs).mapInArrow(run, names)
