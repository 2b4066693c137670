import random
import zlib
from collections import Counter, defaultdict

import brute
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from tallylog.llm import bpe, packing

RANKS, MODEL = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(RANKS), special_tokens={}
    )


def odd_text(rnd, n):
    parts = ["ab", "  ", "\n", " ", "'s", "'", "é", "12", ",.", "\t\n", "x" * rnd.randint(1, 40), "日本", "😀", " "]
    return "".join(rnd.choice(parts) for _ in range(n))


def test_chunks_are_stitched_exactly(reference):
    rnd = random.Random(1)
    code = bpe.encoder(RANKS, public_tokenizers.PATTERN)
    for _ in range(300):
        text = odd_text(rnd, rnd.randint(0, 120))
        chunk, overlap = rnd.choice([5, 8, 17, 30]), rnd.choice([1, 2, 5])
        cuts = list(bpe.cut_chunks(text, chunk, overlap))
        got = bpe.stitch([bpe.split_chunk(a, b, t, b == len(text), code) for a, b, t in cuts])
        expected = np.array(reference.encode_ordinary(text), "<u4").tobytes()
        assert got == expected == code.encode(text)


def test_long_pieces(reference):
    ranks = bpe.load_ranks(RANKS)
    for piece in (b"a" * 3000, b"abcd" * 900, "é".encode() * 800, b"\xff\xfe\x80"):
        if piece.isascii():
            assert bpe.merge(piece, ranks) == reference.encode_ordinary(piece.decode())
        assert b"".join({v: k for k, v in ranks.items()}[i] for i in bpe.merge(piece, ranks)) == piece


def test_encode_and_decode(spark, reference):
    rows = brute.texts(2, 30) + [(900, "word " * 30000 + "end"), (901, "x" * 70000 + " y"), (None, "a"), (5, "a"), (5, "a")]
    df = brute.frame(spark, rows)
    encoded = bpe.encode(df, RANKS, public_tokenizers.PATTERN, decoded=True, chunk=4096)
    got = Counter((r.doc_id, bytes(r.ids), r.n_tokens, bytes(r.decoded)) for r in encoded.collect())
    ids = {t: np.array(reference.encode_ordinary(t or ""), "<u4").tobytes() for _, t in rows}
    assert got == Counter((i, ids[t], len(ids[t]) // 4, (t or "").encode()) for i, t in rows)
    back = {r.doc_id: bytes(r.decoded) for r in bpe.decode(encoded, RANKS).where("doc_id >= 900").collect()}
    assert back == {900: rows[-5][1].encode(), 901: rows[-4][1].encode()}
    assert bpe.encode(df.where("doc_id < 0"), RANKS, public_tokenizers.PATTERN).collect() == []
    # equal long rows at equal places of different partitions
    long = brute.frame(spark, [(1, "some words " * 900)] * 6).repartition(3)
    again = bpe.encode(long, RANKS, public_tokenizers.PATTERN, chunk=4096).collect()
    assert [r.n_tokens for r in again] == [len(reference.encode_ordinary("some words " * 900))] * 6


def test_ids_are_the_library_tokenizers():
    model = Tokenizer.from_file(MODEL)
    model.encode_special_tokens = True
    code = packing.byte_level_encoding(MODEL, public_tokenizers.PATTERN)
    rnd = random.Random(3)
    for text in [t for _, t in brute.texts(3, 40) if t] + [odd_text(rnd, 60) for _ in range(60)] + ["a <|endoftext|> b"]:
        assert code.encode_ordinary(text) == model.encode(text, add_special_tokens=False).ids


def test_added_tokens_are_the_library_tokenizers(spark):
    model = Tokenizer.from_file(MODEL)
    end = "<|endoftext|>"
    texts = [f"a {end} b", end, f"{end}{end}", f"x  {end}\n\n y <|endoftext| {end.upper()}", f"a{end}b  ", "none"]
    found = packing.tokenize_pieces(
        brute.frame(spark, list(enumerate(texts))), MODEL, public_tokenizers.PATTERN, keep_ids=True
    ).collect()
    ids = {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in found}
    assert ids == {i: [*model.encode(t, add_special_tokens=False).ids, 0] for i, t in enumerate(texts)}
    assert ids[0] == [64, 220, 50256, 275, 0]


def placed(counts, capacity):
    bins, used = defaultdict(list), Counter()
    for length, low, high, first, offset, copies in packing.plan_packing(counts, capacity):
        for nth in range(high - low):
            bins[first + nth // copies].append((offset + nth % copies * length, length))
            used[length] += 1
    assert used == Counter({k: v for k, v in counts.items() if v})
    for content in bins.values():
        at = 0
        for offset, length in sorted(content):
            assert offset == at
            at += length
        assert at <= capacity
    return bins


def test_plans_are_gapless_and_tight():
    rnd = random.Random(4)
    for _ in range(300):
        capacity = rnd.choice([6, 10, 17, 64])
        counts = {rnd.randint(1, capacity): rnd.randint(0, 9) for _ in range(rnd.randint(0, 12))}
        bins = placed(counts, capacity)
        total = sum(k * v for k, v in counts.items())
        assert -(-total // capacity) <= len(bins) <= max(1, 2 * total // capacity + 1)
    assert placed({}, 10) == {}
    # large ones in pairs, small ones into the gaps
    assert len(placed({60: 3, 40: 3, 50: 2, 10: 0}, 100)) == 4
    assert len(placed({70: 2, 30: 2}, 100)) == 2
    with pytest.raises(ValueError):
        packing.plan_packing({11: 1}, 10)


def test_pack_documents(spark):
    rows = brute.texts(5, 60) + [(None, "a"), (7, "b"), (7, "b"), (800, "word " * 5000)]
    found = packing.pack_documents(brute.frame(spark, rows), MODEL, public_tokenizers.PATTERN, 512).collect()
    code = packing.byte_level_encoding(MODEL, public_tokenizers.PATTERN)
    expected = Counter()
    for i, text in rows:
        ids = [*code.encode_ordinary(text or ""), 0]
        stop, start, piece = len(ids) % 512 or 512, 0, 0
        while start < len(ids):
            part = ids[start:stop]
            expected[i, piece, start, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
            start, stop, piece = stop, stop + 512, piece + 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found) == expected
    bins = defaultdict(list)
    for r in found:
        bins[r.sequence_id].append((r.offset, r.length))
    for content in bins.values():
        at = 0
        for offset, length in sorted(content):
            assert offset == at
            at += length
        assert at <= 512
    total = sum(r.length for r in found)
    assert len(bins) <= total / 512 * 1.1 + 1
    empty = brute.frame(spark, rows).where("doc_id < 0")
    assert packing.pack_documents(empty, MODEL, public_tokenizers.PATTERN).collect() == []
