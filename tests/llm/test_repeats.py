import random
import time
from collections import Counter
from pathlib import Path

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from tallylog.llm import block_repeats, suffix_dedup
from tallylog.llm.repeats import segments, sliding_least
from tallylog.llm.shared import cut, split_join
from tallylog.llm.words import BYTE


def test_sliding_least():
    rng = np.random.default_rng(1)
    for width in (1, 2, 7, 16, 29):
        x = rng.integers(0, 50, 90).astype(np.uint64)
        assert sliding_least(x, width).tolist() == [x[i : i + width].min() for i in range(90 - width + 1)]


def test_segments_cover_each_window_once():
    rng = np.random.default_rng(2)
    data = rng.integers(97, 100, 500).astype(np.uint8)
    bounds = np.array([0, 3, 120, 120, 300, 500])
    found = segments(BYTE[data], bounds, 20, 6)
    windows = Counter()
    for text, start, count in zip(found.text, found.start, found.count):
        windows.update((int(text), int(s)) for s in range(start, start + count))
    expected = {(i, s) for i in range(5) for s in range(bounds[i + 1] - bounds[i] - 19)}
    assert set(windows) == expected and set(windows.values()) <= {1}


@pytest.mark.parametrize("seed", [3, 4])
def test_words_against_brute_force(spark, seed):
    rows = brute.texts(seed)
    found = {r.doc_id: r for r in block_repeats.kept_words(brute.frame(spark, rows)).collect()}
    units = [[w.encode() for w in brute.words_of(t)] for _, t in rows]
    for (i, _), u, gone in zip(rows, units, brute.repeated_units(units, 35)):
        kept = b" ".join(w for w, g in zip(u, gone) if not g)
        assert (found[i].n_words, found[i].n_removed, bytes(found[i].kept)) == (len(u), sum(gone), kept)
    assert any(sum(g) for g in brute.repeated_units(units, 35))


def test_bytes_against_brute_force(spark):
    rows = brute.texts(5)
    found = {r.doc_id: r for r in suffix_dedup.kept_bytes(brute.frame(spark, rows)).collect()}
    units = [(t or "").encode() for _, t in rows]
    for (i, _), u, gone in zip(rows, units, brute.repeated_units(units, 200)):
        spans = sum(g and not before for before, g in zip([False, *gone], gone))
        kept = bytes(b for b, g in zip(u, gone) if not g)
        r = found[i]
        assert (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) == (len(u), sum(gone), spans, kept)


def test_bytes_of_hot_anchors_are_counted(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT_STRETCHES", 1)
    rows = brute.texts(6, 60)
    found = {r.doc_id: r.n_removed for r in suffix_dedup.kept_bytes(brute.frame(spark, rows)).collect()}
    gone = brute.repeated_units([(t or "").encode() for _, t in rows], 200)
    assert found == {i: sum(g) for (i, _), g in zip(rows, gone)}


def test_suffixes_against_counts():
    rnd = random.Random(7)
    for _ in range(60):
        alphabet = rnd.choice([b"ab", b"abc", b"a", b"abcdefgh"])
        text = bytes(rnd.choice(alphabet) for _ in range(rnd.randint(20, 300)))
        text += text[: rnd.randint(0, 100)]
        width = rnd.choice([16, 20, 25])
        places = np.arange(max(0, len(text) - width + 1))
        seen = Counter(text[i : i + width] for i in places)
        again = suffix_dedup.repeated_suffixes(text, places, width, 8)
        assert again.tolist() == [seen[text[i : i + width]] > 1 for i in places]
        trie = suffix_dedup.BlindTrie(text, width)
        for p in places.tolist():
            trie.insert(p)
        assert [text[leaf[0] : leaf[0] + width] for leaf in trie.leaves()] == sorted(seen)


def test_repeated_rows_null_ids_and_shared_ids(spark):
    long = " ".join(f"w{i}" for i in range(80))
    rows = [(None, long), (None, "other text"), (1, long), (1, long), (2, "short"), (2, " ".join(f"v{i}" for i in range(90)))]
    found = block_repeats.kept_words(brute.frame(spark, rows)).collect()
    assert len(found) == 6
    got = Counter((r.doc_id, r.n_words, r.n_removed) for r in found)
    assert got == Counter([(None, 80, 80), (None, 2, 0), (1, 80, 80), (1, 80, 80), (2, 1, 0), (2, 90, 0)])


def test_cut_texts_keep_their_columns(spark):
    passage = " ".join(f"p{i}" for i in range(40))
    rows = [(1, f"a  b\n{passage}\nc d"), (2, f"{passage} z"), (3, None), (4, "x\ty")]
    df = brute.frame(spark, rows)
    found = block_repeats.remove_repeats(df)
    assert found.columns == df.columns
    assert {r.doc_id: r.text for r in found.collect()} == {1: "a  b\nc d", 2: "z", 3: None, 4: "x\ty"}


def test_empty_tables(spark):
    empty = brute.frame(spark, [(1, "a")]).where("doc_id > 1")
    assert block_repeats.kept_words(empty).collect() == []
    assert suffix_dedup.kept_bytes(empty).collect() == []


def test_texts_of_equal_short_digests_stay_apart(spark):
    """Two texts with null ids whose 32-bit hashes are equal; one holds a repeated passage."""
    passage, clean = " ".join(f"p{i}" for i in range(60)), " ".join(f"c{i}" for i in range(60))
    many = spark.range(200_000).selectExpr(f"concat('{passage} a', id) as a", f"concat('{clean} b', id) as b")
    same = many.selectExpr("a", "hash(a) as h").join(many.selectExpr("b", "hash(b) as h"), "h").first()
    docs = brute.frame(spark, [(None, same.a), (None, same.b), (1, passage)], more=False)
    words = {bytes(r.kept).decode() for r in block_repeats.kept_words(docs).collect()}
    assert words == {same.a.split()[-1], same.b, ""}
    assert {r.text for r in block_repeats.remove_repeats(docs).collect()} >= {same.b}
    assert same.b in {bytes(r.kept).decode() for r in suffix_dedup.kept_bytes(docs).collect()}


@pytest.mark.parametrize("unit", ["words", "bytes"])
def test_many_copies_of_a_row_cost_what_other_copies_do(spark, unit):
    """Rows with null ids and one text, beside a text that shares part of it."""
    words = [f"w{i}" for i in range(300)]
    long, part = " ".join(words), " ".join([*words[100:160], *(f"v{i}" for i in range(50))])
    find = block_repeats.kept_words if unit == "words" else suffix_dedup.kept_bytes
    seconds = {}
    for name, ids in (("warm", range(50)), ("distinct", range(2000)), ("null", [None] * 2000)):
        docs = brute.frame(spark, [(i, long) for i in ids] + [(9000, part)], more=False).repartition(4)
        began = time.perf_counter()
        found = find(docs).collect()
        seconds[name] = time.perf_counter() - began
        kept = {r.doc_id: bytes(r.kept).decode() for r in found}
        assert len(found) == len(ids) + 1 and all(kept[i] == "" for i in ids)
        assert kept[9000].split()[-49:] == [f"v{i}" for i in range(1, 50)] and "w130" not in kept[9000]
    assert seconds["null"] < 1.5 * seconds["distinct"] + 3


def test_a_cut_leaves_no_shuffle_files(spark):
    """Disk of op9 and op5: the screening's shuffles go with the cut, not with the next collection."""
    folders = list(spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs())
    files = lambda: {str(f) for d in folders for f in Path(d.getPath()).rglob("shuffle_*.data")}
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    setting, before = spark.conf.get(name, None), files()
    df = spark.range(1000).groupBy((F.col("id") % 10).alias("k")).count()
    held = cut(df)
    until = time.monotonic() + 10
    while files() - before and time.monotonic() < until:
        time.sleep(0.1)
    assert not files() - before
    assert spark.conf.get(name, None) == setting
    assert {tuple(r) for r in held.collect()} == {tuple(r) for r in df.collect()} == {(k, 100) for k in range(10)}


def test_keys_of_a_split_join_are_dealt_out_once(spark):
    left = spark.createDataFrame([(1, "a", 5), (2, "b", 6), (None, "c", 7), (2, "b", 8)], "k long, s string, v long")
    right = left.groupBy("k", "s").agg(F.count("*").alias("n"))
    joined = split_join(left, right, ["k", "s"], "left")
    assert joined.columns == ["k", "s", "v", "n"]
    found = sorted(map(tuple, joined.collect()), key=str)
    assert found == sorted([(1, "a", 5, 1), (2, "b", 6, 2), (None, "c", 7, None), (2, "b", 8, 2)], key=str)
    assert split_join(left, right.where("n > 1"), ["k", "s"], "left_semi").columns == ["k", "s", "v"]
    wide = left.select("k", "v").hint("merge")
    joined = split_join(wide, right.groupBy("k").agg(F.sum("n").alias("n")), ["k"])
    plan = joined._jdf.queryExecution().optimizedPlan()
    side = next(n for n in iterate(plan) if n.nodeName() == "Join").left()
    assert side.output().size() == 2  # the rewritten key and v
    assert {tuple(r) for r in joined.collect()} == {(1, 5, 1), (2, 6, 2), (2, 8, 2)}


def iterate(plan):
    yield plan
    for i in range(plan.children().size()):
        yield from iterate(plan.children().apply(i))
