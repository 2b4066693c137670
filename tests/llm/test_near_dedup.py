import random

import brute
import numpy as np
import pytest

from tallylog.llm import near_dedup
from tallylog.llm.components import connected


@pytest.mark.parametrize("words", [4, 5])
def test_components_against_brute_force(spark, words):
    rows = brute.texts(11, 90)
    expected = brute.components(rows, words, 80)
    found = near_dedup.near_duplicates(brute.frame(spark, rows), words).collect()
    assert {r.doc_id: r.component_id for r in found} == expected
    assert {r.doc_id: r.n_shingles for r in found} == {i: len(brute.shingle_set(t, words)) for i, t in rows}
    assert all(r.kept == (r.doc_id == r.component_id) for r in found)
    assert len(set(expected.values())) < len(rows)


def family(seed, n):
    """One group of near copies, each with words of its own; not all are linked."""
    rnd = random.Random(seed)
    base = [f"b{i}" for i in range(120)]
    out = []
    for i in range(n):
        copy = list(base)
        for _ in range(rnd.randint(0, 9)):
            copy[rnd.randrange(120)] = f"x{rnd.random()}"
        out.append((i, " ".join(copy)))
    rnd.shuffle(out)
    return out


def test_large_group(spark):
    rows = family(12, 400)  # larger than a small node at every level
    found = near_dedup.near_duplicates(brute.frame(spark, rows, more=False), 4).collect()
    assert {r.doc_id: r.component_id for r in found} == brute.components(rows, 4, 80)


def test_cut_clusters_meet_again(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "CLUSTER_SHINGLES", 6000)
    rows = family(13, 300)
    found = near_dedup.near_duplicates(brute.frame(spark, rows, more=False), 4).collect()
    assert {r.doc_id: r.component_id for r in found} == brute.components(rows, 4, 80)


def hot_sets(seed, n, pairs, groups=12):
    """(set_id, tokens, sketch) of sets whose tokens are all hot: in each tree a set has the three
    tokens of one of a few groups. The last `pairs` sets agree in five trees with one before."""
    rng = np.random.default_rng(seed)
    group = rng.integers(0, groups, (n, near_dedup.TREES))
    for i in range(pairs):
        group[n - pairs + i] = np.where(rng.permutation(near_dedup.TREES) < 5, group[i], group[n - pairs + i])
    values = rng.integers(0, 2**63, (groups, near_dedup.TOKENS))
    tokens = np.stack([values[np.tile(g, near_dedup.LEVELS), np.arange(near_dedup.TOKENS)] for g in group]).astype(">u8")
    sketch = tokens.view(np.uint8)[:, 7::8]
    return [(b"%08d" % i, t.tobytes(), k.tobytes()) for i, (t, k) in enumerate(zip(tokens, sketch))], sketch


def agreeing(sketch):
    """Least set each is connected with by agreeing in enough tokens."""
    label = np.arange(len(sketch))
    near = [np.flatnonzero((sketch == k).sum(axis=1) >= near_dedup.least_agreement(80)) for k in sketch]
    while True:
        least = np.array([label[x].min() for x in near])
        if (least == label).all():
            return label
        label = least


def test_hot_tokens_lose_no_pair(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "SMALL_NODE", 8)
    monkeypatch.setattr(near_dedup, "NODE_PART", 20)
    sets, sketch = hot_sets(14, 400, 60)
    expected = agreeing(sketch)
    assert len(set(expected.tolist())) > 200
    links = near_dedup.candidate_links(spark.createDataFrame(sets, "set_id binary, tokens binary, sketch binary"), 80)
    found = {int(bytes(r.node)): int(bytes(r.label)) for r in connected(links).collect()}
    assert [found.get(i, i) for i in range(400)] == expected.tolist()


@pytest.mark.parametrize("part", [20, 1000])
def test_nodes_branch_in_and_before_their_task(spark, monkeypatch, part):
    monkeypatch.setattr(near_dedup, "SMALL_NODE", 8)
    monkeypatch.setattr(near_dedup, "NODE_PART", part)
    rng = np.random.default_rng(15)
    # first tokens of all trees are the same for all sets, second ones for half of them, third ones differ
    tokens = rng.integers(0, 2**63, (300, near_dedup.TOKENS)).astype(">u8")
    tokens[:, : near_dedup.TREES] = tokens[0, : near_dedup.TREES]
    tokens[:150, near_dedup.TREES : 2 * near_dedup.TREES] = tokens[0, near_dedup.TREES : 2 * near_dedup.TREES]
    for i in range(0, 300, 3):
        tokens[i + 1] = np.where(rng.random(near_dedup.TOKENS) < 0.8, tokens[i], tokens[i + 1])
    sketch = tokens.view(np.uint8)[:, 7::8]
    sets = [(b"%08d" % i, t.tobytes(), k.tobytes()) for i, (t, k) in enumerate(zip(tokens, sketch))]
    links = near_dedup.candidate_links(spark.createDataFrame(sets, "set_id binary, tokens binary, sketch binary"), 80)
    found = {int(bytes(r.node)): int(bytes(r.label)) for r in connected(links).collect()}
    for i in range(0, 300, 3):
        assert (found.get(i, i) == found.get(i + 1, i + 1)) == ((sketch[i] == sketch[i + 1]).sum() >= near_dedup.least_agreement(80))


def test_many_equal_rows_are_one(spark):
    text, near = " ".join(f"w{i}" for i in range(60)), " ".join([*(f"w{i}" for i in range(59)), "x"])
    rows = [(None, text)] * 2000 + [(3, near), (4, text)]
    found = near_dedup.near_duplicates(brute.frame(spark, rows, more=False), 4).collect()
    assert len(found) == 2002 and {r.component_id for r in found} == {3}
    assert [r.doc_id for r in near_dedup.keep_one(brute.frame(spark, rows), 4).collect()] == [3]


def test_linked_components_is_exact():
    rng = np.random.default_rng(3)
    for _ in range(20):
        sets = [set(rng.integers(0, 30, rng.integers(1, 25)).tolist()) for _ in range(40)]
        sizes = np.array([len(s) for s in sets])
        label = near_dedup.linked_components(sizes, np.concatenate([sorted(s) for s in sets]), 60)
        expected = list(range(40))
        for _ in range(40):
            for a in range(40):
                for b in range(40):
                    if 100 * len(sets[a] & sets[b]) >= 60 * len(sets[a] | sets[b]):
                        expected[a] = expected[b] = min(expected[a], expected[b])
        assert label.tolist() == expected


def test_connected(spark):
    links = [(1, 2), (2, 3), (3, 4), (9, 8), (8, 7), (5, 5), (6, 6), (6, 2), (None, 1)] + [(100 + i, 101 + i) for i in range(40)]
    found = {r.node: r.label for r in connected(spark.createDataFrame(links, "a long, b long")).collect()}
    expected = {n: 1 for n in (1, 2, 3, 4, 6)} | {n: 7 for n in (7, 8, 9)} | {5: 5} | {n: 100 for n in range(100, 141)}
    assert found == expected


def test_edges(spark):
    rows = [(None, "a b c d e f"), (None, "A b c d e f"), (3, "a b c d e f"), (4, None), (5, ""), (6, "one"), (6, "one"), (7, "One"), (None, "q r s t u")]
    found = near_dedup.near_duplicates(brute.frame(spark, rows), 5).collect()
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in found), key=str)
    assert got == sorted(
        [(None, 2, 3, False), (None, 2, 3, False), (3, 2, 3, True), (4, 0, 4, True), (5, 0, 5, True), (6, 1, 6, True), (6, 1, 6, True), (7, 1, 6, False), (None, 1, None, True)],
        key=str,
    )
    kept = near_dedup.keep_one(brute.frame(spark, rows))
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["3", "4", "5", "6", "None"]
    assert kept.columns == brute.frame(spark, rows).columns


def test_empty_table(spark):
    assert near_dedup.near_duplicates(brute.frame(spark, [(1, "a")]).where("doc_id > 1")).collect() == []
