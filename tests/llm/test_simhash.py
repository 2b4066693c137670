import random

import brute
import numpy as np
import pytest
import xxhash

from tallylog.llm import simhash


def simple_fingerprint(text, k=4):
    w = brute.words_of(brute.ascii_lower(text))
    grams = [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] if len(w) >= k else [" ".join(w)] * bool(w)
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def labels(prints, bits):
    """Least place each is connected with."""
    prints = np.array(prints, np.uint64)
    near = [np.flatnonzero(np.bitwise_count(prints ^ p) <= bits) for p in prints]
    label = np.arange(len(prints))
    while True:
        least = np.array([label[x].min() for x in near])
        if np.array_equal(least, label):
            return label.tolist()
        label = least


def test_fingerprints_of_long_texts_and_pieces(monkeypatch):
    monkeypatch.setattr(simhash, "PIECE_BYTES", 50)
    for _, text in brute.texts(21, 60):
        assert simhash.fingerprint((text or "").encode()) == simple_fingerprint(text)


def test_components_against_brute_force(spark):
    rows = brute.texts(22, 150)
    prints = [simple_fingerprint(t) for _, t in rows]
    expected = labels(prints, 4)
    found = {r.doc_id: r for r in simhash.near_duplicates(brute.frame(spark, rows)).collect()}
    assert {i: r.fingerprint for i, r in found.items()} == {i: f"{p:016x}" for (i, _), p in zip(rows, prints)}
    assert {i: r.component_id for i, r in found.items()} == {i: c for (i, _), c in zip(rows, expected)}
    assert len(set(expected)) < len(rows)


def planted(seed, n, families, size, most):
    """Random fingerprints, and families around some of them with up to `most` bits changed."""
    rnd = random.Random(seed)
    out = [rnd.getrandbits(64) for _ in range(n)]
    for _ in range(families):
        base = rnd.getrandbits(64)
        for _ in range(size):
            out.append(base ^ sum(1 << b for b in rnd.sample(range(64), rnd.randint(0, most))))
    return sorted(set(out))


@pytest.mark.parametrize("families,size,most", [(200, 4, 4), (4, 700, 3), (1, 2500, 6)])
def test_links_are_exact_through_all_levels(spark, monkeypatch, families, size, most):
    monkeypatch.setattr(simhash, "SHARD", 300)
    monkeypatch.setattr(simhash, "LEAF", 40)
    monkeypatch.setattr(simhash, "SAMPLE", 1000)
    points = planted(7, 3000, families, size, most)
    expected = labels(points, 4)
    signed = np.array(points, np.uint64).view(np.int64).tolist()
    sets = spark.createDataFrame([(p,) for p in signed], "fingerprint long").repartition(3)
    links = {(r.a, r.b) for r in simhash.near_links(sets).collect()}
    of = {p: i for i, p in enumerate(signed)}
    group = list(range(len(points)))

    def root(x):
        while group[x] != x:
            x = group[x]
        return x

    for a, b in links:
        x, y = root(of[a]), root(of[b])
        group[max(x, y)] = min(x, y)
    assert [root(i) for i in range(len(points))] == expected


def test_shards_keep_every_near_pair():
    points = np.array(planted(9, 20000, 300, 3, 4), np.uint64)
    for part in simhash.PARTS:
        tree, shards = simhash.fit_tree(points[:: len(points) // 4000], part, 4, 5 * 16, 0)
        assert shards > 8
        places = [[] for _ in points]

        def walk(node, idx, places=places):
            if isinstance(node, int):
                for i in idx.tolist():
                    places[i].append(node)
                return
            split, inner, outer = node
            inside, outside = split.sides(points[idx])
            walk(inner, idx[inside])
            walk(outer, idx[outside])

        walk(tree, np.arange(len(points)))
        assert all(places)
        assert sum(map(len, places)) < 6 * len(points)
        for i in range(0, len(points), 7):
            near = np.flatnonzero(np.bitwise_count((points ^ points[i]) & np.uint64(part)) <= 1)
            near = near[np.bitwise_count(points[near] ^ points[i]) <= 4]
            assert all(set(places[i]) & set(places[j]) for j in near.tolist())


def test_edges(spark):
    rows = [(None, "a b c d e"), (None, "A b C d e"), (5, None), (6, ""), (3, " \n"), (7, "one"), (7, "One"), (8, "a  b\tc d e"), (None, "z y x w v u")]
    found = simhash.near_duplicates(brute.frame(spark, rows)).collect()
    shown = lambda t: f"{simple_fingerprint(t):016x}"
    expected = [(None, shown("a b c d e"), 8)] * 2 + [(i, "0" * 16, 3) for i in (5, 6, 3)] + [(7, shown("one"), 7)] * 2
    expected += [(8, shown("a b c d e"), 8), (None, shown("z y x w v u"), None)]
    assert sorted(map(tuple, found), key=str) == sorted(expected, key=str)


def test_many_equal_rows(spark):
    rows = [(None, "same words again and again here")] * 2000 + [(4, "same words again and again here")]
    found = simhash.near_duplicates(brute.frame(spark, rows, more=False)).collect()
    assert len(found) == 2001 and {r.component_id for r in found} == {4}


def test_empty_table(spark):
    assert simhash.near_duplicates(brute.frame(spark, [(1, "a")]).where("doc_id > 1")).collect() == []
