import random
import zlib
from collections import defaultdict

import brute
import pytest

from tallylog.llm import manifest

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def h(text):
    return brute.sha256(text.encode())


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def tree(nodes):
    """Root of the nodes, and the siblings (left, right) of each, level by level."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, place in enumerate(at):
            low = place // 16 * 16
            paths[i].append(("".join(nodes[low:place]), "".join(nodes[place + 1 : low + 16])))
        nodes = [h("".join(nodes[i : i + 16])) for i in range(0, len(nodes), 16)]
        at = [place // 16 for place in at]
    return nodes[0], paths


def expected(rows):
    by_source = defaultdict(list)
    for row in rows:
        by_source[row[1]].append(row)
    leaf = lambda row: h("".join(map(field, row)))
    order = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    sources = []
    for source in order:
        own = sorted(by_source[source], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        sources.append((own, *tree([leaf(r) for r in own])))
    root, tops = tree([s[1] for s in sources])
    out = []
    for (own, subroot, paths), top in zip(sources, tops):
        for row, path in zip(own, paths):
            shown = row
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0 and row[4] is not None:
                shown = (*row[:4], brute.ascii_lower(row[4]))
            node = leaf(shown)
            for left, right in path + top:
                node = h(left + node + right)
            out.append((row[0], leaf(row), subroot, root, h("".join(a + b for a, b in path + top)), node, node == root))
    return out


def documents(sizes, seed=5):
    rnd = random.Random(seed)
    text = lambda: rnd.choice([None, "", "Ünïcode Text", "lower only", "X" * 3000, f"Some {rnd.random()} Words"])
    rows = []
    for source, n in sizes.items():
        for i in range(n):
            rows.append((rnd.choice([i, None, 7]) if i % 9 == 0 else i, source, rnd.choice([None, "en"]), rnd.choice([None, i]), text()))
    rnd.shuffle(rows)
    return rows + rows[:5]


@pytest.mark.parametrize(
    "sizes",
    [
        {"web": 1},
        {"web": 1, "": 1},
        {None: 3, "a": 16, "b": 17, "é": 1, "Z": 256, "z": 257, "long": 4097},
        {f"s{i}": 1 + i % 3 for i in range(40)},
    ],
)
def test_manifest_against_brute_force(spark, sizes):
    rows = documents(sizes)
    docs = spark.createDataFrame([(*r, 1, "x", 3, []) for r in rows], SCHEMA + ", branch int, node string, n int, path array<int>")
    found = manifest.manifest(docs.repartition(7))
    assert found.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(map(tuple, found.collect()), key=str) == sorted(expected(rows), key=str)


def test_two_levels_of_blocks(spark, monkeypatch):
    monkeypatch.setattr(manifest, "DIGITS", 1)
    monkeypatch.setattr(manifest, "BLOCK", 16)
    rows = documents({"a": 700, "b": 30, None: 16, "c": 1})
    found = manifest.manifest(spark.createDataFrame(rows, SCHEMA))
    assert sorted(map(tuple, found.collect()), key=str) == sorted(expected(rows), key=str)


def test_many_equal_rows_are_spread(spark):
    rows = [(None, "a", None, None, "Same")] * 3000
    docs = spark.createDataFrame(rows, SCHEMA)
    ranks = manifest.ranked(manifest.leaves(docs), [manifest.F.col("branch"), manifest.F.col("doc_id"), manifest.F.col("leaf")])
    assert sorted(r.rank for r in ranks.collect()) == list(range(3000))
    assert sorted(map(tuple, manifest.manifest(docs).collect())) == sorted(expected(rows))


def test_empty_table(spark):
    assert manifest.manifest(spark.createDataFrame([], SCHEMA)).collect() == []
