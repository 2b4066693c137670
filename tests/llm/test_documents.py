import random
import re
from collections import Counter

import brute
import pytest
from pyspark.sql import functions as F

from tallylog.llm import fingerprints, licenses, quality, queries

SF = "/root/testdata/sf0.01"


def test_measures_against_brute_force(spark):
    rows = brute.texts(21, 40) + [(500, "a b c a b c d"), (501, "x\ny\nx\n \n \n"), (502, "a b c d ###"), (None, "z")]
    found = quality.add_measures(brute.frame(spark, rows).withColumn("n_lines", F.lit("own"))).collect()
    assert len(found) == len(rows)
    by_text = {t: brute.measures(t) for _, t in rows}
    for r in found:
        assert {k: r[k] for k in by_text[r.text]} == by_text[r.text]


def test_counted_characters_of_odd_texts(spark):
    texts = [None, "", " \t\n", "A!B#c é😀 Ü|<>&%$* \n\x0b\n x \n x\n😀 !", "a\x00b\n\x00\n^-]\\", "😀😀 A B\x85C", "Z" * 3 + "[@`" + "!" * 5]
    found = quality.add_measures(brute.frame(spark, list(enumerate(texts)))).collect()
    assert len(found) == len(texts)
    for r in found:
        text = texts[r.doc_id] or ""
        assert {k: r[k] for k in brute.measures(text)} == brute.measures(text)
        assert r.n_upper == len(re.findall("[A-Z]", text)) and r.n_exclaims == text.count("!")


def test_model_recovers_classes():
    # three rules that fire on bad documents alone, a fourth that says nothing
    patterns = {(1, 1, 1, 1): 900, (-1, 1, 1, 1): 40, (1, -1, 1, 1): 30, (-1, -1, 1, 1): 20, (1, 1, 1, -1): 100, (0, 1, 1, 1): 50}
    model = quality.estimate(patterns, 4)
    assert 0.05 <= model.prior <= 0.995
    assert model.log_odds((1, 1, 1, 1)) > 0 > model.log_odds((-1, -1, 1, 1))
    assert quality.estimate({}, 4).prior == 0.9


def test_held_out_accuracy(spark):
    """Labels are not used by the model; the base rule is not part of it."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    measured = quality.add_measures(docs.select("doc_id", "text")).drop("text")
    judged = quality.judge(measured, quality.fit(measured)).where("not base_failed").join(labels, "doc_id")
    counts = {(r.quality, r.kept): r["count"] for r in judged.groupBy("quality", "kept").count().collect()}
    right = counts.get((1, True), 0) + counts.get((0, False), 0)
    assert right >= 0.98 * sum(counts.values())


def test_keep_good_keeps_columns(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet").withColumn("n_words", F.lit("own"))
    kept = quality.keep_good(df)
    assert kept.columns == df.columns
    assert 0 < kept.count() < df.count()
    assert quality.keep_good(df.where("doc_id < 0")).collect() == []
    odd = brute.frame(spark, [(1, None), (2, ""), (None, "a b"), (3, "w " * 60)])
    assert quality.keep_good(odd).collect() == []


def test_texts_without_words_in_ansi_mode(spark, tmp_path):
    rows = [(1, None), (2, ""), (None, " \n"), (3, "!"), (4, " ".join(f"word{i}" for i in range(60))), (4, None)]
    brute.frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    before = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", "true")
    try:
        found = queries.op4_quality_rules(spark, str(tmp_path)).collect()
        kept = quality.keep_good(spark.read.parquet(f"{tmp_path}/documents.parquet")).collect()
    finally:
        spark.conf.set("spark.sql.ansi.enabled", before)
    assert Counter((r.doc_id, r.n_words, r.base_failed) for r in found) == Counter(
        [(1, 0, True), (2, 0, True), (None, 0, True), (3, 1, True), (4, 60, False), (4, 0, True)]
    )
    assert all(0 <= r.p_good <= 1 and r.kept == (r.n_words == 60) for r in found)
    assert [(r.doc_id, len(r.text.split())) for r in kept] == [(4, 60)]


def license_base(text):
    w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", brute.ascii_lower(text))
    places, labels = [], set()
    for phrase, label in licenses.BASE:
        p = phrase.split()
        for i in range(len(w) - len(p) + 1):
            if w[i : i + len(p)] == p:
                places.append(i)
                labels.add(label)
    return len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


LICENSED = [
    ("Released under the MIT License.", {"mit"}),
    ("mit-license MIT  License mit licensed", {"mit"}),
    ("Licensed under the Apache License, Version 2.0.", {"apache", "apache-2.0"}),
    ("GNU General Public License, version 3 or later", {"gpl", "gpl-3"}),
    ("GNU Lesser General Public License v2.1", {"gpl", "lgpl-2.1"}),
    ("CC BY-NC-SA 4.0", {"cc-by-nc-sa-4.0"}),
    ("Creative Commons Attribution-ShareAlike 3.0", {"cc-by-sa-3.0"}),
    ("SPDX-License-Identifier: zlib", {"zlib"}),
    ("Redistribution and use in source and binary forms", {"bsd"}),
    ("Permission is hereby granted, free of charge, to any person obtaining a copy", {"mit"}),
    ("All rights reserved.", {"all-rights-reserved"}),
    ("nothing of the kind, submit license plates", set()),
    ("Mit der Zeit", set()),
    ("МIT licénse ünder", set()),
    (None, set()),
    ("", set()),
    ("...", set()),
]


def test_licenses(spark):
    rows = list(enumerate(t for t, _ in LICENSED)) + [(None, "MIT license"), (1, "MIT license"), (1, "MIT license")]
    found = licenses.scan_licenses(brute.frame(spark, rows)).collect()
    assert len(found) == len(rows)
    expected = Counter((i, *license_base(t or "")) for i, t in rows)
    assert Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in found) == expected
    for r in found:
        if r.doc_id is not None and r.doc_id != 1:
            assert set(filter(None, r.labels.split(","))) == LICENSED[r.doc_id][1], LICENSED[r.doc_id]
        assert 0 <= r.score <= 1 and (r.score > 0) == bool(r.labels)
    assert len(licenses.RULES) > 200
    assert licenses.scan_licenses(brute.frame(spark, rows).where("doc_id < 0")).collect() == []


PROSE = [
    "The hall is open to the general public 3 days a week.",
    "Python 2.0 was released in a hurry, and PHP 3.0 before it.",
    "We moved from PHP 3.0 to Elastic 2.0 and saw an eclipse, public 2.0 talks and a boost.",
    "The snake was distributed under python rock; the artistic 2.0 show ran under the ruby sky.",
    "Business source 1.1 articles, server side public 1 endpoints, open software 3.0 fans.",
    "Apache 2 helicopters landed, available under Apache command, published under Vim and X11.",
    "a mozilla public 2.0 demo, the common public 1.0, microsoft public 3, zlib and openssl released under zlib",
]


def test_prose_has_no_labels(spark):
    found = licenses.scan_licenses(brute.frame(spark, list(enumerate(PROSE)))).collect()
    assert {(r.doc_id, r.labels, r.score) for r in found} == {(i, "", 0.0) for i in range(len(PROSE))}


def plain_labels(text):
    """Every rule on the text, in order of place, longest and surest first; what lies within an
    earlier one goes."""
    w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", brute.ascii_lower(text))
    low = f" {' '.join(w)} " if w else " "
    spans = []
    for rank, rule in enumerate(licenses.RULES):
        spans += [(m.start(), -m.end(), rank, rule) for m in re.finditer(f"(?<= )(?:{rule.signature})(?= )", low)]
    reached, labels, weight = -1, set(), 0.0
    for start, end, _, rule in sorted(spans, key=lambda x: x[:3]):
        if -end > reached:
            reached, weight = -end, max(weight, rule.weight)
            labels.add(rule.label)
    base = set(filter(None, license_base(text)[4].split(",")))
    return ",".join(sorted(labels | base)), max(weight, licenses.PLAIN if base else 0.0)


def test_labels_against_every_rule_on_every_text(spark):
    rnd = random.Random(9)
    pieces = [t for t, _ in LICENSED if t] + PROSE + [
        "licensed under Apache 2.0", "Licensed under the PHP 3.01 or later", "under the terms of the GPL", "gpl v3", "LGPL 2.1",
        "Apache Software License version 1.1", "the Python License 2.0", "available under MPL 2.0", "zlib libpng licence",
        "CC BY 4.0 and CC BY-SA 3.0", "creative commons zero", "EUPL 1.2 and the European Union Public License 1.2",
        "This is free and unencumbered software", "BSD 3-clause license", "3-Clause BSD", "SPDX-License-Identifier: GPL",
    ]
    rows = [(i, " ".join(rnd.choice(pieces) + rnd.choice([" ", ". ", "; x ", "\n"]) for _ in range(rnd.randint(1, 5)))) for i in range(120)]
    found = {r.doc_id: (r.labels, r.score) for r in licenses.scan_licenses(brute.frame(spark, rows)).collect()}
    assert found == {i: plain_labels(t) for i, t in rows}
    assert len({labels for labels, _ in found.values()}) > 40


def test_gate_lets_every_rule_through():
    for rule in licenses.RULES:
        assert re.search(licenses.GATE, rule.form or rule.keyword)


def test_contained_detections_are_suppressed(spark):
    found = licenses.detections(brute.frame(spark, [(1, "x CC BY-NC 4.0 y Apache License 2.0")])).collect()
    assert sorted(r.label for r in found) == ["apache-2.0", "cc-by-nc-4.0"]
    text = " x cc by nc 4 0 y apache license 2 0 "
    assert all(text[r.start : r.end] == r.found for r in found)


def test_sketches_estimate_overlap():
    rows = [t for _, t in brute.texts(22, 60) if t and len(brute.words_of(t)) > 150]
    made = fingerprints.sketches(rows, 5, 2)
    for text, sketch in zip(rows, made):
        n = len(brute.shingle_set(text, 5))
        assert abs(len(sketch[0]) - n / 2) < 5 * (n / 4) ** 0.5 + 1
    half = " ".join(brute.words_of(rows[0])[:80])
    small, large = fingerprints.sketches([half, rows[0]], 5, 2)
    assert fingerprints.containment(small, large) == 1
    both = fingerprints.merge(small, large)
    assert fingerprints.as_text(both) == fingerprints.as_text(large)
    tiny = fingerprints.sketches(["one two", "", " "], 5, 1 << 20)
    assert tiny[0][1] and len(tiny[0][0]) == 1 and not len(tiny[1][0]) and not len(tiny[2][0])
    assert fingerprints.resemblance(tiny[1], tiny[1]) == 0
    assert fingerprints.merge(tiny[0], large) == large


@pytest.mark.parametrize("parts", ["2", "7"])
def test_neighbours_against_brute_force(spark, parts):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        rows = [(3 * i - 50, t) for i, t in brute.texts(23, 60)]
        found = {r.doc_id: r for r in fingerprints.compare_with_next(brute.frame(spark, rows)).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    order = sorted(rows, key=lambda r: -r[0])
    assert len(found) == len(rows)
    equal = {}
    for (i, text), (_, following) in zip(order, order[1:] + order[:1]):
        text, following, r = text or "", following or "", found[i]
        cut = len(text) // 3
        edited = text[: len(text) - cut] + following[:cut]
        assert (r.n_chars, r.edited_sha256) == (len(text), brute.sha256(edited.encode()))
        assert 0 <= r.near_next <= 1 and 0 <= r.near_edited <= 1
        assert equal.setdefault(text, r.fingerprint) == r.fingerprint


def test_neighbours_of_few_rows(spark):
    one = fingerprints.compare_with_next(brute.frame(spark, [(1, "a b c d e f g")])).collect()
    assert [(r.doc_id, r.near_next) for r in one] == [(1, 1.0)]
    some = fingerprints.compare_with_next(brute.frame(spark, [(None, "n"), (2, "b"), (2, "b"), (None, None)])).collect()
    assert sorted(str(r.doc_id) for r in some) == ["2", "2", "None", "None"]
    assert fingerprints.compare_with_next(brute.frame(spark, [(1, "a")]).where("doc_id > 1")).collect() == []
    plain = fingerprints.fingerprint(brute.frame(spark, [(1, "a b c d e f g"), (2, None)])).collect()
    assert {r.doc_id: bool(r.fingerprint) for r in plain} == {1: True, 2: False}


def test_hot_and_null_ids_are_spread(spark):
    """Half of all ids are null, a quarter is one id; every row is compared with the next one."""
    rows = [(None, f"null {i} " + "a b c d e " * (i % 3)) for i in range(400)] + [(77, f"hot {i}") for i in range(200)]
    rows += [(i, f"own {i}") for i in range(200)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    try:
        placed = fingerprints.with_follower(brute.frame(spark, rows, more=False)).collect()
        found = fingerprints.compare_with_next(brute.frame(spark, rows, more=False)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    sizes = Counter(r.part for r in placed if not r.guest)
    assert sum(sizes.values()) == 800 and max(sizes.values()) < 2 * 800 / 8
    assert len(found) == 800 and sum(r.guest for r in placed) == len(sizes)
    order = sorted(placed, key=lambda r: (r.part, r.guest))  # as they stand, but for ties
    own = [[r for r in order if r.part == p and not r.guest] for p in sorted(sizes)]
    ids = [r.doc_id for part in own for r in part]
    assert ids == sorted(ids, key=lambda i: (i is None, -(i or 0)))
    # each range ends with the first row of the next one
    guests = {r.part: r.text for r in placed if r.guest}
    after = sorted(sizes)[1:] + sorted(sizes)[:1]
    firsts = {p: part[0].text for p, part in zip(sorted(sizes), own)}
    assert guests == {p: firsts[q] for p, q in zip(sorted(sizes), after)}
