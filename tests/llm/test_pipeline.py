import random
import zlib
from collections import Counter

import brute
import corpus_pipeline
import numpy as np
import public_tokenizers
from pyspark.sql import functions as F

import __spark_entry__ as contract
from tallylog.llm import packing, quality

SF = "/root/testdata/sf0.001"


def test_pipeline_against_brute_force(spark):
    """The model itself is shared; measures, groups, repeats and pieces are counted anew."""
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    measured = quality.add_measures(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text"))
    good = {r.doc_id for r in quality.judge(measured, quality.fit(measured)).where("kept").collect()}
    for i, text in docs:
        m = brute.measures(text)
        if m["n_words"] < 50 or 2 * m["n_repeat_words"] > m["n_words"]:
            assert i not in good
    docs = [(i, t) for i, t in docs if i in good]
    least = brute.components(docs, 5, 80)
    docs = [(i, t) for i, t in docs if least[i] == i]
    units = [brute.words_of(t) for _, t in docs]
    kept = {i: [w for w, g in zip(u, gone) if not g] for (i, _), u, gone in zip(docs, units, brute.repeated_units(units, 35))}

    stage, frames = spark.read.parquet(f"{SF}/documents.parquet"), []
    columns = stage.columns
    for name, function in corpus_pipeline.STAGES[:-1]:
        stage = spark.createDataFrame(function(spark, stage, SF).collect(), stage.schema)
        assert stage.columns == columns
        frames.append(stage)
    assert {r.doc_id for r in frames[0].collect()} == good
    assert {r.doc_id for r in frames[1].collect()} == set(kept)
    assert {r.doc_id: brute.words_of(r.text) for r in frames[2].collect()} == kept
    assert frames[2].where(F.length("text") != F.col("n_chars")).isEmpty()

    texts = {r.doc_id: r.text for r in frames[2].collect()}
    code = packing.byte_level_encoding(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    expected = Counter()
    for i, text in texts.items():
        ids = [*code.encode_ordinary(text), 0]
        stop, start, piece = len(ids) % 2048 or 2048, 0, 0
        while start < len(ids):
            part = np.array(ids[start:stop], "<u4")
            expected[i, piece, start, len(part), zlib.crc32(part.tobytes())] += 1
            start, stop, piece = stop, stop + 2048, piece + 1
    packed = corpus_pipeline.run(spark, SF).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in packed) == expected


def test_one_row_of_each_group_keeps_its_text(spark):
    rnd = random.Random(21)
    text = [" ".join(f"w{rnd.randrange(10**6)}" for _ in range(90)) for _ in range(6)]
    near = text[3].replace(" ", " more ", 1)  # a near copy
    rows = [
        (1, text[0]), (1, text[0]), (1, text[0]),  # a row three times
        (None, text[1]), (None, text[1]),  # null ids alone
        (None, text[2]), (2, text[2]),  # a null id after all others
        (3, text[3]), (3, near), (4, near),  # near copies that share the least id
        (3, text[4]),  # the same id, a document of its own
        (5, text[5]),
        (6, None), (6, None), (None, ""), (None, ""),
    ]
    docs = brute.frame(spark, rows).repartition(3)
    one = corpus_pipeline.near_deduplication(spark, docs, SF)
    assert one.columns == docs.columns
    found = Counter((r.doc_id, r.text) for r in one.collect())
    third = next(t for t in (text[3], near) if found[3, t])
    expected = [(1, text[0]), (None, text[1]), (2, text[2]), (3, third), (3, text[4]), (5, text[5]), (6, None), (None, ""), (None, "")]
    assert found == Counter(expected)
    whole = corpus_pipeline.substring_deduplication(spark, spark.createDataFrame(one.collect(), one.schema), SF)
    assert Counter((r.doc_id, r.text) for r in whole.collect()) == Counter(expected)


def test_registry():
    names = [n for n in contract.queries() if n.startswith("op")]
    assert [int(n[2:].split("_")[0]) for n in names] == list(range(1, 14))
    assert "pipeline" in contract.queries()
    assert {n for n in contract.oracle_sql() if n.startswith("op") and n[2].isdigit()} == {
        "op1_html_extraction", "op8_near_duplicates", "op9_block_repeats", "op10_warc", "op13_merkle_manifest",
    }
