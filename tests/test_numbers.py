import json
import random
import struct

import pytest
from pyspark.sql import functions as F

from tallylog.functions.attributes import normalize_attributes, parse_attributes
from tallylog.functions.numbers import shortest_text

GOLDEN = {
    "0": "0",
    "-0": "0",
    "-0.0": "0",
    "42": "42",
    "-42": "-42",
    "1.25": "1.25",
    "-1.25": "-1.25",
    "9007199254740991": "9007199254740991",
    "9007199254740992": "9007199254740992",
    "9007199254740993": "9007199254740992",
    "1.7976931348623157e308": "1.7976931348623157e+308",
    "5e-324": "5e-324",
    "1e21": "1e+21",
    "123e19": "1.23e+21",
    "1e20": "100000000000000000000",
    "123456789012345680000": "123456789012345680000",
    "12345678901234567890": "12345678901234567000",
    "1e-7": "1e-7",
    "1.5e-7": "1.5e-7",
    "1e-6": "0.000001",
    "0.000001": "0.000001",
    "0.00012345": "0.00012345",
    "1.0": "1",
    "1.50": "1.5",
    "1e3": "1000",
    "12345678.5": "12345678.5",
    "0.1": "0.1",
    "100.5": "100.5",
    "2e-3": "0.002",
    "1.61304845894623136E17": "161304845894623140",
    "-5e-324": "-5e-324",
    "2.2250738585072014e-308": "2.2250738585072014e-308",
}


def _texts(spark, numbers):
    rows = [(i, json_text) for i, json_text in enumerate(numbers)]
    df = spark.createDataFrame(rows, "i int, n string").select(
        "i", parse_attributes(F.concat(F.lit('{"a":'), "n", F.lit("}"))).alias("attributes")
    )
    found = normalize_attributes(df).select("i", F.col("attributes_search")["a"]).collect()
    return [text for _, text in sorted(map(tuple, found))]


def test_golden_numbers(spark):
    assert dict(zip(GOLDEN, _texts(spark, GOLDEN))) == GOLDEN


def test_random_doubles_read_back_and_are_shortest(spark):
    rng = random.Random(7)
    bits = [rng.getrandbits(64) for _ in range(3000)]
    values = [struct.unpack("<d", struct.pack("<Q", b))[0] for b in bits]
    values += [rng.uniform(-1e6, 1e6) for _ in range(2000)]
    values += [rng.randrange(10**17) / 10 ** rng.randrange(17) for _ in range(2000)]
    values = [v for v in values if v == v and abs(v) != float("inf")]
    texts = _texts(spark, [repr(v) for v in values])
    for value, text in zip(values, texts):
        assert float(text) == value
        assert text == shortest_text(value)


@pytest.mark.parametrize("value", [0.5, 1e21, 123456.789, 1e-7, -2.5e-9, 1e300])
def test_shortest_text_is_json(value):
    assert json.loads(shortest_text(value)) == value


def test_strings_and_booleans(spark):
    text = json.dumps({"s": "03", "t": True, "f": False, "": "empty", "地域": "שלום", "n": 3})
    df = spark.createDataFrame([(text,)], "t string")
    row = normalize_attributes(df.select(parse_attributes(F.col("t")).alias("attributes"))).first()
    assert row["attributes_search"] == {
        "s": "03",
        "t": "true",
        "f": "false",
        "": "empty",
        "地域": "שלום",
        "n": "3",
    }


def test_merged_attributes(spark):
    from tallylog.functions.attributes import merge_attributes

    rows = [({"a": "1", "b": "2"}, {"b": "3", "c": "4"}), ({}, {"x": "1"}), ({"x": "1"}, {}), (None, {"x": "1"})]
    df = spark.createDataFrame(rows, "base map<string,string>, patch map<string,string>")
    got = [r[0] for r in df.select(merge_attributes(F.col("base"), F.col("patch"))).collect()]
    assert got == [{"a": "1", "b": "3", "c": "4"}, {"x": "1"}, {"x": "1"}, None]
