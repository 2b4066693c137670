import random

import pytest
from pyspark.sql import functions as F

from tallylog.functions import timestamps as ts

# A text and the same instant as canonical text.
ACCEPTED = {
    "1999-07-04T06:30:00Z": "1999-07-04T06:30:00.000Z",
    "2031-03-09T00:15:00-11:30": "2031-03-09T11:45:00.000Z",  # over noon
    "2031-03-09T00:15:00+05:45": "2031-03-08T18:30:00.000Z",  # into the day before
    "2017-12-31T23:00:00-03:00": "2018-01-01T02:00:00.000Z",  # into the next year
    "2020-02-28T20:00:00-14:00": "2020-02-29T10:00:00.000Z",  # onto a leap day
    "2011-11-11T11:11:11.5Z": "2011-11-11T11:11:11.500Z",  # at least three digits
    "2011-11-11T11:11:11.250000Z": "2011-11-11T11:11:11.250Z",  # no zeros behind
    "2011-11-11T11:11:11.0070Z": "2011-11-11T11:11:11.007Z",
    "2011-11-11T11:11:11.00000000012Z": "2011-11-11T11:11:11.00000000012Z",  # all that count
    "1600-02-29T01:02:03Z": "1600-02-29T01:02:03.000Z",
    "1955-05-05T05:05:05.987Z": "1955-05-05T05:05:05.987Z",  # before the epoch
    "0000-03-01T00:00:00Z": "0000-03-01T00:00:00.000Z",
    "0000-01-01T03:00:00+04:00": "-000001-12-31T23:00:00.000Z",  # before the year 0
    "9999-12-31T18:00:00-07:30": "+010000-01-01T01:30:00.000Z",  # beyond four digits
}
# Not of the form at all.
BAD_GRAMMAR = [
    "",
    "yesterday",
    "1999-07-04",
    "1999-07-04T06:30:00",
    "1999-07-04 06:30:00+01:00",
    "1999-7-04T06:30:00Z",
    "99-07-04T06:30:00Z",
    "1999-07-04T6:30:00Z",
    "1999-07-04T06:30Z",
    "1999-07-04t06:30:00Z",
    "1999-07-04T06:30:00.5",
    "1999-07-04T06:30:00,5Z",
    "1999-07-04T06:30:00.+01:00",
    "1999-07-04T06:30:00+01",
    "1999-07-04T06:30:00+0130",
    "\t1999-07-04T06:30:00Z",
    "1999-07-04T06:30:00Z ",
    "1999-07-04T06:30:00ZZ",
]
# Of the form, but no such date, time or offset.
BAD_PARTS = [
    "2019-02-29T06:30:00Z",
    "2100-02-29T06:30:00+02:00",
    "2020-02-30T06:30:00Z",
    "1999-06-31T06:30:00Z",
    "1999-11-00T06:30:00Z",
    "1999-99-04T06:30:00Z",
    "1999-07-32T06:30:00Z",
    "1999-07-04T25:30:00Z",
    "1999-07-04T24:00:00Z",
    "1999-07-04T06:99:00Z",
    "1999-07-04T06:30:61Z",
    "1999-07-04T06:30:00-14:30",
    "1999-07-04T06:30:00+23:00",
    "1999-07-04T06:30:00+01:75",
]


def _column(spark, texts, expression):
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    return {r[0]: r[1] for r in df.select("text", expression(F.col("text"))).collect()}


def test_canonical_texts(spark):
    assert _column(spark, ACCEPTED, ts.canonical_timestamp) == ACCEPTED


def test_python_arguments_follow_the_same_rules():
    assert {t: ts.argument_canonical(t) for t in ACCEPTED} == ACCEPTED
    assert all(ts.argument_instant(t) is None for t in BAD_GRAMMAR + BAD_PARTS)


def test_bad_texts_are_told_apart(spark):
    grammar = _column(spark, BAD_GRAMMAR + BAD_PARTS, ts.matches_grammar)
    assert not any(grammar[t] for t in BAD_GRAMMAR)
    assert all(grammar[t] for t in BAD_PARTS)
    seconds = _column(spark, BAD_PARTS, ts.whole_second)
    assert set(seconds.values()) == {None}
    assert set(_column(spark, BAD_GRAMMAR + BAD_PARTS, ts.canonical_timestamp).values()) == {None}


@pytest.mark.parametrize(
    ("left", "right", "expected"),
    [
        ("2008-08-08T08:08:07.9999999Z", "2008-08-08T08:08:08Z", -1),
        ("2008-08-08T20:08:08+12:00", "2008-08-08T04:38:08-03:30", 0),
        ("2008-08-08T08:08:08.70Z", "2008-08-08T08:08:08.7Z", 0),
        ("2008-08-08T08:08:08.0000000002Z", "2008-08-08T08:08:08.000000001Z", -1),
        ("2008-08-08T08:08:08.00010000001Z", "2008-08-08T08:08:08.0001Z", 1),
        ("2008-08-09T00:00:00+00:01", "2008-08-08T23:58:59Z", 1),
    ],
)
def test_argument_order(left, right, expected):
    a, b = ts.argument_instant(left), ts.argument_instant(right)
    assert (a > b) - (a < b) == expected


def test_stored_text_and_instants(spark):
    texts = [t for t, c in ACCEPTED.items() if c[0] not in "+-" and len(c) <= 27]
    back = _column(spark, texts, lambda c: ts.timestamp_text(ts.parse_timestamp(c)))
    assert back == {t: ACCEPTED[t] for t in texts}


def test_digits_beyond_microseconds_are_cut(spark):
    text = "2026-01-15T12:00:59.9999999Z"
    got = _column(spark, [text], lambda c: ts.timestamp_text(ts.parse_timestamp(c)))
    assert got[text] == "2026-01-15T12:00:59.999999Z"
    assert ts.argument_micros(text) % 1000000 == 999999


def _random_text(rng):
    """Mostly valid parts, now and then one out of range."""
    off = lambda usual, odd: rng.choice(odd) if rng.random() < 0.05 else usual
    date = "{:04d}-{:02d}-{:02d}".format(
        off(rng.randint(1, 9998), [0, 9999]), off(rng.randint(1, 12), [0, 13]), rng.randint(1, 31)
    )
    clock = "{:02d}:{:02d}:{:02d}".format(
        off(rng.randint(0, 23), [24]), off(rng.randint(0, 59), [60]), off(rng.randint(0, 59), [60])
    )
    digits = "".join(rng.choice("0019") for _ in range(rng.choice([0, 0, 1, 3, 6, 9, 12])))
    zone = rng.choice(["Z", "+00:00", "-05:30", "+14:00", "-14:00", "+14:01", "+09:60", "+02:00"])
    return f"{date}{off('T', [' ', 't'])}{clock}{'.' + digits if digits else ''}{zone}"


def test_expressions_and_arguments_agree(spark):
    rng = random.Random(11)
    texts = {_random_text(rng) for _ in range(4000)}
    expected = {
        t: ts.argument_canonical(t) if ts.argument_instant(t) is not None else None for t in texts
    }
    assert 500 < sum(v is None for v in expected.values()) < 3000
    assert _column(spark, texts, ts.canonical_timestamp) == expected
    micros = _column(spark, texts, lambda c: F.unix_micros(ts.parse_timestamp(c)))
    assert micros == {
        t: ts.argument_micros(t) if expected[t] is not None else None for t in texts
    }


def test_future_limit_agrees_with_whole_numbers(spark):
    """Compared on all digits, against a limit in milliseconds."""
    rng = random.Random(5)
    texts = {
        f"2026-01-15T12:0{rng.choice('45')}:{rng.choice(['59', '00', '01'])}"
        f".{rng.choice(['', '1', '12', '123', '1230', '12300000001', '0' * 40 + '1', '122999'])}0Z"
        for _ in range(200)
    }
    limit = "2026-01-15T12:05:00.123Z"
    late = _column(
        spark,
        texts,
        lambda c: ts.is_after(ts.whole_second(c), ts.fraction_digits(c), ts.instant_literal(limit)),
    )
    at = ts.argument_instant(limit)
    assert late == {t: ts.argument_instant(t) > at for t in texts}
    assert len(set(late.values())) == 2
