import json

from pyspark.sql import functions as F

from helpers import DROP, entry, judge_bodies, reasons
from tallylog.fixed import REASON
from tallylog.functions.timestamps import canonical_parts
from tallylog.operators import validate as v
from tallylog.operators.enrich import to_log_rows
from tallylog.sources.batches import bad_batches, parse_batches


def dumps(value):
    return json.dumps(value, ensure_ascii=False)


def with_attributes(text):
    return dumps(entry())[:-1] + f', "attributes": {text}}}'


CASES = [
    ("null", "entry_object"),
    ("17", "entry_object"),
    ('"text"', "entry_object"),
    ('"{}"', "entry_object"),
    ("[]", "entry_object"),
    (dumps([entry()]), "entry_object"),
    (dumps(dumps(entry())), "entry_object"),
    ("{}", "timestamp_required"),
    (dumps(entry(timestamp=DROP)), "timestamp_required"),
    *((dumps(entry(timestamp=x)), "timestamp_string") for x in (None, 17, True, {}, [])),
    (dumps(entry(timestamp="2026-01-15")), "timestamp_grammar"),
    (dumps(entry(timestamp="2026-02-29T12:00:00Z")), "timestamp_components"),
    (dumps(entry(timestamp="2026-01-15T12:05:00.001Z")), "timestamp_future"),
    (dumps(entry(timestamp="2026-01-15T12:05:00.0001Z")), "timestamp_future"),
    (dumps(entry(timestamp=f"2026-01-15T12:05:00.{'0' * 500}1Z")), "timestamp_future"),
    (dumps(entry(timestamp="2026-01-15T12:05:01Z")), "timestamp_future"),
    (dumps(entry(timestamp=f"2026-01-15T12:05:00.{'0' * 500}Z")), None),
    (dumps(entry(timestamp="2026-01-15T14:05:00+02:00")), None),
    (dumps(entry(timestamp="1970-01-01T00:00:00Z")), None),
    (dumps(entry(level=DROP)), "level_required"),
    *((dumps(entry(level=x)), "level_string") for x in (None, 42, True, {}, [])),
    *((dumps(entry(level=x)), "level_value") for x in ("", "critical", "INFO", " error ")),
    *((dumps(entry(level=x)), None) for x in ("debug", "info", "warn", "error")),
    (dumps(entry(service=DROP)), "service_required"),
    *((dumps(entry(service=x)), "service_string") for x in (None, 42, True, {}, [])),
    (dumps(entry(service="")), "service_empty"),
    (dumps(entry(service=" ")), None),
    (dumps(entry(service="a\0b")), "service_nul"),
    (dumps(entry(message=DROP)), "message_required"),
    *((dumps(entry(message=x)), "message_string") for x in (None, 42, False, {}, [])),
    (dumps(entry(message="")), "message_empty"),
    (dumps(entry(message="\n")), None),
    (dumps(entry(message="\0")), "message_nul"),
    *((dumps(entry(attributes=x)), "attributes_object") for x in (None, 42, True, "{}", [], [1])),
    (dumps(entry(attributes={})), None),
    (dumps(entry(attributes={"a\0": 1})), "attribute_key_nul"),
    (dumps(entry(attributes={"a\0": {"x": 1}})), "attribute_key_nul"),
    *((dumps(entry(attributes={"a": x})), "attribute_value") for x in (None, {}, [], [1])),
    (with_attributes('{"a": 1e400}'), "attribute_value"),
    (with_attributes('{"a": -1e400}'), "attribute_value"),
    (dumps(entry(attributes={"a": "Infinity"})), None),
    (with_attributes('{"a": 1e308, "b": -0, "c": 123456789012345678901234567890}'), None),
    (dumps(entry(attributes={"a": "x\0"})), "attribute_string_nul"),
    # The first bad attribute in object order decides: indexes first, then as written.
    (dumps(entry(attributes={"z": None, "a\0": 1})), "attribute_value"),
    (dumps(entry(attributes={"z\0": None, "a": None})), "attribute_key_nul"),
    (dumps(entry(attributes={"z": "\0", "a": None})), "attribute_string_nul"),
    (dumps(entry(attributes={"z": None, "a": "\0"})), "attribute_value"),
    (dumps(entry(attributes={"z": None, "7": "\0"})), "attribute_string_nul"),
    # A repeated key or field: the last value counts.
    (with_attributes('{"a": null, "a": 1}'), None),
    (with_attributes('{"a": 1, "a": null}'), "attribute_value"),
    (with_attributes('{"a": {"x": 1, "x": 2}}'), "attribute_value"),
    (dumps(entry())[:-1] + ', "level": "nope"}', "level_value"),
    # Order of the rules.
    (dumps({"level": "x", "service": "", "message": ""}), "timestamp_required"),
    (dumps(entry(level="x", service="", message="", attributes=None)), "level_value"),
    (dumps(entry(service="", message="", attributes=None)), "service_empty"),
    (dumps(entry(service="\0", message="", attributes=None)), "service_nul"),
    (dumps(entry(message="", attributes=None)), "message_empty"),
    (dumps(entry(message="\0", attributes=None)), "message_nul"),
    # Unknown fields do not matter.
    (dumps(entry(metadata="x\0", extra={"nested": [1, {"a": None}]})), None),
]


def test_reasons(spark):
    got = reasons(spark, [text for text, _ in CASES])
    expected = [name and REASON[name] for _, name in CASES]
    wrong = [(t, g, e) for (t, _), g, e in zip(CASES, got, expected) if g != e]
    assert wrong == []


def test_mixed_batch(spark):
    entries = [None, entry(), entry(message=""), entry(), entry(attributes={"a": {"b": 1}})]
    judged = judge_bodies(spark, [dumps({"logs": entries})])
    account = v.batch_accounting(judged).first()
    assert (account["attempted"], account["accepted"], account["outcome"]) == (5, 2, "ok")
    assert [tuple(r) for r in account["rejected"]] == [
        (0, REASON["entry_object"]),
        (2, REASON["message_empty"]),
        (4, REASON["attribute_value"]),
    ]
    assert v.check_accounting(v.batch_accounting(judged)).first()["consistent"]


def test_empty_and_refused_batches(spark):
    bodies = [
        '{"logs":[]}',
        "[]",
        '[{"logs":[]}]',
        "{}",
        '{"logs":null}',
        '{"logs":{}}',
        "null",
        "not json",
        '{"logs":[]} x',
        "{'logs':[]}",
        '{"logs":[NaN]}',
        '{"logs":[],"more":1}',
        '{"logs":1,"logs":[]}',
        '{"logs":[null]}',
        '{"logs":[null],"logs":1}',
        '{"logs":[null,null,null],"logs" : [null,{"logs":[]}]}',
        '["logs",{"logs":[null]},{"logs":[]}]',
    ]
    accounts = {
        r["batch_id"]: r for r in v.batch_accounting(judge_bodies(spark, bodies)).collect()
    }
    assert sorted(accounts, key=int) == ["0", "11", "12", "13", "15"]
    assert accounts["0"]["attempted"] == 0 and accounts["0"]["outcome"] == "rejected"
    assert accounts["13"]["attempted"] == 1 and accounts["13"]["accepted"] == 0
    assert accounts["15"]["attempted"] == 2
    rows = [(str(i), b) for i, b in enumerate(bodies)]
    bad = bad_batches(
        parse_batches(spark.createDataFrame(rows, "batch_id string, body string"))
    ).collect()
    assert sorted(int(r["batch_id"]) for r in bad) == [*range(1, 11), 14, 16]
    assert {r["error"] for r in bad} == {"Invalid ingestion request."}


def test_reference_time_counts_milliseconds(spark):
    texts = [dumps(entry(timestamp=f"2026-01-15T12:05:00.{f}Z")) for f in ("123", "1230", "1231")]
    assert reasons(spark, texts, "2026-01-15T12:00:00.123Z") == [
        None,
        None,
        REASON["timestamp_future"],
    ]


def test_log_rows_are_repeatable(spark):
    body = dumps({"logs": [entry(attributes={"n": 3, "s": "03", "b": True}), entry()]})
    accepted, rejected = v.split_valid(judge_bodies(spark, [body, body]))
    assert rejected.isEmpty()
    rows = to_log_rows(accepted, "run")
    first = {tuple(r) for r in rows.select("id", "message").collect()}
    assert first == {tuple(r) for r in rows.repartition(3).select("id", "message").collect()}
    assert len(first) == 4
    assert all(
        i[14] == "4" and i[19] == "8" and len(i) == 36 for i, _ in first
    )
    one = rows.where(F.size("attributes_search") > 0).first()
    assert one["attributes_search"] == {"n": "3", "s": "03", "b": "true"}
    assert json.loads(one["attributes"]) == {"n": 3, "s": "03", "b": True}
    assert str(one["event_date"]) == "2026-01-15"


def test_canonical_text_keeps_all_digits(spark):
    body = dumps({"logs": [entry(timestamp="2026-01-15T13:00:00.123456789000+01:00")]})
    row = judge_bodies(spark, [body]).select(
        canonical_parts(F.col("second"), F.col("fraction")).alias("text")
    )
    assert row.first()["text"] == "2026-01-15T12:00:00.123456789Z"


def test_inconsistent_accounts_are_found(spark):
    rows = [
        ("good", 3, 2, [(1, "x")]),
        ("sum", 3, 3, [(1, "x")]),
        ("twice", 3, 1, [(1, "x"), (1, "y")]),
        ("range", 3, 2, [(3, "x")]),
    ]
    df = spark.createDataFrame(
        rows,
        "batch_id string, attempted long, accepted long, "
        "rejected array<struct<index:int,reason:string>>",
    )
    found = {r["batch_id"]: r["consistent"] for r in v.check_accounting(df).collect()}
    assert found == {"good": True, "sum": False, "twice": False, "range": False}


def test_only_one_json_value_is_a_body(spark):
    good = '{"logs":[{"a":1}]}'
    refused = [
        "", " ", "5", "null", '"x"', "{}", '{"logs":null}', '{"logs":{}}', f"[{good}]", f"{good} x", good + good,
        f"{good},", f"{good}]", f"{good}] rest", f'{good},"x":1', f'null,"body":{good}', f'[1],"body":{good},"z":0',
        "1],[1", '{"logs":[1],"l\\u006fgs":{}}', '{"logs":[1],"logs":7}', "{'logs':[]}", '{"logs":[NaN]}',
    ]
    taken = [(good, 1), (f" {good}\t", 1), ('{"logs":[]}', 0), ('{"logs":{},"logs":[3]}', 1), ('{"logs":[1,2],"l\\u006fgs":[3]}', 1)]
    bodies = [*((b, None) for b in refused), *taken]
    df = spark.createDataFrame([(str(i), b) for i, (b, _) in enumerate(bodies)], "batch_id string, body string")
    got = {r["batch_id"]: r["logs"] for r in parse_batches(df).collect()}
    for i, (body, n) in enumerate(bodies):
        found = got[str(i)]
        assert (None if found is None else len(found)) == n, body
