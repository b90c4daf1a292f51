from __future__ import annotations

import json
import random

from pyspark.sql import functions as F

from callsift.functions.validity import DEEPEST, json_valid
from callsift.operators import inspection, rules
from callsift.operators.rules import Rule


def test_default_tags(log, values):
    df = log(
        {"duration_ms": 1000.0, "method": "post"},
        {"duration_ms": 1000.5, "response_status": 500},
        {"response_status": 404, "request_body": "x" * 4097},
        {"response_status": None, "duration_ms": None, "method": "PUT"},
    )
    assert values(rules.tag(df).orderBy("seq"), "matched_tags") == [
        ["post"], ["slow", "error", "get"], ["client-error", "get", "large-body"], [],
    ]


def test_null_predicate_is_no_match(log, values):
    df = log({"response_status": None})
    rule = Rule("r", "try_divide(response_status, 0) > 1")
    assert values(rules.tag(df, [rule]), "matched_tags") == [[]]
    assert values(rules.classify(df, [rule]), "category") == [None]
    assert values(rules.tag(df, []), "matched_tags") == [[]]


def test_labels_and_counts(log, values):
    df = log(
        {"method": "POST", "duration_ms": 2000.0},
        {"method": "post", "response_body": "x" * 10_001},
        {"method": "DELETE", "response_status": 503},
        {},
    )
    labeled = rules.label(df)
    assert values(labeled.orderBy("seq"), "labels") == [
        ["slow", "mutation"], ["large-response"], ["error", "mutation"], [],
    ]
    assert sorted(values(rules.label_counts(labeled))) == [
        ("error", 1), ("large-response", 1), ("mutation", 2), ("slow", 1),
    ]
    assert values(rules.label_totals(labeled)) == [(4, 3)]
    assert values(rules.label(df, rules.default_labels(1)).orderBy("seq"), "labels")[3] == ["slow"]


def test_first_matching_category_wins(log, values):
    df = log({"response_status": 500}, {"response_status": 404}, {})
    named = rules.classify(df, [Rule("bad", "response_status >= 400"), Rule("worse", "response_status >= 500")])
    assert values(named.orderBy("seq"), "category") == ["bad", "bad", None]
    assert sorted(values(rules.category_counts(named)), key=str) == [("bad", 2), (None, 1)]


def test_highlight(log, values):
    df = log({"response_status": 500, "duration_ms": 5000.0}, {"duration_ms": 5000.0}, {})
    assert values(rules.highlight(df).orderBy("seq"), "rule") == ["server-error", "slow", None]
    assert sorted(values(rules.highlighted_only(df), "id")) == ["0", "1"]


def test_validation_counts_null_as_failure(log, values):
    df = log(
        {"response_status": 500, "path": "  ", "duration_ms": 100.0},
        {"response_status": None},
        {},
    )
    checks = [rules.status_below_500(), rules.non_empty_path(), rules.duration_at_most(50)]
    assert sorted(values(rules.validate(df, checks), "record_id", "rule_name")) == [
        ("0", "duration_below_50ms"), ("0", "no_server_error"), ("0", "non_empty_path"),
        ("1", "no_server_error"),
    ]
    assert values(rules.validation_summary(df, checks)) == [(3, 4, 1)]
    assert rules.validate(df, []).count() == 0
    assert values(rules.validation_summary(df.limit(0), checks)) == [(0, 0, 0)]


def test_scores(log, values):
    df = log(
        {"response_status": 500, "duration_ms": 3000.0, "method": "DELETE", "request_body": "x" * 10_001},
        {"response_status": 404, "duration_ms": 1000.0},
        {"method": "delete"},
        {"duration_ms": 999.9, "response_status": 503},
    )
    scored = inspection.score(df)
    assert values(scored, "id", "score", "band") == [
        ("0", 19, "HIGH"), ("3", 10, "HIGH"), ("1", 7, "MED"), ("2", 0, "LOW"),
    ]
    assert values(scored, "reasons")[0] == [
        "Server error status 500",
        "Very slow response 3000.0ms (>=3000ms)",
        "Destructive method DELETE",
        "Large request body (10001 bytes)",
    ]
    assert inspection.score(df, min_score=8).count() == 2


def test_inspection_warnings(log, values):
    json_type = {"CONTENT-TYPE": "application/json; charset=utf-8"}
    df = log(
        {"duration_ms": 1500.25, "response_status": 502},
        {"request_body": "x"},
        {"request_body": "{bad", "request_headers": json_type, "response_status": 404},
        {"request_body": '{"a": NaN, "a": 1}', "request_headers": json_type},
        {"response_body": "{} {}", "response_headers": json_type, "path": " "},
        {"request_body": "", "request_headers": json_type, "duration_ms": None, "response_status": None},
        {"path": None},
    )
    warned = inspection.inspection_warnings(inspection.inspect(df))
    assert sorted(values(warned, "record_id", "position", "field")) == [
        ("0", 0, "duration_ms"),
        ("0", 1, "response_status"),
        ("1", 0, "request_headers"),
        ("2", 0, "request_body"),
        ("4", 0, "response_body"),
        ("4", 1, "path"),
        ("6", 0, "path"),
    ]
    slow = warned.where("field = 'duration_ms'")
    assert values(slow, "message") == ["1500.2 ms exceeds threshold 1000.0 ms"]


def _parses(text):
    if not text:
        return False
    try:
        json.loads(text)
    except (ValueError, RecursionError):
        return False
    return True


def _documents(rng, depth=0):
    kind = rng.randrange(8 if depth < 7 else 5)
    if kind < 5:
        return rng.choice([0, -1, 2.5, 1e30, True, None, 'a"b\\c', "é \x7f", "", "x\ty", float("nan"), float("-inf"), "😀"])
    if kind < 7:
        return {str(rng.random())[:4]: _documents(rng, depth + 1) for _ in range(rng.randrange(4))}
    return [_documents(rng, depth + 1) for _ in range(rng.randrange(4))]


def test_json_validity_equals_a_parser_on_broken_texts(spark):
    rng, texts = random.Random(5), [None, "", " ", "\x01", "\x02", "[\x02]", "01", "1.", "-", "- 1", "1 2", '"a" "b"', "{,}"]
    texts += ["[1,]", '{"a":1,}', "[,1]", '{"a"}', "{1:2}", "\ufeff{}", "]", "{]", '{"a":[}]', "nullnull", '"\\u12g4"', '"\\ud800"']
    signs = list('{}[],:"\\ \n\t0123.eE-+ntfNIa\x00\x01\x02\x0b\u0085/u')
    for _ in range(600):
        whole = json.dumps(_documents(rng), ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, 2]))
        texts.append(whole)
        for _ in range(3):
            broken = list(whole)
            for _ in range(rng.randrange(1, 4)):
                if rng.random() < 0.3 and broken:
                    broken.pop(rng.randrange(len(broken)))
                else:
                    broken.insert(rng.randrange(len(broken) + 1), rng.choice(signs))
            texts.append("".join(broken))
    # Long and deep texts: matched without recursion.
    texts += ['"' + "x" * 300_000 + '"', '"' + "\\n" * 200_000 + '"', "[" + "1," * 200_000 + "1]", "[" + "[[1]]," * 20_000 + "{}]"]
    texts += ["[" * 1_500 + "]" * 1_500, '{"a":' * 900 + "1" + "}" * 900, "[" * 1_500 + "]" * 1_499]
    df = spark.createDataFrame(list(enumerate(texts)), "n int, body string")
    found = df.select("n", json_valid(F.col("body"), F.lit(True)).alias("valid")).collect()
    assert [texts[r["n"]] for r in found if r["valid"] != _parses(texts[r["n"]])] == []
    assert sum(r["valid"] for r in found) > 600
    too_deep = spark.createDataFrame([("[" * (DEEPEST + 9) + "]" * (DEEPEST + 9),)], "body string")
    assert not too_deep.select(json_valid(F.col("body"), F.lit(True))).first()[0]
    assert not df.where(json_valid(F.col("body"), F.lit(False))).count()
