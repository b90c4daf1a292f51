from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from callsift.functions import text
from callsift.operators import transforms as tr


def test_normalize_cleans_and_flags(log, values):
    df = log(
        {"path": "//a///b/", "request_headers": {"Content-Type ": " x "}},
        {"path": "/", "method": " get "},
        {"path": "//", "request_body": "  text \n"},
        {"path": "/a", "request_headers": {"a": "1"}},
        {"path": "", "request_body": ""},
    )
    out = tr.normalize(df).orderBy("seq")
    assert values(out, "path") == ["/a/b", "/", "/", "/a", ""]
    assert values(out, "method")[1] == "GET"
    assert values(out, "request_headers") == [{"content-type": "x"}, {}, {}, {"a": "1"}, {}]
    assert values(out, "request_body") == [None, None, "text", None, ""]
    assert values(out, "changed") == [True, False, True, False, False]
    assert values(tr.change_counts(out, "changed")) == [(5, 2, 3)]


def test_colliding_header_names_keep_the_last_value(log, values):
    pairs = [F.lit(v) for v in ("A", "1", "b", "2", " a", " 3 ", "B", "4")]
    df = log({}).withColumn("request_headers", F.create_map(*pairs))
    out = tr.normalize(df)
    assert values(out, "request_headers", "changed") == [({"a": "3", "b": "4"}, True)]


def test_strip_matches_python_on_inner_and_outer_space(spark, values):
    cases = ["", " a ", "\x1ca\x85", "a  b", "　 x﻿", "\t\n", "x ​ "]
    df = spark.createDataFrame([(c,) for c in cases], "s string")
    assert values(df, text.strip(F.col("s"))) == [c.strip() for c in cases]


def test_anonymize_masks_headers_of_both_sides_and_the_request_body(log, values):
    df = log(
        {
            "request_headers": {"AUTHORIZATION": "secret", "Accept": "*"},
            "response_headers": {"Set-Cookie": "c"},
            "request_body": '{"Password" : "p", "token":"t", "note": "password"}',
            "response_body": '{"password": "stays"}',
        },
        {"request_body": None},
    )
    out = tr.anonymize(df).orderBy("seq")
    assert values(out, "request_headers")[0] == {"AUTHORIZATION": "[REDACTED]", "Accept": "*"}
    assert values(out, "response_headers")[0] == {"Set-Cookie": "[REDACTED]"}
    assert values(out, "request_body") == [
        '{"Password" : "[REDACTED]", "token":"[REDACTED]", "note": "password"}',
        None,
    ]
    assert values(out, "response_body")[0] == '{"password": "stays"}'


def test_anonymize_custom_lists_replace_the_defaults(log, values):
    df = log(
        {
            "request_headers": {"X-Mine": "1", "Cookie": "2"},
            "request_body": 'a "pin": "12" b "PIN":"34" "password": "p"',
        }
    )
    out = tr.anonymize(df, headers=["x-mine"], body_patterns=[r'"pin"\s*:\s*"\d+"'])
    assert values(out, "request_headers") == [{"X-Mine": "[REDACTED]", "Cookie": "2"}]
    assert values(out, "request_body") == [
        'a "pin": "[REDACTED]" b "PIN":"[REDACTED]" "password": "p"'
    ]
    assert values(tr.anonymize(df, headers=[]), "request_headers") == [
        {"X-Mine": "1", "Cookie": "[REDACTED]"}
    ]


def test_redact_chains_rules_and_flags_each_step(log, values):
    df = log(
        {"request_body": "Token abc", "request_headers": {"token": "my token"}},
        {"request_body": "nothing", "path": "/x"},
        {"request_body": None},
    )
    rules = [
        tr.RedactRule("request_body", "token", "T$"),
        tr.RedactRule("request_body", r"T\$", "Token"),
        tr.RedactRule("request_headers", "TOKEN"),
        tr.RedactRule("request_body", "noth", "x", predicate="path = '/y'"),
        tr.RedactRule("path", "x"),
    ]
    out = tr.redact(df, rules).orderBy("seq")
    assert values(out, "request_body") == ["Token abc", "nothing", None]
    assert values(out, "request_headers")[0] == {"token": "my [REDACTED]"}
    # The first two steps cancel out, yet the body was changed on the way.
    assert values(out, "redacted") == [True, False, False]


def test_redact_translates_groups(log, values):
    df = log({"request_body": "user=ann pin=7"})
    rule = tr.RedactRule("request_body", r"(?P<k>\w+)=(\w+)", r"\g<k>:\2$1")
    assert values(tr.redact(df, [rule]), "request_body") == ["user:ann$1 pin:7$1"]


def test_redact_predicates_see_the_original_row(log, values):
    df = log({"request_body": "a"})
    rules = [
        tr.RedactRule("request_body", "a", "b"),
        tr.RedactRule("request_body", "b", "c", predicate="request_body = 'a'"),
    ]
    assert values(tr.redact(df, rules), "request_body") == ["c"]


@pytest.mark.parametrize("limit", [0, 1, 2, 3, 4, 5, 6, 7, 50])
def test_truncate_cuts_bytes_like_a_replacing_decoder(log, values, limit):
    bodies = ["", "plain text", "é€𝄞x", "€€€€"]
    df = log(*[{"request_body": b} for b in bodies], {"request_body": None})

    def cut(body):
        raw = body.encode()
        return body if len(raw) <= limit else raw[:limit].decode(errors="replace") + "...[truncated]"

    out = tr.truncate(df, limit).orderBy("seq")
    assert values(out, "request_body") == [*[cut(b) for b in bodies], None]
    assert values(out, "truncated") == [*[len(b.encode()) > limit for b in bodies], False]


def test_errors_stay_in_their_row(log, values):
    df = log({"response_status": 200, "path": "7"}, {"response_status": 404, "path": "x"}, {"response_status": 401, "path": None})
    rules = [
        tr.PatchRule("method", F.lower),
        tr.PatchRule("duration_ms", lambda c: c / (F.col("response_status") % 100)),
        tr.PatchRule("request_body", lambda c: F.lit("seen"), "1 / (response_status - 404) > 0"),
        tr.PatchRule("query_string", lambda c: F.lit(None).cast("string"), "cast(path as int) = 7", nulls=True),
    ]
    out = tr.patch(df, rules, failed="patch_failed").orderBy("seq")
    assert values(out, "method", "duration_ms", "request_body", "query_string", "patched", "patch_failed") == [
        ("GET", 10.0, None, "", False, True), ("get", 2.5, None, "", True, False), ("get", 10.0, None, "", True, False),
    ]
    assert values(tr.patch_counts(df, rules)) == [(3, 2, 1, 1)]
    assert values(tr.patch_counts(df.limit(0), rules)) == [(0, 0, 0, 0)]
    assert df.sparkSession.conf.get("spark.sql.ansi.enabled") == "true"
    with pytest.raises(Exception):
        df.where("1 / (response_status - 404) > 0").collect()


def test_patch(log, values):
    df = log({"path": "/a", "duration_ms": 1.0}, {"path": "/b"}, {"path": None})
    rules = [
        tr.PatchRule("path", F.upper, "path = '/a'"),
        tr.PatchRule("path", lambda c: F.concat(c, F.lit("!")), "path = '/a'"),
        tr.PatchRule("absent", F.upper),
        tr.PatchRule("duration_ms", lambda c: c, None),
    ]
    out = tr.patch(df, rules).orderBy("seq")
    assert values(out, "path", "patched") == [("/A!", True), ("/b", False), (None, False)]
    assert out.columns == [*df.columns, "patched"]


def test_rename_applies_the_first_matching_rule_and_keeps_the_query(log, values):
    df = log({"path": "/v1/users", "query_string": "q=1"}, {"path": "/v1"}, {"path": "/x"}, {"path": None})
    rules = [tr.replace_path_prefix("/v1/u", "/U/"), tr.replace_path_prefix("/v1", "/v2")]
    out = tr.rename(df, rules).orderBy("seq")
    assert values(out, "path", "renamed") == [
        ("/U/sers", True), ("/v2", True), ("/x", False), (None, False),
    ]
    assert values(out, "query_string")[0] == "q=1"


def test_float_text_is_the_shortest_python_text(spark, values):
    numbers = [0.0, 1.0, 0.1, 65.5, 1704067207.179575, 1e7, 12345678.5, 123456789012345.6, 1e15,
               1e16, 1.5e22, 0.0005, 1e-5, 1.5e-7, -2.5, 3000.0, 100.1 * 10]
    df = spark.createDataFrame([(n,) for n in numbers], "n double")
    assert values(df, text.float_text(F.col("n"))) == [repr(n) for n in numbers]


def test_fixed_decimals_round_half_even_on_the_binary_value(spark, values):
    numbers = [0.25, 0.35, 2.5, 1234567.05, 0.05, 99.95]
    df = spark.createDataFrame([(n,) for n in numbers], "n double")
    assert values(df, text.fixed_decimals(F.col("n"), 1)) == [f"{n:.1f}" for n in numbers]


def test_path_prefix(spark, values):
    paths = ["/a/b/c", "a//b", "", "/", "//a/", "/a/b/c/d"]
    df = spark.createDataFrame([(p,) for p in paths], "p string")

    def prefix(path, depth):
        return "/" + "/".join(path.strip("/").split("/")[:depth])

    for depth in (1, 2, 3):
        assert values(df, text.path_prefix(F.col("p"), depth)) == [prefix(p, depth) for p in paths]


@pytest.mark.parametrize(
    "pattern, replacement",
    [
        (r"a.b", "x"),
        (r"B$", "x"),
        (r"b\Z", "x"),
        (r"(?P<l>[a-z])(?P=l)", r"<\g<l>>"),
        (r"(a)(b)?", r"\1\\$\n"),
        (r"(c)", r"\g<1>2"),
        (r"\bß\w", "$1"),
        (r"\s+", r"_\t"),
    ],
)
def test_patterns_and_replacements_mean_what_python_means(log, values, pattern, replacement):
    bodies = ["a\rb a\nb", "ab\n", "AAb bb ccb", "c\u2003ßé c", "x$y \\ b"]
    df = log(*[{"request_body": b} for b in bodies])
    got = tr.redact(df, [tr.RedactRule("request_body", pattern, replacement)]).orderBy("seq")
    want = [re.sub(pattern, replacement, b, flags=re.IGNORECASE) for b in bodies]
    assert values(got, "request_body") == want


def test_java_pattern_names_groups():
    assert text.java_pattern("(?P<a>x)(?P=a)\\Z\\\\Z") == "(?id)(?<a>x)\\k<a>\\z\\\\Z"
    assert text.java_pattern(r"(?#note)(?P<my_key>\w+)(?P=my_key)") == r"(?idU)(?<myU95key>\w+)\k<myU95key>"
    assert text.java_replacement(r"\g<my_key>") == "${myU95key}"
