"""Extraction against plain regex loops, counts of the derived lines, masking."""

import base64
import re

import pytest

from piitrace.functions.patterns import BLOB_SECRET, EXCLUDED_IPS, PATTERNS, PROFILES
from piitrace.operators import extract
from piitrace.sources import dims
from piitrace.sources.incident import Incident

TRICKY = [
    "a@b.co, A.B+c@d-e.org; 127.0.0.1 0.0.0.0 255.255.255.255 999.1.1.1 1.2.3.4.5",
    "User 'bob' USER\"Ann\" user=carl user=x User = 'no' user='q'",
    "+1-555-123-4567 +1-555-1234-567 +91-12345-67890 +44-20-1234-5678 +333-123-456-7890",
    "SK_LIVE_" + "a" * 24 + " ghp_" + "b" * 36 + " ghp_" + "b" * 35 + " hf_" + "C" * 34,
    "key=AKIA" + "A1" * 8 + " asia" + "b2" * 8 + " xoxb-0123456789 XOXP-abcdefghij",
    "password: \"abcdefghijkl\" pwd=short auth = a.b%c+d-e_f12 Token:\tabcdefghijklmnop",
    "d" * 32 + " " + "E" * 40 + " " + "f" * 33 + " x" + "a" * 32,
    "eyJ" + "a" * 30 + ".eyJ" + "b" * 30 + "." + "c" * 30 + " api-key_" + "d" * 20,
    "b64=" + base64.b64encode(b"token=" + b"z" * 33).decode(),
    "b64=" + base64.b64encode(b"credential = longvalue1").decode() + " end",
    "b64=" + base64.b64encode(b"secret=" + b"y" * 32).decode() + "\n key:\n\n  abcdefghijklm",
    "", "nothing here", "K" * 3 + "ey=abcdefghijklm",
]


def loop(text, profile):
    """First match per value of one text, in pattern order."""
    found = {}
    for pid in PROFILES[profile]:
        if pid == "E11":
            hits = []
            for blob in re.findall(PATTERNS["E10"].regex, text, re.ASCII):
                try:
                    plain = base64.b64decode(blob).decode("utf-8", "ignore")
                except ValueError:
                    continue
                hits += re.findall(BLOB_SECRET[profile], plain, re.ASCII)
            kind = "token"
        else:
            p = PATTERNS[pid]
            hits = [m.group(p.group) for m in re.finditer(p.regex, text, re.ASCII)]
            kind = p.pii_type
        for v in hits:
            if pid == "E2" and v in EXCLUDED_IPS[profile]:
                continue
            if kind == "token" and len(v) < 6:
                continue
            found.setdefault(v, (pid, kind))
    return found


@pytest.mark.parametrize("profile", ["demo", "server"])
def test_matches_regex_loops(spark, folder, profile):
    lines = [r.line for r in Incident.load(spark, folder).logs.select("line").collect()]
    texts = [r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    rows = list(enumerate([*TRICKY, *lines, *texts]))
    df = spark.createDataFrame(rows, "id BIGINT, text STRING")
    got = {}
    for r in extract.extract_pii(df, "text", ("id",), None, profile).collect():
        got.setdefault(r.id, {})[r.value] = (r.pattern_id, r.pii_type)
    in_row = {}
    for r in extract.line_matches(df, "text", ("id",), profile).collect():
        in_row.setdefault(r.id, {})[r.value] = (r.pattern_id, r.pii_type)
    for i, text in rows:
        assert got.get(i, {}) == loop(text, profile), text[:200]
    assert got == in_row


def test_hits_of_derived_lines(spark):
    logs = Incident.load(spark, "/root/testdata/sf0.01").logs
    counts = {r.pattern_id: r["count"] for r in extract.all_matches(logs).groupBy(
        "pattern_id").count().collect()}
    assert counts["E1"] == 1394 and counts["E3"] == 695 and counts["E11"] == 38
    assert counts["E20"] == 171 and counts["E22"] == 54
    assert set(counts) == set(PROFILES["demo"])


def test_first_seen_takes_the_first_pattern(spark):
    df = spark.createDataFrame([(1, 1, "key=AKIA" + "A1" * 8)],
                               "scenario_id BIGINT, log_id BIGINT, line STRING")
    rows = extract.extract_pii(df).collect()
    assert [(r.pattern_id, r.pii_type) for r in rows] == [("E15", "token")]


def test_merge_and_decoys(spark):
    found = spark.createDataFrame([(1, "8.8.8.8", "ip"), (1, "9.9.9.9", "ip")],
                                  "scenario_id BIGINT, value STRING, pii_type STRING")
    known = spark.createDataFrame([(1, "9.9.9.9"), (1, "x" * 16), (1, "x" * 16)],
                                  "scenario_id BIGINT, value STRING")
    merged = {r.value: r.pii_type for r in extract.merge_discovered(
        found, known, ("scenario_id",), "server").collect()}
    assert merged == {"8.8.8.8": "ip", "9.9.9.9": "ip", "x" * 16: "token"}
    left = extract.drop_decoys(found, dims.decoys(spark)).collect()
    assert [r.value for r in left] == ["9.9.9.9"]


def test_masking(spark):
    df = spark.createDataFrame(
        [("password=a.b@c.example x", [("email", "a.b@c.example")]),
         ("User 'bob' at 10.0.0.1, bobby", [("username", "bob"), ("username", "bobby")])],
        "line STRING, labels ARRAY<STRUCT<pii_type: STRING, value: STRING>>")
    got = [r.masked for r in extract.mask_text(df).collect()]
    assert got == ["password=[EMAIL] x", "User '[USERNAME]' at [IP], bobby"]
    got = [r.masked for r in extract.mask_known(df).collect()]
    assert got == ["password=[EMAIL] x", "User '[USERNAME]' at 10.0.0.1, [USERNAME]"]


@pytest.mark.parametrize("profile", ["demo", "server"])
def test_masked_text_holds_nothing_extraction_finds(spark, folder, profile):
    """No extracted value is left, no excluded address is gone."""
    lines = [r.line for r in Incident.load(spark, folder).logs.select("line").collect()]
    texts = [r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    more = ["127.0.0.1:80 x.127.0.0.1 0.0.0.0,255.255.255.255 9.127.0.0.1 127.0.0.1.7 1127.0.0.1"]
    rows = list(enumerate([*TRICKY, *more, *lines, *texts]))
    df = spark.createDataFrame(rows, "id BIGINT, text STRING")
    again = extract.all_matches(
        extract.mask_text(df, "text", profile).select("id", "masked"), "masked", ("id",), profile)
    # what a mask leaves behind may form a new match, but none of the values found before
    found = {}
    for r in extract.all_matches(df, "text", ("id",), profile).collect():
        found.setdefault(r.id, set()).add((r.pattern_id, r.value))
    for r in again.collect():
        assert (r.pattern_id, r.value) not in found.get(r.id, set()), (rows[r.id][1], r)
    plain = dict(rows)
    for r in extract.mask_text(df, "text", profile).collect():
        for ip in EXCLUDED_IPS[profile]:
            kept = [m for m in re.findall(PATTERNS["E2"].regex, plain[r.id], re.ASCII) if m == ip]
            assert r.masked.count(ip) >= len(kept), (plain[r.id], r.masked)


def test_blobs_with_secrets_are_masked(spark):
    blob = lambda b: "b64=" + base64.b64encode(b).decode()
    df = spark.createDataFrame([(blob(b"token=" + b"z" * 33) + " " + blob(b"just some plain words"),)],
                               "line STRING")
    masked = extract.mask_text(df).first().masked
    assert masked.startswith("b64=[TOKEN] b64=") and masked.count("[TOKEN]") == 1


def test_sketches_of_parts_add_up(spark):
    """Sketches of two halves give the estimate of the whole, within the stated error."""
    n = 6000
    docs = spark.range(n).selectExpr("id AS doc_id", "concat('mail a', id % 4000, '@b.co, again a', id % 4000, '@b.co') "
                                     "AS text", "concat('s', id % 2) AS source", "'en' AS lang")
    halves = extract.pii_sketches(docs.where("doc_id % 3 = 0")).unionByName(
        extract.pii_sketches(docs.where("doc_id % 3 <> 0")))
    got = {r.source: r for r in extract.sketched_rates(halves).where("lang is not null or source is null").collect()}
    assert (got[None].docs, got[None].docs_with_pii, got[None].hits) == (n, n, 2 * n)
    assert abs(got[None].distinct_values - 4000) <= 4000 * extract.SKETCH_ERROR
    assert abs(got["s0"].distinct_values - 2000) <= 2000 * extract.SKETCH_ERROR
    plan = extract.sketched_rates(extract.pii_sketches(docs))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") <= 4  # sketches are shuffled, not hits
