from datetime import datetime

import pytest

from kinvec.llm.url_filters import BROADCAST_BYTES, intervals, url_verdicts

ENTRIES = [
    ("bad.org", "block", "2024-03-01"), ("bad.org", "clear", "2024-06-01"), ("ok.bad.org", "allow", "2024-01-01"),
    ("Site.com/Forum", "BLOCK", "2024-02-01"), ("site.com", "allow", "2024-01-15"), ("tie.net", "allow", "2024-01-01"),
    ("tie.net", "block", "2024-01-01"), ("", "block", "2024-01-01"), (None, "block", "2024-01-01"), ("x.y", None, "2024-01-01"), ("bad.org", "block", None),
]
CASES = [
    ("http://www.bad.org/x", "2024-02-29", "unlisted"), ("https://a.b.bad.org:8080", "2024-03-01", "block"), ("http://bad.org", "2024-06-01", "unlisted"),
    ("http://ok.bad.org/q?z#f", "2024-04-01", "allow"), ("http://site.com/forum/1/2", "2024-01-20", "allow"), ("http://u:p@site.com/forum/1/2", "2024-02-20", "block"),
    ("http://site.com/forums", "2024-02-20", "allow"), ("http://notbad.org", "2024-04-01", "unlisted"), ("http://tie.net.", "2024-01-02", "block"),
    ("ftp://bad.org", "2024-04-01", "invalid"), (None, "2024-04-01", "invalid"), ("", "2024-04-01", "invalid"), ("http://bad.org", None, "invalid"),
    ("http://a.b.c.d.e.f.bad.org", "2024-04-01", "block"), ("http://x.y", "2024-04-01", "unlisted"),
]


def day(x):
    return datetime.fromisoformat(x) if x else None


@pytest.mark.parametrize("limit", [BROADCAST_BYTES, 0])
def test_verdicts(spark, limit):
    rows = [(i, u, day(t), "p", 1) for i, (u, t, _) in enumerate(CASES)]
    captures = spark.createDataFrame(rows + rows[:2], "page_id long, url string, fetched_at timestamp, pattern string, since int")
    entries = spark.createDataFrame([(p, a, day(t)) for p, a, t in ENTRIES], "pattern string, action string, listed_at timestamp")
    got = [(r.page_id, r.verdict) for r in url_verdicts(captures, entries, broadcast_bytes=limit).collect()]
    assert len(got) == len(CASES) + 2
    assert dict(got) == {i: v for i, (_, _, v) in enumerate(CASES)}


def test_intervals_meet_and_empty_tables(spark):
    entries = spark.createDataFrame([("a.b", "block", day(f"2024-0{m}-01")) for m in (1, 2, 3)], "pattern string, action string, listed_at timestamp")
    rows = sorted((r.since, r.until) for r in intervals(entries).collect())
    assert [u for _, u in rows][:2] == [s for s, _ in rows][1:] and rows[-1][1] is None
    none = spark.createDataFrame([], "page_id long, url string, fetched_at timestamp")
    assert url_verdicts(none, entries).count() == 0
    one = spark.createDataFrame([(1, "http://a.b", day("2024-01-02"))], none.schema)
    assert [r.verdict for r in url_verdicts(one, entries.limit(0)).collect()] == ["unlisted"]


def test_entries_of_any_length_and_form(spark):
    cases = [
        ("b.c.d.e.example.org", "http://a.b.c.d.e.example.org/x"), ("b.c.d.e.example.org/p/q/r/s", "http://a.b.c.d.e.example.org/p/q/r/s/t"),
        ("deep.org/a/b/c", "http://deep.org/a/b/c/d"), ("www.Plain.org", "http://plain.org/x"), ("slash.org/", "http://sub.slash.org"),
        ("https://www.full.org:80/A//b/?q#f", "http://full.org/a/b"), ("dot.org.", "http://dot.org"),
    ]
    wide = ["example.org", "deep.org", "full.org"]
    time = day("2024-01-01")
    entries = spark.createDataFrame([(p, "block", time) for p, _ in cases] + [(p, "allow", time) for p in wide], "pattern string, action string, listed_at timestamp")
    captures = [u for _, u in cases] + ["http://deep.org/a/b", "http://e.example.org", "http://other.org"]
    captures = spark.createDataFrame([(i, u, time) for i, u in enumerate(captures)], "page_id long, url string, fetched_at timestamp")
    got = [r.verdict for r in url_verdicts(captures, entries).orderBy("page_id").collect()]
    assert got == ["block"] * len(cases) + ["allow", "allow", "unlisted"]
