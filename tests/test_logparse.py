from datetime import datetime

import pytest

from millrace.operators import logparse as L

REF = datetime(2025, 5, 18, 12, 0, 0)


@pytest.mark.parametrize("line, want", [
    ("\x1b[32m2025-11-21 00:15:32.356 | ERROR    | works-sync:match:530 - retry\x1b[0m", ("2025-11-21 00:15:32", "ERROR", "works-sync", "retry")),
    ("[Fri Jan 09 06:15:47.125003 2026] [build:debug] [pid 1147] late", ("2026-01-09 06:15:47", "DEBUG", "build", "late")),
    ("2025/10/13 05:03:49.892 [worker-3] ERR   rights.Ledgerd - skipping", ("2025-10-13 05:03:49", "ERROR", "rights.Ledgerd", "skipping")),
    ("2026-01-01T19:19:16.781016Z 3 [ERROR] [MY-011717] [Repl] 861 rows", ("2026-01-01 19:19:16", "ERROR", "Repl", "861 rows")),
    ("[2026-01-08T12:18:37.300000+00:00] claimd.NOTICE: renamed {\"id\":344} []", ("2026-01-08 12:18:37", "INFO", "claimd", 'renamed {"id":344} []')),
    ('t=2025-06-29T21:11:23Z level=error app=intake.gateway msg="could not"', ("2025-06-29 21:11:23", "ERROR", "intake.gateway", "could not")),
    ("2025/07/24 18:13:02 works_sync.go:464: late", ("2025-07-24 18:13:02", "", "works_sync.go", "late")),
    ("E0518 04:41:28.079918 95696 statement_writer.py:622] commit failed", ("2025-05-18 04:41:28", "ERROR", "statement_writer.py", "commit failed")),
    ("E0519 04:41:28.079918 95696 statement_writer.py:622] commit failed", ("2024-05-19 04:41:28", "ERROR", "statement_writer.py", "commit failed")),
    ("Sep 13 12:51:55 node5 claimd[15313]: <warn> merged", ("2024-09-13 12:51:55", "WARNING", "claimd", "merged")),
    ("2025-02-08T14:17:35+05:30 ERR [royalty.loader] retry", ("2025-02-08 08:47:35", "ERROR", "royalty.loader", "retry")),
    ("[2025-06-27 14:35:53] [royalty.loader] [NOTICE] skipping", ("2025-06-27 14:35:53", "INFO", "royalty.loader", "skipping")),
    ("2025-06-16 12:30:51,081 CRITICAL royalty.loader: trim", ("2025-06-16 12:30:51", "CRITICAL", "royalty.loader", "trim")),
    ("[11:55:13] INFO intake.gateway - retry", ("2025-05-18 11:55:13", "INFO", "intake.gateway", "retry")),
    ("[12:55:13] INFO intake.gateway - retry", ("2025-05-17 12:55:13", "INFO", "intake.gateway", "retry")),
    ("1744591971.702 ERR split.matcher retry 1436", ("2025-04-14 00:52:51", "ERROR", "split.matcher", "retry 1436")),
    ("ERROR:feed.reader:could not unlock", ("", "ERROR", "feed.reader", "could not unlock")),
    ('{"ts": 1763204632038, "level": "warn", "logger": "ledgerd", "msg": "no"}', ("2025-11-15 11:03:52", "WARNING", "ledgerd", "no")),
    ('{"@timestamp": "2025-09-21T08:18:51+00:00", "log.level": "fatal", "service": "claimd", "message": "cut sho', ("2025-09-21 08:18:51", "CRITICAL", "claimd", "")),
])
def test_headers(line, want):
    assert L.header(line, REF) == want


@pytest.mark.parametrize("line", ["Traceback (most recent call last):", "KeyError: 'x'", "{", '{"page": 81, "level": "orphan"}', "...ows paused", "Caused by: rights.StoreFault: x", "-- ERROR rows only", "#0 /srv/a.php(3): f()", "",
                                  "025-06-16 12:30:51,081 ERROR x: cut", "99991.702 ERR x cut", "2025-13-40 99:99:99 ERROR x: no", "RuntimeError: cursor moved", "F0 x", "[abc", "Mar x"])
def test_continuations(line):
    assert L.header(line, REF) is None


def test_entries_hold_lines_and_messages():
    text = "...cut\r\n2025-06-16 12:30:51,081 ERROR a: one\r\n  2025-06-16 12:30:52 indented\r\nTraceback\n\nINFO:b:two"
    assert L.entries(text, REF) == [(1, "", "", "", "...cut"), (2, "2025-06-16 12:30:51", "ERROR", "a", "one\n  2025-06-16 12:30:52 indented\nTraceback\n"), (6, "", "INFO", "b", "two")]


def test_empty_null_and_unreferenced():
    assert L.entries(None, REF) == L.entries("", REF) == []
    assert [e[:4] for e in L.entries("[08:55:13] INFO x - y", None)] == [(1, "", "INFO", "x")]
    assert [e[:4] for e in L.entries("(no stderr)", None)] == [(1, "", "", "")]
    assert len(L.entries("x" * 2_000_000, REF)) == 1
    assert L.header('{"ts": ' + "[" * 200_000, REF) is None and L.header("2025-06-16 12:30:51.²  ERROR a: b", REF)[0] == "2025-06-16 12:30:51"
    assert L.header("Feb 29 01:02:03 h p[1]: m", datetime(2025, 5, 1))[0] == "2024-02-29 01:02:03"


def test_frame(spark):
    df = spark.createDataFrame([(1, "ERROR:a:b", None, "", datetime(2025, 1, 1), "x"), (2, None, None, None, None, "y"), (1, "ERROR:a:b", None, "", None, "x")],
                               "delivery_id long, raw_stderr_tail string, stack_trace string, message string, detected_at timestamp, id string")
    rows = L.parse_logs(df).collect()
    assert sorted(tuple(r) for r in rows) == [(1, "raw_stderr_tail", 1, "", "ERROR", "a", "b")] * 2
    assert L.parse_logs(df.limit(0)).count() == 0


def test_heads_of_any_length():
    key, thread, fn = "a" * 60, "t" * 200, "<function>" * 30
    at = datetime(2026, 1, 2)
    assert L.header(f"{key}=1 ts=2026-01-01T10:00:00Z level=error logger=x msg=y", at) == ("2026-01-01 10:00:00", "ERROR", "x", "y")
    assert L.header(f"[2026-01-01 10:00:00] [ERROR] [{thread}] gone", at) == ("2026-01-01 10:00:00", "ERROR", thread, "gone")
    assert L.header(f"2026-01-01 10:00:00 | INFO | mod:{fn}:12 - a - b", at) == ("2026-01-01 10:00:00", "INFO", "mod", "a - b")
    assert L.header("2026-01-01 10:00:00 | INFO | mod says a - b", at)[2:] == ("mod", "says a - b")
    for s in ("[" * 100_000, "a=" * 100_000, "a" * 300_000, "2026-01-01 10:00:00 " + "[x " * 50_000, "2026-01-01 10:00:00 | INFO | " + "m:" * 100_000):
        L.header(s, at)
