import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from millrace.operators import incidents as I, numbering
from millrace.streaming import lifecycle

NOW = datetime(2025, 6, 2)
T0 = datetime(2025, 6, 1, 12)


def test_decisions(spark):
    s = "state string, seen int, detected timestamp, notified timestamp, new timestamp"
    later = T0 + timedelta(minutes=1)
    rows = [(None, None, None, None, T0, "new"), ("NOTIFIED", 99, T0, T0, T0, "already_notified"), ("RESOLVED", 1, T0, None, T0, "resolved_same_event"), ("RESOLVED", 1, T0, None, later, "reopened"),
            ("ESCALATED", 1, T0, None, T0, "escalated_retry"), ("DETECTED", 10, T0, None, T0, "renotify_count"), ("DETECTED", 3, T0 - timedelta(hours=25), None, T0, "renotify_age"), ("DETECTED", 3, T0, None, T0, "duplicate")]
    df = spark.createDataFrame([r[:5] for r in rows], s)
    c = [F.col(x) for x in ("state", "seen", "detected", "notified")]
    assert [r[0] for r in df.select(I.decide(*c, F.col("new"), F.lit(NOW))).collect()] == [r[5] for r in rows]
    assert df.where("state = 'RESOLVED'").select(I.decide(*c, None, F.lit(NOW))).first()[0] == "reopened"


def test_running_count_of_a_hot_key(spark):
    rng = random.Random(1)
    rows = [(i, "hot" if rng.random() < .4 else rng.choice("abc") if rng.random() < .9 else None) for i in range(500)]
    df = numbering.running_count(spark.createDataFrame(rows, "i long, k string").repartition(5), ["k"], "i", "n", F.floor(F.col("i") / 32))
    seen, want = {}, {}
    for i, k in rows:
        seen[k] = seen.get(k, 0) + 1
        want[i] = seen[k]
    assert {r.i: r.n for r in df.collect()} == want


def by_hand(events, confirm, start):
    """The life cycle one event after another: the definition the folded batches are held against."""
    state, out = dict(start), {}
    for i, key, detected, now in events:
        s, seen, d, told_at = state.get(key, (None, 0, None, None))
        if s is None:
            why = "new"
        elif s == "NOTIFIED":
            why = "already_notified"
        elif s == "RESOLVED":
            why = "reopened" if detected != d and detected is not None else "resolved_same_event"
        elif s == "ESCALATED" and told_at is None:
            why = "escalated_retry"
        elif seen > 1 and seen % 10 == 0:
            why = "renotify_count"
        else:
            ref = told_at if told_at is not None else d
            why = "renotify_age" if ref is not None and (now - ref) / 3600 >= 24 else "duplicate"
        told = why in ("new", "reopened", "escalated_retry", "renotify_count", "renotify_age")
        s, seen, d, told_at = ("DETECTED", 1, detected, None) if why in ("new", "reopened") else (s, seen + 1, d, told_at)
        if confirm and told:
            s, told_at = "NOTIFIED", now
        state[key] = s, seen, d, told_at
        out[i] = key, seen, why, told
    return out, state


@pytest.mark.parametrize("confirm", [False, True])
def test_folded_batches_equal_one_event_after_another(spark, monkeypatch, confirm):
    monkeypatch.setattr(I, "BLOCK", 16)
    rng = random.Random(3)
    start = {"r": ("RESOLVED", 4, 50, 60), "e": ("ESCALATED", 2, 50, None), "n": ("NOTIFIED", 9, 50, 60), "d": ("DETECTED", 9, 50, None), "f": ("FIXING", 3, None, None)}
    events = [(i, rng.choice("aabrendf"), rng.choice([50, 50, 50, 700, None]), rng.choice([100, 90_000])) for i in range(150)]
    want, state = by_hand(events, confirm, start)
    stored, got = spark.createDataFrame([(k, *v) for k, v in start.items()], lifecycle.STATE), {}
    for at in range(0, 150, 60):
        batch = spark.createDataFrame([(k, i, d, n) for i, k, d, n in events[at:at + 60]], "fingerprint string, delivery_id long, detected long, now long").repartition(3)
        folded = lifecycle.fold_batch(batch, stored, confirm).collect()
        got.update({r.delivery_id: (r.fingerprint, r.seen_count, r.reason, r.told) for r in folded})
        folded = spark.createDataFrame(folded, "fingerprint string, delivery_id long, seen_count long, reason string, told boolean, n long, detected long, now long")
        stored = spark.createDataFrame(lifecycle.next_state(folded, stored, confirm).collect(), lifecycle.STATE)
    assert got == want
    assert {r.fingerprint: tuple(r)[1:] for r in stored.collect()} == state
    assert {r.fingerprint for r in lifecycle.next_state(folded.limit(0), stored, confirm, 10**9).collect()} <= {"f", "a", "b"}


def test_messages_and_paths(spark):
    rows = [("Traceback (most recent call last):\n  File \"x\"\nKeyError: 'a'\n", "", "KeyError: 'a'"), ("", "", "(no stderr)"), ("x.py:1: DeprecationWarning: old", "ok\n2025-01-01 00:00:00 ERROR load failed", "load failed"),
            ("DeprecationWarning: old", "fine", "DeprecationWarning: old"), (None, None, "(no stderr)"), ("Traceback", "", "Traceback"), ("a" * 300, "", "a" * 240)]
    df = spark.createDataFrame([r[:2] for r in rows], "e string, o string")
    assert [r[0] for r in df.select(I.message_from_stdio(F.col("o"), F.col("e"))).collect()] == [r[2] for r in rows]
    raw = spark.createDataFrame([("t", None, "cron_x", "M", 1, 'File "/srv/rights/REPOS/M/a/b.py", line 3', None, "", [], None), ("t", "timeout", "api_gateway", "N", 0, 'File "/old/REPOS/N/c.py", line 3', "", "", [], "h"),
                                 ("t", "x", "z", "O", None, "", "", "", ["./run.sh", "-v"], "h"), ("t", "x", "z", "P", None, "", "", "/srv/rights/REPOS/P/deep/dir", [], "h"), (None,) * 10], I.RAW)
    pm = spark.createDataFrame([("M", "REPO-M")], "module string, repos_name string")
    got = {r.module: r for r in I.normalize(raw, pm).collect()}
    assert [got[m].repos_rel_path for m in ("M", "N", "O", "P", "")] == ["a/b.py", "c.py", "run.sh", "dir", ""]
    assert (got["M"].source, got["M"].repos_name, got["M"].severity, got["N"].source, got["N"].severity, got["O"].source, got[""].repos_name) == ("cron", "REPO-M", "error", "api_gateway", "timeout", "mcp_tool", "UNKNOWN")
    a, b = got["O"], I.fingerprint(F.lit("x"), F.lit("z"), F.lit(0), F.lit(""))
    assert a.fingerprint == spark.range(1).select(b).first()[0]


def test_faults_and_templates(spark):
    rows = [("Authentication failed", "x", "t", "host", None), ("Connection refused", "x", "t", "host", None), ("timed out", "timeout", "t", "host", None), ("KeyError: 'foo' traceback", "x", "t", "code", None), ("1 generator(s) failed: M", "x", "t", "code", None),
            ("something odd", "x", "t", "host", None), ("! [rejected] non-fast-forward", "x", "cron_pull_all", "host", "pull_all"), ("No space left on device", "x", "t", "host", "disk"), ("Can't connect to MySQL server", "x", "t", "host", "database"),
            ("Traceback: can't connect to mysql", "x", "t", "host", None), ("x", "x", "api_gateway", "host", "gateway"), ("x", "x", "cron_sync_backup", "host", "backup")]
    df = spark.createDataFrame(rows, "message string, kind string, tool string, fault string, template string")
    got = df.select(I.fault(I.blob("message", "kind", "tool"), F.col("kind")), I.template(F.col("tool"), F.col("message"))).collect()
    assert [tuple(r) for r in got] == [r[3:] for r in rows]
    names = spark.createDataFrame([(["A", "a", "B"],), ([],), (["X"],), (["A", "B", "C"],)], "n array<string>").select(I.joined(F.col("n"))).collect()
    assert [r[0] for r in names] == ["the A and B repos", "a repo", "the X repo", "the A, B, and C repos"]
    assert spark.range(1).select(I.failed_pulls(F.lit("FAIL  R-1 (main)\nFAIL R-2 (submodules)"))).first()[0] == ["R-1", "R-2"]
    told = spark.range(1).select(I.notification(F.lit("cron_load_x"), F.lit(""), F.lit("[ERR] file not found: a.csv"), F.lit("x"), F.lit(1), F.lit("abcdefghij"))).first()[0]
    assert told == "load x failed: Couldn't find the file a.csv. (ref abcdefgh)"
