"""Failure events: normalized rows, fingerprints, counts by fingerprint, when to notify, what kind of fault.

Everything is a projection or an aggregate with partial sums. A fingerprint that holds a tenth or a third of all rows
is never one group in one task: its running numbers are prefix sums over blocks of deliveries.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from millrace.functions.text import let
from millrace.operators.numbering import running_count

RENOTIFY_EVERY, RENOTIFY_HOURS = 10, 24
RAW = "ts string, kind string, tool string, module string, returncode int, stderr string, stdout string, cwd string, argv array<string>, host string"
BLOCK = 1 << 16  # deliveries numbered in one window

# Substrings that speak for the host, and for the code.
HOST_HINTS = (
    "authentication failed", "connection refused", "connection timed out", "operation timed out", "network/io error", "network/io", "ssh error", "no route to host",
    "no space left", "disk quota", "can't connect", "cannot connect", "failed to connect", "access denied for user", "incomplete credentials", "paramiko", "banner",
    "errno 61", "errno 60", "mamp", "broken pipe", "connection reset", "name or service not known", "nodename nor servname", "fast-forward", "non-fast-forward",
)
CODE_HINTS = (
    "traceback", "validationerror", "validation failed", "generator(s) failed", "integrityerror", "cwr-validator", "syntaxerror", "attributeerror", "keyerror", "typeerror",
    "valueerror", "assertionerror", "jsondecodeerror", "nameerror", "indexerror", "modulenotfounderror",
)
# Hints of a full disk and of an unreachable database, the line a failed pull leaves.
DISK_HINTS = ("no space left", "disk quota", "no space left on device")
DATABASE_HINTS = ("can't connect to mysql", "cannot connect to mysql", "failed to connect to database", "access denied for user", "can't connect to local mysql", "unable to connect to mysql")
PULL_FAILED = r"FAIL\s+(.+?)\s+\((?:main|submodules|origin/main --ff-only)\)"
# Warning noise, error words, the prefix of a log line, a traceback's frame.
WARNING = r"(?i)(warnings?\.warn|DeprecationWarning|FutureWarning|RequestsDependencyWarning|UserWarning|InsecureRequestWarning)"
ERROR = r"(?i)\b(error|failed|exception|traceback)\b"
LOG_PREFIX = r"^\d{4}-\d{2}-\d{2}\s+\d{2}:\d{2}:\d{2}\s+\w+\s+"
FRAME = r'File "([^"]+)", line (\d+)'


def text_or(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def any_of(said: Column, hints: tuple[str, ...]) -> Column:
    """Whether a text holds one of the hints; plain searches, far cheaper than one pattern of alternatives."""
    return reduce(lambda a, b: a | b, [said.contains(h) for h in hints])


# --- normalizing -----------------------------------------------------------------------------------------------------

def fingerprint(kind: Column, tool: Column, returncode: Column, stderr: Column) -> Column:
    code = F.when(returncode.isNull() | (returncode == 0), "").otherwise(returncode.cast("string"))
    return F.sha2(F.concat(text_or(kind), F.lit("|"), text_or(tool), F.lit("|"), code, F.lit("|"), F.substring(text_or(stderr), 1, 500)), 256)


def _lines(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, "\r\n|\n|\r"), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")), lambda x: x != "")


def message_from_stderr(stderr: Column) -> Column:
    """The last line that says something: not a traceback's first, nor 'During handling'; at most 240 code points."""
    def last(ls: Column) -> Column:
        said = F.filter(ls, lambda x: ~(x.startswith("Traceback") | x.startswith("During handling")))
        return F.when(F.size(ls) == 0, "(no stderr)").otherwise(F.substring(F.coalesce(F.try_element_at(said, F.lit(-1)), F.try_element_at(ls, F.lit(-1))), 1, 240))

    return let(_lines(text_or(stderr)), last)


def message_from_stdio(stdout: Column, stderr: Column) -> Column:
    """Error text rather than warning noise: stderr's message, else the last error-like line of stdout without its log prefix."""
    def shown(bad: Column) -> Column:
        cut = F.trim(F.regexp_replace(bad, LOG_PREFIX, ""))
        return F.substring(F.when(cut != "", cut).otherwise(bad), 1, 240)

    def chosen(err: Column) -> Column:
        found = let(F.try_element_at(F.filter(_lines(text_or(stdout)), lambda x: x.rlike(ERROR)), F.lit(-1)), shown)
        use = err != "(no stderr)"  # what a blank stderr gives as well
        return F.when(use & ~err.rlike(WARNING), err).otherwise(F.coalesce(found, err))

    return let(message_from_stderr(stderr), chosen)


def source_of(tool: Column) -> Column:
    return F.when(tool.startswith("cron_"), "cron").when(tool == "api_gateway", "api_gateway").otherwise("mcp_tool")


def severity_of(kind: Column) -> Column:
    return F.when(kind == "timeout", "timeout").otherwise("error")


def rel_path(module: Column, cwd: Column, argv: Column, stderr: Column, root: str) -> Column:
    """The failing file within its repository: from a traceback's frame, else the first argument, else the working directory."""
    prefix, mark = F.concat(F.lit(root.rstrip("/") + "/"), module, F.lit("/")), F.concat(F.lit("/REPOS/"), module, F.lit("/"))
    frames = F.regexp_extract_all(stderr, F.lit(FRAME), F.lit(1))
    inside = F.transform(frames, lambda p: F.when(p.startswith(prefix), F.substring(p, F.length(prefix) + 1, F.length(p)))
                         .when(p.contains(mark), F.substring(p, F.call_function("instr", p, mark) + F.length(mark), F.length(p))))
    framed = F.try_element_at(F.filter(inside, lambda p: p.isNotNull()), F.lit(1))
    first = F.try_element_at(argv, F.lit(1))
    arg = F.when(first.startswith("./"), F.substring(first, 3, 10_000)).when(~first.contains("/"), first)
    here = F.when(cwd.startswith(prefix), F.coalesce(F.nullif(F.substring_index(F.rtrim(F.substring(cwd, F.length(prefix) + 1, F.length(cwd)), F.lit("/")), "/", -1), F.lit("")), F.lit(".")))
    return F.coalesce(framed, arg, here, F.lit(""))


def normalize(raw: DataFrame, path_map: DataFrame, root: str = "/srv/rights/REPOS") -> DataFrame:
    """Raw failure rows (columns of RAW, any further ones kept) as incident rows; missing texts count as empty.

    The path map is one row a module and fixed in size; the optimizer broadcasts it by its own check.
    """
    pm = path_map.groupBy("module").agg(F.min("repos_name").alias("__mapped"))
    r = raw.join(pm, "module", "left")
    kind = F.when(text_or("kind") == "", "nonzero_exit").otherwise(F.col("kind"))
    module, stderr = text_or("module"), text_or("stderr")
    name = F.coalesce(F.nullif("__mapped", F.lit("")), F.nullif(module, F.lit("")), F.lit("UNKNOWN"))
    rest = [c for c in raw.columns if c not in ("ts", "kind", "tool", "module", "returncode", "stderr", "stdout", "cwd", "argv", "host")]
    return r.select(*rest, fingerprint(F.col("kind"), F.col("tool"), F.col("returncode"), stderr).alias("fingerprint"), text_or("ts").alias("detected_at"), source_of(text_or("tool")).alias("source"),
                    F.when(text_or("host") == "", "local").otherwise(F.col("host")).alias("host"), text_or("tool").alias("tool"), module.alias("module"), name.alias("repos_name"),
                    rel_path(module, text_or("cwd"), F.coalesce("argv", F.array().cast("array<string>")), stderr, root).alias("repos_rel_path"), severity_of(kind).alias("severity"), kind.alias("kind"), "returncode",
                    message_from_stdio(F.col("stdout"), stderr).alias("message"), F.when(stderr.contains("Traceback"), stderr).otherwise("").alias("stack_trace"), stderr.alias("raw_stderr_tail"))


def without_known(rows: DataFrame, rules: tuple[tuple[str, str], ...]) -> DataFrame:
    """Rows without known noise: each rule is a tool and a kind of failure that tool is known for."""
    known = reduce(lambda a, b: a | b, [F.col("tool").eqNullSafe(t) & F.col("kind").eqNullSafe(k) for t, k in rules], F.lit(False))
    return rows.where(~known)


# --- folding ---------------------------------------------------------------------------------------------------------

def fold(deliveries: DataFrame, key: Column, order: str = "delivery_id") -> DataFrame:
    """One row a fingerprint: first and last detection, times seen, the last message and host that are given. Partial sums only."""
    last = lambda c: F.max_by(c, F.when(text_or(c) != "", F.col(order)))
    return (deliveries.withColumn("__key", key).where(F.col("__key").isNotNull()).groupBy(F.col("__key").alias("fingerprint"))
            .agg(F.count(F.lit(1)).alias("seen_count"), F.min("detected_at").alias("first_detected_at"), F.max("detected_at").alias("last_detected_at"),
                 last("message").alias("message"), last("host").alias("host")))


def decide(state: Column, seen: Column, detected: Column, notified: Column, new_detected: Column | None, now: Column,
           every: int = RENOTIFY_EVERY, hours: float = RENOTIFY_HOURS) -> Column:
    """Why an event is told, or not, given the record it meets; the first rule that applies. A null state is no record.

    Told: new, reopened, escalated_retry, renotify_count, renotify_age. Not told: already_notified,
    resolved_same_event, duplicate.
    """
    age = (F.unix_seconds(now) - F.unix_seconds(F.coalesce(notified, detected))) / 3600.0
    seen = F.greatest(F.coalesce(seen, F.lit(1)), F.lit(1))
    reopened = F.lit(True) if new_detected is None else F.coalesce(new_detected != detected, new_detected.isNotNull())
    old = F.coalesce(age >= hours, F.lit(False)) if hours > 0 else F.lit(False)
    return (F.when(state.isNull(), "new").when(state == "NOTIFIED", "already_notified").when((state == "RESOLVED") & reopened, "reopened").when(state == "RESOLVED", "resolved_same_event")
            .when((state == "ESCALATED") & notified.isNull(), "escalated_retry").when((seen > 1) & (seen % every == 0), "renotify_count").when(old, "renotify_age").otherwise("duplicate"))


def told(reason: Column) -> Column:
    return reason.isin("new", "reopened", "escalated_retry", "renotify_count", "renotify_age")


def sequence(deliveries: DataFrame, key: Column, order: str = "delivery_id", every: int = RENOTIFY_EVERY) -> DataFrame:
    """Each delivery with its running number and the reason it would be told for, while nobody confirms or resolves.

    The count rule looks at how often the fingerprint was seen before this delivery.
    """
    keyed = deliveries.withColumn("fingerprint_key", key).where(F.col("fingerprint_key").isNotNull())
    n = running_count(keyed, ["fingerprint_key"], order, "seen_count_now", F.floor(F.col(order) / BLOCK))
    before = F.col("seen_count_now") - 1
    return n.withColumn("reason", F.when(before == 0, "new").when((before > 1) & (before % every == 0), "renotify_count").otherwise("duplicate"))


# --- classifying -----------------------------------------------------------------------------------------------------

def blob(*columns: str) -> Column:
    return F.lower(F.concat_ws(" ", *[text_or(c) for c in columns]))


SAID = ("message", "stack_trace", "raw_stderr_tail", "kind", "tool", "module")


def fault(said: Column, kind: Column) -> Column:
    """host or code; a timeout and whatever is unknown is the host's."""
    return F.when(kind == "timeout", "host").when(any_of(said, HOST_HINTS), "host").when(any_of(said, CODE_HINTS), "code").otherwise("host")


def joined(names: Column) -> Column:
    """Repositories as a phrase, each once whatever its case."""
    first = F.filter(names, lambda x, i: ~F.exists(F.slice(names, 1, i), lambda y: F.lower(y) == F.lower(x)) | (i == 0))
    n = F.size(first)
    return (F.when(n == 0, "a repo").when(n == 1, F.concat(F.lit("the "), F.try_element_at(first, F.lit(1)), F.lit(" repo")))
            .when(n == 2, F.concat(F.lit("the "), F.array_join(first, " and "), F.lit(" repos")))
            .otherwise(F.concat(F.lit("the "), F.array_join(F.slice(first, 1, F.greatest(n - 1, F.lit(1))), ", "), F.lit(", and "), F.try_element_at(first, F.lit(-1)), F.lit(" repos"))))


def template(tool: Column, said: Column) -> Column:
    """Which known fault a record is, in the order of the rules; null if none."""
    low = F.lower(said)
    return (F.when(tool == "cron_pull_all", "pull_all").when(tool == "cron_sync_backup", "backup").when(tool == "api_gateway", "gateway").when(any_of(low, DISK_HINTS), "disk")
            .when(~low.contains("traceback") & any_of(low, DATABASE_HINTS), "database"))


def failed_pulls(said: Column) -> Column:
    return F.transform(F.regexp_extract_all(said, F.lit(PULL_FAILED), F.lit(1)), lambda x: F.trim(x))


def action(tool: Column, module: Column) -> Column:
    """A job's name for people: the tool without its prefix, else the module, else the tool."""
    return F.when(tool.startswith("cron_"), F.replace(F.substring(tool, 6, 200), F.lit("_"), F.lit(" "))).when(module != "", F.replace(module, F.lit("-"), F.lit(" "))) \
        .when(tool != "", F.replace(tool, F.lit("_"), F.lit(" "))).otherwise("a job")


def humanized(message: Column, kind: Column, returncode: Column) -> Column:
    m = F.regexp_replace(F.regexp_replace(F.trim(text_or(message)), r"(?i)^\[ERR\]\s*", ""), r"(?i)^Error:\s*", "")
    up = F.concat(F.upper(F.substring(m, 1, 1)), F.substring(m, 2, 1_000_000))
    missing = F.regexp_extract(m, r"(?i)^file not found:\s*(.+)", 1)
    return (F.when(kind == "timeout", "The job timed out.").when((m == "") | (m == "(no stderr)"), F.when(F.coalesce(returncode, F.lit(0)) != 0, F.concat(F.lit("The script failed (exit code "), returncode.cast("string"), F.lit(").")))
                                                                 .otherwise("Something went wrong."))
            .when(missing != "", F.concat(F.lit("Couldn't find the file "), F.trim(missing), F.lit("."))).when(F.lower(m).startswith("traceback"), "The script crashed.").when(m.endswith("."), up).otherwise(F.concat(up, F.lit("."))))


def notification(tool: Column, module: Column, message: Column, kind: Column, returncode: Column, ref: Column, most: int = 320) -> Column:
    return F.substring(F.concat(action(text_or(tool), text_or(module)), F.lit(" failed: "), humanized(message, kind, returncode), F.lit(" (ref "), F.substring(ref, 1, 8), F.lit(")")), 1, most)
