"""Log text of differing programs into entries with timestamp, level, component and message.

A line is read by a deterministic character-level machine: its first character picks the state (record brace,
bracket, digit, letter, colour escape), the timestamp states then consume the head character by character, and a
grammar per family of layouts assigns what is left to level and component. A line that reaches no accepting state,
or that is indented, is a continuation and is attached to the entry above; lines before the first header form an
entry of their own with empty fields.

Defined results: a null or empty text has no entry; a text of blanks is one entry without fields; carriage returns
at line ends are no part of a line; a record cut short is read as far as it goes; very long lines cost their head
only; repeated rows give repeated entries.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from datetime import datetime, timedelta

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

LEVELS = {
    **dict.fromkeys(("trace", "trc", "debug", "dbg", "dbug", "debg", "verbose", "fine", "d", "t"), "DEBUG"),
    **dict.fromkeys(("info", "inf", "information", "notice", "note", "ntc", "not", "i", "n"), "INFO"),
    **dict.fromkeys(("warn", "warning", "wrn", "wrng", "w"), "WARNING"),
    **dict.fromkeys(("err", "error", "erro", "eror", "severe", "e"), "ERROR"),
    **dict.fromkeys(("crit", "critical", "crt", "fatal", "fat", "ftl", "emerg", "emergency", "panic", "alert", "f", "c"), "CRITICAL"),
}
MONTHS = {m: i + 1 for i, m in enumerate(("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"))}
DAYS = {"Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun"}
TS_KEYS = ("ts", "timestamp", "time", "@timestamp", "t", "datetime", "date", "when")
LEVEL_KEYS = ("level", "lvl", "severity", "log.level", "loglevel", "levelname", "priority")
COMPONENT_KEYS = ("logger", "name", "component", "service", "app", "module", "subsystem", "program", "source", "logger_name", "log.logger")
MESSAGE_KEYS = ("msg", "message", "text", "event")

EPOCH = datetime(1970, 1, 1)
NAME = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_.-/$")


def level_of(word: str, short: bool = False) -> str:
    """The level a word names, or ''. One-letter forms count only where the layout asks for one."""
    return LEVELS.get(word.lower(), "") if len(word) > 1 or short else ""


def _num(s: str, i: int, n: int) -> int:
    """n decimal digits at i, or -1."""
    d = s[i:i + n]
    return int(d) if len(d) == n and d.isascii() and d.isdecimal() else -1


def _clock(s: str, i: int) -> tuple[int, int, int, int] | None:
    """States of hh:mm:ss with an optional fraction: (end, seconds of the day, microseconds, 0)."""
    h, m, x = _num(s, i, 2), _num(s, i + 3, 2), _num(s, i + 6, 2)
    if not (0 <= h < 24 and 0 <= m < 60 and 0 <= x <= 60) or s[i + 2:i + 3] != ":" or s[i + 5:i + 6] != ":":
        return None
    j, micros = i + 8, 0
    if s[j:j + 1] in (".", ",") and s[j + 1:j + 2].isdecimal():
        k = j + 1
        while k < len(s) and s[k].isdecimal():
            k += 1
        micros, j = int(s[j + 1:k][:6].ljust(6, "0")), k
    elif s[j:j + 1].isdecimal():
        return None
    return j, h * 3600 + m * 60 + min(x, 59), micros, 0


def _zone(s: str, j: int) -> tuple[int, int]:
    """An offset at j: (end, minutes)."""
    k = j + 1 if s[j:j + 1] == " " and s[j + 1:j + 2] in ("+", "-", "U", "G", "Z") else j
    c = s[k:k + 1]
    if c == "Z" and not s[k + 1:k + 2].isalnum():
        return k + 1, 0
    if s[k:k + 3] in ("UTC", "GMT") and not s[k + 3:k + 4].isalnum():
        return k + 3, 0
    if c and c in "+-":
        h = _num(s, k + 1, 2)
        i = k + 4 if s[k + 3:k + 4] == ":" else k + 3
        m = _num(s, i, 2)
        if 0 <= h <= 14 and 0 <= m < 60:
            return i + 2, (h * 60 + m) * (1 if c == "+" else -1)
        if 0 <= h <= 14 and not s[k + 3:k + 4].isdecimal():
            return k + 3, h * 60 * (1 if c == "+" else -1)
    return j, 0


def _stamp(y: int, mo: int, d: int, sec: int, off: int) -> str | None:
    if not (1 <= mo <= 12 and 1 <= d <= 31 and 1900 <= y <= 2200):
        return None
    if not off and d <= 28:
        return f"{y:04d}-{mo:02d}-{d:02d} {sec // 3600:02d}:{sec // 60 % 60:02d}:{sec % 60:02d}"
    try:
        return str(datetime(y, mo, d) + timedelta(seconds=sec - off * 60))
    except ValueError:
        return None


def iso(s: str, i: int) -> tuple[int, str] | None:
    """States of a full date and time, yyyy-mm-dd or yyyy/mm/dd, with fraction and offset: (end, stamp)."""
    sep = s[i + 4:i + 5]
    if sep not in ("-", "/") or s[i + 7:i + 8] != sep or s[i + 10:i + 11] not in ("T", " ", "t", "_"):
        return None
    y, mo, d = _num(s, i, 4), _num(s, i + 5, 2), _num(s, i + 8, 2)
    if min(y, mo, d) < 0 or not (c := _clock(s, i + 11)):
        return None
    j, off = _zone(s, c[0])
    t = _stamp(y, mo, d, c[1], off)
    return (j, t) if t else None


def epoch(s: str, i: int) -> tuple[int, str] | None:
    """States of seconds (10 digits, optional fraction) or milliseconds (13 digits) since 1970."""
    j = i
    while j < len(s) and j - i < 20 and s[j].isdecimal():
        j += 1
    if j - i not in (10, 13, 16, 19) or s[i] not in "12":
        return None
    sec = int(s[i:i + 10])
    if s[j:j + 1] == "." and s[j + 1:j + 2].isdecimal():
        j += 1
        while j < len(s) and s[j].isdecimal():
            j += 1
    return j, str(EPOCH + timedelta(seconds=sec))


def _latest(sec: int, micros: int, ref: datetime | None, month: int = 0, day: int = 0) -> str:
    """The latest moment not after ref with this time, and this month and day if given; '' without ref or such a day."""
    if ref is None:
        return ""
    if not month:
        t = ref.replace(hour=0, minute=0, second=0, microsecond=0) + timedelta(seconds=sec, microseconds=micros)
        t = t if t <= ref else t - timedelta(days=1)
        return str(t.replace(microsecond=0))
    for y in range(ref.year, max(ref.year - 9, 1), -1):
        try:
            t = datetime(y, month, day) + timedelta(seconds=sec, microseconds=micros)
        except ValueError:
            continue
        if t <= ref:
            return str(t.replace(microsecond=0))
    return ""


def _name(s: str, i: int) -> tuple[int, str]:
    """The longest component name at i, without a trailing stop."""
    j = i
    while j < len(s) and s[j] in NAME:
        j += 1
    e = j
    while e > i and s[e - 1] in ".-/":
        e -= 1
    return e, s[i:e]


def _word(s: str, i: int) -> tuple[int, str]:
    j = i
    while j < len(s) and s[j].isalpha():
        j += 1
    return j, s[i:j]


def _skip(s: str, i: int) -> int:
    while i < len(s) and s[i] == " ":
        i += 1
    return i


def _bracket(s: str, i: int) -> tuple[int, str] | None:
    """Content of [...] at i."""
    if s[i:i + 1] != "[":
        return None
    j = s.find("]", i)
    return (j + 1, s[i + 1:j]) if j > 0 else None


def _source(s: str, i: int) -> tuple[int, str] | None:
    """file.ext:line at i: (end, file)."""
    e, n = _name(s, i)
    if "." not in n or s[e:e + 1] != ":" or not s[e + 1:e + 2].isdecimal():
        return None
    j = e + 1
    while j < len(s) and s[j].isdecimal():
        j += 1
    return j, n


def _is_code(x: str) -> bool:
    """Process id, thread, error code, host port: brackets that name no component."""
    low = x.lower()
    return not x or x[0].isdecimal() or low.startswith(("pid", "tid", "thread", "worker", "pool-", "main", "client ", "my-", "exec-")) or " " in x or (x.rpartition("-")[2].isdecimal() and x.rpartition("-")[0].isupper())


def _after_date(s: str, i: int, loose: bool) -> tuple[str, str, int]:
    """Grammar of what follows a full timestamp: (level, component, start of the message)."""
    i = _skip(s, i)
    level = comp = ""
    c = s[i:i + 1]
    if c == "|":  # time | LEVEL | name:function:line - message
        j = _skip(s, i + 1)
        e, w = _word(s, j)
        e = _skip(s, e)
        if s[e:e + 1] == "|" and (lv := level_of(w)):
            j = _skip(s, e + 1)
            e, n = _name(s, j)
            k = e
            while k < len(s) and s[k] != " ":  # :function:line
                k += 1
            return lv, n, k + 3 if s[k:k + 3] == " - " else e
        return "", "", i
    if c.isdecimal():  # a thread id before brackets
        j = i
        while j < len(s) and s[j].isdecimal():
            j += 1
        if s[j:j + 2] == " [":
            i, c = j + 1, "["
    if c == "[":
        found = False
        while (b := _bracket(s, i)) is not None and not (level and comp):
            e, x = b
            if not level and (lv := level_of(x)):
                level, found = lv, True
            elif _is_code(x):
                pass
            elif not comp and x and all(ch in NAME for ch in x):
                comp, found = x, True
            else:
                break
            i = _skip(s, e)
        if not found or not (level and comp):
            e, w = _word(s, i)
            if not level and (lv := level_of(w)) and s[e:e + 1] in (" ", ":", ""):
                level, j = lv, _skip(s, e)
                e, n = _name(s, j)
                if n and s[e:e + 3] == " - " or n and s[e:e + 1] == ":":
                    return level, comp or n, e + (3 if s[e:e + 1] == " " else 1)
                return level, comp, j
        return level, comp, i
    e, w = _word(s, i)
    if w and s[e:e + 1] in (" ", ":", "") and (lv := level_of(w)):
        j = _skip(s, e + (s[e:e + 1] == ":"))
        if (b := _bracket(s, j)) is not None:
            return (lv, b[1], b[0] + 1) if b[1] and not _is_code(b[1]) else (lv, "", b[0] + 1)
        if src := _source(s, j):
            return lv, src[1], src[0] + 1
        e, n = _name(s, j)
        if n and (s[e:e + 1] == ":" or s[e:e + 3] == " - "):
            return lv, n, e + (1 if s[e:e + 1] == ":" else 3)
        if n and loose and s[e:e + 1] in (" ", ""):
            return lv, n, e + 1
        return lv, "", j
    if src := _source(s, i):
        return "", src[1], src[0] + 1
    return "", "", i


def _pairs(s: str) -> dict[str, str]:
    """key=value pairs, values bare or in double quotes; what follows a broken pair is left out."""
    out: dict[str, str] = {}
    i, n = 0, len(s)
    while i < n:
        i = _skip(s, i)
        j = i
        while j < n and (s[j] in NAME or s[j] == "@"):
            j += 1
        if j == i or s[j:j + 1] != "=":
            break
        key, i = s[i:j], j + 1
        if s[i:i + 1] == '"':
            j, buf = i + 1, []
            while j < n and s[j] != '"':
                j += s[j] == "\\" and j + 1 < n
                buf.append(s[j])
                j += 1
            val, i = "".join(buf), j + 1
        else:
            j = s.find(" ", i)
            j = n if j < 0 else j
            val, i = s[i:j], j
        out.setdefault(key, val)
    return out


def _object(s: str) -> dict:
    """The top level of a JSON record; a record cut short is closed where it ends."""
    try:
        x = json.loads(s)
        return x if isinstance(x, dict) else {}
    except (ValueError, RecursionError):
        pass
    out: dict = {}
    dec, i = json.JSONDecoder(), 1
    while i < len(s):
        while i < len(s) and s[i] in " ,\t":
            i += 1
        try:
            key, i = dec.raw_decode(s, i)
            while i < len(s) and s[i] in " :\t":
                i += 1
            out[key], i = dec.raw_decode(s, i)
        except (ValueError, TypeError, RecursionError):
            break
    return out if all(isinstance(k, str) for k in out) else {}


def _first(rec: dict, keys: tuple[str, ...]):
    for k in keys:
        if k in rec and rec[k] not in (None, ""):
            return rec[k]
    return None


def _moment(v) -> str:
    """A record's time value, text or number, as a stamp or ''."""
    if isinstance(v, bool) or v is None:
        return ""
    s = str(v).strip()
    t = iso(s, 0) or epoch(s, 0)
    return t[1] if t else ""


def _record(rec: dict) -> tuple[str, str, str, str] | None:
    ts, lv, comp = _moment(_first(rec, TS_KEYS)), level_of(str(_first(rec, LEVEL_KEYS) or "")), _first(rec, COMPONENT_KEYS)
    comp = comp if isinstance(comp, str) else ""
    if not ts and not (lv and comp):
        return None
    return ts, lv, comp, str(_first(rec, MESSAGE_KEYS) or "")


def strip_colour(s: str) -> str:
    """Removes terminal escapes: ESC [ parameters letter."""
    out, i = [], 0
    while (j := s.find("\x1b", i)) >= 0:
        out.append(s[i:j])
        i = j + 1
        if s[i:i + 1] == "[":
            i += 1
            while i < len(s) and not s[i].isalpha():
                i += 1
            i += 1
    out.append(s[i:])
    return "".join(out)


def header(s: str, ref: datetime | None) -> tuple[str, str, str, str] | None:
    """(ts, level, component, message) of a line that opens an entry, or None for a continuation."""
    c = s[:1]
    if c == "\x1b":
        s = strip_colour(s)
        c = s[:1]
    if not c or c in " \t\r\f\v\xa0":
        return None
    if c == "{":
        return _record(_object(s)) if '"' in s else None
    if c == "[":
        b = _bracket(s, 0)
        if b is None:
            return None
        e, x = b
        if t := iso(x, 0):
            i = _skip(s, e)
            if s[i:i + 1] not in ("[", ""):  # channel.LEVEL: message
                k, n = _name(s, i)
                head, dot, tail = n.rpartition(".")
                if dot and s[k:k + 1] == ":" and (lv := level_of(tail)):
                    return t[1], lv, head, s[k + 1:].lstrip()
            lv, comp, m = _after_date(s, e, False)
            return t[1], lv, comp, s[m:].lstrip()
        if x[:3] in DAYS and x[4:7] in MONTHS:  # [Day Mon dd time year] [module:level] [pid n] message
            d, k = _num(x, 8, 2), _clock(x, 11)
            if d < 0:
                d = _num(x, 9, 1) if x[8:9] == " " else -1
            if k and d > 0 and (y := _num(x, k[0] + 1, 4)) > 0 and (ts := _stamp(y, MONTHS[x[4:7]], d, k[1], 0)):
                i, lv, comp = _skip(s, e), "", ""
                while (b := _bracket(s, i)) is not None:
                    e, y = b
                    mod, colon, tail = y.partition(":")
                    if colon and level_of(tail) and not lv:
                        lv, comp = level_of(tail), "" if mod == "-" else mod
                    elif level_of(y) and not lv:
                        lv = level_of(y)
                    elif not _is_code(y):
                        break
                    i = _skip(s, e)
                return ts, lv, comp, s[i:]
            return None
        k = _clock(x, 0)
        if k and k[0] == len(x):  # [time] LEVEL name - message
            lv, comp, m = _after_date(s, e, False)
            return _latest(k[1], k[2], ref), lv, comp, s[m:].lstrip()
        return None
    if c.isdecimal():
        if t := iso(s, 0):
            lv, comp, m = _after_date(s, t[0], False)
            return t[1], lv, comp, s[m:].lstrip()
        if (t := epoch(s, 0)) and s[t[0]:t[0] + 1] == " ":
            lv, comp, m = _after_date(s, t[0], True)
            return t[1], lv, comp, s[m:].lstrip()
        k = _clock(s, 0)
        if k and s[k[0]:k[0] + 1] in (" ", ""):
            lv, comp, m = _after_date(s, k[0], False)
            return _latest(k[1], k[2], ref), lv, comp, s[m:].lstrip()
        return None
    if c in "DIWEFCN" and s[1:2].isdecimal():  # Lmmdd time pid file:line] message
        mo, d = _num(s, 1, 2), _num(s, 3, 2)
        k = _clock(s, 6) if s[5:6] == " " else None
        if k and 1 <= mo <= 12 and 1 <= d <= 31:
            i = _skip(s, k[0])
            while i < len(s) and s[i].isdecimal():
                i += 1
            i = _skip(s, i)
            comp = ""
            if src := _source(s, i):
                comp, i = src[1], src[0]
                i += s[i:i + 1] == "]"
            return _latest(k[1], k[2], ref, mo, d), level_of(c, True), comp, s[i:].lstrip()
        return None
    if s[:3] in MONTHS and s[3:4] == " ":  # Mon dd time host program[pid]: <level> message
        d = _num(s, 4, 2) if s[4:5] != " " else _num(s, 5, 1)
        k = _clock(s, 7) if s[6:7] == " " else None
        if k and 1 <= d <= 31:
            i = _skip(s, k[0])
            i, _ = _name(s, i)
            i = _skip(s, i)
            e, comp = _name(s, i)
            i, lv = e, ""
            if (b := _bracket(s, e)) is not None:
                i = b[0]
            if s[i:i + 1] == ":":
                i = _skip(s, i + 1)
                e, w = _word(s, i + 1)
                if s[i:i + 1] == "<" and s[e:e + 1] == ">" and level_of(w):
                    lv, i = level_of(w), e + 1
                else:
                    e, w = _word(s, i)
                    if level_of(w) and s[e:e + 1] == ":":
                        lv, i = level_of(w), e + 1
            else:
                comp = ""
            return _latest(k[1], k[2], ref, MONTHS[s[:3]], d), lv, comp, s[i:].lstrip()
        return None
    if c.isalpha() or c == "@":
        e, w = _word(s, 0)
        if s[e:e + 1] == ":" and s[e + 1:e + 2] != " " and (lv := level_of(w)):  # LEVEL:name:message
            k, n = _name(s, e + 1)
            if n and s[k:k + 1] == ":":
                return "", lv, n, s[k + 1:].lstrip()
            return None
        e = 0
        while e < len(s) and (s[e] in NAME or s[e] == "@"):
            e += 1
        if s[e:e + 1] == "=":
            return _record(_pairs(s))
    return None


def entries(text: str | None, ref: datetime | None, with_message: bool = True) -> list[tuple[int, str, str, str, str]]:
    """(first line, ts, level, component, message) of each entry of one text."""
    if not text:
        return []
    out: list[list] = []
    body: list[str] = []
    for n, line in enumerate(text.split("\n"), 1):
        h = None
        if line and line[0] not in " \t\r":
            h = header(line[:-1] if line[-1] == "\r" else line, ref)
        if h is not None or n == 1:
            if with_message and out:
                out[-1][4] = "\n".join(body)
            ts, lv, comp, msg = h or ("", "", "", line[:-1] if line[-1:] == "\r" else line)
            out.append([n, ts, lv, comp, ""])
            body = [msg]
        elif with_message:
            body.append(line[:-1] if line[-1:] == "\r" else line)
    if with_message:
        out[-1][4] = "\n".join(body)
    return [tuple(x) for x in out]


def parse_logs(df: DataFrame, id_col: str = "delivery_id", fields: tuple[str, ...] = ("raw_stderr_tail", "stack_trace", "message"),
               ref_col: str = "detected_at", with_message: bool = True) -> DataFrame:
    """One row an entry: id, field, first_line, ts, level, component and, unless left out, the whole message.

    Each text is read where it lies: no shuffle, no state between rows, memory bounded by an Arrow batch.
    """
    src = df.select(F.col(id_col).alias("id"), F.unix_micros(F.col(ref_col).cast("timestamp")).alias("ref"), *[F.col(c).alias(f"f{i}") for i, c in enumerate(fields)])
    names = ["id", "field", "first_line", "ts", "level", "component"] + ["text"] * with_message
    kind = dict(df.dtypes)[id_col]
    schema = f"id {kind}, field string, first_line int, ts string, level string, component string" + ", text string" * with_message

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, refs = b.column(0), [None if v is None else EPOCH + timedelta(microseconds=v) for v in b.column(1).to_pylist()]
            cols = [b.column(2 + i).to_pylist() for i in range(len(fields))]
            at: list[int] = []
            field: list[str] = []
            rows: list[tuple] = []
            for r, ref in enumerate(refs):
                done: dict[str, list] = {}
                for i, name in enumerate(fields):
                    t = cols[i][r]
                    if not t:
                        continue
                    if (got := done.get(t)) is None:
                        got = done[t] = entries(t, ref, with_message)
                    rows += got
                    at += [r] * len(got)
                    field += [name] * len(got)
            if rows:
                line, ts, lv, comp, msg = zip(*rows)
                arrays = [ids.take(pa.array(at, pa.int32())), pa.array(field), pa.array(line, pa.int32()), pa.array(ts), pa.array(lv), pa.array(comp)]
                yield pa.RecordBatch.from_arrays(arrays + [pa.array(msg)] * with_message, names=names)

    return src.mapInArrow(run, schema).withColumnRenamed("id", id_col)
