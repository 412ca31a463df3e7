"""Configuration formats as settings: the key path of every value, with the offsets of the value in the original text.

Three parsers cover JSON (and TOML's or YAML's inline braces), YAML and the INI family (environment files, properties,
TOML). They are tolerant: a text may be a piece of a file, so parents that stand before its start are unknown, a
bracket closed but never opened is passed over, and what is no setting is left to others. A mapping that names what
its value is (`name: X` beside `value: Y`) counts as the setting X as well.

Defined results: an empty text has no settings; a value cut off by the end of the text goes as far as the text does;
a key without a value gives none; equal keys each give their own; every scan is linear in the text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

FORMS = {"json": "json", "jsonc": "json", "json5": "json", "ipynb": "json", "yaml": "yaml", "yml": "yaml", "ini": "ini", "cfg": "ini", "conf": "ini", "cnf": "ini", "toml": "ini", "properties": "ini", "env": "ini"}
#: Keys that name a setting in a mapping of its own, and those that hold what is named.
NAMING, HOLDING = frozenset(("name", "key", "id", "variable", "param", "option", "field")), frozenset(("value", "val"))


class Setting(NamedTuple):
    path: tuple[str, ...]
    start: int
    end: int
    quoted: bool


TOKEN = re.compile(r"""(?P<s>"(?:[^"\\\n]|\\.)*(?:"|(?=\n)|\Z)|'(?:[^'\\\n]|\\.)*(?:'|(?=\n)|\Z))|(?P<p>[{}\[\],])|(?P<c>[:=](?=[\s"'{\[]|$)|(?<=["']):)|(?P<x>//[^\n]*|\#[^\n]*|/\*.*?(?:\*/|\Z))|(?P<b>[^\s{}\[\],"':=]+(?:[:=](?![\s"'{\[])[^\s{}\[\],"':=]*)*)|(?P<n>\s+)|(?P<o>.)""", re.S | re.M)


def braces(text: str, lo: int = 0, hi: int | None = None, parents: tuple[str, ...] = ()) -> Iterator[Setting]:
    """Settings of JSON and of inline mappings and lists."""
    hi = len(text) if hi is None else hi
    stack: list[tuple[str | None, dict]] = []  # key of each open bracket, and what its mapping names and holds
    here: dict = {}
    key, last = None, None  # the key whose value comes next, the last scalar
    for m in TOKEN.finditer(text, lo, hi):
        kind, (a, b) = m.lastgroup, m.span()
        if kind in ("s", "b"):
            if last is not None and kind == last[3]:
                yield from _value(parents, stack, key, last, here, text)
            quoted = kind == "s"
            last = (a + quoted, b - (quoted and b - a > 1 and text[b - 1] == text[a]), quoted, kind)
        elif kind == "c":
            if last is not None:
                key, last = text[last[0]:last[1]], None
        elif kind == "p":
            if last is not None:
                yield from _value(parents, stack, key, last, here, text)
                last = None
            c = m.group()
            if c in "{[":
                stack.append((key, here))
                here, key = {}, None
            elif c in "}]":
                yield from _named(parents, stack, here)
                if stack:
                    key, here = stack.pop()
                key = None
            elif not (stack and here.get("list")):
                key = None
    if last is not None:
        yield from _value(parents, stack, key, last, here, text)
    yield from _named(parents, stack, here)


def _path(parents: tuple[str, ...], stack: list) -> tuple[str, ...]:
    return parents + tuple(k for k, _ in stack if k is not None)


def _value(parents: tuple[str, ...], stack: list, key: str | None, last: tuple, here: dict, text: str) -> Iterator[Setting]:
    a, b, quoted, _ = last
    if key is not None:
        _note(here, key, text[a:b], a, b, quoted)
    yield Setting(_path(parents, stack) + ((key,) if key is not None else ()), a, b, quoted)


def _note(here: dict, key: str, value: str, a: int, b: int, quoted: bool) -> None:
    low = key.lower()
    if low in NAMING:
        here.setdefault("name", value)
    elif low in HOLDING:
        here.setdefault("value", (a, b, quoted))


def _named(parents: tuple[str, ...], stack: list, here: dict) -> Iterator[Setting]:
    if "name" in here and "value" in here:
        yield Setting(_path(parents, stack) + (here["name"],), *here["value"])


LINE = re.compile(r"""(?P<ind>[ \t]*)(?P<dash>(?:-[ \t]+)*)(?:(?:"(?P<dk>(?:[^"\\\n]|\\.)*)"|'(?P<sk>[^'\n]*)'|(?P<k>[^\s#:\[\]{},"'&*!|>%@`-](?:[^:#\n"']*[^\s:#\n"'])?|-[^\s:#\n]+))[ \t]*:(?=[ \t\r\n]|\Z)[ \t]*)?""")
BLOCK = re.compile(r"[|>][+\-0-9]*[ \t]*(?:#[^\n]*)?\r?(?:\n|\Z)")
QUOTED = re.compile(r""""(?P<dq>(?:[^"\\\n]|\\.)*)(?:"|(?=\n)|\Z)|'(?P<sq>(?:[^'\n]|'')*)(?:'|(?=\n)|\Z)""")
YAML_NOTE, INI_NOTE = re.compile(r"(?<=[ \t])#"), re.compile(r"(?<=[ \t])[#;]")


def _plain(text: str, start: int, end: int, note: re.Pattern) -> tuple[int, int]:
    """A bare value to the end of its line or to a note."""
    m = note.search(text, start, end)
    stop = m.start() if m else end
    return start, start + len(text[start:stop].rstrip())


def _closers(text: str) -> dict[int, int]:
    """Where each opening bracket's partner ends, whatever their kinds."""
    out, stack = {}, []
    for m in re.finditer(r"[{}\[\]]", text):
        if m.group() in "{[":
            stack.append(m.start())
        elif stack:
            out[stack.pop()] = m.end()
    return out


def yaml(text: str) -> Iterator[Setting]:
    """Settings of YAML by the indents of its lines."""
    stack: list[tuple[int, str, dict]] = []  # indent, key, the mapping the key stands in
    at, n = 0, len(text)
    waiting = False  # the last key had no value on its line
    maps: dict[int, dict] = {}
    closers: dict[int, int] | None = None
    while at < n:
        end = text.find("\n", at)
        end = n if end < 0 else end
        m = LINE.match(text, at, end)
        start, indent = m.end(), len(m.group("ind")) + len(m.group("dash"))
        key = next((g for g in (m.group("dk"), m.group("sk"), m.group("k")) if g is not None), None)
        body = text[start:end].strip()
        body = "" if body.startswith("#") and key is not None else body
        if key is None and (not body or body.startswith(("#", "---", "..."))):
            at = end + 1
            continue
        while stack and stack[-1][0] >= (indent if key is not None or m.group("dash") else len(m.group("ind"))) and not (key is None and m.group("dash") and stack[-1][0] <= len(m.group("ind"))):
            stack.pop()
        if m.group("dash") or not stack:
            closed = [d for i, d in maps.items() if i >= indent]
        else:
            closed = [d for i, d in maps.items() if i > indent]
        for d in closed:
            if "name" in d and "value" in d:
                yield Setting(d["path"] + (d["name"],), *d["value"])
        maps = {i: d for i, d in maps.items() if i < indent or i == indent and not m.group("dash") and stack}
        path = tuple(k for _, k, _ in stack)
        if key is not None:
            here = maps.setdefault(indent, {"path": path})
            path += (key,)
        waits, waiting = waiting, False
        b = BLOCK.match(text, start)
        if key is not None and not body:
            stack.append((indent, key, here))
            waiting = True
        elif b and (key is not None or m.group("dash")):
            at, lines = b.end(), []
            depth = indent if key is not None else len(m.group("ind"))
            while at < n:
                end = text.find("\n", at)
                end = n if end < 0 else end
                line = text[at:end]
                if line.strip() and len(line) - len(line.lstrip(" \t")) <= depth:
                    break
                if line.strip():
                    lines.append((at + len(line) - len(line.lstrip()), at + len(line.rstrip())))
                at = end + 1
            if len(lines) == 1:
                yield Setting(path, *lines[0], True)
            continue
        elif text[start:start + 1] in "{[" and body:
            closers = _closers(text) if closers is None else closers
            stop = max(end, closers.get(start, end))
            yield from braces(text, start, stop, path)
            end = text.find("\n", stop)
            end = n if end < 0 else end
        elif key is not None or m.group("dash") or waits:
            q = QUOTED.match(text, start, end)
            if q:
                a, z, quoted = *q.span(q.lastgroup), True
            else:
                a, z, quoted = *_plain(text, start, end, YAML_NOTE), False
            if z > a:
                if key is not None:
                    _note(here, key, text[a:z], a, z, quoted)
                yield Setting(path, a, z, quoted)
        at = end + 1
    for d in maps.values():
        if "name" in d and "value" in d:
            yield Setting(d["path"] + (d["name"],), *d["value"])


PAIR = re.compile(r"""[ \t]*(?:(?:export|set|setx|env)[ \t]+)?(?:"(?P<q>[\w.\-/ ]+)"|(?P<k>[A-Za-z_][\w.\-/]*(?:\[\w*\])?))[ \t]*(?:\+?=|:(?=[ \t]))[ \t]*""")
SECTION = re.compile(r"[ \t]*\[\[?([^\]\n]+)\]\]?[ \t]*(?:[#;][^\n]*)?\r?$", re.M)


def ini(text: str) -> Iterator[Setting]:
    """Settings of sections with key = value lines; a dotted section or key is a path."""
    section: tuple[str, ...] = ()
    at, n = 0, len(text)
    while at < n:
        end = text.find("\n", at)
        end = n if end < 0 else end
        if s := SECTION.match(text, at, end):
            section = tuple(s.group(1).strip(" \t\"'").split("."))
        elif m := PAIR.match(text, at, end):
            path, start = section + tuple((m.group("q") or m.group("k")).split(".")), m.end()
            if text[start:start + 1] in ("{", "[") and start < end:
                yield from braces(text, start, end, path)
            elif q := QUOTED.match(text, start, end):
                yield Setting(path, *q.span(q.lastgroup), True)
            elif start < end:
                a, z = _plain(text, start, end, INI_NOTE)
                if z > a:
                    yield Setting(path, a, z, False)
        at = end + 1


NO_COLON = re.compile(r"^[ \t]*(?:[#;\[{\]}\-]|$)")
YAML_LINE, INI_LINE = re.compile(r"^[ \t]*(?:- +)*[\w.\-/]+:(?:[ \t]|\r?$)"), re.compile(r"^[ \t]*(?:\[[^\]]+\]\s*$|(?:export )?[A-Za-z_][\w.\-]*[ \t]*=)")


def form_of(text: str, path: str | None = None) -> str | None:
    """The format of a text, by its path's ending, else by its shape: json, yaml, ini, or None for code and prose."""
    if path is not None:
        name = path.rpartition("/")[2].lower()
        if name.startswith(".env") or ".env." in name:
            return "ini"
        return FORMS.get(name.rpartition(".")[2]) if "." in name else None
    head = text.lstrip()[:1]
    if head and head in "{[" and re.match(r"\s*[{\[]\s*(?:[{\[\"]|$)", text):
        return "json"
    rows = [s for s in text.split("\n") if not NO_COLON.match(s)]
    for form, line in (("yaml", YAML_LINE), ("ini", INI_LINE)):
        if rows and sum(bool(line.match(s)) for s in rows) >= 0.9 * len(rows):
            return form
    return None


PARSERS = {"json": braces, "yaml": yaml, "ini": ini}


def settings(text: str, form: str) -> Iterator[Setting]:
    return PARSERS[form](text)
