"""Generated, minified or vendored source files, and data stored as code.

Every distinct piece of a file is lexed into comments, strings, numbers, names and punctuation, and its code is emitted
again in a canonical layout: a line for each statement and brace, indented by depth, one space between words, long
lines wrapped. The original layout is held against it. A canonical layout many times longer than the original marks
minified text. Lines that all have the layout of their canonical line, of one shape, and whose first numbers count up,
are perfectly uniform and mark generated text. Literals that leave hardly any names mark data. What the comments that
lead a file say of the file itself (a generator's banner, a package's licence) and package directories in the path key
tell the rest: written by a program, a third party's copy.

A piece that is logged or stored several times is lexed and counted once, by its longest text, since some copies are cut
short. Measures of pieces are summed by file, so no group of pieces is ever gathered. Comments lead a file as long as no
piece before them, and nothing before them in their piece, is code.

Defined results: null and empty texts add nothing; a file without any text is judged by its path key; repeated
pieces change nothing; pieces without a number count as one piece of their own text each, and lead no file; rows whose
path is null are left out; documents and configuration are no cases unless a banner or the layout says that a program
wrote them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

WRAP = 120
#: Extensions whose text is documents or prose.
PROSE = ("md", "rst", "adoc", "markdown")
PLAIN = ("yaml", "yml", "env", "example", "ini", "cfg", "conf", "toml", "properties", "txt", "csv", "tsv")  # never minified, whatever its lines
CONFIG = ("yaml", "yml", "env", "example", "ini", "cfg", "conf", "toml", "properties", "json", "xml", "txt", "csv", "tsv", "html")

TOKEN = re.compile(
    r"""(?P<c>/\*[^*]*(?:\*(?!/)[^*]*)*(?:\*/|\Z)|<!--.*?(?:-->|\Z)|(?<![:\w'"])//[^\n]*|(?:(?<=\n)|(?<=\A))[ \t]*(?:\#(?!\{)|--)[^\n]*)"""
    r"""|(?P<s>"(?:[^"\\\n]|\\.)*(?:"|(?=\n)|\Z)|'(?:[^'\\\n]|\\.)*(?:'|(?=\n)|\Z)|`[^`]*(?:`|\Z))"""
    r"""|(?P<d>(?<![\w$])[-+]?(?:0x[0-9a-fA-F]+|\d[\d_]*(?:\.\d+)?(?:[eE][-+]?\d+)?))"""
    r"""|(?P<w>[^\W\d][\w$]*)|(?P<b>[;{}])|(?P<n>\n)|(?P<p>[^\s\w;{}'"`]+)""", re.S)
BLOB = re.compile(r"[A-Za-z0-9+/=]{80,}")
DIGITS = re.compile(r"\d+")
NAMES = re.compile(r"[^\W\d_]+")

#: Sentences by which a program says that it wrote the file. They speak of the file itself, so they begin with it, or with what
#: was done to it; a person's remark about such files has another subject.
_MADE = r"(?:auto(?:matically)?[- ]?|machine[- ]?)(?:generated|written|created|produced|made|built)"
_THIS = r"(?:(?:this|the|these) )?(?:(?:whole|entire|following) )?(?:file|code|document|source|module|script|class|contents?|stubs?|bindings?)(?: (?:file|code))?"
BANNER = re.compile(
    rf"(?i)(?:^|(?<=[.;:!,>]) +| [-|] )[^\w@]*(?:@generated\b|{_MADE}\b|{_THIS},? (?:(?:is|are|was|were|has been|have been) )?(?:{_MADE}|generated|(?:produced|created|built) (?:by|from|with|using) (?:the |a |an )?[\w./\- ]*\b(?:compiler|generator|build|tool|schema|template|program|machine|script)\b)"
    r"|generated (?:automatically|by|from|using|with|on|at)\b|(?:produced|created) from (?:the )?.{1,80}\b(?:schema|template|by)\b|do not (?:edit|change|modify)\b|please do not (?:edit|change|modify)\b"
    r"|(?:any |all |manual |local |hand |your )*(?:changes?|edits?|modifications?) (?:\w+ ){0,6}(?:are|is|be|get) (?:lost|overwritten)\b)")
LICENCE = re.compile(r"(?i)\bv?\d+\.\d+(?:\.\d+)?\b.{0,80}(?:\(c\)|©|copyright).{0,120}\blicen[cs]e|(?:\(c\)|©|copyright).{0,120}\breleased under\b|@license\b|\bSPDX-License-Identifier:|\bLicensed under the\b|Permission is hereby granted, free of charge")
PACKAGE_DIR = re.compile(r"(?i)(?:^|/)(?:node_modules|bower_components|jspm_packages|site-packages|dist-packages|vendor|vendored|_vendor|third[-_]?party|libraries|deps|godeps|pods)/[^/]+/.*[^/]$")
PACKAGE_TOP = re.compile(r"(?i)(?:^|/)(?:node_modules|bower_components|jspm_packages|site-packages|dist-packages)/")
VERSIONED = re.compile(r"(?i)/[a-z][a-z\-]*[a-z][-.]v?\d+\.\d+\.\d+[-.][^/]*$")
MADE_NAME = re.compile(r"(?i)\.(?:min|bundle|chunk)\.(?:js|css|mjs)$|\.(?:generated|autogen|gen)\.[a-z]+$|\.pb\.[a-z]+$|\.designer\.cs$|(?:^|/)(?:package-lock\.json|yarn\.lock|pnpm-lock\.yaml|poetry\.lock|composer\.lock|Pipfile\.lock|Cargo\.lock|go\.sum)$")
MADE_DIR = re.compile(r"(?i)(?:^|/)(?:generated|__generated__|autogen|gen|generated-sources)/")

SUMS = ("chars", "lines", "code_lines", "canonical", "names", "string_chars", "number_chars", "blob_chars", "comment_chars", "serial_lines")
FLAGS = ("code", "banner", "licence")  # whether the piece has code, and what its leading comments say
NOTE = re.compile(r'(?i)"(?:_comment|//|_|\$comment|comment|_note|generated|_generated)"\s*:\s*"([^"\n]*)')
#: What may stand before a file's leading comments.
PREAMBLE = re.compile(r"""<\?(?:php|xml[^>\n]*\?>)?|<!doctype[^>\n]*>|#![^\n]*|package\s+[\w.]+\s*;?|['"]use strict['"]\s*;?""", re.I)
STAR = re.compile(r"\*/")


def emit(tokens: list[tuple[str, str]]) -> list[str]:
    """The canonical layout of tokens (kind, text) without comments: indented by depth, a line for each statement and brace."""
    out: list[str] = []
    line, width, depth = "", 0, 0
    for kind, t in tokens:
        if kind == "n" or t == "}" or width and width + len(t) > WRAP:
            if line:
                out.append("  " * depth + line)
            line, width = "", 0
            if kind == "n":
                continue
            depth -= t == "}" and depth > 0
        if kind in "wd" and line and (line[-1].isalnum() or line[-1] in "_$"):
            line += " "
        line += t
        width += len(t)
        if kind == "b":
            out.append("  " * depth + line)
            line, width = "", 0
            depth += t == "{"
    return out + ["  " * depth + line] * bool(line)


def uniform(lines: list[str], layouts: list[str]) -> int:
    """Lines of perfect uniformity: of a layout that comes three times or more, with first numbers that count up."""
    seen: dict[str, list] = {}
    for s, layout in zip(lines, layouts):
        if not (n := DIGITS.search(s)):
            continue  # nothing to count by
        n = int(n.group()) if n.end() - n.start() < 12 else None
        x = seen.setdefault(layout, [0, 0, None])
        x[0] += 1
        x[1] += n is not None and x[2] is not None and n == x[2] + 1
        x[2] = n
    return sum(c for c, up, _ in seen.values() if c >= 3 and 2 * up >= c)


def measure(text: str, ext: str, first: bool = True) -> tuple[int, ...]:
    """The measures of one piece, in the order of SUMS and FLAGS. first: no piece before it, so no comment reaches into it."""
    begin = 0
    if not first and (m := STAR.search(text)) and text.find("/*", 0, m.start()) < 0:
        begin = m.end()  # the end of a comment that began in an earlier piece
    names = strings = numbers = 0
    comment, past, code = begin, begin, False
    if not first and (end := text.find("\n", begin) + 1) and NOTE_LINE.match(text, end):
        past = end  # the rest of a line among comments
    head: list[str] = []
    tokens: list[tuple[str, str]] = []
    layouts: list[list[str]] = [[]]  # by original line: its tokens' kinds with the spaces before them
    at = begin
    for m in TOKEN.finditer(text, begin):
        kind, t, start = m.lastgroup, m.group(), m.start()
        if kind == "n":
            tokens.append((kind, t))
            layouts.append([])
        elif kind == "c":
            comment += len(t)
            if not code:
                head.append(t)
            layouts += [[] for _ in range(t.count("\n"))]
        else:
            if not code and start >= past:
                p = PREAMBLE.match(text, start)
                code, past = p is None, p.end() if p else past
            tokens.append((kind, t))
            layouts[-1].append(" " * (start - at) + (NAMES.sub("a", DIGITS.sub("9", t)) if kind == "s" else SYMBOLS.get(kind, t)))
            if kind == "w":
                names += 1
            elif kind == "s":
                strings += len(t)
                layouts += [[] for _ in range(t.count("\n"))]
            elif kind == "d":
                numbers += len(t)
        at = m.end()
    rows = [(s, x) for s, x in zip(text[begin:].split("\n"), layouts) if s and not s.isspace()]
    bare = [(s, "".join(x)) for s, x in rows if not s.lstrip().startswith(NOTES)]
    if ext == "json":
        head += NOTE.findall(text)
    said = [s for h in head for s in h.split("\n")]
    return (len(text), len(rows), len(bare), len(emit(tokens)), names, strings, numbers, sum(m.end() - m.start() for m in BLOB.finditer(text)), comment,
            uniform([s for s, _ in bare], [x for _, x in bare]), int(code), int(any(map(BANNER.search, said))), int(any(map(LICENCE.search, said))))


SYMBOLS = {"w": "a", "d": "9"}
NOTES = ("#", "//", "--", "/*", "*", "<!--")
NOTE_LINE = re.compile(r"\s*(?:#|//|--|/\*|\*|<!--)")


def path_key(repo: Column, path: Column) -> Column:
    """`path` if `repo` is null or `path` already starts with it and a slash, else `repo/path`."""
    return F.when(repo.isNull() | path.startswith(F.concat(repo, F.lit("/"))), path).otherwise(F.concat(repo, F.lit("/"), path))


def measures(pieces: DataFrame) -> DataFrame:
    """Measures of pieces (path_key, chunk, text, listed) summed by file.

    Equal rows are dropped before lexing and copies that were cut short after it; of a hot file, partial aggregates leave
    each distinct piece once a task.
    """
    names = ["path_key", "chunk", "listed", *SUMS, *FLAGS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, chunks, texts = (b.column(i).to_pylist() for i in range(3))
            cols: list[list[int]] = [[] for _ in (*SUMS, *FLAGS)]
            for k, n, t in zip(keys, chunks, texts):
                for c, v in zip(cols, measure(t, k.rpartition(".")[2].lower(), n == 0) if t else (0,) * len(cols)):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(3), *[pa.array(c, pa.int64()) for c in cols]], names=names)

    src = pieces.where(F.col("path_key").isNotNull()).groupBy("path_key", F.col("chunk").cast("long").alias("chunk"), "text").agg(F.max("listed").alias("listed"))
    rows = src.mapInArrow(run, "path_key string, chunk long, listed int, " + ", ".join(f"{m} long" for m in (*SUMS, *FLAGS)))
    whole = rows.groupBy("path_key", "chunk", F.when(F.col("chunk").isNull(), F.monotonically_increasing_id()).alias("__own")).agg(
        F.max("listed").alias("listed"), F.max(F.struct(*SUMS, *FLAGS)).alias("m")).select("path_key", "chunk", "listed", "m.*")
    led = F.min(F.when(F.col("code") == 1, F.col("chunk")))
    first = {m: F.min(F.when(F.col(m) == 1, F.col("chunk"))) for m in FLAGS[1:]}
    files = whole.groupBy("path_key").agg(F.max("listed").alias("listed"), *[F.sum(m).alias(m) for m in SUMS], led.alias("__code"), *[e.alias(f"__{m}") for m, e in first.items()])
    return files.select("path_key", "listed", *SUMS, *[(F.col(f"__{m}").isNotNull() & (F.col(f"__{m}") <= F.coalesce("__code", f"__{m}"))).cast("int").alias(m) for m in first])


def judge(files: DataFrame) -> DataFrame:
    """Adds `kind`: vendored, minified, generated, data, or null for what a person wrote."""
    ext = F.lower(F.regexp_extract("path_key", r"\.([^./]+)$", 1))
    prose, config = ext.isin(*PROSE), ext.isin(*CONFIG)
    lines = F.greatest(F.col("lines"), F.lit(1))
    code = F.greatest(F.col("code_lines"), F.lit(1))
    java = lambda p: p.pattern
    vendored = F.col("path_key").rlike(java(PACKAGE_DIR)) | F.col("path_key").rlike(java(PACKAGE_TOP)) | (~prose & (F.col("path_key").rlike(java(VERSIONED)) | (F.col("licence") == 1)))
    minified = ~prose & ~ext.isin(*PLAIN) & ((F.col("canonical") / lines >= 6) & (F.col("chars") / lines >= 150))
    generated = F.col("path_key").rlike(java(MADE_NAME)) | F.col("path_key").rlike(java(MADE_DIR)) | (
        ~prose & ((F.col("banner") == 1) | ((F.col("serial_lines") / code >= 0.5) & (F.col("serial_lines") >= 5))))
    body = F.greatest(F.col("chars") - F.col("comment_chars"), F.lit(1))
    bare = (F.col("names") / code < 0.4) & (F.col("chars") >= 300)
    numbers, literals = F.col("number_chars") / body >= 0.5, (F.col("number_chars") + F.col("string_chars")) / body >= 0.58
    data = ~prose & F.when(config, bare & numbers).otherwise(bare & literals | (F.col("blob_chars") / F.greatest(F.col("chars"), F.lit(1)) >= 0.5))
    return files.withColumn("kind", F.when(vendored, "vendored").when(minified & ~data, "minified").when(generated, "generated").when(data, "data"))


def pieces_of(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """(path_key, chunk, text, listed) of all pieces of either table; listed is 1 for hits."""
    h = hits.select(path_key(F.col("repo"), F.col("path")).alias("path_key"), "chunk", "text", F.lit(1).alias("listed"))
    return h.unionByName(chunks.select(F.col("path").alias("path_key"), "chunk", "text", F.lit(0).alias("listed")))


def judged_files(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """Every file that occurs in hits with its measures and kind."""
    return judge(measures(pieces_of(hits, chunks)).where("listed = 1"))
