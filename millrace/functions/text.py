"""Text functions as column expressions: redaction, chunking, tokens, references, line handling.

All of them are built from Spark's own functions and stay in the JVM. Lengths count code points.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

CHUNK_SIZE, CHUNK_OVERLAP = 1200, 200

# The redaction rules, in order, as (pattern, replacement).
REDACTION_RULES = (
    (r"sk-ant-api0[0-9]-[A-Za-z0-9_\-]{10,}", "[REDACTED_ANTHROPIC_KEY]"),
    (r"sk-[A-Za-z0-9]{20,}", "[REDACTED_OPENAI_KEY]"),
    (r"sk_live_[A-Za-z0-9]{10,}", "[REDACTED_STRIPE_LIVE_KEY]"),
    (r"sk_test_[A-Za-z0-9]{10,}", "[REDACTED_STRIPE_TEST_KEY]"),
    (r"whsec_[A-Za-z0-9]{10,}", "[REDACTED_STRIPE_WEBHOOK]"),
    (r"pk_(live|test)_[A-Za-z0-9]{10,}", "[REDACTED_STRIPE_PK]"),
    (r"AKIA[0-9A-Z]{16}", "[REDACTED_AWS_KEY_ID]"),
    (r"(?i)(aws_secret_access_key|aws_secret_key)\s*[=:]\s*['\"]?[A-Za-z0-9/+=]{40}['\"]?", "$1=[REDACTED_AWS_SECRET]"),
    (r"(?i)(password|passwd|secret|api_key|token|auth_key)\s*[=:]\s*['\"]?(?!REPLACE|CHANGE_ME|YOUR_|EXAMPLE|PLACEHOLDER|<)[A-Za-z0-9!@#$%^&*()_\-+=]{8,}['\"]?", "$1=[REDACTED_SECRET]"),
    (r"\b[a-z]{4}-[a-z]{4}-[a-z]{4}-[a-z]{4}\b", "[REDACTED_APP_PASSWORD]"),
)
# Files that hold nothing but secrets, documents of the first rank, indexable extensions.
SECRET_FILES = (".env", ".env.local", ".env.production", ".env.staging")
DOC_NAMES = ("README.md", "CONTRIBUTING.md", "AGENTS.md", "TOOLS.md")
INDEXABLE = (".py", ".sh", ".sql", ".md", ".json", ".yaml", ".yml", ".txt", ".php", ".js", ".ts", ".tsx", ".jsx", ".html", ".css", ".env.example")
SQL_TREE, DOC_DEPTH, MAX_FILE_BYTES = "SQL-SCRIPTS", 2, 512_000
# Heading and definition boundaries, statement ends.
HEADING, DEFINITION, STATEMENT_END = r"^#{1,3} ", r"^(?:def |class |function )", r";\s*\n"
# References to files and environment keys in prose.
FILE_REF = r"`([^`]+\.(?:py|sh|sql|php|js|ts|yml|yaml|json|md))`|(?:^|\s)([\w./-]+\.(?:py|sh|sql|php|js|ts|yml|yaml))\b"
ENV_KEY = r"\b([A-Z][A-Z0-9_]{2,})\b"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """An expression over a value that is computed once, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def redact(c: Column | str) -> Column:
    """The text after every rule, in their order."""
    out = _col(c)
    for pattern, replacement in REDACTION_RULES:
        out = F.regexp_replace(out, F.lit(pattern), F.lit(replacement))
    return out


def is_secret_file(path: Column | str) -> Column:
    """Whether a file must never be indexed; placeholder files, named as examples, may."""
    name = F.substring_index(_col(path), "/", -1)
    return ~(name.endswith(".example") | name.endswith(".example.env")) & (name.isin(*SECRET_FILES) | name.rlike(r"\.env\.[^.]+$"))


def tokens(c: Column | str) -> Column:
    """Lower-case words between white space."""
    return F.filter(F.split(F.lower(_col(c)), r"(?U)\s+"), lambda x: x != "")


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def char_chunks(c: Column | str, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> Column:
    """Windows of `size` that step by `size - overlap`; a short text is one chunk, an empty one an empty chunk."""
    c, step = _col(c), size - overlap
    last = F.greatest(F.lit(0), F.ceil((F.length(c) - size) / F.lit(float(step))).cast("int"))
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(c, i * step + 1, F.lit(size)))


def split_before(c: Column | str, pattern: str) -> Column:
    """Blocks that begin where the pattern matches at a line's start, stripped, blank ones left out."""
    return F.filter(F.transform(F.split(_col(c), f"(?md)(?={pattern})", -1), strip), lambda x: x != "")


def pack(pieces: Column, size: int = CHUNK_SIZE) -> Column:
    """Greedy packing of an array of texts into texts joined by line feeds; what is too large alone stays whole."""
    zero = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("buf"))

    def step(acc: Column, x: Column) -> Column:
        full = (F.length(acc.buf) + F.length(x) > size) & (acc.buf != "")
        return F.struct(F.when(full, F.concat(acc.done, F.array(acc.buf))).otherwise(acc.done).alias("done"),
                        F.when(full | (acc.buf == ""), x).otherwise(F.concat(acc.buf, F.lit("\n"), x)).alias("buf"))

    return F.aggregate(pieces, zero, step, lambda acc: F.when(acc.buf != "", F.concat(acc.done, F.array(acc.buf))).otherwise(acc.done))


def statements(c: Column | str) -> Column:
    return F.filter(F.transform(F.split(_col(c), STATEMENT_END, -1), strip), lambda x: x != "")


def file_kind(path: Column | str) -> Column:
    """readme, doc or code, by name and depth."""
    p = _col(path)
    name = F.substring_index(p, "/", -1)
    readme = F.upper(name) == "README.MD"
    primary = (readme | name.isin(*DOC_NAMES)) & (F.split(p, "/")[0] != SQL_TREE) & (F.size(F.split(p, "/")) <= DOC_DEPTH)
    return F.when(primary & readme, "readme").when(primary, "doc").otherwise("code")


def suffix(path: Column | str) -> Column:
    return F.lower(F.regexp_extract(F.substring_index(_col(path), "/", -1), r"(?<=.)(\.[^.]+)$", 1))


def chunks(path: Column | str, text: Column | str, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> Column:
    """array<struct<text, symbol_hint>>: a file's chunks by its suffix, in order."""
    p, t, end, kind = _col(path), _col(text), suffix(path), file_kind(path)
    label = F.when(kind == "readme", "README").otherwise(F.substring_index(p, "/", -1))
    prefix = F.when(kind == "code", "").otherwise(F.concat(F.lit("[Repo: "), F.split(p, "/")[0], F.lit(" | "), label, F.lit("]\n")))
    none = F.lit(None).cast("string")

    def cut(block: Column, hint: Column, head: Column) -> Column:
        return F.transform(char_chunks(block, size, overlap), lambda x: F.struct(F.concat(head, x).alias("text"), hint.alias("symbol_hint")))

    sections, blocks, parts = split_before(t, HEADING), split_before(t, DEFINITION), statements(t)

    def section(s: Column, i: Column) -> Column:
        hint = F.substring(strip(F.regexp_extract(s, r"(?md)^#{1,3}\s+(.+)$", 1)), 1, 80)
        return cut(s, F.when(hint != "", hint).otherwise(F.concat(F.lit("section_"), i.cast("string"))), prefix)

    plain = F.transform(char_chunks(t, size, overlap), lambda x, i: F.struct(F.when(i == 0, F.concat(prefix, x)).otherwise(x).alias("text"), none.alias("symbol_hint")))
    return (F.when((end == ".md") & (F.size(sections) > 1), F.flatten(F.transform(sections, section)))
            .when(end.isin(".py", ".sh") & (F.size(blocks) > 1), F.flatten(F.transform(blocks, lambda b: cut(b, F.regexp_extract(b, r"(?md)^(?:def|class)\s+(\w+)", 1), F.lit("")))))
            .when((end == ".sql") & (F.size(parts) > 1), F.transform(pack(parts, size), lambda x: F.struct(x.alias("text"), none.alias("symbol_hint"))))
            .otherwise(plain))


def chunk_id(collection: Column, path: Column, index: Column) -> Column:
    return F.substring(F.sha2(F.concat(collection, F.lit(":"), path, F.lit(":"), index.cast("string")), 256), 1, 32)


def path_key(repo: Column, path: Column) -> Column:
    """`path` if `repo` is null, empty or already its head, else `repo/path`."""
    return F.when(F.coalesce(repo, F.lit("")) == "", path).when(path.startswith(F.concat(repo, F.lit("/"))), path).otherwise(F.concat(repo, F.lit("/"), path))


def path_refs(c: Column | str) -> Column:
    """File names mentioned in a text, first-seen order, leading dots and slashes off."""
    a = F.regexp_extract_all(_col(c), F.lit(f"(?md){FILE_REF}"), F.lit(1))
    b = F.regexp_extract_all(_col(c), F.lit(f"(?md){FILE_REF}"), F.lit(2))
    both = F.zip_with(a, b, lambda x, y: F.trim(F.when(x != "", x).otherwise(y)))
    return F.array_distinct(F.transform(F.filter(both, lambda x: (x != "") & ~x.startswith("http")), lambda x: F.ltrim(x, F.lit("./"))))


def env_keys(c: Column | str) -> Column:
    return F.array_distinct(F.regexp_extract_all(_col(c), F.lit(f"(?U){ENV_KEY}"), F.lit(1)))


def slug(c: Column | str, most: int = 50) -> Column:
    s = F.regexp_replace(F.regexp_replace(F.substring(F.lower(_col(c)), 1, most), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(s == "", "task").otherwise(s)


def lines(c: Column | str) -> Column:
    """Lines without their ends; a final line end opens no further line."""
    s = F.split(F.regexp_replace(_col(c), r"\r\n?|\n", "\n"), "\n", -1)
    return F.when(F.element_at(s, -1) == "", F.slice(s, 1, F.greatest(F.size(s) - 1, F.lit(0)))).otherwise(s)


def number_lines(c: Column | str) -> Column:
    """Each line behind its number of four digits or more."""
    return F.array_join(F.transform(lines(c), lambda x, i: F.concat(line_no(i + 1), F.lit("| "), x)), "\n")


def line_no(n: Column) -> Column:
    s = n.cast("string")
    return F.concat(F.repeat(F.lit("0"), F.greatest(F.lit(0), 4 - F.length(s))), s)


def excerpt(c: Column | str, most: int, centre: Column | None = None) -> Column:
    """A text within about `most` code points, lines numbered: whole if it fits, else around a line, else head and tail."""
    return let(lines(_col(c)), lambda ls: _excerpt(_col(c), ls, most, centre))


def _excerpt(t: Column, ls: Column, most: int, centre: Column | None) -> Column:
    n = F.size(ls)
    half, edge = max(20, most // 80), max(most // 2 // 80, 1)

    def part(first: Column, last: Column) -> Column:
        return F.transform(F.slice(ls, first, F.greatest(last - first + 1, F.lit(0))), lambda x, i: F.concat(line_no(i + first), F.lit("| "), x))

    tail = F.when(n > most // 2 // 80, F.least(F.lit(edge), n)).otherwise(0)
    omitted = n - F.least(F.lit(edge), n) - tail
    ends = F.concat(part(F.lit(1), F.least(F.lit(edge), n)), F.when(omitted > 0, F.concat(F.array(F.concat(F.lit("... ["), omitted.cast("string"), F.lit(" lines truncated] ..."))), part(n - tail + 1, n)))
                    .otherwise(F.array().cast("array<string>")))
    whole = F.when(F.length(t) <= most, F.array_join(part(F.lit(1), n), "\n")).when(n == 0, "").otherwise(F.array_join(ends, "\n"))
    if centre is None:
        return whole
    a, b = F.greatest(F.lit(1), centre - half), F.least(n, centre + half)
    head = F.when(a > 1, F.concat(F.lit("... [lines 1-"), (a - 1).cast("string"), F.lit(" truncated] ...\n"))).otherwise("")
    foot = F.when(b < n, F.concat(F.lit("\n... [lines "), (b + 1).cast("string"), F.lit("-"), n.cast("string"), F.lit(" truncated] ..."))).otherwise("")
    around = F.concat(head, F.array_join(part(a, b), "\n"), foot)
    return F.when((F.length(t) > most) & centre.between(1, n), around).otherwise(whole)


def truncate(c: Column | str, most: int = 4000) -> Column:
    c = _col(c)
    return F.when(F.length(c) <= most, c).otherwise(F.concat(F.substring(c, 1, most - 20), F.lit("\n...(truncated)")))


def number_of(c: Column | str) -> Column:
    """A number out of a text such as '1,234 rows': all but digits, points and signs dropped; null if none is left."""
    return F.regexp_replace(_col(c), r"[^\d.-]", "").try_cast("double")


def quoted(needle: str) -> str:
    """A literal as a regular expression."""
    return "\\Q" + needle.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def bulk_append(c: Column | str, needle: str, append: str, marker: str) -> Column:
    """Appends after each needle unless the marker stands within the look-ahead window of the original text."""
    parts = F.split(_col(c), quoted(needle), -1)
    window = len(needle) + max(2 * len(append), 160)

    def piece(p: Column, i: Column) -> Column:
        rest = F.concat(F.lit(needle), F.array_join(F.slice(parts, i + 2, F.greatest(F.size(parts) - i - 1, F.lit(0))), needle))
        marked = F.substring(rest, 1, window).contains(marker) if marker else F.lit(False)
        return F.when(i == F.size(parts) - 1, p).when(marked, F.concat(p, F.lit(needle))).otherwise(F.concat(p, F.lit(needle + append)))

    return F.array_join(F.transform(parts, piece), "")


def replace_lines(c: Column | str, old: str) -> Column:
    """Line numbers of every occurrence that a bulk replace changes; one that spans lines counts where it begins."""
    if "\n" not in old:
        found = F.transform(F.split(_col(c), "\n", -1), lambda x, i: F.array_repeat(i + 1, occurrences(x, F.lit(old))))
        return F.flatten(found)
    parts = F.split(_col(c), quoted(old), -1)
    feeds = F.transform(parts, lambda p: F.length(p) - F.length(F.replace(p, F.lit("\n"), F.lit(""))))
    found = F.transform(F.slice(feeds, 1, F.size(feeds) - 1), lambda x, i: F.aggregate(F.slice(feeds, 1, i + 1), F.lit(1), lambda a, y: a + y) + i * old.count("\n"))
    return F.when(F.size(parts) > 1, found).otherwise(F.array().cast("array<int>"))


def occurrences(c: Column | str, old: Column) -> Column:
    c = _col(c)
    return F.when(F.length(old) > 0, ((F.length(c) - F.length(F.replace(c, old, F.lit("")))) / F.length(old)).cast("int")).otherwise(0)


# --- reading prose about code ------------------------------------------------------------------------------------------

# File names in prose, headers of retrieved passages, line mentions, identifiers and words that are none.
PROSE_PATH = r"(?i)(?:^|[\s`'\"(])([\w./-]+\.(?:py|sh|php|html|htm|css|sql|yaml|yml|json|md|txt|js|ts))(?:[\s`'\",):]|$)"
PASSAGE_HEADER = r"(?md)^###\s+\[[^\]]+\]\s+(?:[\w-]+/)?(.+?)\s+\(chunk"
LINE_MENTION = r"(?i)line\s+(\d+)"
IDENTIFIER = r"(?iU)\b([a-z_][a-z0-9_]{2,})\b"
NO_TABLES = ("select", "from", "where", "update", "insert", "delete", "table", "schema", "database", "mysql", "the", "and", "for", "with", "into", "join", "left", "right", "inner", "outer", "group", "order", "limit", "fix", "error", "file", "line",
             "python", "script")
DATABASE_WORDS = ("sql", "schema", "mysql", "table", "column", "database", "writer", "work", "ipi")
DRIFT_WORDS = ("config", "env", "readme", "mismatch", "inconsistent")


def relative_path(path: Column, repo: Column) -> Column:
    """A path as written in prose made relative to its repository; null if it is absolute, an address or climbs out."""
    p = F.regexp_replace(F.trim(path), "^[`\"']+|[`\"']+$", "")
    p = F.when(F.lower(F.substring(p, 1, 6)) == "repos/", F.substring(p, F.lit(7), F.length(p))).otherwise(p)
    inside = F.when((F.coalesce(repo, F.lit("")) != "") & p.startswith(F.concat(repo, F.lit("/"))), F.substring(p, F.length(repo) + 2, F.length(p))).otherwise(p)
    return F.when((p != "") & ~p.startswith("http") & ~inside.startswith("/") & ~F.array_contains(F.split(inside, "/"), "..") & (inside != ""), inside)


def discover_paths(changed: Column, plan: Column, request: Column, passages: Column, repo: Column) -> Column:
    """Paths named by a change list, a plan, a request and retrieved passages, each once, in that order."""
    found = lambda c, pattern: F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(pattern), F.lit(1))
    every = F.concat(F.coalesce(changed, F.array().cast("array<string>")), found(plan, PROSE_PATH), found(request, PROSE_PATH), found(passages, PASSAGE_HEADER))
    return F.array_distinct(F.filter(F.transform(every, lambda p: relative_path(p, repo)), lambda p: p.isNotNull()))


def line_mention(path: Column, *texts: Column) -> Column:
    """The first line number in the first text that names the path."""
    return F.coalesce(*[F.when(t.contains(path), F.regexp_extract(t, LINE_MENTION, 1).try_cast("int")) for t in texts])


def table_candidates(c: Column | str, most: int = 5) -> Column:
    """Identifiers that may be tables, lower case, first-seen order."""
    names = F.transform(F.regexp_extract_all(_col(c), F.lit(IDENTIFIER), F.lit(1)), lambda x: F.lower(x))
    return F.slice(F.array_except(F.array_distinct(names), F.array(*map(F.lit, NO_TABLES))), 1, most)


def needs_schema(c: Column | str) -> Column:
    """Whether a request speaks of a database."""
    low = F.lower(_col(c))
    return F.exists(F.array(*map(F.lit, DATABASE_WORDS)), lambda w: low.contains(w))


def speaks_of_drift(c: Column | str) -> Column:
    low = F.lower(_col(c))
    return F.exists(F.array(*map(F.lit, DRIFT_WORDS)), lambda w: low.contains(w))


def diff_counts(c: Column | str) -> Column:
    """struct<insertions, deletions> out of a summary of a diff."""
    n = lambda w: F.coalesce(F.regexp_extract(_col(c), rf"(\d+) {w}", 1).try_cast("int"), F.lit(0))
    return F.struct(n("insertion").alias("insertions"), n("deletion").alias("deletions"))


def has_conflict(c: Column | str) -> Column:
    c = _col(c)
    return c.contains("<<<<<<<") | c.contains("=======") & c.contains(">>>>>>>")
