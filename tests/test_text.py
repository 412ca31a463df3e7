import random
import re

import pytest
from pyspark.sql import functions as F

from millrace.functions import text as T

WORDS = ["a", "bb", "ccc", "é", "日本", "\n", "\n\n", " ", "## ", "# x", "def f", "class C", ";\n", ";", "x" * 40]


def texts(n, seed, most=120):
    rng = random.Random(seed)
    return ["".join(rng.choice(WORDS) + rng.choice(["", " ", "\n"]) for _ in range(rng.randrange(most))) for _ in range(n)] + ["", " ", "\n", "x" * 25, "x" * 26]


def frame(spark, rows):
    return spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i int, t string")


def run(spark, rows, column):
    return [r[0] for r in frame(spark, rows).select("i", column.alias("v")).orderBy("i").select("v").collect()]


def model_windows(t, size, overlap):
    out, a = [], 0
    while True:
        out.append(t[a:a + size])
        if a + size >= len(t):
            return out
        a += size - overlap


@pytest.mark.parametrize("size, overlap", [(25, 5), (10, 0), (7, 6)])
def test_char_chunks(spark, size, overlap):
    rows = texts(60, 1)
    assert run(spark, rows, T.char_chunks("t", size, overlap)) == [model_windows(t, size, overlap) for t in rows]


@pytest.mark.parametrize("pattern", [T.HEADING, T.DEFINITION])
def test_split_before(spark, pattern):
    rows = texts(80, 2)
    want = [[p.strip() for p in re.split(f"(?m)(?={pattern})", t) if p.strip()] for t in rows]
    assert run(spark, rows, T.split_before("t", pattern)) == want


def model_pack(t, size):
    out, buf = [], ""
    for s in (x.strip() for x in re.split(r";\s*\n", t)):
        if not s:
            continue
        if buf and len(buf) + len(s) > size:
            out.append(buf)
            buf = s
        else:
            buf = f"{buf}\n{s}" if buf else s
    return out + [buf] * bool(buf)


def test_pack(spark):
    rows = texts(80, 3)
    assert run(spark, rows, T.pack(T.statements("t"), 60)) == [model_pack(t, 60) for t in rows]


def test_files_by_suffix(spark):
    def of(path, t):
        return [tuple(x) for x in run(spark, [t], T.chunks(F.lit(path), F.col("t")))[0]]
    assert of("R/README.md", "intro\n# One\nx\n## Two\ny") == [("[Repo: R | README]\nintro", "section_0"), ("[Repo: R | README]\n# One\nx", "One"), ("[Repo: R | README]\n## Two\ny", "Two")]
    assert of("R/a/b/README.md", "plain") == [("plain", None)]
    assert of("R/x.py", "import x\ndef f():\n  pass\nclass C:\n  pass") == [("import x", ""), ("def f():\n  pass", "f"), ("class C:\n  pass", "C")]
    assert of("R/x.sql", "select 1;\nselect 2;\n") == [("select 1\nselect 2", None)]
    assert [len(x) for x, _ in of("R/TOOLS.md", "z" * 2201)] == [1200 + len("[Repo: R | TOOLS.md]\n"), 1200, 201]


def test_redaction(spark):
    key = "a1" * 10
    pairs = [("k = sk-" + key, "k = [REDACTED_OPENAI_KEY]"), ("AKIA" + "A1" * 8, "[REDACTED_AWS_KEY_ID]"), ("password: hunter2hunter2", "password=[REDACTED_SECRET]"), ("password = 'YOUR_PASSWORD_1'", "password = 'YOUR_PASSWORD_1'"),
             ("token == abcdefgh1", "token == abcdefgh1"), ("abcd-efgh-ijkl-mnop", "[REDACTED_APP_PASSWORD]"), ("token: sk-" + key, "token: [REDACTED_OPENAI_KEY]"), ("", ""), ("API_KEY=\"abcdefgh\"", "API_KEY=[REDACTED_SECRET]")]
    got = run(spark, [a for a, _ in pairs], T.redact("t"))
    assert got[:4] == [b for _, b in pairs[:4]] and got[5:] == [b for _, b in pairs[5:]]
    assert run(spark, [".env", "a/.env.local", "x/.env.prod", ".env.example", "a/b.env"], T.is_secret_file("t")) == [True, True, True, False, False]


def model_append(t, needle, add, marker):
    out, at = [], 0
    while (i := t.find(needle, at)) >= 0:
        out.append(t[at:i] + needle)
        if not (marker and marker in t[i:i + len(needle) + max(2 * len(add), 160)]):
            out.append(add)
        at = i + len(needle)
    return "".join(out) + t[at:]


def test_edits(spark):
    rows = texts(60, 4) + ["a.b\\E c", "xaxaxa"]
    assert run(spark, rows, T.bulk_append("t", "ccc", "!!", "bb")) == [model_append(t, "ccc", "!!", "bb") for t in rows]
    want = [[t.count("\n", 0, m.start()) + 1 for m in re.finditer("bb", t)] for t in rows]
    assert run(spark, rows, T.replace_lines("t", "bb")) == want
    assert run(spark, rows, T.replace_lines("t", "\n\n")) == [[t.count("\n", 0, m.start()) + 1 for m in re.finditer("\n\n", t)] for t in rows]


def test_lines_and_excerpts(spark):
    assert run(spark, ["a\nb\n", "", "x\r\ny"], T.number_lines("t")) == ["0001| a\n0002| b", "", "0001| x\n0002| y"]
    long = "\n".join(f"line {i}" for i in range(1, 301))
    mid, ends = run(spark, [long], T.excerpt("t", 400, F.lit(100)))[0], run(spark, [long], T.excerpt("t", 400))[0]
    assert mid.startswith("... [lines 1-79 truncated] ...\n0080| line 80") and mid.endswith("0120| line 120\n... [lines 121-300 truncated] ...")
    assert ends.split("\n")[2] == "... [296 lines truncated] ..." and ends.endswith("0300| line 300")
    assert run(spark, ["abc", "z" * 5000], T.truncate("t", 100)) == ["abc", "z" * 80 + "\n...(truncated)"]


def test_small_functions(spark):
    assert run(spark, ["Fix the  Login!", "***"], T.slug("t")) == ["fix-the-login", "task"]
    assert run(spark, ["see `a/b.py` and ./run.sh, http://x.py `a/b.py`"], T.path_refs("t"))[0][:2] == ["a/b.py", "run.sh"]
    assert run(spark, ["1,234 rows", "none", "-5.5%"], T.number_of("t")) == [1234.0, None, -5.5]
    assert run(spark, ["A\u00a0b  C\n"], T.tokens("t")) == [["a", "b", "c"]]


def test_prose(spark):
    def one(c):
        return spark.range(1).select(c).first()[0]
    lit = F.lit
    got = one(T.discover_paths(F.array(lit("R/a/x.py"), lit("../no.py"), lit("/abs.py")), lit("edit `REPOS/R/b.sh`, see (c.sql)."), lit("http://h/d.py and x.md"), lit("### [repos] R/e.py (chunk 3)\ntext"), lit("R")))
    assert got == ["a/x.py", "b.sh", "c.sql", "x.md", "e.py"]
    assert one(T.line_mention(lit("a.py"), lit("none"), lit("a.py at Line 42, line 7"))) == 42 and one(T.line_mention(lit("a.py"), lit("a.py here"))) is None
    assert one(T.table_candidates(lit("Select the Orders from orders JOIN line_items on x"))) == ["orders", "line_items"]
    assert tuple(one(T.diff_counts(lit("3 files changed, 10 insertions(+), 2 deletions(-)")))) == (10, 2) and tuple(one(T.diff_counts(lit("")))) == (0, 0)
    assert one(T.has_conflict(lit("a\n=======\nb\n>>>>>>> x"))) and not one(T.has_conflict(lit("a ======= b")))
    assert one(T.needs_schema(lit("which Column?"))) and not one(T.speaks_of_drift(lit("nothing")))
