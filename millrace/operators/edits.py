"""Edits and scans over tables of files (path, content)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from millrace.functions import text as T

# The audit's rules as (name, pattern, file endings).
_TEXTS = (".yaml", ".yml", ".py", ".sh", ".md", ".txt")
_CODE = (".yaml", ".yml", ".py", ".sh", ".env", ".env.example", ".json", ".txt", ".md")
AUDIT_RULES = (
    ("phone_number", r"\+1[0-9]{10}", _TEXTS),
    ("home_path", r"/Users/[a-zA-Z]", _TEXTS),
    ("anthropic_key", r"sk-ant-api0[0-9]-[A-Za-z0-9_-]{10,}", _CODE),
    ("stripe_live_key", r"sk_live_[A-Za-z0-9]{10,}", (*_CODE, ".php")),
    ("stripe_webhook", r"whsec_[A-Za-z0-9]{10,}", (*_CODE, ".php")),
    ("aws_key", r"AKIA[0-9A-Z]{16}", _CODE),
    ("nvm_path", r"\.nvm/versions/node", _TEXTS[:5]),
)
# What makes a hit a known placeholder.
AUDIT_ALLOWED = r"/Users/YOU(/|$|[^a-zA-Z])|/Users/YOUR_USER(/|$|[^a-zA-Z])|/home/YOUR_USER(/|$|[^a-zA-Z])|\+15551234567|sk-ant-api0[0-9]-REPLACE|whsec_test[A-Za-z0-9]+|SECURE_PASSWORD"


def bulk_append(files: DataFrame, needle: str, append: str, marker: str = "") -> DataFrame:
    """(path, content, changes): the text appended after each needle that is not yet followed by the marker."""
    new = T.bulk_append("content", needle, append, marker)
    return files.withColumn("__new", new).select("path", F.col("__new").alias("content"), ((F.length("__new") - F.length("content")) / max(len(append), 1)).cast("int").alias("changes"))


def bulk_replace(files: DataFrame, old: str, new: str) -> DataFrame:
    """(path, content, lines): all occurrences replaced, with the line of each."""
    return files.select("path", F.replace("content", F.lit(old), F.lit(new)).alias("content"), T.replace_lines("content", old).alias("lines"))


def replace_once(files: DataFrame, edits: DataFrame) -> DataFrame:
    """(path, content, error): one replacement a file that must match exactly once, else an error and the file as it was."""
    j = files.join(edits.select("path", "old_str", "new_str"), "path")
    n = T.occurrences("content", F.col("old_str"))
    j = j.withColumn("__n", n)
    at = F.expr("instr(content, old_str)")
    once = F.concat(F.substring("content", F.lit(1), at - 1), F.col("new_str"), F.substring(F.col("content"), at + F.length("old_str"), F.length("content")))
    error = F.when(F.col("__n") == 0, "not found").when(F.col("__n") > 1, F.concat(F.lit("matched "), F.col("__n").cast("string"), F.lit(" times")))
    return j.select("path", F.when(F.col("__n") == 1, once).otherwise(F.col("content")).alias("content"), error.alias("error"))


def safe_path(path: F.Column) -> F.Column:
    return (F.trim(path) != "") & ~path.startswith("/") & ~F.array_contains(F.split(path, "/"), "..")


def apply_edits(files: DataFrame, edits: DataFrame) -> DataFrame:
    """(path, content, deleted, error): each file's edits folded in order; a file with an error stays as it was.

    edits: path, ord, type (replace, create, delete), old_str, new_str, content. The edits of one file are one plan's
    worth of text, collected in order and folded by an aggregate; files are spread over the cluster.
    """
    todo = edits.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("ord", F.lower(F.coalesce("type", F.lit("replace"))).alias("type"), "old_str", "new_str", F.col("content").alias("body")))).alias("__e"))
    j = todo.join(files.select("path", F.col("content").alias("__old")), "path", "left")
    state = lambda text, gone, error: F.struct(text.alias("text"), gone.alias("gone"), error.alias("error"))
    none, no = F.lit(None).cast("string"), F.lit(False)

    def step(s: F.Column, e: F.Column) -> F.Column:
        have = F.coalesce(s.text, F.col("__old"))
        n = T.occurrences(have, F.coalesce(e.old_str, F.lit("")))
        bad = (F.when(s.error.isNotNull(), s.error)
               .when((e.type == "delete") & s.text.isNotNull(), "delete after edit")
               .when((e.type != "delete") & s.gone, "edit after delete")
               .when((e.type == "create") & e.body.isNull(), "no content")
               .when((e.type == "create") & F.col("__old").isNotNull() & s.text.isNull(), "file exists")
               .when((e.type == "replace") & (e.old_str.isNull() | e.new_str.isNull()), "no strings")
               .when((e.type == "replace") & have.isNull(), "file not found")
               .when((e.type == "replace") & (n == 0), "not found")
               .when((e.type == "replace") & (n > 1), F.concat(F.lit("matched "), n.cast("string"), F.lit(" times")))
               .when((e.type == "delete") & F.col("__old").isNull(), "file not found")
               .when(~e.type.isin("replace", "create", "delete"), "unknown edit type"))
        text = F.when(e.type == "create", e.body).when(e.type == "replace", F.replace(have, e.old_str, e.new_str)).otherwise(s.text)
        return state(F.when(bad.isNull(), text).otherwise(s.text), F.when(bad.isNull(), s.gone | (e.type == "delete")).otherwise(s.gone), bad)

    folded = j.withColumn("__s", F.aggregate("__e", state(none, no, F.when(~safe_path(F.col("path")), "path escape").otherwise(none)), step))
    failed = F.col("__s.error").isNotNull()
    return folded.select("path", F.when(failed, F.col("__old")).when(F.col("__s.gone"), none).otherwise(F.coalesce("__s.text", "__old")).alias("content"), (~failed & F.col("__s.gone")).alias("deleted"), F.col("__s.error").alias("error"))


def mail_rule(domains: tuple[str, ...]) -> tuple[str, str, tuple[str, ...]]:
    """The rule against mail addresses of the given domains, without their endings."""
    return "mail_address", r"[a-zA-Z0-9._%+-]+@(" + "|".join(domains) + r")\.(com|io|net)", _TEXTS[:5]


def audit(files: DataFrame, mail_domains: tuple[str, ...] = ("example-private", "yourcompany")) -> DataFrame:
    """(path, line, rule) of every line that breaks a rule and is no known placeholder."""
    rules = (*AUDIT_RULES, mail_rule(mail_domains))
    lines = files.select("path", F.posexplode(F.split("content", "\r?\n")).alias("n", "text")).withColumn("line", F.col("n") + 1)
    found = F.array(*[F.when(F.col("text").rlike(p) & F.lower("path").rlike("(" + "|".join(e.replace(".", r"\.") for e in ends) + ")$"), F.lit(name)) for name, p, ends in rules])
    return lines.where(~F.col("text").rlike(AUDIT_ALLOWED)).select("path", "line", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("rule"))
