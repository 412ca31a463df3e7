"""Corpus upkeep: which files to index, what changed, chunks by file, keyed upsert, drift between texts and files."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from millrace.functions import text as T

# Directories never indexed; entries with a slash match as adjacent parts.
EXCLUDED = ("node_modules", "vendor", "libraries", "OUTPUT", ".git", "dist", "build", "scripts/test", "__pycache__", ".venv")
# Words in capitals that are no environment keys.
NO_ENV_KEYS = ("README", "SQL", "API", "CWR", "MCP", "URL", "HTTP", "HTTPS")


def indexable(path: Column, size: Column, excluded: tuple[str, ...] = EXCLUDED) -> Column:
    """Whether a file is indexed: known extension, not too large, no excluded directory on its path, no secrets file."""
    name = F.substring_index(path, "/", -1)
    known = reduce(lambda a, b: a | b, [name.endswith(x) for x in T.INDEXABLE])
    parts = F.concat(F.lit("/"), path)
    hidden = reduce(lambda a, b: a | b, [parts.contains(f"/{x}/") for x in excluded])
    return known & (size <= T.MAX_FILE_BYTES) & ~hidden & ~T.is_secret_file(path)


def collection(path: Column) -> Column:
    """repos, docs or sql; a primary document is in docs as well as in repos, so ask `is_doc` for that."""
    return F.when(F.split(path, "/")[0] == T.SQL_TREE, "sql").otherwise("repos")


def is_doc(path: Column) -> Column:
    return T.file_kind(path) != "code"


def file_hash(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 16)


def chunk_files(files: DataFrame, size: int = T.CHUNK_SIZE, overlap: int = T.CHUNK_OVERLAP) -> DataFrame:
    """Files (collection, rel_path, content) as redacted, numbered chunks with ids.

    Redaction comes first, so that no secret is cut in two by a chunk's edge. A null content counts as empty.
    """
    f = files.select("collection", "rel_path", T.redact(F.coalesce("content", F.lit(""))).alias("t"))
    c = f.select("collection", "rel_path", F.posexplode(T.chunks("rel_path", "t", size, overlap)).alias("chunk", "c"))
    kind, end = T.file_kind("rel_path"), T.suffix("rel_path")
    return c.select("collection", T.chunk_id(F.col("collection"), F.col("rel_path"), F.col("chunk")).alias("id"), F.split("rel_path", "/")[0].alias("repo"), F.col("rel_path").alias("path"),
                    "chunk", kind.alias("kind"), F.when(end == "", "txt").otherwise(F.substring(end, 2, 20)).alias("lang"), F.when(kind != "code", "primary").alias("doc_tier"), "c.symbol_hint", "c.text")


SIGNATURE = ("mtime", "size", "hash")


def changed(current: DataFrame, manifest: DataFrame, keys: tuple[str, ...] = ("collection", "rel_path"), signature: tuple[str, ...] = SIGNATURE) -> DataFrame:
    """Current files that are new or whose signature differs; nulls compare as equal. Several manifest rows for a file: any equal one will do."""
    same = reduce(lambda a, b: a & b, [F.col(f"c.{k}").eqNullSafe(F.col(f"m.{k}")) for k in (*keys, *signature)])
    return current.alias("c").join(manifest.select(*keys, *signature).distinct().alias("m"), same, "left_anti")


def removed(current: DataFrame, manifest: DataFrame, keys: tuple[str, ...] = ("collection", "rel_path"), scope: Column | None = None) -> DataFrame:
    """Manifest files that are gone; a scope (such as one repository) keeps everything outside it."""
    m = manifest if scope is None else manifest.where(scope)
    return m.select(*keys).distinct().join(current.select(*keys), list(keys), "left_anti")


def upsert(stored: DataFrame, new: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Stored rows without those the new ones replace, and the new ones."""
    return stored.join(new.select(*keys).distinct(), list(keys), "left_anti").unionByName(new, allowMissingColumns=True)


def replace_files(stored: DataFrame, new_chunks: DataFrame, gone: DataFrame) -> DataFrame:
    """Chunk table after a run: every chunk of a removed or re-indexed file goes first, so a file that shrank leaves none behind."""
    touched = new_chunks.select("collection", "path").unionByName(gone.select("collection", F.col("rel_path").alias("path"))).distinct()
    return stored.join(touched, ["collection", "path"], "left_anti").unionByName(new_chunks, allowMissingColumns=True)


def metadata_value(items: Column) -> Column:
    """A list as one metadata value: its first twenty entries joined by commas."""
    return F.array_join(F.slice(items, 1, 20), ",")


def playbooks(incidents: DataFrame) -> DataFrame:
    """Resolved incidents as one-chunk documents (collection playbooks)."""
    done = incidents.where(F.col("state").isin("FIXED", "RESOLVED"))
    part = lambda label, c: F.concat(F.lit(label), F.col(c).cast("string"))
    path = F.concat(F.lit("playbook_"), F.substring("fingerprint", 1, 12), F.lit(".md"))
    # fields without a value are left out
    text = F.concat_ws("\n", part("state: ", "state"), part("tool: ", "tool"), part("module: ", "module"), part("kind: ", "kind"), part("message: ", "message"))
    return done.select(F.lit("playbooks").alias("collection"), T.chunk_id(F.lit("playbooks"), path, F.lit(0)).alias("id"), F.coalesce("repos_name", F.lit("unknown")).alias("repo"), path.alias("path"),
                       F.lit(0).alias("chunk"), F.lit("playbook").alias("kind"), text.alias("text"))


# --- drift -----------------------------------------------------------------------------------------------------------

def missing_refs(readmes: DataFrame, files: DataFrame, wide: bool = False) -> DataFrame:
    """File names a readme mentions that its repository's root lacks; refs with a slash only if `wide`.

    readmes: repo, text. files: repo, rel_path (without the repository).
    """
    refs = readmes.select("repo", F.explode(T.path_refs("text")).alias("ref")).distinct()
    refs = refs if wide else refs.where(~F.col("ref").contains("/"))
    return refs.join(files.select("repo", F.col("rel_path").alias("ref")).distinct(), ["repo", "ref"], "left_anti").withColumn("check", F.lit("readme_missing_path"))


def env_not_in_example(readmes: DataFrame, examples: DataFrame, most: int = 5) -> DataFrame:
    """Environment keys of a readme that the example file lacks: with an underscore, longer than four, the first few by name.

    Both sides are (repo, text); keys are made distinct before they meet, so no repository is one row. A repository
    without an example file has no findings.
    """
    keys = lambda t: t.select("repo", F.explode(T.env_keys("text")).alias("ref")).distinct()
    said = keys(readmes).where((F.length("ref") > 4) & F.col("ref").contains("_") & ~F.col("ref").isin(*NO_ENV_KEYS))
    only = said.join(examples.select("repo").distinct(), "repo", "left_semi").join(keys(examples), ["repo", "ref"], "left_anti")
    n = F.row_number().over(W.partitionBy("repo").orderBy("ref"))
    return only.withColumn("__n", n).where(F.col("__n") <= most).select("repo", "ref", F.lit("readme_env_not_in_example").alias("check"))


def unmapped(path_map: DataFrame, repos: DataFrame) -> DataFrame:
    """Modules whose repository does not exist."""
    m = path_map.select("module", F.coalesce("repos_name", "module").alias("repo"))
    return m.join(repos.select("repo").distinct(), "repo", "left_anti").select("repo", F.col("module").alias("ref"), F.lit("path_map_missing_repo").alias("check"))


#: Severity of each check and what its finding says.
SEVERITY = {"readme_missing_path": "warning", "path_map_missing_repo": "warning", "readme_env_not_in_example": "info"}
SAYS = {"readme_missing_path": " names a file that is not there: ", "path_map_missing_repo": " does not exist, but is mapped from ", "readme_env_not_in_example": " documents a key that its example lacks: "}


def drift(readmes: DataFrame, files: DataFrame, examples: DataFrame, path_map: DataFrame) -> DataFrame:
    """(repo, check, ref, severity, summary): the findings of all three checks.

    readmes and examples: repo, text; files: repo, rel_path. The repositories are those that have files.
    """
    found = unmapped(path_map, files).unionByName(missing_refs(readmes, files)).unionByName(env_not_in_example(readmes, examples))
    pick = lambda of: F.create_map(*[F.lit(x) for kv in of.items() for x in kv])[F.col("check")]
    return found.select("repo", "check", "ref", pick(SEVERITY).alias("severity"), F.concat("repo", pick(SAYS), "ref").alias("summary"))


def finding_documents(findings: DataFrame) -> DataFrame:
    """Findings as one-chunk documents (collection discrepancies). Their names come from what they say, so a run overwrites itself."""
    path = F.concat(F.lit("finding_"), F.substring(F.md5("summary"), 1, 12), F.lit(".txt"))
    c = F.lit("discrepancies")
    return findings.select(c.alias("collection"), T.chunk_id(c, path, F.lit(0)).alias("id"), "repo", path.alias("path"), F.lit(0).alias("chunk"), F.lit("discrepancy").alias("kind"), "severity", "check", F.col("summary").alias("text"))


def newest(rows: DataFrame, key: Column, order: str) -> DataFrame:
    """The row of each key with the largest order value, whatever the columns; rows without a key are left out. Partial maxima only."""
    one = rows.withColumn("__key", key).where(F.col("__key").isNotNull()).groupBy("__key").agg(F.max_by(F.struct(*[F.col(f"`{c}`") for c in rows.columns]), order).alias("r"))
    return one.select("r.*")
