"""Queries of corpus upkeep, text functions, edits and drift."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from millrace.functions import text as T
from millrace.operators import corpus as C, edits as E
from millrace.operators.delivery import canonical_hash
from millrace.tables import load

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f
    return add


#: Environment keys as SQL: word boundaries in the sense of Unicode, each separator doubled so that neighbours share none.
_W = r"\p{L}\p{M}\p{Nd}\p{Pc}"
_KEYS = rf"list_distinct(regexp_extract_all(' ' || regexp_replace(text, '([^{_W}])', '\1\1', 'g') || ' ', '[^{_W}]([A-Z][A-Z0-9_]{{2,}})[^{_W}]', 1))"


def _redacted(c: str) -> str:
    """The redaction rules as SQL; the look-ahead becomes a mark put before placeholders and taken out again."""
    out = c
    for p, r in T.REDACTION_RULES:
        q = p.replace("'", "''")
        if "(?!" in p:
            a, b = q.index("(?!"), q.index(")", q.index("(?!"))
            words = q[a + 3:b]
            out = f"regexp_replace({out}, '({q[4:a]})({words})', '\\1' || chr(1) || '\\3', 'gi')"
            out = f"replace(regexp_replace({out}, '{q[:a]}{q[b + 1:]}', '{r.replace('$1', chr(92) + '1')}', 'g'), chr(1), '')"
        else:
            out = f"regexp_replace({out}, '{q}', '{r.replace('$1', chr(92) + '1')}', 'g')"
    return out


@query(f"SELECT doc_id, md5({_redacted('text')}) AS redacted, text <> {_redacted('text')} AS hit FROM documents")
def redact_secrets(spark: SparkSession, d: str) -> DataFrame:
    x = load(spark, d, "documents").select("doc_id", "text", T.redact("text").alias("r"))
    return x.select("doc_id", F.md5(F.col("r")).alias("redacted"), (F.col("text") != F.col("r")).alias("hit"))


@query(f"WITH c AS (SELECT DISTINCT ON (id) * FROM chunks ORDER BY id) SELECT id, md5({_redacted('text')}) AS redacted FROM c")
def redact_chunks(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "chunks").dropDuplicates(["id"]).select("id", F.md5(T.redact("text")).alias("redacted"))


@query("SELECT doc_id, i AS chunk, substr(text, i * 1000 + 1, 1200) AS piece FROM (SELECT doc_id, text, unnest(range(greatest(0, CAST(ceil((length(text) - 1200) / 1000.0) AS BIGINT)) + 1)) AS i FROM documents)")
def chunk_fixed(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "documents").select("doc_id", F.posexplode(T.char_chunks("text")).alias("chunk", "piece"))


@query("SELECT DISTINCT id, substr(sha256(collection || ':' || path || ':' || chunk), 1, 32) = id AS same FROM chunks")
def chunk_ids(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "chunks").select("id", (T.chunk_id(F.col("collection"), F.col("path"), F.col("chunk")) == F.col("id")).alias("same")).distinct()


_STRIP = r"regexp_replace(regexp_replace({}, '^\s+', ''), '\s+$', '')"


@query(r"""WITH s AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '(?m)^(#{1,3} )', chr(1) || '\1', 'g'), chr(1)), lambda x: """ + _STRIP.format("x") + r"""), lambda x: x <> '') AS s, text FROM documents),
u AS (SELECT doc_id, unnest(range(len(s))) AS i, unnest(s) AS x FROM s WHERE len(s) > 1),
p AS (SELECT doc_id, i, x, unnest(range(greatest(0, CAST(ceil((length(x) - 1200) / 1000.0) AS BIGINT)) + 1)) AS j FROM u)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i, j) - 1 AS chunk, coalesce(nullif(substr(""" + _STRIP.format(r"regexp_extract(x, '(?m)^#{1,3}\s+(.+)$', 1)") + r""", 1, 80), ''), 'section_' || i) AS hint, md5('[Repo: R | README]' || chr(10) || substr(x, j * 1000 + 1, 1200)) AS piece FROM p
UNION ALL SELECT doc_id, j, NULL, md5(CASE WHEN j = 0 THEN '[Repo: R | README]' || chr(10) ELSE '' END || substr(text, j * 1000 + 1, 1200)) FROM (SELECT doc_id, text, unnest(range(greatest(0, CAST(ceil((length(text) - 1200) / 1000.0) AS BIGINT)) + 1)) AS j FROM s WHERE len(s) <= 1)""")
def chunk_markdown(spark: SparkSession, d: str) -> DataFrame:
    """Every document as a readme: cut at headings, then by size."""
    x = load(spark, d, "documents").select("doc_id", F.posexplode(T.chunks(F.lit("R/README.md"), F.col("text"))).alias("chunk", "c"))
    return x.select("doc_id", "chunk", F.col("c.symbol_hint").alias("hint"), F.md5(F.col("c.text")).alias("piece"))


@query(r"""WITH c AS (SELECT DISTINCT ON (id) * FROM chunks WHERE lang IN ('py', 'sh') ORDER BY id),
s AS (SELECT id, list_filter(list_transform(string_split(regexp_replace(text, '(?m)^(def |class |function )', chr(1) || '\1', 'g'), chr(1)), lambda x: """ + _STRIP.format("x") + r"""), lambda x: x <> '') AS s, text FROM c),
u AS (SELECT id, unnest(range(len(s))) AS i, unnest(s) AS x, true AS cut FROM s WHERE len(s) > 1 UNION ALL SELECT id, 0, text, false FROM s WHERE len(s) <= 1),
p AS (SELECT *, unnest(range(greatest(0, CAST(ceil((length(x) - 1200) / 1000.0) AS BIGINT)) + 1)) AS j FROM u)
SELECT id, row_number() OVER (PARTITION BY id ORDER BY i, j) - 1 AS chunk, CASE WHEN cut THEN regexp_extract(x, '(?m)^(?:def|class)\s+(\w+)', 1) END AS hint, md5(substr(x, j * 1000 + 1, 1200)) AS piece FROM p""")
def chunk_code(spark: SparkSession, d: str) -> DataFrame:
    """Every indexed piece of a script as a file: cut at definitions, then by size."""
    x = load(spark, d, "chunks").where("lang IN ('py', 'sh')").dropDuplicates(["id"])
    x = x.select("id", F.posexplode(T.chunks(F.concat(F.lit("R/f."), F.col("lang")), F.col("text"))).alias("chunk", "c"))
    return x.select("id", "chunk", F.col("c.symbol_hint").alias("hint"), F.md5(F.col("c.text")).alias("piece"))


@query(r"""WITH RECURSIVE c AS (SELECT DISTINCT ON (id) * FROM chunks WHERE lang = 'sql' ORDER BY id),
s AS (SELECT id, text, list_filter(list_transform(regexp_split_to_array(text, ';\s*\n'), lambda x: """ + _STRIP.format("x") + r"""), lambda x: x <> '') AS s FROM c),
p AS (SELECT id, s, 1 AS i, 0 AS g, length(s[1]) AS n FROM s WHERE len(s) > 1
  UNION ALL SELECT id, s, i + 1, CASE WHEN n + length(s[i + 1]) > 1200 THEN g + 1 ELSE g END, CASE WHEN n + length(s[i + 1]) > 1200 THEN length(s[i + 1]) ELSE n + 1 + length(s[i + 1]) END FROM p WHERE i < len(s)),
k AS (SELECT id, g AS chunk, string_agg(s[i], chr(10) ORDER BY i) AS piece FROM p GROUP BY 1, 2
  UNION ALL SELECT id, j, substr(text, j * 1000 + 1, 1200) FROM (SELECT id, text, unnest(range(greatest(0, CAST(ceil((length(text) - 1200) / 1000.0) AS BIGINT)) + 1)) AS j FROM s WHERE len(s) <= 1))
SELECT id, chunk, length(piece) AS length, md5(piece) AS piece FROM k""")
def chunk_sql(spark: SparkSession, d: str) -> DataFrame:
    """Every indexed piece of SQL as a file: statements packed up to the size."""
    x = load(spark, d, "chunks").where("lang = 'sql'").dropDuplicates(["id"]).select("id", F.posexplode(T.chunks(F.lit("R/f.sql"), F.col("text"))).alias("chunk", "c"))
    return x.select("id", "chunk", F.length("c.text").alias("length"), F.md5(F.col("c.text")).alias("piece"))


@query(r"SELECT doc_id, len(w) AS n_tokens, list_aggregate(list_distinct(w), 'count') AS n_distinct FROM (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[\s\x0B\x{85}\p{Z}]+'), lambda x: x <> '') AS w FROM documents)")
def token_stats(spark: SparkSession, d: str) -> DataFrame:
    t = T.tokens("text")
    return load(spark, d, "documents").select("doc_id", F.size(t).alias("n_tokens"), F.size(F.array_distinct(t)).cast("long").alias("n_distinct"))


@query(r"""SELECT doc_id, coalesce(nullif(regexp_replace(regexp_replace(substr(lower(text), 1, 50), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'task') AS slug,
list_sort(""" + _KEYS + r""") AS env_keys, len(text) AS n FROM documents""")
def text_functions(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "documents").select("doc_id", T.slug("text").alias("slug"), F.array_sort(T.env_keys("text")).alias("env_keys"), F.length("text").cast("long").alias("n"))


@query(r"""WITH l AS (SELECT doc_id, text, string_split(regexp_replace(text, '\r\n?|\n', chr(10), 'g'), chr(10)) AS a FROM documents), m AS (SELECT doc_id, text, CASE WHEN a[-1] = '' THEN a[:-2] ELSE a END AS a FROM l),
n AS (SELECT doc_id, text, len(a) AS n, list_transform(range(1, len(a) + 1), lambda i: CASE WHEN i < 10000 THEN lpad(i::VARCHAR, 4, '0') ELSE i::VARCHAR END || '| ' || a[i]) AS a FROM m)
SELECT doc_id, CASE WHEN length(text) > 2000 AND n >= 10 THEN array_to_string(a[1:35], chr(10)) || CASE WHEN n > 35 THEN chr(10) || '... [lines 36-' || n || ' truncated] ...' ELSE '' END ELSE coalesce(array_to_string(a, chr(10)), '') END AS excerpt FROM n""")
def excerpts(spark: SparkSession, d: str) -> DataFrame:
    """Every document within 2,000 code points, lines numbered, around its tenth line."""
    return load(spark, d, "documents").select("doc_id", T.excerpt("text", 2000, F.lit(10)).alias("excerpt"))


def _now(spark: SparkSession, d: str) -> DataFrame:
    """The manifest as it will be: one file in seven touched, one in eleven gone, by a hash of the path."""
    m = load(spark, d, "manifest")
    h = F.conv(F.substring(F.md5(F.col("rel_path")), 1, 6), 16, 10).cast("int")
    return m.where(h % 11 != 0).withColumn("mtime", F.when(h % 7 == 0, F.coalesce("mtime", F.lit(0)) + 1).otherwise(F.col("mtime")))


_NOW = "n AS (SELECT *, ('0x' || substr(md5(rel_path), 1, 6))::INT AS k FROM manifest), c AS (SELECT collection, rel_path, CASE WHEN k % 7 = 0 THEN coalesce(mtime, 0) + 1 ELSE mtime END AS mtime, size, hash FROM n WHERE k % 11 <> 0)"


@query(f"WITH {_NOW} SELECT c.* FROM c WHERE NOT EXISTS (SELECT 1 FROM manifest m WHERE (m.collection, m.rel_path) IS NOT DISTINCT FROM (c.collection, c.rel_path) AND m.mtime IS NOT DISTINCT FROM c.mtime AND m.size IS NOT DISTINCT FROM c.size AND m.hash IS NOT DISTINCT FROM c.hash)")
def index_diff_changed(spark: SparkSession, d: str) -> DataFrame:
    return C.changed(_now(spark, d), load(spark, d, "manifest"))


@query(f"WITH {_NOW} SELECT DISTINCT collection, rel_path FROM manifest m WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.collection = m.collection AND c.rel_path = m.rel_path)")
def index_diff_removed(spark: SparkSession, d: str) -> DataFrame:
    return C.removed(_now(spark, d), load(spark, d, "manifest"))


@query("SELECT DISTINCT collection, path AS rel_path FROM chunks WHERE NOT EXISTS (SELECT 1 FROM manifest m WHERE m.collection = chunks.collection AND m.rel_path = chunks.path)")
def files_not_in_manifest(spark: SparkSession, d: str) -> DataFrame:
    return C.removed(load(spark, d, "manifest"), load(spark, d, "chunks").select("collection", F.col("path").alias("rel_path")))


@query(f"WITH {_NOW} SELECT * FROM c UNION ALL SELECT collection, rel_path, mtime, size, hash FROM manifest m WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.collection = m.collection AND c.rel_path = m.rel_path)")
def keyed_upsert(spark: SparkSession, d: str) -> DataFrame:
    return C.upsert(load(spark, d, "manifest"), _now(spark, d), ("collection", "rel_path"))


@query("SELECT min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY sha256(text)")
def dedupe_exact(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "documents").groupBy(F.sha2("text", 256)).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")).select("doc_id", "copies")


@query(r"""WITH f AS (SELECT DISTINCT path, split_part(path, '/', -1) AS name, split_part(path, '/', 1) AS repo FROM chunks),
r AS (SELECT repo, string_agg(text, chr(10) ORDER BY chunk, id) AS text FROM (SELECT DISTINCT split_part(path, '/', 1) AS repo, chunk, id, text FROM chunks WHERE kind IN ('readme', 'doc')) GROUP BY 1),
k AS (SELECT repo, """ + _KEYS + r""" AS a FROM r)
SELECT repo, len(a) AS n_keys FROM k""")
def drift_env_keys(spark: SparkSession, d: str) -> DataFrame:
    """How many environment keys each repository's documents mention."""
    c = load(spark, d, "chunks").where("kind IN ('readme', 'doc')").select(F.split("path", "/")[0].alias("repo"), F.explode(T.env_keys("text")).alias("k"))
    docs = load(spark, d, "chunks").where("kind IN ('readme', 'doc')").select(F.split("path", "/")[0].alias("repo")).distinct()
    n = c.groupBy("repo").agg(F.countDistinct("k").alias("n"))
    return docs.join(n, "repo", "left").select("repo", F.coalesce("n", F.lit(0)).cast("long").alias("n_keys"))


@query(r"""WITH t AS (SELECT DISTINCT split_part(path, '/', 1) AS repo, text FROM chunks WHERE kind IN ('readme', 'doc')),
x AS (SELECT repo, unnest(list_transform(range(1, len(regexp_extract_all(text, '`[^`]+\.(?:py|sh|sql|php|js|ts|yml|yaml|json|md)`|(?:^|\s)[\w./-]+\.(?:py|sh|sql|php|js|ts|yml|yaml)\b')) + 1),
  lambda i: regexp_extract_all(text, '(?m)`[^`]+\.(?:py|sh|sql|php|js|ts|yml|yaml|json|md)`|(?:^|\s)[\w./-]+\.(?:py|sh|sql|php|js|ts|yml|yaml)\b')[i])) AS m FROM t),
r AS (SELECT DISTINCT repo, ltrim(trim(replace(m, '`', ''), chr(10) || chr(13) || chr(9) || ' '), './') AS ref FROM x WHERE m IS NOT NULL)
SELECT repo, ref, 'readme_missing_path' AS "check" FROM r WHERE NOT contains(ref, '/') AND ref <> '' AND NOT starts_with(ref, 'http') AND NOT EXISTS (SELECT 1 FROM chunks c WHERE c.path = r.repo || '/' || r.ref)""")
def drift_missing_refs(spark: SparkSession, d: str) -> DataFrame:
    """Bare file names in documents that their repository's root lacks."""
    c = load(spark, d, "chunks")
    docs = c.where("kind IN ('readme', 'doc')").select(F.split("path", "/")[0].alias("repo"), "text")
    files = c.select(F.split("path", "/")[0].alias("repo"), F.regexp_replace("path", "^[^/]*/", "").alias("rel_path"))
    return C.missing_refs(docs, files)


@query("SELECT coalesce(repos_name, module) AS repo, module AS ref, 'path_map_missing_repo' AS \"check\" FROM path_map WHERE NOT EXISTS (SELECT 1 FROM chunks WHERE repo = coalesce(repos_name, module))")
def drift_unmapped(spark: SparkSession, d: str) -> DataFrame:
    return C.unmapped(load(spark, d, "path_map"), load(spark, d, "chunks").select("repo"))


@query("SELECT doc_id, md5(replace(text, 'the ', 'that ')) AS content, CAST((length(text) - length(replace(text, 'the ', ''))) / 4 AS BIGINT) AS n FROM documents")
def bulk_replace(spark: SparkSession, d: str) -> DataFrame:
    x = E.bulk_replace(load(spark, d, "documents").select(F.col("doc_id").alias("path"), F.col("text").alias("content")), "the ", "that ")
    return x.select(F.col("path").alias("doc_id"), F.md5(F.col("content")).alias("content"), F.size("lines").cast("long").alias("n"))


@query("""WITH s AS (SELECT doc_id, text, chr(10) || '## ' AS h, string_split(text, chr(10) || '## ') AS a FROM documents),
n AS (SELECT doc_id, text, array_to_string(list_transform(range(1, len(a) + 1), lambda i: CASE WHEN i = len(a) THEN a[i] WHEN contains(substr(h || coalesce(array_to_string(a[i + 1:], chr(10) || '## '), ''), 1, 164), '(checked)') THEN a[i] || h ELSE a[i] || h || '(checked) ' END), '') AS content FROM s)
SELECT doc_id AS path, content, CAST((length(content) - length(text)) / 10 AS INT) AS changes FROM n""")
def bulk_append(spark: SparkSession, d: str) -> DataFrame:
    """A note after each heading that has none yet, as far as the original text shows."""
    return E.bulk_append(load(spark, d, "documents").select(F.col("doc_id").alias("path"), F.col("text").alias("content")), "\n## ", "(checked) ", "(checked)")


@query("SELECT doc_id, CASE WHEN n = 1 THEN md5(replace(text, 'must ', 'shall ')) ELSE md5(text) END AS content, CASE WHEN n = 0 THEN 'not found' WHEN n > 1 THEN 'matched ' || n || ' times' END AS error FROM (SELECT doc_id, text, CAST((length(text) - length(replace(text, 'must ', ''))) / 5 AS BIGINT) AS n FROM documents)")
def replace_once(spark: SparkSession, d: str) -> DataFrame:
    f = load(spark, d, "documents").select(F.col("doc_id").alias("path"), F.col("text").alias("content"))
    e = f.select("path", F.lit("must ").alias("old_str"), F.lit("shall ").alias("new_str"))
    return E.replace_once(f, e).select(F.col("path").alias("doc_id"), F.md5(F.col("content")).alias("content"), "error")


_AUDIT = " UNION ALL ".join(f"SELECT path, line, '{n}' AS rule FROM l WHERE regexp_matches(t, '{p}') AND regexp_matches(lower(path), '({'|'.join(e.replace('.', chr(92) + '.') for e in ends)})$')" for n, p, ends in (*E.AUDIT_RULES, E.mail_rule(("example-private", "yourcompany"))))


@query(f"WITH u AS (SELECT id || '/' || path AS path, string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10)) AS s FROM (SELECT DISTINCT id, path, text FROM chunks)), l AS (SELECT path, unnest(range(len(s))) + 1 AS line, unnest(s) AS t FROM u), "
       f"a AS ({_AUDIT}) SELECT a.* FROM a JOIN l USING (path, line) WHERE NOT regexp_matches(l.t, '{E.AUDIT_ALLOWED}')")
def audit_scan(spark: SparkSession, d: str) -> DataFrame:
    """Lines of indexed pieces that break a publication rule."""
    f = load(spark, d, "chunks").select("id", "path", "text").distinct()
    return E.audit(f.select(F.concat("id", F.lit("/"), "path").alias("path"), F.col("text").alias("content")))


_NAMES = rf"list_distinct(list_transform(regexp_extract_all(' ' || regexp_replace(text, '([^{_W}])', '\1\1', 'g') || ' ', '[^{_W}]([A-Za-z_][A-Za-z0-9_]{{2,}})[^{_W}]', 1), lambda x: lower(x)))"


@query(f"""SELECT item_id, least(5, len(list_filter({_NAMES}, lambda x: x NOT IN ({", ".join(f"'{w}'" for w in T.NO_TABLES)}))))::INT AS names,
{" OR ".join(f"contains(lower(text), '{w}')" for w in T.DATABASE_WORDS)} AS needs_schema, {" OR ".join(f"contains(lower(text), '{w}')" for w in T.DRIFT_WORDS)} AS drift FROM eval_items""")
def prose_flags(spark: SparkSession, d: str) -> DataFrame:
    """What each evaluation text speaks of, and how many table candidates it names."""
    return load(spark, d, "eval_items").select("item_id", F.size(T.table_candidates("text")).alias("names"), T.needs_schema("text").alias("needs_schema"), T.speaks_of_drift("text").alias("drift"))


def _quoted(s: str) -> str:
    return s.replace("'", "''")


@query(f"""WITH f AS (SELECT doc_id, repo, text, list_concat(regexp_extract_all(text, '{_quoted(T.PROSE_PATH)}', 1), regexp_extract_all(text, '{_quoted(T.PASSAGE_HEADER.replace("(?md)", "(?m)"))}', 1)) AS a FROM documents),
g AS (SELECT doc_id, repo, text, list_transform(list_transform(a, lambda x: regexp_replace(trim(x), '^[`"'']+|[`"'']+$', '', 'g')), lambda x: CASE WHEN lower(substr(x, 1, 6)) = 'repos/' THEN substr(x, 7) ELSE x END) AS a FROM f),
h AS (SELECT doc_id, text, list_filter(list_transform(list_filter(a, lambda x: x <> '' AND NOT starts_with(x, 'http')), lambda x: CASE WHEN coalesce(repo, '') <> '' AND starts_with(x, repo || '/') THEN substr(x, length(repo) + 2) ELSE x END),
  lambda x: x <> '' AND NOT starts_with(x, '/') AND NOT list_contains(string_split(x, '/'), '..')) AS a,
  list_filter(list_transform(regexp_extract_all(' ' || regexp_replace(text, '([^{_W}])', '\\1\\1', 'g') || ' ', '[^{_W}]([A-Za-z_][A-Za-z0-9_]{{2,}})[^{_W}]', 1), lambda x: lower(x)), lambda x: x NOT IN ({", ".join(f"'{w}'" for w in T.NO_TABLES)})) AS t FROM g)
SELECT doc_id, list_filter(a, lambda x, i: list_position(a, x) = i) AS paths, CASE WHEN contains(text, coalesce(a[1], '')) THEN TRY_CAST(regexp_extract(text, '(?i)line\\s+(\\d+)', 1) AS INT) END AS line,
list_filter(t, lambda x, i: list_position(t, x) = i)[1:5] AS tables, contains(text, '<<<<<<<') OR contains(text, '=======') AND contains(text, '>>>>>>>') AS conflict FROM h""")
def prose_paths(spark: SparkSession, d: str) -> DataFrame:
    """Paths each document names, relative to its repository, with the line it mentions and its table candidates."""
    x = load(spark, d, "documents").select("doc_id", "repo", "text", T.discover_paths(F.lit(None).cast("array<string>"), F.col("text"), F.lit(""), F.col("text"), F.col("repo")).alias("paths"))
    return x.select("doc_id", "paths", T.line_mention(F.coalesce(F.try_element_at("paths", F.lit(1)), F.lit("")), F.col("text")).alias("line"), T.table_candidates("text").alias("tables"), T.has_conflict("text").alias("conflict"))


# --- files in and out of the index -------------------------------------------------------------------------------------

_SHOWN = " AND ".join(f"NOT contains('/' || rel_path, '/{x}/')" for x in C.EXCLUDED)
_ENDS = " OR ".join(f"ends_with(split_part(rel_path, '/', -1), '{x}')" for x in T.INDEXABLE)
_NAME = "split_part(rel_path, '/', -1)"


@query(f"""SELECT collection, rel_path, size, coalesce(({_ENDS}) AND size <= 512000 AND {_SHOWN}
AND NOT (NOT (ends_with({_NAME}, '.example') OR ends_with({_NAME}, '.example.env')) AND ({_NAME} IN ('.env', '.env.local', '.env.production', '.env.staging') OR regexp_matches({_NAME}, '\\.env\\.[^.]+$'))), false) AS indexed FROM manifest""")
def index_filters(spark: SparkSession, d: str) -> DataFrame:
    """Which files of the manifest may be indexed: by extension, size, directory and secrecy."""
    return load(spark, d, "manifest").select("collection", "rel_path", "size", F.coalesce(C.indexable(F.col("rel_path"), F.col("size")), F.lit(False)).alias("indexed"))


def _notes(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "documents").select(F.lit("repos").alias("collection"), F.concat(F.lit("N/d"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("rel_path"), F.col("text").alias("content"))


@query(f"""WITH r AS (SELECT 'N/d' || doc_id || '.txt' AS path, {_redacted("coalesce(text, '')")} AS t FROM documents), c AS (SELECT path, t, unnest(range(greatest(0, CAST(ceil((length(t) - 1200) / 1000.0) AS BIGINT)) + 1)) AS chunk FROM r)
SELECT substr(sha256('repos:' || path || ':' || chunk), 1, 32) AS id, path, chunk::INT AS chunk, md5(substr(t, chunk * 1000 + 1, 1200)) AS text FROM c""")
def index_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Every document as a text file of the index: redacted, cut, numbered, with ids."""
    return C.chunk_files(_notes(spark, d)).select("id", "path", "chunk", F.md5("text").alias("text"))


_HIT = "('0x' || substr(md5(path), 1, 6))::INT"


@query(f"""WITH s AS (SELECT DISTINCT id, collection, path, chunk FROM chunks), f AS (SELECT DISTINCT collection, path FROM s)
SELECT id, collection, path, chunk FROM s WHERE {_HIT} % 5 <> 0 AND {_HIT} % 5 <> 1 UNION ALL SELECT substr(sha256(collection || ':' || path || ':0'), 1, 32), collection, path, 0 FROM f WHERE {_HIT} % 5 = 1""")
def index_replace(spark: SparkSession, d: str) -> DataFrame:
    """The chunk table after a run in which a fifth of the files, by a hash of their path, shrank to one piece and a fifth were removed."""
    stored = load(spark, d, "chunks").select("id", "collection", "path", "chunk").distinct()
    h = F.conv(F.substring(F.md5("path"), 1, 6), 16, 10).cast("int") % 5
    files = stored.select("collection", "path").distinct()
    new = files.where(h == 1).select(T.chunk_id(F.col("collection"), F.col("path"), F.lit(0)).alias("id"), "collection", "path", F.lit(0).alias("chunk"))
    return C.replace_files(stored, new, files.where(h == 0).select("collection", F.col("path").alias("rel_path")))


@query("""WITH n AS (SELECT doc_id, text, CAST((length(text) - length(replace(text, 'must ', ''))) / 5 AS BIGINT) AS n FROM documents),
e AS (SELECT *, CASE WHEN doc_id % 4 = 1 THEN NULL WHEN doc_id % 4 = 2 THEN 'file exists' WHEN n = 0 THEN 'not found' WHEN n > 1 THEN 'matched ' || n || ' times' WHEN doc_id % 4 = 3 THEN 'delete after edit' END AS error FROM n)
SELECT doc_id, CASE WHEN error IS NOT NULL THEN md5(text) WHEN doc_id % 4 = 1 THEN NULL ELSE md5(replace(text, 'must ', 'shall ')) END AS content, error IS NULL AND doc_id % 4 = 1 AS deleted, error FROM e""")
def edits_ordered(spark: SparkSession, d: str) -> DataFrame:
    """Each document under one of four lists of edits: a replacement; a deletion; a creation; a replacement, then a deletion."""
    docs = load(spark, d, "documents").select(F.col("doc_id").cast("string").alias("path"), F.col("text").alias("content"), (F.col("doc_id") % 4).alias("k"))
    none = F.lit(None).cast("string")
    put = lambda n, kind, old, new, body: F.struct(F.lit(n).alias("ord"), F.lit(kind).alias("type"), old.alias("old_str"), new.alias("new_str"), body.alias("content"))
    swap, gone, made = put(1, "replace", F.lit("must "), F.lit("shall "), none), put(2, "delete", none, none, none), put(1, "create", none, none, F.lit("new"))
    todo = F.when(F.col("k") == 0, F.array(swap)).when(F.col("k") == 1, F.array(gone)).when(F.col("k") == 2, F.array(made)).otherwise(F.array(gone, swap))
    x = E.apply_edits(docs.select("path", "content"), docs.select("path", F.explode(todo).alias("e")).select("path", "e.*"))
    return x.select(F.col("path").cast("long").alias("doc_id"), F.md5("content").alias("content"), "deleted", "error")


# --- drift and playbooks -------------------------------------------------------------------------------------------------

_PARTS = rf"""d AS (SELECT DISTINCT split_part(path, '/', 1) AS repo, text FROM chunks WHERE kind IN ('readme', 'doc')), x AS (SELECT DISTINCT split_part(path, '/', 1) AS repo, text FROM chunks WHERE ends_with(path, '/.env.example')),
dk AS (SELECT DISTINCT repo, unnest({_KEYS}) AS ref FROM d), xk AS (SELECT DISTINCT repo, unnest({_KEYS}) AS ref FROM x),
me AS (SELECT repo, ref FROM dk WHERE length(ref) > 4 AND contains(ref, '_') AND ref NOT IN ({", ".join(f"'{k}'" for k in C.NO_ENV_KEYS)}) AND repo IN (SELECT repo FROM x) AND NOT EXISTS (SELECT 1 FROM xk WHERE xk.repo = dk.repo AND xk.ref = dk.ref)
  QUALIFY row_number() OVER (PARTITION BY repo ORDER BY ref) <= 5)"""


def _drift_sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    c = load(spark, d, "chunks").withColumn("repo", F.split("path", "/")[0])
    return c.where("kind IN ('readme', 'doc')").select("repo", "text"), c.select("repo", F.regexp_replace("path", "^[^/]*/", "").alias("rel_path")), c.where("endswith(path, '/.env.example')").select("repo", "text")


@query(f"WITH {_PARTS} SELECT repo, ref, 'readme_env_not_in_example' AS \"check\" FROM me")
def drift_env_missing(spark: SparkSession, d: str) -> DataFrame:
    """Environment keys that documents mention and the example files of their repository lack."""
    readmes, _, examples = _drift_sides(spark, d)
    return C.env_not_in_example(readmes, examples)


_ALL = _PARTS + rf""", mr AS ({{missing}}),
un AS (SELECT coalesce(repos_name, module) AS repo, module AS ref FROM path_map WHERE NOT EXISTS (SELECT 1 FROM chunks WHERE split_part(path, '/', 1) = coalesce(repos_name, module))),
al AS (SELECT repo, ref, 'readme_env_not_in_example' AS c, 'info' AS severity, '{C.SAYS["readme_env_not_in_example"]}' AS say FROM me UNION ALL SELECT repo, ref, 'path_map_missing_repo', 'warning', '{C.SAYS["path_map_missing_repo"]}' FROM un
  UNION ALL SELECT repo, ref, 'readme_missing_path', 'warning', '{C.SAYS["readme_missing_path"]}' FROM mr)"""
_MISSING = ORACLES["drift_missing_refs"]


@query("WITH " + _ALL.replace("{missing}", _MISSING) + """ SELECT substr(sha256('discrepancies:finding_' || substr(md5(repo || say || ref), 1, 12) || '.txt:0'), 1, 32) AS id, repo, 'finding_' || substr(md5(repo || say || ref), 1, 12) || '.txt' AS path, severity, c AS "check", repo || say || ref AS text FROM al""")
def drift_documents(spark: SparkSession, d: str) -> DataFrame:
    """The findings of all drift checks as documents of the index."""
    readmes, files, examples = _drift_sides(spark, d)
    return C.finding_documents(C.drift(readmes, files, examples, load(spark, d, "path_map"))).select("id", "repo", "path", "severity", "check", "text")


_H = r"nullif(regexp_replace(lower(regexp_replace(fingerprint, '\s+', '', 'g')), '^sha256:', ''), '')"


@query(f"""WITH n AS (SELECT {_H} AS fp, arg_max(struct_pack(state := state, tool := tool, module := module, kind := kind, message := message, repos_name := repos_name), delivery_id) AS r FROM incidents WHERE {_H} IS NOT NULL GROUP BY 1),
p AS (SELECT 'playbook_' || substr(fp, 1, 12) || '.md' AS path, r FROM n WHERE r.state IN ('FIXED', 'RESOLVED'))
SELECT substr(sha256('playbooks:' || path || ':0'), 1, 32) AS id, coalesce(r.repos_name, 'unknown') AS repo, path, md5(concat_ws(chr(10), 'state: ' || r.state, 'tool: ' || r.tool, 'module: ' || r.module, 'kind: ' || r.kind, 'message: ' || r.message)) AS text FROM p""")
def playbook_documents(spark: SparkSession, d: str) -> DataFrame:
    """What the newest delivery of each failure says of how it was resolved, as documents of the index."""
    i = load(spark, d, "incidents").withColumn("fingerprint", canonical_hash("fingerprint"))
    return C.playbooks(C.newest(i.select("delivery_id", "fingerprint", "state", "tool", "module", "kind", "message", "repos_name"), F.col("fingerprint"), "delivery_id")).select("id", "repo", "path", F.md5("text").alias("text"))
