"""Tables kept in a folder of versions: written beside the current one, then made current by one rename.

A keyed table is cut into buckets by a hash of its keys, and a change writes only the buckets it touches: the version's
pointer, one small file, names the folders that make up each bucket. An append adds folders and rewrites nothing. A
version is read while the next is written, so a change may read the table it replaces; a run that dies leaves the
current version as it was. Folders that neither of the last two versions names are removed.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from millrace.operators import corpus as C

POINTER, BUCKET, WHOLE = "_current", "__bucket", "all"


class Store:
    def __init__(self, spark: SparkSession, path: str, keys: tuple[str, ...] = (), buckets: int = 64):
        self.spark, self.path, self.keys, self.buckets = spark, path.rstrip("/"), tuple(keys), buckets
        self._jpath = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._jpath(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _list(self, path: str) -> list[str]:
        at = self._jpath(path)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def _pointers(self) -> list[str]:
        return [n for n in self._list(self.path) if n.startswith(POINTER)]

    def _version(self, pointer: str) -> dict:
        """What a pointer says: `schema` and, by bucket, `folders`."""
        with_stream = self._fs.open(self._jpath(f"{self.path}/{pointer}"))
        text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(with_stream, "UTF-8")
        with_stream.close()
        return json.loads(text)

    def _now(self) -> dict | None:
        p = self._pointers()
        return self._version(p[-1]) if p else None

    def current(self) -> dict[str, list[str]] | None:
        """Folders of the current version by bucket; None if there is no version."""
        now = self._now()
        return None if now is None else now["folders"]

    def read(self, schema: str | None = None) -> DataFrame:
        """The current version; an empty table of the given schema if there is none."""
        now = self._now()
        if now is None:
            if schema is None:
                raise FileNotFoundError(self.path)
            return self.spark.createDataFrame([], schema)
        return self._read(now, [f for fs in now["folders"].values() for f in fs])

    def _read(self, now: dict, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], T.StructType.fromJson(now["schema"]))
        return self.spark.read.schema(T.StructType.fromJson(now["schema"])).parquet(*[f"{self.path}/{f}" for f in folders])

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _write(self, df: DataFrame) -> dict[str, list[str]]:
        """A new folder's own by bucket. Rows of a bucket are brought together first, so that each is few files."""
        name = f"v-{uuid.uuid4().hex}"
        if not self.keys:
            df.write.mode("errorifexists").parquet(f"{self.path}/{name}")
            return {WHOLE: [name]}
        df.withColumn(BUCKET, self.bucket()).repartition(BUCKET).write.mode("errorifexists").partitionBy(BUCKET).parquet(f"{self.path}/{name}")
        return {n.split("=")[1]: [f"{name}/{n}"] for n in self._list(f"{self.path}/{name}") if n.startswith(BUCKET)}

    def _publish(self, folders: dict[str, list[str]], schema: T.StructType) -> None:
        """Makes a version current by creating one file, which readers see whole or not at all."""
        old = self._pointers()
        number = int(old[-1].split("-")[1]) + 1 if old else 1
        tmp, final = self._jpath(f"{self.path}/.tmp-{uuid.uuid4().hex}"), self._jpath(f"{self.path}/{POINTER}-{number:012d}")
        out = self._fs.create(tmp)
        out.write(bytearray(json.dumps({"schema": schema.jsonValue(), "folders": folders}).encode()))
        out.close()
        if self._fs.exists(final) or not self._fs.rename(tmp, final):
            self._fs.delete(tmp, False)
            raise RuntimeError(f"another writer published version {number} of {self.path}")
        for p in old[:-1]:
            self._fs.delete(self._jpath(f"{self.path}/{p}"), False)
        named = {f for p in [*old[-1:], final.getName()] for fs in self._version(p)["folders"].values() for f in fs}
        for top in self._list(self.path):
            if top.startswith("v-") and top not in named:
                kept = [f for f in named if f.startswith(top + "/")]
                for sub in self._list(f"{self.path}/{top}") if kept else ():
                    if sub.startswith(BUCKET) and f"{top}/{sub}" not in named:
                        self._fs.delete(self._jpath(f"{self.path}/{top}/{sub}"), True)
                if not kept:
                    self._fs.delete(self._jpath(f"{self.path}/{top}"), True)

    def replace(self, df: DataFrame) -> None:
        """Writes the whole table anew."""
        self._publish(self._write(df), df.schema)

    def change(self, touched: DataFrame, apply: Callable[[DataFrame], DataFrame], schema: str | None = None) -> None:
        """What `apply` makes of the stored rows of the buckets that hold the touched keys; other buckets stay as they are.

        touched: the key columns. Without keys the whole table is one bucket.
        """
        if not self.keys:
            return self.replace(apply(self.read(schema)))
        wanted = {str(r[0]) for r in touched.select(self.bucket()).distinct().collect()}  # at most `buckets` numbers
        if not wanted:
            return None
        now = self._now()
        part = self.read(schema) if now is None else self._read(now, [f for b in wanted for f in now["folders"].get(b, [])])
        df = apply(part)
        new, rest = self._write(df), {b: f for b, f in (now["folders"] if now else {}).items() if b not in wanted}
        return self._publish({**rest, **new}, df.schema)

    def upsert(self, new: DataFrame, keys: tuple[str, ...] | None = None) -> None:
        if self.current() is None:
            self.replace(new)
        else:
            self.change(new.select(*self.keys), lambda stored: C.upsert(stored, new, keys or self.keys))

    def append(self, new: DataFrame) -> None:
        """Adds rows; nothing stored is read or written again."""
        now, more = self.current() or {}, self._write(new)
        self._publish({b: now.get(b, []) + more.get(b, []) for b in {**now, **more}}, new.schema)


def index(spark: SparkSession, files: DataFrame, chunks: Store, manifest: Store, repo: str | None = None) -> tuple[int, int]:
    """Incremental indexing: chunks of new and changed files replace the old ones, removed files lose theirs.

    files: collection, rel_path, mtime, size, content. With `repo`, only that repository's files count as removed.
    Returns how many files were indexed and how many removed.
    """
    from millrace.sources import tree

    sig = "collection string, rel_path string, mtime long, size long, hash string"
    now, before = tree.manifest(files), manifest.read(sig)
    todo = C.changed(now, before)
    scope = None if repo is None else (F.split("rel_path", "/")[0] == repo)
    gone = C.removed(now, before, scope=scope)
    n_todo, n_gone = todo.count(), gone.count()
    if not n_todo and not n_gone:
        return 0, 0
    new = C.chunk_files(files.join(todo.select("collection", "rel_path"), ["collection", "rel_path"], "left_semi"))
    if chunks.current() is None:
        chunks.replace(new)
    else:
        paths = todo.select("collection", F.col("rel_path").alias("path")).unionByName(gone.select("collection", F.col("rel_path").alias("path")))
        chunks.change(paths, lambda stored: C.replace_files(stored, new, gone.unionByName(todo.select("collection", "rel_path"))))
    rows, keys = todo.select("collection", "rel_path", "mtime", "size", "hash"), ["collection", "rel_path"]
    if manifest.current() is None:
        manifest.replace(rows)
    else:
        manifest.change(rows.select(*keys).unionByName(gone), lambda stored: C.upsert(stored.join(gone, keys, "left_anti"), rows, ("collection", "rel_path")))
    return n_todo, n_gone
