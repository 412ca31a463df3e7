"""SQL as text: splitting a file into statements, and running only what reads.

Whether a text writes is asked of Spark's own parser: the guard walks the parsed plan instead of looking at the first
word, so a comment or a WITH in front hides nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Parsed nodes of commands that only read.
READING = ("ShowTables", "ShowNamespaces", "ShowColumns", "ShowFunctions", "ShowViews", "ShowCreateTable", "ShowPartitions", "ShowTableProperties", "ShowTableExtended", "DescribeRelation", "DescribeColumn", "DescribeNamespace",
           "DescribeFunction", "DescribeQueryCommand", "ExplainCommand", "ShowCatalogsCommand", "ShowCurrentNamespaceCommand", "ShowTablesCommand", "ShowColumnsCommand", "DescribeTableCommand", "ShowViewsCommand", "DescribeColumnCommand")
#: Commands that change nothing but the session.
SESSION = ("SetCommand", "CreateViewCommand", "CreateTempViewUsing", "SetCatalogAndNamespace", "UncacheTable", "CreateView")
#: Parsed nodes that write or command, by the ends of their class names.
WRITING = ("Command", "Statement", "CreateTable", "CreateTableAsSelect", "ReplaceTable", "ReplaceTableAsSelect", "DropTable", "DropView", "DropNamespace", "CreateNamespace", "DeleteFromTable", "UpdateTable", "MergeIntoTable",
           "TruncateTable", "TruncatePartition", "AlterTable", "AddColumns", "DropColumns", "RenameColumn", "RenameTable", "SetTableProperties", "UnsetTableProperties", "AddPartitions", "DropPartitions", "RecoverPartitions",
           "RepairTable", "LoadData", "CacheTable", "CacheTableAsSelect", "RefreshTable", "RefreshFunction", "AnalyzeTable", "AnalyzeColumn", "CreateFunction", "DropFunction", "Call", "CreateView", "AppendData",
           "OverwriteByExpression", "OverwritePartitionsDynamic", "InsertIntoDir", "CommentOnTable", "CommentOnNamespace", "SetTableLocation", "AlterColumns", "CompoundBody")


def split(text: str) -> list[str]:
    """Statements of a text: cut at semicolons outside quotes and comments, comments dropped, blank ones left out."""
    out, buf, i, n = [], [], 0, len(text)
    while i < n:
        c = text[i]
        if text.startswith("--", i):
            i = text.find("\n", i)
            i = n if i < 0 else i
        elif text.startswith("/*", i) and not text.startswith("/*+", i):
            j = text.find("*/", i + 2)
            i = n if j < 0 else j + 2
            buf.append(" ")
        elif c in "'\"`":
            j = i + 1
            while j < n and text[j] != c:
                j += 2 if text[j] == "\\" and c != "`" else 1
            buf.append(text[i:j + 1])
            i = j + 1
        elif c == ";":
            out.append("".join(buf).strip())
            buf, i = [], i + 1
        else:
            buf.append(c)
            i += 1
    out.append("".join(buf).strip())
    return [s for s in out if s]


def nodes(spark: SparkSession, sql: str) -> list[str]:
    """Class names of all nodes of the parsed plan, subqueries and inner plans included."""
    jvm_plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    out, todo = [], [jvm_plan]
    while todo:
        p = todo.pop()
        out.append(p.getClass().getSimpleName())
        for seq in (p.children(), p.innerChildren(), p.subqueries()):
            it = seq.iterator()
            while it.hasNext():
                x = it.next()
                if hasattr(x, "children") and "plans" in x.getClass().getName() or "execution" in x.getClass().getName():
                    todo.append(x)
    return out


def writes(spark: SparkSession, sql: str, allow_session: bool = False) -> bool:
    """Whether a statement does more than read."""
    allowed = (*READING, *(SESSION if allow_session else ()))
    return any(n not in allowed and any(n == w or n.endswith(("Command", "Statement")) for w in WRITING) for n in nodes(spark, sql))


def run_read_only(spark: SparkSession, sql: str, allow_session: bool = False) -> DataFrame:
    """Runs one statement; PermissionError if it writes."""
    sql = sql.strip().rstrip(";")
    if writes(spark, sql, allow_session):
        raise PermissionError("this statement writes; only reading statements are run here")
    return spark.sql(sql)


def run_file(spark: SparkSession, path: str, index: int | None = None) -> list[DataFrame]:
    """The statements of a file, or the one at `index`, run in order in one session."""
    with open(path, encoding="utf-8", errors="replace") as f:
        found = split(f.read())
    if not found:
        raise ValueError(f"no statements in {path}")
    return [spark.sql(s) for s in (found if index is None else [found[index]])]


def schema_text(spark: SparkSession, most_tables: int = 40, described: int = 5, columns: int = 12, most: int = 2000, wanted: list[str] | None = None) -> str:
    """Table names and the columns of some as a short text."""
    names = [t.name for t in spark.catalog.listTables()][:most_tables]
    lines = ["Tables: " + ", ".join(names)]
    for n in [w for w in (wanted or names) if w in names][:described]:
        lines.append(f"{n}: " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in spark.table(n).schema.fields[:columns]))
    return "\n".join(lines)[:most]
