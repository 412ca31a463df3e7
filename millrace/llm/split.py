"""Splitting oversized items at natural boundaries.

An item over the limit is cut by recursive bisection: at the strongest boundary near the midpoint, then again in
each half that still exceeds the limit less the overlap (and less the document prefix every piece repeats); then
each piece but the first is given the end of the one before as overlap. The cores of the pieces joined are the
original text, so nothing is lost.

Defined results: items within the limit come out as one piece, unchanged; a null text stays one piece with null
text, an empty one stays empty; a text without any boundary is cut at its midpoint, though never inside a line
end or before a combining mark; equally strong boundaries are settled by nearness to the midpoint, then by the
earlier; repeated rows come out once; an empty table gives an empty one; columns besides those named are dropped.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

LIMIT, OVERLAP = 1200, 200
PREFIX = r"^\[Repo: [^\n\]]*\]\r?\n"
#: Boundaries by falling strength; the cut is at the end of the match.
BOUNDARIES = tuple(re.compile(p) for p in (
    r"\n(?=#{1,6} |(?:async )?def |class |(?:export |public |private |static )*(?:function|class|interface)\b|(?:CREATE|INSERT|SELECT|UPDATE|DELETE|WITH)\b)",
    r"\n[ \t\r]*\n+",
    r"\n(?=\S)",
    r"\n",
    r"(?:[.!?…]['\")\]”’»]*\s+|[。！？．]['」』）”]*)",
    r"[;:,]\s+|[、，；：]|[;{}](?=\S)",
    r"\s+",
    r"(?<=[^\w\s])(?=\w)",
))


def _safe(text: str, at: int) -> int:
    """The nearest cut at or after `at` that parts neither a line end nor a mark from its letter."""
    while 0 < at < len(text) and (text[at - 1] == "\r" and text[at] == "\n" or unicodedata.combining(text[at]) or text[at] in "‍️" or text[at - 1] == "‍"):
        at += 1
    return at


def boundary(text: str, lo: int, hi: int, aim: int) -> int:
    """Cut position in [lo, hi] at the strongest boundary, nearest to aim; aim itself if there is none."""
    for pattern in BOUNDARIES:
        best = -1
        for m in pattern.finditer(text, max(lo - 80, 0), hi):
            e = m.end()
            if lo <= e <= hi and (best < 0 or abs(e - aim) < abs(best - aim)):
                best = e
        if best >= 0 and _safe(text, best) == best:
            return best
    at = _safe(text, aim)
    return at if lo <= at <= hi else aim


def bisect(text: str, most: int) -> list[str]:
    """Cores of at most `most` code points which joined are the text."""
    todo, out = [text], []
    while todo:
        t = todo.pop()
        n = len(t)
        if n <= most:
            out.append(t)
            continue
        cut = boundary(t, max(1, n // 4), min(n - 1, n - n // 4), n // 2)
        todo += [t[cut:], t[:cut]]
    return out


def pieces(text: str | None, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[str | None, int, int]]:
    """(piece, length of its prefix, length of its overlap), in reading order."""
    if text is None or len(text) <= limit:
        return [(text, 0, 0)]
    m = re.match(PREFIX, text)
    prefix = m.group() if m and m.end() <= limit // 2 else ""
    room = limit - len(prefix)
    overlap = max(0, min(overlap, room // 2))
    cores, out, before = bisect(text[len(prefix):], room - overlap), [], ""
    for core in cores:
        tail = before[-overlap:] if overlap else ""
        if len(tail) > 2 and len(before) > len(tail):  # start the overlap at a boundary of its first half
            tail = tail[boundary(tail, 0, len(tail) // 2, 0):]
        out.append((prefix + tail + core, len(prefix), len(tail)))
        before = core
    return out


def _cutter(limit: int, overlap: int) -> Callable[[Column], Column]:
    @F.pandas_udf("array<struct<text:string,prefix_len:int,overlap_len:int>>")
    def cut(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else [{"text": a, "prefix_len": b, "overlap_len": c} for a, b, c in pieces(t, limit, overlap)] for t in texts])

    return lambda text: cut(F.when(F.length(text) > limit, text))  # only texts over the limit travel to Python


def split_oversized(df: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP, file_cols: tuple[str, ...] = ("collection", "path"),
                    index_col: str = "chunk", id_col: str = "id", text_col: str = "text", keep: tuple[str, ...] = ("repo", "kind", "lang")) -> DataFrame:
    """Every item of the table as pieces within the limit, numbered anew from 0 within the file.

    Columns: the file's, `source_id`, those kept, `source_chunk`, `piece`, `n_pieces`, `prefix_len`, `overlap_len`,
    `text` and the new `chunk`. The numbering is a prefix sum on two levels (blocks of 1,024 source indices, then rows
    within a block), so no file, however large, is one window. Texts are shuffled once, by file and block; the sums of
    the blocks are taken from counts and hashes alone.
    """
    cut = _cutter(limit, overlap)
    cols = dict.fromkeys((*file_cols, *keep))
    file = F.struct(*[F.col(f"`{c}`") for c in file_cols])  # a struct is never null, its nulls are equal
    block = F.floor(F.coalesce(F.col("source_chunk"), F.lit(0)) / 1024)
    whole = F.array(F.struct(F.col("__text").alias("text"), F.lit(0).alias("prefix_len"), F.lit(0).alias("overlap_len")))
    rows = (df.select(*[F.col(f"`{c}`") for c in cols], F.col(id_col).alias("source_id"), F.col(index_col).alias("source_chunk"), F.col(text_col).alias("__text"))
            .withColumn("__key", F.struct(file.alias("f"), block.alias("b"))).withColumn("__pieces", F.coalesce(cut(F.col("__text")), whole)).withColumn("n_pieces", F.size("__pieces")))
    own = ["__key", "source_id", "source_chunk"]
    sizes = rows.select(*own, F.md5("__text").alias("__h"), "n_pieces").distinct().groupBy("__key").agg(F.sum("n_pieces").alias("n"))
    by_block = Window.partitionBy("__key.f").orderBy("__key.b").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("__key", F.coalesce(F.sum("n").over(by_block), F.lit(0)).alias("__start"))
    within = Window.partitionBy("__key").orderBy(F.col("source_chunk").asc_nulls_first(), "source_id", "__pieces")
    same = F.lag(F.struct("source_chunk", "source_id", "__pieces")).over(within) == F.struct("source_chunk", "source_id", "__pieces")
    once = rows.drop("__text").withColumn("__again", F.coalesce(same, F.lit(False))).where(~F.col("__again"))
    placed = once.withColumn("__before", F.coalesce(F.sum("n_pieces").over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).join(starts, "__key")
    return placed.select(*cols, "source_id", "source_chunk", "n_pieces", "__start", "__before", F.posexplode("__pieces").alias("piece", "__p")).select(
        *cols, "source_id", "source_chunk", "piece", "n_pieces", "__p.prefix_len", "__p.overlap_len", "__p.text",
        (F.col("__start") + F.col("__before") + F.col("piece")).alias("chunk"))


def oversized_ids(df: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """Ids of the items that come out of the splitter in more than one piece; nothing but ids is shuffled."""
    n = F.size(_cutter(limit, overlap)(F.col(text_col)))
    return df.where(F.length(text_col) > limit).withColumn("__n", n).where("__n > 1").select(F.col(id_col).alias("id")).distinct()
