import random

from millrace.llm import split as S


def whole(parts):
    return parts[0][0][:parts[0][1]] + "".join(t[p + o:] for t, p, o in parts)


def test_pieces_lose_nothing_and_fit():
    rng = random.Random(1)
    bits = ["word ", "word. ", "\n", "\n\n", "\r\n", "## head\n", "def f():\n", "日本語。", "é", "x" * 60, "👩‍👩", "a, b; "]
    for limit, overlap in ((1200, 200), (100, 20), (50, 49), (10, 0), (7, 30)):
        for n in (0, 1, 5, 60, 700):
            t = ("[Repo: R | README]\n" if rng.random() < .5 else "") + "".join(rng.choice(bits) for _ in range(n))
            parts = S.pieces(t, limit, overlap)
            assert whole(parts) == t and all(len(p) <= limit for p, _, _ in parts), (limit, overlap, n)
            assert all(o <= overlap for _, _, o in parts) and (len(parts) == 1) == (len(t) <= limit)
            for (a, _, _), (b, pre, o) in zip(parts, parts[1:]):
                assert a.endswith(b[pre:pre + o])


def test_cuts_are_natural():
    t = "".join(f"Sentence number {i} of the text. " for i in range(200))
    assert all(p.rstrip().endswith(".") for p, _, _ in S.pieces(t))
    t = "\n\n".join("paragraph " * 20 for _ in range(20))
    assert all(p.endswith("\n\n") for p, _, _ in S.pieces(t)[:-1])
    assert S.pieces(None) == [(None, 0, 0)] and S.pieces("") == [("", 0, 0)]
    assert [len(p) for p, _, _ in S.pieces("x" * 1201, 1200, 0)] == [600, 601]


def test_table(spark):
    rows = [("docs", "a", "R", "R/f.md", 0, "md", "code", "y" * 2500, 1), ("docs", "a", "R", "R/f.md", 0, "md", "code", "y" * 2500, 1), ("docs", "b", "R", "R/f.md", 1, "md", "code", "short", 1), ("docs", "n", "R", "R/f.md", 2, "md", "code", None, 1),
            ("docs", "c", "R", "R/f.md", 5000, "md", "code", "z" * 1300, 1), ("docs", "e", None, "R/g.md", None, None, None, "", 1)]
    df = spark.createDataFrame(rows, "collection string, id string, repo string, path string, chunk int, lang string, kind string, text string, __block int").repartition(3)
    out = S.split_oversized(df).collect()
    f = sorted([r for r in out if r.path == "R/f.md"], key=lambda r: r.chunk)
    assert [r.chunk for r in f] == list(range(len(f))) and [r.source_id for r in f] == ["a"] * f[0].n_pieces + ["b", "n"] + ["c"] * 2
    assert "".join(r.text[r.overlap_len:] for r in f if r.source_id == "a") == "y" * 2500 and all(len(r.text or "") <= 1200 for r in f)
    assert [(r.text, r.chunk) for r in out if r.path == "R/g.md"] == [("", 0)]
    assert sorted(r.id for r in S.oversized_ids(df).collect()) == ["a", "c"]
    assert S.split_oversized(df.limit(0)).count() == 0
