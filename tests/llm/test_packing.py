import random
from collections import defaultdict

import pytest

from millrace.llm import packing as P


def test_sum_of_squares_is_chosen():
    rng, p = random.Random(1), P.Packer(50)
    fill = defaultdict(int)
    for _ in range(3000):
        s = rng.randrange(1, 51)
        n = defaultdict(int)
        for f in fill.values():
            n[f] += f < 50
        cost = lambda h: sum(((n[x] - (x == h > 0) + (x == h + s)) if x < 50 else 0) ** 2 for x in range(1, 51))
        best = min((cost(h), -h) for h in [0, *[x for x in n if n[x] and 0 < x <= 50 - s]])
        box = p.place(s)
        assert (cost(fill[box]), -fill[box]) == best or cost(fill[box]) == best[0]
        fill[box] += s
        assert fill[box] <= 50


def packed(spark, sizes, **kw):
    df = spark.createDataFrame([(i, s, "x") for i, s in enumerate(sizes)], "doc_id long, n_tokens long, id string")
    return P.pack(df.repartition(3), capacity=100, shard_items=200, **kw).collect()


def test_whole_within_capacity_and_tight(spark):
    rng = random.Random(2)
    sizes = [rng.randrange(0, 45) for _ in range(1500)] + [100, 101, 250, 300, 0, 99]
    rows = packed(spark, sizes)
    by_doc, by_box = defaultdict(list), defaultdict(int)
    for r in rows:
        by_doc[r.doc_id].append((r.piece, r.start, r.tokens))
        by_box[r.container] += r.tokens
    for i, s in enumerate(sizes):
        want = [(0, 0, s)] if s <= 100 else [(k, 100 * k, min(100, s - 100 * k)) for k in range(-(-s // 100))]
        assert sorted(by_doc[i]) == want
    assert max(by_box.values()) <= 100 and sum(by_box.values()) == sum(sizes) and 1 - sum(sizes) / (100 * len(by_box)) < .05


def test_texts_and_edges(spark):
    df = spark.createDataFrame([(1, "a b c"), (2, None), (3, ""), (4, "word " * 5000), (1, "a b c"), (5, "x" * 60_000), (6, "日本語 ünï <|endoftext|>")], "doc_id long, text string")
    n = {r.doc_id: r.n_tokens for r in P.token_counts(df).collect()}
    assert n[1] == 3 and n[2] == n[3] == 0 and n[4] > 4000 and n[5] > 0
    rows = P.pack_texts(df).collect()
    assert len([r for r in rows if r.doc_id == 1]) == 2 and sum(r.tokens for r in rows if r.doc_id == 4) == n[4] and max(r.tokens for r in rows) <= P.CAPACITY
    assert P.pack_texts(df.limit(0)).count() == 0
