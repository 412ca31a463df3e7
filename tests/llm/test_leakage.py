import random

import pytest

from millrace.llm import leakage as K

rng = random.Random(4)
VOCAB = [f"{a}{b}" for a in ("ka", "lo", "mi", "nu", "per", "sta", "tre") for b in ("rin", "sol", "tam", "vek", "wun", "dor", "fel", "gim")]
ITEM = [rng.choice(VOCAB) + str(rng.randrange(30)) for _ in range(120)]
OTHER = [rng.choice(VOCAB) for _ in range(300)]
BLOCK = K.Block([([7], " ".join(ITEM)), ([8], "short item of few words"), ([10], "")])


def doc(words, at=150):
    return " ".join(OTHER[:at] + words + OTHER[at:])


def changed(words, every, seed):
    r, out = random.Random(seed), []
    for i, w in enumerate(words):
        if i % every == every // 2:
            k = r.randrange(3)
            out += [["zzz"], [], [w, "zzz"]][k]
        else:
            out.append(w)
    return out


def test_tiles_against_definition():
    assert K.tiles([1, 2, 3, 9, 4, 5], [4, 5, 0, 1, 2, 3]) == [(0, 3, 3), (4, 0, 2)]
    r = random.Random(5)
    for _ in range(60):
        a, b = [r.randrange(5) for _ in range(40)], [r.randrange(5) for _ in range(50)]
        got = K.tiles(a, b, 3)
        assert all(a[i:i + k] == b[j:j + k] and k >= 3 for i, j, k in got)
        left_a, left_b = [1] * 40, [1] * 50
        for i, j, k in got:
            assert all(left_a[i:i + k]) and all(left_b[j:j + k])
            left_a[i:i + k], left_b[j:j + k] = [0] * k, [0] * k
        assert not any(all(left_a[i:i + 3]) and all(left_b[j:j + 3]) and a[i:i + 3] == b[j:j + 3] for i in range(38) for j in range(48))


def test_edits():
    import numpy as np
    d, found = K.edits(np.array([1, 2, 3, 4]), np.array([9, 1, 3, 4, 9]))
    assert d == 1 and found.tolist() == [True, False, True, True]


@pytest.mark.parametrize("n", [25, 30, 60, 120])
def test_whole_and_edited_passages(n):
    part = ITEM[10:10 + n] if n < 110 else ITEM
    assert BLOCK.sure(doc(part)) == [7] and BLOCK.sure(" ".join(part)) == [7]
    hits = sum(BLOCK.sure(doc(changed(part, 9, s))) == [7] for s in range(20))
    assert hits >= (18 if n > 25 else 14)


def test_disguises():
    part = ITEM[20:60]
    t = " ".join(part)
    assert BLOCK.sure(t.upper()) == [7] and BLOCK.sure("<b>" + "</b> **".join(part)) == [7] and BLOCK.sure("​ ".join(part)) == [7] and BLOCK.sure('{"a": "' + "\\n".join(part) + '"}') == [7]
    assert BLOCK.sure(t.replace("a", "á").replace("o", "ö")) == [7] and BLOCK.sure(" | ".join(part)) == [7] and BLOCK.sure(t.replace("k", "\\u006b")) == [7]


def test_no_leaks():
    assert BLOCK.sure(doc([])) == [] and BLOCK.sure(doc(ITEM[10:30])) == [] and BLOCK.sure(doc(ITEM[::2])) == [] and BLOCK.sure(None) == BLOCK.sure("") == []
    common = K.Block([([i], " ".join(ITEM[:12]) + " " + " ".join(f"w{i}x{j}" for j in range(60))) for i in range(4)])
    assert common.sure(" ".join(ITEM[:12] + ["w1x0", "w1x1", "q"] + OTHER)) == []


def test_edited_passages_without_rare_words():
    r = random.Random(6)
    shared = ITEM[:80]
    items = [r.sample(shared, 80) for _ in range(6)]
    block = K.Block([([i], " ".join(w)) for i, w in enumerate(items)])
    assert not any(x.any() for x in block.rare)
    part = items[2][20:45]
    for at in ((5, 11, 18), (4, 9, 14, 19)):
        copy = ["zzz" if i in at else w for i, w in enumerate(part)]
        assert block.sure(doc(copy)) == [2]
    # slots filled anew in phrases of several items: as near to one item as to another
    phrases = [[f"p{i}x{j}" for j in range(5)] for i in range(6)]
    fill = lambda s: [w for i, p in enumerate(phrases) for w in [*p, f"{s}{i}"]]
    block = K.Block([([i], " ".join(fill(f"s{i % 2}v{i}w"))) for i in range(4)])
    assert block.sure(doc(fill("new"))) == []


def test_changes_at_the_ends_and_every_window():
    part = ITEM[10:35]
    for at in ((0, 1), (0, 24), (23, 24), (0, 12, 24), (0, 1, 24)):
        assert BLOCK.sure(doc(["zzz" if i in at else w for i, w in enumerate(part)])) == [7], at
    # words before the passage that match by chance, so that windows too early have as many matches
    early = [*ITEM[8:10], "zzz", *part[1:12], "zzz", *part[13:]]
    early[0], early[1] = ITEM[9], ITEM[8]
    assert BLOCK.sure(doc(early)) == [7]
    assert BLOCK.sure(doc(ITEM[10:31])) == []


def test_table_and_blocks(spark):
    docs = spark.createDataFrame([(1, doc(ITEM[5:60]), "x"), (2, None, "y"), (1, doc(ITEM[5:60]), "x"), (3, "", "z"), (4, doc([]), "")], "doc_id long, text string, item_id string")
    items = spark.createDataFrame([(7, " ".join(ITEM)), (8, None), (9, " ".join(OTHER[:40]))], "item_id long, text string")
    want = [(1, 7), (1, 9), (4, 9)]
    assert sorted(map(tuple, K.find_leaks(docs, items).collect())) == want
    assert sorted(map(tuple, K.find_leaks(docs, items, most=40).collect())) == want
    named = items.selectExpr("concat('item', item_id) AS item_id", "text", "item_id AS doc", "1 AS i")
    assert sorted(map(tuple, K.find_leaks(docs.selectExpr("CAST(doc_id AS int) AS doc_id", "text", "1 AS t"), named).collect())) == [(d, f"item{i}") for d, i in want]
    assert K.find_leaks(docs, items.limit(0)).count() == 0 == K.find_leaks(docs.limit(0), items).count()


def test_blocks_change_nothing(spark):
    """Common instructions, rare words and rivals are asked of all items, however small the blocks."""
    said = ITEM[:14]
    own = [[f"w{i}x{j}" for j in range(60)] for i in range(4)]
    phrases = [[f"p{i}x{j}" for j in range(5)] for i in range(6)]
    fill = lambda s: [w for i, p in enumerate(phrases) for w in [*p, f"{s}{i}"]]
    texts = [said + o for o in own] + [fill(f"s{i % 2}v{i}w") for i in range(4)] + [ITEM[20:80]]
    items = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)] + [(99, " ".join(texts[0]))], "item_id long, text string")
    docs = spark.createDataFrame([(1, doc(said)), (2, doc(own[1][5:40])), (3, doc(fill("new"))), (4, doc(ITEM[25:60])), (5, doc(own[0][:30]))], "doc_id long, text string")
    one = sorted(map(tuple, K.find_leaks(docs, items).collect()))
    assert one == [(2, 1), (4, 8), (5, 0), (5, 99)]
    for most in (100,):
        assert sorted(map(tuple, K.find_leaks(docs, items, most=most).collect())) == one


def test_passages_in_another_order():
    part = ITEM[10:40]
    swapped = part[15:] + part[:15]
    assert BLOCK.sure(doc(swapped)) == [7] and BLOCK.sure(" ".join(swapped)) == [7]
    long = ITEM[10:46]
    assert BLOCK.sure(doc(long[24:] + long[12:24] + long[:12])) == [7]
    assert BLOCK.sure(doc([w for w in part for w in (w, "zzz")])) == []
    assert BLOCK.sure(doc([w for i in range(28, -2, -2) for w in part[i:i + 2]])) == []
    assert BLOCK.sure(doc(part[:12]) + " " + " ".join(OTHER) + " " + " ".join(part[12:])) == []  # far apart: two short quotations


def test_recall_against_edit_distance():
    """Passages of every length with one word in eight changed, dropped or added, at random places."""
    r = random.Random(11)
    for n, most in ((25, 3), (28, 3), (32, 4), (40, 5)):
        hit = 0
        for _ in range(60):
            a = r.randrange(len(ITEM) - n)
            part = ITEM[a:a + n]
            for at in sorted(r.sample(range(n), most), reverse=True):
                part[at:at + 1] = [["zzz"], [], [part[at], "zzz"]][r.randrange(3)]
            hit += BLOCK.sure(doc(part)) == [7]
        assert hit >= 57, (n, most, hit)
