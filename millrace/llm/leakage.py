"""Evaluation texts leaking into a corpus: which documents hold passages of which test items.

Both sides are reduced to words that ignore case, punctuation, accents, layout, markup and escapes. Documents are
joined to items on shared seeds, runs of SEED words; a stretch of a document goes on with an item only where enough
of the seeds of LEAST successive item words lie in it, in whatever order. The item is then held against the stretch
by greedy string tiling: the longest non-overlapping matches are marked first, found by running Karp-Rabin hashes of
falling length. A pair is a leak if the tiles cover nearly all of LEAST successive item words, and either

* an exact check finds no more than about one changed, dropped or added word in EIGHTH between those words and the
  document, or
* the tiles are blocks of at least MOVED words that stand close together in another order, and what is not covered
  and the number of breaks in the order together stay within the same bound.

Runs of COMMON_RUN words found in COMMON_ITEMS items or more, such as instructions, match nothing. What differs in
more than a tenth of its words or in their order, and in most of the words that few items have, may only be made from
the same phrases: it is refused if other items hold the stretch about equally well. Common runs, words that few items
have and such rivals are asked of all items, however they fall into blocks.

The items are a stated set: they are packed into blocks of at most BLOCK_WORDS words, and each block is sent to the
executors once and held against all documents; several blocks mean several passes, one after the other, never a larger
broadcast.

Defined results: null and empty texts have no leak; items shorter than LEAST words cannot leak; items of one text
leak together, and count once where items are counted; each pair of ids comes out once, however often it occurs; very
long texts are read whole.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from millrace.operators.blocks import each_block
from millrace.session import cut_lineage

LEAST, EIGHTH = 25, 8
SEED = 4
EDITS = -(-LEAST // EIGHTH)  # words of LEAST that may be changed, dropped or added
#: Seeds of a passage of LEAST words that are left at least: EDITS + 1 runs hold them.
FEWEST_SEEDS = LEAST - EDITS - (EDITS + 1) * (SEED - 1)
TILED = LEAST - EDITS - 2  # words of LEAST that tiles must cover; single words between two edits make no tile
INNER = LEAST - LEAST // EIGHTH  # words of LEAST from the first found to the last; what is changed may lie at the ends
SLACK = 6  # words added or dropped within a passage
LONGEST = -(-(LEAST - EDITS) // (EDITS + 1))  # words of the longest of the runs that EDITS leave of LEAST words, at least
MOVED = 8  # words of a block that stands in another place than in the item
STRETCH = 2 * LEAST  # words of a document that hold LEAST moved words at most
BAND = 2 * STRETCH  # words of a document looked at together; two ways of cutting, so that no stretch is cut in both
SHORTEST_TILE = 2
COMMON_RUN, COMMON_ITEMS, RARE_ITEMS = 11, 3, 2
RIVAL = 9  # edits by which other items must be further from a stretch that lacks the words few items have; EDITS if there are none
BLOCK_WORDS = 2_000_000
BASE = np.uint64(0x9E3779B97F4A7C15)

ESCAPES = re.compile(r"\\u([0-9a-fA-F]{4})|\\x([0-9a-fA-F]{2})|\\([nrtbf])|\\(.)", re.S)
MARKUP = re.compile(r"<!--(?:[^-]|-(?!->))*+-->|</?[A-Za-z][^<>]*+>|\]\([^()\s]*\)|[|]|(?<=[^\W\d_])[—/](?=[^\W\d_])", re.S)
HYPHENED = re.compile(r"[-‐‑\xad]\s*\n\s*(?=[^\W\d_])")
CJK = re.compile(r"([぀-ヿ㐀-䶿一-鿿가-힯])")
JUNK = re.compile(r"[^\w\s]+|_+")
MARKUP_SIGNS, HYPHENS = ("<", "](", "|", "/", "—"), "-‐‑\xad"  # without one of them there is nothing to replace
ASCII_JUNK = {c: None for c in range(128) if not (chr(c).isalnum() or chr(c).isspace())}  # what JUNK finds in ASCII
MARKS = re.compile("[\u0300-\u036f\u0483-\u0489\u0591-\u05bd\u064b-\u065f\u1ab0-\u1aff\u1dc0-\u1dff\u20d0-\u20ff\u3099\u309a\ufe20-\ufe2f]+")  # combining marks
SPELLED = re.compile("[œæøłđðþı]")
PLAIN = str.maketrans({"œ": "oe", "æ": "ae", "ø": "o", "ł": "l", "đ": "d", "ð": "d", "þ": "th", "ı": "i"})


def _unescape(m: re.Match) -> str:
    code = m.group(1) or m.group(2)
    if code:
        return chr(int(code, 16))
    return " " if m.group(3) else m.group(4)


def words(text: str | None) -> list[str]:
    """The words of a text, bare of case, punctuation, accents, layout, markup and escapes."""
    if not text:
        return []
    if "\\" in text:
        text = ESCAPES.sub(_unescape, text)
    if "&" in text:
        text = html.unescape(text)
    if not text.isascii():
        text = unicodedata.normalize("NFKD", text.casefold())
        text = MARKS.sub("", text)
        if SPELLED.search(text):
            text = text.translate(PLAIN)
        text = CJK.sub(r" \1 ", text)
    else:
        text = text.lower()
    if any(c in text for c in MARKUP_SIGNS):
        text = MARKUP.sub(" ", text)
    if any(c in text for c in HYPHENS):
        text = HYPHENED.sub("", text)
    return (text.translate(ASCII_JUNK) if text.isascii() else JUNK.sub("", text)).split()


def _hashes(ids: np.ndarray, n: int) -> np.ndarray:
    """Polynomial hashes of every run of n ids."""
    if len(ids) < n:
        return np.zeros(0, np.uint64)
    h = np.zeros(len(ids) - n + 1, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            h = h * BASE + ids[k:len(ids) - n + 1 + k].astype(np.uint64)
    return h


def tiles(a: list[int], b: list[int], shortest: int = SHORTEST_TILE, start: int = 16) -> list[tuple[int, int, int]]:
    """Greedy string tiling of two word lists by running Karp-Rabin hashes: (start in a, start in b, length).

    At each search length, from `start` halving down to `shortest`, all maximal matches of unmarked words are found
    and marked from the longest to the shortest, earlier ones first; a marked word is never used again.
    """
    out: list[tuple[int, int, int]] = []
    both = {*a} & {*b}
    free_a, free_b = bytearray(w in both for w in a), bytearray(w in both for w in b)
    mod, base = (1 << 61) - 1, 1_000_003

    def runs(x: list[int], free: bytearray, n: int) -> Iterator[tuple[int, int]]:
        """(position, rolling hash) of every unmarked run of n words."""
        top, h, length = pow(base, n - 1, mod), 0, 0
        for i, w in enumerate(x):
            if not free[i]:
                h = length = 0
                continue
            if length == n:
                h = (h - (x[i - n] + 1) * top) % mod
                length -= 1
            h = (h * base + w + 1) % mod
            length += 1
            if length == n:
                yield i - n + 1, h

    n = max(start, shortest)
    while True:
        table: dict[int, list[int]] = {}
        for i, h in runs(a, free_a, n):
            table.setdefault(h, []).append(i)
        found: list[tuple[int, int, int]] = []
        for j, h in runs(b, free_b, n):
            for i in table.get(h, ()):
                if i and j and free_a[i - 1] and free_b[j - 1] and a[i - 1] == b[j - 1]:
                    continue  # part of a longer match
                k = 0
                while i + k < len(a) and j + k < len(b) and free_a[i + k] and free_b[j + k] and a[i + k] == b[j + k]:
                    k += 1
                if k >= n:
                    found.append((-k, i, j))
        again = False
        for k, i, j in sorted(found):
            k = -k
            if all(free_a[i:i + k]) and all(free_b[j:j + k]):
                free_a[i:i + k] = free_b[j:j + k] = bytes(k)
                out.append((i, j, k))
            else:
                again = True  # what is left of an overlapped match may still be long enough
        if again:
            continue
        if n == shortest:
            return out
        n = max(shortest, n // 2)


def edits(item: np.ndarray, doc: np.ndarray) -> tuple[int, np.ndarray]:
    """Least number of changed, dropped or added words between the item words and any stretch of the document.

    Also tells which item words are found in the best such stretch.
    """
    return align(item, doc)[:2]


def align(item: np.ndarray, doc: np.ndarray) -> tuple[int, np.ndarray, slice]:
    """The result of `edits`, and where the best stretch of the document lies."""
    n, m = len(item), len(doc)
    d = np.zeros((n + 1, m + 1), np.int64)
    d[:, 0] = np.arange(n + 1)
    step = np.arange(m + 1)
    for i in range(1, n + 1):
        row = np.empty(m + 1, np.int64)
        row[0] = i
        row[1:] = np.minimum(d[i - 1, :-1] + (doc != item[i - 1]), d[i - 1, 1:] + 1)
        d[i] = np.minimum.accumulate(row - step) + step
    j = end = int(d[n].argmin())
    least, found, i = int(d[n, j]), np.zeros(n, bool), n
    while i and j:
        same = doc[j - 1] == item[i - 1]
        if d[i, j] == d[i - 1, j - 1] + (not same):
            found[i - 1] = same
            i, j = i - 1, j - 1
        elif d[i, j] == d[i - 1, j] + 1:
            i -= 1
        else:
            j -= 1
    return least, found, slice(j, end)


def extent(found: np.ndarray) -> int:
    """Length of the passage from its first word found to its last, stray single words at either end left off."""
    at = np.flatnonzero(found).tolist()
    while len(at) > 1 and at[1] - at[0] > 2:
        at.pop(0)
    while len(at) > 1 and at[-1] - at[-2] > 2:
        at.pop()
    return at[-1] - at[0] + 1 if at else 0


def moved(found: list[tuple[int, int, int]], at: int) -> tuple[int, np.ndarray, slice] | None:
    """The result of `align` for the LEAST item words from `at`, their blocks in any order: None if they do not hold together.

    Only tiles of MOVED words or more count; each place where the order of the blocks breaks counts as an edit.
    """
    parts = sorted((j + max(0, at - i), max(i, at), min(i + k, at + LEAST)) for i, j, k in found if min(i + k, at + LEAST) - max(i, at) >= MOVED)
    if len(parts) < 2 or parts[-1][0] + parts[-1][2] - parts[-1][1] - parts[0][0] > STRETCH:
        return None
    same = np.zeros(LEAST, bool)
    for _, a, b in parts:
        same[a - at:b - at] = True
    breaks = sum(y[1] < x[2] for x, y in zip(parts, parts[1:]))
    return int(LEAST - same.sum()) + breaks, same, slice(parts[0][0], parts[-1][0] + parts[-1][2] - parts[-1][1])


class Doubt(NamedTuple):
    """A stretch of a document that is a leak unless an item of another text than `part` is within `most` edits of it."""

    stretch: list[str]
    part: list[str]
    most: int


class Place(NamedTuple):
    """Document words from lo to hi that share seeds with item words from first to last."""

    lo: int
    hi: int
    first: int
    last: int
    diagonal: int | None = None  # middle of those the seeds lie on, if they are in order
    within: int = 0  # how far from it equal words may lie


class Block:
    """Distinct item texts with their seeds, sorted by hash, each with the item and the position it stands for.

    common: the hashes of COMMON_RUN words found in COMMON_ITEMS items or more; frequent: those of words found in more
    than RARE_ITEMS. Both are counted over all items; if not given, the block holds all there are.
    """

    def __init__(self, items: list[tuple[list[int], str]], common: set[int] | None = None, frequent: set[int] | None = None):
        self.ids = [i for i, _ in items]
        self.vocabulary: dict[str, int] = {}
        self.words: list[str] = ["\0"]  # what is masked
        read = [words(t) for _, t in items]
        for w in read:
            for x in w:
                if x not in self.vocabulary:
                    self.vocabulary[x] = len(self.words)
                    self.words.append(x)
        self.items = [np.array([self.vocabulary[x] for x in w], np.int64) for w in read]
        if common is None:
            seen: dict[str, dict[int, int]] = {"run": {}, "word": {}}
            for w in read:
                for kind, h in features(w):
                    seen[kind][h] = seen[kind].get(h, 0) + 1
            common = {h for h, n in seen["run"].items() if n >= COMMON_ITEMS}
            frequent = {h for h, n in seen["word"].items() if n > RARE_ITEMS}
        self.rare = [np.array([word_hash(x) not in frequent for x in w], bool) for w in read]
        self.all = np.concatenate([np.append(w, 0) for w in self.items]) if self.items else np.zeros(0, np.int64)  # 0 ends an item
        self.owner = np.repeat(np.arange(len(self.items)), [len(w) + 1 for w in self.items])
        h, who, pos = [], [], []
        for k, (w, said) in enumerate(zip(self.items, read)):
            masked = np.zeros(len(w), bool)
            for j, run in enumerate(run_hashes(said)):
                if run in common:
                    masked[j:j + COMMON_RUN] = True
            w[masked] = 0  # equals no word of a document
            x = _hashes(w, SEED)
            whole = np.flatnonzero(np.convolve(masked, np.ones(SEED, int))[SEED - 1:len(w)] == 0) if len(x) else np.zeros(0, np.int64)
            h.append(x[whole]), who.append(np.full(len(whole), k, np.int64)), pos.append(whole)
        h, who, pos = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (h, who, pos))
        order = np.argsort(h, kind="stable")
        self.h, first, self.n = np.unique(h[order], return_index=True, return_counts=True)
        self.first, self.who, self.pos = first, who[order], pos[order]

    def rival(self, doubt: Doubt) -> bool:
        """Whether an item of the block has a passage that near the stretch and does not hold the part itself."""
        stretch = np.array([self.vocabulary.get(x, -1) for x in doubt.stretch], np.int64)
        part = np.array([self.vocabulary.get(x, -1) for x in doubt.part], np.int64)
        size = np.bincount(self.owner[np.isin(self.all, stretch[stretch > 0])], minlength=len(self.items))
        near = np.flatnonzero(size >= len(stretch) - doubt.most)  # fewer equal words cannot be within
        for k in near[np.argsort(-size[near], kind="stable")]:
            w = self.all[slice(*np.searchsorted(self.owner, (k, k + 1)))]
            if edits(stretch, w)[0] <= doubt.most and edits(part, w)[0] > LEAST // 10:
                return True
        return False

    def stretches(self, ids: np.ndarray) -> dict[int, list[Place]]:
        """By item, the places where enough seeds of LEAST successive item words lie together."""
        near: dict[int, list[Place]] = {}
        h = _hashes(ids, SEED)
        if not len(self.h) or not len(h):
            return near
        at = np.searchsorted(self.h, h)
        at[at == len(self.h)] = 0
        hit = np.flatnonzero(self.h[at] == h)
        if len(hit) < FEWEST_SEEDS:
            return near
        rep = self.n[at[hit]]
        where = np.repeat(hit, rep)
        post = np.repeat(self.first[at[hit]], rep) + np.arange(len(where)) - np.repeat(np.cumsum(rep) - rep, rep)
        who, pos = self.who[post], self.pos[post]
        diagonal, m = where - pos + (1 << 22), FEWEST_SEEDS - 1
        bands: dict[int, list[tuple[int, int, int]]] = {}
        for shift in (0, SLACK):  # in order: enough seeds on diagonals within 2 * SLACK; two ways of cutting, so that no passage is cut in both
            key = (who << 24) | ((diagonal + shift) // (2 * SLACK))
            k, p = _in_order(key, pos)
            found = np.flatnonzero((k[m:] == k[:-m]) & (p[m:] - p[:-m] <= LEAST - SEED)) if len(k) > m else ()
            for x, lo, hi in _spans(k, p, found, m):
                d = (x & (1 << 24) - 1) * 2 * SLACK - shift - (1 << 22)
                bands.setdefault(x >> 24, []).append((d, lo, hi))
        for x, found in bands.items():  # neighbours are looked at together
            found.sort()
            d0, d1, lo, hi = *found[0][:1] * 2, *found[0][1:]
            for d, a, b in [*found[1:], (1 << 40, 0, 0)]:
                if d - d1 <= 2 * SLACK and a <= hi + LEAST and b >= lo - LEAST:
                    d1, lo, hi = d, min(lo, a), max(hi, b)
                    continue
                first, last = max(0, lo - LEAST), hi + SEED + LEAST
                near.setdefault(x, []).append(Place(max(0, first + d0 - SLACK), max(0, last + d1 + 3 * SLACK), first, last, (d0 + d1) // 2 + SLACK, (d1 - d0 + 1) // 2 + 2 * SLACK))
                d0 = d1 = d
                lo, hi = a, b
        code = np.sort((who << 48) | (diagonal << 24) | pos)
        m = MOVED - SEED
        runs = code[:-m][code[m:] - code[:-m] == m]  # blocks of MOVED words
        if len(runs) > 1 and ((runs[1:] >> 48 == runs[:-1] >> 48) & (runs[1:] >> 24 != runs[:-1] >> 24)).any():
            who, d, pos = runs >> 48, (runs >> 24) & (1 << 24) - 1, runs & (1 << 24) - 1
            for shift in (0, BAND // 2):  # moved: such blocks on several diagonals, close together in the document
                key = (who << 24) | ((d - (1 << 22) + pos + shift) // BAND)
                order = np.lexsort((d, key))
                k = key[order]
                found = np.flatnonzero((k[1:] == k[:-1]) & (np.diff(d[order]) != 0))
                for x, lo, hi in _spans(k, pos[order], found, 1, whole=True):
                    start = (x & (1 << 24) - 1) * BAND - shift
                    near.setdefault(x >> 24, []).append(Place(max(0, start - LEAST), start + BAND + LEAST, max(0, lo - LEAST), hi + MOVED + LEAST))
        return near

    def leaked(self, k: int, ids: np.ndarray, said: list[str], places: list[Place]) -> list[Doubt] | None:
        """What speaks for a leak of the k-th item: None if it is one for sure, else the stretches that may be one."""
        doubts: list[Doubt] = []
        for lo, hi, first, last, diagonal, within in places:
            part, doc = self.items[k][first:last], ids[lo:hi]
            if len(part) < LEAST:
                continue
            equal = np.isin(part, doc[doc > 0]) if diagonal is None else _about(part, doc, diagonal + first - lo, within)
            if _counts(equal).max() < LEAST - EDITS:
                continue
            found = tiles(part.tolist(), doc.tolist())
            same = np.zeros(len(part), bool)
            for i, _, n in found:
                same[i:i + n] = True
            covered = _counts(same)
            # edits leave a run of LONGEST words: equal words of each window about the diagonals of such tiles
            diagonals = sorted({j - i for i, j, n in found if n >= LONGEST})
            near = np.array([_counts(_about(part, doc, d)) for d in diagonals] or [0 * covered])
            total = near.max(0)
            at = np.flatnonzero(covered >= TILED)
            for a in at[np.argsort(-total[at], kind="stable")].tolist():  # the likeliest first, since one will do
                least, equal, stretch, order = LEAST, same[:0], slice(0), True
                if total[a] >= LEAST - EDITS:
                    start = max(0, a + diagonals[int(near[:, a].argmax())] - SLACK)
                    least, equal, stretch = align(part[a:a + LEAST], doc[start:start + LEAST + 2 * SLACK])
                    stretch = slice(start + stretch.start, start + stretch.stop)
                if least > EDITS or extent(equal) < INNER:
                    if (other := moved(found, a)) is None or other[0] > EDITS:
                        continue
                    (least, equal, stretch), order = other, False
                few = self.rare[k][first + a:first + a + LEAST]
                if order and least * 10 <= LEAST or equal[few].sum() * 2 >= few.sum() > 0:
                    return None
                doubts.append(Doubt(said[lo:hi][stretch], [self.words[x] for x in part[a:a + LEAST]], least + (RIVAL if few.any() else EDITS) - 1))
        return doubts

    def leaks(self, text: str | None) -> Iterator[tuple[list[int], list[Doubt] | None]]:
        """(ids of an item, None or its doubts) of the items that may have leaked into a text."""
        said = words(text)
        ids = np.array([self.vocabulary.get(w, -1) for w in said], np.int64)  # unknown words equal nothing
        for k, places in self.stretches(ids).items():
            doubts = self.leaked(k, ids, said, places)
            if doubts is None or doubts:
                yield self.ids[k], doubts

    def sure(self, text: str | None) -> list[int]:
        """Ids of the items that leaked into a text, if the block holds all items."""
        return [i for ids, doubts in self.leaks(text) if doubts is None or not all(map(self.rival, doubts)) for i in ids]


def _in_order(key: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs of key and position, sorted by both: as one number where they fit into it."""
    if len(key) and int(key.max()) < 1 << 42 and int(pos.max()) < 1 << 21:
        both = np.sort((key << 21) | pos)
        both = both[np.concatenate([[True], both[1:] != both[:-1]])]
        return both >> 21, both & (1 << 21) - 1
    order = np.lexsort((pos, key))
    key, pos = key[order], pos[order]
    once = np.concatenate([[True], (key[1:] != key[:-1]) | (pos[1:] != pos[:-1])]) if len(key) else np.zeros(0, bool)
    return key[once], pos[once]


def _spans(key: np.ndarray, pos: np.ndarray, found: np.ndarray, m: int, whole: bool = False) -> Iterator[tuple[int, int, int]]:
    """(key, first position, last position) of each key with findings: over what was found, or over all the key has."""
    if not len(found):
        return
    if whole:
        all_ = np.flatnonzero(np.isin(key, key[found]))
        k, a, b = key[all_], pos[all_], pos[all_]
    else:
        k, a, b = key[found], pos[found], pos[found + m]
    first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
    yield from zip(k[first].tolist(), np.minimum.reduceat(a, first).tolist(), np.maximum.reduceat(b, first).tolist())


def _counts(same: np.ndarray) -> np.ndarray:
    """True values in every window of LEAST."""
    total = np.concatenate([[0], np.cumsum(same)])
    return total[LEAST:] - total[:-LEAST]


def _about(item: np.ndarray, doc: np.ndarray, diagonal: int, within: int = SLACK) -> np.ndarray:
    """Which item words have their equal in the document within so many words of a diagonal."""
    padded = np.full(len(item) + 2 * within, -1, np.int64)
    lo, hi = max(0, diagonal - within), min(len(doc), diagonal + within + len(item))
    if lo < hi:
        padded[lo - diagonal + within:hi - diagonal + within] = doc[lo:hi]
    if len(item) <= len(STEPS) and 2 * within < STEPS.shape[1]:
        return (padded[STEPS[:len(item), :2 * within + 1]] == item[:, None]).any(1)
    return (padded[np.arange(len(item))[:, None] + np.arange(2 * within + 1)] == item[:, None]).any(1)


STEPS = np.arange(512)[:, None] + np.arange(64)


def word_hash(w: str) -> int:
    return xxhash.xxh3_64_intdigest(w) - (1 << 63)


def run_hashes(said: list[str]) -> list[int]:
    """Hashes of every run of COMMON_RUN words."""
    return [word_hash(" ".join(said[j:j + COMMON_RUN])) for j in range(len(said) - COMMON_RUN + 1)]


def features(said: list[str]) -> set[tuple[str, int]]:
    """The distinct runs and words of an item."""
    return {("run", h) for h in run_hashes(said)} | {("word", word_hash(w)) for w in {*said}}


def blocks(items: DataFrame, id_col: str, text_col: str, most: int = BLOCK_WORDS) -> Iterator[Block]:
    """The items in blocks of about `most` words at most, fetched one after the other; equal texts are one item.

    A text's block is told by its hash. What is common to several items is counted over all of them by the executors.
    """
    spark = items.sparkSession
    src = items.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).where(F.length("t") > 0)
    n = -(-int(src.agg(F.sum(F.length("t") / 4 + 1)).first()[0] or 0) // most)
    if not n:
        return
    texts = src.groupBy("t").agg(F.collect_set("i").alias("ids")).withColumn("b", F.pmod(F.xxhash64("t"), F.lit(n)))
    if n == 1:
        yield Block([(r.ids, r.t) for r in texts.toLocalIterator()])
        return

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, kind, h = [], [], []
            for i, t in enumerate(b.column(1).to_pylist()):
                for x, y in features(words(t)):
                    at.append(i), kind.append(x), h.append(y)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int32())), pa.array(kind, pa.string()), pa.array(h, pa.int64())], names=["b", "kind", "h"])

    held = texts.select("b", "t").mapInArrow(run, "b long, kind string, h long").groupBy("kind", "h", "b").agg(F.count(F.lit(1)).alias("n"))
    held = held.groupBy("kind", "h").agg(F.sum("n").alias("n"), F.collect_list("b").alias("bs")).where(f"kind = 'run' AND n >= {COMMON_ITEMS} OR kind = 'word' AND n > {RARE_ITEMS}")
    held = cut_lineage(held.select("kind", "h", F.explode("bs").alias("b")))
    for k in range(n):
        part = [(r.ids, r.t) for r in texts.where(F.col("b") == k).toLocalIterator()]
        if part:
            shared: dict[str, set[int]] = {"run": set(), "word": set()}
            for r in held.where(F.col("b") == k).toLocalIterator():
                shared[r.kind].add(r.h)
            yield Block(part, shared["run"], shared["word"])


def find_leaks(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", doc_text: str = "text", item_text: str = "text", most: int = BLOCK_WORDS) -> DataFrame:
    """(doc_id, item_id) of every leak, each pair once."""
    spark = docs.sparkSession
    pair = f"doc {dict(docs.dtypes)[doc_id]}, item {dict(items.dtypes)[item_id]}"
    doubt = f"{pair}, stretch array<string>, part array<string>, most int"
    types = [to_arrow_type(items.schema[item_id].dataType), pa.list_(pa.string()), pa.list_(pa.string()), pa.int32()]
    src = docs.select(F.col(doc_id).alias("doc"), F.col(doc_text).alias("t")).where(F.length("t") > 0)
    alone = [True]

    def parts() -> Iterator[Block]:
        for i, b in enumerate(blocks(items, item_id, item_text, most)):
            alone[0] = alone[0] and i == 0
            yield b

    def apply(sent: Broadcast) -> DataFrame:
        whole = alone[0]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            b = sent.value
            for batch in batches:
                rows: list[tuple] = []
                known: dict[str, list[tuple]] = {}  # copies in a batch are judged once
                for i, t in enumerate(batch.column(1).to_pylist()):
                    if (got := known.get(t)) is None:
                        if whole:
                            got = [(x, None, None, None) for x in b.sure(t)]
                        else:
                            got = [(x, *(d or (None, None, None))) for ids, doubts in b.leaks(t) for x in ids for d in (doubts or [None])]
                        known[t] = got
                    rows += [(i, *x) for x in got]
                cols = list(zip(*rows)) or [()] * 5
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(cols[0], pa.int32())), *[pa.array(c, t) for c, t in zip(cols[1:], types)]],
                                                 names=["doc", "item", "stretch", "part", "most"])

        return src.mapInArrow(run, doubt)

    found = each_block(spark, parts(), apply)
    if found is None:
        found = spark.createDataFrame([], doubt)
    sure = found.where("most IS NULL").select("doc", "item")
    if not alone[0]:  # what is in doubt is asked of every block
        doubts = found.where("most IS NOT NULL")

        def against(sent: Broadcast) -> DataFrame:
            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                b = sent.value
                for batch in batches:
                    rows = zip(*(c.to_pylist() for c in batch.columns))
                    yield batch.filter(pa.array([b.rival(Doubt(*r)) for r in rows], pa.bool_()))

            return doubts.select("stretch", "part", "most").distinct().mapInArrow(run, "stretch array<string>, part array<string>, most int")

        refused = each_block(spark, blocks(items, item_id, item_text, most), against)
        sure = sure.unionByName(doubts.join(refused, ["stretch", "part", "most"], "left_anti").select("doc", "item"))
    return sure.distinct().select(F.col("doc").alias(doc_id), F.col("item").alias(item_id))
