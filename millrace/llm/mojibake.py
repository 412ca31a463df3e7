"""Text garbled by a wrong character decoding: find it, name the chain of encodings, undo it.

A multinomial (softmax) classifier on hashed byte bigrams is fitted on records garbled on purpose: a bounded sample
of clean lines (SAMPLE_LINES, of at most LINE_CHARS code points, in the order of their hash) is put through every
chain of CHAINS; the features are the bigrams of the UTF-8 bytes of what is not ASCII, with one neighbour on each
side. A line's chains are tried from the most probable down to clean; one is inverted and counts only if every step
decodes strictly (chains that lose bytes have no inverse and are reported as not recoverable). Lines read as clean
whose non-ASCII runs partly decode strictly as UTF-8 are judged a second time by those runs alone, so that a garbled
word among clean ones is not outvoted. A sequence that stands alone between quotation marks is a quoted example and is left.

Defined results: null, empty and ASCII texts are clean; equal scores go to the earlier chain, clean first; text no
chain inverts stays as it is; repeated rows give repeated results; an empty or wholly ASCII table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

SAMPLE_LINES = 6000
LINE_CHARS = 2000
BUCKETS = 1 << 14
EPOCHS, BATCH, RATE, CLEAN_COPIES = 3, 256, 0.5, 4
#: Each chain lists its steps: what the bytes were, what they were taken for. "lossy" has no inverse.
CHAINS: tuple[tuple[tuple[str, str], ...], ...] = (
    (),
    *(((("utf-8", w),)) for w in ("cp1252", "latin-1", "mac_roman", "cp437", "cp850", "cp1251", "cp1250", "iso8859-2", "koi8-r", "cp866", "cp852", "gbk", "shift_jis")),
    *((("utf-8", a), ("utf-8", b)) for a, b in (("cp1252", "cp1252"), ("latin-1", "latin-1"), ("latin-1", "cp1252"), ("mac_roman", "mac_roman"), ("cp1252", "mac_roman"), ("cp1252", "cp850"), ("cp1252", "cp1251"), ("cp1251", "cp1251"), ("cp1250", "cp1250"))),
    (("utf-8", "cp1252"),) * 3,
    *((((s, w),)) for s, w in (("cp1250", "cp1252"), ("iso8859-2", "cp1252"), ("cp1251", "cp1252"), ("koi8-r", "cp1252"), ("cp866", "cp1252"), ("koi8-r", "cp1251"), ("cp1251", "koi8-r"),
                              ("cp866", "cp1251"), ("cp1251", "cp866"), ("shift_jis", "cp1252"), ("euc_jp", "cp1252"), ("euc_jp", "shift_jis"), ("mac_roman", "cp1252"), ("cp1252", "mac_roman"),
                              ("cp850", "cp1252"), ("cp437", "cp1252"), ("cp1252", "cp850"), ("cp1252", "cp437"), ("cp1252", "cp1251"), ("gbk", "cp1252"))),
    (("utf-8", "cp1252 without"),),
    (("cp1252", "lossy"),),
)
NAMES = ["clean"] + [" + ".join(f"{s} as {w}" for s, w in c) for c in CHAINS[1:]]
LOST = {len(CHAINS) - 2, len(CHAINS) - 1}  # bytes dropped, bytes replaced: no inverse
LOSSY = len(CHAINS) - 1
LEAST = 0.5  # probability against clean that a chain needs

WINDOW = re.compile(r"[^\n]?[^\x00-\x7f]+[^\n]?")
RUN = re.compile(r"[^\x00-\x7f]+")
#: Spaces that are no trace of garbling: those that follow an ASCII character.
SPACES = re.compile(r"(?<![^\x00-\x7f])[\xa0\u2000-\u200b\u202f\ufeff]")
QUOTED = re.compile(r"(?P<open>[`\"'“‘«„])(?P<seq>[^\x00-\x7f]{2,8}?)[`\"'”’»“](?![^\x00-\x7f])")


def _encode(s: str, codec: str) -> bytes:
    """Bytes of a text in a codec; the codes windows-1252 leaves free stand for themselves, as browsers read them."""
    if codec != "cp1252":
        return s.encode(codec)
    try:
        return s.encode("cp1252")
    except UnicodeEncodeError:
        out = bytearray()
        for c in s:
            out += bytes((ord(c),)) if 0x80 <= ord(c) < 0xA0 else c.encode("cp1252")
        return bytes(out)


def _decode(b: bytes, codec: str) -> str:
    if codec != "cp1252":
        return b.decode(codec)
    try:
        return b.decode("cp1252")
    except UnicodeDecodeError:
        return "".join(bytes((x,)).decode("cp1252", "ignore") or chr(x) for x in b)


def garble(s: str, chain: tuple[tuple[str, str], ...]) -> str | None:
    """The text after the chain, or None where a step cannot be taken."""
    try:
        for src, wrong in chain:
            b = _encode(s, src)
            s = b.decode("utf-8", "replace") if wrong == "lossy" else b.decode("cp1252", "ignore") if wrong == "cp1252 without" else _decode(b, wrong)
    except UnicodeError:
        return None
    return s


def _undo_runs(s: str, wrong: str) -> tuple[str, int]:
    """UTF-8 taken for another encoding, undone run by run: (text, runs undone). A run decodes strictly or stays."""
    done = 0

    def one(m: re.Match) -> str:
        nonlocal done
        run = m.group()
        try:
            x = _encode(run, wrong).decode("utf-8")
        except UnicodeError:
            return run
        if x == run:
            return run
        done += 1
        return x

    if wrong in ("gbk", "shift_jis"):  # double-byte: a character may have swallowed an ASCII neighbour
        try:
            x = s.encode(wrong).decode("utf-8")
            return x, int(x != s)
        except UnicodeError:
            return s, 0
    return RUN.sub(one, s), done


def invert(s: str, chain: tuple[tuple[str, str], ...]) -> str | None:
    """The text before the chain, or None if a step does not decode strictly or the way back gives another text."""
    x = s
    for src, wrong in reversed(chain):
        if wrong in ("lossy", "cp1252 without"):
            return None
        if src == "utf-8":
            x, n = _undo_runs(x, wrong)
            if not n:
                return None
        else:
            try:
                y = _decode(_encode(x, wrong), src)
            except UnicodeError:
                return None
            if y == x:
                return None
            x = y
    return x


def _bigrams(s: str) -> np.ndarray:
    """The distinct hashed bigrams of a text's non-ASCII windows."""
    b = np.frombuffer("\n".join(WINDOW.findall(s)).encode("utf-8", "surrogatepass"), np.uint8).astype(np.int64)
    return np.unique(((b[:-1] * 257 + b[1:]) * 40503 >> 2) & (BUCKETS - 1))


@lru_cache(1 << 16)
def decodes(run: str) -> bool:
    """Whether a run has lost a character, or decodes strictly as UTF-8 that a common encoding was taken for."""
    return "�" in run or any(_undo_runs(run, w)[1] for w in ("cp1252", "mac_roman", "cp437", "cp850", "cp1251", "cp1250"))


class Model:
    """Softmax weights of hashed byte bigrams by chain, features scaled to unit length."""

    def __init__(self, weights: np.ndarray):
        self.w = weights

    @classmethod
    def of(cls, features: Iterable[tuple[int, np.ndarray]]) -> Model:
        """Fits the weights by AdaGrad over the features of every chain's version of every line: (chain, features), chain by chain."""
        samples = [(f, k) for k, f in features for _ in range(1 if k else CLEAN_COPIES)]
        w = np.zeros((BUCKETS, len(CHAINS)), np.float32)
        seen = np.full((BUCKETS, 1), 1e-6, np.float32)
        rng = np.random.default_rng(7)
        for _ in range(EPOCHS):
            order = rng.permutation(len(samples))
            for at in range(0, len(order), BATCH):
                part = [samples[i] for i in order[at:at + BATCH]]
                sizes = np.array([len(f) for f, _ in part])
                used, where = np.unique(np.concatenate([f for f, _ in part]), return_inverse=True)
                x = np.zeros((len(part), len(used)), np.float32)
                x[np.repeat(np.arange(len(part)), sizes), where] = np.repeat(1 / np.sqrt(sizes), sizes)
                z = x @ w[used]
                z = np.exp(z - z.max(1, keepdims=True))
                z /= z.sum(1, keepdims=True)
                z[np.arange(len(part)), [k for _, k in part]] -= 1
                g = x.T @ z / np.float32(len(part))
                seen[used] += (g * g).sum(1, keepdims=True)
                w[used] -= RATE * g / np.sqrt(seen[used])
        return cls(w)

    def probabilities(self, s: str) -> np.ndarray:
        f = _bigrams(s)
        z = self.w[f].sum(0) / np.sqrt(max(1, len(f)))
        z = np.exp(z - z.max())
        return z / z.sum()

    def chain_of(self, s: str) -> tuple[int, str | None]:
        """(chain, text before it): the most probable chain ahead of clean that inverts strictly; (0, None) if clean."""
        p, lost = self.probabilities(s), 0
        for k in np.argsort(-p, kind="stable"):
            k = int(k)
            if k == 0 or p[k] < LEAST * p[0]:
                break
            if k in LOST:
                if k == LOSSY and "�" in s:
                    return k, None
                if k != LOSSY and p[k] > 10 * p[0] and p[k] > 0.2:
                    lost = k
                continue
            back = invert(s, CHAINS[k])
            if back is None:
                continue
            if all(src != "utf-8" for src, _ in CHAINS[k]):  # such a step hardly ever fails: what comes out must read as clean
                if p[k] < p[0] * (1 if sum(map(len, RUN.findall(s))) > 3 else 4) or self.probabilities(back)[0] < 0.9:
                    continue
            return k, back
        return lost, None

    def line(self, s: str) -> tuple[int, str]:
        """(chain, restored line); chain 0 is clean."""
        bare = QUOTED.sub(lambda m: m.group("open"), SPACES.sub(" ", s))
        if bare.isascii():
            return 0, s
        k, back = self.chain_of(bare)
        if not k:  # the runs that decode strictly, judged alone
            runs = [m.group() for m in WINDOW.finditer(bare) if any(map(decodes, RUN.findall(m.group())))]
            if runs and (alone := "\n".join(runs)) != bare:
                k, back = self.chain_of(alone)
        if not k or back is None:
            return k, s
        if not QUOTED.search(s):
            whole = invert(s, CHAINS[k])
            return k, s if whole is None else whole
        parts, at = [], 0  # restore around the quoted examples
        for m in QUOTED.finditer(s):
            parts += [invert(s[at:m.start()], CHAINS[k]) or s[at:m.start()], m.group()]
            at = m.end()
        return k, "".join(parts) + (invert(s[at:], CHAINS[k]) or s[at:])

    def text(self, t: str | None) -> tuple[list[int], str | None]:
        """(chains in order of their first line, text with every line restored that can be)."""
        if not t or t.isascii():
            return [], t
        chains: dict[int, None] = {}
        out = []
        for s in t.split("\n"):
            if not s.isascii():
                k, s = self.line(s)
                if k:
                    chains[k] = None
            out.append(s)
        return list(chains), "\n".join(out)


def clean_lines(lines: list[str]) -> list[str]:
    """Lines fit to be garbled: no quoted example, no lost character, nothing that reads as UTF-8 taken for windows-1252."""
    return [s for s in map(lambda x: SPACES.sub(" ", x), lines) if "�" not in s and not QUOTED.search(s) and not _undo_runs(s, "cp1252")[1]]


def versions(s: str) -> Iterator[tuple[int, np.ndarray]]:
    """(chain, features) of a clean line put through every chain that changes it."""
    for k, chain in enumerate(CHAINS):
        g = garble(s, chain)
        if g is not None and (not k or g != s) and len(f := _bigrams(g)):
            yield k, f


def fit(df: DataFrame, text_col: str = "text", sample_lines: int = SAMPLE_LINES) -> Model:
    """Fits the classifier on a bounded sample: the sample_lines non-ASCII lines of smallest hash of text and position.

    The executors garble the sample and hash its bigrams; what comes to the driver is bounded by sample and chains.
    """
    lines = (df.select(F.col(text_col).alias("t"), F.posexplode(F.split(F.col(text_col), "\n")).alias("p", "s")).where(F.col("s").rlike(r"[^\x00-\x7f]") & (F.length("s") <= LINE_CHARS))
             .select("s", F.xxhash64("t", "p").alias("h")).orderBy("h", "s").limit(sample_lines))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h, ks, fs = [], [], []
            for s, at in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for clean in clean_lines([s]):
                    for k, f in versions(clean):
                        h.append(at), ks.append(k), fs.append(f.astype(np.int32))
            sizes = np.concatenate([[0], np.cumsum([len(f) for f in fs])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(sizes), pa.array(np.concatenate(fs) if fs else np.zeros(0, np.int32)))
            yield pa.RecordBatch.from_arrays([pa.array(ks, pa.int32()), pa.array(h, pa.int64()), lists], names=["k", "h", "f"])

    parts = df.sparkSession.sparkContext.defaultParallelism
    got = lines.repartition(parts).mapInArrow(run, "k int, h long, f array<int>").toArrow().sort_by([("k", "ascending"), ("h", "ascending")])
    chains, lists = got.column("k").to_numpy(), got.column("f").combine_chunks()
    flat, ends = lists.flatten().to_numpy(), np.cumsum(lists.value_lengths().to_numpy())
    return Model.of(zip(chains.tolist(), np.split(flat, ends[:-1]) if len(chains) else []))


def train(lines: list[str]) -> Model:
    """The model of lines at hand."""
    found = [x for s in clean_lines(lines) for x in versions(s)]
    return Model.of(sorted(found, key=lambda x: x[0]))


def restore(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: Model | None = None, with_text: bool = True) -> DataFrame:
    """(id, chains, recovered[, text]) of each garbled text; recovered is false if a chain among them loses bytes."""
    model = model or fit(df, text_col)
    kind = dict(df.dtypes)[id_col]
    names = ["id", "chains", "recovered"] + ["text"] * with_text
    state = df.sparkSession.sparkContext.broadcast(model.w)  # BUCKETS x len(CHAINS) numbers, whatever the table's size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(state.value)
        for b in batches:
            at, chains, ok, text = [], [], [], []
            for i, t in enumerate(b.column(1).to_pylist()):
                ks, back = m.text(t)
                if ks:
                    at.append(i), chains.append("; ".join(NAMES[k] for k in ks)), ok.append(not LOST & {*ks}), text.append(back)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int32())), pa.array(chains, pa.string()), pa.array(ok, pa.bool_()),
                                              *[pa.array(text, pa.string())] * with_text], names=names)

    return (df.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).where(F.col("t").rlike(r"[^\x00-\x7f]"))
            .mapInArrow(run, f"id {kind}, chains string, recovered boolean" + ", text string" * with_text).withColumnRenamed("id", id_col))
