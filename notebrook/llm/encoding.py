"""Text that was decoded in a wrong character encoding (problem 8).

1. Adjacent character pairs of the whole corpus are counted (code spans in backticks left out). A span that a strict inverse
   mapping turns into UTF-8 is not counted, else a corpus with many garbled texts would make garbled pairs look normal.
2. A pair scores its pointwise mutual information, limited by its support: a pair that makes up less than
   ``SUPPORT`` of all pairs, or fewer than ``LEAST_SUPPORT``, has no reliable information and counts as improbable.
3. Maximum-scoring segments of improbable pairs are the runs that are looked at.
4. Only inside those runs inverse mappings (encode in the wrong codec, decode in the right one) are tested. A
   mapping holds if the corpus finds its result more likely by a margin; the run is then restored.

Replacement characters and C1 controls outside backticks cannot be undone but are cases. Characters fall into fewer than
``CLASSES`` classes, so the table of pairs that goes to the tasks has at most CLASSES² cells of 4 bytes (4 MB).

Null, empty and pure ASCII texts are clean; whole texts are read; repeated texts are judged each."""

from __future__ import annotations

import codecs
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notebrook.session import dealt

CLASSES = 1024
SUPPORT, LEAST_SUPPORT = 4e-5, 8
#: Bits by which the corpus must prefer a restored run.
MARGIN_UTF8, MARGIN_OTHER = 2.0, 7.0
_CODE = re.compile(r"```.*?```|``.*?``|`[^`]*`", re.S)
_HIGH = re.compile(r"[^\x00-\x7f]+")
_BREAK, _NEVER, ASCII = 0, 1, 58

# Ranges of code points whose characters are told apart one by one, and ranges that are one class each.
_SINGLE = ((0x80, 0x180), (0x2C0, 0x2E0), (0x370, 0x400), (0x400, 0x460), (0x490, 0x492), (0x2010, 0x2040), (0x20A0, 0x20C0), (0x2500, 0x25A0))
_WHOLE = ((0x180, 0x2C0), (0x300, 0x370), (0x530, 0x590), (0x590, 0x600), (0x600, 0x900), (0x900, 0x1100), (0x1100, 0x1200), (0x1E00, 0x1F00),
          (0x2000, 0x2010), (0x2100, 0x2150), (0x2190, 0x2200), (0x2200, 0x2300), (0x25A0, 0x2800), (0x3000, 0x3040), (0x3040, 0x30A0),
          (0x30A0, 0x3100), (0x3130, 0x3190), (0x3400, 0x4DC0), (0x4E00, 0xA000), (0xAC00, 0xD7B0), (0xE000, 0xF900), (0xFF00, 0xFF61), (0xFF61, 0xFFA0), (0x1F000, 0x20000))


@lru_cache(maxsize=1)
def class_of() -> np.ndarray:
    """Class of every code point."""
    lut = np.full(0x110000, 2, np.int16)
    for chars, k in ((range(0x20), 3), (range(0x20, 0x30), 4), (range(0x30, 0x3A), 5), (range(0x3A, 0x80), 4)):
        lut[list(chars)] = k
    lut[[9, 10, 13, 32]] = 3
    lut[0x41:0x5B], lut[0x61:0x7B] = np.arange(6, 32), np.arange(32, 58)
    k = ASCII
    for a, b in _SINGLE:
        lut[a:b] = np.arange(k, k + b - a)
        k += b - a
    for a, b in _WHOLE:
        lut[a:b] = k
        k += 1
    lut[0x80:0xA0] = _NEVER
    lut[0x85] = 3
    lut[[0xFFFD, 0xFFFF]] = _NEVER
    lut[0] = _BREAK
    assert k <= CLASSES
    return lut


@lru_cache(maxsize=1)
def groups() -> tuple[np.ndarray, np.ndarray]:
    """For each class the coarse class that says whether it is improbable (plain and Cyrillic small letters are one each),
    and the bits that single out a character within its class."""
    coarse, inner = np.arange(CLASSES), np.zeros(CLASSES, np.float32)
    coarse[6:32], coarse[32:58] = 6, 32
    small = class_of()[0x430:0x450]
    coarse[small] = small[0]
    inner[[4, 5]] = 3
    for a, b in _WHOLE:
        inner[class_of()[a]] = min(10.0, np.log2(b - a))
    inner[2] = 10
    return coarse, inner


def classes(text: str) -> np.ndarray:
    return class_of()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)].astype(np.int32)


@lru_cache(maxsize=32)
def _encoding_map(codec: str) -> dict[int, int]:
    """Code point → byte; bytes without a character in the codec stand for the C1 control of the same number."""
    out = {}
    for b in range(255, -1, -1):
        try:
            out[ord(bytes([b]).decode(codec))] = b
        except UnicodeDecodeError:
            pass
        if 0x80 <= b < 0xA0:
            out.setdefault(b, b)
    return out


@lru_cache(maxsize=64)
def _decoding_map(codec: str) -> str:
    return "".join(bytes([b]).decode(codec, "replace") if b > 0x7F else chr(b) for b in range(256))


def encoded(text: str, codec: str) -> bytes | None:
    try:
        return codecs.charmap_encode(text, "strict", _encoding_map(codec))[0]
    except UnicodeEncodeError:
        return None


# Codecs a text may have been read in, each with those it may have been written in besides UTF-8.
_ASIAN = ("gb18030", "euc_jp", "shift_jis", "cp949", "big5")
INVERSE = {
    "cp1252": ("mac_roman", "cp1250", "cp1251", "koi8_r", "cp1254", "iso8859_2", "cp437", "cp850", "cp866", *_ASIAN),
    "mac_roman": ("cp1252", "cp1250", "cp1251", "cp1254", *_ASIAN),
    "cp437": ("cp1252", "cp1250", "cp1254", "cp1251", "mac_roman"),
    "cp850": ("cp1252", "cp1250", "cp1251"),
    "cp1250": ("cp1252", "iso8859_2", "cp1251", "cp1254", *_ASIAN),
    "cp1251": ("koi8_r", "cp866", "mac_cyrillic", "cp1252", "cp1250", "gb18030"),
    "koi8_r": ("cp1251", "cp1252", "cp866"),
    "cp866": ("cp1251", "koi8_r"),
    "cp1254": ("cp1252", "cp1250", "cp1251"),
    "iso8859_2": ("cp1250", "cp1252"),
}
# Lead bytes of the rows with the common characters of each multi-byte code.
_COMMON_ROWS = {"gb18030": ("gb2312", (0xA1, 0xA4), (0xB0, 0xD8)), "euc_jp": ("euc_jp", (0xA1, 0xA6), (0xB0, 0xD0)), "cp949": ("euc_kr", (0xA1, 0xA4), (0xB0, 0xC9)),
                "shift_jis": ("shift_jis", (0x81, 0x84), (0x88, 0x98)), "big5": ("big5", (0xA1, 0xA4), (0xA4, 0xC7))}
_STRICT = ("cp1252", "mac_roman", "cp437", "cp1250", "cp1251")


@lru_cache(maxsize=8)
def _common(codec: str) -> frozenset[str]:
    name, *rows = _COMMON_ROWS[codec]
    pairs = (bytes([a, b]).decode(name, "ignore") for lo, hi in rows for a in range(lo, hi) for b in range(0x40, 0x100))
    return frozenset(p for p in pairs if len(p) == 1)


def plausible(decoded: str, codec: str) -> bool:
    """Whether text decoded by a multi-byte code is at least three characters, nearly all common ones."""
    high = [c for c in decoded if c > "\x7f"]
    return len(high) >= 3 and sum(c in _common(codec) for c in high) >= 0.85 * len(high)


def outside_code(text: str) -> str:
    """The text with each backtick span replaced by breaks of the same length."""
    return _CODE.sub(lambda m: "\0" * len(m.group()), text) if "`" in text else text


def _self_explained(m: re.Match) -> str:
    run = m.group()
    if len(run) > 1:
        for codec in _STRICT:
            raw = encoded(run, codec)
            if raw is not None:
                try:
                    raw.decode("utf-8")
                    return "\0" * len(run)
                except UnicodeDecodeError:
                    pass
    return run


def pair_counts(documents: DataFrame, text_column: str = "text") -> DataFrame:
    """a, b, n: how often each pair of character classes stands side by side in the corpus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CLASSES * CLASSES, np.int64)
        for b in batches:
            texts = [outside_code(t) for t in b.column(0).to_pylist() if t]
            joined = "\0".join(t if t.isascii() else _HIGH.sub(_self_explained, t) for t in texts)
            k = classes(joined)
            if len(k) > 1:
                ok = (k[1:] > _NEVER) & (k[:-1] > _NEVER)
                total += np.bincount((k[:-1] * CLASSES + k[1:])[ok], minlength=CLASSES * CLASSES)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array((at // CLASSES).astype(np.int32)), pa.array((at % CLASSES).astype(np.int32)), pa.array(total[at])], names=["a", "b", "n"])

    return dealt(documents, text_column).mapInArrow(run, "a int, b int, n bigint").groupBy("a", "b").agg(F.sum("n").alias("n"))


class PairModel:
    """Log-likelihood and improbability of pairs, as dense tables over the classes."""

    def __init__(self, rows: list[tuple[int, int, int]]):
        n = np.zeros((CLASSES, CLASSES), np.float64)
        for a, b, x in rows:
            n[a, b] = x
        total = max(n.sum(), 1.0)
        coarse, self.inner = groups()
        fold = np.zeros((CLASSES, CLASSES), np.float32)
        fold[np.arange(CLASSES), coarse] = 1
        g = fold.T @ n @ fold
        left, right = g.sum(1, keepdims=True), g.sum(0, keepdims=True)
        with np.errstate(divide="ignore", invalid="ignore"):
            pmi = np.log2(g * total / (left * right))
            support = np.log2(g / max(SUPPORT * total, LEAST_SUPPORT))
            share_left = n.sum(1) / left[coarse, 0]
            share_right = n.sum(0) / right[0, coarse]
        score = np.minimum(pmi + 1.0, support)
        score[~np.isfinite(score)] = -2.0
        score = score[np.ix_(coarse, coarse)]
        # what a pair of letters lacks in counts is lent by its coarse pair; half a count, or as much of a larger corpus
        # as half a count is of ten million pairs, is left for pairs never seen
        lent = g[np.ix_(coarse, coarse)] * np.nan_to_num(share_left)[:, None] * np.nan_to_num(share_right)[None, :]
        self.bits = np.log2((0.97 * n + 0.03 * lent + max(0.5, total * 5e-8)) / total).astype(np.float32)
        self.floor = float(self.bits.min())
        # plain ASCII neither begins nor carries a run
        score[:ASCII, :ASCII] = 0.5
        self.improbable = np.clip(-score, -1.0, 2.0).astype(np.float32)
        self.improbable[_NEVER, :] = self.improbable[:, _NEVER] = 2.0
        self.improbable[_BREAK, :] = self.improbable[:, _BREAK] = -1.0
        self.bits[_BREAK, :] = self.bits[:, _BREAK] = 0.0
        self.bits[_NEVER, :] = self.bits[:, _NEVER] = self.bits.min() - 2.0

    def likelihood(self, k: np.ndarray) -> float:
        return float(self.bits[k[:-1], k[1:]].sum() - self.inner[k].sum())

    def unseen(self, k: np.ndarray) -> float:
        """Share of the pairs beyond ASCII that the corpus has not seen."""
        a, b = k[:-1], k[1:]
        high = (a >= ASCII) | (b >= ASCII)
        return float((self.bits[a, b][high] < self.floor + 2.5).mean()) if high.any() else 0.0


def segments(scores: np.ndarray) -> list[tuple[int, int]]:
    """All maximum-scoring segments [begin, end) of a sequence, in order (linear time)."""
    found: list[list[float]] = []  # begin, end, sum before, sum up to the end
    total = 0.0
    for i, s in enumerate(scores.tolist()):
        before, total = total, total + s
        if s <= 0:
            continue
        new = [i, i + 1, before, total]
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= new[2]:
                j -= 1
            if j < 0 or found[j][3] >= new[3]:
                found.append(new)
                break
            new = [found[j][0], new[1], found[j][2], new[3]]
            del found[j:]
    return [(int(a), int(b)) for a, b, _, _ in found]


def improbable_runs(text: str, model: PairModel) -> list[tuple[int, int]]:
    """[begin, end) of the runs of improbable characters, widened to whole stretches beyond ASCII."""
    k = classes(text)
    scores = model.improbable[k[:-1], k[1:]]
    if len(text) == 1 or not (scores > 0).any():
        return [(0, 1)] if len(text) == 1 and k[0] == _NEVER else []
    hot = np.flatnonzero(scores > 0)
    out: list[tuple[int, int]] = []
    # far from any improbable pair no segment can begin: look at neighbourhoods only
    cuts = np.flatnonzero(np.diff(hot) > 64)
    for a, b in zip(np.r_[0, cuts + 1], np.r_[cuts, len(hot) - 1]):
        low, high = int(hot[a]), int(hot[b]) + 1
        for begin, end in segments(scores[low:high]):
            begin, end = begin + low, end + low + 1
            while begin > 0 and text[begin - 1] > "\x7f" and text[begin] > "\x7f":
                begin -= 1
            while end < len(text) and text[end] > "\x7f" and text[end - 1] > "\x7f":
                end += 1
            if out and begin < out[-1][1]:
                out[-1] = (out[-1][0], max(end, out[-1][1]))
            else:
                out.append((begin, end))
    return out


def inversions(run: str) -> Iterator[tuple[str, str, str]]:
    """(wrong codec, right codec, decoded) for every inverse mapping that works on the run; UTF-8 first."""
    raws = {}
    for wrong in INVERSE:
        raw = encoded(run, wrong)
        if raw is None:
            continue
        raws[wrong] = raw
        try:
            yield wrong, "utf-8", raw.decode("utf-8")
        except UnicodeDecodeError:
            pass
    for wrong, raw in raws.items():
        for right in INVERSE[wrong]:
            if right in _ASIAN:
                try:
                    decoded = raw.decode(right)
                except UnicodeDecodeError:
                    continue
                if not plausible(decoded, right):
                    continue
            else:
                decoded = codecs.charmap_decode(raw, "strict", _decoding_map(right))[0]
                if 0 < sum("\u0400" <= c <= "\u04ff" for c in decoded) < 3 and not any("\u0400" <= c <= "\u04ff" for c in run):
                    continue  # a letter or two of another script are no evidence
            if decoded != run:
                yield wrong, right, decoded


Option = tuple[float, str, str]  # gain in bits, mapping, decoded


def options(run: str, before: str, after: str, model: PairModel) -> list[Option]:
    """The mappings whose results the corpus likes better by enough, the best first."""
    if not any(c > "\x7f" and not c.isspace() for c in run):
        return []  # an odd space alone is no evidence
    base = model.likelihood(classes(before + run + after))
    found: list[Option] = []
    for wrong, right, decoded in inversions(run):
        k = classes(before + decoded + after)
        gain = model.likelihood(k) - base - (MARGIN_UTF8 if right == "utf-8" else MARGIN_OTHER)
        if gain <= 0:
            continue
        if model.unseen(k) > (0.5 if right == "utf-8" else 0.1):
            # text garbled twice decodes to pairs that the corpus has not seen, but to several characters at a place
            if right != "utf-8" or sum(c > "\x7f" for c in decoded) <= len(_HIGH.findall(run)):
                continue
        found.append((gain, f"{wrong}>{right}", decoded))
        if right == "utf-8" and len(run) > 3:
            break
    return sorted(found, key=lambda o: -o[0])


def damaged(run: str, before: str, after: str, model: PairModel) -> bool:
    """Whether a run is UTF-8 read in a single-byte codec, with parts lost: what is left is likelier than what is there."""
    base = model.likelihood(classes(before + run + after))
    for wrong in _STRICT[:4]:
        raw = encoded(run, wrong)
        if raw is not None:
            decoded = raw.decode("utf-8", "replace")
            lost = decoded.count("�")
            if 0 < lost < sum(c > "\x7f" for c in decoded):
                left = model.likelihood(classes(before + decoded.replace("�", "\0") + after)) + 2 * lost * model.floor
                if left - base > MARGIN_UTF8:
                    return True
    return False


def restore(text: str, model: PairModel, memory: dict) -> tuple[bool, str, list[str]]:
    """(garbled, text as far as it could be restored, mappings used). A text was mostly garbled in one way, so where several
    mappings would do, the one that explains most of the text is taken."""
    garbled, used, seen = False, set(), set()
    while text not in seen:  # text may have been garbled more than once; a text that comes again would go in circles
        seen.add(text)
        plain, parts = outside_code(text), []
        for begin, end in improbable_runs(plain, model):
            key = (plain[max(0, begin - 1) : begin], text[begin:end], plain[end : end + 1])
            if key not in memory:
                if len(memory) > 50_000:
                    memory.clear()
                memory[key] = _judged(key[1], key[0], key[2], model)
            bad, pieces = memory[key]
            garbled |= bad
            parts += [(begin + a, begin + b, found) for a, b, found in pieces]
        if not parts:
            break
        votes: dict[str, float] = {}
        for _, _, found in parts:
            for gain, how, _ in found:
                votes[how] = votes.get(how, 0.0) + gain
        top, out, at = max(votes, key=votes.get), [], 0
        for begin, end, found in parts:
            gain, how, decoded = next((o for o in found if o[1] == top), found[0])
            out += [text[at:begin], decoded]
            at = end
            used.add(how)
        text = "".join(out) + text[at:]
    return garbled, text, sorted(used)


def _judged(run: str, before: str, after: str, model: PairModel) -> tuple[bool, list[tuple[int, int, list[Option]]]]:
    """(whether the run is garbled, [begin, end) of the parts that can be restored with their options)."""
    found = options(run, before, after, model)
    if found:
        return True, [(0, len(run), found)]
    # the run as a whole is in no single codec: its stretches beyond ASCII one by one
    bad = any(c == "�" or ("\x80" <= c < "\xa0" and c != "\x85") for c in run)
    parts = []
    for m in _HIGH.finditer(run):
        a, b = m.span()
        left, right = run[a - 1 : a] if a else before, run[b : b + 1] or after
        found = options(m.group(), left, right, model) if (a, b) != (0, len(run)) else []
        if found:
            bad = True
            parts.append((a, b, found))
        elif damaged(m.group(), left, right, model):
            bad = True
    return bad, parts


def repaired(documents: DataFrame, text_column: str = "text") -> DataFrame:
    """doc_id, garbled, restored (the text, repaired where possible), mappings."""
    counts = pair_counts(documents, text_column).collect()  # at most CLASSES² rows, however large the corpus
    model = documents.sparkSession.sparkContext.broadcast(PairModel([tuple(r) for r in counts]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory: dict = {}
        for b in batches:
            found = [(False, t, []) if not t or t.isascii() else restore(t, model.value, memory) for t in b.column(1).to_pylist()]
            new = [pa.array([x[i] for x in found], t) for i, t in enumerate((pa.bool_(), pa.string(), pa.list_(pa.string())))]
            yield pa.RecordBatch.from_arrays([b.column(0), *new], names=["doc_id", "garbled", "restored", "mappings"])

    return dealt(documents, "doc_id", text_column).mapInArrow(run, f"doc_id {dict(documents.dtypes)['doc_id']}, garbled boolean, restored string, mappings array<string>")


def garbled_documents(documents: DataFrame) -> DataFrame:
    return repaired(documents).where("garbled").select("doc_id").distinct()
