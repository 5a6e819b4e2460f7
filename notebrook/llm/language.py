"""Languages of texts, lines and segments, with confidence (problem 2).

A linear-chain conditional random field labels every word with a language: affix, character n-gram and lexicon features,
learned transitions between neighbouring words, marginals by forward-backward. A line's language is the one with the
largest share of its words' marginals, weighted by letters; that share is the confidence.

The field is fitted on lines of at most ``SAMPLE_CELLS`` labelled cells (those with the least hash of their key). Labels may
be wrong, so the sample's are cleaned first: each line takes the one that its own labels and the words and trigrams of all other
lines speak for. The ``LINES_PER_LANGUAGE`` commonest lines of a language are fitted.

Nulls: null lines have no language; a null, blank or unknown label is a missing one. Lines with fewer than ten letters
outside backticks, tags and URLs have no language, a text without any such line none either. Texts are read whole."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notebrook.session import dealt

LANGUAGES = ("en", "de", "fr", "es", "pt", "it", "nl", "pl", "tr", "ru", "zh", "ja", "ko")
#: Labelled cells of the sample, lines of a language that the field is fitted on, and words of a line or part of a line.
SAMPLE_CELLS, LINES_PER_LANGUAGE, TRAINING_WORDS = 5000, 200, 24
#: Nats between the two best labels of a line of the sample, below which it is unsure.
MARGIN = 3.0
DIMENSIONS = 1 << 16
LEAST_LETTERS = 10

# Three-letter codes of the languages.
THREE_LETTERS = {"eng": "en", "deu": "de", "ger": "de", "fra": "fr", "fre": "fr", "spa": "es", "por": "pt", "ita": "it", "nld": "nl", "dut": "nl",
                 "pol": "pl", "tur": "tr", "rus": "ru", "zho": "zh", "chi": "zh", "jpn": "ja", "kor": "ko"}

_NOT_TEXT = re.compile(r"`[^`]*`|<[^<>]*>|(?:https?|ftp)://\S+|www\.\S+")
_WORDS = re.compile(r"[^\W\d_]+")
_EAST = re.compile(r"[一-鿿㐀-䶿]|[぀-ゟ]+|[゠-ヿㇰ-ㇿー]+|[가-힯ᄀ-ᇿ㄰-㆏]+|[^一-鿿㐀-䶿぀-ヿㇰ-ㇿ가-힯ᄀ-ᇿ㄰-㆏]+")


def canonical(label: str | None) -> str | None:
    """A label as one of LANGUAGES, whatever its case, region or number of letters; None if it names none of them."""
    base = re.split(r"[-_]", (label or "").strip().lower())[0]
    base = THREE_LETTERS.get(base, base)
    return base if base in LANGUAGES else None


def canonical_column(column):
    base = F.lower(F.trim(F.regexp_replace(column, r"[-_].*", "")))
    names = F.create_map(*[F.lit(x) for pair in (THREE_LETTERS | {x: x for x in LANGUAGES}).items() for x in pair])
    return F.try_element_at(names, base)


def line_words(line: str | None) -> tuple[list[str], int]:
    """Words of the running text of a line, and its letters; east Asian runs are cut by script."""
    if not line:
        return [], 0
    if "`" in line or "<" in line or "://" in line or "www." in line:
        line = _NOT_TEXT.sub(" ", line)
    found = _WORDS.findall(line.lower())
    n = sum(map(len, found))
    if not line.isascii() and any(w[0] > "ᄀ" or w[-1] > "ᄀ" for w in found):
        found = [p for w in found for p in (_EAST.findall(w) if max(w) > "ᄀ" else (w,))]
    return found, n


class LanguageField:
    """The fitted field. Plain arrays, at most a few MB whatever the corpus: it goes to the tasks as a broadcast."""

    def __init__(self):
        self.weights = np.zeros((DIMENSIONS, len(LANGUAGES)), np.float32)
        self.transitions = np.zeros((len(LANGUAGES), len(LANGUAGES)), np.float32)
        self.lexicon: dict[str, int] = {}
        self._ids: dict[str, int] = {}
        self._emissions = np.zeros((1024, len(LANGUAGES)), np.float32)

    def features(self, word: str) -> list[int]:
        w = f"^{word}$"
        out = [w]
        out += [f"p{w[:k]}" for k in (2, 3, 4)] + [f"s{w[-k:]}" for k in (2, 3, 4, 5)]
        out += [f"n{w[i : i + 3]}" for i in range(min(len(w), 24) - 2)] + [f"u{c}" for c in word[:24]]
        bits = self.lexicon.get(word, 0)
        out += [f"L{i}" for i in range(len(LANGUAGES)) if bits >> i & 1]
        return [zlib.crc32(x.encode("utf-8", "replace")) % DIMENSIONS for x in dict.fromkeys(out)]

    # ---- fitting

    def fit(self, lines: list[tuple[list[str], int]], steps: int = 30, known: list[tuple[list[str], int]] | None = None) -> LanguageField:
        """lines: (words, language index). Neighbouring lines are also joined, as text that switches its language. known: the lines
        whose words make the lexicon, if more than these."""
        counts = [Counter(w for words, y in known or lines if y == i for w in words) for i in range(len(LANGUAGES))]
        self.lexicon = {}
        for i, c in enumerate(counts):
            for w, n in c.most_common(2000):
                if n >= 3:
                    self.lexicon[w] = self.lexicon.get(w, 0) | 1 << i
        w_ = TRAINING_WORDS
        sequences = [(words[i : i + w_], [y] * len(words[i : i + w_])) for words, y in lines for i in range(0, len(words), w_)]
        mixed = np.random.default_rng(7).permutation(len(lines))[: len(lines) // 3]
        for a, b in zip(mixed[::2], mixed[1::2]):
            (x, p), (z, q) = lines[a], lines[b]
            sequences.append((x[-w_ // 2 :] + z[: w_ // 2], [p] * len(x[-w_ // 2 :]) + [q] * len(z[: w_ // 2])))
        sequences = [s for s in sequences if s[0]]
        if not sequences:
            return self
        vocabulary: dict[str, int] = {}
        for words, _ in sequences:
            for w in words:
                vocabulary.setdefault(w, len(vocabulary))
        rows = [self.features(w) for w in vocabulary]
        flat = np.concatenate([np.array(r) for r in rows])
        owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        starts = np.r_[0, np.cumsum([len(r) for r in rows])[:-1]]
        order = np.argsort(flat, kind="stable")
        used, at = np.unique(flat[order], return_index=True)
        columns = np.searchsorted(used, flat)
        n, t, k = len(sequences), max(len(s[0]) for s in sequences), len(LANGUAGES)
        ids, gold = np.full((n, t), -1), np.full((n, t), -1)
        for j, (words, ys) in enumerate(sequences):
            ids[j, : len(words)] = [vocabulary[w] for w in words]
            gold[j, : len(ys)] = ys
        mask = ids >= 0
        truth = np.zeros((len(rows), k))
        np.add.at(truth, (ids[mask], gold[mask]), 1)
        by_word = np.argsort(ids[mask], kind="stable")  # every word of the vocabulary occurs
        word_starts = np.r_[0, np.cumsum(np.bincount(ids[mask], minlength=len(rows)))[:-1]]
        both = mask[:, 1:] & mask[:, :-1]
        truth_pairs = np.zeros((k, k))
        np.add.at(truth_pairs, (gold[:, :-1][both], gold[:, 1:][both]), 1)
        w, tr = np.zeros((len(used), k), np.float32), np.zeros((k, k), np.float32)
        moments = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(tr), np.zeros_like(tr)]
        for step in range(1, steps + 1):
            emissions = np.add.reduceat(w[columns], starts)
            gamma, pairs = forward_backward(emissions[np.maximum(ids, 0)], mask, tr, want_pairs=True)
            expected = np.add.reduceat(gamma[mask][by_word], word_starts)
            slope = np.add.reduceat((truth - expected)[owner[order]], at) - 0.02 * w
            slope_t = truth_pairs - pairs - 0.02 * tr
            for x, g, m, v in ((w, slope, moments[0], moments[1]), (tr, slope_t, moments[2], moments[3])):
                m *= 0.9
                m += 0.1 * g
                v *= 0.99
                v += 0.01 * g * g
                x += 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        self.weights[:] = 0
        self.weights[used] = w
        self.transitions = tr.astype(np.float32)
        self._ids.clear()
        return self

    # ---- labelling

    def emissions(self, ids: np.ndarray) -> np.ndarray:
        return self._emissions[ids]

    def forget(self) -> None:
        """Bounds the table of words; only between batches, as their numbers are in use within one."""
        if len(self._ids) > 300_000:
            self._ids.clear()

    def word_ids(self, words: list[str]) -> list[int]:
        ids, out = self._ids, []
        for w in words:
            i = ids.get(w)
            if i is None:
                i = ids[w] = len(ids)
                if i >= len(self._emissions):
                    self._emissions = np.concatenate([self._emissions, np.zeros_like(self._emissions)])
                self._emissions[i] = self.weights[self.features(w)].sum(0)
            out.append(i)
        return out

    def shares(self, lines: list[list[str]]) -> np.ndarray:
        """For each line the share of each language in its letters, by the marginals of its words."""
        self.forget()
        out = np.zeros((len(lines), len(LANGUAGES)), np.float32)
        coded = [self.word_ids(x) for x in lines]
        order = sorted((i for i in range(len(lines)) if coded[i]), key=lambda i: len(coded[i]))
        for a in range(0, len(order), 1024):
            part = order[a : a + 1024]
            t = len(coded[part[-1]])
            if t > 200 and len(part) > 1:  # a few very long lines: not padded together with others
                for i in part:
                    out[i] = self._padded([coded[i]], [lines[i]])[0]
            else:
                out[part] = self._padded([coded[i] for i in part], [lines[i] for i in part])
        return out

    def _padded(self, coded: list[list[int]], lines: list[list[str]]) -> np.ndarray:
        n, t = len(coded), max(map(len, coded))
        ids, weight = np.full((n, t), -1), np.zeros((n, t), np.float32)
        for j, (c, w) in enumerate(zip(coded, lines)):
            ids[j, : len(c)] = c
            weight[j, : len(c)] = [len(x) for x in w]
        gamma, _ = forward_backward(self._emissions[np.maximum(ids, 0)], ids >= 0, self.transitions)
        total = np.einsum("nt,ntk->nk", weight, gamma)
        return total / np.maximum(total.sum(1, keepdims=True), 1e-9)


def forward_backward(e: np.ndarray, mask: np.ndarray, transitions: np.ndarray, want_pairs: bool = False):
    """Marginals (n, t, k) of the labels, and expected transitions summed over all sequences."""
    n, t, k = e.shape
    m = np.exp(transitions - transitions.max())
    p = np.exp(e - e.max(2, keepdims=True))
    alpha, scale = np.empty_like(p), np.ones((n, t, 1), p.dtype)
    a = p[:, 0]
    for i in range(t):
        if i:
            nxt = (a @ m) * p[:, i]
            a = np.where(mask[:, i : i + 1], nxt, a)
        s = a.sum(1, keepdims=True)
        a = a / s
        scale[:, i] = np.where(mask[:, i : i + 1], s, 1)
        alpha[:, i] = a
    beta, b = np.empty_like(p), np.ones((n, k), p.dtype)
    pairs = np.zeros((k, k))
    for i in range(t - 1, -1, -1):
        beta[:, i] = b
        if i:
            inside = mask[:, i : i + 1]
            weighted = p[:, i] * b / scale[:, i]
            if want_pairs:
                pairs += m * (np.where(inside, alpha[:, i - 1], 0).T @ np.where(inside, weighted, 0))
            b = np.where(inside, weighted @ m.T, b)
    gamma = alpha * beta
    gamma /= np.maximum(gamma.sum(2, keepdims=True), 1e-30)
    return np.where(mask[:, :, None], gamma, 0), pairs


def labelled_sample(cells: DataFrame) -> list[tuple[str, list[str]]]:
    """(language, lines) of at most SAMPLE_CELLS markdown cells with a label that names a language."""
    named = (
        cells.where("type = 'markdown' and lang is not null and content is not null")
        .select("_id", "content", canonical_column(F.col("lang")).alias("l"))
        .where("l is not null")
    )
    # a hash range that holds about twice the sample, so that no task sends the driver more than its part of it
    part = 2 * SAMPLE_CELLS / max(named.count(), 1)
    near = named.withColumn("h", F.shiftrightunsigned(F.xxhash64("_id"), 33)).where(F.col("h") < int(min(part, 1.0) * 2**31))
    return [(r["l"], r["content"]) for r in near.orderBy("h", "_id", "l").limit(SAMPLE_CELLS).collect()]


def fitted(cells: DataFrame) -> LanguageField:
    labels: dict[tuple[str, ...], Counter] = {}
    for label, content in labelled_sample(cells):
        for line in content:
            words, n = line_words(line)
            if n >= LEAST_LETTERS:
                labels.setdefault(tuple(words), Counter())[LANGUAGES.index(label)] += 1
    kept: list[tuple[list[str], int]] = []
    seen: Counter = Counter()
    commonest = sorted(labels.items(), key=lambda x: -sum(x[1].values()))
    known = cleaned([(list(w), c) for w, c in commonest])
    for words, y in known:
        if seen[y] < LINES_PER_LANGUAGE:
            seen[y] += 1
            kept.append((words, y))
    return LanguageField().fit(kept, known=known)


def cleaned(lines: list[tuple[list[str], Counter]], rounds: int = 3) -> list[tuple[list[str], int]]:
    """Different lines and how often each label stands at them → the lines with the language that their own labels and a
    multinomial model of the words and trigrams of all other lines speak for together. Each label is evidence by how often it
    stands at lines of a language, so the more often a line occurs the more its labels weigh; in the model a line counts as one
    text however often it occurs. Lines whose two best languages lie within MARGIN are left out."""
    ids: dict[str, int] = {}
    rows = [[ids.setdefault(x, len(ids)) for w in words for x in (w, *(f"{w}$"[i : i + 3] for i in range(len(w) - 1)))] for words, _ in lines]
    if not rows:
        return []
    flat, sizes = np.concatenate(rows), np.array([len(r) for r in rows])
    owner, starts = np.repeat(np.arange(len(rows)), sizes), np.r_[0, np.cumsum(sizes)[:-1]]
    # how often the line has the feature, at each of its occurrences: what it adds to the counts of its own language
    _, at, times = np.unique(owner * len(ids) + flat, return_inverse=True, return_counts=True)
    own, k = times[at], len(LANGUAGES)
    labels = np.zeros((len(lines), k))
    for j, (_, c) in enumerate(lines):
        labels[j, list(c)] = list(c.values())
    votes = labels / labels.sum(1, keepdims=True)
    expected = np.full((k, k), 0.2 / (k - 1)) + np.eye(k) * (0.8 - 0.2 / (k - 1))
    confusion = expected
    # the same rate in every language, however much text it has; a language with next to none has not the text of another
    unseen, least = 0.5 * k / len(flat), 0.1 * len(flat) / k
    for _ in range(rounds):
        score = labels @ np.log(confusion).T
        for j in range(k):
            total = sizes @ votes[:, j] - sizes * votes[:, j] + least
            others = np.bincount(flat, votes[owner, j], len(ids))[flat] - own * votes[owner, j]
            score[:, j] += np.add.reduceat(np.log(np.maximum(others, 0) / total[owner] + unseen), starts)
        y = score.argmax(1)
        votes = np.eye(k)[y]
        confusion = votes.T @ labels + 100 * expected
        confusion /= confusion.sum(1, keepdims=True)
    two = np.sort(score, axis=1)[:, -2:]
    return [(words, int(z)) for (words, _), z, m in zip(lines, y, two[:, 1] - two[:, 0]) if m > MARGIN]


def judged_lines(field: LanguageField, lines: list[str | None]) -> tuple[list[int], np.ndarray]:
    """Language index of each line (-1: none) and the confidence. Lines alike but for digits and code are judged once."""
    parsed = [line_words(x) for x in lines]
    distinct: dict[tuple[str, ...], int] = {}
    at = [distinct.setdefault(tuple(w), len(distinct)) if n >= LEAST_LETTERS else -1 for w, n in parsed]
    if not distinct:
        return at, np.zeros(len(lines))
    shares = field.shares([list(w) for w in distinct])
    best, sure = shares.argmax(1).tolist(), shares.max(1)
    return [best[i] if i >= 0 else -1 for i in at], np.array([sure[i] if i >= 0 else 0.0 for i in at])


SCHEMA = "record_id string, piece_no int, lang string, confidence float, mixed boolean, label string"


def piece_languages(df: DataFrame, field: LanguageField, lines_column: str, label_column: str | None = None) -> DataFrame:
    """One row for a text in one language (piece_no -1), one per line for a text in several (piece_no from 0).
    df has ``_id``; label is the delivered label in its canonical form."""
    shared = df.sparkSession.sparkContext.broadcast(field)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in batches:
            lists = b.column(1)
            lengths = [n or 0 for n in lists.value_lengths().to_pylist()]
            best, sure = judged_lines(model, lists.flatten().to_pylist())
            keys, labels = b.column(0).to_pylist(), b.column(2).to_pylist()
            out: list[tuple] = []
            at = 0
            for key, label, n in zip(keys, labels, lengths):
                mine = [(i, best[at + i]) for i in range(n) if best[at + i] >= 0]
                langs = {x for _, x in mine}
                name = canonical(label)
                if len(langs) == 1:
                    x = mine[0][1]
                    out.append((key, -1, LANGUAGES[x], float(np.mean([sure[at + i] for i, _ in mine])), False, name))
                elif langs:
                    out += [(key, i, LANGUAGES[x], float(sure[at + i]), True, name) for i, x in mine]
                at += n
            yield pa.RecordBatch.from_pylist(
                [dict(zip(_NAMES, r)) for r in out],
                pa.schema([("record_id", pa.string()), ("piece_no", pa.int32()), ("lang", pa.string()), ("confidence", pa.float32()), ("mixed", pa.bool_()), ("label", pa.string())]),
            )

    label = F.col(label_column) if label_column else F.lit(None).cast("string")
    return df.select("_id", F.col(lines_column), label.alias("label")).where(F.col(lines_column).isNotNull()).mapInArrow(run, SCHEMA)


_NAMES = ("record_id", "piece_no", "lang", "confidence", "mixed", "label")


def cell_languages(cells: DataFrame, field: LanguageField) -> DataFrame:
    return piece_languages(dealt(cells, "_id", "type", "content", "lang").where("type = 'markdown'"), field, "content", "lang")


def wrong_labels(cells: DataFrame, segments: DataFrame) -> DataFrame:
    """record_id, piece_no, lang of wrongly labelled cells and of the lines of mixed cells and segments."""
    field = fitted(cells)
    of_cells = cell_languages(cells, field).where("mixed or label is null or label != lang")
    of_segments = piece_languages(dealt(segments, "_id", "prompts"), field, "prompts").where("mixed")
    return of_cells.unionByName(of_segments).select("record_id", "piece_no", "lang").distinct()


def label_report(cells: DataFrame) -> DataFrame:
    """Per language as found: cells, mixed ones, missing and wrong labels, mean confidence."""
    field = fitted(cells)
    found = cell_languages(cells, field)  # a cell that was delivered twice has equal rows: averages and groups are the same
    per_cell = found.groupBy("record_id", "lang", "mixed", "label").agg(F.avg("confidence").alias("c"))
    return per_cell.groupBy("lang").agg(
        F.count("*").alias("cells"), F.count_if("mixed").alias("mixed_cells"), F.count_if(F.col("label").isNull()).alias("unlabelled"),
        F.count_if(~F.col("mixed") & (F.col("label") != F.col("lang"))).alias("mislabelled"), F.round(F.avg("c"), 4).alias("confidence"),
    )
