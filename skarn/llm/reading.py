"""Reading level of documents, from the levels of their sentences."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skarn.sources.tables import ship

LEVELS = ("novice", "practitioner", "specialist")
#: Classes of sentences: the levels of English prose, and prose of other languages.
CLASSES = (*LEVELS, "foreign")
#: Hashed features of the sentence model.
FEATURES = 1 << 16
#: At most so many rated documents, and so many of other languages, are used for fitting; they
#: are those of the smallest hashes, so the same at every size of the corpus.
MAX_RATED = 3000
MAX_FOREIGN = 800
#: A document is prose if at least this share of its letters, digits and signs is in English sentences.
PROSE_SHARE = 0.5

_FENCE = re.compile(r"```.*?(?:```|\Z)|~~~.*?(?:~~~|\Z)", re.S)
_TAG = re.compile(r"</?[a-zA-Z!][^<>\n]*>")
_LEAD = re.compile(r"^[\s>*•·–—\-]*(?:\(?\d{1,3}[.)]\s+)?[\s*•]*")
_STOP = re.compile(r"(?<=[.!?。！？।؟])[\"'”’)\]]*\s+|(?<=[。！？।])")
_WORD = re.compile(r"[^\W\d_]+(?:['’\-][^\W\d_]+)*")
_CODE = re.compile(r"[{}<>=|\\`;]{2}|\w\(.*\)\s*[:;{]?$|^\s*(?:def|import|return|if|for|else|while)\b.*[:)]\s*$|\b0x[0-9a-f]+|\S+/\S+\.\w{2,4}\b|^\[?\d\d:\d\d|^[0-9a-f]{7,}\b|\w=\S")


def sentences(text: str | None) -> list[tuple[str, bool]]:
    """(sentence, whether it looks like prose) of a text; nothing for a null or blank one.

    Fenced code is one piece that is no prose, tags are taken off, headings, bullets and numbers
    of list items are dropped. Lines of one paragraph belong together unless they look like code,
    logs or tables: those have few words, many digits and signs, or typical patterns.
    """
    if not text or not text.strip():
        return []
    out: list[tuple[str, bool]] = []
    for m in _FENCE.finditer(text):
        out.append((m.group(), False))
    run: list[str] = []

    def flush() -> None:
        for s in _STOP.split(" ".join(run)):
            if s.strip():
                out.append((s.strip(), True))
        run.clear()

    for line in _FENCE.sub("\n", text).splitlines():
        raw = line.strip()
        if not raw or raw.startswith("#"):
            flush()
            continue
        bare = _TAG.sub(" ", raw)
        item = _LEAD.sub("", bare)
        if not item:
            continue
        words = _WORD.findall(item)
        letters = sum(map(len, words))
        solid = sum(not c.isspace() for c in item)
        if len(_CODE.findall(item)) > 0 and letters < 0.9 * solid or letters < 0.72 * solid or (raw.count(",") >= 3 and ", " not in raw):
            flush()
            out.append((item, False))
            continue
        if item != bare.lstrip():
            flush()
        run.append(item)
    flush()
    return out


def features(parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(sentence, feature) pairs: hashed runs of three and five characters, words and pairs of
    words, all computed on one byte array. Case is folded and digits are alike; sentences begin
    and end in a blank."""
    data = np.frombuffer(("\n" + "\n".join(re.sub(r"\d", "0", p.lower()) for p in parts) + "\n").encode(), np.uint8).astype(np.uint64)
    line = data == 10
    sentence = np.cumsum(line) - 1
    data = np.where(line, np.uint64(32), data)
    found = []
    for n, mul in ((3, 0x9E3779B97F4A7C15), (5, 0xC2B2AE3D27D4EB4F)):
        if len(data) >= n:
            h = np.zeros(len(data) - n + 1, np.uint64)
            for i in range(n):
                h = (h * np.uint64(0x100000001B3)) ^ (data[i : len(data) - n + 1 + i] + np.uint64(n))
            ok = sentence[1 : len(h) + 1] == sentence[n - 1 : n - 1 + len(h)] if n > 2 else np.ones(len(h), bool)
            ok = ok[: len(h)]
            found.append((sentence[1 : len(h) + 1][ok], ((h * np.uint64(mul)) >> np.uint64(48))[ok]))
    letter = (data >= 97) & (data <= 122) | (data >= 128) | (data == 39)
    edge = np.diff(np.concatenate([[0], letter.astype(np.int8), [0]]))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if len(start):
        # words by a polynomial hash: differences of running sums, with odd powers undone mod 2^64
        power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(data), np.uint64(0x5851F42D4C957F2D))]))
        undo = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(data), np.uint64(pow(0x5851F42D4C957F2D, -1, 1 << 64)))]))
        run = np.concatenate([[np.uint64(0)], np.cumsum(data * power[:-1])])
        word = (run[end] - run[start]) * undo[start]
        word = (word ^ (word >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        found.append((sentence[start], word >> np.uint64(48)))
        pair = (word[:-1] * np.uint64(0x94D049BB133111EB) + word[1:]) * np.uint64(0xD6E8FEB86659FD93)
        ok = sentence[start[:-1]] == sentence[start[1:]]
        found.append((sentence[start[:-1]][ok], (pair >> np.uint64(48))[ok]))
    at, what = (np.concatenate([f[i] for f in found]).astype(np.int64) for i in range(2))
    order = np.argsort(at, kind="stable")
    return at[order], what[order]


def _sums(weights: np.ndarray, at: np.ndarray, what: np.ndarray, n: int) -> np.ndarray:
    """Sum of weights per sentence over the root of the number of its features."""
    count = np.bincount(at, minlength=n)
    out = np.stack([np.bincount(at, weights=weights[what, c], minlength=n) for c in range(weights.shape[1])], 1)
    return out / np.sqrt(np.maximum(count, 1))[:, None]


def _soft(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def fit_softmax(at: np.ndarray, what: np.ndarray, label: np.ndarray, classes: int, width: int, rounds: int = 60, ridge: float = 1e-6) -> tuple[np.ndarray, np.ndarray]:
    """Weights and biases of a regularised multinomial logistic model (Adam on all rows)."""
    n = len(label)
    share = np.bincount(label, minlength=classes) + 1.0
    weight = (n / share / classes)[label]
    scale = 1 / np.sqrt(np.maximum(np.bincount(at, minlength=n), 1))
    w, b = np.zeros((width, classes), np.float64), np.zeros(classes)
    m1, m2 = np.zeros_like(w), np.zeros_like(w)
    onehot = np.eye(classes)[label]
    for t in range(1, rounds + 1):
        r = (_soft(_sums(w, at, what, n) + b) - onehot) * weight[:, None] / n
        g = np.stack([np.bincount(what, weights=(r[:, c] * scale)[at], minlength=width) for c in range(classes)], 1) + ridge * w
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.99 * m2 + 0.01 * g * g
        w -= 0.15 * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.99**t)) + 1e-9)
        b -= 0.5 * r.sum(0)
    return w.astype(np.float32), b


class ReadingModel:
    """Level of a sentence, and of a document from its sentences' distribution."""

    def __init__(self, weights: np.ndarray, bias: np.ndarray, calibration: np.ndarray | None = None):
        self.weights, self.bias, self.calibration = weights, bias, calibration

    def summary(self, texts: list[str | None]) -> np.ndarray:
        """Per text: mean class probabilities by sentence and by length, and share of English prose."""
        parts: list[str] = []
        owner: list[int] = []
        solid = np.zeros(len(texts))
        for i, t in enumerate(texts):
            for s, prose in sentences(t):
                solid[i] += len(s)
                if prose:
                    parts.append(s)
                    owner.append(i)
        out = np.zeros((len(texts), 2 * len(LEVELS) + 1))
        if not parts:
            return out
        at, what = features(parts)
        p = _soft(_sums(self.weights, at, what, len(parts)) + self.bias)
        own, size = np.array(owner), np.array([len(s) for s in parts], float)
        english = p[:, : len(LEVELS)].sum(1) > 0.5
        for k, weight in enumerate((english * 1.0, english * size)):
            whole = np.bincount(own, weights=weight, minlength=len(texts))
            for c in range(len(LEVELS)):
                out[:, k * len(LEVELS) + c] = np.bincount(own, weights=weight * p[:, c], minlength=len(texts)) / np.maximum(whole, 1e-9)
        out[:, -1] = np.bincount(own, weights=english * size, minlength=len(texts)) / np.maximum(solid, 1)
        return out

    def levels(self, summary: np.ndarray) -> np.ndarray:
        """Calibrated probabilities of the levels of documents."""
        x = np.concatenate([np.log(summary[:, :-1] + 0.02), np.ones((len(summary), 1))], 1)
        return _soft(x @ self.calibration)


def rated_levels(ratings: DataFrame) -> DataFrame:
    """(doc_id, level): the level most ratings of a document name; documents whose ratings are
    null, of no known level or tied have none. A rating delivered twice counts once."""
    a = F.lower(F.trim("audience"))
    votes = ratings.select("doc_id", "rater", a.alias("level")).filter(a.isin(*LEVELS) & F.col("doc_id").isNotNull()).distinct().groupBy("doc_id", "level").agg(F.count("*").alias("n"))
    best = votes.groupBy("doc_id").agg(F.max("n").alias("n"))
    return votes.join(best, ["doc_id", "n"]).groupBy("doc_id").agg(F.min("level").alias("level"), F.max("level").alias("other")).filter("level = other").select("doc_id", "level")


def _smallest(ids: DataFrame, most: int) -> DataFrame:
    """The rows of the `most` smallest hashes of doc_id, without their texts. The hashes are even,
    so the rows below a bound that holds somewhat more than enough are counted first and only
    those are sorted: what meets in one task is about `most` rows at any size of the corpus."""
    h = (F.xxhash64("doc_id").bitwiseAND(F.lit(2**53 - 1)) / F.lit(2.0**53)).alias("h")
    keyed = ids.select("*", h)
    n = ids.count()
    bound = 1.0 if n <= 2 * most else 1.5 * most / n + 0.001
    if bound < 1.0 and keyed.filter(F.col("h") < bound).count() < most:
        bound = 1.0
    return keyed.filter(F.col("h") < bound).orderBy("h", "doc_id").limit(most)


def _texts(documents: DataFrame, ids: DataFrame) -> list:
    """The texts of few ids, in the order of their hashes."""
    return documents.select("doc_id", "text").join(ids, "doc_id").orderBy("h", "doc_id").collect()


def fit(documents: DataFrame, ratings: DataFrame) -> ReadingModel:
    """The model from rated documents and documents marked as being in another language.

    Half of the rated documents teach the sentence model (each sentence has its document's level,
    which the common sentences of a level outvote where raters err), the other half the
    calibration from a document's sentence distribution to its level.
    """
    filled = documents.filter(F.col("text").rlike(r"\S"))
    rated_ids = _smallest(filled.select("doc_id").join(rated_levels(ratings), "doc_id"), MAX_RATED)
    lang = F.lower(F.trim("lang"))
    foreign_ids = _smallest(filled.filter(~lang.isin("en", "eng", "english", "und", "unknown", "")).select("doc_id"), MAX_FOREIGN)
    rated = [(r.text, r.level) for r in _texts(documents, rated_ids)]
    foreign = [r.text for r in _texts(documents, foreign_ids)]
    half = len(rated) // 2
    parts: list[str] = []
    label: list[int] = []
    for r in [(x, LEVELS.index(level)) for x, level in rated[:half]] + [(x, len(LEVELS)) for x in foreign]:
        for s, prose in sentences(r[0]):
            if prose:
                parts.append(s)
                label.append(r[1])
    if not parts:
        parts, label = ["."], [0]
    at, what = features(parts)
    model = ReadingModel(*fit_softmax(at, what, np.array(label), len(CLASSES), FEATURES))
    x = model.summary([x for x, _ in rated[half:]])
    y = np.array([LEVELS.index(level) for _, level in rated[half:]], int)
    x = np.concatenate([np.log(x[:, :-1] + 0.02), np.ones((len(x), 1))], 1)
    cal = np.concatenate([np.eye(3), np.eye(3), np.zeros((1, 3))]) * 0.5
    for _ in range(400 if len(y) else 0):
        cal -= 0.2 * (x.T @ (_soft(x @ cal) - np.eye(3)[y]) / len(y) + 1e-3 * cal)
    model.calibration = cal
    return model


def reading_levels(documents: DataFrame, model: ReadingModel) -> DataFrame:
    """doc_id, level, difficulty, p_novice, p_practitioner, p_specialist, prose_share.

    difficulty is the expected level from 0 (novice) to 2 (specialist). level and difficulty are
    null for documents that do not consist mainly of English prose: null, empty and blank texts,
    other languages, code, logs and tables. Whole texts are read, in one pass without a shuffle;
    rows are kept as they are, repeated or not. The model (a megabyte, whatever the corpus) goes
    to every executor once.
    """
    ship(documents.sparkSession)
    sent = documents.sparkSession.sparkContext.broadcast((model.weights, model.bias, model.calibration))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = ReadingModel(*sent.value)
        for whole in batches:
            for at in range(0, whole.num_rows, 200):
                b = whole.slice(at, 200)
                s = m.summary(b.column(1).to_pylist())
                p = m.levels(s)
                no = s[:, -1] < PROSE_SHARE
                level = pa.array([None if n else LEVELS[k] for n, k in zip(no, p.argmax(1))], pa.string())
                yield pa.RecordBatch.from_arrays([b.column(0), level, pa.array(np.round(p @ np.arange(3.0), 6), mask=no), *[pa.array(np.round(p[:, c], 6), mask=no) for c in range(3)], pa.array(np.round(s[:, -1], 6))], ["doc_id", "level", "difficulty", "p_novice", "p_practitioner", "p_specialist", "prose_share"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, level string, difficulty double, p_novice double, p_practitioner double, p_specialist double, prose_share double")
