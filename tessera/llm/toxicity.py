"""Toxicity: a support vector machine on a gap-weighted subsequence kernel with Nyström landmarks.

k(s, t) sums, over all letter triples that s and t share in order, decay^(span in s + span in t), for
spans up to `SPAN`, and is normalised to k(s, s) = 1. Words with letters inserted, left out or pulled
apart by blanks so stay near the word they disguise. A text is the set of its words: its kernel with a
landmark word is the largest over its words (values under `FLOOR` count as 0). Landmarks, at most
`n_landmarks`, are words that mark labelled toxic texts and frequent words, chosen to be unlike each
other; K_mm^(-1/2) maps the kernels with them to features of a linear SVM (squared hinge, Newton steps),
and a logistic curve fitted on held-back rows turns its margin into a score.

The classifier is fitted on at most `max_rows` labelled rows, those with the smallest hash of doc_id; all
texts are scored whole. Null texts count as empty and score as a text without any match; null labels are
no training rows; a row labelled twice counts with its larger label; without both labels in training
every score is the share of toxic rows (0 without rows); empty tables give empty results; extra columns
are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.bpe import utf8
from tessera.llm.common import arrow_batches, table, write_shared
from tessera.llm.language_id import held_out, letters

DECAY, SPAN, FLOOR = 0.7, 6, 0.3
MAX_ROWS, N_LANDMARKS = 24_000, 128
#: Two landmarks may be this much alike.
ALIKE = 0.75
THRESHOLD = 0.3
MEMO_WORDS = 400_000
_PATTERNS = [(a, b) for b in range(2, SPAN) for a in range(1, b)]


def text_words(raw: bytes | None) -> set[bytes]:
    """Distinct words; three or more single characters in a row also count as one word."""
    words = (raw or b"").lower().split()
    out = set(words)
    if sum(1 for w in words if len(w) == 1) >= 3:
        run: list[bytes] = []
        for w in [*words, b"--"]:
            if len(w) == 1:
                run.append(w)
            else:
                if len(run) >= 3:
                    out.add(b"".join(run))
                run = []
    return out


def subsequences(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(word, code, weight) of each distinct letter triple of each word, and the norm of each word."""
    points = np.frombuffer((" ".join([w.decode("utf-8").lower() for w in words]) + " ").encode("utf-32-le"), np.uint32).astype(np.int64)
    owner = np.cumsum(points == 0x20)
    owner[points == 0x20] -= 1
    keep = letters(points)
    points, owner = points[keep] & 0x3FFF, owner[keep]
    n = len(points)
    codes, weights, owners = [], [], []
    for a, b in _PATTERNS:
        m = n - b
        if m <= 0:
            continue
        same = owner[:m] == owner[b:]
        codes.append(((points[:m] << 28) | (points[a : m + a] << 14) | points[b:])[same])
        owners.append(owner[:m][same])
        weights.append(np.full(len(codes[-1]), DECAY ** (b + 1)))
    norm = np.zeros(len(words))
    if not codes:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), norm
    code, word, weight = np.concatenate(codes), np.concatenate(owners), np.concatenate(weights)
    order = np.lexsort((code, word))
    code, word, weight = code[order], word[order], weight[order]
    first = np.flatnonzero(np.r_[True, (code[1:] != code[:-1]) | (word[1:] != word[:-1])]) if len(code) else np.zeros(0, np.int64)
    code, word, weight = code[first], word[first], np.add.reduceat(weight, first) if len(first) else weight
    norm = np.sqrt(np.bincount(word, weight**2, len(words)))
    return word, code, weight, norm


@dataclass
class Landmarks:
    """Landmark words with their inverted triples."""

    words: list[bytes]
    codes: np.ndarray = field(init=False)
    owners: np.ndarray = field(init=False)
    weights: np.ndarray = field(init=False)

    def __post_init__(self):
        owner, code, weight, norm = subsequences(self.words)
        by = np.argsort(code, kind="stable")
        self.codes, self.owners, self.weights = code[by], owner[by], (weight / np.maximum(norm[owner], 1e-12))[by]

    def kernel(self, words: list[bytes]) -> np.ndarray:
        """Normalised kernel of each word with each landmark."""
        owner, code, weight, norm = subsequences(words)
        lo, hi = np.searchsorted(self.codes, code, "left"), np.searchsorted(self.codes, code, "right")
        times = hi - lo
        hit = np.flatnonzero(times)
        times = times[hit]
        at = np.repeat(lo[hit] - (np.cumsum(times) - times), times) + np.arange(times.sum())
        mine = np.repeat(hit, times)
        m = len(self.words)
        out = np.bincount(owner[mine] * m + self.owners[at], weight[mine] * self.weights[at], len(words) * m).reshape(len(words), m)
        return out / np.maximum(norm, 1e-12)[:, None]


class Pooler:
    """Kernels of texts with landmarks; remembers which words come near any landmark."""

    def __init__(self, landmarks: Landmarks):
        self.landmarks, self.place, self.rows = landmarks, {}, [np.zeros(len(landmarks.words), np.float32)]

    def pool(self, texts: list[bytes | None]) -> np.ndarray:
        sets = [text_words(t) for t in texts]
        if len(self.place) > MEMO_WORDS:
            self.place, self.rows = {}, self.rows[:1]
        place, rows = self.place, self.rows
        new = list({w for s in sets for w in s if w not in place})
        for at in range(0, len(new), 8192):
            part = new[at : at + 8192]
            k = self.landmarks.kernel(part)
            k[k < FLOOR] = 0
            near = np.flatnonzero(k.any(1))
            place.update(dict.fromkeys(part, 0))
            place.update(zip([part[i] for i in near], range(len(rows), len(rows) + len(near)), strict=True))
            rows += list(k[near].astype(np.float32))
        out = np.zeros((len(texts), len(self.landmarks.words)), np.float32)
        for i, s in enumerate(sets):
            found = {place[w] for w in s} - {0}
            if found:
                out[i] = np.max([rows[k] for k in found], axis=0)
        return out


@dataclass
class ToxicityModel:
    landmarks: Landmarks
    whiten: np.ndarray
    weights: np.ndarray
    bias: float
    slope: float
    offset: float

    def score(self, pooled: np.ndarray) -> np.ndarray:
        margin = pooled @ (self.whiten @ self.weights) + self.bias
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.offset, -40, 40)))


def choose_landmarks(candidates: list[bytes], most: int) -> list[bytes]:
    """Takes candidates in order unless one already taken is too much alike."""
    chosen: list[bytes] = []
    k = Landmarks(candidates).kernel(candidates) if candidates else np.zeros((0, 0))
    for i in range(len(candidates)):
        if k[i, i] > 0.5 and all(k[i, j] < ALIKE for j in chosen):
            chosen.append(i)
            if len(chosen) == most:
                break
    return [candidates[i] for i in chosen]


def squared_hinge_svm(x: np.ndarray, y: np.ndarray, cost: float = 1.0, steps: int = 30) -> tuple[np.ndarray, float]:
    """Weights and bias; y is -1 or 1. Newton steps on the support vectors, the bias is not shrunk."""
    xb = np.c_[x, np.ones(len(x))]
    w = np.zeros(xb.shape[1])
    ridge = np.eye(len(w))
    ridge[-1, -1] = 1e-6
    for _ in range(steps):
        inside = y * (xb @ w) < 1
        a = xb[inside]
        new = np.linalg.solve(ridge + 2 * cost * a.T @ a, 2 * cost * a.T @ y[inside])
        if np.abs(new - w).max() < 1e-8:
            break
        w = new if np.array_equal(w, np.zeros(len(w))) else 0.5 * (w + new)
    return w[:-1], float(w[-1])


def logistic_curve(margin: np.ndarray, y: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Slope and offset of the probability of label 1, with smoothed targets."""
    n1, n0 = max((y > 0).sum(), 1), max((y < 0).sum(), 1)
    t = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, float(np.log(n1 / n0))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -40, 40)))
        g = np.array([((p - t) * margin).sum() + 1e-3 * a, (p - t).sum()])
        s = p * (1 - p) + 1e-9
        h = np.array([[(s * margin**2).sum() + 1e-3, (s * margin).sum()], [(s * margin).sum(), s.sum() + 1e-9]])
        d = np.linalg.solve(h, g)
        a, b = a - d[0], b - d[1]
        if np.abs(d).max() < 1e-9:
            break
    return max(a, 0.0), b


def train_toxicity(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, n_landmarks: int = N_LANDMARKS) -> ToxicityModel:
    """Learns from rows of docs (doc_id, text) that labels (doc_id, toxic) cover."""
    spark = docs.sparkSession
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("y"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    # At most max_rows pairs of numbers: small enough to broadcast.
    train = write_shared(docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(sample), "doc_id").select("doc_id", "y", "text"), "toxicity-train")

    def word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = (Counter(), Counter())
        for batch in batches:
            for y, raw in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), strict=True):
                seen[int(y > 0)].update(text_words(raw))
        words = list(seen[0].keys() | seen[1].keys())
        yield pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array([seen[0][w] for w in words], pa.int64()), pa.array([seen[1][w] for w in words], pa.int64())], names=["word", "n0", "n1"])

    arrow_batches(spark)
    sizes = {r.y: r.n for r in train.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    n1 = sum(n for y, n in sizes.items() if y > 0)
    n0 = sum(sizes.values()) - n1
    if not n0 or not n1:
        share = n1 / max(n0 + n1, 1)
        return ToxicityModel(Landmarks([]), np.zeros((0, 0)), np.zeros(0), 0.0, 0.0, 40.0 if share == 1 else -40.0)
    counts = train.select("y", "text").mapInArrow(word_counts, "word binary, n0 long, n1 long").groupBy("word").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    odds = F.log((F.col("n1") + 0.5) / (n1 + 1.0)) - F.log((F.col("n0") + 0.5) / (n0 + 1.0))
    counts = write_shared(counts.where(F.col("n0") + F.col("n1") >= 3).withColumn("weight", F.col("n1") * odds), "toxicity-words")
    marked = [bytes(r.word) for r in counts.where((F.col("n1") >= 3) & (odds > 1)).orderBy(F.desc("weight"), "word").limit(1500).collect()]
    common = [bytes(r.word) for r in counts.orderBy(F.desc("n0"), "word").limit(1000).collect()]
    chosen = choose_landmarks(marked, n_landmarks * 3 // 4)
    landmarks = Landmarks(chosen + choose_landmarks([w for w in common if w not in set(marked)], n_landmarks - len(chosen)))
    pooled = pool_texts(train, landmarks, "y").toPandas().sort_values("doc_id")
    x, y = np.stack(pooled["kernels"].to_numpy()).astype(float), np.where(pooled["y"] > 0, 1.0, -1.0)
    k = landmarks.kernel(landmarks.words)
    values, vectors = np.linalg.eigh((k + k.T) / 2 + 1e-3 * np.eye(len(k)))
    whiten = vectors @ np.diag(np.maximum(values, 1e-6) ** -0.5) @ vectors.T
    held = np.arange(len(y)) % 3 == 0
    if not (held & (y > 0)).any() or not (~held & (y > 0)).any():
        held[:] = True
    fit = ~held if not held.all() else held
    w, b = squared_hinge_svm(x[fit] @ whiten, y[fit])
    slope, offset = logistic_curve(x[held] @ whiten @ w + b, y[held])
    return ToxicityModel(landmarks, whiten, w, b, slope, offset)


def pool_texts(docs: DataFrame, landmarks: Landmarks, *extra: str) -> DataFrame:
    """(doc_id, extra columns, kernels) of each text."""

    def pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pooler = Pooler(landmarks)
        for batch in batches:
            found = pooler.pool(utf8(batch.column(batch.num_columns - 1)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(list(found), pa.list_(pa.float32()))], names=["doc_id", *extra, "kernels"])

    kinds = "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in extra)
    arrow_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), *extra, F.col("text").cast("string")).mapInArrow(pool, f"doc_id long{kinds}, kernels array<float>")


def toxicity(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """(doc_id, score) of each text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # landmarks: bounded

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pooler = Pooler(shared.value.landmarks)
        for batch in batches:
            found = shared.value.score(pooler.pool(utf8(batch.column(1))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.float64())], names=["doc_id", "score"])

    arrow_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(score, "doc_id long, score double")


def op5_string_kernel_svm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train_toxicity(docs.where(~held_out(2, 4)), table(spark, sf_dir, "labels").where(~held_out(2, 4)))
    return toxicity(docs, model).select("doc_id", held_out(2, 4).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
