"""Language identification of mixed-language texts.

Training counts letter n-grams (hashed to a fixed number of buckets) and scripts of each language over all
training documents, as distributed sums. A word's score under a language is its n-gram log-probability;
the scripts of its letters, found from code-point ranges, first narrow the languages that may claim it.
Viterbi over the words of a text, with a penalty for each switch, labels spans; the language with most
letters is the prediction, its share of the letters the score.

Viterbi runs over chunks of words in parallel: each chunk's best scores between any start and end language
form a small matrix, the matrices of a text are chained, and the labels follow backwards. It is exact.

Null texts and texts without a letter are `und` with score 0; ties go to the first language in sorted
order; rows with null lang are not learned from; without any training row every text is `und`; repeated
rows count as often as they occur in training; an empty table gives an empty result; texts of any length are
labelled whole, with the memory of some ten times the text; extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.bpe import utf8
from tessera.llm.common import arrow_batches, crc_of_id, released, table

UND = "und"
BUCKETS, ORDERS = 1 << 14, (1, 2, 3)
#: Cost, in natural-log units, of a change of language between two words.
SWITCH = 12.0
#: A script that makes up less than this share of a language's letters does not admit it.
SCRIPT_SHARE = 1e-3
#: Cost of a word for a language that its script does not admit.
FOREIGN = 30.0
MEMO_WORDS = 300_000
#: Words whose n-grams are held at a time.
PART_WORDS = 20_000
#: Words of a Viterbi chunk, and cells (words times languages) that are worked on at a time.
CHUNK, CELLS = 64, 4_000_000
#: First code points of script ranges, ascending; letters in no other range count as "other".
SCRIPTS = [
    (0x0041, "latin"), (0x02B0, "other"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"), (0x0780, "other"),
    (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "other"), (0x0B80, "tamil"), (0x0C00, "telugu"), (0x0C80, "other"), (0x0E00, "thai"), (0x0E80, "other"),
    (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "ethiopic"), (0x1380, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x3040, "kana"),
    (0x3100, "other"), (0x3400, "han"), (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "other"), (0x20000, "han"), (0x30000, "other"),
]
SCRIPT_NAMES = sorted({name for _, name in SCRIPTS})
_STARTS = np.array([a for a, _ in SCRIPTS])
_SCRIPT = np.array([SCRIPT_NAMES.index(name) for _, name in SCRIPTS])
_LETTER: np.ndarray | None = None


def letters(points: np.ndarray) -> np.ndarray:
    """Which code points are letters."""
    global _LETTER
    if _LETTER is None:
        _LETTER = np.array([chr(c).isalpha() for c in range(0x20000)])
    out = np.zeros(len(points), bool)
    low = points < 0x20000
    out[low] = _LETTER[points[low]]
    if not low.all():
        out[~low] = [chr(c).isalpha() for c in points[~low].tolist()]
    return out


def word_features(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(word of each n-gram, its bucket, word of each letter, its script, letters of each word)."""
    points = np.frombuffer(" ".join([w.decode("utf-8").lower() for w in words]).encode("utf-32-le") + b"\x20\0\0\0", np.uint32).astype(np.int64)
    owner = np.cumsum(points == 0x20)
    owner[points == 0x20] -= 1
    is_letter = letters(points)
    keep = is_letter | (points == 0x20)
    points, owner, is_letter = points[keep], owner[keep], is_letter[keep]
    n_letters = np.bincount(owner[is_letter], minlength=len(words))
    script = _SCRIPT[np.maximum(np.searchsorted(_STARTS, points[is_letter], "right") - 1, 0)]
    padded = np.where(is_letter, points, 1)
    grams, owners = [], []
    for order in ORDERS:
        if len(padded) < order:
            continue
        m = len(padded) - order + 1
        code = np.full(m, order, np.uint64)
        inside = np.zeros(m, bool)
        for k in range(order):
            code = code * np.uint64(0x9E3779B97F4A7C15) + padded[k : k + m].astype(np.uint64)
            inside |= is_letter[k : k + m]
            if 0 < k < order - 1:
                inside &= is_letter[k : k + m]
        code ^= code >> np.uint64(29)
        code *= np.uint64(0xBF58476D1CE4E5B9)
        # An n-gram belongs to the word of its first letter; a leading boundary is the end of the word before.
        first = np.where(is_letter[:m], owner[:m], owner[min(1, order - 1) : m + min(1, order - 1)])
        grams.append(((code >> np.uint64(40)) % np.uint64(BUCKETS)).astype(np.int64)[inside])
        owners.append(first[inside])
    return np.concatenate(owners), np.concatenate(grams), owner[is_letter], script, n_letters


@dataclass
class LanguageModel:
    """Log-probabilities of buckets [BUCKETS, languages] and admitted scripts [scripts, languages]."""

    languages: list[str]
    log_p: np.ndarray
    admits: np.ndarray

    def score(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(scores [words, languages], best of a word 0; letters of each word)."""
        owner, gram, letter_owner, script, n = word_features(words)
        out = np.stack([np.bincount(owner, self.log_p[gram, k], len(words)) for k in range(len(self.languages))], 1) / len(ORDERS)
        shares = np.stack([np.bincount(letter_owner, self.admits[script, k], len(words)) for k in range(len(self.languages))], 1)
        out -= FOREIGN * ((shares < 0.5 * n[:, None]) & (shares.max(1) >= 0.5 * n)[:, None])
        out -= out.max(1, keepdims=True)
        out[n == 0] = 0
        return np.maximum(out, -2 * FOREIGN).astype(np.float32), n


def train_languages(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> LanguageModel:
    """Counts over all rows with a language; what reaches the driver is bounded by languages times buckets."""
    n_scripts = len(SCRIPT_NAMES)

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: dict[str, Counter] = defaultdict(Counter)
        total: dict[str, np.ndarray] = {}

        def fold() -> None:
            for lang, seen in words.items():
                if seen:
                    keys, times = list(seen), np.array(list(seen.values()), float)
                    for at in range(0, len(keys), PART_WORDS):
                        owner, gram, letter_owner, script, _ = word_features(keys[at : at + PART_WORDS])
                        n = times[at : at + PART_WORDS]
                        sums = np.concatenate([np.bincount(gram, n[owner], BUCKETS), np.bincount(script, n[letter_owner], n_scripts)])
                        total[lang] = total.get(lang, 0) + sums
            words.clear()

        for batch in released(batches):
            for lang, raw in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), strict=True):
                words[lang].update((raw or b"").split())
            if sum(map(len, words.values())) > MEMO_WORDS:
                fold()
        fold()
        for lang, sums in total.items():
            at = np.flatnonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(sums[at].astype(np.int64))], names=["lang", "bucket", "n"])

    arrow_batches(docs.sparkSession)
    rows = docs.where(F.col(lang_col).isNotNull()).select(F.col(lang_col).cast("string"), F.col(text_col).cast("string"))
    summed = rows.mapInArrow(counts, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(summed.lang.unique())
    matrix = np.zeros((BUCKETS + n_scripts, len(languages)))
    matrix[summed.bucket.to_numpy(), np.searchsorted(languages, summed.lang.to_numpy().astype(str)) if languages else []] = summed.n.to_numpy()
    grams, scripts = matrix[:BUCKETS], matrix[BUCKETS:]
    log_p = np.log((grams + 0.5) / (grams.sum(0) + 0.5 * BUCKETS))
    admits = (scripts / np.maximum(scripts.sum(0), 1) >= SCRIPT_SHARE).astype(float)
    return LanguageModel(languages, log_p, admits)


def viterbi(scores: np.ndarray, lengths: np.ndarray, switch: float = SWITCH, chunk: int = CHUNK) -> np.ndarray:
    """Best language of each word; texts lie one after the other, `lengths` words each."""
    n, k = scores.shape
    if not n:
        return np.zeros(0, np.int64)
    per_doc = -(-lengths // chunk)
    doc_of = np.repeat(np.arange(len(lengths)), per_doc)
    first = np.cumsum(per_doc) - per_doc
    place = np.arange(len(doc_of)) - first[doc_of]
    starts = (np.cumsum(lengths) - lengths)[doc_of] + place * chunk
    sizes = np.minimum(chunk, lengths[doc_of] - place * chunk)
    padded = np.zeros((chunk, len(doc_of), k), np.float32)
    word = np.arange(n)
    chunk_of = np.repeat(np.arange(len(doc_of)), sizes)
    padded[word - starts[chunk_of], chunk_of] = scores
    through = np.where(np.eye(k, dtype=bool), 0, -np.inf).astype(np.float32)[None].repeat(len(doc_of), 0)
    for t in range(chunk):
        through = np.maximum(through, through.max(2, keepdims=True) - switch) + padded[t][:, None, :]
    entering = np.zeros((len(doc_of), k), np.float32)
    for p in range(int(place.max())):
        here = first[per_doc > p + 1] + p
        v = (entering[here][:, :, None] + through[here]).max(1)
        entering[here + 1] = v - v.max(1, keepdims=True)
    kind = np.min_scalar_type(k)  # unsigned, as wide as the number of languages asks for
    back = np.empty((chunk, len(doc_of), k), kind)
    own, v = np.arange(k, dtype=kind)[None], entering
    for t in range(chunk):
        best = v.max(1, keepdims=True)
        stay = v >= best - switch
        back[t] = np.where(stay, own, v.argmax(1)[:, None].astype(kind))
        v = np.where(stay, v, best - switch) + padded[t]
    label = np.empty((chunk, len(doc_of), k), kind)
    state = np.broadcast_to(np.arange(k), (len(doc_of), k))
    for t in range(chunk - 1, -1, -1):
        label[t] = state
        state = np.take_along_axis(back[t], state, 1).astype(np.int64)
    end = np.empty(len(doc_of), np.int64)
    last = first + per_doc - 1
    last = last[per_doc > 0]
    end[last] = v[last].argmax(1)
    for p in range(int(place.max()), 0, -1):
        here = first[per_doc > p] + p
        end[here - 1] = state[here, end[here]]
    return label[word - starts[chunk_of], chunk_of, end[chunk_of]].astype(np.int64)


class Labeller:
    """Remembers the scores of words between batches."""

    def __init__(self, model: LanguageModel):
        self.model, self.place = model, {}
        self.scores, self.letters = np.zeros((1024, len(model.languages)), np.float32), np.zeros(1024, np.int64)

    def label(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(language of each word, letters of each word, words of each text)."""
        split = [(t or b"").split() for t in texts]
        if len(self.place) > MEMO_WORDS:
            self.place.clear()
        place = self.place
        new = list({w for words in split for w in words if w not in place})
        if new:
            base = len(place)
            if base + len(new) > len(self.letters):
                grow = 2 * (base + len(new))
                self.scores = np.concatenate([self.scores[:base], np.zeros((grow - base, self.scores.shape[1]), np.float32)])
                self.letters = np.concatenate([self.letters[:base], np.zeros(grow - base, np.int64)])
            for at in range(0, len(new), PART_WORDS):
                part = new[at : at + PART_WORDS]
                s, n = self.model.score(part)
                self.scores[base + at : base + at + len(part)], self.letters[base + at : base + at + len(part)] = s, n
            place.update(zip(new, range(base, base + len(new)), strict=True))
        lengths = np.array([len(w) for w in split], np.int64)
        at = np.fromiter((place[w] for words in split for w in words), np.int64, int(lengths.sum()))
        k = len(self.model.languages)
        chunk = max(CHUNK, min(16 * k, int(lengths.max(initial=0))))  # with many languages a chunk's matrix is large: longer chunks, fewer matrices
        cells = np.cumsum(-(-lengths // chunk) * chunk * k)
        ends = np.cumsum(lengths)
        labels, lo = [np.zeros(0, np.int64)], 0
        while lo < len(lengths):
            hi = max(int(np.searchsorted(cells, (cells[lo - 1] if lo else 0) + CELLS, "right")), lo + 1)
            labels.append(viterbi(self.scores[at[ends[lo] - lengths[lo] : ends[hi - 1]]], lengths[lo:hi], chunk=chunk))
            lo = hi
        return np.concatenate(labels), self.letters[at], lengths


def language_id(docs: DataFrame, model: LanguageModel, spans: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, lang_pred, score), with `spans` the labelled runs of words (lang, start, words) of each text, and the columns to keep."""
    schema = "doc_id long, lang_pred string, score double" + ", spans array<struct<lang:string,start:int,words:int>>" * spans + "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # languages times buckets: bounded
    others = [c for c in keep if c != "text"]
    span_type = pa.list_(pa.struct([("lang", pa.string()), ("start", pa.int32()), ("words", pa.int32())]))

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = shared.value.languages
        labeller = Labeller(shared.value) if names else None
        for batch in released(batches):
            texts = utf8(batch.column(1))
            pred, score, runs = [UND] * len(texts), np.zeros(len(texts)), [[] for _ in texts]
            if labeller:
                labels, n, lengths = labeller.label(texts)
                owner = np.repeat(np.arange(len(texts)), lengths)
                weight = np.bincount(owner * len(names) + labels, n, len(texts) * len(names)).reshape(len(texts), -1)
                total = weight.sum(1)
                pred = [names[k] if t else UND for k, t in zip(weight.argmax(1), total, strict=True)]
                score = np.where(total > 0, weight.max(1) / np.maximum(total, 1), 0.0)
                if spans and len(labels):
                    start = np.cumsum(lengths) - lengths
                    cut = np.flatnonzero(np.r_[True, (labels[1:] != labels[:-1]) | (owner[1:] != owner[:-1])])
                    for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(labels)], strict=True):
                        runs[owner[a]].append({"lang": names[labels[a]], "start": int(a - start[owner[a]]), "words": b - a})
            cols = [batch.column(0), pa.array(pred, pa.string()), pa.array(score, pa.float64()), *([pa.array(runs, span_type)] * spans), *(batch.column(1 if c == "text" else 2 + others.index(c)) for c in keep)]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "lang_pred", "score", *["spans"] * spans, *keep])

    arrow_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), *others).mapInArrow(label, schema)


def held_out(rest: int, modulus: int) -> F.Column:
    return F.coalesce(crc_of_id() % modulus == rest, F.lit(False))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train_languages(docs.where(~held_out(2, 4)))
    return language_id(docs, model).select("doc_id", held_out(2, 4).alias("held_out"), "lang_pred", "score")
