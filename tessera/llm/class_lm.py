"""Language-model scoring with a class-based bigram model.

Words are lower-cased in A-Z and split at ASCII white space; each text ends in an end token. Word counts
come from all training texts. The clustering starts with symbols: the end token, the most frequent words (at
most `WORDS`) and, for all other words, `SHAPES` buckets of word endings, so that the table that reaches the
driver is bounded by symbols squared. Exchange clustering moves each symbol to the class that raises the
class-bigram likelihood most, until a sweep moves none. Every other training word is then placed on its own,
words of one occurrence included: the classes before and after each of its occurrences are gathered by word
over the whole corpus, and it takes the class under which they are most likely. The class bigrams are counted
again with the final classes. A token's probability is
    weight * P(class | class before) * P(word | class) + (1 - weight) * P(word),
both word probabilities with add-one smoothing and one unseen word (in each class), the weight by EM on
leave-one-out probabilities: each training token is predicted from counts without itself. A word that training
does not have takes the class that most endings have.

Only the counts of a text's own words are needed to score it, but the vocabulary grows with the corpus. Texts
are therefore tokenised into blocks with a vocabulary of their own; the blocks' words are dealt by word, where
their counts and neighbours add up, and each block gets back the counts and classes of its words - nothing is
broadcast but the class tables and the symbols. Of a common word, each block has one row, and its neighbours
travel with frequent words' classes known before, so that only rarer words carry any.

Null texts count as empty (one end token); without training rows every token has probability 1 / 1 (N = V
= 0) and the class table is uniform; rows with null doc_id are training rows; repeated rows count as often
as they occur; a text of any length is one row of two bytes a token, twice; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.bpe import utf8
from tessera.llm.common import Memo, arrow_batches, discard, most_frequent, table, write_shared
from tessera.llm.language_id import held_out

WORDS, SHAPES, CLASSES = 511, 256, 64
SYMBOLS = 1 + WORDS + SHAPES
#: Tokens in a block, about.
BLOCK_TOKENS = 4_000_000
#: Bits of a word's place in its block, and of a block's number in its task.
IDX_BITS, BLOCK_BITS = 24, 16
_BLOCKS = "kind string, block long, doc_id long, train boolean, low binary, high binary, at long, hash long, n int, near binary"


def shape(word: bytes) -> int:
    """The bucket of a word's ending."""
    return zlib.crc32(word[-3:]) % SHAPES


def word_hash(word: bytes) -> int:
    h = xxhash.xxh64_intdigest(word)
    return h - (1 << 64) if h >> 63 else h


def training_counts(docs: DataFrame) -> DataFrame:
    """(hash, n) of each word of the texts of `docs`."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def summed() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array([word_hash(w) for w in seen], pa.int64()), pa.array(list(seen.values()), pa.int64())], names=["hash", "n"])
            seen.clear()
            return out

        for batch in batches:
            for raw in utf8(batch.column(0)):
                seen.update((raw or b"").lower().split())
            if len(seen) > 300_000:
                yield summed()
        yield summed()

    arrow_batches(docs.sparkSession)
    return docs.select(F.col("text").cast("string")).mapInArrow(rows, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n"))


def tokenised_blocks(docs: DataFrame, train: Column, first: FirstClasses) -> DataFrame:
    """One row for each text (its words as places in the block's vocabulary) and for each word of each block.

    at: block and place; n: occurrences in training texts; near, for words that are to be placed: the classes before
    and after, a byte each, of those occurrences."""
    names = [x.split()[0] for x in _BLOCKS.split(", ")]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
    shared = docs.sparkSession.sparkContext.broadcast(first)  # symbols

    def batch_of(size: int, **cols) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(cols[c], t) if c in cols else pa.nulls(size, t) for c, t in zip(names, kinds, strict=True)], names=names)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << BLOCK_BITS
        vocab: dict[bytes, int] = {}
        known_ids: list[np.ndarray] = []
        held, none = 0, np.zeros(1, np.int64)

        def words_of_block() -> Iterator[pa.RecordBatch]:
            words, m = list(vocab), len(vocab)
            hashes = np.fromiter(map(word_hash, words), np.int64, m)
            of, asked = np.zeros(m + 1, np.int64), np.zeros(m + 1, bool)
            of[1:], asked[1:] = shared.value.of(hashes, np.fromiter(map(shape, words), np.int64, m))
            ids = np.concatenate([none, *known_ids, none])
            times = np.bincount(ids, minlength=m + 1)
            here = np.flatnonzero(asked[ids])
            here = here[np.argsort(ids[here], kind="stable")]
            of = of.astype(np.uint8)[ids]
            data = np.stack([of[here - 1], of[here + 1]], 1).tobytes()
            end = np.r_[0, np.cumsum(np.where(asked, 2 * times, 0)[1:])]
            near = pa.LargeBinaryArray.from_buffers(pa.large_binary(), m, [None, pa.py_buffer(end.astype(np.int64)), pa.py_buffer(data)])
            for lo in range(0, m, 50_000):
                k = min(50_000, m - lo)
                yield batch_of(k, kind=["word"] * k, at=(block << IDX_BITS) + np.arange(lo, lo + k), hash=hashes[lo : lo + k], n=times[lo + 1 : lo + 1 + k].astype(np.int32), near=near.slice(lo, k).cast(pa.binary()))

        for batch in batches:
            low, high = [], []
            for known, raw in zip(batch.column(1).to_pylist(), utf8(batch.column(2)), strict=True):
                words = (raw or b"").lower().split()
                ids = np.fromiter((vocab.setdefault(w, len(vocab)) for w in words), np.uint32, len(words))
                held += len(ids)
                if known:
                    known_ids += [ids.astype(np.int64) + 1, none]
                low.append((ids & 0xFFFF).astype("<u2").tobytes())
                high.append((ids >> 16).astype("<u2").tobytes())
            n = batch.num_rows
            yield batch_of(n, kind=["text"] * n, block=np.full(n, block), doc_id=batch.column(0), train=batch.column(1), low=low, high=high)
            if held >= BLOCK_TOKENS:
                yield from words_of_block()
                vocab, known_ids, held, block = {}, [], 0, block + 1
        if vocab:
            yield from words_of_block()

    arrow_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), train.alias("train"), F.col("text").cast("string")).mapInArrow(rows, _BLOCKS)


@dataclass
class Symbols:
    """Places of the frequent words by hash; 0 is the end token, buckets of endings follow the words."""

    place: dict[int, int]

    def of(self, word: bytes) -> int:
        return self.place.get(word_hash(word)) or 1 + WORDS + shape(word)


def symbol_bigrams(docs: DataFrame, symbols: Symbols) -> np.ndarray:
    """Counts of neighbouring symbols in the texts of `docs`, an end token before and after each."""
    shared = docs.sparkSession.sparkContext.broadcast(symbols)  # at most WORDS entries

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, total = Memo(shared.value.of), np.zeros(SYMBOLS * SYMBOLS, np.int64)
        for batch in batches:
            parts = [np.zeros(1, np.int64)]
            for raw in utf8(batch.column(0)):
                words = (raw or b"").lower().split()
                parts += [np.fromiter(map(memo.__getitem__, words), np.int64, len(words)), np.zeros(1, np.int64)]
            s = np.concatenate(parts)
            total += np.bincount(s[:-1] * SYMBOLS + s[1:], minlength=SYMBOLS * SYMBOLS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["pair", "n"])

    arrow_batches(docs.sparkSession)
    found = docs.select(F.col("text").cast("string")).mapInArrow(rows, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(SYMBOLS * SYMBOLS)
    out[found["pair"].to_numpy()] = found["n"].to_numpy()
    return out.reshape(SYMBOLS, SYMBOLS)


def exchange_clusters(bigrams: np.ndarray, classes: int = CLASSES) -> np.ndarray:
    """The class of each symbol; symbol 0 (the end token) keeps class 0 to itself."""
    n_symbols = len(bigrams)
    weight = bigrams.sum(0) + bigrams.sum(1)
    order = np.argsort(-weight, kind="stable")
    order = order[order != 0]
    of = np.zeros(n_symbols, np.int64)
    of[order] = 1 + np.arange(len(order)) % (classes - 1)
    member = np.eye(classes)[of]
    to, back = bigrams @ member, bigrams.T @ member  # symbol to class, class to symbol
    table_ = member.T @ to

    def h(x: np.ndarray) -> np.ndarray:
        return x * np.log(np.maximum(x, 1e-12))

    least_gain = 1e-9 + 1e-12 * float(h(bigrams.sum()))  # beyond rounding, so that every move is a gain and the sweeps end
    moved = 1
    while moved:
        moved = 0
        for s in order[weight[order] > 0]:
            old, own = of[s], bigrams[s, s]
            right, left = to[s].copy(), back[s].copy()
            right[old] -= own
            left[old] -= own
            table_[old] -= to[s]
            table_[:, old] -= back[s]
            table_[old, old] += own
            rows, cols = table_.sum(1), table_.sum(0)
            across = h(table_ + right[None, :]) - h(table_) + (h(table_ + left[:, None]) - h(table_)).T
            diagonal = np.diagonal(table_)
            gain = across.sum(1) - np.diagonal(across) + h(diagonal + right + left + own) - h(diagonal)
            gain -= h(rows + right.sum() + own) - h(rows) + h(cols + left.sum() + own) - h(cols)
            gain[0] = -np.inf
            new = int(gain.argmax())
            if gain[new] <= gain[old] + least_gain:
                new = old
            moved += new != old
            of[s] = new
            if new != old:
                to[:, old] -= bigrams[:, s]
                to[:, new] += bigrams[:, s]
                back[:, old] -= bigrams[s]
                back[:, new] += bigrams[s]
            table_[new] += to[s]
            table_[:, new] += back[s]
            table_[new, new] -= bigrams[s, s]
    return of


def token_places(low: bytes, high: bytes) -> np.ndarray:
    """Places in the block's vocabulary from 1 on, an end token (0) last."""
    ids = np.zeros(len(low) // 2 + 1, np.int64)
    ids[:-1] = np.frombuffer(low, "<u2").astype(np.int64) + (np.frombuffer(high, "<u2").astype(np.int64) << 16) + 1
    return ids


@dataclass
class FirstClasses:
    """Classes of the symbols: frequent words by hash, ascending, and the others by their endings."""

    hashes: np.ndarray
    of_hash: np.ndarray
    of_shape: np.ndarray
    step: np.ndarray
    held: np.ndarray

    @classmethod
    def learn(cls, bigrams: np.ndarray, frequent: list[int], classes: int = CLASSES) -> FirstClasses:
        of = exchange_clusters(bigrams, classes)
        member = np.eye(classes)[of]
        pairs = member.T @ bigrams @ member
        hashes = np.array(frequent, np.int64)
        by = np.argsort(hashes)
        return cls(hashes[by], of[1 : 1 + len(hashes)][by], of[1 + WORDS :], transitions(pairs), pairs.sum(0))

    def of(self, hashes: np.ndarray, shapes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(class of each word, whether it is to be placed on its own)."""
        k = self.of_shape[shapes]
        if not len(self.hashes):
            return k, np.ones(len(k), bool)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        frequent = self.hashes[at] == hashes
        k[frequent] = self.of_hash[at[frequent]]
        return k, ~frequent

    def best(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The likeliest class of words with such counts of classes before and after."""
        log = np.log(self.step)
        gain = left @ log + right @ log.T - left.sum(1, keepdims=True) * np.log(self.held + 1)
        gain[:, 0] = -np.inf
        unseen = ~(left.any(1) | right.any(1))
        gain[unseen] = np.bincount(self.of_shape, minlength=len(self.held))
        return gain.argmax(1)


def transitions(pairs: np.ndarray) -> np.ndarray:
    return (pairs + 0.1) / (pairs.sum(1, keepdims=True) + 0.1 * len(pairs))


def chunk_of(x: pa.ChunkedArray) -> pa.Array:
    x = x.combine_chunks()
    return x if isinstance(x, pa.Array) else pa.concat_arrays(x.chunks)


#: A word's count, class and lead (whether the row is the first of its word) in one number.
_VALUE = "at long, value long"


def placed_words(words: DataFrame, first: FirstClasses) -> DataFrame:
    """(at, value) of each word of each block: its corpus count and its class, by the neighbours of all its occurrences."""
    shared = words.sparkSession.sparkContext.broadcast(first)  # symbols
    classes = len(first.step)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        none = np.zeros(0, np.int64)
        held = none, none, none, np.zeros((2, classes))  # the last word so far: at and hash of its rows, n; its neighbours
        frequent = {int(h): int(k) for h, k in zip(m.hashes, m.of_hash, strict=True)}

        def judged(at: np.ndarray, h: np.ndarray, group: np.ndarray, c: np.ndarray, near: np.ndarray) -> pa.RecordBatch:
            lead = np.r_[True, group[1:] != group[:-1]] if len(group) else np.zeros(0, bool)
            k = m.best(near[0], near[1])
            for i, x in enumerate(h[lead].tolist()):
                if x in frequent:
                    k[i] = frequent[x]
            return pa.RecordBatch.from_arrays([pa.array(at), pa.array(c[group] << 9 | lead.astype(np.int64) << 8 | k[group])], names=["at", "value"])

        for batch in batches:
            if not batch.num_rows:
                continue
            raw = batch.column(3).to_pylist()
            times = np.r_[np.zeros(len(held[0]), np.int64), [len(x) // 2 for x in raw]].astype(np.int64)
            at, h, n = (np.r_[old, batch.column(i).to_numpy().astype(np.int64)] for i, old in enumerate(held[:3]))
            group = np.cumsum(np.r_[True, h[1:] != h[:-1]]) - 1
            pairs = np.frombuffer(b"".join(raw), np.uint8).reshape(-1, 2).astype(np.int64)
            size, owner = int(group[-1]) + 1, np.repeat(group, times)
            near = np.stack([np.bincount(owner * classes + pairs[:, side], minlength=size * classes).reshape(size, classes) for side in (0, 1)]).astype(float)
            near[:, 0] += held[3]
            c = np.bincount(group, n, size).astype(np.int64)
            done = group < size - 1
            yield judged(at[done], h[done], group[done], c[: size - 1], near[:, : size - 1])
            held = at[~done], h[~done], n[~done], near[:, size - 1]
        if len(held[0]):
            yield judged(held[0], held[1], np.zeros(len(held[0]), np.int64), held[2].sum(keepdims=True), held[3][:, None])

    arrow_batches(words.sparkSession, 10_000)
    return words.select("at", "hash", "n", "near").repartition("hash").sortWithinPartitions("hash").mapInArrow(rows, _VALUE)


def classed_texts(texts: DataFrame, words: DataFrame, ends: int) -> DataFrame:
    """(doc_id, train, n_tokens, n_known, gain, classes) of each text; gain: the sum of log10(c + 1); classes: a byte for each token."""
    schema = "doc_id long, train boolean, n_tokens long, n_known long, gain double, classes binary"

    def classed(texts: pa.Table, vocab: pa.Table) -> pa.Table:
        idx, value = vocab["at"].to_numpy() & ((1 << IDX_BITS) - 1), vocab["value"].to_numpy()
        c, k = np.zeros(len(idx) + 1, np.int64), np.zeros(len(idx) + 1, np.uint8)
        c[0] = ends
        c[idx + 1], k[idx + 1] = value >> 9, (value & 0xFF).astype(np.uint8)
        gain, known = np.log10(c + 1.0), c > 0
        found = [token_places(*x) for x in zip(texts["low"].to_pylist(), texts["high"].to_pylist(), strict=True)]
        cols = [
            chunk_of(texts["doc_id"]), chunk_of(texts["train"]), pa.array([len(x) for x in found], pa.int64()), pa.array([int(known[x].sum()) for x in found], pa.int64()),
            pa.array([float(gain[x].sum()) for x in found], pa.float64()), pa.array([k[x].tobytes() for x in found], pa.binary()),
        ]
        return pa.Table.from_arrays(cols, names=[x.split()[0] for x in schema.split(", ")])

    arrow_batches(texts.sparkSession)
    blocks = texts.select("block", "doc_id", "train", "low", "high").groupBy("block")
    return blocks.cogroup(words.select(F.shiftright("at", IDX_BITS).alias("block"), "at", "value").groupBy("block")).applyInArrow(classed, schema)


def class_bigrams(texts: DataFrame, classes: int = CLASSES) -> np.ndarray:
    """Counts of neighbouring classes in training texts, an end token before and after each."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(classes * classes, np.int64)
        for batch in batches:
            k = np.frombuffer(b"\0" + b"".join(batch.column(0).to_pylist()), np.uint8).astype(np.int64)
            total += np.bincount(k[:-1] * classes + k[1:], minlength=classes * classes)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["pair", "n"])

    arrow_batches(texts.sparkSession)
    found = texts.where("train").select("classes").mapInArrow(rows, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(classes * classes)
    out[found["pair"].to_numpy()] = found["n"].to_numpy()
    return out.reshape(classes, classes)


@dataclass
class ClassModel:
    """bonus: log10 of a token's probability less log10(c + 1), by class before and class."""

    bonus: np.ndarray
    tokens: int
    types: int
    weight: float

    @property
    def base(self) -> float:
        return float(np.log10(self.tokens + self.types + 1))


def class_model(pairs: np.ndarray, types_of: np.ndarray, tokens: int) -> ClassModel:
    """types_of: distinct training words of each class."""
    types = int(types_of.sum())
    room = pairs.sum(0) + types_of + 1  # add-one smoothing with one unseen word in each class
    a, b = transitions(pairs) / room[None, :], 1 / (tokens + types + 1)
    # Leaving one out: a token's own pair, and its own place in its class and in the corpus, do not count; c + 1 becomes c in both parts.
    seen = pairs > 0
    rest = (np.where(seen, pairs - 1, 0) + 0.1) / (pairs.sum(1, keepdims=True) - 1 + 0.1 * len(pairs)).clip(0.1) / (room - 1).clip(1)[None, :]
    weight, other = 0.5, 1 / max(tokens + types, 1)
    for _ in range(30 if pairs.sum() else 0):
        weight = float((pairs * (weight * rest / (weight * rest + (1 - weight) * other))).sum() / pairs.sum())
    weight = min(weight, 0.99)
    return ClassModel(np.log10(weight * a + (1 - weight) * b), tokens, types, weight)


def learn_classes(docs: DataFrame) -> FirstClasses:
    """docs: the training rows."""
    counts = write_shared(training_counts(docs), "lm-counts")
    frequent = sorted(r.hash for r in most_frequent(counts, WORDS).select("hash").collect())
    discard(counts)
    return FirstClasses.learn(symbol_bigrams(docs, Symbols({h: i + 1 for i, h in enumerate(frequent)})), frequent)


def score_texts(texts: DataFrame, model: ClassModel) -> DataFrame:
    """(doc_id, train, n_tokens, n_known, train_tokens, base_score, score) of each text."""
    shared = texts.sparkSession.sparkContext.broadcast(model)  # classes squared
    schema = "doc_id long, train boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    names = [x.split()[0] for x in schema.split(", ")]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            n, gain = batch.column(2).to_numpy(), batch.column(4).to_numpy()
            k = np.frombuffer(b"\0" + b"".join(batch.column(5).to_pylist()), np.uint8)
            bonus = np.add.reduceat(m.bonus[k[:-1], k[1:]], np.cumsum(n) - n) if len(n) else gain
            cols = [*batch.columns[:4], pa.array(np.full(len(n), m.tokens)), pa.array(gain - n * m.base), pa.array(gain + bonus)]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    arrow_batches(texts.sparkSession)
    return texts.select("doc_id", "train", "n_tokens", "n_known", "gain", "classes").mapInArrow(score, schema)


def class_lm_scores(docs: DataFrame, train: Column) -> DataFrame:
    """Learns from the rows where `train` holds and scores all rows of docs (doc_id, text)."""
    first = learn_classes(docs.where(train))
    blocks = write_shared(tokenised_blocks(docs, train, first), "lm-blocks", "kind")
    texts, words = blocks.where("kind = 'text'"), blocks.where("kind = 'word'")
    ends = texts.where("train").count()
    placed = write_shared(placed_words(words, first), "lm-placed")
    discard(blocks, part="kind=word")
    classed = write_shared(classed_texts(texts, placed, ends), "lm-classed")
    discard(blocks, part="kind=text")
    types_of, tokens = np.zeros(CLASSES, np.int64), ends
    types_of[0] = ends > 0
    lead = placed.where(F.col("value").bitwiseAND(256) != 0).select(F.col("value").bitwiseAND(255).alias("class"), F.shiftright("value", 9).alias("c")).where("c > 0")
    for r in lead.groupBy("class").agg(F.count(F.lit(1)).alias("types"), F.sum("c").alias("c")).collect():  # at most CLASSES rows
        types_of[r["class"]] += r.types
        tokens += r.c
    discard(placed)
    return score_texts(classed, class_model(class_bigrams(classed), types_of, tokens))


def perplexity(scores: DataFrame) -> DataFrame:
    """Adds perplexity and base_perplexity of each text to scores."""
    return scores.withColumns({"perplexity": F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")), "base_perplexity": F.pow(F.lit(10.0), -F.col("base_score") / F.col("n_tokens"))})


def op1_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = class_lm_scores(table(spark, sf_dir, "documents"), ~held_out(2, 7))
    return scores.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
