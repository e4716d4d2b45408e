"""BPE encoding and decoding with a transducer lexicon.

Frequent words, counted over the whole corpus, are compiled with their token ids into a minimal acyclic
automaton: states with equal right languages are shared, and the arcs carry numbers whose sum along a
word's path is the word's place in the table of id sequences. The automaton is one flat file that every
executor maps into memory. A word that is not in the lexicon is merged exactly, pair by pair in order of
rank, so the lexicon decides speed only, never a result.

Null texts count as empty; a text without tokens has zero ids and empty decoded text; texts of any length
are encoded whole; repeated rows and extra columns make no difference; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import mmap
import unicodedata
from array import array
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm.common import arrow_batches, discard, most_frequent, released, share_file, table, write_shared

WORD_BPE = "word_bpe_49k.json"
#: Bytes of a task's memory of encoded chunks and merged words.
MEMO_BYTES = 176 << 20
#: Words in the lexicon.
LEXICON_WORDS = 50_000
END = "</w>"
#: Stands for a pair that has no merge.
NONE = 1 << 60


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path(WORD_BPE)


def byte_characters() -> list[str]:
    """The printable character that byte-level vocabularies use for each byte."""
    shown = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


class Bpe:
    """Vocabulary and merges of a word-end BPE file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab: dict[str, int] = spec["model"]["vocab"]
        chars = byte_characters()
        self.inner, self.last = [vocab[c] for c in chars], [vocab[c + END] for c in chars]
        self.pairs: dict[int, int] = {}
        for rank, (a, b) in enumerate(x if isinstance(x, list) else x.split(" ") for x in spec["model"]["merges"]):
            self.pairs.setdefault(vocab[a] << 16 | vocab[b], rank << 16 | vocab[a + b])
        self.specials = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.tokens: list[str] = [""] * (max([*vocab.values(), *self.specials.values()]) + 1)
        for token, i in [*vocab.items(), *self.specials.items()]:
            self.tokens[i] = token
        self.special = regex.compile("|".join(map(regex.escape, sorted(self.specials, key=len, reverse=True))))
        self.word = regex.compile(next(x for x in spec["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split")["pattern"]["Regex"])

    def words(self, text: str) -> list[str]:
        """Normalised words of a text without special tokens."""
        if text.isascii():
            text = text.lower()
            return [text] if text.isalpha() else self.word.findall(text)
        text = unicodedata.normalize("NFC", text)
        return self.word.findall("".join(map(str.lower, text)) if "Σ" in text else text.lower())

    def merge(self, word: bytes) -> list[int]:
        """Token ids of one word, by exact merges."""
        ids = [self.inner[b] for b in word[:-1]] + [self.last[word[-1]]]
        if len(ids) > 48:
            return self._merge_long(ids)
        get = self.pairs.get
        found = [get(a << 16 | b, NONE) for a, b in zip(ids, ids[1:], strict=False)]
        while found and (best := min(found)) != NONE:
            at = found.index(best)
            new = ids[at] = best & 0xFFFF
            del ids[at + 1], found[at]
            if at:
                found[at - 1] = get(ids[at - 1] << 16 | new, NONE)
            if at < len(found):
                found[at] = get(new << 16 | ids[at + 1], NONE)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same with a heap, for long words."""
        n, get = len(ids), self.pairs.get
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(v >> 16, i, v & 0xFFFF) for i in range(n - 1) if (v := get(ids[i] << 16 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, new = heapq.heappop(heap)
            if ids[i] < 0 or (j := after[i]) < 0 or (v := get(ids[i] << 16 | ids[j])) is None or v & 0xFFFF != new:
                continue
            ids[i], ids[j], after[i] = new, -1, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b >= 0 and (v := get(ids[a] << 16 | ids[b])) is not None:
                    heapq.heappush(heap, (v >> 16, a, v & 0xFFFF))
        return [x for x in ids if x >= 0]


@lru_cache(maxsize=2)
def bpe(path: str) -> Bpe:
    return Bpe(path)


class Lexicon:
    """A minimal acyclic transducer from words to id sequences, over one flat buffer.

    Layout: four uint32 sizes (states, arcs, words, ids); first arc of each state (one more at the end);
    target and gain of each arc; offsets of the id sequences (one more at the end); ids; label of each arc;
    final flag of each state. The gain of an arc counts the words that sort before the words through it.
    """

    def __init__(self, buffer):
        view = memoryview(buffer)
        states, arcs, words, ids = np.frombuffer(buffer, "<u4", 4).tolist()
        at = 16

        def part(n: int, kind: str, size: int) -> memoryview:
            nonlocal at
            out = view[at : at + n * size].cast(kind)
            at += n * size
            return out

        self.first, self.target, self.gain = part(states + 1, "I", 4), part(arcs, "I", 4), part(arcs, "I", 4)
        self.offset, self.ids = part(words + 1, "I", 4), part(ids, "I", 4)
        self.label, self.final = bytes(part(arcs, "B", 1)), part(states, "B", 1)
        self.n_states, self.n_words = states, words

    def get(self, word: bytes) -> list[int] | None:
        """The ids of a word, or None if the lexicon has no such word."""
        state, place = 0, 0
        first, label = self.first, self.label
        for b in word:
            arc = label.find(b, first[state], first[state + 1])
            if arc < 0:
                return None
            place += self.gain[arc]
            state = self.target[arc]
        return self.ids[self.offset[place] : self.offset[place + 1]].tolist() if self.final[state] else None


def compile_lexicon(entries: Iterable[tuple[bytes, list[int]]]) -> bytes:
    """Builds the automaton from distinct words: sorted insertion with a register of shared states."""
    entries = sorted((w, i) for w, i in entries if w)
    register: dict[tuple, int] = {}
    frozen: list[tuple[bool, list[tuple[int, int]]]] = []

    def freeze(final: bool, arcs: list[tuple[int, int]]) -> int:
        key = (final, tuple(arcs))
        if key not in register:
            register[key] = len(frozen)
            frozen.append((final, arcs))
        return register[key]

    path: list[list] = [[False, []]]  # of the last word: final flag and frozen arcs of each state
    last = b""

    def shorten(to: int) -> None:
        while len(path) > to + 1:
            final, arcs = path.pop()
            path[-1][1].append((last[len(path) - 1], freeze(final, arcs)))

    for word, _ in entries:
        common = next((i for i, (a, b) in enumerate(zip(word, last, strict=False)) if a != b), min(len(word), len(last)))
        shorten(common)
        path += [[False, []] for _ in word[common:]]
        path[-1][0] = True
        last = word
    shorten(0)
    root = len(frozen)
    frozen.append((path[0][0], path[0][1]))
    order = {root: 0} | {s: i + 1 for i, s in enumerate(range(root))}
    counts = [0] * len(frozen)  # words that a state accepts; targets are frozen before their sources
    for s, (final, arcs) in enumerate(frozen):
        counts[s] = final + sum(counts[t] for _, t in arcs)
    first, target, gain, label, finals = [0], [], [], bytearray(), bytearray()
    for s in [root, *range(root)]:
        final, arcs = frozen[s]
        before = int(final)
        for b, t in arcs:
            label.append(b)
            target.append(order[t])
            gain.append(before)
            before += counts[t]
        first.append(len(target))
        finals.append(final)
    ids = [i for _, x in entries for i in x]
    offset = np.cumsum([0, *(len(x) for _, x in entries)])
    sizes = [len(frozen), len(target), len(entries), len(ids)]
    return b"".join([*(np.asarray(x, "<u4").tobytes() for x in (sizes, first, target, gain, offset, ids)), bytes(label), bytes(finals)])


@lru_cache(maxsize=2)
def mapped_lexicon(name: str) -> Lexicon:
    with open(SparkFiles.get(name), "rb") as f:
        return Lexicon(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))


@lru_cache(maxsize=2)
def library_merge(path: str):
    """Token ids of one word by the merges of the tokenizers library: what `Bpe.merge` gives, in less than half the time."""
    model, shown = Tokenizer.from_file(path).model, dict(enumerate(byte_characters()))
    return lambda word: [t.id for t in model.tokenize(word.decode("latin-1").translate(shown))]


class Encoder(dict):
    """Ids of white-space-free chunks of UTF-8 text, as little-endian uint32 bytes; one for each task.

    A word's ids come from the lexicon, and by exact merges where it has no such word; without a lexicon by those of the library. A task meets a new chunk every
    seventh word or so: what happens then is written out here instead of being called."""

    def __init__(self, path: str, lexicon: str | None):
        self.model, self.lexicon, self.held = bpe(path), mapped_lexicon(lexicon) if lexicon else None, 0
        self.merge = self.model.merge if lexicon else library_merge(path)
        self.merged: dict[str, bytes] = {}

    def __missing__(self, raw: bytes) -> bytes:
        chunk, merged, lexicon, merge = raw.decode("utf-8"), self.merged, self.lexicon, self.merge
        ids = b""
        for word in self.model.words(chunk) if "<|" not in chunk else self.with_specials(chunk):
            found = merged.get(word)
            if found is None:
                if type(word) is int:
                    found = array("I", [word]).tobytes()
                else:
                    utf8_word = word.encode()
                    known = lexicon.get(utf8_word) if lexicon else None
                    found = array("I", known or merge(utf8_word)).tobytes()
                    if not known:  # what the lexicon has need not be remembered
                        merged[word] = found
                        self.held += 180
            ids += found
        if self.held >= MEMO_BYTES:
            self.clear()
            merged.clear()
            self.held = 0
        self[raw] = ids
        self.held += 180 + len(raw)
        return ids

    def with_specials(self, chunk: str) -> Iterator[str | int]:
        """Words of a chunk, and the ids of special tokens in it."""
        at = 0
        for m in self.model.special.finditer(chunk):
            yield from self.model.words(chunk[at : m.start()])
            yield self.model.specials[m[0]]
            at = m.end()
        yield from self.model.words(chunk[at:])

    def text_ids(self, raw: bytes | None) -> bytes:
        return b"".join(map(self.__getitem__, (raw or b"").split()))


def utf8(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.binary()).to_pylist()


def frequent_words(docs: DataFrame, path: str, most: int, text_col: str = "text") -> list[str]:
    """The most frequent words of the whole corpus, `most` at most (see `most_frequent`); only those reach the driver."""

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, chunks = bpe(path).words, Counter()

        def summed() -> pa.RecordBatch:
            total: Counter = Counter()
            for chunk, n in chunks.items():
                for w in words(chunk.decode("utf-8")):
                    total[w] += n
            chunks.clear()
            return pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])

        for batch in batches:
            for raw in utf8(batch.column(0)):
                if raw:
                    chunks.update(raw.split())
            if len(chunks) > 400_000:
                yield summed()
        yield summed()

    arrow_batches(docs.sparkSession)
    found = write_shared(docs.select(F.col(text_col).cast("string")).mapInArrow(counts, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")), "bpe-words")
    words_ = sorted(r.word for r in most_frequent(found, most).select("word").collect())
    discard(found)
    return words_


def build_lexicon(docs: DataFrame, path: str, most: int = LEXICON_WORDS, text_col: str = "text") -> str:
    """Compiles the corpus's frequent words and hands the file to the executors; returns its name."""
    model = bpe(path)
    raw = [w.encode() for w in frequent_words(docs, path, most, text_col)]
    return share_file(docs.sparkSession, "bpe-lexicon", compile_lexicon((w, model.merge(w)) for w in raw))


def bpe_encode(docs: DataFrame, path: str | None = None, lexicon: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids): the token ids of every text."""
    path = path or default_tokenizer()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = Encoder(path, lexicon)
        for batch in released(batches):
            ids = [np.frombuffer(enc.text_ids(raw), "<u4") for raw in utf8(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=[id_col, "ids"])

    arrow_batches(docs.sparkSession)
    return docs.select(id_col, F.col(text_col).cast("string")).mapInArrow(encode, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, ids array<int>")


def bpe_decode(encoded: DataFrame, path: str | None = None, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, decoded): tokens joined by a blank, as a tokenizer without a decoder gives them; null ids count as none."""
    path = path or default_tokenizer()

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = bpe(path).tokens
        for batch in batches:
            texts = [" ".join([tokens[i] for i in ids or ()]) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[id_col, "decoded"])

    arrow_batches(encoded.sparkSession)
    return encoded.select(id_col, ids_col).mapInArrow(decode, f"`{id_col}` {encoded.schema[id_col].dataType.simpleString()}, decoded string")


def bpe_digests(docs: DataFrame, path: str | None = None, lexicon: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) without shipping ids or decoded texts between tasks."""
    path = path or default_tokenizer()

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = bpe(path).tokens
        digits, shown = [str(i) for i in range(len(tokens))], [t.encode() for t in tokens]
        enc = Encoder(path, lexicon)
        for batch in released(batches):
            n, a, b = [], [], []
            for raw in utf8(batch.column(1)):
                ids = array("I", enc.text_ids(raw))
                n.append(len(ids))
                a.append(hashlib.sha256(" ".join(map(digits.__getitem__, ids)).encode()).hexdigest())
                b.append(hashlib.sha256(b" ".join(map(shown.__getitem__, ids))).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    arrow_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(digests, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op2_bpe_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, path = table(spark, sf_dir, "documents"), default_tokenizer()
    return bpe_digests(docs, path, build_lexicon(docs, path))
