"""Byte-level BPE over a lexicon of frequent words in a minimal transducer.

All words of the corpus are counted; the most frequent are encoded once and
compiled into a minimal acyclic automaton over their bytes. Words share
prefixes and suffixes; the numbers on the transitions along a word add up to
the word's number, and the number leads to its ids. The file is memory-mapped
by the tasks. A word that it does not hold is merged by the ranks, exactly.

Defined results: a null text counts as empty and gives no ids and an empty
text; a special token's string in a text is that token; repeated rows are
encoded each; an empty table gives an empty lexicon and an empty result; other
columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import mmap
import os
import struct
from collections import Counter
from collections.abc import Iterator
from functools import cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import stage
from .common import quoted, ship, text_map

#: Fixed values of the format: how byte-level BPE cuts a text into words.
PRETOKENS = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
             r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")
LEXICON_WORDS = 262_144
LONGEST_WORD = 64
STEM = 5


def byte_characters() -> list[str]:
    """The printable character that the vocabulary file writes for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    table = {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}
    return [table[b] for b in range(256)]


class Merger:
    """The vocabulary: exact merging of a word, and the bytes of an id."""

    def __init__(self, spec: dict):
        chars = {c: b for b, c in enumerate(byte_characters())}
        to_bytes = lambda s: bytes(chars[c] for c in s)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in merges]
        self.single = [vocab[c] for c in byte_characters()]
        self.rank = {(vocab[a], vocab[b]): n for n, (a, b) in enumerate(pairs)}
        self.joined = [vocab[a + b] for a, b in pairs]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.token = [b""] * size
        for s, i in vocab.items():
            self.token[i] = to_bytes(s)
        for s, i in self.special.items():
            self.token[i] = s.encode()

    def merge(self, word: bytes) -> list[int]:
        """Merge the pair of lowest rank, leftmost first, until none is left."""
        ids = [self.single[b] for b in word]
        if len(ids) > LONGEST_WORD:
            return self._merge_long(ids)
        rank, none = self.rank.get, len(self.joined)
        ranks, joined = list(map(rank, zip(ids, ids[1:], strict=False), repeat(none))), self.joined
        while ranks and (least := min(ranks)) < none:
            at = ranks.index(least)
            ids[at] = joined[least]
            del ids[at + 1], ranks[at]
            if at < len(ranks):
                ranks[at] = rank((ids[at], ids[at + 1]), none)
            if at:
                ranks[at - 1] = rank((ids[at - 1], ids[at]), none)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same by a heap over a linked list, for words of any length."""
        import heapq

        n, rank = len(ids), self.rank
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, k, ids[k], ids[k + 1]) for k in range(n - 1)
                if (r := rank.get((ids[k], ids[k + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            r, k, a, b = heapq.heappop(heap)
            new = self.joined[r]
            j = after[k]
            if ids[k] != a or j >= n or ids[j] != b:
                continue
            ids[k], ids[j] = new, -1
            after[k] = after[j]
            if after[k] < n:
                before[after[k]] = k
                if (r := rank.get((new, ids[after[k]]))) is not None:
                    heapq.heappush(heap, (r, k, new, ids[after[k]]))
            if before[k] >= 0 and (r := rank.get((ids[before[k]], new))) is not None:
                heapq.heappush(heap, (r, before[k], ids[before[k]], new))
        return [i for i in ids if i >= 0]


@cache
def merger(spec: str) -> Merger:
    return Merger(json.loads(spec))


# ---- the lexicon ---------------------------------------------------------------

def compile_lexicon(entries: list[tuple[bytes, bytes]]) -> bytes:
    """The automaton of (word, ids) as one file; words sorted and different.

    States are minimised as the sorted words come: a state whose words are
    over is replaced by an equal one seen before. A transition holds byte,
    target and the number of words that sort before it at its state.
    """
    register: dict[tuple, int] = {}
    stored: list[tuple] = []          # (final, ((byte, target), ...)) of each state
    path: list[list] = [[False, []]]  # open states along the current word

    def close(depth: int) -> None:
        while len(path) > depth + 1:
            final, moves = path.pop()
            state = (final, tuple(moves))
            number = register.setdefault(state, len(stored))
            if number == len(stored):
                stored.append(state)
            path[-1][1][-1] = (path[-1][1][-1][0], number)

    prior = b""
    for word, _ in entries:
        same = len(os.path.commonprefix([prior, word]))
        close(same)
        for b in word[same:]:
            path[-1][1].append((b, -1))
            path.append([False, []])
        path[-1][0] = True
        prior = word
    close(0)
    root = (path[0][0], tuple(path[0][1]))
    stored.append(root)

    below, first, edges = [], [], []
    for final, moves in stored:
        n = int(final)
        first.append(len(edges))
        for b, target in moves:
            edges.append((b, target, n))
            n += below[target]
        below.append(n)
    first.append(len(edges))
    finals = [int(f) for f, _ in stored]
    offsets, blob = [0], []
    for _, ids in entries:
        blob.append(ids)
        offsets.append(offsets[-1] + len(ids))
    columns = [first, finals, [e[1] for e in edges], [e[2] for e in edges], offsets]
    head = struct.pack("<6I", *map(len, columns), len(stored) - 1)
    return (head + b"".join(np.array(c, "<u4").tobytes() for c in columns)
            + bytes(e[0] for e in edges) + b"".join(blob))


_ONE = [bytes([b]) for b in range(256)]


class Lexicon:
    """A compiled lexicon, read in place from a memory-mapped file."""

    def __init__(self, data):
        view = memoryview(data)
        *sizes, self.root = struct.unpack_from("<6I", view)
        at, parts = 24, []
        for n in sizes:
            parts.append(view[at:at + 4 * n].cast("I"))
            at += 4 * n
        self.first, self.final, self.target, self.number, self.offset = parts
        self.find, self.bytes_at = data.find, at  # the transitions' bytes
        self.ids = view[at + len(self.target):]
        #: State and number after the first ``STEM`` bytes, of stems in the lexicon.
        self.stems: dict[bytes, tuple[int, int]] = {}

    @classmethod
    def open(cls, path: str) -> Lexicon:
        with open(path, "rb") as f:
            return cls(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))

    def _walk(self, part: bytes, state: int, total: int) -> tuple[int, int] | None:
        first, find, base = self.first, self.find, self.bytes_at
        number, target = self.number, self.target
        for b in part:
            edge = find(_ONE[b], base + first[state], base + first[state + 1])
            if edge < 0:
                return None
            total += number[edge - base]
            state = target[edge - base]
        return state, total

    def get(self, word: bytes) -> bytes | None:
        """The word's ids as little-endian 32-bit numbers, or None."""
        known = self.stems.get(word[:STEM]) if len(word) > STEM else None
        if known is None and len(word) > STEM:
            known = self._walk(word[:STEM], self.root, 0)
            if known is None:
                return None
            self.stems[word[:STEM]] = known
        reached = self._walk(word[STEM:], *known) if known else self._walk(word, self.root, 0)
        if reached is None:
            return None
        state, total = reached
        if not self.final[state]:
            return None
        return bytes(self.ids[self.offset[total]:self.offset[total + 1]])


_PATTERN = regex.compile(PRETOKENS)


def _words_of(chunk: str) -> list[str]:
    """Words of a blank and a chunk of text that holds no blank.

    The usual forms, a word and a word with a stop, need no pattern.
    """
    if chunk.isalpha():
        return [" " + chunk]
    if chunk[-1:] in (".", ",") and chunk[:-1].isalpha():
        return [" " + chunk[:-1], chunk[-1]]
    return _PATTERN.findall(" " + chunk)


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of the texts with their counts, in bounded pieces."""
    def pieces(heads: Counter, chunks: Counter):
        words: dict[str, int] = {}
        get = words.get
        for cut, found in ((_PATTERN.findall, heads), (_words_of, chunks)):
            for chunk, n in found.items():
                for w in cut(chunk):
                    words[w] = get(w, 0) + n
        keys = list(words)
        for at in range(0, len(keys), 50_000):
            part = keys[at:at + 50_000]
            yield pa.RecordBatch.from_arrays(
                [pa.array(part, pa.string()), pa.array([words[w] for w in part], pa.int64())],
                names=["word", "n"])

    heads, chunks = Counter(), Counter()
    for batch in batches:
        for text in batch.column(0).to_pylist():
            if text:
                head, *rest = text.split(" ")
                heads[head] += 1
                chunks.update(rest)
                if len(chunks) + len(heads) > 400_000:
                    yield from pieces(heads, chunks)
                    heads, chunks = Counter(), Counter()
    yield from pieces(heads, chunks)


def frequent_words(docs: DataFrame, text: str = "text", most: int = LEXICON_WORDS) -> DataFrame:
    """The frequent words of all texts, at most ``most``; that bounds the lexicon.

    A histogram of the counts, in steps of an eighth of a doubling, tells from
    which count on the words fit: no task orders all words.
    """
    ship(docs.sparkSession)
    counts = stage(docs.select(quoted(text)).mapInArrow(_count_words, "word string, n bigint")
                   .where(F.octet_length("word") <= LONGEST_WORD)
                   .groupBy("word").agg(F.sum("n").alias("n")).where("n > 1")
                   .withColumn("step", F.floor(8 * F.log2("n")).cast("int")), "words")
    room, least = most, None
    for row in sorted(counts.groupBy("step").count().collect(), reverse=True):
        room -= row["count"]
        if room < 0:
            break
        least = row.step
    return counts.where(F.col("step") >= least if least is not None else F.lit(False)).select("word")


def _encode_words(spec):
    def setup():
        vocabulary = merger(spec.value)

        def compute(words):
            return [[np.array(vocabulary.merge(w.encode()), "<u4").tobytes() for w in words]]
        return compute
    return setup


def build_lexicon(docs: DataFrame, spec, text: str = "text", most: int = LEXICON_WORDS) -> str:
    """Compile the lexicon and give it to the executors; returns its file name.

    At most ``most`` words of at most ``LONGEST_WORD`` bytes come together.
    """
    spark = docs.sparkSession
    coded = text_map(frequent_words(docs, text, most), "word", [("ids", T.BinaryType())],
                     _encode_words(spec))
    entries = sorted((r.word.encode(), bytes(r.ids)) for r in coded.toLocalIterator())
    data = compile_lexicon(entries)
    mark = hashlib.sha256(data + hashlib.sha256(spec.value.encode()).digest())
    name = f"lexicon-{mark.hexdigest()[:16]}.bin"
    folder = os.path.join(SparkFiles.getRootDirectory(), "compiled")
    os.makedirs(folder, exist_ok=True)
    path = os.path.join(folder, name)
    if not os.path.exists(path):
        with open(path, "wb") as f:
            f.write(data)
        spark.sparkContext.addFile(path)
    return name


# ---- texts ---------------------------------------------------------------------

class Encoder:
    """Texts to ids and back; remembers words it has met, up to a bound."""

    def __init__(self, vocabulary: Merger, lexicon: Lexicon | None = None,
                 remember: int = 300_000):
        """``remember`` bounds the words, and 3 / 2 of it the chunks, kept in memory.

        At the bound the memory becomes the older one, which is asked second. A
        chunk that is one word is remembered as a chunk alone.
        """
        self.vocabulary, self.lexicon, self.remember = vocabulary, lexicon, remember
        self.words: dict[str, bytes] = {}
        self.older_words: dict[str, bytes] = {}
        self.chunks: dict[str, bytes] = {}
        self.older_chunks: dict[str, bytes] = {}
        self.specials = regex.compile("|".join(
            map(regex.escape, sorted(vocabulary.special, key=len, reverse=True)))) \
            if vocabulary.special else None

    def word(self, word: str) -> bytes:
        ids = self.words.get(word)
        if ids is None:
            ids = self.older_words.get(word)
            if ids is None:
                ids = self._new(word)
            if len(self.words) >= self.remember:
                self.words, self.older_words = {}, self.words
            if len(word) <= LONGEST_WORD:
                self.words[word] = ids
        return ids

    def _new(self, word: str) -> bytes:
        raw = word.encode("utf-8", "surrogatepass")
        ids = self.lexicon.get(raw) if self.lexicon else None
        if ids is None:
            merged = self.vocabulary.merge(raw)
            ids = struct.pack(f"<{len(merged)}I", *merged)
        return ids

    def plain(self, text: str) -> bytes:
        return b"".join(map(self.word, _PATTERN.findall(text)))

    def _chunk(self, chunk: str) -> bytes | None:
        """Ids of a blank and a chunk; None where white space meets the blank."""
        if not chunk or chunk[0].isspace() or chunk[-1].isspace():
            return None
        ids = self.older_chunks.get(chunk)
        if ids is None:
            # The usual forms, a word and a word with a stop, need no pattern.
            if chunk.isalpha():
                ids = self._new(" " + chunk)
            elif chunk[-1] in ".," and (stem := chunk[:-1]).isalpha():
                ids = (self.chunks.get(stem) or self._chunk(stem)) + self.word(chunk[-1])
            else:
                ids = self.plain(" " + chunk)
        if len(self.chunks) >= 3 * self.remember // 2:
            self.chunks, self.older_chunks = {}, self.chunks
        if len(chunk) <= LONGEST_WORD:
            self.chunks[chunk] = ids
        return ids

    def part(self, text: str) -> bytes:
        """Ids of a text without special tokens.

        A word never runs over from a character into white space, so the text
        is cut at single blanks between characters; where more white space
        meets, the piece up to the next character is taken whole.
        """
        head, *rest = text.split(" ")
        if head and not head[-1].isspace():
            # No blank meets other white space in most texts.
            found = list(map(self.chunks.get, rest))
            for at in [k for k, ids in enumerate(found) if ids is None]:
                found[at] = self.chunks.get(rest[at]) or self._chunk(rest[at])
                if found[at] is None:
                    break
            else:
                return self.plain(head) + b"".join(found)
        out, get, open_piece = [], self.chunks.get, head
        if not head or head[-1].isspace():
            pass
        else:
            out.append(self.plain(head))
            open_piece = None
        for chunk in rest:
            if open_piece is None:
                ids = get(chunk) or self._chunk(chunk)
                if ids is not None:
                    out.append(ids)
                    continue
                open_piece = " " + chunk
            else:
                open_piece += " " + chunk
            if chunk and not chunk[-1].isspace():
                out.append(self.plain(open_piece))
                open_piece = None
        if open_piece:
            out.append(self.plain(open_piece))
        return b"".join(out)

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit numbers."""
        special = self.vocabulary.special
        if not self.specials or not any(s in text for s in special):
            return self.part(text)
        out, at = [], 0
        for m in self.specials.finditer(text):
            out += [self.part(text[at:m.start()]), struct.pack("<I", special[m[0]])]
            at = m.end()
        return b"".join([*out, self.part(text[at:])])

    def decode(self, ids: bytes) -> str:
        return self._bytes(ids).decode("utf-8", "replace")

    def _bytes(self, ids: bytes) -> bytes:
        token = self.vocabulary.token
        numbers = np.frombuffer(ids, "<u4").tolist()
        return b"".join(map(token.__getitem__, numbers))

    def decoded(self, ids: bytes) -> bytes:
        """The decoded text in UTF-8; bytes that are UTF-8 already stand for themselves."""
        raw = self._bytes(ids)
        try:
            raw.decode("utf-8")
        except UnicodeDecodeError:
            return raw.decode("utf-8", "replace").encode("utf-8")
        return raw


def read_spec(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


_encoders: dict[str, Encoder] = {}


def _encoder(spec, name: str, remember: int) -> Encoder:
    """The worker's encoder for a lexicon; later tasks find its words known."""
    if name not in _encoders:
        _encoders.clear()
        _encoders[name] = Encoder(merger(spec.value), Lexicon.open(SparkFiles.get(name)), remember)
    _encoders[name].remember = remember
    return _encoders[name]


def _open(spark: SparkSession, docs: DataFrame, vocabulary: str, text: str, most: int):
    spec = spark.sparkContext.broadcast(read_spec(vocabulary))  # one vocabulary file
    return spec, build_lexicon(docs, spec, text, most)


def digests(docs: DataFrame, vocabulary: str, doc_id: str = "doc_id", text: str = "text",
            most: int = LEXICON_WORDS, remember: int = 300_000) -> DataFrame:
    """Number of ids and digests of the ids and of the decoded text."""
    spec, name = _open(docs.sparkSession, docs, vocabulary, text, most)

    def setup():
        encoder = _encoder(spec, name, remember)

        def compute(texts):
            counts, of_ids, of_text = [], [], []
            for t in texts:
                ids = encoder.encode(t or "")
                back = encoder.decoded(ids)
                counts.append(len(ids) // 4)
                of_ids.append(hashlib.sha256(ids).hexdigest())
                of_text.append(hashlib.sha256(back).hexdigest())
            return counts, of_ids, of_text
        return compute
    plain = docs.select(quoted(doc_id).alias("doc_id"), quoted(text).alias("text"))
    return text_map(plain, "text", [("n_tokens", T.LongType()), ("ids_sha256", T.StringType()),
                                    ("decoded_sha256", T.StringType())], setup, ["doc_id"])


def token_table(docs: DataFrame, vocabulary: str, text: str = "text", most: int = LEXICON_WORDS,
                keep: tuple[str, ...] = ("doc_id", "source"),
                remember: int = 200_000) -> DataFrame:
    """``keep`` with n_tokens, ids (array of int) and whether decoding gives the text.

    A worker remembers less than for ``digests``: it also holds the ids.
    """
    spec, name = _open(docs.sparkSession, docs, vocabulary, text, most)

    def setup():
        encoder = _encoder(spec, name, remember)

        def compute(texts):
            coded = [encoder.encode(t or "") for t in texts]
            same = [encoder.decode(c) == (t or "") for c, t in zip(coded, texts, strict=True)]
            offsets = np.cumsum([0, *[len(c) // 4 for c in coded]])
            values = np.frombuffer(b"".join(coded), "<u4").astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values))
            return [len(c) // 4 for c in coded], ids, same
        return compute
    return text_map(docs, text, [("n_tokens", T.LongType()), ("ids", T.ArrayType(T.IntegerType())),
                                 ("round_trip", T.BooleanType())], setup, list(keep))
