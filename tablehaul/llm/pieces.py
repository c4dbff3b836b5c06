"""SentencePiece encoding and decoding with a given vocabulary.

The pieces stand in an Aho-Corasick automaton. One pass over a text visits every piece that ends at each position, from the
longest to the shortest along the output links, and relaxes the best score of the text up to there (Viterbi). Scores are those
of the vocabulary file, added up as a unigram model does. Characters without a piece become UTF-8 byte pieces.

Where no piece but runs of the blank sign goes on across the start of a word, a text falls apart into words whose best
segmentations do not depend on each other, and at line ends if no piece holds one; a task remembers those of frequent words.
With other vocabularies a text is segmented as a whole.
"""

from __future__ import annotations

import pickle
import re
import struct
from collections.abc import Iterator
from functools import cached_property, lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from tablehaul.llm.text import Remembered, sliced

BLANK = "▁"
#: How far below the lowest score a character without a piece lies.
UNKNOWN_PENALTY = 10.0
#: Words that are remembered in a generation; there are two.
MOST_CACHED = 60_000
TEXTS_AT_ONCE = 128
#: A run of blanks with the word after it; the text starts with a blank that the encoder adds.
UNIT = re.compile(f"{BLANK}+[^{BLANK}]*|[^{BLANK}]+")
MARKS = ".,;:!?"
NO_WAY = float("-inf")
ENCODED = "doc_id long, ids array<int>, n_pieces long"
DECODED = f"{ENCODED}, text string"


class Vocabulary:
    """Pieces, scores and byte pieces; plain data, so that it travels to the workers. Its size is fixed by the file."""

    def __init__(self, pieces: list[tuple[str, float, int]], byte_ids: list[int]) -> None:
        self.pieces, self.byte_ids = pieces, byte_ids
        self.unknown = min(score for _, score, _ in pieces) - UNKNOWN_PENALTY
        self.by_words = not any(BLANK in p.lstrip(BLANK) for p, _, _ in pieces)
        self.by_lines = self.by_words and not any("\n" in p for p, _, _ in pieces)
        self.single = frozenset(p for p, _, _ in pieces if len(p) == 1)
        self.pairs = frozenset(p[i : i + 2] for p, _, _ in pieces for i in range(len(p) - 1))

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        """Reads a model file on the driver. Blank runs longer than one are taken in whole units, as other pieces are."""
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(model.get_piece_size())
        special = {i for i in ids if model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)}
        byte_ids = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        return cls([(model.id_to_piece(i), model.get_score(i), i) for i in ids if i not in special], byte_ids)

    @cached_property
    def automaton(self) -> ahocorasick.Automaton:
        found = ahocorasick.Automaton()
        for piece, score, number in self.pieces:
            found.add_word(piece, (len(piece), score, number))
        found.make_automaton()
        return found

    @cached_property
    def texts(self) -> list[str]:
        """Text of every id; byte pieces above ASCII are kept as surrogates until all bytes are together."""
        known = {number: piece.replace(BLANK, " ") for piece, _, number in self.pieces}
        known |= {i: chr(b) if b < 128 else chr(0xDC00 + b) for b, i in enumerate(self.byte_ids)}
        return [known.get(i, "") for i in range(max(known) + 1)]

    def byte_pieces(self, text: str) -> list[int]:
        return [self.byte_ids[b] for b in text.encode("utf-8", "surrogatepass")]

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("automaton", "texts")}


def segment(unit: str, vocabulary: Vocabulary) -> list[int]:
    """Ids of the best segmentation of a unit; of equal scores the one whose last piece is longer wins."""
    n = len(unit)
    best = [0.0] + [NO_WAY] * n
    starts, numbers = [0] * (n + 1), [-1] * (n + 1)
    if vocabulary.single.issuperset(unit):
        for end, (length, score, number) in vocabulary.automaton.iter(unit):
            total = best[end + 1 - length] + score
            if total > best[end + 1]:
                best[end + 1], starts[end + 1], numbers[end + 1] = total, end + 1 - length, number
    else:
        done, single, unknown = 0, vocabulary.single, vocabulary.unknown  # positions up to ``done`` have their final score
        found = list(vocabulary.automaton.iter(unit))
        for end, (length, score, number) in [*found, (n, (0, 0.0, -1))]:
            while done < end:  # a character without a piece of its own may be unknown
                if unit[done] not in single and best[done] + unknown > best[done + 1]:
                    best[done + 1], starts[done + 1], numbers[done + 1] = best[done] + unknown, done, -1
                done += 1
            if not length:
                break
            total = best[end + 1 - length] + score
            if total > best[end + 1]:
                best[end + 1], starts[end + 1], numbers[end + 1] = total, end + 1 - length, number
    ids: list[int] = []
    while n:
        start = starts[n]
        if numbers[n] >= 0:
            ids.append(numbers[n])
        else:
            ids.extend(reversed(vocabulary.byte_pieces(unit[start:n])))
        n = start
    ids.reverse()
    return ids


class Encoder:
    """Encodes texts to packed ids (32 bits, little-endian), remembering those of frequent words."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.vocabulary = vocabulary
        self.known = Remembered(MOST_CACHED, self.made)
        self.cores = Remembered(MOST_CACHED, lambda keys: [self.packed(self.ids_of(key)) for key in keys])
        self.marks = {m: self.packed(segment(m, vocabulary)) for m in MARKS}
        self.mark = self.packed(vocabulary.byte_pieces(BLANK))
        self.line_end = vocabulary.byte_pieces("\n")

    @staticmethod
    def packed(ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}i", *ids)

    def made(self, keys: list[str]) -> list[bytes]:
        """Where no piece goes on from a word to the mark behind it, the two do not depend on each other."""
        pairs = self.vocabulary.pairs
        marked = [len(key) > 1 and key[-1] in MARKS and key[-2:] not in pairs and key[-2] not in " \n" for key in keys]
        cores = [key[:-1] if m else key for key, m in zip(keys, marked, strict=True)]
        known = self.cores.table(cores)
        return [known[core] + self.marks[key[-1]] if m else known[core] for key, core, m in zip(keys, cores, marked, strict=True)]

    def ids_of(self, key: str) -> list[int]:
        """A key is a unit that begins with the blank sign, a word after one blank, or a line end with the word behind it."""
        if key[:1] == BLANK:
            return segment(key, self.vocabulary)
        if self.vocabulary.by_lines and key[:1] == "\n":
            return self.line_end + segment(key[1:], self.vocabulary)
        return segment(BLANK + key, self.vocabulary)

    def keys(self, part: str) -> list[str]:
        """Units of a text without blank signs that follows a blank."""
        if "  " in part or part[:1] == " ":
            return UNIT.findall(BLANK + part.replace(" ", BLANK))
        return (part.replace("\n", " \n") if self.vocabulary.by_lines else part).split(" ")

    def encode(self, text: str) -> bytes:
        """Ids of a text; an empty text has none. The blank sign itself, if a text holds it, becomes byte pieces."""
        if not text:
            return b""
        parts = text.split(BLANK)
        if not self.vocabulary.by_words:
            whole = [segment((BLANK if not i else "") + p.replace(" ", BLANK), self.vocabulary) for i, p in enumerate(parts)]
            return self.mark.join(map(self.packed, whole))
        out = [self.looked_up(self.keys(parts[0]))]
        for part in parts[1:]:  # what follows the sign itself has no blank in front
            first, blank, rest = part.partition(" ")
            out.append(self.packed(segment(first, self.vocabulary)))
            if blank:
                out[-1] += self.looked_up(self.keys(rest))
        return self.mark.join(out)

    def looked_up(self, keys: list[str]) -> bytes:
        return b"".join(map(self.known.table(keys).__getitem__, keys))


@lru_cache(maxsize=1)
def encoder_of(data: bytes) -> Encoder:
    """The same memory for all tasks of a worker process."""
    return Encoder(pickle.loads(data))


def encode(text: str, vocabulary: Vocabulary) -> list[int]:
    return np.frombuffer(Encoder(vocabulary).encode(text), "<i4").tolist()


def decode(ids: list[int], vocabulary: Vocabulary) -> str:
    """The text of a sequence of ids, without the blank that the encoder added in front."""
    joined = "".join(map(vocabulary.texts.__getitem__, ids))
    if not joined.isascii():
        joined = joined.encode("utf-8", "surrogateescape").decode("utf-8", "replace")
    return joined.removeprefix(" ")


def with_ids(part: pa.RecordBatch, encoder: Encoder) -> pa.RecordBatch:
    """``doc_id``, ``ids`` and ``n_pieces`` of rows of id and text."""
    rows = [encoder.encode(t or "") for t in part.column(1).to_pylist()]
    ends = np.cumsum([0, *map(len, rows)]) // 4
    lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(np.frombuffer(b"".join(rows), "<i4")))
    return pa.RecordBatch.from_arrays([part.column(0), lists, pa.array(np.diff(ends))], ["doc_id", "ids", "n_pieces"])


def with_texts(part: pa.RecordBatch, vocabulary: Vocabulary) -> pa.RecordBatch:
    """Encoded rows with the ``text`` that their ids decode to."""
    texts = [None if ids is None else decode(ids.tolist(), vocabulary) for ids in lists_of(part.column(1))]
    return pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], [*part.schema.names, "text"])


def encode_table(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """``doc_id``, ``ids`` and ``n_pieces`` of every row.

    Null text has no ids, as empty text; null ids and repeated rows stay; an empty table gives an empty result; other
    columns are ignored.
    """

    data = pickle.dumps(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(data)
        for part in sliced(batches, TEXTS_AT_ONCE):
            yield with_ids(part, encoder)

    return docs.selectExpr("cast(doc_id as long) AS doc_id", "text").mapInArrow(run, ENCODED)


def decode_table(encoded: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """Adds the decoded ``text``; null ids give null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(batches, TEXTS_AT_ONCE):
            yield with_texts(part, vocabulary)

    return encoded.mapInArrow(run, DECODED)


def encode_and_decode(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """What ``decode_table`` gives for the rows of ``encode_table``, in one pass: a task needs one Python worker instead of two."""

    data = pickle.dumps(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(data)
        for part in sliced(batches, TEXTS_AT_ONCE):
            yield with_texts(with_ids(part, encoder), encoder.vocabulary)

    return docs.selectExpr("cast(doc_id as long) AS doc_id", "text").mapInArrow(run, DECODED)


def lists_of(column: pa.ListArray) -> Iterator[np.ndarray | None]:
    values, ends = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    valid = column.is_valid().to_numpy(zero_copy_only=False)
    for i, (a, b) in enumerate(zip(ends, ends[1:], strict=False)):
        yield values[a:b] if valid[i] else None
