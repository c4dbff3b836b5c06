"""Harmonic packing of token ids into sequences of a fixed capacity.

A document is the ids of its text and an end id. What fills whole sequences is cut off first. The rest has a length of at most
``capacity / k`` and over ``capacity / (k + 1)``: it is in class ``k``, and ``k`` rests of that class share a sequence, whatever
their lengths. So every task fills the sequences of every class for itself, by arithmetic on lengths, without looking for a
place. Documents may be cut, so the gaps that these sequences leave are closed exactly: the rests that do not fill the fixed
count of their class, and as many of the emptiest sequences as are needed, are laid end to end and cut at the sizes of the
gaps. What still remains goes into full sequences and, at the very end, sequences of a power of two, which need no padding.

Ids of words are remembered: the tokenizer drops white space and never looks across it.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame

from tablehaul.llm.text import Remembered, cut_at, sliced

CAPACITY = 4096
END_ID = 2
MOST_KNOWN = 300_000
#: Tokens that are packed together in a task; the remainder below one sequence is all that is cut into short ones.
TOKENS_AT_ONCE = 4_000_000
#: Bytes of texts that are split into words at once.
BYTES_AT_ONCE = 8 << 20
ROWS_AT_ONCE = 4096
PIECES_AT_ONCE = 2000
WORDS_AT_ONCE = 2000
#: What the tokenizer's vocabulary puts at the end of the last token of a word.
WORD_END = "</w>"
BLANK = re.compile(rb"[ \t\n\x0b\x0c\r]")
SPECIAL = b"<|"
#: Punctuation that is a token of its own where it ends a word after a letter or digit.
ENDINGS = b".,;:!?"
SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
NAMES = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]


class WordIds:
    """Packed ids (unsigned 32 bits, little-endian) of texts by a tokenizer that never looks across white space."""

    def __init__(self, tokenizer: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer)
        vocabulary = self.tokenizer.get_vocab()
        self.is_last = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.is_last[[i for token, i in vocabulary.items() if token.endswith(WORD_END)]] = True
        self.endings = {bytes([e]): self.encoded([bytes([e])])[0] for e in ENDINGS}
        self.cores = Remembered(MOST_KNOWN, self.encoded)
        self.words = Remembered(MOST_KNOWN, self.composed)

    def encoded(self, words: list[bytes]) -> list[bytes]:
        """Words of letters alone are encoded side by side and told apart by the ids that end a word; the others one by one."""
        texts = [w.decode() for w in words]
        plain = [t for t in texts if t.isalpha()]
        known: dict[str, bytes] = {}
        for low in range(0, len(plain), WORDS_AT_ONCE):
            part = plain[low : low + WORDS_AT_ONCE]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, "<u4")
            ends = (4 * (np.flatnonzero(self.is_last[ids]) + 1)).tolist()
            if len(ends) == len(part) and ends[-1] == 4 * len(ids):
                data = ids.tobytes()
                known.update((t, data[a:b]) for t, a, b in zip(part, [0, *ends], ends, strict=False))
        rest = [t for t in texts if t not in known]
        found = self.tokenizer.encode_batch_fast(rest, add_special_tokens=False)
        known.update((t, np.array(f.ids, "<u4").tobytes()) for t, f in zip(rest, found, strict=True))
        return [known[t] for t in texts]

    def composed(self, words: list[bytes]) -> list[bytes]:
        """Ids of words by those of their core and of a mark at the end; only cores are new to the tokenizer."""
        endings = self.endings
        marks = [endings.get(w[-1:]) if w[-2:-1].isalnum() else None for w in words]
        cores = [w if mark is None else w[:-1] for w, mark in zip(words, marks, strict=True)]
        known = self.cores.table(cores)
        return [known[core] if mark is None else known[core] + mark for core, mark in zip(cores, marks, strict=True)]

    def slices(self, text: bytes) -> Iterator[bytes]:
        """Parts of a text of a bounded number of bytes; ASCII letters in lower case unless special tokens may come of it."""
        for part in cut_at(text, BLANK, BYTES_AT_ONCE):
            yield part if SPECIAL in part else part.lower()

    def ids(self, texts: list[bytes]) -> Iterator[bytes]:
        """Ids of every text, in order; words of many short texts are looked up together."""
        held: list[bytes] = []
        size = 0
        for text in texts:
            if len(text) > BYTES_AT_ONCE:
                yield from self.looked_up(held)
                held, size = [], 0
                yield b"".join(ids for part in self.slices(text) for ids in self.looked_up([part]))
                continue
            held.append(next(self.slices(text), b""))
            size += len(text)
            if size > BYTES_AT_ONCE:
                yield from self.looked_up(held)
                held, size = [], 0
        yield from self.looked_up(held)

    def looked_up(self, texts: list[bytes]) -> list[bytes]:
        """Different words are numbered in Arrow, so each is looked up once; blanks at the ends of a text make empty words, without ids."""
        if not texts:
            return []
        lists = pc.ascii_split_whitespace(pa.array(texts, pa.large_binary()).view(pa.large_string()))
        words = lists.values.dictionary_encode()
        different = words.dictionary.view(pa.large_binary()).to_pylist()
        known = self.words.table(different)
        found = pa.array([known[w] for w in different], pa.large_binary()).take(words.indices)
        _, ends, ids = found.buffers()
        places = np.frombuffer(ends, np.int64)[lists.offsets.to_numpy()].tolist()
        data = ids.to_pybytes() if ids else b""
        return [data[a:b] for a, b in zip(places, places[1:], strict=False)]


@lru_cache(maxsize=1)
def word_ids(tokenizer: str) -> WordIds:
    """The same memory for all tasks of a worker process."""
    return WordIds(tokenizer)


def plan(lengths: np.ndarray, capacity: int = CAPACITY) -> dict[str, np.ndarray]:
    """Pieces of documents of these lengths: ``doc`` (index), ``start``, ``length``, ``sequence`` and ``offset`` in it.

    Every sequence is full but the last ones, whose lengths are powers of two. Sequences are numbered from zero.
    """
    lengths = np.asarray(lengths, np.int64)
    whole = lengths // capacity
    doc = np.repeat(np.arange(len(lengths)), whole)
    number = np.arange(len(doc)) - np.repeat(np.cumsum(whole) - whole, whole)
    pieces = [(doc, number * capacity, np.full(len(doc), capacity), np.arange(len(doc)), np.zeros(len(doc), np.int64))]
    taken = len(doc)

    rest = lengths % capacity
    doc = np.flatnonzero(rest)
    if not len(doc):
        return named(pieces)
    kind = capacity // rest[doc]
    doc = doc[np.lexsort((-rest[doc], kind))]  # classes one after the other, rests of like length side by side
    size, start = rest[doc], whole[doc] * capacity
    kind = capacity // size
    first = np.flatnonzero(np.concatenate([[True], kind[1:] != kind[:-1]]))
    members = np.diff(np.concatenate([first, [len(doc)]]))
    in_class = np.arange(len(doc)) - np.repeat(first, members)
    filled = members // kind[first]  # sequences of the class that get their fixed count
    placed = in_class < np.repeat(filled * kind[first], members)
    bins = np.repeat(np.cumsum(filled) - filled, members) + in_class // kind
    bins = np.where(placed, bins, -1)
    used = np.bincount(bins[placed], weights=size[placed], minlength=int(filled.sum())).astype(np.int64)
    gap = capacity - used

    lacking = int(gap.sum() - size[~placed].sum())
    broken = np.argsort(-gap, kind="stable")[: max(0, -(-lacking // capacity))]
    stays = np.ones(len(gap), bool)
    stays[broken] = False
    placed[np.flatnonzero(placed)] = stays[bins[placed]]
    renumbered = taken + np.cumsum(stays) - 1
    ends = np.cumsum(np.where(placed, size, 0))
    own = np.flatnonzero(placed)
    begin = np.concatenate([[True], bins[own][1:] != bins[own][:-1]]) if len(own) else np.zeros(0, bool)
    before = (ends - size)[own]
    offset = before - before[np.flatnonzero(begin)[np.cumsum(begin) - 1]] if len(own) else before
    pieces.append((doc[own], start[own], size[own], renumbered[bins[own]], offset))
    taken += int(stays.sum())

    pool = np.flatnonzero(~placed)
    total = int(size[pool].sum())
    open_bins = np.flatnonzero(stays & (gap > 0))
    left = total - int(gap[open_bins].sum())
    full, tail = divmod(left, capacity)
    powers = [1 << b for b in reversed(range(capacity.bit_length())) if tail >> b & 1]
    sizes = np.concatenate([gap[open_bins], np.full(full, capacity), np.array(powers, np.int64)]).astype(np.int64)
    sequence = np.concatenate([renumbered[open_bins], taken + np.arange(full + len(powers))])
    at = np.concatenate([used[open_bins], np.zeros(full + len(powers), np.int64)])
    starts, pool_starts = np.cumsum(sizes) - sizes, np.cumsum(size[pool]) - size[pool]
    cuts = np.union1d(starts, pool_starts)
    target = np.searchsorted(starts, cuts, "right") - 1
    source = np.searchsorted(pool_starts, cuts, "right") - 1
    length = np.diff(np.concatenate([cuts, [total]]))
    pieces.append((doc[pool][source], start[pool][source] + cuts - pool_starts[source], length, sequence[target], at[target] + cuts - starts[target]))
    return named(pieces)


def named(pieces: list[tuple]) -> dict[str, np.ndarray]:
    columns = [np.concatenate(c).astype(np.int64) for c in zip(*pieces, strict=True)]
    return dict(zip(["doc", "start", "length", "sequence", "offset"], columns, strict=True))


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row for each piece: ``doc_id``, ``start``, ``length``, ``ids`` (packed, see ``WordIds``), ``doc_tokens``, ``sequence_id``, ``offset``.

    ``tokenizer`` is the content of a tokenizer file; special tokens are not added. Null text counts as empty: such a document is
    its end id. Null ids and repeated rows are documents like others, each row by itself; texts of any length are cut; an empty
    table gives an empty result; other columns are ignored. ``sequence_id`` holds the number of the task in its high bits, so
    it depends on how the table is split, but not on attempts.
    """
    end = np.array([end_id], "<u4").tobytes()

    def packed(held: list[tuple], first: int) -> Iterator[pa.RecordBatch]:
        sizes = np.array([len(ids) // 4 for _, ids in held], np.int64)
        found = plan(sizes, capacity)
        for low in range(0, len(found["doc"]), PIECES_AT_ONCE):
            part = {k: v[low : low + PIECES_AT_ONCE] for k, v in found.items()}
            places = zip(*(part[k].tolist() for k in ("doc", "start", "length")), strict=True)
            ids = [held[d][1][4 * s : 4 * (s + n)] for d, s, n in places]
            doc_ids = pa.array([held[d][0] for d in part["doc"].tolist()], pa.int64())
            arrays = [doc_ids, part["start"], part["length"], pa.array(ids, pa.binary()), sizes[part["doc"]], part["sequence"] + first, part["offset"]]
            yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in arrays], NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = word_ids(tokenizer)
        first = TaskContext.get().partitionId() << 40
        held, n = [], 0
        for part in sliced(batches, ROWS_AT_ONCE):
            texts = [t or b"" for t in part.column(1).cast(pa.binary()).to_pylist()]
            for doc_id, ids in zip(part.column(0).to_pylist(), known.ids(texts), strict=True):
                held.append((doc_id, ids + end))
                n += len(held[-1][1]) // 4
                if n >= TOKENS_AT_ONCE:
                    for rows in packed(held, first):
                        yield rows
                    first, held, n = first + n, [], 0  # there are no more sequences than tokens
        if held:
            yield from packed(held, first)

    return docs.selectExpr("cast(doc_id as long) AS doc_id", "text").mapInArrow(run, SCHEMA)
