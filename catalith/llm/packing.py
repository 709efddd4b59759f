"""Packing into sequences of at most `CAPACITY` tokens, by harmonic classes.

A document of length L is of the reciprocal-capacity class k = CAPACITY // L, and a bin of class k takes exactly k of them, whole. What a
full bin has free is filled with pieces cut from a document that was set apart for that: a document longer than CAPACITY, which must be cut
anyway, or else, where `WAITING` full bins wait, the next document whatever its class. So most documents stay whole, and nearly every
sequence is full. Each task fills its own bins as its documents stream by, so there is no shuffle, and it holds fewer than k documents of each
class, `WAITING` bins and as many sequences' worth of documents to cut. What a task has left at its end is joined end to end and cut once more, into
full sequences and powers of two.

Sequences are padded to CAPACITY, but one whose length is a power of two is left as it is. A sequence's id is
its task's number times 2**32 plus its number within the task, so ids are the same when a task is run again.

Defined cases: a null or empty text is the closing id alone; repeated rows and null ids are packed like any
other; an empty table gives an empty table; other columns are not looked at; doc_id may be of any integer type.
"""

from __future__ import annotations

import os
import unicodedata
import zlib
from collections import defaultdict
from collections.abc import Iterator
from struct import pack as to_bytes

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalith.llm.common import batches_of_documents

CAPACITY, END = 2048, 1
#: Full bins that wait for pieces before the next document is cut for them.
WAITING = 64
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"

#: Words that a worker's memo holds, and the longest it takes.
MEMO_WORDS, MEMO_LONGEST = 700_000, 48
#: Marks that are units of their own after letters.
MARKS = ".,;:!?"

_encoders: dict[str, WordEncoder] = {}


class WordEncoder:
    """Ids of whole texts by a tokenizer whose tokens never cross white space, with a memo of its words."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.memo: dict[str, bytes] = {"": b""}
        # the printable character that byte-level pre-tokenizers put for each byte: itself, or the next free one from 256 on
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.printable = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in shown)}

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        split = [self._words(t) for t in texts]
        memo = self.memo
        missing = set().union(*split).difference(memo)
        fresh = self._missing(missing) if missing else {}
        room = MEMO_WORDS - len(memo)
        kept = {w: ids for w, ids in fresh.items() if len(w) <= MEMO_LONGEST} if room > 0 else {}
        if len(kept) == len(fresh):
            memo.update(kept)
            get = memo.__getitem__
        else:
            memo.update(kept)
            both = fresh.copy()
            get = lambda w: memo[w] if w in memo else both[w]
        return [b"".join(map(get, words)) for words in split]

    def _missing(self, words: set[str]) -> dict[str, bytes]:
        """Ids of words that the memo lacks. A word of letters is one unit and goes straight
        to the tokenizer's model; one mark after letters is a unit of its own; the rest is encoded one by one."""
        plain, marked, other = [], [], []
        for w in words:
            if _letters(w):
                plain.append(w)
            elif w[-1] in MARKS and _letters(w[:-1]):
                marked.append(w)
            else:
                other.append(w)
        units = list({*plain, *(w[:-1] for w in marked), *(w[-1] for w in marked)})
        found = dict(zip(units, self._units(units), strict=True))
        out = {w: found[w] for w in plain}
        out |= {w: found[w[:-1]] + found[w[-1]] for w in marked}
        out |= zip(other, self._ids(other), strict=True)
        return out

    def _units(self, units: list[str]) -> list[bytes]:
        tokenize, printable = self.tokenizer.model.tokenize, self.printable
        out = []
        for unit in units:
            unit = unit.lower() if unit.isascii() else "".join(map(printable.__getitem__, unicodedata.normalize("NFC", unit).replace("Σ", "σ").lower().encode()))
            out.append(to_bytes("<%dI" % len(ids := [t.id for t in tokenize(unit)]), *ids))
        return out

    def _words(self, text: str | None) -> list[str]:
        """Parts whose ids are those of the text when joined: tokens end at a space, tab or line end. A text that names
        a special token is left whole."""
        if not text:
            return []
        if any(s in text for s in self.special):
            return [text]
        return text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")

    def _ids(self, words: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]


def _letters(word: str) -> bool:
    """Is the word letters only, also in lower case and normal form C?"""
    return word.isalpha() and (word.isascii() or unicodedata.normalize("NFC", word).lower().isalpha())


def encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


class Bins:
    """Open bins of one worker. A piece is (doc_id, start, ids, doc_tokens)."""

    def __init__(self, worker: int, capacity: int = CAPACITY, waiting: int = WAITING):
        self.capacity, self.most, self.next = capacity, waiting, worker << 32
        self.open: dict[int, list[tuple]] = defaultdict(list)
        self.waiting: list[tuple[list[tuple], int]] = []  # full bins and what they have free
        self.spare: list[tuple] = []  # pieces of documents that may be cut
        self.rows: list[tuple] = []

    def add(self, doc_id, ids: bytes) -> None:
        tokens = len(ids) // 4
        piece = (doc_id, 0, ids, tokens)
        if tokens > self.capacity or len(self.waiting) >= self.most:
            self._cut(piece)
            return
        bin_ = self.open[k := self.capacity // tokens]
        bin_.append(piece)
        if len(bin_) == k:
            self._full(self.open.pop(k))

    def _full(self, bin_: list[tuple]) -> None:
        """A bin with its number of documents: fill it up with what may be cut, or let it wait."""
        free = self.capacity - sum(len(p[2]) // 4 for p in bin_)
        while free and self.spare:
            free -= self._fill(bin_, free)
        if free:
            self.waiting.append((bin_, free))
        else:
            self._close(bin_)

    def _fill(self, bin_: list[tuple], free: int) -> int:
        """Move at most `free` tokens of the spare document to a bin."""
        doc_id, start, ids, tokens = self.spare.pop()
        taken = min(free, len(ids) // 4)
        bin_.append((doc_id, start, ids[: 4 * taken], tokens))
        if 4 * taken < len(ids):
            self.spare.append((doc_id, start + taken, ids[4 * taken :], tokens))
        return taken

    def _cut(self, piece: tuple) -> None:
        """A document to cut: into waiting bins, then into sequences of its own; its rest waits for the next full bin."""
        self.spare.append(piece)
        while self.waiting and self.spare:
            bin_, free = self.waiting.pop()
            self._full(bin_)
        while self.spare and len(self.spare[-1][2]) // 4 >= self.capacity:
            self._own(self.capacity)
        while sum(len(p[2]) for p in self.spare) // 4 >= self.most * self.capacity:
            self._own(self.capacity)

    def _own(self, free: int) -> None:
        """A sequence of nothing but what may be cut."""
        bin_: list[tuple] = []
        while free:
            free -= self._fill(bin_, free)
        self._close(bin_)

    def _close(self, pieces: list[tuple]) -> None:
        offset = 0
        for doc_id, start, ids, tokens in pieces:
            self.rows.append((doc_id, start, len(ids) // 4, zlib.crc32(ids), tokens, self.next, offset))
            offset += len(ids) // 4
        self.next += 1

    def finish(self) -> None:
        """Join what is left end to end, and cut it into full sequences and powers of two."""
        left = [*self.spare, *(p for bin_, _ in self.waiting for p in bin_), *(p for k in sorted(self.open) for p in self.open[k])]
        self.open.clear()
        self.waiting, self.spare = [], left[::-1]
        room, size = sum(len(p[2]) // 4 for p in left), self.capacity
        while room:
            while size > room:
                size //= 2
            self._own(size)
            room -= size

    def take(self) -> pa.RecordBatch:
        rows, self.rows = self.rows, []
        names = [x.split()[0] for x in PIECES.split(", ")]
        return pa.record_batch([pa.array([r[i] for r in rows], pa.int64()) for i in range(len(names))], names=names)


def _pack_rows(path: str, end: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins, close = Bins(TaskContext.get().partitionId()), np.array([end], "<u4").tobytes()
        encode = encoder(path).encode
        for batch in batches_of_documents(batches):
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encode(batch.column("text").to_pylist()), strict=True):
                bins.add(doc_id, ids + close)
            yield bins.take()
        bins.finish()
        yield bins.take()

    return rows


def pack(docs: DataFrame, tokenizer_path: str, end: int = END) -> DataFrame:
    """One row for each piece of a document."""
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(_pack_rows(tokenizer_path, end), PIECES)
