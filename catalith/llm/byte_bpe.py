"""Byte-level BPE encoding and decoding with a lazily determinised finite-state transducer.

A token sequence is the BPE encoding of its bytes exactly when each pair of neighbours is: merging the bytes
of two neighbours gives these two again. So an automaton that reads bytes and guesses token borders needs to
know only the token before and its place in the trie of tokens. The transducer determinises that automaton on
the fly: a state is the set of guesses still open, and a transition tells the last token of the encoding of
what is read so far. A guess lives no longer than the longest token; once `PENDING` bytes wait, the tokens up
to the last border that all open guesses share are emitted, so a piece of any length needs bounded memory.
Transitions are kept when first taken, up to `STATES` states, then the table starts afresh.

Texts are split by the tokenizer's pattern first; a worker keeps the results of recent words in a bounded memo.
Decoding joins the bytes of the tokens and releases whole characters through an incremental UTF-8 state
machine (`Utf8Stream`), so ids may arrive in any portions.

Defined cases: a null text counts as empty and has no ids; repeated rows and null ids of rows are encoded
like any other; an empty table gives an empty table; other columns are not looked at.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalith.llm.common import batches_of_documents

#: States and memo entries that a worker holds.
STATES, MEMO_WORDS, MEMO_LONGEST = 400_000, 500_000, 48
#: Bytes of a piece that wait for their tokens.
PENDING = 1024
ROOT = 0
ENCODED = "doc_id long, n_tokens long, ids binary"
DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"

_codecs: dict[tuple[str, str], Codec] = {}


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a rank file: one base64 token and its rank in each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def merge(piece: bytes, ranks: dict[bytes, int], least: int = 1) -> list[bytes]:
    """Plain BPE: merge the neighbours of least rank, the leftmost first, until none can be merged or only so many parts are left."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    found = [ranks.get(piece[i : i + 2], 1 << 60) for i in range(len(piece) - 1)]
    while len(parts) > least:
        rank = min(found)
        if rank == 1 << 60:
            break
        at = found.index(rank)
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
        del found[at]
        if at:
            found[at - 1] = ranks.get(parts[at - 1] + parts[at], 1 << 60)
        if at < len(found):
            found[at] = ranks.get(parts[at] + parts[at + 1], 1 << 60)
    return parts


def last_merge(token: bytes, ranks: dict[bytes, int]) -> tuple[int, int] | None:
    """The two tokens whose merge makes this one, (-1, -1) for a single byte, None if merges never make it."""
    if len(token) == 1:
        return -1, -1
    parts = merge(token, ranks, 2)
    return (ranks[parts[0]], ranks[parts[1]]) if len(parts) == 2 else None


class Transducer:
    """Bytes in, token ids out."""

    def __init__(self, ranks: dict[bytes, int], states: int = STATES):
        self.ranks, self.most = ranks, states
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.child: dict[int, int] = {}
        self.token: list[int] = [-1]
        self.halves: dict[int, tuple[int, int]] = {}
        for token, rank in ranks.items():
            node = ROOT
            for b in token:
                node = self.child.setdefault(node << 8 | b, len(self.token))
                if node == len(self.token):
                    self.token.append(-1)
            halves = last_merge(token, ranks)
            if halves:  # others never come out of merges
                self.token[node] = rank
                self.halves[rank] = halves
        parents = {key >> 8 for key in self.child}
        self.goes_on = [node in parents for node in range(len(self.token))]
        self.length = [len(self.bytes_of.get(i, b"")) for i in range(max(self.bytes_of) + 1)]
        self.depth = [0] * len(self.token)
        for key, node in self.child.items():  # parents come first
            self.depth[node] = self.depth[key >> 8] + 1
        self.pairs: dict[tuple[int, int], bool] = {}
        self._reset()

    def _reset(self) -> None:
        start = ((-1, ROOT),)
        self.number, self.sets = {start: 0}, [start]
        self.moves: dict[int, tuple[int, int]] = {}

    def _follows(self, before: int, token: int) -> bool:
        """May the token come after the other in an encoding?"""
        if before < 0:
            return True
        found = self.pairs.get((before, token))
        if found is None:
            found = not self._meet(before, token)
            if len(self.pairs) < 4 * self.most:
                self.pairs[before, token] = found
        return found

    def _meet(self, before: int, token: int) -> bool:
        """Would a merge cross the border? Each token is built by merges of rising rank. A part at the border lives from
        its own rank to that of the part it goes into; two parts that live at once, one on each side, merge if
        their union is a token and its turn comes before either goes into another part of its own side."""
        left = [(before, 1 << 60)]
        while (inner := self.halves[left[-1][0]][1]) >= 0:
            left.append((inner, left[-1][0]))
        right = [(token, 1 << 60)]
        while (inner := self.halves[right[-1][0]][0]) >= 0:
            right.append((inner, right[-1][0]))
        i, j = len(left) - 1, len(right) - 1
        while True:
            (a, a_ends), (b, b_ends) = left[i], right[j]
            union = self.ranks.get(self.bytes_of[a] + self.bytes_of[b], 1 << 60)
            if union < a_ends and (union < b_ends or union == b_ends < 1 << 60):  # of equal ranks the left one is first
                return True
            if a_ends == b_ends == 1 << 60:
                return False
            if a_ends <= b_ends:
                i -= 1
            else:
                j -= 1

    def _move(self, state: int, byte: int) -> tuple[int, int]:
        """Determinise one transition: the last token of the encoding of what is read so far, and the state after."""
        open_, last = [], -1
        for before, node in self.sets[state]:
            below = self.child.get(node << 8 | byte)
            if below is None:
                continue
            token = self.token[below]
            if token >= 0 and last < 0 and self._follows(before, token):
                last = token
            if self.goes_on[below]:
                open_.append((before, below))
        after = (*open_, (last, ROOT))
        number = self.number.setdefault(after, len(self.sets))
        if number == len(self.sets):
            self.sets.append(after)
        self.moves[state << 8 | byte] = last, number
        return last, number

    def _walk(self, lasts: list[int], end: int) -> list[int]:
        """The tokens of what is read up to a border."""
        out, length = [], self.length
        while end:
            token = lasts[end - 1]
            out.append(token)
            end -= length[token]
        out.reverse()
        return out

    def _agreed(self, lasts: list[int], state: int) -> int:
        """The last border that lies on the way of all open guesses."""
        at = [len(lasts) - self.depth[node] for _, node in self.sets[state]]
        while len(set(at)) > 1:
            i = at.index(max(at))
            at[i] -= self.length[lasts[at[i] - 1]]
        return at[0]

    def encode(self, piece: bytes) -> bytes:
        """Ids of one piece as little-endian unsigned 32-bit integers. A piece that is a token has that id."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return whole.to_bytes(4, "little")
        if len(self.sets) > self.most:
            self._reset()
        state, lasts, moves, out = 0, [], self.moves, []
        for byte in piece:
            last, state = moves.get(state << 8 | byte) or self._move(state, byte)
            lasts.append(last)
            if len(lasts) >= PENDING:
                border = self._agreed(lasts, state)
                out += self._walk(lasts, border)
                del lasts[:border]
        return pack(out + self._walk(lasts, len(lasts)))


def pack(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class Utf8Stream:
    """Releases the whole characters of a byte stream; keeps back at most three bytes of an unfinished one."""

    def __init__(self):
        self.held = b""

    @staticmethod
    def unfinished(data: bytes) -> int:
        """How many bytes at the end belong to a character that is not complete yet."""
        for back in range(1, min(3, len(data)) + 1):
            byte = data[-back]
            if byte >= 0xC0:
                need = 2 if byte < 0xE0 else 3 if byte < 0xF0 else 4
                return back if need > back else 0
            if byte < 0x80:
                return 0
        return 0

    def feed(self, data: bytes) -> bytes:
        data = self.held + data
        keep = self.unfinished(data)
        self.held = data[len(data) - keep :]
        return data[: len(data) - keep]

    def finish(self) -> bytes:
        """What is left of a stream that ended within a character."""
        data, self.held = self.held, b""
        return data


class _Words(dict):
    """Ids of the parts of a text between spaces. None: the part's ids depend on what stands around it."""

    def __init__(self, codec: Codec, lead: str):
        super().__init__()
        self.codec, self.lead = codec, lead

    def __missing__(self, part: str) -> bytes | None:
        if "\n" in part:
            first, *lines = part.split("\n")
            found = [self[first], *(self.codec.starts[x] for x in lines)]
            return None if None in found else self.codec.line.join(found)
        if part.isalpha():
            ids = self.codec.transducer.encode((self.lead + part).encode())
        elif part.split() != [part]:
            return None
        else:
            ids = self.codec.pieces(self.lead + part)
        if len(part) <= MEMO_LONGEST:
            if len(self) > MEMO_WORDS:
                self.clear()
            self[part] = ids
        return ids


class Codec:
    """Encodes and decodes whole texts."""

    def __init__(self, path: str, pattern: str):
        self.transducer = Transducer(read_ranks(path))
        # white space as Unicode has it, in all versions of the pattern's library
        self.pattern = regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
        self.line = self.transducer.encode(b"\n")
        self.starts, self.inner = _Words(self, ""), _Words(self, " ")
        tokens = self.transducer.bytes_of
        self.table = pa.array([tokens.get(i, b"") for i in range(max(tokens) + 1)], pa.binary())

    def pieces(self, text: str) -> bytes:
        encode = self.transducer.encode
        return b"".join(encode(p.encode()) for p in self.pattern.findall(text))

    def encode(self, text: str | None) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        first, *rest = text.split(" ")
        try:
            return b"".join([self.starts[first], *map(self.inner.__getitem__, rest)])
        except TypeError:  # white space beside white space
            return self.pieces(text)

    def token_bytes(self, ids: np.ndarray) -> tuple[memoryview, np.ndarray]:
        """The bytes of all ids in a row, and where each id's bytes end."""
        if not len(ids):
            return memoryview(b""), np.zeros(1, np.int64)
        taken = self.table.take(pa.array(ids.astype(np.int64)))
        ends = np.frombuffer(taken.buffers()[1], np.int32)[: len(ids) + 1].astype(np.int64)
        return memoryview(taken.buffers()[2])[: int(ends[-1])], ends

    def decode(self, portions: Iterable[np.ndarray]) -> Iterator[bytes]:
        """Whole characters of a stream of ids that arrives in portions."""
        stream = Utf8Stream()
        for ids in portions:
            yield stream.feed(bytes(self.token_bytes(ids)[0]))
        yield stream.finish()


def codec(path: str, pattern: str) -> Codec:
    """This worker's codec."""
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = Codec(path, pattern)
    return _codecs[path, pattern]


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids) of every row; ids: little-endian unsigned 32-bit integers."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches_of_documents(batches):
            ids = [own.encode(t) for t in batch.column("text").to_pylist()]
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "n_tokens": pa.array([len(x) // 4 for x in ids], pa.int64()), "ids": pa.array(ids, pa.binary())})

    return docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(rows, ENCODED)


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """The columns of `encoded`, and `decoded`: the bytes of the text."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches_of_documents(batches, text="ids"):
            out = [b"".join(own.decode([np.frombuffer(x, "<u4")])) for x in batch.column("ids").to_pylist()]
            yield pa.record_batch({**{c: batch.column(c) for c in ("doc_id", "n_tokens", "ids")}, "decoded": pa.array(out, pa.binary())})

    return encoded.mapInArrow(rows, ENCODED + ", decoded binary")


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encode and decode each text in one pass, keeping digests only."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches_of_documents(batches):
            ids = [own.encode(t) for t in batch.column("text").to_pylist()]
            decoded = []
            for x in ids:
                digest = hashlib.sha256()
                for part in own.decode(np.frombuffer(x, "<u4")[i : i + 65_536] for i in range(0, len(x) // 4, 65_536)):
                    digest.update(part)
                decoded.append(digest.hexdigest())
            yield pa.record_batch({
                "doc_id": batch.column("doc_id"),
                "n_tokens": pa.array([len(x) // 4 for x in ids], pa.int64()),
                "ids_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in ids]),
                "decoded_sha256": pa.array(decoded),
            })

    return docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(rows, DIGESTS)
