"""Alignment of two tokenizers by a dangling-suffix transducer.

Both tokenizers cut the same bytes. Read in turns, one side leads and the other has to catch up: a state is the side that leads and its unmatched bytes.
From the empty state side A moves; else the side that is behind does, and its token is linked with the token that leads, whose bytes it overlaps.
The token may leave some of the unmatched bytes, go beyond them, so that its own side leads with the rest, or meet their end: then both sides end at one
byte and the group is closed. States are residuals, and residuals are suffixes of tokens, so transitions repeat; they are memoised by state and next token.

Neither side has a token across a single space between two other characters (side A's pattern ends a piece there, side B has no piece with a space
after another character), so a text is taken apart there, and the groups of recent parts are kept in a bounded memo. `Aligner` refuses other vocabularies.

Links are counted in three passes. Documents are written down with their distinct linked pairs; these are summed over all documents; each document then looks
its pairs up. The `HOT` most frequent pairs go to all workers, the others are joined, so no pair's documents meet in one task.

Defined cases: a null or empty text has no tokens, and neither has one whose tokens' bytes differ from a space and the text; repeated rows and null or
repeated ids are judged one by one; ties for the highest count are all best; an empty table gives an empty table; other columns are not looked at; long
texts are aligned part by part.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from catalith.llm.common import batches_of_documents, written

#: Parts of texts that a worker remembers and the longest such part; transitions that it remembers; parts that are encoded at once.
MEMO_PARTS, MEMO_LONGEST, MEMO_MOVES, AT_ONCE = 250_000, 48, 1_000_000, 5_000
#: Bytes of texts taken at once; characters of a text taken at once; entries that a task holds before it hands them over; pairs that go to all workers.
TEXT_BYTES, STRETCH, HELD, HOT = 2_000_000, 500_000, 2_000_000, 1 << 18
ALIGNED = "doc_id long, row long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, times binary"
LOOKED_UP = "row long, n_best long, count_sum long, rest array<struct<pair: long, times: long>>"
#: A pair is a * 2^PAIR_BITS + b.
PAIR_BITS = 24

#: Where a text is taken apart, and what tells that some of its spaces are none of these places.
_EDGES, _LOOSE = re.compile(r"(?<=\S) (?=\S)"), re.compile(r"\s\s|\A\s|\s\Z")


def byte_letters() -> dict[str, int]:
    """Byte-level vocabularies write a byte as a letter: printable ones of Latin-1 as themselves, the others in order from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(others)}


class Transducer:
    """Token ids of two sides in, groups and links out."""

    A, B = 1, 2

    def __init__(self, a_bytes: list[bytes], b_bytes: list[bytes], moves: int = MEMO_MOVES):
        self.a_bytes, self.b_bytes, self.most = a_bytes, b_bytes, moves
        self._reset()

    def _reset(self) -> None:
        self.states: list[tuple[int, bytes]] = [(0, b"")]
        self.number = {self.states[0]: 0}
        self.moves: dict[tuple[int, int], int] = {}

    def _move(self, state: int, token: int) -> int:
        """The state after the side that is behind has moved; -1 if the sides' bytes differ."""
        side, residual = self.states[state]
        mover = self.B if side == self.A else self.A
        new = (self.b_bytes if mover == self.B else self.a_bytes)[token]
        if not side:
            after = (mover, new) if new else (0, b"")
        elif residual.startswith(new):
            rest = residual[len(new) :]
            after = (side, rest) if rest else (0, b"")
        elif new.startswith(residual):
            after = mover, new[len(residual) :]
        else:
            return -1
        number = self.number.setdefault(after, len(self.states))
        if number == len(self.states):
            self.states.append(after)
        self.moves[state, token] = number
        return number

    def run(self, a: list[int], b: list[int]) -> tuple[list[tuple[list[int], list[int]]], list[tuple[int, int]]] | None:
        """(groups, links) of two encodings; None if they are not of the same bytes."""
        if len(self.moves) > self.most:
            self._reset()
        moves, states = self.moves, self.states
        groups, links, own_a, own_b = [], [], [], []
        i = j = state = lead = 0
        while i < len(a) or j < len(b):
            side = states[state][0]
            if side == 1:
                if j == len(b):
                    return None
                token = b[j]
                j += 1
                own_b.append(token)
                links.append((lead, token))
            else:
                if i == len(a):
                    return None
                token = a[i]
                i += 1
                own_a.append(token)
                if side:
                    links.append((token, lead))
            state = moves.get((state, token), -1) if (state, token) in moves else self._move(state, token)
            if state < 0:
                return None
            if not state:
                groups.append((own_a, own_b))
                own_a, own_b = [], []
            elif states[state][0] != side:
                lead = token
        return (groups, links) if not state else None


class Aligner:
    """Encodes whole texts on both sides and aligns them."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        letters, size = byte_letters(), self.b.get_piece_size()
        names = {i: name for name, i in self.a.get_vocab(with_added_tokens=True).items()}
        special = {t.content for t in self.a.get_added_tokens_decoder().values()}
        a_bytes = [b"" if names.get(i, "") in special else bytes(letters[c] for c in names.get(i, "")) for i in range(max(names) + 1)]
        pieces = [self.b.id_to_piece(i) for i in range(size)]
        if any("▁" in p.lstrip("▁") for p in pieces):
            raise ValueError("side B has a piece with a space after another character")
        b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        if max(len(a_bytes), len(b_bytes)) >> PAIR_BITS:
            raise ValueError(f"a vocabulary has more than {1 << PAIR_BITS} ids")
        self.transducer = Transducer(a_bytes, b_bytes)
        self.known: dict[str, tuple | None] = {}

    def encoded(self, parts: list[str]) -> Iterator[tuple[list[int], list[int]]]:
        a = self.a.encode_batch_fast([" " + p for p in parts], add_special_tokens=False)
        return zip((x.ids for x in a), self.b.encode(parts, num_threads=1), strict=True)

    def part(self, text: str, a: list[int], b: list[int]) -> tuple[int, int, int, bytes, bytes] | None:
        """(n_a, n_b, n_groups, groups as text, links as pairs) of a part; None if a side's bytes are not those of a space and the part."""
        whole = b" " + text.encode()
        if b"".join(map(self.transducer.a_bytes.__getitem__, a)) != whole or b"".join(map(self.transducer.b_bytes.__getitem__, b)) != whole:
            return None
        groups, links = self.transducer.run(a, b)
        shown = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)
        return len(a), len(b), len(groups), shown.encode(), np.array([x << PAIR_BITS | y for x, y in links], np.int64).tobytes()

    def parts(self, wanted: set[str]) -> dict[str, tuple | None]:
        """Each part's alignment; recent ones from the memo."""
        known = self.known
        found = {p: known[p] for p in wanted if p in known}
        missing = [p for p in wanted if p not in found]
        for at in range(0, len(missing), AT_ONCE):
            some = missing[at : at + AT_ONCE]
            for text, (a, b) in zip(some, self.encoded(some), strict=True):
                found[text] = self.part(text, a, b)
                if len(text) <= MEMO_LONGEST and len(known) < MEMO_PARTS:
                    known[text] = found[text]
        return found

    @staticmethod
    def stretches(text: str) -> Iterator[str]:
        """A long text, cut at single spaces between other characters."""
        at = 0
        while len(text) - at > STRETCH:
            edge = _EDGES.search(text, at + STRETCH)
            if not edge:
                break
            yield text[at : edge.start()]
            at = edge.end()
        yield text[at:] if at else text

    @staticmethod
    def cut(stretch: str) -> list[str]:
        """The parts of a stretch: what stands between single spaces that have other characters on both sides."""
        return _EDGES.split(stretch) if _LOOSE.search(stretch) else stretch.split(" ")

    def align(self, texts: list[str]) -> list[tuple]:
        """(n_a, n_b, n_groups, groups' digest, distinct pairs, their times) of each text."""
        cut = [[self.cut(s) for s in self.stretches(t)] if t else [] for t in texts]
        found = self.parts(set().union(*(p for stretches in cut for p in stretches)))
        return [self._joined([[found[p] for p in parts] for parts in stretches]) for stretches in cut]

    @staticmethod
    def _joined(stretches: list[list[tuple | None]]) -> tuple:
        if not stretches or any(None in parts for parts in stretches):
            return 0, 0, 0, "", np.zeros(0, np.int64), np.zeros(0, np.int64)
        digest, totals, pairs, times = hashlib.sha256(), np.zeros(3, np.int64), [], []
        for i, parts in enumerate(stretches):
            n_a, n_b, n_groups, shown, links = zip(*parts, strict=True)
            digest.update((b";" if i else b"") + b";".join(shown))
            totals += sum(n_a), sum(n_b), sum(n_groups)
            pair, n = np.unique(np.frombuffer(b"".join(links), np.int64), return_counts=True)
            pairs.append(pair)
            times.append(n)
        if len(pairs) > 1:
            pairs, times = zip(summed(np.concatenate(pairs), np.concatenate(times)), strict=True)
        return *totals.tolist(), digest.hexdigest(), pairs[0], times[0]


def summed(pairs: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs and the sum of each one's times."""
    keys, at = np.unique(pairs, return_inverse=True)
    return keys, np.bincount(at, times, len(keys)).astype(np.int64) if len(keys) else times


@cache
def aligner(a_path: str, b_path: str) -> Aligner:
    """This worker's aligner."""
    return Aligner(a_path, b_path)


def aligned(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """`ALIGNED` of every row; pairs and times are arrays of 64-bit and 32-bit integers."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(a_path, b_path)
        for batch in batches_of_documents(batches, TEXT_BYTES):
            n_a, n_b, groups, shown, pairs, times = zip(*own.align(batch.column("text").to_pylist()), strict=True)
            counts = {"n_a": n_a, "n_b": n_b, "n_groups": groups, "n_links": [x + y - z for x, y, z in zip(n_a, n_b, groups, strict=True)]}
            yield pa.record_batch({
                "doc_id": batch.column("doc_id"), "row": batch.column("row"), **{k: pa.array(v, pa.int64()) for k, v in counts.items()}, "groups_sha256": pa.array(shown, pa.string()),
                "pairs": pa.array([x.astype("<i8").tobytes() for x in pairs], pa.binary()), "times": pa.array([x.astype("<u4").tobytes() for x in times], pa.binary()),
            })

    text = F.coalesce("text", F.lit("")).alias("text")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), text).mapInArrow(rows, ALIGNED)


def _pairs(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All pairs of a batch, their times, and where each document's end."""
    pairs, times = batch.column("pairs").to_pylist(), batch.column("times").to_pylist()
    ends = np.cumsum([len(x) // 8 for x in pairs], dtype=np.int64)
    return np.frombuffer(b"".join(pairs), "<i8"), np.frombuffer(b"".join(times), "<u4").astype(np.int64), ends


def pair_counts(documents: DataFrame) -> DataFrame:
    """(pair, n, best): links of each pair in all documents, and whether no other pair of its B id has more."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, times = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches_of_documents(batches, TEXT_BYTES, "pairs"):
            more, n, _ = _pairs(batch)
            pairs, times = summed(np.concatenate([pairs, more]), np.concatenate([times, n]))
            if len(pairs) > HELD:
                yield pa.record_batch({"pair": pairs, "n": times})
                pairs, times = pairs[:0], times[:0]
        yield pa.record_batch({"pair": pairs, "n": times})

    counts = documents.select("pairs", "times").mapInArrow(rows, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    highest = F.max("n").over(Window.partitionBy(F.col("pair").bitwiseAND((1 << PAIR_BITS) - 1)))  # a B id has no more pairs than there are A ids
    return written(counts.select("pair", "n", (F.col("n") == highest).alias("best")), "counts")


def looked_up(documents: DataFrame, pairs: np.ndarray, counts: np.ndarray, best: np.ndarray) -> DataFrame:
    """`LOOKED_UP` of every row: what the frequent pairs add, and the rest of its pairs. `pairs` are in order."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of_documents(batches, TEXT_BYTES, "pairs"):
            own, times, ends = _pairs(batch)
            starts = np.append(0, ends[:-1])
            at = np.minimum(np.searchsorted(pairs, own), max(0, len(pairs) - 1))
            hot = pairs[at] == own if len(pairs) else np.zeros(len(own), bool)
            at = at[hot]
            added = np.zeros((2, len(own) + 1), np.int64)
            added[0, :-1][hot] = times[hot] * best[at]
            added[1, :-1][hot] = times[hot] * counts[at]
            sums = np.cumsum(added, axis=1) - added  # exclusive
            n_best, count_sum = (s[ends] - s[starts] for s in sums)
            left = np.append(0, np.cumsum(~hot))
            rest = pa.StructArray.from_arrays([pa.array(own[~hot]), pa.array(times[~hot])], ["pair", "times"])
            offsets = pa.array(np.append(left[starts], left[ends[-1]]).astype(np.int32))
            yield pa.record_batch({"row": batch.column("row"), "n_best": pa.array(n_best), "count_sum": pa.array(count_sum), "rest": pa.ListArray.from_arrays(offsets, rest)})

    return documents.select("row", "pairs", "times").mapInArrow(rows, LOOKED_UP)


def align(docs: DataFrame, a_path: str, b_path: str, hot: int = HOT) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row."""
    documents = written(aligned(docs, a_path, b_path), "aligned")
    counts = pair_counts(documents)
    frequent = counts.orderBy(F.desc("n"), "pair").limit(hot).orderBy("pair").toArrow()
    columns = [frequent[c].to_numpy() for c in ("pair", "n", "best")]
    known = written(looked_up(documents, *columns), "looked-up")
    rest = known.select("row", F.explode("rest").alias("x")).select("row", "x.pair", "x.times").join(counts, "pair")
    rest = rest.groupBy("row").agg(F.sum(F.col("times") * F.col("best").cast("long")).alias("more_best"), F.sum(F.col("times") * F.col("n")).alias("more_sum"))
    found = documents.drop("pairs", "times").join(known.drop("rest"), "row").join(rest, "row", "left").na.fill(0, ["more_best", "more_sum"])
    n_best, count_sum = (F.col("n_best") + F.col("more_best")).alias("n_best"), (F.col("count_sum") + F.col("more_sum")).alias("count_sum")
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", n_best, count_sum, "groups_sha256")
