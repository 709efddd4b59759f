"""Substring dedup by a log-structured fingerprint index.

The unit is a window of `WINDOW` consecutive words. A word goes if a window that covers it also starts in
a document with a smaller id. Every window holds `WINDOW - ANCHOR + 1` shorter runs of `ANCHOR` words; the
one with the smallest hash is its anchor. Equal windows have equal anchors, so the index needs only the
distinct anchors of a document, about two in seven windows, and loses nothing.

* `SubstringIndex.add` takes a batch of new documents, packs its anchors by key range, merges each range
  with the sorted immutable runs of earlier batches, and writes (a) the anchors that two documents share
  and (b) a new run with the keys that no run held before. Old runs are never rewritten, except that
  `compact` merges them into one when there are `fan_in` of them. An index with a path lasts: `opened` goes on with it in
  another session; its documents' texts stay where they are, and are read again where a batch shares an anchor with them.
* `verify` looks at whole windows: those whose anchor is shared are identified by a 128-bit BLAKE2b digest
  of their exact words, and the smallest document of each is found.
* `strip` removes the covered words; it is told their places, not their digests, to keep that table small.

Anchors travel as packed rows, one for each key range and flush. What documents of one flush share is answered on the spot, and only
its least document goes on to the key range, so a passage that all documents hold puts one entry for each flush of
`FLUSH` entries into its range, not one for each document. Digests are treated alike.

Documents are told apart by their id; rows with a null id by a hash of their text.

Defined cases: a null text has no words; empty texts and texts under 13 words lose nothing; rows that
repeat a doc_id are the same document, so neither is removed on the other's account; rows with a null
doc_id count as larger than any other and never as an origin (and are not thinned out on the way to a range of digests); an empty table gives an empty table;
other columns are not looked at, whatever their names; doc_id may be of any integer type.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from catalith.llm.common import Memo, batches_of_documents, bits_for, buckets, corpus_bytes, mix, new_folder, remove, write

WINDOW, ANCHOR = 13, 8
#: Bytes of text whose anchors make up one key range.
RANGE_BYTES = 8 << 20
#: Entries that a task holds before it packs and emits them.
FLUSH = 1_000_000
_C = np.uint64(0x9E3779B97F4A7C15)
_words = Memo(xxhash.xxh3_64_intdigest)

#: Kinds of packed rows: entries of a batch, replies to documents, entries of a run. nul: the documents are rows without an id.
ENTRY, REPLY, RUN = 0, 1, 2
PACKED = "kind int, nul boolean, bucket int, keys binary, docs binary"


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words, and the number of words of each text. bytes.split() splits at 0x20 and 0x09-0x0D only."""
    parts = [t.split() if t else [] for t in texts]
    lengths = np.fromiter(map(len, parts), np.int64, len(parts))
    hashes = np.fromiter((h for words in parts for h in map(_words.__getitem__, words)), np.uint64, int(lengths.sum()))
    return hashes, lengths


def run_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of each k consecutive words."""
    out = np.zeros(max(0, len(words) - k + 1), np.uint64)
    for j in range(k):
        out *= _C
        out += words[j : j + len(out)]
    return mix(out)


def anchors(words: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each window: its anchor's key, its text's place in the batch, and its first word's place in the batch."""
    if len(words) < WINDOW:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    short = run_hashes(words, ANCHOR)
    n = len(words) - WINDOW + 1
    least = short[:n].copy()
    for j in range(1, WINDOW - ANCHOR + 1):
        np.minimum(least, short[j : j + n], out=least)
    ends = np.repeat(np.cumsum(lengths), lengths)
    start = np.flatnonzero(np.arange(n) + WINDOW <= ends[:n])
    owner = np.repeat(np.arange(len(lengths)), lengths)[start]
    return mix(least[start] + np.uint64(1)), owner, start  # minima crowd at small values, so they are mixed again


def _starts(values: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins."""
    return np.flatnonzero(np.r_[True, values[1:] != values[:-1]]) if len(values) else np.zeros(0, np.int64)


def _rows(kind: int, nul: bool, bucket: np.ndarray, keys: list[bytes], docs: list[bytes]) -> pa.RecordBatch:
    n = len(bucket)
    return pa.record_batch({"kind": pa.array(np.full(n, kind, np.int32)), "nul": pa.array(np.full(n, nul)), "bucket": pa.array(bucket.astype(np.int32)), "keys": pa.array(keys, pa.binary()), "docs": pa.array(docs, pa.binary())})


def _pack(keys: np.ndarray, docs: np.ndarray, bits: int, nul: bool, lane: np.ndarray | None = None, places: np.ndarray | None = None) -> pa.RecordBatch:
    """Rows by key range of entries sorted by key; lane and places: what else each entry carries, beside its key and its document."""
    where = buckets(keys, bits)
    cuts = _starts(where)
    ends = np.r_[cuts, len(keys)][1:].astype(np.int64)
    body = keys if lane is None else np.column_stack([keys, lane])
    parts = list(zip(cuts.tolist(), ends.tolist(), strict=True))
    return _rows(ENTRY, nul, where[cuts], [body[a:b].tobytes() for a, b in parts], [docs[a:b].tobytes() + (b"" if places is None else places[a:b].tobytes()) for a, b in parts])


def _reply(nul: np.ndarray, docs: np.ndarray, body: np.ndarray, bits: int) -> Iterator[pa.RecordBatch]:
    """What concerns each document, packed by ranges of mixed ids, so that a range of keys sends one row to a range of documents."""
    for kind in (False, True):
        mine = np.flatnonzero(nul == kind)
        where = buckets(mix(docs[mine].view(np.uint64)), bits)
        order = np.argsort(where, kind="stable")
        mine, where = mine[order], where[order]
        cuts = _starts(where)
        parts = list(zip(cuts.tolist(), np.r_[cuts, len(mine)][1:].tolist(), strict=True))
        yield _rows(REPLY, kind, where[cuts], [body[mine[a:b]].tobytes() for a, b in parts], [docs[mine[a:b]].tobytes() for a, b in parts])


def _by_document(table: pa.Table) -> pa.Table:
    """One row for each document of a range, with all entries that concern it."""
    packed = b"".join(table.column("keys").to_pylist())
    docs = np.frombuffer(b"".join(table.column("docs").to_pylist()), np.int64)
    entries = np.frombuffer(packed, f"V{len(packed) // len(docs)}") if len(docs) else np.zeros(0, "V1")
    order = np.argsort(docs, kind="stable")
    docs, entries = docs[order], entries[order]
    cuts = _starts(docs)
    parts = zip(cuts.tolist(), np.r_[cuts, len(docs)][1:].tolist(), strict=True)
    nul = table.column("nul")[0].as_py() if table.num_rows else False
    return pa.table({"nul": pa.array(np.full(len(cuts), nul)), "addr": pa.array(docs[cuts]), "keys": pa.array([entries[a:b].tobytes() for a, b in parts], pa.binary())})


def _changes(*columns: np.ndarray) -> np.ndarray:
    """Where any column differs from the row before; true for the first row."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return new


def _anchor_rows(bits: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            key, nul, doc = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            order = np.lexsort((doc, nul, key))
            key, nul, doc = key[order], nul[order], doc[order]
            new = _changes(key, nul, doc)
            key, nul, doc = key[new], nul[new], doc[new]
            first = _changes(key)
            cuts = np.flatnonzero(first)
            shared = np.repeat(np.diff(np.r_[cuts, len(key)]) > 1, np.diff(np.r_[cuts, len(key)]))
            yield from _reply(nul[shared], doc[shared], key[shared], bits)
            for kind in (False, True):
                mine = first & (nul == kind)  # the least document of each key
                yield _pack(key[mine], doc[mine], bits, kind)

        for batch in batches_of_documents(batches):
            ids, nul = batch.column("addr").to_numpy(), batch.column("nul").to_numpy(zero_copy_only=False)
            key, owner, _ = anchors(*word_hashes(batch.column("text").to_pylist()))
            if len(key):
                change = _changes(key, owner)
                held.append((key[change], nul[owner[change]], ids[owner[change]]))
                total += len(held[-1][0])
            if total >= FLUSH:
                yield from flush()
                total = 0
        if total:
            yield from flush()

    return rows


def _entries(table: pa.Table, kind: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys, nul flags and documents of the table's rows of a kind."""
    mine = table.filter(pc.equal(table.column("kind"), kind))
    keys = [np.frombuffer(x, np.uint64) for x in mine.column("keys").to_pylist()]
    nul = np.repeat(mine.column("nul").to_numpy(zero_copy_only=False).astype(bool), [len(k) for k in keys])
    return np.concatenate([np.zeros(0, np.uint64), *keys]), nul, np.frombuffer(b"".join(mine.column("docs").to_pylist()), np.int64)


def _merge(bits: int):
    """Merge a key range of a batch with that of the runs: replies and the new run. Replies of the flushes pass."""

    def rows(table: pa.Table) -> pa.Table:
        if table.column("kind")[0].as_py() == REPLY:
            return table.select(["kind", "nul", "bucket", "keys", "docs"])
        old, new = _entries(table, RUN), _entries(table, ENTRY)
        keys, nul, docs = (np.concatenate([a, b]) for a, b in zip(old, new, strict=True))
        known = np.arange(len(keys)) < len(old[0])
        order = np.lexsort((docs, nul, keys))
        keys, nul, docs, known = keys[order], nul[order], docs[order], known[order]
        cuts = _starts(keys)
        sizes = np.diff(np.r_[cuts, len(keys)])
        several = np.add.reduceat(_changes(keys, nul, docs).astype(np.int64), cuts) > 1
        shared = np.repeat(several & ~nul[cuts] & np.logical_or.reduceat(~known, cuts), sizes)  # the least one has an id, or none has
        fresh = cuts[~np.logical_or.reduceat(known, cuts) & ~nul[cuts]]
        run = _rows(RUN, False, np.full(1, table.column("bucket")[0].as_py()), [keys[fresh].tobytes()], [docs[fresh].tobytes()])
        return pa.Table.from_batches([*_reply(nul[shared], docs[shared], keys[shared], bits), run])

    return rows


def _join_runs(table: pa.Table) -> pa.Table:
    keys, _, docs = _entries(table, RUN)
    order = np.argsort(keys, kind="stable")
    return pa.Table.from_batches([_rows(RUN, False, np.full(1, table.column("bucket")[0].as_py()), [keys[order].tobytes()], [docs[order].tobytes()])])


MANIFEST = "version int, bits int, fan_in int, runs array<string>, replies array<string>"


class SubstringIndex:
    """Sorted immutable runs of the anchors of all documents seen so far, in the shared folder, or for good in the folder `path`.
    bits: key ranges as a power of two, chosen for the size that the index is to reach (`bits_for`)."""

    def __init__(self, spark: SparkSession, bits: int, fan_in: int = 2, path: str | None = None):
        self.spark, self.bits, self.fan_in, self.path, self.version = spark, bits, fan_in, path, 0
        self.runs: list[str] = []
        self.replies: list[str] = []

    @classmethod
    def opened(cls, spark: SparkSession, path: str) -> SubstringIndex:
        """The index that an earlier session left at path."""
        last = spark.read.schema(MANIFEST).parquet(f"{path}/manifest").orderBy(F.desc("version")).first()
        index = cls(spark, last["bits"], last["fan_in"], path)
        index.runs, index.replies, index.version = list(last["runs"]), list(last["replies"]), last["version"]
        return index

    def add(self, docs: DataFrame) -> DataFrame:
        """Index a batch; return the anchors that it shares with others, packed by ranges of documents, origins included."""
        if len(self.runs) >= self.fan_in:
            self.compact()
        rows = _addressed(docs).mapInArrow(_anchor_rows(self.bits), PACKED)
        for run in self.runs:
            rows = rows.unionByName(self._read(run, RUN))
        path = self._folder("run")
        write(rows.groupBy("bucket", F.col("kind") == REPLY).applyInArrow(_merge(self.bits), PACKED), path, "kind")
        self.runs.append(path)
        self.replies.append(path)
        self._note()
        return self._read(path, REPLY)

    def shared(self) -> DataFrame:
        """What all batches so far share, as `add` gives it for each."""
        found = self._read(self.replies[0], REPLY)
        for path in self.replies[1:]:
            found = found.unionByName(self._read(path, REPLY))
        return found

    def compact(self) -> None:
        """Merge all runs into one; their keys are disjoint."""
        path = self._folder("compact")
        rows = self._read(self.runs[0], RUN)
        for run in self.runs[1:]:
            rows = rows.unionByName(self._read(run, RUN))
        write(rows.groupBy("bucket").applyInArrow(_join_runs, PACKED), path, "kind")
        old, self.runs = self.runs, [path]
        self._note()
        for run in old:
            remove(self.spark, f"{run}/kind={RUN}")

    def drop(self) -> None:
        """Delete the runs; what `add` returned stays."""
        for run in self.runs:
            remove(self.spark, f"{run}/kind={RUN}")
        self.runs = []
        self._note()

    def _folder(self, name: str) -> str:
        return f"{self.path.rstrip('/')}/{name}-{uuid.uuid4().hex}" if self.path else new_folder(self.spark, f"index-{name}")

    def _note(self) -> None:
        """Write down what a later session must know, before anything old is deleted."""
        self.version += 1
        if self.path:
            row = (self.version, self.bits, self.fan_in, self.runs, self.replies)
            self.spark.createDataFrame([row], MANIFEST).coalesce(1).write.mode("append").parquet(f"{self.path.rstrip('/')}/manifest")

    def _read(self, run: str, kind: int) -> DataFrame:
        return self.spark.read.schema(PACKED).parquet(run).filter(F.col("kind") == kind).select("kind", "nul", "bucket", "keys", "docs")


def _digests(bits: int):
    """(document, place, digest of a window) of all windows whose anchor is shared."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[bytes, np.ndarray, np.ndarray, np.ndarray]] = []
        total = 0

        def flush() -> Iterator[pa.RecordBatch]:
            body = np.frombuffer(b"".join(d for d, _, _, _ in held), np.uint64).reshape(-1, 2)
            nul, docs, places = (np.concatenate([x[i] for x in held]) for i in (1, 2, 3))
            held.clear()
            order = np.lexsort((docs, nul, body[:, 1], body[:, 0]))
            body, nul, docs, places = body[order], nul[order], docs[order], places[order]
            later = _judged(body, nul, docs)
            yield from _reply(nul[later], docs[later], _gone(body[later], places[later]), bits)
            for kind in (False, True):
                mine = ~later & (nul == kind)
                yield _pack(body[mine, 0], docs[mine], bits, kind, body[mine, 1], places[mine])

        for batch in batches_of_documents(batches):
            for nul, doc, digests, places in window_digests(batch):
                n = len(digests)
                held.append((b"".join(digests), np.full(n, nul), np.full(n, doc, np.int64), np.array(places, np.int32)))
                total += n
            if total >= FLUSH // 2:
                yield from flush()
                total = 0
        if total:
            yield from flush()

    return rows


def _judged(body: np.ndarray, nul: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """Of windows sorted by digest, nul and document: which start in a smaller document."""
    cuts = np.flatnonzero(_changes(body[:, 0], body[:, 1]))
    sizes = np.diff(np.r_[cuts, len(docs)])
    least, has_id = np.repeat(docs[cuts], sizes), np.repeat(~nul[cuts], sizes)
    return has_id & (nul | (docs != least))


#: A window that goes: its first word's place, and two bytes of its digest, which tell rows apart that repeat a doc_id with another text.
GONE = np.dtype([("place", "<i4"), ("check", "<u2")])


def _gone(body: np.ndarray, places: np.ndarray) -> np.ndarray:
    gone = np.zeros(len(places), GONE)
    gone["place"], gone["check"] = places, body[:, 0] & np.uint64(0xFFFF)
    return gone


def digest(words: list[bytes]) -> bytes:
    return hashlib.blake2b(b" ".join(words), digest_size=16).digest()


def window_digests(batch: pa.RecordBatch) -> Iterator[tuple[bool, int, list[bytes], list[int]]]:
    """Of each document: its nul flag and address, and the digests and first words of the windows whose anchor is among its keys."""
    ids, nul = batch.column("addr").to_numpy(), batch.column("nul").to_numpy(zero_copy_only=False)
    texts, wanted = batch.column("text").to_pylist(), batch.column("keys").to_pylist()
    words, lengths = word_hashes(texts)
    key, owner, start = anchors(words, lengths)
    begins = np.cumsum(lengths) - lengths
    lows, highs = np.searchsorted(owner, np.arange(len(ids))), np.searchsorted(owner, np.arange(len(ids)), "right")
    for i, keys in enumerate(wanted):
        if not keys or lows[i] == highs[i]:
            continue
        hit = np.isin(key[lows[i] : highs[i]], np.frombuffer(keys, np.uint64))
        places = (start[lows[i] : highs[i]][hit] - begins[i]).tolist()
        if places:
            parts = texts[i].split()
            yield bool(nul[i]), int(ids[i]), [digest(parts[p : p + WINDOW]) for p in places], places


def _origins(bits: int):
    """The windows of a digest range that start in a smaller document. Replies of the flushes pass."""

    def rows(table: pa.Table) -> pa.Table:
        if table.column("kind")[0].as_py() == REPLY:
            return table.select(["kind", "nul", "bucket", "keys", "docs"])
        keys, rest = table.column("keys").to_pylist(), table.column("docs").to_pylist()
        body = np.frombuffer(b"".join(keys), np.uint64).reshape(-1, 2)
        nul = np.repeat(table.column("nul").to_numpy().astype(bool), [len(k) // 16 for k in keys])
        docs = np.frombuffer(b"".join(r[: len(k) // 2] for k, r in zip(keys, rest, strict=True)), np.int64)
        places = np.frombuffer(b"".join(r[len(k) // 2 :] for k, r in zip(keys, rest, strict=True)), np.int32)
        order = np.lexsort((docs, nul, body[:, 1], body[:, 0]))
        body, nul, docs, places = body[order], nul[order], docs[order], places[order]
        later = _judged(body, nul, docs)
        return pa.Table.from_batches(list(_reply(nul[later], docs[later], _gone(body[later], places[later]), bits)))

    return rows


def _gather(replies: DataFrame, name: str) -> DataFrame:
    """(nul, addr, name): one row for each document."""
    return replies.groupBy("nul", "bucket").applyInArrow(_by_document, "nul boolean, addr long, keys binary").withColumnRenamed("keys", name)


def _addressed(docs: DataFrame, *more: Column) -> DataFrame:
    """(nul, addr, text) of every row: its id, or the hash of its text where it has none."""
    text = F.col("text").cast("binary")
    return docs.select(F.col("doc_id").isNull().alias("nul"), F.coalesce(F.col("doc_id").cast("long"), F.xxhash64(text)).alias("addr"), text.alias("text"), *more)


def verify(docs: DataFrame, shared: DataFrame, bits: int) -> DataFrame:
    """The windows that start in a smaller document, as `GONE` entries packed by ranges of documents."""
    path = new_folder(docs.sparkSession, "windows")
    wanted = _addressed(docs).join(_gather(shared, "keys"), ["nul", "addr"])
    rows = wanted.mapInArrow(_digests(bits), PACKED)
    write(rows.groupBy("bucket", F.col("kind") == REPLY).applyInArrow(_origins(bits), PACKED), path)
    return docs.sparkSession.read.schema(PACKED).parquet(path)


STRIPPED = ("doc_id", "n_words", "n_removed", "kept")


def _strip(batches: Iterator[pa.RecordBatch], carry: list[str]) -> Iterator[pa.RecordBatch]:
    for batch in batches_of_documents(batches):
        parts = [t.split() if t else [] for t in batch.column("text").to_pylist()]
        gone: dict[int, np.ndarray] = {}
        for i, entries in enumerate(batch.column("windows").to_pylist()):
            if not entries:
                continue
            found = np.frombuffer(entries, GONE)
            hit = [p for p, c in found.tolist() if digest(parts[i][p : p + WINDOW])[:2] == c.to_bytes(2, "little")]
            if hit:
                cover = np.zeros(len(parts[i]) + WINDOW + 1, np.int32)
                np.add.at(cover, hit, 1)
                np.add.at(cover, np.array(hit) + WINDOW, -1)
                gone[i] = np.cumsum(cover)[: len(parts[i])] > 0
        kept = [b" ".join(w for w, g in zip(p, gone[i].tolist(), strict=True) if not g) if i in gone else b" ".join(p) for i, p in enumerate(parts)]
        yield pa.record_batch({
            "doc_id": batch.column("_doc_id"),
            "n_words": pa.array([len(p) for p in parts], pa.int64()),
            "n_removed": pa.array([int(gone[i].sum()) if i in gone else 0 for i in range(len(parts))], pa.int64()),
            "kept": pa.array(kept, pa.binary()),
            **{c: batch.column("_" + c) for c in carry},
        })


def strip(docs: DataFrame, windows: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, n_words, n_removed, kept) of every row, and the carried columns."""
    more = [c for c in carry if c not in STRIPPED]
    rows = _addressed(docs, *[F.col(c).alias("_" + c) for c in ("doc_id", *more)]).join(_gather(windows, "windows"), ["nul", "addr"], "left")
    kinds = [T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.BinaryType())]
    schema = T.StructType([docs.schema["doc_id"], *kinds, *[docs.schema[c] for c in more]])
    return rows.select("text", "windows", *["_" + c for c in ("doc_id", *more)]).mapInArrow(partial(_strip, carry=more), schema)


def deduplicate(docs: DataFrame, steps: int = 3, fan_in: int = 2, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, n_words, n_removed, kept) and the carried columns of every row, by way of an index that takes the documents in `steps` batches of rising id."""
    spark = docs.sparkSession
    bits = bits_for(corpus_bytes(docs), RANGE_BYTES)
    index = SubstringIndex(spark, bits, fan_in)
    wanted = [i / steps for i in range(1, steps)]
    found = docs.agg(F.percentile_approx("doc_id", wanted, 1_000).alias("cuts")).first()["cuts"] if wanted else []
    cuts = sorted(set(found or []))
    for low, high in zip([None, *cuts], [*cuts, None], strict=True):
        batch = docs if low is None else docs.filter((F.col("doc_id") > low) | F.col("doc_id").isNull())
        if high is not None:
            batch = batch.filter(F.col("doc_id") <= high)
        index.add(batch)
    index.drop()  # a lasting index would stay for the next batch of documents
    return strip(docs, verify(docs, index.shared(), bits), carry)
