"""Exact dedup by composable polynomial fingerprints.

A normalised text is read as a number in base 256; its fingerprint is that number modulo the prime `PRIME`.
Chunks are hashed on their own and combined by length-shifted arithmetic, H(AB) = H(A) * 256^|B| + H(B), so
parts of a huge document may be hashed apart and in parallel (`combine` is associative).

Rows with equal fingerprint and length are candidates. Those are then compared chunk by chunk: every
candidate's normalised text is streamed next to that of the first row of its fingerprint class, in chunks of
`CHUNK` bytes, and a row that differs is set apart by the digest of its text. The class's first text is dealt
out over salts in proportion to the class, so that a class with a third of all rows spreads over many tasks. Rows meet what is
known of their class by a join in which classes with more than a `HOT`th of all rows, of which there are fewer than `HOT`, are broadcast.

Rows are found again by a hash of id and text, so repeated and null ids are compared like any other.

Defined cases: null counts as empty, and empty texts equal each other; ties go to the smallest doc_id, a null
doc_id counting as larger than any; repeated rows with one doc_id are all kept by that id, so each of them
has kept = true and they count in group_size; where no row of a group has an id, keep_id is null and all are kept; an empty table
gives an empty table; other columns are not looked at, whatever their names; doc_id may be of any integer type.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from catalith.llm.common import batches_of_documents, text_bytes, written

#: A prime of 100 bits. Powers of two modulo it have a long period, unlike modulo a Mersenne prime.
PRIME = 10**30 + 57
CHUNK = 1 << 16
#: Bytes and rows of a fingerprint class that one salt holds.
SALT_BYTES, SALT_ROWS = 8 << 20, 100
MARKS = "at long, doc_id long, fp binary, size long, text_sha256 string"
HOT = 256

_SPACES = bytes.maketrans(b"\t\n\x0b\x0c\r", b"     ")
_RUNS = re.compile(rb"  +")


def normalise(text: bytes) -> bytes:
    """Each run of 0x20 and 0x09-0x0D becomes one space."""
    text = text.translate(_SPACES)
    return _RUNS.sub(b" ", text) if b"  " in text else text


@F.pandas_udf(T.StringType())
def text_digest(text: pd.Series) -> pd.Series:
    """SHA-256 of a text's normalised bytes."""
    return text.map(lambda t: hashlib.sha256(normalise(t)).hexdigest())


def chunk_hash(chunk: bytes) -> tuple[int, int]:
    """Fingerprint and length of a chunk."""
    return int.from_bytes(chunk, "big") % PRIME, len(chunk)


def combine(left: tuple[int, int], right: tuple[int, int]) -> tuple[int, int]:
    """Fingerprint and length of two parts, one after the other."""
    return (left[0] * pow(256, right[1], PRIME) + right[0]) % PRIME, left[1] + right[1]


def fingerprint(text: bytes, chunk: int = CHUNK) -> tuple[int, int]:
    whole = (0, 0)
    for at in range(0, len(text), chunk):
        whole = combine(whole, chunk_hash(text[at : at + chunk]))
    return whole


def same(left: bytes, right: bytes, chunk: int = CHUNK) -> bool:
    """Compare two texts chunk by chunk, up to the first difference."""
    if len(left) != len(right):
        return False
    a, b = memoryview(left), memoryview(right)
    return all(a[i : i + chunk] == b[i : i + chunk] for i in range(0, len(left), chunk))


def _fingerprint_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches_of_documents(batches):
        texts = [normalise(t) for t in batch.column("text").to_pylist()]
        marks = [fingerprint(t) for t in texts]
        yield pa.record_batch({
            "at": batch.column("at"),
            "doc_id": batch.column("doc_id").cast(pa.int64()),
            "fp": pa.array([h.to_bytes(13, "big") for h, _ in marks], pa.binary()),
            "size": pa.array([n for _, n in marks], pa.int64()),
            "text_sha256": pa.array([hashlib.sha256(t).hexdigest() for t in texts]),
        })


DIFFERING = "at long, fp binary, size long"


def _differing_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by class and salt, the class's first text leading: those whose text differs from it."""
    key, lead = None, b""
    for batch in batches_of_documents(batches):
        found = []
        for row in zip(*(batch.column(c).to_pylist() for c in ("at", "fp", "size", "salt", "text")), strict=True):
            text = normalise(row[4])
            if fingerprint(text)[0].to_bytes(13, "big") != row[1]:
                continue  # another row with that number
            if row[1:4] != key:
                key, lead = row[1:4], text
            elif not same(lead, text):
                found.append(row[:3])
        yield pa.record_batch({"at": pa.array([x[0] for x in found], pa.int64()), "fp": pa.array([x[1] for x in found], pa.binary()), "size": pa.array([x[2] for x in found], pa.int64())})


def with_class(rows: DataFrame, classes: DataFrame, key: list[str], count: str, total: int) -> DataFrame:
    """Rows with the columns of their class, by broadcast for classes of more than total / HOT rows, so that none of them meets in one task."""
    hot = classes.filter(F.col(count) > total / HOT)  # fewer than HOT rows, as their rows add up to total at most
    mark = hot.select(*key).withColumn("_hot", F.lit(True))
    split = rows.join(F.broadcast(mark), key, "left")
    many = split.filter("_hot").drop("_hot").join(F.broadcast(hot), key)
    few = split.filter("_hot is null").drop("_hot").join(classes.filter(F.col(count) <= total / HOT), key)
    return many.unionByName(few)


def numbered(docs: DataFrame) -> DataFrame:
    """(at, doc_id, text): rows with the hash of id and text, by which they are found again."""
    return docs.select(F.xxhash64("doc_id", "text").alias("at"), "doc_id", text_bytes().alias("text"))


def collisions(texts: DataFrame, marks: DataFrame, salt_bytes: int = SALT_BYTES) -> DataFrame:
    """(at, fp, size) of the rows whose text differs from the first one of their fingerprint class."""
    once = marks.groupBy("fp", "size", "at").agg(F.count("*").alias("n"))  # equal rows are compared once
    groups = once.groupBy("fp", "size").agg(F.min("at").alias("first"), F.count("*").alias("rows")).filter("rows > 1")
    groups = written(groups.withColumn("salts", F.ceil(F.greatest(F.col("rows") * (F.col("size") + 1) / salt_bytes, F.col("rows") / SALT_ROWS)).cast("int")), "candidates")
    rows = with_class(once.drop("n"), groups, ["fp", "size"], "rows", once.count())
    leads = F.col("at") == F.col("first")
    salts = F.when(leads, F.sequence(F.lit(0), F.col("salts") - 1)).otherwise(F.array(F.pmod(F.xxhash64("at"), F.col("salts")).cast("int")))
    rows = rows.select("at", "fp", "size", leads.alias("leads"), salts.alias("salts"))
    rows = texts.join(rows, "at").select("at", "fp", "size", "leads", F.explode("salts").alias("salt"), "text")
    rows = rows.repartition("fp", "size", "salt").sortWithinPartitions("fp", "size", "salt", F.desc("leads"))
    return rows.drop("leads").mapInArrow(_differing_rows, DIFFERING)


def classes(docs: DataFrame) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) of every row."""
    kind = docs.schema["doc_id"].dataType
    texts = numbered(docs)
    marks = written(texts.mapInArrow(_fingerprint_rows, MARKS), "fingerprints")
    differing = written(collisions(texts, marks).distinct().withColumn("differs", F.lit(True)), "collisions")
    variant = F.when(F.col("differs"), F.col("text_sha256")).otherwise("")
    marks = marks.join(differing, ["at", "fp", "size"], "left").withColumn("variant", variant)
    key = ["fp", "size", "variant"]
    groups = written(marks.groupBy(*key).agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size")), "groups")
    kept = F.coalesce(F.col("doc_id") == F.col("keep_id"), F.col("keep_id").isNull())
    found = with_class(marks, groups, key, "group_size", marks.count())
    return found.select(F.col("doc_id").cast(kind), F.col("keep_id").cast(kind).alias("keep_id"), "group_size", kept.alias("kept"), "text_sha256")
