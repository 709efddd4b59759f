"""Minimax contiguous partition of a corpus into shards, by DataFrame and SQL functions only.

Equal texts are one group. Groups stand in the order of a hash of their text; those that share the hash's last
`ATOM_BITS` bits are one atom, so that however large the corpus is, there is a bounded sequence of atom sizes
(65,536), each about total / 65,536 but for what a large group of copies adds. Over this sequence the
smallest feasible shard capacity is found by binary search: a capacity is feasible if greedy filling needs no
more than the wanted number of shards. The shards are cut where greedy filling at that capacity cuts.

A row's slot is the number of rows before its cell, plus its place within the cell. A cell is an atom, or one
of the parts of about `CELL_ROWS` rows into which an atom with many rows is dealt, by a number that each row gets when it is first written down,
so a text with a third of all copies spreads over many tasks, whatever the ids.

Defined cases: a null text has no bytes, size 1 and the checksum of no bytes, and goes with the empty texts;
rows of a cell go by doc_id, then size and checksum, and stand beside each other else; repeated rows have a slot each; an empty table gives an empty table; other
columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from catalith.llm.common import written

SHARDS, ATOM_BITS, CELL_ROWS = 8, 16, 1_000
LAW = "bytes"

#: Over `atoms`, an ordered array of struct(atom, size): the smallest capacity at which greedy filling needs at most {shards} shards.
CAPACITY = """
    aggregate(sequence(1, 63),
        named_struct('low', greatest(array_max(transform(atoms, x -> x.size)), total div {shards}), 'high', total),
        (s, i) -> CASE WHEN s.low >= s.high THEN s
            WHEN aggregate(atoms, named_struct('n', 1, 'sum', 0L),
                (a, x) -> CASE WHEN a.sum + x.size <= s.low + (s.high - s.low) div 2
                    THEN named_struct('n', a.n, 'sum', a.sum + x.size) ELSE named_struct('n', a.n + 1, 'sum', x.size) END).n <= {shards}
            THEN named_struct('low', s.low, 'high', s.low + (s.high - s.low) div 2)
            ELSE named_struct('low', s.low + (s.high - s.low) div 2 + 1, 'high', s.high) END).low
"""
#: The atoms with which greedy filling at `capacity` begins each shard but the first.
CUTS = """
    aggregate(atoms, named_struct('sum', 0L, 'cuts', cast(array() AS array<bigint>)),
        (a, x) -> CASE WHEN a.sum + x.size <= capacity THEN named_struct('sum', a.sum + x.size, 'cuts', a.cuts)
            ELSE named_struct('sum', x.size, 'cuts', array_append(a.cuts, x.atom)) END).cuts
"""


def measured(docs: DataFrame) -> DataFrame:
    """(doc_id, size, text_crc32, atom, number) of every row."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(
        "doc_id",
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).bitwiseAND(2**ATOM_BITS - 1).alias("atom"),
        F.monotonically_increasing_id().alias("number"),
    )


def cuts(atoms: DataFrame, shards: int = SHARDS) -> list[int]:
    """The first atom of each shard but the first; at most shards - 1 numbers."""
    row = atoms.agg(F.array_sort(F.collect_list(F.struct("atom", "size"))).alias("atoms"), F.sum("size").alias("total"))
    capacity = row.select(F.expr(CAPACITY.format(shards=shards)).alias("capacity")).first()["capacity"]  # a literal below, or each step of the fold would search anew
    return list(row.withColumn("capacity", F.lit(capacity).cast("long")).select(F.expr(CUTS).alias("cuts")).first()["cuts"] or [])


def shard(docs: DataFrame, shards: int = SHARDS, cell_rows: int = CELL_ROWS) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of every row."""
    rows = written(measured(docs), "measured")
    atoms = written(rows.groupBy("atom").agg(F.sum("size").alias("size"), F.count("*").alias("rows")), "atoms")
    begins = cuts(atoms, shards)
    at = sum((F.when(F.col("atom") >= b, 1).otherwise(0) for b in begins), F.lit(0)).cast("int")
    parts = F.ceil(F.col("rows") / cell_rows)
    # at most 2**ATOM_BITS rows, so it may be broadcast at any size of the corpus
    dealt = rows.join(F.broadcast(atoms.select("atom", at.alias("shard"), parts.alias("parts"))), "atom")
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("number"), "parts"))
    before = Window.partitionBy("shard").orderBy("atom", "part").rowsBetween(Window.unboundedPreceding, -1)
    cells = dealt.groupBy("shard", "atom", "part").count().withColumn("before", F.coalesce(F.sum("count").over(before), F.lit(0)))
    within = F.row_number().over(Window.partitionBy("atom", "part").orderBy("doc_id", "size", "text_crc32", "number"))
    placed = dealt.withColumn("within", within).join(cells.select("atom", "part", "before"), ["atom", "part"])
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), "shard", (F.col("before") + F.col("within") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
