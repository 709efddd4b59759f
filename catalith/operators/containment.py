"""Which of many needles each text holds (O-062, O-098, O-137, O-144): an automaton over the needles, run once over each text.

Needles go into a goto/fail automaton in blocks of `BLOCK`, by a hash: a block is what a worker holds, some ten million nodes at most for short needles. Each text
is read once for every block, whatever the number of needles in it, and hits are exact, so no text travels to be verified. Up to one block needs one pass.

Defined cases: null and empty needles are never held; a null text holds nothing; repeated needles are one; repeated rows have their hits each; where a needle lies within another one both are held.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalith.session import prepare, written

BLOCK = 100_000

_automata: dict[str, object] = {}


def _automaton(key: str, needles: list[str]):
    """This worker's automaton of a block; a new block takes the place of the one before."""
    if key not in _automata:
        import ahocorasick

        built = ahocorasick.Automaton()
        for n in needles:
            built.add_word(n, n)
        built.make_automaton()
        _automata.clear()
        _automata[key] = built
    return _automata[key]


def _held_rows(needles: list[str], body: str, keep: list[str]):
    key = hashlib.sha256("\n".join(needles).encode()).hexdigest()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = _automaton(key, needles)
        for batch in batches:
            owner, found = [], []
            for i, text in enumerate(batch.column(body).to_pylist()):
                hits = sorted({n for _, n in run.iter(text)}) if text else ()
                owner.extend([i] * len(hits))
                found.extend(hits)
            yield pa.record_batch({**{c: batch.column(c).take(pa.array(owner, pa.int64())) for c in keep}, "needle": pa.array(found, pa.string())})

    return rows


def containing(texts: DataFrame, body: str, keep: list[str], needles: DataFrame, block: int = BLOCK) -> DataFrame:
    """(keep, needle) of each text that holds a needle. needles: (needle)."""
    spark = prepare(texts.sparkSession)
    wanted = needles.select("needle").filter("needle <> ''").distinct()
    n = -(-wanted.count() // block)
    source = texts.select(*keep, body)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.select(*keep).schema) + ", needle string"
    if not n:
        return spark.createDataFrame([], schema)
    if n > 1:  # several passes
        source, wanted = written(source, "texts"), written(wanted, "needles")
    parts = []
    for i in range(n):
        own = sorted(r["needle"] for r in wanted.filter(F.pmod(F.xxhash64("needle"), F.lit(n)) == i).collect())  # about `block` needles
        if own:
            parts.append(source.mapInArrow(_held_rows(own, body, keep), schema))
    return reduce(DataFrame.unionByName, parts)
