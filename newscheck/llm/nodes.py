"""Numbers of documents, with one of its own for each row without an id."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newscheck.session import discard, materialize

_LEAST, _MOST = -(1 << 63), (1 << 63) - 1
# Bits of a row's place within its partition in Spark's increasing ids.
_PLACE = 33


@dataclass(frozen=True)
class Numbered:
    """``rows`` with a number; ids are ``shift`` above theirs, and numbers beyond ``top`` stand for no id."""

    rows: DataFrame
    shift: int
    top: int
    written: tuple[DataFrame, ...]

    def id_of(self, number: Column) -> Column:
        """The id that a number stands for, null for rows without one."""
        own = number + F.lit(self.shift) if self.shift else number
        return F.when(number <= F.lit(self.top), own) if self.written else own

    def discard(self) -> None:
        """Delete what was written, when nothing reads ``rows`` any more."""
        discard(*self.written)


def numbered(docs: DataFrame, name: str) -> Numbered:
    """``docs`` with the column ``name``: the ``doc_id``, or a number above all ids that no other row has.

    Rows without an id are written with their numbers, so that these hold; they are
    numbered without a gap, in the order they are read, per partition plus an offset per
    partition. Other rows are not written. If the largest id leaves no room above it,
    all ids are moved down; only ids at both ends of the 64 bits leave none.
    """
    own = F.col("doc_id").cast("long")
    low, high, n = docs.agg(F.min(own), F.max(own), F.count_if(own.isNull())).first()
    if not n:
        return Numbered(docs.withColumn(name, own), 0, _MOST, ())
    top = -1 if high is None else high
    shift = max(0, top + n - _MOST)
    if low is not None and low - shift < _LEAST:
        raise ValueError("no room for rows without an id beside the ids")
    written = materialize(docs.where(own.isNull()).withColumn(name, F.monotonically_increasing_id()), "without-id")
    part = F.shiftright(name, _PLACE).alias("_part")
    at, first = top - shift + 1, []
    for r in sorted(written.groupBy(part).count().collect()):
        first.append((r[0], at))
        at += r[1]
    offsets = docs.sparkSession.createDataFrame(first, "_part long, _first long")
    place = F.col(name).bitwiseAND(F.lit((1 << _PLACE) - 1))
    kept = [F.col(f"`{c}`") for c in docs.columns]
    without = written.join(F.broadcast(offsets), F.shiftright(name, _PLACE) == F.col("_part")).select(*kept, (F.col("_first") + place).alias(name))
    with_id = docs.where(own.isNotNull()).withColumn(name, own - F.lit(shift) if shift else own)
    return Numbered(with_id.union(without), shift, top - shift, (written,))
