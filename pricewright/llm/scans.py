"""Running sums and xors inside groups of any size.

A window keyed by the group would sort a group of a third of all rows in one task.  Here the rows are
range-partitioned in their order, so a large group is dealt over many tasks; each task runs over its
rows as a stream of batches and notes what it has of each group so far.  The groups that reach over a border
of partitions are then put right: one row per partition goes through the driver.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

_OPS = {"sum": np.add, "xor": np.bitwise_xor}


def _segments(values: np.ndarray, starts: np.ndarray, before, op) -> np.ndarray:
    """Running ``op`` that begins anew at each start; ``before`` is what the first segment goes on from."""
    whole = op.accumulate(values)
    previous = np.concatenate([[values.dtype.type(0)], whole])[starts]
    undo = np.repeat(-previous if op is np.add else previous, np.diff(np.append(starts, len(values))))
    out = op(whole, undo)
    if len(starts):
        head = starts[1] if len(starts) > 1 else len(values)
        out[:head] = op(out[:head], before)
    return out


def running(df: DataFrame, group: str, order: list[Column], totals: dict[str, tuple[str, str]], label: str) -> DataFrame:
    """``df`` with a bigint column per entry of ``totals``, which maps a name to (``sum`` or ``xor``, a bigint column).

    ``group`` is a bigint column without nulls and ``order`` sorts by it first.  Each row gets the total of
    its group up to and with itself.  The result is written to the shared folder and lies sorted.
    """
    names, columns = list(totals), df.columns

    def walk(batches):
        part, last, carry, count = TaskContext.get().partitionId(), None, {n: np.int64(0) for n in names}, 0
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            of = batch.column(group).to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
            if last is None or of[0] != last:
                carry = {name: np.int64(0) for name in names}
            added = []
            with np.errstate(over="ignore"):
                for name in names:
                    op, source = totals[name]
                    values = batch.column(source).to_numpy(zero_copy_only=False).astype(np.int64)
                    found = _segments(values, starts, carry[name], _OPS[op])
                    carry[name] = found[-1]
                    added.append(pa.array(found, pa.int64()))
            row = np.arange(count, count + n)
            count += n
            last = of[-1]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *added, pa.array(row, pa.int64()), pa.array(np.full(n, part), pa.int64())],
                [*columns, *names, "_row", "_part"],
            )

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    ddl = f"{types}, {', '.join(f'`{n}` bigint' for n in names)}, _row bigint, _part bigint"
    rows = written(df.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(walk, ddl), label)
    borders = rows.groupBy("_part").agg(F.min(group).alias("first"), F.max(group).alias("last"))
    # One row per partition.
    ends = (
        rows.join(F.broadcast(borders), "_part")
        .where(F.col(group) == F.col("last"))
        .groupBy("_part", "first", "last")
        .agg(*[F.max_by(n, "_row").alias(n) for n in names])
        .orderBy("_part")
        .collect()
    )
    at, so_far, shifts = None, {n: 0 for n in names}, []
    for end in ends:
        if end["first"] == at:
            shifts.append((end["_part"], at, *[so_far[n] for n in names]))
        if end["last"] != at:
            so_far = {n: 0 for n in names}
        at = end["last"]
        so_far = {n: so_far[n] + end[n] if totals[n][0] == "sum" else so_far[n] ^ end[n] for n in names}
    out = [F.col(c) for c in columns]
    if not shifts:
        return rows.select(*out, *names)
    shift = df.sparkSession.createDataFrame(shifts, f"_part bigint, `{group}` bigint, {', '.join(f'_{n} bigint' for n in names)}")
    joined = rows.join(F.broadcast(shift), ["_part", group], "left")
    before = {n: F.coalesce(F.col(f"_{n}"), F.lit(0)) for n in names}
    for n in names:
        out.append((F.col(n) + before[n] if totals[n][0] == "sum" else F.col(n).bitwiseXOR(before[n])).alias(n))
    return joined.select(*out)
