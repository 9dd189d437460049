"""Sequential steps over groups that stream through a task in order, many groups to an Arrow batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

Rows = list[tuple]
#: Rows that a step gives back at once.
OUT_ROWS = 2000


def _batches(found: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held: Rows = []
    put = lambda: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
    for row in found:
        held.append(row)
        if len(held) >= OUT_ROWS:
            yield put()
            held = []
    if held:
        yield put()


def by_group(df: DataFrame, key: str, order: Sequence[str], columns: Sequence[str], step: Callable[[object, Rows], Iterator[tuple]], schema: str) -> DataFrame:
    """step(key, rows) for each group's rows (tuples of columns) in order; its tuples are the result's rows.

    Rows are dealt by key and sorted, so a task holds one group at a time and no
    group costs a frame of its own. A null key is a group like others.
    """
    names = [key, *[c for c in columns if c != key]]
    want = to_arrow_schema(StructType.fromDDL(schema))
    dealt = df.select(*dict.fromkeys([*names, *order])).repartition(F.col(key)).sortWithinPartitions(key, *order).select(*names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[tuple]:
            now, rows = None, []
            for batch in batches:
                for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if rows and r[0] != now:
                        yield from step(now, rows)
                        rows = []
                    now = r[0]
                    rows.append(r[1:])
            if rows:
                yield from step(now, rows)

        yield from _batches(found(), want)

    return dealt.mapInArrow(run, schema)


def by_both(one: DataFrame, two: DataFrame, key: str, order: Sequence[str], columns: Sequence[str], step: Callable[[object, Rows, Rows], Iterator[tuple]], schema: str) -> DataFrame:
    """step(key, rows of one, rows of two); a group that one side lacks has no rows there."""
    side = lambda df, n: df.select(key, *dict.fromkeys([*columns, *order]), F.lit(n).alias("_side"))

    def run(name, rows: Rows) -> Iterator[tuple]:
        cut = next((i for i, r in enumerate(rows) if r[0]), len(rows))
        return step(name, [r[1:] for r in rows[:cut]], [r[1:] for r in rows[cut:]])

    return by_group(side(one, 0).unionByName(side(two, 1)), key, ["_side", *order], ["_side", *columns], run, schema)
