"""Rows whose hash occurs more than once, found without shuffling the rows themselves."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from fraudloom.llm.common import written
from fraudloom.llm.spaced_seeds import bit_array, bits_for, held


def repeated_rows(rows: DataFrame, column: str) -> DataFrame:
    """The rows whose 64-bit hash in `column` occurs in more than one row, and a few more by chance.

    One shuffle of hashes alone, combined before it, tells which repeat. They go into a bit array of
    at most 16 MB however many there are, and the rows, made a second time, are tested against it.
    All rows of one hash pass or none, so counting what passes is exact; a fuller array only lets
    more of the others through. `rows` must come out the same both times and hold no NULL hash.
    """
    again = written(rows.groupBy(F.col(column).alias("seed")).agg(
        F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > 1).select("seed"), "repeats")
    bits = bits_for(again.count())
    table = rows.sparkSession.sparkContext.broadcast(bit_array(again, bits))
    at = rows.columns.index(column)

    def run(batches):
        for batch in batches:
            places = held(table.value, bits, np.asarray(batch.column(at)).view(np.uint64))
            if len(places):
                yield batch.take(pa.array(places))

    return rows.mapInArrow(run, rows.schema)
