"""Sequential folds over a key's ordered rows, as streams of sorted partitions.

A partition is sorted by key and order on the JVM and passes through Python row by row; only
the state of the key at hand is held, so a key may have any number of rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(rows: DataFrame, key: str, order: list[Column | str], columns: list[str], start: Callable[[], object], step: Callable[[object, tuple], None], finish: Callable[[object], list[tuple]], schema: str) -> DataFrame:
    """One fold per key: ``finish`` gives the rows of ``schema`` after ``step`` saw each row's ``columns`` in order.

    The key leads each result row.  A null key is a key.
    """
    kind = rows.schema[key].dataType.simpleString()
    names = [key, *(x.split()[0] for x in schema.split(", "))]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state = None, None
        for pdf in frames:
            out = []
            keys = pdf[key].astype(object).where(pdf[key].notna(), None).tolist()
            for k, row in zip(keys, pdf[columns].itertuples(index=False, name=None), strict=True):
                if state is None or k != now:
                    if state is not None:
                        out += [(now, *r) for r in finish(state)]
                    now, state = k, start()
                step(state, row)
            yield pd.DataFrame(out, columns=names)
        if state is not None:
            yield pd.DataFrame([(now, *r) for r in finish(state)], columns=names)

    dealt = rows.repartition(key).sortWithinPartitions(F.col(key), *order)
    return dealt.select(key, *columns).mapInPandas(run, f"{key} {kind}, {schema}")
