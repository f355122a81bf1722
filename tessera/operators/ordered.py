"""Recurrences along the rows of a key, where a window can't say what the next row depends on."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame


def scan(rows: DataFrame, key: str, order: list[str], start: Callable[[], object], step: Callable[[object, tuple], tuple[object, object]], name: str, kind: str) -> DataFrame:
    """rows with the column `name`: step(state, row) gives the next state and the value of each row of a key, in order, from start().

    A key's rows are read in order by one task, batch by batch, and only the state is kept, so a key may have any number of rows; keys
    are dealt over the tasks. Nulls are a key like any other.
    """
    columns = rows.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, state = object(), None
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False, name="Row"):
                own = getattr(row, key)
                own = None if own is None or own != own else own
                if own != last:
                    last, state = own, start()
                state, value = step(state, row)
                out.append(value)
            batch[name] = out
            yield batch

    dealt = rows.repartition(key).sortWithinPartitions(key, *order)
    fields = ", ".join(f"`{c}` {t}" for c, t in rows.select(*columns).dtypes)
    return dealt.mapInPandas(run, f"{fields}, `{name}` {kind}")
