"""Folds over rows in order, where no window can say it: sorted partitions are read batch by batch, and only the state of the group at hand is kept."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame


def ordered_fold(rows: DataFrame, by: str, order: list[str], added: str, new: Callable[[], dict], step: Callable[[dict, pd.DataFrame], pd.DataFrame | None], schema: str | None = None) -> DataFrame:
    """``step(state, part)`` over the rows of each ``by`` in order; a part is what one batch holds of a group, so a group of any size passes through.

    The output has the columns of ``rows`` and ``added``, or those of ``schema``. Null keys are one group.
    """
    out = schema or ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema), added])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, state = object(), None
        for batch in batches:
            if not len(batch):
                continue
            keys = batch[by].astype(object).where(batch[by].notna(), None).tolist()
            edges = [0] + [i for i in range(1, len(keys)) if keys[i] != keys[i - 1]] + [len(keys)]
            for a, b in zip(edges[:-1], edges[1:]):
                if keys[a] != held or state is None:
                    held, state = keys[a], new()
                made = step(state, batch.iloc[a:b])
                if made is not None and len(made):
                    yield made

    return rows.repartition(by).sortWithinPartitions(by, *order).mapInPandas(run, out)
