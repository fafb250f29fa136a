"""Greedy packing of ordered rows into batches limited by items and code points."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def greedy_batches(rows: DataFrame, shard: str, order: str, text: str, max_items: int, max_chars: int) -> DataFrame:
    """rows with batch_no, counted within each shard in the given order.

    A batch ends before the row that would break a limit; a longer row is a batch of its own. The rule
    is sequential, so a shard is one task's work: choose shards of bounded size.
    """
    kinds = dict(rows.dtypes)
    schema = f"`{shard}` {kinds[shard]}, `{order}` {kinds[order]}, n_chars long, batch_no long"
    slim = rows.select(shard, order, F.length(text).cast("long").alias("n_chars"))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        out, items, chars, number = [], 0, 0, 0
        for n in pdf["n_chars"]:
            if items and (items == max_items or chars + n > max_chars):
                number, items, chars = number + 1, 0, 0
            items, chars = items + 1, chars + n
            out.append(number)
        return pdf.assign(batch_no=out)

    return slim.groupBy(shard).applyInPandas(pack, schema)
