"""Token buckets of a stream: the same recurrence as over tables, with each key's state kept between batches."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.limits import HOUR, walked


def limited_stream(events: DataFrame, key: str, time: str, order: str, capacity: int, cost: str | None = None) -> DataFrame:
    """`events` with allowed and tokens. Within a batch events of a key go in the order of `time` and `order`; an event that is older than those of earlier batches refills nothing.

    A key's state is two numbers. Costs and null keys are as in `operators.limits.rate_limited`; null times refill nothing.
    """
    columns = events.columns
    price = F.greatest(F.lit(0), F.coalesce(F.col(cost), F.lit(0))).cast("long") if cost else F.lit(1).cast("long")
    rows = events.withColumns({"_key": F.to_json(F.struct(F.col(key).alias("k"))), "_at": F.unix_micros(F.col(time).cast("timestamp")), "_cost": price})
    schema = events.schema.add("allowed", "boolean").add("tokens", "double")

    def limited(_, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tokens, last = state.get if state.exists else (capacity * HOUR, None)
        batch = pd.concat(list(parts)).sort_values(["_at", order], na_position="first")  # one key's events of one batch
        allowed, left = [], []
        for at, price_ in zip(batch["_at"], batch["_cost"], strict=True):
            at = (0 if last is None else last) if pd.isna(at) else int(at) if last is None else max(last, int(at))
            yes, tokens = next(walked(tokens, [(at, int(price_))], last, capacity))
            last = at
            allowed.append(yes)
            left.append(tokens / HOUR)
        state.update((tokens, last))
        yield batch[columns].assign(allowed=allowed, tokens=left)

    return rows.groupBy("_key").applyInPandasWithState(limited, schema, "tokens long, last long", "append", GroupStateTimeout.NoTimeout)
