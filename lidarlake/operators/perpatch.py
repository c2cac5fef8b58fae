"""User code that works on the points of one patch at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame

from lidarlake.operators.patch import patch_keys


def apply_per_patch(
    patches: DataFrame,
    function: Callable[[dict, pd.DataFrame], pd.DataFrame],
    schema: str,
    dims: Sequence[str],
) -> DataFrame:
    """Run ``function(key, points)`` on every patch; no shuffle.

    A patch is one row already, and of bounded size, so rows go to Python in Arrow
    batches where they lie. ``key`` maps the key columns of the patch to its values.
    """
    dims = list(dims)
    keys = patch_keys(patches)

    def over_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.to_dict("records"):
                points = pd.DataFrame({d: row[d] for d in dims})
                yield function({k: row[k] for k in keys}, points)

    return patches.select(*keys, *dims).mapInPandas(over_batches, schema)
