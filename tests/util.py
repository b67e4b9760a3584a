"""Comparing frames by key."""

import numpy as np
import pandas as pd


def keyed(df, columns, keys=("symbol", "bar_idx")) -> pd.DataFrame:
    return df.select(*keys, *columns).toPandas().sort_values(list(keys)).reset_index(drop=True)


def assert_same(a: pd.DataFrame, b: pd.DataFrame, rtol: float = 1e-9, atol: float = 1e-9) -> None:
    assert list(a.columns) == list(b.columns)
    assert len(a) == len(b)
    for c in a.columns:
        if a[c].dtype.kind in "fiub" and b[c].dtype.kind in "fiub":
            x, y = a[c].astype(float).to_numpy(), b[c].astype(float).to_numpy()
            assert np.allclose(x, y, rtol=rtol, atol=atol, equal_nan=True), c
        else:
            assert (a[c].astype(str) == b[c].astype(str)).all(), c
