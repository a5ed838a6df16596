"""Comparison of a Spark result with a DuckDB result, without regard to order."""

import pandas as pd


def plain(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]

    def one(v):
        if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
            return "null"
        if hasattr(v, "item"):
            v = v.item()
        if isinstance(v, float):
            v = round(v, 6)
            return str(int(v)) if v.is_integer() else str(v)
        return str(v)

    return sorted(tuple(one(v) for v in row) for row in df.itertuples(index=False))


def assert_same(got, want) -> None:
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)
