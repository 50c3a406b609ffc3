DATA = "/root/testdata/sf0.001"


def same_rows(got, expected):
    """Rows of two pandas frames are the same in any order; doubles to nine digits."""
    import pandas as pd

    def text(v):
        if v is None or (not hasattr(v, "__len__") and pd.isna(v)):
            return "null"
        if isinstance(v, float):
            return f"{v + 0.0:.9g}"
        return str(v)

    assert sorted(got.columns) == sorted(expected.columns)
    cols = sorted(got.columns)
    rows = lambda df: sorted(tuple(map(text, r)) for r in df[cols].astype(object).itertuples(index=False, name=None))
    a, b = rows(got), rows(expected)
    assert len(a) == len(b)
    assert a == b
