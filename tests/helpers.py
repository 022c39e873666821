"""What tests share."""

import pandas as pd

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(df) -> list:
    """Rows as comparable text, whatever their order and column order."""
    pdf = df if hasattr(df, "iloc") else df.toPandas()
    pdf = pdf[sorted(pdf.columns)]

    def show(v):
        if v is None or (isinstance(v, float) and v != v):
            return "null"
        if isinstance(v, float):
            return repr(v)
        return str(v)

    out = []
    for r in pdf.itertuples(index=False):
        out.append(tuple(show(None if v is pd.NA or v is pd.NaT else float(v) if hasattr(v, "dtype") and v.dtype.kind in "fiu" else float(v) if isinstance(v, int) and not isinstance(v, bool) else v) for v in r))
    return sorted(out)
