"""Order-insensitive comparison of a Spark result with an oracle result."""
import math

import pandas as pd


def _norm(v):
    if v is None or v is pd.NA or v is pd.NaT:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if hasattr(v, "item") and not isinstance(v, (str, bytes)):
        return _norm(v.item())
    if hasattr(v, "isoformat"):
        s = v.isoformat()
        return s[:10] if s.endswith("T00:00:00") else s
    return v


def rows(pdf):
    cols = sorted(pdf.columns)
    out = [tuple(_norm(x) for x in r) for r in pdf[cols].itertuples(index=False)]
    return cols, sorted(out, key=lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) for x in r))


def assert_same(spark_pdf, oracle_pdf):
    sc, sr = rows(spark_pdf)
    oc, orr = rows(oracle_pdf)
    assert sc == oc, (sc, oc)
    assert len(sr) == len(orr), (len(sr), len(orr))
    diff = [(a, b) for a, b in zip(sr, orr) if a != b]
    assert not diff, diff[:3]
