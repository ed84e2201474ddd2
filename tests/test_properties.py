"""Property checks: fills and changes equal pandas on random null patterns,
with random bucket sizes so the cross-bucket carries are exercised."""

import numpy as np
import pandas as pd
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tidemark.operators import align as AL

values = st.lists(st.one_of(st.none(), st.integers(-5, 5).map(float)), min_size=1, max_size=25)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(vals=values, per=st.integers(1, 6))
def test_fill_and_change_match_pandas(spark, monkeypatch, vals, per):
    monkeypatch.setattr(AL, "ROWS_PER_BUCKET", per)
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "t int, v double")
    s = pd.Series(vals, dtype="float64")
    both = AL.fill_both(df, "t").orderBy("t").toPandas()["v"]
    np.testing.assert_array_equal(both.to_numpy(float), s.ffill().bfill().to_numpy(float))
    if s.notna().any():
        assert both.notna().all()          # ffill∘bfill leaves no null when any value exists
    ch = AL.pct_change(df, "t", ["v"], scale=1.0).orderBy("t").toPandas()["v"].to_numpy(float)
    f = s.ffill()
    with np.errstate(divide="ignore", invalid="ignore"):
        exp = (f / f.shift(1) - 1).to_numpy(float)
    exp[~np.isfinite(exp)] = np.nan        # a zero denominator is null here, inf/NaN in pandas
    np.testing.assert_array_equal(ch, exp)
