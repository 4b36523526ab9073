"""Property tests: the null-safe join equals a pandas-style merge where null keys match."""
import pandas as pd
from hypothesis import given, settings
from hypothesis import strategies as st

from tablens.operators import joins

keys = st.lists(st.one_of(st.none(), st.integers(0, 4)), max_size=12)


@settings(max_examples=15, deadline=None)
@given(left=keys, right=keys, how=st.sampled_from(["inner", "left", "outer"]))
def test_join_counts_match_null_matching_merge(spark, left, right, how):
    lp = pd.DataFrame({"k": pd.array(left, dtype="Int64"), "a": range(len(left))})
    rp = pd.DataFrame({"k": pd.array(right, dtype="Int64"), "b": range(len(right))})
    want = len(lp.merge(rp, on="k", how=how))          # pandas merge: null keys match each other
    ls = spark.createDataFrame([(None if pd.isna(k) else int(k), i) for i, k in enumerate(left)], "k int, a int")
    rs = spark.createDataFrame([(None if pd.isna(k) else int(k), i) for i, k in enumerate(right)], "k int, b int")
    assert joins.join_two(ls, rs, "k", how, "r", match_nulls=True).count() == want


def _expected(values, n_rows):
    """The preview rules for one text column, written out plainly."""
    import re
    nn = [v for v in values if v is not None]
    if not nn:
        return 0, None, False
    dates = sum(bool(re.match(r"^\d{4}-\d{2}-\d{2}$", v)) for v in nn)
    if dates / len(nn) > 0.5:
        return None, "datetime", False
    k = len(set(nn))
    if k <= 1:
        return k, None, False
    if k / n_rows > 0.9:
        return k, None, True
    nums = sum(bool(re.match(r"^-?\d+(\.\d+)?$", v)) for v in nn)
    if nums / len(nn) > 0.8:
        return k, "numeric-coerce", False
    return (k, "one-hot", False) if k <= 10 else (k, "label", False)


cell = st.one_of(st.none(), st.sampled_from(["a", "b", "c"]), st.integers(0, 30).map(lambda i: f"w{i}"),
                 st.integers(-5, 99).map(str), st.integers(1, 28).map(lambda d: f"2024-02-{d:02d}"))


@settings(max_examples=10, deadline=None)
@given(col=st.lists(cell, min_size=1, max_size=40))
def test_classifier_matches_rules(spark, col):
    from tablens.operators import profile
    df = spark.createDataFrame([(v,) for v in col], "t string")
    got = profile.classify_columns(df).first()
    assert (got["cardinality"], got["suggested_encoding"], got["is_id_like"]) == _expected(col, len(col))
