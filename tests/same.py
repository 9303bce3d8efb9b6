"""Comparison of result tables."""


def assert_same(got, want):
    """Two pandas frames hold the same rows, whatever their order."""
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    got, want = (x[columns].sort_values(columns).reset_index(drop=True) for x in (got, want))
    assert len(got) == len(want)
    for c in columns:
        different = (got[c] != want[c]) & ~(got[c].isna() & want[c].isna())
        assert not different.any(), (c, got[different.values].head(3), want[different.values].head(3))
