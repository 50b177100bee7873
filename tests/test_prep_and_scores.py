"""Quantile bins, codes and scores against plain Python."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pytest

from tesselle.operators import prep, scoring
from tesselle.plans import registry


def test_bins_match_pandas(spark):
    rng = np.random.default_rng(0)
    for values in (rng.exponential(2000, 500), rng.integers(0, 5, 300).astype(float), np.array([3.0] * 20), np.array([1.0, 2.0])):
        v = [None if i % 17 == 0 else float(x) for i, x in enumerate(values)]
        df = spark.createDataFrame([(i, x) for i, x in enumerate(v)], "id long, x double")
        got = {r.id: r.x_binned for r in prep.quantile_bins(df, ["x"], 10).collect()}
        s = pd.Series(v, dtype=float)
        want = pd.qcut(s, 10, labels=False, duplicates="drop") if s.nunique() > 1 else pd.Series([np.nan] * len(s))
        assert got == {i: None if math.isnan(x) else int(x) for i, x in want.items()}


@pytest.mark.parametrize("most", [5000, 2])
def test_codes_keep_gaps_or_rank(spark, monkeypatch, most):
    monkeypatch.setattr(prep, "MOST_CODES", most)
    df = spark.createDataFrame([(0, 3, None), (1, 5, 7), (2, 9, 2)], "id long, a int, b int")
    got = {(r.id, r.field): r.code for r in prep.bin_codes(df, ["a", "b"]).collect()}
    assert got == {(0, "a"): 0, (1, "a"): 2, (2, "a"): 6, (0, "b"): 0, (1, "b"): 2, (2, "b"): 1}


def plain_score(inside, overall, weight, n, g, exact):
    if n <= 0:
        return 2.0
    if n == 1:
        return 1.0
    if n >= g:
        return 0.0
    s = 0.0
    for k, c in overall.items():
        i, o = inside.get(k, 0), c - inside.get(k, 0)
        if i == 0 and not exact:
            continue
        s += weight[k[0]] * ((i * math.log(i * g / (n * c)) if i else 0) + (o * math.log(o * g / ((g - n) * c)) if o else 0))
    return s / g


def test_scores_match_plain(spark):
    rng = np.random.default_rng(1)
    rows = [(p, int(rng.integers(0, 4)) if p else 9, f, int(rng.integers(0, 5))) for p in range(200) for f in "ab"]
    label = {p: n for p, n, f, _ in rows if f == "a"}
    rows = [(p, label[p], f, c) for p, _, f, c in rows]
    codes = spark.createDataFrame(rows, "parcel_id long, nid long, field string, code int")
    weight = {"a": 1.5, "b": 0.25}
    w = spark.createDataFrame(list(weight.items()), "field string, weight double")
    overall, size = {}, {}
    for _, _, f, c in rows:
        overall[f, c] = overall.get((f, c), 0) + 1
    for n in label.values():
        size[n] = size.get(n, 0) + 1
    for exact in (False, True):
        got = {r.nid: (r.n, r.score) for r in scoring.score_labels(codes, w, exact=exact).collect()}
        for n, count in size.items():
            inside = {}
            for _, m, f, c in rows:
                if m == n:
                    inside[f, c] = inside.get((f, c), 0) + 1
            assert got[n][0] == count and abs(got[n][1] - plain_score(inside, overall, weight, count, 200, exact)) < 1e-9
    assert got[9][1] == 1.0  # a label of one parcel


def test_gains_match_relabelling(spark, sf_dir):
    """Set-at-a-time gains equal relabelling the tile and scoring again."""
    codes = registry.codes(spark, sf_dir).cache()
    w = registry.weights(spark)
    ways, found = registry.donation_gains(spark, sf_dir)
    picked = ways.join(found, "cand").orderBy("cand").limit(2).collect()
    before = {r.nid: r.score for r in scoring.score_labels(codes, w).collect()}
    for move in picked:
        moved = codes.selectExpr("parcel_id", f"case when tile_id = {move.tile} then {move.n2}L else nid end as nid", "field", "code")
        after = {r.nid: r.score for r in scoring.score_labels(moved, w).collect()}
        mixed = codes.filter(f"tile_id = {move.tile}").select("nid").distinct().count() > 1
        if not mixed:
            assert abs(sum(after.get(n, 2.0) - before[n] for n in (move.n1, move.n2)) - move.gain) < 1e-9


def test_validation_messages(spark):
    universe = [("a", "numeric"), ("model_group", "text"), ("b_binned", "prebinned"), ("r", "derived")]
    found = lambda **c: {(r.setting, r.value, r.fatal) for r in prep.validate_fields(spark, universe, {"weights": {"a_binned": 1.0}, "continuous_variables": ["a"], **c}, ["condos"]).collect()}
    assert found() == set()
    assert found(parcel_filter_column="nope") == {("parcel_filter_column", "nope", True)}
    assert found(parcel_filter_column="model_group", parcel_filter_value="house") == {("parcel_filter_value", "house", True)}
    assert found(weights={"r_binned": 1.0, "b_binned": 1.0}) == {("weights", "r_binned", True)}
    assert found(weights={}) == {("weights", "(empty)", True)}
    assert found(adjacency_mode="parcel", obstacle_mode="all_except", land_class_column="x") == {("land_class_column", "x", False)}
