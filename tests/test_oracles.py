"""Every query with a SQL twin, held against DuckDB at the smallest scale."""

from __future__ import annotations

import pytest

from tesselle.plans import registry


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_same_rows(name, spark, sf_dir, duck, same):
    same(registry.QUERIES[name](spark, sf_dir), duck, registry.ORACLES[name])


def test_only_chains_and_seeds_have_no_twin():
    assert set(registry.QUERIES) - set(registry.ORACLES) == {"anneal_grouped", "kmeans_seed"}


def test_seeds(spark, sf_dir):
    """All parcels, twelve labels, and each parcel at the middle it is nearest to."""
    import numpy as np

    got = {r.parcel_id: r.nid for r in registry.QUERIES["kmeans_seed"](spark, sf_dir).collect()}
    fields = ["px", "py", "assr_market_value"]
    rows = {r.parcel_id: [float(r[f]) for f in fields] for r in registry.derived(spark, sf_dir).select("parcel_id", *fields).collect()}
    assert got.keys() == rows.keys() and set(got.values()) == set(range(12))
    ids = sorted(rows)
    x, nid = np.array([rows[i] for i in ids]), np.array([got[i] for i in ids])
    x = (x - x.mean(0)) / x.std(0)
    middle = np.stack([x[nid == k].mean(0) for k in range(12)])
    apart = ((x[:, None] - middle) ** 2).sum(2)
    # Lloyd's steps may stop a little before the last ones; most rows are with their nearest middle.
    assert (apart.argmin(1) == nid).mean() > 0.95
    assert apart[np.arange(len(x)), nid].sum() < 0.45 * (x**2).sum()


def test_entry(spark, sf_dir):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 16
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
