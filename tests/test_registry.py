"""Every registered query of the library against its SQL."""

from __future__ import annotations

import pytest

from canopy import registry
from tests.conftest import rows_of

ORACLE = registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query_matches_sql(spark, duck, sf_dir, name):
    got, want = registry.queries()[name](spark, sf_dir).toPandas(), duck.execute(ORACLE[name]).df()
    assert rows_of(got) == rows_of(want)


def test_signatures_hold_every_customer(spark):
    sf_dir = "/root/testdata/sf0.01"
    want = sorted(r[0] for r in spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_name").collect())
    got = " ".join(r["signature"] for r in registry.queries()["k_signatures"](spark, sf_dir).collect())
    assert len(want) > 400 and sorted(w for w in got.split() if w.startswith("Customer#")) == want


def test_entry_gives_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(registry.queries()) <= set(__spark_entry__.queries())
