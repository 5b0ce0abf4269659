"""The queries run with the formal settings; under tight ones every rule of length and allocation shows."""

import importlib
import os

import pytest

from tallyforge.plans import catalog, oracle
from tallyforge.plans.settings import Settings

SMALL = "/root/testdata/sf0.001"
needs = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")
TIGHT = Settings(train=60, validation=10, evaluation=10, mini_train=16, mini_validation=4, mini_evaluation=4, max_length=220, max_prompt_length=160, max_pair_length=230)
TIGHT_PAIRS = Settings(max_prompt_length=170, max_pair_length=260, max_length=260)
SCALED = Settings().scaled(120_000, 12_000)
NAMES = [
    "filter_counts", "length_filter", "dpo_length_filter", "stable_split", "allocate_splits", "row_ids", "split_manifest", "dataset_counts", "shortfall_counts", "mini_prefix", "mini_length_violations",
    "mini_prefix_check", "sft_rows", "dpo_rows", "evaluation_rows", "reserve_rows", "candidate_filter", "candidate_stats", "select_pairs", "no_valid_rejected", "split_report", "total_report",
]


def plain(v):
    return repr(v)


@pytest.fixture
def tight():
    """Catalog and SQL under the tight values."""
    before = catalog.SETTINGS, catalog.PAIRS, catalog.PER_ROWS
    catalog.SETTINGS, catalog.PAIRS, catalog.PER_ROWS = TIGHT, TIGHT_PAIRS, None
    yield importlib.reload(oracle)
    catalog.SETTINGS, catalog.PAIRS, catalog.PER_ROWS = before
    importlib.reload(oracle)


def test_queries_run_with_the_formal_settings():
    assert catalog.SETTINGS == catalog.PAIRS == Settings()
    assert SCALED.train == 80_000 and Settings().scaled(12_000, catalog.PER_ROWS) == Settings()


@needs
def test_no_usable_row_is_lost(spark):
    usable = catalog.queries()["prompt_dedupe"](spark, SMALL).count()
    assert catalog.queries()["stable_split"](spark, SMALL).count() == usable > 0


@needs
@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql_under_tight_settings(spark, tight, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in os.listdir(SMALL):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SMALL}/{f}'")
    made = catalog.queries()[name](spark, SMALL)
    names = sorted(made.columns)
    wanted = con.sql(tight.oracle_sql()[name])
    at = [wanted.columns.index(c) for c in names]
    assert sorted(tuple(plain(r[c]) for c in names) for r in made.collect()) == sorted(tuple(plain(r[i]) for i in at) for r in wanted.fetchall())
