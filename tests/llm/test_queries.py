"""All queries over empty tables, over null columns, and over the smallest given tables."""

import os

import pytest
from pyspark.sql import functions as F

from tallyforge.llm.queries import oracle_sql, queries

SMALL = "/root/testdata/sf0.001"
TABLES = ("raw_rows", "raw_records", "prep_metadata", "sft_rows", "dpo_rows", "evaluation_rows", "documents", "source_catalog", "split_targets")
needs = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """The schemas without rows, and with rows whose columns are null all but the key."""
    empty, null = (str(tmp_path_factory.mktemp(k)) for k in ("empty", "null"))
    for t in TABLES:
        rows = spark.read.parquet(f"{SMALL}/{t}.parquet")
        rows.limit(0).write.parquet(f"{empty}/{t}.parquet")
        key, *rest = rows.columns if t not in ("sft_rows", "dpo_rows", "evaluation_rows") else ["id", *[c for c in rows.columns if c != "id"]]
        blank = rows.limit(3).select(key, *[F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in rest], F.lit(1).alias("words"), F.lit(2).alias("digest"), F.lit(3).alias("group"))
        blank.unionByName(blank).write.parquet(f"{null}/{t}.parquet")
    return empty, null


@needs
@pytest.mark.parametrize("name", sorted(queries()))
def test_odd_tables(spark, odd, name):
    empty, null = odd
    # a total over nothing is still a row
    assert queries()[name](spark, empty).count() == (1 if name in ("p7_fill", "p3_invariants", "p6_totals", "p7_totals") else 0)
    queries()[name](spark, null).collect()


@needs
@pytest.mark.parametrize("name", sorted(queries()))
def test_small_tables(spark, name):
    assert queries()[name](spark, SMALL).columns


def test_sql_names():
    assert set(oracle_sql()) <= set(queries())


def test_workers_need_no_copy_of_the_package(tmp_path):
    """What is sent to workers loads and runs in a process that can't import the package."""
    import subprocess
    import sys

    import pyarrow as pa
    from pyspark import cloudpickle

    from tallyforge.llm import components, defects, formatting, similar, tokenizing, truncation

    class Sent:  # a broadcast that has arrived
        def __init__(self, value):
            self.value = value

    import zlib

    table = Sent(zlib.compress(bytes(1 << 16), 1))
    texts = pa.RecordBatch.from_pydict({"digest": [b"a", b"b"], "text": ["It ends here.", "It stops in the mid"]})
    values = pa.RecordBatch.from_pydict({"id": ["x"], "field_name": ["chosen"], "question": ["How many boots are there in 3 boxes?"], "answer": ["I cannot help with that."]})
    sets = pa.RecordBatch.from_pydict({"rid": [1, 2], "words": ["a b c d e", "a b c d f"], "side": pa.array([0, 1], pa.int32())})
    clauses = pa.RecordBatch.from_pydict({"rid": [1], "clause": ["one two three four five six"]})
    runs = {
        "ends": (truncation._ends, [texts]), "judged": (defects._judged, [values]), "bands": (defects._bands, [clauses]), "counter": (similar._counter(16, False), [sets]),
        "entries": (similar._entries(table, 16, False, (3, 5)), [sets]), "held": (similar._held_entries(table, 16, (3, 5)), [sets]), "train": (similar._train_entries(table, 16, table, 16), [sets]),
        "combine": (formatting._combine, [pa.RecordBatch.from_pydict({"bucket": [b""], "canon": [b"x"], "key": [1], "n": [1]})]),
        "gathered": (tokenizing._gathered(Sent({"a": (1,)}), False), [pa.RecordBatch.from_pydict({"doc_id": [1], "words": [["a", "b", "a"]]})]),
    }
    loaded = [similar._checker((3, 5), None), similar._joiner((3, 5)), truncation._adjacent, components._forest, defects._verified, formatting._combine_buckets]
    # a test module's own class would be pickled by name
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    (tmp_path / "sent").write_bytes(cloudpickle.dumps((runs, loaded)))
    code = "import pickle; runs, _ = pickle.load(open('sent', 'rb')); print({k: sum(b.num_rows for b in f(iter(x))) > -1 for k, (f, x) in runs.items()})"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True)
    assert done.returncode == 0 and "False" not in done.stdout, done.stderr
