"""Every journal query against its SQL on the smallest tables."""

import json
import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from runfold import oracle, queries  # noqa: E402
from runfold.sources import journal  # noqa: E402
from tests.compare import connect, rows  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_each_query_has_its_sql():
    assert queries.QUERIES.keys() - oracle.ORACLES.keys() == {"replay_random"}  # Python's own generator: see below
    assert not oracle.ORACLES.keys() - queries.QUERIES.keys()


def test_random_numbers_depend_on_the_run_alone(spark):
    got = queries.QUERIES["replay_random"](spark, SF).collect()
    assert len(got) > 10
    for r in got:
        of = random.Random(r.run_id)
        assert json.loads(r.draws) == [of.random() for _ in range(3)]


@pytest.mark.parametrize("name", sorted(oracle.ORACLES))
def test_query(spark, name):
    got = queries.QUERIES[name](spark, SF).toPandas()
    want = connect(SF).execute(oracle.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


LOOKUPS = {"run_by_id": "o_orderkey,42", "task_by_id": "l_orderkey,42", "tasks_of_run": "l_orderkey,42", "history_of_run": "l_orderkey,42", "effect_by_key": "l_orderkey,42", "effects_of_run": "l_orderkey,42", "lease_by_task": "l_orderkey,42", "signals_of_run": "user_id,7"}


@pytest.mark.parametrize("name", sorted(LOOKUPS))
def test_lookups_reach_the_scan(spark, name):
    """The registered point lookups push their key to every scan and read only the columns that they need."""
    plan = plan_of(queries.QUERIES[name](spark, SF))
    assert plan.count("FileScan") == plan.count(f"EqualTo({LOOKUPS[name]})") + (name == "history_of_run") * plan.count("EqualTo(o_orderkey,42)") and "l_comment" not in plan


def test_exchanges(spark):
    """Folds over the log shuffle it once."""
    for name, most in (("pending_fanout", 1), ("history_steps", 2), ("dispatch_latency", 2)):
        assert plan_of(queries.QUERIES[name](spark, SF)).count("Exchange hashpartitioning") <= most, name


def test_journal_is_written_and_read(spark, tmp_path):
    log = queries.Journal(spark, SF).log
    journal.write_journal(log, f"{tmp_path}/j")
    got = journal.read_journal(spark, f"{tmp_path}/j", "R42")
    assert "EqualTo(run_id,R42)" in plan_of(got) and got.count() == log.where("run_id = 'R42'").count() > 0


@pytest.mark.parametrize("name", ["task_claim_dedup", "lease_acquire", "effect_ledger", "task_complete", "effect_update", "history_steps", "replay_parallel"])
def test_tasks_have_as_many_rows_on_any_size(spark, monkeypatch, name):
    """Rows are dealt by their run over partitions that grow with the table, and no join by key deals them again."""
    monkeypatch.setattr(journal, "LINES_A_TASK", 500, raising=False)
    sf_dir = "/root/testdata/sf0.001"
    parts = -(-spark.read.parquet(f"{sf_dir}/lineitem.parquet").count() // 500)
    plan = queries.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert parts > 4 and f", {parts}), REPARTITION_BY_NUM" in plan and "Join" not in plan
