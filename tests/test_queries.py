"""Every registered query of the route operators against its SQL in DuckDB."""

import math

import duckdb
import pytest

from groundroute.jobs import sweep
from groundroute.jobs.queries import ORACLE_SQL, QUERIES
from groundroute.operators import grid, keypoints, metrics, routes, traversability
from groundroute.shared import shuffled
from groundroute.sources import images
from tests.conftest import DATA


def plain(rows):
    clean = lambda v: None if v is None or isinstance(v, float) and math.isnan(v) else v
    return sorted((tuple(map(clean, r)) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"create view orders as select * from '{DATA}/orders.parquet'")
    found = QUERIES[name](spark, DATA)
    names = sorted(found.columns)
    cursor = con.execute(ORACLE_SQL[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == names
    wanted = [tuple(r[columns.index(n)] for n in names) for r in cursor.fetchall()]
    assert plain(found.select(*[f"`{n}`" for n in names]).collect()) == plain(wanted)


def test_sweeps_run_the_default_chain(spark, monkeypatch):
    from groundroute.jobs import queries as Q

    asked, run = [], Q.SW.run_sweep
    monkeypatch.setattr(Q.SW, "run_sweep", lambda *a, **options: asked.append(options) or run(*a, **options))
    for name in ("run_sweep", "run_sweep_overlap", "run_sweep_multiscale"):
        Q.QUERIES[name](spark, DATA)
    assert Q.QUERIES["run_sweep_overlap_multiscale"](spark, DATA).count() > 0
    assert all(o.get("smooth", True) and o.get("normalize", True) for o in asked)
    assert asked[-1] == {"ov": 2, "multiscale": True}


@pytest.mark.parametrize("name", ["path_centers", "trace_paths", "route_all", "run_sweep_multiscale"])
def test_no_step_of_a_job_is_broadcast_by_size(spark, monkeypatch, name):
    """With small() out of the way no join of the whole job is left to Spark's choice, which goes by the size of files."""
    for module in (grid, keypoints, metrics, routes, traversability, images, sweep):
        monkeypatch.setattr(module, "small", shuffled)
    store = spark._jsparkSession.sharedState().statusStore()
    last = lambda: (n := store.executionsList().size()) and store.executionsList().apply(n - 1).executionId()
    before = last()
    QUERIES[name](spark, DATA).write.format("noop").mode("overwrite").save()
    spark._jsparkSession.sparkContext().listenerBus().waitUntilEmpty(30_000)
    steps = [store.executionsList().apply(n) for n in range(store.executionsList().size())]
    plans = [s.physicalPlanDescription() for s in steps if s.executionId() > before]
    assert len(plans) > 5 and any("SortMergeJoin" in p for p in plans)
    assert not [p for p in plans if "Broadcast" in p]
