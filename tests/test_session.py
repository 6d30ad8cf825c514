import os

from orbitweave import session
from orbitweave.plans.queries import QUERIES


def test_a_run_leaves_nothing_behind(spark):
    outer = session.shared_dir(spark).removeprefix("file:")
    before = {f for f in os.listdir(outer)}
    with session.run_folder(spark) as folder:
        inside = folder.removeprefix("file:")
        assert session.shared_dir(spark) == folder
        rows = QUERIES["write_once"](spark, "/root/testdata/sf0.001").collect()
        session.durable(spark.range(5)).count()
        assert rows and len(os.listdir(inside)) >= 2
        with session.run_folder(spark) as inner:
            assert session.shared_dir(spark) == inner and inner.startswith(folder)
        assert session.shared_dir(spark) == folder
    left = set(os.listdir(outer)) - before  # a new folder for checkpoints to come, at most
    assert not os.path.exists(inside) and all(not os.listdir(f"{outer}/{f}") for f in left) and len(left) <= 1
    assert session.shared_dir(spark) != folder
    kept = session.durable(spark.range(7))
    assert kept.count() == 7
