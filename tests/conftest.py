import os
import sys
from contextlib import contextmanager
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}{os.pathsep}{os.environ.get('PYTHONPATH', '')}"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoints")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def broadcasts(spark):
    """A context under a broadcast threshold; what it gives holds afterwards the rows of each table that was broadcast."""
    store, conf = spark._jsparkSession.sharedState().statusStore(), "spark.sql.autoBroadcastJoinThreshold"

    @contextmanager
    def under(threshold):
        sent, first = [], max((e.executionId() for e in _items(store.executionsList())), default=-1)
        spark.conf.set(conf, threshold)
        try:
            yield sent
        finally:
            spark.conf.unset(conf)
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        for e in (e.executionId() for e in _items(store.executionsList()) if e.executionId() > first):
            values = store.executionMetrics(e)
            for node in _items(store.planGraph(e).allNodes()):
                if node.name() == "BroadcastExchange":
                    found = [values.get(m.accumulatorId()) for m in _items(node.metrics()) if m.name() == "number of output rows"]
                    sent += [int(v.get().replace(",", "")) for v in found if v.isDefined()]

    return under


@pytest.fixture
def made(spark):
    """A context; what it gives holds afterwards (description, rows) of each operator named so that ran in it."""
    store = spark._jsparkSession.sharedState().statusStore()

    @contextmanager
    def by(name):
        found, first = [], max((e.executionId() for e in _items(store.executionsList())), default=-1)
        yield found
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        for e in (e.executionId() for e in _items(store.executionsList()) if e.executionId() > first):
            values = store.executionMetrics(e)
            for node in _items(store.planGraph(e).allNodes()):
                rows = [values.get(m.accumulatorId()) for m in _items(node.metrics()) if node.name() == name and m.name() == "number of output rows"]
                found += [(node.desc(), int(v.get().replace(",", ""))) for v in rows if v.isDefined()]

    return by


def _items(seq):
    return [seq.apply(i) for i in range(seq.size())]
