"""Every tool on the derived tables of the smallest folder."""

import pytest
from pyspark.sql import functions as F

from sparklore import api
from sparklore.operators import retrieval as R
from sparklore.plans.fixtures import Tables


@pytest.fixture(scope="module")
def store(spark):
    t = Tables(spark, "/root/testdata/sf0.001")
    chunks = t["v_chunks"].cache()
    keep = lambda name: t[name].cache()
    return api.Store(keep("v_bodies"), keep("v_classes"), keep("v_calls"), keep("v_files"), keep("v_imports"), keep("v_routes"), chunks, R.embedded(chunks, "id", "chunk_text").cache(), keep("v_notes"), keep("v_runs"), keep("v_run_files"), "2024-06-01 00:00:00")


def test_every_tool_answers(store):
    name = store.calls.groupBy("callee").count().orderBy(F.desc("count"), "callee").first()["callee"]
    path = store.files.orderBy("path").first()["path"]
    note = store.notes.orderBy("id").first()
    ask = {
        ("search", "lexical"): {"query": name}, ("search", "semantic"): {"query": "src r1"}, ("search", "hybrid"): {"query": name}, ("search", "similar"): {"id": 1},
        ("symbol", "get"): {"name": name}, ("symbol", "definitions"): {"name": name}, ("symbol", "references"): {"name": name}, ("symbol", "implementations"): {"name": "Brand11"}, ("symbol", "brief"): {"name": name},
        ("graph", "callers"): {"name": name}, ("graph", "callees"): {"name": name}, ("graph", "chain"): {"start": name, "goal": name}, ("graph", "tests"): {"name": name}, ("graph", "tests_of_file"): {"path": path}, ("graph", "dependencies"): {"path": path}, ("graph", "impact"): {"path": path},
        ("map", "overview"): {}, ("map", "hotspots"): {}, ("file", "outline"): {"path": path}, ("file", "list"): {}, ("grep", ""): {"pattern": "fn [a-z]+"}, ("audit", "dead_code"): {}, ("audit", "unreachable"): {},
        ("verify", "recent"): {"project": "p1"}, ("verify", "last_green"): {}, ("check_exists", ""): {"query": name}, ("recall", ""): {"project": note["project"], "query": "the"},
        ("memory", "search"): {"project": note["project"], "query": "the"}, ("memory", "list"): {"project": note["project"]}, ("memory", "get"): {"id": note["id"]}, ("memory", "resolve"): {"project": note["project"], "ids": [note["id"]]}, ("memory", "curate"): {},
        ("session", "start"): {"project": note["project"]}, ("session", "end"): {"project": note["project"], "completed": ["the end"]}, ("developer", "rules"): {"project": note["project"]},
    }
    assert set(ask) == set(api.TOOLS)
    rows = {key: api.call(store, *key, **arguments).count() for key, arguments in ask.items()}
    empty = {key for key, n in rows.items() if not n}
    assert empty <= {("symbol", "implementations"), ("symbol", "brief"), ("graph", "callees"), ("graph", "tests"), ("graph", "dependencies"), ("graph", "impact"), ("audit", "dead_code"), ("audit", "unreachable"), ("memory", "search"), ("session", "end"), ("developer", "rules"), ("memory", "curate")}, empty
    assert api.call(store, "memory", "resolve", project=note["project"], ids=[note["id"]]).filter(F.col("id") == note["id"]).first()["status"] == "resolved"


def test_wrong_calls_are_errors(store):
    for name, op, arguments in (("nothing", "", {}), ("graph", "nothing", {}), ("grep", "", {}), ("grep", "", {"pattern": "x", "other": 1}), ("grep", "", {"pattern": "x", "limit": 0}), ("graph", "callers", {"name": "x", "certainty": "sure"}), ("memory", "resolve", {"project": "no", "ids": [store.notes.first()["id"]]}), ("memory", "resolve", {"project": "no", "ids": ["mem_none"]})):
        with pytest.raises(ValueError):
            api.call(store, name, op, **arguments)
