"""Merging nested documents and building those of children."""

import json

import pytest
from pyspark.sql import functions as F

from musterroll.functions.documents import Value, merged
from musterroll.operators import children, sets, validate
from musterroll.plans.roles import WORDS


def as_json(column):
    return F.to_json(F.struct(column.alias("v")))


LOWER = "a INT, s STRUCT<x: INT, only: STRING, m: MAP<STRING, STRING>>, env ARRAY<STRUCT<name: STRING, value: STRING>>, tags ARRAY<STRING>"
UPPER = "a INT, s STRUCT<x: INT, m: MAP<STRING, STRING>, more: INT>, env ARRAY<STRUCT<name: STRING, from: STRING>>, tags ARRAY<STRING>"


@pytest.mark.parametrize("whole", [(), ("env",)])
def test_documents_merge_by_their_schema(spark, whole):
    low = [(1, (1, "o", {"k": "l", "j": "l"}), [("A", "1"), ("B", "2")], ["x"]), (None, None, None, None), (2, (3, None, None), [], None)]
    high = [(None, (None, {"k": "u"}, 5), [("C", "f"), ("A", "g")], ["y"]), (7, None, None, None), (None, None, [("Z", None)], [])]
    rows = [(i, a, b) for i, (a, b) in enumerate(zip(low, high, strict=True))]
    df = spark.createDataFrame(rows, f"id INT, low STRUCT<{LOWER.replace(' ', ': ', 1).replace(', s ', ', s: ').replace(', env ', ', env: ').replace(', tags ', ', tags: ')}>, "
                                     f"high STRUCT<{UPPER.replace(' ', ': ', 1).replace(', s ', ', s: ').replace(', env ', ', env: ').replace(', tags ', ', tags: ')}>")
    both = merged(Value.of(df, "low"), Value.of(df, "high"), whole)
    found = [json.loads(r[0])["v"] for r in df.orderBy("id").select(as_json(both.column)).collect()]
    of_a = {"name": "A", "from": "g"} if whole else {"name": "A", "value": "1", "from": "g"}
    assert found[0] == {
        "a": 1, "s": {"x": 1, "only": "o", "m": {"k": "u", "j": "l"}, "more": 5},
        "env": [{"name": "C", "from": "f"}, of_a, {"name": "B", "value": "2"}], "tags": ["y"],
    }
    assert found[1] == {"a": 7}
    assert found[2] == {"a": 2, "s": {"x": 3}, "env": [{"name": "Z"}], "tags": []}
    assert df.select(both.column.alias("v")).schema["v"].dataType == both.kind


def cluster_rows(spark, **changed):
    env = [{"name": "WORKER_NAME", "valueFrom": {"key": "k"}}, {"name": "X", "value": "1"}]
    doc = {
        "apiVersion": "v", "kind": "Cluster",
        "metadata": {"name": "foo", "labels": {"a": "own", "fleet.example/cluster-name": "bar"},
                     "annotations": {"kopf.zalando.org/x": "1", "kept": "2"}},
        "spec": {"cluster": "foo", "worker": {"metadata": {"labels": {"a": "part"}}, "spec": {"containers": [
            {"name": "w", "env": env}, {"name": "sidecar"}], "hostNetwork": True}}},
    }
    text = json.dumps(doc | changed)
    schema = spark.range(1).select(F.schema_of_json(F.lit(json.dumps(doc)))).first()[0]
    return spark.createDataFrame([(1, "ns", "id7", {"a": "cluster", "zone": "z"}, text)],
                                 "row INT, namespace STRING, worker_id STRING, cluster_labels MAP<STRING, STRING>, text STRING").select(
        "row", "namespace", "worker_id", "cluster_labels",
        F.from_json("text", schema.replace("labels: STRUCT<a: STRING>", "labels: MAP<STRING, STRING>").replace(
            "labels: STRUCT<a: STRING, `fleet.example/cluster-name`: STRING>", "labels: MAP<STRING, STRING>").replace(
            "annotations: STRUCT<kept: STRING, `kopf.zalando.org/x`: STRING>", "annotations: MAP<STRING, STRING>")).alias("document"))


def test_worker_documents_are_whole(spark):
    rows = children.worker_children(cluster_rows(spark), WORDS, cluster_labels="cluster_labels")
    assert rows.columns == ["row", "namespace", "worker_id", "cluster_labels", "kind", "child", "manifest"]
    made = json.loads(rows.first().manifest)
    labels = {"a": "part", "zone": "z", "fleet.example/cluster-name": "foo", "fleet.example/workergroup-name": "foo",
              "fleet.example/component": "worker", "sidecar.istio.io/inject": "false"}
    meta = {"name": "foo-worker-id7", "namespace": "ns", "labels": labels, "annotations": {"kept": "2"}}
    name, address = {"name": "WORKER_NAME", "value": "foo-worker-id7"}, {
        "name": "SCHEDULER_ADDRESS", "value": "tcp://foo-scheduler.ns.svc.cluster.local:8786"}
    assert made == {
        "apiVersion": "apps/v1", "kind": "Deployment", "metadata": meta,
        "spec": {"replicas": 1, "selector": {"matchLabels": labels}, "template": {"metadata": meta, "spec": {
            "hostNetwork": True, "containers": [
                {"name": "w", "env": [{"name": "WORKER_NAME", "valueFrom": {"key": "k"}}, {"name": "X", "value": "1"}, address]},
                {"name": "sidecar", "env": [name, address]},
            ]}}},
    }


def test_children_without_some_parts(spark):
    rows = children.cluster_children(cluster_rows(spark), WORDS).collect()
    made = {r.kind: json.loads(r.manifest) for r in rows}
    assert list(made) == ["Deployment", "Service", "WorkerGroup"]
    assert made["Deployment"]["metadata"]["labels"] == {
        "a": "own", "fleet.example/cluster-name": "foo", "fleet.example/component": "scheduler", "sidecar.istio.io/inject": "false"}
    assert "spec" not in made["Deployment"]["spec"]["template"] and "spec" not in made["Service"]
    assert "sidecar.istio.io/inject" not in made["Service"]["metadata"]["labels"]
    assert made["WorkerGroup"]["spec"]["worker"]["spec"]["hostNetwork"] is True
    assert made["WorkerGroup"]["metadata"]["labels"]["a"] == "part"
    empty = cluster_rows(spark, metadata={"name": "foo"}, spec={})
    group = next(json.loads(r.manifest) for r in children.cluster_children(empty, WORDS).collect() if r.kind == "WorkerGroup")
    assert group["spec"] == {"cluster": "foo"} and group["metadata"]["annotations"] == {}


def test_drift_by_path(spark):
    kind = "d STRUCT<a: INT, m: MAP<STRING, STRING>, l: ARRAY<STRUCT<name: STRING, v: INT>>, n: ARRAY<INT>>"
    left = spark.createDataFrame([
        (1, (1, {"x": "1", "y": "2"}, [("p", 1), ("q", 2)], [1, 2])), (2, (None, None, None, None)), (3, (5, None, [], None)), (None, (1, None, None, None)),
        (5, (1, {}, [("p", 1), ("p", 2), (None, 3)], None)), (6, None),
    ], f"k INT, {kind}")
    right = spark.createDataFrame([
        (1, (1, {"y": "3", "z": "4"}, [("q", 2), ("p", 7)], [1])), (2, (None, {}, None, None)), (4, (9, None, None, None)), (None, (2, None, None, None)),
        (5, (1, None, [("p", 1), ("p", 4), (None, 3)], None)), (6, None),
    ], f"k INT, {kind}")
    found = sorted((tuple(r) for r in sets.drift_paths(left, right, ["k"], ["d"]).collect()), key=repr)
    assert found == sorted([
        (1, "d.m[x]", "1", None), (1, "d.m[y]", "2", "3"), (1, "d.m[z]", None, "4"), (1, "d.l[p].v", "1", "7"), (1, "d.n", "[1,2]", "[1]"),
        (3, "d.a", "5", None), (4, "d.a", None, "9"), (None, "d.a", "1", "2"), (5, "d.l[#1].v", "2", "4"),
    ], key=repr)


def test_documents_against_their_schemas(spark):
    schema = {"type": "object", "required": ["a", "l"], "properties": {
        "a": {"type": "integer", "minimum": 1}, "s": {"type": "string", "enum": ["x", "y"]}, "b": {"type": "boolean"},
        "m": {"type": "object", "additionalProperties": {"type": "string"}}, "free": {"type": "object"},
        "l": {"type": "array", "items": {"type": "object", "required": ["name"], "properties": {"name": {"type": "string"}}}}}}
    rows = [
        (1, "k", '{"a": 3, "l": [{"name": "n"}], "s": "x", "b": true, "m": {"p": "q"}, "free": {"any": [1]}}'),
        (2, "k", '{"a": 0, "l": [{"name": 1}, {"nome": "n"}, 5], "s": "z", "b": 1, "m": {"p": 1}, "more": null}'),
        (3, "k", '{"a": null, "l": {}}'), (4, "k", "[]"), (5, "k", "{"), (6, "k", None), (7, "other", "{}"), (8, "k", '{"a": 1.5, "l": []}'),
        (9, None, "{}"), (10, "k", ""),
    ]
    df = spark.createDataFrame(rows, "id INT, kind STRING, body STRING")
    found = sorted(tuple(r) for r in validate.check_documents(df, ["id"], "body", F.col("kind"), {"k": schema}).drop("kind").collect())
    assert found == sorted([
        (2, "a", "too small"), (2, "l[0].name", "not of type string"), (2, "l[1].name", "missing"), (2, "l[1].nome", "unknown"),
        (2, "l[2]", "not an object"), (2, "s", "not one of the values"), (2, "b", "not of type boolean"), (2, "m[p]", "not of type string"),
        (2, "more", "unknown"), (3, "a", "missing"), (3, "l", "not an array"), (4, "", "not an object"), (5, "", "not JSON"),
        (8, "a", "not of type integer"), (10, "", "not JSON"),
    ])
