import json
import random

import numpy as np
from pyspark.sql import functions as F

from inkweave.operators import graph as g
from inkweave.operators import relational as rel
from inkweave.session import cut_lineage


def links_of(spark, rows):
    return spark.createDataFrame([(d, f"s{d}", t, "E") for d, t in rows], "doc long, src string, dst string, edge_type string")


def test_a_refreshed_graph_is_one_built_anew(spark, tmp_path):
    path = f"{tmp_path}/g"
    before = [(d, f"t{d % 5}") for d in range(40)] + [(3, "more"), (3, "more")]
    after = [(d, f"t{d % 5}") for d in range(40) if d not in (7, 8)] + [(3, "other"), (100, "new")]
    g.write_graph(links_of(spark, before), path, 16)
    files = lambda: {p: f.stat().st_mtime_ns for f in (tmp_path / "g" / "links").rglob("*.parquet") for p in [str(f)]}
    assert g.refresh_graph(links_of(spark, before), path, 16) == []
    old = files()
    touched = g.refresh_graph(links_of(spark, after), path, 16)
    got = sorted(map(tuple, g.stored_edges(spark, path).select("src", "dst").collect()))
    assert got == sorted({(f"s{d}", t) for d, t in after})
    part = {r["doc"]: r["part"] for r in g._by_doc(links_of(spark, before + after), 16).collect()}
    assert set(touched) == {part[d] for d in (3, 7, 8, 100)} and len(touched) < 16
    kept = [p for p in old if not any(f"part={k}/" in p for k in touched)]
    assert kept and all(files()[p] == old[p] for p in kept)
    assert g.refresh_graph(links_of(spark, after), path, 16) == []
    gone = [r for r in after if part[r[0]] != part[100]]
    g.refresh_graph(links_of(spark, gone), path, 16)
    assert sorted(map(tuple, g.stored_edges(spark, path).select("src", "dst").collect())) == sorted({(f"s{d}", t) for d, t in gone})
    assert not list((tmp_path / "g" / "links").glob(f"part={part[100]}"))
    g.refresh_graph(links_of(spark, after).limit(0), path, 16)
    assert g.stored_edges(spark, path).count() == 0


def test_bundles_of_three_shapes_and_broken_ones(spark):
    rows = [
        ("a", json.dumps({"nodes": [{"node_id": "n1", "label": "One", "type": "org", "aliases": ["uno", "I"]}, {"node_id": "n2"}, {"label": "no id"}], "edges": [{"edge_id": "e1", "source": "n1", "target": "n2"}, {"source": "n1", "target": "n1"}, {"from": "n2", "to": "n1", "type": "T"}]})),
        ("b", json.dumps({"entities": [{"id": "x", "title": "X"}, {"id": "x", "title": "X"}], "relations": [], "timeline": {"events": [{"event_id": 7, "name": "fair"}]}})),
        ("c", json.dumps({"artifacts": {"nodes.json": [{"id": "q"}], "edges.json": [{"id": "e", "subject_id": "q", "object_id": "z"}]}, "timeline": [{"id": "t"}]})),
        ("d", "not json"), ("e", "[]"), ("f", None), ("g", '{"nodes": "text", "edges": 3}'),
    ]
    df = g.bundle_rows(spark.createDataFrame(rows, "source string, json string"))
    got = {(r["kind"], r["ref"], r["type"], r["label"], r["src"], r["dst"]) for r in df.collect()}
    assert got == {
        ("node", "ext:a:n1", "ORG", "One", None, None), ("node", "ext:a:n2", "OBJ", "n2", None, None), ("edge", "ext:a:e1", "RELATED", "RELATED", "ext:a:n1", "ext:a:n2"), ("edge", "ext:a:n2/T/n1", "T", "T", "ext:a:n2", "ext:a:n1"),
        ("node", "ext:b:x", "OBJ", "X", None, None), ("event", "ext:b:7", "EVENT", "fair", None, None), ("node", "ext:c:q", "OBJ", "q", None, None), ("edge", "ext:c:e", "RELATED", "RELATED", "ext:c:q", "ext:c:z"), ("event", "ext:c:t", "EVENT", "t", None, None),
    }
    terms = sorted((r["place"], r["term"]) for r in g.bridge_terms(df).where("ref = 'ext:a:n2'").collect())
    assert terms == [(1, "n2"), (2, "related"), (3, "one"), (4, "uno"), (5, "i"), (6, "t")]
    assert g.bridge_terms(df, 2).where("ref = 'ext:a:n2'").count() == 2
    assert g.bundle_rows(spark.createDataFrame([], "source string, json string")).count() == 0


def test_percentiles_in_passes(spark, monkeypatch):
    monkeypatch.setattr(rel, "BINS", 4)
    monkeypatch.setattr(rel, "ORDERED", 5)
    r = random.Random(3)
    groups = {"even": [5.0] * 300, "wide": [r.lognormvariate(0, 6) for _ in range(400)], "one": [2.5], "two": [1.0, -1e300], "few": [float(r.randrange(4)) for _ in range(200)], None: [r.random() for _ in range(50)]}
    rows = [(k, v) for k, vs in groups.items() for v in vs] + [("one", None), ("one", float("nan")), ("empty", None)]
    df = cut_lineage(spark.createDataFrame(rows, "k string, v double").repartition(3))
    shares = {"p0": 0.0, "p50": 0.5, "p95": 0.95, "p99": 0.99, "p100": 1.0}
    got = {x["k"]: [x[c] for c in shares] for x in rel.percentiles(df, ["k"], "v", shares).collect()}
    assert got.keys() == groups.keys()
    for k, vs in groups.items():
        assert np.allclose(got[k], np.quantile(vs, list(shares.values())), rtol=1e-12)
    whole = rel.percentiles(df.where("k = 'wide'").select("v"), [], "v", {"m": 0.5}).collect()
    assert np.isclose(whole[0]["m"], np.quantile(groups["wide"], 0.5))
    assert rel.percentiles(df.limit(0), ["k"], "v", shares).count() == 0
    assert df.select(F.count("v")).first()[0] == sum(map(len, groups.values())) + 1


def test_checksums_of_large_groups_are_trees(spark, monkeypatch):
    from hashlib import sha256

    monkeypatch.setattr(rel, "FAN", 4)
    rows = [(k, i, f"{k}{i}") for k, n in (("a", 70), ("b", 3), ("c", 17)) for i in range(n) if i % 5 != 2] + [("d", 9, None), ("e", 64, "x")]
    got = dict(map(tuple, rel.content_checksum(spark.createDataFrame(rows, "k string, i long, l string").repartition(7), "k", F.col("l"), "i").collect()))

    def tree(lines):
        for _ in range(4):  # 70 numbers are one block after four levels
            blocks = {}
            for i, x in sorted(lines.items()):
                blocks.setdefault(i // 4, []).append(x)
            lines = {b: sha256("\n".join(xs).encode()).hexdigest() for b, xs in blocks.items()}
        return "sha256:" + lines[0]

    assert got == {k: tree({i: x for kk, i, x in rows if kk == k}) for k in "abce"}
    parts = rel.listed_by_parts(spark.createDataFrame([("a", v) for v in (5, 1, 9, 9, 17)] + [("b", None)], "k string, v long"), "k", "v", 8).collect()
    assert {(r["part"], r["n"], tuple(r["values"])) for r in parts} == {(0, 2, (1, 5)), (1, 1, (9,)), (2, 1, (17,))}
