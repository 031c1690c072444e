from inkweave.operators import graph as g
from inkweave.plans import graphs


def exchanges(df) -> list[str]:
    return [line for line in df._jdf.queryExecution().executedPlan().toString().splitlines() if " Exchange " in line]


def test_edges_are_told_apart_by_keys(spark, sf):
    """Keys move, not the ids that are made of them."""
    for df in (graphs.kg_edges(spark, sf), graphs._edges(spark, sf).groupBy("edge_type").count()):
        assert exchanges(df) and not any("src" in line or "dst" in line for line in exchanges(df))


def test_only_nodes_of_the_kinds_asked_for_are_read(spark, sf):
    own = graphs._nodes(spark, sf, ("ORG", "LOC"))
    assert {t for t in ("lineitem", "part", "customer") if any(f"/{t}.parquet" in f for f in own.inputFiles())} == set()
    every = graphs._nodes(spark, sf).where("node_type in ('ORG', 'LOC')")
    assert sorted(map(tuple, own.collect())) == sorted(map(tuple, every.collect()))


def test_links_of_a_stored_graph_move_once(spark, tmp_path):
    rows = [(d, ("EVENT", d), ("OBJ", d % 3), "E") for d in range(30)] * 2
    links = spark.createDataFrame(rows, "doc long, src struct<kind:string,key:bigint>, dst struct<kind:string,key:bigint>, edge_type string")
    by_doc = g._by_doc(links, 8)
    assert len(exchanges(by_doc)) == len(exchanges(g._stamps(by_doc))) == 1
    g.write_graph(links, f"{tmp_path}/g", 8)
    stored = g.stored_links(spark, f"{tmp_path}/g", end="struct<kind:string,key:bigint>")
    assert sorted((r.doc, tuple(r.src), tuple(r.dst)) for r in stored.collect()) == sorted((d, s, t) for d, s, t, _ in set(rows))
    assert g.refresh_graph(links, f"{tmp_path}/g", 8) == []
