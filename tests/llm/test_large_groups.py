"""Connected components and SimHash groups on long chains and large groups."""

from docketry.llm.graph import connected_components


def test_chain_and_star(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(300)] + [(5000, 5000), (None, 3), (7, None)]
    roots = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert roots == {**dict.fromkeys(range(1, 201), 0), **dict.fromkeys(range(1001, 1300), 1000)}
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0
