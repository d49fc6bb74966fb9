"""Chains deeper than 64, closed to a cycle."""

from glyphmill.operators import editing, joins

DEEP = 67


def test_deep_tree(spark):
    nodes = spark.createDataFrame([(i, i - 1 if i else None) for i in range(DEEP)], "id int, parent int")
    assert [tuple(r) for r in editing.tree_counts(nodes).collect()] == [(0, DEEP)]


def test_deep_objects(spark):
    edges = spark.createDataFrame([(i, (i + 1) % DEEP) for i in range(DEEP)], "parent int, child int")
    roots = spark.createDataFrame([(1, 0), (2, 0)], "page int, object int")
    assert joins.shared_objects(edges, roots).count() == DEEP
