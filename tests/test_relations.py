"""Recursion against a plain walk."""

from nestq.operators import relations


def test_walk_goes_beyond_a_hundred_levels(spark):
    """A chain longer than 100 rows is walked to its end."""
    links = spark.createDataFrame([(i, i + 1) for i in range(104)] + [(104, 0)], "__from long, __to long").coalesce(1)
    roots = spark.createDataFrame([(7, 0)], "__fk long, __id long").coalesce(1)
    got = {(r["__fk"], r["__id"], r["__level"]) for r in relations.walk(spark, roots, links, 0).collect()}
    assert got == {(7, k, k) for k in range(1, 105)}
