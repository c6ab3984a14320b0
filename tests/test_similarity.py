"""Order of features that contribute equally."""

from pyspark.sql import functions as F

from kithmesh.operators import similarity


def test_equal_means_whatever_the_order_of_rows(spark):
    u = {"e1": 0.1, "e2": 0.2, "e3": 0.3}
    rows = [(e, "a", u[e]) for e in ("e1", "e2", "e3")] + [(e, "b", u[e]) for e in ("e3", "e2", "e1")]
    units = spark.createDataFrame(rows, "entity string, feature string, u double").coalesce(1)
    core = F.broadcast(spark.createDataFrame([(e,) for e in u], "entity string"))  # the rows keep their order
    got = {r["feature"]: r["c"] for r in similarity.centroid(units, core).collect()}
    assert got["a"] == got["b"]
    odd = units.unionByName(spark.createDataFrame([("e1", "c", float("nan"))], units.schema))
    assert {r["feature"] for r in similarity.centroid(odd, core).where("isnan(c)").collect()} == {"c"}
