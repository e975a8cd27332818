import numpy as np

from gridspark.plans import catalog

SF = "/root/testdata/sf0.001"


def test_all_orders_against_brute_force(spark):
    lines = spark.read.parquet(f"{SF}/lineitem.parquet").select("l_orderkey", "l_quantity", "l_extendedprice").toPandas().astype({"l_quantity": float, "l_extendedprice": float})
    want = {}
    for order, own in lines.groupby("l_orderkey"):
        y = own.groupby("l_quantity")["l_extendedprice"].mean()
        want |= {(order, t): v for t, v in zip((5.0, 20.5, 40.0), np.interp([5.0, 20.5, 40.0], y.index, y.values), strict=True)}
    got = {(r.l_orderkey, r.t): r.y for r in catalog.queries()["interp_columns_all"](spark, SF).collect()}
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-5 for k in want)
