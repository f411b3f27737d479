"""Queries read whole tables, also where the given tables do not show it."""

from lodestrand import registry


def test_unknown_refs_of_all_customers(spark, tmp_path):
    customers = [(k, f"c{k:02}", "AB"[k % 2]) for k in range(1, 25)]
    spark.createDataFrame(customers, "c_custkey long, c_name string, c_mktsegment string").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame([(k, "F") for k in range(1, 25) if k not in (3, 7, 8, 20)] + [(7, "O")], "o_custkey long, o_orderstatus string").write.parquet(f"{tmp_path}/orders.parquet")
    out = registry.queries()["j11_unknown_refs"](spark, str(tmp_path)).collect()
    assert {(r.provider, r.missing) for r in out} == {("B", "c03,c07"), ("A", "c08,c20")}
