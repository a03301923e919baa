"""The second assessment of `recheck` on rows built here."""

from datetime import datetime

from gigsift.plans import order_queries


def test_recheck_reads_its_tables_once(spark, tmp_path, capsys):
    """Both verdicts come from one pass: the joined sides are written rows, not two plans over the tables."""
    orders = [(k, k % 5, "OPF"[k % 3], 1000.0 * k + 40000, datetime(1995, 1, 1), f"{k % 5 + 1}-X") for k in range(30)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string"
                          ).write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(k, 1) for k in range(30)], "l_orderkey long, l_linenumber int").write.parquet(f"{tmp_path}/lineitem.parquet")
    found = order_queries.QUERIES["recheck"](spark, str(tmp_path))
    capsys.readouterr()
    found.explain()
    assert "lineitem.parquet" not in capsys.readouterr().out
    rows = found.collect()
    assert sorted(r.row_id for r in rows) == list(range(30)) and {r.window_later for r in rows} == {"in", "out"}
