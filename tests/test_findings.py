"""Small tables on which queries once were too slow at size or differed from their SQL."""

from __future__ import annotations

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from corvane.operators import graph, sample, tensor
from corvane.plans import catalogue


def against_sql(spark, folder, name: str, **tables: list[dict]) -> tuple[list, list]:
    """Rows of a query over small tables and of its SQL, with every value as text."""
    con = duckdb.connect()
    for t, rows in tables.items():
        path = f"{folder}/{t}.parquet"
        pq.write_table(pa.Table.from_pylist(rows), path)
        con.execute(f"create view {t} as select * from '{path}'")
    ours = catalogue.queries()[name](spark, str(folder))
    columns = ", ".join(f'"{c}"::VARCHAR' for c in ours.columns)
    ours.write.parquet(f"{folder}/{name}")
    read = lambda what: sorted(con.execute(f"select {columns} from {what}").fetchall(), key=repr)
    return read(f"'{folder}/{name}/*.parquet'"), read(f"({catalogue.oracle_sql()[name]})")


def line(order: int, **given) -> dict:
    return {"l_orderkey": order, "l_partkey": 1, "l_suppkey": 9, "l_linenumber": 1, "l_quantity": 10.0, "l_extendedprice": 1000.0, "l_discount": 0.05, "l_tax": 0.04, "l_returnflag": "A", "l_linestatus": "F"} | given


def order(key: int, **given) -> dict:
    return {"o_orderkey": key, "o_custkey": 7, "o_orderstatus": "O", "o_totalprice": 200000.0} | given


def test_cells_compute_only_kinds_asked_for(spark):
    rows = spark.range(2).select(F.lit(1).alias("c"), F.col("id").alias("index"), F.when(F.col("id") == 0, "a").otherwise("b").alias("kind"), *[F.lit(x).alias(n) for n, x in (("pt", 1.0), ("eta", 0.0), ("phi", 0.0), ("tau_pt", 20.0), ("tau_eta", 0.0), ("tau_phi", 0.0))], F.struct(F.lit(2.0).alias("v")).alias("object"))
    of = lambda k, x, inner: F.array(x["v"].cast("float")) if k == "a" else F.raise_error(F.lit("not asked for")).cast("array<float>")
    found = tensor.cell_vectors(rows, ["c"], "index", of, lambda inner: F.array(F.lit(1.0).cast("float")), ["a", "b"], remove_inner=True)
    assert [tuple(r) for r in found.select("c", "inner", "cell", "a", "kinds").collect()] == [(1, True, 60, [2.0], 2)]


def test_rounded_to_minus_zero_in_cells(spark, tmp_path):
    rows = {"lineitem": [line(1, l_discount=0.05), line(2, l_discount=0.05, l_suppkey=10)], "orders": [order(k, o_totalprice=round(0.05 * 1.0171359713 * 3 * 997331.17 + 10, 2)) for k in (1, 2)]}
    ours, theirs = against_sql(spark, tmp_path, "cell_vectors", **rows)
    assert ours == theirs and "-0.0" in str(ours)


def test_rounded_to_minus_zero_in_data_sets(spark, tmp_path):
    rows = {"lineitem": [line(1, l_discount=0.05)], "orders": [order(1, o_totalprice=round(0.05 * 1.0171359713 * 3 * 997331.17 + 0.2, 2))]}
    ours, theirs = against_sql(spark, tmp_path, "dataset_features", **rows)
    assert ours == theirs and "-0.0" in str(ours)


def test_differences_at_the_limit_of_a_theta_join(spark, tmp_path):
    balances = [(k, c + step) for k, c in enumerate(range(-99987, -99487, 7)) for step in (-50000, 50000)]
    rows = {"supplier": [{"s_suppkey": k, "s_nationkey": k, "s_acctbal": (c - (50000 if k % 2 else -50000)) / 100} for k, c in balances], "customer": [{"c_custkey": n, "c_nationkey": k, "c_acctbal": c / 100} for n, (k, c) in enumerate(balances)]}
    ours, theirs = against_sql(spark, tmp_path, "join_theta", **rows)
    assert ours == theirs and ours


def test_sums_of_targets_hang_on_no_order(spark, tmp_path):
    prices = [94869.08, 98482.03, 100774.57, 97210.55, 102117.23, 97408.69, 71512.84]  # 662374.99 in all, 662374.9899999999 in this order
    pq.write_table(pa.Table.from_pylist([line(1, l_extendedprice=p) for p in prices] + [line(2, l_extendedprice=float("nan")), line(2)]), f"{tmp_path}/lineitem.parquet")
    found = {r["l_orderkey"]: r["y"] for r in catalogue.queries()["regression_targets"](spark, str(tmp_path)).collect()}
    assert found[1][3] == 438740.627378 and str(found[2][3]) == "nan"


def test_draws_and_rows_are_numbered_alike_in_parts_of_any_size(spark, monkeypatch):
    rows = spark.range(300).select("id", F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("s"))
    mixed = lambda: sorted(map(tuple, sample.mixed(rows, F.col("s"), [F.col("id")], 5).select("step", "source", "id").collect()))
    whole = mixed()
    monkeypatch.setattr(sample, "STEPS", 16)
    monkeypatch.setattr(sample, "ROWS", 10)
    assert whole == mixed() and [r[0] for r in whole] == list(range(len(whole)))
    plan = sample.drawn(spark, [("a", 100), ("b", 200)], 5)._jdf.queryExecution().optimizedPlan().toString()
    assert "isnotnull(source" not in plan and "RepartitionByExpression" not in plan


def test_dense_blocks_hold_what_their_cells_hold(spark):
    cells = spark.sql("select 1 as c, true as inner, 60 as cell, array(2F, 3F) as v union all select 1, true, 0, null")
    block = tensor.dense(cells, ["c"], {"v": 2}).first()["v"]
    assert len(block) == 242 and block[120:122] == [2.0, 3.0] and sum(block) == 5.0


def test_a_tag_of_two_entries_is_no_further_lepton(spark, tmp_path):
    tag = {"l_partkey": 1, "l_suppkey": 1, "l_quantity": 40.0, "l_discount": 0.05, "l_tax": 0.04}
    pairs = [line(k, l_returnflag=f, l_suppkey=s, **{n: v for n, v in tag.items() if n != "l_suppkey"}) for k, f in ((1, "A"), (2, "R")) for s in (1, 14)]
    probes = [line(k, l_partkey=9, l_suppkey=2, l_linenumber=5, l_returnflag="N", l_tax=0.0, l_discount=0.04) for k in (1, 2)]
    rows = {"lineitem": pairs + probes, "orders": [order(k) for k in (1, 2)]}
    ours, theirs = against_sql(spark, tmp_path, "selector_tag_and_probe", **rows)
    assert ours == theirs and {r[3] for r in ours} == {"muon", "electron"}


def test_lines_are_dealt_by_event_before_structs_are_made(spark, sf):
    plan = catalogue.queries()["selector_mu_tau"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.index("Join Inner") :]
    assert plan.count("collect_list(") == below.count("collect_list(") == 1 and "has_tau" not in below and "l_partkey % " not in below


def test_components_sort_and_group_no_links(spark, monkeypatch):
    plans, written = [], graph.shared.written
    monkeypatch.setattr(graph.shared, "written", lambda df, name: plans.append((name, df._jdf.queryExecution().optimizedPlan().toString())) or written(df, name))
    links = spark.createDataFrame([(1, 2), (2, 1), (1, 2), (2, 3), (7, 7), (9, 8), (8, 5)], "a long, b long")
    assert {r.node: r.label for r in graph.components(links).collect()} == {1: 1, 2: 1, 3: 1, 7: 7, 9: 5, 8: 5, 5: 5}
    assert plans[0][0] == "edges" and "Aggregate" not in plans[0][1]
    assert all(p.count("rightHint=(strategy=shuffle_hash)") == 2 for _, p in plans[2:]) and len(plans) > 2


def test_cells_sort_their_lines_once(spark, sf):
    plan = catalogue.queries()["cell_features"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Sort [") == 1 and plan.count("Window [") == 1 and "SortMergeJoin" not in plan and "BroadcastExchange" not in plan


def test_filters_on_what_is_selected_repeat_no_selection(spark, sf):
    for name in ("selector_tag_and_probe", "selector_mu_tau", "selector_tau_jet_tag"):
        plan = catalogue.queries()[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
        filters = [step for step in plan.splitlines() if step.lstrip(" +-:").startswith("Filter ")]
        assert filters and all(step.count("lambdafunction(") < 3 for step in filters)
