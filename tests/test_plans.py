"""Physical plans: no Cartesian products, no nested loops, and scans that read what is used."""

import re

import pytest

from loomtrail.plans import catalogue


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - {"streamed_windows"}))
def test_no_nested_loops(spark, data_dir, name):
    p = plan(catalogue.QUERIES[name](spark, data_dir))
    assert "CartesianProduct" not in p
    assert "BroadcastNestedLoopJoin" not in p


@pytest.mark.parametrize(
    ("name", "table", "columns"),
    [
        ("profile_p95", "documents", {"text", "source"}),
        ("strict_gate_audit", "trajectories", {"dataset", "process"}),
        ("cube_totals", "lineitem", {"l_quantity", "l_returnflag", "l_linestatus"}),
        ("in_degree_band", "page_nodes", {"title", "outgoing"}),
        ("contract_tools", "trajectories", {"messages"}),
    ],
)
def test_column_pruning(spark, data_dir, name, table, columns):
    p = catalogue.QUERIES[name](spark, data_dir)._jdf.queryExecution().executedPlan().treeString()
    read = [m.group(1) for m in re.finditer(r"FileScan parquet \[([^\]]*)\]", p)]
    assert read and {re.sub(r"#\d+L?", "", c) for c in read[0].split(",")} == columns


def test_pushed_filters(spark, data_dir):
    p = catalogue.QUERIES["link_extract"](spark, data_dir)._jdf.queryExecution().executedPlan().treeString()
    assert "EqualTo(namespace,page)" in p


def test_paths_of_four_hops_by_brute_force(spark, tmp_path):
    """two_to_four_hop_paths against plain Python, on a small graph with cycles."""
    titles = ["Alder", "Birch", "Cedar", "Dogwood", "Elm", "Fir"]
    out = {t: [titles[(k + d) % 6] for d in (1, 2, 3)][: 2 + k % 2] for k, t in enumerate(titles)}
    rows = [(k, t, [(x, "near") for x in out[t]], 100 if k < 2 else 5, "x" * 300) for k, t in enumerate(titles)]
    spark.createDataFrame(rows, "page_id bigint, title string, outgoing array<struct<title:string,relation:string>>, incoming_links bigint, extract string").write.parquet(str(tmp_path / "page_nodes.parquet"))
    want, paths = {}, [[t] for t in titles[:2]]
    for hops in range(1, 5):
        paths = [[*p, x] for p in paths for x in out[p[-1]] if x not in p]
        want[hops] = (len(paths), len({p[0] for p in paths}))
    got = {r["hops"]: (r["paths"], r["starts"]) for r in catalogue.QUERIES["two_to_four_hop_paths"](spark, str(tmp_path)).collect()}
    assert got == {k: want[k] for k in (2, 3, 4)} and want[4][0] > 0


def test_paths_follow_the_first_links_of_a_hub(spark):
    """A node with 60 links: 40 are followed, by position, unless the parameter says otherwise."""
    from loomtrail.operators import graph as N

    links = spark.createDataFrame([("hub", f"t{k}", "near", k) for k in range(60)], "src string, dst string, relation string, pos int")
    starts = spark.createDataFrame([("hub",)], "title string")
    assert {r["path"][1] for r in N.paths(starts, links, 1).collect()} == {f"t{k}" for k in range(40)}
    assert N.paths(starts, links, 1, fan_out=60).count() == 60


def test_rewards_read_the_messages_once(spark, data_dir):
    p = plan(catalogue.QUERIES["reward_score"](spark, data_dir))
    assert "Generate" not in p and p.count("FileScan parquet") <= 2 and p.count("Exchange") <= 2
