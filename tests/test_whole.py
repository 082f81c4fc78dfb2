"""Queries over whole tables against brute force and small fixtures."""

import collections

from wayside.plans import QUERIES


def chains(edges, a, b):
    """(depth, number of shortest chains) from a to b, breadth first."""
    near = collections.defaultdict(set)
    for u, v in edges:
        near[u].add(v)
        near[v].add(u)
    level, seen, depth = {a: 1}, {a}, 0
    while level and b not in level:
        after = collections.Counter()
        for u, n in level.items():
            for v in near[u] - seen:
                after[v] += n
        level, depth = after, depth + 1
        seen |= set(level)
    return [(b, depth, level[b])] if level else []


def table(spark, folder, name, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")


def test_shortest_chain_takes_all_lines(spark, sf, tmp_path):
    edges = {(r.l_partkey, r.l_suppkey + 1_000_000) for r in spark.read.parquet(f"{sf}/lineitem.parquet").collect()}
    parts = [a for a, _ in edges]
    assert list(map(tuple, QUERIES["shortest_chain"](spark, sf).collect())) == chains(edges, min(parts), max(parts))
    # a line of 12 parts, each sharing a supplier with the next: 22 hops
    rows = [(k, s, 1) for k in range(12) for s in (k - 1, k) if 0 <= s < 11]
    table(spark, tmp_path, "lineitem", rows, "l_partkey long, l_suppkey long, l_linenumber int")
    assert list(map(tuple, QUERIES["shortest_chain"](spark, str(tmp_path)).collect())) == [(11, 22, 1)]


def test_overlaps_of_any_line(spark, tmp_path):
    rows = [(1, 1, 7, 5, "1992-02-01", 10), (2, 3, 8, 5, "1992-02-05", 10), (2, 3, 8, 5, "1992-02-05", 10), (3, 1, 9, 6, "1992-02-05", 10)]
    table(spark, tmp_path, "lineitem", rows, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_shipdate string, l_quantity int")
    got = sorted(map(tuple, QUERIES["bucketed_overlap_pairs"](spark, str(tmp_path)).collect()))
    assert got == [("1-1-7-1", "2-3-8-1", 6), ("1-1-7-1", "2-3-8-2", 6), ("2-3-8-1", "2-3-8-2", 10)]


def test_walks_of_all_customers(spark, tmp_path):
    table(spark, tmp_path, "customer", [(k,) for k in range(1, 12)], "c_custkey long")
    got = {r.start: (r.node, r.depth, r.how) for r in QUERIES["dead_end_walk"](spark, str(tmp_path)).collect()}
    assert got == {0: (1, 1, "fork"), 6: (3, 1, "fork"), 7: (3, 1, "fork"), 8: (4, 1, "fork"), 9: (4, 1, "fork"), 10: (5, 1, "fork"), 11: (5, 1, "fork")}


def test_any_line_covers_a_side(spark, tmp_path):
    table(spark, tmp_path, "part", [(1,)], "p_partkey long")
    table(spark, tmp_path, "lineitem", [(1, "A", 6)], "l_partkey long, l_returnflag string, l_linenumber int")
    assert sorted(r.side for r in QUERIES["placeholders"](spark, str(tmp_path)).collect()) == ["N", "R"]


def test_slots_take_the_strictest_rule_of_a_stack(spark, tmp_path):
    from wayside.plans import rules

    keys, rank = range(1, 28), {"park": 1, "stand": 2, "stop": 3}
    table(spark, tmp_path, "supplier", [(k,) for k in keys], "s_suppkey long")
    got = {(r.stack, r.slot): r.effect for r in QUERIES["slot_effect"](spark, str(tmp_path)).collect()}
    assert len(got) == len(keys) * 2016
    fields = [dict(zip(rules._N, r, strict=True)) for r in rules.RULES]
    several = 0
    for k in keys:
        own = rules._DEFAULT | dict(action=["park", "stand", "stop"][k % 3], days=k % 127 + 1, from_min=k * 7 % 1440, to_min=k * 13 % 1440, except_sunday=k % 4 == 0)
        for slot in range(2016):
            day, minute, found = slot // 288, slot % 288 * 5, []
            for r in [*(f for f in fields if f["stack"] == k % 9), own]:
                a, b = r["from_min"], r["to_min"]
                clock = a is None or (a <= minute < b if b > a else minute >= a or minute < b)
                if r["days"] >> day & 1 and not (r["except_sunday"] and day == 6) and clock and not r["permitted"] and r["vehicle"] == "all":
                    found.append(rank[r["action"]])
            several += len(set(found)) > 1
            assert got[k, slot] == max(found, default=0)
    assert several > 100


def test_degrees_where_keys_of_parts_reach_those_of_suppliers(spark, tmp_path):
    """Part 1,000,001 has the number of supplier 1: an edge there and one back are two, one to itself has two ends."""
    import duckdb

    from __spark_entry__ import oracle_sql

    from .compare import rows_of, sql_rows

    rows = [(1_000_001, 2), (1_000_002, 1), (1_000_001, 1), (1_000_001, 1), (5, 1), (5, 3), (None, 4)]
    table(spark, tmp_path, "lineitem", rows, "l_partkey long, l_suppkey long")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    got = rows_of(QUERIES["nodes_degree"](spark, str(tmp_path)))
    assert got == sql_rows(con, oracle_sql()["nodes_degree"]) == (["degree", "n_nodes"], [(1, 3), (2, 2), (5, 1)])
