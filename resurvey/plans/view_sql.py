"""The fixture views again, in SQL, written independently of the DataFrame forms.

Used only to check results: every text here is a common table expression.
"""

CELLS = ["m1c2", "m1c4", "m2c2", "m2c3", "m3c2", "m3c4", "m4c2", "m4c3"]
_CELL_SQL = ",\n".join(
    f"CASE WHEN count(*) FILTER (l_partkey % 8 = {i}) > 0 "
    f"THEN least(count(*) FILTER (l_partkey % 8 = {i}), 3)::BIGINT END AS {c}"
    for i, c in enumerate(CELLS)
)
SIZE_CLASSES = [
    "seed5_15", "seed15_30", "seed30_50", "seed50_137", "sap0_1", "sap1_25", "sap25_5", "sap5_10",
]
_SIZE_SQL = ",\n".join(
    f"coalesce(sum(cnt) FILTER (class_no = {i}), 0)::BIGINT AS {c}" for i, c in enumerate(SIZE_CLASSES)
)
ROLE = "CASE WHEN l_linestatus = 'O' THEN 'N' ELSE 'Q' END"

VIEWS = {
    "rating": f"""
SELECT l_orderkey AS unit, {ROLE} AS role, min(l_returnflag) AS value,
       min(CASE WHEN l_linenumber = 1 THEN 1 ELSE 2 END) AS fit
FROM lineitem GROUP BY 1, 2""",
    "pair": """
SELECT l_orderkey AS unit,
       min(l_returnflag) FILTER (l_linestatus = 'O') AS value1,
       min(l_returnflag) FILTER (l_linestatus = 'F') AS value2,
       min(CASE WHEN l_linenumber = 1 THEN 1 ELSE 2 END) FILTER (l_linestatus = 'O') AS fit1,
       min(CASE WHEN l_linenumber = 1 THEN 1 ELSE 2 END) FILTER (l_linestatus = 'F') AS fit2
FROM lineitem GROUP BY 1""",
    "tree": f"""
SELECT concat(l_orderkey, '-', l_linenumber, '-', role) AS id,
       concat(l_orderkey, '-', l_linenumber, '-', CASE WHEN role = 'N' THEN 'Q' ELSE 'N' END) AS link_id,
       role, status, dbh, crown, code1, code2, level1, rater
FROM (SELECT l_orderkey, l_linenumber, {ROLE} AS role,
             max(l_quantity) AS dbh, min(l_quantity)::BIGINT % 5 AS status,
             1 + max(round(l_discount * 100)::BIGINT) FILTER (l_tax > 0) % 5 AS crown,
             min(l_returnflag) AS code1,
             CASE WHEN min(l_returnflag) <> max(l_returnflag) THEN max(l_returnflag) END AS code2,
             1 + max(l_quantity)::BIGINT % 5 AS level1, max(l_suppkey) % 7 AS rater
      FROM lineitem GROUP BY 1, 2, 3)""",
    "spec": f"""
SELECT concat(plot, '_', year) AS unit, *,
       split_part(item, ' ', 1) IN ('hot', 'cold', 'new') AS exotic,
       item IN ('hot ring', 'hot bolt', 'cold gear', 'new rod') AS priority,
       -80 - (supp % 10) / 10.0::DOUBLE AS longitude, 30 + (supp % 100) / 10.0::DOUBLE AS latitude
FROM (SELECT concat('PK', lpad((supp % 20)::VARCHAR, 2, '0')) AS park,
             concat('PK', lpad((supp % 20)::VARCHAR, 2, '0'),
                    CASE WHEN supp < 100 THEN lpad(supp::VARCHAR, 3, '0') ELSE supp::VARCHAR END) AS plot, *
      FROM (SELECT l_suppkey AS supp, year(l_shipdate) AS year, {ROLE} AS role, p_name AS item,
                   (1 + floor((max(l_quantity) - 1) / 5))::BIGINT AS cover_class,
                   {_CELL_SQL}
            FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2, 3, 4))""",
    "records": f"""
SELECT concat(l_suppkey, '_', year(l_shipdate)) AS unit, {ROLE} AS role,
       (1 + l_linenumber % 4)::BIGINT AS module, l_quantity AS qty
FROM lineitem""",
    "cnt": f"""
SELECT concat(l_suppkey, '_', year(l_shipdate)) AS unit, {ROLE} AS role,
       (1 + l_linenumber % 4)::BIGINT AS module, count(*) AS n, avg(l_quantity) AS avg_val
FROM lineitem GROUP BY 1, 2, 3""",
    "thr": """
SELECT r_name AS unit, n_name AS subunit, c_mktsegment AS bin, year(o_orderdate) AS period, o_totalprice AS y
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
     JOIN region ON n_regionkey = r_regionkey""",
    "surveys": """
SELECT DISTINCT user_id AS unit, 'N' AS role, ts::DATE AS survey_date,
       (1 + (ts::DATE - DATE '2024-01-01') // 7)::BIGINT AS cycle_no
FROM events WHERE event_type = 'view'""",
    "burns": """
SELECT DISTINCT user_id AS unit, ts::DATE AS event_date FROM events WHERE event_type = 'error'""",
    "regen_base": f"""
SELECT concat(l_suppkey, '-', year(l_shipdate)) AS event, n_name AS area, r_name AS zone,
       concat('G', lpad(n_nationkey::VARCHAR, 3, '0')) AS community,
       l_suppkey::VARCHAR AS plot, year(l_shipdate) AS year,
       ceil((year(l_shipdate) - 1994) / 5.0)::BIGINT AS cycle_no, {ROLE} AS role,
       concat('C', l_linenumber) AS corner, (1 + l_linenumber % 4)::BIGINT AS module,
       p_type IN ('ECONOMY', 'PROMO') AS target, (p_size - 1) * 8 // 50 AS class_no,
       p_size::DOUBLE AS dbh, l_quantity::BIGINT % 5 AS status, l_quantity::BIGINT AS cnt
FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
     JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "regen": f"""
SELECT event, area, zone, community, plot, year, cycle_no, role, corner, module, target,
       {_SIZE_SQL}
FROM v_regen_base GROUP BY ALL""",
    "regen_tree": """
SELECT event, area, zone, plot, year, cycle_no, role, module, target, dbh, status FROM v_regen_base""",
    "bound": """
SELECT l_suppkey AS unit, l_extendedprice AS x, l_quantity AS y, l_linenumber::BIGINT AS piece FROM lineitem""",
}
NEEDS = {"regen": ["regen_base"], "regen_tree": ["regen_base"]}


def with_views(names: str, body: str) -> str:
    """``WITH`` clause for the named views followed by ``body`` (``SELECT ...`` or ``, x AS (...) SELECT``)."""
    wanted: list[str] = []
    for name in names.split():
        for need in [*NEEDS.get(name, []), name]:
            if need not in wanted:
                wanted.append(need)
    return "WITH " + ",\n".join(f"v_{n} AS ({VIEWS[n].strip()})" for n in wanted) + "\n" + body.strip()
