"""DuckDB SQL of the domain views, for the queries' oracles."""

from __future__ import annotations

VIEWS = {
    "courts": "SELECT n_nationkey AS id, n_name AS county, r_name AS state FROM nation JOIN region ON n_regionkey = r_regionkey",
    "judges": "SELECT s_suppkey AS id, s_name AS canonical_name, s_nationkey AS court_id FROM supplier",
    "cases": (
        "SELECT o_orderkey AS id, o_orderpriority AS case_type, o_orderstatus AS case_status, o_orderdate AS created_at, "
        "c_nationkey AS court_id, o_custkey AS party_id FROM orders JOIN customer ON o_custkey = c_custkey"
    ),
    "rulings": (
        "SELECT l_orderkey AS case_id, l_suppkey AS judge_id, CAST(l_shipdate AS DATE) AS hearing_date, p_type AS motion_type, "
        "CASE l_returnflag || l_linestatus WHEN 'AF' THEN 'granted' WHEN 'AO' THEN 'denied' WHEN 'NF' THEN 'granted_in_part' "
        "WHEN 'NO' THEN 'denied_in_part' WHEN 'RF' THEN 'moot' END AS outcome, "
        "lpad(CAST(l_linenumber AS VARCHAR), 9, '0') || '-' || lpad(CAST(l_partkey AS VARCHAR), 9, '0') || '-' || lpad(CAST(l_suppkey AS VARCHAR), 9, '0') AS seq "
        "FROM lineitem JOIN part ON l_partkey = p_partkey"
    ),
    "parties": "SELECT c_custkey AS id, c_name AS name, c_mktsegment AS party_type FROM customer",
}


def over(*views: str, query: str, more: str = "") -> str:
    """``query`` with the named views in front."""
    parts = [f"{v} AS ({VIEWS[v]})" for v in views] + ([more] if more else [])
    return (f"WITH {', '.join(parts)} " if parts else "") + query


def first_match(text: str, patterns: list[tuple[str, str]]) -> str:
    """An ordered-pattern CASE."""
    whens = " ".join(f"WHEN regexp_matches({text}, '{p.replace(chr(39), chr(39) * 2)}', 'i') THEN '{v}'" for p, v in patterns)
    return f"CASE {whens} END"
