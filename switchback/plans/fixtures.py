"""The domain's tables as views over the test tables, by arithmetic that both engines share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .dialect import Spark


def views(d: Spark) -> dict[str, str]:
    part_xy = "44e0 + (p_partkey * 7919 % 2003) * 1e-3 AS lat, -120e0 + (p_partkey * 104729 % 2999) * 1e-3 AS lng"
    return {
        "points": f"""SELECT user_id AS session_id, {d.epoch("ts")} AS time, {d.idiv(d.epoch("ts"), "86400")} AS segment_number,
            -120e0 + (user_id % 50) * 2e-2 + (event_id % 97) * 3e-4 AS lng, 44e0 + (user_id % 7) * 2e-2 + (event_id % 89) * 3e-4 AS lat,
            900e0 + value * 8e0 AS elevation, (event_id % 23) / 10e0 AS speed, event_id, event_type, value FROM {d.t("events")}""",
        "destinations": f"""SELECT p_partkey AS id, p_name AS name, p_retailprice * 3e0 AS elevation, CASE WHEN p_size % 6 = 0 THEN NULL ELSE p_size * 20e0 END AS prominence,
            {part_xy}, p_type AS type, concat('S', CAST(p_size % 10 AS STRING)) AS state, CASE WHEN p_partkey % 9 = 0 THEN 'peaks' ELSE concat('u', CAST(p_partkey % 50 AS STRING)) END AS owner,
            CASE p_size % 4 WHEN 0 THEN {d.arr("'summit'")} WHEN 1 THEN {d.arr("'summit'", "'lookout'")} WHEN 2 THEN {d.arr("'lake'")} ELSE {d.arr("'waterfall'", "'viewpoint'")} END AS features,
            p_brand AS brand, p_size AS size FROM {d.t("part")}""",
        "sessions": f"""SELECT o_orderkey AS id, o_custkey AS user_id, o_orderdate AS start_time, o_totalprice AS distance, CAST(o_orderkey % 1500 AS DOUBLE) AS gain,
            CAST(1800 + o_orderkey % 20000 AS BIGINT) AS duration, o_orderstatus AS status, o_orderpriority AS priority, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE concat('trip ', CAST(o_orderkey % 100 AS STRING)) END AS name,
            o_orderkey % 3 = 0 AS is_public FROM {d.t("orders")}""",
        "session_destinations": f"""SELECT l_orderkey AS session_id, l_partkey AS destination_id, CASE WHEN min(l_returnflag) = 'N' THEN 'goal' ELSE 'reached' END AS relation,
            CASE WHEN max(l_linestatus) = 'O' THEN 'auto' ELSE 'manual' END AS source FROM {d.t("lineitem")} GROUP BY l_orderkey, l_partkey""",
        "areas": f"""SELECT n_nationkey AS id, n_name AS name, n_regionkey AS parent_id, 44e0 + (n_nationkey % 5) * 4e-1 AS south, 44e0 + (n_nationkey % 5) * 4e-1 + 5e-1 AS north,
            -120e0 + {d.idiv("n_nationkey", "5")} * 6e-1 AS west, -120e0 + {d.idiv("n_nationkey", "5")} * 6e-1 + 7e-1 AS east FROM {d.t("nation")}""",
        "routes": f"""SELECT s_suppkey AS id, s_name AS name, 44e0 + (s_suppkey * 31 % 199) * 1e-2 AS lat, -120e0 + (s_suppkey * 17 % 299) * 1e-2 AS lng, abs(s_acctbal) AS gain,
            s_acctbal * 10e0 AS distance, s_nationkey AS area_id, CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE s_suppkey % 3 END AS vehicle_rank FROM {d.t("supplier")}""",
        "route_destinations": f"""SELECT l_suppkey AS route_id, l_partkey AS destination_id, CAST(min(l_linenumber) AS BIGINT) AS ordinal FROM {d.t("lineitem")} GROUP BY l_suppkey, l_partkey""",
        "lists": f"""SELECT p_brand AS list_id, p_partkey AS destination_id, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS ordinal FROM {d.t("part")}""",
        "users": f"""SELECT c_custkey AS id, c_name AS name, c_nationkey AS area_id, c_mktsegment AS segment, c_acctbal AS balance FROM {d.t("customer")}""",
    }


def with_views(d: Spark, sql: str) -> str:
    """Put the views that a statement names in front of it."""
    import re

    all_views = views(d)
    used = [k for k in all_views if re.search(rf"\b{k}\b", sql)]
    own = re.match(r"\s*WITH\s+(RECURSIVE\s+)?", sql)
    head = ", ".join(f"{k} AS ({all_views[k]})" for k in used)
    if not used:
        return sql
    if own:
        return f"WITH {own[1] or ''}{head}, {sql[own.end():]}"
    return f"WITH {head} {sql}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.sql(views(Spark(sf_dir))[name])
