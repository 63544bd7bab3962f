"""Registry of queries and the SQL each one must equal, with the views they share."""

from __future__ import annotations

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

VIEWS = {
    "experiments": """SELECT o_orderkey AS exp_code, o_orderkey AS exp_seq, o_orderstatus AS dataset_code,
        o_custkey AS cust, o_totalprice AS total, o_orderpriority AS priority FROM orders""",
    "cells": """SELECT l_orderkey AS exp_code, CAST(l_linenumber - 1 AS INTEGER) AS layer,
        sum(l_quantity) AS quantity, round(sum(l_extendedprice), 2) AS price, max(l_discount) AS discount
        FROM lineitem GROUP BY 1, 2""",
    "sized": """SELECT o_orderkey AS exp_code, o_orderkey AS exp_seq, o_orderstatus AS dataset_code,
        o_custkey AS cust, o_totalprice AS total, o_orderpriority AS priority,
        CAST(coalesce(n, 0) AS INTEGER) AS n_layers
        FROM orders LEFT JOIN (SELECT l_orderkey, max(l_linenumber) AS n FROM lineitem GROUP BY 1) s
        ON s.l_orderkey = o_orderkey""",
    "grid": """SELECT s.*, CAST(u.i AS INTEGER) AS layer, CAST(u.i AS BIGINT) AS cell_idx
        FROM sized s, unnest(range(s.n_layers)) AS u(i)""",
    "users": """SELECT user_id AS exp_code, CAST(max(day(ts)) AS INTEGER) AS n_days, 24 AS n_hours
        FROM events GROUP BY 1""",
    "ucells": """SELECT user_id AS exp_code, CAST(day(ts) - 1 AS INTEGER) AS day, CAST(hour(ts) AS INTEGER) AS hour,
        round(sum(value), 2) AS value, count(*) AS n FROM events GROUP BY 1, 2, 3""",
    "ugrid": """SELECT exp_code, n_days, n_hours, CAST(d.i AS INTEGER) AS day, CAST(h.i AS INTEGER) AS hour,
        CAST(d.i * n_hours + h.i AS BIGINT) AS cell_idx
        FROM users, unnest(range(n_days)) AS d(i), unnest(range(24)) AS h(i)""",
    "ups": """SELECT user_id AS exp_code, event_id AS seq, event_type AS param, value,
        CASE WHEN k < 27 THEN 'n_days' WHEN k < 54 THEN 'hour' END AS iterator_code,
        CAST(CASE WHEN k < 27 THEN day(ts) - 1 WHEN k < 54 THEN hour(ts) END AS INTEGER) AS step_index
        FROM (SELECT *, second(ts) AS k FROM events)""",
    "scores": """SELECT exp_code, layer, greatest(0, least(1, 1 - abs(quantity - 25) / 25)) AS s_quantity,
        greatest(0, least(1, 1 - abs(price - 40000) / 40000)) AS s_price,
        greatest(0, least(1, 1 - abs(discount - 0.05) / 0.05)) AS s_discount FROM cells""",
    "kernels": """SELECT vec_id AS kernel_id, label AS model, 1.0::DOUBLE AS w,
        (v0 - min(v0) OVER ()) / (max(v0) OVER () - min(v0) OVER ()) AS z0,
        (v1 - min(v1) OVER ()) / (max(v1) OVER () - min(v1) OVER ()) AS z1
        FROM (SELECT vec_id, label, CAST(embedding[1] AS DOUBLE) AS v0, CAST(embedding[2] AS DOUBLE) AS v1
              FROM embeddings)""",
    "cand": """SELECT s_suppkey AS cand_id, (s_acctbal + 1000.0) / 11000.0 AS z0, s_nationkey / 24.0 AS z1
        FROM supplier""",
}
NEEDS = {"grid": ["sized"], "ugrid": ["users"], "scores": ["cells"]}


def sql(body: str, *views: str, extra: dict[str, str] | None = None) -> str:
    """``body`` with the named shared views (and ``extra`` ones) in front of it."""
    order: list[str] = []
    for v in views:
        for n in [*NEEDS.get(v, []), v]:
            if n not in order:
                order.append(n)
    parts = [f"{n} AS ({VIEWS[n]})" for n in order]
    parts += [f"{n} AS ({q})" for n, q in (extra or {}).items()]
    return (f"WITH {', '.join(parts)} " if parts else "") + body


def query(name: str, oracle: str | None = None):
    """Register a function (spark, folder) → DataFrame under ``name``."""

    def add(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} exists")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return add
