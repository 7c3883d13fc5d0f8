"""The role views of ``bindings`` in SQL, for the side-by-side check."""

from __future__ import annotations

import re

VIEWS: dict[str, str] = {
    "v_order_item": """
        SELECT CAST(year(o_orderdate) AS INT) AS season, CAST(month(o_orderdate) AS INT) AS week, l.*, o.*
        FROM lineitem l JOIN orders o ON l_orderkey = o_orderkey""",
    "v_perf": """
        SELECT season, week, entity, s_nationkey AS grp,
               CASE entity % 5 WHEN 0 THEN 'QB' WHEN 1 THEN 'RB' WHEN 2 THEN 'WR' WHEN 3 THEN 'TE' ELSE 'K' END AS category,
               carries, receptions, receiving_yards, rushing_yards,
               0.5 * receptions + 0.0625 * receiving_yards + 1.0 * floor(rushing_yards / 10.0) + 0.25 * carries AS pts
        FROM (SELECT season, week, l_suppkey AS entity, CAST(count(*) AS DOUBLE) AS carries,
                     CAST(count(*) FILTER (WHERE l_returnflag = 'R') AS DOUBLE) AS receptions,
                     sum(l_quantity) AS receiving_yards, sum(floor(l_extendedprice / 1000.0)) AS rushing_yards
              FROM v_order_item GROUP BY season, week, l_suppkey) JOIN supplier ON entity = s_suppkey""",
    "v_category": "SELECT unnest(['QB', 'RB', 'WR', 'TE', 'K']) AS category",
    "v_season": "SELECT DISTINCT CAST(year(o_orderdate) AS INT) AS season FROM orders",
    "v_sched": """
        SELECT season, week, grp, CASE WHEN opp0 <> grp THEN opp0 END AS opp, CASE WHEN opp0 <> grp THEN grp < opp0 END AS home
        FROM (SELECT season, CAST(w.week AS INT) AS week, n_nationkey AS grp, ((w.week - n_nationkey) % 25 + 25) % 25 AS opp0
              FROM v_season, (SELECT unnest(range(1, 13)) AS week) w, nation)""",
    "v_final": """
        SELECT season, week, grp, opp, home,
               NOT (season = 2001 AND (week > 6 OR (week = 6 AND least(grp, opp) % 2 = 1))) AS final
        FROM v_sched WHERE opp IS NOT NULL""",
    "v_points": "SELECT season, week, grp, category, sum(pts) AS pts FROM v_perf GROUP BY season, week, grp, category",
    "v_grid": """
        SELECT f.season, f.week, f.grp, f.opp, f.home, c.category, coalesce(p.pts, 0.0) AS pts
        FROM (SELECT * FROM v_final WHERE final) f CROSS JOIN v_category c
        LEFT JOIN v_points p ON p.season = f.season AND p.week = f.week AND p.grp = f.grp AND p.category = c.category""",
    "v_loo": """
        SELECT *, CASE WHEN count(*) OVER g > 1 THEN (sum(pts) OVER g - pts) / (count(*) OVER g - 1) END AS usual
        FROM v_grid WINDOW g AS (PARTITION BY season, grp, category)""",
    "v_allowed": """
        SELECT d.season, d.week, d.grp, d.opp, d.category, d.pts, o.pts AS allowed, o.usual AS opp_usual
        FROM v_grid d JOIN v_loo o ON o.season = d.season AND o.week = d.week AND o.grp = d.opp AND o.category = d.category""",
    "v_score": """
        SELECT season, week, grp, opp, home, sum(pts) AS pf FROM v_grid GROUP BY season, week, grp, opp, home""",
    "v_hist": """
        SELECT a.season, a.week, a.grp AS manager, a.pf, a.opp, b.pf AS pa, a.week > 10 AS playoff,
               CASE WHEN a.pf > b.pf THEN 'W' WHEN a.pf < b.pf THEN 'L' ELSE 'T' END AS result
        FROM v_score a JOIN v_score b ON a.season = b.season AND a.week = b.week AND a.opp = b.grp""",
    "v_avg": """
        SELECT season, entity, grp, category, avg(pts) AS ppg, stddev_pop(pts) AS sd, sum(pts) AS total, count(*) AS n
        FROM v_perf GROUP BY season, entity, grp, category""",
}


def with_views(sql: str) -> str:
    """Prefix ``sql`` with the views it mentions, directly or through other views."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in re.findall(r"\bv_\w+", text):
            if name in VIEWS and name not in needed:
                visit(VIEWS[name])
                if name not in needed:
                    needed.append(name)

    visit(sql)
    if not needed:
        return sql
    ctes = ",\n".join(f"{name} AS MATERIALIZED ({VIEWS[name].strip()})" for name in needed)
    return f"WITH {ctes}\n{sql}"
