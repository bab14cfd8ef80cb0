"""The labelling rules restated row by row in plain Python, for tests only."""

import re

from hintwise.schemas import NOT_TABLE_NAMES, SQL_KEYWORDS


def keywords(sql):
    if sql is None:
        return []
    up = sql.upper()
    found = {k for k in SQL_KEYWORDS if re.search(rf"\b{re.escape(k)}\b", up)}
    if "(" in sql and up.count("SELECT") > 1:
        found.add("SUBQUERY")
    return [k for k in SQL_KEYWORDS if k in found]


def complexity(sql, kws):
    if sql is None:
        return "simple"
    up, kws = sql.upper(), set(kws)
    hard = [
        "SUBQUERY" in kws, kws & {"UNION", "INTERSECT", "EXCEPT"}, up.count("JOIN") > 1,
        up.count("SELECT") > 1, "CASE" in kws, "HAVING" in kws, "OVER(" in up or "OVER (" in up,
    ]
    middle = [
        kws & {"JOIN", "INNER JOIN", "LEFT JOIN", "RIGHT JOIN"}, "GROUP BY" in kws,
        kws & {"COUNT", "SUM", "AVG", "MAX", "MIN"}, "ORDER BY" in kws, len(kws) > 5,
    ]
    if len([1 for s in hard if s]) > 1:
        return "complex"
    return "medium" if len([1 for s in middle if s]) > 1 else "simple"


def tables(sql):
    if sql is None:
        return []
    names = set()
    for word in ("from", "join", "into", "update"):
        names |= {n.lower() for n in re.findall(rf"\b{word}\s+([a-z_][a-z0-9_]*)", sql, re.I | re.A)}
    return sorted(names - set(NOT_TABLE_NAMES))


def table_count(sql):
    joins = 0 if sql is None else len(re.findall(r"\bJOIN\b", sql.upper()))
    return {0: "1", 1: "2"}.get(joins, "3+")
