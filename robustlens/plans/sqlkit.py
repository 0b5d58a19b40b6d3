"""Small text helpers for the DuckDB side of the queries."""


def R(x):
    return f"(round(CAST({x} AS DOUBLE), 6) + 0e0)"


def CORR(x, y, min_n=3, default="0e0"):
    return (f"(CASE WHEN count(*) FILTER (WHERE {x} IS NOT NULL AND {y} IS NOT NULL) >= {min_n} "
            f"AND min({x}) FILTER (WHERE {y} IS NOT NULL) < max({x}) FILTER (WHERE {y} IS NOT NULL) "
            f"AND min({y}) FILTER (WHERE {x} IS NOT NULL) < max({y}) FILTER (WHERE {x} IS NOT NULL) "
            f"THEN corr({x}, {y}) ELSE {default} END)")


def SLOPE(x, y, default="0e0"):
    return f"(CASE WHEN min({x}) < max({x}) THEN regr_slope({y}, {x}) ELSE {default} END)"


def DIV0(a, b):
    return f"(CASE WHEN ({b}) = 0 OR ({b}) IS NULL THEN 0e0 ELSE CAST({a} AS DOUBLE) / ({b}) END)"


def H(seed, *cols):
    return "md5(concat_ws('|', '" + str(seed) + "', " + ", ".join(f"CAST({c} AS VARCHAR)" for c in cols) + "))"


def HI(seed, *cols):
    return f"CAST(('0x' || substr({H(seed, *cols)}, 1, 15)) AS BIGINT)"
