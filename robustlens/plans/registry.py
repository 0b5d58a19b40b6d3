"""Query registry: one Spark callable per operator and, where SQL can say it, its DuckDB text."""
QUERIES = {}
ORACLES = {}


def query(name, sql=None):
    def register(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register
