"""Registered queries and, where SQL can say it, the same result as SQL text."""
QUERIES: dict = {}
ORACLES: dict = {}


def query(name, sql=None):
    """Registers ``fn(spark, sf_dir) -> DataFrame`` under ``name``."""
    def add(fn):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql() if callable(sql) else sql
        return fn
    return add
