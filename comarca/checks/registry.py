"""Register of queries and the SQL texts they must agree with."""

from comarca.checks.views import Tables, with_views

QUERIES, ORACLES = {}, {}


def check(name, sql=None):
    """Register a query over ``Tables``; ``sql`` uses ``{name}`` for tables and views."""

    def add(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = lambda spark, folder: fn(Tables(spark, folder))
        if sql is not None:
            ORACLES[name] = with_views(sql)
        return fn

    return add
