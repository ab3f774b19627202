"""Named queries: name -> (callable(spark, sf_dir), DuckDB SQL or None)."""

QUERIES = {}


def query(sql=None):
    """Register a function under its own name, with its SQL twin."""

    def add(fn):
        QUERIES[fn.__name__] = (fn, sql)
        return fn

    return add


from . import annotations, estimation, reports, relational, semistructured, sensitivity, texts  # noqa: E402, F401  (they register themselves)


def flagship(spark, sf_dir):
    return QUERIES["cluster_estimate_urgent"][0](spark, sf_dir)
