"""Name -> query and name -> SQL twin."""

QUERIES, ORACLE = {}, {}


def query(name, sql=None):
    def add(fn):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return add


def with_(*ctes, select):
    return "WITH " + ",\n".join(ctes) + "\n" + select


def haversine_sql(lat1, lng1, lat2, lng2):
    return (f"(12742.0::DOUBLE * asin(sqrt(least(1.0::DOUBLE, "
            f"power(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * "
            f"cos(radians({lat2})) * power(sin(radians({lng2} - {lng1}) / 2), 2)))))")


def half_even_sql(x, places=2):
    """Half-even on the binary value, like the Spark expression."""
    return f"(format('{{:.{places}f}}', {x})::DOUBLE + 0.0)"


def sql_list(values):
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def mean_sql(x):
    """Nearest double to the mean of values with at most two decimals."""
    return f"(sum(round({x} * 100)::HUGEINT)::DOUBLE / (100.0::DOUBLE * count(*)))"
