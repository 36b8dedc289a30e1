"""Rows of two engines as sorted tuples."""

import math


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    if isinstance(v, bool):
        return str(v)
    return repr(round(float(v), 5) + 0.0) if isinstance(v, (int, float)) or type(v).__name__ == "Decimal" else str(v)


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in data)


def same(spark_df, duck_rel):
    assert sorted(spark_df.columns) == sorted(duck_rel.columns)
    assert rows(spark_df.columns, spark_df.collect()) == rows(duck_rel.columns, duck_rel.fetchall())
