"""Compare a Spark result with DuckDB's over the same tables."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _plain(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return None
    if isinstance(x, bool):
        return x
    if isinstance(x, float):
        return round(x, 6) + 0.0
    if isinstance(x, (list, tuple)):
        return tuple(_plain(v) for v in x)
    if isinstance(x, dict):
        return tuple(sorted((k, _plain(v)) for k, v in x.items()))
    if hasattr(x, "asDict"):
        return _plain(x.asDict())
    if hasattr(x, "tzinfo"):
        return x.replace(tzinfo=None)
    return x


def _kind(t):
    t = str(t).lower()
    for name, words in {"int": ("int", "long"), "float": ("double", "float", "decimal"), "str": ("string", "varchar"), "bool": ("bool",)}.items():
        if any(w in t for w in words) and not t.startswith(("array", "struct", "map")) and "[" not in t and "(" not in t.replace("decimal(", ""):
            return name
    return "other"


def compare(df, con, sql):
    """None if equal, else what differs."""
    rel = con.execute(sql)
    names, types = [d[0] for d in rel.description], [str(d[1]) for d in rel.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    want = [tuple(_plain(r[i]) for i in order) for r in rel.fetchall()]
    columns = sorted(df.columns)
    if columns != [names[i] for i in order]:
        return f"columns {columns} and {[names[i] for i in order]}"
    kinds = [(c, _kind(dict(df.dtypes)[c]), _kind(types[i])) for c, i in zip(columns, order)]
    if bad := [k for k in kinds if k[1] != k[2]]:
        return f"types {bad}"
    got = [tuple(_plain(r[c]) for c in columns) for r in df.collect()]
    if len(got) != len(want):
        return f"{len(got)} rows, {len(want)} wanted"
    key = lambda r: tuple((v is None, str(v)) for v in r)
    got.sort(key=key)
    want.sort(key=key)
    for a, b in zip(got, want):
        if a != b:
            return f"{columns}: {a} and {b}"
    return None
