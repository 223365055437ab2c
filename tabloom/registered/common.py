"""Helpers shared by the registered queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def joined(c: Column) -> Column:
    """Numbers of an array as text."""
    return F.array_join(F.transform(c, lambda x: x.cast("string")), ",")


# --- SQL fragments ---------------------------------------------------------------------------

def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def digest(seed, *keys: str) -> str:
    return f"md5(concat_ws(':', {q(str(seed))}, {', '.join(keys)}))"


def uniform(seed, *keys: str) -> str:
    return f"(('0x' || substr({digest(seed, *keys)}, 1, 8))::UBIGINT / 4294967296.0::DOUBLE)"


def num(c: str) -> str:
    """Number as text."""
    return f"coalesce(({c})::VARCHAR, 'nan')"


def iso(c: str) -> str:
    """Timestamp as ISO text with six fraction digits when there are any."""
    return (
        f"coalesce(CASE WHEN microsecond({c}) % 1000000 = 0 THEN strftime({c}, '%Y-%m-%dT%H:%M:%S') "
        f"ELSE strftime({c}, '%Y-%m-%dT%H:%M:%S.%f') END, 'NaT')"
    )


def txt(c: str) -> str:
    """Trimmed text without one final full stop."""
    return f"regexp_replace(trim(coalesce({c}, 'None')), '\\.$', '')"


def draws(n: str, k: int, seed, *keys: str) -> str:
    """List of k different numbers below n: draw j among the free ones, moved up past taken ones."""
    expr = "[]::BIGINT[]"
    for j in range(k):
        r = f"floor({uniform(seed, *keys, q(str(j)))} * ({n} - {j}))::BIGINT"
        if j == 0:
            steps = f"[{r}]"
        else:
            steps = (
                f"(SELECT list_append(t, list_reduce(list_concat([{r}], list_sort(t)), "
                f"lambda p, c: CASE WHEN c <= p THEN p + 1 ELSE p END)) FROM (SELECT {expr} AS t))"
            )
        expr = steps
    return expr


TABLE_COLUMNS = {
    "customer": {"c_custkey": num, "c_name": txt, "c_nationkey": num, "c_acctbal": num, "c_mktsegment": txt},
    "orders": {"o_orderkey": num, "o_custkey": num, "o_orderstatus": txt, "o_totalprice": num,
               "o_orderdate": lambda c: iso(c), "o_orderpriority": txt},
    "part": {"p_partkey": num, "p_name": txt, "p_brand": txt, "p_type": txt, "p_size": num, "p_retailprice": num},
    "supplier": {"s_suppkey": num, "s_name": txt, "s_nationkey": num, "s_acctbal": num},
    "events": {"event_id": num, "ts": lambda c: iso(c), "user_id": num, "event_type": txt, "value": num, "props": txt},
    "lineitem": {"l_orderkey": num, "l_partkey": num, "l_suppkey": num, "l_linenumber": num, "l_quantity": num,
                 "l_extendedprice": num, "l_discount": num, "l_tax": num, "l_returnflag": txt, "l_linestatus": txt,
                 "l_shipdate": lambda c: iso(c)},
}


def sentences(table: str, target: str | None) -> str:
    """The row as sentences."""
    parts = [f"'The {c} is ' || {f(c)} || '.'" for c, f in TABLE_COLUMNS[table].items() if c != target]
    return " || ' ' || ".join(parts)


def raw(table: str, c: str) -> str:
    """Value text without trimming."""
    f = TABLE_COLUMNS[table][c]
    return f"coalesce({c}, 'None')" if f is txt else f(c)
