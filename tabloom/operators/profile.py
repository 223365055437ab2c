"""Column profiles and target candidates of one table or of many with the same schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.config import TargetConfig
from tabloom.functions import text
from tabloom.operators.ordering import broadcast_if_small, join_null_safe
from tabloom.session import cut_lineage

# Fixed value: a string that counts as a number.
NUMERIC_PATTERN = r"(?U)^-?\d+(\.+\d+)?$"


def is_numeric_text(c: Column) -> Column:
    return F.regexp_like(c, F.lit(NUMERIC_PATTERN))


def is_date_type(dt: T.DataType, strict: bool = True) -> bool:
    """Timestamps and durations; plain dates count only when ``strict`` is off."""
    return isinstance(dt, text.DATE_TYPES) or (not strict and isinstance(dt, T.DateType))


def is_missing(c: Column, dt: T.DataType) -> Column:
    if isinstance(dt, text.FLOAT_TYPES):
        return c.isNull() | F.isnan(c)
    return c.isNull()


def _is_nested(dt: T.DataType) -> bool:
    return isinstance(dt, (T.ArrayType, T.MapType, T.StructType))


def _is_whole(dt: T.DataType) -> bool:
    return isinstance(dt, (*text.INT_TYPES, T.BooleanType, T.DateType, T.TimestampType))


def _whole(c: Column, dt: T.DataType) -> Column:
    if isinstance(dt, T.DateType):
        return F.unix_date(c).cast("long")
    if isinstance(dt, T.TimestampType):
        return F.unix_micros(c)
    return c.cast("int").cast("long") if isinstance(dt, T.BooleanType) else c.cast("long")


def _cells(df: DataFrame, table: Column, columns: list[str], flags: bool = True) -> DataFrame:
    """One row per cell: table_id, column, missing, a, b, and with ``flags`` length, numeric, zero_one.

    ``a`` and ``b`` are 128 bits that equal values share: the value itself where it is a whole number,
    else two hashes of it. Values are prepared in one projection and laid out in the next: in one, the
    generated code of a wide table is larger than what the JVM compiles, and several times slower.
    """
    fields = {f.name: f.dataType for f in df.schema.fields}
    ready, cells = [table.alias("table_id")], []
    zero = F.lit(0).cast("long")
    for i, name in enumerate(columns):
        dt, c = fields[name], F.col(f"`{name}`")
        value, shown, missing = (F.col(f"{x}{i}") for x in ("v", "s", "m"))
        nested, number = _is_nested(dt), isinstance(dt, text.FLOAT_TYPES)
        plain = not (nested or number or _is_whole(dt))  # told apart by the text
        ready.append(is_missing(c, dt).alias(f"m{i}"))
        if plain or (flags and not nested):
            ready.append(text.py_str(c, dt).alias(f"s{i}"))
        if number:
            ready.append(F.when(c == 0, F.lit(0.0)).otherwise(c.cast("double")).alias(f"v{i}"))  # -0.0 is no value of its own
        elif _is_whole(dt):
            ready.append(_whole(c, dt).alias(f"v{i}"))
        if nested:
            ids, shown, numeric, zero_one = (zero, zero), F.lit(""), F.lit(False), F.lit(False)
        elif _is_whole(dt):
            ints = isinstance(dt, text.INT_TYPES)
            ids, numeric, zero_one = (value, zero), ~missing & F.lit(ints), value.isin(0, 1) & F.lit(ints)
        elif number:
            plainly = (F.abs(value) >= 1e-4) & (F.abs(value) < 1e16)  # else spelled with an exponent
            ids, numeric, zero_one = (F.xxhash64(value), F.xxhash64(F.lit(1), value)), (value == 0) | plainly, F.lit(False)
        else:
            ids, numeric, zero_one = (F.xxhash64(shown), F.xxhash64(F.lit(1), shown)), is_numeric_text(shown), shown.isin("0", "1")
        cells += [F.lit(name), missing, *ids]
        if flags:
            cells += [F.length(shown), F.coalesce(numeric, F.lit(False)), F.coalesce(zero_one, F.lit(False))]
    out = ["column", "missing", "a", "b", *(["length", "numeric", "zero_one"] if flags else [])]
    return df.select(*ready).select("table_id", F.stack(F.lit(len(columns)), *cells).alias(*out))


def column_profile(
    df: DataFrame, table: Column, columns: list[str] | None = None, null_is_value: bool = True, settle: TargetConfig | None = None
) -> DataFrame:
    """One row per (table, column) with counts and the flags target selection needs.

    A first pass sums every column up in one row per task: counts, flags, the longest text, the range of
    what identifies a value. Columns without values, of one value, of 0 and 1, or of two neighbouring
    whole numbers are settled by that. Only for the others the values themselves are told apart, as two numbers each,
    equal ones collapsed before they move. ``settle`` counts only where the verdict of
    :func:`target_candidates` under that configuration depends on it; ``n_unique`` and
    ``n_unique_with_null`` are null elsewhere, so that long texts, which are never counted, never move.
    """
    fields = {f.name: f.dataType for f in df.schema.fields}
    names = columns or [f.name for f in df.schema.fields]
    keys = ["table_id", "column"]
    there = F.when(~F.col("missing"), F.lit(True))
    counted = F.lit(True) if null_is_value else ~F.col("missing")
    flat = cut_lineage(
        _cells(df, table, names).groupBy(*keys).agg(
            F.count(F.lit(1)).alias("n"),
            F.count_if("missing").alias("n_missing"),
            F.coalesce(F.bool_and(F.when(counted, F.col("numeric"))), F.lit(True)).alias("all_numeric"),
            F.coalesce(F.bool_and(F.when(counted, F.col("zero_one"))), F.lit(False)).alias("zero_one"),
            F.coalesce(F.max(F.when(counted, F.col("length"))), F.lit(0)).alias("max_len"),
            *[f(F.when(there, F.col(c))).alias(f"{n}_{c}") for c in ("a", "b") for n, f in (("min", F.min), ("max", F.max))],
        )
    )
    whole = F.col("column").isin([n for n in names if _is_whole(fields[n])])
    dates = F.col("column").isin([n for n in names if is_date_type(fields[n])])
    nested = F.col("column").isin([n for n in names if _is_nested(fields[n])])
    span = F.col("max_a").cast("decimal(38,0)") - F.col("min_a").cast("decimal(38,0)")
    known = (
        F.when(F.col("n") == F.col("n_missing"), 0)
        .when((F.col("min_a") == F.col("max_a")) & (F.col("min_b") == F.col("max_b")), 1)
        .when(whole & (span == 1), 2)
        .when(F.col("zero_one"), 2)
    )
    open_ = known.isNull()
    if settle:
        # More than one value is known; what may be left is whether all of them differ.
        differ = F.col("all_numeric") & (F.col("n_missing") == 0) & (~whole | (span + 1 >= F.col("n")))
        asked = F.lit(settle.min_unique_values > 2) | (F.lit(settle.require_nonunique and not settle.drop_numeric) & differ)
        open_ = open_ & asked & ~nested & ~(F.lit(settle.drop_dates) & dates) & ~F.contains("column", F.lit("Unnamed:"))
    left = flat.where(open_).select(*keys)
    which = {r["column"] for r in left.select("column").distinct().collect()}
    distinct = None
    if which:
        cells = _cells(df, table, [n for n in names if n in which], flags=False).where(~F.col("missing"))
        of = _rename(left, keys)
        cells = cells.join(broadcast_if_small(of, left.count()), (F.col("table_id").eqNullSafe(F.col("__table_id"))) & (F.col("column") == F.col("__column")), "left_semi")
        distinct = cells.groupBy(*keys, "a", "b").agg(F.lit(1).alias("one")).groupBy(*keys).agg(F.count(F.lit(1)).alias("exact"))
        flat = join_null_safe(flat, distinct, keys, "left")
    n_unique = F.coalesce(F.col("exact"), known) if distinct is not None else known
    n_unique = n_unique.cast("long")
    order = F.create_map(*[x for i, n in enumerate(names) for x in (F.lit(n), F.lit(i))])
    with_null = n_unique + F.when(F.col("n_missing") > 0, 1).otherwise(0)
    return flat.select(
        *keys,
        order[F.col("column")].alias("ordinal"),
        "n",
        n_unique.alias("n_unique"),
        with_null.cast("long").alias("n_unique_with_null"),
        "all_numeric",
        # Both values and nothing else: then the count is settled, too.
        (F.col("zero_one") & F.coalesce((with_null if null_is_value else n_unique) == 2, F.lit(False))).alias("is_binary01"),
        "max_len",
        dates.alias("is_date"),
        nested.alias("is_nested"),
    )


def _rename(df: DataFrame, names: list[str]) -> DataFrame:
    return df.withColumnsRenamed({n: f"__{n}" for n in names})


def _per_column(cells: DataFrame, keys: list[str], null_is_value: bool) -> DataFrame:
    """Counts and flags per column from (keys, value, missing), one row per cell."""
    values = cells.groupBy(*keys, "value", "missing").agg(F.count(F.lit(1)).alias("c"))
    counted = F.lit(True) if null_is_value else ~F.col("missing")
    return values.groupBy(*keys).agg(
        F.sum("c").alias("n"),
        F.count_if(~F.col("missing")).alias("n_unique"),
        F.count(F.lit(1)).alias("n_unique_with_null"),
        F.coalesce(F.bool_and(F.when(counted, is_numeric_text(F.col("value")))), F.lit(True)).alias("all_numeric"),
        (
            F.coalesce(F.bool_and(F.when(counted, F.col("value").isin("0", "1"))), F.lit(False))
            & (F.count_if(counted) == 2)
        ).alias("is_binary01"),
        F.coalesce(F.max(F.when(counted, F.length("value"))), F.lit(0)).alias("max_len"),
    )


def records_profile(records: DataFrame, null_is_value: bool = True) -> DataFrame:
    """The same profile for records of any schema (features with value and missing)."""
    cells = records.select("table_id", F.explode("features").alias("f")).select(
        "table_id", F.col("f.name").alias("column"), F.col("f.ordinal").alias("ordinal"), F.col("f.kind").alias("kind"),
        F.when(F.col("f.kind") != "nested", F.col("f.value")).otherwise(F.lit("")).alias("value"), F.col("f.missing").alias("missing"),
    )
    prof = _per_column(cells, ["table_id", "column", "ordinal", "kind"], null_is_value)
    return prof.withColumn("is_date", F.col("kind") == "time").withColumn("is_nested", F.col("kind") == "nested").drop("kind")


def target_candidates(profile: DataFrame, config: TargetConfig = TargetConfig()) -> DataFrame:
    """Adds ``reason`` (null for a candidate) and ``is_candidate``; the first rule that fails names it."""
    all_unique = F.col("n_unique") == F.col("n")
    numeric = F.col("all_numeric")
    rules = [
        (F.contains("column", F.lit("Unnamed:")), "unnamed"),
        (F.lit(config.drop_dates) & F.col("is_date"), "date"),
        (F.col("is_nested"), "unhashable"),
        (F.col("n_unique") < config.min_unique_values, "too few values"),
        (F.lit(config.require_nonunique and not config.drop_numeric) & all_unique & numeric, "unique numbers"),
        (F.lit(config.drop_numeric) & numeric & ~F.col("is_binary01"), "numeric"),
        (F.col("max_len") > config.max_label_chars, "too long"),
    ]
    reason = F.lit(None).cast("string")
    for cond, name in reversed(rules):
        reason = F.when(cond, F.lit(name)).otherwise(reason)
    return profile.withColumn("reason", reason).withColumn("is_candidate", F.col("reason").isNull())


def summary(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """describe(include="all") as rows (column, statistic, value): one aggregation for all columns.

    Quartiles and the most frequent value come from the exact distributed operators.
    """
    from tabloom.operators.quantiles import even_quantiles

    fields = {f.name: f.dataType for f in df.schema.fields}
    names = columns or [f.name for f in df.schema.fields]
    numeric = [n for n in names if text.is_number(fields[n])]
    other = [n for n in names if n not in numeric and not _is_nested(fields[n])]
    aggs, cells = [], []
    for n in names:
        c = F.col(f"`{n}`")
        ok = ~is_missing(c, fields[n])
        aggs.append(F.count(F.when(ok, F.lit(1))).cast("double").alias(f"{n}__count"))
        stats = ["count"]
        if n in numeric:
            v = F.when(ok, c.cast("double"))
            for s, e in (("mean", F.avg(v)), ("std", F.stddev_samp(v)), ("min", F.min(v)), ("max", F.max(v))):
                aggs.append(e.alias(f"{n}__{s}"))
                stats.append(s)
        for s in stats:
            cells += [F.lit(n), F.lit(s), F.col(f"`{n}__{s}`")]
    flat = df.agg(*aggs)
    out = flat.select(F.stack(F.lit(len(cells) // 3), *cells).alias("column", "statistic", "value"))
    out = out.select("column", "statistic", text.py_float(F.col("value")).alias("value"))
    if numeric:
        long = df.select(
            F.stack(
                F.lit(len(numeric)),
                *[x for n in numeric for x in (F.lit(n), F.col(f"`{n}`").cast("double"))],
            ).alias("column", "v")
        )
        quart = even_quantiles(long, ["column"], "v", 4).where("i between 1 and 3")
        out = out.unionByName(
            quart.select(
                "column",
                F.concat((F.col("i") * 25).cast("string"), F.lit("%")).alias("statistic"),
                text.py_float(F.col("quantile")).alias("value"),
            )
        )
    if other:
        cells = [x for n in other for x in (F.lit(n), F.when(~is_missing(F.col(f"`{n}`"), fields[n]), text.py_str(F.col(f"`{n}`"), fields[n])))]
        long = df.select(F.stack(F.lit(len(other)), *cells).alias("column", "v")).where("v is not null")
        freq = long.groupBy("column", "v").agg(F.count(F.lit(1)).alias("c"))
        # Most frequent value; the smallest wins a tie.
        top = freq.groupBy("column").agg(
            F.count(F.lit(1)).cast("string").alias("unique"),
            F.min(F.struct(-F.col("c"), F.col("v"))).alias("t"),
        )
        top = top.select("column", "unique", F.col("t.v").alias("top"), (-F.col("t.col1")).cast("string").alias("freq"))
        out = out.unionByName(top.unpivot(["column"], ["unique", "top", "freq"], "statistic", "value"))
    return out


def value_counts(df: DataFrame, column: str, group: list[str] | None = None) -> DataFrame:
    """Absolute and relative frequency of each value (missing values are not counted as a value)."""
    group = group or []
    dt = df.schema[column].dataType
    counts = (
        df.where(~is_missing(F.col(column), dt)).groupBy(*group, column).agg(F.count(F.lit(1)).alias("count"))
    )
    if not group:
        return counts.withColumn("share", F.col("count") / F.lit(df.count()))
    totals = df.groupBy(*group).agg(F.count(F.lit(1)).alias("__total"))
    return join_null_safe(counts, totals, group).withColumn("share", F.col("count") / F.col("__total")).drop("__total")
