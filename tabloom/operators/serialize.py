"""Table rows to text, and back.

The columns of a row are known when the plan is built, so each style becomes one string
expression over the typed columns. The default styles use no higher-order function and stay inside
generated code. Optional parts rely on ``concat_ws`` skipping nulls.
"""

from __future__ import annotations

import html
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.config import SerializerConfig
from tabloom.functions import hashing, text
from tabloom.functions.tokens import CHOICE_SEP, STRUCTURE

STYLES = ("basic", "basic_v2", "structured", "pandas", "html", "html_compact", "json")


@dataclass(frozen=True)
class Feature:
    """One column of a row. ``present`` is null for always, else the rows that show it."""

    name: str
    value: Column
    dtype: T.DataType
    present: Column | None = None
    quantile: Column | None = None
    scale: Column | None = None

    def meta(self) -> list[tuple[str, Column]]:
        return [(k, m) for k, m in (("quantile", self.quantile), ("scale", self.scale)) if m is not None]


def features_of(df: DataFrame, columns: list[str] | None = None, meta: bool = False) -> list[Feature]:
    """Features in table order; ``<column>__quantile`` / ``__scale`` columns become metafeatures."""
    have = {f.name: f.dataType for f in df.schema.fields}
    hidden = {c + s for c in have for s in ("__quantile", "__scale")} if meta else set()
    out = []
    for name in columns or [c for c in have if c not in hidden]:
        q, s = f"{name}__quantile", f"{name}__scale"
        out.append(
            Feature(
                name,
                F.col(f"`{name}`"),
                have[name],
                quantile=F.col(f"`{q}`") if meta and q in have else None,
                scale=F.col(f"`{s}`") if meta and s in have else None,
            )
        )
    return out


def check_names(names: list[str], strict: bool) -> None:
    """In strict mode no name may be part of a later one (it could not be found again in text)."""
    if strict:
        for i, a in enumerate(names):
            if any(a in b for b in names[i + 1:]):
                raise ValueError(f"one column name contains another: {a}")


def with_dropout(features: list[Feature], rate: float, row_key: Column, seed=0) -> list[Feature]:
    """Each feature of each row is kept when its draw exceeds ``rate``."""
    out = []
    for f in features:
        keep = hashing.exceeds(rate, seed, "drop", row_key, f.name)
        out.append(replace(f, present=keep if f.present is None else f.present & keep))
    return out


def shuffled_columns(names: list[str], table: str, seed=0) -> list[str]:
    """One column order for a whole table."""
    import hashlib

    return sorted(names, key=lambda n: hashlib.md5(f"{seed}:{table}:{n}".encode()).hexdigest())


# --- values ----------------------------------------------------------------------------------

def _shown(f: Feature, config: SerializerConfig) -> Column:
    """Value text: numbers rounded if asked, strings trimmed and freed of one final full stop."""
    v = f.value
    if isinstance(f.dtype, text.FLOAT_TYPES) and config.max_precision is not None:
        v = text.py_round(v.cast("double"), config.max_precision)
        return text.py_float(v)
    if isinstance(f.dtype, (T.StringType, T.BinaryType)):
        return text.tidy(text.py_str(v, f.dtype))
    shown = text.py_str(v, f.dtype)
    if isinstance(f.dtype, (T.StructType, T.MapType)):
        return text.tidy(shown)
    return shown


def _is_text(dt: T.DataType) -> bool:
    return not (text.is_number(dt) or isinstance(dt, (T.BooleanType, T.ArrayType)))


def _arranged(features: list[Feature], parts: list[Column], config, row_key, seed) -> list[Column]:
    """Arguments for ``concat_ws``: feature texts in table order, or one array in a hashed order per
    row. Features a row does not show are null, which ``concat_ws`` skips."""
    parts = [p if f.present is None else F.when(f.present, p) for f, p in zip(features, parts)]
    if not config.shuffle_features or not parts:
        return parts
    if row_key is None:
        raise ValueError("shuffling features needs a row key")
    ranked = [
        F.struct(hashing.digest(seed, "order", row_key, f.name).alias("k"), p.alias("t"))
        for f, p in zip(features, parts)
    ]
    # Sorting an array of structs and taking a field needs no lambda.
    return [F.sort_array(F.array(*ranked)).getField("t")]


def _as_col(x) -> Column:
    return F.lit(x) if isinstance(x, str) else x


def _part(x) -> Column | None:
    """Trimmed part of a text, null if empty; fixed texts are trimmed when the plan is built."""
    if isinstance(x, str):
        return F.lit(x.strip()) if x else None
    return text.strip(_optional(x))


def _optional(c: Column) -> Column:
    """Null for an empty text, so that it takes no part in a join of texts."""
    return F.when(c != "", c)


def _choices_array(choices) -> Column | None:
    if choices is None:
        return None
    return F.array(*[F.lit(c) for c in choices]) if isinstance(choices, (list, tuple)) else choices


def choices_text(choices, style: str) -> Column:
    """Choice list of a style; empty without choices."""
    arr = _choices_array(choices)
    if arr is None:
        return F.lit("")
    if style == "basic_v2":
        t = F.concat(F.lit(CHOICE_SEP), F.array_join(arr, CHOICE_SEP), F.lit(CHOICE_SEP))
    elif style == "structured":
        a, b = STRUCTURE["choices"]
        t = F.concat(F.lit(a), F.array_join(arr, CHOICE_SEP), F.lit(b))
    elif style == "json":
        items = F.transform(arr, text.json_quote)
        t = F.concat(F.lit("["), F.array_join(items, ", "), F.lit("]"))
    else:
        t = F.array_join(arr, " or ")
    return F.when(F.size(arr) > 0, t).otherwise(F.lit(""))


# --- feature part of each style --------------------------------------------------------------

def _basic_features(features, config, row_key, seed):
    parts = []
    for f in features:
        t = [F.lit(f"The {f.name} is "), _shown(f, config)]
        meta = f.meta()
        if meta:
            cells = [x for k, m in meta for x in (F.lit(f", {k}:"), text.py_float(m))]
            cells[0] = F.lit(f" ({meta[0][0]}:")
            t += [*cells, F.lit(")")]
        parts.append(F.concat(*t, F.lit(".")))
    # Every sentence starts with "The" and ends with a full stop: nothing to trim.
    return _arranged(features, parts, config, row_key, seed)


def _structured_features(features, config, row_key, seed):
    (k0, k1), (v0, v1), (m0, m1) = STRUCTURE["key"], STRUCTURE["value"], STRUCTURE["meta"]
    parts = []
    for f in features:
        t = [F.lit(f"{k0}{f.name}{k1}{v0}"), text.py_str(f.value, f.dtype), F.lit(v1)]
        if f.meta():
            cells = [x for k, m in f.meta() for x in (F.lit(STRUCTURE[k][0]), text.py_float(m), F.lit(STRUCTURE[k][1]))]
            t += [F.lit(m0), *cells, F.lit(m1)]
        parts.append(F.concat(*t))
    return _arranged(features, parts, config, row_key, seed)


def _json_number(shown: Column) -> Column:
    """Number text in JSON spelling."""
    odd = F.replace(F.replace(shown, F.lit("nan"), F.lit("NaN")), F.lit("inf"), F.lit("Infinity"))
    return F.when(F.contains(shown, F.lit("n")), odd).otherwise(shown)


def _literal(f: Feature, config, flavour: str) -> Column:
    shown = _shown(f, config)
    if flavour == "json":
        if isinstance(f.dtype, T.BooleanType):
            return F.when(f.value, "true").when(~f.value, "false").otherwise('"None"')
        if isinstance(f.dtype, T.ArrayType):
            items = F.transform(f.value, lambda x: text.json_quote(text.py_str(x, f.dtype.elementType)))
            return F.coalesce(F.concat(F.lit("["), F.array_join(items, ", "), F.lit("]")), F.lit('"None"'))
        return _quote_value(f, shown, flavour) if _is_text(f.dtype) else _json_number(shown)
    if isinstance(f.dtype, T.BooleanType):
        return F.when(f.value.isNull(), F.lit("'None'")).otherwise(shown)
    if not _is_text(f.dtype):
        return shown
    return _quote_value(f, shown, flavour)


def _quote_value(f: Feature, shown: Column, flavour: str) -> Column:
    """Quoted text of a value; dates and numbers in text need no escapes."""
    if not isinstance(f.dtype, (T.StringType, T.BinaryType, T.StructType, T.MapType)):
        mark = '"' if flavour == "json" else "'"
        return F.concat(F.lit(mark), shown, F.lit(mark))
    return _quote(shown, flavour) if flavour != "html" else F.concat(F.lit("'"), text.html_escape(shown), F.lit("'"))


def _quote(c: Column, flavour: str) -> Column:
    if flavour == "json":
        return text.json_quote(c)
    return text.py_quote(c) if flavour == "python" else c


def _name_literal(name: str, flavour: str) -> str:
    import json

    if flavour == "json":
        return json.dumps(name)
    if flavour == "python":
        return repr(name)
    return "'" + html.escape(name, quote=False) + "'"


def _mapping(features, config, row_key, seed, flavour) -> Column:
    q = '"' if flavour == "json" else "'"
    parts = []
    for f in features:
        t = [F.lit(f"{_name_literal(f.name, flavour)}: {{{q}value{q}: "), _literal(f, config, flavour)]
        for k, m in f.meta():
            shown = text.py_float(m)
            t += [F.lit(f", {q}{k}{q}: "), _json_number(shown) if flavour == "json" else shown]
        parts.append(F.concat(*t, F.lit("}")))
    body = F.concat_ws(", ", *_arranged(features, parts, config, row_key, seed))
    return F.concat(F.lit("{"), body, F.lit("}"))


def _dict_style(style, features, config, prefix, suffix, choices, context, row_key, seed) -> Column:
    flavour = {"pandas": "python", "json": "json"}.get(style, "html")
    chosen = _optional(choices_text(choices, style))
    if style == "pandas":
        chosen = text.py_quote(chosen)
    fields = [
        ("task_context", _quote(_optional(context), flavour)),
        ("prefix", _quote(_optional(prefix), flavour)),
        ("features", _mapping(features, config, row_key, seed, flavour)),
        ("suffix", _quote(_optional(suffix), flavour)),
        ("choices", chosen),
    ]
    if flavour != "html":
        cells = [F.concat(F.lit(_name_literal(k, flavour) + ": "), v) for k, v in fields]
        body = F.concat(F.lit("{"), F.concat_ws(", ", *cells), F.lit("}"))
        return F.concat(F.lit("pd.Series("), body, F.lit(")")) if style == "pandas" else body
    nl = "" if style == "html_compact" else "\n"
    pad = (lambda n: "") if style == "html_compact" else (lambda n: " " * n)

    def line(n, s):
        return pad(n) + s + nl

    head = (
        line(0, '<table border="1" class="dataframe">') + line(2, "<thead>")
        + line(4, '<tr style="text-align: right;">') + line(6, "<th></th>") + line(6, "<th>0</th>")
        + line(4, "</tr>") + line(2, "</thead>") + line(2, "<tbody>")
    )
    rows = [
        F.concat(
            F.lit(line(4, "<tr>") + line(6, f"<th>{k}</th>") + pad(6) + "<td>"),
            v if k == "features" else text.strip(text.html_escape(v)),
            F.lit("</td>" + nl + line(4, "</tr>")),
        )
        for k, v in fields
    ]
    return F.concat(F.lit(head), F.concat_ws("", *rows), F.lit(line(2, "</tbody>") + "</table>"))


# --- whole text ------------------------------------------------------------------------------

def serialize(
    features: list[Feature],
    config: SerializerConfig = SerializerConfig(),
    prefix="",
    suffix="",
    choices=None,
    context="",
    row_key: Column | None = None,
    seed=0,
    body: list[Column] | None = None,
) -> Column:
    """Text of one row. ``prefix``, ``suffix`` and ``context`` are strings or Columns, ``choices`` a
    list or an array Column. ``body`` replaces the texts made from ``features`` (sentence and marker
    styles only)."""
    if config.style not in STYLES:
        raise ValueError(f"unknown style: {config.style}")
    check_names([f.name for f in features], config.strict)
    if config.strict and config.style in ("basic", "basic_v2") and isinstance(suffix, str) and "." in suffix:
        raise ValueError("the suffix may not contain a full stop in strict mode")
    if config.feature_dropout > 0:
        if row_key is None:
            raise ValueError("feature dropout needs a row key")
        features = with_dropout(features, config.feature_dropout, row_key, seed)
    if config.style in ("pandas", "html", "html_compact", "json"):
        prefix, suffix, context = _as_col(prefix), _as_col(suffix), _as_col(context)
        return _dict_style(config.style, features, config, prefix, suffix, choices, context, row_key, seed)
    sep = " "
    chosen = None if choices is None else _optional(choices_text(choices, config.style))
    # Anything whose ends are not known when the plan is built may leave blanks at the ends.
    loose = any(not isinstance(x, str) or (x and not x.strip()) for x in (prefix, suffix, context))
    if config.style == "structured":
        sep = ""
        body = body or _structured_features(features, config, row_key, seed)
        body = [F.lit(STRUCTURE["example"][0]), *body, F.lit(STRUCTURE["example"][1])]
        prefix, suffix = (
            (a + c + b if c else "") if isinstance(c, str) else F.when(c != "", F.concat(F.lit(a), c, F.lit(b)))
            for (a, b), c in ((STRUCTURE["prefix"], prefix), (STRUCTURE["suffix"], suffix))
        )
    else:
        body = body or _basic_features(features, config, row_key, seed)
        if config.style == "basic" and chosen is not None:
            chosen = text.strip(chosen)
            loose = True
    front = [chosen] if config.choices_position in ("front", "both") else []
    back = [chosen] if config.choices_position in ("back", "both") else []
    parts = [_part(context), _part(prefix), *front, *body, _part(suffix), *back]
    whole = F.concat_ws(sep, *[p for p in parts if p is not None])
    return text.strip(whole) if loose else whole


def record_texts(features: Column, config: SerializerConfig, row_key: Column, seed=0) -> list[Column]:
    """Feature texts of a record (array of ordinal, name, kind, value) for ``serialize(body=...)``."""
    if config.style not in ("basic", "basic_v2", "structured"):
        raise ValueError(f"records have no {config.style} form")
    if config.feature_dropout > 0:
        features = F.filter(features, lambda f: hashing.exceeds(config.feature_dropout, seed, "drop", row_key, f["name"]))
    if config.shuffle_features:
        ranked = F.transform(features, lambda f: F.struct(hashing.digest(seed, "order", row_key, f["name"]).alias("k"), f.alias("f")))
        features = F.array_sort(ranked)["f"]
    (k0, k1), (v0, v1) = STRUCTURE["key"], STRUCTURE["value"]

    def valued(f):
        if config.max_precision is None:
            return f["value"]
        rounded = text.py_float(text.py_round(f["number"], config.max_precision))
        return F.when(f["kind"] == "float", rounded).otherwise(f["value"])

    def sentence(f):
        value = F.when(f["kind"].isin("text", "bytes"), text.tidy(f["value"])).otherwise(valued(f))
        return F.concat(F.lit("The "), f["name"], F.lit(" is "), value, F.lit("."))

    def marked(f):
        return F.concat(F.lit(k0), f["name"], F.lit(k1 + v0), f["value"], F.lit(v1))

    return [F.transform(features, marked if config.style == "structured" else sentence)]


# Extension point: a style is a function (features, config, **texts) -> Column.
CUSTOM: dict = {}


def register_style(name: str, build) -> None:
    """Adds a serializer: ``build`` takes the arguments of :func:`serialize` and returns a Column."""
    CUSTOM[name] = build


def serialize_with(style: str, features: list[Feature], **kw) -> Column:
    if style in CUSTOM:
        return CUSTOM[style](features, **kw)
    return serialize(features, config=kw.pop("config", SerializerConfig(style=style)), **kw)


# --- text back to values ---------------------------------------------------------------------

def deserialize_basic(c: Column, names: list[str], allow_missing: bool = False) -> Column:
    """map<name, value text> from the sentence styles, in order of appearance.

    A value reaches to the next name that occurs; the last one ends at the final full stop.
    """
    starts = []
    for n in names:
        mark = f"The {n} is"
        at = F.locate(mark, c)
        starts.append(
            F.struct(at.alias("at"), F.lit(n).alias("name"), F.lit(len(mark) + 1).cast("int").alias("skip"))
        )
    found = F.array_sort(F.filter(F.array(*starts), lambda s: s["at"] > 0))
    # Position of the last full stop, counted in characters.
    last_dot = F.length(c) - F.locate(".", F.reverse(c)) + 1
    nxt = F.concat(F.slice(found["at"], 2, len(names)), F.array(last_dot))
    spans = F.arrays_zip(found.alias("f"), nxt.alias("next"))

    def value(s, i):
        begin = s["f"]["at"] + s["f"]["skip"]
        raw = F.substring(c, begin, s["next"] - begin)
        # Any character followed by the blank before the next name is cut off.
        cut = F.when(F.endswith(raw, F.lit(" ")) & (F.length(raw) >= 2), F.substring(raw, F.lit(1), F.length(raw) - 2)).otherwise(raw)
        return F.struct(s["f"]["name"].alias("key"), F.when(i < F.size(found) - 1, cut).otherwise(raw).alias("value"))

    out = F.map_from_entries(F.transform(spans, value))
    if allow_missing:
        return out
    complete = F.size(found) == len(names)
    return F.when(complete, out).otherwise(F.raise_error(F.concat(F.lit("expected key not in example: "), c)))


def deserialize_structured(c: Column) -> Column:
    """map<name, value text> from the marker style; unequal marker counts are an error."""
    def count(tok):
        return (F.length(c) - F.length(F.replace(c, F.lit(tok), F.lit("")))) / F.lit(len(tok))

    counts = [count(t) for k in ("key", "value") for t in STRUCTURE[k]]
    same = (counts[0] == counts[1]) & (counts[0] == counts[2]) & (counts[0] == counts[3])

    def between(kind):
        a, b = (t.replace("|", "\\|") for t in STRUCTURE[kind])
        return F.regexp_extract_all(c, F.lit(f"(?s){a}(.*?){b}"), F.lit(1))

    out = F.map_from_arrays(between("key"), between("value"))
    return F.when(same, out).otherwise(F.raise_error(F.concat(F.lit("bad example: "), c)))


def deserialize_json(c: Column) -> Column:
    """map<name, struct> from the JSON style; values come back as text."""
    schema = "struct<features: map<string, struct<value: string, quantile: double, scale: double>>>"
    return F.from_json(c, schema, {"allowNonNumericNumbers": "true"})["features"]
