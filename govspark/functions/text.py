"""Globs, URNs, JSON, identifiers and type names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from govspark.fixed_values import UUID_NAMESPACE_DNS
from govspark.functions.time import iso_utc

# Private-use marks that stand for an open class, a negated class and a closing bracket.
_OPEN, _NEGATED, _CLOSE = "\ue000", "\ue001", "\ue002"
_OUTSIDE_CLASS = f"(?![^{_OPEN}{_NEGATED}]*{_CLOSE})"


def glob_regex(pattern: Column, star: str = ".*", one: str = ".") -> Column:
    """Anchored Java regex of a shell glob with ``*``, ``?``, ``[seq]`` and ``[!seq]``."""
    steps = [
        (r"([\\.^$+{}()|&~#])", r"\\$1"),
        (r"\[!(\]?+[^\]]*)\]", f"{_NEGATED}$1{_CLOSE}"),
        (r"\[(\]?+[^\]]*)\]", f"{_OPEN}$1{_CLOSE}"),
        (r"\[", r"\\["),
        (r"\]", r"\\]"),
        (rf"\*+{_OUTSIDE_CLASS}", star),
        (rf"\?{_OUTSIDE_CLASS}", one),
        (_NEGATED, "[^"),
        (_OPEN, "["),
        (_CLOSE, "]"),
    ]
    regex = pattern
    for find, replacement in steps:
        regex = F.regexp_replace(regex, F.lit(find), F.lit(replacement))
    return F.concat(F.lit(r"\A(?s:"), regex, F.lit(r")\z"))


def glob_match(text: Column, pattern: Column) -> Column:
    return F.rlike(text, glob_regex(pattern))


def segment_glob_match(text: Column, pattern: Column) -> Column:
    """Glob in which ``*`` and ``?`` stop at a colon."""
    return F.rlike(text, glob_regex(pattern, star="[^:]*", one="[^:]"))


def any_glob(text: Column, patterns: list[str]) -> Column:
    """True when any of a fixed list of globs matches."""
    hit = F.lit(False)
    for pattern in patterns:
        hit = hit | glob_match(text, F.lit(pattern))
    return hit


def urn_last(urn: Column) -> Column:
    return F.substring_index(urn, ":", -1)


def urn_segment(urn: Column, position: int, default: str = "unknown") -> Column:
    """Zero-based segment of a URN, or the default when it has too few."""
    return F.coalesce(F.get(F.split(urn, ":"), F.lit(position)), F.lit(default))


def workspace_id(host: Column) -> Column:
    """First label of a host name, without scheme, port or path."""
    return F.regexp_extract(host, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*://)?([^/:.]*)", 1)


def json_text(document: Column, path: str) -> Column:
    return F.get_json_object(document, path)


def canonical_json_text(document: Column) -> Column:
    """JSON text with keys sorted at every level and no blanks; null when it is not JSON."""
    return F.to_json(F.try_parse_json(document))


def _canonical(value: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, T.StructType):
        fields = sorted(dtype.fields, key=lambda field: field.name)
        body = F.struct(*[_canonical(value[f.name], f.dataType).alias(f.name) for f in fields])
        return F.when(value.isNotNull(), body)
    if isinstance(dtype, T.ArrayType):
        return F.transform(value, lambda item: _canonical(item, dtype.elementType))
    if isinstance(dtype, T.MapType):
        return F.map_from_entries(F.array_sort(F.map_entries(value)))
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return iso_utc(value)
    return value


def canonical_json(value: Column, dtype: T.DataType, keep_nulls: bool = True) -> Column:
    """Compact JSON of a struct, array or map with sorted keys at every depth."""
    return F.to_json(_canonical(value, dtype), {"ignoreNullFields": "false" if keep_nulls else "true"})


def content_hash(document: Column, tag: str = "gov", version: int = 1) -> Column:
    """Short change marker ``<tag>:v<version>:<8 hex>`` of canonical JSON text."""
    return F.concat(F.lit(f"{tag}:v{version}:"), F.substring(F.sha2(document, 256), 1, 8))


def uuid5_dns(text: Column) -> Column:
    """Name-based (SHA-1) UUID in the DNS namespace."""
    digest = F.sha1(F.concat(F.unhex(F.lit(UUID_NAMESPACE_DNS)), F.encode(text, "UTF-8")))
    nibble = F.conv(F.substring(digest, 17, 1), 16, 10).cast("int")
    variant = F.lower(F.hex(nibble.bitwiseAND(F.lit(3)).bitwiseOR(F.lit(8))))
    return F.concat_ws(
        "-",
        F.substring(digest, 1, 8),
        F.substring(digest, 9, 4),
        F.concat(F.lit("5"), F.substring(digest, 14, 3)),
        F.concat(variant, F.substring(digest, 18, 3)),
        F.substring(digest, 21, 12),
    )


# Substring tests in the order they are tried, with the Spark name each gives.
_SCALAR_TYPE_RULES = [
    (["VARCHAR", "TEXT", "CHAR", "CLOB", "STRING"], "STRING"),
    (["BIGINT", "INT8", "LONG"], "BIGINT"),
    (["SMALLINT", "INT2"], "SMALLINT"),
    (["TINYINT", "INT1", "BYTE"], "TINYINT"),
    (["INT"], "INT"),
    (["DECIMAL", "NUMERIC", "NUMBER"], "DECIMAL"),
    (["DOUBLE", "FLOAT8"], "DOUBLE"),
    (["FLOAT", "REAL"], "FLOAT"),
    (["BOOL"], "BOOLEAN"),
    (["TIMESTAMP"], "TIMESTAMP"),
    (["DATE"], "DATE"),
    (["TIME"], "STRING"),
    (["INTERVAL"], "INTERVAL"),
    (["BINARY", "BLOB", "BYTES"], "BINARY"),
]


def _scalar_arms() -> str:
    arms = ["WHEN u = '' THEN 'STRING'"]
    for parts, spark_name in _SCALAR_TYPE_RULES:
        value = f"'{spark_name}'"
        if spark_name == "DECIMAL":
            value = r"concat('DECIMAL', regexp_extract(u, r'(\([\d,\s]+\))', 1))"
        elif spark_name == "TIMESTAMP":
            value = "CASE WHEN u RLIKE 'NTZ|WITHOUT' THEN 'TIMESTAMP_NTZ' ELSE 'TIMESTAMP' END"
        arms.append(f"WHEN u RLIKE '{'|'.join(parts)}' THEN {value}")
    return " ".join(arms)


_SCALARS = "|".join(part for parts, _ in _SCALAR_TYPE_RULES for part in parts)


def _type_sql(name: str, maps: bool = True) -> str:
    """Peels one ARRAY or MAP after the other off the name, as many as it has; what surrounds the rest is kept in ``pre`` and ``post``."""
    raw = f"trim(coalesce({name}, ''))"
    inner = "regexp_extract(s.rest, '<(.+)>$', 1)"
    state = lambda pre, rest, post: f"named_struct('pre', {pre}, 'rest', trim({rest}), 'post', {post})"
    known = f"upper(s.rest) = '' OR upper(s.rest) RLIKE '{_SCALARS}'"
    arms = [
        f"WHEN {known} THEN s",
        f"WHEN upper(s.rest) LIKE 'ARRAY%' THEN {state("concat(s.pre, 'ARRAY<')", inner, "concat('>', s.post)")}",
    ]
    if maps:
        key = _type_sql(f"substring_index({inner}, ',', 1)", maps=False)
        value = f"regexp_extract({inner}, '^[^,]*,(.*)$', 1)"
        opened = state(f"concat(s.pre, 'MAP<', {key}, ',')", value, "concat('>', s.post)")
        arms.append(f"WHEN upper(s.rest) LIKE 'MAP%' AND contains({inner}, ',') THEN {opened}")
    arms.append(f"WHEN upper(s.rest) LIKE 'MAP%' THEN {state("concat(s.pre, 'MAP<STRING,')", "'STRING'", "concat('>', s.post)")}")
    levels = f"sequence(0, length({raw}) - length(replace({raw}, '<', '')))"
    peeled = f"aggregate({levels}, {state("''", raw, "''")}, (s, i) -> CASE {' '.join(arms)} ELSE s END)"
    rest = f"CASE {_scalar_arms()} WHEN startswith(u, 'STRUCT') THEN u WHEN u RLIKE 'VARIANT|JSON' THEN 'STRING' ELSE u END"
    last = f"transform(array(upper(p.rest)), u -> {rest})[0]"
    return f"transform(array({peeled}), p -> concat(p.pre, {last}, p.post))[0]"


def normalize_type(name: str) -> Column:
    """Spark SQL type name for a warehouse type name, given as a column name or SQL text; ARRAY and MAP are followed to any depth."""
    return F.expr(_type_sql(name))
