"""Functions whose names or arguments differ between SQL dialects."""

from __future__ import annotations

import re

#: Same arguments, another name in Spark.
RENAMED = {
    "approx_distinct": "approx_count_distinct",
    "approx_percentile_cont": "approx_percentile",
    "approx_median": "median",
    "array_has": "array_contains",
    "array_length": "size",
    "array_to_string": "array_join",
    "arrow_typeof": "typeof",
    "character_length": "char_length",
    "datetrunc": "date_trunc",
    "list_contains": "array_contains",
    "list_distinct": "array_distinct",
    "list_has": "array_contains",
    "list_length": "size",
    "list_sort": "sort_array",
    "make_array": "array",
    "make_list": "array",
    "named_struct": "named_struct",
    "random": "rand",
    "starts_with": "startswith",
    "ends_with": "endswith",
    "stddev_population": "stddev_pop",
    "string_to_array": "split",
    "to_timestamp_seconds": "timestamp_seconds",
    "to_timestamp_millis": "timestamp_millis",
    "to_timestamp_micros": "timestamp_micros",
    "unnest": "explode",
}
_ORDER = re.compile(r"(?is)^(.*?)\s+ORDER\s+BY\s+(.*)$")


def _ordered(arguments: list[str]) -> tuple[list[str], str | None]:
    """Arguments without the ORDER BY that ends them, and its key."""
    for i, a in enumerate(arguments):
        m = _ORDER.match(a)
        if m:
            return [*arguments[:i], m[1]], ", ".join([m[2], *arguments[i + 1 :]])
    return arguments, None


def _sorted_values(value: str, key: str) -> str:
    descending = bool(re.search(r"(?i)\bDESC\b", key))
    key = re.sub(r"(?is)\s+(ASC|DESC)?\s*(NULLS\s+(FIRST|LAST))?\s*$", "", key)
    if "," in key and not key.endswith(")"):
        raise ValueError("an aggregate's ORDER BY takes one key")
    return f"transform(sort_array(array_agg(struct(({key}) AS k, ({value}) AS v)), {str(not descending).lower()}), s -> s.v)"


def _array_agg(arguments, windowed, before):
    arguments, key = _ordered(arguments)
    return _sorted_values(arguments[0], key) if key else None


def _string_agg(arguments, windowed, before):
    arguments, key = _ordered(arguments)
    return f"listagg({', '.join(arguments)})" + (f" WITHIN GROUP (ORDER BY {key})" if key else "")


def _nth_value(arguments, windowed, before):
    if windowed:
        return None
    arguments, key = _ordered(arguments)
    values = _sorted_values(arguments[0], key) if key else f"array_agg({arguments[0]})"
    return f"get({values}, ({arguments[1]}) - 1)"


def _first(position: int):
    def call(arguments, windowed, before):
        arguments, key = _ordered(arguments)
        return f"element_at({_sorted_values(arguments[0], key)}, {position})" if key and not windowed else None

    return call


def _sha(bits: int):
    return lambda a, windowed, before: f"unhex(sha2({a[0]}, {bits}))"


def _date_bin(a, windowed, before):
    width = re.sub(r"(?i)^\s*interval\s*", "", a[0]).strip()
    if not width.startswith("'"):
        width = f"'{width}'"
    origin = f", {width}, concat(cast(pmod(unix_micros(cast({a[2]} AS timestamp)), 86400000000) AS string), ' microseconds')" if len(a) > 2 else ""
    return f"window({a[1]}, {width}{origin}).start"


def _series(a, windowed, before):
    if before not in ("FROM", "JOIN", ","):
        return f"sequence({', '.join(a)})"
    return f"(SELECT explode(sequence({', '.join(a)})) AS value)"


#: Calls that become another expression: (arguments, whether OVER, WITHIN or FILTER follows, the word before).
CALLS = {
    "array_agg": _array_agg,
    "date_bin": _date_bin,
    "first_value": _first(1),
    "generate_series": _series,
    "last_value": _first(-1),
    "list_element": lambda a, w, b: f"element_at({a[0]}, {a[1]})",
    "array_element": lambda a, w, b: f"element_at({a[0]}, {a[1]})",
    "nth_value": _nth_value,
    "regexp_match": lambda a, w, b: f"regexp_extract_all({a[0]}, {a[1]}, 0)",
    "sha224": _sha(224),
    "sha256": _sha(256),
    "sha384": _sha(384),
    "sha512": _sha(512),
    "string_agg": _string_agg,
    "strpos": lambda a, w, b: f"locate({a[1]}, {a[0]})",
    "instr": lambda a, w, b: f"locate({a[1]}, {a[0]})",
    "to_hex": lambda a, w, b: f"lower(hex({a[0]}))",
    "trunc": lambda a, w, b: f"(sign({a[0]}) * floor(abs({a[0]})))" if len(a) == 1 else None,
}
