"""PostgreSQL-flavoured functions as Spark SQL expressions.

Each entry takes the Spark texts of its arguments and gives the text of an expression that
stays inside whole-stage code generation. Functions that Spark has under the same name with
the same meaning need no entry.
"""

from __future__ import annotations

import re
from collections.abc import Callable

Args = list[str]


def _same(name: str) -> Callable[[Args], str]:
    return lambda a: f"{name}({', '.join(a)})"


def _trim(one: str, side: str) -> Callable[[Args], str]:
    return lambda a: f"{one}({a[0]})" if len(a) == 1 else f"trim({side} {a[1]} FROM {a[0]})"


def _series(a: Args, inclusive: bool = True) -> str:
    start, stop, step = (["0", *a] if len(a) == 1 else a)[0], a[0] if len(a) == 1 else a[1], a[2] if len(a) > 2 else "1"
    reach = ">=" if inclusive else ">"
    end = stop if inclusive else f"({stop}) - sign({step})"
    whole = f"sequence({start}, CAST({end} AS bigint), {step})" if not inclusive else f"sequence({start}, {stop}, {step})"
    if "interval" in step.lower():
        return whole
    return f"if((({stop}) - ({start})) * sign({step}) {reach} 0, {whole}, array())"


def _part(a: Args) -> str:
    field = a[0].strip("'").lower()
    if field in ("dow", "dayofweek"):
        return f"CAST(dayofweek({a[1]}) - 1 AS double)"
    if field == "epoch":
        return f"(unix_micros(CAST({a[1]} AS timestamp)) / 1000000D)"
    if field in ("millisecond", "milliseconds", "ms"):
        return f"CAST(date_part('second', {a[1]}) * 1000 AS double)"
    if field in ("microsecond", "microseconds", "us"):
        return f"CAST(date_part('second', {a[1]}) * 1000000 AS double)"
    if field == "isodow":
        return f"CAST(weekday({a[1]}) + 1 AS double)"
    return f"CAST(date_part({a[0]}, {a[1]}) AS double)"


def _left(a: Args) -> str:
    return f"if(({a[1]}) >= 0, left({a[0]}, {a[1]}), left({a[0]}, greatest(char_length({a[0]}) + ({a[1]}), 0)))"


def _right(a: Args) -> str:
    return f"if(({a[1]}) >= 0, right({a[0]}, {a[1]}), right({a[0]}, greatest(char_length({a[0]}) + ({a[1]}), 0)))"


def _substr(a: Args) -> str:
    if len(a) == 2:
        return f"substring({a[0]}, greatest(({a[1]}), 1))"
    return f"substring({a[0]}, greatest(({a[1]}), 1), greatest(({a[1]}) + ({a[2]}) - greatest(({a[1]}), 1), 0))"


def _replace(a: Args) -> str:
    flags = a[3].strip("'") if len(a) > 3 else ""
    pattern = f"concat('(?i)', {a[1]})" if "i" in flags else a[1]
    if "g" in flags:
        return f"regexp_replace({a[0]}, {pattern}, {_group_refs(a[2])})"
    # only the first match: what stands before it, its replacement, what follows
    at, hit = f"regexp_instr({a[0]}, {pattern})", f"regexp_substr({a[0]}, {pattern})"
    return f"if({at} = 0, {a[0]}, concat(left({a[0]}, {at} - 1), regexp_replace({hit}, {pattern}, {_group_refs(a[2])}), substring({a[0]}, {at} + char_length({hit}))))"


def _group_refs(text: str) -> str:
    return re.sub(r"\\\\(\d)", r"$\1", text)


def _match(a: Args) -> str:
    text = a[1]
    groups = text.replace("\\\\(", "").count("(") - text.count("(?:") - text.count("(?i")
    parts = ", ".join(f"regexp_extract({a[0]}, {text}, {i})" for i in (range(1, groups + 1) if groups > 0 else [0]))
    return f"if(regexp_like({a[0]}, {text}), array({parts}), null)"


def _gcd(a: Args) -> str:
    x, y = f"abs(CAST({a[0]} AS bigint))", f"abs(CAST({a[1]} AS bigint))"
    # Euclid's steps; 92 are enough for any two 64-bit numbers
    return f"aggregate(sequence(1, 92), named_struct('a', {x}, 'b', {y}), (s, i) -> if(s.b = 0, s, named_struct('a', s.b, 'b', s.a % s.b)), s -> s.a)"


def _digest(a: Args) -> str:
    kind = a[1].strip("'").lower()
    if kind == "md5":
        return f"unhex(md5({a[0]}))"
    if kind in ("sha224", "sha256", "sha384", "sha512"):
        return f"unhex(sha2({a[0]}, {kind[3:]}))"
    if kind in ("blake2b", "blake2s", "blake3"):
        return f"pg_{kind}(CAST({a[0]} AS binary))"
    raise ValueError(f"digest algorithm {kind} has no built-in")


def _encode(a: Args) -> str:
    kind = a[1].strip("'").lower()
    return f"lower(hex({a[0]}))" if kind == "hex" else f"base64(CAST({a[0]} AS binary))"


def _decode(a: Args) -> str:
    kind = a[1].strip("'").lower()
    return f"unhex({a[0]})" if kind == "hex" else f"unbase64({a[0]})"


_BIN_UNITS = {"microsecond": 1, "millisecond": 1000, "second": 10**6, "minute": 60 * 10**6, "hour": 3600 * 10**6, "day": 86400 * 10**6, "week": 7 * 86400 * 10**6}


def _date_bin(a: Args) -> str:
    words = a[0].lower().replace("interval", "").strip(" '").split()
    width = int(words[0]) * _BIN_UNITS[words[1].rstrip("s'")]
    at = f"unix_micros(CAST({a[1]} AS timestamp))"
    origin = f"unix_micros(CAST({a[2]} AS timestamp))" if len(a) > 2 else "0"
    return f"CAST(timestamp_micros({at} - pmod({at} - {origin}, {width})) AS timestamp_ntz)"


_TYPES = {"Int8": "tinyint", "Int16": "smallint", "Int32": "int", "Int64": "bigint", "UInt8": "smallint", "UInt16": "int", "UInt32": "bigint", "UInt64": "decimal(20,0)", "Float32": "float", "Float64": "double", "Utf8": "string", "LargeUtf8": "string", "Binary": "binary", "Boolean": "boolean", "Date32": "date"}


def _arrow_cast(a: Args) -> str:
    name = a[1].strip("'")
    kind = "timestamp_ntz" if name.startswith("Timestamp") else name.lower().replace("decimal128", "decimal") if name.startswith("Decimal") else _TYPES[name]
    return f"CAST({a[0]} AS {kind})"


def _arrow_typeof(a: Args) -> str:
    pairs = ", ".join(f"'{spark}', '{arrow}'" for arrow, spark in _TYPES.items() if arrow not in ("UInt8", "UInt16", "UInt32", "LargeUtf8"))
    return f"coalesce(try_element_at(map({pairs}), typeof({a[0]})), typeof({a[0]}))"


def _whole(name: str) -> Callable[[Args], str]:
    # from 2^53 on every DOUBLE is whole, and what is not finite stays as it is
    return lambda a: f"if(abs({a[0]}) >= 9007199254740992, CAST({a[0]} AS double), CAST({name}({a[0]}) AS double))"


def _trunc(a: Args) -> str:
    scaled = f"(({a[0]}) * power(10, {a[1]}))" if len(a) > 1 else f"({a[0]})"
    cut = f"CAST(if({scaled} < 0, ceil({scaled}), floor({scaled})) AS double)"
    back = f"({cut} / power(10, {a[1]}))" if len(a) > 1 else cut
    return f"if(abs{scaled} >= 9007199254740992, CAST({a[0]} AS double), {back})"


def _initcap(a: Args) -> str:
    # every run of letters and digits is a word
    return f"array_join(transform(regexp_extract_all({a[0]}, '[\\\\p{{L}}\\\\p{{N}}]+|[^\\\\p{{L}}\\\\p{{N}}]+', 0), w -> concat(upper(left(w, 1)), lower(substring(w, 2)))), '')"


def _chrono(text: str) -> str:
    for old, new in (("%Y", "yyyy"), ("%m", "MM"), ("%d", "dd"), ("%H", "HH"), ("%M", "mm"), ("%S", "ss"), ("%y", "yy"), ("%b", "MMM"), ("%B", "MMMM"), ("%a", "EEE"), ("%A", "EEEE"), ("%j", "DDD"), ("%p", "a"), ("%I", "hh"), ("%F", "yyyy-MM-dd"), ("%T", "HH:mm:ss"), ("YYYY", "yyyy"), ("DD", "dd"), ("HH24", "HH"), ("MI", "mm"), ("SS", "ss")):
        text = text.replace(old, new)
    return text


def _remove_n(a: Args, n: str) -> str:
    seen = f"size(filter(slice({a[0]}, 1, i + 1), y -> y = {a[1]}))"
    return f"filter({a[0]}, (x, i) -> NOT coalesce(x = {a[1]}, false) OR {seen} > {n})"


def _replace_n(a: Args, n: str) -> str:
    seen = f"size(filter(slice({a[0]}, 1, i + 1), y -> y = {a[1]}))"
    return f"transform({a[0]}, (x, i) -> if(coalesce(x = {a[1]}, false) AND {seen} <= {n}, {a[2]}, x))"


def _slice(a: Args) -> str:
    return f"slice({a[0]}, {a[1]}, greatest(least({a[2]}, size({a[0]})) - ({a[1]}) + 1, 0))"


def _positions(a: Args) -> str:
    return f"filter(transform({a[0]}, (x, i) -> if(x = {a[1]}, CAST(i + 1 AS bigint), null)), x -> x IS NOT NULL)"


def _resize(a: Args) -> str:
    fill = a[2] if len(a) > 2 else "null"
    return f"slice(concat({a[0]}, array_repeat({fill}, greatest(({a[1]}) - size({a[0]}), 0))), 1, {a[1]})"


#: name (lower case) -> builder. The first block of each group changes meaning, the rest names.
SCALAR: dict[str, Callable[[Args], str]] = {
    # math
    "ceil": _whole("ceil"),
    "ceiling": _whole("ceil"),
    "floor": _whole("floor"),
    "log": lambda a: f"log10({a[0]})" if len(a) == 1 else f"log({a[0]}, {a[1]})",
    "trunc": _trunc,
    "gcd": _gcd,
    "lcm": lambda a: f"if(({a[0]}) = 0 OR ({a[1]}) = 0, 0L, abs(({a[0]}) * ({a[1]})) div {_gcd(a)})",
    "iszero": lambda a: f"(({a[0]}) = 0)",
    "random": lambda a: "rand()",
    # string
    "chr": lambda a: f"decode(unhex(lpad(hex({a[0]}), 8, '0')), 'UTF-32')",
    "initcap": _initcap,
    "concat": lambda a: "concat(" + ", ".join(f"coalesce(CAST({x} AS string), '')" for x in a) + ")",
    "btrim": _trim("trim", "BOTH"),
    "ltrim": _trim("ltrim", "LEADING"),
    "rtrim": _trim("rtrim", "TRAILING"),
    "to_hex": lambda a: f"lower(hex({a[0]}))",
    "ends_with": _same("endswith"),
    "starts_with": _same("startswith"),
    "uuid": lambda a: "uuid()",
    "left": _left,
    "right": _right,
    "strpos": lambda a: f"instr({a[0]}, {a[1]})",
    "substr": _substr,
    "substring": _substr,
    "substr_index": _same("substring_index"),
    "length": _same("char_length"),
    "lpad": lambda a: f"lpad({a[0]}, {a[1]}, {a[2] if len(a) > 2 else repr(' ')})",
    "rpad": lambda a: f"rpad({a[0]}, {a[1]}, {a[2] if len(a) > 2 else repr(' ')})",
    # regular expressions
    "regexp_match": _match,
    "regexp_replace": _replace,
    "regexp_like": lambda a: f"regexp_like({a[0]}, {a[1]})" if len(a) == 2 else f"regexp_like({a[0]}, concat('(?', {a[2]}, ')', {a[1]}))",
    "regexp_count": lambda a: f"regexp_count({a[0]}, {a[1]})" if len(a) == 2 else f"regexp_count(substring({a[0]}, {a[2]}), {a[1]})",
    # hash and encoding
    "sha224": lambda a: f"sha2({a[0]}, 224)",
    "sha256": lambda a: f"sha2({a[0]}, 256)",
    "sha384": lambda a: f"sha2({a[0]}, 384)",
    "sha512": lambda a: f"sha2({a[0]}, 512)",
    "digest": _digest,
    "encode": _encode,
    "decode": _decode,
    # core
    "arrow_cast": _arrow_cast,
    "arrow_typeof": _arrow_typeof,
    "row": _same("struct"),
    "get_field": lambda a: f"({a[0]})[{a[1]}]",
    # date and time
    "date_bin": _date_bin,
    "date_part": _part,
    "datepart": _part,
    "date_trunc": lambda a: f"CAST(date_trunc({a[0]}, {a[1]}) AS timestamp_ntz)",
    "from_unixtime": lambda a: f"CAST(timestamp_seconds({a[0]}) AS timestamp_ntz)",
    "to_char": lambda a: f"date_format({a[0]}, {_chrono(a[1])})",
    "date_format": lambda a: f"date_format({a[0]}, {_chrono(a[1])})",
    "to_date": lambda a: f"to_date({a[0]})" if len(a) == 1 else f"to_date({a[0]}, {_chrono(a[1])})",
    "to_timestamp": lambda a: f"CAST(timestamp_seconds({a[0]}) AS timestamp_ntz)" if a[0].replace(".", "").isdigit() else f"to_timestamp_ntz({a[0]})" if len(a) == 1 else f"to_timestamp_ntz({a[0]}, {_chrono(a[1])})",
    "to_timestamp_seconds": lambda a: f"CAST(timestamp_seconds({a[0]}) AS timestamp_ntz)",
    "to_timestamp_millis": lambda a: f"CAST(timestamp_millis({a[0]}) AS timestamp_ntz)",
    "to_timestamp_micros": lambda a: f"CAST(timestamp_micros({a[0]}) AS timestamp_ntz)",
    "to_unixtime": lambda a: f"unix_seconds(CAST({a[0]} AS timestamp))",
    "to_local_time": lambda a: f"CAST({a[0]} AS timestamp_ntz)",
    # arrays
    "make_array": _same("array"),
    "make_list": _same("array"),
    "array_prepend": lambda a: f"array_prepend({a[1]}, {a[0]})",
    "array_push_front": lambda a: f"array_prepend({a[1]}, {a[0]})",
    "array_push_back": _same("array_append"),
    "array_concat": _same("concat"),
    "array_cat": _same("concat"),
    "array_element": lambda a: f"try_element_at({a[0]}, {a[1]})",
    "array_extract": lambda a: f"try_element_at({a[0]}, {a[1]})",
    "array_slice": _slice,
    "array_has": _same("array_contains"),
    "array_has_any": _same("arrays_overlap"),
    "array_has_all": lambda a: f"(size(array_except({a[1]}, {a[0]})) = 0)",
    "array_length": lambda a: f"CAST(size({a[0]}) AS bigint)",
    "cardinality": lambda a: f"CAST(size({a[0]}) AS bigint)",
    "array_position": lambda a: f"nullif(array_position({a[0]}, {a[1]}), 0)",
    "array_positions": _positions,
    "array_remove": lambda a: _remove_n(a, "1"),
    "array_remove_n": lambda a: _remove_n(a, a[2]),
    "array_remove_all": _same("array_remove"),
    "array_repeat": lambda a: f"array_repeat({a[0]}, {a[1]})",
    "array_replace": lambda a: _replace_n(a, "1"),
    "array_replace_n": lambda a: _replace_n(a, a[3]),
    "array_replace_all": lambda a: f"transform({a[0]}, x -> if(coalesce(x = {a[1]}, false), {a[2]}, x))",
    "array_resize": _resize,
    "array_reverse": _same("reverse"),
    "array_sort": lambda a: f"sort_array({a[0]})" if len(a) == 1 else f"sort_array({a[0]}, {'false' if a[1].strip(chr(39)).upper() == 'DESC' else 'true'})",
    "array_pop_back": lambda a: f"slice({a[0]}, 1, greatest(size({a[0]}) - 1, 0))",
    "array_pop_front": lambda a: f"slice({a[0]}, 2, greatest(size({a[0]}) - 1, 0))",
    "array_to_string": lambda a: f"array_join({', '.join(a)})",
    "string_to_array": lambda a: f"split({a[0]}, concat('\\\\Q', {a[1]}, '\\\\E'))",
    "range": lambda a: _series(a, inclusive=False),
    "empty": lambda a: f"(size({a[0]}) = 0)",
    "array_empty": lambda a: f"(size({a[0]}) = 0)",
    "array_distance": lambda a: f"sqrt(aggregate(zip_with({a[0]}, {a[1]}, (x, y) -> CAST((x - y) * (x - y) AS double)), 0D, (s, x) -> s + x))",
    "unnest": _same("explode"),
    # maps
    "map_extract": lambda a: f"array(try_element_at({a[0]}, {a[1]}))",
    "element_at": lambda a: f"try_element_at({a[0]}, {a[1]})",
    # aggregates
    "mean": _same("avg"),
    "median": _same("median"),
    "approx_distinct": _same("approx_count_distinct"),
    "approx_median": lambda a: f"percentile_approx({a[0]}, 0.5)",
    "approx_percentile_cont": lambda a: f"percentile_approx({', '.join(a)})",
    "approx_percentile_cont_with_weight": lambda a: f"percentile({a[0]}, {a[2]}, {a[1]})",
    "string_agg": lambda a: f"listagg({', '.join(a)})",
    "var": _same("var_samp"),
    "covar": _same("covar_samp"),
    "array_agg": lambda a: f"transform(collect_list(named_struct('v', {a[0]})), s -> s.v)",
}
for _name in [n for n in SCALAR if n.startswith("array_")]:
    SCALAR.setdefault("list_" + _name[6:], SCALAR[_name])


def expression(name: str, args: Args) -> str:
    """The Spark text of a call; unknown names are passed on."""
    build = SCALAR.get(name.lower())
    return build(args) if build else f"{name}({', '.join(args)})"
