"""PostgreSQL scalar functions whose results differ from Spark's built-ins of the same name.

Everything is built from built-in expressions, so that it stays inside whole-stage
code generation. Functions that agree with Spark's (``abs``, ``lower``, ``coalesce`` and
so on) are used directly and are not repeated here; ``SAME`` lists them.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: PostgreSQL names that mean the same in Spark SQL.
SAME = tuple(
    "abs acos acosh asin asinh atan atan2 atanh cbrt ceil ceiling cos cosh cot degrees exp floor ln log10 mod pi power radians sign sin sinh sqrt tan tanh "
    "ascii bit_length btrim char_length character_length concat_ws length lower lpad md5 octet_length overlay position repeat replace reverse rpad split_part translate trim upper "
    "regexp_count regexp_substr current_time current_timestamp localtimestamp make_date make_time now array_append array_prepend array_remove "
    "avg bit_and bit_or bit_xor bool_and bool_or corr count covar_pop covar_samp every max min mode percentile_cont percentile_disc regr_avgx regr_avgy regr_count regr_intercept "
    "regr_r2 regr_slope regr_sxx regr_sxy regr_syy stddev stddev_pop stddev_samp sum var_pop var_samp variance grouping row_number rank dense_rank percent_rank cume_dist ntile "
    "lag lead first_value last_value nth_value coalesce greatest least nullif width_bucket factorial".split()
)


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


# Arithmetic


def int_div(a, b) -> Column:
    """Integer division truncates toward zero; a zero divisor is an error."""
    return F.call_function("div", _c(a).cast("bigint"), _c(b).cast("bigint"))


def pg_round(x, digits: int | None = None) -> Column:
    """Doubles round half to even, as do their integers; numerics (with digits) half up."""
    return F.rint(_c(x)) if digits is None else F.round(_c(x), digits)


def trunc(x, digits: int = 0) -> Column:
    """Cut off toward zero at so many decimal places."""
    scale = F.lit(10.0**digits)
    x = _c(x)
    return F.when(x < 0, F.ceil(x * scale)).otherwise(F.floor(x * scale)).cast("double") / scale


def log(x, base=None) -> Column:
    """One argument: base 10. Two, ``log(base, x)`` there: the given base."""
    return F.log10(_c(x)) if base is None else F.ln(_c(x)) / F.ln(_c(base))


def pg_sqrt(x) -> Column:
    """As sqrt; a negative argument is an error."""
    x = _c(x)
    return F.when(x < 0, F.raise_error(F.lit("cannot take square root of a negative number"))).otherwise(F.sqrt(x))


def sind(x) -> Column:
    return F.sin(F.radians(_c(x)))


def cosd(x) -> Column:
    return F.cos(F.radians(_c(x)))


def tand(x) -> Column:
    return F.tan(F.radians(_c(x)))


def cotd(x) -> Column:
    return F.cot(F.radians(_c(x)))


def asind(x) -> Column:
    return F.degrees(F.asin(_c(x)))


def acosd(x) -> Column:
    return F.degrees(F.acos(_c(x)))


def atand(x) -> Column:
    return F.degrees(F.atan(_c(x)))


def atan2d(y, x) -> Column:
    return F.degrees(F.atan2(_c(y), _c(x)))


def gcd(a, b, steps: int = 93) -> Column:
    """Euclid's algorithm as a fold; no pair of 64-bit numbers needs more steps."""
    start = F.struct(F.abs(_c(a).cast("bigint")).alias("x"), F.abs(_c(b).cast("bigint")).alias("y"))
    step = lambda s, _: F.when(s["y"] == 0, s).otherwise(F.struct(s["y"].alias("x"), (s["x"] % F.when(s["y"] == 0, F.lit(1)).otherwise(s["y"])).alias("y")))
    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step, lambda s: s["x"])


def lcm(a, b) -> Column:
    a, b = _c(a).cast("bigint"), _c(b).cast("bigint")
    return F.when((a == 0) | (b == 0), F.lit(0).cast("bigint")).otherwise(F.abs(int_div(a, gcd(a, b)) * b))


def erf(x) -> Column:
    """Error function: the Maclaurin series near 0, a continued fraction beyond; about 1e-13."""
    x = _c(x).cast("double")
    a = F.abs(x)
    near = F.aggregate(F.sequence(F.lit(1), F.lit(60)), F.struct(x.alias("t"), x.alias("s")), lambda s, n: F.struct((s["t"] * -x * x / n).alias("t"), (s["s"] + s["t"] * -x * x / n / (2 * n + 1)).alias("s")), lambda s: s["s"] * (2 / 3.141592653589793**0.5))
    far = F.aggregate(F.sequence(F.lit(80), F.lit(1), F.lit(-1)), F.lit(0.0), lambda s, n: (n / F.lit(2.0)) / (a + s), lambda s: F.exp(-a * a) / ((a + s) * 3.141592653589793**0.5))
    return F.when(a < 2.5, near).otherwise(F.sign(x) * (1 - far))


def erfc(x) -> Column:
    return 1 - erf(x)


_LANCZOS = (0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059, 12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7)


def lgamma(x) -> Column:
    """Logarithm of the absolute gamma function (Lanczos, reflected below one half)."""
    x = _c(x).cast("double")

    def upper(z: Column) -> Column:
        z = z - 1
        series = sum((F.lit(c) / (z + i) for i, c in enumerate(_LANCZOS[1:], 1)), F.lit(_LANCZOS[0]))
        t = z + 7.5
        return F.lit(0.9189385332046727) + (z + 0.5) * F.ln(t) - t + F.ln(series)

    return F.when(x < 0.5, F.ln(F.pi() / F.abs(F.sin(F.pi() * x))) - upper(1 - x)).otherwise(upper(x))


def gamma(x) -> Column:
    x = _c(x).cast("double")
    sign = F.when((x < 0) & (F.pmod(F.floor(x), F.lit(2)) != 0), -1.0).otherwise(1.0)
    return sign * F.exp(lgamma(x))


def scale(x) -> Column:
    """Digits after the point of a number's text form."""
    text = _c(x).cast("string")
    return F.when(F.instr(text, ".") > 0, F.length(text) - F.instr(text, ".")).otherwise(0)


def trim_scale(x) -> Column:
    """The text form without zeros at the end of its fraction."""
    text = _c(x).cast("string")
    return F.when(F.instr(text, ".") > 0, F.regexp_replace(text, r"\.?0+$", "")).otherwise(text)


def min_scale(x) -> Column:
    return scale(trim_scale(x))


def random_between(low: int, high: int, seed: int) -> Column:
    return (F.lit(low) + F.floor(F.rand(seed) * (high - low + 1))).cast("bigint")


def random_normal(mean: float, deviation: float, seed: int) -> Column:
    return F.randn(seed) * deviation + mean


# Text


def concat(*parts) -> Column:
    """Nulls are skipped; no part at all is the empty text."""
    return F.concat_ws("", *(_c(p).cast("string") for p in parts))


def left(s, n: int) -> Column:
    """The first n characters, or all but the last -n."""
    s = _c(s)
    return F.substring(s, F.lit(1), F.lit(n)) if n >= 0 else F.substring(s, F.lit(1), F.greatest(F.length(s) + n, F.lit(0)))


def right(s, n: int) -> Column:
    """The last n characters, or all but the first -n."""
    s = _c(s)
    keep = F.least(F.length(s), F.lit(n)) if n >= 0 else F.greatest(F.length(s) + n, F.lit(0))
    return F.substring(s, F.length(s) - keep + 1, keep)


def substr(s, start: int, count: int | None = None) -> Column:
    """Positions before 1 count as places that hold nothing."""
    s = _c(s)
    if count is None:
        return F.substring(s, F.lit(max(start, 1)), F.length(s))
    if count < 0:
        return F.raise_error(F.lit("negative substring length not allowed")).cast("string")
    end = start + count
    return F.substring(s, F.lit(max(start, 1)), F.lit(max(end - max(start, 1), 0)))


def initcap(s) -> Column:
    """Each run of letters and digits gets a capital first letter, the rest is lowered."""
    runs = F.regexp_extract_all(_c(s), F.lit(r"[\p{L}\p{N}]+|[^\p{L}\p{N}]+"), F.lit(0))
    return F.array_join(F.transform(runs, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, F.lit(2), F.length(w))))), "")


def chr_(code) -> Column:
    """The character of a Unicode code point."""
    code = _c(code).cast("int")
    return F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")


def to_hex(n) -> Column:
    return F.lower(F.hex(_c(n)))


def encode(raw, form: str) -> Column:
    raw = _c(raw).cast("binary")
    return {"hex": F.lower(F.hex(raw)), "base64": F.base64(raw)}[form]


def decode(text, form: str) -> Column:
    return {"hex": F.unhex, "base64": F.unbase64}[form](_c(text))


def sha(raw, bits: int) -> Column:
    return F.unhex(F.sha2(_c(raw).cast("binary"), bits))


def quote_ident(s) -> Column:
    s = _c(s)
    return F.when(s.rlike(r"^[a-z_][a-z0-9_$]*$"), s).otherwise(F.concat(F.lit('"'), F.replace(s, F.lit('"'), F.lit('""')), F.lit('"')))


def quote_literal(s) -> Column:
    s = _c(s).cast("string")
    plain = F.concat(F.lit("'"), F.replace(F.replace(s, F.lit("'"), F.lit("''")), F.lit("\\"), F.lit("\\\\")), F.lit("'"))
    return F.when(F.contains(s, F.lit("\\")), F.concat(F.lit("E"), plain)).otherwise(plain)


def quote_nullable(s) -> Column:
    return F.coalesce(quote_literal(s), F.lit("NULL"))


def format_(pattern: str, *args) -> Column:
    """%s, %I and %L with optional n$ positions; %% is a percent sign."""
    import re

    parts, at, used = [], 0, 0
    for m in re.finditer(r"%(?:(\d+)\$)?([sIL%])", pattern):
        parts.append(F.lit(pattern[at : m.start()]))
        at = m.end()
        if m[2] == "%":
            parts.append(F.lit("%"))
            continue
        used = int(m[1]) if m[1] else used + 1
        arg = _c(args[used - 1])
        parts.append({"s": F.coalesce(arg.cast("string"), F.lit("")), "I": quote_ident(arg), "L": quote_nullable(arg)}[m[2]])
    return F.concat(*parts, F.lit(pattern[at:]))


def string_to_array(s, delimiter: str | None, null: str | None = None) -> Column:
    """Split by a plain delimiter (None: into characters); '' has no elements."""
    s = _c(s)
    pattern = "" if delimiter is None else "\\Q" + delimiter + "\\E"
    made = F.when(s == "", F.array().cast("array<string>")).otherwise(F.split(s, pattern, -1))
    if null is not None:
        made = F.transform(made, lambda x: F.when(x != null, x))
    return made


def starts_with(s, prefix) -> Column:
    return F.startswith(_c(s), _c(prefix) if not isinstance(prefix, str) else F.lit(prefix))


def normalize(s, form: str = "NFC"):
    """Unicode normal form, by an Arrow batch function (no built-in has it)."""

    @F.pandas_udf("string")
    def run(x: pd.Series) -> pd.Series:
        return x.str.normalize(form)

    return run(_c(s))


def is_normalized(s, form: str = "NFC") -> Column:
    return normalize(s, form) == _c(s)


def unistr(s) -> Column:
    r"""Decode \XXXX and \+XXXXXX escapes."""
    parts = F.regexp_extract_all(_c(s), F.lit(r"\\\\|\\\+[0-9A-Fa-f]{6}|\\[0-9A-Fa-f]{4}|[^\\]+"), F.lit(0))

    def one(p: Column) -> Column:
        code = F.regexp_replace(p, r"^\\\+?", "")
        return F.when(p == "\\\\", "\\").when(F.startswith(p, F.lit("\\")), F.decode(F.unhex(F.lpad(code, 8, "0")), "UTF-32")).otherwise(p)

    return F.array_join(F.transform(parts, one), "")


def parse_ident(s) -> Column:
    """A dotted name's parts: bare ones lowered, quoted ones as they are."""
    parts = F.regexp_extract_all(_c(s), F.lit(r'"(?:[^"]|"")+"|[^".]+'), F.lit(0))
    return F.transform(parts, lambda p: F.when(F.startswith(p, F.lit('"')), F.replace(F.substring(p, F.lit(2), F.length(p) - 2), F.lit('""'), F.lit('"'))).otherwise(F.lower(F.trim(p))))


# Patterns


def similar_pattern(pattern: str, escape: str = "\\") -> str:
    """A SIMILAR TO pattern as an anchored Java one."""
    out, i, inside = [], 0, False
    while i < len(pattern):
        ch = pattern[i]
        if escape and ch == escape and i + 1 < len(pattern):
            i += 1
            out.append("\\" + pattern[i] if not pattern[i].isalnum() else pattern[i])
        elif inside:
            out.append(ch)
            inside = ch != "]"
        elif ch == "[":
            out.append(ch)
            inside = True
        elif ch in "%_":
            out.append({"%": ".*", "_": "."}[ch])
        elif ch in ".^$\\":
            out.append("\\" + ch)
        else:
            out.append(ch)
        i += 1
    return "^(?s:" + "".join(out) + ")$"


def similar_to(s, pattern: str, escape: str = "\\") -> Column:
    return _c(s).rlike(similar_pattern(pattern, escape))


def flags(pattern: str, options: str) -> str:
    """Regular-expression options as a Java prefix (i, n, x; g is the caller's)."""
    kept = "".join({"i": "i", "n": "m", "m": "m", "x": "x"}.get(o, "") for o in options)
    return f"(?{kept}){pattern}" if kept else pattern


def matches(s, pattern: str, options: str = "") -> Column:
    """``~`` (or ``~*`` with option i)."""
    return _c(s).rlike(flags(pattern, options))


def regexp_replace(s, pattern: str, replacement: str, options: str = "") -> Column:
    r"""The first match only, unless options hold g; \1 and \& refer to groups and the match."""
    import re

    java = re.sub(r"\\(\d|&)", lambda m: "$" + ("0" if m[1] == "&" else m[1]), replacement.replace("$", "\\$"))
    made = flags(pattern, options)
    if "g" in options:
        return F.regexp_replace(_c(s), made, java)
    return _replace_first(_c(s), made, java)


def _replace_first(s: Column, pattern: str, java: str) -> Column:
    # Up to the first match nothing may match: what precedes it is kept by position.
    found = F.regexp_instr(s, F.lit(pattern))
    match = F.regexp_substr(s, F.lit(pattern))
    head = F.substring(s, F.lit(1), found - 1)
    tail = F.substring(s, found + F.length(match), F.length(s))
    return F.when(found > 0, F.concat(head, F.regexp_replace(match, pattern, java), tail)).otherwise(s)


def regexp_match(s, pattern: str, options: str = "") -> Column:
    """The groups of the first match (the match without groups), or null."""
    import re

    groups = re.compile(re.sub(r"\(\?<[A-Za-z]", "(?P<", pattern)).groups
    made = flags(pattern, options)
    parts = [F.regexp_extract(_c(s), made, i) for i in (range(1, groups + 1) if groups else [0])]
    return F.when(_c(s).rlike(made), F.array(*parts))


def regexp_matches(s, pattern: str, options: str = "") -> Column:
    """With g: an array of all matches' first group (or match); explode it for rows."""
    import re

    return F.regexp_extract_all(_c(s), F.lit(flags(pattern, options)), F.lit(1 if re.compile(pattern).groups else 0))


def regexp_split(s, pattern: str, options: str = "") -> Column:
    return F.split(_c(s), flags(pattern, options), -1)


# Predicates


def between_symmetric(x, a, b) -> Column:
    a, b = _c(a), _c(b)
    return (_c(x) >= F.least(a, b)) & (_c(x) <= F.greatest(a, b))


def overlaps(s1, e1, s2, e2) -> Column:
    """Half-open periods with their ends in any order; an empty one overlaps where it starts."""
    a1, b1, a2, b2 = F.least(_c(s1), _c(e1)), F.greatest(_c(s1), _c(e1)), F.least(_c(s2), _c(e2)), F.greatest(_c(s2), _c(e2))
    return ((a1 < b2) & (a2 < b1)) | (a1 == a2)


def any_of(x, op: str, values) -> Column:
    """x op ANY (array), null if undecided."""
    return F.exists(_c(values), lambda v: _compare(_c(x), op, v))


def all_of(x, op: str, values) -> Column:
    """x op ALL (array), null if undecided."""
    return F.forall(_c(values), lambda v: _compare(_c(x), op, v))


def _compare(a: Column, op: str, b: Column) -> Column:
    return {"=": a == b, "<>": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op]


def num_nulls(*xs) -> Column:
    return sum((_c(x).isNull().cast("int") for x in xs), F.lit(0))


def num_nonnulls(*xs) -> Column:
    return sum((_c(x).isNotNull().cast("int") for x in xs), F.lit(0))


# Date and time


def extract(field: str, ts) -> Column:
    """EXTRACT of a timestamp without zone; dow counts from Sunday as 0, epoch is in seconds."""
    ts = _c(ts)
    zoned = ts.cast("timestamp")
    year = F.year(ts)
    exact = {
        "epoch": lambda: F.unix_micros(zoned) / 1e6,
        "dow": lambda: F.dayofweek(ts) - 1,
        "isodow": lambda: F.weekday(ts) + 1,
        "decade": lambda: F.floor(year / 10),
        "century": lambda: F.ceil(year / 100),
        "millennium": lambda: F.ceil(year / 1000),
        "isoyear": lambda: F.date_part(F.lit("YEAROFWEEK"), ts),
        "second": lambda: F.date_part(F.lit("SECOND"), ts).cast("double"),
        "milliseconds": lambda: F.date_part(F.lit("SECOND"), ts).cast("double") * 1e3,
        "microseconds": lambda: F.date_part(F.lit("SECOND"), ts).cast("double") * 1e6,
    }
    return exact[field]() if field in exact else F.date_part(F.lit(field.upper()), ts)


def date_trunc(field: str, ts) -> Column:
    ts = _c(ts)
    years = {"decade": 10, "century": 100, "millennium": 1000}.get(field)
    if not years:
        return F.date_trunc(field, ts)
    shift = 0 if years == 10 else 1
    first = F.floor((F.year(ts) - shift) / years) * years + shift
    return F.make_timestamp_ntz(first.cast("int"), F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0))


def date_bin(stride_seconds: float, ts, origin: str = "2000-01-01") -> Column:
    """The start of the bin of equal strides from an origin."""
    micros = F.lit(int(stride_seconds * 1_000_000))
    at = F.unix_micros(_c(ts).cast("timestamp"))
    zero = F.unix_micros(F.lit(origin).cast("timestamp"))
    return F.timestamp_micros(zero + F.floor((at - zero) / micros) * micros).cast("timestamp_ntz")


def age(later, earlier) -> Column:
    """Years, months and days between two dates as text, as an interval reads."""
    a, b = _c(later), _c(earlier)
    months = F.floor(F.months_between(a, b)).cast("int")
    days = F.datediff(a, F.add_months(b, months))
    return F.format_string("%d years %d mons %d days", F.floor(months / 12).cast("int"), F.pmod(months, F.lit(12)).cast("int"), days)


def date_minus(a, b) -> Column:
    """date - date is a number of days."""
    return F.datediff(_c(a), _c(b))


def at_time_zone(ts, zone: str) -> Column:
    """A timestamp without zone is a wall time there; the result is the same moment in UTC."""
    return F.to_utc_timestamp(_c(ts), zone)


#: to_char and to_date letters and Spark's.
_PATTERNS = (("YYYY", "yyyy"), ("HH24", "HH"), ("HH12", "hh"), ("HH", "hh"), ("MI", "mm"), ("SS", "ss"), ("MS", "SSS"), ("US", "SSSSSS"), ("Month", "MMMM"), ("Mon", "MMM"), ("MM", "MM"), ("DDD", "DDD"), ("DD", "dd"), ("Day", "EEEE"), ("Dy", "EEE"), ("AM", "a"), ("PM", "a"), ("YY", "yy"), ("Q", "Q"))


def datetime_pattern(pattern: str) -> str:
    import re

    table = dict(_PATTERNS)
    return re.sub("|".join(k for k, _ in _PATTERNS) + r'|"[^"]*"|[A-Za-z]+', lambda m: table.get(m[0]) or "'" + m[0].strip('"') + "'", pattern)


def to_char(ts, pattern: str) -> Column:
    return F.date_format(_c(ts), datetime_pattern(pattern))


def to_date(s, pattern: str) -> Column:
    return F.to_date(_c(s), datetime_pattern(pattern))


def justify(months, days, seconds) -> Column:
    """Hours over 24 become days and days over 30 months, each with the sign of the whole part."""
    days = _c(days) + F.floor(_c(seconds) / 86400)
    seconds = F.pmod(_c(seconds), F.lit(86400))
    return F.struct((_c(months) + F.floor(days / 30)).cast("int").alias("months"), F.pmod(days, F.lit(30)).cast("int").alias("days"), seconds.alias("seconds"))


# Arrays


def array_length(a) -> Column:
    """Null for an empty array."""
    return F.when(F.size(_c(a)) > 0, F.size(_c(a)))


def array_position(a, x) -> Column:
    """From 1; null if absent."""
    found = F.array_position(_c(a), x)
    return F.when(found > 0, found)


def array_positions(a, x) -> Column:
    a = _c(a)
    return F.filter(F.transform(a, lambda v, i: F.when(v.eqNullSafe(F.lit(x)), i + 1)), lambda i: i.isNotNull())


def array_replace(a, old, new) -> Column:
    return F.transform(_c(a), lambda v: F.when(v.eqNullSafe(F.lit(old)), F.lit(new)).otherwise(v))


def array_contains_all(a, b) -> Column:
    """a @> b: every non-null element of b is in a; a null there is never contained."""
    return F.forall(_c(b), lambda v: F.coalesce(F.array_contains(_c(a), v), F.lit(False)))


def array_slice(a, first: int, last: int) -> Column:
    """a[first:last], both included; out of range is empty."""
    low = max(first, 1)
    return F.slice(_c(a), F.lit(low), F.lit(max(last - low + 1, 0)))


def array_at(a, i) -> Column:
    """a[i] from 1; null outside."""
    return F.when((_c(i) if not isinstance(i, int) else F.lit(i)) >= 1, F.try_element_at(_c(a), F.lit(i) if isinstance(i, int) else _c(i)))


def array_fill(value, n: int) -> Column:
    return F.array_repeat(F.lit(value), n)


def array_dims(a) -> Column:
    return F.when(F.size(_c(a)) > 0, F.concat(F.lit("[1:"), F.size(_c(a)).cast("string"), F.lit("]")))


def array_to_string(a, delimiter: str, null: str | None = None) -> Column:
    return F.array_join(_c(a).cast("array<string>"), delimiter) if null is None else F.array_join(_c(a).cast("array<string>"), delimiter, null)


# Numbers with a domain or a format


def _domain(x, wrong, of) -> Column:
    x = _c(x).cast("double")
    return F.when(wrong(x), F.raise_error(F.lit("input is out of range"))).otherwise(of(x))


def acos(x) -> Column:
    """As acos; outside -1 to 1 it is an error."""
    return _domain(x, lambda v: F.abs(v) > 1, F.acos)


def acosh(x) -> Column:
    """As acosh; below 1 it is an error."""
    return _domain(x, lambda v: v < 1, F.acosh)


def atanh(x) -> Column:
    """As atanh; outside -1 to 1 it is an error."""
    return _domain(x, lambda v: F.abs(v) > 1, F.atanh)


def power(x, y) -> Column:
    """A negative base with a fraction as exponent, and zero with a negative one, are errors."""
    a, b = _c(x).cast("double"), _c(y).cast("double")
    wrong = ((a < 0) & (b != F.floor(b))) | ((a == 0) & (b < 0))
    return F.when(wrong, F.raise_error(F.lit("a result of this power is undefined"))).otherwise(F.pow(a, b))


def factorial(n) -> Column:
    """Exact up to 33, as a 38-digit number holds it; a negative argument is an error."""
    n = _c(n).cast("int")
    one = F.lit(1).cast("decimal(38,0)")
    product = F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), one, lambda a, i: (a * i.cast("decimal(20,0)")).cast("decimal(38,0)"))
    return F.when(n < 0, F.raise_error(F.lit("factorial of a negative number is undefined"))).otherwise(product)


def to_number(s, pattern: str) -> Column:
    """9 and 0 are digits, . or D the point, , or G group marks; S, MI and PR mean signs; other marks are skipped."""
    s = _c(s)
    digits = F.regexp_replace(s, "[^0-9.]", "")
    fraction = pattern.upper().replace("D", ".").partition(".")[2].count("9") + pattern.upper().replace("D", ".").partition(".")[2].count("0")
    minus = F.contains(s, F.lit("-")) | (F.lit("PR" in pattern.upper()) & F.contains(s, F.lit("<")))
    value = digits.cast(f"decimal(38,{fraction})")
    return F.when(minus, -value).otherwise(value)


def setseed(seed: float) -> int:
    """The seed that ``random`` takes; one number between -1 and 1 always gives the same rows the same numbers."""
    if not -1 <= seed <= 1:
        raise ValueError("setseed parameter is out of allowed range [-1,1]")
    return int((seed + 1) * (1 << 52))


def random(seed: int | None = None) -> Column:
    return F.rand() if seed is None else F.rand(seed)


# More text


def btrim(s, marks: str = " ") -> Column:
    """Without any of the marks at both ends."""
    return F.btrim(_c(s), F.lit(marks))


def ltrim(s, marks: str = " ") -> Column:
    return F.ltrim(_c(s), F.lit(marks))


def rtrim(s, marks: str = " ") -> Column:
    return F.rtrim(_c(s), F.lit(marks))


def strpos(s, part) -> Column:
    """From 1; 0 where the part isn't there. ``position`` has its arguments the other way round."""
    return F.locate(part, _c(s)) if isinstance(part, str) else F.instr(_c(s), part)


def position(part: str, s) -> Column:
    return strpos(s, part)


def overlay(s, new: str, start: int, count: int | None = None) -> Column:
    return F.overlay(_c(s), F.lit(new), F.lit(start), F.lit(len(new) if count is None else count))


def casefold(s) -> Column:
    """Full case folding: sharp s and the like become what their capitals do."""
    return F.lower(F.replace(F.upper(_c(s)), F.lit("\u1e9e"), F.lit("SS")))


#: Letters of Latin-1 with marks, and without.
_MARKED = "ÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝàáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
_BARE = "AAAAAACEEEEIIIINOOOOOUUUUYaaaaaaceeeeiiiinooooouuuuyy"


def to_ascii(s) -> Column:
    """Latin letters without their marks."""
    return F.translate(_c(s), _MARKED, _BARE)


#: Encodings by their names there and in Java.
_ENCODINGS = {"UTF8": "UTF-8", "LATIN1": "ISO-8859-1", "SQL_ASCII": "US-ASCII", "UTF16": "UTF-16"}


def convert_to(s, encoding: str) -> Column:
    """Text as bytes of an encoding."""
    return F.encode(_c(s), _ENCODINGS[encoding.upper()])


def convert_from(raw, encoding: str) -> Column:
    """Bytes of an encoding as text."""
    return F.decode(_c(raw), _ENCODINGS[encoding.upper()])


def convert(raw, source: str, target: str) -> Column:
    """Bytes of one encoding as bytes of another."""
    return convert_to(convert_from(raw, source), target)


def client_encoding() -> Column:
    return F.lit("UTF8")


def version() -> Column:
    return F.concat(F.lit("Spark "), F.split_part(F.version(), F.lit(" "), F.lit(1)))


def gen_random_uuid() -> Column:
    """A random version-4 UUID as text."""
    return F.uuid()


def string_to_table(s, delimiter: str | None, null: str | None = None) -> Column:
    """The parts as rows."""
    return F.explode(string_to_array(s, delimiter, null))


def regexp_like(s, pattern: str, options: str = "") -> Column:
    return matches(s, pattern, options)


def regexp_instr(s, pattern: str, start: int = 1, nth: int = 1, end: bool = False, options: str = "") -> Column:
    """Where the nth match begins, or the place after it; 0 without one. Places count from 1."""
    java = flags(pattern, options)
    rest = F.substring(_c(s), start, 1 << 30)
    found = F.regexp_extract_all(rest, F.lit(java), F.lit(0))
    before = F.slice(F.split(rest, java, -1), 1, nth)
    whole = lambda parts: F.aggregate(F.transform(parts, F.length), F.lit(0), lambda a, b: a + b)
    place = F.lit(start) + whole(before) + (whole(F.slice(found, 1, nth - 1)) if nth > 1 else F.lit(0))
    width = F.length(F.get(found, F.lit(nth - 1))) if end else F.lit(0)
    return F.when(F.size(found) >= nth, place + width).otherwise(0)


def regexp_substr(s, pattern: str, start: int = 1, nth: int = 1, options: str = "") -> Column:
    """The nth match from a place on, or null."""
    return F.get(F.regexp_extract_all(F.substring(_c(s), start, 1 << 30), F.lit(flags(pattern, options)), F.lit(0)), F.lit(nth - 1))


def ascending(using: str) -> bool:
    """ORDER BY ... USING < or >: the direction that operator means."""
    return {"<": True, "<=": True, ">": False, ">=": False}[using]


def collate(s, name: str) -> Column:
    """``C`` and ``POSIX`` compare bytes; other names are ICU locales, with _CI or _AI as Spark writes them."""
    return F.collate(_c(s), {"C": "UTF8_BINARY", "POSIX": "UTF8_BINARY", "ucs_basic": "UTF8_BINARY", "und-x-icu": "UNICODE"}.get(name, name))


# Clocks and makers of times


def clock_timestamp() -> Column:
    return F.current_timestamp()


def statement_timestamp() -> Column:
    return F.current_timestamp()


def transaction_timestamp() -> Column:
    """The same in a whole query, as Spark fixes it when the query is planned."""
    return F.current_timestamp()


def timeofday() -> Column:
    return F.date_format(F.current_timestamp(), "EEE MMM dd HH:mm:ss.SSSSSS yyyy VV")


def localtime() -> Column:
    """The time of day as text."""
    return F.date_format(F.current_timestamp(), "HH:mm:ss.SSSSSS")


def isfinite(ts) -> Column:
    """Dates and timestamps are always finite here; null stays null."""
    return F.when(_c(ts).isNotNull(), True)


def make_date(y, m, d) -> Column:
    """Negative years are BC; a day that doesn't exist is an error."""
    y = _c(y)
    return F.make_date(F.when(y < 0, y + 1).otherwise(y), _c(m), _c(d))


def make_time(h, m, s) -> Column:
    """The time of day as text; a field out of range is an error."""
    h, m, s = _c(h), _c(m), _c(s).cast("decimal(8,6)")
    good = h.between(0, 23) & m.between(0, 59) & (s >= 0) & (s < 60)
    shown = F.concat_ws(":", F.lpad(h.cast("string"), 2, "0"), F.lpad(m.cast("string"), 2, "0"), F.concat(F.lpad(F.floor(s).cast("string"), 2, "0"), F.regexp_replace(F.regexp_extract(s.cast("string"), r"(\.[0-9]+)$", 1), r"\.?0+$", "")))
    return F.when(good, shown).otherwise(F.raise_error(F.lit("time field value out of range")))


def make_timestamp(y, mo, d, h, mi, s) -> Column:
    return F.make_timestamp_ntz(_c(y), _c(mo), _c(d), _c(h), _c(mi), _c(s))


def make_timestamptz(y, mo, d, h, mi, s, zone: str | None = None) -> Column:
    """A moment: the wall time there, or in the session's zone."""
    made = make_timestamp(y, mo, d, h, mi, s)
    return made.cast("timestamp") if zone is None else F.to_utc_timestamp(made, zone)


def make_interval(years=0, months=0, weeks=0, days=0, hours=0, mins=0, secs=0) -> Column:
    parts = [F.lit(x) if isinstance(x, (int, float)) else _c(x) for x in (years, months, weeks, days, hours, mins, secs)]
    return F.make_interval(*parts)


def to_timestamp(x, pattern: str | None = None) -> Column:
    """Seconds since 1970 as a moment, or text by a pattern."""
    return F.timestamp_micros((_c(x) * 1_000_000).cast("bigint")) if pattern is None else F.to_timestamp(_c(x), datetime_pattern(pattern))


# More arrays


def array_cat(a, b) -> Column:
    """Null counts as empty, unless both are."""
    a, b = _c(a), _c(b)
    return F.coalesce(F.concat(a, b), a, b)


def array_prepend(x, a) -> Column:
    x = _c(x)
    return F.coalesce(F.array_prepend(_c(a), x), F.array(x))


def array_remove(a, x) -> Column:
    """All elements that equal x; null finds nulls."""
    x = _c(x) if not isinstance(x, (int, float, str)) else F.lit(x)
    return F.filter(_c(a), lambda v: ~v.eqNullSafe(x))


def array_lower(a, dimension: int = 1) -> Column:
    return F.when((array_ndims(a) >= dimension), 1)


def array_upper(a, dimension: int = 1) -> Column:
    """The last place of a dimension; null where there is none."""
    a = _c(a)
    for _ in range(dimension - 1):
        a = F.get(a, F.lit(0))
    return F.when(F.size(a) > 0, F.size(a))


def array_ndims(a, dimensions: int = 1) -> Column:
    """How deep the type nests, null for an empty array; the caller says it, as a column's type isn't known here."""
    return F.when(F.size(_c(a)) > 0, dimensions)


def cardinality(a, dimensions: int = 1) -> Column:
    """All elements of all dimensions; 0 for an empty array, null for null."""
    a = _c(a)
    for _ in range(dimensions - 1):
        a = F.flatten(a)
    return F.when(a.isNotNull(), F.size(a))


def array_shuffle(a) -> Column:
    return F.shuffle(_c(a))


def array_sample(a, n: int) -> Column:
    """n elements in random order; more than there are is an error."""
    a = _c(a)
    return F.when(F.size(a) < n, F.raise_error(F.lit("sample size must be between 0 and the number of elements"))).otherwise(F.slice(F.shuffle(a), 1, n))


def enum_range(labels: list[str], first: str | None = None, last: str | None = None) -> Column:
    """The labels of an enumeration in order, all or from one to another; its columns are text."""
    low = labels.index(first) if first is not None else 0
    high = labels.index(last) if last is not None else len(labels) - 1
    return F.array(*map(F.lit, labels[low : high + 1])) if low <= high else F.array().cast("array<string>")
