"""JSON as text: navigation, construction, set-returning forms and changes.

Navigation and construction are built-in expressions. Containment, changes and
path predicates need a JSON tree; they run as Arrow batch functions.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def _path(*keys) -> str:
    return "$" + "".join(f"[{k}]" if isinstance(k, int) else f"['{k}']" for k in keys)


def get(j, *keys) -> Column:
    """-> and #>: the value as JSON text. Negative places count from the end, so they need a tree."""
    if any(isinstance(k, int) and k < 0 for k in keys):
        return _mapped(j, lambda tree: _dump(_walk(tree, keys)))
    return F.to_json(F.try_variant_get(F.try_parse_json(_c(j)), _path(*keys), "variant"))


def get_text(j, *keys) -> Column:
    """->> and #>>: the value as text; JSON null is null."""
    value = F.try_variant_get(F.try_parse_json(_c(j)), _path(*keys), "variant")
    return F.when(~F.is_variant_null(value), F.try_variant_get(value, "$", "string"))


def is_json(s, kind: str = "value") -> Column:
    parsed = F.try_parse_json(_c(s))
    shape = F.schema_of_variant(parsed)
    test = {"value": F.lit(True), "object": F.startswith(shape, F.lit("OBJECT")), "array": F.startswith(shape, F.lit("ARRAY"))}
    test["scalar"] = ~test["object"] & ~test["array"]
    return F.when(_c(s).isNotNull(), parsed.isNotNull() & F.coalesce(test[kind], F.lit(False)))


def typeof(j) -> Column:
    shape = F.schema_of_variant(F.try_parse_json(_c(j)))
    return F.when(F.startswith(shape, F.lit("OBJECT")), "object").when(F.startswith(shape, F.lit("ARRAY")), "array").when(shape == "STRING", "string").when(shape == "BOOLEAN", "boolean").when(shape == "VOID", "null").when(shape.isNotNull(), "number")


def keys(j) -> Column:
    return F.json_object_keys(_c(j))


def each_text(j) -> Column:
    """A map of an object's members as text; explode it for rows."""
    return F.from_json(_c(j), "map<string,string>")


def elements_text(j) -> Column:
    return F.from_json(_c(j), "array<string>")


def has_key(j, key: str) -> Column:
    """?"""
    return F.coalesce(F.array_contains(F.json_object_keys(_c(j)), key), F.lit(False))


def has_any(j, names: list[str]) -> Column:
    """?|"""
    return F.coalesce(F.arrays_overlap(F.json_object_keys(_c(j)), F.array(*map(F.lit, names))), F.lit(False))


def has_all(j, names: list[str]) -> Column:
    """?&"""
    return F.coalesce(F.size(F.array_except(F.array(*map(F.lit, names)), F.json_object_keys(_c(j)))) == 0, F.lit(False))


def build_object(**members) -> Column:
    return F.to_json(F.struct(*(_c(v).alias(k) for k, v in members.items())), {"ignoreNullFields": "false"})


def build_array(*values) -> Column:
    return F.to_json(F.array(*(_c(v).cast("string") for v in values)), {"ignoreNullFields": "false"})


def agg(value) -> Column:
    return F.to_json(F.transform(F.array_sort(F.collect_list(F.struct(_c(value).alias("v")))), lambda s: s["v"]))


def object_agg(key, value) -> Column:
    return F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct(_c(key).cast("string"), _c(value))))))


def _dump(tree) -> str | None:
    return None if tree is _ABSENT else json.dumps(tree, separators=(",", ":"), ensure_ascii=False)


_ABSENT = object()


def _walk(tree, path):
    for k in path:
        if isinstance(tree, list):
            try:
                tree = tree[int(k)]
            except (IndexError, ValueError):
                return _ABSENT
        elif isinstance(tree, dict) and str(k) in tree:
            tree = tree[str(k)]
        else:
            return _ABSENT
    return tree


def _mapped(j, change: Callable, kind: str = "string") -> Column:
    return together(j, value=(kind, change))["value"]


def together(j, **changes: tuple[str, Callable]) -> Column:
    """Several results of one JSON column as a struct, for which each value is parsed once.

    Each is (type, function of the tree), as ``setting``, ``deleting`` and ``existing`` make them.
    """
    kind = ", ".join(f"`{name}` {k}" for name, (k, _) in changes.items())

    @F.pandas_udf(kind)
    def run(x: pd.Series) -> pd.DataFrame:
        trees = [None if v is None else json.loads(v) for v in x]
        return pd.DataFrame({name: pd.Series([None if v is None else change(t) for v, t in zip(x, trees, strict=True)], dtype=object) for name, (_, change) in changes.items()})

    return run(_c(j))


def setting(path: list, value: str, create: bool = True) -> tuple[str, Callable]:
    tree = json.loads(value)
    return "string", lambda a: _dump(_put(a, path, tree, create, False, False))


def deleting(path: list) -> tuple[str, Callable]:
    return "string", lambda a: _dump(_drop(a, path))


def existing(path: str) -> tuple[str, Callable]:
    return "boolean", lambda a: bool(path_query(a, path))


def _holds(a, b, top: bool = True) -> bool:
    if isinstance(a, dict) and isinstance(b, dict):
        return all(k in a and _holds(a[k], v, False) for k, v in b.items())
    if isinstance(a, list):
        if isinstance(b, list):
            return all(any(_holds(x, y, False) for x in a) for y in b)
        return top and not isinstance(b, dict) and b in a
    return type(a) is type(b) and a == b if isinstance(a, bool) or isinstance(b, bool) else a == b


def contains(j, other: str) -> Column:
    """@> with a constant."""
    tree = json.loads(other)
    return _mapped(j, lambda a: _holds(a, tree), "boolean")


def contained(j, other: str) -> Column:
    """<@ with a constant."""
    tree = json.loads(other)
    return _mapped(j, lambda a: _holds(tree, a), "boolean")


def _put(tree, path: list, value, create: bool, insert: bool, after: bool):
    if not path:
        return tree
    k, rest = path[0], path[1:]
    if isinstance(tree, dict):
        out = dict(tree)
        if rest:
            if k in out:
                out[k] = _put(out[k], rest, value, create, insert, after)
        elif (k in out and not insert) or (k not in out and create):
            out[k] = value
        return out
    if isinstance(tree, list):
        out, i = list(tree), int(k)
        at = i + len(out) if i < 0 else i
        if rest:
            if 0 <= at < len(out):
                out[at] = _put(out[at], rest, value, create, insert, after)
        elif insert:
            out.insert(min(max(at + after, 0), len(out)), value)
        elif 0 <= at < len(out):
            out[at] = value
        elif create:
            out.insert(0 if at < 0 else len(out), value)
        return out
    return tree


def set_(j, path: list, value: str, create: bool = True) -> Column:
    """jsonb_set"""
    return together(j, value=setting(path, value, create))["value"]


def insert(j, path: list, value: str, after: bool = False) -> Column:
    """jsonb_insert"""
    tree = json.loads(value)
    return _mapped(j, lambda a: _dump(_put(a, path, tree, True, True, after)))


def _drop(tree, path):
    k, rest = path[0], path[1:]
    if isinstance(tree, dict):
        return {a: (_drop(b, rest) if rest and a == k else b) for a, b in tree.items() if rest or a != k}
    if isinstance(tree, list):
        try:
            at = int(k) + len(tree) if int(k) < 0 else int(k)
        except ValueError:
            return [x for x in tree if x != k] if not rest else tree
        return [(_drop(x, rest) if rest and i == at else x) for i, x in enumerate(tree) if rest or i != at]
    return tree


def delete_path(j, path: list) -> Column:
    """#- and -"""
    return together(j, value=deleting(path))["value"]


def _strip(tree):
    if isinstance(tree, dict):
        return {k: _strip(v) for k, v in tree.items() if v is not None}
    return [_strip(x) for x in tree] if isinstance(tree, list) else tree


def strip_nulls(j) -> Column:
    return _mapped(j, lambda a: _dump(_strip(a)))


def pretty(j) -> Column:
    return _mapped(j, lambda a: json.dumps(a, indent=4, ensure_ascii=False))


# Paths


_TOKEN = re.compile(r"""\s*(?:(\$)|\.\s*"([^"]*)"|\.\s*(\*\*|\*|[A-Za-z_]\w*)(\(\))?|\[\s*(\*|-?\d+(?:\s*to\s*-?\d+)?|last)\s*\]|\?\s*\((.*)\)\s*$)""", re.S)


def path_query(tree, path: str) -> list:
    """A lax JSON path: members, *, **, [i], [i to j], [last], size(), type() and a final filter."""
    at, found = 0, [tree]
    path = re.sub(r"^\s*(lax|strict)\s+", "", path)
    while at < len(path.rstrip()):
        m = _TOKEN.match(path, at)
        if not m:
            raise ValueError(f"not a JSON path: {path}")
        at = m.end()
        quoted, name, call, place, test = m.group(2), m.group(3), m.group(4), m.group(5), m.group(6)
        if m.group(1):
            found = [tree]
        elif call:
            kinds = {dict: "object", list: "array", str: "string", bool: "boolean", type(None): "null"}
            one = {"size": lambda x: len(x) if isinstance(x, list) else 1, "type": lambda x: kinds.get(type(x), "number"), "abs": abs, "floor": lambda x: x // 1, "double": float}[name]
            found = [one(x) for x in found]
        elif name == "**":
            found = [y for x in found for y in _everything(x)]
        elif quoted is not None or name:
            flat = [y for x in found for y in (x if isinstance(x, list) else [x])]
            key = quoted if quoted is not None else name
            found = [v for x in flat if isinstance(x, dict) for k, v in x.items() if k == key or (quoted is None and key == "*")]
        elif place:
            out = []
            for x in found:
                rows = x if isinstance(x, list) else [x]
                if place == "*":
                    out += rows
                elif place == "last":
                    out += rows[-1:]
                elif "to" in place:
                    a, b = (int(i) for i in place.split("to"))
                    out += rows[a : b + 1]
                elif 0 <= int(place) < len(rows):
                    out.append(rows[int(place)])
            found = out
        elif test:
            flat = [y for x in found for y in (x if isinstance(x, list) else [x])]
            found = [x for x in flat if _test(x, test)]
    return found


def _everything(x):
    yield x
    for y in x.values() if isinstance(x, dict) else x if isinstance(x, list) else ():
        yield from _everything(y)


def _test(item, test: str) -> bool:
    for sep, how in (("||", any), ("&&", all)):
        parts = test.split(sep)
        if len(parts) > 1:
            return how(_test(item, p) for p in parts)
    if m := re.match(r"\s*exists\s*\((.*)\)\s*$", test, re.S):
        return bool(path_query(item, m[1].replace("@", "$", 1)))
    m = re.match(r"\s*(@[^=<>!]*?)\s*(==|!=|<>|<=|>=|<|>|like_regex|starts with)\s*(.+?)\s*$", test, re.S)
    if not m:
        raise ValueError(f"not a path filter: {test}")
    value = json.loads(m[3])
    for x in path_query(item, m[1].replace("@", "$", 1)):
        if m[2] == "like_regex":
            hit = isinstance(x, str) and bool(re.search(value, x))
        elif m[2] == "starts with":
            hit = isinstance(x, str) and x.startswith(value)
        elif m[2] in ("==", "!=", "<>"):
            hit = (x == value) == (m[2] == "==")
        else:
            same = isinstance(x, (int, float)) and isinstance(value, (int, float)) or isinstance(x, str) and isinstance(value, str)
            hit = same and {"<": x < value, "<=": x <= value, ">": x > value, ">=": x >= value}[m[2]]
        if hit:
            return True
    return False


def path_exists(j, path: str) -> Column:
    """jsonb_path_exists and @?"""
    return together(j, value=existing(path))["value"]


def path_match(j, path: str) -> Column:
    """jsonb_path_match and @@: a path, an operator and a constant."""
    return _mapped(j, lambda a: _test(a, re.sub(r"^\s*\$", "@", path)), "boolean")


def path_query_array(j, path: str) -> Column:
    """jsonb_path_query_array; explode ``elements`` of it for jsonb_path_query."""
    return _mapped(j, lambda a: _dump(path_query(a, path)))


def path_query_first(j, path: str) -> Column:
    return _mapped(j, lambda a: next((_dump(x) for x in path_query(a, path)), None))


def json_value(j, path: str, default: str | None = None) -> Column:
    """A scalar at the path as text, or the default."""

    def one(a):
        found = path_query(a, path)
        scalar = len(found) == 1 and not isinstance(found[0], (dict, list)) and found[0] is not None
        return (found[0] if isinstance(found[0], str) else _dump(found[0])) if scalar else default

    return _mapped(j, one)


def json_query(j, path: str, wrapper: bool = False) -> Column:
    """An object or array at the path, or all items wrapped in an array."""

    def one(a):
        found = path_query(a, path)
        return _dump(found) if wrapper else _dump(found[0]) if len(found) == 1 and isinstance(found[0], (dict, list)) else None

    return _mapped(j, one)


# Records and constructors


def json_object(*pairs, absent_on_null: bool = False) -> Column:
    """json_object of keys and values in turn, or of one array of them; the values are text."""
    if len(pairs) == 1:
        flat = _c(pairs[0])
        half = F.sequence(F.lit(0), (F.size(flat) / 2).cast("int") - 1)
        entries = F.when(F.size(flat) > 0, F.transform(half, lambda i: F.struct(F.get(flat, i * 2).alias("k"), F.get(flat, i * 2 + 1).alias("v")))).otherwise(F.array().cast("array<struct<k:string,v:string>>"))
    else:
        entries = F.array(*(F.struct(_c(k).alias("k"), _c(v).cast("string").alias("v")) for k, v in zip(pairs[::2], pairs[1::2], strict=True)))
    if absent_on_null:
        entries = F.filter(entries, lambda e: e["v"].isNotNull())
    return F.to_json(F.map_from_entries(entries), {"ignoreNullFields": "false"})


def row_to_json(*columns) -> Column:
    """row_to_json, to_json and to_jsonb of a row."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def to_jsonb(x) -> Column:
    """to_json and to_jsonb of one value; null stays null."""
    c = _c(x)
    return F.when(c.isNotNull(), F.regexp_replace(F.to_json(F.struct(c.alias("v"))), r'^\{"v":([\s\S]*)\}$', "$1"))


def scalar(x) -> Column:
    """json_scalar"""
    return to_jsonb(x)


def parse(s) -> Column:
    """json(): the text if it is JSON; anything else is an error."""
    c = _c(s)
    return F.when(F.parse_json(c).isNotNull(), c)


def serialize(j, kind: str = "string") -> Column:
    """json_serialize, as text or as UTF-8 bytes."""
    return parse(j) if kind == "string" else F.encode(parse(j), "UTF-8")


def to_record(j, schema: str) -> Column:
    """json_to_record and jsonb_to_record: a struct of declared fields; absent ones are null."""
    return F.from_json(_c(j), schema)


def to_recordset(j, schema: str) -> Column:
    """json_to_recordset and jsonb_to_recordset: a row for each element, as a struct."""
    return F.explode(F.from_json(_c(j), F.lit(f"array<struct<{schema}>>")))


def _filled(base: Column, found: Column, given: Column, names: list[str]) -> Column:
    return F.struct(*(F.when(F.array_contains(given, n), found[n]).otherwise(base[n]).alias(n) for n in names))


def populate_record(base: Column, j, schema: str) -> Column:
    """json_populate_record and jsonb_populate_record: members of the object, else the base row's fields."""
    names = [part.strip().split()[0].split(":")[0] for part in schema.split(",")]
    return _filled(base, F.from_json(_c(j), schema), F.coalesce(F.json_object_keys(_c(j)), F.array().cast("array<string>")), names)


def populate_recordset(base: Column, j, schema: str) -> Column:
    """json_populate_recordset and jsonb_populate_recordset: the same for each element of an array, as rows."""
    names = [part.strip().split()[0].split(":")[0] for part in schema.split(",")]
    items = F.zip_with(F.from_json(_c(j), f"array<struct<{schema}>>"), F.from_json(_c(j), "array<map<string,string>>"), lambda r, m: F.struct(r.alias("r"), m.alias("m")))
    return F.explode(F.transform(items, lambda x: _filled(base, x["r"], F.map_keys(x["m"]), names)))


def set_lax(j, path: list, value: str | None, create: bool = True, null_treatment: str = "use_json_null") -> Column:
    """jsonb_set_lax: what a null value means is chosen."""
    if value is not None:
        return set_(j, path, value, create)
    if null_treatment == "raise_exception":
        raise ValueError("JSON value must not be null")
    return {"use_json_null": lambda: set_(j, path, "null", create), "delete_key": lambda: delete_path(j, path), "return_target": lambda: _c(j)}[null_treatment]()


#: Paths hold no times here, so the forms that know time zones are the same functions.
path_exists_tz, path_match_tz, path_query_tz = path_exists, path_match, path_query_array
path_query_array_tz, path_query_first_tz = path_query_array, path_query_first


def json_table(df, j: str, rows: str, columns: dict[str, tuple[str, str]]):
    """JSON_TABLE: a row for each item at ``rows``, with columns name: (type, path); ``ordinality`` counts from 1."""
    items = df.select(*df.columns, F.posexplode(F.from_json(path_query_array(j, rows), "array<string>")).alias("__at", "__item"))
    made = [json_value(F.col("__item"), path).cast(kind).alias(name) for name, (kind, path) in columns.items()]
    return items.select(*df.columns, (F.col("__at") + 1).alias("ordinality"), *made)
