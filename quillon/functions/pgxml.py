"""XML as text: construction, escaping, paths and tables."""

from __future__ import annotations

import xml.etree.ElementTree as ET

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def text(x) -> Column:
    """xmltext: escaped."""
    c = _c(x).cast("string")
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(raw), F.lit(safe))
    return c


def element(name: str, attributes: dict | None = None, *content) -> Column:
    """xmlelement with xmlattributes; null attributes and contents are left out."""
    marks = [F.when(_c(v).isNotNull(), F.concat(F.lit(f' {k}="'), F.replace(text(v), F.lit('"'), F.lit("&quot;")), F.lit('"'))) for k, v in (attributes or {}).items()]
    inside = F.concat_ws("", *content) if content else F.lit("")
    head = F.concat(F.lit(f"<{name}"), F.concat_ws("", *marks) if marks else F.lit(""))
    return F.when(inside == "", F.concat(head, F.lit("/>"))).otherwise(F.concat(head, F.lit(">"), inside, F.lit(f"</{name}>")))


def forest(**members) -> Column:
    return F.concat_ws("", *(F.when(_c(v).isNotNull(), F.concat(F.lit(f"<{k}>"), text(v), F.lit(f"</{k}>"))) for k, v in members.items()))


def comment(s) -> Column:
    return F.concat(F.lit("<!--"), _c(s), F.lit("-->"))


def instruction(name: str, s=None) -> Column:
    return F.lit(f"<?{name}?>") if s is None else F.concat(F.lit(f"<?{name} "), _c(s), F.lit("?>"))


def concat(*parts) -> Column:
    return F.concat_ws("", *map(_c, parts))


def root(x, version: str = "1.0", standalone: str | None = None) -> Column:
    mark = f' standalone="{standalone}"' if standalone else ""
    return F.concat(F.lit(f'<?xml version="{version}"{mark}?>'), _c(x))


def agg(x, order) -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(_c(order).alias("o"), _c(x).alias("x")))), lambda s: s["x"]), "")


def exists(x, path: str) -> Column:
    return F.xpath_boolean(_c(x), F.lit(path))


def xpath(x, path: str) -> Column:
    return F.xpath(_c(x), F.lit(path))


def well_formed(x, document: bool = True) -> Column:
    """xml_is_well_formed_document, or _content (several roots and bare text are fine)."""

    @F.pandas_udf("boolean")
    def run(s: pd.Series) -> pd.Series:
        def one(v):
            if v is None:
                return None
            try:
                ET.fromstring(v if document else f"<r>{v}</r>")
            except ET.ParseError:
                return False
            return True

        return pd.Series([one(v) for v in s], dtype=object)

    return run(_c(x))


def table(df: DataFrame, x: str, rows: str, columns: dict[str, tuple[str, str]]) -> DataFrame:
    """XMLTABLE: a row for each node at ``rows`` (a path), columns name: (type, path or @attribute)."""
    names = list(columns)

    @F.pandas_udf("array<map<string,string>>")
    def cut(s: pd.Series) -> pd.Series:
        def value(node, path):
            if path.startswith("@"):
                return node.get(path[1:])
            found = node if path == "." else node.find(path)
            return None if found is None else "".join(found.itertext())

        def one(v):
            top = ET.fromstring(v)
            steps = rows.strip("/").split("/")
            nodes = [top] if steps == [top.tag] else top.findall("/".join(steps[1:]) if steps[0] == top.tag else ".//" + "/".join(steps))
            return [{n: value(node, columns[n][1]) for n in names} for node in nodes]

        return pd.Series([None if v is None else one(v) for v in s])

    items = df.select(*df.columns, F.posexplode(cut(F.col(x))).alias("__at", "__row"))
    return items.select(*df.columns, (F.col("__at") + 1).alias("ordinality"), *(F.col("__row")[n].cast(columns[n][0]).alias(n) for n in names))


def namespaces(names: dict[str, str]) -> dict[str, Column]:
    """XMLNAMESPACES as attributes of an element; the empty name is the default one."""
    return {f"xmlns:{k}" if k else "xmlns": F.lit(v) for k, v in names.items()}


def parse(s, document: bool = True) -> Column:
    """XMLPARSE: the text if it is well formed; anything else is an error."""
    return F.when(well_formed(s, document), _c(s)).when(_c(s).isNotNull(), F.raise_error(F.lit("invalid XML " + ("document" if document else "content"))))


def serialize(x, kind: str = "string") -> Column:
    """XMLSERIALIZE, as text or as UTF-8 bytes."""
    return _c(x) if kind == "string" else F.encode(_c(x), "UTF-8")


def is_document(x) -> Column:
    """IS DOCUMENT: well formed with one root."""
    return well_formed(x, True)


_INSTANCE = "http://www.w3.org/2001/XMLSchema-instance"
#: XML Schema types of Spark's.
_SCHEMA_TYPES = {"tinyint": "xsd:byte", "smallint": "xsd:short", "int": "xsd:int", "bigint": "xsd:long", "float": "xsd:float", "double": "xsd:double", "boolean": "xsd:boolean", "date": "xsd:date", "timestamp": "xsd:dateTime", "timestamp_ntz": "xsd:dateTime", "binary": "xsd:base64Binary"}


def rows_to_xml(df: DataFrame, nulls: bool = False) -> DataFrame:
    """A row element for each row, as a table forest; ``nulls`` shows null columns as nil instead of leaving them out."""

    def cell(c: str) -> Column:
        full = F.concat(F.lit(f"<{c}>"), text(F.col(c)), F.lit(f"</{c}>"))
        return F.when(F.col(c).isNotNull(), full).otherwise(F.lit(f'<{c} xsi:nil="true"/>') if nulls else F.lit(None))

    return df.select(*df.columns, F.concat(F.lit("<row>"), F.concat_ws("", *map(cell, df.columns)), F.lit("</row>")).alias("xml"))


def table_to_xml(df: DataFrame, name: str, order: str, nulls: bool = False) -> DataFrame:
    """table_to_xml and query_to_xml: one document with all rows in the order of a column.

    The document is one value by nature; ``rows_to_xml`` gives the same rows apart.
    """
    every = rows_to_xml(df, nulls).agg(agg("xml", order).alias("rows"))
    return every.select(F.concat(F.lit(f'<{name} xmlns:xsi="{_INSTANCE}">'), "rows", F.lit(f"</{name}>")).alias("xml"))


def _row_type(df: DataFrame, name: str) -> str:
    parts = "".join(f'<xsd:element name="{c}" type="{_SCHEMA_TYPES.get(k, "xsd:decimal" if k.startswith("decimal") else "xsd:string")}" minOccurs="0"></xsd:element>' for c, k in df.dtypes)
    return f'<xsd:complexType name="RowType.{name}"><xsd:sequence>{parts}</xsd:sequence></xsd:complexType>'


def table_to_xmlschema(df: DataFrame, name: str) -> str:
    """table_to_xmlschema and query_to_xmlschema: from the schema alone."""
    whole = f'<xsd:complexType name="TableType.{name}"><xsd:sequence><xsd:element name="row" type="RowType.{name}" minOccurs="0" maxOccurs="unbounded"/></xsd:sequence></xsd:complexType>'
    return f'<xsd:schema xmlns:xsd="http://www.w3.org/2001/XMLSchema">{_row_type(df, name)}{whole}<xsd:element name="{name}" type="TableType.{name}"/></xsd:schema>'


def table_to_xml_and_xmlschema(df: DataFrame, name: str, order: str) -> DataFrame:
    """The schema inside the document, before its rows."""
    inner = table_to_xmlschema(df, name)
    return table_to_xml(df, name, order).select(F.concat(F.regexp_extract("xml", "^<[^>]*>", 0), F.lit(inner), F.regexp_replace("xml", "^<[^>]*>", "")).alias("xml"))


def schema_to_xml(tables: dict[str, tuple[DataFrame, str]], name: str) -> DataFrame:
    """schema_to_xml: the documents (table by (frame, order)) of a schema's tables in one."""
    parts = None
    for i, (t, (df, order)) in enumerate(sorted(tables.items())):
        one = table_to_xml(df, t, order).select(F.lit(i).alias("i"), F.replace("xml", F.lit(f' xmlns:xsi="{_INSTANCE}"'), F.lit("")).alias("x"))
        parts = one if parts is None else parts.unionByName(one)
    return parts.agg(agg("x", "i").alias("rows")).select(F.concat(F.lit(f'<{name} xmlns:xsi="{_INSTANCE}">'), "rows", F.lit(f"</{name}>")).alias("xml"))


def schema_to_xmlschema(tables: dict[str, DataFrame], name: str) -> str:
    inner = "".join(_row_type(df, t) for t, df in sorted(tables.items()))
    every = "".join(f'<xsd:element name="{t}" type="RowType.{t}"/>' for t in sorted(tables))
    return f'<xsd:schema xmlns:xsd="http://www.w3.org/2001/XMLSchema">{inner}<xsd:complexType name="SchemaType.{name}"><xsd:all>{every}</xsd:all></xsd:complexType><xsd:element name="{name}" type="SchemaType.{name}"/></xsd:schema>'
