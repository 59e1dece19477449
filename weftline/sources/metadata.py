"""Record descriptions in XML as Spark schemas, and typed projections of delimited text."""

from __future__ import annotations

import xml.etree.ElementTree as ET

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Types of record fields. Fixed values.
_TYPES = {"boolean": T.BooleanType(), "integer": T.IntegerType(), "long": T.LongType(), "number": T.DoubleType(), "double": T.DoubleType(), "string": T.StringType(), "byte": T.BinaryType(), "cbyte": T.BinaryType(), "variant": T.VariantType()}
_KEPT = ("nullValue", "default", "format", "nullable")
#: What an unset field that may not be null holds. Fixed values.
_ZERO = {"boolean": False, "int": 0, "bigint": 0, "double": 0.0, "string": ""}


def parse_record(xml: str) -> T.StructType:
    """The schema of a Record element; unknown types raise. Field attributes stay in the field's metadata."""
    root = ET.fromstring(xml.strip())
    record = root if root.tag.lower() == "record" else next(e for e in root.iter() if e.tag.lower() == "record")
    fields = []
    for f in record:
        if f.tag.lower() != "field":
            continue
        kind = f.get("type", "string").lower()
        if kind == "decimal":
            spark = T.DecimalType(int(f.get("length", "12")), int(f.get("scale", "2")))
        elif kind == "date":
            spark = T.TimestampType()
        elif kind in _TYPES:
            spark = _TYPES[kind]
        else:
            raise ValueError(f"unknown field type {kind!r}")
        if f.get("containerType") == "list":
            spark = T.ArrayType(spark)
        elif f.get("containerType") == "map":
            spark = T.MapType(T.StringType(), spark)
        fields.append(T.StructField(f.get("name"), spark, f.get("nullable", "true") != "false", {k: f.get(k) for k in _KEPT if f.get(k) is not None}))
    return T.StructType(fields)


def to_xml(schema: T.StructType, name: str) -> str:
    """The Record element of a schema; the inverse of parse_record for its types."""
    back = {"boolean": "boolean", "int": "integer", "bigint": "long", "double": "number", "string": "string", "timestamp": "date", "binary": "byte", "variant": "variant"}
    root = ET.Element("Record", name=name, type="delimited")
    for f in schema.fields:
        simple = f.dataType.simpleString()
        e = ET.SubElement(root, "Field", name=f.name, type="decimal" if simple.startswith("decimal") else back[simple])
        if simple.startswith("decimal"):
            e.set("length", str(f.dataType.precision))
            e.set("scale", str(f.dataType.scale))
        if not f.nullable:
            e.set("nullable", "false")
        for k, v in f.metadata.items():
            e.set(k, v)
    return ET.tostring(root, encoding="unicode")


#: A port's record in a prompt: its number, its direction and the record's element.
PORT = r"Port (\d+) (reads|writes):\s*(<Record[\s\S]*?</Record>)"
#: Types of text records for values as they are found. Fixed values.
_TEXT = {"int": "integer", "bigint": "long", "double": "number", "boolean": "boolean", "timestamp": "date", "string": "string"}


def port_records(text: Column) -> Column:
    """array(struct(port, role, record, fields)) of the records that a text describes, in order; fields are the names of its fields."""
    t = F.coalesce(text, F.lit(""))
    zipped = F.arrays_zip(*[F.regexp_extract_all(t, F.lit(PORT), i).alias(n) for i, n in ((1, "port"), (2, "role"), (3, "xml"))])
    name = lambda xml: F.regexp_extract(xml, '<Record[^>]*name="([^"]*)"', 1)
    fields = lambda xml: F.regexp_extract_all(xml, F.lit('<Field[^>]*name="([^"]*)"'), 1)
    return F.transform(zipped, lambda z: F.struct(z.port.cast("int").alias("port"), z.role.alias("role"), name(z.xml).alias("record"), fields(z.xml).alias("fields")))


def described(df: DataFrame, name: str) -> str:
    """The Record element that describes a table's columns."""
    root = ET.Element("Record", name=name, type="delimited")
    for column, kind in df.dtypes:
        ET.SubElement(root, "Field", name=column, type=_TEXT.get(kind, "string"))
    return ET.tostring(root, encoding="unicode")


def filled(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Text columns for a record: absent ones null, whole numbers in date fields read as milliseconds since 1970 in UTC."""
    out = []
    for f in schema.fields:
        c = F.col(f.name).cast("string") if f.name in df.columns else F.lit(None).cast("string")
        if isinstance(f.dataType, T.TimestampType):
            c = F.when(c.rlike(r"^-?\d{9,16}\z"), F.date_format(F.timestamp_millis(c.try_cast("bigint")), "yyyy-MM-dd HH:mm:ss.SSS")).otherwise(c)
        out.append(c.alias(f.name))
    return df.select(*out)


def cast_cell(cell: Column, field: T.StructField, pattern: str = "yyyy-MM-dd HH:mm:ss.SSS") -> Column:
    """A text cell in its field's type; text that does not parse gives null (see ``typed`` for rejects)."""
    if isinstance(field.dataType, T.TimestampType):
        return F.try_to_timestamp(cell, F.lit(field.metadata.get("format", pattern)))
    return cell.try_cast(field.dataType)


def typed(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Typed columns and ``_bad``: the names of cells that hold text but do not parse; non-null fields get their zero."""
    values, bad = [], []
    for f in schema.fields:
        v = cast_cell(F.col(f.name), f)
        bad.append(F.when(F.col(f.name).isNotNull() & v.isNull(), F.lit(f.name)))
        zero = _ZERO.get(f.dataType.simpleString())
        values.append((F.coalesce(v, F.lit(zero)) if not f.nullable and zero is not None else v).alias(f.name))
    return df.select(*values, F.array_compact(F.array(*bad)).alias("_bad"))


def encode_cells(df: DataFrame, null: str = "__NULL__", pattern: str = "yyyy-MM-dd HH:mm:ss.SSS") -> DataFrame:
    """Every column as text: nulls as a mark, times in a fixed pattern, decimals at their scale."""
    out = []
    for name, kind in df.dtypes:
        c = F.date_format(name, pattern) if kind.startswith("timestamp") else F.col(name).cast("string")
        out.append(F.coalesce(c, F.lit(null)).alias(name))
    return df.select(*out)
