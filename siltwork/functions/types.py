"""Field types of the log model, their Spark types, and the declared-type conversion."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPARK = {
    "chars": T.StringType(), "digit": T.LongType(), "float": T.DoubleType(), "bool": T.BooleanType(), "time": T.TimestampNTZType(),
    "ip": T.StringType(), "ipnet": T.StringType(), "hex": T.StringType(), "json": T.StringType(), "symbol": T.StringType(), "domain": T.StringType(),
    "email": T.StringType(), "url": T.StringType(), "id_card": T.StringType(), "mobile_phone": T.StringType(), "sn": T.StringType(),
}
TEXTUAL = frozenset(("chars", "symbol", "domain", "email", "url", "id_card", "mobile_phone", "sn", "ipnet", "json"))
NUMERIC = frozenset(("digit", "float"))


@dataclass(frozen=True)
class Field:
    """A column with the type its values have in the log model; NULL stands for absent and ignored."""

    column: Column
    kind: str

    def with_column(self, column: Column, kind: str | None = None) -> "Field":
        return Field(column, kind or self.kind)


def kind_of(data_type: T.DataType) -> str:
    if isinstance(data_type, T.StringType):
        return "chars"
    if isinstance(data_type, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "digit"
    if isinstance(data_type, (T.FloatType, T.DoubleType, T.DecimalType)):
        return "float"
    if isinstance(data_type, T.BooleanType):
        return "bool"
    if isinstance(data_type, (T.TimestampNTZType, T.TimestampType, T.DateType)):
        return "time"
    if isinstance(data_type, T.ArrayType):
        return "array"
    if isinstance(data_type, (T.StructType, T.MapType, T.VariantType)):
        return "obj"
    return "chars"


def widen(column: Column, kind: str) -> Column:
    """Integers as bigint, numbers as double: the two numeric types of the model."""
    return column.cast({"digit": "bigint", "float": "double"}[kind]) if kind in NUMERIC else column


def as_text(field: Field) -> Column:
    """The raw text of any value."""
    if field.kind in TEXTUAL or field.kind in ("ip", "hex"):
        return field.column
    if field.kind in ("obj", "array"):
        return F.to_json(field.column)
    if field.kind == "time":
        return F.date_format(field.column, "yyyy-MM-dd HH:mm:ss")
    return field.column.cast("string")


_FLOAT = r"^[+-]?(?:[0-9]+\.?[0-9]*(?:[eE][+-]?[0-9]+)?|\.[0-9]+(?:[eE][+-]?[0-9]+)?|[iI][nN][fF](?:[iI][nN][iI][tT][yY])?|[nN][aA][nN])$"
_IP4 = r"^(?:(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])$"


def convert(field: Field, declared: str) -> Field:
    """A value to its declared type; text that does not parse strictly becomes NULL."""
    if declared in ("auto", field.kind):
        return field
    if declared == "chars":
        return Field(as_text(field), "chars")
    if field.kind == "chars":
        c = field.column
        if declared == "bool":
            return Field(F.when(c == "true", True).when(c == "false", False), "bool")
        if declared == "digit":
            return Field(F.when(c.rlike(r"^[+-]?[0-9]+$"), c.try_cast("bigint")), "digit")
        if declared == "float":
            return Field(F.when(c.rlike(_FLOAT), c.try_cast("double")), "float")
        if declared == "ip":
            return Field(F.when(c.rlike(_IP4), c), "ip")
    return field  # any other pair keeps the value as it is
