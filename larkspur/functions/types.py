"""Declared column types and the Spark types that carry them."""

from __future__ import annotations

import enum

from pyspark.sql import types as T


class DeclaredType(enum.Enum):
    I8 = "I8"
    I16 = "I16"
    I32 = "I32"
    I64 = "I64"
    U8 = "U8"
    U16 = "U16"
    U32 = "U32"
    U64 = "U64"
    F32 = "F32"
    F64 = "F64"
    BOOL = "Bool"
    STR = "Str"

    @property
    def bits(self) -> int | None:
        return int(self.value[1:]) if self.value[1:].isdigit() else None

    @property
    def signed(self) -> bool:
        return self.value[0] == "I"

    @property
    def integral(self) -> bool:
        return self.value[0] in "IU"

    @property
    def floating(self) -> bool:
        return self.value[0] == "F"

    @property
    def numeric(self) -> bool:
        return self.integral or self.floating

    @property
    def bounds(self) -> tuple[int, int]:
        """Least and greatest value of an integer type."""
        if not self.integral:
            raise ValueError(f"{self.value} has no integer range")
        return (-(1 << self.bits - 1), (1 << self.bits - 1) - 1) if self.signed else (0, (1 << self.bits) - 1)

    @property
    def spark(self) -> T.DataType:
        """Unsigned types take the next wider signed one."""
        return SPARK[self]


SPARK = {
    DeclaredType.I8: T.ByteType(),
    DeclaredType.I16: T.ShortType(),
    DeclaredType.I32: T.IntegerType(),
    DeclaredType.I64: T.LongType(),
    DeclaredType.U8: T.ShortType(),
    DeclaredType.U16: T.IntegerType(),
    DeclaredType.U32: T.LongType(),
    DeclaredType.U64: T.DecimalType(20, 0),
    DeclaredType.F32: T.FloatType(),
    DeclaredType.F64: T.DoubleType(),
    DeclaredType.BOOL: T.BooleanType(),
    DeclaredType.STR: T.StringType(),
}
PLAIN = {
    "byte": DeclaredType.I8, "short": DeclaredType.I16, "integer": DeclaredType.I32, "long": DeclaredType.I64,
    "float": DeclaredType.F32, "double": DeclaredType.F64, "boolean": DeclaredType.BOOL, "string": DeclaredType.STR,
}


def declared_of(field: T.StructField) -> DeclaredType | None:
    """The type a field was declared with, or that which its Spark type stands for; None for others."""
    name = (field.metadata or {}).get("declared")
    return DeclaredType(name) if name else PLAIN.get(field.dataType.typeName())


def field(name: str, declared: DeclaredType) -> T.StructField:
    return T.StructField(name, declared.spark, False, {"declared": declared.value})
