"""Points, attributes and their names and types."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Attribute types (fixed values) and the Spark types that hold them; Spark has no unsigned types.
SPARK_TYPES: dict[str, T.DataType] = {
    "int8": T.ByteType(),
    "uint8": T.ShortType(),
    "int16": T.ShortType(),
    "uint16": T.IntegerType(),
    "int32": T.IntegerType(),
    "uint32": T.LongType(),
    "int64": T.LongType(),
    "uint64": T.DecimalType(20, 0),
    "bool": T.BooleanType(),
    "float32": T.FloatType(),
    "float64": T.DoubleType(),
}

NUMPY_TYPES: dict[str, str] = {"int8": "<i1", "uint8": "<u1", "int16": "<i2", "uint16": "<u2", "int32": "<i4", "uint32": "<u4", "int64": "<i8", "uint64": "<u8", "bool": "<u1", "float32": "<f4", "float64": "<f8"}

#: What each output format can hold, and as what (fixed values).
OUTPUT_TYPES: dict[str, dict[str, str]] = {
    "pnts": {t: t for t in ("int8", "uint8", "int16", "uint16", "int32", "uint32", "float32", "float64")} | {"bool": "uint8"},
    "glb": {t: t for t in ("int8", "uint8", "int16", "uint16", "float32")} | {"bool": "uint8", "float64": "float32"},
    "metadata": {t: t for t in SPARK_TYPES} | {"bool": "uint8"},
}

POSITION = ("x", "y", "z")
COLOUR = ("r", "g", "b")
DEFAULT_ATTRIBUTES = ("intensity", "classification")

#: Output spellings of the standard attributes (fixed values).
_STANDARD = {"intensity": "INTENSITY", "classification": "CLASSIFICATION", "return_number": "RETURN_NUMBER", "number_of_returns": "NUMBER_OF_RETURNS"}


def canonical(name: str) -> str:
    """Lower case, no white space."""
    return "".join(name.split()).lower()


def canonical_column(name: Column) -> Column:
    return F.lower(F.regexp_replace(name, r"\s+", ""))


def requested(names: str | list[str]) -> list[str]:
    """Canonical attribute names without repeats, in order; "none" empties the list."""
    each = names.split(",") if isinstance(names, str) else names
    out = list(dict.fromkeys(c for c in map(canonical, each) if c))
    return [] if "none" in out else out


def output_name(name: str, kind: str = "pnts") -> str:
    """Upper case; other characters become underscores; glTF asks for a leading underscore."""
    clean = canonical(name)
    out = _STANDARD.get(clean) or "".join(c if c.isascii() and (c.isalnum() or c == "_") else "_" for c in clean).upper()
    return "_" + out.lstrip("_") if kind == "glb" else out


def output_name_column(name: Column, kind: str = "pnts") -> Column:
    clean = F.upper(F.regexp_replace(canonical_column(name), "[^a-z0-9_]", "_"))
    return F.concat(F.lit("_"), F.regexp_replace(clean, "^_+", "")) if kind == "glb" else clean


def field(name: str, kind: str) -> T.StructField:
    return T.StructField(name, SPARK_TYPES[kind], True, {"attr_type": kind})


def merged_types(files: list[dict[str, str]]) -> dict[str, str]:
    """Attributes and types of several files together, in the order in which they come up; one name with two types is an error."""
    out: dict[str, str] = {}
    for own in files:
        for name, kind in own.items():
            if out.setdefault(name, kind) != kind:
                raise TypeError(f"{name}: {out[name]} in one file and {kind} in another")
    return out


def attribute_type(f: T.StructField) -> str:
    """The declared type of an attribute, or the one that its Spark type suggests."""
    if "attr_type" in f.metadata:
        return f.metadata["attr_type"]
    by_kind = {T.ByteType: "int8", T.ShortType: "int16", T.IntegerType: "int32", T.LongType: "int64", T.BooleanType: "bool", T.FloatType: "float32", T.DoubleType: "float64", T.DecimalType: "uint64"}
    try:
        return by_kind[type(f.dataType)]
    except KeyError:
        raise ValueError(f"{f.name}: {f.dataType.simpleString()} is no attribute type") from None


def attributes(df: DataFrame) -> list[T.StructField]:
    """The attribute columns: all but position, colour and what tiling adds."""
    own = {*POSITION, *COLOUR, "file_id", "pos", "point_id", "leaf", "tile", "level"}
    return [f for f in df.schema.fields if f.name not in own]


def exported(df: DataFrame, kind: str) -> list[tuple[T.StructField, str]]:
    """(field, type in the output) of the attributes that the format can hold."""
    return [(f, OUTPUT_TYPES[kind][attribute_type(f)]) for f in attributes(df) if attribute_type(f) in OUTPUT_TYPES[kind]]


def zero(kind: T.DataType) -> Column:
    return F.lit(False) if isinstance(kind, T.BooleanType) else F.lit(0).cast(kind)


def union_points(frames: list[DataFrame]) -> DataFrame:
    """All points of several sources: the first one's columns, zero where a source lacks one.

    The same name with another type is an error.
    """
    first = frames[0].schema
    for df in frames[1:]:
        for f in df.schema.fields:
            if f.name in first.names and first[f.name].dataType != f.dataType:
                raise TypeError(f"{f.name}: {first[f.name].dataType.simpleString()} and {f.dataType.simpleString()}")
    out = None
    for i, df in enumerate(frames):
        columns = [(F.col(f.name) if f.name in df.columns else zero(f.dataType)).alias(f.name) for f in first.fields if f.name != "file_id"]
        mine = df.select(F.lit(i).alias("file_id"), *columns)
        out = mine if out is None else out.unionByName(mine)
    return out


def one_crs(found: list[str | None]) -> str | None:
    """The CRS of several files: those that name one must agree, the others inherit it."""
    named = {c for c in found if c}
    if len(named) > 1:
        raise ValueError(f"the files have several CRS: {', '.join(sorted(named))}")
    return named.pop() if named else None
