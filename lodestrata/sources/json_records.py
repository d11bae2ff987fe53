"""JSON in: schema discovery, ingest by schema, remapped paths, passthrough of unknown fields, keys without loading."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def discover(df: DataFrame, column: str = "value", sample: float = 1.0, maps: Sequence[str] = (), strict: bool = False) -> T.StructType:
    """The schema of JSON texts: integers long, fractions double, conflicts string; objects at `maps` (dotted paths) become maps.

    Texts that aren't JSON are left out; strict: they raise.
    """
    spark = df.sparkSession
    texts = df.select(F.col(column).cast("string")).filter(F.col(column).isNotNull())
    if strict and not (bad := texts.filter(F.try_parse_json(F.col(column)).isNull())).isEmpty():
        raise ValueError(f"not JSON: {bad.first()[0][:200]}")
    strings = getattr(texts._jdf, "as")(spark._jvm.org.apache.spark.sql.Encoders.STRING())
    reader = spark._jsparkSession.read().option("samplingRatio", str(sample)).option("mode", "DROPMALFORMED")
    found = T._parse_datatype_json_string(reader.json(strings).schema().json())

    def visit(kind: T.DataType, path: str) -> T.DataType:
        if isinstance(kind, T.StructType):
            if path in maps:
                kinds = {f.dataType.simpleString(): visit(f.dataType, f"{path}.*") for f in kind}
                return T.MapType(T.StringType(), next(iter(kinds.values())) if len(kinds) == 1 else T.StringType())
            return T.StructType([T.StructField(f.name, visit(f.dataType, f"{path}.{f.name}".lstrip("."))) for f in kind])
        return T.ArrayType(visit(kind.elementType, path)) if isinstance(kind, T.ArrayType) else kind

    return visit(found, "")


def ingest(df: DataFrame, schema: T.StructType, column: str = "value", remap: Mapping[str, str] | None = None, processors: Mapping[str, Callable[[Column], Column]] | None = None) -> DataFrame:
    """Records of JSON texts by schema: a missing field is null, an unknown one ignored. Maps may be objects or [{"key", "value"}] lists.

    remap: field -> dotted source path; processors: field -> function of its column.
    """
    structured = [f.name for f in schema if isinstance(f.dataType, T.MapType)]
    wide = T.StructType([T.StructField(f"__e_{n}", T.ArrayType(T.StructType([T.StructField("key", schema[n].dataType.keyType), T.StructField("value", schema[n].dataType.valueType)]))) for n in structured])
    rows = df.select(F.from_json(column, schema).alias("r"), F.col(column).alias("__json"))
    out = []
    for f in schema:
        c = F.col(f"r.`{f.name}`")
        if remap and f.name in remap:
            c = F.get_json_object("__json", "$." + remap[f.name])
            c = c.cast(f.dataType) if not isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType)) else F.from_json(c, f.dataType)
        elif f.name in structured:
            listed = F.from_json(F.get_json_object("__json", f"$.{f.name}"), wide[f"__e_{f.name}"].dataType)
            listed = F.filter(listed, lambda e: e["key"].isNotNull())
            c = F.when(F.substring(F.ltrim(F.get_json_object("__json", f"$.{f.name}")), 1, 1) == "[", F.map_from_entries(listed)).otherwise(c)
        if processors and f.name in processors:
            c = processors[f.name](c)
        out.append(c.alias(f.name))
    return rows.select(*out)


def array_records(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Records of files that hold one JSON array or object each."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def chunks(df: DataFrame, column: str = "value", keep: Sequence[str] = ()) -> DataFrame:
    """The elements of JSON array texts, a row each, as texts: a big array is cut once and its elements parsed wherever they lie. (record, *keep, position, value)

    A text that isn't JSON has no elements. One of 20 MB or more that can't be parsed raises, as it may be an array beyond a variant's 128 MiB or hold a string of over 20 million characters.
    keep: columns of df beside each element; don't join them back instead, as Spark takes these rows for hundreds of times smaller than they are and would broadcast them.
    """
    if clash := {"record", "position", "value"} & set(keep):
        raise ValueError(f"keep has names of the result: {sorted(clash)}")
    size = F.octet_length(column)
    too_big = F.raise_error(F.concat(F.lit("can't be cut into elements: a text of "), size.cast("string"), F.lit(" bytes that isn't JSON or is too large for a variant")))
    elements = F.variant_get(F.coalesce(F.try_parse_json(column), F.when(size >= 20_000_000, too_big)), "$", "array<variant>")
    return df.select(F.monotonically_increasing_id().alias("record"), *keep, F.posexplode(elements).alias("position", "__v")).select("record", *keep, "position", F.to_json("__v").alias("value"))


def flat_records(df: DataFrame, schema: T.StructType, column: str = "value") -> DataFrame:
    """Each JSON text as one self-contained nested record, column `record`; a text that isn't JSON gives null."""
    return df.select(F.from_json(column, schema).alias("record"))


def passthrough(df: DataFrame, known: Sequence[str], column: str = "value") -> DataFrame:
    """df with single_values (unknown scalars as text) and multi_values (unknown arrays as lists of text); nulls and objects are dropped."""
    raw = F.from_json(column, "map<string,string>")
    unknown = F.map_filter(raw, lambda k, v: ~k.isin(list(known)) & v.isNotNull())
    first = lambda v: F.substring(F.ltrim(v), 1, 1)
    single = F.map_filter(unknown, lambda k, v: ~first(v).isin("[", "{"))
    multi = F.transform_values(F.map_filter(unknown, lambda k, v: first(v) == "["), lambda k, v: F.from_json(v, "array<string>"))
    return df.select("*", single.alias("single_values"), multi.alias("multi_values"))


def find_key(df: DataFrame, paths: Sequence[str], column: str = "value") -> DataFrame:
    """Key fields straight from the text."""
    return df.select("*", *[F.get_json_object(column, "$." + p).alias(p.replace(".", "_")) for p in paths])
