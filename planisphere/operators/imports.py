"""From a product label to an output label: formats, core description, overrides, arguments, and record output."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Raster cell types and their names in output labels, fixed values.
PIXEL_TYPES = {"Byte": "UnsignedByte", "Int16": "SignedWord", "UInt16": "UnsignedWord", "Int32": "SignedInteger", "UInt32": "UnsignedInteger", "Float32": "Real", "Float64": "Double"}
RESERVED = ("from", "to", "template", "target", "format")


def output_format(path: Column) -> Column:
    """cube, gtiff or auto, by the extension."""
    ext = F.lower(F.regexp_extract(path, r"\.([^./]*)$", 1))
    return F.when(ext.isin("cub", "lbl"), "cube").when(ext.isin("tif", "tiff"), "gtiff").otherwise("auto")


#: The names inside the description are the output label's, fixed values.
def core(samples: Column, lines: Column, bands: Column, cell_type: Column, base: Column, multiplier: Column) -> Column:
    """The core's description as a struct; without an offset and a scale, 0 and 1."""
    kinds = F.create_map(*(F.lit(x) for kv in PIXEL_TYPES.items() for x in kv))
    dims = F.struct(samples.alias("Samples"), lines.alias("Lines"), bands.alias("Bands"))
    pixels = F.struct(F.coalesce(F.element_at(kinds, cell_type), F.lit("Real")).alias("Type"), F.lit("Lsb").alias("ByteOrder"), F.coalesce(base, F.lit(0.0)).alias("Base"), F.coalesce(multiplier, F.lit(1.0)).alias("Multiplier"))
    return F.struct(F.lit(1).alias("StartByte"), F.lit("BandSequential").alias("Format"), dims.alias("Dimensions"), pixels.alias("Pixels"))


def override_target(translated: DataFrame, target: str) -> DataFrame:
    """TargetName replaced, only in labels that have an Instrument group. translated: label_id, ord, keyword, value."""
    if not target:
        return translated
    have = translated.where((F.col("keyword") == "Group") & (F.col("value") == "Instrument")).select("label_id").distinct()
    rest = translated.join(have.withColumn("has_", F.lit(True)), "label_id", "left")
    kept = rest.where((F.col("keyword") != "TargetName") | F.col("has_").isNull()).drop("has_")
    new = have.select("label_id", F.lit(2**31 - 1).alias("ord"), F.lit("TargetName").alias("keyword"), F.lit(target).alias("value"))
    return kept.unionByName(new, allowMissingColumns=True)


def arguments(tokens: list[str]) -> list[str]:
    """KEY=VALUE of a reserved key, any case, as --key VALUE; other tokens stay."""
    out = []
    for t in tokens:
        key, eq, value = t.partition("=")
        out += [f"--{key.lower()}", value] if eq and key.lower() in RESERVED and not t.startswith("-") else [t]
    return out


def spec_dir(override: str | None, env: str | None, candidates: list[str]) -> str | None:
    """The first that is given, or exists: an override, the environment's, then known places."""
    return override or env or next((c for c in candidates if os.path.isdir(c)), None)


def template(name: str, folder: str) -> str:
    """A template given as a path stays; a bare name stands for a file of the folder."""
    return name if "/" in name or name.endswith(".json") else os.path.join(folder, f"{name}.json")


def written(records: DataFrame, style: str, columns: list[str]) -> DataFrame:
    """point_idx, text: records as json, as pvl (Key = value) or as aligned text."""
    if style == "json":
        return records.select("point_idx", F.to_json(F.struct(*columns)).alias("text"))
    width = max(map(len, columns))
    line = (lambda c: F.concat(F.lit(f"  {c} = "), F.col(c).cast("string"))) if style == "pvl" else (lambda c: F.concat(F.lit(f"{c.ljust(width)}  "), F.col(c).cast("string")))
    body = F.concat_ws("\n", *(line(c) for c in columns))
    return records.select("point_idx", (F.concat(F.lit("Group = GroundPoint\n"), body, F.lit("\nEnd_Group\n")) if style == "pvl" else body).alias("text"))
