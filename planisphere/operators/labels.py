"""Image labels: paths into JSON documents, rules, named transforms, dispatch."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def variant_path(path: str) -> str:
    """A dotted path, whose numbers are indexes, as a path into a variant."""
    return "$." + re.sub(r"\.(\d+)(?=\.|$)", r"[\1]", path)


def resolve(label: Column, path: str) -> Column:
    """The text at a dotted path of a variant, itself or its `value` or `_text`; null if it is missing."""
    base = variant_path(path)
    got = lambda p: F.try_variant_get(label, p, "string")
    return F.coalesce(got(base + ".value"), got(base + "._text"), got(base))


def clean(v: Column) -> Column:
    return F.btrim(v, F.lit(" \t\r\n"))


def number(v: Column, kind: str) -> Column:
    """The number that a text begins with, as int or double, in text; null if there is none."""
    if kind == "int":
        return F.regexp_extract(v, r"^\s*([-+]?\d+)", 1).try_cast("long").cast("string")
    return F.regexp_extract(v, r"^\s*([-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?)", 1).try_cast("double").cast("string")


def coerce(v: Column, kind: str) -> Column:
    """As int (a numeric prefix will do) or double, where possible; else the text."""
    return F.coalesce(number(v, kind), v) if kind in ("int", "double") else v


def apply_enum(v: Column, values: Column) -> Column:
    return F.coalesce(F.element_at(values, v), F.element_at(values, F.lit("*")), v)


def capitalize(v: Column) -> Column:
    """All lower, the first character upper; other words stay lower."""
    return F.concat(F.upper(F.substring(v, 1, 1)), F.lower(F.substring(v, F.lit(2), F.length(v))))


def strip_z(v: Column) -> Column:
    return F.regexp_replace(v, "Z$", "")


def frame_code(instrument: Column, number: Column) -> Column:
    """Framing camera codes, by camera and filter."""
    n = number.cast("int")
    return F.when(instrument == "FC1", -203110 - n).when(instrument == "FC2", -203120 - n)


#: The camera's frame codes by view, fixed values.
VIEW_CODES = {"FORE": -152211, "NADIR": -152210, "AFT": -152212}


def view(file_name: Column) -> Column:
    """FORE, AFT or NADIR by the eleventh character of a file name, any case; else null."""
    at = F.lower(F.substring(file_name, 11, 1))
    return F.when(at == "f", "FORE").when(at == "a", "AFT").when(at == "n", "NADIR")


def view_instrument(file_name: Column) -> Column:
    return F.concat_ws("_", F.lit("CH2_TMC"), view(file_name))


def view_frame(file_name: Column) -> Column:
    return apply_enum_only(view(file_name), VIEW_CODES)


def apply_enum_only(v: Column, values: dict) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for kv in values.items() for x in kv)), v)


#: (summing, is the edit mode "0"): first pixel, last dark pixel, dark suffix; fixed values.
DARK = {("1", True): (0, 37, 18), ("1", False): (0, 15, 0), ("2", True): (7, 18, 9), ("2", False): (0, 7, 0)}


def crop(samples: Column, summing: Column, mode: Column) -> Column:
    """struct(samples, start) of an image line without its dark columns; samples at least 0."""
    key = F.concat_ws("|", summing, (F.coalesce(mode, F.lit("")) == "0").cast("string"))  # worked out once for a look-up
    pick = lambda of: F.coalesce(F.element_at(F.create_map(*(F.lit(x) for (s, zero), v in DARK.items() for x in (f"{s}|{str(zero).lower()}", of(v)))), key), F.lit(0))
    return F.struct(F.greatest(F.lit(0), samples - pick(lambda v: v[1] + v[2]) - 1).cast("long").alias("samples"), pick(lambda v: v[0]).cast("long").alias("start"))


def _text(label: Column, *paths: str) -> Column:
    """The first of the paths whose text is not empty."""
    return F.coalesce(*(F.nullif(clean(resolve(label, p)), F.lit("")) for p in paths))


def _crop(value: Column, label: Column, args) -> Column:
    samples = F.coalesce(number(_text(label, "IMAGE.LINE_SAMPLES"), "int").try_cast("long"), F.lit(0))
    return crop(samples, F.coalesce(_text(label, "SPATIAL_SUMMING", "SAMPLING_FACTOR"), F.lit("")), _text(label, "EDIT_MODE_ID", "SAMPLE_FIRST_PIXEL"))["samples"]


def _frame(value: Column, label: Column, args) -> Column:
    return frame_code(_text(label, "INSTRUMENT_ID"), F.coalesce(number(_text(label, "FILTER_NUMBER"), "int").try_cast("int"), F.lit(0)))


#: Named transforms (value's text, label, arguments) -> column. The names are those that specs use, fixed values.
TRANSFORMS: dict[str, Callable[..., Column]] = {
    "capitalize": lambda v, label, args: capitalize(v), "remove_start_time_z": lambda v, label, args: strip_z(v), "mroctx_crop": _crop,
    "dawnfc_naifframecode": _frame, "ch2tmc_instrument_id": lambda v, label, args: view_instrument(v), "ch2tmc_naifframecode": lambda v, label, args: view_frame(v),
}
#: Those that give numbers.
NUMERIC = {"mroctx_crop", "dawnfc_naifframecode", "ch2tmc_naifframecode"}


def register(name: str, function: Callable[..., Column], numeric: bool = False) -> None:
    """Offer one more transform; function takes (value's text, label, arguments) as columns and may hold a UDF."""
    TRANSFORMS[name] = function
    NUMERIC.discard(name)
    NUMERIC.update({name} if numeric else ())


def transform(name: str) -> Callable[..., Column]:
    if name not in TRANSFORMS:
        raise ValueError(f"no transform {name}")
    return TRANSFORMS[name]


def translate(labels: DataFrame, rules: list[dict]) -> DataFrame:
    """label_id, ord, keyword, value, unit of every keyword that the rules give.

    A rule has `out`, and any of const, from, fallback, transform, default, enum, type,
    unit. const beats from, from beats fallback; then transform, default, enum and type
    apply, in this order; a keyword without a value is left out. labels: label_id, label
    (variant). Rules are parameters, so one pass over the labels makes all keywords.
    """
    made = []
    for k, r in enumerate(rules):
        apply = transform(r["transform"]) if r.get("transform") else None
        if "const" in r:
            v = F.lit(str(r["const"]))
        else:
            v = F.coalesce(*(clean(resolve(F.col("label"), p)) for p in (r.get("from"), r.get("fallback")) if p), F.lit(None).cast("string"))
        v = apply(v, F.col("label"), r.get("args")).cast("string") if apply else v
        v = F.coalesce(v, F.lit(r["default"]).cast("string")) if "default" in r else v
        if enum := r.get("enum"):
            v = apply_enum(v, F.create_map(*(F.lit(x) for kv in enum.items() for x in kv)))
        v = coerce(v, r.get("type", "string"))
        made.append(F.struct(F.lit(k).alias("ord"), F.lit(r["out"]).alias("keyword"), v.alias("value"), F.lit(r.get("unit")).cast("string").alias("unit")))
    return labels.select("label_id", F.explode(F.array(*made)).alias("k")).select("label_id", "k.*").where("value is not null")


def to_json(translated: DataFrame) -> DataFrame:
    """label_id, json: the keywords of a label, in the rules' order."""
    entry = lambda e: F.struct(e["keyword"].alias("keyword"), e["value"].alias("value"), e["unit"].alias("unit"))
    grouped = translated.groupBy("label_id").agg(F.array_sort(F.collect_list(F.struct("ord", "keyword", "value", "unit"))).alias("e"))
    return grouped.select("label_id", F.to_json(F.transform("e", entry)).alias("json"))


#: Where labels name the spacecraft and the instrument, in order of trust; fixed values.
CRAFT_PATHS = ["SPACECRAFT_NAME", "MISSION_NAME", "INSTRUMENT_HOST_NAME", "QUBE.MISSION_NAME", "QUBE.SPACECRAFT_NAME", "Product_Observational.Observation_Area.Investigation_Area.name"]
INSTRUMENT_PATHS = ["INSTRUMENT_ID", "QUBE.INSTRUMENT_ID", "Product_Observational.Observation_Area.Observing_System.Observing_System_Component.1.name"]


#: What tells a product's type, in this order: a path that is there, and the type; fixed values.
PRODUCTS = [
    ("Product_Observational.product_class", "pds4"), ("Product_Observational.Identification_Area.product_class", "pds4"), ("QUBE", "qube"),
    ("PDS_VERSION_ID", "pds3"), ("CCSD3ZF0000100000001NJPL3IF0PDS200000001", "pds3"),
]
#: Types that use the specs of another.
_SHARED = {"qube": "pds3", "unknown": "pds3"}


def product(label: Column) -> Column:
    """pds4, qube, pds3 or unknown, by what the label has."""
    has = lambda path: F.try_variant_get(label, f"$.{path}", "variant").isNotNull()
    return F.coalesce(*(F.when(has(path), kind) for path, kind in PRODUCTS), F.lit("unknown"))


def dispatch(labels: DataFrame, crafts: DataFrame, specs: DataFrame) -> DataFrame:
    """labels with product, spacecraft, instrument and the spec for them; null where none fits.

    crafts: spacecraft, craft_id, instr_override, instr_map (map); an override beats the
    map. specs: craft_id, instr, spec and, if it matters, product (qube and unknown use
    those of pds3). Both are small; Catalyst broadcasts by their size.
    """
    first = lambda paths: F.coalesce(*(F.nullif(clean(resolve(F.col("label"), p)), F.lit("")) for p in paths))
    out = labels.withColumns({"spacecraft": first(CRAFT_PATHS), "instrument": first(INSTRUMENT_PATHS), "product": product(F.col("label"))}).join(crafts, "spacecraft", "left")
    out = out.withColumns({"craft_id": F.coalesce("craft_id", "spacecraft"), "instr": F.coalesce("instr_override", F.element_at("instr_map", F.col("instrument")), "instrument")})
    if "product" not in specs.columns:
        return out.join(specs, ["craft_id", "instr"], "left").select(*labels.columns, "product", "spacecraft", "instrument", "spec")
    shared = F.coalesce(*(F.when(F.col("product") == a, b) for a, b in _SHARED.items()), "product")
    out = out.withColumn("kind", shared).join(specs.withColumnRenamed("product", "kind"), ["craft_id", "instr", "kind"], "left")
    return out.select(*labels.columns, "product", "spacecraft", "instrument", "spec")


def merge_specs(base: list[dict], over: list[dict]) -> list[dict]:
    """Rules of `over` replace those of `base` for the same keyword in their place; others follow."""
    new = {r["out"]: r for r in over}
    return [new.pop(r["out"], r) for r in base] + [r for r in over if r["out"] in new]


def sanitize_key(key: str) -> str:
    """A leading ^ becomes ptr, and : an underscore."""
    return (f"ptr{key[1:]}" if key.startswith("^") else key).replace(":", "_")
