"""Labels from text: PVL and XML to JSON, sensor documents, body detection, input checks."""

from __future__ import annotations

import json
import re
import xml.etree.ElementTree as ET

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.labels import sanitize_key


def _scalar(text: str):
    t = text.strip()
    unit = re.fullmatch(r"(.*?)\s*<([^>]*)>", t)
    if unit:
        return {"value": _scalar(unit[1]), "unit": unit[2]}
    if t[:1] in "({" and t[-1:] in ")}":
        return [_scalar(x) for x in re.findall(r'"[^"]*"|[^,]+', t[1:-1]) if x.strip()]
    if t[:1] in "\"'" and t[-1:] == t[:1]:
        return t[1:-1]
    for kind in (int, float):
        try:
            return kind(t)
        except ValueError:
            pass
    return t


def parse_pvl(text: str) -> dict:
    """A PVL label as nested dicts; repeated names become lists; units become {value, unit}."""
    text = re.sub(r"/\*.*?\*/", "", text, flags=re.S)
    root: dict = {}
    stack = [root]
    for m in re.finditer(r"^\s*([\^\w:]+)\s*=\s*((?:\"[^\"]*\"|\([^)]*\)|\{[^}]*\}|[^\n\"({])*)|^\s*(END\w*)\b.*$", text, re.M):
        key, value, end = m[1], m[2], m[3]
        if end == "END" or (key is None and end == "END"):
            break
        if end or (key or "").upper() in ("END_OBJECT", "END_GROUP"):
            stack = stack[:-1] if len(stack) > 1 else stack
            continue
        put = {} if key.upper() in ("OBJECT", "GROUP") else _scalar(value)
        name = sanitize_key(value.strip().strip('"') if put == {} and key.upper() in ("OBJECT", "GROUP") else key)
        here = stack[-1]
        here[name] = put if name not in here else [*(here[name] if isinstance(here[name], list) else [here[name]]), put]
        if key.upper() in ("OBJECT", "GROUP"):
            stack.append(put)
    return root


def xml_to_dict(text: str) -> dict:
    """An XML label: attributes as attrib_name, repeats as lists, text as itself or _text."""

    def node(e: ET.Element):
        out: dict = {f"attrib_{sanitize_key(k.split('}')[-1])}": v for k, v in e.attrib.items()}
        for child in e:
            name, v = sanitize_key(child.tag.split("}")[-1]), node(child)
            out[name] = v if name not in out else [*(out[name] if isinstance(out[name], list) else [out[name]]), v]
        said = (e.text or "").strip()
        if not out:
            return said
        return out | ({"_text": said} if said else {})

    root = ET.fromstring(text)
    return {sanitize_key(root.tag.split("}")[-1]): node(root)}


def label_json(text: str | None) -> str | None:
    """A label of either kind as JSON; null if it is neither."""
    if not text:
        return None
    try:
        return json.dumps(xml_to_dict(text) if text.lstrip().startswith("<") else parse_pvl(text))
    except ET.ParseError:
        return None


def read_labels(df: DataFrame, text: str) -> DataFrame:
    """df with label, a variant, of a text column. Labels nest without bound, so a Python function parses them, in Arrow batches."""
    from pyspark.sql.types import StringType

    parse = F.udf(label_json, StringType(), useArrow=True)
    return df.withColumn("label", F.try_parse_json(parse(F.col(text))))


#: Body codes, names and mean radii in km, fixed values.
BODIES = [(199, "MERCURY", 2439.7), (299, "VENUS", 6051.8), (399, "EARTH", 6371.0), (301, "MOON", 1737.4), (499, "MARS", 3389.5), (599, "JUPITER", 69911.0), (699, "SATURN", 58232.0)]


def body(code: Column, name: Column, platform: Column, radius_km: Column) -> Column:
    """The target: by code, else by name, else by a word in the platform's name, else by radius (1 %)."""
    p = F.lower(platform)
    by_word = [F.when(p.contains(n.lower()), n) for _, n, _ in BODIES] + [F.when(p.contains("lunar"), "MOON")]
    by_size = [F.when(F.abs(radius_km - r) <= r * 0.01, n) for _, n, r in BODIES]
    return F.coalesce(*(F.when(code == c, n) for c, n, _ in BODIES), F.upper(name), *by_word, *by_size)


def _said(rules: list[tuple[Column, str | Column]]) -> Column:
    """The messages of the rules that hold, in order."""
    made = [F.when(F.coalesce(c, F.lit(False)), F.lit(m) if isinstance(m, str) else m) for c, m in rules]
    return F.filter(F.array(*made), lambda m: m.isNotNull())


def url_problems(url: Column) -> Column:
    """Messages on what is wrong with a URL; an empty array if nothing is."""
    return _said([(url.isNull() | (F.btrim(url) == ""), "empty"), (~url.rlike(r"(?i)^(https?|s3|file)://"), "scheme"), (url.rlike(r"\s"), "blank inside"), (~url.rlike(r"://[^/?#]+"), "no host")])


def _told(errors: Column, warnings: Column) -> Column:
    """struct(error, warnings): the first error, and the warnings of what has none."""
    return F.struct(F.get(errors, 0).alias("error"), F.when(F.size(errors) == 0, warnings).otherwise(F.array().cast("array<string>")).alias("warnings"))


def url_check(url: Column, endings: tuple[str, ...] = ()) -> Column:
    """struct(error, warnings) of the address of a remote file: only http and https, a host with a dot or localhost, one of the endings if given."""
    host = F.lower(F.regexp_extract(url, r"(?i)^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    path = F.lower(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1))
    ends = F.lit(False)
    for e in endings:
        ends = ends | path.endswith(e.lower())
    errors = _said([
        (url.isNull() | (F.btrim(url) == ""), "empty"), (~url.rlike(r"(?i)^[a-z][a-z0-9+.-]*:"), "no URL"), (~url.rlike(r"(?i)^https?:"), "scheme"),
        (~(host.contains(".") | (host == "localhost")), "host"), (~ends if endings else F.lit(False), "ending"),
    ])
    return _told(errors, _said([(host.isin("localhost", "127.0.0.1"), "localhost"), (url.rlike("(?i)^http:"), "not encrypted")]))


def raster_check(head: Column, width: Column, height: Column, size: Column, images: Column, compression: Column) -> Column:
    """struct(error, warnings) of a raster file by its first bytes and what its tags say; size in bytes."""
    magic, mb = F.hex(F.substring(head, 1, 4)), size / 1048576
    errors = _said([(F.coalesce(size, F.lit(0)) < 8, "too small"), (~magic.isin("49492A00", "4D4D002A"), "no TIFF"), ((width == 1) & (height == 1) & (images > 1), "thumbnail first"), ((width == 1) & (height == 1), "one pixel")])
    ratio = F.greatest(width, height) / F.nullif(F.least(width, height), F.lit(0))
    warnings = _said([((width < 10) | (height < 10), "very small"), (compression != 1, "compressed"), (mb > 500, "very large"), ((mb > 200) & (mb <= 500), "large"), (images > 1, "several images"), (ratio > 100, "very long")])
    return _told(errors, warnings)


def sensor_check(doc: Column) -> Column:
    """struct(error, warnings) of a sensor document (a variant)."""
    has = lambda *paths: F.coalesce(*(F.when(F.try_variant_get(doc, f"$.{p}", "variant").isNotNull(), F.lit(True)) for p in paths), F.lit(False))
    samples, lines_ = (F.try_variant_get(doc, f"$.image_{k}", "double") for k in ("samples", "lines"))
    shape = F.coalesce(F.schema_of_variant(doc), F.lit("VOID"))
    errors = _said([(~shape.startswith("OBJECT"), "no object"), ((samples != 0) & (lines_ != 0) & ((samples < 1) | (lines_ < 1)), "dimensions")])
    warnings = _said([
        (~has("image_samples") | ~has("image_lines"), "no dimensions"), ((samples == 1) & (lines_ == 1), "one pixel"), (~has("body_rotation.BODY_CODE", "target_name", "name_platform", "radii"), "no body"),
        (has("radii") & ~(has("radii.semimajor") & has("radii.semiminor")), "radii incomplete"), (~has("radii"), "no radii"),
        (~has("name_sensor", "sensor_identifier", "instrument_id"), "no sensor"), (~has("name_platform", "platform_identifier", "spacecraft_name"), "no platform"),
    ])
    return _told(errors, warnings)


def sensor_problems(doc: Column) -> Column:
    """Fields that a sensor document (a variant) lacks."""
    need = ["image_lines", "image_samples", "name_platform", "radii.semimajor", "instrument_position.positions", "instrument_pointing.quaternions"]
    return _said([(F.try_variant_get(doc, f"$.{n}", "variant").isNull(), f"missing {n}") for n in need])


def state_bytes(text: Column) -> Column:
    """The bytes of a sensor state written in hexadecimal; null if it is not."""
    return F.when(text.rlike("^(?:[0-9A-Fa-f]{2})*$"), F.unhex(text))


def state_text(document: Column) -> Column:
    """The sensor state that a document carries: its own text where it is one, else the text behind `state`, plain or hexadecimal."""
    blob = F.try_variant_get(document, "$.state", "string")
    return F.coalesce(F.decode(state_bytes(blob), "UTF-8"), blob, F.try_variant_get(document, "$", "string"))


def hex_state(blob: Column) -> Column:
    return F.lower(F.hex(blob))
