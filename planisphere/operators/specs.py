"""Translation specs: groups of keyword rules that turn product labels into output labels.

A spec is a dict: `groups`, each with `name`, `parent` (ROOT by default) and `keywords`;
`core` with a transform that is checked by name; `extends`, the name of a base spec. A
keyword rule has `out` and any of const, from, fallback_from, transform,
transform_args, default, enum, type (int, double, string) and unit.

Rules are parameters and a label is a variant column, so a spec becomes expressions of a
row: no shuffle, however many keywords. A value is held as a struct of its text, whether
it is a JSON string, and its items if it is an array. Over a table, what a rule uses more
than once becomes a column, so that Spark compiles it; a single expression binds it by `let`.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.binding import let
from . import imports, labels

ROOT = "Cube"
_ITEM = "struct<text:string,quoted:boolean>"
_VALUE = f"struct<text:string,quoted:boolean,items:array<{_ITEM}>>"


def merge_groups(base: list[dict], over: list[dict]) -> list[dict]:
    """Groups of `over` replace those of `base` with the same parent and name, in their place; others follow."""
    key = lambda g: (g.get("parent", ROOT), g["name"])
    new = {key(g): g for g in over}
    return [new.get(key(g), g) for g in base] + [new[k] for k in dict.fromkeys(map(key, over)) if k not in set(map(key, base))]


def load(read: Callable[[str], dict], name: str) -> dict:
    """The spec of a name, its groups merged over those of the spec it extends; a base's own base is not followed."""
    own = read(name)
    base = read(own["extends"]) if own.get("extends") else {}
    return {**base, **own, "groups": merge_groups(base.get("groups", []), own.get("groups", []))}


def _quote(text: Column) -> Column:
    array = F.to_json(F.array(text))
    return F.substring(array, F.lit(2), F.length(array) - 2)


def _literal(value) -> Column:
    """A JSON value of a spec as a value struct."""
    one = lambda v: F.struct(F.lit(v if isinstance(v, str) else json.dumps(v)).alias("text"), F.lit(isinstance(v, str)).alias("quoted"))
    items = F.array(*map(one, value)).cast(f"array<{_ITEM}>") if isinstance(value, list) else F.lit(None).cast(f"array<{_ITEM}>")
    text = F.lit(None).cast("string") if isinstance(value, list) else one(value)["text"]
    return F.struct(text.alias("text"), F.lit(isinstance(value, str)).alias("quoted"), items.alias("items")).cast(_VALUE)


def _none() -> Column:
    return F.lit(None).cast(_VALUE)


class _Columns:
    """Binds values, in place of `let`, as columns of a table: the n-th of a rule in the n-th of the steps that make them."""

    def __init__(self, prefix: str = ""):
        self.prefix, self.steps, self.at = prefix, [], 0

    def __call__(self, value: Column, body: Callable[[Column], Column]) -> Column:
        self.steps += [{}] * (self.at + 1 - len(self.steps))
        name = f"spec_{self.prefix}_{self.at}_{len(self.steps[self.at])}_"
        self.steps[self.at] = {**self.steps[self.at], name: value}
        self.at += 1
        return body(F.col(name))

    def on(self, df: DataFrame) -> DataFrame:
        for step in self.steps:
            df = df.withColumns(step)
        return df


def _scalar(v: Column, kind: Column | None = None) -> Column:
    """A variant's text, trimmed if it is a string."""
    is_text = F.coalesce((F.schema_of_variant(v) if kind is None else kind) == "STRING", F.lit(False))
    return F.struct(F.when(is_text, labels.clean(F.try_variant_get(v, "$", "string"))).otherwise(F.to_json(v)).alias("text"), is_text.alias("quoted"))


def value(label: Column, path: str, bind: Callable = let) -> Column:
    """The value at a dotted path: itself, its `value` or its `_text`; items of an array lose their own units; null if missing."""
    got = lambda v, p: F.try_variant_get(v, p, "variant")
    items = lambda v: F.transform(F.try_variant_get(v, "$", "array<variant>"), lambda e: let(F.coalesce(got(e, "$.value"), e), lambda x: _scalar(x)))
    array = lambda v: F.struct(F.lit(None).cast("string").alias("text"), F.lit(False).alias("quoted"), items(v).alias("items")).cast(_VALUE)
    single = lambda v, kind: bind(_scalar(v, kind), lambda x: F.struct(x["text"].alias("text"), x["quoted"].alias("quoted"), F.lit(None).cast(f"array<{_ITEM}>").alias("items")).cast(_VALUE))

    def of(v: Column) -> Column:
        return bind(F.schema_of_variant(v), lambda kind: F.when(v.isNotNull() & (kind != "VOID"), F.when(kind.startswith("ARRAY"), array(v)).otherwise(single(v, kind))))

    base = labels.variant_path(path)
    return bind(F.coalesce(got(label, base + ".value"), got(label, base + "._text"), got(label, base)), of)


def written(v: Column) -> Column:
    """A value as JSON text."""
    one = lambda x: F.when(x["quoted"], _quote(x["text"])).otherwise(x["text"])
    return F.when(v["items"].isNotNull(), F.concat(F.lit("["), F.array_join(F.transform(v["items"], one), ","), F.lit("]"))).otherwise(one(v))


def _single(text: Column, quoted: bool) -> Column:
    return F.struct(text.alias("text"), F.lit(quoted).alias("quoted"), F.lit(None).cast(f"array<{_ITEM}>").alias("items")).cast(_VALUE)


def numeric_if_possible(v: Column, bind: Callable = let) -> Column:
    """A string that is a whole number, or else a decimal one that begins with a digit, as that number."""
    whole, decimal = r"^\s*[-+]?\d+$", r"^\s*[-+]?\d+(\.\d*)?([eE][-+]?\d+)?$"
    text = v["text"]
    number = F.when(text.rlike(whole), text.try_cast("long").cast("string")).when(text.rlike(decimal), text.try_cast("double").cast("string"))
    return F.when(v["quoted"] & v["items"].isNull(), bind(number, lambda n: F.when(n.isNotNull(), _single(n, False)).otherwise(v))).otherwise(v)


def _coerce(v: Column, kind: str, bind: Callable = let) -> Column:
    if kind == "string":
        return F.when(v.isNotNull(), _single(F.when(v["items"].isNotNull(), written(v)).otherwise(v["text"]), True))
    number = F.when(v["items"].isNull(), labels.number(v["text"], kind))
    return bind(number, lambda n: F.when(n.isNotNull(), _single(n, False)).otherwise(v))


def _enum(v: Column, values: dict) -> Column:
    """An exact match, else the value for *, else the value itself."""
    table = F.create_map(*(x for k, w in values.items() for x in (F.lit(k), _literal(w))))
    key = F.when(v["items"].isNotNull(), written(v)).otherwise(v["text"])
    return F.when(v.isNotNull(), F.coalesce(F.element_at(table, key), F.element_at(table, F.lit("*")), v))


def keyword(label: Column, rule: dict, bind: Callable = let) -> Column:
    """struct(keyword, value as JSON text, unit) by a rule; null if the rule leaves it out.

    const beats from, from beats fallback_from; then transform, default (where there is no
    value), enum, type and unit apply. Arrays take no unit; a unit's text becomes a number if it is one.
    """
    unit, steps = rule.get("unit"), []
    if "const" in rule:
        v = _literal(rule["const"])
    else:
        v = F.coalesce(*(value(label, rule[k], bind) for k in (("from", "fallback_from") if rule.get("from") else ()) if rule.get(k)), _none())
    if name := rule.get("transform"):
        apply = labels.transform(name)
        made = lambda v: apply(v["text"], label, rule.get("transform_args")).cast("string")
        steps.append(lambda v: bind(made(v), lambda t: F.when(t.isNotNull(), _single(t, name not in labels.NUMERIC))))
    if "default" in rule:
        steps.append(lambda v: F.coalesce(v, _literal(rule["default"])))
    if rule.get("enum"):
        steps.append(lambda v: _enum(v, rule["enum"]))
    if rule.get("type", "auto") in ("int", "double", "string"):
        steps.append(lambda v: _coerce(v, rule["type"], bind))
    if unit:
        steps.append(lambda v: numeric_if_possible(v, bind))
    for step in steps:
        v = bind(v, step)
    with_unit = lambda v: F.when(v["items"].isNull(), F.lit(unit)) if unit else F.lit(None).cast("string")
    return bind(v, lambda v: F.when(v.isNotNull(), F.struct(F.lit(rule["out"]).alias("keyword"), written(v).alias("value"), with_unit(v).alias("unit"))))


def _groups(label: Column, spec: dict, bind: Callable = let) -> list[tuple[str, str, list[tuple[str, Column]]]]:
    """Parent, name and rules of each group: their keyword and what they give."""
    core = spec.get("core", {}).get("transform")
    if core:
        labels.transform(core)  # an unknown name raises

    def made(rule: dict) -> tuple[str, Column]:
        if bind is not let:
            bind.at = 0
        return rule["out"], bind(keyword(label, rule, bind), lambda e: e) if bind is not let else keyword(label, rule)

    return [(g.get("parent", ROOT), g["name"], [made(r) for r in g.get("keywords", [])]) for g in spec.get("groups", [])]


def translate(labels_df: DataFrame, spec: dict) -> DataFrame:
    """label_id, grp, parent, group, ord, keyword, value (JSON text), unit: a row for each keyword, in the spec's order."""
    bind = _Columns()
    groups = _groups(F.col("label"), spec, bind)
    entries = lambda es: F.filter(F.array(*(e for _, e in es)), lambda e: e.isNotNull()) if es else F.array().cast("array<struct<keyword:string,value:string,unit:string>>")
    each = F.array(*(F.struct(F.lit(k).alias("grp"), F.lit(parent).alias("parent"), F.lit(name).alias("group"), entries(es).alias("e")) for k, (parent, name, es) in enumerate(groups)))
    rows = bind.on(labels_df).select("label_id", F.explode(each).alias("g")).select("label_id", "g.grp", "g.parent", "g.group", F.posexplode("g.e").alias("ord", "k"))
    return rows.select("label_id", "grp", "parent", "group", "ord", "k.keyword", "k.value", "k.unit")


def _entry(out: str, e: Column) -> Column:
    """A keyword's struct as JSON text, with its unit if it has one."""
    with_unit = F.concat(F.lit('{"value":'), e["value"], F.lit(',"unit":'), _quote(e["unit"]), F.lit("}"))
    return F.concat(_quote(F.lit(out)), F.lit(":"), F.when(e["unit"].isNotNull(), with_unit).otherwise(e["value"]))


def document(label: Column, spec: dict, target: Column | None = None, bind: Callable = let) -> Column:
    """The output label as JSON text: parents, their groups, their keywords, all in the spec's order.

    target, where it is not null or empty, replaces TargetName in the root's Instrument group.
    """
    parents: dict[str, list[Column]] = {ROOT: []}
    for parent, name, rules in _groups(label, spec, bind):
        texts = []
        for out, e in rules:
            texts.append((out, let(e, lambda e: _entry(out, e)) if bind is let else _entry(out, e)))  # noqa: B023 (called at once)
        if target is not None and (parent, name) == (ROOT, "Instrument"):
            new, given = F.concat(F.lit('"TargetName":'), _quote(target)), F.coalesce(target, F.lit("")) != ""
            there = reduce(lambda x, y: x | y, (t.isNotNull() for out, t in texts if out == "TargetName"), F.lit(False))
            texts = [(out, F.when(given & t.isNotNull(), new).otherwise(t) if out == "TargetName" else t) for out, t in texts] + [("TargetName", F.when(given & ~there, new))]
        body = F.concat_ws(",", F.lit('"_type":"group"'), *(t for _, t in texts))
        parents.setdefault(parent, []).append(F.concat(F.lit(json.dumps(name) + ":{"), body, F.lit("}")))
    whole = [F.concat(F.lit(json.dumps(parent) + ':{"_type":"object"'), *(F.concat(F.lit(","), g) for g in groups), F.lit("}")) for parent, groups in parents.items()]
    return F.concat(F.lit("{"), F.concat_ws(",", *whole), F.lit("}"))


def with_document(df: DataFrame, name: str, spec: dict, label: Column, target: Column | None = None) -> DataFrame:
    """df with the document of a label; null where there is no label."""
    bind = _Columns(name)
    of = f"spec_{name}_label_"
    made = document(F.col(of), spec, target, bind)
    out = bind.on(df.withColumn(of, label)).withColumn(name, F.when(F.col(of).isNotNull(), made))
    return out.select(*(c for c in df.columns if c != name), name)


def import_labels(products: DataFrame, crafts: DataFrame, spec_map: DataFrame, specs: dict[str, dict], template: str | None = None, target: str | None = None, form: str = "auto") -> DataFrame:
    """label_id, ok, message, spec, format, document of products (label_id, label, to).

    Nothing raises for a bad product: its row says what failed first. `template` names the
    spec for all, whatever the label says; `form` is the output's, or auto for its path's ending.
    """
    found = labels.dispatch(products, crafts, spec_map)
    spec = F.lit(template) if template else F.col("spec")
    said = F.when(F.col("form_") == "auto", imports.output_format(F.col("to"))).otherwise(F.col("form_"))
    key = F.concat_ws("/", F.col("product"), F.col("spacecraft"), F.col("instrument"))
    out = found.withColumn("form_", F.lit(form)).withColumns({"spec": spec, "format": said})
    steps = [
        (F.col("label").isNull(), F.lit("unreadable label")),
        (F.lit(template is None) & F.col("spacecraft").isNull(), F.lit("no spacecraft in the label")),
        (F.col("spec").isNull(), F.concat(F.lit("no spec for "), key)),
        (~F.coalesce(F.col("spec"), F.lit("")).isin(*specs), F.concat(F.lit("no such spec: "), F.col("spec"))),
        (F.coalesce(F.col("format"), F.lit("auto")) == "auto", F.concat(F.lit("no format for "), F.coalesce(F.col("to"), F.lit("")))),
    ]
    message = reduce(lambda rest, step: F.when(F.coalesce(step[0], F.lit(True)), step[1]).otherwise(rest), reversed(steps), F.lit(None).cast("string"))
    out = out.withColumn("message", message)
    done = F.col("message").isNull()
    for k, (n, s) in enumerate(specs.items()):  # a label is there only for its own spec
        out = with_document(out, f"document_{k}_", s, F.when(done & (F.col("spec") == n), F.col("label")), F.lit(target) if target else None)
    made = F.coalesce(*(F.col(f"document_{k}_") for k in range(len(specs))), F.lit(None).cast("string"))
    return out.select("label_id", done.alias("ok"), F.coalesce("message", F.concat(F.lit("imported to "), F.col("to"))).alias("message"), "spec", F.when(done, F.col("format")).alias("format"), F.when(done, made).alias("document"))
