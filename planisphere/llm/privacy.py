"""Operator 9, information-theoretic sanitisation of personal data. DataFrame functions only.

Patterns find the protected entities: e-mail addresses, IP addresses, card numbers
(Luhn) and phone numbers. The corpus then tells which other terms reveal them. For an
entity e and a term t anywhere in a text that holds e, p(e|t) is the share of t's texts
that hold e, and t discloses e if its pointwise mutual information with e reaches the
entity's information content over ALPHA:

    log2(p(e|t) / p(e)) >= -log2(p(e)) / ALPHA, that is, p(e|t) >= p(e) ^ (1 - 1/ALPHA)

Such terms become spans of kind `term` wherever they stand in the documents that hold e.
All entities are judged, however rare: p(e|t) = (n_et + PRIOR p(e)) / (n_t + PRIOR), so
that few texts count less than many. A text counts once, however many documents are exact
copies of it; an entity of all texts has no information to disclose. In sanitised text an
entity becomes its kind in brackets; a term is removed where it tells the entity almost
surely (REMOVE), else generalised to its initial.

Positions come from the texts between matches: one pass splits, one extracts, and the
lengths are summed in blocks, in time linear in the matches. Documents without matches cost the passes alone. What the corpus
gathers (texts of each term and entity) covers all rows. Terms in too many texts to
disclose an entity even if it stood in all of them are not paired with it.

Defined cases: null text is empty; spans are code points, end exclusive, leftmost and
non-overlapping for each kind; spans of different kinds may overlap, and sanitising
takes them from left to right; terms inside an entity's span are no spans of their own;
words that touch an entity count from its end; a null doc_id is a document like others;
repeated rows have equal spans; empty tables give no rows. Columns `spans` and `sanitised`
replace such columns of the input; all others are kept by `sanitise`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import before, discard, let, lower_ascii, stage, text_key

#: Fixed by the query's contract, but for lookbehinds and possessive repeats, which find the same in linear time.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = [*PATTERNS, "term"]
#: What a text must contain for a pattern to be tried.
_NEEDS = {"email": "@", "ip": ".", "phone": "+"}
_PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
_WORD = r"\p{L}{3,}"
#: PRIOR: for how many texts the entity's own share counts in the estimate of p(e|t).
ALPHA, PRIOR, REMOVE = 1.1, 1.0, 0.9


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    def total(d: Column) -> Column:
        n = F.length(d)

        def add(acc: Column, i: Column) -> Column:
            x = F.substring(d, n - i + 1, F.lit(1)).cast("int")
            twice = F.when(x > 4, x * 2 - 9).otherwise(x * 2)
            return acc + F.when(i % 2 == 0, twice).otherwise(x)

        return F.when(n.between(13, 19), F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0).otherwise(False)

    return let(_digits(value), total)


_SOUND = {
    "email": lambda v: F.lit(True),
    "ip": lambda v: v.rlike(f"^{_PART}(?:\\.{_PART}){{3}}$"),
    "card": _luhn,
    "phone": lambda v: F.length(_digits(v)).between(9, 15),
}
_SPAN = "struct<kind:int,start:int,end:int,value:string>"


def matches(text: Column, pattern: str, kind: int) -> Column:
    """array of (kind, start, end, value) of a pattern's matches in a text; a match starts after all gaps and matches before it."""

    def located(x: Column) -> Column:
        ends = before(F.transform(x["found"], lambda v, i: (F.length(x["gaps"][i]) + F.length(v)).cast("long")))
        at = lambda e: F.transform(x["found"], lambda v, i: F.struct(F.lit(kind).alias("kind"), (e[i] + F.length(x["gaps"][i])).cast("int").alias("start"), (e[i] + F.length(x["gaps"][i]) + F.length(v)).cast("int").alias("end"), v.alias("value")))
        return let(ends, at)

    def of(x: Column) -> Column:
        both = F.struct(x["found"].alias("found"), F.split(x["text"], pattern, -1).alias("gaps"))
        return F.when(F.size(x["found"]) == 0, F.array().cast(f"array<{_SPAN}>")).otherwise(let(both, located))

    return let(F.struct(text.alias("text"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found")), of)


def blanked(text: Column) -> Column:
    """The text with its e-mail addresses blank, so that words keep their places; entities of other kinds hold no letters."""
    pattern = PATTERNS["email"]

    def whole(x: Column) -> Column:
        parts = F.transform(x["found"], lambda v, i: F.concat(x["gaps"][i], F.repeat(F.lit(" "), F.length(v))))
        return F.when(F.size(x["found"]) == 0, x["text"]).otherwise(F.concat(F.array_join(parts, ""), F.element_at(x["gaps"], -1)))

    both = F.struct(text.alias("text"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"), F.split(text, pattern, -1).alias("gaps"))
    return F.when(F.contains(text, F.lit("@")), let(both, whole)).otherwise(text)


def base_spans(text: Column) -> Column:
    """The entities of a text, by kind and then start."""
    out = []
    for k, (kind, pattern) in enumerate(PATTERNS.items()):
        sound = _SOUND[kind]
        found = F.filter(matches(text, pattern, k), lambda s: sound(s["value"]))  # used at once, in this turn of the loop
        if kind in _NEEDS:
            found = F.when(F.contains(text, F.lit(_NEEDS[kind])), found).otherwise(F.array().cast(f"array<{_SPAN}>"))
        out.append(found)
    return F.concat(*out)


def entity(kind: Column, value: Column) -> Column:
    """What counts as the same entity: digits of cards and phones, lower-cased text of others."""
    return F.concat(kind.cast("string"), F.lit(":"), F.when(kind >= 2, _digits(value)).otherwise(lower_ascii(value)))


def vocabulary(text: Column) -> Column:
    """The different terms of a text."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(_WORD), F.lit(0)), F.lower))


def disclosing(docs: DataFrame, found: DataFrame, alpha: float, prior: float) -> DataFrame:
    """th, term, share: the terms of a text that disclose an entity in it, each once with its greatest share; a staged table.

    found: th, text, base of each different text with entities. If there is no entity at all, the
    texts' terms are not counted (an empty table stands for them), as nothing could be disclosed.
    """
    held = found.select("th", F.explode("base").alias("s")).select("th", entity(F.col("s.kind"), F.col("s.value")).alias("e")).distinct()
    held = stage(held, "held")
    if held.isEmpty():
        docs = docs.limit(0)
    th = text_key(F.col("text")).alias("th")
    n = F.lit(float(max(1, docs.select(th).distinct().count())))
    words = docs.select(th, vocabulary(F.col("text")).alias("terms")).groupBy("th").agg(F.first("terms").alias("terms"))
    n_t = words.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("n_t"))  # counted before the join, which then meets a row a term
    near = found.select("th", F.explode(vocabulary(F.col("text"))).alias("term")).join(n_t, "term")
    of_e = held.groupBy("e").agg(F.count("*").alias("n_e")).where(F.col("n_e") < n)
    p = F.col("n_e") / n
    share = lambda n_et: (n_et + prior * p) / (F.col("n_t") + prior)
    tells = lambda n_et: share(n_et) >= F.pow(p, F.lit(1 - 1 / alpha))
    pairs = held.join(of_e, "e").join(near, "th").where(tells(F.least("n_e", "n_t")))
    pairs = stage(pairs, "pairs")
    told = pairs.groupBy("e", "n_e", "term", "n_t").agg(F.count("*").alias("n_et")).where(tells(F.col("n_et")))
    told = stage(told.select("e", "term", share(F.col("n_et")).alias("share")), "disclosing")
    out = stage(pairs.select("th", "e", "term").join(told, ["e", "term"]).groupBy("th", "term").agg(F.max("share").alias("share")), "told")
    discard(held, pairs, told)
    return out


def find_spans(docs: DataFrame, alpha: float = ALPHA, prior: float = PRIOR) -> DataFrame:
    """id (doc_id), th (the text's hash), base and terms (arrays of spans), sure (terms to remove): one row a document row.

    Spans hang on the text alone, so they are found once for each different text.
    """
    all_docs = docs.select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    found = all_docs.select(text_key(F.col("text")).alias("th"), "text", base_spans(F.col("text")).alias("base")).where("size(base) > 0")
    held = stage(found.groupBy("th").agg(F.first("text").alias("text"), F.first("base").alias("base")), "entities")
    told = disclosing(all_docs.select("text"), held, alpha, prior)

    # each word meets its text's terms by a join, so that a text with many of both takes no product of them
    some = held.select("th", "text").join(told.select("th").distinct(), "th", "left_semi")
    every = some.select("th", matches(blanked(F.col("text")), _WORD, len(PATTERNS)).alias("words")).select("th", F.explode_outer("words").alias("s"))
    every = every.select(F.col("th.a").alias("a"), F.col("th.b").alias("b"), F.col("s.start").alias("start"), F.col("s.end").alias("end"), F.col("s.value").alias("value")).where("value is not null")
    asked = told.select(F.col("th.a").alias("ta"), F.col("th.b").alias("tb"), "term", "share")
    named = every.join(asked, (F.col("a") == F.col("ta")) & (F.col("b") == F.col("tb")) & (F.lower("value") == F.col("term")))
    span = F.struct(F.lit(len(PATTERNS)).alias("kind"), "start", "end", "value")
    marks = named.groupBy(F.struct("a", "b").alias("th")).agg(F.sort_array(F.collect_list(span)).alias("terms"), F.collect_set(F.when(F.col("share") >= REMOVE, F.col("term"))).alias("sure"))
    marked = stage(held.select("th", "base").join(marks, "th", "left"), "spans")
    discard(held, told)

    none, no_terms = F.array().cast(f"array<{_SPAN}>"), F.array().cast("array<string>")
    out = all_docs.select("id", text_key(F.col("text")).alias("th")).join(marked, "th", "left")
    return out.select("id", "th", F.coalesce("base", none).alias("base"), F.coalesce("terms", none).alias("terms"), F.coalesce("sure", no_terms).alias("sure"))


def written(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    name = lambda k: F.element_at(F.array(*map(F.lit, KINDS)), k + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat(name(s["kind"]), F.lit(":"), s["start"], F.lit(":"), s["end"])), ",")


def sanitise(docs: DataFrame, alpha: float = ALPHA, prior: float = PRIOR) -> DataFrame:
    """The documents with spans (array of kind, start, end) and sanitised (the text without what they cover)."""
    marked = stage(find_spans(docs.select("doc_id", "text"), alpha, prior).where("size(base) > 0").drop("id").dropDuplicates(["th"]), "text_spans")
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("d"), text_key(F.col("text")).alias("key"))
    text = F.coalesce(F.col("d.text"), F.lit(""))
    both = whole.join(marked.hint("merge"), F.col("key") == F.col("th"), "left")
    name = lambda k: F.element_at(F.array(*map(F.lit, KINDS)), k + 1)
    no_spans, no_terms = F.array().cast(f"array<{_SPAN}>"), F.array().cast("array<string>")
    every = F.concat(F.coalesce("base", no_spans), F.coalesce("terms", no_spans))
    spans = F.transform(every, lambda s: F.struct(name(s["kind"]).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    inside = lambda s: F.when(s["kind"] < len(PATTERNS), F.concat(F.lit("["), F.upper(name(s["kind"])), F.lit("]"))).when(F.array_contains(F.coalesce("sure", no_terms), F.lower(s["value"])), F.lit("")).otherwise(F.concat(F.substring(s["value"], 1, 1), F.lit("...")))
    by_start = F.array_sort(F.transform(every, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), s["kind"].alias("kind"), s["value"].alias("value"))))

    def step(acc: Column, s: Column) -> Column:
        gap = F.substring(text, acc["at"] + 1, s["start"] - acc["at"])
        taken = F.struct((-s["back"]).alias("at"), F.concat(acc["out"], F.array(F.concat(gap, inside(s)))).alias("out"))
        return F.when(s["start"] >= acc["at"], taken).otherwise(acc)

    first = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    clean = F.aggregate(by_start, first, step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["at"] + 1, F.length(text))))
    cols = [F.col(f"d.`{c}`").alias(c) for c in docs.columns if c not in ("spans", "sanitised")]
    return both.select(*cols, spans.alias("spans"), F.when(F.size(every) == 0, text).otherwise(clean).alias("sanitised"))


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_term, n_spans of every document."""
    out = find_spans(docs)
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    every = F.concat("base", "terms")
    return out.select(
        F.col("id").alias("doc_id"), *(count(k).alias(f"n_{kind}") for k, kind in enumerate(PATTERNS)), F.sha2(written(F.col("base")), 256).alias("base_sha256"),
        written(every).alias("spans"), F.size("terms").cast("long").alias("n_term"), F.size(every).cast("long").alias("n_spans"),
    )
