"""Fill-in-middle transformation: a lazy matcher counts units, then walks to the two cuts; no list of units is ever held.

Units are `UNIT` matches, so every code point belongs to one. Python sees the text and returns four whole numbers; the output
is put together, and read back, by string functions of Spark.

Defined results: a null text is the empty text and plain; blanks alone are one unit; a text that holds a sentinel is plain; a null
id is drawn as an empty id; repeated rows each get the same result; no rows give no rows; columns of the input that bear a name
of the output are replaced, all others stay.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A word with the blanks before it, or blanks at the end. Possessive: the blanks are tried once.
UNIT = re.compile(r"[\x20\x09-\x0D]*+[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED, RATE, SPM_RATE = 42, 50, 80
_CUTS = T.StructType([T.StructField(c, T.LongType()) for c in ("n", "prefix_chars", "middle_chars")])


def cuts(text: str, h1: int, h2: int, wanted: bool) -> tuple[int, int, int]:
    """Units, code points before the first cut and between the cuts; where no cut is wanted, the last two are 0."""
    n = sum(1 for _ in UNIT.finditer(text))
    if not wanted:
        return n, 0, 0
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    units = UNIT.finditer(text)
    first = next(islice(units, low - 1, None)).end() if low else 0
    second = next(islice(units, high - low - 1, None)).end() if high > low else first
    return n, first, second - first


@F.arrow_udf(_CUTS)
def _cut(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for columns in batches:
        found = [cuts(t.as_py(), a.as_py(), b.as_py(), w.as_py()) for t, a, b, w in zip(*columns)]
        places = list(zip(*found)) or [(), (), ()]
        yield pa.StructArray.from_arrays([pa.array(p, pa.int64()) for p in places], names=["n", "prefix_chars", "middle_chars"])


def draws(doc_id: Column, seed: int = SEED) -> list[Column]:
    """The first four 32-bit numbers of the digest of seed and id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def restore(output: Column, form: Column) -> Column:
    """The text that an output of this form was made of."""
    parts = F.split(output, "<[PSM]>", -1)
    return F.when(form == "psm", F.concat(parts[1], parts[3], parts[2])).when(form == "spm", F.concat(parts[2], parts[3], parts[1])).otherwise(output)


def transform(docs: DataFrame, seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE) -> DataFrame:
    """docs with n, form, prefix_chars, middle_chars (null if plain) and output.

    `rate` of 100 texts are cut, `spm_rate` of 100 of these have the suffix first; both follow
    from the id and the seed alone. Nothing is shuffled.
    """
    text = F.coalesce("text", F.lit(""))
    h1, h2, h3, h4 = draws(F.col("doc_id"), seed)
    plain = (text == "") | (h3 % 100 >= rate)
    for sentinel in (PREFIX, SUFFIX, MIDDLE):
        plain = plain | F.contains(text, F.lit(sentinel))
    form = F.when(plain, "plain").when(h4 % 100 < spm_rate, "spm").otherwise("psm")
    own = ["n", "form", "prefix_chars", "middle_chars", "output", "_cut"]
    out = docs.drop(*own).withColumn("form", form).withColumn("_cut", _cut(text, h1, h2, F.col("form") != "plain"))
    a, b = F.col("_cut.prefix_chars"), F.col("_cut.middle_chars")
    prefix, middle, suffix = F.substring(text, F.lit(1), a), F.substring(text, a + 1, b), F.substring(text, a + b + 1, F.length(text))
    psm, spm = (PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle), (SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle)
    glued = lambda parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    cut = F.col("form") != "plain"
    return out.withColumns({
        "n": F.col("_cut.n"), "prefix_chars": F.when(cut, a), "middle_chars": F.when(cut, b),
        "output": F.when(F.col("form") == "psm", glued(psm)).when(F.col("form") == "spm", glued(spm)).otherwise(text),
    }).drop("_cut")
