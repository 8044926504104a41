"""Fill-in-middle, Yinyang clustering and token counts against plain versions, and their edge cases."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from planisphere.llm import middle, token_counts, yinyang
from planisphere.llm.common import table
from planisphere.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
LONG = " ".join(f"word{k}" for k in range(20_000))
TEXTS = [None, "", " \t\n", "one", "a <P> b", "a <M", " lead and trail \n", LONG, "é́ ü x\x1cy 漢字。仮名 🎉🎉", "tie tie tie", "tie tie tie"]


def docs(spark, texts=TEXTS, **more):
    df = spark.createDataFrame([(None if k == 3 else k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    return df.withColumns({c: F.lit(v) for c, v in more.items()})


# 11, fill in the middle


def plain_middle(doc_id, text):
    text = text or ""
    units = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(units)
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < 80:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_middle_against_plain(spark):
    df = docs(spark, TEXTS * 9, n="clash", output="clash", source="kept")
    got = middle.transform(df).withColumn("restored", middle.restore(F.col("output"), F.col("form"))).collect()
    assert len(got) == 9 * len(TEXTS) and {r.form for r in got} == {"plain", "spm", "psm"}
    for r in got:
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == plain_middle(r.doc_id, r.text)
        assert r.restored == (r.text or "") and r.source == "kept"
    assert middle.transform(df.limit(0)).count() == 0


def test_middle_query_against_plain(spark):
    texts = {r.doc_id: r.text for r in table(spark, SF, "documents").collect()}
    got = QUERIES["op11_lazy_middle"](spark, SF).collect()
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert sorted(r.doc_id for r in got) == sorted(texts)
    for r in got:
        n, form, a, b, output = plain_middle(r.doc_id, texts[r.doc_id])
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output_sha256, r.restored_sha256) == (n, form, a, b, sha(output), sha(texts[r.doc_id] or ""))


def test_middle_holds_no_units():
    """Memory beside the text stays small, however many units there are."""
    import tracemalloc

    text = "a " * 1_000_000
    tracemalloc.start()
    assert middle.cuts(text, 700_000, 300_000, True)[0] == 1_000_001
    assert tracemalloc.get_traced_memory()[1] < 100_000
    tracemalloc.stop()


@given(st.text(alphabet="ab \n\t é<PSM>", max_size=40), st.integers(0, 99), st.integers(0, 99))
@settings(max_examples=200, deadline=None)
def test_middle_cuts_at_units(text, h1, h2):
    units = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    assert middle.cuts(text, h1, h2, True) == (len(units), len("".join(units[:a])), len("".join(units[a:b])))
    assert middle.cuts(text, h1, h2, False) == (len(units), 0, 0)


# 12, centroids


def plain_clusters(rows, k=40, rounds=5, dims=64):
    """Every centroid for every vector, in Python's whole numbers."""
    vs = [(i, [int(np.floor(256 * float(x))) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and np.isfinite(x) for x in v)]
    digest = lambda i: hashlib.sha256(f"2:{'' if i is None else i}".encode()).hexdigest()
    cs = [v for _, v in sorted(vs, key=lambda r: (digest(r[0]), r[1]))[:k]]
    q = np.array([v for _, v in vs], object)
    for step in range(rounds + 1):
        d = np.array([((q - np.array(c, object)) ** 2).sum(1) for c in cs], object).T
        at = [min(range(len(cs)), key=lambda c: (row[c], c)) for row in d]
        if step < rounds:
            for c in range(len(cs)):
                mine = [v for (_, v), a in zip(vs, at) if a == c]
                if mine:
                    cs[c] = [sum(x) // len(mine) for x in zip(*mine)]
    return [(i, a, min(int(d[n][a]), (1 << 63) - 1)) for n, ((i, _), a) in enumerate(zip(vs, at))], cs


def vectors(spark, rows, kind="float"):
    return spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>")


def same(found, rows, **how):
    want, cs = plain_clusters(rows, **how)
    assert found.centroids == cs
    none = lambda r: (-1 if r[0] is None else r[0], *r[1:])
    assert sorted(none(tuple(r)) for r in found.members.collect()) == sorted(map(none, want))


def test_clusters_query_against_plain(spark):
    rows = [(r.vec_id, r.embedding) for r in table(spark, SF, "embeddings").collect()]
    want, cs = plain_clusters(rows)
    total = {c: sum(d for _, a, d in want if a == c) for c in range(40)}
    got = {r.vec_id: r for r in QUERIES["op12_yinyang"](spark, SF).collect()}
    assert len(got) == len(rows)
    for i, a, d in want:
        r = got[i]
        assert (r.cluster, r.distance, r.cluster_inertia, r.inertia) == (a, d, total[a], sum(total.values()))
        assert r.centroid_sha256 == hashlib.sha256(",".join(map(str, cs[a])).encode()).hexdigest()


def test_bounds_spare_distances_and_change_nothing(spark):
    """Clustered vectors: after the first round most are never looked at, and the result stays that of a full scan."""
    rng = np.random.default_rng(3)
    middles = rng.normal(0, 4, (20, 8))
    rows = [(k, [float(x) for x in middles[k % 20] + rng.normal(0, 0.2, 8)]) for k in range(1500)]
    found = yinyang.fit(vectors(spark, rows, "double"), k=20, dims=8, per_group=4)
    same(found, rows, k=20, dims=8)
    assert found.taken[0] == 1500 * 21 and found.taken[-1] < 1500 * 20 / 4


def test_clusters_with_ties_and_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(k % 50, [float(k % 3), float(k % 2)]) for k in range(120)] + [(None, [1.0, 1.0]), (None, [0.0, 1.0])]
    rows += [(900, None), (901, []), (902, [1.0]), (903, [nan, 1.0]), (904, [None, 1.0]), (905, [inf, 1.0]), (906, [1.0, 2.0, 3.0]), (907, [-0.001, -2.5])]
    same(yinyang.fit(vectors(spark, rows, "double"), k=7, dims=2, per_group=2), rows, k=7, dims=2)
    few = rows[:3]
    same(yinyang.fit(vectors(spark, few, "double"), k=7, dims=2), few, k=7, dims=2)
    assert yinyang.report(yinyang.fit(vectors(spark, rows, "double").limit(0))).count() == 0


def test_clusters_of_huge_components(spark):
    rng = np.random.default_rng(4)
    rows = [(k, [float(x) for x in rng.normal(0, 1, 3) * 10.0 ** rng.integers(0, 30)]) for k in range(60)]
    same(yinyang.fit(vectors(spark, rows, "double"), k=6, dims=3, per_group=2), rows, k=6, dims=3)


def test_one_cluster_holds_most(spark):
    rows = [(k, [0.25, 0.5]) for k in range(400)] + [(1000 + k, [float(k), -float(k)]) for k in range(30)]
    same(yinyang.fit(vectors(spark, rows), k=5, dims=2), rows, k=5, dims=2)


# 13, token counts


@pytest.fixture(scope="module")
def path():
    return str(pytest.importorskip("public_tokenizers").path("word_bpe_49k.json"))


@pytest.fixture(scope="module")
def whole(path):
    """Tokens of a whole text at once."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    return lambda text: len(t.encode(text or "", add_special_tokens=False).ids)


def test_counts_query_against_whole_texts(spark, whole):
    texts = {r.doc_id: r.text for r in table(spark, SF, "documents").collect()}
    got = QUERIES["op13_token_counts"](spark, SF).collect()
    assert sorted(r.doc_id for r in got) == sorted(texts)
    for r in got:
        n = whole(texts[r.doc_id])
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len((texts[r.doc_id] or "").encode()), n, n > 2048)


ODD = ["x" * 30_000, "漢字。仮名、" * 3000, "a<|endoftext|>b <|startoftext|>, ~ ~~ x~y", "don't we've I'll 's,'s '.s", "é, ́x á.b", "À 한.가", "x\x1cy\x85z w v\x0bu", "1.2.3 4,5", "<|end. oftext|>", "<|endoftext|", "ﬁ,ß.İ;ſ"]


def test_counts_of_odd_texts(spark, path, whole):
    df = docs(spark, TEXTS + ODD, n_tokens="clash", source="kept")
    got = token_counts.count(df, path, limit=5).collect()
    assert len(got) == len(TEXTS + ODD)
    for r in got:
        assert (r.n_tokens, r.over_limit, r.source) == (whole(r.text), whole(r.text) > 5, "kept")
    assert token_counts.count(df.limit(0), path).count() == 0


@given(st.lists(st.text(alphabet="aBé́.,'~<|>s \n\x1c 漢。7!", max_size=30), max_size=6))
@settings(max_examples=300, deadline=None)
def test_counts_add_up(texts):
    path = str(pytest.importorskip("public_tokenizers").path("word_bpe_49k.json"))
    t = token_counts.tokenizer(path)
    small = token_counts.Counter(path, batch=40, window=8, remembered=5)
    for _ in range(2):  # the second time from memory
        assert small(pa.array(texts, pa.string())).tolist() == [len(t.encode(x, add_special_tokens=False).ids) for x in texts]


def test_windows_and_batches():
    text = b"ab cd\tefghij k " * 50
    parts = list(token_counts.windows(text, 16))
    assert b"".join(parts) == text and max(map(len, parts)) <= 16 and all(p[:1].isspace() for p in parts[1:])
    assert list(token_counts.windows(b"x" * 90, 16)) == [b"x" * 90]
    sizes = [5, 900, 5, 5, 300, 300, 300, 5]
    ranges = token_counts.balanced(sizes, 400)
    assert ranges[0][0] == 0 and ranges[-1][1] == len(sizes) and all(a[1] == b[0] for a, b in zip(ranges, ranges[1:]))
    assert all(sum(sizes[a:b]) <= 400 + max(sizes[a:b]) for a, b in ranges)


def test_counts_refuse_tokenizers_that_join_across_blanks():
    other = str(pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json"))
    with pytest.raises(ValueError):
        token_counts.check_boundaries(other)
