"""The pipeline, stage by stage, against plain versions on the smallest tables."""

import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from planisphere.llm import language, line_dedup
from planisphere.llm.common import table
from tests.llm.test_operators import ODD, _groups, _shingles, docs as made

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    out, docs = [], table(spark, SF, "documents")
    out.append(docs)
    for k, (_, step) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stages") / str(k))
        step(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs)
    return out


def test_columns_and_order(steps):
    assert [n for n, _ in corpus_pipeline.STAGES][0] == "language ID" and len(corpus_pipeline.STAGES) == 5
    assert all(s.columns == steps[0].columns for s in steps[:5])


def test_language_keeps_clean_documents(steps):
    assert steps[1].count() >= steps[0].where("text is not null").count() - 1


def test_lines_against_plain(steps):
    key = lambda line: re.sub("[A-Z]", lambda c: c[0].lower(), line.strip(" \t\n\x0b\x0c\r"))
    rows, seen = [(r.doc_id, r.text) for r in steps[1].select("doc_id", "text").collect()], defaultdict(set)
    for d, t in rows:
        for line in t.split("\n"):
            seen[key(line)].add(d)
    gone = lambda d, line: len(key(line)) >= 40 and len(seen[key(line)]) >= 5 and max(seen[key(line)]) != d
    stay = {d: [x for x in t.split("\n") if not gone(d, x)] for d, t in rows}
    assert {r.doc_id: r.text for r in steps[2].collect()} == {d: "\n".join(x) for d, x in stay.items() if x}


def test_lines_have_an_effect(spark, steps):
    assert line_dedup.dedup_lines(steps[2]).agg(F.sum("n_dropped")).first()[0] == 0
    assert steps[2].where("n_chars <> length(text)").count() == 0


def test_one_of_each_group(steps):
    rows = [(r.doc_id, r.text) for r in steps[2].select("doc_id", "text").collect()]
    want = {d for d, _, c in _groups(rows, corpus_pipeline.SIMILAR) if d == c}
    assert {r.doc_id for r in steps[3].collect()} == want


def test_no_benchmark_left(spark, steps):
    items = [_shingles(r.text) for r in table(spark, SF, "benchmark").collect()]
    leaks = lambda t: any(i and len(i & _shingles(t)) >= 0.8 * len(i) for i in items)
    want = {r.doc_id for r in steps[3].collect() if not leaks(r.text)}
    assert {r.doc_id for r in steps[4].collect()} == want


def test_mix_repeats_documents(steps):
    got = defaultdict(list)
    for r in steps[5].collect():
        got[r.doc_id].append(r)
    for rows in got.values():
        assert sorted(r.copy for r in rows) == list(range(1, rows[0].copies + 1)) and rows[0].copies <= 3
    taken = sum(r.size for rows in got.values() for r in rows)
    assert abs(taken - steps[4].select(F.sum(F.size(F.split(F.trim("text"), r"\s+")))).first()[0]) / taken < 0.15


def test_mix_takes_what_a_plain_mix_takes(steps):
    size, source, rows = {}, {}, steps[4].select("doc_id", "text", "source").collect()
    for r in rows:
        size[r.doc_id], source[r.doc_id] = len(re.findall(r"[^ \t-\r]+", r.text or "")), r.source
    mass = Counter()
    for d, n in size.items():
        mass[source[d]] += n
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sorted(mass, key=lambda s: (s is None, s or "")))}
    target, left = {}, sum(mass.values())
    while True:  # targets above three times their source's size stop there
        free = [s for s in mass if s not in target]
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 3 * mass[s]]
        target |= {s: 3.0 * mass[s] for s in over} if over else share
        if not over:
            break
        left -= sum(3 * mass[s] for s in over)
    taken = Counter()
    for r in steps[5].select("doc_id", "size", "target").collect():
        assert r["size"] == size[r.doc_id] and abs(r.target - target[source[r.doc_id]]) < 1e-6 * max(1, r.target)
        taken[source[r.doc_id]] += r["size"]
    for s in mass:
        assert abs(taken[s] - target[s]) <= max(n for d, n in size.items() if source[d] == s)


CLASH = ["score", "rejected", "n_lines", "gone_id", "hit_id", "size", "target", "copy", "d", "th", "id", "text2", "key", "batch"]


def test_stages_on_odd_rows(spark, tmp_path):
    plain = "some ordinary english words that make a document of number"
    rows = [*ODD, *((k, f"{plain} {k} " + " ".join(f"w{k}x{j}" for j in range(12))) for k in range(10, 40)), (None, plain + " nobody"), (50, "twice the same text, with the same id"), (50, "twice the same text, with the same id")]
    made(spark, rows).select("doc_id", "text").limit(0).selectExpr("doc_id as item_id", "text").write.parquet(str(tmp_path / "benchmark.parquet"))
    df = made(spark, rows)
    for c in CLASH:
        df = df.withColumn(c, F.lit("mine"))
    everything = Counter((r.doc_id, r.text) for r in df.collect())
    model = language.fit(df.select("doc_id", "text", "lang"))
    want = [
        Counter({k: n for k, n in everything.items() if not language.judge(k[1], model)[2]}),
        everything, everything - Counter([(4, ODD[4][1]), (50, rows[-1][1])]), everything,
    ]
    for (name, step), left in zip(corpus_pipeline.STAGES, [*want, None]):
        got = step(spark, df, str(tmp_path))
        assert got.columns[: len(df.columns)] == df.columns and len({c.lower() for c in got.columns}) == len(got.columns), name
        assert got.where(" or ".join(f"`{c}` <> 'mine'" for c in CLASH)).count() == 0, name
        if left is not None:
            same = Counter((r.doc_id, r.text) for r in got.collect())
            assert sum(same.values()) == sum(left.values()) and {d for d, _ in same} == {d for d, _ in left}, name
        assert step(spark, df.limit(0), str(tmp_path)).count() == 0, name


def test_run_is_the_stages(spark, steps):
    assert corpus_pipeline.run(spark, SF).select("doc_id", "copy").exceptAll(steps[5].select("doc_id", "copy")).count() == 0
