"""The ten operators against plain versions of themselves, and their edge cases."""

from __future__ import annotations

import hashlib
import re
import time
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from planisphere.llm import audio, chat, decontaminate, language, line_dedup, mixing, near_dedup, privacy, quality, url_trust
from planisphere.llm.common import table
from planisphere.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows, more=""):
    """Rows of (doc_id, text[, lang[, source]]); more: a clashing column."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s", len(r[1] or "")) for r in rows]
    df = spark.createDataFrame(full, DOC)
    return df.withColumn(more, F.lit("mine")) if more else df


LONG = " ".join(f"word{k}" for k in range(20_000))
ODD = [(1, None), (2, ""), (3, " \t\n"), (None, "some text without an id here"), (4, "tie tie tie tie tie tie"), (4, "tie tie tie tie tie tie"), (5, LONG), (6, None, None, None)]


@pytest.fixture(scope="module")
def corpus(spark):
    return table(spark, SF, "documents")


# 1, URLs


def _judged(pages, links, rules=url_trust.RULES):
    """Plain version: hosts, rules and power iteration."""
    parsed = {}
    for pid, url in pages:
        m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
        host, path = (re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]) if m else ("", "")
        fits = [(len(h + p), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        parsed[pid] = (host, path, *(max(fits)[1:] if fits else (None, None)))
    good, bad = Counter(), Counter()
    for host, _, _, v in parsed.values():
        good[host] += v == "allow"
        bad[host] += v == "block"
    out = {}
    for name, seed, edges in (("trust", good, links), ("distrust", bad, {(b, a): n for (a, b), n in links.items()})):
        total = sum(seed.values()) or 1
        s0 = {h: n / total for h, n in seed.items()}
        score, away = dict(s0), Counter()
        for (a, _), n in edges.items():
            away[a] += n
        for _ in range(250):
            lost = sum(v for h, v in score.items() if not away[h])  # goes back to the seeds
            new = defaultdict(float, {h: v * (1 - url_trust.DAMPING + url_trust.DAMPING * lost) for h, v in s0.items()})
            for (a, b), n in edges.items():
                new[b] += url_trust.DAMPING * score.get(a, 0) * n / away[a]
            score = new
        out[name] = score if links else s0
    return parsed, out


def test_urls_against_plain(spark):
    urls = ["http://Good.example.com/en/7x", "https://bad.org/es/1", "http://hub.info/a?x#y", "http://lone.info/", "nothing", None, "http://friend.net/de/1#z", "x://example.net/de/81", "http://notexample.com/en/7"]
    html = {2: '<a href="http://bad.org/x"><a class=k HREF=//friend.net/q><a href="/out?u=http://lone.info/"><a href="?http://lone.info">', 3: None, 0: "<a href='http://hub.info/'>", 6: '<a href="/own">'}
    pages = spark.createDataFrame([(i, u, html.get(i, "")) for i, u in enumerate(urls)], "page_id long, url string, html string").withColumn("rule", F.lit("mine"))
    links = {("hub.info", "bad.org"): 1, ("hub.info", "friend.net"): 1, ("good.example.com", "hub.info"): 1}
    parsed, score = _judged(list(enumerate(urls)), links)
    got = {r.page_id: r for r in url_trust.judge(pages).collect()}
    assert len(got) == len(urls)
    for pid, (host, path, rule, verdict) in parsed.items():
        r = got[pid]
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.trust == pytest.approx(score["trust"].get(host, 0) if host else 0, abs=1e-6)
        assert r.distrust == pytest.approx(score["distrust"].get(host, 0) if host else 0, abs=1e-6)
        bad, good = score["distrust"].get(host, 0) if host else 0, score["trust"].get(host, 0) if host else 0
        assert r.verdict == (verdict or ("block" if bad > good else "allow"))
    assert got[2].distrust > 0 and got[2].trust > 0 and got[3].verdict == "allow" and got[5].verdict == "allow"
    assert url_trust.judge(pages.limit(0)).count() == 0


def test_trust_of_a_random_graph(spark):
    rng = np.random.default_rng(13)
    name = lambda k: f"h{k}.com" if k % 7 else f"h{k}.net"
    urls = [f"http://{name(int(rng.integers(300)))}/{rng.choice(['en/', 'de/', 'fr/'])}{k}" for k in range(900)]
    hosts = [re.match("http://([^/]*)", u)[1] for u in urls]
    links, html = Counter(), []
    for k, h in enumerate(hosts):
        far = {name(int(rng.integers(300))) for _ in range(int(rng.integers(3)))} if int(re.sub("[^0-9]", "", h)) % 5 else set()  # a fifth dangle
        html.append(" ".join(f"<a href='http://{x}/p'>" for x in far))
        links.update((h, x) for x in far if x != h)
    pages = spark.createDataFrame([(k, u, t) for k, (u, t) in enumerate(zip(urls, html))], "page_id long, url string, html string")
    parsed, score = _judged(list(enumerate(urls)), links)
    for r in url_trust.judge(pages).collect():
        good, bad = score["trust"].get(r.host, 0), score["distrust"].get(r.host, 0)
        assert r.trust == pytest.approx(good, abs=1e-6) and r.distrust == pytest.approx(bad, abs=1e-6)
        assert r.verdict == (parsed[r.page_id][3] or ("block" if bad > good else "allow")) or abs(bad - good) < 1e-6
    assert sum(score["trust"].values()) == pytest.approx(1)


def test_trust_comes_to_rest(spark):
    edges = [(f"h{k:02d}", f"h{k + 1:02d}", 1) for k in range(29)] + [("a", "b", 1), ("b", "a", 1)]
    seeds = [("h29", 0.0, 0.5), ("a", 0.5, 0.5)]
    args = spark.createDataFrame(edges, "src string, dst string, n long"), spark.createDataFrame(seeds, "host string, trust double, distrust double")
    got = {r.host: r for r in url_trust.propagate(*args).collect()}
    ring = {"a": 0.15 / (1 - 0.85**2), "b": 0.15 * 0.85 / (1 - 0.85**2)}  # a cycle
    chain = [0.15 * 0.85 ** (29 - k) for k in range(30)]  # 29 links from the one seed, against them
    for k in range(30):
        assert got[f"h{k:02d}"].distrust == pytest.approx(chain[k] / (sum(chain) + sum(ring.values())), rel=1e-6) and got[f"h{k:02d}"].trust == 0
    for host in "ab":
        assert got[host].trust == pytest.approx(ring[host] / sum(ring.values()), rel=1e-6)
    with pytest.raises(RuntimeError):
        url_trust.propagate(*args, limit=8)


def test_url_query_is_complete(spark):
    pages = table(spark, SF, "pages")
    got = QUERIES["op1_link_trust"](spark, SF)
    assert got.count() == pages.count() and got.where("verdict not in ('allow', 'block')").count() == 0


# 2, decontamination


def _shingles(text):
    w = (text or "").encode().lower().split()
    return frozenset(b" ".join(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([b" ".join(w)] if w else [])


def test_leaks_against_plain(spark):
    rng = np.random.default_rng(1)
    vocab = [f"w{k}" for k in range(3000)]
    text = lambda n: " ".join(rng.choice(vocab, n))
    items = [(k, text(n)) for k, n in enumerate((3, 5, 6, 8, 12, 20, 59, 59))] + [(50, "one two three"), (51, None), (None, text(15))]
    rows = []
    for i in range(60):
        own, size = items[i % 8][1], [0, 30, 900, 6000][i % 4]
        words = own.split()
        part = " ".join(words[: max(1, int(len(words) * (1.0, 0.9, 0.5)[i % 3]))]).upper()
        rows.append((i, f"{text(size)} {part}\n{text(size)}"))
    rows += ODD + [(900, " one TWO\tthree "), (901, f"a {items[10][1]}")]
    got = {(r.doc_id, r.item_id): round(r.containment, 9) for r in decontaminate.leaks(docs(spark, rows, "item_id"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = {}
    for d, t, *_ in rows:
        for i, q in items:
            need = _shingles(q)
            if need and len(need & _shingles(t)) / len(need) >= 0.8:
                want[d, i] = round(len(need & _shingles(t)) / len(need), 9)
    assert got == want and (900, 50) in want and (901, None) in want


def test_leaks_where_sketches_begin(spark):
    """Items of which just so many shingles are asked that sketches are trusted, in documents that hold just so many."""
    rng = np.random.default_rng(18)
    vocab = [f"w{k}" for k in range(60_000)]
    items = [(k, [str(w) for w in rng.choice(vocab, 14, replace=False)]) for k in range(400)]  # 10 shingles, 8 asked
    rows = []
    for k, w in items:
        at, size = int(rng.integers(0, 3)), int(rng.choice([5, 60, 700, 4000]))
        rows.append((k, " ".join([*rng.choice(vocab, size), *w[at : at + 12], *rng.choice(vocab, size)])))
        rows.append((1000 + k, " ".join([*rng.choice(vocab, size), *w[at : at + 11], *rng.choice(vocab, size)])))
    got = {(r.doc_id, r.item_id, r.n_found) for r in decontaminate.leaks(docs(spark, rows), spark.createDataFrame([(k, " ".join(w)) for k, w in items], "item_id long, text string")).collect()}
    assert got == {(k, k, 8) for k in range(400)} and decontaminate.SURE == 8


def test_remove_leaks_keeps_columns(spark, corpus):
    bench = table(spark, SF, "benchmark")
    kept = decontaminate.remove_leaks(corpus, bench)
    assert kept.columns == corpus.columns
    assert decontaminate.leaks(kept, bench).count() == 0
    assert decontaminate.leaks(corpus.limit(0), bench).count() == 0 and decontaminate.leaks(corpus, bench.limit(0)).count() == 0


def test_remove_leaks_with_null_and_repeated_ids(spark):
    item = "a benchmark question of more than five words in all"
    rows = [(None, f"x {item} y"), (None, "clean text of nobody"), (4, item.upper()), (4, "clean text of the fourth document"), (5, None), *ODD]
    df = docs(spark, rows, "hit_id").withColumn("th", F.lit(1)).withColumn("item", F.lit(2))
    got = decontaminate.remove_leaks(df, spark.createDataFrame([(1, item), (1, item), (None, None)], "item_id long, text string"))
    assert got.columns == df.columns and Counter((r.doc_id, r.text) for r in got.collect()) == Counter([(None, "clean text of nobody"), (4, "clean text of the fourth document"), (5, None), *(r[:2] for r in ODD)])


# 3 and 5, classifiers


def test_quality_held_out(spark):
    d = "/root/testdata/sf0.01"
    got = QUERIES["op3_zstd_quality"](spark, d).join(table(spark, d, "labels"), "doc_id").where("held_out").toPandas()
    rank, y = got.score.rank(), got.quality
    auc = (rank[y == 1].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (len(y) - y.sum()))
    assert auc > 0.85 and (got.predicted == (got.score >= 0.7)).all() and got.score.between(0, 1).all()


def test_quality_against_plain(spark):
    d = "/root/testdata/sf0.01"
    corpus, labels = table(spark, d, "documents"), table(spark, d, "labels")
    model = quality.fit(corpus, labels)
    compress = {k: zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(getattr(model, k)), write_content_size=False, write_checksum=False, write_dict_id=False) for k in ("good", "bad")}
    got = {r.doc_id: r for r in quality.classify(corpus, labels).collect()}
    texts = {r.doc_id: r.text for r in corpus.collect()}
    assert set(got) == set(texts)
    for i, t in texts.items():
        raw = (t or "").encode("utf-8", "replace")
        size = {k: sum(len(c.compress(raw[at : at + 4096])) - 5 for at in range(0, len(raw), 4096)) for k, c in compress.items()}
        x = (size["bad"] - size["good"]) / max(1, sum(size.values())) if raw else 0.0
        p = 1 / (1 + np.exp(-np.clip(model.slope * x + model.bias, -40, 40)))
        assert got[i].score == pytest.approx(p, abs=1e-9) and got[i].predicted == int(got[i].score >= 0.7)
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2)
    held = [(got[r.doc_id].score, r.quality) for r in labels.collect() if r.doc_id in got and got[r.doc_id].held_out and r.quality is not None]
    bins = defaultdict(list)
    for p, y in held:
        bins[min(4, int(5 * p))].append((p, y))
    assert sum(abs(sum(p - y for p, y in v)) for v in bins.values()) / len(held) < 0.1  # calibration error


def test_quality_sample_is_bounded(spark):
    labels = spark.createDataFrame([(k, k % 2) for k in range(20)] * 3, "doc_id long, quality int").withColumn("text", F.lit("mine"))
    rows = [(k % 20, f"text {k} " * 20) for k in range(4000)]
    got = quality.sample(docs(spark, rows, "quality"), labels.select("doc_id", "quality").distinct())
    assert got.groupBy("quality").count().where("count > 10").count() == 0 and got.count() == 20


def test_quality_edges(spark):
    labels = spark.createDataFrame([(k, 1 if k < 6 else 0) for k in range(12)] + [(3, None), (99, 1)], "doc_id long, quality int")
    rows = [(k, "good calm prose " * 50 if k < 6 else "$$$ ### !!! " * 50) for k in range(12)] + ODD
    got = quality.classify(docs(spark, rows, "score"), labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id in (None,)}) == 1
    assert quality.classify(docs(spark, ODD), labels.limit(0)).count() == len(ODD)
    assert quality.classify(docs(spark, rows), labels.where("quality = 1")).agg(F.min("score")).first()[0] > 0.99
    assert quality.classify(docs(spark, []), labels).count() == 0


def test_difference_takes_whole_texts():
    a = quality.difference("x" * 5000 + "good " * 400, b"good good good good ", b"bad bad bad bad bad ")
    assert a != quality.difference("x" * 5000, b"good good good good ", b"bad bad bad bad bad ")


def test_language_held_out(spark):
    d = "/root/testdata/sf0.01"
    got = language.predict(table(spark, d, "documents")).join(table(spark, d, "documents").select("doc_id", "lang"), "doc_id").toPandas()
    held = got[got.held_out]
    assert (held.lang_pred == held.lang).mean() > 0.98 and not got.rejected.any()
    assert (got.held_out == got.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 4 == 2)).all()


FINNISH = "kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan heille on annettu järki ja omatunto ja heidän on toimittava toisiaan kohtaan veljeyden hengessä "
RUSSIAN = "все люди рождаются свободными и равными в своем достоинстве и правах они наделены разумом и совестью и должны поступать в отношении друг друга в духе братства "


def test_language_edges(spark, corpus):
    model = language.fit(corpus)
    rng = np.random.default_rng(15)
    gibberish = "".join(c if rng.random() > 0.18 else " " for c in rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 20_000))
    rows = ODD + [(20, "12 34 !!"), (21, "Жжжж щщщ ыыы эээ юю я" * 40), (22, "the"), (23, gibberish), (24, FINNISH * 20), (25, RUSSIAN), (26, "".join(map(chr, rng.integers(0x4E00, 0x9000, 500))))]
    df = docs(spark, rows, "score").withColumn("rejected", F.lit("mine"))
    got = {r.doc_id: r for r in language.identify(df, model).collect()}
    assert got[1].lang_pred == got[2].lang_pred == got[20].lang_pred == "und" and got[20].rejected and got[20].score == 0
    assert got[21].rejected and got[21].lang_pred in model.langs and not got[22].rejected
    assert all(got[k].rejected for k in (23, 24, 25, 26))
    kept = language.retain(df, model)
    assert kept.columns == df.columns and Counter(r.doc_id for r in kept.where("rejected = 'mine' and score = 'mine'").collect()) == Counter(d for d, *_ in rows if not got[d].rejected)
    assert {r.lang_pred for r in language.predict(docs(spark, [(1, "a", None)])).collect()} == {"und"}
    assert language.predict(docs(spark, [])).count() == 0 and language.retain(docs(spark, []), None).count() == 0


def _plain_places(text):
    """Places of all letter runs, one at a time."""
    a = [0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D]
    mask, out, c = 2**32 - 1, Counter(), [" "]
    for ch in text.lower():
        if ch.isalpha() or c[-1] != " " or len(c) == 1 and text[0] == ch:
            c.append(ch if ch.isalpha() else " ")
    c = [ord(x) for x in [*c, " "]]
    one = [x * a[0] & mask for x in c]
    two = [((one[i] ^ one[i] >> 15) * a[1] + c[i + 1] * a[2]) & mask for i in range(len(c) - 1)]
    three = [((two[i] ^ two[i] >> 13) * a[2] + c[i + 2] * a[1]) & mask for i in range(len(c) - 2)]
    out.update(x >> 20 for x in one + [x ^ 0x5BD1E995 for x in two] + three)
    return out


def test_language_against_plain(spark, corpus):
    model = language.fit(corpus)
    rows = [(r.doc_id, r.text) for r in corpus.limit(60).collect()]
    got = {r.doc_id: r for r in language.identify(docs(spark, rows), model).collect()}
    for d, t in rows:
        n = _plain_places(t)
        v = {p: (1 + np.log(k)) * model.idf[p] for p, k in n.items()}
        norm = sum(x * x for x in v.values()) ** 0.5
        cos = [sum(x / norm * float(c[p]) for p, x in v.items()) for c in model.centroids]
        assert got[d].score == pytest.approx(max(cos), abs=1e-5) and got[d].lang_pred == model.langs[model.owner[int(np.argmax(cos))]]
    assert np.linalg.norm(model.centroids, axis=1) == pytest.approx(1, abs=1e-4) and len(model.centroids) == 3 * len(model.langs)


def test_language_rejects_strangers_at_every_length(spark):
    """Thresholds never fall with length: what is rejected as random letters when short is so when long."""
    model = language.fit(table(spark, "/root/testdata/sf0.01", "documents"))
    assert (np.diff(model.least) >= 0).all() and model.least[13] > 0
    rng = np.random.default_rng(5)
    letters = np.array(list("abcdefghijklmnopqrstuvwxyz     "))
    syllables = ["ka", "lo", "mi", "pu", "ha", "na", "ke", "wi", "ono", "ala"]  # of no learned language
    for size in (2**k for k in range(6, 15)):
        noise = ["".join(rng.choice(letters, size)) for _ in range(20)]
        strange = [" ".join("".join(rng.choice(syllables, 3)) for _ in range(size // 6))[:size] for _ in range(20)]
        for texts in (noise, strange):
            kept = sum(not language.judge(t, model)[2] for t in texts)
            assert kept <= (0 if size >= 1024 else 4), (size, kept)
    clean = [r.text for r in table(spark, SF, "documents").where("lang is not null and length(text) > 60").collect()]
    assert np.mean([language.judge(t, model)[2] for t in clean]) < 0.02


def test_language_learns_repeats_once(spark):
    same = [(None, "the same english words again and again")] * 300 + [(1, "the same english words again and again")] * 300
    rows = same + [(k, f"ein deutscher Satz mit der Nummer {k}", "de") for k in range(40)]
    got = language.sample(docs(spark, rows)).groupBy("lang").count().collect()
    assert {r.lang: r["count"] for r in got}["en"] <= 2
    model = language.fit(docs(spark, rows))
    assert model.langs == ["de", "en"] and language.judge("ein Satz", model)[0] == "de"


# 4, mixing


def test_targets_share_all_words(spark):
    rows = spark.createDataFrame([("0a", 10), ("0b", 1000), ("0c", 500), ("1", 5)], "key string, mass long")
    got = {r.key: r.target for r in mixing.targets(rows).collect()}
    assert sum(got.values()) == pytest.approx(1515) and got["0a"] == 30 and got["1"] == 15
    assert got["0b"] / got["0c"] == pytest.approx(2)


def test_balance_of_two_margins(spark):
    cells = spark.createDataFrame([("a", "x", 60, 100.0, 90.0), ("a", "y", 40, 100.0, 110.0), ("b", "x", 50, 100.0, 90.0), ("b", "y", 50, 100.0, 110.0)], "s string, l string, mass long, ts double, tl double")
    got = mixing.balance(cells, [("s", "ts"), ("l", "tl")]).toPandas()
    got["taken"] = got.mass * got.rate
    assert got.groupby("s").taken.sum().tolist() == pytest.approx([100, 100], rel=1e-6)
    assert got.groupby("l").taken.sum().tolist() == pytest.approx([90, 110], rel=1e-6)


def test_joint_dual_against_raking(spark):
    rng = np.random.default_rng(14)
    mass = rng.integers(1, 500, (9, 4)).astype(float)
    rate = np.exp(rng.normal(scale=0.4, size=9))[:, None] * np.exp(rng.normal(scale=0.4, size=4))[None]  # a solution exists
    taken = mass * np.minimum(rate, 3.0)
    rows = [(f"s{i}", f"l{j}", int(mass[i, j]), float(taken[i].sum()), float(taken[:, j].sum())) for i in range(9) for j in range(4)]
    got = mixing.balance(spark.createDataFrame(rows, "s string, l string, mass long, ts double, tl double"), [("s", "ts"), ("l", "tl")]).collect()
    for r in got:
        assert r.rate == pytest.approx(min(3.0, rate[int(r.s[1:]), int(r.l[1:])]), rel=1e-6)
    with pytest.raises(RuntimeError):  # the margins ask for different sums
        mixing.balance(spark.createDataFrame([("a", "x", 10, 10.0, 12.0)], "s string, l string, mass long, ts double, tl double"), [("s", "ts"), ("l", "tl")], steps=5)


def test_mix_with_a_second_margin(spark):
    rows = [(k, "w " * (k % 37 + 1), "en" if k % 4 else "de", f"s{k % 3}") for k in range(900)]
    shares = spark.createDataFrame([("de", 0.4), ("en", 0.6)], "group string, share double")
    got = mixing.mix(docs(spark, rows), margin=(F.col("lang"), shares)).toPandas()
    by = got.groupby("source").agg(taken=("taken", "sum"), target=("target", "first"))
    assert (abs(by.taken - by.target) <= 0.01 * by.target + 80).all()
    assert got[got.lang == "de"].taken.sum() / got.taken.sum() == pytest.approx(0.4, abs=0.02) and got.copies.max() <= 3


def test_mix_copies_with_clashing_names(spark):
    df = docs(spark, [*ODD, (8, "a b c")], "size").withColumn("copy", F.lit("mine")).withColumn("d", F.lit(0))
    got = mixing.mix_copies(df)
    assert got.columns == [*df.columns, "mix_size", "target", "rate", "copies", "mix_copy"]
    assert got.where("size <> 'mine' or copy <> 'mine'").count() == 0 and got.where("mix_copy > copies").count() == 0


def test_mix_edges_and_reruns(spark):
    rows = ODD + [(100 + k, "w " * (k % 50 + 1), "en", f"s{k % 4}") for k in range(400)]
    df = docs(spark, rows, "taken")
    a, b = mixing.mix(df).collect(), mixing.mix(df.repartition(7)).collect()
    key = lambda r: (r.doc_id is None, r.doc_id, r.size, r.source or "", r.copies)
    assert sorted(map(key, a)) == sorted(map(key, b)) and len(a) == len(rows)
    assert all(r.taken == r.size * r.copies and 0 <= r.copies <= 3 for r in a)
    by = defaultdict(list)
    for r in a:
        by[r.source].append(r)
    for s in ("s0", "s1", "s2", "s3"):
        assert abs(sum(r.taken for r in by[s]) - by[s][0].target) <= 0.02 * by[s][0].target + 32
    assert mixing.mix(docs(spark, [])).count() == 0


def test_mix_meets_targets_where_rows_tie(spark):
    rows = [(None, "one two three four five", "en", "x")] * 400 + [(7, "six seven eight", "en", "y")] * 400 + [(1000 + k, "nine ten", "en", "z") for k in range(400)]
    got = mixing.mix(docs(spark, rows)).toPandas()
    assert len(got) == 1200 and got.copies.max() <= 3
    by = got.groupby("source").agg(taken=("taken", "sum"), target=("target", "first"), size=("size", "max"))
    assert (abs(by.taken - by.target) <= by["size"] / 2).all()
    again = mixing.mix(docs(spark, rows).repartition(5)).toPandas()
    assert sorted(zip(got.source, got.copies)) == sorted(zip(again.source, again.copies))


# 6, near copies


def _groups(rows, percent=85):
    sets = [(d, _shingles(t)) for d, t, *_ in rows]
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (_, a) in enumerate(sets):
        for j in range(i):
            b = sets[j][1]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                root[find(i)] = find(j)
    least: dict = {}
    for i, (d, _) in enumerate(sets):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [(d, len(s), least.get(find(i)) if s else d) for i, (d, s) in enumerate(sets)]


def test_near_groups_against_plain(spark):
    rng = np.random.default_rng(2)
    vocab = [f"w{k}" for k in range(5000)]
    base = [list(rng.choice(vocab, n)) for n in (6, 40, 150, 150, 700)]
    rows = [(1000 + k, " ".join(w)) for k, w in enumerate(base)]
    for k in range(160):
        w = list(base[k % 5])
        for _ in range(int(rng.integers(0, max(2, len(w) // 40)))):
            w[int(rng.integers(len(w)))] = str(rng.choice(vocab))
        rows.append((k + 10, " ".join(w).upper() if k % 2 else "\n".join(w)))
    rows += ODD
    got = near_dedup.near_groups(docs(spark, rows, "kept")).collect()
    assert sorted((r.doc_id or -1, r.n_shingles, r.component_id or -1) for r in got) == sorted((d or -1, n, c or -1) for d, n, c in _groups(rows))
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_near_chain_that_no_hub_sees(spark):
    words = [f"w{k}" for k in range(400)]
    rows = [(k + 1, " ".join(words[4 * k : 4 * k + 300])) for k in range(12)]  # each links with its neighbours alone
    got = near_dedup.near_groups(docs(spark, rows)).collect()
    assert {r.component_id for r in got} == {1}


def test_near_long_chain(spark):
    words = [f"w{k}" for k in range(20_000)]
    rows = [(k + 1, " ".join(words[2 * k : 2 * k + 100])) for k in range(3000)]
    got = near_dedup.near_groups(docs(spark, rows)).collect()
    assert {r.component_id for r in got} == {1}


def test_near_unlinked_members_of_a_bucket(spark):
    rng = np.random.default_rng(12)
    vocab = [f"w{k}" for k in range(9000)]
    stem = list(rng.choice(vocab, 300))
    rows = []
    for k in range(700):  # near a common stem, some within the threshold of each other only
        w = list(stem)
        at = int(rng.integers(0, 300)) if k % 3 else 40
        for j in range(int(rng.integers(4, 20))):
            w[(at + 7 * j) % 300] = f"x{k // 4}-{j}" if k % 2 else str(rng.choice(vocab))
        rows.append((k, " ".join(w)))
    got = near_dedup.near_groups(docs(spark, rows)).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted(_groups(rows)) and len({r.component_id for r in got}) > 20


def test_near_edges(spark):
    assert near_dedup.near_groups(docs(spark, [])).count() == 0
    kept = near_dedup.drop_near_copies(docs(spark, [(5, "same words in both of these texts"), (2, "same words in both of these texts")]))
    assert [r.doc_id for r in kept.collect()] == [2]
    assert near_dedup.drop_near_copies(docs(spark, [])).count() == 0
    assert near_dedup.rows_of_a_band(85) == 6 and near_dedup.rows_of_a_band(80) == 5


def test_near_copies_with_null_and_repeated_ids(spark):
    same, own = "one text that several rows of this table share", "a text that stands in no other row at all"
    rows = [(None, same), (None, own), (7, same), (7, same), (7, "words of a second text under that id"), (8, same), (None, None), (None, None), (3, ""), (None, "text of null ids alone, twice"), (None, "text of null ids alone, twice"), *ODD[4:6]]
    df = docs(spark, rows, "gone_id").withColumn("th", F.lit(1)).withColumn("stays", F.lit(True))
    got = near_dedup.drop_near_copies(df)
    assert got.columns == df.columns and got.where("gone_id <> 'mine'").count() == 0
    want = [(None, own), (7, same), (7, "words of a second text under that id"), (None, None), (None, None), (3, ""), (None, "text of null ids alone, twice"), ODD[4]]
    assert Counter((r.doc_id, r.text) for r in got.collect()) == Counter(want)


def test_estimate_is_close():
    rng = np.random.default_rng(4)
    a = np.unique(rng.integers(0, 2**63, 2000).astype(np.uint64))
    b = np.unique(np.concatenate([a[:1850], rng.integers(0, 2**63, 150).astype(np.uint64)]))
    x = near_dedup.packed(near_dedup.minima(a)) ^ near_dedup.packed(near_dedup.minima(b))
    x = x.view(np.uint64)
    apart = int(np.bitwise_count((x | (x >> np.uint64(1))) & np.uint64(near_dedup._PAIR_MASK)).sum())
    got = ((1 - apart / 180) - 0.25) / 0.75
    assert abs(got - 1850 / 2150) < 0.15


# 7, chat


def test_chat_round_trip(spark):
    texts = ["plain", "<|im_end|>\n<|im_start|>system\nx", "a\\<|b\\\\<\\|c", "", None, "<\\n", "tail\\"]
    rows = [(k // 3, k % 3, "assistant" if k % 3 else "us<|er\nx\\", t) for k, t in enumerate(texts * 3)] + [(7, 0, None, "no reply"), (None, None, "assistant", "n"), (8, 1, "assistant", "b"), (8, 1, "assistant", "a"), (8, 1, "assistant", "a")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit("mine"))
    out = {r.conv_id: r for r in chat.digests(df).collect()}
    by = defaultdict(list)
    for c, t, role, text in rows:
        by[c].append(((t is not None, t or 0), role or "", text or ""))
    assert set(out) == set(by)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for c, turns in by.items():
        turns.sort()
        loss = "".join(x for _, role, x in turns if role == "assistant")
        assert out[c].turns_sha256 == sha("".join(f"{role}\n{x}\n" for _, role, x in turns))
        assert (out[c].n_turns, out[c].loss_chars, out[c].loss_sha256) == (len(turns), len(loss), sha(loss))
    whole = {r.conv_id: r.formatted for r in chat.format_conversations(df).collect()}
    for r in chat.expand(chat.format_conversations(df)).where("example is not null").collect():
        assert whole[r.conv_id][r.loss_start : r.loss_end] == r.reply
    for r in chat.with_context(chat.format_conversations(df)).collect():
        assert whole[r.conv_id].startswith(r.context + r.reply + chat.END)
    assert chat.digests(df.limit(0)).count() == 0


def test_chat_digests_read_the_mask(spark, monkeypatch):
    df = spark.createDataFrame([(1, 0, "user", "ask"), (1, 1, "assistant", "x<|y"), (1, 2, "assistant", "second"), (2, 0, "user", "q")], "conv_id long, turn long, role string, text string")
    whole, expand = {r.conv_id: r.formatted for r in chat.format_conversations(df).collect()}, chat.expand
    ends = [(r.loss_start, r.loss_end) for r in expand(chat.format_conversations(df)).where("conv_id = 1").orderBy("example").collect()]
    monkeypatch.setattr(chat, "expand", lambda *args: expand(*args).withColumn("loss_end", F.col("loss_end") - 1))
    got = {r.conv_id: r for r in chat.digests(df).collect()}
    loss = "".join(whole[1][a : b - 1] for a, b in ends).replace("<\\|", "<|")
    assert loss == "x<|secon" and got[1].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest() and got[2].loss_chars == 0


# 8, lines


def test_lines_against_plain(spark):
    rng = np.random.default_rng(6)
    pool = [f"Line number {k} with enough characters to count, é{k}" for k in range(12)] + ["short", "", "   "]
    rows = [(int(d), "\n".join(rng.choice(pool, int(rng.integers(0, 9))))) for d in range(60)] + [(70, " \tLINE number 3 with enough characters to count, é3\x0b")] + ODD + [(3, "x\n")]
    key = lambda line: re.sub("[A-Z]", lambda c: c[0].lower(), line.strip(" \t\n\x0b\x0c\r"))
    seen = defaultdict(set)
    for d, t, *_ in rows:
        for line in (t or "").split("\n"):
            seen[key(line)].add(d)
    hot = {k: max((d for d in v if d is not None), default=None) for k, v in seen.items() if len(k) >= 40 and len(v) >= 5}
    want = []
    for d, t, *_ in rows:
        every = (t or "").split("\n")
        stay = [x for x in every if key(x) not in hot or hot[key(x)] == d]
        want.append((d or -1, len(every), len(every) - len(stay), "\n".join(stay)))
    for batches, fanout in ((4, 4), (5, 2), (1, 9), (3, 2)):
        got = line_dedup.dedup_lines(docs(spark, rows, "n_lines"), batches=batches, fanout=fanout)
        assert sorted((r.doc_id or -1, r.n_lines, r.n_dropped, r.text) for r in got.collect()) == sorted(want)
    assert line_dedup.dedup_lines(docs(spark, [])).count() == 0


def test_lines_of_any_ids(spark):
    rng = np.random.default_rng(16)
    shared = "a line of well over forty characters, shared"
    ends = [0, *range(2**60 - 6, 2**60)], [-(2**62), 2**62, -(2**63), 2**63 - 1, 5, None], [int(i) for i in rng.integers(-(2**63), 2**63 - 1, 40)]
    for ids in ends:
        rows = [(i, f"{shared}\nown {k}") for k, i in enumerate(ids)]
        got = {r.doc_id: r for r in line_dedup.dedup_lines(docs(spark, rows, "th")).collect()}
        top = max(i for i in ids if i is not None)
        assert len(got) == len(ids) and all(r.n_dropped == (r.doc_id != top) and (shared in r.text) == (r.doc_id == top) for r in got.values())


def test_lines_of_a_long_document_in_linear_time(spark):
    many = [f"line {k} is long enough to be a key of its own" for k in range(60_000)]
    rows = [(k, "\n".join(many)) for k in range(5)] + [(9, "x\n" + "\n".join(many[::2])), (9, many[1])]
    got = {(r.doc_id, r.n_lines): r for r in line_dedup.dedup_lines(docs(spark, rows)).collect()}
    assert got[9, 30_001].n_dropped == 0 and got[9, 1].n_dropped == 0 and got[0, 60_000].text == ""
    assert got[4, 60_000].n_dropped == 30_001 and got[4, 60_000].text == "\n".join(many[3::2])


def test_drop_lines_keeps_columns(spark):
    rows = [(k, "the same line of over forty characters in all\n" * (2 if k else 1) + ("" if k < 3 else "tail")) for k in range(6)] + ODD
    df = docs(spark, rows, "n_lines").withColumn("d", F.lit(1)).withColumn("places", F.lit(2))
    got = line_dedup.drop_lines(df)
    assert got.columns == df.columns and got.where("n_lines <> 'mine' or n_chars <> length(text)").count() == 0
    assert line_dedup.drop_lines(df.limit(0)).count() == 0


def test_runs_tell_what_is_fresh(spark):
    store = line_dedup.LineRuns(fanout=2)
    keys = lambda rows: spark.createDataFrame(rows, "doc_id long, h1 long, h2 long")
    fresh = lambda: sorted(r.h1 for table, _ in store.levels if table is not None for r in table.where("fresh").collect())
    for batch, new in (([(9, 1, 1), (8, 2, 2)], [1, 2]), ([(7, 1, 1), (7, 3, 3)], [1, 2, 3]), ([(6, 2, 2)], [1, 2, 3])):
        store.add(keys(batch))
        assert fresh() == new
    assert [n for _, n in store.levels] == [1, 1]
    assert sorted((r.h1, r.docs, r.holder) for r in store.finish().collect()) == [(1, 2, 9), (2, 2, 8), (3, 1, 7)]


# 9, personal data


PLAIN = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def _sound(kind, v):
    d = re.sub("[^0-9]", "", v)
    if kind == "ip":
        return all(int(x) <= 255 for x in v.split("."))
    if kind == "card":
        return 13 <= len(d) <= 19 and sum(x if i % 2 == 0 else 2 * x - 9 * (x > 4) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0
    return kind == "email" or 9 <= len(d) <= 15


def test_base_spans_against_plain(spark, corpus):
    hard = ["a@b.c_d@e.f a@b.c@d.e x@y 1.2.3.4.5.6.7.8 256.1.1.1 001.02.3.4", "+1 (23) 456-7890 4111 1111 1111 1111 é 4111-1111-1111-1112", "1" * 3000 + ".2.3.4", "@a@b.c@@d.e@f.g..h@i.j", "4111111111111111 +4111111111111111 +123456789", "a" * 100_000 + "@", "1 " * 40_000, None, ""]
    rows = [(r.doc_id, r.text) for r in corpus.select("doc_id", "text").collect()] + [(-k - 1, t) for k, t in enumerate(hard)] + ODD
    got = Counter((r.doc_id, r.base_sha256, r.n_email, r.n_ip, r.n_card, r.n_phone) for r in privacy.digests(docs(spark, rows, "spans")).collect())
    want: Counter = Counter()
    for d, t, *_ in rows:
        found = [(k, m.start(), m.end()) for k, p in PLAIN for m in re.finditer(p, t or "") if _sound(k, m.group())]
        n = Counter(k for k, _, _ in found)
        want[d, hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in found).encode()).hexdigest(), n["email"], n["ip"], n["card"], n["phone"]] += 1
    assert got == want


def test_spans_of_long_texts_in_linear_time(spark):
    words = " ".join(f"word{'abcdefghij'[k % 10]}{'klmnopqrst'[k // 10 % 10]}{'uvwxyz'[k // 100 % 6]} x{k}@y{k}.org" for k in range(50_000))
    began = time.time()
    got = {r.doc_id: r for r in privacy.digests(docs(spark, [(1, words), (2, "1.2.3.4 " * 100_000), (3, "plain words " * 50_000), (4, "nothing")])).collect()}
    assert time.time() - began < 90
    assert (got[1].n_email, got[2].n_ip, got[3].n_email) == (50_000, 100_000, 0)
    want = hashlib.sha256(",".join(f"ip:{8 * k}:{8 * k + 7}" for k in range(100_000)).encode()).hexdigest()
    assert got[2].base_sha256 == want


def test_disclosing_terms(spark):
    filler = ["alpha beta", "gamma delta", "kappa sigma", "omega theta", "lambda rho"]
    rows = [(k, f"{filler[k]} zebulon wrote to Jo@X.org about common things {k * 'pad '}") for k in range(5)]
    rows += [(50 + k, f"common things happen {k}") for k in range(40)] + [(600, "mail me at solo@y.org with raretoken")]
    got = {r.doc_id: r for r in privacy.sanitise(docs(spark, rows, "sanitised")).collect()}
    for k in range(5):
        kinds = [(s.kind, rows[k][1][s.start : s.end]) for s in got[k].spans]
        assert ("email", "Jo@X.org") in kinds and ("term", "zebulon") in kinds and ("term", "common") not in kinds
        assert "zebulon" not in got[k].sanitised and "[EMAIL]" in got[k].sanitised and "common things" in got[k].sanitised
    assert [s.kind for s in got[600].spans] == ["email"]
    copies = [(k, "alpha zebulon wrote to jo@x.org about it") for k in range(9)]
    assert privacy.digests(docs(spark, copies)).agg(F.sum("n_term")).first()[0] == 0
    assert privacy.digests(docs(spark, [])).count() == 0


def _told(rows, alpha=privacy.ALPHA, prior=privacy.PRIOR):
    """Plain version: the disclosing terms of each text."""
    holds, terms = {}, {}
    for t in {t for _, t in rows}:
        found = [(k, m.group()) for k, p in PLAIN for m in re.finditer(p, t) if _sound(k, m.group())]
        holds[t] = {(k, v.lower() if k in ("email", "ip") else re.sub("[^0-9]", "", v)) for k, v in found}
        terms[t] = {w.lower() for w in re.findall(r"[^\W\d_]{3,}", t)}
    n_t = Counter(w for x in terms.values() for w in x)
    out = defaultdict(set)
    for e in set().union(*holds.values()):
        texts = [t for t in holds if e in holds[t]]
        p = len(texts) / len(holds)
        n_et = Counter(w for t in texts for w in terms[t])
        told = {w for w, k in n_et.items() if p < 1 and (k + prior * p) / (n_t[w] + prior) >= p ** (1 - 1 / alpha)}
        for t in texts:
            out[t] |= told & terms[t]
    return out


def test_terms_of_whole_texts_and_rare_entities(spark):
    far = " ".join(["common things happen"] * 10)
    rows = [(k, f"Zebulon{'abcdef'[k]} {far} zebulon {'bcdefg'[k] * 4} {far} wrote to jo@x.org") for k in range(6)]
    rows += [(50 + k, f"common things happen {k} at {k % 9}.1.1.{k % 7}") for k in range(40)] + [(200 + k, f"common things happen again {k}") for k in range(2500)]
    rows += [(9000, f"the Raretoken spoke {far} to solo@y.org"), (9001, f"the Raretoken spoke {far} to solo@y.org"), (9002, f"a Twotoken {far} two@z.org"), (9003, "no twotoken is here")]
    got = {r.doc_id: r.spans for r in privacy.digests(docs(spark, rows, "spans")).collect()}
    want = _told(rows)
    for d, t in rows:
        words = [t[int(a) : int(b)].lower() for k, a, b in (s.split(":") for s in got[d].split(",") if s) if k == "term"]
        whole = re.sub(r"\S+@\S+", " ", t)  # no span stands in an entity
        assert sorted(words) == sorted(w for w in re.findall(r"[^\W\d_]{3,}", whole.lower()) if w in want[t])
    for d, word, told in ((0, "zebulon", True), (9000, "raretoken", True), (9001, "raretoken", True), (9002, "twotoken", False), (0, "common", False)):
        assert (word in want[dict(rows)[d]]) == told


# 10, audio


def test_audio_finds_excerpts_and_noise():
    rng = np.random.default_rng(8)
    tune = audio.render(rng.normal(size=120))
    a = audio.fingerprint(tune)
    cut = audio.fingerprint(tune[audio.HOP * 30 :] + rng.normal(scale=0.01, size=len(tune) - audio.HOP * 30))
    other = audio.fingerprint(audio.render(rng.normal(size=120)))
    block = audio._Block([(1, a)])
    (q, shift, overlap, error), = block.aligned(2, cut)
    assert (q, shift) == (1, -30) and overlap == len(cut) and error < 0.1
    assert block.aligned(2, other) == [] and block.aligned(1, a) == [] and block.aligned(3, np.empty(0, np.uint32)) == []
    assert len(audio.fingerprint(np.zeros(10))) == 0 and len(set(audio.fingerprint(np.zeros(60_000)).tolist())) == 1


def test_integral_image_areas_match_sums():
    rng = np.random.default_rng(9)
    c = rng.random((40, 12))
    total = np.zeros((41, 13))
    total[1:, 1:] = c.cumsum(0).cumsum(1)
    assert total[20, 7] - total[4, 7] - total[20, 3] + total[4, 3] == pytest.approx(c[4:20, 3:7].sum())


def test_audio_search_recall_against_all_pairs(spark):
    rng = np.random.default_rng(10)
    base = rng.normal(size=(20, 64))
    rows = [(i, (base[i % 20] + rng.normal(scale=0.02, size=64)).tolist()) for i in range(300)] + [(1000, None), (1100, []), (1200, rows_same := base[0].tolist()), (1200, rows_same)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("print", F.lit("mine"))
    got = {r.vec_id: r for r in audio.search(df, "vec_id", "embedding", audio.render).collect()}
    prints = [(i, audio.fingerprint(audio.render(np.asarray(v))) if v else np.empty(0, np.uint32)) for i, v in rows]
    hits = all_hits = 0
    for q, p in prints:
        if q % audio.QUERY_EVERY or not len(p):
            continue
        true = sum(1 for i, r in prints if i != q and len(r) and np.bitwise_count(p ^ r).sum() / (32 * len(p)) <= audio.MAX_ERROR)
        all_hits += true
        hits += min(true, got[q].n_matches)
    assert all_hits > 0 and hits >= 0.9 * all_hits
    assert got[1000].n_matches == 0 and got[1100].n_frames == 0 and len(got) == 6
    assert audio.search(df.limit(0), "vec_id", "embedding", audio.render).count() == 0


def test_audio_search_finds_shifted_recordings(spark, monkeypatch):
    monkeypatch.setattr(audio, "HELD", 600)  # many blocks and chunks
    rng = np.random.default_rng(17)
    base = rng.normal(size=(12, 64))
    rows = [(100 * k, base[k].tolist()) for k in range(12)]
    for k in range(240):
        v, cut = base[k % 12] + rng.normal(scale=0.02, size=64), int(rng.integers(0, 25))
        rows.append((5000 + 2 * k + 1, (v[cut:] if k % 2 else np.concatenate([rng.normal(size=cut), v[: 64 - cut]])).tolist()))
    got = {r.vec_id: r for r in audio.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id", "embedding", audio.render).collect()}
    prints = {i: audio.fingerprint(audio.render(np.asarray(v))) for i, v in rows}
    want = {q: [i for i, p in prints.items() if i != q and _best_alignment(prints[q], p)] for q in prints if q % 100 == 0}
    assert {q: len(w) for q, w in want.items()} == {q: r.n_matches for q, r in got.items()}
    assert sum(map(len, want.values())) > 100 and all(r.best_id in want[q] for q, r in got.items() if r.n_matches)
    assert sum(r.best_offset != 0 for r in got.values() if r.n_matches) > 5


def _best_alignment(q, p):
    """Plain version: the told offset of a pair over all offsets, or None."""
    found = []
    for shift in range(-len(q) + 1, len(p)):
        pairs = [(int(q[i]) ^ int(p[i + shift])).bit_count() for i in range(len(q)) if 0 <= i + shift < len(p)]
        error = sum(pairs) / (32 * max(1, len(pairs)))
        if len(pairs) >= audio.MIN_OVERLAP and error <= audio.MAX_ERROR:
            found.append((-pairs.count(0), error, abs(shift), shift, len(pairs)))
    return min(found)[3:] + (min(found)[1],) if found else None


def test_audio_alignment_is_complete_up_to_max_error():
    rng = np.random.default_rng(11)
    queries = [(k, rng.integers(0, 2**32, n).astype(np.uint32)) for k, n in enumerate([48] * 12 + [16, 17, 33, 15, 0])]
    block = audio._Block(queries)
    hits = unvoted = 0
    for k, q in queries:
        for share in (0.02, 0.1, 0.12, 0.14, 0.149, 0.16):
            for first in (0, 20, 32):
                p = q[first:].copy() if len(q) == 48 else q.copy()
                bits = rng.permutation(32 * len(p))[: int(share * 32 * len(p))]
                np.bitwise_xor.at(p, bits // 32, (np.uint32(1) << (bits % 32).astype(np.uint32)))
                p = np.concatenate([rng.integers(0, 2**32, int(rng.integers(0, 9))).astype(np.uint32), p])
                want = [(i, *w) for i, other in queries if (w := _best_alignment(other, p))]
                assert block.aligned(-1, p) == want
                hits += len(want)
                unvoted += sum(not np.isin(p, queries[w[0]][1]).any() for w in want)
    assert hits > 100 and unvoted > 10


# queries with SQL


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_against_duckdb(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations", "pages", "labels", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = QUERIES[name](spark, SF)
    got = con.execute(ORACLES[name])
    cols = [c[0] for c in got.description]
    assert sorted(cols) == sorted(df.columns)
    order = sorted(cols)
    plain = lambda v: repr(round(v, 6)) if isinstance(v, float) else str(v)
    assert sorted(tuple(plain(r[c]) for c in order) for r in df.collect()) == sorted(tuple(plain(r[cols.index(c)]) for c in order) for r in got.fetchall())
