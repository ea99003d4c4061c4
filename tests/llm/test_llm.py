"""Each training-data operator against brute force, an exact round trip or held-out labels, and on odd tables."""

import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lintlake.llm import ann, chat, entropy_mix, jaccard_join, linkgraph, lm_score, media, pack, quality, toxicity
from lintlake.llm.queries import queries

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def odd_docs(spark):
    """Nulls everywhere, empty and very long texts, repeated rows, and columns whose names operators use inside."""
    long = " ".join(f"w{i % 700}x{i % 13}" for i in range(40_000))
    rows = [(1, "a b c d e f", "en", "s1", 1), (1, "a b c d e f", "en", "s1", 1), (2, None, None, None, None), (3, "", "en", "s1", 0), (4, " \t\n ", "en", "s2", 4), (5, long, "en", "s2", 9), (6, long + " end", "en", None, 9), (None, "a b c d e f", "en", "s1", 1), (7, "one two", "fr", "s2", 2), (8, "One TWO", "fr", "s3", 2)]
    df = spark.createDataFrame(rows, DOCS)
    for name in ("k", "t", "n", "node", "name", "size", "rate", "label", "target", "h"):
        df = df.withColumn(name, F.lit("clash"))
    return df


def brute_classes(rows, words=5, percent=80):
    low = {i: i + 32 for i in range(65, 91)}
    sets, ids = [], []
    for k, t in rows:
        w = WORD.findall((t or "").translate(low))
        sets.append({tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set())
        ids.append(k)
    label = list(range(len(sets)))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    links = [0] * len(sets)
    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                label[root(i)] = root(j)
                links[i] += 1
                links[j] += 1
    least = defaultdict(list)
    for i in range(len(sets)):
        least[root(i)].append(ids[i])
    return [(k, len(s), min((x for x in least[root(i)] if x is not None), default=None), links[i]) for i, (k, s) in enumerate(zip(ids, sets, strict=True))]


def near_copies(seed=1):
    """Families of copies with few to many edits, exact copies, and texts that share a long passage."""
    rng = random.Random(seed)
    words = [f"v{i}" for i in range(300)]
    rows, n = [], 0
    for family in range(12):
        base = [rng.choice(words) for _ in range(rng.choice([3, 5, 30, 120]))]
        for _ in range(rng.choice([1, 3, 25])):
            t = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                t[rng.randrange(len(t))] = rng.choice(words)
            rows.append((n, " ".join(t).upper() if family % 2 else " ".join(t)))
            n += 1
    passage = " ".join(rng.choice(words) for _ in range(60))
    for _ in range(30):
        rows.append((n, passage + " " + " ".join(rng.choice(words) for _ in range(rng.choice([2, 8, 40])))))
        n += 1
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("chunk", "words", "percent"), [(1024, 4, 85), (7, 5, 80), (7, 4, 85)])
def test_jaccard_classes_equal_brute_force(spark, chunk, words, percent):
    rows = near_copies(chunk)
    got = jaccard_join.jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string"), percent, words, chunk_nodes=chunk, block_nodes=chunk)
    assert sorted(tuple(r) for r in got.select("doc_id", "n_shingles", "component_id", "n_links").collect()) == sorted(brute_classes(rows, words, percent))


def test_linked_equals_counting():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 60, 80)
    sets = [np.unique(np.where(rng.random(80) < rng.choice([0.02, 0.3]), rng.integers(0, 1 << 60, 80), base)[: rng.integers(1, 81)]).astype(np.uint64) for _ in range(60)]
    want = [[100 * len(np.intersect1d(x, y)) >= 80 * len(np.union1d(x, y)) for y in sets[25:]] for x in sets[:25]]
    assert (jaccard_join.linked(sets[:25], sets[25:], 80) == np.array(want)).all() and np.any(want)


def test_small_tables_are_written_in_few_files(spark, monkeypatch):
    made, materialise = [], jaccard_join.materialise
    monkeypatch.setattr(jaccard_join, "materialise", lambda *a: made.append(out := materialise(*a)) or made.append(len(out.inputFiles())) or out)
    names = ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")
    before = [spark.conf.get(n) for n in names]
    for n, v in zip(names, ("23", "false"), strict=True):
        spark.conf.set(n, v)
    try:
        texts = near_copies()
        got = jaccard_join.jaccard_classes(spark.createDataFrame(texts, "doc_id long, text string").coalesce(1)).select("doc_id", "n_shingles", "component_id", "n_links").collect()
    finally:
        for n, v in zip(names, before, strict=True):
            spark.conf.set(n, v)
    assert max(made[1::2]) == 1
    assert sorted(map(tuple, got)) == sorted(brute_classes(texts))


def test_jaccard_on_odd_tables(spark):
    df = odd_docs(spark)
    got = sorted(map(tuple, jaccard_join.jaccard_classes(df).select("doc_id", "n_shingles", "component_id", "n_links").collect()), key=str)
    assert got == sorted([(k, n, c if n else k, m) for k, n, c, m in brute_classes([(r.doc_id, r.text) for r in df.collect()])], key=str)
    assert jaccard_join.jaccard_classes(df.limit(0)).count() == 0


def test_joiner_recursion_is_exact():
    rng = np.random.default_rng(0)
    sets = []
    for _ in range(40):
        base = rng.integers(0, 400, rng.integers(5, 60))
        for _ in range(5):
            s = base.copy()
            s[rng.integers(0, len(s), rng.integers(0, 6))] = rng.integers(0, 400)
            sets.append(np.unique(s).astype(np.uint64))
    j = jaccard_join.Joiner(sets, 85)
    j.join(np.arange(len(sets)))
    linked = [[100 * len(np.intersect1d(a, b)) >= 85 * len(np.union1d(a, b)) for b in sets] for a in sets]
    label = list(range(len(sets)))
    for _ in range(len(sets)):
        new = [min(label[b] for b in range(len(sets)) if linked[a][b]) for a in range(len(sets))]
        if new == label:
            break
        label = new
    same = lambda x: [list(x).index(v) for v in x]
    assert same(j.labels) == same(label)


def auc(y, s):
    order = pd.Series(s).rank().to_numpy()
    y = np.asarray(y, bool)
    return (order[y].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (~y).sum())


@pytest.fixture(scope="module")
def labelled(spark, data):
    from lintlake.llm.common import table

    rich = data.replace("sf0.001", "sf0.01")
    return table(spark, rich, "documents"), table(spark, rich, "labels")


def test_quality_on_held_out_labels(labelled):
    docs, labels = labelled
    got = quality.score_quality(docs, labels, name="p").join(labels, "doc_id").where(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2).toPandas()
    assert auc(got["quality"], got["p"]) > 0.9


def test_quality_scores_equal_sizes_and_calibration_written_out(labelled):
    """The fit doesn't depend on partitions, and each score follows from the sizes of its blocks under both dictionaries."""
    import zstandard

    docs, labels = labelled
    docs = docs.where("doc_id < 400")
    fitted, again = (quality.fit(docs.repartition(n), labels) for n in (2, 7))
    assert fitted[:2] == again[:2] and np.allclose(fitted[2][2], again[2][2])
    good, bad, (mean, scale, w), _ = fitted
    odd = docs.sparkSession.createDataFrame([(-1, ""), (-2, None), (-3, "\u00e9" * 5000)], "doc_id long, text string")
    rows = quality.score(docs.select("doc_id", "text").union(odd), fitted, name="p").collect()
    for r in rows:
        data = (r.text or "").encode()
        size = {}
        for kind, d in (("good", good), ("bad", bad)):
            z = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_checksum=False, write_dict_id=False)
            size[kind] = sum(len(z.compress(data[i : i + 1024])) for i in range(0, len(data), 1024))
        d, g = (size["bad"] - size["good"]) / max(1, *size.values()), size["good"] / max(1, len(data))
        z = w[0] + sum(w[1 + i] * (x - mean[i]) / scale[i] for i, x in enumerate((d, g, d * d, g * g, d * g)))
        assert abs(r.p - 1 / (1 + np.exp(-np.clip(z, -30, 30)))) < 1e-9
    assert len(rows) > 100


def test_toxicity_on_held_out_labels(labelled):
    docs, labels = labelled
    got = toxicity.score_toxicity(docs, labels, name="p").join(labels, "doc_id").toPandas()
    fold = got["doc_id"].map(lambda k: zlib.crc32(str(k).encode()) % 5)
    held = got[(fold == 0)]
    assert ((held["p"] >= 0.5) & (held["toxic"] == 0)).mean() < 0.05
    assert auc(held["toxic"], held["p"]) > 0.8


def test_toxicity_weighs_words_of_rare_labels(spark):
    words = [f"{'bcdfghjklm'[i // 10]}a{'nprstvwxyz'[i % 10]}e" for i in range(100)]
    rng, rows = random.Random(2), []
    for i in range(2000):
        toxic = i < 60
        sign = i < 54 or 60 <= i < 360  # nine tenths of the toxic, fewer than a sixth of the clean
        rows.append((i, " ".join([rng.choice(words) for _ in range(6)] + ["zorkum"] * sign), int(toxic)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    assert any("zork" in f for f in toxicity.fit(df, df)[1])


def test_restorer_sees_through_disguise():
    texts = ["you are a moron and a clown and stupid trash", "what a disgusting idiot that loser is"] * 20
    r = toxicity.Restorer(toxicity.log_model(toxicity.trigram_counts(texts, toxicity.symbol_table())))
    for shown, word in [("m0r0n", "moron"), ("cl0wn", "clown"), ("$tupid", "stupid"), ("stuuuupid", "stupid"), ("tr4sh", "trash"), ("s.t.u.p.i.d", "stupid"), ("d1sgust1ng", "disgusting"), ("1d10t", "idiot")]:
        assert word in r.token(shown), (shown, r.token(shown))
    assert "moron" in toxicity.words_of("what a m o r o n", r)
    assert "moron" in toxicity.words_of("m 0 r 0 n", r) and "moron" in toxicity.words_of("m o o o r o n", r)
    assert {"stupid", "loser"} <= toxicity.words_of("s t u p i d  l o s e r", r) | toxicity.words_of("s-t-u-p-1-d l-0-s-e-r", r)
    assert r.decode("s t u p i d l o s e r", spaced=True).replace(" ", "") == "stupidloser"
    assert r.decode("stu" + "u" * 100_000 + "pid") == "stupid"
    assert r.token("plain") == ("plain",)


@pytest.mark.parametrize("shown", ["m0rn", "a11", "$s5", "o.0m", "mmmo", "m o n", "m  0 n", "i 1 l"])
def test_decoding_equals_every_path_through_the_lattice(shown):
    """All readings of each character and gap, enumerated, with the channel and the language model written out again."""
    texts = ["moron mom loss ass all ill moon in on"] * 5
    r = toxicity.Restorer(toxicity.log_model(toxicity.trigram_counts(texts, toxicity.symbol_table())))
    spaced = " " in shown
    gaps = [len(x) for x in re.findall(" +", shown)]
    found = []

    def walk(rest, before, a, b, score, out):
        if not rest:
            found.append((score + r.model[a][b][0], out))
            return
        if m := re.match(" +", rest):
            wide = len(m[0]) > min(gaps)
            p = 0.2 if wide else 0.8
            walk(rest[m.end() :], before, a, b, score + np.log(p), out)
            if b:
                walk(rest[m.end() :], before, b, 0, score + np.log(1 - p) + r.model[a][b][0], out + " ")
            return
        c, rest = rest[0], rest[1:]
        can = toxicity.LEET.get(c, "")
        for x, p in [(c, 0.9)] * c.isalpha() + [(x, 0.7 / len(can)) for x in can]:
            s = r.symbol(x)
            walk(rest, c, b, s, score + np.log(p) + r.model[a][b][s], out + x)
        if c == before and b:
            walk(rest, c, a, b, score + np.log(0.3), out)
        elif not c.isalpha():
            walk(rest, c, a, b, score + np.log(0.0005 if can else 0.05), out)

    walk(shown, "", 0, 0, 0.0, "")
    assert r.decode(shown, spaced=spaced) == max(found)[1]


@pytest.mark.parametrize("score", [quality.score_quality, toxicity.score_toxicity])
def test_scores_on_odd_tables(spark, score):
    df = odd_docs(spark)
    labels = spark.createDataFrame([(1, 1, 1), (1, 1, 0), (5, 0, 0), (6, 1, 1), (7, None, None), (None, 1, 1), (8, 0, 1)], "doc_id long, quality int, toxic int")
    rows = score(df, labels, name="p").select("p", *df.columns).collect()
    assert len(rows) == df.count() and all(0 <= r.p <= 1 for r in rows)
    assert len({r.p for r in rows if not (r.text or "").strip() and not r.text}) == 1
    assert score(df.limit(0), labels, name="p").count() == 0
    assert {r.p for r in score(df, labels.limit(0), name="p").collect()} <= {0.0, 0.5}


def test_url_parts_and_rules(spark):
    urls = [(1, "http://A.Example.NET/en/x?q#f"), (2, "https://example.net/enx"), (3, "http://net/"), (4, "http://b.org/fr/1"), (5, "x://example.com/de/"), (6, "nothing"), (7, None), (8, "http://badexample.com/de/"), (9, "http://h?x://y"), (10, "http://ÄB.org/fr/"), (10, "http://ÄB.org/fr/")]
    pages = spark.createDataFrame([(i, u, None if i % 2 else '<a href="//other.org/x">') for i, u in urls], "page_id long, url string, html string").withColumn("host", F.lit("clash")).withColumn("key", F.lit("clash"))
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in linkgraph.judge(pages).collect()}
    assert got[1] == ("a.example.net", "/en/x", "example.net/en/", "allow")
    assert got[2] == ("example.net", "/enx", "net/", "block")
    assert got[3][2:] == ("net/", "block") and got[4][2:] == ("org/fr/", "allow") and got[5][2:] == ("example.com/de/", "block")
    assert got[6][:3] == ("", "", None) and got[7][:3] == ("", "", None) and got[6][3] == "allow"
    assert got[8][2] is None and got[9][:2] == ("h", "") and got[10][0] == "Äb.org"
    assert linkgraph.judge(pages).count() == 11 and linkgraph.judge(pages.limit(0)).count() == 0


def power_iteration(edges, seed, names):
    m = np.zeros((len(names),) * 2)
    for s, t, n in edges:
        m[names.index(t), names.index(s)] += n
    m = m / np.maximum(m.sum(0), 1e-12)
    v = seed.copy()
    for _ in range(400):
        f = 0.85 * m @ v
        v = f + seed * (1 - f.sum())
    return v


def test_pagerank_equals_power_iteration(spark):
    e = [("a", "b", 1.0), ("a", "c", 3.0), ("b", "c", 1.0), ("c", "a", 1.0), ("d", "c", 2.0)]
    chain = [(f"h{i}", f"h{i + 1}", 1.0) for i in range(30)]  # longer than any number of steps between two looks
    edges = spark.createDataFrame([("x", *r) for r in e] + [("y", *r) for r in chain], "kind string, src string, dst string, n double")
    seeds = spark.createDataFrame([("x", "a", 0.5), ("x", "d", 0.5), ("y", "h0", 1.0)], "kind string, host string, weight double")
    got = {(r.kind, r.host): r.score for r in linkgraph.propagate(edges, seeds).collect()}
    for kind, links, names, seed in (("x", e, list("abcd"), [0.5, 0, 0, 0.5]), ("y", chain, [f"h{i}" for i in range(31)], [1] + [0] * 30)):
        want = power_iteration(links, np.array(seed, float), names)
        assert all(abs(got.get((kind, n), 0) - x) < 1e-5 for n, x in zip(names, want, strict=True))
    assert got["y", "h30"] > 0


def test_propagated_verdicts_equal_brute_force(spark):
    """Every verdict without a rule, from dense matrices over the same links."""
    rng = random.Random(12)
    hosts = [f"s{i}.{d}" for i in range(12) for d in ("example.net", "b.org", "c.de", "plain.info")]
    rows = []
    for i in range(150):
        h = rng.choice(hosts)
        links = "".join(f'<a href="https://{rng.choice(hosts)}/x">' for _ in range(rng.randrange(4)))
        rows.append((i, f"https://{h}/{rng.choice(['en', 'fr', 'de'])}/{i}", links))
    got = linkgraph.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).toPandas()
    rules = sorted([("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")], key=lambda r: -len(r[1] + r[2]))
    good, bad, edges = defaultdict(float), defaultdict(float), defaultdict(float)
    of = {}
    for i, u, x in rows:
        h, p = re.match(r"https://([^/]*)(.*)", u).groups()
        of[i] = next((a for a, rh, rp in rules if (h == rh or h.endswith("." + rh)) and p.startswith(rp)), None)
        good[h] += of[i] == "allow"
        bad[h] += of[i] == "block"
        for t in re.findall(r"//([^/]*)/x", x):
            if t != h:
                edges[h, t] += 1
        d = h
        while d.count(".") > 0:
            up = d.split(".", 1)[1]
            edges[d, up] = edges[d, up] if (d, up) in edges else 0
            d = up
    for d, up in [(s, t) for s, t in edges if s.split(".", 1)[-1] == t]:
        edges[d, up] += 1
        edges[up, d] += 1
    names = sorted({x for e in edges for x in e})
    e = [(s, t, n) for (s, t), n in edges.items() if n]
    seed = lambda w: np.array([w[n] for n in names]) / sum(w.values())
    trust = dict(zip(names, power_iteration(e, seed(good), names), strict=True))
    distrust = dict(zip(names, power_iteration([(t, s, n) for s, t, n in e], seed(bad), names), strict=True))
    propagated = 0
    for r in got.itertuples():
        assert abs(trust[r.host] - r.trust) < 1e-5 and abs(distrust[r.host] - r.distrust) < 1e-5
        if of[r.page_id]:
            assert r.verdict == of[r.page_id]
        elif abs(trust[r.host] - distrust[r.host]) > 1e-5:
            propagated += 1
            assert r.verdict == ("block" if distrust[r.host] > trust[r.host] else "allow")
    assert propagated > 30


def test_url_parts_equal_sql(spark, data):
    import duckdb

    from lintlake.llm.common import table

    rich = data.replace("sf0.001", "sf0.01")
    got = sorted((r.page_id, r.host, r.path, r.rule, r.verdict if r.rule else None) for r in linkgraph.judge(table(spark, rich, "pages")).collect())
    fits = lambda h, p: f"(host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '{p}')"
    rules = [("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"), ("net", "/", "block")]  # longest first
    rule = " ".join(f"when {fits(h, p)} then '{h}{p}'" for h, p, _ in rules)
    action = " ".join(f"when {fits(h, p)} then '{a}'" for h, p, a in rules)
    want = duckdb.sql(f"""with parts as (select page_id, case when instr(url, '://') > 0 then translate(regexp_extract(url[instr(url, '://') + 3:], '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') else '' end host,
        case when instr(url, '://') > 0 then regexp_extract(url[instr(url, '://') + 3:], '^[^/?#]*([^?#]*)', 1) else '' end path from '{rich}/pages.parquet')
        select page_id, host, path, case {rule} end, case {action} end from parts""").fetchall()
    assert got == sorted(want)


def test_ann_equals_brute_force_with_all_lists_and_ties(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((600, 24))
    x[100:160] = x[40]  # ties
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(700, None), (720, [0.0] * 24), (740, [float("nan")] * 24), (760, [None] * 24), (None, x[0].tolist()), (780, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("list", F.lit("clash"))
    got = ann.search(df, lists=8, probes=8, chunk=100).toPandas().sort_values(["query_id", "rank"])
    hits = 0
    for q, g in got.groupby("query_id"):
        s = (x * x[q]).sum(1)
        s[q] = -np.inf
        want = np.lexsort((np.arange(600), -s))[:20]
        assert list(g["rank"]) == list(range(1, 21)) and np.allclose(g["score"], s[g["vec_id"]])
        hits += len(set(want) & set(g["vec_id"]))
        if q == 40:
            assert list(g["vec_id"]) == list(range(100, 120))  # equal scores by id
    assert got["query_id"].nunique() == 30 and hits / 600 > 0.97
    assert ann.search(df.limit(0)).count() == 0
    assert ann.search(df.where("vec_id in (0, 1, 2)")).select("vec_id", "rank").orderBy("rank").collect() in ([(1, 1), (2, 2)], [(2, 1), (1, 2)])


def test_ann_always_finds_as_many_as_there_are(spark):
    rng = np.random.default_rng(6)
    x = rng.standard_normal((500, 16))
    x[:300] += 9 * np.eye(16)[0]  # most in one direction, so that many lists are small
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = ann.search(df, probes=1).toPandas()
    assert (got.groupby("query_id").size() == 20).all() and got["query_id"].nunique() == 25
    again = ann.search(df.unionByName(df), probes=2).toPandas()  # each key twice: as many candidates, none of them the query
    assert (again.groupby("query_id").size() == 20).all() and (again["query_id"] != again["vec_id"]).all()


def test_ann_tells_near_copies_apart(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((1500, 64))
    x[300:900] = x[0] + 0.05 * rng.standard_normal((600, 64))  # a large group of near copies
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    got = ann.search(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")).toPandas()
    hits = defaultdict(list)
    for q, g in got.groupby("query_id"):
        s = (x * x[q]).sum(1)
        s[q] = -np.inf
        hits[300 <= q < 900].append(len(set(np.argsort(-s)[:20]) & set(g["vec_id"])) / 20)
    assert np.mean(hits[True]) > 0.95 and np.mean(hits[False]) > 0.85 and np.mean(hits[True] + hits[False]) >= 0.9


def brute_targets(sizes, weights=(5.0, 2.0, 1.0), share=1.5, cap=2):
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [s for s in sizes if s is None]
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    target, full, left = {}, set(), share * sum(sizes.values())
    while True:
        free = [s for s in names if s not in full]
        over = [s for s in free if left * w[s] / sum(w[x] for x in free) > cap * sizes[s]]
        if not over:
            return target | {s: left * w[s] / sum(w[x] for x in free) for s in free}
        for s in over:
            target[s], left = cap * sizes[s], left - cap * sizes[s]
            full.add(s)


def test_mix_targets_and_copies(spark):
    rng = random.Random(4)
    rows = [(i, "w " * rng.choice([1, 5, 20, 60, 200]), "en", rng.choice(["a"] * 8 + ["b", "c", "é", "Z", None]), 1) for i in range(3000)]
    docs = spark.createDataFrame(rows, DOCS)
    got = entropy_mix.entropy_mix(docs).toPandas()
    sizes = defaultdict(int)
    for _, t, _, s, _ in rows:
        sizes[s] += len(t.split())
    want = brute_targets(dict(sizes))
    for s, g in got.groupby("source", dropna=False):
        s = None if pd.isna(s) else s
        assert abs(g["mix_target"].iloc[0] - want[s]) < 1e-6 * want[s] and (g["mix_source_size"] == sizes[s]).all()
        assert abs((g["mix_size"] * g["mix_rate"]).sum() / want[s] - 1) < 1e-6
        assert abs((g["mix_size"] * g["mix_copies"]).sum() / want[s] - 1) < 0.02
    assert got["mix_copies"].between(0, 2).all()
    again = entropy_mix.entropy_mix(docs.repartition(3)).toPandas()
    assert dict(zip(got["doc_id"], got["mix_copies"], strict=True)) == dict(zip(again["doc_id"], again["mix_copies"], strict=True))


def test_mix_meets_targets_with_repeated_rows(spark):
    rng = random.Random(5)
    rows = [(7, "w " * 90, "en", "a", 1)] * 40 + [(i, "w " * rng.randrange(1, 60), "en", rng.choice("ab"), 1) for i in range(100, 160)] + [(None, "w " * 30, "en", "c", 1)] * 50
    docs = spark.createDataFrame(rows, DOCS)
    got = entropy_mix.entropy_mix(docs).toPandas()
    assert (got["mix_gap"] < 1e-6).all()
    for _, g in got.groupby("source"):
        target = g["mix_target"].iloc[0]
        assert abs((g["mix_size"] * g["mix_copies"]).sum() - target) <= max(0.01 * target, 45), (g["source"].iloc[0], target)


def test_mix_on_odd_tables(spark):
    df = odd_docs(spark)
    out = entropy_mix.entropy_mix(df)
    assert out.count() == df.count() and set(df.columns) <= set(out.columns)
    assert entropy_mix.mixed(df).columns == df.columns
    named = df.withColumns({"mix_size": F.lit("keep"), "mix_n": F.lit("keep"), "in_0": F.lit("keep"), "doc_0": F.lit("keep")})
    kept = entropy_mix.entropy_mix(named)
    assert "_mix_copies" in kept.columns and {(r.mix_size, r.mix_n, r.in_0) for r in kept.collect()} == {("keep",) * 3}
    assert {(r.mix_size, r.mix_n, r.doc_0) for r in entropy_mix.mixed(named).collect()} == {("keep",) * 3}
    assert entropy_mix.entropy_mix(df.limit(0)).count() == 0


def test_pack_is_gapless_tight_and_true_to_the_tokenizer(spark):
    from tokenizers import Tokenizer

    rng = random.Random(5)
    words = ["the", "don't", "naïve", "ΣΑΣ", "x\x1cy", "12.5", "<|endoftext|>", "long" * 9, "漢字", "é"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 5, 40, 300]))) for _ in range(120)] + [None, ""]
    got = pack.pack_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), capacity=128).toPandas()
    tok = Tokenizer.from_file(pack.tokenizer_path())
    for k, g in got.groupby("doc_id"):
        ids = tok.encode(texts[k] or "", add_special_tokens=False).ids + [0]
        g = g.sort_values("piece")
        assert list(g["start"]) == list(range(0, len(ids), 128)) and g["length"].sum() == len(ids)
        for r in g.itertuples():
            assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
    g = got.sort_values(["sequence_id", "offset"])
    assert (g.groupby("sequence_id")["length"].cumsum() - g["length"] == g["offset"]).all() and g.groupby("sequence_id")["length"].sum().max() <= 128
    assert g["sequence_id"].nunique() == best_fit(sorted(got["length"], reverse=True), 128)


def best_fit(lengths, capacity):
    gaps = []
    for n in lengths:
        fit = min((g for g in gaps if g >= n), default=None)
        if fit is None:
            gaps.append(capacity - n)
        else:
            gaps.remove(fit)
            gaps.append(fit - n)
    return len(gaps)


def test_plan_equals_best_fit_one_by_one():
    rng = random.Random(6)
    for _ in range(60):
        cap = rng.choice([10, 64, 100])
        counts = {n: rng.randrange(1, 30) for n in rng.sample(range(1, cap + 1), rng.randrange(1, 9))}
        runs, n = pack.plan(counts, cap)
        assert n == best_fit([x for x in sorted(counts, reverse=True) for _ in range(counts[x])], cap)


def test_pack_on_odd_tables(spark):
    df = odd_docs(spark)
    out = pack.pack_documents(df)
    assert out.groupBy("doc_id", "piece").count().where("count > 2").count() == 0
    assert out.select("doc_id").distinct().count() == df.select("doc_id").distinct().count()
    assert pack.pack_documents(df.limit(0)).count() == 0


def test_chat_recovers_roles_and_text(spark):
    rng = random.Random(7)
    rows = []
    for c in range(60):
        for t in range(rng.choice([2, 4, 6])):
            role = ("user", "assistant")[t % 2]
            rows.append((c, t, role, "What is it?" if role == "user" else "It is this.\nAnd that, at length, as assistants say it."))
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("k", F.lit("clash"))
    got = chat.parse(chat.as_transcript(turns), role="role").toPandas()
    truth = {(c, t): (r, x) for c, t, r, x in rows}
    heads = got[got["line"] == 0]
    assert np.mean([truth[(r.conv_id, r.turn)][0] == r.role for r in heads.itertuples()]) > 0.9
    exact = [truth[(r.conv_id, r.turn)][1] == r.content for r in got.itertuples() if r.line == 0]
    assert np.mean(exact) > 0.6 and got["rendered"].str.match(r"<\|\w+\|>\n").all()


def test_chat_across_parts_equals_one_viterbi(spark):
    rng = random.Random(8)
    rows = [(1, t, None, rng.choice(["User: hi?", "Assistant: well.", "so", "and then?", "### System: be good"])) for t in range(500)] + [(2, 0, None, "a"), (3, 1, None, None), (None, None, None, "Bot: x")]
    got = chat.parse(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).toPandas()
    big = got[got["conv_id"] == 1].sort_values("turn")
    lines = chat.lines_of(spark.createDataFrame(rows[:500], "conv_id long, turn long, role string, text string"), "conv_id", "turn", "text").orderBy("o").toPandas()
    states = chat.viterbi(lines["seen"].to_numpy(), chat.Model.untrained())
    begins = (states % 2 == 0) | np.r_[True, states[1:] // 2 != states[:-1] // 2]
    at = np.flatnonzero(begins)
    assert list(big["turn"]) == list(at) and list(big["role"]) == [chat.ROLES[states[i] // 2] for i in at]
    assert list(big["n_lines"]) == list(np.diff(np.r_[at, 500])) and len(got[got["conv_id"] != 1]) == 3
    assert chat.parse(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_chat_rows_at_one_place_stay_apart(spark):
    schema = "conv_id long, turn long, role string, text string"
    rows = [(1, 0, None, "User: a"), (1, 0, None, "Assistant: b"), (1, 0, None, "User: c"), (1, 0, None, "User: c"), (1, None, None, "System: first"), (2, 0, None, None), (2, 0, None, "")]
    got = [sorted(((r.conv_id, r.turn or 0, r.role, r.content, r.n_lines) for r in chat.parse(spark.createDataFrame(x, schema).withColumn("h", F.lit("clash")).repartition(n)).collect()), key=str) for x, n in ((rows, 1), (rows[::-1], 4))]
    assert got[0] == got[1]
    assert sorted(x[3] for x in got[0] if x[0] == 1) == ["a", "b", "c", "c", "first"] and len(got[0]) == 7
    long = [(1, t, None, ("User: " if t % 2 else "Assistant: ") + f"line {t}\n" * 200 + "x" * 20_000) for t in range(40)]
    out = chat.parse(spark.createDataFrame(long, schema).repartition(3)).orderBy("turn").collect()
    assert len(out) == 40 and all(r.n_lines == 201 and len(r.content) > 20_000 for r in out)


def test_chat_roles_of_held_out_conversations(spark, data):
    rich = data.replace("sf0.001", "sf0.01")
    got = queries()["op8_chat_format"](spark, rich).where("held_out and line = 0").toPandas()
    truth = spark.read.parquet(f"{rich}/conversations.parquet").toPandas().drop_duplicates(["conv_id", "turn"]).set_index(["conv_id", "turn"])["role"]
    right = [truth.get((r.conv_id, r.turn)) == r.role for r in got.itertuples()]
    assert len(right) > 50 and np.mean(right) > 0.9


def test_copies_of_images_are_found(spark):
    vec = spark.createDataFrame([(i, np.random.default_rng(i).standard_normal(16).tolist()) for i in range(60)], "vec_id long, embedding array<double>")
    images = media.rendered(vec)
    flat = spark.createDataFrame([(1001, 40, 40, bytes(1600)), (1002, 40, 40, bytes(1600)), (1003, None, None, None), (1004, 3, 3, bytes(9)), (1005, 5, 5, bytes(9)), (1001, 40, 40, bytes(1600)), (None, 2, 2, bytes(4))], "image_id long, width int, height int, pixels binary")
    got = media.copy_classes(images.unionByName(flat).withColumn("id", F.lit("clash"))).toPandas()
    of = dict(zip(got["image_id"], got["class_id"], strict=True))
    assert all(of[-1 - k] == of[k] for k in range(3, 60, 10))
    originals = [of[k] for k in range(60)]
    assert len(set(originals)) == 60
    assert of[1001] == of[1002] == 1001 and of[1003] == 1003 and of[1004] == 1004 and len(got) == 66 + 7
    assert media.copy_classes(flat.limit(0)).count() == 0


def test_turned_and_rescaled_copies_without_grain_are_found(spark):
    rows = []
    for i in range(24):
        rng = np.random.default_rng(i)
        a = np.full((64, 64), 128.0)
        for cx, cy, w, h, g in rng.random((40, 5)):
            a[int(cy * 64) : int(cy * 64 + 4 + h * 21), int(cx * 64) : int(cx * 64 + 4 + w * 21)] += (g - 0.5) * 180
        a = np.clip(a, 0, 255)
        y, x = np.mgrid[:64, :64] - 31.5
        c, s = np.cos(0.35), np.sin(0.35)
        y, x = (np.clip(v + 31.5, 0, 62.999) for v in (c * y - s * x, s * y + c * x))
        y0, x0 = y.astype(int), x.astype(int)
        fy, fx = y - y0, x - x0
        turned = a[y0, x0] * (1 - fy) * (1 - fx) + a[y0 + 1, x0] * fy * (1 - fx) + a[y0, x0 + 1] * (1 - fy) * fx + a[y0 + 1, x0 + 1] * fy * fx
        for k, b in ((i, a), (100 + i, turned), (200 + i, media._zoom(a, 0.85))):
            rows.append((k, b.shape[1], b.shape[0], b.astype(np.uint8).tobytes()))
    got = media.copy_classes(spark.createDataFrame(rows, "image_id long, width int, height int, pixels binary")).toPandas().set_index("image_id")["class_id"]
    assert len({got[i] for i in range(24)}) == 24
    assert sum(got[100 + i] == got[i] for i in range(24)) >= 22 and sum(got[200 + i] == got[i] for i in range(24)) >= 22


def test_descriptors_under_hot_keys_meet_as_in_one_group(spark):
    """Against all pairs: every descriptor with another image's within NEAR bits under its key is linked, whatever the parts of the key."""
    rng = np.random.default_rng(1)
    rows = []
    for c in range(40):  # clusters of near descriptors under one key
        base = rng.integers(-(1 << 62), 1 << 62, 4)
        base[0] &= (1 << 24) - 1  # the first 40 bits are the key
        for i in range(6):
            bits = base.copy()
            bits[1 + i % 3] ^= np.int64(1 << int(rng.integers(0, 60)))
            rows.append((int(100 * c + i), i, *map(int, bits)))
    corners = spark.createDataFrame(rows, "id long, c int, t0 long, t1 long, t2 long, t3 long")
    for chunk in (4096, 50, 16):
        got = media.matched(corners, 0, chunk).collect()
        assert all(r.id // 100 == r.pivot // 100 and r.id > r.pivot and r.both == (r.id % 100 << 32) + r.pivot % 100 for r in got)
        links = {(r.id, r.pivot) for r in got}
        linked = defaultdict(set)
        for a, b in links:
            linked[a].add(b)
            linked[b].add(a)
        for c in range(40):  # one component a cluster
            seen, todo = set(), [100 * c]
            while todo:
                x = todo.pop()
                if x not in seen:
                    seen.add(x)
                    todo += linked[x]
            assert len(seen) == 6, chunk


@pytest.mark.parametrize("at_once,most", [(media.AT_ONCE, media.MOST), (50, 20)])
def test_all_near_descriptors_match_each_with_each(at_once, most, monkeypatch):
    """Against all pairs, over all tables, whole and in parts of large images: no partner of a descriptor is left out."""
    monkeypatch.setattr(media, "AT_ONCE", at_once)
    monkeypatch.setattr(media, "MOST", most)
    rng = np.random.default_rng(3)
    base = rng.integers(-(1 << 62), 1 << 62, (4, 4))
    words = base[rng.integers(0, 4, 120)]
    for row in words:
        for bit in rng.choice(256, rng.integers(0, 25), replace=False):
            row[bit // 64] ^= np.int64(-(1 << 63) if bit % 64 == 0 else 1 << (63 - bit % 64))
    corners = media.Corners(np.arange(12), np.full(12, 10), np.column_stack([np.zeros(120, np.int64), words]))
    got = sorted((int(i), int(j)) for x in media.near(corners, corners, [corners.table(t) for t in range(media.TABLES)]) for i, j in zip(*x, strict=True))
    bits = np.unpackbits(words.astype(">i8").view(np.uint8).reshape(120, 32), axis=1)
    keys = bits[:, : media.TABLES * media.KEY_BITS].reshape(120, media.TABLES, media.KEY_BITS)
    want = [(i, j) for i in range(120) for j in range(120) if (bits[i] != bits[j]).sum() <= media.NEAR and (keys[i] == keys[j]).all(1).any()]
    assert got == want and len(want) > 1000


@pytest.mark.parametrize("at_once,most", [(media.AT_ONCE, media.MOST), (3000, 2500)])
def test_only_matches_that_may_agree_are_compared_and_none_that_agree_is_lost(at_once, most, monkeypatch):
    """Corners that all look alike, in one turn and scale: against all pairs, cell by cell, from either side; what lies in no crowded cell goes before bits are compared."""
    monkeypatch.setattr(media, "AT_ONCE", at_once)
    monkeypatch.setattr(media, "MOST", most)
    monkeypatch.setattr(media, "SHIFT", 8.0)  # all shifts are exact
    rng = np.random.default_rng(4)
    n, ids = 40, rng.permutation(60) * 7
    place = rng.integers(8, 800, (60, n, 2)).astype(float)
    for k in range(0, 20, 2):  # copies: 6 corners of the one before, shifted, and one of them far off in its bits
        place[k + 1, :6] = place[k, :6] + rng.integers(-8, 8, 2) + rng.uniform(-1, 1, (6, 2))
    words = np.tile(rng.integers(-(1 << 62), 1 << 62, 4), (60 * n, 1))
    for t in range(1, media.TABLES):  # near each other, but under an equal key in one table only
        for bit in media.KEY_BITS * t + np.argsort(rng.random((60 * n, media.KEY_BITS)), axis=1)[:, :2].T:
            words[np.arange(60 * n), bit // 64] ^= (np.uint64(1) << (63 - bit % 64).astype(np.uint64)).view(np.int64)
    words[n : 20 * n : 2 * n, 1:] = rng.integers(-(1 << 62), 1 << 62, (10, 3))
    x, y = place.reshape(-1, 2).T
    numbers = np.column_stack([media.packed(x, y, 0, np.full(60 * n, -np.pi)), words])
    whole = media.Corners(ids, np.full(60, n), numbers)
    by_id = np.argsort(ids)
    rows = (by_id[:, None] * n + np.arange(n)).ravel()
    a, b = whole.some(slice(0, 12)), media.Corners(ids[by_id], np.full(60, n), numbers[rows])
    tables, got, left = [b.table(t) for t in range(media.TABLES)], set(), 0
    for side in (1, -1):
        for i, j, shift in media.near(a, b, tables, side=side):
            left += len(i)
            assert ((a.ids[a.image[i]] > b.ids[b.image[j]]) == (side > 0)).all() and (a.ids[a.image[i]] != b.ids[b.image[j]]).all()
            first, m, second, o = (a, i, b, j) if side > 0 else (b, j, a, i)
            got |= {(int(first.ids[q]), int(second.ids[r])) for q, r, *_ in media.agreeing(first, m, second, o, shift)}
    bits, spots, want = words.view(np.uint64).reshape(60, n, 4), np.rint(place * 8) / 8, set()
    for p in range(12):
        for q in range(60):
            if ids[p] == ids[q]:
                continue
            one, two = (p, q) if ids[p] > ids[q] else (q, p)
            alike = np.bitwise_count(bits[one][:, None] ^ bits[two]).sum(2) <= media.NEAR
            off = (spots[one][:, None] - spots[two])[alike] / media.SHIFT
            at = np.rint(spots[one]).astype(int).repeat(n, 0).reshape(n, n, 2)[alike]
            for half in (0.0, 0.5):
                cells = defaultdict(set)
                for c, w in zip(np.floor(off + half).astype(int), at, strict=True):
                    cells[tuple(c)].add(tuple(w))
                if max(map(len, cells.values())) >= media.AGREE:
                    want.add((int(ids[one]), int(ids[two])))
    assert got == want and sum((max(x), min(x)) in want for x in ids[:12].reshape(-1, 2).tolist()) == 6
    assert left < 0.1 * 12 * 59 * n * n


def test_descriptors_with_several_near_ones_match_all_of_them(spark):
    base = np.random.default_rng(5).integers(-(1 << 62), 1 << 62, 4)
    corners = spark.createDataFrame([(i, 0, int(base[0]), int(base[1]), int(base[2]), int(base[3]) ^ (1 << i)) for i in range(8)], "id long, c int, t0 long, t1 long, t2 long, t3 long")
    for chunk in (4096, 3):
        assert sorted((r.id, r.pivot) for r in media.matched(corners, 0, chunk).collect()) == [(i, j) for i in range(8) for j in range(i)]


def test_copies_in_blocks_equal_those_in_one(spark, monkeypatch):
    vec = spark.createDataFrame([(i, np.random.default_rng(i).standard_normal(16).tolist()) for i in range(40)], "vec_id long, embedding array<double>")
    images = media.materialise(media.rendered(vec))
    got = []
    for chunk in (media.CHUNK, 12):
        monkeypatch.setattr(media, "CHUNK", chunk)
        got.append(sorted(map(tuple, media.copy_classes(images).collect())))
    assert got[0] == got[1] and sum(c != k for k, _, c in got[0]) == 4


def test_agreeing_corners_of_different_images_are_no_copy():
    """Corners may agree by chance; the pixels then don't."""
    rng = np.random.default_rng(2)
    a, b = (media._box(media._box(rng.uniform(0, 255, (64, 64)), 2), 1) for _ in range(2))
    at = np.array([12 + 9j, 40 + 15j, 20 + 44j, 50 + 50j, 33 + 30j])
    assert not media.alike(a, b, at, at)
    painted = a * 0.7 + 30
    painted[20:36, 20:36] = 250
    assert media.alike(a, painted, at, at) and media.alike(a, a[5:, 3:], at, at - 3 - 5j) and media.alike(np.rot90(a), a, 1j * (63 - at.real) + at.imag, at)


def test_copies_with_repeated_keys_are_one_image(spark):
    rng = np.random.default_rng(0)
    a, b = (rng.integers(0, 256, 64 * 64).astype(np.uint8).tobytes() for _ in range(2))
    rows = [(1, 64, 64, a), (1, 64, 64, b), (1, 64, 64, a), (2, 64, 64, a), (3, 64, 64, b)]
    schema = "image_id long, width int, height int, pixels binary"
    got = [sorted(map(tuple, media.copy_classes(spark.createDataFrame(r, schema)).collect())) for r in (rows, rows[::-1])]
    assert got[0] == got[1] and len(got[0]) == 5
    assert sorted(k for k, _, c in got[0] if c == 1) in ([1, 1, 1, 2], [1, 1, 1, 3])


def test_drawn_copies_are_of_all_kinds(spark):
    vec = spark.createDataFrame([(i, np.random.default_rng(i).standard_normal(16).tolist()) for i in range(60)], "vec_id long, embedding array<double>")
    got = {r.image_id: r for r in media.rendered(vec).collect()}
    assert len({got[-4 - 10 * i].pixels for i in range(6)}) == 6 and [got[-4 - 10 * i].width == 64 for i in range(6)] == [False, True, False, True, True, True]
    levels = [len(set(got[i].pixels)) for i in range(60)]
    assert min(levels) < 120 < max(levels)  # with and without grain


def test_larger_images_have_more_corners():
    a = np.random.default_rng(0).integers(0, 256, (256, 256)).astype(np.uint8)
    assert len(media.Describer()(a)) > 8 * len(media.Describer()(a[:64, :64])) > 0


def test_language_model_prefers_corpus_over_noise(spark, data):
    """With the query's own settings: texts of the corpus score above texts with every other word replaced by a word drawn evenly, and above a unigram model."""
    from lintlake.llm.common import table

    docs = table(spark, data.replace("sf0.001", "sf0.01"), "documents").where("lang = 'en'").select("doc_id", "text")
    rng = random.Random(9)
    some = docs.limit(60).collect()
    words = sorted({w for r in some for w in (r.text or "").split()})
    noisy = [(10_000_000 + r.doc_id, " ".join(w if i % 2 else rng.choice(words) for i, w in enumerate((r.text or "").split()))) for r in some]
    model = lm_score.pseudo_likelihood(docs.unionByName(spark.createDataFrame(noisy, "doc_id long, text string"))).toPandas().set_index("doc_id")
    a = model.loc[[k - 10_000_000 for k, _ in noisy], "mean_log_likelihood"].to_numpy()
    b = model.loc[[k for k, _ in noisy], "mean_log_likelihood"].to_numpy()
    assert np.nanmean(a > b) > 0.9
    count = defaultdict(int)
    for r in docs.collect():
        for w in (r.text or "").lower().split():
            count[w] += 1
    total = sum(count.values())
    unigram = sum(n * np.log(n / total) for n in count.values()) / total
    real = model[model.index < 10_000_000]
    assert real["log_likelihood"].sum() / real["n_tokens"].sum() > unigram


def test_language_model_does_not_depend_on_partitions(spark):
    rng = random.Random(3)
    docs = spark.createDataFrame([(i, " ".join(rng.choice("abcdefghij") * rng.randrange(1, 4) for _ in range(rng.randrange(80)))) for i in range(200)], "doc_id long, text string")
    words = [lm_score.hashed(d.select(F.col("doc_id").alias("k"), F.col("text").alias("t"))) for d in (docs.coalesce(1), docs.repartition(5, "doc_id"))]
    got = []
    for w in words:
        vocab, total = lm_score.vocabulary(w)
        got.append(lm_score.flat(lm_score.fit(w, vocab, total, shard=2000, piece=30)))
    assert np.abs(got[0] - got[1]).max() < 1e-6


def small_vocabulary(texts):
    words = [lm_score.word_hashes(t, {}) for t in texts]
    h, n = np.unique(np.concatenate(words), return_counts=True)
    order = np.lexsort((h, -n))
    top, rest = order[:2], order[2:]
    cells = np.unique(h[rest] % lm_score.CELLS, return_inverse=True)
    return lm_score.Vocabulary(h[top].astype(np.uint32), n[top].astype(float), [cells[0].astype(np.int64), np.bincount(cells[1], n[rest]).astype(np.int64), np.bincount(cells[1])]), words


def test_language_model_matches_direct_sum():
    vocab, words = small_vocabulary(["a b c a b a", "", "rare a a b"])
    p = lm_score.initial(vocab.counts)
    tokens = [vocab.tokens(w) for w in words]
    whole, at, text = lm_score.padded(tokens)
    got = np.bincount(text, lm_score.log_probabilities(p, whole, at) + vocab.shares(np.concatenate(words), whole[at]), minlength=3)
    soft = lambda z: z - np.log(np.exp(z).sum())
    want = []
    for w, x in zip(words, tokens, strict=True):
        total, full = 0.0, [0, 0, *x, 0, 0]
        for i in range(len(x)):
            near = [full[i], full[i + 1], full[i + 3], full[i + 4]]
            h = np.tanh(np.concatenate([p["embed"][c] for c in near]) @ p["into"] + p["bias"])
            g, m = divmod(int(x[i]) - 1, lm_score.MEMBERS)
            total += soft((h @ p["group"] + p["group_rest"]).astype(float))[g] + soft((h @ p["member"][g] + p["member_rest"][g]).astype(float))[m]
            total += float(vocab.share[w[i] % lm_score.CELLS]) if x[i] > lm_score.TOKENS - lm_score.BUCKETS else 0.0
        want.append(total)
    assert np.allclose(got, want, atol=1e-3)
    assert list(tokens[0][:2]) == [1, 2] and tokens[2][0] > lm_score.TOKENS - lm_score.BUCKETS  # a and b have tokens of their own
    assert abs(np.exp(vocab.share[crc32_of("c") % lm_score.CELLS]) - (1 if tokens[0][2] != tokens[2][0] else 0.5)) < 1e-6


def crc32_of(word):
    return zlib.crc32(word.encode())


def test_language_model_gradient_is_the_slope_of_the_loss():
    vocab, words = small_vocabulary(["a b c a b a d e f", "rare a a b"])
    p = lm_score.initial(vocab.counts)
    whole, at, _ = lm_score.padded([vocab.tokens(w) for w in words])
    g = lm_score.gradient(p, whole, at)
    loss = lambda: -lm_score.log_probabilities(p, whole, at).mean()
    rng = np.random.default_rng(0)
    for k in p:
        where = np.argwhere(np.abs(g[k]) > 0.01)
        for i in map(tuple, where[rng.permutation(len(where))[:3]]):
            before = p[k][i]
            p[k][i] = before + 0.01
            up = loss()
            p[k][i] = before - 0.01
            down = loss()
            p[k][i] = before
            assert abs((up - down) / 0.02 - g[k][i]) < 0.02 * abs(g[k][i]) + 2e-3, (k, i)


def test_language_model_exponentials_take_the_logits_place():
    z = np.array([[0, 1, -200], [300, 2, 3]], np.float32)
    want = np.exp(np.clip(z, -80, 80))
    total = lm_score.exponentials(z)
    assert np.allclose(z, want) and np.allclose(total, want.sum(1)) and np.isfinite(total).all()


def test_language_model_deals_every_position_once(spark):
    texts = ["a b c d e f g", "", "a a", None, "a b c d e f g"]
    docs = spark.createDataFrame(list(enumerate(texts)), "k long, t string")
    words = lm_score.hashed(docs)
    vocab, total = lm_score.vocabulary(words)
    assert total == 16
    pieces = lm_score.dealt(words, spark.sparkContext.broadcast(vocab), 3, 3).collect()
    seen = [np.frombuffer(r.ids, "<u2") for r in pieces]
    assert sum(len(x) - 2 * lm_score.SIDE for x in seen) == 16 and {r.shard for r in pieces} <= {0, 1, 2}
    whole = vocab.tokens(lm_score.word_hashes(texts[0], {}))
    assert any(list(x) == [*whole[1:], 0] for x in seen)  # a middle piece has the tokens around it


def test_language_model_on_odd_tables(spark):
    df = odd_docs(spark)
    got = lm_score.pseudo_likelihood(df).toPandas()
    assert len(got) == df.count() and (got.loc[got["n_tokens"] == 0, "log_likelihood"] == 0).all() and (got["log_likelihood"] <= 0).all()
    assert lm_score.pseudo_likelihood(df.limit(0)).count() == 0


def test_every_operator_has_a_query():
    assert sorted(int(re.match(r"op(\d+)_", q)[1]) for q in queries()) == list(range(1, 11))


def test_pipeline_stages_keep_columns_and_take_effect(spark, data):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    from lintlake.llm.common import materialise, table

    docs = table(spark, data, "documents")
    names, before = docs.columns, docs.count()
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = materialise(stage(spark, docs, data), name)
        if i < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == names
        if name == "ngram_jaccard_join":
            rows = brute_classes([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
            assert sorted(r.doc_id for r in out.collect()) == sorted({k for k, n, c, _ in rows if c == k or not n})
        docs = out
    assert 0 < docs.select("doc_id").distinct().count() < before


def test_pipeline_stages_on_odd_tables(spark, data):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    from lintlake.llm.common import materialise

    df = odd_docs(spark).unionByName(spark.createDataFrame([(1, "quite another text under the same id as before", "en", "s1", 1)], DOCS), allowMissingColumns=True)
    df = df.withColumns({c: F.lit("keep") for c in ("toxicity", "quality", "row", "mix_size", "mix_n")})
    rows = df.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = materialise(stage(spark, df, data), name)
        assert out.columns == df.columns and stage(spark, df.limit(0), data).count() == 0
        assert {r.row for r in out.select("row").collect()} <= {"keep"} and out.count() <= 2 * rows
        if name == "ngram_jaccard_join":
            got = sorted((r.doc_id or 0, (r.text or "")[:20]) for r in out.collect())
            # of three equal rows and of the two long texts one stays; all others stay, the other text under id 1 as well
            assert got == sorted([(1, "a b c d e f"), (1, "quite another text u"), (2, ""), (3, ""), (4, " \t\n "), (5, "w0x0 w1x1 w2x2 w3x3 "), (7, "one two")])
    packed = corpus_pipeline.STAGES[-1][1](spark, df, data)
    assert packed.select("doc_id").distinct().count() == df.select("doc_id").distinct().count()
