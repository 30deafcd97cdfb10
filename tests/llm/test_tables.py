"""Mixing, url filters, the pipeline, and the registered queries against SQL on the smallest tables."""

import glob
import os

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from brindle.llm import mixing as MX
from brindle.llm import repeated_spans as RS
from brindle.llm import url_filters as U
from brindle.llm.registry import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def brute_fill(caps, weights, budget):
    """Water-filling by rounds: who can't take its share is full, the rest share again."""
    full, left, open_ = {}, budget, dict(weights)
    while open_:
        total = sum(open_.values())
        over = [k for k in open_ if caps[k] * total <= left * open_[k]]
        if not over:
            return full | {k: left * w // total for k, w in open_.items()}
        for k in over:
            full[k] = caps[k]
        left -= sum(caps[k] for k in over)
        for k in over:
            del open_[k]
    return full


@pytest.mark.parametrize("budget", [0, 10, 57, 100, 1000])
def test_fill(spark, budget):
    caps, weights = {"a": 50, "b": 9, "c": 20, "d": 5}, {"a": 5, "b": 3, "c": 2, "d": 1}
    rows = [(0, k, weights[k], caps[k], budget) for k in caps]
    df = spark.createDataFrame(rows, "p int, n string, w int, cap long, budget long").select("p", "n", F.col("w").cast("decimal(6,0)").alias("w"), F.col("cap").cast("decimal(20,0)").alias("cap"), F.col("budget").cast("decimal(20,0)").alias("budget"))
    assert {r.n: int(r.allot) for r in MX.fill(df, ["p"], "n").collect()} == brute_fill(caps, weights, budget)


def test_mix_edge_cases(spark):
    rows = [(i, "w " * (i % 7), ["en", "de", None][i % 3], ["src0", "src1", None, "odd"][i % 4], "keep") for i in range(60)] + [(99, None, "en", "src0", "keep"), (3, "w w w", "en", "odd", "keep")]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, tokens string")
    found, leaves = MX.mix(d)
    assert found.count() == len(rows)
    by_leaf = {(r.domain, r.lang, r.source): r for r in found.groupBy("domain", "lang", "source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("took"), F.max("n_tokens").alias("most")).collect()}
    for r in leaves.collect():
        took = by_leaf[tuple(r[n] for n in MX.NODES)]
        assert took.took <= r.allot < took.took + max(1, took.most) + 1
    chosen = MX.select(d)
    taken = [r.doc_id for r in chosen.collect()]
    assert chosen.columns == d.columns and len(taken) == sum(r.copies for r in found.collect() if r.doc_id != 3) + taken.count(3)
    assert MX.mix(d.limit(0))[0].count() == 0


def test_mix_keeps_the_documents_of_zero_weights(spark):
    rows = [(i, "w " * 5, ["en", "de"][i % 2], f"src{i % 6}") for i in range(120)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    for weights in ({"domain": {"web": 0, "books": 3}, "source": {"src1": 0}}, {"domain": {"web": 0, "books": 0, "forum": 0}}):
        found, leaves = MX.mix(d, MX.MixConfig(weights=weights))
        got = found.collect()
        assert sorted(r.doc_id for r in got) == list(range(120)) and leaves.count() == 6
        none = [r for r in got if weights["domain"].get(r.domain) == 0 or weights.get("source", {}).get(r.source) == 0]
        assert none and all(r.copies == 0 for r in none)


def test_pipeline_mix_on_a_hot_source(spark):
    """Forum brings half of all tokens: the shares that the README states, and no row twice."""
    import corpus_pipeline as P

    rows = [(i, "w " * 10, "en", ["src0", "src2", "src1", "src2"][i % 4]) for i in range(4800)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    took = P.mix_sources(spark, d, DATA)
    n = {r.source: r["count"] for r in took.groupBy("source").count().collect()}
    assert took.select("doc_id").distinct().count() == took.count() == sum(n.values()) == 4320
    assert {k: round(100 * v / 4320) for k, v in n.items()} == {"src0": 28, "src1": 28, "src2": 44}


def test_url_filters(spark):
    urls = ["http://a.com/x", "https://EXAMPLE.com/en/1", "http://www.example.com/en/2#f", "ftp://q.net/es/", "http://z.org/p?ref=1", "https://www.z.org/p/", None, "no scheme", "http://m.b.net/fr/1?utm_source=q", "x://n.net/de/1", "http://r.org/1", "http://s.org/2", "://", "http://t.org"]
    html = {10: '<link href="http://q.net/es/" rel=canonical>', 11: "<META http-equiv='refresh' content='0; url=/3'>", 13: '<link rel="canonical" href="//a.com/x">'}
    df = spark.createDataFrame([(i, u, html.get(i, "<p>"), "c") for i, u in enumerate(urls)], "page_id long, url string, html string, host string")
    links = spark.createDataFrame([("http://s.org/3", "http://z.org/p"), ("http://z.org/p", "http://q.net/fr/9")], "url string, target string")
    got = {r.page_id: r for r in U.judge(df, links=links).collect()}
    want = {0: ("com/", "allow"), 1: ("example.com/en/", "block"), 2: ("www.example.com/en/", "allow"), 3: ("net/es/", "block"), 8: ("net/fr/", "block"), 6: (None, "allow"), 7: (None, "allow"), 12: (None, "allow"), 9: (None, "allow"), 10: (None, "block"), 13: (None, "allow"), 4: (None, "allow")}
    assert {k: (got[k].rule, got[k].verdict) for k in want} == want
    assert got[1].host == "example.com" and got[2].path == "/en/2" and (got[6].host, got[6].path) == ("", "")
    assert got[4].alias_class == got[5].alias_class == got[11].alias_class and got[6].alias_class is None
    assert U.judge(df.limit(0)).count() == 0
    assert U.judge(df.unionByName(df)).count() == 2 * len(urls)
    long = spark.createDataFrame([(1, "http://a.com/" + "x" * 300_000), (2, "http://" + "a." * 50_000 + "net/fr/")], "page_id long, url string").withColumn("html", F.lit(None).cast("string"))
    assert {r.page_id: r.verdict for r in U.judge(long).collect()} == {1: "allow", 2: "block"}
    assert {r.page_id: r.verdict for r in U.judge(long, spark.createDataFrame([(r.verdict, r.host, r.path) for r in U.RULES], "verdict string, host string, path string")).collect()} == {1: "allow", 2: "block"}


def test_url_rules_by_join(spark):
    """Any number of rules, from a table: as the expression where it can hold them, and by brute force."""
    import random

    rng = random.Random(5)
    hosts = ["com", "a.com", "b.a.com", "net", "x.net", "org", "co.uk", ""]
    paths = ["/", "/a", "/a/", "/a/b", "/é", ""]
    rules = tuple({(v, h, p): U.Rule(v, h, p) for v in ("allow", "block") for h in rng.sample(hosts, 6) for p in rng.sample(paths, 4)}.values())
    many = rules + tuple(U.Rule("block", f"h{i}.example", f"/p{i % 50}") for i in range(100_000))
    urls = [f"s://{sub}{h}{p}{rest}" for sub in ("", "z.", "q.z.") for h in [*hosts, "acom", "h7.example", "h99999.example"] for p in [*paths, "/p7", "/p49"] for rest in ("", "b/c", "?q")]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string").withColumn("html", F.lit(""))

    def want(url, rules):
        at = url.split("://")[1]
        host = at.split("/")[0].split("?")[0]
        path = at[len(host) :].split("?")[0]
        fit = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        best = max(fit, key=lambda r: (len(r.name), r.verdict == "allow", r.name), default=None)
        return best and (best.name, best.verdict)

    got = {r.page_id: (r.rule, r.verdict) for r in U.judge(df, rules).where("rule is not null").collect()}
    assert got == {i: w for i, u in enumerate(urls) if (w := want(u, rules))}
    table = spark.createDataFrame([(r.verdict, r.host, r.path) for r in rules], "verdict string, host string, path string")
    assert {r.page_id: (r.rule, r.verdict) for r in U.judge(df, table).where("rule is not null").collect()} == got
    few = {r.name: r for r in many if r.host in ("h7.example", "h99999.example")}
    got = {r.page_id: (r.rule, r.verdict) for r in U.judge(df, many).where("rule is not null").collect()}
    assert got == {i: w for i, u in enumerate(urls) if (w := want(u, (*rules, *few.values())))}


def test_url_decisions_spread_over_chains(spark):
    """A block goes along aliases, redirects and canonical links of any length; an allow anywhere in the class wins."""
    urls = [f"http://www.c{k}.org/{i}/?utm_a=1" for k in range(2) for i in range(30)] + ["http://x.net/fr/1", "http://y.net/fr/2", "http://ok.com/", "http://alone.org/"]
    df = spark.createDataFrame([(i, u, "") for i, u in enumerate(urls)], "page_id long, url string, html string")
    hops = [(f"http://c{k}.org/{i}", f"https://m.c{k}.org/{i + 1}#f") for k in range(2) for i in range(29)]
    links = spark.createDataFrame([*hops, ("http://c0.org/29", urls[60]), ("http://c1.org/7.html", urls[61]), (urls[62], "ftp://c1.org/20")], "url string, target string")
    got = {r.page_id: (r.verdict, r.alias_class) for r in U.judge(df, links=links).collect()}
    assert [got[i][0] for i in range(60)] == ["block"] * 30 + ["allow"] * 30 and got[63][0] == "allow"
    assert len({got[i][1] for i in range(30)}) == len({got[i][1] for i in range(30, 60)}) == 1


@needs_tables
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    df, want = QUERIES[name](spark, DATA), con.sql(ORACLES[name])
    cols = sorted(df.columns)
    assert sorted(want.columns) == cols
    at = [want.columns.index(c) for c in cols]
    assert sorted(tuple(map(str, r)) for r in df.select(*cols).collect()) == sorted(tuple(str(r[i]) for i in at) for r in want.fetchall())


@needs_tables
def test_substring_dedup_table(spark):
    rows = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in QUERIES["op2_substring_dedup"](spark, DATA).collect()}
    assert got == {r.doc_id: x for r, x in zip(rows, RS.brute_force([r.text for r in rows]), strict=True)}


def brute_pipeline(docs, model):
    """Ids that each stage keeps, in plain Python: scores, texts, fingerprints and budgets one by one."""
    import hashlib
    import re

    import numpy as np
    from test_text_operators import brute_fingerprint

    import corpus_pipeline as P
    from brindle.llm import toxicity as TX

    docs = {i: (t or "", lang or "", source or "") for i, t, lang, source in docs}
    kept = {i: d for i, d in docs.items() if TX._Scorer(model).document(d[0])[0] < 0.5}
    yield set(kept)
    first = {}
    for i in sorted(kept):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", kept[i][0]), i)
    kept = {i: kept[i] for i in first.values()}
    yield set(kept)
    ids = sorted(kept)
    fps = np.array([brute_fingerprint(kept[i][0]) for i in ids], np.uint64)
    up = list(range(len(ids)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in np.argwhere(np.bitwise_count(fps[:, None] ^ fps) <= 3):
        x, y = find(a), find(b)
        up[max(x, y)] = min(x, y)
    kept = {i: kept[i] for k, i in enumerate(ids) if find(k) == k}
    yield set(kept)
    leaves: dict = {}
    for i, (t, lang, source) in kept.items():
        n = re.search(r"(\d+)$", source)
        domain = ("web", "books", "forum")[int(n[1]) % 3] if n else "web"
        leaves.setdefault((domain, lang, source), []).append((i, len(re.findall(r"[^\x20\x09-\x0D]+", t))))
    tokens = {leaf: sum(n for _, n in rows) for leaf, rows in leaves.items()}
    budgets = {(): sum(tokens.values()) * P.MIX.share[0] // P.MIX.share[1]}
    for level, name in enumerate(("domain", "lang", "source")):
        below = {}
        for leaf, n in tokens.items():
            below[leaf[: level + 1]] = below.get(leaf[: level + 1], 0) + n * P.MIX.max_epochs
        weights = P.MIX.weights[name]
        budgets |= {k: v for p in {k[:level] for k in below} for k, v in brute_fill({k: c for k, c in below.items() if k[:level] == p}, {k: weights.get(k[level], 1) for k in below if k[:level] == p}, budgets[p]).items()}
    out = set()
    for leaf, rows in leaves.items():
        epochs, rest = divmod(budgets[leaf], tokens[leaf]) if tokens[leaf] else (0, 0)
        if epochs:
            out |= {i for i, _ in rows}
        upto = 0
        for i, n in sorted(rows, key=lambda r: (hashlib.md5(f"{P.MIX.seed}:{epochs}:{r[0]}".encode()).hexdigest(), r[0])):
            upto += n
            if upto <= rest:
                out.add(i)
    yield out


@needs_tables
def test_pipeline(spark):
    """Each stage against brute force on what it gets; the packed pieces against the packing contract."""
    from test_text_operators import check_packing

    import corpus_pipeline as P
    from brindle.llm import toxicity as TX

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns = docs.columns
    rows = docs.select("doc_id", "text", "lang", "source").collect()
    model = TX.fit(docs, spark.read.parquet(f"{DATA}/labels.parquet"))
    for (name, stage), want in zip(P.STAGES[:-1], brute_pipeline(rows, model), strict=True):
        docs = P.materialise(stage(spark, docs, DATA), f"test-{name}")
        assert docs.columns == columns and {r.doc_id for r in docs.select("doc_id").collect()} == want, name
        assert docs.count() == len(want) > 0
    pieces = P.STAGES[-1][1](spark, docs, DATA).collect()
    ids = sorted(want)
    texts = {r.doc_id: r.text for r in rows}
    check_packing(spark, [texts[i] for i in ids], [Row(**(r.asDict() | {"doc_id": ids.index(r.doc_id)})) for r in pieces])


def test_pipeline_edge_cases(spark, tmp_path):
    """Nulls in any column, empty and very long texts, repeated rows, columns with clashing names, an empty table."""
    import corpus_pipeline as P

    long = " ".join(f"word{i}" for i in range(30_000))
    rows = [(1, None, None, None), (None, "a b c", "en", "src1"), (2, "", "", ""), (3, long, "en", "src0"), (3, long, "en", "src0"), (4, "one two", None, "src2"), (4, "other text of four words", "de", None), (5, "one  two", "en", "src5")]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    d = d.withColumns({k: F.lit(1) for k in ("fp", "digest", "tokens", "file", "at", "component_id", "copies", "keep_id")})
    labels = f"{tmp_path}/labels.parquet"
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(labels)
    for docs in (d, d.limit(0)):
        docs.write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
        now = docs
        for _, stage in P.STAGES[:-1]:
            now = P.materialise(stage(spark, now, str(tmp_path)), "edge")
            assert now.columns == d.columns
        pieces = P.STAGES[-1][1](spark, now, str(tmp_path))
        assert pieces.count() >= now.count() and (now.count() == 0) == (docs.count() == 0)
    assert P.run(spark, str(tmp_path)).count() == 0
