"""Operators on texts: brute force, round trips and edge cases on small tables."""

import hashlib
import html
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from brindle.llm import components as CC
from brindle.llm import exact_dedup as X
from brindle.llm import html_blocks as H
from brindle.llm import line_quality as Q
from brindle.llm import mpeg_audio as M
from brindle.llm import packing as PK
from brindle.llm import repeated_spans as RS
from brindle.llm import simhash as SH
from brindle.llm import toxicity as TX
from brindle.llm.tokens import Encoder

SMALL = settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def docs(spark, texts, **extra):
    """Documents with ids from 0, and columns whose names clash with those that operators make."""
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    more = {"lang": "en", "source": "src0", "n_chars": 1, "score": 0.5, "digest": "x", "fp": 3, "m": 1, "tokens": 2} | extra
    return df.withColumns({k: F.lit(v) for k, v in more.items()})


def run(n, *words):
    return " ".join(f"w{i}" for i in range(n)) + (" " + " ".join(words) if words else "")


EDGE = [None, "", " \n\t ", "a", "a", "  a ", run(40), run(40), run(40, "tail"), run(35), "x y " * 100, "é\u00a0ß " + run(36), "long " * 30000]


def spans_match(spark, rows, window=RS.WINDOW, **how):
    """Results of rows (doc_id, text) against brute force, row by row."""
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"row": F.lit(1), "start": F.lit(2), "n": F.lit("x")})
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.kept.encode()).hexdigest()) for r in RS.without_repeats(d, window, **how).collect())
    assert got == sorted((-1 if i is None else i, *x) for (i, _), x in zip(rows, RS.brute_force([t for _, t in rows], window), strict=True))


def test_repeated_spans_edge_cases(spark):
    spans_match(spark, list(enumerate(EDGE)))
    assert RS.without_repeats(docs(spark, [])).count() == 0


def test_repeated_spans_of_rows_that_share_or_lack_an_id(spark):
    shared = " ".join(f"s{i}" for i in range(60))
    spans_match(spark, [(1, run(200) + " " + shared), (1, "only two"), (2, "head " + shared + " tail"), (None, shared), (None, "x " + shared), (None, None), (3, run(10, shared)), (3, run(10, shared)), (3, "other")])


def test_repeated_spans_thue_morse(spark):
    """Words in the order that makes polynomial hashes modulo powers of two collide."""
    tm = ["ab"[bin(i).count("1") % 2] for i in range(4096)]
    spans_match(spark, [(0, " ".join(tm[:2048])), (1, " ".join(tm[2048:])), (2, " ".join(tm[100:700])), (3, "c " + " ".join(tm[5:60]))])


@pytest.mark.parametrize("bits", [2])
def test_repeated_spans_survive_weak_hashes(spark, bits):
    """Hashes of a few bits collide; the words at the coordinates decide."""
    rng = np.random.default_rng(bits)
    part = [" ".join(f"v{x}" for x in rng.integers(0, 30, 50)) for _ in range(6)]
    texts = [" ".join(part[k] for k in rng.integers(0, 6, 3)) + " " + " ".join(f"u{x}" for x in rng.integers(0, 40, 60)) for _ in range(25)]
    spans_match(spark, list(enumerate(texts)), bits=bits)


@SMALL
@given(st.lists(st.lists(st.tuples(st.integers(0, 3), st.integers(1, 30), st.booleans()), max_size=5), min_size=1, max_size=6), st.sampled_from([3, 64]))
def test_repeated_spans_random(spark, plans, bits):
    texts = [" ".join(" ".join(f"{k}_{i % 7 if loop else i}" for i in range(n)) for k, n, loop in plan) for plan in plans]
    spans_match(spark, list(enumerate(texts)), 9, bits=bits)


def test_inner_steps_go(spark):
    import glob

    from brindle.llm import common

    at = common.shared_dir(spark).removeprefix("file://") + "/brindle"
    before = set(glob.glob(f"{at}/*"))
    out = RS.without_repeats(docs(spark, EDGE))
    left = {p.split("/")[-1].rsplit("-", 1)[0] for p in set(glob.glob(f"{at}/*")) - before}
    assert left == {"texts", "spans"} and out.count() == len(EDGE)
    common.release(spark)
    assert not {p for p in set(glob.glob(f"{at}/*")) - before}


def test_a_cluster_needs_a_shared_folder(spark):
    from types import SimpleNamespace

    from brindle.llm import common

    for master, conf in (("spark://h:1", {}), ("local-cluster[2,1,1024]", {}), ("yarn", {})):
        s = SimpleNamespace(conf=SimpleNamespace(get=conf.get), sparkContext=SimpleNamespace(master=master, getConf=lambda: {}))
        with pytest.raises(ValueError):
            common.shared_dir(s)
    s = SimpleNamespace(conf=SimpleNamespace(get={"spark.checkpoint.dir": "/tmp/checkpoints"}.get), sparkContext=SimpleNamespace(master="local[8]", getConf=lambda: {}))
    assert common.shared_dir(s) == "/tmp/checkpoints"


def brute_fingerprint(text):
    import xxhash

    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_edge_cases(spark):
    for t in [*EDGE[:-1], "A B", "Ä B c", "one two three"]:
        assert SH.fingerprint(t) == brute_fingerprint(t)
    got = {r.doc_id: r.component_id for r in SH.near_groups(docs(spark, EDGE)).collect()}
    assert len(got) == len(EDGE) and got[0] == got[1] == got[2] == 0 and got[3] == got[4] == got[5] == 3 and got[7] == 6
    assert SH.near_groups(docs(spark, [])).count() == 0
    kept = SH.keep_one(docs(spark, EDGE))
    assert kept.columns == docs(spark, []).columns and {r.doc_id for r in kept.collect()} == set(got.values())


def trees(fps, edges):
    up = {x: x for x in fps}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        up[find(a)] = find(b)
    out = {}
    for x in fps:
        out.setdefault(find(x), set()).add(x)
    return {frozenset(v) for v in out.values()}


def near_fingerprints(seed=1):
    rng = np.random.default_rng(seed)
    out = [int(x) for x in rng.integers(0, 2**63, 150, dtype=np.uint64)] + [0, 2**64 - 1]
    for x in list(out):
        for _ in range(5):
            y = x
            for b in rng.choice(64, rng.integers(1, 6), replace=False):
                y ^= 1 << int(b)
            out.append(y)
    return sorted(set(out))


@pytest.mark.parametrize("blocks", [10, 13, 16])
def test_simhash_links(spark, blocks):
    fps = near_fingerprints()
    a = np.array(fps, np.uint64)
    near = np.argwhere(np.bitwise_count(a[:, None] ^ a) <= 3)
    want = trees(fps, [(fps[i], fps[j]) for i, j in near])
    df = spark.createDataFrame([(x - 2**64 if x >= 2**63 else x,) for x in fps], "fp long")
    edges = [(r.a % 2**64, r.b % 2**64) for r in SH.links(df, len(fps), blocks=blocks).collect()]
    assert trees(fps, edges) == want
    held = SH._Anchor(a, 3)
    assert held.order is not None and trees(fps, [(int(x), int(y)) for x, y in held.links(a, False)]) == want


@pytest.mark.parametrize(("homes", "visitors"), [(1, 1), (3, 2), (1000, 5), (7, 1000)])
def test_simhash_split_anchors(spark, homes, visitors):
    """Anchors with more homes or visitors than a task may hold give the same trees."""
    rng = np.random.default_rng(9)
    dense = {int(rng.integers(0, 2**63))}
    for x in list(dense) * 60:
        y = x
        for b in rng.choice(12, rng.integers(0, 5), replace=False):
            y ^= 1 << int(b)
        dense.add(y)
    fps = sorted(dense | set(near_fingerprints()[:200]))
    a = np.array(fps, np.uint64)
    want = trees(fps, [(fps[i], fps[j]) for i, j in np.argwhere(np.bitwise_count(a[:, None] ^ a) <= 3)])
    df = spark.createDataFrame([(x - 2**64 if x >= 2**63 else x,) for x in fps], "fp long")
    edges = [(r.a % 2**64, r.b % 2**64) for r in SH.links(df, len(fps), most_homes=homes, most_visitors=visitors).collect()]
    assert trees(fps, edges) == want


def test_simhash_replication():
    """Copies of a random fingerprint, as the docstring states them."""
    fps = np.random.default_rng(0).integers(0, 2**63, 20000, dtype=np.uint64) * np.uint64(2)
    for blocks, copies in ((10, 60), (12, 107), (14, 175), (16, 240)):
        assert abs(len(SH.Covering(blocks).anchors(fps)[0]) / len(fps) - copies) < 0.05 * copies


def test_simhash_keeps_rows_by_place(spark):
    d = spark.createDataFrame([(1, run(50)), (2, run(50)), (2, "quite another text of some words"), (3, None), (3, run(50)), (0, "quite another text of some words")], "doc_id long, text string").withColumn("at", F.lit("x"))
    assert sorted(((r.doc_id, (r.text or "")[:5]) for r in SH.keep_one(d).collect())) == [(0, "quite"), (1, "w0 w1"), (3, "")]


def test_simhash_one_anchor_with_visitors():
    """Random visitors of one anchor: links of the visitors with its homes all hold, in both ways of comparing."""
    rng = np.random.default_rng(11)
    for n in (6, 40, 300):
        for _ in range(150 if n < 300 else 5):
            x = np.unique(np.array([sum(1 << int(b) for b in rng.choice(14, rng.integers(0, 7), replace=False)) for _ in range(2 * n)], np.uint64))
            rng.shuffle(x)
            homes, visitors = x[: len(x) // 2], x[len(x) // 2 :]
            held = SH._Anchor(homes, 3)
            edges = [*held.links(homes, False)] + [e for i in range(0, len(visitors), 7) for e in held.links(visitors[i : i + 7], True)]
            near = [(int(a), int(b)) for a in x for b in homes if np.bitwise_count(a ^ b) <= 3]
            every = [int(v) for v in x]
            assert trees(every, [(int(a), int(b)) for a, b in edges]) == trees(every, near)


def test_simhash_bridge_to_a_merged_tree():
    """Visitor A joins homes 0 and 2, then B joins homes 1 and 2: B's edge must reach the tree of home 0."""
    homes = np.array([0b11111, 0b11111 << 10, 0], np.uint64)
    visitors = np.array([0b11, 0b11 << 10], np.uint64)
    held = SH._Anchor(homes, 3)
    edges = [*held.links(homes, False), *held.links(visitors, True)]
    every = [int(x) for x in (*homes, *visitors)]
    assert trees(every, [(int(x), int(y)) for x, y in edges]) == {frozenset(every)}


def test_components(spark):
    pairs = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (200, None)] + [(300, 300 + i) for i in range(1, 30)]
    got = {}
    for r in CC.components(spark.createDataFrame(pairs, "a long, b long")).collect():
        got.setdefault(r.root, set()).add(r.node)
    assert sorted(map(sorted, got.values())) == [list(range(41)), [100, 101], list(range(300, 330))]
    assert CC.components(spark.createDataFrame([], "a string, b string")).count() == 0


def test_exact_dedup_edge_cases(spark):
    rows = {r.doc_id: r for r in X.groups(docs(spark, EDGE)).collect()}
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for t in EDGE]
    for i, t in enumerate(norm):
        same = [j for j, u in enumerate(norm) if u == t]
        assert (rows[i].keep_id, rows[i].group_size, rows[i].kept) == (same[0], len(same), i == same[0])
        assert rows[i].digest == hashlib.sha256(t.encode()).hexdigest()
    assert X.groups(docs(spark, [])).count() == 0
    kept = X.keep_first(docs(spark, EDGE))
    assert kept.columns == docs(spark, []).columns and sorted(r.doc_id for r in kept.collect()) == sorted({norm.index(t) for t in norm})


def test_exact_dedup_checks_full_bytes(spark):
    weak = lambda c: F.length(c).cast("string")  # noqa: E731  every text of one length collides
    got = {r.doc_id: (r.keep_id, r.group_size) for r in X.groups(docs(spark, ["ab", "cd", "ab", "xyz", "xyz"]), weak).collect()}
    assert got == {0: (0, 2), 1: (1, 1), 2: (0, 2), 3: (3, 2), 4: (3, 2)}


def test_exact_dedup_of_rows_that_share_an_id(spark):
    rows = [(1, "a"), (2, "a"), (2, "b"), (3, "b"), (3, "c"), (None, "c"), (None, "d"), (1, "a")]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("file", F.lit("x"))
    assert sorted((str(r.doc_id), r.text) for r in X.keep_first(d).collect()) == [("1", "a"), ("1", "a"), ("2", "b"), ("3", "c"), ("None", "c"), ("None", "d")]


def test_exact_dedup_hot_digests(spark):
    texts = [f"t{i}" if i % 3 else "the same   text" for i in range(6000)]
    got = {r.doc_id: (r.keep_id, r.group_size) for r in X.groups(docs(spark, texts)).collect()}
    assert all(got[i] == ((i, 1) if i % 3 else (0, 2000)) for i in range(6000))
    weak = lambda c: F.length(c).cast("string")
    got = {r.doc_id: (r.keep_id, r.group_size) for r in X.groups(docs(spark, texts), weak).collect()}
    assert all(got[i] == ((i, 1) if i % 3 else (0, 2000)) for i in range(6000))


def test_exact_dedup_runs_add_up(spark, tmp_path):
    """A second run reads new rows only, knows the first one's, and fetches their texts by locator."""
    state, got = f"{tmp_path}/state", []
    for k, rows in enumerate([[(5, "a"), (6, "b"), (7, "a")], [(8, "b"), (9, "c"), (4, "a"), (10, "c")], []]):
        path = f"{tmp_path}/in{k}"
        spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(path)
        d = spark.read.parquet(path)
        got.append(sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in X.groups(d, state=state).collect()))
    assert got == [[(5, 5, 2, True), (6, 6, 1, True), (7, 5, 2, False)], [(4, 4, 3, True), (8, 6, 2, False), (9, 9, 2, True), (10, 9, 2, False)], []]
    d = spark.createDataFrame([(20, "a"), (21, "d")], "doc_id long, text string")
    assert [r.doc_id for r in X.keep_first(d, state=state).collect()] == [21]
    weak = lambda c: F.length(c).cast("string")
    for rows, want in (([(1, "ab"), (2, "cd")], [(1, 1), (2, 1)]), ([(3, "ab"), (4, "ef")], [(3, 2), (4, 1)])):
        spark.createDataFrame(rows, "doc_id long, text string").write.mode("overwrite").parquet(f"{tmp_path}/w{rows[0][0]}")
        found = X.groups(spark.read.parquet(f"{tmp_path}/w{rows[0][0]}"), weak, state=f"{tmp_path}/weak").collect()
        assert sorted((r.doc_id, r.group_size) for r in found) == want


def test_exact_dedup_fetches_only_hits(spark, tmp_path):
    spark.createDataFrame([(i, f"text {i % 97 if i < 100 else i}") for i in range(500)], "doc_id long, text string").write.parquet(f"{tmp_path}/d")
    d = X.located(spark.read.parquet(f"{tmp_path}/d"), "x")
    marked = X.groups(d).join(d.select(F.col(X.FILE).alias("f"), F.col(X.AT).alias("a"), "text"), (F.col("file") == F.col("f")) & (F.col("at") == F.col("a")))
    assert marked.count() == 500 and marked.where(F.col("digest") != F.sha2(F.col("text").cast("binary"), 256)).count() == 0
    assert marked.where("group_size > 1").count() == 6


def check_packing(spark, texts, rows):
    encoder, pieces, sequences = Encoder(), {}, {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
    assert set(pieces) == set(range(len(texts)))
    for i, t in enumerate(texts):
        ids = np.append(encoder.whole.encode(t or "", add_special_tokens=False).ids, 1).astype("<u4")
        at = 0
        for r in sorted(pieces[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and zlib.crc32(ids[at : at + r.length].tobytes()) == r.ids_crc32
            at += r.length
        assert at == len(ids)
    for rs in sequences.values():
        at = 0
        for r in sorted(rs, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048 and {r.padded_to for r in rs} == {at if at & (at - 1) == 0 else 2048}


def test_packing(spark):
    texts = [*EDGE, "a <|endoftext|> b", *(run(n) for n in range(1, 120, 7))]
    check_packing(spark, texts, PK.pack(docs(spark, texts)).collect())
    assert PK.pack(docs(spark, [])).count() == 0
    rows = sorted(PK.pack(docs(spark, ["hello there"]), with_ids=True).collect(), key=lambda r: r.start)
    assert [i for r in rows for i in r.ids] == [*Encoder().ids("hello there").tolist(), 1]


def packed(lengths, **how):
    """(sequences, pieces of each document) of lengths packed in order, nothing lost."""
    p, seen = PK.HarmonicPacker(2048, **how), {}
    out = [x for i, n in enumerate(lengths) for x in p.add(i, n)]
    assert len(p.wait) <= p.waiting
    out += p.finish()
    for _, padded, held in out:
        assert sum(n for _, n in held) <= padded <= 2048
        for (i, start), n in held:
            seen.setdefault(i, []).append((start, n))
    for i, n in enumerate(lengths):
        at = 0
        for start, size in sorted(seen[i]):
            assert start == at
            at += size
        assert at == n
    return out, seen


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(1, 5000), st.sampled_from([1, 682, 683, 1024, 1025, 2047, 2048, 2049])), min_size=1, max_size=200), st.sampled_from([0, 8]), st.sampled_from([1, 64]))
def test_packer_loses_nothing(lengths, slack, waiting):
    packed(lengths, slack=slack, waiting=waiting)


def test_packer_fills_classes_by_number():
    """Bins of class j hold j documents of lengths over 2048 / (j + 1), up to 2048 / j, and what fills them up."""
    rng = np.random.default_rng(2)
    lengths = [int(x) for x in rng.integers(1, 2048, 3000)]
    out, seen = packed(lengths)
    full = [held for _, padded, held in out if padded == 2048][: len(out) // 2]
    by_class = [Counter(2048 // n for (i, _), n in held if n == lengths[i]) for held in full]
    assert np.mean([any(c[j] >= j for j in c) for c in by_class]) > 0.9
    assert np.mean([len(x) == 1 for x in seen.values()]) > 0.5


def test_packing_keeps_documents_whole(spark):
    import os

    if not os.path.isdir("/root/testdata/sf0.01"):
        pytest.skip("no test tables")
    rows = PK.op3_harmonic_packing(spark, "/root/testdata/sf0.01").select("doc_id", "length", "doc_tokens", "sequence_id", "padded_to").collect()
    pieces, tokens = Counter(r.doc_id for r in rows), {r.doc_id: r.doc_tokens for r in rows}
    fit = [i for i, n in tokens.items() if n <= 2048]
    assert np.mean([pieces[i] == 1 for i in fit]) > 0.9
    total = sum({r.sequence_id: r.padded_to for r in rows}.values())
    assert (total - sum(tokens.values())) / total < 0.01


def test_toxicity(spark):
    clean = [f"The quick fox number {i} jumps over the dog. It was a fine day for word{i % 17} and tea." for i in range(120)]
    toxic = [f"The quick fox number {i} jumps. You are a vile{'abcd'[i % 4]} creature. It was a fine day for word{i % 17}." for i in range(120)]
    texts = [x for pair in zip(clean, toxic, strict=True) for x in pair]
    d = docs(spark, texts)
    labels = spark.createDataFrame([(i, i % 2) for i in range(240)] + [(5, None), (None, 1)], "doc_id long, toxic int")
    model = TX.fit(d, labels)
    got = {r.doc_id: r for r in TX.score(docs(spark, [*texts, None, "", "You VILEx thing"]), model).collect()}
    assert all(got[i].predicted == i % 2 for i in range(240))
    assert got[1].worst_sentence == "You are a vilea creature." and got[0].worst_sentence is None
    assert 0 <= got[240].score == got[241].score < 0.5 and got[242].predicted == 1
    assert TX.reject(d, model).columns == d.columns and TX.reject(d, model).count() == 120
    empty = TX.fit(d, labels.limit(0))
    assert {r.predicted for r in TX.score(d, empty).collect()} == {0}
    assert TX.score(docs(spark, []), model).count() == 0


def test_toxicity_is_a_noisy_or():
    """Scores against a plain product over sentences; the gradient against differences."""
    import math

    model = TX.ToxicityModel(-4.0, {"vile": 3.0, "vil*": 1.5, "kind": -2.0, "fool": 5.0, "foo*": 0.5})

    def plain(text):
        odds = []
        for part in re.split(r"(?<=[.!?])\s+|[\n\r]+", text):
            words = set(re.findall(r"[^\W\d_]+", part.lower()))
            z = sum(model.weights.get(w, 0) + sum(model.weights.get(w[:k] + "*", 0) for k in (3, 4, 5, 6) if len(w) > k) for w in words)
            odds.append((1 + math.exp(model.bias)) / (1 + math.exp(model.bias + max(z, 0))))
        n = len([x for x in re.split(r"(?<=[.!?])\s+|[\n\r]+", text) if x])
        return 1 - (1 - 1 / (1 + math.exp(-model.bias))) ** (1 + n * 100 / (n + 100)) * math.prod(odds)

    for text in ("", "Plain.", "A vile thing. So kind!\nYou fool? fine", "vile " * 50, "kind. " * 9 + "Fools and vilest fool.", "None. " * 5000):
        assert TX._Scorer(model).document(text)[0] == pytest.approx(plain(text), rel=1e-9)
    rng = np.random.default_rng(4)
    sent_doc, y = np.repeat(np.arange(12), 3), rng.integers(0, 2, 12)
    ids, sent_of = rng.integers(0, 6, 80), np.sort(rng.integers(0, 36, 80))
    w, b = rng.normal(size=6), -1.3
    loss, grad = TX.likelihood(w, b, ids, sent_of, sent_doc, y)
    for k in range(7):
        step = np.zeros(7)
        step[k] = 1e-6
        up = TX.likelihood(w + step[:6], b + step[6], ids, sent_of, sent_doc, y)[0]
        assert (up - loss) / 1e-6 == pytest.approx(grad[k], abs=1e-4)


def test_toxicity_of_very_long_clean_texts(spark):
    long = "It was a fine day for tea. " * 60_000
    rows = docs(spark, [long, long, None, long + "You vilea vileb thing."])
    d = docs(spark, [f"A fine day for word{i}." if i % 2 else f"You vile{'ab'[i % 4 // 2]} creature {i}." for i in range(80)])
    model = TX.fit(d, spark.createDataFrame([(i, 1 - i % 2) for i in range(80)], "doc_id long, toxic int"))
    got = {r.doc_id: r for r in TX.score(rows, model).collect()}
    assert got[0].score == got[1].score < 0.5 and got[2].predicted == 0 and got[3].predicted == 1 and "vilea" in got[3].worst_sentence
    assert TX.reject(rows, TX.ToxicityModel(-7.0)).count() == 4


@pytest.mark.parametrize("name", ["toxicity", "line_quality"])
def test_held_out_rows_of_the_tables(spark, name):
    import os

    path = "/root/testdata/sf0.01"
    if not os.path.isdir(path):
        pytest.skip("no test tables")
    from brindle.llm.registry import QUERIES

    q, label, least = {"toxicity": ("op1_toxicity", "toxic", 0.85), "line_quality": ("op4_line_quality", "quality", 0.95)}[name]
    labels = spark.read.parquet(f"{path}/labels.parquet")
    rows = QUERIES[q](spark, path).join(labels.select("doc_id", F.col(label).alias("y")), "doc_id").where("held_out and y is not null").select("y", "score").collect()
    ones, zeros = [r.score for r in rows if r.y == 1], [r.score for r in rows if r.y == 0]
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in ones for b in zeros])
    assert len(ones) > 3 and auc > least, (len(ones), auc)


def test_labels_that_disagree_are_left_out(spark):
    from brindle.llm.common import labelled_sample

    d = docs(spark, [f"text {i}" for i in range(50)])
    labels = spark.createDataFrame([(i, i % 2) for i in range(50)] + [(7, 0), (8, 0), (9, 1)], "doc_id long, toxic int")
    got = {r.doc_id: r.y for r in labelled_sample(d, labels, "toxic", 100).collect()}
    assert 7 not in got and all(got[i] == i % 2 for i in got) and (8 in got) == (zlib.crc32(b"8") % 5 > 0)


def test_quality(spark):
    good = [f"This is a plain sentence about thing {i}.\nAnother line follows it, and it reads well.\nThe end of story {i % 9}." for i in range(100)]
    bad = [f"This is a plain sentence about thing {i}.\n" + ("buy now | best | cheap | deal | " * 6 + f"{i}\n") * 4 for i in range(100)]
    texts = [x for pair in zip(bad, good, strict=True) for x in pair]
    d = docs(spark, texts)
    model = Q.fit(d, spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, quality int"))
    got = {r.doc_id: r for r in Q.score(docs(spark, [*texts, None, ""]), model).collect()}
    assert all(got[i].predicted == i % 2 for i in range(200))
    assert got[200].score == got[201].score and got[200].n_lines == 0 and 0 <= got[200].score <= 1
    assert Q.score(docs(spark, []), model).count() == 0
    long = "\n".join(texts) * 40
    rows = {r.doc_id: r for r in Q.score(docs(spark, [long, long, "word " * 200_000, texts[0], texts[0]]), model).collect()}
    assert rows[0].score == rows[1].score and rows[3].score == rows[4].score == got[0].score and all(0 <= r.score <= 1 for r in rows.values())
    assert {r.score for r in Q.score(d, Q.fit(d.limit(0), spark.createDataFrame([], "doc_id long, quality int"))).collect()} == {0.5}


def test_chain_marginals():
    """Forward-backward against all labellings of short chains."""
    import itertools

    rng = np.random.default_rng(3)
    counts = np.array([3, 0, 1, 4])
    bins = np.zeros((8, len(Q._NAMES)), np.int32)
    chains = Q.Chains(counts, bins)
    u, moves = rng.normal(size=8), rng.normal(size=(2, 2))
    got, pairs = chains.marginals(u, moves)
    want, seen, at = np.zeros(8), np.zeros((2, 2)), 0
    for n in counts:
        total, part, p2 = 0.0, np.zeros(n), np.zeros((2, 2))
        for ys in itertools.product((0, 1), repeat=int(n)):
            w = np.exp(sum(u[at + k] for k in range(n) if ys[k]) + sum(moves[a, b] for a, b in itertools.pairwise(ys)))
            total += w
            part += w * np.array(ys)
            for a, b in itertools.pairwise(ys):
                p2[a, b] += w
        want[at : at + n], seen, at = part / total, seen + p2 / total, at + n
    assert np.allclose(got, want) and np.allclose(pairs, seen)


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var a = "<p>no</p>";</script></head><body>
<header><p>The site of the town and of the people that live in it and it is for all of them to read in the day.</p></header>
<nav><ul><li><a href="/a">A</a><li><a href="/b">B</a></ul></nav><div class="ad">The best offer of the year is here for you and it is on for a day.</div>
<article><h1>A &amp; B</h1><p>First <b>paragraph</b> of the text,<br>with&nbsp;words that are in it &lt;here&gt;.<p>No.<aside>By the way, this is in the box at the side of it.</aside>
<table><tr><td>x | y</td></tr></table><div class="comments"><p>The nice one of the people wrote that it is good.</div></article><footer>&copy; z</footer><!-- end"""


def test_html():
    assert H.main_text(PAGE) == "A & B\nFirst paragraph of the text, with words that are in it <here>.\nNo.\nx | y"
    assert H.main_text(None) == H.main_text("") == H.main_text("<nav>a</nav>") == H.main_text("<!-- x") == ""
    plain = "<p>" + "The text of the page is in a block that has no section around it and it is long. " * 4 + "</p>"
    assert H.main_text(f"<body><div><a href=x>one two</a></div>{plain}<p>Short one.</p>{plain}</body>").count("\n") == 2


ARTICLE = "<article><h1>Title</h1><p>" + "The text of the page is in a block that is long and it is for all to read. " * 4 + "</p><p>Short one.</p></article>"


@pytest.mark.parametrize("tag", ["article", "main"])
@pytest.mark.parametrize("wrapper", ["div class='layout has-sidebar'", "div class=no-sidebar", "div id=content-sidebar", "div class=sidebar", "div class='page social'", "div class=with-menu", "section class='x header-fixed'", "form action=x", "form id=aspnet class=has-widget"])
def test_html_layout_wrappers(wrapper, tag):
    text = ARTICLE.replace("article", tag)
    page = f"<body><{wrapper}><p>Not in it.</p>{text}<div class=menu>Menu</div></{wrapper.split()[0]}></body>"
    assert H.main_text(page) == H.main_text(f"<body>{text}</body>") and H.main_text(page).startswith("Title\n")


def test_html_wrappers_that_stay_bad():
    alone = H.main_text(ARTICLE)
    card = ARTICLE.replace("Title", "Card")
    for wrapper in ("div class=sidebar", "div class=comments", "div id=related-posts", "aside", "nav", "div hidden", "form style='display:none'"):
        assert H.main_text(f"<{wrapper}>{card}</{wrapper.split()[0]}>{ARTICLE}") == alone
    for wrapper in ("div class='comments has-sidebar'", "nav", "form hidden"):
        assert H.main_text(f"<{wrapper}>{card}</{wrapper.split()[0]}>") == ""


def test_html_comment_articles_leave_main():
    body = ARTICLE[len("<article>") : -len("</article>")]
    said = "<section class=comments><article><p>" + "It is a nice one and the best of the ones that I have read. " * 4 + "</p></article></section>"
    for main in ("main", "div class=content"):
        assert H.main_text(f"<{main}>{body}{said}</{main.split()[0]}>") == H.main_text(f"<{main}>{body}</{main.split()[0]}>") == H.main_text(ARTICLE)


SOUP = re.compile(r"<(/?)(?:article|nav|footer|header|aside|main)\b[^>]*>|(<\w+)\s+(?:class|id)=(?:\"[^\"]*\"|'[^']*'|[^\s>]+)")


def soup(page):
    """The page without names: sectioning elements as plain ones, no classes or ids."""
    return SOUP.sub(lambda m: m[2] or f"<{m[1]}div>", page)


def f1(got, want):
    a, b = Counter(got.split()), Counter(want.split())
    return 2 * sum((a & b).values()) / max(1, sum(a.values()) + sum(b.values()))


#: Rules with links, length and stop words switched off: only places are left.
PLACES_ONLY = H.BlockRules(is_long=0, some_stop_words=0, many_stop_words=0, no_stop_words=0, many_links=0)


def test_html_density_decides():
    prose = "The text of the page is in a block that is long and it is for all of them to read in the day. " * 3
    links = "<p>" + "".join(f"<a href=/{i}>Things of the day {i}</a> " for i in range(9)) + "</p>"
    words = "<p>" + "Price10 Model20 Stock30 Colour40 Size50 " * 6 + "</p>"
    page = f"<div>{links}<p>Short before.</p><h2>Title</h2><p>{prose}</p><p>Short one.</p><p>{prose}</p>{words}<p>Short after.</p>{links}</div>"
    want = f"Title\n{prose.strip()}\nShort one.\n{prose.strip()}"
    assert H.main_text(page) == want
    for off in ({"max_link": 1.0}, {"no_stop_words": 2}, {"stop_words": frozenset()}, {"short": 0}, {"is_long": 0, "many_stop_words": 0}):
        assert H.main_text(page, H.BlockRules(**off)) != want, off
    assert H.main_text(page, PLACES_ONLY) != want
    # in an article too, links and missing words lose where the place alone would keep them
    inside = f"<article><h1>Title</h1><p>{prose}</p>{links}<p>{prose}</p></article>"
    assert "Things" not in H.main_text(inside) and "Things" in H.main_text(inside, PLACES_ONLY)


def test_html_names_that_say_nothing():
    prose = "The text of the page is in a block that is long and it is for all of them to read in the day. " * 3
    for names in ("share-of-market", "story-related-events", "side-effects", "menu-of-the-day", "header-fixed", "navy", "footnote", "advertising-law"):
        page = f"<article><h1>T</h1><p>{prose}</p><section class='{names}' id={names}><p>Short.</p><p>{prose}</p></section></article>"
        assert H.main_text(page) == f"T\n{prose.strip()}\nShort.\n{prose.strip()}", names
        assert H.main_text(f"<article><section class={names}><p>{prose}</p></section></article>") == prose.strip()
    for names in ("related-posts", "comment-list", "site-header", "cookie-banner", "ad-slot-2", "article-share", "comments__item", "sidebar right"):
        assert H.main_text(f"<div class='{names}'><p>Short.</p></div><article><h1>T</h1><p>{prose}</p></article>") == f"T\n{prose.strip()}", names


def test_html_time_is_linear():
    import time

    for page in ("<div>" * 60000 + "</p>" * 60000, "<div><p>" * 40000, "<head>" * 40000, "<a x=\"" * 40000, "<p class='a" * 40000, "<!--" * 40000, "<div></span></ul>" * 40000, "<b " * 40000 + "x"):
        began = time.perf_counter()
        H.main_text(page + "<p>x")
        assert time.perf_counter() - began < 8, page[:20]


def test_html_pages(spark):
    df = spark.createDataFrame([(1, "u", PAGE, 5), (2, None, None, 6), (3, "v", "<p>" * 2000 + "x", 7)], "page_id long, url string, html string, text int")
    got = {r.page_id: r for r in H.extract(df).collect()}
    assert got[1].n_chars == len(got[1].text) and (got[2].text, got[2].n_chars, got[2].url) == ("", 0, None)
    assert H.extract(df.limit(0)).count() == 0


def test_html_table_pages(spark):
    import os

    path = "/root/testdata/sf0.001/pages.parquet"
    if not os.path.exists(path):
        pytest.skip("no test tables")
    score, kept, without, n = 0.0, 0, 0, 0
    for r in spark.read.parquet(path).collect():
        article = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", p.replace("<br>", " "))).split()) for p in re.split(r"</?p>|</?h1>", article)]
        want = "\n".join(p for p in parts if p)
        assert H.main_text(r.html) == want
        got, n = H.main_text(soup(r.html)), n + 1
        score += f1(got, want)
        kept += len(set(got.split("\n")) - set(parts))
        without += len(set(H.main_text(soup(r.html), PLACES_ONLY).split("\n")) - set(parts))
    # without any names, links, length and stop words do nearly as well; without these too, all menus and adverts stay
    assert score / n > 0.9 and kept < without / 5, (score / n, kept, without)


def test_mpeg_round_trip(spark):
    texts = [*EDGE, "x" * 192, "x" * 193]
    d = docs(spark, texts)
    got = {r.doc_id: r for r in M.read_back(M.stored(d)).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        payload = raw + b" " * (max(192, -(-len(raw) // 192) * 192) - len(raw))
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        media = M.store(payload)
        assert (r.media_bytes, r.media_sha256) == (len(media), hashlib.sha256(media).hexdigest())
    assert got[0].feature == got[1].feature and M.read_back(M.stored(docs(spark, []))).count() == 0


def test_mpeg_parse():
    payload = bytes(range(192)) * 4
    data = M.store(payload, "née")
    back, f = M.load(data)
    assert back == payload and f.tags == {"TIT2": "née"} and f.crc_bad == 0 and f.crc_ok == 5
    assert (f.frames, f.declared_frames, f.samples, f.duration) == (4, 4, 4608, Fraction(4608, 48000)) and len(f.toc) == 100
    assert M.seek(f, Fraction(1152, 48000)) == f.offsets[1] and M.seek(f, 1.0) is None
    broken = bytearray(data)
    broken[f.offsets[2] + 8] ^= 1
    assert M.parse(bytes(broken)).crc_bad == 1
    junk = data[: f.offsets[2]] + b"\xff\xfbjunk\xff\xff" + data[f.offsets[2] :] + b"TAG" + b"title".ljust(125, b"\0")
    g = M.parse(junk)
    assert (g.frames, g.resyncs, g.skipped) == (4, 1, 8) and g.tags["v1:title"] == "title"
    assert M.parse(None).frames == M.parse(b"\xff" * 50).frames == 0
    layer2 = bytes((0xFF, 0xFD, 0x84, 0x00)) + bytes(380)
    h = M.header(layer2[:4])
    assert (h.layer, h.kbps, h.rate, h.length, h.samples) == (2, 128, 48000, 384, 1152)
    with pytest.raises(ValueError):
        M.store(b"x")


def test_describe(spark):
    df = spark.createDataFrame([(1, bytearray(M.store(b"a" * 192))), (2, None)], "media_id long, media binary")
    got = {r.media_id: r for r in M.describe(df).collect()}
    assert got[1].frames == 1 and got[1].seconds == 1152 / 48000 and got[2].frames == 0


def test_describe_mixed_rates(spark):
    layer2 = bytes((0xFF, 0xFC, 0x84, 0x00)) + bytes(380)
    data = M.store(b"a" * 192) + layer2 + bytes((0xFF, 0xFD, 0x80, 0x00)) + bytes(413)
    r = M.describe(spark.createDataFrame([(1, bytearray(data))], "media_id long, media binary")).first()
    assert (r.frames, r.crc_ok, r.crc_bad, r.crc_unchecked) == (3, 2, 0, 1)
    assert Fraction(r.duration_num, r.duration_den) == Fraction(2 * 1152, 48000) + Fraction(1152, 44100)


def test_seek_digest_covers_all_offsets(spark):
    r = M.read_back(M.stored(docs(spark, ["x" * 192 * 7]))).first()
    offsets = M.parse(M.store(b"x" * 192 * 7)).offsets
    assert f"seek_crc32={zlib.crc32(np.array([*offsets, r.media_bytes], '<u8').tobytes()):08x}" in r.feature


def test_rows_without_id(spark):
    rows = [(None, run(40)), (None, run(40)), (1, run(40)), (2, run(60, "x")), (None, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"lang": F.lit("en"), "source": F.lit("src1")})
    assert RS.without_repeats(d).count() == X.groups(d).count() == SH.near_groups(d).count() == 5
    assert X.keep_first(d).where("doc_id is null").count() == 3 and SH.keep_one(d).where("doc_id is null").count() == 3
    assert {r.keep_id for r in X.groups(d).where("group_size = 3").collect()} == {1}
    assert len(PK.pack(d).select("doc_id").distinct().collect()) == 3
    assert len(M.read_back(M.stored(d)).collect()) == 5
    model = TX.ToxicityModel(-7.0)
    assert TX.score(d, model).count() == TX.reject(d, model).count() == 5
    from brindle.llm import mixing as MX

    assert MX.mix(d)[0].count() == 5 and MX.select(d).columns == d.columns


MARKS = [b"TAG", b"ID3\x03\0\0\0\0\0\x10", b"Xing", b"Info\0\0\0\x07", b"VBRI", b"APETAGEX", b"LYRICSBEGIN", b"\xff\xfa\x64\xc0", b"\xff\xfb\x90\x00", b"\xff" * 8]


@pytest.mark.parametrize("mark", MARKS)
@pytest.mark.parametrize("frames", [1, 4])
def test_mpeg_marks_in_the_payload(mark, frames):
    for at in range(0, 192 * frames - len(mark) + 1):
        payload = (b"x" * at + mark).ljust(192 * frames, b"y")
        back, found = M.load(M.store(payload))
        assert back == payload and found.frames == found.declared_frames == frames


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from([*MARKS, b"a", b"\0", b" ", M.store(b"z" * 192)]), max_size=40))
def test_mpeg_payload_of_marks(parts):
    raw = b"".join(parts)
    payload = raw.ljust(max(192, -(-len(raw) // 192) * 192))
    assert M.load(M.store(payload))[0] == payload


def test_mpeg_load_refuses_damage():
    data = M.store(bytes(range(192)) * 4)
    at = M.parse(data).offsets
    for bad in (data[: at[3]], data[:-1], data[: at[1]] + data[at[2] :], data[: at[2]] + b"junk" + data[at[2] :], data + b"TAG".ljust(128, b"t")):
        with pytest.raises(ValueError):
            M.load(bad)
    tagged = M.parse(data[:-50] + b"TAG" + b"cut".ljust(125, b"\0"))
    assert (tagged.frames, tagged.skipped, tagged.tags["v1:title"]) == (3, 190, "cut")
    assert M.parse(b"TAG".ljust(128, b"t")).frames == 0
