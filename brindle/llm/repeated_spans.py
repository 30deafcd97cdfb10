"""Repeated word spans by De Bruijn compaction.

A window of 35 words is an edge of the De Bruijn graph of the corpus' token k-mers; an edge that occurs twice is a
repeat. Edges aren't handled one by one: each belongs to the least k-mer in it (its minimizer), and neighbouring windows
with one minimizer form a path that is compacted where it is read, about one row per 14 words. Equal windows have equal
minimizers, so a minimizer that occurs once drops its whole path. A join finds the paths that occur as a whole more than
once: those are nonbranching repeats, compacted to one span per occurrence. Paths that share a minimizer but differ
branch somewhere; only their edges are compared one by one, with one occurrence standing for each whole repeat.

Hashes only nominate. Every repeat names the source coordinates (row, first word) of one representative; claims that
continue each other on both sides are merged, cut on a grid of the representative's words, and the words at both
coordinates are compared. Where any differ, all windows of the minimizers concerned are compared by their words.

Rows are numbered when the texts are first written, so a row's coordinates never depend on its doc_id.

Skew: counts are combined before each shuffle, and joins on a hot path are plain sort-merge joins of written tables,
which adaptive execution splits. A representative is read once however many rows claim it: the grid bounds the
different intervals of a text by its length. Shuffle files and inner steps go as soon as they are used.

Defined results: words are maximal runs of other than ASCII white space; a null text counts as empty: no words, nothing
removed. A text of fewer words than a window has no windows. Rows count one by one: a row that stands there twice
repeats all its windows, rows that share a doc_id with different texts, or lack one, are compared and cut like any
other. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, partitions, per_document, scratch, table

WINDOW = 35
KMER = 8
#: Claims are compared in pieces of so many windows of the representative at most.
GRID = 64

#: Bases of the two hashes of a run of words.
_BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
_powers: dict[int, np.ndarray] = {}


def _power(base: np.uint64, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), modulo 2 ** 64; kept for the next text."""
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        size = max(4096, 1 << n.bit_length())
        have = np.full(size, base)
        have[0] = 1
        have = _powers[int(base)] = np.multiply.accumulate(have)
    return have[:n]


class Sums:
    """Polynomial hashes of any run of a text's words."""

    def __init__(self, h: np.ndarray, base: int):
        n = len(h)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(h * _power(np.uint64(base), n), out=self.sums[1:])
        self.back = _power(np.uint64(pow(base, -1, 1 << 64)), n + 1)

    def runs(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.back[start]

    def every(self, size: int) -> np.ndarray:
        return (self.sums[size:] - self.sums[:-size]) * self.back[: len(self.sums) - size]


def word_hashes(words: list[bytes], bits: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each word; fewer bits make collisions, for tests."""
    import xxhash

    digest = xxhash.xxh3_128_digest
    both = np.frombuffer(b"".join([digest(w) for w in words]), "<u8").reshape(-1, 2)
    if bits < 64:
        both = both & np.uint64((1 << bits) - 1)
    return both[:, 0].copy(), both[:, 1].copy()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def _least(x: np.ndarray, size: int) -> np.ndarray:
    """Minimum of each run of size neighbours."""
    have = 1
    while 2 * have <= size:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[: len(x) - (size - have)], x[size - have :]) if size > have else x


def paths(words: list[bytes], window: int = WINDOW, kmer: int = KMER, bits: int = 64):
    """(minimizer, content hash, first word, windows, loops) of each compacted path of a text, as arrays; None without windows.

    A path loops if its minimizer stands in it more than once, so that it may hold one window twice.
    """
    if len(words) < window:
        return None
    h1, h2 = word_hashes(words, bits)
    kmers = _mixed(Sums(h1, _BASES[0]).every(kmer))
    least = _least(kmers, window - kmer + 1)
    start = np.append(0, np.flatnonzero(least[1:] != least[:-1]) + 1)
    end = np.append(start[1:], len(least))
    content = _mixed(Sums(h2, _BASES[1]).runs(start, end + window - 1))
    m, reach = least[start], end + window - kmer
    loops = np.zeros(len(m), bool)
    if len(np.unique(kmers)) < len(kmers):
        loops = np.array([np.count_nonzero(kmers[a:b] == x) > 1 for a, b, x in zip(start.tolist(), reach.tolist(), m, strict=True)])
    return m.view(np.int64), content.view(np.int64), start, end - start, loops


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode().split()


def numbered(docs: DataFrame) -> DataFrame:
    """(row, doc_id, text), written once, so that a row keeps its number."""
    return materialise(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text"), "texts", keep=True)


def repeated_spans(texts: DataFrame, window: int = WINDOW, kmer: int = KMER, bits: int = 64) -> DataFrame:
    """(row, spans): where windows of numbered() texts stand that occur again, as array<struct<start, n>>; rows with any."""
    with scratch(texts.sparkSession):
        shared, claims = _claims(texts, window, kmer, bits)
        pieces = materialise(_pieces(claims), "pieces")
        failed = materialise(_differing(texts, pieces, window), "differing")
        ends = claims.select("row", "start", "n").unionByName(claims.select(F.col("other").alias("row"), F.col("at").alias("start"), "n"))
        if not failed.isEmpty():
            ends = _by_words(texts, shared, ends, pieces.join(failed, ["other", "at", "n"], "left_semi"), window)
        spans = ends.groupBy("row").agg(F.array_sort(F.collect_set(F.struct("start", "n"))).alias("spans"))
        return materialise(spans, "spans", keep=True)


def _claims(texts: DataFrame, window: int, kmer: int, bits: int) -> tuple[DataFrame, DataFrame]:
    """(paths whose minimizer occurs again; (row, start, n, other, at): n windows from start equal, by their hashes, those of row other from at)."""

    def cut(cols):
        rows, parts = [], []
        for row, text in zip(cols["row"], cols["text"], strict=True):
            p = paths(_words(text), window, kmer, bits)
            if p is not None:
                rows.append(np.full(len(p[0]), row, np.int64))
                parts.append(p)
        if not rows:
            return {}
        m, content, start, n, loops = (np.concatenate(x) for x in zip(*parts, strict=True))
        return {"row": np.concatenate(rows), "m": m, "content": content, "start": start.astype(np.int32), "n": n.astype(np.int32), "loops": loops}

    def edges(cols):
        out = []
        for row, text, work in zip(cols["row"], cols["text"], cols["work"], strict=True):
            h1, h2 = word_hashes(_words(text), bits)
            one, two = Sums(h1, _BASES[0]).every(window), Sums(h2, _BASES[1]).every(window)
            at = np.concatenate([np.arange(w["start"], w["start"] + w["n"]) for w in work])
            weight = np.repeat([w["weight"] for w in work], [w["n"] for w in work])
            out.append((np.full(len(at), row, np.int64), at.astype(np.int32), one[at].view(np.int64), two[at].view(np.int64), weight.astype(np.int8)))
        return dict(zip(("row", "start", "e1", "e2", "weight"), map(np.concatenate, zip(*out, strict=True)), strict=True)) if out else {}

    spark = texts.sparkSession
    with scratch(spark):
        all_paths = materialise(per_document(texts, ["row", "text"], cut, "row long, m long, content long, start int, n int, loops boolean"), "paths")
        again = materialise(all_paths.groupBy("m").agg(F.count(F.lit(1)).alias("times"), F.max("loops").alias("loops")).where("times > 1 or loops").select("m"), "minimizers")
        shared = materialise(all_paths.join(again, "m", "left_semi"), "shared-paths", keep=True)
    with scratch(spark):
        kinds = materialise(shared.groupBy("m", "content").agg(F.count(F.lit(1)).alias("times"), F.min(F.struct("row", "start", "n")).alias("first"), F.max("loops").alias("loops")), "path-kinds")
        other = kinds.where("times > 1").select("m", "content", F.col("first.row").alias("other"), F.col("first.start").alias("at"))
        whole = shared.join(other, ["m", "content"]).select("row", "start", "n", "other", "at")
        # paths that branch or loop, and one occurrence of each whole repeat that shares a minimizer with one of them
        mixed = kinds.groupBy("m").agg(F.count(F.lit(1)).alias("variants"), F.max(F.expr("times = 1 and loops")).alias("loops"), F.min("times").alias("least"))
        mixed = materialise(mixed.where("least = 1 and (variants > 1 or loops)").select("m"), "mixed-minimizers")
        branching = kinds.where("times = 1").join(mixed, "m", "left_semi").select("first.*", F.lit(1).cast("tinyint").alias("weight"))
        stand_in = kinds.where("times > 1").join(mixed, "m", "left_semi").select("first.*", F.lit(2).cast("tinyint").alias("weight"))
        work = branching.unionByName(stand_in).groupBy("row").agg(F.collect_list(F.struct("start", "n", "weight")).alias("work"))
        of_text = texts.select("row", "text").join(materialise(work, "branching"), "row")
        single_edges = materialise(per_document(of_text, ["row", "text", "work"], edges, "row long, start int, e1 long, e2 long, weight tinyint"), "edges")
        twice = single_edges.groupBy("e1", "e2").agg(F.sum("weight").alias("times"), F.min(F.struct("row", "start")).alias("first")).where("times > 1")
        twice = materialise(twice.select("e1", "e2", F.col("first.row").alias("other"), F.col("first.start").alias("at")), "repeated-edges")
        # stand-ins too: theirs may be the only claim on an edge that comes first
        found = single_edges.join(twice, ["e1", "e2"]).select("row", "start", F.lit(1).alias("n"), "other", "at")
        return shared, materialise(whole.unionByName(found).where("row <> other or start <> at"), "claims", keep=True)


def _pieces(claims: DataFrame) -> DataFrame:
    """Claims that continue each other on both sides, merged and cut on the grid of the other's words.

    Merging saves comparisons only: a run may end with its batch.
    """

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            if not batch.num_rows:
                continue
            row, other, at, start, n = (batch.column(k).to_numpy().astype(np.int64) for k in range(5))
            new = (row[1:] != row[:-1]) | (other[1:] != other[:-1]) | (at[1:] - start[1:] != at[:-1] - start[:-1]) | (start[1:] != start[:-1] + n[:-1])
            first = np.append(0, np.flatnonzero(new) + 1)
            size = np.add.reduceat(n, first)
            row, other, at, start = row[first], other[first], at[first], start[first]
            count = (at + size - 1) // GRID - at // GRID + 1
            i = np.repeat(np.arange(len(first)), count)
            cell = at[i] // GRID + np.arange(len(i)) - np.repeat(np.cumsum(count) - count, count)
            low, high = np.maximum(at[i], cell * GRID), np.minimum((at + size)[i], (cell + 1) * GRID)
            found = {"row": row[i], "start": (start[i] + low - at[i]).astype(np.int32), "other": other[i], "at": low.astype(np.int32), "n": (high - low).astype(np.int32)}
            yield pa.RecordBatch.from_pydict({k: pa.array(v) for k, v in found.items()})

    lined_up = claims.select("row", "other", "at", "start", "n").repartition(partitions(claims.sparkSession), "row").sortWithinPartitions("row", "other", F.col("at") - F.col("start"), "start")
    return lined_up.mapInArrow(run, "row long, start int, other long, at int, n int")


def _differing(texts: DataFrame, pieces: DataFrame, window: int) -> DataFrame:
    """(other, at, n) of the pieces whose words aren't the same at all their coordinates."""

    def run(cols):
        seen = {}
        for text, work in zip(cols["text"], cols["work"], strict=True):
            words = _words(text)
            for w in work:
                seen[w["other"], w["at"], w["n"], b" ".join(words[w["start"] : w["start"] + w["n"] + window - 1])] = None
        return dict(zip(("other", "at", "n", "words"), zip(*seen, strict=True), strict=True)) if seen else {}

    own = pieces.select("other", "at", "n").distinct().select(F.col("other").alias("row"), F.col("at").alias("start"), "other", "at", "n")
    work = materialise(pieces.unionByName(own).groupBy("row").agg(F.collect_list(F.struct("start", "n", "other", "at")).alias("work")), "compared")
    said = per_document(texts.select("row", "text").join(work, "row"), ["row", "text", "work"], run, "other long, at int, n int, words binary")
    ends = said.groupBy("other", "at", "n").agg(F.min("words").alias("low"), F.max("words").alias("high"))
    return ends.where("low <> high").select("other", "at", "n")


def _by_words(texts: DataFrame, shared: DataFrame, ends: DataFrame, failed: DataFrame, window: int) -> DataFrame:
    """ends (row, start, n) with all windows of the failed pieces' minimizers judged by their words instead."""

    def run(cols):
        out = [(row, at, b" ".join(words[at : at + window])) for row, text, work in zip(cols["row"], cols["text"], cols["work"], strict=True) for words in [_words(text)] for w in work for at in range(w["start"], w["start"] + w["n"])]
        return dict(zip(("row", "start", "words"), zip(*out, strict=True), strict=True)) if out else {}

    wrong = failed.select("row", "start", "n").unionByName(failed.select(F.col("other").alias("row"), F.col("at").alias("start"), "n"))
    wrong = wrong.select("row", F.col("start").alias("low"), (F.col("start") + F.col("n")).alias("high"))
    again = shared.join(wrong, "row").where("start < high and start + n > low").select("m").distinct()
    redo = materialise(shared.join(again, "m", "left_semi").select("row", F.col("start").alias("from"), (F.col("start") + F.col("n")).alias("to")), "compared-by-words")
    good = ends.join(redo, (ends["row"] == redo["row"]) & (ends["start"] >= redo["from"]) & (ends["start"] < redo["to"]), "left_anti")
    work = redo.groupBy("row").agg(F.collect_list(F.struct(F.col("from").alias("start"), (F.col("to") - F.col("from")).alias("n"))).alias("work"))
    windows = materialise(per_document(texts.select("row", "text").join(work, "row"), ["row", "text", "work"], run, "row long, start int, words binary"), "windows")
    twice = windows.groupBy("words").agg(F.count(F.lit(1)).alias("times")).where("times > 1").select("words")
    return good.unionByName(windows.join(twice, "words", "left_semi").select("row", "start", F.lit(1).alias("n")))


def covered(n_words: int, spans, window: int = WINDOW) -> np.ndarray:
    """Which of a text's words the windows of the spans cover."""
    step = np.zeros(n_words + 1, np.int64)
    for s in spans or ():
        step[s["start"]] += 1
        step[s["start"] + s["n"] + window - 1] -= 1
    return np.cumsum(step)[:n_words] > 0


def without_repeats(docs: DataFrame, window: int = WINDOW, bits: int = 64) -> DataFrame:
    """One row per row of docs: doc_id, kept (its remaining words, joined by one space), n_words, n_removed."""

    def run(cols):
        kept, total, removed = [], [], []
        for text, spans in zip(cols["text"], cols["spans"], strict=True):
            words = _words(text)
            gone = covered(len(words), spans, window)
            kept.append(b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g]).decode())
            total.append(len(words))
            removed.append(int(gone.sum()))
        return {"doc_id": cols["doc_id"], "kept": kept, "n_words": total, "n_removed": removed}

    texts = numbered(docs)
    joined = texts.join(repeated_spans(texts, window, bits=bits), "row", "left")
    return per_document(joined, ["doc_id", "text", "spans"], run, "doc_id long, kept string, n_words long, n_removed long")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = without_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def brute_force(texts: list[str | None], window: int = WINDOW) -> list[tuple[int, int, str]]:
    """(n_words, n_removed, kept_sha256) of each row, by counting every window: for tests."""
    rows = [_words(t) for t in texts]
    counts: dict[tuple, int] = {}
    for w in rows:
        for i in range(len(w) - window + 1):
            key = tuple(w[i : i + window])
            counts[key] = counts.get(key, 0) + 1
    out = []
    for w in rows:
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if counts[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return out
