"""SimHash near-duplicates by anchor-point covering.

Anchors are the words of a covering code: the 64 bits are cut into blocks, and an anchor is constant in each block, so a
fingerprint's nearest anchor (its home) is the majority of each block, at most half a block's bits away per block. If
two fingerprints differ in at most t bits, each lies within covering radius plus t of the other's home. So every
distinct fingerprint is sent to its home and to the anchors within that reach, which are the homes of fingerprints
within t bits of it: those where the blocks to turn over cost t flips or fewer. At an anchor, homes are compared with
all that visit; every link is found at the home of either end.

Cost: copies go as one fingerprint, then each is replicated a number of times that depends on the number of blocks only
(with t = 3, on average 60 for 10 blocks, 107 for 12, 175 for 14, 240 for 16). The number of blocks grows with the
logarithm of the input, so that an anchor's homes stay near 2^17. A task holds the homes of an anchor in memory and
streams its visitors; an anchor with more of either than a bound is split over tasks. It gives the edges of a spanning
forest, at most one per visitor and two per join of two trees, never all pairs of a group.

Defined results: a null text counts as empty; texts without words have fingerprint zero, linked like any other; repeated
rows fall in one component; component_id is the smallest doc_id reachable; rows are told apart by their place, so one
doc_id with two texts counts as two; a row without doc_id is linked but never dropped. An empty table gives an empty result.
"""

from __future__ import annotations

import itertools

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import AT, FILE, located, materialise, partitions, per_document, scratch, small, table
from .components import components


def fingerprint(text: str | None, words: int = 3) -> int:
    """64-bit SimHash of the shingles of a text, as an unsigned integer."""
    import xxhash

    body = b" ".join((text or "").encode().lower().split())
    if not body:
        return 0
    gaps = np.flatnonzero(np.frombuffer(body, np.uint8) == 32)
    starts, ends = np.append(0, gaps + 1).tolist(), np.append(gaps, len(body)).tolist()
    n = max(1, len(starts) - words + 1)
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(body[a:b], 42) for a, b in zip(starts[:n], ends[-n:], strict=True)], "<u8")
    ones = np.zeros(64, np.int64)
    for i in range(0, n, 65536):
        part = h[i : i + 65536]
        ones += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, fp, file, at) of located() rows: fp is the fingerprint's bits as a signed long."""

    def run(cols):
        fp = np.array([fingerprint(t, words) for t in cols["text"]], np.uint64).view(np.int64)
        return {"doc_id": cols["doc_id"], "fp": fp, "file": cols[FILE], "at": cols[AT]}

    return per_document(docs, ["doc_id", "text", FILE, AT], run, "doc_id long, fp long, file long, at long")


class Covering:
    """A covering code of the 64-bit words: one repetition code per block."""

    def __init__(self, blocks: int, reach: int = 3):
        cuts = [64 * i // blocks for i in range(blocks + 1)]
        self.sizes = np.array([b - a for a, b in itertools.pairwise(cuts)])
        self.masks = np.array([(1 << b) - (1 << a) for a, b in itertools.pairwise(cuts)], np.uint64)
        self.reach = reach
        self.turned = [c for k in range(reach + 1) for c in itertools.combinations(range(blocks), k)]
        self.flip = np.array([sum(1 << i for i in c) for c in self.turned], np.int64)

    def anchors(self, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, anchor, 1 for a visitor or 0 for a home) of every copy of the fingerprints."""
        ones = np.stack([np.bitwise_count(fps & m) for m in self.masks], axis=1).astype(np.int64)
        high = 2 * ones > self.sizes
        home = (high << np.arange(len(self.sizes))).sum(axis=1)
        low_most = self.sizes // 2  # a block with so many ones or fewer has a home bit of zero
        cost = np.where(high, ones - low_most, low_most + 1 - ones)
        near = np.stack([cost[:, list(c)].sum(axis=1) <= self.reach for c in self.turned], axis=1)
        row, turn = np.nonzero(near)
        return row, home[row] ^ self.flip[turn], (turn > 0).astype(np.int8)


def blocks_for(n: int) -> int:
    """Blocks of the covering code for n distinct fingerprints: 10, and more where homes would pass 2^17 an anchor."""
    return min(16, max(10, int(n).bit_length() - 17))


class _Anchor:
    """Homes of one anchor, and the trees that links have joined so far."""

    BANDS = 4
    #: Pairs compared at a time.
    STEP = 2_000_000

    def __init__(self, homes: np.ndarray, reach: int):
        self.homes, self.reach = homes, reach
        self.root = np.arange(len(homes))
        self.order = None
        if len(homes) > 256 and reach < self.BANDS:
            # reach bits can't touch all bands: linked fingerprints agree in one of them
            self.keys = [(homes >> np.uint64(16 * b)) & np.uint64(0xFFFF) for b in range(self.BANDS)]
            self.order = [np.argsort(k, kind="stable") for k in self.keys]
            self.keys = [k[o] for k, o in zip(self.keys, self.order, strict=True)]

    def links(self, fps: np.ndarray, fresh: bool):
        """Yields edges between fps and homes; fresh: fps are visitors, else the homes themselves."""
        if self.order is None:
            step = max(1, self.STEP // max(1, len(self.homes)))
            for i in range(0, len(fps), step):
                part = fps[i : i + step]
                v, h = np.nonzero(np.bitwise_count(part[:, None] ^ self.homes) <= self.reach)
                yield from self._join(part, v, h, i, fresh)
            return
        for b in range(self.BANDS):
            key = (fps >> np.uint64(16 * b)) & np.uint64(0xFFFF)
            lo, hi = np.searchsorted(self.keys[b], key, "left"), np.searchsorted(self.keys[b], key, "right")
            total = np.cumsum(hi - lo)
            i = 0
            while i < len(fps):
                before = total[i - 1] if i else 0
                j = max(i + 1, int(np.searchsorted(total, before + self.STEP, "right")))
                n = (hi - lo)[i:j]
                v = np.repeat(np.arange(j - i), n)
                at = np.arange(len(v)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo[i:j], n)
                h = self.order[b][at]
                part = fps[i:j]
                near = np.bitwise_count(part[v] ^ self.homes[h]) <= self.reach
                yield from self._join(part, v[near], h[near], i, fresh)
                i = j

    def _join(self, part, v, h, at, fresh):
        pairs = np.unique(np.stack([v, self.root[h]], axis=1), axis=0) if len(v) else ()
        first: dict[int, int] = {}
        moved = False
        for x, r in pairs:
            r = self._find(r)
            own = first.get(x) if fresh else self._find(at + x)
            if own is None:
                first[x] = r
                yield part[x], self.homes[r]
            elif (own := self._find(own)) != r:
                self.root[max(own, r)] = min(own, r)
                moved = True
                # both: links of this call may have moved either root since the edge to it went out
                yield part[x], self.homes[max(own, r)]
                yield part[x], self.homes[min(own, r)]
        if moved:
            while True:
                up = self.root[self.root]
                if (up == self.root).all():
                    break
                self.root = up

    def _find(self, i):
        while self.root[i] != i:
            i = self.root[i]
        return i


class Split:
    """Into how many groups the homes of an anchor, and into how many hands its visitors, are dealt.

    A shard of an anchor holds one group of homes and streams one hand of visitors. Homes also visit the groups after
    their own, so each pair meets once.
    """

    def __init__(self, sizes: dict[tuple[int, int], int], homes: int, visitors: int):
        self.of = {}
        for a in {a for a, _ in sizes}:
            groups, hands = -(-sizes.get((a, 0), 0) // homes), -(-sizes.get((a, 1), 0) // visitors)
            if max(groups, hands) > 1:
                self.of[a] = max(1, groups), max(1, hands)
        self.split = np.array(sorted(self.of), np.int64)

    def deal(self, anchor: np.ndarray, visitor: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, ...]:
        """(anchor, shard, kind, fp) of every copy; kind 0: a home compared with its group, 1: a home, 2: a visitor."""
        hot = np.isin(anchor, self.split)
        out = [(anchor[~hot], np.zeros((~hot).sum(), np.int64), visitor[~hot] * 2, fp[~hot])]
        mixed = (fp ^ (fp >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(32)
        for a in np.unique(anchor[hot]).tolist():
            groups, hands = self.of[a]
            for seen in (0, 1):
                x = fp[(anchor == a) & (visitor == seen)]
                m = mixed[(anchor == a) & (visitor == seen)]
                own, hand = (m % np.uint64(groups)).astype(np.int64), ((m >> np.uint64(16)) % np.uint64(hands)).astype(np.int64)
                for g in range(groups):
                    visits = np.ones(len(x), bool) if seen else own < g
                    out.append((np.full(visits.sum(), a), g * hands + hand[visits], np.full(visits.sum(), 2), x[visits]))
                    if not seen:
                        here = x[own == g]
                        for d in range(hands):
                            out.append((np.full(len(here), a), np.full(len(here), g * hands + d), np.full(len(here), min(d, 1)), here))
        return tuple(np.concatenate(c) for c in zip(*out, strict=True))


#: Homes of an anchor that one task holds (under 100 bytes each), and visitors that it streams, at most.
MOST_HOMES, MOST_VISITORS = 1 << 18, 1 << 22


def _copies(batches, code: Covering):
    """(anchor, 1 for a visitor, fingerprint) of every copy, a few thousand fingerprints at a time."""
    for batch in batches:
        every = batch.column(0).to_numpy().view(np.uint64)
        for i in range(0, len(every), 2048):
            part = every[i : i + 2048]
            row, anchor, visitor = code.anchors(part)
            yield anchor, visitor, part[row]


def links(fps: DataFrame, n: int, reach: int = 3, blocks: int | None = None, most_homes: int = MOST_HOMES, most_visitors: int = MOST_VISITORS) -> DataFrame:
    """(a, b) edges that connect just the fingerprints of column fp (n distinct ones) that reach bits or fewer link."""
    blocks = blocks or blocks_for(n)

    def count(batches):
        import pyarrow as pa

        for anchor, visitor, _ in _copies(batches, Covering(blocks, reach)):
            key, times = np.unique(anchor * 2 + visitor, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array((key >> 1).astype(np.int32)), pa.array((key & 1).astype(np.int8)), pa.array(times)], names=["anchor", "visitor", "n"])

    def replicate(batches):
        import pyarrow as pa

        for anchor, visitor, fp in _copies(batches, Covering(blocks, reach)):
            anchor, shard, kind, fp = split.deal(anchor, visitor.astype(np.int64), fp)
            yield pa.RecordBatch.from_arrays([pa.array(anchor.astype(np.int32)), pa.array(shard.astype(np.int32)), pa.array(kind.astype(np.int8)), pa.array(fp.view(np.int64))], names=["anchor", "shard", "kind", "fp"])

    def compare(batches):
        import pyarrow as pa

        now, homes, alike, held = None, [], True, None

        def out(edges):
            found = np.array(list(edges), np.uint64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(found[:, k].view(np.int64)) for k in (0, 1)], names=["a", "b"])

        def own():
            nonlocal held
            held = _Anchor(np.concatenate(homes), reach)
            return held.links(held.homes, False) if alike else ()

        for batch in batches:
            anchor, shard, kind, fp = (batch.column(k).to_numpy() for k in range(4))
            fp = fp.view(np.uint64)
            edges = np.flatnonzero((anchor[1:] != anchor[:-1]) | (shard[1:] != shard[:-1]) | (kind[1:] != kind[:-1])) + 1
            for i, j in itertools.pairwise([0, *edges.tolist(), len(fp)]):
                if i == j:
                    continue
                if (anchor[i], shard[i]) != now:
                    if homes and held is None:
                        yield out(own())
                    now, homes, alike, held = (anchor[i], shard[i]), [], kind[i] == 0, None
                if kind[i] < 2:
                    homes.append(fp[i:j])
                elif homes:
                    if held is None:
                        yield out(own())
                    yield out(held.links(fp[i:j], True))
        if homes and held is None:
            yield out(own())

    n_tasks = partitions(fps.sparkSession)
    # a file of fingerprints is small but each is sent many times: deal them out first
    dealt = fps.select("fp").repartition(n_tasks, "fp")
    sizes = {}
    if n > min(most_homes, most_visitors):
        # at most 2 ** blocks anchors, 65536
        counted = dealt.mapInArrow(count, "anchor int, visitor byte, n long").groupBy("anchor", "visitor").agg(F.sum("n").alias("n"))
        sizes = {(r.anchor, r.visitor): r.n for r in counted.collect()}
    split = Split(sizes, most_homes, most_visitors)
    met = dealt.mapInArrow(replicate, "anchor int, shard int, kind byte, fp long").repartition(n_tasks, "anchor", "shard").sortWithinPartitions("anchor", "shard", "kind")
    return met.mapInArrow(compare, "a long, b long")


def near_groups(docs: DataFrame, words: int = 3, reach: int = 3) -> DataFrame:
    """One row per row of docs: doc_id, fp, component_id, file, at (its place)."""
    with scratch(docs.sparkSession):
        rows = materialise(fingerprints(located(docs, "simhash-docs"), words), "simhash", keep=True)
        fps = materialise(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-distinct")
        joined = components(links(fps, fps.count(), reach))
        roots = fps.join(joined.select(F.col("node").alias("fp"), "root"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
        roots = materialise(roots, "simhash-roots")
        least = roots.groupBy("root").agg(F.min("first").alias("component_id"))
        classes = materialise(roots.join(least, "root").select("fp", "component_id"), "simhash-classes", keep=True)
    return rows.join(classes, "fp").select("doc_id", "fp", "component_id", "file", "at")


def keep_one(docs: DataFrame, words: int = 3, reach: int = 3) -> DataFrame:
    """The rows of docs that stay, with all their columns: of each component those with the smallest doc_id.

    Rows go by their place, so only the keys of those that go move.
    """
    columns, docs = docs.columns, located(docs, "simhash-docs")
    gone = materialise(near_groups(docs, words, reach).where("doc_id <> component_id").select("file", "at"), "simhash-gone")
    return docs.join(small(gone), (docs[FILE] == gone["file"]) & (docs[AT] == gone["at"]), "left_anti").select(*(docs[c] for c in columns))


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
