"""Near-duplicate documents: SimHash fingerprints linked through a forest of vantage-point trees.

Two fingerprints within ``max_distance`` bits are, by the pigeonhole rule, within ``max_distance // bands`` bits on
one of ``bands`` equal slices at least. Each slice has its own vantage-point tree over the slice's Hamming space, with
vantage points from a bounded sample. A fingerprint has a home shard (leaf) in each tree and visits every other leaf that the
triangle bound cannot exclude for its ball; inside a shard the visitors meet the home fingerprints and the whole
64-bit distance decides, so no link is lost. Shards with more than ``shard_rows`` home rows are split into salted
blocks that each get all visitors. A block returns a spanning forest of its links, at most one edge a row, so a dense
group never becomes all its pairs. Components are found by the alternating-star method on distinct fingerprints, with
each round written to the shared folder.

Defined cases: a null or empty text has fingerprint zero, linked like any other; fewer words than a shingle are one
shingle; rows equal in everything share a component; null ids are allowed and never name a component unless all its
ids are null; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basisweave.llm.common import first_by_hash, read_table, unused, written


_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


def simhash(text: str | None, width: int = 4, seed: int = 42) -> int:
    """64-bit fingerprint as an unsigned integer; a bit is set if over half of the shingle hashes have it."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    n = max(1, len(words) - width + 1)
    starts = [0, *(ends[: n - 1] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[s:e], seed) for s, e in zip(starts, ends[min(width, len(words)) - 1 :].tolist())], ">u8")
    columns = hashes.view(np.uint8).reshape(n, 8)
    ones = np.stack([np.bincount(columns[:, k], minlength=256) @ _BYTE_BITS for k in range(8)])
    return int.from_bytes(np.packbits(ones * 2 > n, axis=1).tobytes(), "big")


def _signed(values: list[int]) -> np.ndarray:
    return np.array(values, np.uint64).view(np.int64)


def fingerprints(docs: DataFrame, text_col: str = "text", width: int = 4) -> DataFrame:
    """``docs`` with the text replaced by ``fp``, the fingerprint as a signed long."""
    keep = [c for c in docs.columns if c != text_col]
    schema = docs.select(*keep).withColumn("fp", F.lit(0).cast("long")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = pa.array(_signed([simhash(t, width) for t in b.column(text_col).to_pylist()]), pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), fp], names=[*keep, "fp"])

    return docs.mapInArrow(run, schema)


@dataclass
class VantageTree:
    """A vantage-point tree over ``bits``-wide values: inner node i has children 2i+1 (near) and 2i+2 (far)."""

    bits: int
    depth: int
    vantage: np.ndarray
    cut: np.ndarray

    @classmethod
    def fit(cls, sample: np.ndarray, bits: int, depth: int, seed: int = 7) -> VantageTree:
        """Each node's vantage point is the one of eight sampled values whose distances spread most; its cut is the median distance."""
        rng = np.random.default_rng(seed)
        vantage, cut = np.zeros(2**depth - 1, np.uint64), np.full(2**depth - 1, bits // 2, np.int64)
        held = {0: np.asarray(sample, np.uint64)}
        for node in range(2**depth - 1):
            own = held.pop(node, np.zeros(0, np.uint64))
            if len(own):
                tries = own[rng.integers(0, len(own), 8)]
                spread = [np.bitwise_count(own ^ v).std() for v in tries]
                vantage[node] = tries[int(np.argmax(spread))]
                d = np.bitwise_count(own ^ vantage[node]).astype(np.int64)
                cut[node] = int(np.median(d))
                held[2 * node + 1], held[2 * node + 2] = own[d <= cut[node]], own[d > cut[node]]
            else:  # no sampled value came here: any point will do
                vantage[node] = rng.integers(0, 2**bits, dtype=np.uint64)
        return cls(bits, depth, vantage, cut)

    def route(self, values: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) of every leaf that the ball around each value may reach; radius 0 gives the home leaf."""
        rows, nodes = np.arange(len(values)), np.zeros(len(values), np.int64)
        for _ in range(self.depth):
            d = np.bitwise_count(values[rows] ^ self.vantage[nodes]).astype(np.int64)
            near, far = d - radius <= self.cut[nodes], d + radius > self.cut[nodes]
            rows, nodes = np.concatenate((rows[near], rows[far])), np.concatenate((2 * nodes[near] + 1, 2 * nodes[far] + 2))
        return rows, nodes - (2**self.depth - 1)

    def visit_table(self, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For all 2^bits slice values: the home leaf, and the leaves that the triangle bounds leave to visit, as offsets and values."""
        values = np.arange(2**self.bits, dtype=np.uint64)
        rows, leaves = self.route(values, 0)
        home = np.empty(len(values), np.int32)
        home[rows] = leaves
        rows, leaves = self.route(values, radius)
        order = np.argsort(rows, kind="stable")
        return home, np.searchsorted(rows[order], np.arange(len(values) + 1)), leaves[order].astype(np.int32)


def slices(fps: np.ndarray, bands: int) -> list[np.ndarray]:
    """The fingerprints' equal slices, as unsigned values."""
    bits = 64 // bands
    u = fps.view(np.uint64)
    return [(u >> np.uint64(k * bits)) & np.uint64(2**bits - 1) for k in range(bands)]


def spanning_links(home: np.ndarray, label: np.ndarray, visitors: np.ndarray, max_distance: int) -> tuple[list[int], list[int]]:
    """Edges that connect what the links between ``visitors`` and ``home`` connect; ``label`` (updated) names each home's tree root.

    An edge may lead to a tree's root rather than to the linked fingerprint itself.
    """
    a: list[int] = []
    b: list[int] = []
    step = max(1, 2_000_000 // max(1, len(home)))
    for at in range(0, len(visitors), step):
        part = visitors[at : at + step]
        v_at, h_at = np.nonzero(np.bitwise_count(part[:, None] ^ home[None, :]) <= max_distance)
        if not len(v_at):
            continue
        cuts = np.flatnonzero(np.diff(v_at)) + 1
        for v, hits in zip(part[v_at[np.concatenate(([0], cuts))]].tolist(), np.split(h_at, cuts)):
            labels = label[hits]
            first = int(labels[0])
            if home[first] != v:
                a.append(v)
                b.append(int(home[first]))
            if len(hits) > 1 and (labels != first).any():
                for other in np.unique(labels[labels != first]).tolist():
                    a.append(int(home[other]))
                    b.append(int(home[first]))
                    label[label == other] = first
    return a, b


def _runs(starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, position) of every position in the runs that begin at ``starts``."""
    rows = np.repeat(np.arange(len(lengths)), lengths)
    return rows, np.arange(len(rows)) - np.repeat(np.cumsum(lengths) - lengths, lengths) + np.repeat(starts, lengths)


_SHARD_ROWS = "shard int, salt int, visit boolean, fp long"


def similarity_links(fps: DataFrame, max_distance: int = 4, bands: int = 4, shard_rows: int = 512, block_rows: int = 4096, sample_rows: int = 8192) -> DataFrame:
    """Edges (a, b) over the distinct ``fp`` of ``fps`` that connect whatever links within ``max_distance`` connect."""
    spark = fps.sparkSession
    n = fps.count()
    sample = np.array([r[0] for r in first_by_hash(fps, sample_rows, "fp").collect()], np.int64)
    bits, radius = 64 // bands, max_distance // bands
    depth = int(np.clip(np.ceil(np.log2(max(1, n / shard_rows))), 0, min(bits - 2, 14)))
    trees = [VantageTree.fit(s, bits, depth, seed=k) for k, s in enumerate(slices(sample, bands))]

    # 2^bits values a tree, whatever the input: bounded by the slice width.
    tables = spark.sparkContext.broadcast([t.visit_table(radius) for t in trees])

    def home_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(bands << depth, np.int64)
        for b in batches:
            for k, s in enumerate(slices(b.column(0).to_numpy(), bands)):
                counts += np.bincount((k << depth) + tables.value[k][0][s], minlength=bands << depth)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(counts[at], pa.int64())], names=["shard", "n"])

    # At most bands x 2^depth rows: the size of the trees, fixed beforehand.
    sizes = fps.mapInArrow(home_counts, "shard int, n long").groupBy("shard").agg(F.sum("n").alias("n")).where(F.col("n") > block_rows).collect()
    blocks = np.ones(bands << depth, np.int64)
    for r in sizes:
        blocks[r["shard"]] = -(-r["n"] // block_rows)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = b.column(0).to_numpy()
            for at in range(0, len(fp), 8192):
                part = fp[at : at + 8192]
                mixed = (part.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
                for k, s in enumerate(slices(part, bands)):
                    homes, offsets, leaves = tables.value[k]
                    home = (k << depth) + homes[s]
                    salt = (mixed % blocks[home].astype(np.uint64)).astype(np.int64)
                    rows, at_leaf = _runs(offsets[s], offsets[s + np.uint64(1)] - offsets[s])
                    shard = (k << depth) + leaves[at_leaf]
                    again, salts = _runs(np.zeros(len(shard), np.int64), blocks[shard])
                    rows, shard = rows[again], shard[again]
                    own = (shard == home[rows]) & (salts == salt[rows])
                    yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), pa.array(salts, pa.int32()), pa.array(~own), pa.array(part[rows], pa.int64())], names=["shard", "salt", "visit", "fp"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, homes, label = None, [], None
        home = np.zeros(0, np.uint64)
        for b in batches:
            shard, salt = b.column(0).to_numpy(), b.column(1).to_numpy()
            visit, fp = b.column(2).to_numpy(zero_copy_only=False), b.column(3).to_numpy().view(np.uint64)
            cuts = np.flatnonzero((np.diff(shard) != 0) | (np.diff(salt) != 0) | (np.diff(visit.astype(np.int8)) != 0)) + 1
            a: list[int] = []
            c: list[int] = []
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(fp)]):
                if hi == lo:
                    continue
                if (shard[lo], salt[lo]) != key:
                    key, homes, label = (shard[lo], salt[lo]), [], None
                if not visit[lo]:
                    homes.append(fp[lo:hi])
                    home = np.concatenate(homes)
                    grown = np.arange(len(home))
                    if label is not None:
                        grown[: len(label)] = label
                    label = grown
                elif label is None:
                    continue
                x, y = spanning_links(home, label, fp[lo:hi], max_distance)
                a += x
                c += y
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(np.array(a, np.uint64).view(np.int64)), pa.array(np.array(c, np.uint64).view(np.int64))], names=["a", "b"])

    routed = fps.mapInArrow(route, _SHARD_ROWS).repartition("shard", "salt").sortWithinPartitions("shard", "salt", "visit")
    found = routed.mapInArrow(meet, "a long, b long")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): root is the smallest node connected. Alternating stars."""
    edges = written(edges.select("a", "b"), "edges")
    for _ in range(max_rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("low"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).where("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        floor = down.groupBy("a").agg(F.min("b").alias("low"))
        small = down.join(floor, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("low").alias("b")), F.struct("a", F.col("low").alias("b")))).alias("e")).select("e.a", "e.b").where("a <> b")
        after = written(small.distinct(), "edges")
        was, now = (x.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first() for x in (edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), after))
        edges = after
        if was == now:
            break
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, max_distance: int = 4, **search) -> DataFrame:
    """(id, fp, component) per row: component is the smallest id reachable through links, itself included."""
    own = written(fingerprints(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "text", width), "fingerprints")
    distinct = written(own.groupBy("fp").agg(F.min("id").alias("id")), "distinct-fingerprints")
    roots = written(components(similarity_links(distinct.select("fp"), max_distance, **search)), "roots")
    labelled = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "id", F.coalesce("root", "fp").alias("root"))
    least = labelled.groupBy("root").agg(F.min("id").alias("component"))
    named = labelled.join(least, "root").select("fp", "component")
    return own.join(named, "fp").select("id", "fp", "component")


def shingle_set(text: str | None, width: int) -> set:
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    return set(zip(*(w[k:] for k in range(width)))) if len(w) >= width else {tuple(w)}


def _led(members: DataFrame, width: int, least: float) -> DataFrame:
    """``members`` (g, block, n, rid, id, text) to (g, n, rid, same): in each block, in order of id, a row is the same as an
    earlier one that is not if their shingle sets' Jaccard similarity is ``least`` or more; else it leads from there on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, texts, leads = None, set(), []
        for b in batches:
            same = []
            for g, block, text in zip(b.column("g").to_pylist(), b.column("block").to_pylist(), b.column("text").to_pylist()):
                if (g, block) != key:
                    key, texts, leads = (g, block), set(), []
                found = text in texts
                if not found:
                    own = shingle_set(text, width)
                    for other in leads:
                        if least * len(own) <= len(other) and least * len(other) <= len(own):
                            both = len(own & other)
                            if both >= least * (len(own) + len(other) - both):
                                found = True
                                break
                    else:
                        texts.add(text)
                        leads.append(own)
                same.append(found)
            yield pa.RecordBatch.from_arrays([b.column("g"), b.column("n"), b.column("rid"), pa.array(same, pa.bool_())], names=["g", "n", "rid", "same"])

    ordered = members.repartition("g", "block").sortWithinPartitions("g", "block", F.col("id").isNull(), "id", "rid")
    return ordered.select("g", "block", "n", "rid", "text").mapInArrow(run, "g long, n long, rid long, same boolean")


_ODD = np.uint64(0x9E3779B97F4A7C15)
_BUCKETS = 1 << 18


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """The distinct 64-bit hashes of the shingles of ``shingle_set``, sorted."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    own = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    n = max(1, len(words) - width + 1)
    out = np.full(n, min(len(words), width), np.uint64)
    for k in range(min(width, len(words))):
        out = (out ^ own[k : k + n]) * _ODD
        out ^= out >> np.uint64(29)
    return np.unique(out)


def prefix_tokens(rows: DataFrame, width: int, least: float) -> DataFrame:
    """``rows`` (rid, text) to (token, rid, n, pos): of each row's n shingles in a common order, those at the front, so many
    that two rows of similarity ``least`` share one. Any order is right; shingles of full hash buckets come last."""
    spark = rows.sparkSession

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(_BUCKETS, np.int64)
        for b in batches:
            for t in b.column(0).to_pylist():
                np.add.at(n, (shingle_hashes(t, width) % np.uint64(_BUCKETS)).astype(np.int64), 1)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(n[at])], names=["bucket", "n"])

    # At most _BUCKETS rows, whatever the input.
    found = rows.select("text").mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    full = np.zeros(_BUCKETS, np.int64)
    full[found["bucket"].to_numpy()] = found["n"].to_numpy()
    counts = spark.sparkContext.broadcast(full)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            tokens, sizes, lengths = [np.zeros(0, np.uint64)], [], []
            for t in b.column("text").to_pylist():
                own = shingle_hashes(t, width)
                n = len(own)
                front = n - int(np.ceil(least * n - 1e-9)) + 1
                order = np.argsort(counts.value[(own % np.uint64(_BUCKETS)).astype(np.int64)], kind="stable")
                tokens.append(own[order[:front]])
                sizes.append(n)
                lengths.append(min(front, n))
            at, pos = _runs(np.zeros(len(lengths), np.int64), np.array(lengths, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens).view(np.int64)), pa.array(b.column("rid").to_numpy()[at]), pa.array(np.array(sizes, np.int32)[at]), pa.array(pos.astype(np.int32))], names=["token", "rid", "n", "pos"])

    return rows.select("rid", "text").mapInArrow(run, "token long, rid long, n int, pos int")


def similar_pairs(rows: DataFrame, width: int, least: float, block_rows: int = 512) -> DataFrame:
    """(lo, hi) of all pairs of ``rows`` (rid, id, text) whose Jaccard similarity is ``least`` or more; lo is first by id.

    Exact: a prefix-filter join proposes the pairs and the shingle sets decide. A token with more than ``block_rows``
    rows is cut into blocks, and each pair of blocks meets under a key of its own.
    """
    tokens = written(prefix_tokens(rows, width, least), "prefix-tokens")
    shared = written(tokens.groupBy("token").agg(F.count(F.lit(1)).alias("k")).where("k > 1"), "shared-tokens")
    blocks = F.ceil(F.col("k") / block_rows).cast("int")
    dealt = tokens.join(shared, "token").withColumn("blocks", blocks).withColumn("o", F.pmod(F.xxhash64("rid"), F.col("blocks")).cast("int"))
    dealt = dealt.select("token", "rid", "n", "pos", "o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("j"))
    dealt = written(dealt.select("token", F.least("o", "j").alias("x"), F.greatest("o", "j").alias("y"), "rid", "n", "pos", "o"), "dealt-tokens")
    a, b = (dealt.select("token", "x", "y", *(F.col(c).alias(f"{c}_{side}") for c in ("rid", "n", "pos", "o"))) for side in "ab")
    need = F.lit(least / (1 + least)) * (F.col("n_a") + F.col("n_b")) - 1e-6
    met = a.join(b.hint("merge"), ["token", "x", "y"]).where((F.col("rid_a") < F.col("rid_b")) & ((F.col("x") == F.col("y")) | (F.col("o_a") != F.col("o_b"))) & (F.least(F.col("n_a") - F.col("pos_a"), F.col("n_b") - F.col("pos_b")) >= need))
    pairs = written(met.select("rid_a", "rid_b").distinct(), "near-candidates")
    texts = lambda side: rows.select(*(F.col(c).alias(f"{c}_{side}") for c in ("rid", "id", "text")))
    full = pairs.join(texts("a"), "rid_a").join(texts("b"), "rid_b")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("text_a").to_pylist(), batch.column("text_b").to_pylist()):
                x, y = shingle_set(x, width), shingle_set(y, width)
                both = len(x & y)
                keep.append(both >= least * (len(x) + len(y) - both))
            yield batch.select(["rid_a", "rid_b", "first"]).filter(pa.array(keep, pa.bool_()))

    key = lambda side: F.struct(F.col(f"id_{side}").isNull(), F.col(f"id_{side}"), F.col(f"rid_{side}"))
    sure = full.withColumn("first", key("a") < key("b")).select("rid_a", "rid_b", "first", "text_a", "text_b").mapInArrow(verify, "rid_a long, rid_b long, first boolean")
    return sure.select(F.when(F.col("first"), F.col("rid_a")).otherwise(F.col("rid_b")).alias("lo"), F.when(F.col("first"), F.col("rid_b")).otherwise(F.col("rid_a")).alias("hi"))


def followers(pairs: DataFrame, by_id_rounds: int = 16) -> DataFrame:
    """The rids to drop so that no pair (lo, hi) stays whole and each dropped rid has a kept partner.

    Each round keeps the rids that come first in all their pairs and drops their partners. The first rounds go by id; what long
    chains leave goes by hash, which settles in logarithmic rounds.
    """
    left, gone, turn = written(pairs, "near-pairs"), [], 0
    while not gone or left.take(1):
        if turn == by_id_rounds:
            swap = F.xxhash64(F.lit(1), "lo") > F.xxhash64(F.lit(1), "hi")
            left = written(left.select(F.when(swap, F.col("hi")).otherwise(F.col("lo")).alias("lo"), F.when(swap, F.col("lo")).otherwise(F.col("hi")).alias("hi")), "near-pairs")
        later = left.select(F.col("hi").alias("lo")).distinct()
        out = written(left.join(later, "lo", "left_anti").select(F.col("hi").alias("rid")).distinct(), "near-followers")
        gone.append(out)
        left = written(left.join(out.withColumnRenamed("rid", "lo"), "lo", "left_anti").join(out.withColumnRenamed("rid", "hi"), "hi", "left_anti").select("lo", "hi"), "near-pairs")
        turn += 1
    dropped = gone[0]
    for g in gone[1:]:
        dropped = dropped.unionByName(g)
    return dropped


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: float = 0.8, max_distance: int = 7, block_rows: int = 512, **search) -> DataFrame:
    """``docs`` without the rows that repeat an earlier id's text at ``similarity`` or more.

    Groups are proposed by equal fingerprints first, then by fingerprint components. A group is dealt by hash into
    blocks of about ``block_rows`` rows; in a block the rows are taken by id, and one that reaches the similarity with
    an earlier kept one goes. What is left of a group of several blocks is dealt anew as long as a turn drops over
    a tenth of it; blocks never grow. So every dropped row was as similar as asked to a row that stayed in its turn.
    Fingerprints within ``max_distance`` miss pairs and blocks part them, so an exact join then finds all pairs among the
    rows that are left: no two rows that stay reach the similarity.
    """
    kept_columns, number = docs.columns, unused(docs.columns, "rid")
    base = written(docs.withColumn(number, F.monotonically_increasing_id()), "numbered")
    own = base.select(F.col(number).alias("rid"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    marked = written(near_duplicates(own.select("rid", "text"), "rid", "text", width, max_distance, **search).select(F.col("id").alias("rid"), "fp", "component"), "near-groups")
    gone: list[DataFrame] = []
    turn = 0
    for by in ("fp", "component"):
        left = marked.select("rid", F.col(by).alias("g"))
        for g in gone:
            left = left.join(g, "rid", "left_anti")
        while True:
            sizes = left.groupBy("g").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
            dealt = left.join(sizes, "g").withColumn("block", F.pmod(F.xxhash64(F.lit(turn), "rid"), F.ceil(F.col("n") / block_rows)))
            verdict = written(_led(dealt.join(own, "rid"), width, similarity), "near-verdicts")
            gone.append(verdict.where("same").select("rid"))
            turn += 1
            shrunk = verdict.where(F.col("n") > block_rows).groupBy("g").agg(F.count_if("same").alias("n_same"), F.max("n").alias("n")).where("10 * n_same > n").select("g")
            more = verdict.where(~F.col("same")).join(shrunk, "g").select("rid", "g")
            if not more.take(1):
                break
            left = more
    survivors = own
    for g in gone:
        survivors = survivors.join(g, "rid", "left_anti")
    gone.append(followers(similar_pairs(written(survivors, "near-survivors"), width, similarity, block_rows)))
    dropped = gone[0]
    for g in gone[1:]:
        dropped = dropped.unionByName(g)
    return base.join(dropped.withColumnRenamed("rid", number), number, "left_anti").select(*kept_columns)


def op2_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(read_table(spark, sf_dir, "documents"), width=4, max_distance=4)
    return out.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))
