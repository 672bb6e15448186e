import random
import re

import numpy as np
import xxhash

from basisweave.llm import simhash_dedup
from basisweave.llm.simhash_dedup import VantageTree, drop_near_duplicates, followers, near_duplicates, shingle_set, similarity_links, simhash


def slow_hash(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[k : k + 4]).encode(), 42) for k in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(n, linked):
    label = list(range(n))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in linked:
        a, b = root(a), root(b)
        label[max(a, b)] = min(a, b)
    return [root(k) for k in range(n)]


def test_fingerprint_against_slow():
    rng = random.Random(3)
    for text in [None, "", " \t", "A", "a B c", "É É ß", *(" ".join(rng.choices(["Foo", "bar", "b", "é"], k=k)) for k in range(1, 40))]:
        assert simhash(text) == slow_hash(text)


def test_tree_visits_every_ball():
    rng = np.random.default_rng(2)
    tree = VantageTree.fit(rng.integers(0, 2**10, 500, dtype=np.uint64), 10, 4)
    home, offsets, leaves = tree.visit_table(1)
    for v in range(2**10):
        near = {int(home[v])} | {int(home[v ^ (1 << k)]) for k in range(10)}
        assert near <= set(leaves[offsets[v] : offsets[v + 1]].tolist())
    assert len(leaves) < 0.6 * 2**10 * 2**4  # and the triangle bounds prune
    rows, found = tree.route(np.arange(2**10, dtype=np.uint64), 2)
    reach = {v: set() for v in range(2**10)}
    for a, b in zip(rows.tolist(), found.tolist()):
        reach[a].add(b)
    assert all(int(home[v ^ 3]) in reach[v] for v in range(2**10))


def test_links_connect_what_brute_force_connects(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    flips = [np.uint64(sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 7), replace=False))) for _ in range(900)]
    fps = np.unique(np.array([base[k % 40] ^ f for k, f in enumerate(flips)] + [np.uint64(0), np.uint64(2**64 - 1)]))
    df = spark.createDataFrame([(int(v),) for v in fps.view(np.int64)], "fp long")
    # Small shards and blocks, so that splitting and salting take part.
    edges = similarity_links(df, shard_rows=16, block_rows=8, sample_rows=200).collect()
    at = {int(v): k for k, v in enumerate(fps.view(np.int64))}
    near = [(i, j) for i in range(len(fps)) for j in np.flatnonzero(np.bitwise_count(fps[i] ^ fps) <= 4).tolist() if i < j]
    assert len(edges) < 8 * len(fps)
    assert groups(len(fps), near) == groups(len(fps), [(at[e.a], at[e.b]) for e in edges])


def test_components_of_rows(make_docs):
    text = " ".join(f"w{k}" for k in range(200))
    rows = [(9, text), (4, text), (4, text), (5, text.upper()), (6, "other words here and there"), (7, None), (8, ""), (None, text)]
    got = [(r.id, r.component) for r in near_duplicates(make_docs(rows)).collect()]
    assert len(got) == len(rows)
    assert dict((i, c) for i, c in got if i is not None) == {9: 4, 4: 4, 5: 4, 6: 6, 7: 7, 8: 7}
    assert near_duplicates(make_docs([])).count() == 0


def test_stage_keeps_one_of_each_group(make_docs):
    rng = random.Random(1)
    word = lambda: "".join(rng.choices("abcdefgh", k=6))
    texts = [[word() for _ in range(300)] for _ in range(6)]
    rows = []
    for k, t in enumerate(texts):
        for copy in range(4):
            changed = list(t)
            for _ in range(copy):
                changed[rng.randrange(300)] = word()
            rows.append((10 * k + copy, " ".join(changed)))
    small = {r.doc_id for r in drop_near_duplicates(make_docs(rows + [(200 + k, rows[0][1]) for k in range(40)]), block_rows=3).collect()}
    kept = {r.doc_id for r in drop_near_duplicates(make_docs(rows, fp="x", component=1)).collect()}
    assert small == kept
    assert {10 * k for k in range(6)} <= kept
    sets = {i: shingle_set(t, 5) for i, t in rows}
    similar = lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    assert all(any(similar(i, k) for k in kept) for i in sets if i not in kept)
    assert len(kept) <= 8


def test_stage_leaves_no_similar_pair(make_docs):
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdefgh", k=6))
    rows = []
    for k in range(24):  # pairs just above and just below the similarity: fingerprints mostly further apart than 7 bits
        t = [word() for _ in range(300)]
        for copy, changes in enumerate((0, 5, 6, 8)):
            changed = list(t)
            for c in range(changes):
                changed[7 + (290 // max(1, changes)) * c + copy] = word()
            rows.append((10 * k + copy, " ".join(changed)))
    rows += [(900, ""), (901, "a b"), (902, "a  B"), (None, rows[0][1])]
    sets = {i: shingle_set(t, 5) for i, t in rows[:-1]}
    similar = lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    far = [i for i in sets if i % 10 == 1 and i < 900 and similar(i, i - 1) and (simhash(rows[i // 10 * 4][1], 5) ^ simhash(rows[i // 10 * 4 + 1][1], 5)).bit_count() > 7]
    assert far  # the search by fingerprints alone has pairs to miss
    for block in (512, 2):
        kept = [r.doc_id for r in drop_near_duplicates(make_docs(rows), block_rows=block).collect()]
        assert None not in kept
        assert not [(a, b) for a in kept for b in kept if a < b and similar(a, b)]
        assert all(any(similar(i, k) for k in kept) for i in sets if i not in kept)


def test_followers_of_a_long_chain(spark):
    chain = spark.createDataFrame([(k, k + 1) for k in range(99)], "lo long, hi long")
    gone = {r.rid for r in followers(chain, by_id_rounds=3).collect()}
    assert all(k in gone or k + 1 in gone for k in range(99))
    assert all((k > 0 and k - 1 not in gone) or (k < 99 and k + 1 not in gone) for k in gone)


def test_stage_blocks_stay_bounded(make_docs, monkeypatch):
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abcdefgh", k=6))
    base = [word() for _ in range(300)]
    rows = []
    for k in range(120):  # a template with fields: one component, every pair far below 0.8 but a few
        t = list(base)
        for at in range(0, 300, 12):
            t[at] = word()
        rows.append((k, " ".join(t)))
    rows += [(500 + k, rows[7 * k][1] + " end") for k in range(5)]
    seen = []

    def watched(members, width, least, led=simhash_dedup._led):
        seen.extend(r["count"] for r in members.groupBy("g", "block").count().collect())
        return led(members, width, least)

    monkeypatch.setattr(simhash_dedup, "_led", watched)
    # With so wide a distance all are one component.
    kept = {r.doc_id for r in drop_near_duplicates(make_docs(rows), block_rows=8, max_distance=31).collect()}
    assert sum(seen) >= len(rows) and max(seen) <= 24
    assert kept == set(range(120))


def test_query_against_brute_force(spark, small_tables):
    """Hexadecimal form, the sign bit, ties and components of the whole query."""
    docs = spark.read.parquet(f"{small_tables}/documents.parquet").select("doc_id", "text").collect()
    prints = [slow_hash(r.text) for r in docs]
    ids = [r.doc_id for r in docs]
    label = groups(len(docs), [(a, b) for a in range(len(docs)) for b in range(a) if bin(prints[a] ^ prints[b]).count("1") <= 4])
    least = {}
    for g, i in zip(label, ids):
        if i is not None:
            least[g] = min(least.get(g, i), i)
    got = simhash_dedup.op2_simhash_dedup(spark, small_tables)
    assert got.columns[:3] == ["doc_id", "fingerprint", "component_id"]
    want = [(i, f"{p:016x}", least.get(g)) for i, p, g in zip(ids, prints, label)]
    assert sorted(((r.doc_id, r.fingerprint, r.component_id) for r in got.collect()), key=str) == sorted(want, key=str)
    assert any(p >> 63 for p in prints) and len(set(label)) < len(docs)
