import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from gridspan.llm import simhash as S
from gridspan.llm.components import connected_components


def brute_fingerprint(text, width=3):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_classes(ids, prints, most=3):
    parent = {i: i for i in range(len(ids))}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= most:
                parent[root(i)] = root(j)
    groups = {}
    for i in range(len(ids)):
        groups.setdefault(root(i), []).append(ids[i])
    return {i: min(g) for g in groups.values() for i in g}


def test_fingerprints_match_the_definition():
    rng = random.Random(1)
    for n in (0, 1, 2, 3, 4, 50, 400):
        text = " ".join(rng.choice(["Ab", "cd", "É", "x\ty", "Z"]) for _ in range(n))
        assert int.from_bytes(S.text_sketch(text, 3, 1)[1], "big") == brute_fingerprint(text)


def test_pieces_do_not_change_the_sketch(monkeypatch):
    text = " ".join(f"w{i % 37}" for i in range(5000))
    whole = S.text_sketch(text, 3, 2)
    monkeypatch.setattr(S, "_PIECE", 50)
    pieces = S.word_pieces
    monkeypatch.setattr(S, "word_pieces", lambda d: pieces(d, 50))
    assert S.text_sketch(text, 3, 2) == whole


def test_slices_are_bits_of_the_sketch():
    words = np.random.default_rng(2).integers(0, 2**63, (20, 8), dtype=np.uint64)
    for cut in (S.Slice(0, 20, 1), S.Slice(500, 20, 1), S.Slice(505, 27, 1, 3), S.Slice(13, 34, 1, 7)):
        for row, code in zip(words, cut.codes(words), strict=True):
            bits = "".join(f"{int(w):064b}" for w in row)
            assert int(code) == int("".join(bits[(cut.first + i * cut.step) % 512] for i in range(cut.bits)), 2)


def test_tables_grow_with_the_rows_and_keep_their_share():
    for n in (1, 10**5, 10**7, 10**9):
        tables = S.near_tables(n, 0.8)
        assert S.found_share(tables, 0.8) >= 0.988 and all(2 ** t.bits >= n and t.radius == 1 for t in tables)
        places = {tuple((t.first + i * t.step) % 512 for i in range(t.bits)) for t in tables}
        assert len(places) == len(tables)
    assert len(S.near_tables(10**5, 0.8)) == 24


def test_strided_tables_propose_what_they_should():
    """Pairs of sketches with independent differing bits: the share that some table brings together is the one that was counted on."""
    rng = np.random.default_rng(6)
    p = S._bit_differs(0.8)
    a = rng.integers(0, 2, (3000, 512)).astype(np.uint8)
    b = a ^ (rng.random(a.shape) < p)
    words = [np.packbits(x, axis=1).view(">u8").astype(np.uint64) for x in (a, b)]
    tables = S.near_tables(10**8, 0.8)
    near = np.zeros(3000, bool)
    for t in tables:
        near |= np.bitwise_count(t.codes(words[0]) ^ t.codes(words[1])) <= 1
    assert len(tables) > 80 and near.mean() > 0.98


def test_classes_match_brute_force(spark):
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(120)]
    prints = base + [b ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(5))) % 2**64 for b in base * 3]
    prints += [prints[5]] * 30 + [0] * 4
    nodes = sorted(set(prints))
    df = spark.createDataFrame([(p.to_bytes(8, "big"),) for p in nodes], "sketch binary")
    for rows in (16, 10_000):
        edges = S.near_edges(df, [S.Slice(0, 32, 1), S.Slice(32, 32, 1)], 3, 1, shard_rows=rows, hot_factor=1)
        got = {int.from_bytes(r["node"], "big"): int.from_bytes(r["component"], "big") for r in connected_components(edges).collect()}
        want = {p: c for p, c in brute_classes(nodes, nodes).items()}
        assert {p: got.get(p, p) for p in nodes} == want


def test_a_dense_ball_is_one_class_without_pairs():
    centre = np.uint64(0x0123456789ABCDEF)
    words = np.unique(np.array([centre] + [centre ^ np.uint64(1 << i | 1 << j) for i in range(64) for j in range(i)], np.uint64)).reshape(-1, 1)
    parent = S.join_shard(words, np.zeros(len(words), bool), S.Slice(0, 32, 1), 3, False)
    other = S.join_shard(words, np.zeros(len(words), bool), S.Slice(32, 32, 1), 3, False)
    forest = S._Forest(len(words))
    for p in (parent, other):
        forest.link(np.arange(len(words)), p)
    assert set(forest.parent) == {0}


def test_rows_of_every_kind(spark):
    rows = [(4, "a b c d", 1), (2, "A B C D", 1), (9, None, 1), (7, "", 1), (None, "a b c d", 1), (2, "A B C D", 1), (3, "x " * 60_000, 1), (5, " \n ", 1), (11, None, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, component int").withColumn("sketch", F.lit(0)).withColumn("id", F.lit("q"))
    got = S.simhash_classes(df).collect()
    assert len(got) == len(rows)
    want = {4: 2, 2: 2, None: 2, 9: 5, 7: 5, 5: 5, 11: 5, 3: 3}
    assert {r["id"]: r["component"] for r in got} == want
    assert S.simhash_classes(df.limit(0)).collect() == []


def test_near_duplicates_keep_one(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    docs = [(i, " ".join(word() for _ in range(300))) for i in range(40)]
    for i in range(0, 40, 2):
        words = docs[i][1].split()
        words[rng.randrange(300)] = "changed"
        words[rng.randrange(300)] = "altered"
        docs.append((100 + i, " ".join(words)))
    docs.append((200, docs[1][1]))
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("extra", F.lit(1))
    kept = S.keep_one(df)
    assert kept.columns == df.columns
    assert {r["doc_id"] for r in kept.collect()} == set(range(40))


def test_components_of_chains_and_hubs(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 50)] + [(7, 7), (None, 3), (200, 201), (200, 201)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {100 + i: 100 for i in range(50)} | {200: 200, 201: 200}
    assert connected_components(spark.createDataFrame([], "a long, b long")).collect() == []


def brute_near(texts, similarity=0.8):
    """id -> least id of its class, by exact Jaccard similarity of five-word shingle sets; texts: id -> text."""
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, t in texts.items() for w in [(t or "").encode().lower().split()]}
    parent = {i: i for i in texts}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in texts:
        for j in texts:
            if j < i and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= similarity:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in texts}


def repeated_lines(seed=5):
    """Texts of own words that share a line repeated often; others that repeat their own beginning; and altered copies."""
    rng = random.Random(seed)
    words = lambda n: ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n)]
    texts = []
    for times in (10, 20, 40):
        line = words(12)
        texts += [words(100) + line * times for _ in range(8)]
    for n in (60, 150):
        for _ in range(8):
            w = words(n)
            texts += [w, w + w[:12] * 6]
    for changes in (1, 3, 5, 8):
        for _ in range(6):
            w = words(200)
            v = list(w)
            for k in rng.sample(range(200), changes):
                v[k] = "changed"
            texts += [w, v]
    return {i: " ".join(w) for i, w in enumerate(texts)}


def test_near_duplicates_are_decided_by_the_sets(spark, monkeypatch):
    texts = repeated_lines()
    want = brute_near(texts)
    assert 0 < len(set(want.values())) < len(texts)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for sets in (512, 3):
        monkeypatch.setattr(S, "BLOCK_SETS", sets, raising=False)
        assert {r["id"]: r["component"] for r in S.near_duplicate_classes(df).collect()} == want
        assert {r["doc_id"] for r in S.keep_one(df).collect()} == set(want.values())


def test_clean_rows_stay_whatever_their_id(spark):
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(40)) for x in "abcd")
    rows = [(1, a, "p"), (1, b, "q"), (None, c, "r"), (None, c, "s"), (None, a, "t"), (None, d, "u"), (7, a, "v")]
    df = spark.createDataFrame(rows, "doc_id long, text string, `the rest` string")
    kept = S.keep_one(df)
    assert kept.columns == df.columns
    got = kept.collect()
    assert len(got) == 4
    assert {(r[0], r[1]) for r in got} == {(1, a), (1, b), (None, c), (None, d)}
    assert all(tuple(r) in rows for r in got)
