"""Operators 1 and 6 against brute force."""

import random
import re

import numpy as np
import pytest
import xxhash

from pathloom.llm import components, nearcopies, simhash, substring

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_fingerprint(text, n):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    shingles = [" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(values, linked):
    root = {v: v for v in values}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    values = sorted(values)
    for i, a in enumerate(values):
        for b in values[:i]:
            if linked(a, b):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {v: find(v) for v in values}


def test_op1_equals_brute_force(docs, corpus, none):
    for n in (3, 5):
        prints = {i: brute_fingerprint(t, n) for i, t in corpus}
        expected = brute_components(prints, lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 2)
        rows = simhash.near_duplicates(docs, shingle=n).collect()
        assert {r["doc_id"]: (r["fp"] % (1 << 64), r["component_id"]) for r in rows} == {i: (prints[i], expected[i]) for i in prints}
    assert len(set(expected.values())) < len(expected)
    assert simhash.near_duplicates(none).count() == 0


def test_op1_null_ids_and_repeats(spark):
    docs = spark.createDataFrame([(5, "a b c"), (5, "a b c"), (None, "a b c"), (None, "x"), (3, None), (4, "")], "doc_id long, text string")
    got = sorted(((r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(docs).collect()), key=str)
    assert got == sorted([(5, 5), (5, 5), (None, 5), (None, None), (3, 3), (4, 3)], key=str)


@pytest.mark.parametrize("most", [1, 64])
def test_near_pairs_lose_no_link(spark, most):
    """Chains and balls of fingerprints, by pairs and by the way for large buckets."""
    pick = random.Random(4)
    values = {0, (1 << 64) - 1}
    for _ in range(5):
        x = pick.getrandbits(64)
        for _ in range(40):
            values.add(x)
            for b in pick.sample(range(64), pick.randint(1, 3)):
                x ^= 1 << b
    ball = pick.getrandbits(64)
    values |= {ball ^ 1 << a for a in range(64)} | {ball ^ 1 << a ^ 1 << (a * 7 % 64) for a in range(64)}
    frame = spark.createDataFrame([(simhash.signed(v),) for v in values], "fp long")
    links = simhash.near_pairs(frame, most=most)
    assert all((a ^ b).bit_count() <= 2 for a, b in ((r["a"] % (1 << 64), r["b"] % (1 << 64)) for r in links.collect()))
    got = {r["node"] % (1 << 64): r["root"] for r in components.connected_components(links).collect()}
    expected = brute_components(values, lambda a, b: (a ^ b).bit_count() <= 2)
    sizes = [sorted(v for v in values if expected[v] == c) for c in set(expected.values())]
    for group in sizes:
        if len(group) > 1:
            assert len({got[v] for v in group}) == 1
        else:
            assert group[0] not in got
    assert len({got[v] for v in got}) == sum(len(g) > 1 for g in sizes)


def shingles(text, n=5):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return {" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_wide_fingerprint_by_hand():
    text = "a B c d e f g h a b c d e"
    hashes = {xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles(text)}
    bits = np.zeros(nearcopies.BITS, int)
    for h in hashes:
        for j in range(nearcopies.BITS // 64):
            x = (h + (j + 1) * 0x9E3779B97F4A7C15) % (1 << 64)
            x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 % (1 << 64)
            x = (x ^ x >> 27) * 0x94D049BB133111EB % (1 << 64)
            x ^= x >> 31
            bits[64 * j : 64 * j + 64] += np.unpackbits(np.frombuffer(x.to_bytes(8, "little"), np.uint8))
    assert nearcopies.wide_simhash(text) == np.packbits(2 * bits > len(hashes)).tobytes()
    assert nearcopies.wide_simhash(None) == nearcopies.wide_simhash(" ") == bytes(nearcopies.BITS // 8)
    assert nearcopies.wide_simhash("one two") == nearcopies.wide_simhash("ONE  two")


def test_blocks_are_shared_as_often_as_the_similarity_says():
    """Blocks by hand, and the share of pairs with a common block by their similarity."""
    pick = random.Random(3)
    hashes = np.unique(np.array([pick.getrandbits(64) for _ in range(40)], np.uint64))
    factors, _ = nearcopies.sampling(nearcopies.BLOCKS * nearcopies.SAMPLES, simhash.SEED)
    for j, value in enumerate(np.frombuffer(nearcopies.block_values(hashes), ">u8").tolist()):
        own = [min(hashes.tolist(), key=lambda h: h * int(f) % (1 << 64)) for f in factors[5 * j : 5 * j + 5]]
        own = [int.from_bytes(h.to_bytes(8, "little"), "big") for h in own]
        assert value == sum(1 << b for b in range(64) if sum(h >> b & 1 for h in own) > 2)
    assert nearcopies.block_values(hashes[:0]) == bytes(8 * nearcopies.BLOCKS)
    shared = {}
    for similarity in (0.8, 0.5, 0.0):
        both = round(300 * similarity)
        hits = 0
        for _ in range(300):
            every = np.array([pick.getrandbits(64) for _ in range(300)], np.uint64)
            mine = (300 - both) // 2
            a, b = np.unique(every[: both + mine]), np.unique(np.concatenate((every[:both], every[both + mine :])))
            x, y = (np.frombuffer(nearcopies.block_values(v), np.uint64) for v in (a, b))
            hits += bool((x == y).any())
        shared[similarity] = hits / 300
    assert shared[0.8] > 0.98 and abs(shared[0.5] - nearcopies.share_a_block(0.5)) < 0.12 and shared[0.0] == 0


def edited(pick, words, share, vocabulary):
    return [pick.choice(vocabulary) if pick.random() < share else w for w in words]


def test_near_copies_recall_and_precision(spark):
    """Pairs by their true similarity: nearly all from 0.8 on are found, none below."""
    pick = random.Random(12)
    vocabulary = [f"v{i}" for i in range(5000)]
    rows, pairs = [], []
    for i in range(400):
        words = [pick.choice(vocabulary) for _ in range(pick.randint(60, 600))]
        other = edited(pick, words, pick.choice([0.0, 0.004, 0.01, 0.018, 0.02, 0.022, 0.05, 0.1, 0.3]), vocabulary)
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(other))]
        pairs.append((2 * i, 2 * i + 1, jaccard(shingles(rows[-2][1]), shingles(rows[-1][1]))))
    got = {r["doc_id"]: r["component_id"] for r in nearcopies.near_copies(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    high, mid, low = ([got[a] == got[b] for a, b, s in pairs if lo <= s < hi] for lo, hi in ((0.85, 1.1), (0.8, 0.85), (0, 0.8)))
    assert len(high) > 100 and all(high)
    assert len(mid) > 20 and sum(mid) >= 0.95 * len(mid)
    assert len(low) > 100 and not any(low)
    assert len(set(got.values())) >= 400  # strangers stay apart


def test_near_copies_of_large_groups(spark):
    """Hundreds of edited copies of one text, exact copies, and what repeats ids or has none."""
    pick = random.Random(13)
    vocabulary = [f"v{i}" for i in range(3000)]
    base = [pick.choice(vocabulary) for _ in range(400)]
    rows = [(10_000 - i, " ".join(edited(pick, base, 0.004, vocabulary))) for i in range(500)] + [(20_000 + i, " ".join(base)) for i in range(300)]
    rows += [(i, " ".join(pick.choice(vocabulary) for _ in range(100))) for i in range(50)] + [(7, rows[0][1]), (None, "x"), (60, None), (61, "")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    for size in (10_000, 40):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        got = nearcopies.near_copies(frame).collect()
        assert len(got) == len(rows) - 1
        assert {r["component_id"] for r in got if r["doc_id"] > 9000} == {7}
        assert {r["component_id"] for r in got if r["doc_id"] in (60, 61)} == {60}
        assert {(r["doc_id"], r["component_id"]) for r in got if r["doc_id"] < 50 and r["doc_id"] != 7} == {(i, i) for i in range(50) if i != 7}
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert nearcopies.near_copies(frame.limit(0)).count() == 0


def template_family(pick, size, common, private, pairs):
    """Texts of one template with words of their own; the last `pairs` share most of these with the ones before them."""
    words = lambda n: [f"u{pick.getrandbits(60)}" for _ in range(n)]
    template = words(common)
    own = [words(private) for _ in range(size - pairs)]
    own += [x[: private - 24] + words(24) for x in own[len(own) - pairs :]]
    return [(i, " ".join(template + x)) for i, x in enumerate(own)], [(size - 2 * pairs + i, size - pairs + i) for i in range(pairs)]


def test_near_copies_within_a_template_family(spark):
    """Pairs of over 0.8 in buckets full of texts of some 0.65."""
    rows, pairs = template_family(random.Random(14), 1000, 320, 84, 60)
    sets = {i: shingles(t) for i, t in rows if i >= 880}
    assert all(0.8 <= jaccard(sets[a], sets[b]) < 0.9 for a, b in pairs) and 0.6 < jaccard(sets[880], sets[881]) < 0.7
    got = {r["doc_id"]: r["component_id"] for r in nearcopies.near_copies(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert sum(got[a] == got[b] for a, b in pairs) >= 0.95 * len(pairs)


def test_near_copies_keep_families_below_the_limit_apart(spark):
    """Texts of 0.7 to 0.79 aren't linked, neither directly nor over others."""
    rows, _ = template_family(random.Random(15), 150, 350, 50, 0)
    sets = [shingles(t) for _, t in rows[:2]]
    assert 0.7 < jaccard(*sets) < 0.79
    rows.append((1000, rows[3][1] + " end"))
    got = {r["doc_id"]: r["component_id"] for r in nearcopies.near_copies(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert got == {i: 3 if i == 1000 else i for i, _ in rows}


@pytest.mark.parametrize("tile", [7, 2048])
def test_tiles_join_what_pairs_join(spark, monkeypatch, tile):
    """The links of all tiles and the components before join what brute force over each key's pairs joins, and no more."""
    monkeypatch.setattr(nearcopies, "TILE", tile)
    pick = random.Random(tile)
    base, sets = list(range(100)), {}
    for i in range(60):
        sets[i] = sorted(set(base) - set(pick.sample(base, pick.choice([2, 8, 12, 30]))) | {1000 + i})
    sets[60] = []
    keys = {1: range(50), 2: [3, 7, 9, 52, 53, 60], 3: [55]}
    roots = {i: 0 for i in range(0, 60, 20)}
    expected = brute_components(range(61), lambda a, b: (a in roots and b in roots and roots[a] == roots[b]) or any(a in k and b in k for k in keys.values()) and 0.8 <= jaccard(set(sets[a]), set(sets[b])))
    members = spark.createDataFrame([(k, i) for k, ids in keys.items() for i in ids], "key long, id long")
    named = nearcopies.several_roots(members, spark.createDataFrame([(i, r) for i, r in roots.items()], "node long, root long"))
    assert {r["key"] for r in named.collect()} == {1, 2}
    known = spark.createDataFrame([(i, len(x), np.array(x, np.uint64).tobytes()) for i, x in sets.items()], "id long, size long, set binary")
    links = [(r["a"], r["b"]) for r in nearcopies.across_components(named, known, 0.8).collect()]
    assert all(0.8 <= jaccard(set(sets[a]), set(sets[b])) for a, b in links)
    joined = brute_components(range(61), lambda a, b: (a in roots and b in roots and roots[a] == roots[b]) or (b, a) in links or (a, b) in links)
    assert joined == expected and len(set(expected.values())) > 5


def test_components_of_long_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 300)] + [(1000, 1000 + i) for i in range(1, 200)] + [(5000, 5001), (5001, 5000), (5000, 5000)]
    random.Random(1).shuffle(edges)
    got = {r["node"]: r["root"] for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(301)}, **{1000 + i: 1000 for i in range(200)}, 5000: 5000, 5001: 5000}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_repeats(rows, window):
    words = {i: WORD.findall(t or "") for i, t in rows}
    seen, gone = set(), {i: set() for i in words}
    for i in sorted(words):
        for k in range(len(words[i]) - window + 1):
            key = tuple(words[i][k : k + window])
            if key in seen:
                gone[i].update(range(k, k + window))
            seen.add(key)
    return {i: (len(w), len(gone[i]), " ".join(x for k, x in enumerate(w) if k not in gone[i])) for i, w in words.items()}


def as_dict(frame):
    return {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept"]) for r in frame.collect()}


def test_op6_equals_brute_force(docs, corpus, none):
    expected = brute_repeats(corpus, 20)
    assert sum(n for _, n, _ in expected.values()) > 1000
    assert as_dict(substring.kept_words(docs)) == expected
    left = {r["doc_id"]: r["text"] for r in substring.remove_repeats(docs).collect()}
    for i, text in corpus:
        if expected[i][1] == 0:
            assert left[i] == text
        else:
            assert WORD.findall(left.get(i, "")) == expected[i][2].split(" ") * bool(expected[i][2])
    assert substring.remove_repeats(docs).columns == docs.columns
    assert substring.kept_words(none).count() == 0 and substring.remove_repeats(none).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_op6_patchworks(spark, seed):
    pick = random.Random(seed)
    vocabulary = [f"w{i}" for i in range([2, 6, 40, 400][seed])]
    passages = [[pick.choice(vocabulary) for _ in range(pick.randint(3, 60))] for _ in range(6)]
    rows = []
    for i in range(50):
        words = []
        for _ in range(pick.randint(0, 5)):
            p = pick.choice(passages)
            a, b = sorted((pick.randint(0, len(p)), pick.randint(0, len(p))))
            words += p[a:b] + [pick.choice(vocabulary) for _ in range(pick.randint(0, 4))]
        rows.append((i * 3 - 50, " ".join(words) if words else None))
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for window, anchor in ((20, 6), (7, 7), (5, 1)):
        assert as_dict(substring.kept_words(frame, window, anchor)) == brute_repeats(rows, window)


def test_op6_small_batches(spark, docs, corpus):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        assert as_dict(substring.kept_words(docs)) == brute_repeats(corpus, 20)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_op6_repeated_and_null_ids(spark):
    text = " ".join(f"a{i}" for i in range(30))
    other = "start " + text
    rows = [(1, text), (1, text), (1, other), (None, text), (2, text)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r["doc_id"], r["n_words"], r["n_removed"]) for r in substring.kept_words(frame).collect()), key=str)
    # the null id is first; all others hold windows that it starts
    assert got == sorted([(None, 30, 0), (1, 30, 30), (1, 30, 30), (1, 31, 30), (2, 30, 30)], key=str)


def test_op6_many_texts_under_one_key(spark):
    """Thousands of different texts without doc_id, and under one doc_id, that share nothing lose nothing; a shared passage goes once."""
    passage = " ".join(f"p{i}" for i in range(25))
    rows = [(None if i % 2 else 7, " ".join(f"x{i}y{j}" for j in range(21))) for i in range(4000)]
    rows += [(None, "a0 " + passage), (None, "b0 b1 " + passage), (7, passage)] + [(7, rows[0][1])] * 50
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted((r["n_words"], r["n_removed"]) for r in substring.kept_words(frame).collect())
    assert got == sorted([(21, 0)] * 4050 + [(26, 0), (27, 25), (25, 25)])
    lists = substring.find_repeats(frame).collect()
    assert len(lists) == 2 and all(len(r["repeats"]) <= 25 for r in lists)


def test_long_texts_do_not_wrap():
    words = [b"w%d" % (i % 997) for i in range(200_000)]
    hashes = substring.WordHashes(words)
    assert hashes.runs(np.array([5]), 20)[0] == hashes.runs(np.array([5 + 997]), 20)[0]
    assert hashes.runs(np.array([199_000]), 500)[0] == hashes.runs(np.array([199_000 - 997]), 500)[0]
