import random
from collections import defaultdict

import numpy as np
import pytest

from helpers import DOCS, awkward, clashing, docs, empty, rows
from tickloom.llm import common, jaccard, urlfilter
from tickloom.llm.queries import URL_RULES


def shingle_set(text, k=3):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


THREE, FIVE = jaccard.Rule(90, 3), jaccard.Rule(80, 5)


def brute(pairs, rule=THREE):
    """Components by holding every document against every other."""
    sets = {i: shingle_set(t, rule.words) for i, t in pairs}
    up = {i: i for i in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            common_ = len(sets[i] & sets[j])
            if common_ and 100 * common_ >= rule.percent * (len(sets[i]) + len(sets[j]) - common_):
                a, b = top(i), top(j)
                up[max(a, b)] = min(a, b)
    return sorted(((i, len(sets[i]), top(i)) for i in sets), key=repr)


def corpus(n, seed):
    """Texts of all sizes, near copies of each other at all distances around the threshold, sharing passages."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    word = lambda: rng.choice(vocabulary)
    passage, out = [word() for _ in range(40)], []
    while len(out) < n:
        base = [word() for _ in range(rng.choice([1, 2, 3, 9, 11, 12, 13, 18, 20, 21, 22, 23, 30, 60, 150]))]
        if rng.random() < 0.3:
            base += passage
        out.append(" ".join(base))
        for _ in range(rng.choice([0, 0, 1, 3, 6])):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 40))):
                at = rng.randrange(len(copy) + 1)
                rng.choice([lambda: copy.insert(at, word()), lambda: copy.pop(min(at, len(copy) - 1)) if len(copy) > 1 else None, lambda: copy.append(word())])()
            out.append(" ".join(copy).upper() if rng.random() < 0.2 else " \n".join(copy))
    return out[:n]


@pytest.mark.parametrize("seed,rule", [(1, THREE)])
def test_components_equal_brute_force(spark, seed, rule):
    texts = corpus(400, seed)
    random.Random(seed).shuffle(texts)
    assert rows(jaccard.join(docs(spark, texts), rule), "doc_id", "n_shingles", "component_id") == brute(list(enumerate(texts)), rule)


def brute_links(pairs, rule):
    """Links of each document by holding it against every other."""
    sets = [(i, shingle_set(t, rule.words)) for i, t in pairs]
    linked = lambda a, b: bool(a & b) and 100 * len(a & b) >= rule.percent * len(a | b)
    return sorted(((i, sum(i != j and linked(a, b) for j, b in sets)) for i, a in sets), key=repr)


@pytest.mark.parametrize("seed,rule,sets,shingles", [(1, THREE, 1024, 1 << 19), (2, FIVE, 2, 1 << 19), (3, jaccard.Rule(60, 2), 1024, 100)])
def test_link_counts_equal_brute_force(spark, monkeypatch, seed, rule, sets, shingles):
    monkeypatch.setattr(jaccard, "TILE_SETS", sets)
    monkeypatch.setattr(jaccard, "TILE_SHINGLES", shingles)
    texts = corpus(300, seed)
    random.Random(seed).shuffle(texts)
    got = jaccard.join(docs(spark, texts), rule, count_links=True)
    want = brute_links(list(enumerate(texts)), rule)
    assert max(k for _, k in want) >= 3 and rows(got, "doc_id", "n_links") == want
    assert rows(got, "doc_id", "n_shingles", "component_id") == brute(list(enumerate(texts)), rule)


def test_links_inside_a_component_are_counted(spark):
    """Three different texts, each linked with both others: the link that the smallest has no part in counts too."""
    base = [f"w{i}" for i in range(200)]
    texts = [" ".join([*base, *more]) for more in ([], ["x"], ["y"])]
    assert rows(jaccard.join(docs(spark, texts), THREE, count_links=True), "doc_id", "n_links") == [(0, 2), (1, 2), (2, 2)]


def test_links_of_awkward_rows(spark):
    got = rows(jaccard.join(clashing(awkward(spark)), count_links=True), "doc_id", "n_links")
    assert got == sorted([(i, 0) for i in (1, 2, 3, 4, 4, None, 5, 6)], key=repr)
    assert jaccard.join(empty(spark), count_links=True).count() == 0
    same = spark.createDataFrame([(7, "a b c d", "", "", 1), (None, "A b c d", "", "", 1), (3, "a b  c d", "", "", 1)], DOCS)
    assert rows(jaccard.join(same, count_links=True), "doc_id", "n_links") == [(3, 1), (7, 1), (None, 0)]


def test_long_lists_are_cut_without_loss(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "LONGEST", 12)
    monkeypatch.setattr(jaccard, "LIST_TILE", 3)
    texts = corpus(250, 4)
    assert rows(jaccard.join(docs(spark, texts), FIVE), "doc_id", "n_shingles", "component_id") == brute(list(enumerate(texts)), FIVE)


def test_chains_and_unlinked_centres(spark):
    """Neighbours of a chain link, its ends do not, and the smallest id is in the middle or apart."""
    words = [f"w{i}" for i in range(200)]
    texts = [" ".join(words[4 * k : 4 * k + 100]) for k in (3, 0, 1, 2, 4, 5, 9, 8)]
    assert rows(jaccard.join(docs(spark, texts), THREE), "doc_id", "n_shingles", "component_id") == brute(list(enumerate(texts)))


def linked_pairs(rule, seed, rounds=1500):
    """Sets of all sizes at all distances around the threshold: ``a, b, linked`` of sets that are not equal."""
    rng = np.random.default_rng(seed)
    for _ in range(rounds):
        n = int(rng.choice([4, 5, 8, 9, 10, 11, 13, 15, 18, 19, 20, 21, 27, 28, 30, 45, 100, 300, 449, 450]))
        a = rng.integers(0, 2**62, n).astype(np.uint64) * np.uint64(2)
        keep = int(rng.integers(int(n * (rule.percent - 5) / 100), n + 1))
        b = np.concatenate([rng.permutation(a)[:keep], rng.integers(0, 2**62, int(rng.integers(0, n // 4 + 2))).astype(np.uint64) * np.uint64(2) + np.uint64(1)])
        a, b = np.unique(a), np.unique(b)
        both = len(np.intersect1d(a, b))
        if not np.array_equal(a, b):
            yield a, b, 100 * both >= rule.percent * (len(a) + len(b) - both)


@pytest.mark.parametrize("rule", [THREE, FIVE])
def test_linked_sets_meet_in_a_list_at_places_that_may_link(rule):
    levels = np.random.default_rng(5).integers(0, 4, 1 << 12).astype(np.uint8)
    for a, b, linked in linked_pairs(rule, 1):
        if linked:
            x, y = (jaccard.rarest(h, levels, rule.prefix(len(h))) for h in (a, b))
            both = np.intersect1d(x, y)
            assert len(both) and rule.least_partner(max(len(a), len(b))) <= min(len(a), len(b))
            for k in both:
                p, q = (int(np.flatnonzero(z == k)[0]) for z in (x, y))
                most = min(p, q) + 1 + min(len(a) - p - 1, len(b) - q - 1)
                assert (100 + rule.percent) * most >= rule.percent * (len(a) + len(b))
            assert all(len(np.intersect1d(*(jaccard.block_keys(h, rule, seed) for h in (a, b)))) for seed in (1, 2))


@pytest.mark.parametrize("rule", [THREE, FIVE, jaccard.Rule(60, 2)])
def test_sets_of_two_sizes_share_a_subset_if_linked(rule):
    for a, b, linked in linked_pairs(rule, 2, 400):
        if max(len(a), len(b)) < 12:
            shared = len(np.intersect1d(*(jaccard.subset_keys(h, rule, 12) for h in (a, b))))
            assert bool(shared) == linked or (shared and len(a) == len(b)), (len(a), len(b))


def test_order_is_that_of_level_and_hash():
    rng = np.random.default_rng(8)
    levels, h = rng.integers(0, 3, 1 << 10).astype(np.uint8), np.unique(rng.integers(0, 2**63, 300).astype(np.uint64))
    want = sorted(h.tolist(), key=lambda x: (levels[x % 1024], x))
    assert all(jaccard.rarest(h, levels, k).tolist() == want[:k] for k in (1, 7, 299, 300))


def test_levels_grow_with_the_number_of_documents(spark):
    texts = ["a b c d"] * 40 + [f"u{i} v{i} w{i} x{i}" for i in range(30)]
    found = jaccard.signatures(docs(spark, texts).repartition(3), THREE)
    levels = jaccard.levels_of(found.where("at is not null").select("at", "counts"))
    at = lambda t: levels[(jaccard.shingles(t, jaccard.Words(), 3) & np.uint64(jaccard.COUNTERS - 1)).astype(np.int64)]
    assert (at("a b c d") == round(8 * np.log2(41))).all() and (at("u3 v3 w3 x3") == 8).all()
    assert jaccard.mean_others(levels) == pytest.approx((2 * 40 * 39) / (2 * 40 + 60), rel=0.1)
    assert jaccard.mean_others(np.zeros(16, np.uint8)) == 0


def test_boundary_follows_cost():
    for rule in (THREE, FIVE):
        for others in (0.0, 3.0, 40.0):
            n = rule.boundary(others)
            assert all(rule.subsets(k) <= rule.prefix(k) * (1 + others) for k in range(1, n)) and rule.subsets(n) > rule.prefix(n) * (1 + others)
        assert rule.boundary(0.0) < rule.boundary(40.0)


@pytest.mark.parametrize("others", [60.0])
def test_any_boundary_finds_all_links(spark, monkeypatch, others):
    monkeypatch.setattr(jaccard, "mean_others", lambda levels: others)
    texts = corpus(300, 6)
    got = jaccard.join(docs(spark, texts), THREE)
    assert rows(got, "doc_id", "n_shingles", "component_id") == brute(list(enumerate(texts)))
    assert rows(got, "doc_id", "n_links") == brute_links(list(enumerate(texts)), THREE)


def test_jaccard_of_awkward_rows(spark):
    got = rows(jaccard.join(clashing(awkward(spark))), "doc_id", "n_shingles", "component_id")
    assert got == sorted([(1, 0, 1), (2, 0, 2), (3, 1, 3), (4, 1, 4), (4, 1, 4), (None, 1, None), (5, 0, 5), (6, 1, 6)], key=repr)
    assert jaccard.join(empty(spark)).count() == 0
    same = spark.createDataFrame([(7, "a b c d", "", "", 1), (None, "A b c d", "", "", 1), (3, "a b  c d", "", "", 1)], DOCS)
    assert {r["component_id"] for r in jaccard.join(same).collect()} == {3}


def test_deduplicate(spark):
    got = jaccard.deduplicate(clashing(awkward(spark)))
    assert got.columns == clashing(awkward(spark)).columns
    assert sorted((r["doc_id"] for r in got.collect()), key=repr) == sorted([1, 2, 3, 4, None, 5, 6], key=repr)
    texts = corpus(200, 5)
    kept = {r["doc_id"] for r in jaccard.deduplicate(docs(spark, texts)).collect()}
    assert kept == {c for _, _, c in brute(list(enumerate(texts)), FIVE)}
    assert jaccard.deduplicate(empty(spark)).count() == 0


def test_sketches_never_drop_a_link(spark):
    """Widths of one and of two sizes; the engine's count of differing bits is that of the folded sketches."""
    rng, held = np.random.default_rng(2), []
    for n in (1, 40, 300, 511, 512, 513, 600, 2000):
        for m in (1, 40, 300, 511, 512, 513, 600, 1100):
            a, b = (np.unique(rng.integers(0, 3000, k).astype(np.uint64)) for k in (n, m))
            held.append((jaccard.sketch(a).tolist(), jaccard.sketch(b).tolist(), len(np.setxor1d(a, b))))
    df = spark.createDataFrame(held, "sketch_a array<long>, sketch_b array<long>, apart long").withColumn("differ", jaccard.differing("a", "b"))
    for r in df.collect():
        assert r["differ"] <= r["apart"]
        if len(r["sketch_a"]) == len(r["sketch_b"]):
            assert r["differ"] == sum(((x ^ y) & (1 << 64) - 1).bit_count() for x, y in zip(r["sketch_a"], r["sketch_b"], strict=True))


@pytest.mark.parametrize("shape", ["path", "star", "random", "none"])
def test_connected_components(spark, shape):
    rng = random.Random(9)
    pairs = {"path": [(i, i + 1) for i in range(60)], "star": [(30, i) for i in range(60) if i != 30], "random": [(rng.randrange(80), rng.randrange(80)) for _ in range(60)], "none": []}[shape]
    up = {x: x for p in pairs for x in p}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    want = {x: top(x) for p in pairs if p[0] != p[1] for x in p}
    got = {r["node"]: r["comp"] for r in common.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == want


def test_lookup_with_hot_and_null_keys(spark):
    data = [(i, 1 if i < 700 else i % 50 if i % 9 else None) for i in range(1200)]
    df = spark.createDataFrame(data, "i long, k long")
    facts = df.where("k is not null").groupBy("k").count().selectExpr("k", "k * 10 as v", "count as n").where("k <> 7")
    got = {r["i"]: r["v"] for r in common.lookup(df, facts, ["k"], 1200, "i").collect()}
    assert got == {i: (None if k is None or k == 7 else k * 10) for i, k in data}


def judged(url, rules):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host, path = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut]), rest[cut:]
        path = path[: min([path.find(c) for c in "?#" if c in path] or [len(path)])]
    fits = [(len(h + p), len(h), h + p, v) for h, p, v in rules if h and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[2], best[3] if best else "allow"


@pytest.mark.parametrize("seed", [1, 2])
def test_url_rules_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    labels = ["a", "b", "com", "x", "é", ""]
    rules = list({(".".join(rng.choice(labels[:4]) for _ in range(rng.randint(1, 4))), "/" + "/".join(rng.choice(["p", "q", "pp", ""]) for _ in range(rng.randint(0, 3)))) for _ in range(60)})
    rules = [(h, p, rng.choice(["allow", "block"])) for h, p in rules]
    urls = [rng.choice(["http", "HTTP", ""]) + rng.choice(["://", "://", ":/"]) + ".".join(rng.choice([*labels, "COM"]) for _ in range(rng.randint(1, 5))) + rng.choice(["", "/"]) + "/".join(rng.choice(["p", "q", "pp", "", "?a", "#b://c"]) for _ in range(rng.randint(0, 4))) for _ in range(800)]
    urls += [None, "", "://", "http://a.com", "http://a.com/p"] + ["http://hot.com/p"] * 400
    pages = clashing(spark.createDataFrame([(i if i != 3 else None, u) for i, u in enumerate(urls)], "page_id long, url string"))
    got = urlfilter.judge(pages, spark.createDataFrame(rules, "host string, path string, verdict string"))
    want = sorted(((i if i != 3 else None, *judged(u, rules)) for i, u in enumerate(urls)), key=repr)
    assert rows(got, "page_id", "host", "path", "rule", "verdict") == want


def test_url_edge_tables(spark):
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    pages = spark.createDataFrame([(1, "http://www.example.com/en/x"), (2, "http://notexample.com/en/"), (3, "https://m.example.com:80/en/")], "page_id long, url string")
    assert rows(urlfilter.judge(pages, rules), "page_id", "rule", "verdict") == [(1, "www.example.com/en/", "allow"), (2, "com/", "allow"), (3, None, "allow")]
    assert urlfilter.judge(pages.where("false"), rules).count() == 0
    assert rows(urlfilter.judge(pages, rules.where("false")), "verdict") == [("allow",)] * 3
    twice = rules.unionByName(spark.createDataFrame([("com", "/", "block")], rules.schema))
    assert rows(urlfilter.judge(pages, twice), "page_id", "verdict")[1] == (2, "block")


def test_grouping_is_by_hash_not_order():
    seen = defaultdict(list)
    for i, t in enumerate(["a b c d", "A B C D", "d c b a"]):
        from tickloom.llm.shingles import Words, shingles

        seen[shingles(t, Words()).tobytes()].append(i)
    assert sorted(seen.values()) == [[0, 1], [2]]


def test_boundary_is_bounded_however_long_the_lists():
    for rule in (THREE, FIVE):
        at = [rule.boundary(jaccard.pairs_cost(x)) for x in (0.0, 0.3, 1.0, 1e3, 1e9)]
        assert at == sorted(at) and at[2] == at[4]
        assert rule.subsets(at[4] - 1) <= rule.prefix(at[4] - 1) * (1 + jaccard.PAIR_COST)


def test_candidates_are_written_before_they_are_settled_and_the_driver_is_released(spark, monkeypatch):
    """What is settled is read several times, so it must not be computed each time; and the driver drops what finished steps left."""
    given, released, settle = [], [], jaccard.settle
    monkeypatch.setattr(jaccard, "settle", lambda docs, pairs, *a: given.append(hasattr(pairs, "_written_to")) or settle(docs, pairs, *a))
    monkeypatch.setattr(jaccard, "release", lambda session: released.append(session) or common.release(session), raising=False)
    pairs = [(i, t) for i, t in enumerate(corpus(30, 3))]
    found = jaccard.join(docs(spark, [t for _, t in pairs]), THREE, count_links=False)
    assert rows(found, "doc_id", "n_shingles", "component_id") == brute(pairs)
    assert given == [True, True] and len(released) >= 3
