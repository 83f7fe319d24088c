import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import DOCS, awkward, clashing, docs, empty, rows
from tickloom.llm import decontam, langid, pii, quality

EN = "the and of that with this from have which their there would about other words".split()
DE = "der die und das nicht mit ein sich auf für ist dem werden auch über".split()


def sentences(words, n, seed):
    rng = random.Random(seed)
    return [" ".join(rng.choice(words) for _ in range(rng.randint(5, 60))) for _ in range(n)]


@pytest.fixture(scope="module")
def labelled(spark):
    both = [(t, "en") for t in sentences(EN, 120, 1)] + [(t, "de") for t in sentences(DE, 120, 2)]
    return spark.createDataFrame([(i, t, lang, "s", len(t)) for i, (t, lang) in enumerate(both)], DOCS).cache()


def test_held_out_accuracy(spark, labelled):
    profiles = langid.train(labelled)
    assert profiles.langs == ["de", "en"]
    found = langid.identify(labelled, profiles).join(labelled.where(langid.held_out(F.col("doc_id"))), "doc_id")
    assert found.count() > 30 and found.where("lang_pred <> lang").count() == 0
    assert found.where("score < 0 or score > 1").count() == 0


def test_held_out_rows_teach_nothing(spark, labelled):
    wrong = labelled.withColumn("lang", F.when(langid.held_out(F.col("doc_id")), "xx").otherwise(F.col("lang")))
    (codes, place), (other, same) = langid.train(wrong).tables[0], langid.train(labelled).tables[0]
    assert langid.train(wrong).langs == ["de", "en"] and (codes == other).all() and (place == same).all()


def brute_distance(text, profile, ranks):
    """Out-of-place distance written from the definition: letters, framed words, ranks by count and then by code."""
    count = {}
    for word in "".join(c if c.isalpha() else " " for c in text.lower()).split():
        framed = f" {word} "
        for k in (1, 2, 3):
            for i in range(len(framed) - k + 1):
                g = framed[i : i + k]
                if g.strip() and not (k == 3 and g[1] == " "):
                    count[g] = count.get(g, 0) + 1
    code = lambda g: sum(ord(c) << 21 * (len(g) - 1 - i) for i, c in enumerate(g))
    own = sorted(count, key=lambda g: (-count[g], code(g)))[:ranks]
    return sum(abs(profile[code(g)] - r) if code(g) in profile else ranks for r, g in enumerate(own)), len(own)


def test_distances_equal_brute_force_with_ties(monkeypatch):
    """More languages than one table holds, some of them with equal profiles: the first by name wins."""
    monkeypatch.setattr(langid, "TOGETHER", 2)
    texts = {"de": "der die und das nicht", "en": "the and of that with", "aa": "the and of that with", "fr": "le la et les des", "zz": "x"}
    ranks, lists = 60, {}
    for lang, t in texts.items():
        lists[lang] = {int(c): r for r, c in enumerate(langid.ranked(*langid.counts(t), ranks))}
    profiles = langid.Profiles([(lang, c, r) for lang, held in lists.items() for c, r in held.items()], ranks)
    assert len(profiles.tables) == 3
    for text in ("that and the", "und die", "le chat", "a1b c", "x x x y", "zzz"):
        want = {lang: brute_distance(text, held, ranks) for lang, held in lists.items()}
        best = min(sorted(want), key=lambda v: want[v][0])
        assert profiles.distances(langid.ranked(*langid.counts(text), ranks)).tolist() == [want[v][0] for v in sorted(want)]
        got = profiles.nearest(text)
        assert got[0] == best and got[1] == pytest.approx(1 - want[best][0] / (ranks * want[best][1]))


def test_long_texts_are_counted_in_slices():
    text = "the cat 1 sat " * 300
    whole, parts = langid.counts(text), langid.counts(text, 100)
    assert (whole[0] == parts[0]).all() and (whole[1] == parts[1]).all()


def test_language_of_awkward_rows(spark, labelled):
    profiles = langid.train(labelled)
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.identify(clashing(awkward(spark)), profiles).collect()}
    assert got[1] == got[2] == got[5] == ("und", 0.0) and got[3][0] in ("de", "en")
    assert langid.identify(empty(spark), profiles).count() == 0
    none = langid.train(empty(spark))
    assert {r["lang_pred"] for r in langid.identify(awkward(spark), none).collect()} == {"und"}
    kept = langid.keep_known(clashing(awkward(spark)), profiles, 0.0)
    assert kept.columns == clashing(awkward(spark)).columns and {r["doc_id"] for r in kept.collect()} == {3, 4, None, 6}


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(s):
    total = sum(int(c) if i % 2 == 0 else (int(c) * 2 - 9 * (int(c) > 4)) for i, c in enumerate(reversed(s)))
    return total % 10 == 0


def valid(kind, t):
    n = re.sub("[^0-9]", "", t)
    return {"email": lambda: True, "ip": lambda: all(int(x) <= 255 for x in t.split(".")), "card": lambda: 16 <= len(n) <= 19 and luhn(n), "phone": lambda: 8 <= len(n) <= 15}[kind]()


def brute_spans(text):
    return {k: [(m.start(), m.end()) for m in re.finditer(p, text or "") if valid(k, m.group())] for k, p in BASE.items()}


def test_pii_equals_brute_force(spark):
    rng = random.Random(3)
    parts = ["a", "B", "@", ".", "1", "23", "+", "-", " ", "(", ")", "é", "😀", "_", "4539148803436467", "4539 1488 0343 6467", "255", "\n", "a@b.cc", "+1 (234) 555-7890", "10.0.0.1"]
    df = docs(spark, ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(600)], 1000).unionByName(awkward(spark))
    for r in pii.digest(clashing(df)).join(df.select("doc_id", "text").distinct(), "doc_id").collect():
        want = brute_spans(r["text"])
        base = ",".join(f"{k}:{a}:{b}" for k in BASE for a, b in want[k])
        assert [r[f"n_{k}"] for k in BASE] == [len(v) for v in want.values()], r["text"]
        assert r["base_sha256"] == hashlib.sha256(base.encode()).hexdigest() and r["spans"].startswith(base)
    assert pii.digest(empty(spark)).count() == 0


def test_long_runs_do_not_overflow(spark):
    text = "1 " * 6000 + "a" * 60_000 + "@x.y " + "1." * 9000 + "+1" + " " * 9000
    r = pii.digest(docs(spark, [text])).first()
    assert (r["n_email"], r["n_card"], r["n_phone"]) == (1, 0, 0) and r["n_ip"] == 2250


def test_iban_checksum_and_context(spark):
    r = pii.digest(docs(spark, ["my iban DE89 3704 0044 0532 0130 00 and DE89370400440532013001"])).first()
    assert r["spans"].split(",")[-1] == "iban:8:35" and "iban:40" not in r["spans"] and r["scores"].split(",")[-1] == "0.80"


def test_context_decides_added_spans_and_redaction(spark):
    """The same account number and address, beside words that raise their score, beside none and beside words that lower it."""
    texts = [f"{word} DE89370400440532013000 and {other} 10.1.2.3" for word, other in (("iban", "host"), ("my", "my"), ("sku", "version"))]
    got = pii.digest(docs(spark, texts)).orderBy("doc_id").collect()
    assert [("iban" in r["spans"], r["n_ip"]) for r in got] == [(True, 1), (True, 1), (False, 1)]
    clean = [r["text"] for r in pii.redact(docs(spark, texts)).orderBy("doc_id").collect()]
    assert clean == ["iban <IBAN> and host <IP>", "my <IBAN> and my <IP>", texts[2]]


def test_redaction(spark):
    df = docs(spark, ["mail a@b.cc or 10.0.0.1.", None, "clean"])
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in pii.redact(clashing(df)).collect()}
    assert got == {0: ("mail <EMAIL> or <IP>.", 21), 1: (None, 0), 2: ("clean", 5)}
    assert pii.redact(clashing(df)).columns == clashing(df).columns and pii.redact(empty(spark)).count() == 0


def brute_tiles(a, b, least):
    """Greedy string tiling by looking at every pair of positions."""
    ma, mb, out = [False] * len(a), [False] * len(b), []
    while True:
        best = least - 1, None
        for i in range(len(a)):
            for j in range(len(b)):
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and not ma[i + n] and not mb[j + n]:
                    n += 1
                if n > best[0]:
                    best = n, (i, j)
        if best[1] is None:
            return out
        i, j = best[1]
        for k in range(best[0]):
            ma[i + k] = mb[j + k] = True
        out.append((i, j, best[0]))


def test_tiling_equals_brute_force():
    import numpy as np

    rng = random.Random(4)
    for _ in range(150):
        a, b = ([rng.randint(0, 3) for _ in range(rng.randint(1, 25))] for _ in range(2))
        got = decontam.tile(np.array(a), np.array(b), 3)
        assert got == brute_tiles(a, b, 3)


def test_tiling_of_long_equal_texts_is_quick():
    import time

    import numpy as np

    a = np.random.default_rng(1).integers(0, 5000, 30_000)
    began = time.time()
    assert decontam.tile(a, np.concatenate([a[20_000:], a[:20_000]]), 5)[:2] == [(0, 10_000, 20_000), (20_000, 0, 10_000)]
    assert time.time() - began < 5


def test_contamination(spark):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(3000)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [text(40) for _ in range(5)] + ["tiny item", None, "", "..."]
    half = items[1].split()
    cases = [text(60), f"{text(30)} {items[0].upper()} {text(30)}", " ".join(half[20:]) + " " + text(20) + " " + " ".join(half[:20]), text(10) + " " + " ".join(items[2].split()[:15]) + " " + text(10), "a Tiny, item b", items[3] + " " + items[3]]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    df = docs(spark, cases).unionByName(awkward(spark).withColumn("doc_id", F.col("doc_id") + 100))
    for block in (decontam.BLOCK_BYTES, 100):
        got = {(r["doc_id"], r["item_id"]): r for r in decontam.contaminated(clashing(df), clashing(bench), block_bytes=block).collect()}
        assert set(got) == {(1, 0), (2, 1), (4, 5), (5, 3)}
        assert got[2, 1]["coverage"] == 1.0 and len(got[2, 1]["tiles"].split(",")) >= 2
        kept = decontam.clean(clashing(df), bench, block_bytes=block)
        assert kept.columns == clashing(df).columns and kept.count() == df.count() - 4
    assert decontam.contaminated(empty(spark), bench).count() == 0 and decontam.contaminated(df, bench.where("false")).count() == 0


def test_resampling_prefers_target_texts(spark):
    good, bad = sentences(EN, 200, 6), sentences(DE, 200, 7)
    df = docs(spark, [x for pair in zip(good, bad, strict=True) for x in pair])
    marks = spark.createDataFrame([(i, int(i % 2 == 0), 0) for i in range(0, 300)], "doc_id long, quality int, toxic int")
    out = quality.resample(clashing(df), clashing(marks))
    assert out.where("selected").count() == 200 and out.where("selected and doc_id % 2 = 0").count() > 190
    assert rows(out, "doc_id", "selected") == rows(quality.resample(df, marks), "doc_id", "selected")


def test_weights_and_selection_equal_brute_force(spark):
    """Log ratios of counted buckets added up, the noise of the id on top, the largest half."""
    import xxhash

    texts = sentences(EN, 40, 8) + sentences(DE, 40, 9)
    df, marks = docs(spark, texts), spark.createDataFrame([(i, int(i < 30), 0) for i in range(60)], "doc_id long, quality int, toxic int")

    def bag(t):
        h = [xxhash.xxh3_64_intdigest(w) for w in t.encode().lower().split()]
        pairs = [int(quality.mix(np.array([(x * 3 + y) % 2**64], np.uint64))[0]) for x, y in zip(h, h[1:])]
        return [x % quality.BUCKETS for x in h + pairs]

    raw, good = Counter(x for t in texts for x in bag(t)), Counter(x for t in texts[:30] for x in bag(t))
    share = lambda c, x: math.log((c[x] + 1) / (sum(c.values()) + quality.BUCKETS))
    want = {i: sum(share(good, x) - share(raw, x) for x in bag(t)) for i, t in enumerate(texts)}
    noise = {r["id"]: r["g"] for r in spark.range(len(texts)).select("id", quality.gumbel(F.col("id")).alias("g")).collect()}
    kept = sorted(want, key=lambda i: (-(want[i] + noise[i]), i))[:40]
    got = quality.resample(df, marks).collect()
    assert all(r["log_weight"] == pytest.approx(want[r["doc_id"]]) for r in got) and {r["doc_id"] for r in got if r["selected"]} == set(kept)


def test_threshold_is_exact(spark):
    rng = random.Random(8)
    data = [(round(rng.gauss(0, 1), 2), i) for i in range(3000)]
    df = spark.createDataFrame(data, "key double, doc_id long")
    ranked = sorted(data, key=lambda x: (-x[0], x[1]))
    for few in (quality._FEW, 3):
        quality._FEW = few
        for k in (1, 7, 1500, 3000):
            assert tuple(quality.threshold(df, k)) == ranked[k - 1]
    quality._FEW = 4096
    assert quality.threshold(df.where("false"), 3) is None


def test_resampling_awkward_rows(spark):
    marks = spark.createDataFrame([(4, 1, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality.resample(clashing(awkward(spark)), marks).collect()
    assert len(got) == 8 and all(not r["selected"] for r in got if r["log_weight"] is None or r["doc_id"] is None)
    assert quality.resample(empty(spark), marks).count() == 0 and quality.resample(awkward(spark), marks.where("false")).count() == 8
