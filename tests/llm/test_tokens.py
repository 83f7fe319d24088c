import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from helpers import awkward, clashing, docs, empty, rows
from tickloom.llm import packing, token_counts, tokenizer

PATH = public_tokenizers.path("byte_bpe_50k.json")
PARTS = ["a", "b ", "the", " the", "\n", "  ", "é", "日本", "1", "23", ".", "!!", "'s", "<|endoftext|>", "ñ ", "😀", " x", "\t", "\u3000", "’"]


@pytest.fixture(scope="module")
def own():
    return Tokenizer.from_file(PATH)


def texts(n, size, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, size))) for _ in range(n)]


def test_ids_equal_the_library(own):
    t = tokenizer.load(PATH)
    for s in texts(300, 60):
        assert t.ids(s) == own.encode(s, add_special_tokens=False).ids


def test_every_character_splits_as_in_the_library(own):
    t = tokenizer.load(PATH)
    for cp in [*range(0xD800), *range(0xE000, 0x11000, 3)]:
        if cp < 0x500 or cp % 7 == 0 or not chr(cp).isalnum():
            s = f"a{chr(cp)}b1{chr(cp)}2 {chr(cp)} '{chr(cp)}{chr(cp)} \n"
            assert t.ids(s) == own.encode(s, add_special_tokens=False).ids, hex(cp)


@pytest.mark.parametrize("chunk,overlap", [(1, 1), (5, 1), (20, 4), (64, 16)])
def test_spliced_counts_equal_whole_ones(own, chunk, overlap):
    t = tokenizer.load(PATH)
    for s in [*texts(60, 300, 2), "x" * 500, " " * 500, "ab1" * 200, "日" * 300, "<|endoftext|>" * 30]:
        assert token_counts.count_tokens(t, s, chunk, overlap) == len(own.encode(s, add_special_tokens=False).ids), s[:40]


def test_counts_of_awkward_rows(spark, own):
    found = rows(token_counts.token_counts(clashing(awkward(spark)), PATH), "doc_id", "n_bytes", "n_tokens", "over_limit")
    want = []
    for r in awkward(spark).collect():
        n = len(own.encode(r["text"] or "", add_special_tokens=False).ids)
        want.append((r["doc_id"], len((r["text"] or "").encode()), n, n > 1024))
    assert found == sorted(want, key=repr)
    assert token_counts.token_counts(empty(spark), PATH).count() == 0


def other_files():
    return ["word_bpe_49k.json", "piece_bpe_32k.model"]


@pytest.mark.parametrize("name", other_files())
def test_other_vocabularies_go_to_their_library(name):
    t = tokenizer.load(public_tokenizers.path(name))
    assert t.lengths is None and len(t.ids("Some words here")) > 0
    assert token_counts.count_tokens(t, "word " * 50, 16, 4) == len(t.ids("word " * 50))


def unpacked(spark, df, own, **more):
    p = packing.pack(df, PATH, **more).toPandas()
    source = [(r["doc_id"], r["text"]) for r in df.collect()]
    return p, source


@pytest.mark.parametrize("window,open_windows", [(2048, 16), (16, 2), (8, 1)])
def test_pieces_hold_every_id_once(spark, own, window, open_windows):
    df = docs(spark, [*texts(80, 120, 3), None, "", "word " * 3000]).repartition(5)
    p, source = unpacked(spark, df, own, window=window, open_windows=open_windows, merge=2)
    by_doc = dict(source)
    for doc, part in p.sort_values("start").groupby("doc_id"):
        ids = np.array([*own.encode(by_doc[doc] or "", add_special_tokens=False).ids, 1], dtype="<u4")
        assert part["start"].tolist() == [0, *part["length"].cumsum().tolist()[:-1]] and part["length"].sum() == len(ids)
        assert (part["doc_tokens"] == len(ids)).all() and (part["length"] > 0).all()
        for r in part.itertuples():
            assert zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32
    assert set(p["doc_id"]) == set(by_doc)
    for _, seq in p.sort_values("offset").groupby("sequence_id"):
        assert seq["offset"].tolist() == [0, *seq["length"].cumsum().tolist()[:-1]] and seq["length"].sum() <= window


def test_little_padding(spark, own):
    df = docs(spark, texts(400, 700, 4)).repartition(8)
    p, _ = unpacked(spark, df, own)
    used = p.groupby("sequence_id")["length"].sum()
    padding = sum(0 if n & (n - 1) == 0 else 2048 - n for n in used)
    assert padding <= 0.02 * used.sum()


def test_packing_awkward_rows(spark):
    p = packing.pack(clashing(awkward(spark)), PATH).toPandas()
    assert p["length"].sum() == p.drop_duplicates(["doc_id", "start", "sequence_id", "offset"])["length"].sum()
    assert (p["doc_id"] == 4).sum() >= 2 and p["doc_id"].isna().sum() >= 1
    assert packing.pack(empty(spark), PATH).count() == 0
