import os
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from helpers import DOCS
from test_joins import FIVE, brute
from tickloom.llm import queries

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    """A folder with documents of every case and a benchmark, and the documents' rows."""
    rng = random.Random(11)
    words = "the and of that with this from have which their there would about other".split()
    text = lambda n: " ".join(rng.choice(words) + str(rng.randrange(60)).translate(str.maketrans("0123456789", "abcdefghij")) for _ in range(n))
    texts = [text(rng.randint(30, 120)) for _ in range(60)]
    item = text(30)
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    rows += [(100, texts[3], "en", "s", 1), (101, texts[4] + " extra", "en", "s", 1), (102, text(20) + " " + item + " " + text(20), "en", "s", 1), (103, text(40) + " me@mail.example.com 10.1.2.3", "en", "s", 1), (104, "12 34 ##", "en", "s", 1), (105, None, None, None, None), (106, "", "en", "s", 0)]
    at = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows, DOCS).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return str(at), rows


def test_stages_take_effect(spark, small):
    at, source = small
    docs = spark.read.parquet(f"{at}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.materialize(stage(spark, docs, at), name)
        assert docs.columns == [c.split()[0] for c in DOCS.split(", ")]
        seen[name] = {r["doc_id"]: r["text"] for r in docs.collect()}
    every = {r[0]: r[1] for r in source}
    assert set(every) - set(seen["language_id"]) == {104, 105, 106}
    assert set(seen["near_duplicates"]) == {c for _, _, c in brute(list(seen["language_id"].items()), FIVE)}
    assert set(seen["near_duplicates"]) - set(seen["decontamination"]) == {102}
    assert set(seen["pii"]) == set(seen["decontamination"])
    assert seen["pii"][103].endswith("<EMAIL> <IP>") and all(t == every[i] for i, t in seen["pii"].items() if i != 103)


def test_run_packs_what_the_stages_keep(spark, small):
    at, _ = small
    pieces = corpus_pipeline.run(spark, at).toPandas()
    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    docs = spark.read.parquet(f"{at}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.materialize(stage(spark, docs, at), name)
    want = {r["doc_id"]: len(own.encode(r["text"] or "", add_special_tokens=False).ids) + 1 for r in docs.collect()}
    assert pieces.groupby("doc_id")["length"].sum().to_dict() == want


def test_empty_corpus(spark, small, tmp_path):
    at, _ = small
    spark.read.parquet(f"{at}/documents.parquet").where("false").write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{at}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_every_query_returns_a_row_for_each_input(spark, name):
    n = queries.queries()[name](spark, DATA).count()
    table = "pages" if name.startswith(("op4_", "op8_")) else "documents"
    whole = spark.read.parquet(f"{DATA}/{table}.parquet").count()
    assert n >= whole if name.startswith("op7_") else n == whole if not name.startswith("op1_") else 0 < n < whole
