import random

import pytest
from tokenizers import Tokenizer

import oracle
from tidemark.llm import queries, tokenize
from tidemark.sources.tables import table

JSON = tokenize.VOCABULARY.replace(".tiktoken", ".json")
ODD = ["", None, " ", "   \n\n  x", "a" * 5000, " " * 3000 + "b", "don't we'll I'd", "é½👩‍💻​在庫切れ طلب", "<|endoftext|> text", "x\r\n\r\ny\t\tz", "1234567890" * 400, "مرحبا " * 800, "'", "a'", "  x"]


@pytest.fixture(scope="module")
def reference():
    t = Tokenizer.from_file(JSON)
    t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def encode(spark, texts, **kw):
    df = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in enumerate(texts)], "doc_id long, text string, ids string, row long, piece int").repartition(3)
    got = tokenize.encode_corpus(df, "doc_id", "text", **kw)
    assert got.columns == ["doc_id", "ids"]
    return {r.doc_id: list(r.ids) for r in got.collect()}


def test_odd_texts(spark, reference):
    assert encode(spark, ODD) == {i: reference(t) for i, t in enumerate(ODD)}


@pytest.mark.parametrize("chunk, overlap", [(32, 16), (64, 20), (200, 40)])
def test_chunks_give_the_ids_of_the_whole(spark, reference, chunk, overlap):
    rnd = random.Random(chunk)
    parts = ["word", " ", "  ", "\n", "'re", "'s", "don't", "123", "é", "在庫", "👩‍💻", "!!!", "a" * 90, " " * 70, "."]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randrange(10, 400))) for _ in range(40)] + ODD
    assert encode(spark, texts, chunk=chunk, overlap=overlap) == {i: reference(t) for i, t in enumerate(texts)}


def test_repeated_and_null_ids_and_empty_table(spark, reference):
    long = "many words here " * 2000
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (1, long), (1, long), (None, long), (None, None)], "doc_id long, text string")
    got = sorted((str(r.doc_id), len(r.ids)) for r in tokenize.encode_corpus(df, "doc_id", "text").collect())
    n = len(reference(long))
    assert got == sorted([("1", 2), ("1", 2), ("1", n), ("1", n), ("None", n), ("None", 0)])
    assert tokenize.encode_corpus(df.limit(0), "doc_id", "text").count() == 0


def test_whole_corpus_round_trip(spark, reference):
    root = f"{oracle.DATA}/sf0.01"
    ids = {r.doc_id: list(r.ids) for r in queries.p8_ids(spark, root).collect()}
    texts = {r.doc_id: r.text for r in table(spark, root, "documents").select("doc_id", "text").collect()}
    assert ids == {d: reference(t) for d, t in texts.items()}
    rows, ours, theirs = oracle.compare(spark, "p8_round_trip", root)
    assert rows == len(texts) and not ours and not theirs
