import hashlib

import public_tokenizers
from tokenizers import Tokenizer

from tessella.llm import bpe, queries

PATH = public_tokenizers.path("byte_bpe_50k.json")


def brute(texts):
    tok = Tokenizer.from_file(PATH)
    out = {}
    for i, t in texts.items():
        ids = tok.encode(t or "", add_special_tokens=False).ids
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        out[i] = (len(ids), sha(",".join(map(str, ids))), sha(tok.decode(ids, skip_special_tokens=False)))
    return out


def test_query_equals_the_library(spark, sf):
    want = brute({r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()})
    assert {r[0]: tuple(r)[1:] for r in queries.op4_bpe(spark, sf).collect()} == want


def test_odd_texts(docs_of, odd_texts):
    texts = dict(enumerate([*odd_texts, "  x", "x  ", "a \n b", "\n", " ", "  \n  y  z  w", "a<|endoftext|> b<|endoftext|><|endoftext|>", "tab\t x \x85 y", "'s 't it's  'll", "١٢٣ 12 a1"]))
    got = {r[0]: tuple(r)[1:] for r in bpe.digests(docs_of(list(texts.items())).repartition(3), PATH).collect()}
    assert got == brute(texts)
    assert bpe.digests(docs_of([]), PATH).count() == 0


def test_keys_and_clashing_columns(spark):
    df = spark.createDataFrame([("k", "some text", 1), (None, None, 2), ("k", "some text", 3)], "doc_id string, text string, ids int")
    got = sorted(((r["doc_id"], r["n_tokens"]) for r in bpe.digests(df, PATH).collect()), key=str)
    assert got == [("k", 2), ("k", 2), (None, 0)]


def test_words_join_to_the_text():
    for t in ("a b", " a", "a  b ", "\n a\n\n b  ", "", " ", "x   y"):
        assert " ".join(bpe.split_words(t)) == t
