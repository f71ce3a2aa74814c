import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from tessella.llm import packing, queries

PATH = public_tokenizers.path("word_bpe_49k.json")


def check_pieces(rows, texts):
    """rows: (doc_id, start, length, crc, doc_tokens, sequence_id, offset)."""
    tok, by_doc, by_seq = Tokenizer.from_file(PATH), defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r[0]].append(r)
        by_seq[r[5]].append(r)
    assert set(by_doc) == set(texts)
    for i, text in texts.items():
        ids, at = [*tok.encode(text or "", add_special_tokens=False).ids, 1], 0
        for _, start, length, crc, total, _, _ in sorted(by_doc[i], key=lambda r: r[1]):
            assert start == at and length > 0 and total == len(ids)
            assert crc == zlib.crc32(np.array(ids[start : start + length], "<u4").tobytes())
            at += length
        assert at == len(ids)
    padded = 0
    for own in by_seq.values():
        at = 0
        for r in sorted(own, key=lambda r: r[6]):
            assert r[6] == at
            at += r[2]
        assert at <= 2048
        padded += 0 if at & (at - 1) == 0 else 2048 - at
    return padded


def test_query_equals_brute_force(spark, sf):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = [tuple(r) for r in queries.op1_packing(spark, sf).collect()]
    assert check_pieces(rows, texts) == 0


def test_odd_texts(docs_of, odd_texts):
    rows = [tuple(r) for r in queries.packed(docs_of(odd_texts)).collect()]
    check_pieces(rows, dict(enumerate(odd_texts)))
    assert queries.packed(docs_of([])).count() == 0


def items(sizes, bears=None):
    return [packing.Item(k, 0, np.arange(n, dtype=np.uint32), None if bears is None else np.arange(n) >= n - bears[k], n) for k, n in enumerate(sizes)]


def test_three_limits_hold_at_once():
    rng = np.random.default_rng(0)
    sizes = rng.integers(1, 400, 900).tolist()
    bears = [int(rng.integers(0, n + 1)) for n in sizes]
    for cut in (True, False):
        out = list(packing.pack_items(iter(items(sizes, bears)), 512, 7, 256, cut, pool=200))
        for b in out:
            assert sum(len(i.ids) for i in b) <= 512 and len(b) <= 7 and sum(int(i.loss.sum()) for i in b) <= 256
        assert sum(len(i.ids) for b in out for i in b) == sum(sizes)
        if not cut:
            assert sum(len(b) for b in out) == len(sizes) + sum(1 for x in bears if x > 256)
            assert sum(sizes) / (512 * len(out)) > 0.7


def test_dot_product_balances_dimensions():
    """Long items with little loss go with short ones with much: each pair fills both limits."""
    sizes, bears = [90] * 20 + [10] * 20, [10] * 20 + [10] * 20
    out = list(packing.pack_items(iter(items(sizes, bears)), 100, 2, 20, False, pool=100))
    assert len(out) == 20 and all(sorted(len(i.ids) for i in b) == [10, 90] for b in out)


def test_instruction_data_marks_answers(spark, sf):
    turns = spark.read.parquet(f"{sf}/conversations.parquet")
    df = turns.selectExpr("conv_id", "text", "role = 'assistant' AS answer", "1 AS ids", "2 AS start")
    got = packing.pack(df, PATH, "conv_id", loss_col="answer", final_id=None, max_loss=1024, cuttable=False).collect()
    assert sum(r["length"] for r in got) == sum(len(Tokenizer.from_file(PATH).encode(r["text"] or "", add_special_tokens=False).ids) for r in turns.collect())


def test_null_ids_repeated_rows_and_clashing_names(spark):
    rows = [(None, "a b c", 1, 2), (None, "a b c", 1, 2), (5, "x y", 3, 4), (5, "x y", 3, 4), (5, "x y", 3, 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, key int, offset int")
    got = packing.pack(df, PATH).collect()
    sizes = {t: len(Tokenizer.from_file(PATH).encode(t, add_special_tokens=False).ids) + 1 for t in ("a b c", "x y")}
    assert sum(r["length"] for r in got if r["key"] is None) == 2 * sizes["a b c"]
    assert sum(r["length"] for r in got if r["key"] == 5) == 3 * sizes["x y"]


def test_pieces_are_the_tokenizers_own():
    """Whatever its case and the marks around it, a word of Latin letters is learnt once; ids are the library's."""
    words = packing.WordTokenizer(PATH)
    next(words.encode(["Abc, abc. (ABC) \"abc\" aBc!"]))
    assert set(words.known) == {"abc", ",", ".", "(", ")", '"', "!"}
    rng, letters = np.random.default_rng(2), list("abZéÉßþÞ×÷012'''stredvml.,!?<|>-\t\n \x0b\x1c\xa0µº…«İΣςé中①²")
    texts = ["".join(rng.choice(letters[:n], rng.integers(0, 30))) for n in (33, len(letters)) for _ in range(2000)]
    words.LIMIT = 300
    for got, want in zip(words.encode(texts), words.full.encode_batch(texts, add_special_tokens=False), strict=True):
        assert got.tolist() == want.ids


def test_a_task_leaves_one_generation_of_words_behind(monkeypatch):
    """Workers outlive their tasks: the older generation isn't kept between them, and ids stay the same."""
    import public_tokenizers

    from tessella.llm.packing import WordTokenizer

    monkeypatch.setattr(WordTokenizer, "LIMIT", 40)
    words = WordTokenizer(public_tokenizers.path("word_bpe_49k.json"))
    texts = [" ".join(f"{a}{b}ing" for b in "abcdefghij") for a in "klmnopqrst"]
    whole = [words.full.encode(t, add_special_tokens=False).ids for t in texts]
    ids = lambda: [x.tolist() for t in texts for x in words.encode([t])]
    assert ids() == whole and words.older
    words.rest()
    assert not words.older and ids() == whole
