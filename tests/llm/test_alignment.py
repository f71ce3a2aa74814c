import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tessella.llm import alignment, queries
from tessella.llm.bpe import byte_of_char

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def tokens(texts):
    """Of whole texts: [(id, byte)], for A and for B, by the libraries alone."""
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    table = byte_of_char()
    for t in texts:
        ids_a, ids_b = (a.encode(f" {t}", add_special_tokens=False).ids, b.encode(t)) if t else ([], [])
        of_a = [(i, bytes(table[c] for c in a.id_to_token(i))) for i in ids_a]
        of_b = [(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in ids_b]
        raw = f" {t}".encode()
        yield (of_a, of_b) if t and b"".join(x for _, x in of_a) == raw == b"".join(x for _, x in of_b) else ([], [])


def spans(of):
    at, out = 0, []
    for i, raw in of:
        out.append((i, at, at + len(raw)))
        at += len(raw)
    return out


def brute(rows):
    """rows: (id, text). Links by their definition: all pairs of tokens whose byte ranges overlap."""
    found = []
    for (key, _), (a, b) in zip(rows, tokens([t for _, t in rows]), strict=True):
        a, b = spans(a), spans(b)
        links, low = [], 0
        for i, p, q in a:
            while low < len(b) and b[low][2] <= p:
                low += 1
            for j, r, s in b[low:]:
                if r >= q:
                    break
                links.append((i, j))
        cuts = sorted({q for _, _, q in a} & {q for _, _, q in b})
        groups = []
        for lo, hi in zip([0, *cuts], cuts, strict=False):
            groups.append("|".join(",".join(str(i) for i, p, q in of if lo <= p and q <= hi) for of in (a, b)))
        found.append((key, len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""))
    count = Counter(p for *_, links, _ in found for p in set(links))
    most = {}
    for (i, _), c in count.items():
        most[i] = max(most.get(i, 0), c)
    return sorted(((k, na, nb, ng, len(ls), sum(count[p] == most[p[0]] for p in ls), sum(count[p] for p in ls), sha) for k, na, nb, ng, ls, sha in found), key=str)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_query_equals_whole_texts_encoded_by_the_libraries(spark, sf):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert got(queries.op13_alignment(spark, sf)) == brute(rows)


def test_odd_texts(docs_of, odd_texts):
    rows = list(enumerate([*odd_texts, "foo ", " foo", "  ", "a \t", "a\r\n b\rc; \r x", "a▁b", "▁", "<s> <0x41> <unk></s>", "a\x00b c\x00", "　x　 y", "a\xa0b \xa0c", "中文 文字", "\U0001f600 \U0001f468‍\U0001f469", "\n\n\tx\n", "<|endoftext|> a"]))
    rows += [(None, "a null key"), (3, "a repeated key"), (3, "a repeated key")]
    assert got(alignment.align(docs_of(rows).repartition(3), A, B)) == brute(rows)
    assert alignment.align(docs_of([]), A, B).count() == 0
    assert got(alignment.align(docs_of([(1, None), (2, "")]), A, B)) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]


def test_fuzz(docs_of):
    r = random.Random(7)
    parts = [" ", "  ", "\n", "\r", "\r\n", "\t", "\xa0", " ", "　", "\x1c", "​", "the", "word", "'s", "'ll", ";", "{", "});", "*/", "3", "١", "\xe9", "é", "ﬁ", "中", "\U0001f600", "﻿", "�", "<0x0A>", "İ", "\x00", "\x7f", "­"]
    rows = [(i, "".join(r.choices(parts, k=r.randrange(1, 25)))) for i in range(3000)]
    assert got(alignment.align(docs_of(rows).repartition(4), A, B)) == brute(rows)


def test_blocks_and_forgetting_change_nothing(docs_of, monkeypatch, tmp_path):
    r = random.Random(3)
    rows = [(i, " ".join("".join(r.choices("abcdes", k=r.randrange(1, 7))) for _ in range(r.randrange(40)))) for i in range(200)]
    rows = [(i, t.replace("a", "a\n")) for i, t in rows]
    want = brute(rows)
    assert got(alignment.align(docs_of(rows).repartition(2), A, B)) == want
    both = alignment.aligner(A, B)
    own = alignment._split(A, B, 4, alignment.pa.schema([("block", alignment.pa.int64()), ("bucket", alignment.pa.int32()), ("keys", alignment.pa.list_(alignment.pa.int64())), ("blob", alignment.pa.binary())]))
    monkeypatch.setattr(alignment, "MOST_DISTINCT", 50)
    monkeypatch.setattr(alignment, "TaskContext", type("Task", (), {"get": staticmethod(lambda: type("Own", (), {"partitionId": lambda self: 0})())}))
    batch = alignment.pa.RecordBatch.from_arrays([alignment.pa.array([i for i, _ in rows]), alignment.pa.array([t for _, t in rows])], ["key", "text"])
    made = [b.to_pylist()[0] for b in own(iter([batch]))]
    assert len({m["block"] for m in made}) > 10
    assert sorted(k for m in made for k in m["keys"] or []) == [i for i, _ in rows]
    for block in {m["block"] for m in made}:
        words = {}
        for m in made:
            if m["block"] == block and m["bucket"] is not None:
                numbers, *segments = alignment.unsqueeze(m["blob"])
                words.update(zip(alignment.np.frombuffer(numbers, "<u4").tolist(), segments, strict=True))
        for m in made:
            if m["block"] == block and m["bucket"] is None:
                sizes, flat = (alignment.np.frombuffer(x, "<u4").tolist() for x in alignment.unsqueeze(m["blob"]))
                for key, size in zip(m["keys"], sizes, strict=True):
                    text = b"".join(words[i] for i in flat[:size]).decode()
                    flat = flat[size:]
                    assert text == (f" {rows[key][1]}" if rows[key][1] else "")
    assert len(set(both.split(" a b\n\nc"))) == 3


def test_places_to_split_follow_the_vocabulary():
    assert set(alignment.breaks(["▁a", "▁▁", "b"])) >= {" ", "\n", "\t", "\r"}
    assert "\r" not in alignment.breaks([";\r"]) and " " in alignment.breaks([";\r"])
    assert " " not in alignment.breaks(["a▁b"]) and "\n" in alignment.breaks(["a▁b"])
    assert "\t" not in alignment.breaks(["▁\t"])
    assert alignment.aligner(A, B).split(" a b\r c;\rd  e") == [" a", " b\r c;\rd", "  e"]


def test_other_kinds_of_tokenizers_are_refused():
    with pytest.raises(ValueError, match="byte-level"):
        alignment.Aligner(public_tokenizers.path("word_bpe_49k.json"), B)


def test_string_keys_and_clashing_columns(spark):
    df = spark.createDataFrame([("x", "some text", 1), (None, "some text", 2)], "doc_id string, text string, block int")
    assert [r[:4] for r in got(alignment.align(df, A, B))] == [r[:4] for r in brute([("x", "some text"), (None, "some text")])]


def test_pairs_of_a_block_are_stored_in_bounded_rows(monkeypatch):
    pa, np, pc = alignment.pa, alignment.np, pytest.importorskip("pyarrow.compute")
    monkeypatch.setattr(alignment, "PAIRS", 3)
    monkeypatch.setattr(alignment, "TaskContext", type("Task", (), {"get": staticmethod(lambda: type("Own", (), {"partitionId": lambda self: 0})())}))
    listed = [("keys", pa.list_(pa.int64())), ("blob", pa.binary())]
    first = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), *listed])
    pair = pa.struct([("i", pa.int32()), ("a", pa.int32()), ("b", pa.int32()), ("docs", pa.int64())])
    second = pa.schema([("block", pa.int64()), *listed, ("pairs", pa.list_(pair))])
    rows = [(1, "one two one"), (2, "three two four five"), (3, None)]
    batch = pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows], pa.int64()), pa.array([t for _, t in rows])], ["key", "text"])
    split = pa.Table.from_batches(alignment._split(A, B, 2, first)(iter([batch])))
    buckets = split.filter(pc.is_valid(split["bucket"])).sort_by("bucket").select(["block", "bucket", "blob"])
    aligned = pa.Table.from_batches(alignment._align(A, B)(iter(buckets.to_batches())))
    made = alignment._compose(second)(split.filter(pc.is_null(split["bucket"])).select(["block", "keys", "blob"]), aligned).to_pylist()
    pairs = [m["pairs"] for m in made if m["pairs"] is not None]
    assert len(pairs) > 1 and max(map(len, pairs)) <= 3 and all(m["blob"] is None and m["keys"] is None for m in made if m["pairs"] is not None)
    flat = [p for own in pairs for p in own]
    assert [p["i"] for p in flat] == list(range(len(flat))) and sum(m["keys"] is None and m["blob"] is not None for m in made) == 1
    links = lambda t: {tuple(x) for s in alignment.aligner(A, B).split(f" {t}") for x in np.frombuffer(alignment.aligner(A, B).align([s.encode()])[0][3], "<i4").reshape(-1, 2).tolist()}
    want = [x for _, t in rows if t for x in links(t)]
    assert {(p["a"], p["b"]): p["docs"] for p in flat} == {x: want.count(x) for x in want}


def test_a_block_is_composed_within_a_few_times_its_alignments():
    """What a task holds beside a block's alignments is numbers and one buffer, not an object a segment."""
    import tracemalloc

    many, width = 60_000, 12
    rng = np.random.default_rng(3)
    counts = np.tile(np.array([width, width, width, width], "<u4"), (many, 1))
    links = rng.integers(0, 60, (many * width, 2)).astype("<i4")
    groups = b"\n".join([b"101|202"] * many)
    blob = alignment.squeeze([np.arange(many, dtype="<u4").tobytes(), counts.tobytes(), links.tobytes(), groups])
    aligned = pa.table({"block": pa.array([0], pa.int64()), "blob": pa.array([blob], pa.binary())})
    coded = np.arange(200, dtype="<u4")
    documents = pa.table({"block": pa.array([0], pa.int64()), "keys": pa.array([[7]], pa.list_(pa.int64())), "blob": pa.array([alignment._pack(np.array([200], "<u4"), coded)], pa.binary())})
    pair = pa.struct([("i", pa.int32()), ("a", pa.int32()), ("b", pa.int32()), ("docs", pa.int64())])
    schema = pa.schema([("block", pa.int64()), ("keys", pa.list_(pa.int64())), ("blob", pa.binary()), ("pairs", pa.list_(pair))])
    tracemalloc.start()
    try:
        done = alignment._compose(schema)(documents, aligned)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    digests = alignment.unsqueeze(alignment.unsqueeze(done.column("blob")[0].as_py())[1])
    assert digests == [hashlib.sha256(b";".join([b"101|202"] * 200)).digest()]
    assert peak < 600 * many
