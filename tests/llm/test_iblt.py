import hashlib

import pytest
import xxhash
from pyspark.sql import functions as F

from tessella.llm import iblt, queries


SPACE = " \t\n\x0b\f\r"


def pieces(text):
    """Letter by letter: the first word, then pieces of twelve words and up to a sentence's or line's end, 32 at most."""
    out, at, n = [], 0, len(text)

    def word(e):
        stop = min(n, e + 64)
        while e < stop and text[e] not in SPACE:
            e += 1
        return e

    def gap(e, within_line):
        stop = min(n, e + 64)
        while e < stop and text[e] in SPACE and not (within_line and text[e] == "\n"):
            e += 1
        return e

    if text and text[0] not in SPACE:
        at = gap(word(0), False)
        out.append(text[:at])
    while at < n:
        if text[at] in SPACE:
            at = gap(at, False)
            continue
        e, count = at, 0
        while e < n and text[e] not in SPACE:
            count, w = count + 1, word(e)
            e = gap(w, True)
            if e < n and text[e] == "\n" or count == 32 or (count > 11 and text[w - 1] in ".!?…。！？"):
                e = gap(w, False)
                break
        out.append(text[at:e])
        at = e
    return [p.rstrip(SPACE) for p in out]


def paragraphs(text):
    return {xxhash.xxh64_intdigest(p.encode(), seed=42) for p in pieces(text or "")}


def jaccard(a, b):
    a, b = paragraphs(a), paragraphs(b)
    return 1.0 if not a | b else len(a & b) / len(a | b)


def brute(texts):
    """texts: {id: text}; (n_chars, edited_sha256, near_edited, near_next)."""
    ids, out = sorted(texts, reverse=True), {}
    for n, i in enumerate(ids):
        text, following = texts[i] or "", texts[ids[(n + 1) % len(ids)]] or ""
        k = len(text) // 3
        edit = text[: len(text) - k] + following[:k]
        out[i] = (len(text), hashlib.sha256(edit.encode()).hexdigest(), pytest.approx(jaccard(text, edit)), pytest.approx(jaccard(text, following)))
    return out


def rows(df):
    return {r["doc_id"]: (r["n_chars"], r["edited_sha256"], r["near_edited"], r["near_next"]) for r in df.collect()}


def test_query_equals_brute_force(spark, sf):
    want = brute({r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()})
    assert rows(queries.op10_fingerprints(spark, sf)) == want


def test_ranges_meet_at_their_ends(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").repartition(5)
    want = brute({r["doc_id"]: r["text"] for r in docs.collect()})
    got = {r["id"]: r["next_text"] for r in iblt.with_next(docs, "doc_id", "text", rows_a_range=7).collect()}
    assert len(got) == len(want)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    ids = sorted(texts, reverse=True)
    assert got == {i: texts[ids[(n + 1) % len(ids)]] for n, i in enumerate(ids)}


def test_odd_texts(docs_of, odd_texts):
    texts = dict(enumerate([*odd_texts, "\n".join(f"line {i}" for i in range(3000)), "x\nx\nx\n\ny", None, "one"]))
    got = iblt.versions(docs_of(list(texts.items())))
    assert rows(got) == brute(texts)
    by_text = {}
    for r in got.collect():
        assert by_text.setdefault(texts[r["doc_id"]] or "", r["fingerprint"]) == r["fingerprint"]
        assert len(r["fingerprint"]) == 24 * 32
    assert iblt.versions(docs_of([])).count() == 0
    assert rows(iblt.versions(docs_of([(5, "abc")]))) == brute({5: "abc"})
    assert iblt.versions(docs_of([(1, "a\nb"), (1, "a\nb"), (None, "c"), (None, None)])).count() == 4


def test_peeling_recovers_digests_or_says_so(spark):
    for n, m, ok in ((0, 0, True), (5, 3, True), (40, 40, False)):
        a, b = [f"p{i}" for i in range(n)] + ["both"], [f"q{i}" for i in range(m)] + ["both"]
        df = spark.createDataFrame([("\n".join(a), "\n".join(b))], "a string, b string").select(iblt.digests(F.col("a")).alias("a"), iblt.digests(F.col("b")).alias("b"))
        got = df.select(iblt.peel(iblt.subtract(iblt.sketch(F.col("a")), iblt.sketch(F.col("b"))), iblt.BASE).alias("f")).first()["f"]
        if not ok:
            assert got is None
        else:
            signed = lambda x: x - 2**64 if x >= 2**63 else x
            want = {(signed(x), 1) for x in paragraphs("\n".join(a[:n]))} | {(signed(x), -1) for x in paragraphs("\n".join(b[:m]))}
            assert {(r["key"], r["sign"]) for r in got} == want


def test_shared_text_shows(spark):
    """Two thirds of a text are kept: its likeness to the edited text is above that to the next document's."""
    path = "/root/testdata/sf0.01"
    words = {r["doc_id"]: len((r["text"] or "").split()) for r in spark.read.parquet(f"{path}/documents.parquet").collect()}
    got = [r for r in queries.op10_fingerprints(spark, path).collect() if words[r["doc_id"]] >= 3]
    assert sum(r["near_edited"] > r["near_next"] for r in got) >= 0.99 * len(got)


def test_ids_must_be_integers(spark):
    df = spark.createDataFrame([("x", "a b")], "doc_id string, text string")
    with pytest.raises(ValueError, match="integer"):
        iblt.versions(df)
    clash = spark.createDataFrame([(1, "a b", 5, "q"), (2, "a b", 6, "r")], "doc_id long, text string, range int, id string")
    assert [r["near_next"] for r in iblt.versions(clash).collect()] == [1.0, 1.0]


def test_no_python_in_the_plan(spark, sf, capsys):
    queries.op10_fingerprints(spark, sf).explain()
    assert "Python" not in (plan := capsys.readouterr().out) and "Arrow" not in plan
