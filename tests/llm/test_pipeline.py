"""The pipeline and each of its stages against brute-force versions."""

import numpy as np
import pytest
from pyspark.sql import types as T
from test_near_sets import brute_kept
from test_packing import check_pieces
from test_simhash import brute_fingerprint as simhash_of

import corpus_pipeline as cp
from tessella.llm import langid

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def corpus(spark):
    rng = np.random.default_rng(3)
    words = {"en": "the of and that is was for with this word there people".split(), "fr": "que les une des est dans pour mais avec sont leur tout".split()}
    rows, i = [], 0
    for lang in ("en", "fr"):
        for _ in range(40):
            text = " ".join(rng.choice(words[lang], 60))
            rows.append((i, text, lang, "s", len(text)))
            i += 1
    long = " ".join(rng.choice(words["en"], 900))
    apart = long.split()  # at 0.8 and more of the longer text's shingles, though far beyond three bits of a fingerprint
    apart[100:190] = rng.choice(words["en"], 90).tolist()
    assert bin(simhash_of(long) ^ simhash_of(" ".join(apart))).count("1") > 3
    for t in (" ".join(apart), rows[3][1], rows[3][1], rows[50][1], "### $$$ 123", "", long, long[:-5] + "thing", long + " end"):
        rows.append((i, t, "en", "s", len(t)))
        i += 1
    rows += [(i, None, None, None, None), (None, rows[7][1], "en", None, 1), (None, None, None, None, None), (3, rows[3][1], "en", "s", 1)]
    schema = T.StructType([T.StructField(c, T.LongType() if c in ("doc_id", "n_chars") else T.StringType()) for c in COLUMNS])
    return spark.createDataFrame(rows, schema).repartition(3), rows


def plain(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_each_stage_on_its_own_input(spark, corpus):
    df, rows = corpus
    model = langid.fit(df.where(~langid.is_held_out(df["doc_id"])))
    labels, scores = model.predict(iter([r[1] for r in rows]))
    want = [r for r, g, s in zip(rows, labels, scores, strict=True) if g != "und" and s >= cp.LEAST_SCORE]
    stages = dict(cp.STAGES)
    first = stages["language_id"](spark, df, "")
    assert first.columns == COLUMNS and plain(first) == sorted(want, key=str)
    assert len(want) == len([r for r in rows if r[1] and any(map(str.isalpha, r[1]))])

    second = stages["exact_dedup"](spark, df, "")
    best = {}
    for r in rows:
        t = r[1] or ""
        best[t] = min((x for x in (best.get(t), r[0]) if x is not None), default=None)
    assert second.columns == COLUMNS and sorted((r["text"] or "") for r in second.collect()) == sorted(best)
    assert all(r["doc_id"] == best[r["text"] or ""] for r in second.collect())

    third = stages["simhash_near_dedup"](spark, df, "")
    kept = set(brute_kept([r[:2] for r in rows if r[0] is not None]))
    assert third.columns == COLUMNS and plain(third) == sorted((r for r in rows if r[0] is None or r[:2] in kept), key=str)

    ids = {r[0]: r[1] for r in rows if r[0] is not None}
    unique = df.where(df["doc_id"].isNotNull()).dropDuplicates(["doc_id"])
    assert check_pieces([tuple(r) for r in stages["packing"](spark, unique, "").collect()], ids) == 0


def test_run(spark, corpus, tmp_path):
    df, rows = corpus
    df.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).write.parquet(str(tmp_path / "documents.parquet"))
    seen, kept = {}, {}
    for r in sorted({r[0]: r for r in reversed(rows) if r[0] is not None}.values()):
        if r[1] and any(map(str.isalpha, r[1])) and r[1] not in seen:
            seen[r[1]] = r[0]
            kept[r[0]] = r[1]
    left = dict(brute_kept(list(kept.items())))
    assert check_pieces([tuple(r) for r in cp.run(spark, str(tmp_path)).collect()], left) == 0
    assert len(left) < len(kept) < len(rows)


def test_odd_tables(spark, docs_of, odd_texts):
    clash = docs_of(odd_texts, "en").selectExpr("*", "1 AS judged", "2 AS gone", "3 AS kid", "'x' AS dsha", "4 AS copies", "5 AS label", "6 AS again")
    texts = dict(enumerate(odd_texts))
    first = {t or "": i for i, t in reversed(texts.items())}
    for name, stage in cp.STAGES:
        out = stage(spark, clash, "")
        if name == "packing":
            check_pieces([tuple(r) for r in out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset").collect()], texts)
        else:
            assert out.columns == clash.columns
            kept = {r["doc_id"]: r for r in out.collect()}
            assert all(r["text"] == texts[i] and tuple(r)[5:] == (1, 2, 3, "x", 4, 5, 6) for i, r in kept.items())
            if name == "exact_dedup":
                assert set(kept) == set(first.values())
            elif name == "simhash_near_dedup":
                assert set(kept) == {i for i, _ in brute_kept(list(texts.items()))}
            else:
                assert {texts[i] for i in kept} <= {t for t in odd_texts if t and any(map(str.isalpha, t))}
        assert stage(spark, clash.limit(0), "").count() == 0
