import numpy as np
import pytest

from tessella.llm import langid, queries


def test_held_out_accuracy(spark):
    path = "/root/testdata/sf0.01"
    truth = {r["doc_id"]: (r["lang"], r["text"]) for r in spark.read.parquet(f"{path}/documents.parquet").collect()}
    got = queries.op3_language_id(spark, path).collect()
    assert len(got) == len(truth)
    held = [r for r in got if r["held_out"]]
    assert {r["doc_id"] for r in held} == {i for i in truth if langid.crc_fold(i) == 0}
    right = sum(r["lang_pred"] == truth[r["doc_id"]][0] for r in held)
    assert right / len(held) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got)


def test_labels_of_the_held_out_fold_do_not_matter(spark):
    docs = [(i, "the and of them that is word " * 5 if i % 2 else "que pour les une dans est mot " * 5, "en" if i % 2 else "fr", "s", 1) for i in range(60)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    turned = [(i, t, "xx" if langid.crc_fold(i) == 0 else g, s, n) for i, t, g, s, n in docs]
    out = []
    for rows in (docs, turned):
        df = spark.createDataFrame(rows, schema)
        from pyspark.sql import functions as F

        model = langid.fit(df.where(~langid.is_held_out(F.col("doc_id"))), per_language=16)
        out.append(sorted(tuple(r) for r in df.select("doc_id", langid.language(F.col("text"), model).alias("p")).select("doc_id", "p.*").collect()))
    assert out[0] == out[1]
    assert all(r[1] == ("en" if r[0] % 2 else "fr") for r in out[0])


def test_odd_texts(spark, docs_of, odd_texts):
    from pyspark.sql import functions as F

    df = docs_of(odd_texts)
    assert langid.fit(df) is None
    model = langid.train(["the and of " * 40, "que les une " * 40], ["en", "fr"], epochs=2)
    got = {r["doc_id"]: r["p"] for r in df.select("doc_id", langid.language(F.col("text"), model).alias("p")).collect()}
    for i in (0, 1, 2, 9):
        assert got[i]["lang_pred"] == "und" and got[i]["score"] == 0
    assert all(got[i]["lang_pred"] in ("en", "fr") for i in (3, 4, 8, 10, 11))
    assert {r["p"]["lang_pred"] for r in df.select(langid.language(F.col("text"), None).alias("p")).collect()} == {"und"}


def naive(net, text):
    """Every window, position, filter and width one by one; the windows' probabilities by the bytes they cover."""
    raw, total = text.encode(), 0
    for at in range(0, len(raw), net.window):
        padded = (raw[at : at + net.window + 3] + bytes(net.window + 3))[: net.window + 3]
        pooled = [max(sum(float(net.taps[w][k][padded[p + k], f]) for k in range(w)) for p in range(net.window)) for w in langid.WIDTHS for f in range(net.taps[w][0].shape[1])]
        z = np.maximum(np.array(pooled) + net.bias, 0) @ net.out + net.out_bias
        z = np.exp(z - z.max())
        total = total + z / z.sum() * len(raw[at : at + net.window])
    return total / len(raw)


def test_forward_equals_a_naive_convolution():
    texts = ["the and of that is " * 40, "que les une des " * 40]
    net = langid.train(texts, ["en", "fr"], window=32, filters=4, epochs=2)
    for text in (*texts, "a", "é" * 50, "the que " * 9 + "x", "z" * 32, "z" * 33):
        want = naive(net, text)
        (label,), (score,) = net.predict(iter([text]))
        assert label == net.languages[int(want.argmax())] and score == pytest.approx(want.max(), abs=1e-5)


def test_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(2)
    window, filters = 16, 3
    params = [rng.normal(0, 0.3, (256, filters)) for _ in range(sum(langid.WIDTHS))] + [rng.normal(0, 0.3, 3 * filters), rng.normal(0, 0.5, (3 * filters, 3)), rng.normal(0, 0.1, 3)]
    x, y, share = rng.integers(0, 256, (6, window + 3)).astype(np.uint8), np.array([0, 1, 2, 0, 1, 2]), np.array([1.0, 0.5, 2.0])
    loss = lambda: langid.gradients(params, x, y, share, window, filters)[0]
    _, grads = langid.gradients(params, x, y, share, window, filters)
    for p, g in zip(params, grads, strict=True):
        for i in np.argsort(np.abs(g).ravel())[-3:]:
            at = np.unravel_index(i, g.shape)
            old = p[at]
            p[at] = old + 1e-6
            up = loss()
            p[at] = old - 1e-6
            down = loss()
            p[at] = old
            assert (up - down) / 2e-6 == pytest.approx(g[at], rel=1e-3, abs=1e-7)


def test_query_over_odd_tables(spark, tmp_path):
    rows = [(None, "the and of that " * 9, "en", 1), (1, "que les une des " * 9, "fr", 2), (1, "que les une des " * 9, "fr", 2), (2, "the and of that " * 9, "en", 3), (3, None, None, 4), (4, "the and " * 9, None, 5), (6, "que les " * 9, "fr", 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, p int")
    df.write.parquet(str(tmp_path / "a" / "documents.parquet"))
    got = queries.op3_language_id(spark, str(tmp_path / "a")).collect()
    assert len(got) == 7 and {r["held_out"] for r in got if r["doc_id"] is None} == {False}
    assert {r["lang_pred"] for r in got if r["doc_id"] == 3} == {"und"}
    df.limit(0).write.parquet(str(tmp_path / "b" / "documents.parquet"))
    assert queries.op3_language_id(spark, str(tmp_path / "b")).count() == 0
