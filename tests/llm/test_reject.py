import numpy as np
import pytest

import corpus_pipeline as cp

LEARNED = {
    "en": "the of and that is was for with this word there people which would about their after other",
    "fr": "que les une des est dans pour mais avec sont leur tout cette comme nous vous elle plus",
    "de": "der die und das nicht ist von sich auch ein eine wird haben werden sein noch nach über",
    "es": "los una del las por con para como pero sus entre cuando muy sin sobre también hasta hay",
}
OTHERS = [
    "nopea ruskea kettu hyppää laiskan koiran yli eikä kukaan tiedä miksi näin tapahtui",
    "Быстрая коричневая лиса прыгает через ленивую собаку",
    "qxzv jkwq zzkp vvbn wqxj kpzt xcvq gghj",
]


@pytest.mark.parametrize("k", [1, 2, 3, 4])
def test_texts_in_no_learned_language_go(spark, k):
    rng = np.random.default_rng(k)
    rows = [(i, " ".join(rng.choice(LEARNED[lang].split(), 40)), lang) for i, lang in enumerate(list(LEARNED)[:k] * 40)]
    others = [(1000 + i, f"{t} " * n, None) for i, (t, n) in enumerate((t, n) for t in OTHERS for n in (1, 30))]
    # Text that begins in a learned language is judged over its whole length.
    others.append((2000, rows[0][1] + " " + OTHERS[2] * 20, None))
    short = [(3000, LEARNED["en"].split()[0], None)]
    docs = spark.createDataFrame(rows + others + short, "doc_id long, text string, lang string")
    got = {r["doc_id"] for r in cp.language_id(spark, docs, "").collect()}
    assert got == {r[0] for r in rows + short}
