import re

import numpy as np

from tessella.llm import license_scan, queries
from tessella.llm.license_texts import TEMPLATES

LINES = {"Licensed under the Apache License, Version 2.0.": "Apache-2.0-line", "Released under the MIT License.": "MIT-line", "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0-line", "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0-line"}


def test_query_finds_exactly_the_lines_that_a_search_finds(spark):
    path = "/root/testdata/sf0.01"
    want = {(r["doc_id"], name, m.start(), m.end() - 1) for r in spark.read.parquet(f"{path}/documents.parquet").collect() for line, name in LINES.items() for m in re.finditer(re.escape(line), r["text"] or "")}
    got = queries.op6_license_scan(spark, path).collect()
    exact = {(r["doc_id"], r["license"], r["span_start"], r["span_end"]) for r in got if r["coverage"] == 1}
    assert want and want <= exact
    assert {r["doc_id"] for r in got} == {w[0] for w in want}


def brute(doc, t):
    """(score, matches) of the best full local alignment; of equal scores the one with more matches."""
    best, above = (0, 0), [(0, 0)] * (len(t) + 1)
    for word in doc:
        row = [(0, 0)]
        for j, x in enumerate(t):
            same = int(word == x)
            step = lambda cell, score, hit=0: (cell[0] + score, cell[1] + hit)
            row.append(max(step(above[j], 2 if same else -1, same), step(above[j + 1], -1), step(row[j], -1), (0, 0)))
        best, above = max(best, *row), row
    return best


def test_banded_alignment_equals_full_alignment():
    rng = np.random.default_rng(0)
    for turn in range(60):
        t = rng.integers(1, 9 if turn % 2 else 40, 25)
        body = np.delete(t, rng.integers(0, 25, 2)) if turn % 3 else np.insert(t, [4, 9, 9], [50, 51, 52])
        doc = np.concatenate([rng.integers(1, 9, 5), body, rng.integers(1, 9, 5)])
        assert license_scan.align(doc, t, -40, 40)[0] == brute(doc.tolist(), t.tolist())[1]


def test_edited_and_repeated_texts():
    scanner = license_scan.Scanner(TEMPLATES, 3, 3, 0.8)
    rng = np.random.default_rng(1)
    for name, text in TEMPLATES.items():
        hit = scanner.scan(f"Intro words here. {text} And an outro.")
        assert [m[0] for m in hit] == [name] and hit[0][1] == 1.0
        words = text.split()
        if len(words) > 30:
            for i in rng.choice(len(words), len(words) // 12, replace=False):
                words[i] = "changed"
            hit = scanner.scan("x " * 50 + " ".join(words))
            assert name in {m[0] for m in hit} and all(0.8 <= m[1] < 1 for m in hit)
    twice = f"{TEMPLATES['ISC']} between the two {TEMPLATES['ISC']}"
    assert [m[0] for m in scanner.scan(twice)] == ["ISC", "ISC"]
    assert scanner.scan("the and of " * 3000) == []


def test_odd_texts(docs_of, odd_texts, spark):
    line = "Released under the MIT License."
    texts = [*odd_texts, f"İİ ﬁ {line}", line, line]
    got = license_scan.scan(docs_of(texts)).collect()
    n = len(odd_texts)
    assert sorted((r["doc_id"], r["span"]) for r in got) == [(n + i, line[:-1]) for i in range(3)]
    assert license_scan.scan(docs_of([])).count() == 0
    clash = spark.createDataFrame([(None, line, "q")], "doc_id long, text string, license string")
    assert [(r["doc_id"], r["license"]) for r in license_scan.scan(clash).collect()] == [(None, "MIT-line")]


def test_every_template_repeated_back_to_back():
    scanner = license_scan.Scanner(TEMPLATES, 3, 3, 0.8)
    for name, text in TEMPLATES.items():
        for n in range(1, 7):
            hits = scanner.scan(" ".join([text] * n))
            assert [m[0] for m in hits] == [name] * n
            assert all(m[1] == 1.0 for m in hits) and len({m[3] for m in hits}) == n


def test_edited_copies_that_follow_each_other_directly():
    scanner = license_scan.Scanner(TEMPLATES, 3, 3, 0.8)
    for name in ("MIT", "ISC", "GPL-3.0", "BSD-2-Clause"):
        words = TEMPLATES[name].split()
        words[20] = words[41] = "changed"
        del words[30]
        for n in (2, 4):
            hits = scanner.scan(" ".join(words * n))
            assert [m[0] for m in hits] == [name] * n and all(0.8 <= m[1] < 1 for m in hits)
            assert all(a[4] <= b[3] for a, b in zip(hits, hits[1:], strict=False))


def test_a_recurring_phrase_takes_time_in_proportion():
    import time

    scanner = license_scan.Scanner(TEMPLATES, 3, 3, 0.8)
    begun = time.process_time()
    assert scanner.scan("the above copyright notice and this permission notice " * 20_000) == []
    assert time.process_time() - begun < 10
    line = "Released under the MIT License."
    assert len(scanner.scan("\n".join([line] * 3000))) == 3000


def test_ties_go_to_the_earlier_span_then_to_the_name():
    found = [("b", 1.0, 5, 0, 9), ("a", 1.0, 5, 0, 9), ("c", 1.0, 5, 1, 9), ("d", 1.0, 6, 3, 12), ("e", 1.0, 4, 4, 12)]
    assert license_scan.outermost(found) == [("a", 1.0, 5, 0, 9), ("d", 1.0, 6, 3, 12)]
