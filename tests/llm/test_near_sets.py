import numpy as np

import corpus_pipeline as cp
from tessella.llm import near_sets, simhash


def brute_set(text, size=5):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def brute_kept(rows):
    """rows: (id, text) in any number; those whose component at a Jaccard similarity of 0.8 has no smaller id, in order."""
    rows, sets = list(rows), [brute_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i + 1, len(sets)):
            b = sets[j]
            if 4 * max(len(a), len(b)) <= 5 * min(len(a), len(b)) and 5 * len(a & b) >= 4 * len(a | b):
                parent[find(j)] = find(i)
    least = {}
    for n, (i, _) in enumerate(rows):
        root = find(n)
        least[root] = min(least.get(root, i), i)
    return [r for n, r in enumerate(rows) if least[find(n)] == r[0]]


def test_stage_equals_brute_force_at_0_8(spark, docs_of):
    rng = np.random.default_rng(5)
    word = lambda: f"w{rng.integers(5000)}"
    texts, line = [], "this very common line stands in most of the texts here"
    for n in (8, 40, 130, 400):
        for _ in range(6):
            base = [word() for _ in range(n)]
            for _ in range(6):  # chains: similarities on both sides of 0.8
                texts.append(" ".join(base) + (f" {line}" if rng.random() < 0.5 else ""))
                for at in rng.choice(n, max(1, n // 60), replace=False).tolist():
                    base[at] = word()
    texts += ["", None, " \n", "a b", "A B", "a b c", line, line + " "]
    order = rng.permutation(len(texts)).tolist()
    df = docs_of(list(zip(order, texts, strict=True)))
    got = {r["doc_id"] for r in dict(cp.STAGES)["simhash_near_dedup"](spark, df, "").collect()}
    assert got == (want := {i for i, _ in brute_kept(list(zip(order, texts, strict=True)))})
    assert 30 < len(want) < len(texts)
    assert {r["doc_id"] for r in near_sets.keep_one(df, sample=0).collect()} == want


def test_rows_that_share_an_id_go_by_their_own_text(docs_of):
    t, u, v = ("".join(f"{w}{i} " for i in range(60)) for w in "tuv")
    rows = [(1, t), (2, t + " end"), (2, u), (3, v), (4, v + " more"), (1, u + " x"), (5, ""), (6, None)]
    for rows_ in (rows[:4], rows):
        want = brute_kept(rows_)
        df = docs_of(rows_)
        assert sorted(((r["doc_id"], r["text"]) for r in near_sets.keep_one(df).collect()), key=str) == sorted(want, key=str)
        assert {(1, t), (2, u), (3, v)} <= {(r["doc_id"], r["text"]) for r in simhash.keep_one(df).collect()} | ({(2, u)} if rows_ is rows else set())
    assert (2, u) in brute_kept(rows[:4])


def test_a_hub_and_a_common_line(docs_of):
    """Many near copies of one text, and a line that a part of all texts share: one link a copy, and no text without copies goes."""
    rng = np.random.default_rng(8)
    base = [f"b{i}" for i in range(200)]
    line = " ".join(f"c{i}" for i in range(8))
    rows = [(i, " ".join([*base[:190], f"x{i}"])) for i in range(1500)]
    rows += [(2000 + i, f"{line} " + " ".join(f"w{n}" for n in rng.integers(0, 10**6, 12))) for i in range(1500)]
    kept = {r["doc_id"] for r in near_sets.keep_one(docs_of(rows).repartition(4)).collect()}
    assert kept == {0, *range(2000, 3500)}


def test_a_large_group_whose_members_differ(docs_of, monkeypatch):
    """Copies that are each near the others but not all near one of them: rounds take the pairs away before they are made."""
    rng = np.random.default_rng(9)
    base = [f"b{i}" for i in range(300)]
    rows = []
    for i in range(700):
        own = list(base)
        for at in rng.choice(300, 5 + i % 4, replace=False).tolist():
            own[at] = f"x{i}_{at}"
        rows.append((i, " ".join(own)))
    want = {i for i, _ in brute_kept(rows)}
    made = []
    plain = near_sets._pairs
    monkeypatch.setattr(near_sets, "_pairs", lambda least: made.append(1) or plain(least))
    assert {r["doc_id"] for r in near_sets.keep_one(docs_of(rows).repartition(4)).collect()} == want and made
    monkeypatch.setattr(near_sets, "ROUNDS", 0)
    assert {r["doc_id"] for r in near_sets.keep_one(docs_of(rows).repartition(4)).collect()} == want


def test_fingerprints_link_first(spark, docs_of, monkeypatch):
    """Operator 8's anchors give links that span all groups at three bits; what they link is checked, and the rest is found after them."""
    rng = np.random.default_rng(11)
    rows = []
    for g in range(12):
        base = [f"g{g}w{i}" for i in rng.integers(0, 10**6, 260)]
        for c in range(5):
            own = list(base)
            for at in rng.choice(260, [0, 1, 1, 2, 9][c], replace=False).tolist():
                own[at] = f"c{c}x{at}"
            rows.append((len(rows), " ".join(own)))
    rows += [(100, rows[0][1] + " " + rows[0][1]), (101, ""), (102, None), (103, "a b")]

    def brute_print(text):
        bits = [[int(b) for b in f"{h:064b}"] for h in near_sets.hashes_of(text, 5).tolist()]
        return sum((2 * sum(column) > len(bits)) << (63 - n) for n, column in enumerate(zip(*bits, strict=True)))

    prints = [brute_print(t) for _, t in rows]
    assert [near_sets.print_of(near_sets.hashes_of(t, 5)) % 2**64 for _, t in rows] == prints
    assert [int.from_bytes(simhash.fingerprint_bytes(t, 5), "big") for _, t in rows] == prints
    signed = [p - 2**64 if p >> 63 else p for p in prints]
    sets = spark.createDataFrame([(n, p, 7) for n, p in enumerate(signed)], "v long, fp long, n int")
    pairs = [(r["a"], r["b"]) for r in near_sets.print_pairs(sets).collect()]
    assert all((prints[a] ^ prints[b]).bit_count() <= 3 for a, b in pairs) and len(set(pairs)) == len(pairs)

    def groups(links):
        label = list(range(len(rows)))
        for _ in label:
            for a, b in links:
                label[a] = label[b] = min(label[a], label[b])
        return label

    near = [(a, b) for a in range(len(rows)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 3]
    assert groups(pairs) == groups(near) and 12 < len(set(groups(near))) < len(rows) - 12

    made, plain = [], near_sets.near_links
    monkeypatch.setattr(near_sets, "near_links", lambda fps: made.append(1) or plain(fps))
    assert sorted((r["doc_id"], r["text"]) for r in near_sets.keep_one(docs_of([r for r in rows if r[1]])).collect()) == brute_kept([r for r in rows if r[1]]) and made


def _bits(hashes):
    odd = np.bincount((np.array(hashes, np.uint64) % np.uint64(near_sets.BITS)).astype(np.int64), minlength=near_sets.BITS) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def test_a_pair_comes_once_and_the_nearest_once_a_member(monkeypatch):
    """However many meetings two sets share, a place gives their pair once, with all their shingles; a round gives a member one pair a meeting."""
    import pyarrow as pa

    common = list(range(1, 200))
    sets = [[*common, 1000 + 3 * i, 1001 + 3 * i, 1002 + 3 * i] for i in range(30)]
    rows = [(g, 0, v, v, 202, 2 + g, _bits(sets[v])) for g in range(50) for v in range(30)]
    batch = pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows, strict=True)], ["g", "at", "v", "label", "n", "c", "bits"])
    batches = [batch.slice(at, 512) for at in range(0, batch.num_rows, 512)]
    got = [tuple(r.values()) for b in near_sets._pairs(near_sets.Fraction("0.8"))(iter(batches)) for r in b.to_pylist()]
    assert sorted(got) == [(a, b, 202, 202, sum(range(2, 52))) for a in range(30) for b in range(a + 1, 30)]
    for crowd in (1024, 7):
        monkeypatch.setattr(near_sets, "CROWD", crowd)
        near = [tuple(r.values())[:2] for b in near_sets._nearest(near_sets.Fraction("0.8"), 0)(iter(batches)) for r in b.to_pylist()]
        assert len(near) == len(set(near)) <= 30 and {x for p in near for x in p} == set(range(30))


def test_rows_of_pairs_follow_the_group_not_its_square(spark, docs_of, monkeypatch):
    """Groups in which each text is near a few others and meets many: rows of pairs stay a few a member, and the result is exact."""
    rng = np.random.default_rng(21)
    rows = []
    for g in range(2):
        base = [f"g{g}b{i}" for i in range(240)]
        for i in range(160):
            own = list(base)
            for at in rng.choice(240, 6 + i % 6, replace=False).tolist():
                own[at] = f"x{g}_{i}_{at}"
            rows.append((len(rows), " ".join(own)))
    made, plain = [], near_sets.materialise

    def counted(df, label):
        stored = plain(df, label)
        if label.endswith("-pairs") or label == "edges":
            made.append((label, stored.count()))
        return stored

    monkeypatch.setattr(near_sets, "materialise", counted)
    monkeypatch.setattr(simhash, "materialise", counted)
    want = {i for i, _ in brute_kept(rows)}
    assert {r["doc_id"] for r in near_sets.keep_one(docs_of(rows).repartition(3)).collect()} == want
    assert all(n <= 6 * len(rows) for label, n in made if not label.startswith("prints")), made
    for name, value in (("ROUNDS", 0), ("TOGETHER", 100), ("CROWD", 8)):
        monkeypatch.setattr(near_sets, name, value)
        assert {r["doc_id"] for r in near_sets.keep_one(docs_of(rows).repartition(3)).collect()} == want


def test_labels_are_raised(spark):
    """Links between components already found join their labels alone."""
    labels = spark.createDataFrame([(2, 1), (3, 1), (11, 10), (21, 20)], "v long, label long")
    links = spark.createDataFrame([(3, 11), (2, 11), (30, 31), (2, 3)], "a long, b long")
    got = sorted(map(tuple, near_sets.merged(labels, links).select("v", "label").collect()))
    assert got == [(2, 1), (3, 1), (10, 1), (11, 1), (21, 20), (31, 30)]
    assert sorted(map(tuple, near_sets.merged(labels, links.limit(0)).select("v", "label").collect())) == sorted(map(tuple, labels.collect()))
