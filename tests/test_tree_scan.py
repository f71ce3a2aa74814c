"""Scans of trees: what the driver opens is bounded, and tasks find the rest."""

import os

import pytest

from tessella.sources import tree


class Counting:
    """A file system that says which folders were listed."""

    def __init__(self, inner):
        self.inner, self.listed = inner, []

    def get_file_info(self, selector):
        self.listed.append(selector.base_dir)
        return self.inner.get_file_info(selector)

    def __getattr__(self, name):
        return getattr(self.inner, name)


@pytest.fixture
def big(tmp_path):
    """40 folders of 12 folders of 3 files, one far deeper, some to leave out."""
    for a in range(40):
        for b in range(12):
            d = tmp_path / f"a{a}" / f"b{b}"
            d.mkdir(parents=True)
            for c in range(3):
                (d / f"f{c}.py").write_text("x")
    deep = tmp_path / "a0"
    for k in range(30):
        deep = deep / f"deep{k}"
    deep.mkdir(parents=True)
    (deep / "last.md").write_text("y")
    for name in ("node_modules", ".git"):
        (tmp_path / "a1" / name / "x").mkdir(parents=True)
        (tmp_path / "a1" / name / "x" / "no.py").write_text("")
    (tmp_path / "a2" / "p.png").write_text("")
    return tmp_path


def plain(root):
    out = set()
    for d, dirs, files in os.walk(root):
        dirs[:] = [x for x in dirs if x not in ("node_modules", ".git")]
        out |= {os.path.relpath(os.path.join(d, f), root) for f in files if not f.endswith(".png")}
    return out


@pytest.mark.parametrize("share", [1, 7, 64, 10_000])
def test_driver_opens_a_bounded_number_of_folders(big, share):
    reader = tree.TreeReader({"path": str(big), "share": str(share), "content": "false"})
    system, root = reader.system()
    counting = Counting(system)
    reader.system = lambda: (counting, root)
    shares = reader.partitions()
    assert len(counting.listed) <= share and len(shares) <= 2 * share + 2
    before = len(counting.listed)
    rows = [r for s in shares for r in reader.read(s)]
    assert len(rows) == len({r[0] for r in rows}) and {r[0] for r in rows} == plain(big)
    assert not any("node_modules" in x or ".git" in x for x in counting.listed)
    assert len(set(counting.listed)) == len(counting.listed) and (before == len(counting.listed)) == (share == 10_000)


def test_any_share_gives_the_same_table(spark, big):
    want = plain(big)
    for options in ({}, {"share": "1"}, {"share": "5", "partitionBytes": "2"}):
        df = tree.read_tree(spark, str(big), **options)
        assert {(r["path"], r["text"]) for r in df.collect()} == {(p, "y" if p.endswith(".md") else "x") for p in want}
    folders = tree.read_tree(spark, str(big), folders="true", content="false", share="3").where("is_dir")
    assert folders.count() == 40 + 480 + 30


def test_an_empty_tree(spark, tmp_path):
    assert tree.read_tree(spark, str(tmp_path)).count() == 0
