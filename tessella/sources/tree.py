"""A file tree as a table: a Python data source, since the built-in file sources skip names that begin with '_' or '.'.

Folders that rules leave out are never walked into. The driver opens a bounded number of folders, those nearest to
the root; the folders below are walked by the tasks that read them, so what the driver holds doesn't grow with the
tree (but with what lies right in the folders it opened). Content is read only if it is asked for.
"""

from __future__ import annotations

import fnmatch
import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tessella.functions import rules as R


def gitignore(text: str) -> tuple[list[str], list[str]]:
    """(literal names, globs) of a rule file: comments, exceptions and blank lines go; '**/' before and '/**' after are taken off."""
    literals, globs = [], []
    for line in text.splitlines():
        rule = line.strip()
        if not rule or rule.startswith("#"):
            continue
        rule = rule.split(" #", 1)[0].strip()
        if rule.startswith("!"):
            continue
        rule = (rule[3:] if rule.startswith("**/") else rule.removesuffix("/**")).rstrip("/")
        if rule:
            (globs if any(c in rule for c in "*?[") else literals).append(rule)
    return literals, globs


def excludes(config: str) -> tuple[list[str], list[str]]:
    """(literal names, globs) of the list under ``exclude`` in a configuration's YAML, as block or in brackets; globs
    lose leading stars. A configuration without such a list excludes nothing."""
    found, inside = [], False
    for line in config.splitlines():
        bare = line.split(" #", 1)[0].rstrip()
        head, colon, rest = bare.partition(":")
        if colon and head == head.strip() and not head.startswith(("-", "#")):
            inside = head == "exclude"
            if inside and rest.strip().startswith("["):
                found += rest.strip().strip("[]").split(",")
        elif inside and bare.strip().startswith("-"):
            found.append(bare.strip()[1:])
    names = [x.strip().strip("'\"").strip() for x in found]
    wild = lambda x: any(c in x for c in "*?[")
    return [x for x in names if x and not wild(x)], [g for x in names if wild(x) and (g := x.lstrip("*"))]


@dataclass(frozen=True)
class Rules:
    """What is left out: folders and names by their whole name, names by globs, files by suffix."""

    names: frozenset[str]
    globs: tuple[str, ...]
    binary: tuple[str, ...]

    def leaves_out(self, name: str) -> bool:
        return name in self.names or bool(self.globs) and any_glob(self.globs)(name) is not None


@lru_cache
def any_glob(globs: tuple[str, ...]):
    """All globs as one pattern."""
    return re.compile("|".join(map(fnmatch.translate, globs))).match


class Share(InputPartition):
    """What one task reads: entries that were listed, and folders that it walks itself."""

    def __init__(self, entries: list[tuple[str, str, int, bool]], folders: list[str], root: str, rules: Rules):
        self.entries, self.folders, self.root, self.rules = entries, folders, root, rules


def listing(system, root: str, folder: str, rules: Rules) -> Iterator[tuple[str, str, int, bool]]:
    """(relative path, address, size, is folder) of what lies right in a folder, without what the rules leave out."""
    from pyarrow import fs

    for i in sorted(system.get_file_info(fs.FileSelector(folder)), key=lambda i: i.path):
        if not rules.leaves_out(i.base_name):
            yield i.path[len(root) :].lstrip("/"), i.path, max(i.size or 0, 0), i.type == fs.FileType.Directory


def walk(system, root: str, folders: list[str], rules: Rules) -> Iterator[tuple[str, str, int, bool]]:
    """What lies below folders. A folder that is left out is never opened."""
    todo = list(folders)
    while todo:
        for entry in listing(system, root, todo.pop(), rules):
            if entry[3]:
                todo.append(entry[1])
            yield entry


class TreeReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root = options["path"].rstrip("/")
        self.folders = options.get("folders", "false").lower() == "true"
        self.content = options.get("content", "true").lower() == "true"
        self.git = options.get("gitignore", "false").lower() == "true"
        self.wide = options.get("rules", "current") == "archived"
        self.bytes = int(options.get("partitionbytes", 64 << 20))
        self.share = int(options.get("share", 64))

    def system(self):
        from pyarrow import fs

        if "://" in self.root:
            return fs.FileSystem.from_uri(self.root)
        return fs.LocalFileSystem(), self.root.removeprefix("file:")

    def rules(self, system, root: str) -> Rules:
        names = set(R.MORE_IGNORED_DIRS if self.wide else R.IGNORED_DIRS) | set(R.MORE_IGNORED_FILES if self.wide else R.IGNORED_FILES)
        globs: list[str] = []
        if self.git:
            try:
                with system.open_input_file(f"{root}/.gitignore") as f:
                    literals, globs = gitignore(f.read().decode("utf-8", "ignore"))
                    names |= set(literals)
            except FileNotFoundError:
                pass
        return Rules(frozenset(names), tuple(globs), tuple(R.MORE_BINARY_SUFFIXES if self.wide else R.BINARY_SUFFIXES))

    def wanted(self, entry: tuple[str, str, int, bool], rules: Rules) -> bool:
        return self.folders if entry[3] else not entry[0].lower().endswith(rules.binary)

    def partitions(self) -> list[Share]:
        """Folders are opened here, those nearest to the root first, only until there are enough to share or so many
        have been opened; what they hold is dealt by size, and each folder left is a task's to walk."""
        system, root = self.system()
        rules = self.rules(system, root)
        todo, opened, shares, own, size = deque([root]), 0, [], [], 0
        while todo and opened < self.share and len(todo) < self.share:
            opened += 1
            for entry in listing(system, root, todo.popleft(), rules):
                if entry[3]:
                    todo.append(entry[1])
                if not self.wanted(entry, rules):
                    continue
                if own and size + entry[2] > self.bytes:
                    shares.append(Share(own, [], root, rules))
                    own, size = [], 0
                own.append(entry)
                size += entry[2]
        shares.append(Share(own, [], root, rules))
        # Neighbours go to different tasks; more tasks than twice the share would each have next to nothing.
        tasks = min(len(todo), 2 * self.share)
        return shares + [Share([], list(todo)[k::tasks], root, rules) for k in range(tasks)]

    def read(self, partition: Share) -> Iterator[tuple]:
        system = self.system()[0]
        walked = (e for e in walk(system, partition.root, partition.folders, partition.rules) if self.wanted(e, partition.rules))
        for rel, address, size, folder in chain(partition.entries, walked):
            data = None
            if self.content and not folder:
                with system.open_input_stream(address, compression=None) as f:
                    data = f.read()
            yield rel, size, folder, data, None if data is None else data.decode("utf-8", "replace")


class TreeSource(DataSource):
    """spark.read.format("tree").load(folder). Options: folders, content, gitignore,
    rules (current, archived), partitionBytes, share (how many folders the driver opens at most, and looks for)."""

    @classmethod
    def name(cls) -> str:
        return "tree"

    def schema(self) -> str:
        return "path string, size bigint, is_dir boolean, content binary, text string"

    def reader(self, schema) -> TreeReader:
        return TreeReader(dict(self.options))


def read_tree(spark: SparkSession, root: str, **options: str) -> DataFrame:
    from tessella.session import ship

    ship(spark).dataSource.register(TreeSource)
    return spark.read.format("tree").options(**options).load(root)


def checked_json(spark: SparkSession, path: str, schema: str, version: int | None = None, strict: bool = False) -> DataFrame:
    """A JSON document as rows: tolerant of faults, or failing on them; rows of another cache version are left out
    (strict: refused)."""
    mode = "FAILFAST" if strict else "PERMISSIVE"
    df = spark.read.schema(schema).option("multiLine", True).option("mode", mode).json(path)
    if version is None:
        return df
    if strict and not df.where(f"cache_schema_version IS NULL OR cache_schema_version <> {int(version)}").isEmpty():
        raise ValueError(f"{path} isn't of version {version}")
    return df.where(f"cache_schema_version = {int(version)}")
