"""Alignment of two tokenizers' tokens through a table of distinct segments.

A byte-level BPE (A) and a sentencepiece BPE (B) read the same bytes: a space and the text. Texts are split
before runs of white space, there alone where no token can reach across: A's words never hold white space
after anything else (its published pattern, which is checked to be the file's), and B can only merge what is
a piece of its vocabulary, so a white-space character that some piece holds after another character is no
place to split (``breaks``). Each distinct segment is encoded by both and aligned once, and its alignment
is joined back to the blocks of documents it came from, where documents are composed. As both
tokenizers end a token at each split, a document's groups are its segments' groups, in order.

Blocks are bounded in characters and in distinct segments. A block's documents are kept as numbers of its
segments, in a stored table, so that no later step depends on how rows are dealt again. Segments
travel compressed, by hash bucket. A task remembers a bounded number of bytes of a bucket's
alignments; beyond that it forgets them, and a segment that comes again is aligned again.

How many documents hold a pair of ids linked is summed from the blocks' counts (each counts a document once
for a pair) and joined back to the blocks' pairs by (a, b), never by one id alone.

Cases: null and empty texts, and those that a tokenizer doesn't give back byte for byte, have no tokens: all
counts zero, groups_sha256 ''. Repeated rows are documents each. A null key is carried along. A text without
white space is one segment, and a very long one a block by itself. An empty table gives an empty result.
Columns other than key and text aren't read.
"""

from __future__ import annotations

import hashlib
import json
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.bpe import BLOCK_CHARS, SPACE, byte_of_char, squeeze, unsqueeze
from tessella.llm.store import discard, give_back, materialise

#: Distinct segments of a block, segments and pairs of a stored row, and bytes of alignments that a task remembers.
MOST_DISTINCT = 400_000
CHUNK = 1 << 17
PAIRS = 1 << 14
MOST_BYTES = 64_000_000
#: Sentencepiece's mark of a space.
MARK = "▁"
BYTE = re.compile(r"<0x([0-9A-F]{2})>")

_loaded: dict[tuple[str, str], Aligner] = {}


def breaks(pieces: list[str]) -> str:
    """The white-space characters before which these pieces allow a split: none holds them after anything that
    isn't white space, nor (but for the space itself) after a space's mark."""
    white = re.compile(f"[{SPACE}]")
    within = f"{SPACE}{MARK}"
    bad = {m[1].replace(MARK, " ") for p in pieces for m in re.finditer(f"(?<=[^{within}])([{within}])", p)}
    bad |= {m[1] for p in pieces for m in re.finditer(f"(?<={MARK})([{SPACE}])", p)}
    return "".join(c for c in map(chr, range(0x3001)) if white.fullmatch(c) and c not in bad)


class Aligner:
    """Both tokenizers, once a worker."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        from tokenizers import Tokenizer

        with open(path_a, encoding="utf-8") as f:
            spec = json.load(f)
        before = spec["pre_tokenizer"] or {}
        if spec["normalizer"] or before.get("type") != "ByteLevel" or not before.get("use_regex", True) or before.get("add_prefix_space"):
            raise ValueError(f"{path_a}: not a byte-level tokenizer with the published word pattern alone")
        self.a = Tokenizer.from_file(path_a)
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        names = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.mark = self.b.piece_to_id(MARK)
        if self.b.encode("a\ta")[:1] != self.b.encode("a\tb")[:1] or not names[self.b.encode("a")[0]].startswith(MARK):
            raise ValueError(f"{path_b}: no space is put before texts")
        table, vocab = byte_of_char(), self.a.get_vocab()
        self.bytes_a = [b""] * (max(vocab.values()) + 1)
        for piece, i in vocab.items():
            self.bytes_a[i] = bytes(table[c] for c in piece) if all(c in table for c in piece) else piece.encode()
        self.bytes_b = [bytes([int(m[1], 16)]) if self.b.is_byte(i) and (m := BYTE.fullmatch(p)) else p.replace(MARK, " ").encode() for i, p in enumerate(names)]
        self.size_a, self.size_b = (np.array([len(x) for x in t]) for t in (self.bytes_a, self.bytes_b))
        # Control pieces never come of text; what they spell is ordinary text.
        places = breaks([p for i, p in enumerate(names) if not self.b.is_control(i) and not self.b.is_byte(i)])
        self.split = re.compile(f"(?<=[^{SPACE}])(?=[{places}])").split if places else lambda text: [text]

    def ids_b(self, segments: list[str]) -> list[list[int]]:
        """B's ids of segments of (space + text). B puts a space before what it is given: that of the segment,
        or one that is no part of it, which stays a token of its own and is taken off."""
        out = self.b.encode([s[1:] if s[:1] == " " else s for s in segments], num_threads=1)
        for n, s in enumerate(segments):
            if s[:1] != " ":
                out[n] = out[n][1:] if out[n][:1] == [self.mark] else []
            elif len(s) == 1:
                out[n] = [self.mark]
        return out

    def align(self, segments: list[bytes]) -> list[tuple[int, int, int, bytes, bytes]]:
        """(n_a, n_b, n_groups, links as a and b by turns, groups' text) a segment; no groups where bytes differ."""
        texts = [s.decode("utf-8") for s in segments]
        of_a, of_b = [e.ids for e in self.a.encode_batch_fast(texts, add_special_tokens=False)], self.ids_b(texts)
        good = [n for n, (s, a, b) in enumerate(zip(segments, of_a, of_b, strict=True)) if b"".join(map(self.bytes_a.__getitem__, a)) == s == b"".join(map(self.bytes_b.__getitem__, b))]
        out = [(0, 0, 0, b"", b"")] * len(segments)
        if not good:
            return out
        flat = lambda of: np.array([i for n in good for i in of[n]], np.int64)
        a, b = flat(of_a), flat(of_b)
        end_a, end_b = np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b])
        ends = np.union1d(end_a, end_b)
        both = np.intersect1d(end_a, end_b)
        links = np.stack([a[np.searchsorted(end_a, ends)], b[np.searchsorted(end_b, ends)]], 1).astype("<i4")
        edge = np.cumsum([len(segments[n]) for n in good])
        at = lambda of: np.searchsorted(of, edge, "right").tolist()
        to_a, to_b = (np.searchsorted(of, both, "right").tolist() for of in (end_a, end_b))
        name_a, name_b = list(map(str, a.tolist())), list(map(str, b.tolist()))
        groups = [f"{','.join(name_a[i:j])}|{','.join(name_b[k:m])}" for i, j, k, m in zip([0, *to_a], to_a, [0, *to_b], to_b, strict=False)]
        was_g = was_l = 0
        for n, g, m in zip(good, at(both), at(ends), strict=True):
            out[n] = len(of_a[n]), len(of_b[n]), g - was_g, links[was_l:m].tobytes(), ";".join(groups[was_g:g]).encode()
            was_g, was_l = g, m
        return out


def aligner(path_a: str, path_b: str) -> Aligner:
    if (path_a, path_b) not in _loaded:
        _loaded[path_a, path_b] = Aligner(path_a, path_b)
    return _loaded[path_a, path_b]


def _row(schema: pa.Schema, **values) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([values.get(f.name)], f.type) for f in schema], schema=schema)


def _pack(*arrays: np.ndarray) -> bytes:
    return squeeze([x.tobytes() for x in arrays], 3)


def _split(path_a: str, path_b: str, buckets: int, schema: pa.Schema):
    """Rows of documents (keys, numbers of their segments) and rows of a block's distinct segments in a bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, block = aligner(path_a, path_b).split, TaskContext.get().partitionId() << 32
        number: dict[str, int] = defaultdict()
        number.default_factory = number.__len__
        keys, coded, size, held = [], [], 0, 0

        def documents() -> pa.RecordBatch:
            blob = _pack(np.array([len(c) for c in coded], "<u4"), np.concatenate([np.zeros(0, "<u4"), *coded]))
            return _row(schema, block=block, keys=keys, blob=blob)

        def segments() -> Iterator[pa.RecordBatch]:
            # Numbers are places in this list. Only one bucket's segments are copied at a time.
            names = list(number)
            of = np.fromiter((zlib.crc32(s.encode("utf-8")) % buckets for s in names), np.int64, len(names))
            order = np.argsort(of, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(of[order])) + 1) if names else []:
                rows = sorted((names[n].encode("utf-8"), n) for n in part.tolist())
                yield _row(schema, block=block, bucket=int(of[part[0]]), blob=squeeze([np.array([n for _, n in rows], "<u4").tobytes(), *(s for s, _ in rows)]))

        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                keys.append(key)
                coded.append(np.array(list(map(number.__getitem__, split(f" {text}"))) if text else [], "<u4"))
                size, held = size + len(text or ""), held + len(coded[-1]) + 16
                over = size >= 2 * BLOCK_CHARS or len(number) >= MOST_DISTINCT
                if over or held >= CHUNK:
                    yield documents()
                    keys, coded, held = [], [], 0
                if over:
                    yield from segments()
                    number.clear()
                    size, block = 0, block + 1
        if keys:
            yield documents()
        yield from segments()
        number.clear()
        give_back()

    return run


def _align(path_a: str, path_b: str):
    """A blob of alignments for each blob of segments. Rows come by bucket: a segment is aligned where it is first met."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, last, known, size = aligner(path_a, path_b), None, {}, 0
        for batch in batches:
            out = []
            for bucket, blob in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                numbers, *segments = unsqueeze(blob)
                if bucket != last or size > MOST_BYTES:
                    last, known, size = bucket, {}, 0
                new = [s for s in segments if s not in known]
                for at in range(0, len(new), 4096):
                    done = both.align(part := new[at : at + 4096])
                    known.update(zip(part, done, strict=True))
                    size += sum(map(len, part)) + sum(len(x[3]) + len(x[4]) + 200 for x in done)
                rows = [known[s] for s in segments]
                counts = np.array([(*r[:3], len(r[3]) // 8) for r in rows], "<u4").reshape(-1, 4)
                out.append(squeeze([numbers, counts.tobytes(), b"".join(r[3] for r in rows), b"\n".join(r[4] for r in rows)]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["block", "blob"])
        known.clear()
        give_back()

    return run


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each range, one after the other."""
    total = int(size.sum())
    kind = np.int32 if total + int(start.max(initial=0)) + int(size.max(initial=0)) < 1 << 31 else np.int64
    out = np.repeat((start - np.cumsum(size) + size).astype(kind), size)
    out += np.arange(total, dtype=kind)
    return out


COUNTS = ["n_a", "n_b", "n_groups", "n_links"]


def _compose(schema: pa.Schema):
    """A block's documents with counts, digest and segments' numbers; a row more with its segments' numbers of pairs, and rows of those pairs, bounded."""

    def run(documents: pa.Table, alignments: pa.Table) -> pa.Table:
        # The groups' texts stay one buffer with the places of each: as objects they would take several times that.
        raw, numbers, tables, parts, ends = bytearray(), [np.zeros(0, "<u4")], [np.zeros((0, 4), "<u4")], [np.zeros(0, "<i8")], [np.zeros(0, np.int64)]
        for blob in alignments.column("blob"):
            number, table, linked, texts = unsqueeze(blob.as_py())
            numbers.append(np.frombuffer(number, "<u4"))
            tables.append(np.frombuffer(table, "<u4").reshape(-1, 4))
            parts.append(np.frombuffer(linked, "<i8"))
            ends.append(np.append(np.flatnonzero(np.frombuffer(texts, np.uint8) == 10), len(texts)) + len(raw))
            raw += texts
            raw += b"\n"
        order = np.argsort(np.concatenate(numbers))
        counts = np.concatenate(tables).astype(np.int64)
        links = np.concatenate(parts)
        del parts, tables, numbers
        end = np.concatenate(ends)
        begin = np.concatenate([np.zeros(1, np.int64), end[:-1] + 1])[: len(end)]
        begin, end, texts = begin[order], end[order], memoryview(raw)
        start = np.cumsum(counts[:, 3]) - counts[:, 3]
        counts, start = counts[order], start[order]
        pairs, which = np.unique(links), np.zeros(len(links), np.uint32)
        for at in range(0, len(links), CHUNK):
            which[at : at + CHUNK] = np.searchsorted(pairs, links[at : at + CHUNK])
        del links
        which = which[_ranges(start, counts[:, 3])]
        start = np.cumsum(counts[:, 3]) - counts[:, 3]
        held = np.zeros(len(pairs), np.int64)
        out = []
        block = documents.column("block")[0].as_py()
        for keys, blob in zip(documents.column("keys"), documents.column("blob").to_pylist(), strict=True):
            sizes, flat = (np.frombuffer(x, "<u4") for x in unsqueeze(blob))
            totals, digests, kept, seen = np.zeros((len(sizes), 4), "<i8"), [b""] * len(sizes), [], []
            for n, (to, size) in enumerate(zip(np.cumsum(sizes).tolist(), sizes.tolist(), strict=True)):
                own = flat[to - size : to]
                if not size or not counts[own, 2].all():
                    kept.append(own[:0])
                    continue
                totals[n] = counts[own].sum(axis=0)
                digests[n] = hashlib.sha256(b";".join([texts[i:j] for i, j in zip(begin[own].tolist(), end[own].tolist(), strict=True)])).digest()
                kept.append(own)
                once = np.unique(own)
                seen.append(np.unique(which[_ranges(start[once], counts[once, 3])]))
            if seen:
                held += np.bincount(np.concatenate(seen), minlength=len(pairs))
            blob = _pack(totals, np.array([len(k) for k in kept], "<u4"), np.concatenate([np.zeros(0, "<u4"), *kept])), squeeze(digests, 1)
            out.append(_row(schema, block=block, keys=keys.as_py(), blob=squeeze(list(blob), 1)))
        ids = pairs.astype("<i8").view("<i4").reshape(-1, 2)
        kind = schema.field("pairs").type.value_type
        columns = [np.arange(len(ids)), ids[:, 0], ids[:, 1], held]
        found = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kind, strict=True)], fields=list(kind))
        out.append(_row(schema, block=block, blob=_pack(counts[:, 3].astype("<u4"), which.astype("<u4", copy=False))))
        plain = _row(schema, block=block)
        for at in range(0, len(ids), PAIRS):
            part = found.slice(at, PAIRS)
            listed = pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), part)
            out.append(pa.RecordBatch.from_arrays([listed.cast(f.type) if f.name == "pairs" else plain.column(f.name) for f in schema], schema=schema))
        give_back()
        return pa.Table.from_batches(out, schema)

    return run


def _finish(schema: pa.Schema):
    """Documents' rows: what of the counts of pairs falls to their links."""

    below = lambda x: np.concatenate([np.zeros(1, np.int64), np.cumsum(x, dtype=np.int64)])

    def run(documents: pa.Table, counted: pa.Table) -> pa.Table:
        count, best = (np.zeros(counted.num_rows, np.int64) for _ in range(2))
        at = counted.column("i").to_numpy()
        count[at], best[at] = counted.column("docs").to_numpy(), counted.column("best").to_numpy()
        rows = list(zip(documents.column("keys"), documents.column("blob").to_pylist(), strict=True))
        links, which = (np.frombuffer(x, "<u4") for x in unsqueeze(next(b for k, b in rows if not k.is_valid)))
        ends = below(links)
        sums = [np.diff(below(of[which])[ends]) for of in (best, count)]
        out = []
        for keys, blob in rows:
            if not keys.is_valid:
                continue
            numbers, digests = unsqueeze(blob)
            totals, sizes, flat = unsqueeze(numbers)
            totals, to = np.frombuffer(totals, "<i8").reshape(-1, 4), below(np.frombuffer(sizes, "<u4"))
            flat = np.frombuffer(flat, "<u4")
            mine = [np.diff(below(of[flat])[to]) for of in sums]
            columns = [keys.values, *(pa.array(totals[:, k]) for k in range(4)), *map(pa.array, mine), pa.array([d.hex() for d in unsqueeze(digests)])]
            out.append(pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema, strict=True)], schema=schema))
        return pa.Table.from_batches(out, schema)

    return run


def align(df: DataFrame, path_a: str, path_b: str, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a row of df: key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    path_a: a byte-level BPE file of the tokenizers library, path_b: a sentencepiece model that puts a space
    before texts; both readable on executors. key: a column of long or string.
    """
    text_key = df.schema[key].dataType.simpleString() == "string"
    kind, arrow = ("string", pa.string()) if text_key else ("long", pa.int64())
    source = df.select(F.col(key).cast(kind).alias("key"), F.col(text_col).alias("text"))
    size = int(str(source._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(4 * partitions, min(1 << 16, int(4 * (size / BLOCK_CHARS) ** 0.5)))

    listed = [("keys", pa.list_(arrow)), ("blob", pa.binary())]
    first = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), *listed])
    stored = materialise(source.mapInArrow(_split(path_a, path_b, buckets, first), f"block long, bucket int, keys array<{kind}>, blob binary"), "split")
    segments = stored.where("bucket is not null").select("block", "bucket", "blob")
    aligned = segments.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_align(path_a, path_b), "block long, blob binary")

    pair = pa.struct([("i", pa.int32()), ("a", pa.int32()), ("b", pa.int32()), ("docs", pa.int64())])
    second = pa.schema([("block", pa.int64()), *listed, ("pairs", pa.list_(pair))])
    documents = stored.where("bucket is null").select("block", "keys", "blob")
    composed = documents.groupBy("block").cogroup(aligned.groupBy("block")).applyInArrow(_compose(second), f"block long, keys array<{kind}>, blob binary, pairs array<struct<i: int, a: int, b: int, docs: long>>")
    composed = materialise(composed, "composed")
    discard(stored)

    pairs = composed.where("pairs is not null").select(F.col("block").alias("home"), F.inline("pairs"))
    held = pairs.groupBy("a", "b").agg(F.sum("docs").alias("docs"))
    held = materialise(held, "pairs")
    best = held.groupBy("a").agg(F.max("docs").alias("most"))
    rated = held.join(best, "a").select("a", "b", "docs", (F.col("docs") == F.col("most")).cast("long").alias("best"))
    counted = pairs.drop("docs").join(rated, ["a", "b"]).select("home", "i", "docs", "best")
    last = pa.schema([("key", arrow), *((c, pa.int64()) for c in [*COUNTS, "n_best", "count_sum"]), ("groups_sha256", pa.string())])
    fields = ", ".join(f"{c} long" for c in [*COUNTS, "n_best", "count_sum"])
    done = composed.where("blob is not null").select("block", "keys", "blob").groupBy("block").cogroup(counted.groupBy("home")).applyInArrow(_finish(last), f"key {kind}, {fields}, groups_sha256 string")
    return done.withColumnRenamed("key", key)
