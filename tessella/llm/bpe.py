"""Byte-level BPE of whole texts through a table of distinct words, and back through a table of pieces.

A word is what lies between two spaces that are followed by anything but white space, with the space
before it; the tokenizer's own words never reach across such a place, so words can be encoded apart.
Texts are taken in blocks of bounded size. Each block gives its distinct words once, sorted, in
buckets by the word's hash; the buckets of all blocks are brought together, every distinct word is
encoded once, and the ids go back to each block in the order of its words. There they are joined to
the texts by position. A frequent word thus crosses an exchange once a block, however often it occurs.
Words, ids and texts travel compressed.

Buckets grow with the root of the input's size, so that neither their number nor what one holds grows in
proportion to it. A task remembers a bounded number of a bucket's words; beyond it forgets them, and a
word that comes again is encoded again.

Block numbers come from partition and position. Should a re-run deal rows differently, a bucket
whose checksum differs is left aside and its words are encoded on the spot, so results stay whole.

Cases: a null or empty text has no ids and decodes to the empty text. Marks of special tokens in a
text become those tokens, as the library does. Very long texts are a block each. Repeated rows and
null keys are encoded each. An empty table gives an empty result. Columns other than key and text are
not read.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Unicode White_Space, as ranges of a character class.
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
LOOSE = re.compile(f" (?=[{SPACE}]|\\Z)")
BREAK = re.compile(f" (?=[^{SPACE}])")
BLOCK_CHARS = 12_000_000
#: Words of a bucket that a task remembers.
MOST_WORDS = 1_000_000

_loaded: dict[str, tuple] = {}


def load(path: str) -> tuple:
    """(tokenizer, {special token: id}) of a tokenizer file, once a worker."""
    if path not in _loaded:
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        tok.no_truncation()
        tok.no_padding()
        _loaded[path] = tok, {t["content"]: t["id"] for t in json.load(open(path, encoding="utf-8"))["added_tokens"]}
    return _loaded[path]


def split_words(text: str) -> list[str]:
    """Words without the space before them (the first has none)."""
    return BREAK.split(text) if LOOSE.search(text) else text.split(" ")


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list, list[str]]]:
    """(block, keys, texts) of bounded size from batches of (key, text)."""
    base, number, keys, texts, size = TaskContext.get().partitionId() << 32, 0, [], [], 0
    for batch in batches:
        for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            keys.append(k), texts.append(t or "")
            size += len(texts[-1]) + 64
            if size >= BLOCK_CHARS:
                yield base + number, keys, texts
                number, keys, texts, size = number + 1, [], [], 0
    if keys:
        yield base + number, keys, texts


def _segments(text: str, marks: re.Pattern | None) -> list[str]:
    """Text and special tokens by turns."""
    return marks.split(text) if marks and marks.search(text) else [text]


def _marks(special: dict[str, int]) -> re.Pattern | None:
    return re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None


def block_words(texts: list[str], marks: re.Pattern | None, buckets: int) -> list[list[str]]:
    """The distinct words of a block's texts, sorted, by bucket."""
    first, later = set(), set()
    for text in texts:
        for segment in _segments(text, marks)[::2]:
            words = split_words(segment)
            first.add(words[0])
            later.update(words[1:])
    out: list[list[str]] = [[] for _ in range(buckets)]
    crc = zlib.crc32
    for w in first.union(" " + w for w in later) - {""}:
        out[crc(w.encode("utf-8")) % buckets].append(w)
    for own in out:
        own.sort()
    return out


def squeeze(parts: list[bytes], level: int = 6) -> bytes:
    """Byte strings as one compressed one: lengths, then contents."""
    sizes = np.array([len(parts), *map(len, parts)], "<u4").tobytes()
    return zstandard.ZstdCompressor(level=level).compress(sizes + b"".join(parts))


def unsqueeze(blob: bytes) -> list[bytes]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = int.from_bytes(raw[:4], "little")
    ends = (np.cumsum(np.frombuffer(raw, "<u4", n, 4)) + 4 * (n + 1)).tolist()
    return [raw[a:b] for a, b in zip([4 * (n + 1), *ends], ends, strict=False)]


def _distinct_words(path: str, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = _marks(load(path)[1])
        for block, _, texts in blocks(batches):
            own = [(k, squeeze([w.encode("utf-8") for w in words])) for k, words in enumerate(block_words(texts, marks, buckets)) if words]
            if own:
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in own], pa.int32()), pa.array(np.full(len(own), block)), pa.array([x for _, x in own], pa.binary())], ["bucket", "block", "words"])

    return run


def _encode_words(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by bucket, so that a word is met in one run of rows and encoded at its first."""
        tok, bucket, known = load(path)[0], None, {}
        for batch in batches:
            out, checks = [], []
            for k, blob in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if k != bucket:
                    bucket, known = k, {}
                words = unsqueeze(blob)
                if len(known) > MOST_WORDS:
                    known = {}
                new = [w for w in words if w not in known]
                for at in range(0, len(new), 8192):
                    part = new[at : at + 8192]
                    for w, e in zip(part, tok.encode_batch_fast([w.decode("utf-8") for w in part], add_special_tokens=False), strict=True):
                        known[w] = np.array(e.ids, "<u4").tobytes()
                out.append(squeeze([known[w] for w in words]))
                checks.append(zlib.crc32(b"\0".join(words)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(checks, pa.int64()), pa.array(out, pa.binary())], ["bucket", "block", "check", "ids"])

    return run


def _packed_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block, keys, texts in blocks(batches):
        at = 0
        while at < len(keys):
            to, size = at, 0
            while to < len(keys) and (to == at or size < 1_000_000):
                size += len(texts[to])
                to += 1
            raw = [t.encode("utf-8") for t in texts[at:to]]
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([keys[at:to]], pa.list_(_key_type(keys[at:to]))), pa.array([squeeze(raw)], pa.binary())], ["block", "keys", "blob"])
            at = to


def _key_type(keys: list) -> pa.DataType:
    return pa.int64() if all(k is None or isinstance(k, int) for k in keys) else pa.string()


def _join_back(path: str, buckets: int):
    def run(texts: pa.Table, words: pa.Table) -> pa.Table:
        tok, special = load(path)
        marks = _marks(special)
        keys = [k for own in texts.column("keys").to_pylist() for k in own]
        raw = [t.decode("utf-8") for blob in texts.column("blob").to_pylist() for t in unsqueeze(blob)]
        own = block_words(raw, marks, buckets)
        first, later = {"": b""}, {}
        for k, check, blob in zip(*(words.column(c).to_pylist() for c in ("bucket", "check", "ids")), strict=True):
            if check != zlib.crc32(b"\0".join(w.encode("utf-8") for w in own[k])):
                continue
            for w, x in zip(own[k], unsqueeze(blob), strict=True):
                if w[0] == " ":
                    later[w[1:]] = x
                else:
                    first[w] = x

        def look(word: str, spaced: bool) -> bytes:
            full = f" {word}" if spaced else word
            table, key = (later, full[1:]) if full[:1] == " " else (first, full)
            if key not in table:
                table[key] = np.array(tok.encode(full, add_special_tokens=False).ids, "<u4").tobytes()
            return table[key]

        def encode(text: str) -> bytes:
            out = []
            for n, segment in enumerate(_segments(text, marks)):
                if n % 2:
                    out.append(np.array([special[segment]], "<u4").tobytes())
                    continue
                head, *rest = split_words(segment)
                out.append(look(head, False))
                try:
                    out.append(b"".join(map(later.__getitem__, rest)))
                except KeyError:
                    out.append(b"".join(look(w, True) for w in rest))
            return b"".join(out)

        flat, ends = [], [0]
        for text in raw:
            flat.append(encode(text))
            ends.append(ends[-1] + len(flat[-1]) // 4)
        values = pa.array(np.frombuffer(b"".join(flat), "<i4"))
        return pa.table({"key": pa.array(keys, texts.schema.field("keys").type.value_type), "ids": pa.ListArray.from_arrays(pa.array(np.array(ends, np.int32)), values)})

    return run


def encode(df: DataFrame, tokenizer: str, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a row of df: key, ids (array of int). tokenizer: a path that executors can read.
    key: a column of long or string."""
    kind = "string" if df.schema[key].dataType.simpleString() == "string" else "long"
    source = df.select(F.col(key).cast(kind).alias("key"), F.col(text_col).alias("text"))
    size = int(str(source._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(4 * partitions, min(1 << 16, int(4 * (size / BLOCK_CHARS) ** 0.5)))
    words = source.mapInArrow(_distinct_words(tokenizer, buckets), "bucket int, block long, words binary")
    ids = words.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_encode_words(tokenizer), "bucket int, block long, check long, ids binary")
    texts = source.mapInArrow(_packed_texts, f"block long, keys array<{kind}>, blob binary")
    return texts.groupBy("block").cogroup(ids.groupBy("block")).applyInArrow(_join_back(tokenizer, buckets), f"key {kind}, ids array<int>")


def pieces(tokenizer: str) -> tuple[np.ndarray, np.ndarray]:
    """The id-to-piece table: all pieces' bytes in a row, and where each id's begins (one more at the end)."""
    tok, special = load(tokenizer)
    table = byte_of_char()
    names = {i: p for p, i in tok.get_vocab().items()}
    marks = {i: t for t, i in special.items()}
    raw = [marks[i].encode() if i in marks else bytes(table[c] for c in names[i]) if i in names else b"" for i in range(max(names) + 1)]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])])


def byte_of_char() -> dict[str, int]:
    """The published byte-to-character rule of byte-level BPE: printable bytes stand for themselves,
    the rest follow from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(rest)}


def decode(df: DataFrame, tokenizer: str, key: str = "key", ids_col: str = "ids") -> DataFrame:
    """df with the column decoded (string): the pieces of each row's ids, joined by id, in order.
    Null ids give the empty text; bytes that aren't UTF-8 become U+FFFD."""
    names = [*df.columns, "decoded"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat, begin = pieces(tokenizer)
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                lists = batch.column(batch.schema.get_field_index(ids_col))
                out = []
                for n in range(len(lists)):
                    ids = lists[n].values.to_numpy(zero_copy_only=False) if lists[n].is_valid else np.zeros(0, np.int32)
                    size = begin[ids + 1] - begin[ids]
                    where = np.repeat(begin[ids] - np.cumsum(size) + size, size) + np.arange(size.sum())
                    out.append(flat[where].tobytes().decode("utf-8", "replace"))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], names)

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField("decoded", T.StringType())]))


def digests(df: DataFrame, tokenizer: str, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """key, n_tokens, ids_sha256, decoded_sha256 of encoding df and decoding the result."""
    done = decode(encode(df, tokenizer, key, text_col), tokenizer)
    listed = F.concat_ws(",", F.col("ids").cast("array<string>"))
    return done.select(F.col("key").alias(key), F.size("ids").cast("long").alias("n_tokens"), F.sha2(listed, 256).alias("ids_sha256"), F.sha2(F.col("decoded"), 256).alias("decoded_sha256"))
