"""Vector bin packing of token sequences under limits on tokens, segments and loss-bearing tokens.

A task packs what its own partition holds, so nothing is shuffled and no key can gather rows. One bin
is open at a time; the next item is the one whose demand vector has the largest dot product with
what the bin has left, each dimension weighted by its mean demand. If none fits, and items may be cut,
the one with the largest product is cut so that the bin ends exactly full; what remains of it goes
back to the pool. The pool is bounded (``pool`` items a task).

Pieces of full length never enter the pool. A bin that can't be filled (the last of a task, or one
that has reached its limit of segments or loss) is dealt out as sequences whose lengths are powers of
two, which take no padding, if items may be cut; otherwise it is padded.

Cases: a null or empty text has no ids but the final one. Equal texts and repeated rows are packed
each. A null id is carried along. Very long texts become full sequences. An empty table gives an empty
result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, compress, repeat
from operator import is_

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.store import give_back

SCHEMA = "key {}, start long, length long, ids binary, item_tokens long, sequence_id long, offset long"
#: What makes a text go to the library whole: separators that str.split() alone honours, marks of special tokens.
WHOLE = ("\x1c", "\x1d", "\x1e", "\x1f", "<|")
#: Texts of these characters alone are put in lower case and cut here as the tokenizer's pattern would.
LATIN = re.compile(r"[\t\n\r -~À-ÖØ-öø-ÿ]*")
MARKS = [c for c in map(chr, range(33, 127)) if not c.isalnum()]
PIECE = re.compile(r"'(?:s|t|re|ve|m|ll|d)|[a-zß-öø-ÿ]+|[0-9]|[!-/:-@\[-`{-~]+")
WORD = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+")


def pieces(text: str) -> list[str]:
    """A text's words and marks in lower case, or its chunks between white space if it has other characters."""
    if not (text.isascii() or LATIN.fullmatch(text)):
        return text.split()
    text, marks = text.lower(), [m for m in MARKS if m in text]
    # Adjacent marks are one token, and an apostrophe may belong to what follows it.
    if len(marks) > 8 or "'" in marks or any(a + b in text for a in marks for b in marks):
        return PIECE.findall(text)
    for m in marks:
        text = text.replace(m, f" {m} ")
    return text.split()


class WordTokenizer:
    """Ids of whole texts for a tokenizer whose words never span white space, end in a marked piece and are
    independent of each other. A chunk between white space, or a word or mark of it, is encoded once a worker and remembered, in two
    generations of bounded size: what isn't met again while a new one fills is forgotten with the older."""

    LIMIT = 400_000

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.full = Tokenizer.from_file(path)
        vocab = self.full.get_vocab()
        # For words of lower-case letters, which neither normalizer nor pattern would change or cut.
        self.words = Tokenizer.from_file(path)
        self.words.normalizer = None
        self.words.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for p, i in vocab.items() if p.endswith("</w>")]] = True
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _plain(self, words: list[str]) -> None:
        """Words of lower-case letters alone: encoded as one text and cut at the marked pieces."""
        for at in range(0, len(words), 4096):
            part = words[at : at + 4096]
            ids = np.array(self.words.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, "<u4")
            ends = (4 * np.flatnonzero(self.ends[ids]) + 4).tolist()
            if len(ends) == len(part):
                raw = ids.tobytes()
                self.known.update(zip(part, [raw[a:b] for a, b in zip([0, *ends], ends, strict=False)], strict=True))
            else:
                self._each(part)

    def _each(self, chunks: list[str]) -> None:
        for at in range(0, len(chunks), 4096):
            part = chunks[at : at + 4096]
            for c, e in zip(part, self.full.encode_batch_fast(part, add_special_tokens=False), strict=True):
                self.known[c] = np.array(e.ids, "<u4").tobytes()

    def missing(self, chunks: set[str]) -> set[str]:
        """Those that neither generation knows; what the older one knows passes to the new one."""
        chunks = chunks.difference(self.known)
        again = chunks & self.older.keys()
        self.known.update(zip(again, map(self.older.__getitem__, again), strict=True))
        return chunks - again

    def learn(self, chunks: set[str]) -> None:
        new = chunks.difference(self.known)
        if len(self.known) + len(new) > self.LIMIT:
            self.older, self.known = self.known, {}
            new = chunks
        new = self.missing(new)
        # The tokenizer lowers case, so letters alone are looked up and encoded in lower case.
        letters = {c: c.lower() for c in new if WORD.fullmatch(c)}
        self._plain(list(self.missing(set(letters.values()))))
        self._each(list(new.difference(letters)))
        self.known.update({c: self.known[word] for c, word in letters.items() if c != word})

    def rest(self) -> None:
        """What a task leaves to its worker, which other stages use as well: the younger generation alone."""
        self.older = {}

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        """Ids of each text. Texts with separators that only str.split() honours, or with marks of special
        tokens, go to the library whole."""
        for at in range(0, len(texts), 64):
            split = [None if any(m in t for m in WHOLE) else pieces(t) for t in texts[at : at + 64]]
            words = list(chain.from_iterable(filter(None, split)))
            found = list(map(self.known.get, words))
            gaps = list(compress(range(len(words)), map(is_, found, repeat(None))))
            if gaps:
                self.learn({words[n] for n in gaps})
                for n in gaps:
                    found[n] = self.known[words[n]]
            low = 0
            for text, own in zip(texts[at : at + 64], split, strict=True):
                if own is None:
                    yield np.array(self.full.encode(text, add_special_tokens=False).ids, "<u4")
                else:
                    yield np.frombuffer(b"".join(found[low : low + len(own)]), "<u4")
                    low += len(own)


_tokenizers: dict[str, WordTokenizer] = {}


def word_tokenizer(path: str) -> WordTokenizer:
    if path not in _tokenizers:
        _tokenizers[path] = WordTokenizer(path)
    return _tokenizers[path]


@dataclass
class Item:
    """A piece that waits: ids from start on, and which of them bear loss (None: all)."""

    key: object
    start: int
    ids: np.ndarray
    loss: np.ndarray | None
    total: int

    def demand(self) -> tuple[int, int, int]:
        return len(self.ids), 1, len(self.ids) if self.loss is None else int(self.loss.sum())

    def cut(self, n: int) -> tuple[Item, Item]:
        part = lambda a, b: Item(self.key, self.start + a, self.ids[a:b], None if self.loss is None else self.loss[a:b], self.total)
        return part(0, n), part(n, len(self.ids))


class Pool:
    """Waiting items by demand: a row of demands and a count for each kind, and the items behind it."""

    def __init__(self, capacity: np.ndarray):
        self.capacity, self.at = capacity, {}
        self.share, self.counts, self.items = np.zeros((256, 3)), np.zeros(256, np.int64), []
        self.waiting, self.total = 0, np.zeros(3)

    def put(self, item: Item) -> None:
        d = item.demand()
        i = self.at.get(d)
        if i is None:
            i = self.at[d] = len(self.items)
            self.items.append([])
            if i == len(self.counts):
                self.share, self.counts = np.concatenate([self.share, np.zeros_like(self.share)]), np.concatenate([self.counts, np.zeros_like(self.counts)])
            self.share[i] = np.array(d) / self.capacity
        self.items[i].append(item)
        self.counts[i] += 1
        self.waiting += 1
        self.total += self.share[i]

    def take(self, i: int) -> Item:
        self.counts[i] -= 1
        self.waiting -= 1
        self.total -= self.share[i]
        return self.items[i].pop()

    def tidy(self) -> None:
        """Forgets kinds that no item has, once they are the most."""
        n = len(self.items)
        live = np.flatnonzero(self.counts[:n])
        if n > 256 and len(live) * 2 < n:
            old = {i: d for d, i in self.at.items()}
            self.at = {old[i]: k for k, i in enumerate(live.tolist())}
            self.items = [self.items[i] for i in live.tolist()]
            size = max(256, len(live))
            share, counts = np.zeros((size, 3)), np.zeros(size, np.int64)
            share[: len(live)], counts[: len(live)] = self.share[live], self.counts[live]
            self.share, self.counts = share, counts


class Packer:
    """Packs items as they come; yields lists of items, one list a sequence."""

    def __init__(self, capacity: tuple[int, int, int], cuttable: bool, pool: int):
        self.capacity, self.cuttable, self.limit = np.array(capacity, float), cuttable, pool
        self.pool = Pool(self.capacity)

    def add(self, item: Item) -> Iterator[list[Item]]:
        tokens, loss = int(self.capacity[0]), int(self.capacity[2])
        while (d := item.demand())[0] >= tokens or d[2] > loss:
            n = self._most(item, tokens, loss)
            if n >= len(item.ids):
                yield [item]
                return
            head, item = item.cut(n)
            yield [head]
        if len(item.ids):
            self.pool.put(item)
        if self.pool.waiting >= self.limit:
            yield from self.drain(self.limit // 2)

    @staticmethod
    def _most(item: Item, tokens: int, loss: int) -> int:
        """How many ids from the start fit: at least one."""
        if item.loss is None:
            return max(1, min(tokens, loss, len(item.ids)))
        return int(max(1, min(tokens, np.searchsorted(np.cumsum(item.loss), loss, "right"))))

    def drain(self, down_to: int) -> Iterator[list[Item]]:
        """Fills bins until so many items wait."""
        pool = self.pool
        while pool.waiting > down_to:
            pool.tidy()
            weight = pool.total / pool.waiting
            room, bin_ = np.ones(3), []
            while pool.waiting:
                n = len(pool.items)
                products = np.where(pool.counts[:n] > 0, pool.share[:n] @ (weight * room), -1.0)
                fits = (pool.share[:n] <= room + 1e-9).all(axis=1)
                i = int(np.where(fits, products, -1.0).argmax())
                if fits[i] and pool.counts[i] > 0:
                    room = room - pool.share[i]
                    bin_.append(pool.take(i))
                    if room[0] < 1e-9:
                        break
                    continue
                left = np.rint(room * self.capacity).astype(int)
                if self.cuttable and left.min() >= 1:
                    item = pool.take(int(products.argmax()))
                    k = min(self._most(item, *left[[0, 2]].tolist()), len(item.ids) - 1)
                    if k >= 1:
                        head, item = item.cut(k)
                        bin_.append(head)
                    pool.put(item)
                break
            yield bin_


def powers(bin_: list[Item]) -> Iterator[list[Item]]:
    """A bin as sequences whose lengths are powers of two, largest first."""
    queue, left = bin_[::-1], sum(len(i.ids) for i in bin_)
    while left:
        room, out = 1 << (left.bit_length() - 1), []
        left -= room
        while room:
            item = queue.pop()
            if len(item.ids) > room:
                item, rest = item.cut(room)
                queue.append(rest)
            out.append(item)
            room -= len(item.ids)
        yield out


def pack_items(items: Iterator[Item], max_tokens: int, max_segments: int, max_loss: int, cuttable: bool = True, pool: int = 1024) -> Iterator[list[Item]]:
    """Sequences, as lists of items. Without cutting, an item that exceeds a limit by itself is still cut."""
    packer = Packer((max_tokens, max_segments, max_loss), cuttable, pool)

    def shaped(bins):
        for b in bins:
            if cuttable and sum(len(i.ids) for i in b) < max_tokens:
                yield from powers(b)
            elif b:
                yield b

    for item in items:
        yield from shaped(packer.add(item))
    yield from shaped(packer.drain(0))


def pack(df: DataFrame, tokenizer: str, key: str = "doc_id", text_col: str = "text", loss_col: str | None = None, final_id: int | None = 1, max_tokens: int = 2048, max_segments: int = 512, max_loss: int = 2048, cuttable: bool = True) -> DataFrame:
    """One row a piece: key, start, length, ids (unsigned 32-bit, little-endian), item_tokens, sequence_id, offset.

    tokenizer: the path of a word-level tokenizer file, readable on executors. loss_col: a boolean column
    that says whether a row's tokens bear loss (instruction data: the answers); without it all do but the
    first of each item, which nothing precedes.
    """
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_tokenizer(tokenizer)
        base, number = TaskContext.get().partitionId() << 40, 0

        def items() -> Iterator[Item]:
            for batch in batches:
                for at in range(0, batch.num_rows, 256):
                    part = batch.slice(at, 256)
                    texts = [t or "" for t in part.column(1).to_pylist()]
                    bears = part.column(2).to_pylist()
                    for k, ids, bear in zip(part.column(0).to_pylist(), words.encode(texts), bears, strict=True):
                        if final_id is not None:
                            ids = np.append(ids, np.uint32(final_id))
                        if not len(ids):
                            continue
                        loss = np.full(len(ids), bool(bear))
                        loss[0] &= bear is not None and loss_col is not None
                        yield Item(k, 0, ids, loss, len(ids))

        rows: list[tuple] = []
        columns = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
        types, names = [], ["key", "start", "length", "ids", "item_tokens", "sequence_id", "offset"]

        def source():
            for batch in source_batches:
                if not types:
                    types.extend([batch.schema.field(0).type, *[pa.int64()] * 2, pa.binary(), *[pa.int64()] * 3])
                yield batch

        source_batches, batches = batches, None
        batches = source()
        for sequence in pack_items(items(), max_tokens, max_segments, max_loss, cuttable):
            offset = 0
            for i in sequence:
                rows.append((i.key, i.start, len(i.ids), i.ids.tobytes(), i.total, base + number, offset))
                offset += len(i.ids)
            number += 1
            if len(rows) >= 512:
                yield columns()
                rows.clear()
        if rows:
            yield columns()
        words.rest()
        give_back()

    bears = F.col(loss_col) if loss_col else F.lit(True)
    return df.select(F.col(key).alias("k"), F.col(text_col).alias("t"), bears.alias("b")).mapInArrow(run, SCHEMA.format(kind))
