"""Main text of web pages by a recurrent block labeller in numpy.

A page becomes its sequence of leaf blocks. Each block has a vector: its tag path's marks (tags and
the words of class, id and role), hashed and embedded, its words, hashed and embedded, and a few
measures of its text. A bidirectional LSTM reads the whole sequence, so every block is classified with
the page's context on both sides. It is trained here, on generated pages whose labels are known; no
row of any table is used. Its weights are stored beside this module.

Cases: a null or empty page has empty text. Unclosed tags, comments, quotes and raw elements are read
to the end of the page. Very long pages are one sequence. Repeated rows give repeated rows; other
columns aren't read.
"""

from __future__ import annotations

import hashlib
import inspect
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tessella.llm.html_blocks import Block, blocks
from tessella.llm.html_pages import labelled

PATHS, WORDS, MEASURES, HIDDEN = 1024, 256, 14, 24
WEIGHTS = Path(__file__).with_name("html_weights.npz")


def bucket(token: str, n: int) -> int:
    return zlib.crc32(token.encode("utf-8", "surrogatepass")) % n


def path_tokens(path: tuple[tuple[str, ...], ...]) -> list[int]:
    """Every mark anywhere in the path, and those of the innermost two elements once more as such."""
    flat = dict.fromkeys(m for marks in path for m in marks)
    near = [f"{d}:{m}" for d, marks in enumerate(path[::-1][:2]) for m in marks]
    return [bucket(t, PATHS) for t in (*flat, *near)]


class Buckets(dict):
    """Buckets of words, remembered up to a bound."""

    LIMIT = 500_000

    def __missing__(self, word: str) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        k = self[word] = bucket(word.lower(), WORDS)
        return k


_word_buckets = Buckets()
DIGIT = re.compile(r"\d")


def word_vectors(texts: list[list[str]]) -> np.ndarray:
    """For each list of words the roots of its buckets' shares."""
    sizes = np.array([len(t) for t in texts])
    flat = np.fromiter(map(_word_buckets.__getitem__, chain.from_iterable(texts)), np.int64, sizes.sum())
    counts = np.bincount(np.repeat(np.arange(len(texts)), sizes) * WORDS + flat, minlength=len(texts) * WORDS)
    return np.sqrt(counts.reshape(-1, WORDS) / np.maximum(sizes, 1)[:, None]).astype(np.float32)


END = ".!?…"


def kin(page: list[Block]) -> list[list[float]]:
    """For each block, of all those of the page that lie in parts of the same marks: their share of the page's text,
    how much of it is linked, how long they are, how many end as sentences do; and how much of the page is linked."""
    total = sum(len(b.text) for b in page) or 1
    parts: dict = {}
    for b in page:
        own = parts.setdefault(b.path[:-1], [0, 0, 0, 0])
        own[0] += len(b.text)
        own[1] += b.linked
        own[2] += 1
        own[3] += b.text[-1] in END
    all_linked = min(1.0, sum(b.linked for b in page) / total)
    of = {k: [size / total, min(1.0, linked / max(1, size)), np.log1p(size / n) / 6, ends / n, all_linked] for k, (size, linked, n, ends) in parts.items()}
    return [of[b.path[:-1]] for b in page]


def measures(b: Block, words: list[str], at: int, n: int) -> list[float]:
    size = len(b.text)
    return [np.log1p(size) / 6, np.log1p(len(words)) / 4, min(1.0, b.linked / max(1, size)), float(b.text[-1] in END), b.text.count(",") / max(1, len(words)), len(DIGIT.findall(b.text)) / max(1, size), at / max(1, n - 1), len(b.path) / 10, 1.0]


class BlockLabeller:
    """params: path embedding, word weights, measure weights, and for each direction (recurrent, bias); then output."""

    def __init__(self, seed: int = 3):
        rng, h = np.random.default_rng(seed), HIDDEN
        self.p = {"path": rng.normal(0, 0.15, (PATHS, 8 * h)), "word": rng.normal(0, 0.1, (WORDS, 8 * h)), "size": rng.normal(0, 0.2, (MEASURES, 8 * h)), "f": rng.normal(0, 0.2, (h, 4 * h)), "b": rng.normal(0, 0.2, (h, 4 * h)), "out": rng.normal(0, 0.3, 2 * h), "bias": np.zeros(1)}
        self.cache: dict = {}

    def __getstate__(self):
        return self.__dict__ | {"cache": {}}

    def inputs(self, page: list[Block]) -> tuple[np.ndarray, list, np.ndarray, np.ndarray]:
        """(what both LSTMs' gates get from outside, path tokens, word vectors, measures) of a page's blocks."""
        p, x, toks = self.p, [], []
        for b in page:
            hit = self.cache.get(b.path)
            if hit is None:
                if len(self.cache) > 20_000:
                    self.cache.clear()
                ids = path_tokens(b.path)
                hit = self.cache[b.path] = (p["path"][ids].sum(axis=0), ids)
            x.append(hit[0]), toks.append(hit[1])
        words = [b.text.split() for b in page]
        own = [measures(b, of, at, len(page)) + k for at, (b, of, k) in enumerate(zip(page, words, kin(page), strict=True))]
        w, m = word_vectors(words), np.array(own, np.float32)
        return np.array(x) + w @ p["word"] + m @ p["size"], toks, w, m

    def _run(self, x: np.ndarray, mask: np.ndarray, rec: np.ndarray, keep: list | None) -> np.ndarray:
        """x: (n, T, 4h) gate inputs; mask: (n, T); the hidden states, (n, T, h)."""
        n, steps, h = x.shape[0], x.shape[1], HIDDEN
        hid, cell, out = np.zeros((n, h), x.dtype), np.zeros((n, h), x.dtype), np.zeros((n, steps, h), x.dtype)
        for t in range(steps):
            z = x[:, t] + hid @ rec
            gates = 1 / (1 + np.exp(-z[:, : 3 * h]))
            i, f, o = gates[:, :h], gates[:, h : 2 * h], gates[:, 2 * h :]
            g = np.tanh(z[:, 3 * h :])
            on = mask[:, t, None]
            new = np.where(on, f * cell + i * g, cell)
            tanh = np.tanh(new)
            if keep is not None:
                keep.append((hid, cell, i, f, o, g, tanh, on))
            cell, hid = new, np.where(on, o * tanh, hid)
            out[:, t] = hid
        return out

    def scores(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        """Logits of each page's blocks, from inputs()[0]."""
        steps = max(map(len, pages))
        x, mask = np.zeros((len(pages), steps, 8 * HIDDEN), np.float32), np.zeros((len(pages), steps), bool)
        for k, page in enumerate(pages):
            x[k, : len(page)], mask[k, : len(page)] = page, True
        a = self._run(x[:, :, : 4 * HIDDEN], mask, self.p["f"], None)
        b = self._run(x[:, ::-1, 4 * HIDDEN :], mask[:, ::-1], self.p["b"], None)[:, ::-1]
        z = np.concatenate([a, b], axis=2) @ self.p["out"] + self.p["bias"]
        return [z[k, : len(page)] for k, page in enumerate(pages)]

    def step(self, pages: list[list[Block]], labels: list[list[bool]], drop: np.random.Generator | None = None) -> tuple[float, dict]:
        """Loss and gradients of one batch, by back-propagation through time."""
        h, p = HIDDEN, self.p
        self.cache.clear()
        read = [self.inputs(page) for page in pages]
        if drop is not None:  # some blocks without their words, so that the words alone decide nothing
            for k, (x, toks, w, m) in enumerate(read):
                gone = drop.random(len(w)) < 0.25
                read[k] = x - (w * gone[:, None]) @ p["word"], toks, w * ~gone[:, None], m
        steps = max(map(len, pages))
        x, mask, y = np.zeros((len(pages), steps, 8 * h)), np.zeros((len(pages), steps), bool), np.zeros((len(pages), steps))
        for k, (r, own) in enumerate(zip(read, labels, strict=True)):
            x[k, : len(own)], mask[k, : len(own)], y[k, : len(own)] = r[0], True, own
        kept = [], []
        runs = [self._run(x[:, :, : 4 * h], mask, p["f"], kept[0]), self._run(x[:, ::-1, 4 * h :], mask[:, ::-1], p["b"], kept[1])]
        both = np.concatenate([runs[0], runs[1][:, ::-1]], axis=2)
        prob = 1 / (1 + np.exp(-(both @ p["out"] + p["bias"])))
        d = np.where(mask, prob - y, 0) / mask.sum()
        grads = {k: np.zeros_like(v) for k, v in p.items()}
        grads["out"], grads["bias"] = np.einsum("nt,nth->h", d, both), d.sum(keepdims=True).reshape(1)
        outer = d[:, :, None] * p["out"]
        dx = np.zeros_like(x)
        for which, name in enumerate("fb"):
            back = outer[:, :, which * h : (which + 1) * h]
            back = back if which == 0 else back[:, ::-1]
            dh, dc, rec = np.zeros((len(pages), h)), np.zeros((len(pages), h)), p[name]
            for t in range(steps - 1, -1, -1):
                hid, cell, i, f, o, g, tanh, on = kept[which][t]
                dh = dh + back[:, t]
                do, dcell = dh * tanh, dc + dh * o * (1 - tanh**2)
                dz = np.where(on, np.concatenate([dcell * g * i * (1 - i), dcell * cell * f * (1 - f), do * o * (1 - o), dcell * i * (1 - g**2)], axis=1), 0)
                grads[name] += hid.T @ dz
                dx[:, t if which == 0 else steps - 1 - t, which * 4 * h : (which + 1) * 4 * h] = dz
                dh, dc = np.where(on, dz @ rec.T, dh), np.where(on, dcell * f, dc)
        for k, (_, toks, w, m) in enumerate(read):
            own = dx[k, : len(toks)]
            grads["word"] += w.T @ own
            grads["size"] += m.T @ own
            flat = np.concatenate([np.array(t) for t in toks])
            np.add.at(grads["path"], flat, np.repeat(own, [len(t) for t in toks], axis=0))
        loss = -np.where(mask, y * np.log(prob + 1e-9) + (1 - y) * np.log(1 - prob + 1e-9), 0).sum() / mask.sum()
        return float(loss), grads

    def fit(self, pages: list, epochs: int, rate: float = 0.01, batch: int = 32, seed: int = 5) -> BlockLabeller:
        """Adam over batches of pages of like length."""
        rng, pages = np.random.default_rng(seed), [x for x in pages if x[0]]
        pages.sort(key=lambda x: len(x[0]))
        groups = [pages[i : i + batch] for i in range(0, len(pages), batch)]
        m, v, n = {k: np.zeros_like(x) for k, x in self.p.items()}, {k: np.zeros_like(x) for k, x in self.p.items()}, 0
        for epoch in range(epochs):
            for g in rng.permutation(len(groups)):
                _, grads = self.step([x[0] for x in groups[g]], [x[1] for x in groups[g]], rng)
                n += 1
                norm = np.sqrt(sum((x**2).sum() for x in grads.values()))
                for k, x in grads.items():
                    x = x * min(1.0, 5 / (norm + 1e-9))
                    m[k] += 0.1 * (x - m[k])
                    v[k] += 0.001 * (x * x - v[k])
                    self.p[k] -= rate * (0.3 if epoch >= epochs - 2 else 1) * (m[k] / (1 - 0.9**n)) / (np.sqrt(v[k] / (1 - 0.999**n)) + 1e-8)
        self.p = {k: x.astype(np.float32) for k, x in self.p.items()}
        self.cache.clear()
        return self

    def label(self, pages: list[list[Block]]) -> list[list[bool]]:
        """Whether each block of each page is main text; pages of like length share a batch."""
        order = sorted((i for i in range(len(pages)) if pages[i]), key=lambda i: len(pages[i]))
        out: list[list[bool]] = [[] for _ in pages]
        at = 0
        while at < len(order):
            to = at + 1
            while to < len(order) and to - at < 64 and (to + 1 - at) * len(pages[order[to]]) <= 16_384:
                to += 1
            own = order[at:to]
            for i, z in zip(own, self.scores([self.inputs(pages[i])[0] for i in own]), strict=True):
                out[i] = (z > 0).tolist()
            at = to
        return out


def recipe(pages: int, epochs: int, seed: int) -> str:
    """What the weights depend on: the sources that make pages and blocks, and how training goes."""
    sources = [Path(__file__).with_name(name).read_bytes() for name in ("html_blocks.py", "html_pages.py")]
    return hashlib.sha256(b"".join(sources) + repr((PATHS, WORDS, MEASURES, HIDDEN, pages, epochs, seed)).encode()).hexdigest()


@lru_cache(maxsize=2)
def trained(pages: int = 12_000, epochs: int = 9, seed: int = 11) -> BlockLabeller:
    """The labeller with the weights that were stored with the package, if they are by this recipe; else fitted
    now, once a process. ``python -m tessella.llm.html_main`` fits and stores them."""
    if WEIGHTS.exists():
        with np.load(WEIGHTS) as stored:
            if str(stored["recipe"]) == recipe(pages, epochs, seed):
                model = BlockLabeller()
                model.p = {k: stored[k].astype(np.float32) for k in model.p}
                return model
    return BlockLabeller().fit(labelled(pages, seed), epochs)


def extract(pages: list[str | None], model: BlockLabeller) -> list[str]:
    """Main texts: the blocks that are labelled so, in page order, one a line."""
    out = []
    for at in range(0, len(pages), 512):
        own = [blocks(p or "") for p in pages[at : at + 512]]
        out += ["\n".join(b.text for b, keep in zip(page, labels, strict=True) if keep) for page, labels in zip(own, model.label(own), strict=True)]
    return out


def main_text(page: Column, model: BlockLabeller | None = None) -> Column:
    """The main text of a column of HTML."""
    model = model or trained()

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for pages in batches:
            yield pd.Series(extract(pages.tolist(), model), dtype=object)

    return run(page)


def store_weights() -> None:
    """Fits the labeller and stores its weights with the package, in half precision."""
    options = [p.default for p in inspect.signature(trained.__wrapped__).parameters.values()]
    model = BlockLabeller().fit(labelled(options[0], options[2]), options[1])
    np.savez_compressed(WEIGHTS, recipe=np.array(recipe(*options)), **{k: v.astype(np.float16) for k, v in model.p.items()})


if __name__ == "__main__":
    store_weights()
