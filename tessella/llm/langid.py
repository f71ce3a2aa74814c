"""Language identification by a byte convolutional network, trained and applied in numpy.

Filters of widths 2, 3 and 4 slide over one-hot bytes; each is max-pooled over a window of fixed
length, and a softmax layer reads the pooled values. A whole text is cut into windows of
``window`` positions (a window also sees the next three bytes, so that no n-gram is lost); all
windows are classified, in batches, and their probabilities averaged by the bytes they cover.

Training takes a bounded sample: of the labelled rows that the caller allows, in the 256 most frequent
languages, at most ``per_language`` (one for each language and hash bucket, the one with the least hash of its id),
and of each a few windows from places all over the text. Labels serve training alone.

Cases: a null text, an empty one and one without any letter is ``und`` with score 0. Without
labelled rows every text is ``und``. Ties go to the language that sorts first. Very long texts are
read whole, in blocks. Other columns pass through untouched.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.store import give_back

UNKNOWN = "und"
WIDTHS = (2, 3, 4)
BATCH = 512
#: Languages that are learnt at most: the most frequent labels, so that dirty ones can't fill the driver.
MOST_LANGUAGES = 256
#: Characters of a slice that training takes a window from.
SLICE = 512


@dataclass
class ByteConvNet:
    """languages: what the classes stand for. taps[w][k]: (256, filters), what the k-th byte of an n-gram adds."""

    languages: list[str]
    taps: dict[int, list[np.ndarray]]
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray
    window: int = 256
    tables: list = field(default_factory=list, repr=False)

    def __getstate__(self):
        return self.__dict__ | {"tables": []}

    def prepare(self) -> None:
        """Folds the taps into tables over byte pairs: five lookups a position for the three widths."""
        if not self.tables:
            t = {w: [x.astype(np.float32) for x in xs] for w, xs in self.taps.items()}
            pair = lambda a, b: (a[:, None] + b[None]).reshape(65536, -1)
            self.tables = [pair(*t[2]), pair(*t[3][:2]), t[3][2], pair(*t[4][:2]), pair(*t[4][2:])]

    def pooled(self, x: np.ndarray) -> np.ndarray:
        """x: (n, window + 3) bytes; the filters' maxima, (n, 3 * filters)."""
        self.prepare()
        two, three, third, four, rest = self.tables
        p = self.window
        pairs = (x[:, :-1].astype(np.int32) << 8) | x[:, 1:]

        def top(a: np.ndarray) -> np.ndarray:
            while a.shape[1] > 1:
                h = a.shape[1] // 2
                b = np.maximum(a[:, :h], a[:, h : 2 * h])
                a = b if a.shape[1] == 2 * h else np.concatenate([b, a[:, 2 * h :]], axis=1)
            return a[:, 0]

        a = three.take(pairs[:, :p], axis=0)
        a += third.take(x[:, 2 : p + 2], axis=0)
        b = four.take(pairs[:, :p], axis=0)
        b += rest.take(pairs[:, 2 : p + 2], axis=0)
        return np.concatenate([top(two.take(pairs[:, :p], axis=0)), top(a), top(b)], axis=1)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        z = np.maximum(self.pooled(x) + self.bias, 0) @ self.out + self.out_bias
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    def predict(self, texts: Iterator[str | None]) -> tuple[list[str], list[float]]:
        """Labels and scores; windows of several texts share a batch."""
        total, weight = {}, {}
        rows, owner, cover = [], [], []

        def flush() -> None:
            if rows:
                p = self.probabilities(np.stack(rows)) * np.array(cover)[:, None]
                for k, v in zip(owner, p, strict=True):
                    total[k] = total.get(k, 0) + v
                rows.clear(), owner.clear(), cover.clear()

        n = 0
        for n, text in enumerate(texts, 1):
            if not text or not any(map(str.isalpha, text)):
                continue
            for x, size in windows(text, self.window):
                rows.append(x), owner.append(n), cover.append(size)
                weight[n] = weight.get(n, 0) + size
                if len(rows) >= BATCH:
                    flush()
        flush()
        best = {k: int(v.argmax()) for k, v in total.items()}
        return [self.languages[best[i]] if i in best else UNKNOWN for i in range(1, n + 1)], [float(min(1.0, total[i][best[i]] / weight[i])) if i in best else 0.0 for i in range(1, n + 1)]


def windows(text: str, window: int) -> Iterator[tuple[np.ndarray, int]]:
    """All windows of a text's UTF-8 bytes, (window + 3) wide and filled up with zero, and how many bytes each covers."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    count = -(-len(raw) // window)
    full = np.zeros(count * window + 3, np.uint8)
    full[: len(raw)] = raw
    for k in range(count):
        yield full[k * window : (k + 1) * window + 3], min(window, len(raw) - k * window)


def tap_numbers() -> dict[int, list[int]]:
    """Which of the parameters are the taps of each width."""
    out, at = {}, 0
    for w in WIDTHS:
        out[w], at = list(range(at, at + w)), at + w
    return out


def gradients(params: list[np.ndarray], x: np.ndarray, y: np.ndarray, share: np.ndarray, window: int, filters: int) -> tuple[float, list[np.ndarray]]:
    """Loss (each language weighted by its share) and gradients of a batch of windows."""
    taps_of, n = tap_numbers(), len(y)
    pooled, where = [], {}
    for w in WIDTHS:
        act = sum(params[t][x[:, k : window + k]] for k, t in enumerate(taps_of[w]))
        where[w] = act.argmax(axis=1)
        pooled.append(np.take_along_axis(act, where[w][:, None, :], axis=1)[:, 0])
    h = np.maximum(pre := np.concatenate(pooled, axis=1) + params[-3], 0)
    z = h @ params[-2] + params[-1]
    z = np.exp(z - z.max(axis=1, keepdims=True))
    d = z / z.sum(axis=1, keepdims=True)
    loss = float(-(share[y] * np.log(d[np.arange(n), y] + 1e-300)).mean())
    d[np.arange(n), y] -= 1
    d *= share[y][:, None] / n
    grads = [np.zeros_like(p) for p in params]
    grads[-2], grads[-1] = h.T @ d, d.sum(axis=0)
    back = (d @ params[-2].T) * (pre > 0)
    grads[-3] = back.sum(axis=0)
    for i, w in enumerate(WIDTHS):
        g, f = back[:, i * filters : (i + 1) * filters], np.broadcast_to(np.arange(filters), (n, filters))
        for k, t in enumerate(taps_of[w]):
            np.add.at(grads[t], (np.take_along_axis(x, where[w] + k, axis=1), f), g)
    return loss, grads


def train(texts: list[str], labels: list[str], window: int = 256, filters: int = 16, windows_per_text: int = 1, epochs: int = 8, batch: int = 64, rate: float = 0.01, seed: int = 7) -> ByteConvNet:
    """Fits the network with Adam; gradients pass through the position that each maximum came from."""
    rng = np.random.default_rng(seed)
    languages = sorted(set(labels))
    xs, ys = [], []
    for text, label in zip(texts, labels, strict=True):
        own = [x for x, size in windows(text, window) if size > 8 or len(text) <= 8]
        for i in rng.permutation(len(own))[:windows_per_text]:
            x = own[i].copy()
            if rng.random() < 0.3:  # short texts must be told apart, too
                x[rng.integers(8, window) :] = 0
            xs.append(x), ys.append(languages.index(label))
    x, y = np.stack(xs), np.array(ys)
    shape = [(256, filters)] * sum(WIDTHS)
    params = [rng.normal(0, 0.3, s) for s in shape] + [np.zeros(3 * filters), rng.normal(0, 0.2, (3 * filters, len(languages))), np.zeros(len(languages))]
    m, v, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    taps_of = tap_numbers()
    share = np.array([len(y) / (len(languages) * max(1, (y == c).sum())) for c in range(len(languages))])
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for lo in range(0, len(y), batch):
            idx = order[lo : lo + batch]
            _, grads = gradients(params, x[idx], y[idx], share, window, filters)
            step += 1
            for p, g, a, b in zip(params, grads, m, v, strict=True):
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                p -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
                p -= rate * 1e-4 * p
    f32 = [p.astype(np.float32) for p in params]
    return ByteConvNet(languages, {w: [f32[t] for t in ts] for w, ts in taps_of.items()}, f32[-3], f32[-2], f32[-1], window)


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo five; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


def training_sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str, per_language: int, slices_per_text: int = 4) -> tuple[list[str], list[str]]:
    """Slices of at most per_language labelled texts of each language, however frequent it is.

    The choice is made over all rows on ids alone, combined before the shuffle. Of a chosen text some slices
    reach the driver, from places all over it.
    """
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}") & F.col(id_col).isNotNull())
    pick = rows.groupBy(F.col(lang_col).alias("_l"), F.pmod(F.xxhash64(F.col(id_col), F.lit("sample")), F.lit(per_language)).alias("_b")).agg(F.min_by(F.col(id_col), F.xxhash64(F.col(id_col))).alias("_id"))
    frequent = [r[0] for r in rows.groupBy(F.col(lang_col).alias("_l")).count().orderBy(F.desc("count"), "_l").limit(MOST_LANGUAGES).collect()]
    ids = [r[0] for r in pick.where(F.col("_l").isin(*frequent)).select("_id").collect()] if frequent else []
    spark = docs.sparkSession
    wanted = spark.createDataFrame([(i,) for i in ids], spark.createDataFrame([], docs.select(F.col(id_col).alias("_id")).schema).schema)
    text, room = F.col(text_col), F.greatest(F.length(text_col) - SLICE, F.lit(0))
    at = lambda k: F.floor(F.pmod(F.xxhash64(F.col(id_col), F.lit(k)), F.lit(1_000_000)) / 1_000_000.0 * (room + 1)).cast("int") + 1
    slices = F.array_distinct(F.array(*[F.substring(text, at(k), F.lit(SLICE)) for k in range(slices_per_text)]))
    got = rows.join(F.broadcast(wanted), F.col(id_col) == F.col("_id")).select(F.col(id_col).alias("i"), slices.alias("t"), F.col(lang_col).alias("l")).dropDuplicates(["i"]).collect()
    got.sort(key=lambda r: (r["l"], str(r["i"])))
    pairs = [(t, r["l"]) for r in got for t in r["t"] if t]
    return [t for t, _ in pairs], [g for _, g in pairs]


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = 512, **options) -> ByteConvNet | None:
    """A network fitted to a bounded sample of docs; None without labelled rows."""
    texts, labels = training_sample(docs, id_col, text_col, lang_col, per_language)
    return train(texts, labels, **options) if texts else None


def language(text: Column, model: ByteConvNet | None) -> Column:
    """struct(lang_pred, score) of the whole text."""

    @F.arrow_udf("lang_pred string, score double")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            labels, scores = model.predict(iter(texts.to_pylist())) if model else ([UNKNOWN] * len(texts), [0.0] * len(texts))
            yield pa.StructArray.from_arrays([pa.array(labels, pa.string()), pa.array(scores, pa.float64())], ["lang_pred", "score"])

    return run(text)


NO_LETTER = re.compile(r"[\W\d_]+")


def trigrams(text: str) -> np.ndarray:
    """The byte trigrams of a text's words, each word between blanks, as numbers."""
    b = np.frombuffer(f" {NO_LETTER.sub(' ', text.lower())} ".encode("utf-8", "surrogatepass"), np.uint8).astype(np.uint32)
    return ((b[:-2] << 16) | (b[1:-1] << 8) | b[2:])[b[1:-1] != 32]


@dataclass
class Familiar:
    """What tells texts of the learned languages from others, which a softmax can't: it always has a winner.

    known: the trigrams of each language's sample, in order. floor: the least share of a text's trigrams that
    must be known. So few as `slack` unknown ones decide nothing.
    """

    known: dict[str, np.ndarray]
    floor: dict[str, float]
    slack: int = 3
    tables: dict = field(default_factory=dict, repr=False)

    def __getstate__(self):
        return self.__dict__ | {"tables": {}}

    def count(self, keys: np.ndarray, lang: str) -> int:
        if lang not in self.tables:
            bits = np.zeros(1 << 24, bool)
            bits[self.known[lang]] = True
            self.tables[lang] = np.packbits(bits, bitorder="little")
        return int((self.tables[lang].take(keys >> 3) >> (keys & 7).astype(np.uint8) & 1).sum())

    def accepts(self, text: str | None, lang: str) -> bool:
        if not text or lang not in self.known:
            return False
        keys = trigrams(text)
        return self.count(keys, lang) + self.slack >= self.floor[lang] * len(keys)


def familiarise(texts: list[str], labels: list[str], tolerance: float = 0.8, quantile: float = 0.01) -> Familiar:
    """Known trigrams and floors from a labelled sample. A floor is `tolerance` of the share that all but a
    `quantile` of the language's second half reach if only its first half is known."""
    out = Familiar({}, {})
    for lang in sorted(set(labels)):
        own = [trigrams(t) for t, g in zip(texts, labels, strict=True) if g == lang]
        first, second = own[: -(-len(own) // 2)], own[-(-len(own) // 2) :]
        half = Familiar({lang: np.unique(np.concatenate(first))}, {})
        shares = [half.count(k, lang) / len(k) for k in second if len(k)]
        out.known[lang] = np.unique(np.concatenate(own))
        out.floor[lang] = tolerance * float(np.quantile(shares, quantile)) if shares else 0.0
    return out


def judged(text: Column, model: ByteConvNet, familiar: Familiar) -> Column:
    """struct(lang_pred, score, familiar: whether the whole text looks like that language), in one pass."""

    @F.arrow_udf("lang_pred string, score double, familiar boolean")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            texts = batch.to_pylist()
            labels, scores = model.predict(iter(texts))
            known = [familiar.accepts(t, g) for t, g in zip(texts, labels, strict=True)]
            yield pa.StructArray.from_arrays([pa.array(labels, pa.string()), pa.array(scores, pa.float64()), pa.array(known, pa.bool_())], ["lang_pred", "score", "familiar"])
        give_back()

    return run(text)


def is_held_out(doc_id: Column) -> Column:
    return F.coalesce(fold(doc_id) == 0, F.lit(False))


def crc_fold(doc_id: int) -> int:
    """fold() in plain Python."""
    return zlib.crc32(str(doc_id).encode()) % 5
