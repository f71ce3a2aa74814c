"""Which URLs to keep: rules by host and path, and logistic regression on hashed character n-grams for the rest.

A URL's host is what follows its first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; its path goes
on from there up to ``?``, ``#`` or the end. The regression sees, for host and path apart, which n-grams of 3 to 5
bytes occur (host and path between marks, digits as one sign, A-Z in lower case), each hashed to one of 2 ** 18
weights; a part with many n-grams weighs each less. It is fitted with numpy on a small table of labelled URLs,
of which at most ``most`` rows are taken (a documented bound), and sent to the tasks with the query; rules are a list of at
most MOST_RULES, compiled into one expression. So there is no shuffle, and no task holds more than a batch.

Cases: a null URL, or one without ``://``, has an empty host and path, no n-grams and the verdict of the intercept alone,
as has an empty one. A very long URL is read whole, in pieces of bounded size. Repeated rows are judged each. Of
rules that fit, the one of most characters wins, of those the one with the longer host. An empty table gives an
empty result. A column of df that bears a result's name gives way to it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.store import fresh

SLOTS = 1 << 18
WIDTHS = (3, 4, 5)
#: N-grams that a part may have before each weighs less.
USUAL = 32
#: Bytes of a piece, and rows hashed at once.
PIECE, ROWS = 1 << 20, 4096
MOST_RULES = 500
ALLOW, BLOCK = "allow", "block"

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SIGNS = bytes(ord("0") if 48 <= b < 58 else b + 32 if 65 <= b < 91 else b for b in range(256))


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Both as strings, never null."""
    part = lambda n: F.coalesce(F.regexp_extract(url, "(?s)^.*?://([^/?#]*)([^?#]*)", n), F.lit(""))
    return F.translate(part(1), UPPER, LOWER), part(2)


def fitting_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest fitting rule, nulls without one. rules: (verdict, host and path in one text).

    A rule fits its host and all subdomains of it, if the path starts with the rule's. Of the same rule given
    with both verdicts, block holds.
    """
    if len(rules) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    parts = {(verdict, *rule.partition("/")[::2], rule) for verdict, rule in rules}
    order = sorted(parts, key=lambda r: (-len(r[3]), -len(r[1]), r[3], r[0] != BLOCK))
    rule = verdict = None
    for judged, name, rest, text in order:
        name = name.lower()
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(f"/{rest}" if "/" in text else "")
        rule = (F if rule is None else rule).when(fits, F.lit(text))
        verdict = (F if verdict is None else verdict).when(fits, F.lit(judged))
    nothing = F.lit(None).cast("string")
    return (nothing, nothing) if rule is None else (rule, verdict)


def _slots(flat: np.ndarray, width: int, kind: int) -> np.ndarray:
    """The slot of the n-gram at each position (the last few are of no use)."""
    flat = np.concatenate([flat, np.zeros(max(0, width - len(flat)), np.uint64)])
    h = np.full(len(flat) - width + 1, 1469598103934665603 + 2 * kind + 8 * width, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(width):
            h = (h ^ flat[k : len(flat) - width + 1 + k]) * np.uint64(1099511628211)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (h >> np.uint64(64 - SLOTS.bit_length() + 1)).astype(np.int64)


def grams(parts: list[bytes], kind: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, slot) of the distinct n-grams of each part, in order. kind: 0 for hosts, 1 for paths."""
    out = []
    short = [(n, p) for n, p in enumerate(parts) if len(p) <= PIECE]
    at = 0
    while at < len(short):
        to, size = at, 0
        while to < len(short) and size < PIECE:
            size += len(short[to][1])
            to += 1
        flat = np.frombuffer(b"".join(p for _, p in short[at:to]), np.uint8).astype(np.uint64)
        sizes = np.array([len(p) for _, p in short[at:to]])
        row, left = np.repeat(np.array([n for n, _ in short[at:to]]), sizes), np.repeat(np.cumsum(sizes), sizes) - np.arange(len(flat))
        for w in WIDTHS:
            ok = left[: max(0, len(flat) - w + 1)] >= w
            out.append(np.unique(row[: len(ok)][ok] * SLOTS + _slots(flat, w, kind)[: len(ok)][ok]))
        at = to
    for n, p in enumerate(parts):
        if len(p) > PIECE:
            seen = np.zeros(SLOTS, bool)
            for a in range(0, len(p), PIECE):
                flat = np.frombuffer(p[a : a + PIECE + max(WIDTHS) - 1], np.uint8).astype(np.uint64)
                for w in WIDTHS:
                    seen[_slots(flat, w, kind)[:PIECE]] = True
            out.append(np.flatnonzero(seen) + n * SLOTS)
    both = np.unique(np.concatenate(out)) if out else np.zeros(0, np.int64)
    return both // SLOTS, both % SLOTS


def features(hosts: list[str], paths: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, slot, value) of hosts and paths."""
    rows, slots, values = [], [], []
    for kind, parts in enumerate(([b"." + h.encode().translate(SIGNS) + b"." if h else b"" for h in hosts], [p.encode().translate(SIGNS) + b"$" if p else b"" for p in paths])):
        row, slot = grams(parts, kind)
        count = np.bincount(row, minlength=len(parts))
        rows.append(row), slots.append(slot), values.append(np.sqrt(USUAL / np.maximum(count, USUAL))[row])
    return np.concatenate(rows), np.concatenate(slots), np.concatenate(values)


@dataclass
class Model:
    """Weights by slot and an intercept."""

    weights: np.ndarray = field(default_factory=lambda: np.zeros(SLOTS, np.float32))
    intercept: float = 0.0

    def scores(self, hosts: list[str], paths: list[str]) -> np.ndarray:
        """The probability that each URL is one to block."""
        row, slot, value = features(hosts, paths)
        z = np.bincount(row, self.weights[slot] * value, minlength=len(hosts)) + self.intercept
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def train(hosts: list[str], paths: list[str], bad: list[bool], steps: int = 1500, rate: float = 0.5, decay: float = 1e-4) -> Model:
    """Full-batch gradient descent with momentum, both kinds of rows of equal weight; deterministic. Without rows of both kinds everything is judged alike."""
    model, y = Model(), np.array(bad, float)
    if not len(y) or y.min() == y.max():
        model.intercept = 5.0 if len(y) and y[0] else -5.0
        return model
    row, slot, value = features(hosts, paths)
    own, at = np.unique(slot, return_inverse=True)
    share = np.where(y > 0, 0.5 / y.sum(), 0.5 / (1 - y).sum())
    w, b, speed, drift = np.zeros(len(own)), 0.0, np.zeros(len(own)), 0.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-(np.bincount(row, w[at] * value, minlength=len(y)) + b)))
        off = (p - y) * share
        speed = 0.9 * speed - rate * (np.bincount(at, off[row] * value, minlength=len(own)) + decay * w)
        drift = 0.9 * drift - rate * off.sum()
        w, b = w + speed, b + drift
    model.weights[own], model.intercept = w, float(b)
    return model


def fit(labelled: DataFrame, most: int = 4096) -> Model:
    """From rows (url, bad); rows with a null are left out. Of more than `most` rows those of the smallest hashes are taken."""
    host, path = host_and_path(F.col("url"))
    rows = labelled.where("url is not null and bad is not null").orderBy(F.xxhash64("url"), "url", "bad").limit(most)
    got = rows.select(host.alias("host"), path.alias("path"), "bad").collect()
    return train([r.host for r in got], [r.path for r in got], [bool(r.bad) for r in got])


def scored(host: Column, path: Column, model: Model) -> Column:
    """The probability that a URL is one to block."""
    own = np.flatnonzero(model.weights)
    weights = model.weights[own]

    @F.arrow_udf("double")
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        full = Model(intercept=model_intercept)
        full.weights[own] = weights
        for hosts, paths in batches:
            done = [full.scores(hosts.slice(at, ROWS).to_pylist(), paths.slice(at, ROWS).to_pylist()) for at in range(0, len(hosts), ROWS)]
            yield pa.array(np.concatenate([np.zeros(0), *done]))

    model_intercept = model.intercept
    return run(host, path)


def judged(df: DataFrame, model: Model, rules: list[tuple[str, str]] = (), url_col: str = "url", threshold: float = 0.5) -> DataFrame:
    """df with host, path, rule, verdict and score (the model's probability of block, whatever the rule says)."""
    kept = df.drop(*(c for c in df.columns if c.lower() in ("host", "path", "rule", "verdict", "score")))
    (own,) = fresh(kept, "judged_by")
    host, path = host_and_path(F.col(url_col))
    parts = kept.withColumn(own, F.struct(host.alias("host"), path.alias("path")))
    host, path = F.col(f"{own}.host"), F.col(f"{own}.path")
    rule, verdict = fitting_rule(host, path, list(rules))
    out = parts.select(*kept.columns, host.alias("host"), path.alias("path"), rule.alias("rule"), verdict.alias("verdict"), scored(host, path, model).alias("score"))
    return out.withColumn("verdict", F.coalesce("verdict", F.when(F.col("score") >= threshold, F.lit(BLOCK)).otherwise(F.lit(ALLOW))))


#: The labelled table's words: what sites to block call themselves, and what others do.
BAD_WORDS = """casino poker slots jackpot roulette betting bet bets wager lotto bingo gamble adult porn xxx sex nude webcam escort hookup
ads adserver adclick banner popunder popup track tracker tracking clickbait affiliate telemetry spam spammer bulkmail pills pharmacy viagra cialis
steroid diet weightloss payday loans quickcash freemoney getrich crypto-doubler giveaway prize winner warez crack keygen torrent nulled
phishing malware trojan exploit scam fake replica counterfeit hoax""".split()
GOOD_WORDS = """news daily times herald journal blog library archive museum university college school institute research science nature
garden kitchen recipe travel hotel city council government health clinic hospital weather sports football chess music theatre film books review
history culture language dictionary wiki docs developer code software engineering data maps forum community family home design studio photo
energy transport railway harbour mountain river forest ocean market shop store bank insurance law office press radio
reading cooking hiking printing housing shipping learning building banking writing parking running training wedding trading""".split()
SYLLABLES = "st sh nd nt ly ing tion ble wh ou at ed es ch ph gr tr pl qu mb rt ck ss tt ll ee oo ai au eu ie ba be bo ca ce co da de di el en er fa fi ga ha he in ka ko la le lo ma me mi mo na ne no on or pa pe ra re ri ro sa se si so ta te th ti to un ur va ve vi wa we za".split()
AFFIXES = "free best cheap win big my top hot live pro go x farm club zone online now 24 hub world".split()
ENDS = "example.com example.net example.org site.test pages.test web.invalid".split()
FRONTS = ["", "www.", "m.", "blog.", "en."]
PATHS = ["/", "/en/{n}", "/de/{n}.html", "/fr/{n}/", "/index.html", "/{n}", "/es/{n}", "/articles/{n}", ""]


def labelled_urls() -> list[tuple[str, bool]]:
    """(url, bad) by rule from the words above: names of one word, of two, and invented ones, which are no sign of anything."""
    out = []

    def add(name: str, bad: bool, path: str | None = None) -> None:
        n = len(out)
        where = PATHS[n % len(PATHS)] if path is None else path
        out.append((f"http{'s' * (n % 2)}://{FRONTS[n % len(FRONTS)]}{name}.{ENDS[n // 2 % len(ENDS)]}{where.format(n=37 * n % 9973)}", bad))

    for words, bad in ((BAD_WORDS, True), (GOOD_WORDS, False)):
        for n, word in enumerate(words):
            other = AFFIXES[n % len(AFFIXES)]
            add(word, bad)
            add(f"{other}-{word}", bad)
            add(f"{word}{other}", bad)
            add(f"{word}-{AFFIXES[(n + 7) % len(AFFIXES)]}", bad)
            add(f"{words[(5 * n + 1) % len(words)]}{word}", bad)
            add("".join(SYLLABLES[(n * k + 3 * k) % len(SYLLABLES)] for k in (1, 2, 5)[: 2 + n % 2]), bad, f"/{word}/{{n}}")
    for n in range(400):
        add("".join(SYLLABLES[(7 * n + k * (n // 9 + 5) + 11 * k * k) % len(SYLLABLES)] for k in range(2 + n % 4)), False)
    return out


def labelled_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(labelled_urls(), "url string, bad boolean")
