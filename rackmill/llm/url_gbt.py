"""URL verdicts: host and path rules, else gradient-boosted trees on lexical features.

Features of a URL: lengths of url, host and path, depth, labels in the host, digit ratios of host and
path, character entropies of host and path, hyphens in the host, longest label, parameters, fragment, and the
smoothed share of blocked training URLs for the host's last label and for the host's last two
labels. The trees (logistic loss, histogram splits on quantile bins, leaf weights -G / (H + lambda)) are trained on the driver
from a bounded sample of labelled URLs: the SAMPLE with the smallest hash of the distinct (url, label) rows.

The trees are to judge hosts that they have not seen. So every host weighs the same, however many URLs it has; both sides of a
split hold at least LEAST_HOSTS hosts, so that no leaf learns one host by its length; suffix shares of a training URL leave its own
host out; and both labels weigh the same, as label 0 mostly means that nothing is known of a host. And no URL is judged by trees that saw its host
or a sibling of it: hosts fall into FOLDS parts by their last three labels, and a part is judged by trees trained on the others, so a verdict is never a URL's own label given back.

Labels: a DataFrame (url, label), 1 for block. seed_labels() gives such rows from hosts known to be bad by their words; hosts of other words
that look like them are for the trees to find.

Defined results: a null url, or one without ://, has an empty host and path, matches no rule and
is judged by the trees like any other; without labelled URLs of both kinds the trees allow. Repeated rows each get a
row. Other columns are ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .words import parts, tidy

#: (host and path, verdict)
RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))
#: Words of hosts whose URLs serve as blocked examples.
SEED_WORDS = ("spam", "farm", "cheap", "pills", "casino", "xxx", "warez", "malware", "phish")
SAMPLE = 20_000
TREES, DEPTH, RATE, LAMBDA, BINS = 40, 3, 0.2, 1.0, 32
LEAST_HOSTS = 3
#: Parts of the hosts; each is judged by the trees of the others.
FOLDS = 16
#: Features that a tree may use, drawn anew for each, so that no single one decides.
DRAWN = 5
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FEATURES = ("url_len", "host_len", "path_len", "depth", "labels", "host_digits", "path_digits", "host_entropy", "path_entropy", "hyphens", "longest", "params", "fragment", "suffix1", "suffix2")


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path by the first ://."""
    has = F.coalesce(F.contains(url, F.lit("://")), F.lit(False))
    rest = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.when(has, F.translate(host, _UPPER, _LOWER)).otherwise(F.lit("")), F.when(has, path).otherwise(F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: (len(r[0]), r[0])):  # later and longer ones win
        h, _, p = text.partition("/")
        fits = ((host == h) | host.endswith("." + h)) & path.startswith("/" + p)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def _entropy(s: str) -> float:
    n = len(s)
    return -sum(c / n * math.log2(c / n) for c in Counter(s).values()) if n else 0.0


def _suffixes(host: str) -> tuple[str, str]:
    labels = host.split(".")
    return labels[-1], ".".join(labels[-2:])


def _rate(counts: dict[str, tuple[float, float]], key: str, prior: float, own: tuple[float, float] = (0, 0)) -> float:
    """Smoothed share of blocked hosts. own: hosts and blocked ones to leave out."""
    n, bad = counts.get(key, (0, 0))
    return (max(0.0, bad - own[1]) + prior) / (max(0.0, n - own[0]) + 1)


def parse(url: str | None) -> tuple[str, str]:
    """split_url() for one string."""
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), path


def features(urls: list[str | None], stats: dict, without: dict[str, tuple[float, float]] | None = None) -> np.ndarray:
    """A row for each URL. without: for each host its part of the suffix counts, which is left out."""
    out = np.zeros((len(urls), len(FEATURES)))
    for i, url in enumerate(urls):
        u = url or ""
        host, path = parse(url)
        labels = host.split(".")
        query = u.partition("?")[2].partition("#")[0]
        s1, s2 = _suffixes(host)
        own = without[host] if without else (0, 0)
        out[i] = (
            len(u), len(host), len(path), sum(1 for x in path.split("/") if x), len(labels),
            sum(c.isdigit() for c in host) / max(1, len(host)), sum(c.isdigit() for c in path) / max(1, len(path)),
            _entropy(host), _entropy(path), host.count("-"), max(map(len, labels)), query.count("&") + 1 if query else 0, "#" in u,
            _rate(stats["1"], s1, stats["prior"], own), _rate(stats["2"], s2, stats["prior"], own),
        )
    return out


class Trees:
    """Boosted trees of a fixed depth over binned features, with the logistic loss."""

    def __init__(self):
        self.cuts: list[np.ndarray] = []
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.base = -10.0

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, k], "left") for k, c in enumerate(self.cuts)], 1).astype(np.int16)

    def fit(self, x: np.ndarray, y: np.ndarray, hosts: np.ndarray | None = None) -> Trees:
        """hosts: the share of a host that each row is; all rows are hosts if None."""
        if not len(y) or y.min() == y.max():
            return self
        self.cuts = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS + 1)[1:-1])) for k in range(x.shape[1])]
        b = self.bins(x)
        hosts = np.ones(len(y)) if hosts is None else hosts
        weight = hosts * np.where(y == 1, hosts[y == 0].sum() / hosts[y == 1].sum(), 1.0)
        self.base = 0.0
        score = np.zeros(len(y))
        rng = np.random.Generator(np.random.Philox(7))
        for _ in range(TREES):
            q = 1 / (1 + np.exp(-score))
            g, h = weight * (q - y), weight * q * (1 - q)
            tree = self._tree(b, g, h, hosts, np.sort(rng.permutation(b.shape[1])[:DRAWN]))
            self.trees.append(tree)
            score += RATE * self._walk(b, tree)
        return self

    def _tree(self, b: np.ndarray, g: np.ndarray, h: np.ndarray, hosts: np.ndarray, drawn: np.ndarray):
        inner = 2**DEPTH - 1
        feature, cut, leaf = np.zeros(inner, np.int64), np.full(inner, BINS + 1), np.zeros(2**DEPTH)
        node = np.zeros(len(g), np.int64)
        for level in range(DEPTH):
            for k in range(2**level - 1, 2 ** (level + 1) - 1):
                own = node == k
                every = hosts[own].sum()
                if every < 2 * LEAST_HOSTS:
                    continue
                gs, hs, best = g[own], h[own], 1e-9
                total = gs.sum() ** 2 / (hs.sum() + LAMBDA)
                for f in drawn.tolist():
                    gl = np.cumsum(np.bincount(b[own, f], gs, BINS + 1))[:-1]
                    hl = np.cumsum(np.bincount(b[own, f], hs, BINS + 1))[:-1]
                    left = np.cumsum(np.bincount(b[own, f], hosts[own], BINS + 1))[:-1]
                    gain = gl**2 / (hl + LAMBDA) + (gs.sum() - gl) ** 2 / (hs.sum() - hl + LAMBDA) - total
                    gain[np.minimum(left, every - left) < LEAST_HOSTS - 1e-9] = 0
                    c = int(gain.argmax())
                    if gain[c] > best:
                        best, feature[k], cut[k] = gain[c], f, c
            node = 2 * node + 1 + (b[np.arange(len(g)), feature[node]] > cut[node])
        at = node - inner
        leaf = -np.bincount(at, g, 2**DEPTH) / (np.bincount(at, h, 2**DEPTH) + LAMBDA)
        return feature, cut, leaf

    def _walk(self, b: np.ndarray, tree) -> np.ndarray:
        feature, cut, leaf = tree
        node, rows = np.zeros(len(b), np.int64), np.arange(len(b))
        for _ in range(DEPTH):
            node = 2 * node + 1 + (b[rows, feature[node]] > cut[node])
        return leaf[node - (2**DEPTH - 1)]

    def predict(self, x: np.ndarray) -> np.ndarray:
        score = np.full(len(x), self.base)
        if self.trees and len(x):
            b = self.bins(x)
            for tree in self.trees:
                score += RATE * self._walk(b, tree)
        return 1 / (1 + np.exp(-score))


class UrlModel:
    def __init__(self, labelled: list[tuple[str, int]]):
        names = [parse(url)[0] for url, _ in labelled]
        rows = Counter(names)
        one: dict[str, list[float]] = {}
        two: dict[str, list[float]] = {}
        own: dict[str, list[float]] = {}
        for host, (_, label) in zip(names, labelled, strict=True):
            for counts, key in zip((one, two, own), (*_suffixes(host), host), strict=True):
                c = counts.setdefault(key, [0.0, 0.0])
                c[0] += 1 / rows[host]
                c[1] += label / rows[host]
        y = np.array([x for _, x in labelled], float)
        hosts = np.array([1 / rows[host] for host in names])
        self.stats = {"1": {k: tuple(v) for k, v in one.items()}, "2": {k: tuple(v) for k, v in two.items()}, "prior": float(np.average(y, weights=hosts)) if len(y) else 0.0}
        without = {k: (v[0], v[1]) for k, v in own.items()}
        self.trees = Trees().fit(features([u for u, _ in labelled], self.stats, without), y, hosts)

    def __call__(self, urls: list[str | None]) -> np.ndarray:
        return self.trees.predict(features(urls, self.stats))


def seed_labels(pages: DataFrame, url_col: str = "url", words=SEED_WORDS) -> DataFrame:
    """(url, label): 1 where a part of the host, cut at dots and hyphens, is one of the words."""
    host = split_url(F.col(url_col))[0]
    bad = F.arrays_overlap(F.split(host, r"[.\-]"), F.array(*map(F.lit, words)))
    return pages.filter(F.col(url_col).isNotNull()).select(F.col(url_col).alias("url"), bad.cast("int").alias("label"))


def site(host: str) -> str:
    """A host's last three labels, which it shares with its siblings."""
    return ".".join(host.split(".")[-3:])


def fold(host: str, folds: int = FOLDS) -> int:
    return zlib.crc32(site(host).encode()) % folds


class FoldedModel:
    """For each part of the hosts a model that saw none of them."""

    def __init__(self, labelled: list[tuple[str, int]], folds: int = FOLDS):
        self.models = [UrlModel([(u, y) for u, y in labelled if fold(parse(u)[0], folds) != k]) for k in range(folds)]

    def __call__(self, urls: list[str | None]) -> np.ndarray:
        at = np.array([fold(parse(u)[0], len(self.models)) for u in urls], np.int64)
        out = np.zeros(len(urls))
        for k in np.unique(at).tolist():
            own = np.flatnonzero(at == k)
            out[own] = self.models[k]([urls[i] for i in own.tolist()])
        return out


def train(labelled: DataFrame, sample: int = SAMPLE) -> FoldedModel:
    """From the `sample` distinct rows with the smallest hash."""
    rows = labelled.select("url", "label").groupBy("url", "label").count().orderBy(F.xxhash64("url"), "url", "label").limit(sample)
    return FoldedModel([(r.url, int(r.label)) for r in rows.select("url", "label").collect()])


def judge(pages: DataFrame, labelled: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, threshold: float = 0.5) -> DataFrame:
    """page_id, host, path, rule, verdict and the trees' score for each row of pages."""
    model = pages.sparkSession.sparkContext.broadcast(train(labelled))

    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array(np.concatenate([model.value(urls.to_pylist()) for urls in parts(batch)] or [np.zeros(0)]), pa.float64())

    d = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"))
    host, path = split_url(F.col("url"))
    d = d.withColumns({"host": host, "path": path, "score": F.arrow_udf(tidy(score), "double")(F.col("url"))})
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("score") >= threshold, F.lit("block")).otherwise(F.lit("allow"))
    return d.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"), F.round("score", 6).alias("score"))
