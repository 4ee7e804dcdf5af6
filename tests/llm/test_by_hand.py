"""Operators that SQL doesn't express, step by step in plain Python: the ring's walk, a tree's split, sums of contexts, bound letters."""

import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rackmill.llm import hd_lang, quality_classifier, ring, url_gbt, words

# ---- 2 ----


@pytest.mark.parametrize("seed", [1, 2, 3, 4])
def test_a_split_is_the_best_of_all(seed):
    rng = np.random.default_rng(seed)
    n = 60
    b = rng.integers(0, url_gbt.BINS, (n, 6)).astype(np.int16)
    g, h, hosts = rng.normal(size=n), rng.random(n) + 0.1, rng.random(n) * 0.6
    drawn = np.array([0, 2, 5])
    feature, cut, leaf = url_gbt.Trees()._tree(b, g, h, hosts, drawn)
    gain = {}
    for f in drawn.tolist():
        for c in range(url_gbt.BINS):
            left = [i for i in range(n) if b[i, f] <= c]
            right = [i for i in range(n) if b[i, f] > c]
            if min(sum(hosts[i] for i in left), sum(hosts[i] for i in right)) >= url_gbt.LEAST_HOSTS:
                gain[f, c] = sum(sum(g[i] for i in side) ** 2 / (sum(h[i] for i in side) + url_gbt.LAMBDA) for side in (left, right))
    assert gain[feature[0], cut[0]] == pytest.approx(max(gain.values()))
    # every leaf weighs what its rows ask for
    at = [0] * n
    for i in range(n):
        for _ in range(url_gbt.DEPTH):
            at[i] = 2 * at[i] + 1 + int(b[i, feature[at[i]]] > cut[at[i]])
    for k in range(2**url_gbt.DEPTH):
        own = [i for i in range(n) if at[i] - (2**url_gbt.DEPTH - 1) == k]
        assert leaf[k] == pytest.approx(-sum(g[i] for i in own) / (sum(h[i] for i in own) + url_gbt.LAMBDA))


def test_no_host_is_judged_by_trees_that_saw_it(monkeypatch):
    seen = []
    real = url_gbt.UrlModel.__init__

    def noted(self, labelled):
        seen.append({url_gbt.parse(u)[0] for u, _ in labelled})
        real(self, labelled)

    monkeypatch.setattr(url_gbt.UrlModel, "__init__", noted)
    urls = [(f"http://{a}.{b}.org/{k}", int(b == "pills")) for a in ("www", "m", "x-y") for b in ("pills", "one", "two", "three", "free") for k in range(3)] + [(None, 0), ("plain", 0)]
    model = url_gbt.FoldedModel(urls)
    assert len(seen) == len(model.models) == url_gbt.FOLDS
    for u, _ in urls:
        host = url_gbt.parse(u)[0]
        own = seen[url_gbt.fold(host)]
        assert not any(url_gbt.site(s) == url_gbt.site(host) for s in own)
    one = model([u for u, _ in urls])
    assert one.tolist() == [float(model.models[url_gbt.fold(url_gbt.parse(u)[0])]([u])[0]) for u, _ in urls]


@pytest.mark.parametrize(("table", "found", "wrong"), [("sf0.1", 0.9, 0.02)])
def test_held_out_hosts(table, found, wrong):
    """Every verdict is one on a host that the trees haven't seen."""
    urls = [r[0] for r in duckdb.connect().execute(f"select url from '/root/testdata/{table}/pages.parquet' where url is not null").fetchall()]
    label = np.array([bool(set(re.split(r"[.\-]", url_gbt.parse(u)[0])) & set(url_gbt.SEED_WORDS)) for u in urls])
    p = url_gbt.FoldedModel(list(zip(urls, label.astype(int).tolist(), strict=True)))(urls) >= 0.5
    assert p[label].mean() >= found and p[~label].mean() <= wrong


# ---- 7 ----


def walked(cells, shards, vnodes=8, cells_of_ring=256):
    """Row by row: first every row at home while there is room, then those turned away, clockwise."""
    nodes = ring.ring(shards, vnodes, cells_of_ring)
    room = ring.capacities(len(cells), shards)
    home, turned = {}, []
    for k, c in enumerate(cells):  # in ring order
        at = next((i for i, (cell, _) in enumerate(nodes) if cell >= c), 0)
        s = nodes[at][1]
        if room[s]:
            room[s] -= 1
            home[k] = s
        else:
            turned.append((k, at))
    for k, at in turned:
        while True:
            at = (at + 1) % len(nodes)
            s = nodes[at][1]
            if room[s]:
                room[s] -= 1
                home[k] = s
                break
    return home


@pytest.mark.parametrize(("seed", "shards"), [(1, 3), (2, 7), (3, 11)])
def test_the_plan_is_the_walk(seed, shards):
    rng = random.Random(seed)
    cells = sorted(rng.choices(range(256), k=300) + [rng.randrange(256)] * 200)  # a hot cell
    want = walked(cells, shards)
    counts = Counter(cells)
    first = {c: i for i, c in reversed(list(enumerate(cells)))}
    got, slots = {}, {}
    for cell, a, b, s, slot in ring.plan(dict(counts), shards, 8, 256):
        for k in range(a, b):
            got[first[cell] + k] = s
            slots.setdefault(s, []).append(slot + k - a)
    assert Counter(got.values()) == Counter(want.values()) and got == want
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_rows_of_the_ring_run_no_python_and_take_clashing_names(spark):
    df = spark.createDataFrame([(k % 5, f"t{k % 7}", k, k, 0.5, "x") for k in range(60)], "doc_id long, text string, cell int, h long, rank double, shard string")
    out = ring.shard(df, 4)
    assert not re.search("Python|Pandas|Arrow", out._jdf.queryExecution().toString())
    got = out.collect()
    assert sorted(Counter(r.shard for r in got).values()) == [15] * 4 and Counter(r.doc_id for r in got) == Counter(k % 5 for k in range(60))


def test_growth_moves_about_its_share():
    """One more shard: what moves is about what it takes and what overflows differently, far from all."""
    rng = np.random.default_rng(3)
    counts = dict(Counter(rng.integers(0, ring.CELLS, 200_000).tolist()))
    places = []
    for n in (40, 41):
        own = {}
        for cell, a, b, s, _ in ring.plan(counts, n):
            for k in range(a, b):
                own[cell, k] = s
        places.append(own)
    moved = sum(places[0][k] != s for k, s in places[1].items()) / len(places[1])
    into = sum(s == 40 and places[0][k] != 40 for k, s in places[1].items()) / len(places[1])
    assert into == pytest.approx(1 / 41, abs=0.002) and into <= moved <= 5 / 41


# ---- 8 ----


def test_context_sums_word_by_word(spark):
    rng = random.Random(2)
    texts = [" ".join(rng.choices(["a", "b", "cc", "d-e", "é", "F"], k=rng.randint(0, 12))) for _ in range(30)] + [None, "", "one"]
    index = quality_classifier.index_vectors()
    assert set(np.abs(index).sum(1)) == {2.0} and np.unique(index).tolist() == [-1, 0, 1]
    bucket = lambda w: int(words.word_hashes(pa.array([w]), False)[0][0] % np.uint64(quality_classifier.BUCKETS))
    want = np.zeros((quality_classifier.BUCKETS, quality_classifier.DIMS))
    for t in texts:
        ws = (t or "").split(" ") if t else []
        for i, w in enumerate(ws):
            for j, near in enumerate(ws):
                if i != j and abs(i - j) <= quality_classifier.REACH:
                    want[bucket(w)] += index[bucket(near)]
    got = np.zeros_like(want)
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    schema = "bucket int, " + ", ".join(f"{n} double" for n in quality_classifier._DIMS)
    for r in df.mapInArrow(quality_classifier._contexts, schema).collect():
        got[r.bucket] += np.array(r[1:])
    assert (got == want).all() and np.abs(want).sum() > 0
    v = quality_classifier.word_vectors(df)
    rows = quality_classifier.pooled(pa.array(texts), v)
    for t, row in zip(texts, rows, strict=True):
        own = [v[bucket(w)].astype(float) for w in (t.split(" ") if t else [])]
        if own:
            assert np.allclose(row[: v.shape[1]], np.mean(own, 0), atol=1e-5) and np.allclose(row[v.shape[1] : -1], np.sqrt(np.mean(np.square(own), 0)), atol=1e-5) and row[-1] == pytest.approx(math.log1p(len(own)))
        else:
            assert not row.any()


# ---- 9 ----


def test_letters_are_bound_and_bundled():
    """A trigram's vector is the product of its letters' vectors, the first rotated by two places, the second by one."""
    hd_lang.vectors(np.array([0]))
    letters = hd_lang._vectors[hd_lang.DIMS].astype(int)
    d = hd_lang.DIMS

    def bound(a, b, c):
        return np.array([letters[a][(i - 2) % d] * letters[b][(i - 1) % d] * letters[c][i] for i in range(d)])

    texts = ["Ab, ba!", "é aa", "zz top  zz"]
    for text in texts:
        sym = []
        for ch in f" {text} ":
            s = 0
            if ch.isalpha():
                low = ch.lower()[0]
                s = ord(low) - 96 if "a" <= low <= "z" else 27 + ord(low) * 2654435761 % 2**32 * hd_lang.OTHERS // 2**32
            if s or not sym or sym[-1]:
                sym.append(s)
        want = sum(bound(*t) for t in zip(sym, sym[1:], sym[2:], strict=False) if any(t))
        codes, n = hd_lang.trigrams(pa.array([text]))[0]
        assert (hd_lang.bundle(codes, n) == want).all()
    # the language whose prototype has the largest cosine
    weights = {name: hd_lang.trigrams(pa.array([t]))[0] for name, t in zip("xyz", texts, strict=True)}
    profiles = hd_lang.Profiles(weights)
    own = np.stack([hd_lang.bundle(*weights[k]) for k in "xyz"])
    own = own / np.linalg.norm(own, axis=1, keepdims=True)
    own = own - own.mean(0)
    own = own / np.linalg.norm(own, axis=1, keepdims=True)
    asked = [*texts, "ab ba ab", "top", "éé", "17"]
    langs, scores = profiles(pa.array(asked))
    for t, lang, score in zip(asked, langs, scores, strict=True):
        tri = hd_lang.trigrams(pa.array([t]))[0]
        if tri is None:
            assert (lang, score) == ("und", 0)
            continue
        v = hd_lang.bundle(*tri)
        cosine = own @ v / np.linalg.norm(v)
        assert lang == "xyz"[int(cosine.argmax())] and score == pytest.approx(0.5 + 0.5 * cosine.max(), abs=1e-5)


def test_columns_named_like_ours(spark):
    df = spark.createDataFrame([(1, "some text", "k", "v")], "doc_id long, text string, bucket string, v0 string")
    assert quality_classifier.word_vectors(df).shape[0] == quality_classifier.BUCKETS and df.select(F.col("bucket")).count() == 1
