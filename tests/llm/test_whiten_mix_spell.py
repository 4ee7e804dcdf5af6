"""Whitening, source mixing and spelling variants against brute force, and on awkward rows."""

import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rackmill.llm import mixing, spelling, whitening

WORD = re.compile("[^\x20\x09-\x0d]+")
RUN = re.compile("[A-Za-zÀ-ÿ]+")
DOCS = "doc_id long, text string, source string, lang string, h string, n long, word string, bucket string, size double"
NULLS = (None,) * 5


# ---- 11 ----


def brute_whitening(vectors, components=8):
    kept = [(i, v) for i, v in vectors if v is not None and v and all(c is not None and np.isfinite(c) for c in v)]
    sizes = Counter(len(v) for _, v in kept)
    d = max(sizes, key=lambda k: (sizes[k], k))
    kept = [(i, v) for i, v in kept if len(v) == d]
    x = np.array([np.floor(1024 * np.array(v, float)) for _, v in kept]).astype(np.int64) + 100_000
    n, s = len(x), x.sum(0)
    c = x - s / n
    values, vec = np.linalg.eigh(c.T @ c / n)
    values, vec = values[::-1], vec[:, ::-1]
    k = min(components, int((values > values[0] * whitening.FLAT).sum()))
    dev = [sum((n * int(a) - int(b)) ** 2 for a, b in zip(row, s, strict=True)) for row in x]
    return [i for i, _ in kept], n, dev, c @ vec[:, :k] / np.sqrt(values[:k]), values[:k] / values.sum()


@pytest.mark.parametrize("seed", [1, 2])
def test_whitening_is_the_dense_computation(spark, seed):
    rng = np.random.default_rng(seed)
    mixed = rng.normal(size=(300, 12)) @ rng.normal(size=(12, 12)) + 5
    rows = [(k, v.tolist()) for k, v in enumerate(mixed)]
    rows += [(7, rows[7][1]), (None, rows[9][1]), (900, None), (901, []), (902, [*rows[0][1][:-1], None]), (903, [*rows[0][1][:-1], float("nan")]), (904, [*rows[0][1][:-1], float("inf")]), (905, [1.0, 2.0])]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, n int, component string").repartition(5)
    got = whitening.whiten(df).collect()
    ids, n, dev, white, explained = brute_whitening(rows)
    assert n == 302 and len(got) == 8 * n and {r.n for r in got} == {n}
    assert Counter((r.vec_id, r.deviation) for r in got if r.component == 1) == Counter(zip(ids, dev, strict=True))
    by = defaultdict(list)
    for r in got:
        by[r.vec_id, r.component].append(r.whitened)
    for k in range(8):
        sign = np.sign(by[ids[0], k + 1][0] * white[0, k])
        for j, i in enumerate(ids):
            assert any(abs(w - sign * white[j, k]) < 1e-9 for w in by[i, k + 1])
    assert all(abs(r.explained / explained[r.component - 1] - 1) < 1e-9 and r.identity_error < 1e-9 for r in got)


def test_whitening_of_large_offsets_keeps_its_precision(spark):
    rng = np.random.default_rng(3)
    rows = [(k, (1e9 + v).tolist()) for k, v in enumerate(rng.normal(size=(200, 4)) * [1, 2, 3, 4])]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    _, n, dev, _, explained = brute_whitening(rows)
    assert {(r.vec_id, r.deviation) for r in got} == set(enumerate(dev))
    assert all(r.identity_error < 1e-9 and abs(r.explained / explained[r.component - 1] - 1) < 1e-6 for r in got) and {r.component for r in got} == {1, 2, 3, 4}


def test_whitening_of_little(spark):
    schema = "vec_id long, embedding array<float>"
    assert whitening.whiten(spark.createDataFrame([], schema)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, None), (2, []), (3, [None])], schema)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0])] * 3, schema)).count() == 0  # no variance
    line = whitening.whiten(spark.createDataFrame([(k, [float(k), 2.0 * k]) for k in range(9)], schema)).collect()
    assert {r.component for r in line} == {1} and len(line) == 9 and abs(line[0].explained - 1) < 1e-9
    huge = whitening.whiten(spark.createDataFrame([(1, [3e38, 0.0]), (2, [-3e38, 1.0]), (3, [0.0, 5.0])], schema)).collect()
    assert {(r.vec_id, r.deviation) for r in huge} == {(1, None), (2, None), (3, 9216**2)} and len(huge) == 3


def test_whole_reads_slices_and_nulls():
    a = pa.array([[1.0, 2.0], None, [], [3.0, None], [4.0, 5.0, 6.0], [float("inf"), 1.0], [7.0, 8.0]], pa.list_(pa.float64()))
    for i in range(len(a)):
        rows, size, x = whitening.whole(a.slice(i))
        want = [(k, v) for k, v in enumerate(a.slice(i).to_pylist()) if v and all(c is not None and np.isfinite(c) for c in v)]
        assert rows.tolist() == [k for k, _ in want] and size.tolist() == [len(v) for _, v in want]
        assert x.tolist() == [int(1024 * c) + 100_000 for _, v in want for c in v]


# ---- 12 ----


def brute_targets(sizes, most=3):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (1, 2, 3)[k % 3] for k, s in enumerate(order)}
    capped, total = {}, sum(sizes.values())
    while True:
        free = [s for s in order if s not in capped]
        left, w = total - sum(capped.values()), sum(weight[s] for s in free)
        share = {s: Fraction(left * weight[s], w) for s in free}
        over = [s for s in free if share[s] > most * sizes[s]]
        if not over:
            return order, {**share, **{s: Fraction(v) for s, v in capped.items()}}
        capped |= {s: most * sizes[s] for s in over}


def brute_seats(order, targets, sizes, blocks, block, most=3):
    """Block by block to the highest quotient."""
    seats, room = dict.fromkeys(order, 0), {s: -(-sizes[s] * most // block) for s in order}
    for _ in range(blocks):
        open_ = [s for s in order if seats[s] < room[s] and targets[s]]
        if not open_:
            break
        seats[max(open_, key=lambda s: targets[s] / (2 * seats[s] + 1))] += 1  # the first of equals
    return seats


def _mixed(spark, rows, **more):
    df = spark.createDataFrame([(i, t, s, None, "x", 1, "w", "b", 0.5) for i, t, s in rows], DOCS).repartition(3)
    taken, quota = mixing.mix(df, **more)
    return taken.collect(), quota.collect()


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_mix_takes_the_apportioned_words(spark, seed):
    rng = random.Random(seed)
    names = [None, "", "a", "b", "é", "hot", "z", "\U0001f389", "￮"][: rng.randint(3, 9)]
    rows = [(k, " ".join("w" * rng.randint(1, 4) for _ in range(rng.choice((0, 1, 5, 40, 300)))), rng.choice([*names, "hot", "hot"])) for k in range(150)]
    rows += [(3, "one two three", "a")] * 4 + [(None, "x y", "a"), (None, "x y", "a"), (500, None, "a"), (501, "", "b"), (502, " \n", None), (503, "v " * 4000, "tiny")]
    got, quota = _mixed(spark, rows, shards=5)
    size = lambda t: len(WORD.findall(t or ""))
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += size(t)
    order, target = brute_targets(sizes)
    block = mixing.block_words(sum(sizes.values()))
    seats = brute_seats(order, target, sizes, -(-sum(sizes.values()) // block), block)
    assert Counter((r.doc_id, r.size, r.source) for r in got) == Counter((i, size(t), s) for i, t, s in rows)
    taken = Counter()
    for r in got:
        taken[r.source] += r.taken
        assert 0 <= r.taken <= 3 * r.size and r.source_size == sizes[r.source] and abs(r.target - float(target[r.source])) <= 1e-9 * r.target
    by = defaultdict(dict)
    for q in quota:
        by[q.source][q.shard] = q.quota
    for s in order:
        assert sum(by[s].values()) == seats[s] and len(by[s]) == 5 and max(by[s].values()) - min(by[s].values()) <= 1
        assert abs(taken[s] - float(target[s])) <= 2 * block
    assert Counter(r.asDict().values().__str__() for r in _mixed(spark, rows, shards=5)[0]) == Counter(r.asDict().values().__str__() for r in got)


def test_seats_go_by_the_highest_quotients(spark):
    rng = random.Random(4)
    for block, blocks in ((1, 40), (7, 333), (32, 5000)):
        sizes = {f"s{k}": rng.choice((0, 1, 10, 500, 500, 90_000)) for k in range(9)}
        target = {s: Fraction(rng.choice((0, 1, 77, 77, 12345))) for s in sizes}
        df = spark.createDataFrame([(s, v, float(target[s]), k) for k, (s, v) in enumerate(sizes.items())], "source string, source_size long, target double, rank long")
        got = {r.source: r.seats for r in mixing.apportion(df, blocks, block).collect()}
        assert got == brute_seats(list(sizes), target, sizes, blocks, block)


def test_a_block_is_taken_whole_or_not(spark):
    """The stream of one source: what is taken of every single word, word by word."""
    for size, quota, block in ((100, 7, 10), (103, 5, 10), (103, 17, 10), (103, 31, 10), (9, 1, 10), (9, 3, 10), (64, 0, 8), (1, 3, 1)):
        for start in (0, 3):
            df = spark.range(size + 1).select(F.col("id").alias("at"), F.lit(size).cast("long").alias("source_size"), F.lit(quota).cast("long").alias("quota"), F.lit(min(start, max(size // block - 1, 0))).cast("long").alias("start"))
            upto = [r.t for r in df.select("at", mixing._taken(F.col("at"), block, 3).alias("t")).orderBy("at").collect()]
            each = np.diff(upto)
            drawn = min(quota * block, 3 * size)
            whole, rest = divmod(drawn, size)
            assert upto[0] == 0 and set(each) <= {whole, whole + 1} and 0 <= drawn - upto[-1] < block
            full = size // block * block
            assert all(len(set(each[k : k + block])) == 1 for k in range(0, full, block))
            assert sum(each[k] > whole for k in range(0, full, block)) == min(size // block, rest // block)


def test_mix_of_little(spark):
    assert mixing.mix(spark.createDataFrame([], DOCS))[0].count() == 0
    got, _ = _mixed(spark, [(1, None, None), (2, "", "a")])
    assert [(r.size, r.target, r.taken) for r in got] == [(0, 0.0, 0)] * 2
    got, _ = _mixed(spark, [(1, "a b c", "only")])
    assert [(r.size, r.target, r.taken) for r in got] == [(3, 3.0, 3)]


def test_mix_runs_no_python(spark):
    df = spark.createDataFrame([(1, "a b", "s", *NULLS, None)], DOCS)
    assert not re.search("Python|Pandas|Arrow", mixing.mix(df)[0]._jdf.queryExecution().toString())


# ---- 13 ----


def low(s):
    return re.sub("[A-Z]", lambda m: m[0].lower(), s)


def brute_words(rows):
    c = Counter()
    for i, t in rows:
        for r in RUN.findall(t or ""):
            r = low(r)
            h = zlib.crc32(f"{'' if i is None else i}:{r}".encode())
            if h % 97 == 0:
                r = r[: h % len(r)] + r[h % len(r) + 1 :]
            if len(r) >= 5:
                c[r] += 1
    return {w: n for w, n in c.items() if n >= 3}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute_variants(c):
    near = {w: [x for x in c if abs(len(x) - len(w)) < 2 and one_edit(w, x)] for w in c}
    best = {w: min(xs, key=lambda x: (-c[x], x), default=None) for w, xs in near.items()}
    form = {w: x if x and c[x] >= 2 * c[w] else None for w, x in best.items()}
    out = set()
    for w in c:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, c[w], len(near[w]), c[form[w]] if form[w] else None))
    return out


def _variants(df):
    return {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


def _vocabulary(rng, letters, n):
    out = set()
    while len(out) < n:
        w = "".join(rng.choices(letters, k=rng.randint(5, 9)))
        out.add(w)
        for _ in range(rng.randint(0, 6)):  # chains of edits
            k = rng.randrange(len(w))
            w = rng.choice((w[:k] + w[k + 1 :], w[:k] + rng.choice(letters) + w[k:], w[:k] + rng.choice(letters) + w[k + 1 :]))
            if len(w) >= 5:
                out.add(w)
    return sorted(out)


@pytest.mark.parametrize(("letters", "group", "rows"), [("ab", 1 << 15, 1 << 17), ("abcé÷", 1 << 15, 500), ("ab", 7, 200), ("aÿ", 40, 1 << 17)])
def test_variants_are_all_found(spark, letters, group, rows):
    rng = random.Random(len(letters) + group)
    c = {w: 3 * 2 ** rng.randint(0, 8) + rng.randint(0, 1) for w in _vocabulary(rng, letters, 350)}
    known = spark.createDataFrame(list(c.items()), "word string, n long")
    want = brute_variants(c)
    near = {(r.word, r.n_near) for r in spelling.near_words(known, group, rows).collect()}
    assert near == {(w, k) for w, _, _, _, k, _ in want if k}
    if group == 1 << 15:
        assert _variants(spelling.variants(known)) == want


def test_words_and_variants_of_awkward_texts(spark):
    rng = random.Random(9)
    vocabulary = _vocabulary(rng, "abçé", 60)
    text = lambda n: rng.choice((" ", ", ", "7", "\n")).join(w.upper() if rng.random() < 0.2 else w for w in rng.choices(vocabulary, k=n))
    rows = [(k, text(rng.randint(0, 60))) for k in range(60)] + [(None, text(30)), (None, text(30)), (70, None), (71, ""), (72, "1234 \n"), (73, "x" * 40_000), (73, "x" * 40_000), (73, "x" * 40_000), (74, "x" * 39_999 + " ÀÉ×÷ÿ Ãabcd ") ] * 3
    df = spark.createDataFrame([(i, t, None, None, "x", 1, "w", "b", 0.5) for i, t in rows], DOCS).repartition(3)
    c = brute_words(rows)
    assert {r.word: r.n for r in spelling.words(df).collect()} == c and any(len(w) >= 39_999 for w in c)
    assert _variants(spelling.spelling_variants(df)) == brute_variants(c)
    assert spelling.spelling_variants(df.limit(0)).count() == 0
    assert spelling.spelling_variants(df.select("doc_id", F.lit(None).cast("string").alias("text"))).count() == 0


def test_the_tree_reports_every_point():
    rng = np.random.default_rng(5)
    for n in (1, 2, 3, 17, 64, 200):
        places = rng.permutation(n)
        tree = spelling.WaveletTree(places)
        a, low_ = rng.integers(0, n + 1, 50), rng.integers(0, n + 1, 50)
        b, high = rng.integers(0, n + 1, 50), rng.integers(0, n + 1, 50)
        q, v = tree.report(np.minimum(a, b), np.maximum(a, b), np.minimum(low_, high), np.maximum(low_, high))
        want = sorted((i, x) for i in range(50) for x in places[min(a[i], b[i]) : max(a[i], b[i])].tolist() if min(low_[i], high[i]) <= x < max(low_[i], high[i]))
        assert sorted(zip(q.tolist(), v.tolist(), strict=True)) == want
