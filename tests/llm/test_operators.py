"""The training-data operators against brute force, exact round trips or held-out labels, and on awkward rows."""

import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rackmill.llm import decontam, hd_lang, jaccard, quality_classifier, quality_rules, ring, sp_scan, sstable, token_counts, url_gbt, words

BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
WORD = re.compile("[^\x20\x09-\x0d]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, n string"


def low(s: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), s)


@pytest.fixture(scope="module")
def awkward(spark):
    """Nulls in every column, empty, blank and long texts, repeated rows and ids, clashing column names."""
    rng = random.Random(5)
    vocabulary = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 7))) for _ in range(300)]
    text = lambda n: " ".join(rng.choices(vocabulary, k=n))
    base = text(120).split(" ")
    near = [*base[:60], "changed", *base[61:]]
    rows = [
        (1, " ".join(base)), (2, " ".join(near)), (3, " ".join(base)), (3, " ".join(base)), (4, None), (5, ""), (6, " \n\t "), (7, "one two"), (8, "one  two"),
        (9, text(30_000)), (10, "x" * 50_000), (None, " ".join(near)), (None, text(40)), (11, "日本語のテキスト 漢字 🎉 é"), (12, "<|endoftext|> and <s> it's"), (13, "ONE two"), (14, text(25)), (15, " ".join([*base[:30], "A", *base[30:90], "b", "c", *base[90:]])),
    ]
    rows += [(100 + k, text(rng.randint(20, 80))) for k in range(20)]
    full = [(i, t, [None, "aa", "bb"][k % 3], None if k % 4 else "s", None, None, "x") for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(full, DOCS), rows


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def labels(spark, awkward):
    ids = sorted({i for i, _ in awkward[1] if i is not None})
    return spark.createDataFrame([(i, int(k % 2), None) for k, i in enumerate(ids)] + [(None, 1, 0), (ids[0], None, 0)], "doc_id long, quality int, toxic int")


def test_word_hashes_agree_with_a_regex():
    texts = ["Ab  ab cé", None, "", "ab\x0bAB\x0cx", "z" * 100, "é\u00a0x y"]
    for lower in (True, False):
        h, at = words.word_hashes(pa.array(texts), lower)
        seen = {}
        for i, t in enumerate(texts):
            own = [low(w) if lower else w for w in WORD.findall(t or "")]
            assert len(own) == at[i + 1] - at[i]
            for w, x in zip(own, h[at[i] : at[i + 1]], strict=True):
                assert seen.setdefault(w, x) == x
        assert len(set(seen.values())) == len(seen)


# ---- 1 ----


def test_shards_hold_every_row_in_order(spark, awkward, tmp_path):
    df, rows = awkward
    t = token_counts.codec(BPE)
    manifest = sstable.write_shards(df, BPE, f"file://{tmp_path}/sst", shard_bytes=2000)
    got = sorted(sstable.read_shards(manifest).collect(), key=lambda r: r.start)
    ids = {x or "": [*t.ids([x or ""])[0], 0] for _, x in rows}
    want = sorted(((i is not None, i or 0, len(ids[x or ""]), zlib.crc32(np.array(ids[x or ""], "<u4").tobytes())) for i, x in rows))
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.n_tokens, r.ids_crc32) for r in got) == want
    assert [r.start for r in got] == [0, *np.cumsum([r.n_tokens for r in got])[:-1].tolist()]
    keys = [(r.doc_id is not None, r.doc_id or 0) for r in got]
    assert keys == sorted(keys)
    assert [x.tolist() for x in sstable.lookup(manifest, 12)] == [ids["<|endoftext|> and <s> it's"]]
    assert len(sstable.lookup(manifest, 3)) == 2 and sstable.lookup(manifest, 99) == []


def test_shard_file_finds_every_key(tmp_path):
    path = tmp_path / "a.sst"
    w = sstable.ShardWriter(open(path, "wb"), 2)
    keys = [sstable.key_of(None), *(sstable.key_of(i) for i in range(-500, 60_000, 7))]
    for k, key in enumerate(keys):
        w.add(key, np.arange(k % 50, dtype="<u2").tobytes())
    w.close()
    r = sstable.ShardReader(f"file://{path}")
    assert r.blocks > 1 and [k for k, _ in r.scan()] == keys
    for k in range(0, len(keys), 97):
        assert r[keys[k]].tolist() == list(range(k % 50))
    missing = 0
    for i in range(-499, 3000, 7):
        with pytest.raises(KeyError):
            r[sstable.key_of(i)]
        missing += r.may_hold(sstable.key_of(i)[:8])
    assert missing < 20  # the filter alone turns most away


def test_empty_tables(nothing, labels, spark):
    assert sstable.token_shards(nothing, BPE)[1].count() == 0
    assert token_counts.token_counts(nothing, BPE).count() == 0
    assert sp_scan.round_trip(nothing, PIECES).count() == 0
    assert jaccard.near_duplicates(nothing).count() == 0
    assert jaccard.one_of_each(nothing).count() == 0
    assert quality_rules.quality_rules(quality_rules.trusted_documents(nothing, labels)).count() == 0
    assert ring.shard(nothing).count() == 0
    assert quality_classifier.quality(nothing, labels).count() == 0
    assert hd_lang.languages(nothing).count() == 0
    items = spark.createDataFrame([], "item_id long, text string")
    assert decontam.decontaminate(nothing, items).count() == 0
    pages = spark.createDataFrame([], "page_id long, url string")
    assert url_gbt.judge(pages, url_gbt.seed_labels(pages)).count() == 0


# ---- 2 ----


def test_keys_of_a_hot_id(spark, tmp_path):
    """One id over several tasks: every row has a key of its own, and all are found."""
    rows = [(7, f"text {k}") for k in range(400)] + [(k, "x") for k in (1, 2, 9, 10, 11)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        manifest = sstable.write_shards(df, BPE, f"file://{tmp_path}/hot")
        shards = [r.shard for r in manifest.collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    keys = [key for s in shards for key, _ in sstable.ShardReader(s).scan()]
    assert len(shards) > 1 and len(set(keys)) == len(keys) == 405
    assert len(sstable.lookup(manifest, 7)) == 400


def test_urls(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://WWW.Example.COM/en/1?x=/fr/#y", "http://a.example.com/en/2", "http://example.com", "http://xcom/", "http://b.net/fr/9", "http://b.net/de/9", "http://b.org?q://z/en/", "a://É.com/x", "http://b.net/fr"]
    want = [("", "", None), ("", "", None), ("", "", None), ("", "", None), ("www.example.com", "/en/1", "www.example.com/en/"), ("a.example.com", "/en/2", "example.com/en/"), ("example.com", "", None), ("xcom", "/", None), ("b.net", "/fr/9", "net/fr/"), ("b.net", "/de/9", None), ("b.org", "", None), ("É.com", "/x", "com/"), ("b.net", "/fr", None)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: r for r in url_gbt.judge(pages, url_gbt.seed_labels(pages)).collect()}
    assert [(got[k].host, got[k].path, got[k].rule) for k in range(len(urls))] == want
    assert [url_gbt.parse(u) for u in urls] == [w[:2] for w in want]
    rules = dict(url_gbt.RULES)
    assert all(g.verdict == rules[g.rule] for g in got.values() if g.rule)


def test_trees_learn_lexical_labels():
    rng = random.Random(1)
    good = [(f"http://{''.join(rng.choices('abc', k=6))}.example.org/en/{k}", 0) for k in range(400)]
    bad = [(f"http://free-{k}-pills.example.org/en/{rng.randint(1, 10**9)}?a=1&b=2", 1) for k in range(400)]
    data = good + bad
    rng.shuffle(data)
    m = url_gbt.UrlModel(data[:600])
    p = m([u for u, _ in data[600:]])
    assert np.mean((p > 0.5) == np.array([y for _, y in data[600:]])) > 0.98
    assert url_gbt.UrlModel([])(["x"])[0] < 0.5


def test_trees_judge_unseen_hosts():
    """Trained without a fold of hosts, the trees find its seed hosts and allow plain ones."""
    urls = [r[0] for r in duckdb.sql("select url from '/root/testdata/sf0.1/pages.parquet' where url is not null").fetchall()]
    label = {u: int(bool(set(re.split(r"[.\-]", url_gbt.parse(u)[0])) & set(url_gbt.SEED_WORDS))) for u in urls}
    hosts = sorted({url_gbt.parse(u)[0] for u in urls})
    fold = dict(zip(hosts, np.random.default_rng(0).permutation(len(hosts)) % 5, strict=True))
    found, wrong = [], []
    for k in range(5):
        m = url_gbt.UrlModel([(u, label[u]) for u in urls if fold[url_gbt.parse(u)[0]] != k])
        rest = [u for u in urls if fold[url_gbt.parse(u)[0]] == k]
        for u, p in zip(rest, m(rest), strict=True):
            (found if label[u] else wrong).append(p >= 0.5)
    assert np.mean(found) >= 0.9 and np.mean(wrong) <= 0.02


def test_awkward_urls(spark):
    urls = [None, None, "", "http://a.b/" + "x/" * 300_000, "http://a.b/1", "http://a.b/1"]
    pages = spark.createDataFrame([(k % 4, u, "h", "v") for k, u in enumerate(urls)], "page_id long, url string, host string, verdict string")
    got = url_gbt.judge(pages, url_gbt.seed_labels(pages)).collect()
    assert sorted(r.page_id for r in got) == [0, 0, 1, 1, 2, 3] and all(r.verdict in ("allow", "block") for r in got)


# ---- 3 ----


@pytest.mark.parametrize("path", [BPE, PIECES])
def test_counts_are_the_librarys(path):
    rng = random.Random(3)
    letters = [*"▁ab c  \n\t'stre.,é漢12 \xa0\u3000", "<|endoftext|>", " the", "'ll", "!!"]
    for chunk, overlap in ((40, 16), (70, 5), (10_000, 256)):
        c = token_counts.Counter(path, chunk, overlap, memo=50)
        texts = ["".join(rng.choices(letters, k=rng.randint(0, 300))) for _ in range(150)] + ["", "a" * 500, " " * 300]
        assert c(texts) == c.codec.counts(texts)


def test_counts_of_rows(spark, awkward):
    df, rows = awkward
    c = token_counts.codec(BPE)
    want = Counter((i, len((x or "").encode()), n, n > 512) for (i, x), n in zip(rows, c.counts([x or "" for _, x in rows]), strict=True))
    assert Counter(tuple(r) for r in token_counts.token_counts(df, BPE, chunk_chars=1000).collect()) == want


# ---- 4 ----


@pytest.mark.parametrize("chunk", [5, 17, 64])
def test_scan_gives_the_librarys_ids(chunk):
    rng = random.Random(chunk)
    letters = [*"ab c   \n'stre.,é漢12▁", "<s>", " the", " andthe", "!!", "  ", " international", "ization"]
    e = sp_scan.Encoder(PIECES, chunk)
    for text in ["".join(rng.choices(letters, k=rng.randint(0, 120))) for _ in range(200)] + ["", " ", "▁", "internationalization" * 5]:
        want = e.lattice.sp.encode(text)
        assert e(text).tolist() == want
        assert e.decode(e(text), 7) == e.lattice.sp.decode(want)


def test_scan_of_a_unigram_model_is_viterbi():
    e = sp_scan.Encoder(PIECES, 6)
    lattice = e.lattice
    lattice.bpe = False
    lattice.scores = {w: float(-len(w)) - k / 10 for k, w in enumerate(["a", "b", "ab", "ba", "aba", "bab", "abab"])}
    lattice.longest, lattice.lowest = 4, -50.0
    lattice.follows.cache_clear()
    rng = random.Random(9)
    for _ in range(50):
        text = "".join(rng.choices("ab", k=rng.randint(7, 40)))
        best = [0.0] + [sp_scan.NONE] * len(text)
        for j in range(1, len(text) + 1):
            best[j] = max(best[i] + lattice.scores.get(text[i:j], -50.0 if j - i == 1 else sp_scan.NONE) for i in range(max(0, j - 4), j))
        ends = sp_scan.boundaries(text, 6)
        chunks = [sp_scan.Chunk(lattice, text, a, b) for a, b in zip(ends[:-1], ends[1:], strict=True)]
        total = chunks[0].matrix()
        for c in chunks[1:]:
            total = sp_scan.product(total, c.matrix())
        assert total[0, 0][len(text), len(text)] == pytest.approx(best[-1])


def test_round_trip_of_rows(spark, awkward):
    df, rows = awkward
    got = sp_scan.round_trip(df, PIECES, chunk=512).collect()
    sp = token_counts.PieceCodec(PIECES).sp
    want = Counter((i, len(x := sp.encode(t or "")), zlib.crc32(np.array(x, "<u4").tobytes())) for i, t in rows)
    assert Counter((r.doc_id, r.n_pieces, r.ids_crc32) for r in got) == want and all(r.same for r in got)
    both = sp_scan.decoded(sp_scan.encoded(df, PIECES, chunk=512), PIECES)
    assert both.filter(F.coalesce("text", F.lit("")) != F.col("decoded")).isEmpty()


# ---- 5 ----


def classes(rows):
    sets = []
    for _, t in rows:
        w = WORD.findall(low(t or ""))
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for k in range(i):
            both = len(sets[i] & sets[k])
            if both and 100 * both >= 80 * len(sets[i] | sets[k]):
                parent[find(i)] = find(k)
    ids = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        ids[find(i)].append(d)
    return [(d, len(s), min((x for x in ids[find(i)] if x is not None), default=None) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))]


def test_near_duplicates(spark, awkward):
    df, rows = awkward
    assert Counter(tuple(r) for r in jaccard.near_duplicates(df).collect()) == Counter(classes(rows))


def test_one_of_each(spark, awkward):
    df, rows = awkward
    out = jaccard.one_of_each(df)
    assert out.columns == df.columns
    kept = Counter((r.doc_id, r.text) for r in out.collect())
    want = Counter()
    for (d, t), (_, n, c) in zip(rows, classes(rows), strict=True):
        if not n:
            want[d, t] += 1
        elif d == c:
            want[d, t] = 1
    assert kept == want


def test_hot_groups_of_near_copies(spark):
    rng = random.Random(11)
    base = [f"w{rng.randint(0, 10**6)}" for _ in range(150)]
    rows = []
    for k in range(300):
        w = list(base)
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(150)] = f"m{rng.randint(0, 10**6)}"
        rows.append((k, " ".join(w)))
    passage = " ".join(f"p{k}" for k in range(60))
    rows += [(1000 + k, " ".join(f"u{rng.randint(0, 10**6)}" for _ in range(200)) + " " + passage) for k in range(150)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert Counter(tuple(r) for r in jaccard.near_duplicates(df).collect()) == Counter(classes(rows))


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(45)] + [(k, k + 1) for k in range(100, 140)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    got = {r.node: r.root for r in jaccard.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got.get(x, x) == find(x) for x in parent)


# ---- 6 ----


def base_measures(t):
    w = WORD.findall(t)
    seen, lines = set(), 0
    for x in t.split("\n"):
        if WORD.search(x):
            lines += x in seen
            seen.add(x)
    windows = [tuple(w[k : k + 8]) for k in range(len(w) - 7)]
    n = Counter(windows)
    covered = {i for k, x in enumerate(windows) if n[x] > 1 for i in range(k, k + 8)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), lines, len(covered), len(w) < 20 or 100 * len(covered) > 30 * len(w)


def test_rules(spark, awkward, labels):
    df, rows = awkward
    extra = [(900, "a b c d e f g h i a b c d e f g h i\nx\nx\n \n#$%", None, None, None, None, None), (901, "r s t u v w x y " * 6, None, None, None, None, None)]
    df = df.unionByName(spark.createDataFrame(extra, DOCS))
    rows = rows + [(r[0], r[1]) for r in extra]
    got = quality_rules.quality_rules(quality_rules.trusted_documents(df, labels)).collect()
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == Counter((i, *base_measures(t or "")) for i, t in rows)
    assert all(r.kept <= (not r.base_failed) for r in got)


def test_ratio_is_the_multinomials(spark):
    """Scores, threshold and verdicts by sums in Python: no fold counts for itself."""
    rng = random.Random(4)
    texts = [" ".join(f"{'gb'[k % 3 == 0]}{rng.randint(0, 40)}" for _ in range(rng.randint(0, 60))) for k in range(160)]
    rows = [(k, t, k % 3 != 0 and k % 4 != 0) for k, t in enumerate([*texts, None, "", "w", texts[5]])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, trusted boolean")
    n = quality_rules.BUCKETS
    p = quality_rules.hashed(docs, "text", "")
    known = {r.doc_id: (r.f, r.h1 + r.h2) for r in p.select("doc_id", quality_rules.fold(F.col("text")).alias("f"), "h1", "h2").collect()}
    assert all(len(known[k][1]) == max(0, 2 * len((t or "").split()) - 1) for k, t, _ in rows)
    corpus, good = Counter(), Counter()
    for k, _, trusted in rows:
        for x in known[k][1]:
            corpus[known[k][0], x % n] += 1
            good[known[k][0], x % n] += trusted
    want = {}
    for k, _, _ in rows:
        f, own = known[k]
        rest, rest_good = sum(c for (i, _), c in corpus.items() if i != f), sum(c for (i, _), c in good.items() if i != f)
        each = [np.log((sum(good[i, x % n] for i in range(quality_rules.FOLDS) if i != f) + 1) / (rest_good + n)) - np.log((sum(corpus[i, x % n] for i in range(quality_rules.FOLDS) if i != f) + 1) / (rest + n)) for x in own]
        want[k] = round(float(np.mean(each)), 9) if own else 0
    got = {r.doc_id: r for r in quality_rules.quality_rules(docs).collect()}
    assert all(got[k].score == pytest.approx(want[k], abs=2e-9) for k, _, _ in rows)
    steps = sorted(np.floor(got[k].score * quality_rules.STEPS) for k, t, trusted in rows if trusted and len((t or "").split()) >= 20)
    least = steps[int(quality_rules.LOST * len(steps))] / quality_rules.STEPS
    assert all(got[k].kept == (not got[k].base_failed and got[k].score >= least) for k, _, _ in rows)
    none = quality_rules.quality_rules(docs.withColumn("trusted", F.lit(None).cast("boolean"))).collect()
    assert {r.score for r in none} == {0.0} and all(r.kept == (not r.base_failed) for r in none)


def test_rules_keep_what_they_have_not_seen(spark):
    """Half of the good labels trusted: the other half passes, bad ones don't."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    half = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0
    out = quality_rules.quality_rules(quality_rules.trusted_documents(docs, labels.filter(half)))
    r = out.filter("not base_failed").join(labels.filter(~half), "doc_id").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()
    kept = {x.quality: x.kept for x in r}
    assert kept[1] >= 0.95 and kept[0] <= 0.25


def test_names_may_clash(spark):
    docs = spark.createDataFrame([(k, f"w{k} " * 3 + " ".join(f"x{j}" for j in range(30)), 1, 2, 3, 4, 5) for k in range(4)], "doc_id long, text string, _rules_kept int, _found int, _quality int, _lang int, trusted int")
    labels = spark.createDataFrame([(0, 1, 0), (1, 1, 0)], "doc_id long, quality int, toxic int")
    assert quality_rules.passing(docs, labels).columns == docs.columns
    items = spark.createDataFrame([], "item_id long, text string")
    assert decontam.clean(docs, items).count() == 4 and decontam.decontaminate(docs, items).filter("contaminated").isEmpty()
    assert quality_classifier.passing(docs, labels).columns == docs.columns
    assert hd_lang.languages(docs.withColumn("lang", F.lit("a"))).count() == 4
    assert jaccard.one_of_each(docs).columns == docs.columns


def test_rules_plan_is_native(spark, awkward, labels):
    df, _ = awkward
    plan = quality_rules.quality_rules(quality_rules.trusted_documents(df, labels))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# ---- 7 ----


@pytest.mark.parametrize("shards", [1, 7, 40])
def test_shards_are_even(spark, awkward, shards):
    df, rows = awkward
    df = df.unionByName(df.filter("doc_id = 3")).unionByName(df)
    got = ring.shard(df, shards).collect()
    want = Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in rows)
    n = Counter()
    for k, v in want.items():
        n[k] += 2 * v
    for i, t in rows:
        if i == 3:
            n[i, len(t.encode()) + 16, zlib.crc32(t.encode())] += 1
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == n
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    counts = [len(slots.get(s, [])) for s in range(shards)]
    assert max(counts) - min(counts) <= 1 and all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_growth_moves_little():
    rng = np.random.default_rng(0)
    counts = dict(Counter(rng.integers(0, ring.CELLS, 200_000).tolist()))
    home = []
    for n in (40, 41):
        p = np.full(sum(counts.values()), -1)
        base = dict(zip(sorted(counts), np.cumsum([0] + [counts[c] for c in sorted(counts)])[:-1], strict=True))
        for cell, a, b, s, _ in ring.plan(counts, n):
            p[base[cell] + a : base[cell] + b] = s
        assert (p >= 0).all()
        home.append(p)
    assert (home[0] != home[1]).mean() < 0.15


# ---- 8 ----


def test_quality_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = quality_classifier.quality(docs, labels).join(labels, "doc_id").collect()
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    held = [r for r in got if r.held_out]
    assert sum(r.predicted == r.quality for r in held) / len(held) > 0.95


def test_quality_of_awkward_rows(spark, awkward, labels):
    df, rows = awkward
    got = quality_classifier.quality(df, labels).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in rows) and all(0 <= r.score <= 1 for r in got)
    none = quality_classifier.quality(df, labels.filter("quality > 5")).collect()
    assert {r.score for r in none} == {0.5}


# ---- 9 ----


def test_languages_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = hd_lang.languages(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in got)
    assert sum(r.lang_pred == r.lang for r in held) / len(held) > 0.97


def test_languages_of_awkward_rows(spark, awkward):
    df, rows = awkward
    got = hd_lang.languages(df).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in rows)
    letters = Counter((i, any(c.isalpha() for c in t or "")) for i, t in rows)
    assert Counter((r.doc_id, r.lang_pred != "und") for r in got) == letters
    assert {r.lang_pred for r in got} <= {"aa", "bb", "und"}
    assert {r.lang_pred for r in hd_lang.languages(df.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_bundle_is_linear():
    codes, n = np.array([5, 700, 90_000]), np.array([2, 1, 3])
    v = hd_lang.vectors(codes).astype(int)
    assert (hd_lang.bundle(codes, n, step=2) == (n[:, None] * v).sum(0)).all() and set(np.unique(v)) == {-1, 1}


# ---- 10 ----


def test_overlaps_with_substitutions(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=6))
    items = [[word() for _ in range(n)] for n in (40, 30, 18, 9, 6, 3)]
    table = [(k, " ".join(w)) for k, w in enumerate(items)] + [(98, None), (99, "")]
    docs, want = [], {}
    for k, w in enumerate(items):
        for kind in range(4):
            own = list(w)
            if kind == 1:
                own = [x.upper() + "," for x in own]
            if kind == 2 and len(own) >= 18:
                own[len(own) // 3] = word()
                own[2 * len(own) // 3] = word()
            if kind == 3:
                own = [word() for _ in own]
            docs.append((len(docs), " ".join([word() for _ in range(50)] + own + [word() for _ in range(50)])))
            want[len(docs) - 1] = [k] if kind != 3 and len(w) >= 4 else []
    docs += [(500, None), (501, ""), (None, " ".join(items[0]))]
    want |= {500: [], 501: [], None: [0]}
    d = spark.createDataFrame(docs, "doc_id long, text string")
    i = spark.createDataFrame(table, "item_id long, text string")
    got = {r.doc_id: (r.contaminated, r.item_ids) for r in decontam.decontaminate(d, i).collect()}
    assert got == {k: (bool(v), v) for k, v in want.items()}
    blocks = decontam.matched(d, i, most=60).select("doc_id", "_found.items").collect()
    assert {r.doc_id: r["items"] for r in blocks} == want
    assert decontam.clean(d, i).columns == d.columns and decontam.clean(d, i).count() == sum(not v for v in want.values())


def test_many_blocks_of_items_are_one(spark):
    """64 blocks give what one gives, repeated rows and ids and clashing names included, and the plan doesn't grow with them."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdefghij", k=5))
    items = [(k % 60, " ".join(word() for _ in range(20))) for k in range(64)]
    text = lambda *held: " ".join([*(word() for _ in range(20)), *held, *(word() for _ in range(20))])
    rows = [(k, text(items[k % 64][1])) for k in range(80)] + [(1, text(items[3][1], items[62][1], items[63][1]))] * 3 + [(1, None), (None, None), (7, ""), (7, text())] * 2
    d = spark.createDataFrame([(i, t, "x", 1, "k") for i, t in rows], "doc_id long, text string, items string, longest int, key string")
    i = spark.createDataFrame(items, "item_id long, text string")
    one, many = decontam.matched(d, i), decontam.matched(d, i, most=50)
    assert sum(1 for _ in decontam.blocks(i, most=50)) == 64
    rows_of = lambda df: Counter(str(r) for r in df.collect())
    assert one.columns == many.columns and rows_of(one) == rows_of(many) and rows_of(one).total() == len(rows)
    assert len(many._jdf.queryExecution().analyzed().toString()) < 2 * len(decontam.matched(d, i, most=700)._jdf.queryExecution().analyzed().toString())


def test_a_part_too_large_for_one_number_is_split():
    index = decontam.Index([(k, f"a b c d e f g h i j k l m n o p{k}") for k in range(3)])
    texts = pa.array(["a b c d e f g h i j k l m n o p1", "x", None] * 3)
    whole = index.overlaps(texts)
    index.ids = _Wide(index.ids)
    assert index.overlaps(texts) == whole and whole[0] == {0: 15, 1: 16, 2: 15}


class _Wide(list):
    """A list that says it is very long, as one of many items would be."""

    def __len__(self):
        return 2**55


@pytest.mark.parametrize(("n", "k"), [(13, 2), (16, 3), (20, 4)])
def test_masks_miss_no_pattern_of_substitutions(n, k):
    for lost in itertools.combinations(range(n), k):
        assert any(all(c == "0" or o + i not in lost for i, c in enumerate(m)) for m in decontam.MASKS for o in range(n - decontam.SPAN + 1))


def test_best_stretch():
    f = lambda s: decontam.best_stretch(np.array([c == "1" for c in s]))
    assert f("") == 0 and f("000") == 0 and f("0001110") == 3 and f("111111111101111111111") == 21 and f("1110001") == 3


def test_best_stretch_is_the_longest():
    def longest(s):
        return max((b - a for a in range(len(s)) for b in range(a + 1, len(s) + 1) if s[a] and s[b - 1] and 5 * (b - a - sum(s[a:b])) <= b - a), default=0)

    rng = random.Random(10)
    for n in (1, 5, 13, 20, 60):
        for p in (0.3, 0.7, 0.85):
            for _ in range(60):
                s = [rng.random() < p for _ in range(n)]
                assert decontam.best_stretch(np.array(s)) == longest(s)


@pytest.mark.parametrize(("n", "k"), [(13, 2), (15, 3), (16, 3), (20, 4)])
def test_verdict_on_all_patterns_of_substitutions(n, k):
    """Any k of n tokens inside, with other tokens around the passage in the item and in the document."""
    item = [f"w{i}" for i in range(n + 20)]
    index = decontam.Index([(1, " ".join(item))])
    texts = [" ".join("x" if i < 10 or i >= n + 10 or i - 10 in lost else t for i, t in enumerate(item)) for lost in itertools.combinations(range(1, n - 1), k)]
    assert index.overlaps(pa.array(texts)) == [{0: n}] * len(texts)


@pytest.mark.parametrize("n", range(4, 17))
def test_short_items_with_substitutions(n):
    """Every choice of substituted tokens of an item, its ends included, against the rule itself."""
    item = [f"w{i}" for i in range(n)]
    index = decontam.Index([(1, " ".join(item))])
    lost = [x for k in range(min(n, 4) + 1) for x in itertools.combinations(range(n), k)]
    texts = [" ".join(["x"] * 9 + ["x" if i in x else t for i, t in enumerate(item)] + ["x"] * 9) for x in lost]

    def want(x):
        kept = [i for i in range(n) if i not in x]
        m = max((b - a + 1 for a in kept for b in kept if a <= b and 5 * sum(a < i < b for i in x) <= b - a + 1), default=0)
        return {0: m} if m >= 4 and (m >= 13 or 5 * m >= 4 * n) else {}

    assert index.overlaps(pa.array(texts)) == [want(x) for x in lost]
    assert n < 5 or all(index.overlaps(pa.array([" ".join("x" if i == k else t for i, t in enumerate(item))]))[0] for k in range(n))


# ---- pipeline ----


def test_pipeline_stages(spark):
    import corpus_pipeline as p

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before = docs.count()
    for name, stage in p.STAGES:
        out = stage(spark, docs, sf)
        if name != p.STAGES[-1][0]:
            assert out.columns == docs.columns
            docs = out
    assert 0 < docs.count() < before and out.count() == docs.count()
    clean = spark.read.parquet(f"{sf}/documents.parquet").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("quality = 1")
    rules = p.rules(spark, spark.read.parquet(f"{sf}/documents.parquet"), sf).select("doc_id")
    good = clean.filter("size(split(text, ' ')) > 30").select("doc_id")
    assert good.join(rules, "doc_id", "left_anti").count() <= 0.03 * good.count()


def test_each_stage_keeps_what_its_operator_says(spark):
    """Base rules, near duplicates and ids by brute force, the other verdicts by the operators that tests above hold against it."""
    import corpus_pipeline as p

    sf = "/root/testdata/sf0.001"
    docs, labels, items = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels", "benchmark"))
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    stage = {name: {r.doc_id: r for r in f(spark, docs, sf).collect()} for name, f in p.STAGES}
    said = quality_rules.quality_rules(quality_rules.trusted_documents(docs, labels)).collect()
    assert stage["quality_rules"].keys() == {r.doc_id for r in said if r.kept} and all(r.base_failed == base_measures(dict(rows)[r.doc_id] or "")[-1] for r in said)
    assert stage["quality_classifier"].keys() == {r.doc_id for r in quality_classifier.quality(docs, labels).collect() if r.predicted}
    assert stage["ngram_jaccard_join"].keys() == {d for d, n, c in classes(rows) if not n or d == c}
    assert stage["benchmark_decontamination"].keys() == {r.doc_id for r in decontam.decontaminate(docs, items).collect() if not r.contaminated}
    sp = token_counts.PieceCodec(PIECES).sp
    assert {d: r.n_pieces for d, r in stage["sentencepiece"].items()} == {d: len(sp.encode(t or "")) for d, t in rows}


def test_pipeline_takes_awkward_rows(spark, awkward):
    import corpus_pipeline as p

    df, _ = awkward
    for name, stage in p.STAGES:
        out = stage(spark, df, "/root/testdata/sf0.001")
        out.write.format("noop").mode("overwrite").save()
        if name != p.STAGES[-1][0]:
            assert out.columns == df.columns


def test_repeated_tokens_stay_bounded():
    """Runs of one token and short periods on both sides: memory is bounded and the stretch is found at every diagonal."""
    long = "a " * 60_000
    index = decontam.Index([(1, "a " * 700), (2, "b c " * 300), (3, "x " + "a " * 30 + "y z")])
    got = index.overlaps(pa.array([long, "q " + "b c " * 5_000, "x " + "a " * 30 + "y z", "a a a", "w " * 50]))
    assert got[0] == {0: 700, 2: 30} and got[1] == {1: 600} and got[2] == {0: 30, 2: 33} and got[3] == got[4] == {}  # by number
    most = max(len(p) for p, _ in index.hits(decontam.tokens(pa.array([long]))[0], np.array([0, 60_000])))
    assert most <= 2 * decontam.PAIRS


def test_copies_just_below_the_limit(spark):
    """Many near copies of which most don't link: the groups' matrix joins far fewer rows than there are pairs."""
    rng = random.Random(8)
    base = [f"w{rng.randint(0, 10**6)}" for _ in range(300)]
    rows = []
    for k in range(400):
        w = list(base)
        for i in rng.sample(range(0, 296, 6), 7):
            w[i] = f"m{rng.randint(0, 10**9)}"
        rows.append((k, " ".join(w)))
    made = {}
    plain = jaccard.materialize

    def kept(df, name, paths=None):
        made[name] = plain(df, name)
        return made[name]

    jaccard.materialize = kept
    try:
        got = {r.doc_id: r.component_id for r in jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    finally:
        jaccard.materialize = plain
    sets = [{tuple(t.split()[k : k + 5]) for k in range(296)} for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for k in range(i):
            if find(i) != find(k) and 100 * len(sets[i] & sets[k]) >= 80 * len(sets[i] | sets[k]):
                parent[max(find(i), find(k))] = min(find(i), find(k))
    assert got == {k: find(k) for k in range(len(rows))}
    m = made["matrix"].groupBy("token").count().agg(F.sum(F.col("count") * F.col("count"))).first()[0] or 0
    assert m <= 400 * 400 / 8
