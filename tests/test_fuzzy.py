"""Joins on string ratios and the vendor vote against loops over all pairs."""

import difflib
import random
import re

import pytest
from pyspark.sql import functions as F

from rackmill.functions import similarity as sim
from rackmill.operators import fuzzy, match


def names(rng, n, letters="abcde 12", low=1, high=14):
    out = {"".join(rng.choices(letters, k=rng.randint(low, high))).strip() for _ in range(n)}
    for w in list(out)[: n // 2]:
        for _ in range(rng.randint(1, 3)):
            k = rng.randrange(len(w) + 1)
            w = w[:k] + rng.choice((rng.choice(letters), "")) + w[k + rng.randint(0, 1) :]
        out.add(w.strip())
    return sorted(x for x in out if x)


@pytest.mark.parametrize(("least", "letters", "low"), [(0.85, "abcde12", 1), (0.6, "abcdefgh 12", 2), (0.6, "ab", 1), (0.85, "ab", 1), (1.0, "abc", 1), (0.95, "xyé-", 3)])
def test_no_pair_is_lost(spark, least, letters, low):
    rng = random.Random(int(least * 100) + len(letters))
    a, b = names(rng, 120, letters, low), names(rng, 120, letters, low)
    x, y = (spark.createDataFrame([(t,) for t in [*s, ""]], "text string") for s in (a, b))
    indel = {(p, q) for p in a for q in b if sim._indel(p, q) >= 100 * least}
    sequence = {(p, q) for p in a for q in b if sim._ratio(p, q) >= least}
    proposed = [tuple(r) for r in fuzzy.proposals(x, y, least).collect()]
    assert len(proposed) == len(set(proposed)) and indel | sequence <= set(proposed)
    if len(letters) > 4:
        assert len(proposed) < len(a) * len(b) / 2
    assert {(r.a, r.b) for r in fuzzy.ratio_join(x, y, lambda p, q: sim.indel_ratio(p, q) / 100, least).collect()} == indel
    assert {(r.a, r.b) for r in fuzzy.ratio_join(x, y, sim.sequence_ratio, least).collect()} == sequence


def test_close_match_is_difflibs(spark):
    rng = random.Random(3)
    known, asked = names(rng, 150, "abcdef 1_-"), names(rng, 150, "abcdef 1_-")
    norm = lambda s: re.sub(r"\s+", " ", s.replace("_", " ").replace("-", " ")).strip().lower()
    by = {}
    for n in sorted(known):
        by.setdefault(norm(n), n)
    by.pop("", None)
    facts = spark.createDataFrame([(k, n) for k, n in enumerate(asked)] + [(900, None), (901, "zzzzzzzz"), (902, asked[0])], "k int, port string")
    got = {r.k: r.matched for r in match.close_match(facts, spark.createDataFrame([(n,) for n in known if norm(n)], "name string"), "port", "name").collect()}
    for k, n in [*enumerate(asked), (901, "zzzzzzzz"), (902, asked[0])]:
        q = norm(n)
        want = [q] if q in by else difflib.get_close_matches(q, by, n=1, cutoff=0.6)
        assert got[k] == (by[want[0]] if want else None), n
    assert got[900] is None and len(got) == len(asked) + 3


def test_descriptions_take_the_best_ratio(spark):
    rng = random.Random(5)
    models, asked = names(rng, 120, "abcd12-", 4, 12), names(rng, 120, "abcd12-", 4, 12)
    dim = [(f"{m} / {models[(k * 7) % len(models)]}", f"d{k}") for k, m in enumerate(models)]
    flat = [(m.strip(), re.sub("[^a-z0-9]", "", m.lower()), d) for ms, d in dim for m in ms.split("/")]
    best = {}
    for m in asked:
        q = re.sub("[^a-z0-9]", "", m.lower())
        hits = [(-round(sim._indel(q, n), 9), m2, d) for m2, n, d in flat if n and q and sim._indel(q, n) >= 85]
        best[m] = min(hits)[0] if hits else None
    got = match.describe_models(spark.createDataFrame([(m,) for m in asked], "model string"), spark.createDataFrame(dim, "model string, description string")).collect()
    assert {r.model: None if r.ratio is None else round(r.ratio, 3) for r in got} == {m: None if v is None else round(-v, 3) for m, v in best.items()}
    for r in got:
        assert r.matched is None or (r.matched, r.description) in {(m, d) for m, _, d in flat}


def loop_vote(parts, aliases, least=0.2):
    """Every part against every alias, in order."""
    ocr = lambda s: re.sub(r"\s+", " ", re.sub(r"[^a-z0-9\s-]", " ", s.lower().replace("\\n", " ").translate(str.maketrans("01", "ol")))).strip()
    sums, votes = {}, {}
    order = sorted({(o, v) for o, v, _ in aliases})
    for p in parts:
        best, who = 0.0, None
        for sub in [p, *([p.split("(", 1)[0].strip()] if "(" in p and p.split("(", 1)[0].strip() else [])]:
            t = ocr(sub)
            for o, v in order:
                for a in (ocr(x) for k, w, x in aliases if (k, w) == (o, v)):
                    if not a or not t:
                        continue
                    s = (1.0 if a in t else 0.0) + 0.6 * (len(set(t.split()) & set(a.split())) / max(len(set(a.split())), 1)) + 0.5 * difflib.SequenceMatcher(None, t, a).ratio()
                    if s > best:
                        best, who = s, (o, v)
        if who and best >= least:
            sums[who], votes[who] = sums.get(who, 0.0) + best, votes.get(who, 0) + 1
    if not sums:
        return None
    w = max(sums, key=lambda k: (round(sums[k], 3), votes[k], -k[0]))
    return w[1], round(sums[w], 3), votes[w]


def test_vendor_vote_is_the_loop(spark):
    rng = random.Random(6)
    aliases = [(k, f"v{k}", a) for k, own in enumerate((["Cisco", "cisc0 systems"], ["D-Link", "dlink"], ["Hewlett Packard", "hp", "HPE"], ["juniper"], ["great lakes", " "], ["zte"])) for a in own]
    words = ["cisco", "c1sco", "Clsco systems", "D-Link", "d link", "link", "hp", "hewlett", "packard bell", "Juniper (EX2300)", "jun1per", "great", "lakes", "(rack)", "GREAT LAKES (case and cabinet)", "zte 24 port", "24", "port", "", "  ", "é"]
    rows = [(k % 40, " ".join(rng.choices(words, k=rng.randint(1, 3)))) for k in range(300)] + [(50, None), (51, "qqqq")]
    got = {r.image: r for r in match.vendor_vote(spark.createDataFrame(rows, "image int, part string").repartition(3), spark.createDataFrame(aliases, "ord int, vendor string, alias string"), examples=True).collect()}
    for image in range(60):
        want = loop_vote([p for i, p in rows if i == image and p], aliases)
        r = got.get(image)
        assert (r and (r.vendor, r.votes)) == (want and (want[0], want[2])), image
        assert r is None or abs(r.total - want[1]) < 2e-3 and len(r.examples) == r.votes
    with pytest.raises(ValueError, match="aliases"):
        match.VOCABULARY, kept = 3, match.VOCABULARY
        try:
            match.vendor_vote(spark.createDataFrame(rows, "image int, part string"), spark.createDataFrame(aliases, "ord int, vendor string, alias string"))
        finally:
            match.VOCABULARY = kept


def test_proposals_prune(spark, sf):
    """Far fewer pairs are compared in full than there are."""
    p = spark.read.parquet(f"{sf}/part.parquet")
    a = p.select(F.concat("p_name", F.lit(" "), "p_type", F.lit(" "), F.col("p_size").cast("string")).alias("text"))
    b = p.select(F.concat("p_brand", F.lit(" "), "p_name", F.col("p_size").cast("string")).alias("text"))
    n = a.distinct().count() * b.distinct().count()
    assert fuzzy.proposals(a, b, 0.85).count() < n / 100


def below_distinct(d):
    """The optimized plan's filters that make grams."""
    lines = d._jdf.queryExecution().optimizedPlan().toString().splitlines()
    return [x for x in lines if "Filter" in x and "sequence(" in x]


def test_grams_of_distinct_texts_only(spark, sf):
    p = spark.read.parquet(f"{sf}/part.parquet")
    dim = p.select(F.col("p_name").alias("model"), F.col("p_type").alias("description"))
    assert not below_distinct(match.describe_models(p.select("p_partkey", F.concat("p_name", F.lit("s")).alias("model")), dim))


def test_grams_of_distinct_names_only(spark, sf):
    p = spark.read.parquet(f"{sf}/part.parquet")
    out = match.close_match(p.select("p_partkey", F.concat(F.substring("p_name", 2, 100), F.lit("_"), "p_type").alias("port")), p.select(F.concat("p_name", F.lit(" "), "p_type").alias("name")), "port", "name")
    assert not below_distinct(out)


def made_at_scans(d, form):
    """What stands between a scan and the next aggregate, join or explode above it in the optimized plan and makes the form."""
    lines, out = d._jdf.queryExecution().optimizedPlan().toString().splitlines(), []
    for k, x in enumerate(lines):
        above = reversed(lines[:k]) if "Relation" in x else ()
        for y in above:
            if any(w in y for w in ("Aggregate", "Join", "Generate")):
                break
            out += [y] if form in y else []
    return out


def test_forms_of_distinct_names_only(spark, sf):
    p = spark.read.parquet(f"{sf}/part.parquet")
    out = match.close_match(p.select("p_partkey", F.col("p_type").alias("port")), p.select(F.col("p_name").alias("name")), "port", "name")
    assert not made_at_scans(out, "regexp_replace")
    dim = p.select(F.col("p_name").alias("model"), F.col("p_type").alias("description"))
    assert not made_at_scans(match.describe_models(p.select("p_partkey", F.col("p_type").alias("model")), dim).select("p_partkey"), "regexp_replace")
