"""Exact n-gram Jaccard join by a token-group matrix.

A document's set holds the 64-bit hashes of its distinct 5-word shingles; documents with equal sets
are one node. Two nodes link when 100 * |A & B| >= 80 * |A | B|.

1. Every document emits its prefix: the first n - ceil(0.8 n) + 1 tokens in a global order in which
   very frequent tokens come late. Any order gives the same links (linked sets share a prefix
   token); the frequencies only decide how many candidates are looked at. Tokens of one node end here.
2. Leaders. In rounds every node is compared with the node that it most often meets as the leader
   of a token, and joined to it if they link: first the node with the most common tokens, later nodes in a random order of the
   round. Rounds end when few comparisons give links, or after ROUNDS; they only save work, step 4 finds what they miss.
   Nodes with the same first leader, linked or not, are cut into groups of at most GROUP nodes and about
   GROUP_TOKENS tokens, ordered by component and size.
3. Matrix. It has a row for each group and each distinct prefix token of its members, without tokens of one component only;
   for each group of a pair the union of its members' tokens is stored, with a bit for each member.
4. The matrix is joined with itself: two groups are a pair if they hold as many prefix tokens in common as the
   least that a link between any two members needs, and are not both of one component. In a pair, the overlap of a node with
   the other group's union bounds its overlap with each member; only if some node reaches 0.8 of its tokens are the groups opened,
   and members are compared exactly, by one product of the two groups' bits.
5. Components over all links, by large-star / small-star rounds.

No step emits all pairs within a group, collects an unbounded group or drops a candidate. Node,
token and text identities are 64-bit hashes; two different ones are equal with probability 2**-64 a pair.

Defined results: null, empty and word-less texts have n_shingles 0 and are linked with nothing
(component_id is their own doc_id, or null). Repeated rows are copies and each gets a row. A null doc_id takes part;
it is never the smallest. Only the id and text columns are read; other columns may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import drop, materialize, small
from .words import U, mix, parts, tidy, word_hashes

WORDS = 5
#: Similarity as a fraction.
NUM, DEN = 80, 100
GROUP = 64
GROUP_TOKENS = 1 << 16
#: At most so many rounds of leaders; they end early when less than one comparison in DRY gives a link.
ROUNDS, DRY = 6, 8
#: A token is frequent from so many nodes on; the order knows the most frequent KNOWN of them.
FREQUENT, KNOWN = 32, 1_000_000
#: Tokens that a task counts at once.
WINDOW = 1 << 20
#: Groups may be broadcast up to this size; they pass through the driver.
BROADCAST_BYTES = 4 << 20
_MULT = [U(pow(0xD1342543DE82EF95, k + 1, 2**64)) for k in range(64)]


def shingle_sets(texts: pa.Array, words: int = WORDS) -> list[np.ndarray]:
    """For each row the sorted distinct hashes of its shingles."""
    h, at = word_hashes(texts)
    out = []
    if len(h) >= words:
        joined = h[: len(h) - words + 1] * _MULT[0]
        for k in range(1, words):
            joined = joined + h[k : len(h) - words + 1 + k] * _MULT[k]
        joined = mix(joined)
    for i in range(len(texts)):
        a, b = at[i], at[i + 1]
        if b - a >= words:
            out.append(np.unique(joined[a : b - words + 1]))
        elif b > a:
            x = np.sum(h[a:b] * np.array(_MULT[1 : b - a + 1], U), dtype=U, keepdims=True)
            out.append(mix(x + np.array([b - a], U)))
        else:
            out.append(np.zeros(0, U))
    return out


def node_of(tokens: np.ndarray) -> int | None:
    """A set's identity: a 64-bit hash that depends on the set alone."""
    if not len(tokens):
        return None
    with np.errstate(over="ignore"):
        a, b = mix(tokens * U(0x9FB21C651E98DF25)).sum(dtype=U), mix(tokens + U(0xC2B2AE3D27D4EB4F)).sum(dtype=U)
        return int(mix(np.array([a * U(3) + mix(np.array([b + U(len(tokens))], U))[0]], U)).view(np.int64)[0])


def prefix_length(n: int) -> int:
    return n - (n * NUM + DEN - 1) // DEN + 1


def _described(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    kind = pa.struct([("n", pa.int64()), ("node", pa.int64())])
    for batch in batches:
        n, node = [], []
        for part in parts(batch):
            for s in shingle_sets(part):
                n.append(len(s))
                node.append(node_of(s))
        yield pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(node, pa.int64())], fields=list(kind))


def described(docs: DataFrame, text_col: str) -> DataFrame:
    """docs with _set: struct of n (shingles) and node (null if none)."""
    return docs.withColumn("_set", F.arrow_udf(tidy(_described), "n long, node long")(F.col(text_col)))


def _prefixes(frequent: tuple[np.ndarray, np.ndarray]):
    """Emits node, n and the prefix in the order (level of frequency, hash)."""
    known, level = frequent

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # copies within a task are emitted once
        for batch in batches:
            for part in parts(batch.column(0)):
                nodes, sizes, tokens, ends = [], [], [], [0]
                for s in shingle_sets(part):
                    if not len(s) or (node := node_of(s)) in seen:
                        continue
                    seen.add(node)
                    if len(known):
                        k = np.minimum(np.searchsorted(known, s), len(known) - 1)
                        own = np.where(known[k] == s, level[k], 0)
                        s2 = s[np.argsort(own, kind="stable")] if own.any() else s
                    else:
                        s2 = s
                    nodes.append(node)
                    sizes.append(len(s))
                    tokens.append(s2[: prefix_length(len(s))])
                    ends.append(ends[-1] + len(tokens[-1]))
                flat = np.concatenate(tokens).view(np.int64) if tokens else np.zeros(0, np.int64)
                reps = np.diff(ends)
                yield pa.RecordBatch.from_arrays([pa.array(flat), pa.array(np.repeat(np.array(nodes, np.int64), reps)), pa.array(np.repeat(np.array(sizes, np.int32), reps))], names=["token", "node", "n"])

    return emit


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """token and the number of the task's distinct sets that hold it, where there are two or more. Beyond WINDOW tokens at once the rarest are forgotten."""
    seen: set[int] = set()
    tokens, counts = np.zeros(0, U), np.zeros(0, np.int64)

    def fold(fresh: list[np.ndarray]) -> None:
        nonlocal tokens, counts
        u, c = np.unique(np.concatenate(fresh), return_counts=True)
        u, at = np.unique(np.concatenate([tokens, u]), return_inverse=True)
        tokens, counts = u, np.bincount(at, np.concatenate([counts, c])).astype(np.int64)
        least = 1
        while len(tokens) > WINDOW:
            least += 1
            tokens, counts = tokens[counts >= least], counts[counts >= least]

    fresh, n = [], 0
    for batch in batches:
        for part in parts(batch.column(0)):
            for s in shingle_sets(part):
                if len(s) and (node := node_of(s)) not in seen:
                    seen.add(node)
                    fresh.append(s)
                    n += len(s)
            if n > WINDOW:
                fold(fresh)
                fresh, n = [], 0
    if fresh:
        fold(fresh)
    twice = counts > 1
    yield pa.RecordBatch.from_arrays([pa.array(tokens[twice].view(np.int64)), pa.array(counts[twice])], names=["token", "count"])


def _frequent(docs: DataFrame, text_col: str, made: list[str] | None) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent tokens of all sets (in hash order) and the level, the logarithm, of their frequency: from such a level on that they are at most KNOWN, so of bounded size."""
    counts = docs.select(text_col).mapInArrow(tidy(_counted), "token long, count long").groupBy("token").agg(F.sum("count").alias("count")).filter(F.col("count") >= FREQUENT)
    counts = materialize(counts.select("token", F.floor(F.log2("count")).cast("byte").alias("level")), "frequent", made)
    levels = sorted(counts.groupBy("level").count().collect(), reverse=True)
    total, least = 0, 64
    for level, many in levels:
        total += many
        if total > KNOWN:
            break
        least = level
    rows = counts.filter(F.col("level") >= least).toArrow()
    tokens, level = rows.column(0).to_numpy().view(U), rows.column(1).to_numpy()
    order = np.argsort(tokens)
    return tokens[order], level[order]


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs a, b with their texts; keeps the links. Sorted neighbours often share b."""
    last: tuple[int | None, np.ndarray] = (None, np.zeros(0, U))
    for batch in batches:
        a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        left, right, i = [], [], 0
        for part in parts(batch.column(2)):
            sets = shingle_sets(part)
            for k, s in enumerate(sets):
                if last[0] != b[i + k]:
                    last = (b[i + k], shingle_sets(batch.column(3).slice(i + k, 1))[0])
                t = last[1]
                both = len(np.intersect1d(s, t, assume_unique=True))
                if DEN * both >= NUM * (len(s) + len(t) - both):
                    left.append(a[i + k])
                    right.append(b[i + k])
            i += len(sets)
        yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])


def verify(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) that link. texts: node, text."""
    t = texts.select("node", "text")
    joined = pairs.select("a", "b").join(t.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a").join(t.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b")
    return joined.select("a", "b", "ta", "tb").mapInArrow(tidy(_verified), "a long, b long")


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lists of at most GROUP members (node, text): the union of their tokens and for each token a bit for each member; for a single member its text, which is shorter."""
    for batch in batches:
        g, union, bits, members, sizes, alone = [], [], [], [], [], []
        for group, rows in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            g.append(group)
            members.append([r["node"] for r in rows])
            alone.append(rows[0]["text"] if len(rows) == 1 else None)
            if len(rows) == 1:
                union.append(None)
                bits.append(None)
                sizes.append(None)
                continue
            sets = [s for part in parts(pa.array([r["text"] for r in rows])) for s in shingle_sets(part)]
            every, inv = np.unique(np.concatenate(sets), return_inverse=True)
            own = np.zeros(len(every), np.uint64)
            np.bitwise_or.at(own, inv, np.repeat(np.uint64(1) << np.arange(len(sets), dtype=np.uint64), [len(s) for s in sets]))
            union.append(every.tobytes())
            bits.append(own.tobytes())
            sizes.append([len(s) for s in sets])
        yield pa.RecordBatch.from_arrays([pa.array(g, pa.int64()), pa.array(union, pa.binary()), pa.array(bits, pa.binary()), pa.array(members, pa.list_(pa.int64())), pa.array(sizes, pa.list_(pa.int64())), pa.array(alone, pa.string())], names=["g", *_GROUP])


_GROUP = ("tokens", "bits", "members", "sizes", "text")


def _unpacked(batch: pa.RecordBatch, prefix: str, name: str) -> Iterator[tuple[np.ndarray, bytes | None, list[int], np.ndarray]]:
    """Tokens, bits, members and their sizes of the group on one side of each row; equal neighbours are worked out once."""
    tokens, bits, members, sizes, text = (batch.column(f"{prefix}{c}") for c in _GROUP)
    ids = batch.column(name).to_numpy()
    first = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]]) if len(ids) else np.zeros(0, int)
    sets = iter([s for part in parts(text.take(pa.array(first))) for s in shingle_sets(part)])
    ends = [*first[1:].tolist(), len(ids)]
    for a, b in zip(first.tolist(), ends, strict=True):
        s = next(sets)
        if not tokens[a].is_valid:
            found = s, None, members[a].as_py(), np.array([len(s)])
        else:
            found = np.frombuffer(tokens[a].as_buffer(), U), bits[a].as_py(), members[a].as_py(), np.array(sizes[a].as_py())
        for _ in range(b - a):
            yield found


def _holds(bits: bytes | None, at: np.ndarray, members: int) -> np.ndarray:
    """Which members hold the tokens at these places of a group: a row for each token."""
    if bits is None:
        return np.ones((len(at), 1), np.float32)
    return ((np.frombuffer(bits, np.uint64)[at][:, None] >> np.arange(members, dtype=np.uint64)) & np.uint64(1)).astype(np.float32)


def _spanning(a: list[int], b: list[int], pairs: np.ndarray) -> Iterator[tuple[int, int]]:
    """Of the linked pairs as many as connect what all connect."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    for i, k in pairs:
        x, y = find(a[i]), find(b[k])
        if x != y:
            parent[x] = y
            yield a[i], b[k]


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of groups. The other group's union bounds the overlap of each member; if a member reaches the bound, the group is opened."""
    for batch in batches:
        left, right = [], []
        for (x, b1, m1, sizes), (y, b2, m2, others) in zip(_unpacked(batch, "own_", "own"), _unpacked(batch, "", "g"), strict=True):
            _, i, k = np.intersect1d(x, y, assume_unique=True, return_indices=True)
            if DEN * len(i) < NUM * sizes.min():
                continue
            own = _holds(b1, i, len(m1))
            if not (DEN * own.sum(0) >= NUM * sizes).any():
                continue
            both = own.T @ _holds(b2, k, len(m2))
            for p, q in _spanning(m1, m2, np.argwhere(DEN * both >= NUM * (sizes[:, None] + others[None, :] - both))):
                left.append(p)
                right.append(q)
        yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])


def components(edges: DataFrame, made: list[str] | None = None) -> DataFrame:
    """node, root (the smallest reachable node) for all nodes of the edges (a, b), by alternating large stars and small stars until only stars are left. A root has a row too."""
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct()
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        star = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("x")).select("x.*").filter("u <> v").distinct()
        e = materialize(star, "edges", made)
        # a star: whoever has an edge to a smaller node has one only, and that node has none
        ends = e.groupBy("u").agg(F.count("*").alias("n"))
        if ends.filter("n > 1").isEmpty() and e.select(F.col("v").alias("u")).join(ends, "u", "left_semi").isEmpty():
            break
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _of(rows: DataFrame, by: DataFrame, key: str) -> DataFrame:
    """rows joined with `by`, which has each key once: by broadcast if it is small, else shuffled, where Spark splits the rows of frequent keys."""
    return rows.join(small(by), key)


def _shared(docs: DataFrame, text_col: str, made: list[str]) -> DataFrame:
    """token, node, n, size of every prefix token that two or more nodes hold; size counts the tasks' nodes that hold it. Tokens are counted with partial aggregation and joined back, so that no task gathers the rows of a token."""
    frequent = docs.sparkSession.sparkContext.broadcast(_frequent(docs, text_col, made))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _prefixes(frequent.value)(batches)

    rows = materialize(docs.select(text_col).mapInArrow(tidy(emit), "token long, node long, n int"), "prefixes", made)
    frequent.destroy()
    sizes = rows.groupBy("token").agg(F.count("*").alias("size"), F.min("node").alias("lo"), F.max("node").alias("hi")).filter("lo <> hi")
    sizes = materialize(sizes.select("token", "size"), "sizes", made)
    return materialize(_of(rows, sizes, "token").distinct(), "rows", made)


def _labelled(nodes: DataFrame, roots: DataFrame | None) -> DataFrame:
    """nodes with comp: the root of each node, or the node."""
    if roots is None:
        return nodes.withColumn("comp", F.col("node"))
    return nodes.join(small(roots), "node", "left").withColumn("comp", F.coalesce("root", "node")).drop("root")


def _need(a: str, b: str) -> str:
    """A lower bound of the common prefix tokens of linked sets, of which the larger has at most `a` and the smaller at least `b` tokens: more than 0.8 (a + b) / 1.8 - 0.8 a."""
    return f"floor(({NUM * DEN} * ({a} + {b}) - {NUM * (NUM + DEN)} * {a}) / {DEN * (NUM + DEN)}) + 1"


def _edges(roots: DataFrame | None, new: DataFrame) -> DataFrame:
    return new if roots is None else new.unionByName(roots.select(F.col("node").alias("a"), F.col("root").alias("b")))


def linked(docs: DataFrame, sets: DataFrame, text_col: str, made: list[str]) -> DataFrame | None:
    """node and root (the smallest node of its component) of all nodes that link with another; None if none do. sets: node, text_hash of docs."""
    rows = _shared(docs, text_col, made)
    # how common a node's tokens are: of many near copies, the text that they were made from comes first
    nodes = materialize(rows.groupBy("node", "n").agg((F.sum("size") * 1000 / F.col("n")).cast("long").alias("common")), "nodes", made)
    wanted = materialize(_of(sets.select("node", "text_hash"), nodes.select("node"), "node").groupBy("node").agg(F.min("text_hash").alias("text_hash")), "wanted", made)
    texts = _of(docs.select(F.col(text_col).alias("text"), F.xxhash64(text_col).alias("text_hash")), wanted, "text_hash").select("node", "text")
    texts = materialize(texts.dropDuplicates(["node"]), "texts", made)

    roots, homes = None, None
    for turn in range(ROUNDS):
        # the leader of a token: its most common node, later one that comes first in this round's order; nodes of the leader's component ask nothing
        known = _labelled(nodes, roots).withColumn("h", F.xxhash64("node", F.lit(turn)) if turn else F.col("common")).select("node", "n", "comp", "h")
        met = rows.select("token", "node").join(small(known), "node")
        lead = met.groupBy("token").agg(F.max(F.struct("h", "node", "comp", "n")).alias("lead"), F.min("comp").alias("c0"), F.max("comp").alias("c1")).filter("c0 <> c1")
        lead = lead.select("token", F.col("lead.node").alias("b"), F.col("lead.n").alias("m"), F.col("lead.comp").alias("other"))
        led = met.join(lead, "token").filter(f"other <> comp and {DEN} * least(n, m) >= {NUM} * greatest(n, m)")
        best = led.groupBy("node", "n", "b").count().groupBy("node", "n").agg(F.max(F.struct("count", "b")).alias("x"))
        best = materialize(best.select("node", "n", "x.b", "x.count"), "best", made)
        if homes is None:  # only what shares a good part of its prefix: the union of unlike nodes would bound nothing
            homes = best.filter(f"3 * count >= n - ceil({NUM} * n / {DEN}) + 1").select("node", F.col("b").alias("home"))
        asked = best.filter(f"8 * count >= n - ceil({NUM} * n / {DEN}) + 1").select(F.col("node").alias("a"), "b")
        tries = asked.count()
        if not tries:
            break
        new = materialize(verify(asked, texts), "links", made)
        if hits := new.count():
            roots = components(_edges(roots, new), made)
        if hits * DRY < tries:
            break

    comps = _labelled(nodes, roots).select("node", "n", "comp")
    r = rows.select("token", "node").join(small(comps), "node")
    several = r.groupBy("token").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1")).filter("c0 <> c1").select("token")
    r = materialize(r.join(several, "token"), "open", made)
    # groups: nodes that met the same leader most, by component and size; in hashed blocks, so that no window holds a very large group
    members = r.select("node", "n", "comp").distinct()
    members = (members.withColumn("home", F.col("node")) if homes is None else members.join(small(homes), "node", "left").withColumn("home", F.coalesce("home", "node"))).select("node", "n", "comp", "home")
    sizes = members.groupBy("home").agg(F.count("*").alias("size"))
    members = members.join(small(sizes), "home").withColumn("sub", F.expr(f"pmod(xxhash64(node), cast(ceil(size / {64 * GROUP}) as bigint))"))
    order = Window.partitionBy("home", "sub").orderBy("comp", "n", "node")
    members = members.withColumns({"k": F.floor((F.row_number().over(order) - 1) / GROUP), "t": F.floor((F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")) / GROUP_TOKENS)})
    members = materialize(members.withColumn("g", F.xxhash64("home", "sub", "k", "t")).select("node", "n", "comp", "g"), "members", made)
    bounds = members.groupBy("g").agg(F.min("n").alias("n0"), F.max("n").alias("n1"), F.min("comp").alias("c0"), F.max("comp").alias("c1"))
    bounds = materialize(bounds.select("g", "n0", "n1", F.when(F.col("c0") == F.col("c1"), F.col("c0")).alias("only")), "bounds", made)  # only: the component of a group of one
    matrix = r.select("token", "node").join(small(members.select("node", "g")), "node").select("token", "g").distinct()
    matrix = materialize(matrix.join(small(bounds), "g"), "matrix", made)
    other = matrix.withColumnsRenamed({"g": "own", "n0": "m0", "n1": "m1", "only": "own_only"})
    pair = other.join(matrix, "token").filter(f"own < g and (only is null or own_only is null or only <> own_only) and {DEN} * n1 >= {NUM} * m0 and {DEN} * m1 >= {NUM} * n0")
    need = f"least({_need('n1', 'm0')}, {_need('m1', 'n0')})"
    asked = pair.groupBy("own", "g", "n0", "n1", "m0", "m1").count().filter(f"count >= {need}").select("own", "g")
    asked = materialize(asked.unionByName(bounds.filter("only is null").select(F.col("g").alias("own"), "g")), "asked", made)
    wanted = asked.select(F.explode(F.array("own", "g")).alias("g")).distinct()
    rows = texts.join(small(members.join(small(wanted), "g", "left_semi").select("node", "g")), "node").groupBy("g").agg(F.collect_list(F.struct("node", "text")).alias("rows"))
    unions = materialize(rows.mapInArrow(tidy(_grouped), "g long, tokens binary, bits binary, members array<long>, sizes array<long>, text string"), "unions", made)
    asking = unions.withColumnsRenamed({c: f"own_{c}" for c in _GROUP}).withColumnRenamed("g", "own")
    columns = ["own", "g", *(f"{o}{c}" for o in ("own_", "") for c in _GROUP)]
    size = unions.agg(F.sum(F.coalesce(F.octet_length("tokens"), F.lit(0)) + F.coalesce(F.octet_length("bits"), F.lit(0)) + F.coalesce(F.octet_length("text"), F.lit(0)))).first()[0] or 0
    if size <= BROADCAST_BYTES:  # else both joins shuffle
        asking, unions = F.broadcast(asking), F.broadcast(unions)
    opened = asked.join(asking, "own").join(unions, "g").select(columns).mapInArrow(tidy(_opened), "a long, b long").filter("a <> b")
    opened = materialize(opened, "links", made)
    return roots if opened.isEmpty() else components(_edges(roots, opened), made)


def classes(docs: DataFrame, id_col: str, text_col: str, made: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """doc_id, n_shingles, node of each row; and node, component_id, root of each node. Both are tables named in `made`."""
    made = [] if made is None else made
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    sets = described(d, "text").select("doc_id", F.col("_set.n").alias("n_shingles"), F.col("_set.node").alias("node"), F.xxhash64("text").alias("text_hash"))
    sets = materialize(sets, "sets", made)
    scratch: list[str] = []
    roots = linked(d, sets.filter("node is not null"), "text", scratch)
    own = sets.filter("node is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id"))
    own = own.withColumn("root", F.col("node")) if roots is None else own.join(roots, "node", "left").select("node", "doc_id", F.coalesce("root", "node").alias("root"))
    least = own.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    named = materialize(own.join(least, "root").select("node", "component_id", "root"), "named", made)
    drop(docs.sparkSession, scratch)
    return sets.drop("text_hash"), named


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id for each row of docs."""
    made: list[str] = []
    sets, named = classes(docs, id_col, text_col, made)
    own = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    result = materialize(sets.join(named, "node", "left").select("doc_id", "n_shingles", own.alias("component_id")), "classes")
    drop(docs.sparkSession, made)
    return result


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each component, the one with the smallest id; texts without words all stay.
    Where rows repeat that id, or a component has no id at all, any one of these rows stays."""
    made: list[str] = []
    sets, named = classes(docs, id_col, text_col, made)
    if sets.groupBy("doc_id").count().filter("count > 1 or doc_id is null").isEmpty():
        rows = sets.filter("node is not null").join(named, "node")
        lost = materialize(rows.filter("component_id < doc_id").select(F.col("doc_id").alias(id_col)), "lost")
        drop(docs.sparkSession, made)
        return docs.join(small(lost), id_col, "left_anti").select(docs.columns)
    tagged = described(docs.withColumnsRenamed({c: f"_own_{c}" for c in docs.columns}), f"_own_{text_col}").withColumn("_node", F.col("_set.node"))
    joined = tagged.join(named.select(F.col("node").alias("_node"), F.col("component_id").alias("_component"), F.col("root").alias("_root")), "_node", "left")
    kept = joined.filter(F.col("_root").isNotNull() & F.col(f"_own_{id_col}").eqNullSafe(F.col("_component"))).dropDuplicates(["_root"])
    return kept.unionByName(joined.filter("_root is null")).select([F.col(f"_own_{c}").alias(c) for c in docs.columns])
