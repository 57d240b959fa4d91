"""Near-duplicates by the exact similarity of word shingles.

The similarity of two texts is that of the sets of their shingles of five lower-cased (A-Z) words: shared ones by
all (Jaccard). A text of fewer words is one shingle, one without words has none and equals its like. Texts of one
set are one node. Candidates come first from the method of operator 2: nodes that share a fuzzy key of their SimHash fingerprints, as all do
that differ in at most 4 bits, are verified and connected. Pairs of similarity 0.8 differ in about 10 bits, so the search goes on from these
components: nodes that share one of 40 keys of 6 MinHashes each are candidates too, and with them what the fingerprints left to compare: a pair of similarity s shares none with
probability (1 - s^6)^40, 5 in a million at 0.8. Every candidate pair is verified on the sets, so no link is false.

Before that it must pass a bound without error: a sketch holds, in each of 512 bits, whether an odd number of a set's
shingles falls there, so two sketches differ in no more bits than the sets in shingles; and sets of similarity s differ in at
most (1 - s) / (1 + s) of the sum of their sizes. Pairs much below the similarity fail it and are never made.

A bucket of nodes with one key is not paired all with all: in each round one of its nodes leads, the same in all buckets
of a group of copies and another in each round, and every node is verified against the one leader of its buckets whose sketch is
nearest. Buckets of one component are done and leave. When after a round the pairs left, those in buckets whose ends are not yet
connected, are few, all of them that pass the bound are verified. So components are those of all candidate links.

Where the pairs left get no fewer, and are more than PAIRS_A_SHINGLE times the shingles of their nodes, nodes meet that are not alike: texts of one template share most of the least
hashes, and are no duplicates. Nodes of such buckets are dealt anew, by their rarest shingles. In any order of shingles two sets of
similarity s share one of the first n - ceil(s n) + 1 of each, so the rarest fifth of a set is enough, without error; what a
template brings is frequent and comes last, so that texts which share no more than a template do not meet at all. (Unlike texts whose
template has more than four fifths of each, a similarity of 0.67 to 0.8, still meet by it.)

Buckets hold keys, nodes and components only. Sketches go to pairs with leaders, and at last to the buckets still open;
texts go to pairs that pass the bound.

Hashes of shingles and of sets have 64 bits; null and empty texts are alike. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.llm import simhash
from paperloom.llm.common import map_batches, maybe_in
from paperloom.llm.components import components
from paperloom.scratch import discard, written

SHINGLE = 5
SIMILARITY = (4, 5)  #: least similarity, as a fraction
BANDS, ROWS = 40, 6
FEW = 4  #: pairs left a row of the buckets, at most, to verify all of them
SKETCH = 8  #: words of 64 bits
PAIRS_A_SHINGLE = 50  #: pairs of a bucket, compared by their sketches in the join, that cost as much as a shingle that is made, written and dealt twice
AT_ONCE = 500  #: documents or pairs worked on at once
PART = 512  #: shingles hashed at once, so that products stay in the cache


def shingles(text: str | None, n: int = SHINGLE) -> np.ndarray:
    """Sorted distinct XXH64 hashes of the shingles."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined, size = memoryview(b" ".join(words)), min(n, len(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - size + 1]
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(joined[a:b]) for a, b in zip(starts.tolist(), ends[size - 1 :].tolist(), strict=True)], np.uint64))


class MinHash:
    def __init__(self):
        rng = np.random.default_rng(42)
        odd = lambda n: rng.integers(0, 1 << 63, n, dtype=np.uint64) << np.uint64(1) | np.uint64(1)
        self.by_hash, self.by_row, self.by_band = odd(BANDS * ROWS), odd(ROWS), odd(BANDS)

    def keys(self, hashes: np.ndarray) -> np.ndarray:
        least = np.full(BANDS * ROWS, np.uint64(0xFFFFFFFFFFFFFFFF))
        for at in range(0, len(hashes), PART):
            np.minimum(least, (self.by_hash[:, None] * hashes[None, at : at + PART]).min(axis=1), out=least)
        return ((least.reshape(BANDS, ROWS) * self.by_row).sum(axis=1, dtype=np.uint64) + self.by_band).view(np.int64)


def odd_sketch(hashes: np.ndarray) -> np.ndarray:
    odd = np.bincount((hashes >> np.uint64(20)).astype(np.int64) % (64 * SKETCH), minlength=64 * SKETCH) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def text_digest() -> Column:
    return F.xxhash64("text")


def _marked(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, node, size, fp, keys, sketch) of every row of docs."""
    import xxhash

    def make():
        minhash = MinHash()

        def work(batch):
            found = [shingles(t) for t in batch.column("text").to_pylist()]
            nodes = np.array([xxhash.xxh64_intdigest(x.tobytes()) for x in found], np.uint64).view(np.int64)
            fps = np.array([simhash.bit_majority(x) for x in found], np.uint64).view(np.int64)
            return {"doc_id": batch.column("doc_id"), "digest": batch.column("digest"), "node": nodes, "size": [len(x) for x in found], "fp": fps, "keys": [minhash.keys(x) for x in found], "sketch": [odd_sketch(x) for x in found]}

        return work

    return map_batches(docs.select(F.col("doc_id").cast("long"), text_digest().alias("digest"), "text"), make, "doc_id long, digest long, node long, size int, fp long, keys array<long>, sketch array<long>", AT_ONCE)


def _texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, text) of the nodes of wanted (digest, node)."""
    # Texts that are surely not wanted are not dealt, and equal ones once a task.
    texts = maybe_in(docs.select(text_digest().alias("digest"), "text"), wanted, "digest").filter("maybe")
    return texts.groupBy("digest").agg(F.first("text").alias("text")).join(wanted.select("digest", "node"), "digest").select("node", "text")


def similar(x: np.ndarray, y: np.ndarray) -> bool:
    shared = len(np.intersect1d(x, y, assume_unique=True))
    return SIMILARITY[1] * shared >= SIMILARITY[0] * (len(x) + len(y) - shared)


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (u, v) that are similar."""
    # The side of which one node may have very many pairs is joined first, from a written table.
    both = pairs.join(texts.select(F.col("node").alias("v"), F.col("text").alias("b")), "v").join(texts.select(F.col("node").alias("u"), F.col("text").alias("a")), "u")

    def work(batch):
        u, v = batch.column("u").to_numpy(), batch.column("v").to_numpy()
        sets, keep = {}, np.zeros(len(u), bool)
        for at in range(len(u)):
            for node, text in ((u[at], batch.column("a")), (v[at], batch.column("b"))):
                if node not in sets:
                    sets[node] = shingles(text[at].as_py())
            keep[at] = similar(sets[u[at]], sets[v[at]])
        return {"u": u[keep], "v": v[keep]}

    return map_batches(both.select("u", "v", "a", "b"), lambda: work, "u long, v long", AT_ONCE)


WORDS = [f"s{i}" for i in range(SKETCH)]


def _differ() -> Column:
    """Bits in which the sketches of a node and of its partner (v_…) differ."""
    return sum((F.bit_count(F.col(w).bitwiseXOR(F.col(f"v_{w}"))) for w in WORDS), F.lit(0))


def _may_link() -> Column:
    """Whether sizes and sketches of a node and its partner leave a link possible."""
    a, b = SIMILARITY
    sizes = F.least("size", "v_size") * b >= F.greatest("size", "v_size") * a
    return sizes & (_differ() * (b + a) <= (F.col("size") + F.col("v_size")) * (b - a))


def _partner(*further: str) -> list[Column]:
    return [F.col("node").alias("v"), *[F.col(c).alias(f"v_{c}") for c in ("size", *WORDS, *further)]]


def _star_pairs(members: DataFrame, sketches: DataFrame, turn: int) -> DataFrame:
    """Every node with the nearest leader of its buckets (key) that it may have a new link to."""
    leader = F.min_by(F.struct("node", "component"), F.xxhash64("node", F.lit(turn)))
    leaders = written(members.groupBy("key").agg(leader.alias("l")), "shingle-leaders")
    pairs = members.join(leaders, "key").filter("component != l.component").select(F.col("node").alias("u"), F.col("l.node").alias("v"))
    # A leader may have very many nodes: its pairs are written before its sketch is joined.
    pairs = written(pairs.distinct(), "shingle-led")
    both = pairs.join(sketches.select(*_partner()), "v").join(sketches.withColumnRenamed("node", "u"), "u").filter(_may_link())
    nearest = written(both.groupBy("u").agg(F.min_by("v", F.struct(_differ(), "v")).alias("v")), "shingle-pairs")
    discard(leaders, pairs)
    return nearest


def _all_pairs(members: DataFrame, sketches: DataFrame, groups: DataFrame) -> DataFrame:
    """All pairs of a bucket that may have a new link; groups (key, component, n) counts the nodes."""
    members = written(members.join(sketches, "node"), "shingle-wide")
    largest = written(groups.groupBy("key").agg(F.max_by("component", F.struct("n", "component")).alias("largest")), "shingle-largest")
    others = written(members.join(largest, "key").filter("component != largest").select("key", *_partner("component")), "shingle-others")
    joined = members.join(others, "key").filter((F.col("component") != F.col("v_component")) & _may_link())
    pairs = written(joined.select(F.greatest("node", "v").alias("u"), F.least("node", "v").alias("v")).distinct(), "shingle-pairs")
    discard(members, largest, others)
    return pairs


def _shingles_of(members: DataFrame, sketches: DataFrame) -> int:
    return sketches.join(members.select("node").distinct(), "node", "left_semi").agg(F.sum("size")).first()[0] or 0


def _by_rarest(members: DataFrame, texts: DataFrame) -> DataFrame:
    """The nodes of members (key, node, component) by the rarest of their shingles, as many as two similar sets share one of; their
    frequencies are those among these nodes."""
    nodes = written(members.groupBy("node").agg(F.min("component").alias("component")), "shingle-rest")

    def work(batch):
        sets = [shingles(t).view(np.int64) for t in batch.column("text").to_pylist()]
        return {"node": batch.column("node"), "shingles": sets}

    held = map_batches(texts.join(nodes, "node", "left_semi"), lambda: work, "node long, shingles array<long>", AT_ONCE)
    each = written(held.select("node", F.size("shingles").alias("size"), F.explode("shingles").alias("key")), "shingle-each")
    # Frequent shingles have very many rows: their counts are combined, and joined to a written table.
    counts = written(each.groupBy("key").agg(F.count(F.lit(1)).alias("n")), "shingle-counts")
    a, b = SIMILARITY
    first = F.col("size") - F.ceil(F.col("size") * a / b).cast("int") + 1
    rarest = each.join(counts, "key").groupBy("node").agg(F.min("size").alias("size"), F.array_sort(F.collect_list(F.struct("n", "key"))).alias("all"))
    keyed = rarest.select("node", F.explode(F.slice("all", F.lit(1), first)).alias("k")).filter("k.n > 1").select(F.col("k.key").alias("key"), "node")
    found = written(keyed.join(nodes, "node").select("key", "node", "component"), "shingle-members")
    discard(nodes, each, counts)
    return found


def _members(keyed: DataFrame) -> DataFrame:
    """(key, node, component) of the nodes of keyed (key, node) whose key others have too; each is its own component."""
    shared = written(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key"), "shingle-buckets")
    # Most keys are of one node: they are surely not wanted and not dealt again.
    maybe = maybe_in(keyed, shared, "key").filter("maybe")
    members = written(maybe.join(shared, "key").select("key", "node", F.col("node").alias("component")), "shingle-members")
    discard(shared)
    return members


def _by_fingerprint(nodes: DataFrame) -> DataFrame:
    """The buckets of the fuzzy keys of nodes (node, fp): fingerprints that differ in at most 4 bits share one."""
    return _members(simhash.fuzzy_keys(nodes, "node").select("key", "node"))


def _by_minhash(nodes: DataFrame) -> DataFrame:
    return _members(nodes.select("node", F.explode("keys").alias("key")))


def _relabelled(members: DataFrame, labels: DataFrame) -> DataFrame:
    relabelled = members.drop("component").join(labels, "node", "left").select("key", "node", F.coalesce("component", "node").alias("component"))
    return written(relabelled, "shingle-members")


def _connected(members: DataFrame, sketches: DataFrame, texts: DataFrame, labels: DataFrame | None, last_too: bool = True) -> tuple[DataFrame | None, DataFrame | None]:
    """labels (node, component; None: no links yet) with the links among members (key, node, component) added, and the members left
    to compare all with all (None: none), which is done if last_too. Discards both."""
    if labels is not None:
        members, done = _relabelled(members, labels), members
        discard(done)
    turn, before, rarest = 0, None, False
    while True:
        groups = written(members.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n")), "shingle-groups")
        left = groups.groupBy("key").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("squares"), F.count(F.lit(1)).alias("parts"))
        left = written(left.filter("parts > 1"), "shingle-open")
        count, pairs_left = left.agg(F.sum("n"), F.sum(F.expr("(n * n - squares) div 2").cast("decimal(38,0)"))).first()
        if not pairs_left:
            discard(groups, left, members)
            break
        if labels is not None:
            members, done = written(members.join(left.select("key"), "key").select("key", "node", "component"), "shingle-members"), members
            groups, counted = written(groups.join(left.select("key"), "key").select("key", "component", "n"), "shingle-groups"), groups
            discard(done, counted)
        few, stuck = pairs_left <= FEW * count, before is not None and 10 * pairs_left > 9 * before
        # The rarest shingles cost a row a shingle of the nodes left, all pairs a comparison a pair: the cheaper way is taken.
        if before is not None and (few or stuck) and not last_too:
            discard(groups, left)
            return labels, members
        if stuck and not few and not rarest and pairs_left > PAIRS_A_SHINGLE * _shingles_of(members, sketches):
            members, done = _by_rarest(members, texts), members
            discard(groups, left, done)
            before, rarest = None, True
            continue
        last = before is not None and (few or stuck)
        pairs = _all_pairs(members, sketches, groups) if last else _star_pairs(members, sketches, turn)
        found = verified(pairs, texts)
        # What is connected so far goes on as links of nodes to the smallest of their component.
        links = written(found if labels is None else found.unionByName(labels.select(F.col("node").alias("u"), F.col("component").alias("v"))), "shingle-links")
        discard(pairs, groups, left, *([] if labels is None else [labels]))
        labels = components(links)
        discard(links)
        if last:
            discard(members)
            break
        members, done = _relabelled(members, labels), members
        discard(done)
        before, turn = pairs_left, turn + 1
    return labels, None


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, component, kept) of every row of docs (doc_id, text) that has a near-duplicate.

    kept marks the row of a component with the smallest id, and of several texts of this id the one with the
    smallest digest (text_digest). Rows with a null id connect others, and are kept."""
    marked = written(_marked(docs), "shingle-marked")
    rows = written(marked.select("doc_id", "digest", "node"), "shingle-nodes-of-rows")
    nodes = marked.groupBy("node").agg(F.min("size").alias("size"), F.min("digest").alias("digest"), F.first("fp").alias("fp"), F.first("keys").alias("keys"), F.first("sketch").alias("sketch"))
    nodes = written(nodes, "shingle-nodes")
    discard(marked)
    by_print, by_minhash = _by_fingerprint(nodes), _by_minhash(nodes)
    # Sketches and texts are of nodes that share a bucket only.
    met = by_print.select("node").union(by_minhash.select("node")).distinct()
    wanted = nodes.join(met, "node").select("digest", "node", "size", *[F.get("sketch", F.lit(i)).alias(w) for i, w in enumerate(WORDS)])
    wanted = written(wanted, "shingle-wanted")
    discard(nodes)
    texts, sketches = written(_texts(docs, wanted), "shingle-texts"), wanted.drop("digest")

    labels, rest = _connected(by_print, sketches, texts, None, last_too=False)
    if rest is not None:
        by_minhash, done = written(by_minhash.unionByName(rest), "shingle-members"), by_minhash
        discard(done, rest)
    labels, _ = _connected(by_minhash, sketches, texts, labels)
    discard(wanted, texts)
    # Nodes without a link may still be several rows.
    linked = rows.withColumn("component", F.col("node")) if labels is None else rows.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    linked, done = written(linked.select("doc_id", "digest", "component"), "shingle-rows"), rows
    discard(done, *([] if labels is None else [labels]))
    first = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "digest")))
    first = written(linked.groupBy("component").agg(first.alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1"), "shingle-first")
    kept = F.col("doc_id").isNull() | (F.struct("doc_id", "digest") == F.col("first"))
    return linked.join(first, "component").select("doc_id", "digest", "component", kept.alias("kept"))
