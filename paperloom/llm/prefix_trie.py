"""Tries of conversations that share their first turns, by mergesort with common prefixes.

A turn is known by the MD5 of its role and text, a conversation by those of its turns, one after the other: its path. Paths
are dealt in ranges. In each range rows are sorted in runs of bounded size, each of which carries how many turns a path
shares with the one before it (its LCP); a loser tree merges the runs by these numbers, so that shared turns are not compared
again. The merged stream keeps the open path, from the root to where it stands, on a stack: a node that the next path leaves is
finished. Finished nodes are spooled, and read backwards, parents first, to learn their parents' smallest members.

Nodes on the first and on the last path of a range may go on in its neighbours. They are merged in the same way, FAN ranges at a
time and level by level, as many as there are nodes on two paths a range. Rows of finished nodes whose parents were open
are joined to them at last. Conversations with equal paths may fill many ranges: only numbers go on from there, and their
ids in chunks, which one task hashes as they come, since a digest of a list is a chain.

What a task holds: a run, a block of each run, an open path, and the ids that end at its nodes.

Null roles and texts are empty. Rows with a null conv_id belong to no conversation and are left out. Turns go by number,
null first; those of one number, repeated rows too, go by the digest of role and text. The turns of one conversation must
fit a row (24 bytes a turn). A conversation of no turns ends at the root. An empty table gives no rows. Further columns are
ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import pickle
import struct
import tempfile
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm.common import WORD, crc32_sql
from paperloom.scratch import discard, written

DIGEST = 16  #: bytes of a turn in a path
RUN_ROWS, RUN_BYTES, BLOCK = 20_000, 32 << 20, 200  #: rows and bytes of a run, rows of a block that is read back
FAN = 16  #: ranges whose open nodes are merged at once
CHUNK = 8192  #: ids in a row of ends
AFTER = 1 << 40  #: place of nodes on the last path of a range, behind those on the first
NO_ENDS = hashlib.sha256(b"").digest()
NODE, OPEN, ENDS = 0, 1, 2  #: kinds of rows

COLUMNS = (
    "kind int, part long, place long, id binary, parent binary, depth long, conv_id long, parent_conv_id long, parent_open boolean, "
    "n_convs long, n_children long, n_leaves long, saved_tokens long, words long, sha binary, ends array<long>"
)
NAMES = [c.split()[0] for c in COLUMNS.split(", ")]


# -- sorted runs and their merge --------------------------------------------------------------------------------------


def shared_turns(a: bytes, b: bytes, known: int) -> int:
    """Turns that two paths share, of which `known` are known to be equal."""
    most = min(len(a), len(b)) // DIGEST
    while known < most and a[known * DIGEST : (known + 1) * DIGEST] == b[known * DIGEST : (known + 1) * DIGEST]:
        known += 1
    return known


def sorted_run(rows: list[tuple]) -> list[tuple]:
    """(lcp, path, conv_id, words) of rows (path, conv_id, words), in order."""
    rows.sort(key=lambda r: r[:2])
    before, out = b"", []
    for path, conv_id, words in rows:
        out.append((shared_turns(before, path, 0), path, conv_id, words))
        before = path
    return out


def _blocks(spool, places: list[int]) -> Iterator[tuple]:
    for at in places:
        spool.seek(at)
        yield from pickle.load(spool)


def sorted_runs(batches: Iterator[pa.RecordBatch], spool, run_rows: int = RUN_ROWS) -> list[Iterator[tuple]]:
    """Runs of the rows (path, conv_id, words) of batches, each in order; all but the last are in the spool file."""
    runs, rows, size = [], [], 0

    def put():
        run, places = sorted_run(rows), []
        for at in range(0, len(run), BLOCK):
            places.append(spool.seek(0, 2))
            pickle.dump(run[at : at + BLOCK], spool, pickle.HIGHEST_PROTOCOL)
        runs.append(_blocks(spool, places))
        rows.clear()

    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("path", "conv_id", "words")), strict=True):
            rows.append(row)
            size += 2 * len(row[0])
            if len(rows) >= run_rows or size >= RUN_BYTES:
                put()
                size = 0
    return [*runs, iter(sorted_run(rows))]


def merged(runs: list[Iterator[tuple]]) -> Iterator[tuple]:
    """The rows (lcp, path, conv_id, words) of sorted runs in order; lcp is that with the row before.

    A loser tree: the inner nodes keep the run that lost there, with the turns that its row shares with the row that beat it. Of
    two rows that share unlike numbers of turns with the last row given out, the one with more comes first; only equal
    numbers ask for a comparison, from there on."""
    heads = [next(r, None) for r in runs]
    shared = [row[0] if row else 0 for row in heads]

    def first_of(i: int, j: int) -> tuple[int, int]:
        if heads[i] is None or heads[j] is None:
            return (i, j) if heads[j] is None else (j, i)
        if shared[i] != shared[j]:
            return (i, j) if shared[i] > shared[j] else (j, i)
        a, b = heads[i], heads[j]
        n = shared_turns(a[1], b[1], shared[i])
        before = (a[1][n * DIGEST : (n + 1) * DIGEST], a[2]) < (b[1][n * DIGEST : (n + 1) * DIGEST], b[2])
        winner, loser = (i, j) if before else (j, i)
        shared[loser] = n
        return winner, loser

    n = len(runs)
    losers, winners = [0] * n, [0] * n + list(range(n))
    for at in range(n - 1, 0, -1):
        winners[at], losers[at] = first_of(winners[2 * at], winners[2 * at + 1])
    top = winners[1] if n > 1 else 0
    while heads[top] is not None:
        yield (shared[top], *heads[top][1:])
        heads[top] = next(runs[top], None)
        shared[top] = heads[top][0] if heads[top] else 0
        at = (n + top) // 2
        while at:
            top, losers[at] = first_of(top, losers[at])
            at //= 2


# -- the open path ------------------------------------------------------------------------------------------------------


class Node:
    """A node of the trie, or the part of it that one range holds. `left`: it is on the range's first path."""

    __slots__ = ("id", "parent", "depth", "conv_id", "n", "children", "leaves", "saved", "words", "sha", "ends", "left")

    def __init__(self, id: bytes, parent: bytes, depth: int, words: int, left: bool):
        self.id, self.parent, self.depth, self.words, self.left = id, parent, depth, words, left
        self.conv_id = self.sha = self.ends = None
        self.n = self.children = self.leaves = self.saved = 0

    def add(self, conv_id: int | None, n: int, children: int, leaves: int, saved: int) -> None:
        if conv_id is not None and (self.conv_id is None or conv_id < self.conv_id):
            self.conv_id = conv_id
        self.n, self.children, self.leaves, self.saved = self.n + n, self.children + children, self.leaves + leaves, self.saved + saved


def ends_digest(ids: array) -> bytes:
    """SHA-256 of ids as decimals joined by commas."""
    found = hashlib.sha256()
    for at in range(0, len(ids), CHUNK):
        found.update((("," if at else "") + ",".join(map(str, ids[at : at + CHUNK]))).encode())
    return found.digest()


class OpenPath:
    """Nodes from the root to where a stream in order stands. finished() gives those that are done, parents before children."""

    RECORD = struct.Struct("<16s16s6q32s")

    def __init__(self, spool):
        self.path, self.open, self.spool, self.count = [], [], spool, 0

    def leave(self, depth: int, whole: bool = False) -> None:
        """The stream goes on below the node at depth - 1: deeper ones are done, but for those on the first path."""
        while len(self.path) > depth:
            node = self.path.pop()
            if node.left and not whole:
                self.open.append((node.depth, node))
                continue
            if not node.children:
                node.leaves = 1
            node.saved += (node.n - 1) * node.words
            if node.ends is not None:
                node.sha = ends_digest(node.ends)
            self.spool.write(self.RECORD.pack(node.id, node.parent, node.depth, node.conv_id, node.n, node.children, node.leaves, node.saved, node.sha or bytes(32)))
            self.count += 1
            if self.path:
                self.path[-1].add(node.conv_id, node.n, 1, node.leaves, node.saved)

    def end(self, whole: bool) -> None:
        if whole:
            self.leave(0, True)
        self.open += [(node.depth if node.left else AFTER + node.depth, node) for node in self.path]

    def finished(self) -> Iterator[dict]:
        seen, step = {}, 4096
        for end in range(self.count, 0, -step):
            at = max(0, end - step)
            self.spool.seek(at * self.RECORD.size)
            for id, parent, depth, conv_id, n, children, leaves, saved, sha in reversed(list(self.RECORD.iter_unpack(self.spool.read((end - at) * self.RECORD.size)))):
                seen[depth] = id, conv_id
                own, above = seen.get(depth - 1, (None, None))
                yield {"kind": NODE, "id": id, "parent": parent, "depth": depth, "conv_id": conv_id, "parent_conv_id": above if own == parent else None, "parent_open": depth > 0 and own != parent,
                       "n_convs": n, "n_children": children, "n_leaves": leaves, "saved_tokens": saved, "sha": None if sha == bytes(32) else sha}

    def opened(self, part: int) -> Iterator[dict]:
        """Rows of the nodes that may go on elsewhere, and of the ids that end there."""
        for place, node in self.open:
            yield {"kind": OPEN, "part": part, "place": place, "id": node.id, "parent": node.parent, "depth": node.depth, "conv_id": node.conv_id,
                   "n_convs": node.n, "n_children": node.children, "n_leaves": node.leaves, "saved_tokens": node.saved, "words": node.words, "sha": node.sha}
            for at in range(0, len(node.ends or ()), CHUNK):
                yield {"kind": ENDS, "part": part, "place": at, "id": node.id, "ends": list(node.ends[at : at + CHUNK])}


def walk(rows: Iterator[tuple], open_path: OpenPath) -> None:
    """Take rows (lcp, path, conv_id, words) in order along the open path."""
    stack, before = open_path.path, None
    for lcp, path, conv_id, words in rows:
        first = before is None
        if not first and path != before:
            # No more paths end there; where the first one ends, some may in the range before.
            if not stack[-1].left:
                stack[-1].sha, stack[-1].ends = ends_digest(stack[-1].ends), None
            open_path.leave(lcp + 1)
        for depth in range(len(stack), len(path) // DIGEST + 1):
            parent = stack[-1].id if stack else bytes(DIGEST)
            own = hashlib.md5(parent + path[(depth - 1) * DIGEST : depth * DIGEST]).digest() if depth else bytes(DIGEST)
            stack.append(Node(own, parent, depth, words[depth - 1] if depth else 0, first))
        node = stack[-1]
        node.add(conv_id, 1, 0, 0, 0)
        if node.ends is None:
            node.ends = array("q")
        node.ends.append(conv_id)
        before = path


def _batches(rows: Iterator[dict], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) >= 2048:
            yield pa.RecordBatch.from_pylist(held, schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=schema)


def _schema() -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(COLUMNS))


def ranges(paths: DataFrame, run_rows: int = RUN_ROWS) -> DataFrame:
    """Finished and open nodes of each range of paths (path, conv_id, words)."""
    schema = _schema()

    def run(batches):
        part = TaskContext.get().partitionId()
        with tempfile.TemporaryFile() as runs, tempfile.TemporaryFile() as spool:
            open_path = OpenPath(spool)
            walk(merged(sorted_runs(batches, runs, run_rows)), open_path)
            open_path.end(whole=False)
            yield from _batches(open_path.finished(), schema)
            yield from _batches(open_path.opened(part), schema)

    return paths.repartitionByRange("path", "conv_id").select("path", "conv_id", "words").mapInArrow(run, COLUMNS)


def joined_ranges(opened: DataFrame, whole: bool, fan: int = FAN) -> DataFrame:
    """Finished and open nodes of `fan` neighbouring ranges; with `whole` there are no others and all are finished."""

    schema = _schema()

    def run(key, table):
        rows = sorted(table.select(NAMES).to_pylist(), key=lambda r: (r["part"], r["place"]))
        with tempfile.TemporaryFile() as spool:
            open_path = OpenPath(spool)
            stack = open_path.path
            for r in rows:
                depth = r["depth"]
                if depth >= len(stack) or stack[depth].id != r["id"]:
                    open_path.leave(depth)
                    stack.append(Node(r["id"], r["parent"], depth, r["words"], r["part"] == rows[0]["part"] and r["place"] < AFTER and not whole))
                stack[depth].add(*(r[c] for c in ("conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")))
                stack[depth].sha = stack[depth].sha or r["sha"]
            open_path.end(whole)
            return pa.Table.from_pylist([*open_path.finished(), *open_path.opened(key[0].as_py())], schema=schema)

    return opened.withColumn("group", F.expr(f"part div {fan}")).groupBy("group").applyInArrow(run, COLUMNS)


def chains(ends: DataFrame) -> DataFrame:
    """(id, chain): the digest of the ids in the chunks of a node, hashed as they come."""
    schema = pa.schema([("id", pa.binary()), ("chain", pa.binary())])

    def run(batches):
        last, found = None, None
        for batch in batches:
            out = {"id": [], "chain": []}
            for id, ids in zip(batch.column("id").to_pylist(), batch.column("ends").to_pylist(), strict=True):
                text = ",".join(map(str, ids)).encode()
                if id == last:
                    found.update(b"," + text)
                    continue
                if last is not None:
                    out["id"].append(last)
                    out["chain"].append(found.digest())
                last, found = id, hashlib.sha256(text)
            yield pa.RecordBatch.from_pydict(out, schema=schema)
        if last is not None:
            yield pa.RecordBatch.from_pydict({"id": [last], "chain": [found.digest()]}, schema=schema)

    return ends.repartition("id").sortWithinPartitions("id", "part", "place").select("id", "ends").mapInArrow(run, "id binary, chain binary")


def trie(paths: DataFrame, *, run_rows: int = RUN_ROWS, fan: int = FAN) -> DataFrame:
    """One row for each distinct beginning of paths (conv_id, path, words): conv_id, depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256."""
    levels = [written(ranges(paths, run_rows), "trie-ranges")]
    opened = levels[0].filter(f"kind = {OPEN}")
    while True:
        last = opened.agg(F.max("part")).first()[0]
        whole = last is None or last < fan
        levels.append(written(joined_ranges(opened, whole, fan), "trie-level"))
        if whole:
            break
        opened = levels[-1].filter(f"kind = {OPEN}")
    ends = written(chains(levels[0].filter(f"kind = {ENDS}")), "trie-ends")
    upper = levels[1]
    for level in levels[2:]:
        upper = upper.unionByName(level)
    upper = written(upper.filter(f"kind = {NODE}").join(ends, "id", "left").withColumn("sha", F.coalesce("sha", "chain")).drop("chain"), "trie-upper")
    discard(ends, *levels[1:])
    nodes = levels[0].filter(f"kind = {NODE}").unionByName(upper)
    # An open node may have very many children: both sides are written, so that a skewed one is split.
    orphans = written(nodes.filter("parent_open"), "trie-orphans")
    above = upper.select(F.col("id").alias("parent"), F.col("conv_id").alias("above"))
    found = orphans.join(above, "parent").withColumn("parent_conv_id", F.col("above")).drop("above")
    sha = F.lower(F.hex(F.coalesce("sha", F.lit(NO_ENDS))))
    return nodes.filter("not parent_open").unionByName(found).select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", sha.alias("ends_sha256"))


# -- conversations -----------------------------------------------------------------------------------------------------


def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns) of conversations (conv_id, turn, role, text); a turn has its digest and number of words."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)))
    rows = conversations.filter("conv_id is not null").select(F.col("conv_id").cast("long"), F.struct("turn", digest.alias("digest"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("words")).alias("t"))
    return rows.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list("t")), lambda t: F.struct(t["digest"].alias("digest"), t["words"].alias("words"))).alias("turns"))


def paths(conversations: DataFrame) -> DataFrame:
    """(conv_id, path, words) of conversations (conv_id, turns)."""
    path = F.unhex(F.array_join(F.transform("turns", lambda t: F.hex(t["digest"])), ""))
    return conversations.select("conv_id", path.alias("path"), F.col("turns.words").alias("words"))


def rebuilt(conversations: DataFrame, group: int = 20, most: int = 4) -> DataFrame:
    """conversations (conv_id, turns), whose first h turns are those of the first conversation of `group`; h is crc32 of conv_id modulo `most`."""
    base = F.col("conv_id") - F.pmod("conv_id", F.lit(group))
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(most)).cast("int")
    heads = conversations.filter(F.pmod("conv_id", F.lit(group)) == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, most - 1).alias("head"))
    own = conversations.select("conv_id", "turns", base.alias("base"), h.alias("h")).join(heads, "base", "left")
    head = F.coalesce(F.slice("head", F.lit(1), F.col("h")), F.slice("turns", 1, 0))
    return own.select("conv_id", F.concat(head, F.slice("turns", F.col("h") + 1, F.size("turns"))).alias("turns"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = written(turns(spark.read.parquet(f"{sf_dir}/conversations.parquet")), "trie-turns")
    made = written(paths(rebuilt(held)), "trie-paths")
    discard(held)
    return trie(made)


OP11_SQL = rf"""
WITH rows AS (SELECT conv_id, turn, coalesce(text, '') AS t, coalesce(role, '') AS r FROM conversations WHERE conv_id IS NOT NULL),
digests AS (SELECT conv_id, turn, md5(length(r) || ':' || r || t) AS digest, len(regexp_extract_all(t, '{WORD}')) AS words FROM rows),
own AS (SELECT conv_id, list(struct_pack(digest := digest, words := words) ORDER BY turn NULLS FIRST, digest) AS turns, {crc32_sql('CAST(conv_id AS VARCHAR)')} % 4 AS h FROM digests GROUP BY 1),
made AS (SELECT o.conv_id, list_concat(coalesce(list_slice(b.turns, 1, o.h), []), list_slice(o.turns, o.h + 1, len(o.turns))) AS turns
  FROM own o LEFT JOIN own b ON b.conv_id = o.conv_id - (o.conv_id % 20 + 20) % 20),
members AS (SELECT conv_id, len(turns) AS n, turns, unnest(range(len(turns) + 1)) AS depth FROM made),
paths AS (SELECT conv_id, n, depth, array_to_string(list_transform(list_slice(turns, 1, depth), lambda x: x.digest), '') AS path, CASE WHEN depth > 0 THEN turns[depth].words ELSE 0 END AS words FROM members),
nodes AS (SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(words) AS words, coalesce(string_agg(CASE WHEN n = depth THEN CAST(conv_id AS VARCHAR) END, ',' ORDER BY conv_id), '') AS ends FROM paths GROUP BY 1, 2),
kids AS (SELECT left(path, 32 * (depth - 1)) AS path, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1),
whole AS (SELECT nodes.*, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN kids USING (path)),
above AS (SELECT left(path, CAST(32 * unnest(range(depth + 1)) AS INT)) AS path, n_children = 0 AS leaf, (n_convs - 1) * words AS saved FROM whole),
sums AS (SELECT path, sum(CAST(leaf AS INT)) AS n_leaves, sum(saved) AS saved_tokens FROM above GROUP BY 1)
SELECT w.conv_id, w.depth, p.conv_id AS parent_conv_id, w.n_convs, w.n_children, CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, sha256(w.ends) AS ends_sha256
FROM whole w JOIN sums USING (path) LEFT JOIN nodes p ON w.depth > 0 AND p.path = left(w.path, 32 * (w.depth - 1))
"""
