"""Prefix trie of conversations as balanced parentheses, a shard of sorted conversations at a time.

A conversation is the sequence of its turns' digests. Conversations are range-sorted by sequence and
identifier; a shard is one range. Its trie is written down as parentheses: a node opens where its
first conversation needs it and closes behind its last one. Blocks of excess minima find the close of
an open parenthesis (``Parentheses.findclose``), which delimits the subtree: conversations that end in
between are the members, rank over pairs ``()`` counts leaves, cumulative weights give the savings.

Nodes on the path to a shard's border go on in the next shard: its spine. How deep neighbouring shards
share a path is worked out first, so each shard knows which of its nodes are spines and in which shard
each was opened; (shard opened in, depth) names a spine node everywhere. Shards report what they know
of a spine node without its spine descendants, the reports are merged by name, and the merged nodes
are added up over their subtrees, which are ranges of (shard, depth) again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boursecraft.session import materialise

#: Turns that a shard is aimed at, where there are that many.
SHARD_TURNS = 1 << 17
#: Parentheses of one block of excess minima.
BLOCK = 64
DIGEST = 16

_NODES = (
    "kind string, shard long, depth int, conv_id long, n_convs long, chars long, n_children long, n_leaves long, saved long, "
    "ends string, opened long, up_opened long, parent_conv_id long, closed long"
)
_NAMES = [part.split()[0] for part in _NODES.split(", ")]
_TYPES = [{"string": pa.string(), "long": pa.int64(), "int": pa.int32()}[part.split()[1]] for part in _NODES.split(", ")]


# ---- parentheses -------------------------------------------------------------------------------

class Parentheses:
    """A balanced sequence with a tree of minima over blocks of its excess."""

    def __init__(self, opens: np.ndarray):
        self.opens = opens
        self.excess = np.cumsum(np.where(opens, 1, -1))
        blocks = max(1, -(-len(opens) // BLOCK))
        self.width = 1 << (blocks - 1).bit_length()
        padded = np.full(self.width * BLOCK, 1 << 60, np.int64)
        padded[: len(opens)] = self.excess
        self.padded = padded
        self.least = np.full(2 * self.width, 1 << 60, np.int64)  # a heap: node k over 2k and 2k + 1
        self.least[self.width :] = padded.reshape(-1, BLOCK).min(1)
        for k in range(self.width.bit_length() - 2, -1, -1):
            level = self.least[2 << k : 4 << k]
            self.least[1 << k : 2 << k] = np.minimum(level[::2], level[1::2])
        self.pairs = np.append(0, np.cumsum(opens[:-1] & ~opens[1:])) if len(opens) else np.zeros(0, np.int64)

    def _scan(self, at: np.ndarray, want: np.ndarray, out: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Look from ``at`` to the end of its block; gives the rows that found nothing."""
        stop = (at // BLOCK + 1) * BLOCK
        while len(rows):
            hit = self.padded[at] <= want
            out[rows[hit]] = at[hit]
            go = ~hit & (at + 1 < stop)
            lost = ~hit & ~go
            if lost.any():
                self._lost.append(rows[lost])
            at, want, rows, stop = at[go] + 1, want[go], rows[go], stop[go]
        return rows

    def findclose(self, at: np.ndarray) -> np.ndarray:
        """The position that closes each open parenthesis: the first behind it with a lower excess."""
        out, self._lost = np.full(len(at), -1, np.int64), []
        want = self.excess[at] - 1
        edge = (at + 1) % BLOCK == 0
        inside = np.flatnonzero(~edge)
        self._scan(at[inside] + 1, want[inside], out, inside)
        rows = np.concatenate([np.flatnonzero(edge), *self._lost]).astype(np.int64)
        if not len(rows):
            return out
        # up the heap while no right neighbour is low enough, then down to its first low block
        node, low = at[rows] // BLOCK + self.width, want[rows]
        climbing = np.arange(len(rows))
        while len(climbing):
            here = node[climbing]
            left = here % 2 == 0
            found = left & (self.least[np.minimum(here + 1, 2 * self.width - 1)] <= low[climbing])
            node[climbing] = np.where(found, here + 1, here >> 1)
            climbing = climbing[~found]
        while True:
            above = np.flatnonzero(node < self.width)
            if not len(above):
                break
            child = 2 * node[above]
            node[above] = np.where(self.least[child] <= low[above], child, child + 1)
        self._scan((node - self.width) * BLOCK, low, out, rows)
        return out


class RangeMinimum:
    """Least value of ranges, from minima of all ranges whose length is a power of two."""

    def __init__(self, values: np.ndarray):
        self.levels = [values]
        while 2 ** len(self.levels) <= len(values):
            last, half = self.levels[-1], 2 ** (len(self.levels) - 1)
            self.levels.append(np.minimum(last[:-half], last[half:]))

    def least(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        out = np.zeros(len(start), np.int64)
        level = np.frexp((stop - start).astype(np.float64))[1] - 1
        for k in np.unique(level):
            rows = level == k
            out[rows] = np.minimum(self.levels[k][start[rows]], self.levels[k][stop[rows] - (1 << k)])
        return out


def common(a: bytes, b: bytes) -> int:
    """How many turns two sequences share from the start."""
    n = min(len(a), len(b)) // DIGEST
    if a[: n * DIGEST] == b[: n * DIGEST]:
        return n
    x, y = (np.frombuffer(s, np.uint8, n * DIGEST).reshape(n, DIGEST) for s in (a, b))
    return int((x != y).any(1).argmax())


class ShardTrie:
    """Nodes, in preorder, of the sorted sequences of one shard."""

    def __init__(self, ids: np.ndarray, sequences: list[bytes], chars: list[np.ndarray]):
        self.ids = ids
        self.length = length = np.array([len(s) // DIGEST for s in sequences], np.int64)
        shared = np.array([common(a, b) for a, b in zip(sequences, sequences[1:])], np.int64)
        before, behind = np.append(-1, shared), np.append(shared, -1)
        opened, closed = length - before, length - behind
        counts = np.stack([opened, closed], 1).ravel()
        self.opens = np.repeat(np.tile([True, False], len(ids)), counts)
        self.tree = Parentheses(self.opens)
        self.at = np.flatnonzero(self.opens)
        self.close = self.tree.findclose(self.at)
        owner = np.repeat(np.arange(len(ids)), opened)  # the conversation that opens each node
        self.depth = before[owner] + 1 + np.arange(len(owner)) - np.repeat(np.cumsum(opened) - opened, opened)
        flat = np.concatenate([np.append(0, c) for c in chars])
        self.chars = flat[np.repeat(np.cumsum(length + 1) - length - 1, opened) + self.depth]
        ends = np.cumsum(counts)[::2] - 1  # the last position at which a conversation still opens
        self.first, self.stop = np.searchsorted(ends, self.at), np.searchsorted(ends, self.close)
        self.members = self.stop - self.first
        self.least = RangeMinimum(ids).least(self.first, self.stop)
        size = (self.close - self.at + 1) // 2
        self.last = np.arange(len(size)) + size  # preorder end of each subtree
        span = len(size) + 1
        keys = np.sort(self.depth * span + np.arange(len(size)))
        before_key = np.searchsorted(keys, (self.depth - 1) * span + np.arange(len(size))) - 1
        self.parent = np.where(self.depth > 0, keys[np.maximum(before_key, 0)] % span, -1)
        self.shared = shared

    def path(self, conversation: int) -> np.ndarray:
        """The nodes, from the root on, that a conversation is a member of."""
        stop = np.searchsorted(self.first, conversation, side="right")  # nodes open in order of their first member
        return np.flatnonzero(self.stop[:stop] > conversation)

    def ends(self) -> tuple[np.ndarray, list[str]]:
        """(node, identifiers joined) of each distinct sequence: its conversations in ascending order."""
        starts = np.flatnonzero(np.append(True, self.length[1:] > self.shared))
        opened = np.cumsum(self.length - np.append(-1, self.shared))
        texts = list(map(str, self.ids.tolist()))
        edges = [*starts.tolist(), len(texts)]
        return opened[starts] - 1, [",".join(texts[a:b]) for a, b in zip(edges, edges[1:])]


class Borders:
    """What shards know of each other: how deep each shares a path with the one before (``left``) and,
    inside itself, from its first to its last sequence (``within``). A few numbers for each shard."""

    def __init__(self, left: list[int], within: list[int]):
        self.left = [*left, -1]
        self.through = [min(a, b) for a, b in zip(left, within)]  # paths up to here pass the shard
        self.kept = [min(t, a) for t, a in zip(self.through, self.left[1:])]  # and go on behind it
        n = len(left)
        self.before, self.behind = [-1] * n, [n] * n  # the nearest shard with a lower number
        for k in range(n):
            at = k - 1
            while at >= 0 and self.through[at] >= self.through[k]:
                at = self.before[at]
            self.before[k] = at
        for k in range(n - 1, -1, -1):
            at = k + 1
            while at < n and self.kept[at] >= self.kept[k]:
                at = self.behind[at]
            self.behind[k] = at

    def opener(self, shard: int, depth: int) -> int:
        """The shard that opened the node of this depth which is open at the left of ``shard``."""
        at = shard - 1
        while self.through[at] >= depth:
            at = self.before[at]
        return at

    def closer(self, shard: int, depth: int) -> int:
        """The shard that closes the node of this depth which ``shard`` opened and left open."""
        at = shard + 1
        while self.kept[at] >= depth:
            at = self.behind[at]
        return at


def _hex(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def shard_rows(place: int, ids: np.ndarray, sequences: list[bytes], chars: list[np.ndarray], borders: Borders) -> dict[str, list]:
    """What a shard says: its own nodes, those that hang below a spine node, and reports of spine nodes."""
    trie = ShardTrie(ids, sequences, chars)
    n, left, right = len(trie.at), borders.left[place], borders.left[place + 1]
    spine = np.zeros(n, bool)
    older, newer = trie.path(0), trie.path(len(ids) - 1)
    older, newer = older[trie.depth[older] <= left], newer[trie.depth[newer] <= right]
    spine[older] = spine[newer] = True
    opened = np.full(n, place, np.int64)
    opened[older] = [borders.opener(place, d) for d in trie.depth[older].tolist()]
    fresh = spine & (opened == place)
    closed = np.full(n, -1, np.int64)
    closed[fresh] = [borders.closer(place, d) for d in trie.depth[fresh].tolist()]

    weight = np.where(spine, 0, (trie.members - 1) * trie.chars)
    upto = np.append(0, np.cumsum(weight))
    saved = upto[trie.last] - upto[:-1]
    leaves = trie.tree.pairs[trie.close] - trie.tree.pairs[trie.at]
    has_parent = trie.parent >= 0
    children = np.bincount(trie.parent[has_parent], minlength=n)
    hangs = ~spine & has_parent
    hangs[hangs] = spine[trie.parent[hangs]]
    below = trie.parent[hangs]
    for values in (children, leaves, saved):  # of a spine node, only what hangs below it
        held = np.zeros(n, np.int64)
        np.add.at(held, below, values[hangs] if values is not children else 1)
        values[spine] = held[spine]

    ends: list[str | None] = [None] * n
    node, texts = trie.ends()
    for k, text in zip(node.tolist(), texts):
        ends[k] = text
    nothing = _hex("")
    ends = [e if s else nothing if e is None else _hex(e) for e, s in zip(ends, spine.tolist())]
    kind = np.where(spine, "spine", np.where(hangs, "hang", "node"))
    up_opened = np.where(has_parent, opened[trie.parent], -1)
    up_known = has_parent & ~spine & ~hangs
    said = lambda values, known: [v if k else None for v, k in zip(values.tolist(), known.tolist())]
    return {
        "kind": kind.tolist(), "shard": [place] * n, "depth": trie.depth.tolist(), "conv_id": trie.least.tolist(), "n_convs": trie.members.tolist(), "chars": trie.chars.tolist(),
        "n_children": children.tolist(), "n_leaves": leaves.tolist(), "saved": saved.tolist(), "ends": ends, "opened": said(opened, spine), "up_opened": said(up_opened, hangs | (fresh & has_parent)),
        "parent_conv_id": said(trie.least[trie.parent], up_known), "closed": said(closed, fresh),
    }


# ---- Spark -----------------------------------------------------------------------------------------

def turn_digest(role: Column, text: Column) -> Column:
    """Hex digest of a turn; the role's length keeps role and text apart."""
    return F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256), 1, 2 * DIGEST)


def sequences(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id and turns (digest, chars) of every conversation, ordered by turn, null first.

    Turns of one number follow their digests; null roles and texts are empty; rows without an
    identifier belong to no conversation and are left out. Texts end here: what is moved is 16 bytes
    a turn. A conversation's digests are one value, as a text is one.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    rows = conversations.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("conv_id"), F.struct(F.col(turn_col).isNotNull().alias("numbered"), F.coalesce(F.col(turn_col).cast("long"), F.lit(0)).alias("turn"), turn_digest(role, text).alias("digest"), F.length(text).cast("long").alias("chars")).alias("turn")
    )
    ordered = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("turn")).alias("turns"))
    return ordered.select("conv_id", F.transform("turns", lambda t: F.struct(t["digest"].alias("digest"), t["chars"].alias("chars"))).alias("turns"))


def rebuild(seqs: DataFrame, every: int = 100, most: int = 6) -> DataFrame:
    """Conversations that begin as another one does: conversation c takes its first h turns from
    c - c % every and goes on with its own behind h, where h is the checksum of c modulo ``most``."""
    first = F.col("conv_id") - F.col("conv_id") % every
    heads = seqs.where(F.col("conv_id") == first).select(F.col("conv_id").alias("_base"), F.slice("turns", 1, most).alias("_head"))
    own = seqs.withColumns({"_base": first, "_h": (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int")})
    head = F.coalesce(F.slice("_head", F.lit(1), F.col("_h")), F.expr("slice(turns, 1, 0)"))
    return own.join(heads, "_base", "left").select("conv_id", F.concat(head, F.slice("turns", F.col("_h") + 1, F.size("turns") + 1)).alias("turns"))


def _shards(seqs: DataFrame) -> DataFrame:
    """Stored rows by shard: conv_id, sequence (digests joined) and chars."""
    spark = seqs.sparkSession
    rows = materialise(seqs.select("conv_id", F.unhex(F.array_join(F.col("turns")["digest"], "")).alias("sequence"), F.col("turns")["chars"].alias("chars")), "sequences")
    turns = rows.agg(F.sum(F.size("chars"))).first()[0] or 0
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-turns // SHARD_TURNS))
    return materialise(rows.repartitionByRange(shards, "sequence", "conv_id").withColumn("shard", F.spark_partition_id().cast("long")), "trie-shards")


def _borders(stored: DataFrame) -> tuple[dict[int, int], Borders]:
    """(place of each shard that has rows, what they share). The driver reads two numbers a shard."""
    edges = stored.groupBy("shard").agg(F.min("sequence").alias("low"), F.max("sequence").alias("high"))
    edges = materialise(edges, "shard-edges")
    order = sorted(r["shard"] for r in edges.select("shard").collect())
    if not order:
        return {}, Borders([], [])
    follows = stored.sparkSession.createDataFrame(list(zip(order[1:], order)), "shard long, prior long")
    prior = edges.select(F.col("shard").alias("prior"), F.col("high").alias("prior_high"))
    pairs = edges.join(follows, "shard", "left").join(prior, "prior", "left").select("shard", "low", "high", "prior_high")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(s, -1 if p is None else common(p, a), common(a, b)) for s, a, b, p in zip(*(c.to_pylist() for c in batch.columns))]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], ["shard", "left", "within"])

    found = sorted(tuple(r) for r in pairs.mapInArrow(measure, "shard long, left long, within long").collect())
    return {s: k for k, s in enumerate(order)}, Borders([r[1] for r in found], [r[2] for r in found])


def _end_digests(reports: DataFrame) -> DataFrame:
    """Digest of the identifiers that end at each spine node, streamed shard by shard in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, state = None, None
        row = lambda: pa.RecordBatch.from_arrays([pa.array([name[0]], pa.int64()), pa.array([name[1]], pa.int32()), pa.array([state.hexdigest()])], ["opened", "depth", "ends_sha256"])
        for batch in batches:
            for opened, depth, _, ends in zip(*(c.to_pylist() for c in batch.columns)):
                if (opened, depth) == name:
                    state.update(b",")
                else:
                    if name is not None:
                        yield row()
                    name, state = (opened, depth), hashlib.sha256()
                state.update(ends.encode())
        if name is not None:
            yield row()

    parts = reports.where("ends IS NOT NULL").select("opened", "depth", "shard", "ends")
    return parts.repartition("opened", "depth").sortWithinPartitions("opened", "depth", "shard").mapInArrow(run, "opened long, depth int, ends_sha256 string")


def _merged(reports: DataFrame, shards: int) -> DataFrame:
    """Spine nodes: reports of one node put together, then sums over the subtrees among spine nodes."""
    spark = reports.sparkSession
    one = reports.groupBy("opened", "depth").agg(
        F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"), F.max("chars").alias("chars"), F.sum("n_children").alias("n_children"), F.sum("n_leaves").alias("n_leaves"),
        F.sum("saved").alias("saved"), F.max("up_opened").alias("up_opened"), F.max("closed").alias("closed"),
    )
    up = F.col("depth") - 1
    kids = one.where("up_opened IS NOT NULL").groupBy(F.col("up_opened").alias("opened"), up.alias("depth")).agg(F.count("*").alias("spine_children"))
    one = one.join(kids, ["opened", "depth"], "left").withColumn("n_children", F.col("n_children") + F.coalesce("spine_children", F.lit(0)))
    one = one.withColumns({"own_leaves": F.col("n_leaves") + (F.col("n_children") == 0).cast("long"), "own_saved": F.col("saved") + (F.col("n_convs") - 1) * F.col("chars")})
    one = materialise(one, "spines")
    # nodes below (opened, depth): deeper ones of that shard, and all of the shards until it closes
    totals = {r["opened"]: (r["l"], r["s"]) for r in one.groupBy("opened").agg(F.sum("own_leaves").alias("l"), F.sum("own_saved").alias("s")).collect()}
    before, leaves, saved = [], 0, 0
    for k in range(shards + 1):
        before.append((k, leaves, saved))
        more = totals.get(k, (0, 0))
        leaves, saved = leaves + more[0], saved + more[1]
    sums = spark.createDataFrame(before, "k long, leaves_before long, saved_before long")
    deeper = Window.partitionBy("opened").orderBy(F.desc("depth"))
    here = one.withColumns({"own_leaves": F.sum("own_leaves").over(deeper), "own_saved": F.sum("own_saved").over(deeper), "next": F.col("opened") + 1})
    start = sums.select(F.col("k").alias("next"), F.col("leaves_before").alias("l0"), F.col("saved_before").alias("s0"))
    stop = sums.select(F.col("k").alias("closed"), F.col("leaves_before").alias("l1"), F.col("saved_before").alias("s1"))
    full = here.join(start, "next").join(stop, "closed")
    parents = one.select(F.col("opened").alias("up_opened"), (F.col("depth") + 1).alias("depth"), F.col("conv_id").alias("parent_conv_id"))
    return full.join(parents, ["up_opened", "depth"], "left").select(
        "opened", "depth", "conv_id", "parent_conv_id", "n_convs", "n_children", (F.col("own_leaves") + F.col("l1") - F.col("l0")).alias("n_leaves"), (F.col("own_saved") + F.col("s1") - F.col("s0")).alias("saved")
    )


def build(seqs: DataFrame) -> DataFrame:
    """One row per distinct prefix of ``seqs`` (conv_id, turns): its members and its subtree.

    conv_id (smallest member; its first ``depth`` turns are the prefix), depth, parent_conv_id (null
    at the root), n_convs, n_children, n_leaves (nodes without children in the subtree), saved_tokens
    (over the subtree, characters of a node's last turn once for each member but one) and ends_sha256
    (identifiers of the conversations that end here, ascending). A conversation without turns is a
    member of the root; without conversations there are no rows. conv_id must be unique.
    """
    stored = _shards(seqs)
    places, borders = _borders(stored)
    shared = stored.sparkSession.sparkContext.broadcast((places, borders))

    def run(group: pa.Table) -> pa.Table:
        numbers, limits = shared.value
        ids, seq, chars = (group.column(c).to_pylist() for c in ("conv_id", "sequence", "chars"))
        order = sorted(range(len(ids)), key=lambda k: (seq[k], ids[k]))
        rows = shard_rows(numbers[group.column("shard")[0].as_py()], np.array([ids[k] for k in order], np.int64), [seq[k] for k in order], [np.array(chars[k], np.int64) for k in order], limits)
        return pa.Table.from_arrays([pa.array(rows[c], t) for c, t in zip(_NAMES, _TYPES)], _NAMES)

    said = materialise(stored.groupBy("shard").applyInArrow(run, _NODES), "trie-nodes")
    reports = said.where("kind = 'spine'")
    spines = materialise(_merged(reports, len(places)), "merged-spines")
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved"]
    own = said.where("kind = 'node'").select(*names, F.col("ends").alias("ends_sha256"))
    # each shard's spine nodes, so that a node which most shards hang from is no single key
    known = reports.select("shard", "opened", "depth").join(spines.select("opened", "depth", F.col("conv_id").alias("up")), ["opened", "depth"])
    known = known.select("shard", F.col("opened").alias("up_opened"), (F.col("depth") + 1).alias("depth"), "up")
    hanging = said.where("kind = 'hang'").join(known, ["shard", "up_opened", "depth"]).withColumn("parent_conv_id", F.col("up")).select(*names, F.col("ends").alias("ends_sha256"))
    across = spines.join(_end_digests(reports), ["opened", "depth"], "left").select(*names, F.coalesce("ends_sha256", F.lit(_hex(""))).alias("ends_sha256"))
    return own.unionByName(hanging).unionByName(across).withColumn("depth", F.col("depth").cast("long")).withColumnRenamed("saved", "saved_tokens")
