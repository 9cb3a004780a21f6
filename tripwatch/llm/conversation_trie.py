"""The trie of conversations' turns: what shared prefixes save, node by node.

Distinct conversations are sorted by their turns and dealt out in ranges. A shard, a bounded run of sorted conversations, writes
its trie as balanced parentheses. findclose, by blocks of 64 excess values and a range-min tree over them, delimits each
subtree; ranks of leaf pairs and cumulative arrays over the opening parentheses give leaves, members and savings of it. Only nodes
on a shard's first and last path, its spine, may have more elsewhere. They go on, with what the rest of the shard adds to each,
as two paths to the next level, where shards of spines are merged in the same way, until one shard holds them all.

A node is named by 128 bits, sums of hashes of its turns with their depths. Texts leave the first stage as hashes and word counts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, materialise, mix, releasing

#: Turns of a shard; a longer conversation is a shard with three others.
SHARD, LEAST_ROWS = 1 << 18, 4
#: Conversations c to c + 19 begin with turns of c.
FAMILY, MOST_SHARED = 20, 4
#: Ids of a piece of a member list: a node's list is hashed piece by piece.
PIECE_BITS = 12
BLOCK = 64

_U = np.uint64
_ROOT = bytes(16)
_NO_MEMBERS = hashlib.sha256(b"").hexdigest()
_NODE = "k1 long, k2 long, p1 long, p2 long, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
_SPINE = "path array<binary>, words array<long>, ends array<long>, low array<long>, leaves array<long>, saved array<long>, kids array<long>, sha array<string>"
_NODES, _SPINES = ([c.split()[0] for c in s.split(", ")] for s in (_NODE, _SPINE))
_LISTS = {"path": pa.list_(pa.binary()), "sha": pa.list_(pa.string())}


class Parentheses:
    """A balanced sequence, True for an opening one, with range-min blocks of its excess."""

    def __init__(self, bits: np.ndarray):
        self.excess = np.cumsum(np.where(bits, 1, -1)).astype(np.int32)
        full = np.full(-(-len(bits) // BLOCK) * BLOCK, np.iinfo(np.int32).max, np.int32)
        full[: len(bits)] = self.excess
        self.blocks = full.reshape(-1, BLOCK)
        self.tree = [self.blocks.min(1)]
        while len(self.tree[-1]) > 1:
            low = self.tree[-1]
            if len(low) % 2:
                low = self.tree[-1] = np.append(low, np.iinfo(np.int32).max)
            self.tree.append(np.minimum(low[::2], low[1::2]))

    def close(self, opens: np.ndarray) -> np.ndarray:
        """The closing parenthesis of each of some opening ones."""
        return np.concatenate([self._close(opens[i : i + 32768]) for i in range(0, len(opens), 32768)]) if len(opens) else opens

    def _close(self, opens: np.ndarray) -> np.ndarray:
        want, block = self.excess[opens] - 1, opens // BLOCK
        here = (self.blocks[block] <= want[:, None]) & (np.arange(BLOCK) > (opens % BLOCK)[:, None])
        found, out = here.any(1), block * BLOCK + here.argmax(1)
        rest = np.flatnonzero(~found)
        if len(rest):
            at, goal, level = block[rest].copy(), want[rest], np.full(len(rest), -1)
            for up, low in enumerate(self.tree[:-1]):  # climb to a right sibling that gets low enough
                open_ = np.flatnonzero(level < 0)
                right = np.minimum(at[open_] + 1, len(low) - 1)
                hit = (at[open_] % 2 == 0) & (low[right] <= goal[open_])
                at[open_[hit]], level[open_[hit]] = right[hit], up
                at[open_[~hit]] //= 2
            for down in range(len(self.tree) - 2, 0, -1):  # and down to its first block that does
                on = np.flatnonzero(level >= down)
                left = at[on] * 2
                at[on] = np.where(self.tree[down - 1][left] <= goal[on], left, left + 1)
            out[rest] = at * BLOCK + (self.blocks[at] <= goal[:, None]).argmax(1)
        return out


def _subtree_min(values: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The least of values[i : i + size[i]] for each i, by doubling."""
    out, step, level = values.copy(), 1, values
    done = size == 1
    while not done.all():
        if step > 1:
            level = np.minimum(level[: len(level) - step // 2], level[step // 2 :])
        fits = ~done & (size < 2 * step)
        i = np.flatnonzero(fits)
        out[i] = np.minimum(level[i], level[i + size[i] - step])
        done |= fits
        step *= 2
    return out


class Shard:
    """The trie of a run of sorted paths. Each position of a path adds to its node: members that end there, and, on higher
    levels, the least member, leaves, savings and children that a shard below has found off its spine."""

    def __init__(self, length: np.ndarray, turns: np.ndarray, words: np.ndarray, ends: np.ndarray, low: np.ndarray, leaves: np.ndarray, saved: np.ndarray, kids: np.ndarray, sha: np.ndarray):
        first = np.concatenate([[0], np.cumsum(length)])
        row = np.repeat(np.arange(len(length)), length)
        depth = np.arange(first[-1]) - first[row]
        before = first[np.maximum(row - 1, 0)] + depth
        shares = (row > 0) & (depth < np.concatenate([[0], length])[row])
        same = shares & (turns[np.minimum(before, first[-1] - 1)] == turns).all(1)
        common = np.minimum.reduceat(np.where(same, np.iinfo(np.int64).max, depth), first[:-1])
        common = np.minimum(common, length)
        new = depth >= common[row]
        # a position that isn't new is the last new one of its depth
        order = np.lexsort((row, depth))
        number = np.cumsum(new) - 1
        node = np.empty(len(row), np.int64)
        node[order] = number[order][np.maximum.accumulate(np.where(new[order], np.arange(len(order)), 0))]
        n = int(new.sum())
        self.count, self.new, self.depth, self.words = n, np.flatnonzero(new), depth[new], words[new]
        self.parent = np.where(self.depth > 0, node[self.new - 1], -1)
        name = np.cumsum(mix(turns + mix(depth.astype(_U) + _U(1))[:, None]), axis=0)
        name -= np.where(first[row][:, None] > 0, name[first[row] - 1], _U(0))
        self.key = name[new].view(np.int64)
        total = lambda x: np.bincount(node, weights=x, minlength=n).astype(np.int64) if np.abs(x).sum(dtype=np.float64) < 2**52 else _exact(node, x, n)
        self.ends, self.leaves, self.saved, self.kids = (total(x) for x in (ends, leaves, saved, kids))
        self.low = np.full(n, np.iinfo(np.int64).max)
        np.minimum.at(self.low, node, low)
        self.sha = np.full(n, None, object)
        told = np.flatnonzero(sha != None)  # noqa: E711
        self.sha[node[told]] = sha[told]
        self.turns, self.node, self.first = turns, node, first
        close = np.concatenate([[0], length[:-1] - common[1:], length[-1:]])
        opened = np.concatenate([length - common, [0]])
        self.bits = np.repeat(np.tile([False, True], len(length) + 1), np.stack([close, opened], 1).ravel())
        opens = np.flatnonzero(self.bits)
        closes = Parentheses(self.bits).close(opens)
        self.size = (closes - opens + 1) // 2
        pair = self.bits & ~np.append(self.bits[1:], True)
        pair[opens] &= self.kids == 0
        self.opens, self.closes, self.pair = opens, closes, pair

    def _sums(self, values: np.ndarray) -> np.ndarray:
        upto = np.concatenate([[0], np.cumsum(values)])
        at = np.arange(self.count)
        return upto[at + self.size] - upto[at]

    def solved(self, last: bool) -> tuple[dict[str, object], list[dict[str, object]]]:
        """Columns of the nodes that are whole, and the paths that go to the next level; the last level keeps none back."""
        rows = len(self.first) - 1
        spine = np.zeros(self.count, bool)
        if not last:
            for r in {0, rows - 1}:
                spine[self.node[self.first[r] : self.first[r + 1]]] = True
        n = self._sums(self.ends)
        low = _subtree_min(self.low, self.size)
        pair = self.pair.copy()
        pair[self.opens[spine]] = False
        rank = np.cumsum(pair)
        leaves = rank[self.closes] - rank[self.opens] + pair[self.opens] + self._sums(self.leaves)
        saved = self._sums(self.saved + np.where(spine, 0, (n - 1) * self.words))
        inner = np.flatnonzero(self.parent >= 0)
        kids = self.kids + np.bincount(self.parent[inner], minlength=self.count)
        i = np.flatnonzero(~spine)
        up = self.parent[i]
        known = (up >= 0) & ~spine[up]
        parent_key = np.where((up >= 0)[:, None], self.key[up], 0)
        sha = np.where(self.sha[i] == None, _NO_MEMBERS, self.sha[i])  # noqa: E711
        whole = {
            "k1": self.key[i, 0], "k2": self.key[i, 1], "p1": parent_key[:, 0], "p2": parent_key[:, 1], "conv_id": low[i], "depth": self.depth[i],
            "parent_conv_id": pa.array(low[up], mask=~known), "n_convs": n[i], "n_children": kids[i], "n_leaves": leaves[i], "saved_tokens": saved[i], "ends_sha256": pa.array(sha.tolist(), pa.string()),
        }
        if last:
            return whole, []
        below = np.flatnonzero(spine & (self.parent >= 0))
        off = {}
        for name, of in (("ends", n), ("leaves", leaves), ("saved", saved)):
            off[name] = of.copy()
            np.subtract.at(off[name], self.parent[below], of[below])
        off["kids"] = kids - np.bincount(self.parent[below], minlength=self.count)
        out, told = [], np.zeros(self.count, bool)
        for r in dict.fromkeys([0, rows - 1]):
            at = np.arange(self.first[r], self.first[r + 1])
            own = self.node[at]
            fresh = ~told[own]
            told[own] = True
            out.append({"path": [t.tobytes() for t in self.turns[at]], "words": self.words[own], "low": low[own], "sha": [x if f else None for x, f in zip(self.sha[own], fresh, strict=True)]} | {name: np.where(fresh, of[own], 0) for name, of in off.items()})
        return whole, out


def _exact(node: np.ndarray, x: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(n, np.int64)
    np.add.at(out, node, x)
    return out


def _shard(rows: list[pa.RecordBatch]) -> Shard:
    """A shard of the rows of a level; those of the first level have their values for the last position only."""
    table = pa.Table.from_batches(rows).combine_chunks()
    column = lambda n: table.column(n).combine_chunks() if table.column(n).num_chunks != 1 else table.column(n).chunk(0)
    path = column("path")
    length = np.diff(path.offsets.to_numpy()).astype(np.int64)
    turns = np.frombuffer(b"".join(path.flatten().to_pylist()), _U).reshape(-1, 2)
    flat = lambda n: column(n).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    words = flat("words")
    if pa.types.is_list(table.schema.field("ends").type):
        sha = np.array([*column("sha").flatten().to_pylist(), None], object)[:-1]
        return Shard(length, turns, words, *(flat(n) for n in ("ends", "low", "leaves", "saved", "kids")), sha)
    last, none = np.cumsum(length) - 1, np.zeros(len(words), np.int64)
    ends, low, sha = none.copy(), np.full(len(words), np.iinfo(np.int64).max), np.full(len(words), None, object)
    ends[last], low[last], sha[last] = column("ends").to_numpy(), column("low").to_numpy(), column("sha").to_pylist()
    return Shard(length, turns, words, ends, low, none, none, none, sha)


def _level(paths: DataFrame, last: bool, shard: int) -> DataFrame:
    """Whole nodes and spine paths, in one table, of sorted paths."""

    def written(rows: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole, spines = _shard(rows).solved(last)
        n = len(whole["k1"])
        lists = [_LISTS.get(c, pa.list_(pa.int64())) for c in _SPINES]
        if n:
            yield pa.RecordBatch.from_arrays([*[x if isinstance(x := whole[c], pa.Array) else pa.array(x, pa.int64()) for c in _NODES], *[pa.nulls(n, t) for t in lists]], names=_NODES + _SPINES)
        if spines:
            none = [pa.nulls(len(spines), pa.string() if c == "ends_sha256" else pa.int64()) for c in _NODES]
            yield pa.RecordBatch.from_arrays([*none, *[pa.array([s[c] for s in spines], t) for c, t in zip(_SPINES, lists, strict=True)]], names=_NODES + _SPINES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, size, count = [], 0, 0
        for rows in batches:
            at = np.concatenate([[0], np.cumsum(rows.column("path").value_lengths().to_numpy(zero_copy_only=False))])
            lo = 0
            for hi in range(1, len(rows) + 1):
                if not last and size + at[hi] - at[lo] >= shard and count + hi - lo >= LEAST_ROWS:
                    yield from written([*kept, rows.slice(lo, hi - lo)])
                    kept, size, count, lo = [], 0, 0, hi
            if lo < len(rows):
                kept.append(rows.slice(lo))
                size, count = size + at[-1] - at[lo], count + len(rows) - lo
        if kept:
            yield from written(kept)

    return paths.mapInArrow(releasing(run), f"{_NODE}, {_SPINE}")


def rebuilt(conversations: DataFrame) -> DataFrame:
    """(conv, path): each conversation with its first turns from the head of its family; path begins with the root's turn.

    A turn is a struct of t, 128 bits of its role and text, and w, the words of the text.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turn = F.struct(F.col("turn"), F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))).alias("t"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("w"))
    own = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv"), turn.alias("x")).groupBy("conv").agg(F.array_sort(F.collect_list("x"), _by_turn).alias("x"))
    own = own.select("conv", F.transform("x", lambda x: F.struct(x["t"].alias("t"), x["w"].alias("w"))).alias("own"))
    own = materialise(own)
    heads = own.where(F.col("conv") % FAMILY == 0).select(F.col("conv").alias("family"), F.slice("own", 1, MOST_SHARED - 1).alias("head"))
    h = (F.crc32(F.col("conv").cast("string").cast("binary")) % MOST_SHARED).cast("int")
    both = own.withColumn("family", F.col("conv") - F.col("conv") % FAMILY).join(heads, "family", "left").withColumn("h", h)
    root = F.array(F.struct(F.lit(_ROOT).alias("t"), F.lit(0).cast("long").alias("w")))
    return both.select("conv", F.concat(root, F.slice(F.coalesce("head", F.array().cast(dict(heads.dtypes)["head"])), F.lit(1), F.col("h")), F.slice("own", F.col("h") + 1, F.size("own"))).alias("path"))


def _by_turn(a: Column, b: Column) -> Column:
    """Order of turns: null first; ties go by the bits of role and text."""
    by_text = F.when(a["t"] < b["t"], -1).when(a["t"] > b["t"], 1).otherwise(0)
    return F.when(a["turn"].eqNullSafe(b["turn"]), by_text).when(a["turn"].isNull(), -1).when(b["turn"].isNull(), 1).when(a["turn"] < b["turn"], -1).otherwise(1)


def member_hashes(ends: DataFrame) -> DataFrame:
    """(name, sha) of ends(name, conv): SHA-256 of the ascending ids, joined by commas. Pieces of 4096 ids meet in order, as a hash is
    made in order; what a task holds of a node is one piece."""
    pieces = ends.groupBy("name", F.shiftright("conv", PIECE_BITS).alias("piece")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv")), lambda c: c.cast("string")), ",").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, sha = None, None
        for rows in batches:
            names, out = rows.column("name").to_pylist(), []
            for name, ids in zip(names, rows.column("ids").to_pylist(), strict=True):
                if name != own:
                    if sha:
                        out.append((own, sha.hexdigest()))
                    own, sha = name, hashlib.sha256(ids.encode())
                else:
                    sha.update(b"," + ids.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out]) for i in range(2)], names=["name", "sha"])
        if sha:
            yield pa.RecordBatch.from_arrays([pa.array([own]), pa.array([sha.hexdigest()])], names=["name", "sha"])

    return pieces.repartition("name").sortWithinPartitions("name", "piece").mapInArrow(run, "name string, sha string")


def nodes(paths: DataFrame, shard: int = SHARD) -> DataFrame:
    """The nodes of paths(conv, path), see digest."""
    spark = paths.sparkSession
    named = materialise(paths.withColumn("name", F.sha2(F.concat(*[F.to_json(F.transform("path", lambda x: F.base64(x["t"])))]), 256)))
    sha = member_hashes(named.select("name", "conv"))
    distinct = named.groupBy("name", "path").agg(F.count("*").alias("ends"), F.min("conv").alias("low")).join(sha, "name")
    level = distinct.select(F.col("path.t").alias("path"), F.col("path.w").alias("words"), "ends", "low", "sha").repartitionByRange("path").sortWithinPartitions("path")
    done, rows, last = [], None, False
    while True:
        got = materialise(_level(level, last, shard))
        done.append(got.where("k1 is not null").select(_NODES))
        spines = got.where("path is not null").select(_SPINES)
        size = spines.agg(F.count("*").alias("rows"), F.sum(F.size("path")).alias("turns")).first()
        if not size["rows"]:
            break
        # a shard of LEAST_ROWS paths or more leaves two; where hardly any shard has that many, one takes the rest
        last = size["turns"] <= shard or size["rows"] <= 16 or (rows is not None and size["rows"] > 0.7 * rows)
        rows = size["rows"]
        level = (spines.repartition(1) if last else spines.repartitionByRange("path")).sortWithinPartitions("path")
    every = done[0]
    for more in done[1:]:
        every = every.unionByName(more)
    # only spine nodes, which a later level has solved, have children elsewhere
    if len(done) == 1:
        return every
    above = done[1]
    for more in done[2:]:
        above = above.unionByName(more)
    above = materialise(above.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), (F.col("depth") + 1).alias("depth"), F.col("conv_id").alias("parent")))
    return every.join(above, ["p1", "p2", "depth"], "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "parent"))


def digest(conversations: DataFrame, shard: int = SHARD) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256), a row for each node.

    Null roles and texts count as empty, null turns come first, equal turns go by a hash of role and text, and repeated rows are
    turns of their own. Rows without a conv_id belong to no conversation and are left out; with no rows there is no root.
    Extra columns don't matter. Very long texts leave the first stage as 16 bytes and a count; a conversation is a unit, 24 bytes
    a turn.
    """
    return nodes(rebuilt(conversations.select("conv_id", "turn", "role", "text")), shard).select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def oracle_sql() -> str:
    """Prefixes as lists of hashes, and each node joined with those that it is a prefix of."""
    eight = ", ".join(["0::UBIGINT"] * 8)
    crc = f"xor(list_reduce(list_transform(string_split(CAST(conv AS VARCHAR), ''), lambda s: CAST(ascii(s) AS UBIGINT)), lambda x, y: list_reduce([{eight}], lambda p, q: xor(p >> 1, (p & 1) * 3988292384), xor(x, y)), 4294967295::UBIGINT), 4294967295::UBIGINT)"
    return f"""WITH t AS MATERIALIZED (SELECT conv_id AS conv, coalesce(turn, -9223372036854775808) AS turn, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS t, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS w FROM conversations WHERE conv_id IS NOT NULL),
own AS MATERIALIZED (SELECT conv, list({{'t': t, 'w': w}} ORDER BY turn, t) AS x FROM t GROUP BY conv),
r AS MATERIALIZED (SELECT o.conv, list_concat(list_slice(coalesce(b.x, []), 1, h), list_slice(o.x, h + 1, len(o.x))) AS x FROM (SELECT *, CAST({crc} % {MOST_SHARED} AS BIGINT) AS h FROM own) o LEFT JOIN own b ON b.conv = o.conv - o.conv % {FAMILY}),
p AS MATERIALIZED (SELECT conv, d, len(x) AS full_d, CASE WHEN d > 0 THEN x[d].w ELSE 0 END AS w, md5(array_to_string(list_transform(list_slice(x, 1, d), lambda z: z.t), ',')) AS name, CASE WHEN d > 0 THEN md5(array_to_string(list_transform(list_slice(x, 1, d - 1), lambda z: z.t), ',')) END AS up FROM (SELECT conv, x, unnest(range(0, len(x) + 1)) AS d FROM r)),
n AS MATERIALIZED (SELECT name, d, any_value(up) AS up, any_value(w) AS w, min(conv) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(CAST(conv AS VARCHAR), ',' ORDER BY conv) FILTER (WHERE full_d = d), '')) AS ends_sha256 FROM p GROUP BY name, d),
k AS MATERIALIZED (SELECT up AS name, d - 1 AS d, count(*) AS n_children FROM n WHERE d > 0 GROUP BY ALL),
m AS MATERIALIZED (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN k USING (name, d)),
a AS (SELECT DISTINCT b.name, b.d, c.name AS top, c.d AS top_d FROM p b JOIN p c ON b.conv = c.conv AND c.d <= b.d),
s AS (SELECT top AS name, top_d AS d, count(*) FILTER (WHERE n_children = 0) AS n_leaves, sum((n_convs - 1) * w) AS saved FROM a JOIN m USING (name, d) GROUP BY ALL)
SELECT m.conv_id, CAST(m.d AS BIGINT) AS depth, q.conv_id AS parent_conv_id, m.n_convs, m.n_children, n_leaves, CAST(saved AS BIGINT) AS saved_tokens, m.ends_sha256 FROM m JOIN s USING (name, d) LEFT JOIN m q ON q.name = m.up AND q.d = m.d - 1"""
