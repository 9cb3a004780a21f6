"""Near-duplicate documents: tensored MinHash banding finds candidates, full shingle sets confirm them.

Two small collections of tables, each keyed by the minima of three hashes, are computed per distinct shingle set. A table of
the tensor product has a key of each collection, so TABLES**2 tables of six minima cost 6 * TABLES minima. Two sets meet in
a product table if and only if they meet in one table of each collection; keys that only one set has are dropped before the
product is formed. At similarity 0.75 a pair meets nowhere with a chance of 2 * (1 - 0.75**3)**24, under 4 in a million; at 0.3 a pair
meets with a chance of 0.23 and at 0.2 with 0.03, so that common passages don't make one cluster of all that have them.
Sets that meet form clusters; inside a cluster every pair of parts that isn't linked yet is compared on full sets, in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, byte_codes, materialise, mix, releasing, row_key, steps, utf8, word_hashes, words
from .components import components

#: Words of a shingle; a pair is linked if 100 * shared >= PERCENT * united.
WORDS, PERCENT = 5, 75
#: Tables of each collection, and minima in a table's key.
TABLES, MINIMA = 24, 3
#: Documents of a block that is compared with another in one step.
BLOCK = 192

_U = np.uint64
_CODES = byte_codes(4, fold_case=True)
_SEEDS = mix(np.arange(1, 2 * TABLES * MINIMA + 1, dtype=_U) * _U(0xD1B54A32D192ED03))
_SIGNED = pa.schema([("rk", pa.int64()), ("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_id", pa.int64()), ("keys", pa.list_(pa.int64()))])


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of the rows of a step, sorted in each row, and where each row's begin."""
    starts, ends, first = words(data, offsets)
    counts = np.diff(first)
    one = word_hashes(data, starts, ends, _CODES, fold=True)
    weights = mix(np.arange(11, 11 + WORDS, dtype=_U)) | _U(1)
    rows, hashes = [], []
    total = np.zeros(max(0, len(one) - WORDS + 1), _U)
    for j in range(WORDS):
        total += one[j : j + len(total)] * weights[j]
    begin = np.repeat(first[:-1], counts)[: len(total)]
    fits = np.arange(len(total)) + WORDS <= (begin + np.repeat(counts, counts)[: len(total)])
    rows.append(np.repeat(np.arange(len(counts)), counts)[: len(total)][fits])
    hashes.append(mix(total[fits]))
    for row in np.flatnonzero((counts > 0) & (counts < WORDS)):  # one shingle: the whole sequence
        own = one[first[row] : first[row + 1]]
        hashes.append(mix((own * weights[: len(own)]).sum(keepdims=True) + _U(len(own))))
        rows.append(np.array([row]))
    row, value = np.concatenate(rows), np.concatenate(hashes)
    order = np.argsort(value)
    order = order[np.argsort(row[order], kind="stable")]
    row, value = row[order], value[order]
    new = np.ones(len(row), dtype=bool)
    new[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    return value[new], np.searchsorted(row[new], np.arange(len(counts) + 1))


def _table_keys(value: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A row of 2 * TABLES table keys for each row with shingles; the lowest bit tells the collection."""
    filled = first[:-1][np.diff(first) > 0]
    keys = []
    for table in range(2 * TABLES):
        key = np.full(len(filled), table, _U)
        for i in range(MINIMA):
            seed = _SEEDS[table * MINIMA + i]
            key = mix(key + np.minimum.reduceat((value ^ seed) * (seed | _U(1)), filled)) if len(filled) else key
        keys.append((key & ~_U(1)) | _U(table % 2))
    return np.stack(keys, axis=1).view(np.int64)


def signatures(docs: DataFrame) -> DataFrame:
    """(rk, doc_id, n_shingles, set_id, keys) of docs(rk, doc_id, text); set_id names equal sets (null: no shingles)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            data, offsets = utf8(rows.column("text"))
            for lo, hi in steps(offsets):
                value, first = shingle_sets(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                size = np.diff(first)
                full = np.flatnonzero(size)
                sums = np.add.reduceat(mix(value + _U(77)), first[:-1][full]) if len(full) else np.empty(0, _U)
                set_id = np.zeros(hi - lo, np.int64)
                set_id[full] = mix(sums + size[full].astype(_U)).view(np.int64)
                keys = np.full(hi - lo, None, dtype=object)
                for row, own in zip(full, _table_keys(value, first), strict=True):
                    keys[row] = own
                yield pa.RecordBatch.from_arrays([rows.column("rk").slice(lo, hi - lo), rows.column("doc_id").slice(lo, hi - lo), pa.array(size.astype(np.int64)), pa.array(set_id, mask=size == 0), pa.array(keys.tolist(), _SIGNED.field("keys").type)], schema=_SIGNED)

    return docs.select("rk", "doc_id", "text").mapInArrow(releasing(run), "rk long, doc_id long, n_shingles long, set_id long, keys array<long>")


def candidate_clusters(sets: DataFrame) -> DataFrame:
    """(set_id, cluster) of the sets(set_id, keys) that meet another in a product table, directly or over others."""
    # a key is named by the least set that has it: sets that share a key share its name, and a large group has few names
    keyed = sets.select("set_id", F.explode("keys").alias("key"))
    named = materialise(keyed.groupBy("key").agg(F.min("set_id").alias("lead"), F.max("set_id").alias("most")).where("lead < most").select("key", "lead"))
    met = keyed.join(named, "key").groupBy("set_id").agg(F.collect_set(F.expr("if(key & 1 = 0, lead, null)")).alias("left"), F.collect_set(F.expr("if(key & 1 = 1, lead, null)")).alias("right"))
    met = met.where("size(left) > 0 and size(right) > 0")
    product = met.select("set_id", "right", F.explode("left").alias("l")).select("set_id", "l", F.explode("right").alias("r")).select("set_id", F.xxhash64("l", "r").alias("table"))
    product = materialise(product)
    leaders = product.groupBy("table").agg(F.min("set_id").alias("lead"), F.max("set_id").alias("most")).where("lead < most").select("table", "lead")
    # a set has TABLES**2 leads at most, all less than itself; it keeps an edge to the least, and the others hang on that one,
    # which a large group's sets have in common: so the edges that every round of components() shuffles are few
    led = product.join(leaders, "table").where("set_id <> lead").groupBy("set_id").agg(F.collect_set("lead").alias("leads")).withColumn("least", F.array_min("leads"))
    stars = led.select(F.explode(F.expr("array_append(transform(leads, x -> struct(least as a, x as b)), struct(set_id as a, least as b))")).alias("e")).select("e.*").where("a <> b").distinct()
    return components(stars).select(F.col("node").alias("set_id"), F.col("root").alias("cluster"))


def _links(query: list[np.ndarray], data: list[np.ndarray]) -> np.ndarray:
    """Whether each query set is linked with each data set."""
    nq, nd = np.array([len(x) for x in query]), np.array([len(x) for x in data])
    names, code = np.unique(np.concatenate([*query, *data]), return_inverse=True)
    q = np.zeros((len(query), len(names)), np.float32)
    q[np.repeat(np.arange(len(query)), nq), code[: nq.sum()]] = 1
    shared = np.empty((len(query), len(data)), np.int64)
    own = code[nq.sum() :]
    ends = np.cumsum(nd)
    for j, (end, n) in enumerate(zip(ends, nd, strict=True)):
        shared[:, j] = q[:, own[end - n : end]].sum(axis=1)
    return 100 * shared >= PERCENT * (nq[:, None] + nd[None, :] - shared)


def _compare(pdf: pd.DataFrame) -> pd.DataFrame:
    """Star edges that link what the full sets of two blocks (or one with itself) link. Large sets go a few at a time."""
    query, data = pdf[pdf["asks"]], pdf[~pdf["asks"]]
    data_sets = [np.asarray(x) for x in data["shingles"]]
    data_ids = data["set_id"].to_numpy()
    edges: list[tuple[int, int]] = []
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = x = root[root[x]]
        return x

    held: list[tuple[int, np.ndarray]] = []

    def flush() -> None:
        linked = _links([s for _, s in held], data_sets) if held and data_sets else np.zeros((0, 0), dtype=bool)
        for i, j in zip(*np.nonzero(linked), strict=True):
            a, b = find(int(held[i][0])), find(int(data_ids[j]))
            if a != b:
                root[a] = b
                edges.append((int(held[i][0]), int(data_ids[j])))
        held.clear()

    cells = sum(map(len, data_sets))
    for key, shingles in zip(query["set_id"], query["shingles"], strict=True):
        held.append((key, np.asarray(shingles)))
        cells += len(held[-1][1])
        if cells * len(held) > 8_000_000:
            flush()
            cells = sum(map(len, data_sets))
    flush()
    return pd.DataFrame(edges, columns=["a", "b"], dtype="int64")


def _compared(query: DataFrame, data: DataFrame) -> DataFrame:
    """Edges between query(set_id, cluster, shingles, block, blocks, query_blocks) and all data of their cluster."""
    asks = query.select("set_id", "cluster", "shingles", F.lit(True).alias("asks"), F.col("block").alias("i"), F.explode(F.expr("sequence(0, blocks - 1)")).alias("j"))
    told = data.select("set_id", "cluster", "shingles", F.lit(False).alias("asks"), F.explode(F.expr("sequence(0, query_blocks - 1)")).alias("i"), F.col("block").alias("j"))
    return asks.unionByName(told).groupBy("cluster", "i", "j").applyInPandas(lambda pdf: _compare(pdf), "a long, b long")


def _blocks(sets: DataFrame, by: str, name: str) -> DataFrame:
    sizes = sets.groupBy("cluster").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias(name))
    return sets.join(sizes, "cluster")


def linked_sets(sets: DataFrame) -> DataFrame:
    """(set_id, root) for sets(set_id, cluster, shingles) that are linked with another of their cluster.

    First each block is compared with itself. Then one set of each part found is compared with the whole cluster. What
    is still outside a cluster's largest part after that is compared with the whole cluster.
    """
    sets = materialise(_blocks(sets, "cluster", "blocks").withColumn("block", F.expr("cast(pmod(xxhash64(set_id, 7), blocks) as int)")))
    both = sets.select("cluster", "set_id", "shingles", "block", F.explode(F.array(F.lit(True), F.lit(False))).alias("asks"))
    edges = materialise(both.groupBy("cluster", "block").applyInPandas(lambda pdf: _compare(pdf), "a long, b long"))
    many = sets.where("blocks > 1")
    if not many.limit(1).count():
        return components(edges).select(F.col("node").alias("set_id"), "root")
    for last in (False, True):
        roots = components(edges).select(F.col("node").alias("set_id"), "root")
        parts = materialise(many.drop("shingles").join(roots, "set_id", "left").withColumn("root", F.coalesce("root", "set_id")))
        sizes = parts.groupBy("cluster", "root").count()
        open_ = sizes.groupBy("cluster").agg(F.count("*").alias("parts"), F.max(F.struct("count", "root")).alias("top")).where("parts > 1").select("cluster", F.col("top.root").alias("top"))
        asks = parts.join(open_, "cluster").where("root <> top" if last else "set_id = root").select("cluster", "set_id")
        asks = materialise(_blocks(asks, "cluster", "query_blocks"))
        if not asks.limit(1).count():
            break
        query = many.join(asks, ["cluster", "set_id"]).withColumn("block", F.expr("cast(pmod(xxhash64(set_id, 9), query_blocks) as int)"))
        data = many.join(asks.select("cluster", "query_blocks").distinct(), "cluster")
        edges = materialise(edges.unionByName(_compared(query, data)))
    return components(edges).select(F.col("node").alias("set_id"), "root")


def _sets_of(docs: DataFrame) -> DataFrame:
    """(set_id, cluster, shingles) of docs(set_id, cluster, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            data, offsets = utf8(rows.column("text"))
            for lo, hi in steps(offsets):
                value, first = shingle_sets(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                yield pa.RecordBatch.from_arrays([rows.column("set_id").slice(lo, hi - lo), rows.column("cluster").slice(lo, hi - lo), pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(value.view(np.int64)))], names=["set_id", "cluster", "shingles"])

    return docs.select("set_id", "cluster", "text").mapInArrow(releasing(run), "set_id long, cluster long, shingles array<long>")


def classes(docs: DataFrame) -> DataFrame:
    """Per row: rk, doc_id, n_shingles, component_id, kept.

    A null text has no words: such a row, or one of white space, is a component of its own. Null ids count as larger than
    all others. Rows with the same id and text are one class; `kept` is true for each row whose id is component_id.
    """
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("rk", row_key())
    signed = materialise(signatures(keyed))
    # one row stands for all of a class; equal keys make first() one value
    sets = materialise(signed.where("set_id is not null").groupBy("set_id").agg(F.min("doc_id").alias("least"), F.min("rk").alias("rk"), F.first("keys").alias("keys")))
    clusters = candidate_clusters(sets.select("set_id", "keys"))
    wanted = sets.join(clusters, "set_id").select("rk", "set_id", "cluster")
    linked = linked_sets(_sets_of(keyed.join(wanted, "rk").dropDuplicates(["set_id"])))
    rooted = materialise(sets.select("set_id", "least").join(linked, "set_id", "left").withColumn("root", F.coalesce("root", "set_id")))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(least, "root").select("set_id", "component_id")
    alone = signed.where("set_id is null").select("rk", "doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    rest = signed.where("set_id is not null").join(named, "set_id").select("rk", "doc_id", "n_shingles", "component_id")
    return rest.unionByName(alone).withColumn("kept", F.expr("doc_id <=> component_id"))


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row; an empty table gives an empty result.

    Null and empty texts have no shingles and are linked with nothing; rows with equal id and text have equal results; null ids
    count as larger than all others; extra columns are ignored; texts of any length have all their shingles.
    """
    return classes(docs).drop("rk")


def deduplicate(docs: DataFrame) -> DataFrame:
    """The rows of docs whose id names their component; of rows with equal id and text one stays. Columns stay as they are."""
    names = docs.columns
    apart = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("rk", row_key())
    kept = classes(apart).where("kept").select("rk").distinct()
    return apart.join(kept, "rk", "left_semi").dropDuplicates(["rk"]).select("row.*")
