"""Toxicity from class-conditional Kneser-Ney bigrams of words.

Two models, one of toxic and one of ordinary documents. The chance of a word in a class follows from its continuation count:
how many different words it comes after, less a discount; the discounted mass goes to all words that either class has, alike.
A pair of words adds its own discounted count after the first word; the weight of the backoff after a word is what both classes
together leave over there, so that a pair that neither class has often is judged by its second word. Toxic documents
are ordinary text with toxic expressions in it, so their model is a mixture of both, of which MIXTURE is the toxic part; that
also keeps what all words of a text have in common, as its language, out of the comparison. A document's score is a logistic
function of the difference of its length-normalised log-likelihoods.

The models are a table of words and pairs that grows with the input. Its most frequent rows, a fixed number at most, are sent to
all executors with a filter of fixed size; only words and pairs that pass the filter and aren't among these are
joined to the table.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batch, byte_codes, chosen, crc_remainder, materialise, mix, releasing, steps, utf8, word_hashes, words

#: What a count loses: a word's of preceding words, and a pair's.
DISCOUNT, PAIR_DISCOUNT = 0.75, 2.0
#: Share of toxic expressions in the model of toxic documents.
MIXTURE = 0.01
#: Rows of the table that are sent to all executors at most, and bits of the filter as a power of two.
HEAD, FILTER_BITS = 1 << 22, 26
#: Bits of the first word in a pair's name; no context; bytes of text that are counted at once.
CONTEXT_BITS, STEP = 24, 16 << 20
ALONE = (1 << CONTEXT_BITS) - 1
#: Tasks at most over which the pairs of a word are spread.
SALTS = 16
#: Labels up to which they are sent to all executors; more are joined by a shuffle.
BROADCAST_ROWS = 2_000_000
#: Documents, as expected, from which the logistic function is fitted.
FIT_ROWS = 40_000

_U = np.uint64
_CODES = byte_codes(8, fold_case=True)
_PUNCTUATION = np.zeros(256, dtype=bool)
_PUNCTUATION[[i for i in range(33, 127) if not chr(i).isalnum()]] = True


class Model(NamedTuple):
    tail: DataFrame  # (step, some, all): what a word, or a pair beside its word, adds to the log-likelihoods' difference
    steps: np.ndarray  # those of the most frequent, sorted
    values: dict[str, np.ndarray]  # theirs, by the models of some training rows and of all
    filters: tuple[np.ndarray, np.ndarray]  # bits of all steps, and of those in the tail


def pairs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names of the word pairs that end at each word of a step of rows, and where each row's words begin. The name of a word is in
    the upper 40 bits, that of the word before it in the others (0: none). Words are without case and outer punctuation."""
    starts, ends, first = words(data, offsets)
    live = np.arange(len(starts))
    while len(live):
        live = live[ends[live] - starts[live] > 1]
        tail, head = _PUNCTUATION[data[ends[live] - 1]], _PUNCTUATION[data[starts[live]]]
        ends[live] -= tail
        starts[live] += head & (ends[live] - starts[live] > 1)
        live = live[tail | head]
    word = word_hashes(data, starts, ends, _CODES, fold=True) >> _U(CONTEXT_BITS)
    before = np.concatenate([[_U(0)], mix(word[:-1]) % _U(ALONE - 1) + _U(1)]) if len(word) else word
    before[first[:-1][np.diff(first) > 0]] = 0
    return (word << _U(CONTEXT_BITS)) | before, first


def _pair_counts(rows: DataFrame) -> DataFrame:
    """(pair, n0, n1, m0, m1) of rows(text, toxic, part), for each step of rows: counts in ordinary and toxic rows, n of part 0 and m of part 1."""
    names = ("n0", "n1", "m0", "m1")
    schema = pa.schema([("pair", pa.int64()), *[(c, pa.int32()) for c in names]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in batches:
            data, offsets = utf8(some.column("text"))
            kinds = some.column("toxic").to_numpy(zero_copy_only=False) + 2 * some.column("part").to_numpy(zero_copy_only=False)
            for lo, hi in steps(offsets, STEP):
                found, kind, at = [], [], offsets[lo : hi + 1]
                for i, j in steps(at - at[0]):
                    own, first = pairs(data[at[i] : at[j]], at[i : j + 1] - at[i])
                    found.append(own)
                    kind.append(np.repeat(kinds[lo + i : lo + j].astype(np.uint8), np.diff(first)))
                found, kind = np.concatenate(found), np.concatenate(kind)
                order = np.argsort(found)
                found, kind = found[order], kind[order]
                new = np.flatnonzero(np.concatenate([[True], found[1:] != found[:-1]])) if len(found) else np.empty(0, np.int64)
                sums = {c: np.add.reduceat(kind == k, new, dtype=np.int32) if len(new) else new.astype(np.int32) for k, c in enumerate(names)}
                yield batch({"pair": found[new].view(np.int64), **sums}, schema)

    return rows.select("text", "toxic", "part").mapInArrow(releasing(run), "pair long, n0 int, n1 int, m0 int, m1 int")


def _over(count: Column, discount: float) -> Column:
    return F.greatest(count - F.lit(discount), F.lit(0.0))


def _statistics(found: DataFrame) -> DataFrame:
    """(kind, name, a0, a1, b0, b1, ka, kb, n) of found(pair, n0, n1, m0, m1): a is of part 0 and b of all, 0 of ordinary and 1 of
    toxic rows. Kind 0 are words with their continuation counts, 1 pairs that have more than their discount, 2 first words with
    the sums of their pairs and what these keep, in ka and kb. All three come from one shuffle of the pairs, by their second word and one of SALTS parts
    of the first words, so that a common word is in many tasks; its parts are summed up after.
    """
    word, salt = F.shiftrightunsigned("pair", CONTEXT_BITS), F.col("pair").bitwiseAND(SALTS - 1)
    # dealt out by expressions of the pair, so that only the pair is shuffled
    counts = found.repartition(word, salt).withColumns({"word": word, "salt": salt}).groupBy("word", "salt", "pair").agg(*[F.sum(c).alias(c) for c in ("n0", "n1", "m0", "m1")])
    counts = counts.select("word", "salt", "pair", F.col("n0").alias("a0"), F.col("n1").alias("a1"), (F.col("n0") + F.col("m0")).alias("b0"), (F.col("n1") + F.col("m1")).alias("b1"))
    kept = lambda x: _over(F.col(f"{x}0"), PAIR_DISCOUNT) + _over(F.col(f"{x}1"), PAIR_DISCOUNT)
    sides, none = ("a0", "a1", "b0", "b1"), F.lit(0.0)
    parts = counts.groupBy("word", "salt").agg(*[F.count(F.when(F.col(c) > 0, 1)).alias(c) for c in sides], F.sum(F.col("b0") + F.col("b1")).alias("n"))
    words_ = parts.groupBy("word").agg(*[F.sum(c).alias(c) for c in (*sides, "n")])
    often = counts.where(f"b0 > {PAIR_DISCOUNT} or b1 > {PAIR_DISCOUNT}")
    firsts = counts.groupBy(F.col("pair").bitwiseAND(ALONE).alias("before")).agg(*[F.sum(c).alias(c) for c in sides], F.sum(kept("a")).alias("ka"), F.sum(kept("b")).alias("kb"))
    out = words_.select(F.lit(0).alias("kind"), F.col("word").alias("name"), *sides, none.alias("ka"), none.alias("kb"), "n")
    out = out.unionByName(often.select(F.lit(1).alias("kind"), F.col("pair").alias("name"), *sides, none.alias("ka"), none.alias("kb"), (F.col("b0") + F.col("b1")).alias("n")))
    return out.unionByName(firsts.select(F.lit(2).alias("kind"), F.col("before").alias("name"), *sides, "ka", "kb", F.lit(0).cast("long").alias("n")))


def table(found: DataFrame) -> DataFrame:
    """(step, some, all, n) of found(pair, n0, n1, m0, m1): values by the models of part 0 and of all. A word's step is its name
    with ALONE, a pair's its name. Words and pairs that a model hasn't got have the value 0 in it."""
    every = materialise(_statistics(found))
    words_, often, firsts = (every.where(f"kind = {k}").drop("kind") for k in range(3))
    sums = words_.agg(*[F.count(F.when(F.col(f"{x}0") + F.col(f"{x}1") > 0, 1)).alias(f"{x}_types") for x in "ab"], *[F.sum(x + c).alias(f"{x}{c}_sum") for x in "ab" for c in "01"], *[F.count(F.when(F.col(x + c) > 0, 1)).alias(f"{x}{c}_types") for x in "ab" for c in "01"]).first()

    def chance(x: str, c: str) -> Column:  # of a word
        types = max(sums[f"{x}_types"], 1)
        if not sums[f"{x}{c}_sum"]:
            return F.lit(1.0 / types)
        return (_over(F.col(x + c), DISCOUNT) + F.lit(DISCOUNT * sums[f"{x}{c}_types"] / types)) / F.lit(float(sums[f"{x}{c}_sum"]))

    def after(x: str, c: str) -> Column:  # of a pair's second word
        rest = 1 - F.col(f"k{x}") / (F.col(f"f{x}0") + F.col(f"f{x}1"))
        return F.when(F.col(f"f{x}{c}") > 0, _over(F.col(x + c), PAIR_DISCOUNT) / F.col(f"f{x}{c}")).otherwise(0.0) + rest * F.col(f"p{x}{c}")

    gain = lambda p, x: F.log(F.lit(1 - MIXTURE) + F.lit(MIXTURE) * p(x, "1") / p(x, "0"))
    known = lambda x, least: (F.col(f"{x}0") > least) | (F.col(f"{x}1") > least)
    one = words_.select(F.shiftleft("name", CONTEXT_BITS).bitwiseOR(ALONE).alias("step"), *[F.when(known(x, 0), gain(chance, x)).otherwise(0.0).cast("float").alias(n) for x, n in (("a", "some"), ("b", "all"))], "n")
    firsts = firsts.select(F.col("name").alias("before"), *[F.col(x + c).alias(f"f{x}{c}") for x in "ab" for c in "01"], "ka", "kb")
    seconds = words_.select(F.col("name").alias("word"), *[chance(x, c).alias(f"p{x}{c}") for x in "ab" for c in "01"])
    often = often.drop("ka", "kb").withColumns({"word": F.shiftrightunsigned("name", CONTEXT_BITS), "before": F.col("name").bitwiseAND(ALONE)}).join(firsts, "before").join(seconds, "word")
    plain = lambda x, c: F.col(f"p{x}{c}")
    two = often.select(F.col("name").alias("step"), *[F.when(known(x, PAIR_DISCOUNT), gain(after, x) - gain(plain, x)).otherwise(0.0).cast("float").alias(n) for x, n in (("a", "some"), ("b", "all"))], "n")
    return one.unionByName(two)


def _place(step: Column) -> Column:
    """Bit of the filter for a step; places() is the same for arrays."""
    return F.shiftrightunsigned(step, CONTEXT_BITS).bitwiseXOR(step.bitwiseAND(ALONE) * 40503).bitwiseAND((1 << FILTER_BITS) - 1)


def places(step: np.ndarray) -> np.ndarray:
    return (((step >> _U(CONTEXT_BITS)) ^ ((step & _U(ALONE)) * _U(40503))) & _U((1 << FILTER_BITS) - 1)).astype(np.int64)


def _filter(rows: DataFrame) -> np.ndarray:
    bits = np.zeros(1 << (FILTER_BITS - 3), np.uint8)
    at = _place(F.col("step")) + 1  # bitmaps count from 1
    maps = rows.groupBy(F.bitmap_bucket_number(at).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits")).toArrow()
    for bucket, own in zip(maps["bucket"].to_pylist(), maps["bits"], strict=True):
        own = np.frombuffer(own.as_buffer(), np.uint8)
        bits[(bucket - 1) * len(own) : bucket * len(own)] = own
    return bits


def model(found: DataFrame) -> Model:
    """The models of found(pair, n0, n1, m0, m1)."""
    rows = materialise(table(found).withColumn("size", F.floor(8 * F.log2("n")).cast("int")))
    # the sizes whose rows together are HEAD at most, the greatest first
    least, left = 1 << 30, HEAD
    for r in sorted(rows.groupBy("size").count().collect(), key=lambda r: -r["size"]):
        left -= r["count"]
        if left < 0:
            break
        least = r["size"]
    head = rows.where(F.col("size") >= least).select("step", "some", "all").toArrow().sort_by("step")
    return Model(rows.where(F.col("size") < least).select("step", "some", "all"), head["step"].to_numpy(), {c: head[c].to_numpy() for c in ("some", "all")}, (_filter(rows), _filter(rows.where(F.col("size") < least))))


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of a slightly regularised logistic regression, by Newton's method."""
    scale = np.maximum(np.abs(x).mean(axis=0), 1e-9)
    x, w = x / scale, np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hess = (x * (p * (1 - p))[:, None]).T @ x + 1e-1 * np.eye(x.shape[1])
        move = np.linalg.solve(hess, x.T @ (y - p) - 1e-1 * w)
        w += move
        if np.abs(move).max() < 1e-8:
            break
    return w / scale


def scored(docs: DataFrame, by: Model, which: str = "all", carry: str = "doc_id") -> DataFrame:
    """(carry, ratio, n) of each row of docs(carry, text): the log-likelihoods' difference by the models of some training rows or of
    all, and words."""
    shared = docs.sparkSession.sparkContext.broadcast((by.steps, by.values[which], by.filters))
    schema = pa.schema([("row", pa.int64()), (carry, pa.int64()), ("n", pa.int64()), ("value", pa.float64()), ("step", pa.int64()), ("times", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, values, (bits, tail) = shared.value
        row = TaskContext.get().partitionId() << 32
        for rows in batches:
            data, offsets = utf8(rows.column("text"))
            for lo, hi in steps(offsets):
                found, first = pairs(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                size = np.diff(first)
                of, total = np.repeat(np.arange(hi - lo), size), np.zeros(hi - lo)
                far = []
                for step in (found | _U(ALONE), found):
                    place = places(step)
                    live = np.flatnonzero((bits[place >> 3] >> (place & 7).astype(np.uint8)) & 1)
                    own, inverse = np.unique(step[live].view(np.int64), return_inverse=True)
                    at = np.minimum(np.searchsorted(keys, own), max(len(keys) - 1, 0))
                    near = keys[at] == own if len(keys) else np.zeros(len(own), dtype=bool)
                    value = np.where(near, values[at], 0.0) if len(keys) else np.zeros(len(own))
                    total += np.bincount(of[live], weights=value[inverse], minlength=hi - lo)
                    place = places(own.view(_U))
                    wanted = (~near & ((tail[place >> 3] >> (place & 7).astype(np.uint8)) & 1).astype(bool))[inverse]
                    far.append((of[live][wanted], own[inverse][wanted]))
                own = np.concatenate([x for x, _ in far]), np.concatenate([x for _, x in far])
                names, times = np.unique(np.stack(own, axis=1), axis=0, return_counts=True) if len(own[0]) else (np.empty((0, 2), np.int64), np.empty(0, np.int64))
                m = hi - lo
                yield pa.RecordBatch.from_arrays([pa.array(row + np.arange(m)), rows.column(carry).slice(lo, m), pa.array(size), pa.array(total), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64())], schema=schema)
                k = len(names)
                yield pa.RecordBatch.from_arrays([pa.array(row + names[:, 0]), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.float64()), pa.array(names[:, 1]), pa.array(times)], schema=schema)
                row += m

    both = materialise(docs.select(F.col(carry).cast("long").alias(carry), "text").mapInArrow(releasing(run), f"row long, {carry} long, n long, value double, step long, times long"))
    far = both.where("step is not null").select("row", "step", "times").join(by.tail, "step").groupBy("row").agg(F.sum(F.col(which) * F.col("times")).alias("more"))
    return both.where("step is null").select("row", carry, "n", "value").join(far, "row", "left").select(carry, (F.col("value") + F.coalesce("more", F.lit(0.0))).alias("ratio"), "n")


def _mean() -> Column:
    return F.col("ratio") / F.greatest("n", F.lit(1))


def fit(docs: DataFrame, labels: DataFrame) -> tuple[Model, np.ndarray]:
    """Models of the labelled rows that aren't held out. The logistic function is fitted on rows of remainder 4 with models that
    don't count these, so that it sees texts as new ones; the score's models count all. Beside the models come weights a, b, c: a
    score is the logistic function of a + b * asinh(c * difference), where asinh keeps copies of a labelled text from outweighing
    all others. A document with several labels is toxic
    if one is."""
    known = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.expr("cast(toxic > 0 as int)")).alias("toxic"))
    known = materialise(known.where(crc_remainder() != 0))
    small = known.count() <= BROADCAST_ROWS
    rows = docs.select("doc_id", "text", F.expr("0").alias("part")).where((crc_remainder() != 0) & F.col("text").isNotNull()).join(F.broadcast(known) if small else known, "doc_id")
    rows = rows.withColumn("part", F.when(crc_remainder() == 4, 1).otherwise(0))
    by = model(_pair_counts(rows))
    n = max(1, known.where(crc_remainder() == 4).count())
    sample = rows.where((F.col("part") == 1) & (F.lit(n <= FIT_ROWS) | chosen(FIT_ROWS / n, "doc_id")))
    weights = np.array([0.0, 1.0, 1.0])
    found = scored(sample, by, "some", "toxic").select("toxic", _mean().alias("mean")).toPandas()
    if found["toxic"].nunique() > 1:
        scale = 1 / max(np.abs(found["mean"]).median(), 1e-9)
        weights = np.append(_logistic(np.stack([np.ones(len(found)), np.arcsinh(scale * found["mean"])], axis=1), found["toxic"].to_numpy(float)), scale)
    return by, weights


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted, and ratio (log-likelihoods' difference) and n (words).

    Null and empty texts get the score of no evidence. Without labels of both classes asinh of the ratio per word is the
    logistic function's argument. Repeated rows are scored each; extra columns are ignored; empty tables give an empty result.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    by, (a, b, c) = fit(docs, labels)
    score = 1 / (1 + F.exp(-(F.lit(float(a)) + F.lit(float(b)) * F.asinh(F.lit(float(c)) * _mean()))))
    out = scored(docs, by).withColumn("score", score)
    return out.select("doc_id", (crc_remainder() == 0).alias("held_out"), "score", F.expr("cast(score >= 0.5 as int)").alias("predicted"), "ratio", "n")
