"""Language identification with a bit-sliced Bloom filter of n-grams.

All languages share the slots of one filter: a slot holds a bit mask, one bit a language (a mask for each 64 of them). The masks at an n-gram's slots,
ANDed, are the languages that contain it. A text's bits are counted per language and corrected for false positives.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .common import batch, chosen, crc_remainder, materialise, mix, releasing, steps, utf8

#: Bytes of an n-gram, slots of the filter as a power of two, and slots probed for an n-gram.
GRAM, SLOT_BITS, PROBES = 4, 21, 2
#: Labelled rows to learn from, for each language, as expected when rows are drawn by a hash of their id.
TRAIN_ROWS = 20_000
#: Least share of a language's n-grams; so a language has 1 / LEAST_SHARE n-grams at most. And least share against the language that has most of an n-gram.
LEAST_SHARE, AGAINST = 2e-5, 0.2
#: Least share of known n-grams that the pipeline keeps.
KNOWN = 0.2

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[[9, 10, 11, 12, 13]] = 32


class LanguageFilter(NamedTuple):
    languages: list[str]
    #: A row of slots for each 64 languages.
    masks: np.ndarray
    #: Chance that an n-gram which a language lacks seems to be in it.
    false_positive: np.ndarray


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """n-grams as integers and the range of each row's: a text of n bytes, blanks around it, has n."""
    rows = len(offsets) - 1
    flat = np.full(len(data) + 2 * rows + GRAM, 32, np.uint8)
    flat[np.arange(len(data)) + np.repeat(2 * np.arange(1, rows + 1), np.diff(offsets))] = _FOLD[data]
    out = np.zeros(len(flat) - GRAM + 1, np.uint32)
    for i in range(GRAM):
        out |= flat[i : i + len(out)].astype(np.uint32) << np.uint32(8 * i)
    start = offsets[:-1] + 2 * np.arange(rows)
    return out, start, start + np.diff(offsets)


def _slots(values: np.ndarray) -> list[np.ndarray]:
    spread = mix(values.astype(np.uint64))
    return [((spread >> np.uint64(i * SLOT_BITS)) & np.uint64((1 << SLOT_BITS) - 1)).astype(np.int64) for i in range(PROBES)]


def fit(docs: DataFrame, rows: int = TRAIN_ROWS) -> LanguageFilter:
    """The filter learnt from docs(doc_id, text, lang): rows with a language that aren't held out, about `rows` a language."""
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (crc_remainder() != 0)).select("doc_id", "text", "lang")
    sizes = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}
    if not sizes:
        return LanguageFilter([], np.zeros((1, 1 << SLOT_BITS), np.uint8), np.zeros(0))
    share = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, rows / n))])
    drawn = labelled.where((share[F.col("lang")] >= 1.0) | chosen(share[F.col("lang")], "doc_id"))
    schema = pa.schema([("lang", pa.string()), ("gram", pa.int64()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in batches:
            langs = some.column("lang").to_pylist()
            data, offsets = utf8(some.column("text"))
            for lo, hi in steps(offsets):
                values, start, end = grams(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                for lang in set(langs[lo:hi]):
                    own = [i for i in range(hi - lo) if langs[lo + i] == lang]
                    value, n = np.unique(np.concatenate([values[start[i] : end[i]] for i in own]), return_counts=True)
                    yield batch({"lang": [lang] * len(value), "gram": value, "n": n}, schema)

    counts = materialise(drawn.select("lang", "text").mapInArrow(releasing(count), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    totals = {r["lang"]: r["n"] for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    languages = sorted(totals, key=lambda x: (-sizes[x], x))
    if not languages:
        return LanguageFilter([], np.zeros((1, 1 << SLOT_BITS), np.uint8), np.zeros(0))
    total = F.create_map(*[F.lit(x) for lang, n in totals.items() for x in (lang, float(n))])
    shares = counts.withColumn("share", F.col("n") / total[F.col("lang")])
    most = shares.groupBy("gram").agg(F.max("share").alias("most"))
    known = shares.where(F.col("share") >= LEAST_SHARE).join(most, "gram").where(F.col("share") >= AGAINST * F.col("most")).select("lang", "gram").toPandas()
    return LanguageFilter(languages, *sliced([known["gram"][known["lang"] == lang].to_numpy(np.int64) for lang in languages]))


def sliced(grams_: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Masks of the filter of each language's n-grams, and the chance of a false positive for each."""
    kind = next(t for bits, t in ((8, np.uint8), (16, np.uint16), (32, np.uint32), (1 << 60, np.uint64)) if len(grams_) <= bits)
    bits = np.dtype(kind).itemsize * 8
    masks, fill = np.zeros((-(-len(grams_) // bits), 1 << SLOT_BITS), kind), np.zeros(len(grams_))
    for i, own in enumerate(grams_):
        for slots in _slots(own):
            masks[i // bits, slots] |= kind(1 << i % bits)
        fill[i] = ((masks[i // bits] >> kind(i % bits)) & kind(1)).mean()
    return masks, fill**PROBES


def scores(model: LanguageFilter, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Share of each row's n-grams that each language contains, corrected for false positives."""
    values, start, end = grams(data, offsets)
    first, *others = _slots(values)
    masks = model.masks[:, first]
    for slots in others:
        masks &= model.masks[:, slots]
    out = np.zeros((len(start), len(model.languages)))
    size = np.maximum(end - start, 1)
    for i, wrong in enumerate(model.false_positive):
        bits = masks.itemsize * 8
        sums = np.concatenate([[0], np.cumsum((masks[i // bits] >> masks.dtype.type(i % bits)) & masks.dtype.type(1), dtype=np.int64)])
        out[:, i] = np.maximum(0, ((sums[end] - sums[start]) / size - wrong) / (1 - wrong))
    return out


def predict(docs: DataFrame, model: LanguageFilter) -> DataFrame:
    """docs with lang_pred, lang_score (share of the best language in all) and lang_known (its share of the n-grams).

    A null text, or one without a letter, is `und` with score 0. Among equal scores the language with most rows wins.
    """
    names = [c for c in docs.columns]
    shared = docs.sparkSession.sparkContext.broadcast(model)
    ready = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.expr(r"coalesce(cast(text as string) rlike '\\p{L}', false)").alias("letters"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for rows in batches:
            data, offsets = utf8(pc.struct_field(rows.column("row"), [names.index("text")]).cast(pa.string()))
            letters = rows.column("letters").to_numpy(zero_copy_only=False)
            for lo, hi in steps(offsets):
                found = scores(model, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]) if model.languages else np.zeros((hi - lo, 1))
                best = found.argmax(axis=1)
                known = found[np.arange(len(best)), best]
                score = known / np.maximum(found.sum(axis=1), 1e-12)
                good = letters[lo:hi] & bool(model.languages)
                langs = [model.languages[b] if g else "und" for b, g in zip(best, good, strict=True)]
                yield pa.RecordBatch.from_arrays([rows.column("row").slice(lo, hi - lo), pa.array(langs), pa.array(np.where(good, score, 0.0)), pa.array(np.where(good, known, 0.0))], names=["row", "lang_pred", "lang_score", "lang_known"])

    schema = StructType([ready.schema["row"], StructField("lang_pred", StringType()), StructField("lang_score", DoubleType()), StructField("lang_known", DoubleType())])
    return ready.mapInArrow(releasing(run), schema)


def digest(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, held_out, lang_pred, score. Nulls in lang are no labels; a null id counts as an empty text in its
    remainder; repeated rows are judged each; extra columns are ignored; an empty table gives an empty result."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    out = predict(docs.select("doc_id", "text"), fit(docs))
    return out.select(F.col("row.doc_id").alias("doc_id"), (crc_remainder("row.doc_id") == 0).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


def keep_known(docs: DataFrame, least: float = KNOWN) -> DataFrame:
    """The rows of docs in a learnt language: not `und`, and at least `least` of the n-grams are the language's. Columns stay."""
    return predict(docs, fit(docs)).where(f"lang_pred <> 'und' and lang_known >= {least}").select("row.*")
