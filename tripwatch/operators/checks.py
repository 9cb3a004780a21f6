"""Checks of a matched statement against its pattern; each gives a label and a severity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.terms import CRITICAL, INCONSISTENCY, dist_kind


def _findings(*found: tuple[Column, str, int]) -> Column:
    """Array of (label, code) of the conditions that hold."""
    return F.array_compact(F.array(*[F.when(c, F.struct(F.lit(label).alias("label"), F.lit(code).alias("code"))) for c, label, code in found]))


def static_findings(kind: Column, value: Column, dtype: Column, lang: Column, st_kind: Column, st_value: Column, st_dtype: Column, st_lang: Column) -> Column:
    """Findings against a static pattern; datatypes on both sides are inferred ones."""
    literal, same_kind = st_kind == "literal", kind == st_kind
    return _findings(
        (~same_kind, "Resource Type Violation", INCONSISTENCY),
        (~literal & ~(value.eqNullSafe(st_value)), "Value Equality Violation", CRITICAL),
        (literal & ~(dtype.eqNullSafe(st_dtype)), "Data Type Violation", INCONSISTENCY),
        (literal & ~(value.eqNullSafe(st_value)), "Value Equality Violation", CRITICAL),
        (literal & lang.isNotNull() & st_lang.isNotNull() & (lang != st_lang), "Value Language Violation", INCONSISTENCY),
    )


def static_checks(pairs: DataFrame, patterns: DataFrame) -> DataFrame:
    """(graph_id, seq, stmt_ix, ap_id, label, code) of matched pairs against their static patterns."""
    known = patterns.select("graph_id", "ap_id", "st_kind", "st_value", "st_dtype", "st_lang")
    found = static_findings(F.col("o_kind"), F.col("o_value"), F.col("dtype_eff"), F.col("o_lang"), F.col("st_kind"), F.col("st_value"), F.col("st_dtype"), F.col("st_lang"))
    return pairs.join(known, ["graph_id", "ap_id"]).select("graph_id", "seq", "stmt_ix", "ap_id", F.inline(found))


def own_checks(pairs: DataFrame) -> DataFrame:
    """static_checks() of matched_messages' pairs, which have their pattern as `ap`: nothing is joined."""
    ap = [F.col(f"ap.{c}") for c in ("st_kind", "st_value", "st_dtype", "st_lang")]
    return pairs.select("graph_id", "seq", "stmt_ix", "ap_id", F.inline(static_findings(F.col("o_kind"), F.col("o_value"), F.col("dtype_eff"), F.col("o_lang"), *ap)))


def discrete_findings(kind: Column, dtype: Column, dist_dtype: Column, is_iri: Column) -> Column:
    """Findings against a discrete distribution, of IRIs or of literals of dist_dtype."""
    literal = kind == "literal"
    return _findings(
        (~literal & ~is_iri, "Resource Type Violation", CRITICAL),
        (literal & ~(dist_kind(dtype).eqNullSafe(F.lit("D"))), "Value Type Violation", INCONSISTENCY),
        (literal & ~(dtype.eqNullSafe(dist_dtype)), "Data Type Violation", INCONSISTENCY),
    )


def continuous_findings(kind: Column, dtype: Column, dist_dtype: Column) -> Column:
    """Findings against a continuous distribution of dist_dtype."""
    literal = kind == "literal"
    return _findings(
        (~literal, "Resource Type Violation", CRITICAL),
        (literal & ~(dist_kind(dtype).eqNullSafe(F.lit("C"))), "Value Type Violation", INCONSISTENCY),
        (literal & ~(dtype.eqNullSafe(dist_dtype)), "Data Type Violation", INCONSISTENCY),
    )


def outside(value: Column, lo: Column, hi: Column) -> Column:
    """Whether a value is out of the half-open interval (lo, hi]."""
    return (value <= lo) | (value > hi)
