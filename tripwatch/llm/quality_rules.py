"""Quality rules as a threshold table, compiled into one Spark projection without user functions."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Frequent short words of the corpus' languages (fixed values).
STOP_WORDS = (
    "a also an and are as at auf avec be but by ce con da das de dem den der des die do du e ein eine el en es est et eu "
    "for from har has have i ich il in is ist it la las le les lo los mit na nicht no not of on or para pas pour por que qui se sich "
    "that the this to un una und une von was with y zu"
).split()


#: As they stand in text; the plan looks words up as they are.
STOP_FORMS = sorted({f for w in STOP_WORDS for f in (w, w.capitalize(), w.upper())})


class Rule(NamedTuple):
    """A document fails if `metric` is below `least` or above `most` (None: no limit)."""

    name: str
    metric: str
    least: float | None
    most: float | None


#: Ratios are per word, per character or per line; a metric is a key of `metrics`.
RULES = (
    Rule("words", "n_words", 50, None),
    Rule("word_length", "mean_word_chars", 2, 12),
    Rule("symbols", "symbol_ratio", None, 0.15),
    Rule("stop_words", "stop_word_ratio", 0.02, None),
    Rule("letters", "letter_word_ratio", 0.5, None),
    Rule("repeated_words", "repeat_word_ratio", None, 0.5),
    Rule("repeated_lines", "dup_line_ratio", None, 0.5),
)

#: Word positions that fit beside a hash in 63 bits; longer texts take the general form.
_PLACES = 22
_HIGH = -(1 << _PLACES)


def _let(name: str, value: str, body: str) -> str:
    """SQL for body with name bound to value, which is computed once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _repeat_words(words: str) -> str:
    """SQL for the number of words in 3-word windows that the text has twice or more.

    Windows are hashed with their place in the low bits and sorted as plain integers: neighbours with equal high bits are
    suspects. Only suspects are compared as text, sorted by window and place; each covers up to three new words.
    """
    window = lambda i: f"concat_ws(' ', get(w, {i}), get(w, {i} + 1), get(w, {i} + 2))"
    places = "transform(sequence(0, size(w) - 3), i -> cast(i as bigint))"
    hashes = f"array_sort(transform(sequence(0, size(w) - 3), i -> (xxhash64({window('i')}) & {_HIGH}L) | i))"
    near = f"(k > 0 and (x & {_HIGH}L) = (get(h, k - 1) & {_HIGH}L)) or (x & {_HIGH}L) = (get(h, k + 1) & {_HIGH}L)"
    suspects = f"if(size(w) < {1 << _PLACES}, transform(filter(h, (x, k) -> {near}), x -> x & {(1 << _PLACES) - 1}), h)"
    sorted_ = f"array_sort(transform(s, p -> struct({window('cast(p as int)')} as g, p as p)))"
    twice = "array_sort(transform(filter(o, (x, k) -> (k > 0 and x.g = get(g, k - 1)) or x.g = get(g, k + 1)), x -> x.p))"
    total = "aggregate(transform(q, (p, k) -> least(3L, coalesce(get(q, k + 1), p + 3) - p)), 0L, (a, x) -> a + x)"
    body = _let("s", suspects, _let("o", sorted_, _let("g", "transform(o, x -> x.g)", _let("q", twice, total))))
    body = _let("h", f"if(size(w) < {1 << _PLACES}, {hashes}, {places})", body)
    return _let("w", words, f"if(size(w) < 3, 0L, {body})")


def metrics(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the ratios of RULES."""
    white = r"[\\x20\\x09-\\x0D]+"
    out = docs.withColumn("_t", F.coalesce(F.col(text).cast("string"), F.lit("")))
    out = out.withColumn("_w", F.expr(f"array_remove(split(_t, '{white}'), '')"))
    out = out.withColumn("n_words", F.size("_w").cast("long"))
    out = out.withColumn("n_repeat_words", F.expr(_repeat_words("_w")))
    out = out.withColumn("word_chars", F.expr("cast(char_length(array_join(_w, '')) as bigint)"))
    out = out.withColumn("n_symbols", F.expr("cast(char_length(_t) - char_length(regexp_replace(_t, '[#*$%&|<>]', '')) as bigint)"))
    out = out.withColumn("_l", F.expr(r"filter(split(_t, '\n', -1), l -> l rlike '[^\\x20\\x09-\\x0D]')"))
    out = out.withColumn("n_dup_lines", F.expr("cast(size(_l) - size(array_distinct(_l)) as bigint)"))
    stops = ", ".join(f"'{w}'" for w in STOP_FORMS)
    ratio = lambda a, b: F.expr(f"coalesce(try_divide(cast({a} as double), {b}), 0D)")
    out = out.withColumn("mean_word_chars", ratio("word_chars", "n_words")).withColumn("symbol_ratio", ratio("n_symbols", "word_chars"))
    out = out.withColumn("stop_word_ratio", ratio(f"size(filter(_w, x -> x in ({stops})))", "n_words"))
    out = out.withColumn("letter_word_ratio", ratio(r"size(filter(_w, x -> x rlike '\\p{L}'))", "n_words"))
    out = out.withColumn("repeat_word_ratio", ratio("n_repeat_words", "n_words")).withColumn("dup_line_ratio", ratio("n_dup_lines", "size(_l)"))
    return out.drop("_t", "_w", "_l")


def failed(rules: tuple[Rule, ...] = RULES) -> Column:
    """The names of the rules that a row of `metrics` fails, as one expression."""
    broken = []
    for r in rules:
        tests = ([F.col(r.metric) < F.lit(r.least)] if r.least is not None else []) + ([F.col(r.metric) > F.lit(r.most)] if r.most is not None else [])
        for t in tests:
            broken.append(F.when(t, F.lit(r.name)))
    return F.array_compact(F.array(*broken)) if broken else F.array().cast("array<string>")


def digest(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Per row: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept.

    A null or empty text has no words and fails the base; repeated rows are judged each; extra columns are
    ignored; an empty table gives an empty result; texts of any length are counted whole.
    """
    out = metrics(docs.select("doc_id", "text")).withColumn("base_failed", F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words"))
    out = out.withColumn("kept", ~F.col("base_failed") & (F.size(failed(rules)) == 0))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def oracle_sql() -> str:
    """DuckDB SQL for `digest` over `documents` with RULES."""
    stops = ", ".join(f"'{w}'" for w in STOP_FORMS)
    return f"""
WITH t AS (SELECT doc_id, row_number() OVER () AS k, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS w, list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')) AS l FROM t),
g AS (SELECT k, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT k, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
c AS (SELECT k, i, count(*) OVER (PARTITION BY k, g) AS n FROM g),
r AS (SELECT k, sum(least(3, coalesce(nxt - i, 3))) AS n FROM (SELECT k, i, lead(i) OVER (PARTITION BY k ORDER BY i) AS nxt FROM c WHERE n > 1) GROUP BY k),
m AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
  CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words, len(l) AS n_lines,
  len(list_filter(w, lambda x: x IN ({stops}))) AS n_stops, len(list_filter(w, lambda x: regexp_matches(x, '\\p{{L}}'))) AS n_letters
  FROM w LEFT JOIN r USING (k)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND word_chars / n_words BETWEEN 2 AND 12 AND CAST(n_symbols AS DOUBLE) / word_chars <= 0.15 AND CAST(n_stops AS DOUBLE) / n_words >= 0.02
  AND CAST(n_letters AS DOUBLE) / n_words >= 0.5 AND CAST(n_repeat_words AS DOUBLE) / n_words <= 0.5 AND coalesce(CAST(n_dup_lines AS DOUBLE) / nullif(n_lines, 0), 0) <= 0.5 AS kept
FROM b"""
