"""Document fingerprints by a homomorphic multiset hash: wide vectors of paragraphs, summed modulo powers of two.

A fingerprint has two parts. Eight lanes of 32 bits sum SHA-256 digests of the paragraphs (lines): equal multisets of
paragraphs have equal sums, whatever their order. 60 lanes of 32 bits sum the +1/-1 vectors hashed from the runs of up to
RUN words within the paragraphs' sentences: the cosine of two such sums estimates how much two texts share. Both are sums,
so the fingerprint of a document follows from inserted and deleted parts alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words of a run at most.
RUN = 6
#: Lanes of the two sums, and their modulus.
EQUAL_LANES, LIKE_LANES, MODULUS = 8, 60, 1 << 32
#: Lanes that one 64-bit sum holds side by side, and the bits of each.
_SIDE, _BITS = 3, 20

_STOP = r"\\x20\\x09-\\x0D.,;:!?"
_RUNS = f"[^{_STOP}]+(?:[\\\\x20\\\\x09]+[^{_STOP}]+){{0,{RUN - 1}}}"
_FIELD = (1 << _BITS) - 1
_ONES = sum(1 << (_BITS * k) for k in range(_SIDE))


def lanes(text: str) -> Column:
    """Array of EQUAL_LANES sums in [0, MODULUS) and LIKE_LANES signed sums of a string column; an empty text has zeros."""
    equal = f"transform(filter(split({text}, '\n'), x -> x <> ''), x -> sha2(x, 256))"
    runs = f"transform(regexp_extract_all({text}, '{_RUNS}', 0), x -> cast(conv(substr(sha2(x, 256), 1, 15), 16, 10) as bigint))"
    step = LIKE_LANES // _SIDE
    # few runs: three lanes are summed at once in fields of _BITS bits, which no sum fills; else each lane by itself
    side = f"""transform(array(transform(sequence(0, {step - 1}), j -> aggregate(hs, 0L, (a, h) -> a + (shiftright(h, j) & {_ONES}L)))),
        ss -> transform(sequence(0, {LIKE_LANES - 1}), i -> (shiftright(get(ss, i % {step}), {_BITS} * cast(i div {step} as int)) & {_FIELD}) * 2 - size(hs)))[0]"""
    single = f"transform(sequence(0, {LIKE_LANES - 1}), i -> aggregate(hs, 0L, (a, h) -> a + (shiftright(h, i) & 1)) * 2 - size(hs))"
    return F.expr(
        f"""concat(
        transform(array({equal}), hs -> transform(sequence(0, {EQUAL_LANES - 1}), j -> aggregate(hs, 0L, (a, h) -> (a + cast(conv(substr(h, 8 * j + 1, 8), 16, 10) as bigint)) & {MODULUS - 1}L)))[0],
        transform(array({runs}), hs -> if(size(hs) < {_FIELD}, {side}, {single}))[0])"""
    )


def combined(a: Column, b: Column, sign: int = 1) -> Column:
    """Lanes of the union of two multisets (sign 1), or of the first without the second (sign -1)."""
    return F.zip_with(a, b, lambda x, y: (x + sign * y).bitwiseAND(MODULUS - 1))


def fingerprint(sums: Column) -> Column:
    """The lanes modulo MODULUS as lowercase hex, eight digits each."""
    return F.array_join(F.transform(sums, lambda x: F.lower(F.lpad(F.hex(x.bitwiseAND(MODULUS - 1)), 8, "0"))), "")


def _signed(lane: str) -> str:
    return f"if(({lane} & {MODULUS - 1}L) >= {MODULUS // 2}L, ({lane} & {MODULUS - 1}L) - {MODULUS}L, {lane} & {MODULUS - 1}L)"


def product(a: str, b: str) -> Column:
    """Sum of the products of the likeness lanes of two lane arrays."""
    part = lambda v: f"slice({v}, {EQUAL_LANES + 1}, {LIKE_LANES})"
    return F.expr(f"aggregate(zip_with({part(a)}, {part(b)}, (p, q) -> cast({_signed('p')} as double) * {_signed('q')}), 0D, (s, x) -> s + x)")


def likeness(dot: str, a: str, b: str) -> Column:
    """Cosine from the products of two lane arrays with each other and themselves, 0 at least: of two empty ones 1, of one 0."""
    return F.expr(f"round(case when {a} = 0 and {b} = 0 then 1D when {a} = 0 or {b} = 0 then 0D else greatest(0D, least(1D, {dot} / (sqrt({a}) * sqrt({b})))) end, 6)")


def next_rows(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text, own) with next, a struct of text and own of the next row by descending id; the first follows the last.

    Rows are cut into ranges of ids. A range is ordered in one task, and gets a copy of the row that comes after it, so no
    task orders more than one range. Null ids come last; rows with equal ids go by their texts.
    """
    keyed = docs.withColumn("_id", F.coalesce("doc_id", F.lit(-(1 << 63))))
    n = keyed.count()
    parts = max(1, min(-(-n // 2_000), 20_000))
    cuts = keyed.select(F.percentile_approx("_id", F.array(*[F.lit(i / parts) for i in range(1, parts)]), 100_000)).first()[0] if parts > 1 else []
    cuts = sorted(set(cuts or []))
    cut = F.array(*[F.lit(c).cast("long") for c in cuts]) if cuts else F.array().cast("array<bigint>")
    # the range of an id is the number of cuts at or below it; binary search keeps the expression short
    ranged = keyed.withColumn("_part", F.expr("0") if not cuts else F.lit(0))
    if cuts:
        step = 1 << (len(cuts).bit_length() - 1)
        ranged = ranged.withColumn("_cuts", cut)
        while step:
            ranged = ranged.withColumn("_part", F.expr(f"if(_part + {step} <= {len(cuts)} and get(_cuts, _part + {step - 1}) <= _id, _part + {step}, _part)"))
            step >>= 1
        ranged = ranged.drop("_cuts")
    # the first row of each range in descending order, copied to the range before it
    heads = ranged.groupBy("_part").agg(F.max(F.struct("_id", "text", "own")).alias("h")).select("_part", "h.*")
    rank = heads.select("_part").collect()
    order = sorted((r[0] for r in rank), reverse=True)
    before = {p: order[i - 1] for i, p in enumerate(order)}
    move = F.create_map(*[F.lit(x) for p, q in before.items() for x in (p, q)]) if before else None
    if move is None:
        return docs.withColumn("next", F.struct("text", "own"))
    guests = heads.withColumn("_part", move[F.col("_part")]).select(F.lit(None).cast("long").alias("doc_id"), "text", "own", "_id", "_part", F.lit(1).alias("_guest"))
    window = "lead(struct(text, own)) over (partition by _part order by _guest, _id desc, text desc)"
    return ranged.withColumn("_guest", F.lit(0)).unionByName(guests).withColumn("next", F.expr(window)).where("_guest = 0").select("doc_id", "text", "own", "next")


def digest(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    A null text is empty; two empty texts are alike, an empty and another are not; repeated rows are judged each, and follow
    each other; extra columns are ignored; an empty table gives an empty result.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = next_rows(rows.withColumn("own", lanes("text"))).withColumn("n_chars", F.char_length("text").cast("long"))
    rows = rows.withColumn("cut", F.expr("cast(n_chars div 3 as int)")).withColumn("edited", F.expr("concat(substring(text, 1, cast(n_chars as int) - cut), substring(next.text, 1, cut))"))
    rows = rows.withColumn("changed", lanes("edited")).withColumn("after", F.col("next.own"))
    for name, a, b in (("oo", "own", "own"), ("cc", "changed", "changed"), ("aa", "after", "after"), ("oc", "own", "changed"), ("oa", "own", "after")):
        rows = rows.withColumn(name, product(a, b))
    return rows.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), fingerprint(F.col("own")).alias("fingerprint"), fingerprint(F.col("changed")).alias("edited_fingerprint"),
        likeness("oc", "oo", "cc").alias("near_edited"), likeness("oa", "oo", "aa").alias("near_next"),
    )


def oracle_sql() -> str:
    """DuckDB SQL for `digest` over `documents`."""
    stop = r"\x20\x09-\x0D.,;:!?"
    runs = rf"[^{stop}]+(?:[\x20\x09]+[^{stop}]+){{0,{RUN - 1}}}"
    equal = lambda t: f"list_transform(range({EQUAL_LANES}), lambda j: coalesce(list_sum(list_transform(list_filter(string_split({t}, chr(10)), lambda x: x <> ''), lambda x: CAST('0x' || substr(sha256(x), 8 * j + 1, 8) AS BIGINT))), 0) % {MODULUS})"
    hashes = lambda t: f"list_transform(regexp_extract_all({t}, '{runs}'), lambda x: CAST('0x' || substr(sha256(x), 1, 15) AS BIGINT))"
    like = lambda h: f"list_transform(range({LIKE_LANES}), lambda j: 2 * coalesce(list_sum(list_transform({h}, lambda x: (x >> j) & 1)), 0) - len({h}))"
    hexed = lambda e, k: f"array_to_string(list_transform(list_concat({e}, list_transform({k}, lambda v: (v + {MODULUS}) % {MODULUS})), lambda v: lpad(lower(to_hex(CAST(v AS BIGINT))), 8, '0')), '')"
    dot = lambda a, b: f"CAST(list_sum(list_transform(range({LIKE_LANES}), lambda j: CAST({a}[j + 1] AS DOUBLE) * {b}[j + 1])) AS DOUBLE)"
    near = lambda x, a, b: f"round(CASE WHEN {a} = 0 AND {b} = 0 THEN 1.0::DOUBLE WHEN {a} = 0 OR {b} = 0 THEN 0.0::DOUBLE ELSE greatest(0.0::DOUBLE, least(1.0::DOUBLE, {x} / (sqrt({a}) * sqrt({b})))) END, 6)"
    return f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
n AS (SELECT *, coalesce(lead(t) OVER o, first_value(t) OVER o) AS nt FROM t WINDOW o AS (ORDER BY doc_id DESC NULLS LAST, t DESC ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
e AS (SELECT *, length(t) AS n, substr(t, 1, length(t) - length(t) // 3) || substr(nt, 1, length(t) // 3) AS ed FROM n),
h AS (SELECT *, {hashes('t')} AS ho, {hashes('ed')} AS hc, {hashes('nt')} AS ha FROM e),
v AS (SELECT doc_id, n, ed, {equal('t')} AS eo, {equal('ed')} AS ec, {like('ho')} AS o, {like('hc')} AS c, {like('ha')} AS a FROM h),
d AS (SELECT *, {dot('o', 'o')} AS oo, {dot('c', 'c')} AS cc, {dot('a', 'a')} AS aa, {dot('o', 'c')} AS oc, {dot('o', 'a')} AS oa FROM v)
SELECT doc_id, CAST(n AS BIGINT) AS n_chars, sha256(ed) AS edited_sha256, {hexed('eo', 'o')} AS fingerprint, {hexed('ec', 'c')} AS edited_fingerprint,
  {near('oc', 'oo', 'cc')} AS near_edited, {near('oa', 'oo', 'aa')} AS near_next
FROM d"""
