"""Exports as SHACL statements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.terms import DCT, RDF, SH, TYPE, XSD, serialised, subject_text
from .sequence import placed


def _row(s: Column, p: str, kind: str, value: Column, dtype: str | None = None) -> Column:
    return F.struct(s.alias("s"), F.lit(p).alias("p"), F.lit(kind).alias("o_kind"), value.cast("string").alias("o_value"), F.lit(XSD + dtype if dtype else None).cast("string").alias("o_dtype"))


def _head(r: Column, ts: Column, conforms: Column) -> Column:
    return F.array(
        _row(r, TYPE, "iri", F.lit(SH + "ValidationReport")), _row(r, DCT + "date", "literal", ts, "dateTime"), _row(r, DCT + "identifier", "literal", r, "string"),
        _row(r, DCT + "conformsTo", "iri", F.lit(SH)), _row(r, SH + "conforms", "literal", conforms, "boolean"),
    )


def _result(r: Column, of) -> Column:
    """The statements of a violation, whose fields `of` gives by name."""
    v, sev = of("result_id"), F.concat(of("result_id"), F.lit("-severity"))
    base = [
        _row(r, SH + "result", "bnode", v), _row(v, TYPE, "iri", F.lit(SH + "ValidationResult")), _row(v, SH + "resultMessage", "literal", of("label"), "string"), _row(v, DCT + "description", "literal", of("message"), "string"),
        _row(v, SH + "resultSeverity", "bnode", sev), _row(sev, TYPE, "iri", F.lit(SH + "Severity")), _row(sev, DCT + "title", "literal", of("severity"), "string"), _row(sev, DCT + "description", "literal", F.concat(F.lit("severity "), of("severity")), "string"),
    ]
    about = [_row(v, SH + "focusNode", "iri", of("focus")), _row(v, SH + "resultPath", "iri", of("path")), _row(v, SH + "value", "literal", of("value"))]
    return F.when(of("focus").isNull(), F.array(*base)).otherwise(F.array(*base, *about))


def report_statements(reports: DataFrame, violations: DataFrame) -> DataFrame:
    """Statements of validation reports(report_id, report_ts, conforms) and their violations(report_id, result_id, label,
    message, severity, focus, path, value): a head of five, eight for a structural violation (focus null), eleven for others."""
    r = F.col("report_id")
    head = reports.select(r.alias("graph_id"), F.inline(_head(r, F.col("report_ts"), F.col("conforms"))))
    return head.unionByName(violations.select(r.alias("graph_id"), F.inline(_result(r, F.col))))


def report_messages(reports: DataFrame) -> DataFrame:
    """(graph_id, sts) of reports(report_id, report_ts, conforms, violations), which have their violations as an array: the statements
    that report_statements makes, a row for each report."""
    r = F.col("report_id")
    results = F.flatten(F.transform("violations", lambda x: _result(r, lambda name: x[name])))
    return reports.select(r.alias("graph_id"), F.concat(_head(r, F.col("report_ts"), F.col("conforms")), F.coalesce(results, F.array())).alias("sts"))


def joined(statements: DataFrame, root_class: str, paths: dict[str, list[str]]) -> DataFrame:
    """(graph_id, root, one column for each of paths): what the nodes of a class reach along paths of predicates, of any length.

    Paths that begin alike share their joins; each step joins the nodes reached so far with the statements that have them as
    subject, by graph and node. A step that leads nowhere gives null, one that leads to several nodes gives a row for each.
    """
    own = statements.select("graph_id", "s", "p", "o_value")
    rows = own.where((F.col("p") == TYPE) & (F.col("o_value") == root_class)).select("graph_id", F.col("s").alias("root")).distinct()
    at: dict[tuple[str, ...], str] = {(): "root"}
    for path in sorted({tuple(p[: i + 1]) for p in paths.values() for i in range(len(p))}, key=lambda p: (len(p), p)):
        at[path] = f"_{len(at)}"
        step = own.where(F.col("p") == path[-1]).select("graph_id", F.col("s").alias(at[path[:-1]]), F.col("o_value").alias(at[path]))
        rows = rows.join(step, ["graph_id", at[path[:-1]]], "left")
    return rows.select("graph_id", "root", *[F.col(at[tuple(p)]).alias(name) for name, p in paths.items()])


def message_texts(messages: DataFrame) -> DataFrame:
    """(graph_id, text) of report_messages: a report's statements, one a line in the order of their texts, between a first and a last
    line. Nothing is shuffled, as a report is one row."""
    no = F.lit(None).cast("string")
    line = lambda x: F.concat(F.lit(" "), subject_text(x["s"]), F.lit(" "), subject_text(x["p"]), F.lit(" "), serialised(x["o_kind"], x["o_value"], x["o_dtype"], no), F.lit(" ."))
    body = F.array_join(F.sort_array(F.transform("sts", line)), "\n")
    edge = lambda word: F.concat(F.lit(f"--- {word} Validation Report "), F.col("graph_id"), F.lit(" ---"))
    return messages.select("graph_id", F.concat(edge("BEGIN"), F.lit("\n"), body, F.lit("\n"), edge("END")).alias("text"))


def report_texts(statements: DataFrame) -> DataFrame:
    """message_texts of statements that are rows, which are brought together by report."""
    return message_texts(statements.groupBy("graph_id").agg(F.collect_list(F.struct("s", "p", "o_kind", "o_value", "o_dtype")).alias("sts")))


def pattern_texts(patterns: DataFrame) -> DataFrame:
    """(graph_id, text, digest) of patterns(graph_id, ap_id, anchor, relation, st_value): each graph's as one text, in the order of
    ap_id, so that equal sets of patterns have equal digests."""
    one = F.concat(F.lit("("), F.concat_ws(", ", "anchor", "relation", F.coalesce("st_value", F.lit("*"))), F.lit(")"))
    texts = F.transform(F.array_sort(F.collect_list(F.struct("ap_id", one.alias("one")))), lambda x: x["one"])
    whole = patterns.groupBy("graph_id").agg(F.concat(F.lit("{"), F.array_join(texts, "; "), F.lit("}")).alias("text"))
    return whole.withColumn("digest", F.sha2("text", 256))


#: The columns of a published report and where they are in its statements.
REPORT = {"report_date": [DCT + "date"], "identifier": [DCT + "identifier"], "conforms": [SH + "conforms"]} | {
    name: [SH + "result", *p]
    for name, p in {"result": [], "message": [SH + "resultMessage"], "description": [DCT + "description"], "focus": [SH + "focusNode"], "path": [SH + "resultPath"], "value": [SH + "value"], "severity": [SH + "resultSeverity"], "severity_label": [SH + "resultSeverity", DCT + "title"], "severity_description": [SH + "resultSeverity", DCT + "description"]}.items()
}


def binding_sets(statements: DataFrame) -> DataFrame:
    """(report, report_date, identifier, conforms, result, message, description, focus, path, value, severity, severity_label,
    severity_description) of report statements: a row for each result; structural ones have neither focus, path nor value, and
    a report that conforms has one row without a result."""
    found = joined(statements, SH + "ValidationReport", REPORT)
    return found.select(F.col("root").alias("report"), *REPORT)


def shape_statements(patterns: DataFrame, bounds: DataFrame | None = None, lists: DataFrame | None = None) -> DataFrame:
    """Shapes of patterns(graph_id, ap_id, anchor, relation, st_kind, st_value, st_dtype, st_lang) as statements (graph_id, s, p,
    o_kind, o_value, o_dtype): a node shape and a property shape for each; a fixed value with its kind, and its language list or
    datatype. Patterns with a distribution have st_kind null; theirs are bounds(ap_id, min_inclusive, max_inclusive, dtype), lexical
    forms, or lists(ap_id, pos, member, dtype), sorted members as the cells of a list.
    """
    shape, prop, cell = F.concat(F.lit("B"), F.col("ap_id")), F.concat(F.lit("B"), F.col("ap_id"), F.lit("-property")), F.concat(F.lit("B"), F.col("ap_id"), F.lit("-language"))
    kind = F.col("st_kind")
    value = F.struct(prop.alias("s"), F.lit(SH + "hasValue").alias("p"), kind.alias("o_kind"), F.col("st_value").alias("o_value"), F.when(kind == "literal", F.col("st_dtype")).alias("o_dtype"))
    node = F.when(kind == "literal", SH + "Literal").when(kind == "iri", SH + "IRI").otherwise(SH + "BlankNode")
    spoken, data = (kind == "literal") & F.col("st_lang").isNotNull(), (kind == "literal") & F.col("st_lang").isNull() & F.col("st_dtype").isNotNull()
    rows = F.array(
        _row(F.col("graph_id"), DCT + "hasPart", "bnode", shape), _row(shape, TYPE, "iri", F.lit(SH + "NodeShape")), _row(shape, DCT + "identifier", "literal", F.col("ap_id"), "string"),
        _row(shape, SH + "targetClass", "iri", F.col("anchor")), _row(shape, SH + "targetSubjectsOf", "iri", F.col("relation")), _row(shape, SH + "property", "bnode", prop), _row(prop, SH + "path", "iri", F.col("relation")),
        F.when(kind.isNotNull(), value), F.when(kind.isNotNull(), _row(prop, SH + "nodeKind", "iri", node)), F.when(data, _row(prop, SH + "datatype", "iri", F.col("st_dtype"))),
        F.when(spoken, _row(prop, SH + "languageIn", "bnode", cell)), F.when(spoken, _row(cell, TYPE, "iri", F.lit(RDF + "List"))), F.when(spoken, _row(cell, RDF + "first", "literal", F.col("st_lang"), "string")), F.when(spoken, _row(cell, RDF + "rest", "iri", F.lit(RDF + "nil"))),
    )
    out = patterns.select("graph_id", F.inline(F.array_compact(rows)))
    typed = lambda p, v: F.struct(prop.alias("s"), F.lit(SH + p).alias("p"), F.lit("literal").alias("o_kind"), F.col(v).cast("string").alias("o_value"), F.col("dtype").alias("o_dtype"))
    owner = patterns.select("graph_id", "ap_id")
    if bounds is not None:
        out = out.unionByName(owner.join(bounds, "ap_id").select("graph_id", F.inline(F.array(typed("minInclusive", "min_inclusive"), typed("maxInclusive", "max_inclusive")))))
    if lists is not None:
        place = lambda n: F.concat(F.lit("B"), F.col("ap_id"), F.lit("-in-"), n.cast("string"))
        lists = lists.withColumn("last", F.max("pos").over(W.partitionBy("ap_id")))
        rest = F.when(F.col("pos") == F.col("last"), _row(place(F.col("pos")), RDF + "rest", "iri", F.lit(RDF + "nil"))).otherwise(_row(place(F.col("pos")), RDF + "rest", "bnode", place(F.col("pos") + 1)))
        member = F.struct(place(F.col("pos")).alias("s"), F.lit(RDF + "first").alias("p"), F.when(F.col("dtype") == XSD + "anyURI", "iri").otherwise("literal").alias("o_kind"), F.col("member").alias("o_value"), F.when(F.col("dtype") != XSD + "anyURI", F.col("dtype")).alias("o_dtype"))
        head = F.when(F.col("pos") == 0, _row(prop, SH + "in", "bnode", place(F.lit(0)))), F.when(F.col("pos") == 0, _row(place(F.lit(0)), TYPE, "iri", F.lit(RDF + "List")))
        out = out.unionByName(owner.join(lists, "ap_id").select("graph_id", F.inline(F.array_compact(F.array(*head, member, rest)))))
    return out


def shape_bounds(samples: DataFrame) -> DataFrame:
    """(graph_id, relation, min_inclusive, max_inclusive) of samples(graph_id, relation, num)."""
    return samples.groupBy("graph_id", "relation").agg(F.min("num").alias("min_inclusive"), F.max("num").alias("max_inclusive"))


def shape_lists(samples: DataFrame) -> DataFrame:
    """(graph_id, relation, pos, member) of samples(graph_id, relation, str): sorted distinct members of an sh:in list."""
    members = samples.select("graph_id", "relation", F.col("str").alias("member")).distinct()
    return placed(members, ["graph_id", "relation"], ["member"], "pos").select("graph_id", "relation", (F.col("pos") - 1).cast("int").alias("pos"), "member")
