"""Statements from messages, files, bindings and tables.

A statement is a row of graph_id, seq, stmt_ix, s, p, o_kind, o_value, o_dtype, o_lang.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.terms import TYPE, XSD, serialised, subject_text
from ..operators.sequence import placed

EX = "http://example.org/"
# a statement: subject and relation in brackets or bare, an object, and a full stop that ends a word; literals stay within a line
_NAME = r'(?:<([^<>\s]*)>|([^\s<>"]++)(?=\s))\s*'
_TERM = r'(<([^<>\s]*)>|"(.*?)"(?:@([A-Za-z0-9-]+)|\^\^<([^<>\s]*)>|\^\^([^\s<>"]+?))?|([^\s<>"]+?))'
_STATEMENT = _NAME + _NAME + _TERM + r"\s*\.(?=\s|$)"
#: What a statement's groups hold, each on a line of its own, as none has line breaks: s, p, o as it stands, o's name, and a literal's value, language and datatype.
_PARTS = "$1$2\n$3$4\n$5\n$6$11\n$7\n$8\n$9$10"


def numbered(events: DataFrame, key: Column | None = None) -> DataFrame:
    """events with graph_id and seq, its place in its stream by time, from 1; streams are cut into ranges of time (see placed)."""
    key = F.concat(F.lit("g-"), F.col("event_type")) if key is None else key
    keyed = events.select("event_id", "ts", "user_id", "event_type", "value", F.get_json_object("props", "$.k").cast("long").alias("k")).withColumn("graph_id", key)
    return placed(keyed, ["graph_id"], ["ts", "event_id"], "seq")


def _statement(ix: Column, s: Column, p: str, kind: str, value: Column, dtype: str | None = None) -> Column:
    no = F.lit(None).cast("string")
    return F.struct(ix.cast("int").alias("stmt_ix"), s.alias("s"), F.lit(p).alias("p"), F.lit(kind).alias("o_kind"), value.cast("string").alias("o_value"), (F.lit(XSD + dtype) if dtype else no).alias("o_dtype"), no.alias("o_lang"))


def stated(messages: DataFrame) -> DataFrame:
    """The statements of messages(graph_id, seq, sts), a row for each."""
    return messages.select("graph_id", "seq", F.inline("sts"))


def triplified_messages(events: DataFrame, made_by: bool = True) -> DataFrame:
    """(graph_id, seq, sts): eight statements for each numbered event (seven without made_by), as one row."""
    obs, res = F.concat(F.lit(EX + "obs/"), F.col("event_id")), F.concat(F.lit(EX + "res/"), F.col("event_id"))
    rows = [
        (obs, TYPE, "iri", F.lit(EX + "Observation")),
        *([(obs, EX + "madeBy", "iri", F.concat(F.lit(EX + "user/"), F.col("user_id")))] if made_by else []),
        (obs, EX + "hasTimestamp", "literal", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), "dateTime"),
        (obs, EX + "hasResult", "iri", res),
        (res, TYPE, "iri", F.lit(EX + "PropertyValue")),
        (res, EX + "isValueOfProperty", "iri", F.concat(F.lit(EX + "prop/"), F.col("event_type"))),
        (res, EX + "hasValue", "literal", F.col("value"), "double"),
        (res, EX + "isMeasuredIn", "literal", F.col("k"), "integer"),
    ]
    return events.select("graph_id", "seq", F.array(*[_statement(F.lit(i), *row) for i, row in enumerate(rows)]).alias("sts"))


def triplified(events: DataFrame, made_by: bool = True) -> DataFrame:
    """Eight statements for each numbered event (seven without made_by), in one pass over the rows."""
    return stated(triplified_messages(events, made_by))


#: The order of an order's lines; line numbers may repeat.
_LINE_ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_returnflag", "l_shipdate")


def _after_prefix() -> Column:
    return F.substring("graph_id", F.lit(3), F.length("graph_id"))


def dealt_orders(orders: DataFrame, lineitem: DataFrame) -> DataFrame:
    """(graph_id, heads, lines): a row for each order, its lines in their order. Only table rows are shuffled, not their statements."""
    head = F.struct("o_orderstatus", F.col("o_totalprice").cast("string").alias("o_totalprice"))
    line = F.struct(*_LINE_ORDER)
    no = lambda df, c: F.lit(None).cast(df.select(c.alias("x")).schema["x"].dataType)
    a = orders.select(F.concat(F.lit("o-"), F.col("o_orderkey")).alias("graph_id"), head.alias("head"), no(lineitem, line).alias("line"))
    b = lineitem.select(F.concat(F.lit("o-"), F.col("l_orderkey")).alias("graph_id"), no(orders, head).alias("head"), line.alias("line"))
    dealt = a.unionByName(b).repartition("graph_id").groupBy("graph_id").agg(F.collect_list("head").alias("heads"), F.collect_list("line").alias("lines"))
    return dealt.withColumn("lines", F.sort_array("lines"))


def order_messages(dealt: DataFrame, *more: str) -> DataFrame:
    """(graph_id, seq, sts, more) of dealt_orders: type, status and total of an order, and a typed node for each line, whose relations repeat."""
    order = F.concat(F.lit(EX + "order/"), _after_prefix())
    heads = F.transform("heads", lambda h: F.array(_statement(F.lit(0), order, TYPE, "iri", F.lit(EX + "Order")), _statement(F.lit(1), order, EX + "status", "literal", h["o_orderstatus"], "string"), _statement(F.lit(2), order, EX + "total", "literal", h["o_totalprice"], "double")))

    def body(x: Column, i: Column) -> Column:
        n, line = (i + 1) * 3, F.concat(F.lit(EX + "line/"), _after_prefix(), F.lit("/"), x["l_linenumber"])
        return F.array(_statement(n, line, TYPE, "iri", F.lit(EX + "Line")), _statement(n + 1, line, EX + "quantity", "literal", x["l_quantity"], "double"), _statement(n + 2, line, EX + "flag", "literal", x["l_returnflag"], "string"))

    return dealt.select("graph_id", F.lit(1).cast("long").alias("seq"), F.flatten(F.concat(heads, F.transform("lines", body))).alias("sts"), *more)


def order_graphs(orders: DataFrame, lineitem: DataFrame) -> DataFrame:
    """A graph for each order: its type, status and total, and a typed node for each line, whose relations repeat."""
    return stated(order_messages(dealt_orders(orders, lineitem)))


def part_messages(lineitem: DataFrame) -> DataFrame:
    """(graph_id, seq, sts): an order has its lines, which are typed nodes, and their suppliers, which aren't, as parts."""
    dealt = lineitem.select(F.concat(F.lit("p-"), F.col("l_orderkey")).alias("graph_id"), F.struct(*_LINE_ORDER).alias("line")).repartition("graph_id")
    dealt = dealt.groupBy("graph_id").agg(F.sort_array(F.collect_list("line")).alias("lines"))
    order = F.concat(F.lit(EX + "order/"), _after_prefix())

    def body(x: Column, i: Column) -> Column:
        n, line = (i + 1) * 3, F.concat(F.lit(EX + "line/"), _after_prefix(), F.lit("/"), x["l_linenumber"])
        return F.array(_statement(n, order, EX + "part", "iri", line), _statement(n + 1, line, TYPE, "iri", F.lit(EX + "Line")), _statement(n + 2, order, EX + "part", "iri", F.concat(F.lit(EX + "supplier/"), x["l_suppkey"])))

    return dealt.select("graph_id", F.lit(1).cast("long").alias("seq"), F.flatten(F.transform("lines", body)).alias("sts"))


def part_graphs(lineitem: DataFrame) -> DataFrame:
    """A graph for each order: it has its lines, which are typed nodes, and their suppliers, which aren't, as parts."""
    return stated(part_messages(lineitem))


def parsed_messages(messages: DataFrame) -> DataFrame:
    """(graph_id, seq, sts) of messages(graph_id, seq, data): their statements, numbered from 0; any number on a line. What is no
    statement is skipped. A message stays one row.

    Names are without brackets; blank nodes are `_:name` as subjects and as objects (o_kind bnode), so that a node's statements
    meet. A literal ends at the first quotation mark after which the statement can end.
    """
    cut = F.transform(F.regexp_extract_all("data", F.lit(_STATEMENT), F.lit(0)), lambda x: F.split(F.regexp_replace(x, f"^{_STATEMENT}$", _PARTS), "\n"))

    def statement(part: Column, i: Column) -> Column:
        literal = part[2].startswith('"')
        kind = F.when(literal, "literal").when(part[2].startswith("_:"), "bnode").otherwise("iri")
        own = lambda j: F.nullif(part[j], F.lit(""))
        return F.struct(i.alias("stmt_ix"), part[0].alias("s"), part[1].alias("p"), kind.alias("o_kind"), F.when(literal, part[4]).otherwise(part[3]).alias("o_value"), own(6).alias("o_dtype"), own(5).alias("o_lang"))

    return messages.select("graph_id", "seq", F.transform(cut, statement).alias("sts"))


def parsed(messages: DataFrame) -> DataFrame:
    """The statements of messages(graph_id, seq, data), a row for each (see parsed_messages)."""
    return parsed_messages(messages).select("graph_id", "seq", F.inline_outer("sts")).where("stmt_ix is not null")  # inline's own filter would parse twice


def _line(x: Column) -> Column:
    return F.concat(subject_text(x["s"]), F.lit(" "), subject_text(x["p"]), F.lit(" "), serialised(x["o_kind"], x["o_value"], x["o_dtype"], x["o_lang"]), F.lit(" ."))


def rendered_messages(messages: DataFrame, between: str = "\n") -> DataFrame:
    """messages(graph_id, seq, data) that `parsed_messages` reads, of messages(graph_id, seq, sts), whose statements are in their order."""
    return messages.select("graph_id", "seq", F.array_join(F.transform("sts", _line), between).alias("data"))


def rendered(statements: DataFrame, between: str = "\n") -> DataFrame:
    """rendered_messages of statements that are rows, which are brought together by message."""
    one = F.struct("stmt_ix", "s", "p", "o_kind", "o_value", "o_dtype", "o_lang")
    return rendered_messages(statements.groupBy("graph_id", "seq").agg(F.sort_array(F.collect_list(one)).alias("sts")), between)


def by_relation(messages: DataFrame) -> DataFrame:
    """(graph_id, seq, p, own) of messages(graph_id, seq, sts): a row for each relation of a message, with its statements. Nothing is
    shuffled, as a message is one row. Each of its relations, which are few, looks through its statements."""
    own = F.transform(F.array_distinct(F.transform("sts", lambda x: x["p"])), lambda p: F.struct(p.alias("p"), F.filter("sts", lambda x: x["p"].eqNullSafe(p)).alias("own")))
    return messages.select("graph_id", "seq", F.inline(own))


def labelled_messages(raw: DataFrame) -> DataFrame:
    """messages of raw(value, seq), JSON objects with `label` and `data`; objects without either are skipped."""
    got = raw.select("seq", F.from_json("value", "label string, data string, anomaly boolean").alias("m"))
    return got.where("m.label is not null and m.data is not null").select(F.col("m.label").alias("graph_id"), "seq", F.col("m.data").alias("data"), F.col("m.anomaly").alias("anomaly"))


def stream_file(spark, path: str) -> DataFrame:
    """(stream, ix, graph_id, data, anomaly) of a JSON file that is a list of lists of labelled graphs."""
    streams = spark.read.text(path, wholetext=True).select(F.posexplode(F.from_json("value", "array<array<struct<label:string,data:string,anomaly:boolean>>>")).alias("stream", "items"))
    return streams.select("stream", F.posexplode("items").alias("ix", "m")).select("stream", "ix", F.col("m.label").alias("graph_id"), F.col("m.data").alias("data"), F.col("m.anomaly").alias("anomaly"))


def round_robin(items: DataFrame) -> DataFrame:
    """items(stream, ix, ...) in the order in which streams take turns, one item each; a range-partitioned sort."""
    return items.orderBy("ix", "stream")


def binding_sets(raw: DataFrame, templates: dict[str, tuple[list[str], dict[str, str]]]) -> DataFrame:
    """messages of raw(value, seq), JSON objects with knowledgeInteractionId and bindingSet: a message for each binding, whose
    graph_id is the last part of the id. Objects without either, without bindings or of an unknown id are skipped.

    templates: for each id its lines and prefixes. seq numbers an object's bindings within it, in their order.
    """
    got = raw.select("seq", F.from_json("value", "knowledgeInteractionId string, bindingSet array<map<string,string>>").alias("m")).where("m.knowledgeInteractionId is not null and size(m.bindingSet) > 0")
    each = got.select(F.col("m.knowledgeInteractionId").alias("id"), "seq", F.posexplode("m.bindingSet").alias("place", "binding"))
    out = None
    for name, (template, prefixes) in templates.items():  # templates are code, like their lines
        own = each.where(F.col("id") == name).select(F.lit(name.rsplit("/", 1)[-1]).alias("graph_id"), "seq", "place", "binding")
        filled = instantiated(own, template, prefixes, ["place"])
        out = filled if out is None else out.unionByName(filled)
    if out is None:
        raise ValueError("no templates")
    return out


def instantiated(bindings: DataFrame, template: list[str], prefixes: dict[str, str], carry: list[str] | None = None) -> DataFrame:
    """messages of bindings(graph_id, seq, binding map<string,string>): template lines with `?name` and `prefix:` replaced.

    The template is code, a few lines; it's unrolled into one expression per line, so nothing is joined.
    """
    lines = []
    for line in template:
        if not line.strip():
            continue
        parts = []
        for token in line.split():
            prefix, _, rest = token.partition(":")
            if token.startswith("?"):
                parts.append(F.coalesce(F.element_at("binding", F.lit(token[1:])), F.lit(token)))
            elif prefix in prefixes and not token.startswith(("<", '"')):
                parts.append(F.lit(f"<{prefixes[prefix]}{rest}>"))
            else:
                parts.append(F.lit(token))
        lines.append(F.concat_ws(" ", *parts))
    return bindings.select("graph_id", "seq", *(carry or []), F.concat_ws("\n", *lines).alias("data"))
