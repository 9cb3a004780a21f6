"""Terms, datatypes and severities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
RDFS_RESOURCE = "http://www.w3.org/2000/01/rdf-schema#Resource"
XSD = "http://www.w3.org/2001/XMLSchema#"
SH = "http://www.w3.org/ns/shacl#"
DCT = "http://purl.org/dc/terms/"
TYPE = RDF + "type"

#: Local names of the XSD datatypes by family, and those with a continuous distribution (fixed values).
FAMILIES = {
    "datefrag": "gDay gMonth gMonthDay".split(),
    "datetime": "date dateTime dateTimeStamp gYear gYearMonth".split(),
    "numeric": "decimal double float long int short byte integer nonNegativeInteger nonPositiveInteger negativeInteger positiveInteger unsignedLong unsignedInt unsignedShort unsignedByte".split(),
    "string": "string normalizedString token language Name NCName ENTITY ID IDREF NMTOKEN anyURI".split(),
}
CONTINUOUS = "date dateTime dateTimeStamp decimal double float".split()
SEVERITIES = ("NOMINAL", "ERROR", "NODATA", "INCONSISTENCY", "SUSPICIOUS", "CRITICAL")
NOMINAL, ERROR, NODATA, INCONSISTENCY, SUSPICIOUS, CRITICAL = range(6)

STATEMENT = "graph_id string, seq bigint, stmt_ix int, s string, p string, o_kind string, o_value string, o_dtype string, o_lang string"


def type_dim(spark: SparkSession) -> DataFrame:
    """(family, dtype, dist_kind) of the supported datatypes: C continuous, D discrete."""
    every = spark.createDataFrame([(f, XSD + n) for f, names in FAMILIES.items() for n in names], "family string, dtype string")
    continuous = spark.createDataFrame([(XSD + n,) for n in CONTINUOUS], "dtype string")
    discrete = every.select("dtype").exceptAll(continuous)
    kinds = continuous.withColumn("dist_kind", F.lit("C")).unionByName(discrete.withColumn("dist_kind", F.lit("D")))
    return every.join(kinds, "dtype").select("family", "dtype", "dist_kind")


def severity_dim(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(SEVERITIES)), "code int, severity string")


def dist_kind(dtype: Column) -> Column:
    """C or D for a supported datatype, else null."""
    names = [n for f in FAMILIES.values() for n in f]
    return F.when(dtype.isin([XSD + n for n in CONTINUOUS]), "C").when(dtype.isin([XSD + n for n in names if n not in CONTINUOUS]), "D")


def _column(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def subject_text(value: str | Column = "s") -> Column:
    """A subject or predicate as text: blank nodes have their prefix as part of their name, others are IRIs."""
    value = _column(value)
    return F.when(value.startswith("_:"), value).otherwise(F.concat(F.lit("<"), value, F.lit(">")))


def serialised(kind: str | Column = "o_kind", value: str | Column = "o_value", dtype: str | Column = "o_dtype", lang: str | Column = "o_lang") -> Column:
    """A term as text: <iri>, _:node, "value"@lang or "value"^^<datatype>."""
    kind, value, dtype, lang = map(_column, (kind, value, dtype, lang))
    quoted = F.concat(F.lit('"'), value, F.lit('"'))
    literal = F.when(lang.isNotNull(), F.concat(quoted, F.lit("@"), lang)).when(dtype.isNotNull(), F.concat(quoted, F.lit("^^<"), dtype, F.lit(">"))).otherwise(quoted)
    return F.when(kind == "iri", F.concat(F.lit("<"), value, F.lit(">"))).when(kind == "bnode", F.concat(F.lit("_:"), F.regexp_replace(value, "^_:", ""))).otherwise(literal)
