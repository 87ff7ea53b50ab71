"""JSON and JSON5 in, JSON and newline-delimited JSON out."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from varidoc.functions.binding import bind

_LENIENT = {"allowComments": "true", "allowSingleQuotes": "true", "allowUnquotedFieldNames": "true", "allowNumericLeadingZeros": "true", "mode": "PERMISSIVE"}
#: Strings and comments, which are kept as they are; and the commas and signs that JSON does not know.
_TRAILING = r""""(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*'|//[^\n]*|/\*[\s\S]*?\*/"""


def parse(text: Column) -> Column:
    """The document, failing on malformed text, also where something follows the value. Keys must not repeat.
    parse_error tells what is wrong and where."""

    def sure(v: Column) -> Column:
        why = F.concat(F.lit("malformed JSON: "), F.substring(text, 1, 200))
        return F.when(text.isNull() | v.isNotNull(), v).otherwise(F.raise_error(why).cast("variant"))

    return bind(try_parse(text), sure)


def try_parse(text: Column) -> Column:
    """The document, NULL for malformed text, also where something follows the value."""

    def ended(whole: Column) -> Column:
        fine = F.try_variant_get(whole, "$.y", "int").isNotNull() & (F.size(F.try_variant_get(whole, "$", "map<string,variant>")) == 2)
        return F.when(fine, F.try_variant_get(whole, "$.x", "variant"))

    # the text stands inside a dict, so that the parser must reach its end
    return bind(F.try_parse_json(F.concat(F.lit('{"x":'), text, F.lit(',"y":0}'))), ended)


def is_valid(text: Column) -> Column:
    return try_parse(text).isNotNull()


def _errors(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    def refuse(word: str):
        raise json.JSONDecodeError(f"{word} is no JSON number", word, 0)

    for batch in texts:
        out = []
        for t in batch.to_pylist():
            try:
                json.loads(t or "0", parse_constant=refuse)
                out.append(None)
            except json.JSONDecodeError as e:
                out.append({"message": e.msg, "position": e.pos})
            except RecursionError:
                out.append({"message": "nested too deep", "position": 0})
        yield pa.array(out, pa.struct([("message", pa.string()), ("position", pa.int32())]))


def parse_error(text: Column) -> Column:
    """Of malformed JSON text what is wrong and at which character (from 0): message, position. NULL for good text."""
    return F.when(~is_valid(text), F.arrow_udf(_errors, "message string, position int")(text))


def parse_json5(text: Column) -> Column:
    """JSON with comments, single quotes, bare keys, trailing commas, leading plus signs and numbers that begin or
    end with a point; NULL for malformed text."""
    plain = F.regexp_replace(text, rf"({_TRAILING})|,(?=(?:\s|//[^\n]*\n|/\*[\s\S]*?\*/)*[}}\]])", "$1")
    plain = F.regexp_replace(plain, rf"({_TRAILING})|(^\s*|[:\[,]\s*)\+(?=[0-9.])", "$1$2")
    plain = F.regexp_replace(plain, rf"({_TRAILING})|((?:^|[:\[,])\s*-?)(?=\.[0-9])", "$1$2\u0000")
    plain = F.regexp_replace(plain, rf"({_TRAILING})|([0-9]\.)(?=[\s,}}\]eE]|$)", "$1$2\u0000")
    # the mark stands where a digit is missing, also behind strings and comments, where it goes again
    plain = F.regexp_replace(plain, r"(?<=[.])\u0000|\u0000(?=[.])", "0")
    return F.from_json(F.replace(plain, F.lit("\u0000"), F.lit("")), "variant", _LENIENT)


def require(v: Column, kind: str) -> Column:
    """v if it is of the kind (array or dict), else an error."""
    from varidoc.functions.values import doc_type

    return F.when(doc_type(v) == kind, v).otherwise(F.raise_error(F.lit(f"the document is no {kind}")).cast("variant"))


def read_documents(spark: SparkSession, path: str, column: str = "body") -> DataFrame:
    """A row for each line of newline-delimited JSON files."""
    return spark.read.option("singleVariantColumn", column).json(path)


def to_json(v: Column) -> Column:
    """JSON text with keys in order, numbers as Java writes them."""
    return F.to_json(v)


def to_canonical_json(v: Column) -> Column:
    """JSON text with keys in order, numbers in their shortest form and control characters as \\u00xx."""
    from varidoc.functions.canonical import canonical_text

    return canonical_text(F.to_json(v))


def to_json5(v: Column) -> Column:
    """JSON text with bare keys wherever JSON5 allows them."""
    return F.regexp_replace(F.to_json(v), r'''"([A-Za-z_$][A-Za-z0-9_$]*)"(?=:)|("(?:[^"\\]|\\.)*")''', "$1$2")


def write_ndjson(df: DataFrame, v: str, path: str, *, append: bool = False) -> None:
    """A line of JSON for each document, in a new folder or beside what is there."""
    df.select(F.to_json(v).alias("value")).write.mode("append" if append else "errorifexists").text(path)


def read_whole(spark: SparkSession, path: str, column: str = "body") -> DataFrame:
    """A document for each file, whose text it is; NULL where the text is malformed. Also its path."""
    files = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("path"))
    return files.select("path", try_parse(F.col("value")).alias(column))


def read_bytes(spark: SparkSession, path: str) -> DataFrame:
    """path and content of each file."""
    return spark.read.format("binaryFile").load(path).select("path", "content")


def write_documents(df: DataFrame, v: str, path: str) -> None:
    """Documents as Parquet, with all columns of df."""
    df.write.mode("errorifexists").parquet(path)
