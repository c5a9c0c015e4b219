"""Raw log text to decoded records.

Every decoder takes a frame with a text column `value` and adds
  record         VARIANT of the log object, null unless valid
  source         where the record came from
  export_time, export_ptr, event_id, ingestion_time   envelope metadata
  envelope_ok    the outer JSON could be read
  decode_status  valid | invalid | skipped
Nothing raises on bad input: bad rows keep their text and their status.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numbers import col
from ..functions.records import filled


# Control characters cannot occur in JSON text, so they are free as marks.
BACKSLASHES, QUOTE, CUT = "\x01", "\x02", "\x03"


def _outside(line: Column, change) -> Column:
    """Apply `change(text, is_last)` to the parts of a line outside its strings."""
    marked = F.replace(F.replace(line, F.lit("\\\\"), F.lit(BACKSLASHES)), F.lit('\\"'), F.lit(QUOTE))
    parts = F.split(marked, '"', -1)
    changed = F.transform(parts, lambda s, i: F.when(i % 2 == 0, change(s, i == F.size(parts) - 1)).otherwise(s))
    joined = F.array_join(changed, '"')
    return F.replace(F.replace(joined, F.lit(QUOTE), F.lit('\\"')), F.lit(BACKSLASHES), F.lit("\\\\"))


def _mark_ends(text: Column, is_last: Column) -> Column:
    inner = F.regexp_replace(text, r"\}(?=\s*[^\s,\]}])", "}" + CUT)
    return F.when(is_last, inner).otherwise(F.regexp_replace(inner, r"\}(?=\s*$)", "}" + CUT))


def value_pieces(line: Column) -> Column:
    """A line cut where a value ends and another text begins. Most lines show none of that
    outside of strings and stay as they are; strings are left out by one pass of a pattern
    that never turns back, and only where the whole line shows it at all."""
    seam = F.lit(r"\}\s*[^\s,\]}]")
    bare = F.regexp_replace(line, r'"[^"\\]*+(?:\\.[^"\\]*+)*+"', "0")
    candidate = F.regexp_like(line, seam) & F.regexp_like(bare, seam)
    return F.when(candidate, F.split(_outside(line, _mark_ends), CUT)).otherwise(F.array(line))


def scan_lines(spark: SparkSession, paths: str | list[str], glob: str = "*.{gz,json,jsonl}") -> DataFrame:
    """One row per non-blank line of plain or gzip files, any number of paths. A line on
    which something follows the end of an object is cut there."""
    lines = spark.read.text(paths, pathGlobFilter=glob, recursiveFileLookup=True)
    cut = lines.select(F.explode(value_pieces(F.col("value"))).alias("value"), F.col("_metadata.file_path").alias("path"))
    return cut.where(F.trim("value") != "")


def scan_indented(spark: SparkSession, paths: str | list[str], glob: str = "*.{gz,json,jsonl}") -> DataFrame:
    """One row per object of files written with an indenting encoder, where an
    object ends with a closing brace alone on its line. Splittable."""
    chunks = spark.read.text(paths, lineSep="\n}\n", pathGlobFilter=glob, recursiveFileLookup=True)
    body = F.rtrim(F.col("value"))
    closed = F.when(body.startswith("{") & ~body.endswith("\n}"), F.concat(body, F.lit("\n}"))).otherwise(body)
    return chunks.select(closed.alias("value"), F.col("_metadata.file_path").alias("path")).where(F.trim(body) != "")


def _is_object(text: Column) -> Column:
    return F.ltrim(text).startswith("{")


def one_value(text) -> Column:
    """The VARIANT of a text that is exactly one JSON value, else null. The parser stops
    after the first value of a text, so the text is read inside an array: what follows
    it must be the 0 put there and nothing else."""
    whole = F.try_parse_json(F.concat(F.lit("["), col(text), F.lit(",0]")))
    alone = (F.try_variant_get(whole, "$[1]", "int") == 0) & F.try_variant_get(whole, "$[2]", "variant").isNull()
    return F.when(alone, F.try_variant_get(whole, "$[0]", "variant"))


def _get(variant: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(variant, path, kind)


def _finish(df: DataFrame, outer: Column, text: Column, parsed: Column, source: Column, skipped: Column, **meta: Column) -> DataFrame:
    """Add the decoded columns. They come out of a one-row generator: a filter on
    the status then stays above the parsing instead of being copied into it,
    parse by parse, when predicates are pushed down."""
    ok = parsed.isNotNull() & _is_object(text)
    names = {"export_time": "string", "export_ptr": "string", "event_id": "string", "ingestion_time": "bigint"}
    columns = {
        "record": F.when(ok, parsed),
        "record_text": F.when(ok, text),
        "source": source,
        **{n: meta.get(n, F.lit(None).cast(t)) for n, t in names.items()},
        "envelope_ok": outer.isNotNull(),
        "decode_status": F.when(ok, "valid").when(skipped, "skipped").otherwise("invalid"),
    }
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def decode_lines(df: DataFrame) -> DataFrame:
    """One JSON object per row."""
    parsed = df.withColumn("_v", one_value("value"))
    blank = F.trim("value") == ""
    return _finish(parsed, F.col("_v"), F.col("value"), F.col("_v"), F.lit("s3"), blank).drop("_v")


def decode_string_records(df: DataFrame) -> DataFrame:
    """A JSON string that itself holds a JSON object; anything else is dropped by status."""
    inner = F.when(F.ltrim("value").startswith('"'), _get(one_value("value"), "$"))
    parsed = df.withColumn("_t", inner).withColumn("_v", one_value("_t"))
    return _finish(parsed, F.col("_t"), F.col("_t"), F.col("_v"), F.lit("s3"), F.trim("value") == "").drop("_t", "_v")


def decode_exports(df: DataFrame) -> DataFrame:
    """Export envelope: the log object is JSON text under @message. An envelope
    whose message is not text is invalid, an empty message is skipped."""
    outer = df.withColumn("_o", F.when(_is_object(F.col("value")), one_value("value")))
    o = F.col("_o")
    as_object = F.try_variant_get(o, "$['@message']", "map<string,variant>")
    text = F.when(as_object.isNull(), _get(o, "$['@message']"))
    parsed = outer.withColumn("_t", text).withColumn("_v", one_value("_t"))
    return _finish(
        parsed, o, F.col("_t"), F.col("_v"), F.lit("cloudwatch_export"), F.col("_t") == "",
        export_time=filled(_get(o, "$['@timestamp']")), export_ptr=filled(_get(o, "$['@ptr']")),
    ).drop("_o", "_t", "_v")


def decode_events(df: DataFrame) -> DataFrame:
    """API event: the log object is under @message, message or Message, as text
    or as an object; the first that is not empty counts."""
    outer = df.withColumn("_o", F.when(_is_object(F.col("value")), one_value("value")))
    o = F.col("_o")
    text = F.coalesce(
        filled(_get(o, "$['@message']")), filled(_get(o, "$.message")), filled(_get(o, "$.Message"))
    )
    parsed = outer.withColumn("_t", text).withColumn("_v", one_value("_t"))
    return _finish(
        parsed, o, F.col("_t"), F.col("_v"), F.lit("cloudwatch"), o.isNotNull() & F.col("_t").isNull(),
        export_time=filled(_get(o, "$['@timestamp']")), export_ptr=filled(_get(o, "$['@ptr']")),
        event_id=_get(o, "$.eventId"), ingestion_time=_get(o, "$.ingestionTime", "bigint"),
    ).drop("_o", "_t", "_v")


def decode_any(df: DataFrame) -> DataFrame:
    """Mixed rows: export envelopes, JSON strings and plain objects, told apart
    by their first character and their keys."""
    outer = df.withColumn("_o", one_value("value"))
    o = F.col("_o")
    head = F.substring(F.ltrim("value"), 1, 1)
    message = F.try_variant_get(o, "$['@message']", "variant")
    as_object = F.try_variant_get(o, "$['@message']", "map<string,variant>")
    kind = F.when((head == "{") & message.isNotNull(), "export").when(head == "{", "plain").when(head == '"', "text")
    inner = F.when(
        F.col("_k") == "export", F.when(as_object.isNull(), _get(o, "$['@message']"))
    ).when(F.col("_k") == "text", _get(o, "$"))
    parsed = (
        outer.withColumn("_k", kind)
        .withColumn("_t", F.when(F.col("_k") == "plain", F.col("value")).otherwise(inner))
        .withColumn("_v", F.when(F.col("_k") == "plain", o).otherwise(one_value("_t")))
    )
    is_export = F.col("_k") == "export"
    return _finish(
        parsed, o, F.col("_t"), F.col("_v"),
        F.when(is_export, "cloudwatch_export").otherwise("s3"),
        (F.trim("value") == "") | (is_export & (F.col("_t") == "")),
        export_time=F.when(is_export, filled(_get(o, "$['@timestamp']"))),
        export_ptr=F.when(is_export, filled(_get(o, "$['@ptr']"))),
    ).drop("_o", "_k", "_t", "_v")


def valid_records(decoded: DataFrame) -> DataFrame:
    return decoded.where(F.col("decode_status") == "valid")


def reject_rows(decoded: DataFrame) -> DataFrame:
    """Rows that could not be decoded, with their text."""
    return decoded.where(F.col("decode_status") != "valid").drop(
        "record", "record_text", "source", "export_time", "export_ptr", "event_id", "ingestion_time", "envelope_ok"
    )


def parse_summary(decoded: DataFrame, *keys: str) -> DataFrame:
    """Counters per file, run or other key: found = valid + invalid + skipped."""
    status = F.col("decode_status")
    return decoded.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("found"),
        F.count(F.when(F.col("envelope_ok"), 1)).alias("processed"),
        F.count(F.when(status == "valid", 1)).alias("valid"),
        F.count(F.when(status == "invalid", 1)).alias("invalid"),
        F.count(F.when(status == "skipped", 1)).alias("skipped"),
    )
