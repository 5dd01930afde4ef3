"""Column expressions that the jobs share: ids, titles, times, JSON access. All of them stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: White space as str.strip() takes it, for a regular expression's class.
STRIP = r"\s\x1c-\x1f\x85\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Line ends as str.splitlines() takes them.
LINE_END = r"[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
TITLE_LENGTH = 200


def stable_id(kind: str, *parts: Column) -> Column:
    """A UUID of version 8 from SHA-256 over the kind and the parts, each after a NUL."""
    text = F.concat(F.lit(kind), *(F.concat(F.lit("\x00"), p.cast("string")) for p in parts))
    h = F.sha2(text.cast("binary"), 256)
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    groups = (F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("8"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))
    return F.concat_ws("-", *groups)


def conversation_id(source: Column, native: Column) -> Column:
    return stable_id("conversation", source, native)


def block_id(message: Column, index: Column) -> Column:
    return stable_id("block", message, index)


def raw_event_id(conversation: Column, line: Column) -> Column:
    return stable_id("raw_event", conversation, line)


def with_message_ids(messages: DataFrame, conversation: str = "conversation_id", native: str = "source_native_id", index: str = "sequence_index") -> DataFrame:
    """Adds id: by the native id, its n-th repeat with n, and messages without one by their position."""
    nth = F.row_number().over(Window.partitionBy(conversation, native).orderBy(index)) - 1
    own = F.when(F.col(native).isNull(), stable_id("message", F.col(conversation), F.concat(F.lit("#"), F.col(index).cast("string"))))
    own = own.when(F.col("__nth") == 0, stable_id("message", F.col(conversation), F.col(native)))
    return messages.withColumn("__nth", nth).withColumn("id", own.otherwise(stable_id("message", F.col(conversation), F.col(native), F.col("__nth")))).drop("__nth")


def with_parents(messages: DataFrame) -> DataFrame:
    """Adds parent_message_id: the conversation's first message with the parent's native id, or null.

    The join is a merge: what comes of a variant, which counts as 2 KB, Spark takes for a fraction of its size, and would send a row per message through the driver.
    """
    firsts = messages.where("source_native_id is not null").groupBy("conversation_id", F.col("source_native_id").alias("parent_source_native_id"))
    firsts = firsts.agg(F.min_by("id", "sequence_index").alias("parent_message_id"))
    return messages.join(firsts.hint("merge"), ["conversation_id", "parent_source_native_id"], "left")


def with_event_count(metadata: Column, n: Column) -> Column:
    """A JSON object's text with event_count set; keys sorted."""
    members = F.coalesce(F.try_variant_get(parsed(metadata), "$", "map<string, variant>"), F.expr("map()").cast("map<string, variant>"))
    others = F.map_filter(members, lambda k, v: k != "event_count")
    texts = F.transform(F.map_entries(others), lambda e: F.struct(e["key"].alias("k"), F.to_json(e["value"]).alias("v")))
    every = F.array_sort(F.concat(texts, F.array(F.struct(F.lit("event_count").alias("k"), n.cast("string").alias("v")))))
    return F.concat(F.lit("{"), F.array_join(F.transform(every, lambda e: F.concat(json_string(e["k"]), F.lit(":"), e["v"])), ","), F.lit("}"))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"^[{STRIP}]+|[{STRIP}]+$", "")


def first_line(text: Column) -> Column:
    """The first line of the stripped text, at most TITLE_LENGTH characters."""
    return F.substring(F.element_at(F.split(strip(text), LINE_END, 2), 1), 1, TITLE_LENGTH)


def first_user_line(blocks: DataFrame) -> DataFrame:
    """(conversation key columns, line) of blocks with conversation_key, sequence_index, block_index, role, type, text.

    Of each user message the first text block that isn't empty counts; if only white space is in it, the next message is tried.
    """
    texts = blocks.where("role = 'user' and type = 'text' and text != ''")
    own = texts.groupBy("conversation_key", "sequence_index").agg(F.min_by("text", "block_index").alias("text"))
    own = own.withColumn("line", first_line(F.col("text"))).where("line != ''")
    return own.groupBy("conversation_key").agg(F.min_by("line", "sequence_index").alias("line"))


#: The shapes of ISO times that are taken; those without a zone are UTC.
ISO_SHAPE = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})?)?$"


def iso_time(text: Column) -> Column:
    return F.when(text.rlike(ISO_SHAPE), F.try_to_timestamp(text))


def unix_time(seconds: Column) -> Column:
    """Seconds to a timestamp at microseconds, halves to even."""
    return F.timestamp_micros(F.bround(seconds * 1e6).cast("long"))


def unix_millis(millis: Column) -> Column:
    return unix_time(millis.cast("double") / 1000)


# JSON: columns of type variant. A JSON null and an absent key differ.


def parsed(text: Column) -> Column:
    """A JSON text as a variant; null for text that is not exactly one JSON value."""
    wrapped = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    items = F.try_variant_get(wrapped, "$", "array<variant>")
    return let(items, lambda own: F.when(F.size(own) == 1, F.get(own, F.lit(0))))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body over a value that is written out, and computed, once: inside lambdas nothing else finds what expressions have in common."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def kind(v: Column) -> Column:
    """OBJECT, ARRAY, STRING, ... of a variant; its array and object details are dropped."""
    return F.regexp_extract(F.schema_of_variant(v), r"^[A-Z]+", 0)


def get(v: Column, key: str) -> Column:
    return F.try_variant_get(v, f"$['{key}']" if not key.isidentifier() else f"$.{key}", "variant")


def get_string(v: Column, key: str) -> Column:
    """The value of a key if it is a JSON string."""
    own = get(v, key)
    return F.when(kind(own) == "STRING", F.try_variant_get(own, "$", "string"))


def non_empty(v: Column, key: str) -> Column:
    return F.when(get_string(v, key) != "", get_string(v, key))


def as_object(v: Column) -> Column:
    return F.when(kind(v).isin("OBJECT"), v)


def items_of(v: Column) -> Column:
    """The objects of a JSON array, in order; null if it is no array."""
    return F.when(kind(v) == "ARRAY", F.filter(F.try_variant_get(v, "$", "array<variant>"), lambda x: kind(x) == "OBJECT"))


def truthy(v: Column) -> Column:
    """Python's idea of truth for a JSON value; absent and null are false."""
    text = F.to_json(v)
    return F.coalesce(~F.is_variant_null(v) & ~text.isin("false", "0", "0.0", '""', "[]", "{}"), F.lit(False))


def canonical(text: Column) -> Column:
    """JSON text with sorted keys, for comparison by value."""
    return F.coalesce(F.to_json(F.try_parse_json(text)), text)


def object_text(**members: Column) -> Column:
    """JSON text of an object whose members are JSON texts themselves; keys sorted, a null member is a JSON null."""
    parts = [F.concat(F.lit(f'"{k}":'), F.coalesce(v, F.lit("null"))) for k, v in sorted(members.items())]
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def optional_object(**members: Column) -> Column:
    """The same with null members left out."""
    parts = [F.when(v.isNotNull(), F.concat(F.lit(f'"{k}":'), v)) for k, v in sorted(members.items())]
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def string_of(v: Column) -> Column:
    """The text of a variant that is a JSON string."""
    return F.when(kind(v) == "STRING", F.try_variant_get(v, "$", "string"))


def number_of(v: Column) -> Column:
    """The double of a variant that is a JSON number."""
    return F.when(kind(v).isin("TINYINT", "SMALLINT", "INT", "BIGINT", "DECIMAL", "FLOAT", "DOUBLE"), F.try_variant_get(v, "$", "double"))


def or_other(v: Column, other: Column) -> Column:
    """v if it is true in Python's sense, else other."""
    return F.when(truthy(v), v).otherwise(other)


def json_string(text: Column) -> Column:
    """A string as JSON text."""
    return F.when(text.isNotNull(), F.regexp_extract(F.to_json(F.array(text)), r"(?s)^\[(.*)\]$", 1))


def json_text(v: Column) -> Column:
    return F.to_json(v)
