"""Versioned JSON envelopes, deliveries and signal requests as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runfold.functions import scalars as S

VERSION = 1
#: Names under which providers return a reference, in order of preference; fixed values.
REFERENCES = ("reference", "external_ref", "id", "reference_id")


def wrap(data: Column) -> Column:
    """A struct column as an envelope."""
    return F.to_json(F.struct(F.lit(VERSION).alias("v"), data.alias("data")))


def decode(raw: Column, schema: str) -> Column:
    """struct(data, error): the body, null where the text is no JSON or of another version."""
    parsed = F.from_json(raw, f"v int, data struct<{', '.join(f'{n}:{t}' for n, t in (x.split() for x in schema.split(', ')))}>")
    bad = F.try_parse_json(raw).isNull()
    error = F.when(bad, "undecodable").when(F.coalesce(parsed["v"], F.lit(0)) != VERSION, "unknown version")
    return F.struct(F.when(error.isNull(), parsed["data"]).alias("data"), error.alias("error"))


def encode_delivery(task_id: Column) -> Column:
    return F.to_json(F.struct(F.lit(VERSION).alias("v"), task_id.alias("task_id")))


def decode_delivery(raw: Column) -> Column:
    """struct(task_id, error): refuses other versions and empty ids."""
    parsed = F.from_json(raw, "v int, task_id string")
    error = F.when(F.try_parse_json(raw).isNull(), "undecodable").when(F.coalesce(parsed["v"], F.lit(0)) != VERSION, "unknown version").when(F.coalesce(parsed["task_id"], F.lit("")) == "", "no task")
    return F.struct(F.when(error.isNull(), parsed["task_id"]).alias("task_id"), error.alias("error"))


def external_reference(body: Column) -> Column:
    """The first non-empty string among the reference fields; numbers don't count, nor does what is no JSON object."""
    value = F.try_parse_json(body)

    def text(name: str) -> Column:
        field = F.try_variant_get(value, f"$.{name}", "variant")
        return F.when(F.schema_of_variant(field) == "STRING", F.nullif(F.try_variant_get(value, f"$.{name}", "string"), F.lit("")))

    return F.coalesce(*[text(n) for n in REFERENCES])


def or_null(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def as_object(text: Column) -> Column:
    """The text where it is a JSON object, else {}."""
    value = F.try_parse_json(text)
    return F.when(F.coalesce(F.schema_of_variant(value).startswith("OBJECT"), F.lit(False)), text).otherwise(F.lit("{}"))


def effect_body(task_id: Column, key: Column, kind: Column, effect_class: Column, status: Column, reference: Column | None = None, error: Column | None = None, detail: Column | None = None) -> Column:
    """The body of an event about an effect, as JSON; what is not known is left out."""
    none = F.lit(None).cast("string")
    named = {"task_id": task_id, "idempotency_key": key, "effect_type": kind, "effect_class": effect_class, "status": status, "external_ref": reference, "error": error, "detail": detail}
    return F.to_json(F.struct(*[(none if c is None else c).alias(n) for n, c in named.items()]))


def or_empty_object(text: Column) -> Column:
    return F.coalesce(F.nullif(text, F.lit("")), F.lit("{}"))


def signal_status(requests: DataFrame, runs: DataFrame, most_bytes: int) -> DataFrame:
    """requests (run_id, body, size, idempotency_key) with the HTTP ``code`` that a signal endpoint answers, and the signal's id."""
    joined = requests.join(runs.select("run_id", F.col("status").alias("__status")), "run_id", "left")
    code = (
        F.when(F.col("size") > most_bytes, 413)
        .when((F.coalesce("body", F.lit("")) != "") & F.try_parse_json("body").isNull(), 400)
        .when(F.col("__status").isNull(), 404)
        .when(S.run_terminal(F.col("__status")), 409)
        .otherwise(202)
    )
    return joined.withColumn("code", code.cast("long")).withColumn("signal_id", F.col("idempotency_key")).drop("__status")
