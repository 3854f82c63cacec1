"""Functions over agent replies and observation envelopes held as JSON text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import first_n, strip

# Action domain, defaults and limits.
ACTION_TYPES = ("bash", "python")
DEFAULT_ACTION = "bash"
EMPTY_REPLY_COMMAND = "ls"
FALLBACK_LENGTH = 500
FENCE = "```"


def _unfenced(reply: Column) -> Column:
    text = strip(reply)
    kept = F.filter(F.split(text, "\n", -1), lambda line: ~F.startswith(strip(line), F.lit(FENCE)))
    return F.when(F.startswith(text, F.lit(FENCE)), strip(F.array_join(kept, "\n"))).otherwise(text)


def _kind(v: Column) -> Column:
    return F.schema_of_variant(v)


def parse_action(reply: Column) -> Column:
    """``struct<action_type, command>`` of a reply.

    A JSON object with a known ``action_type`` and a string ``command`` (either may
    be left out) is taken as is; any other text becomes a command itself.
    """
    text = _unfenced(F.coalesce(reply, F.lit("")))
    doc = F.try_parse_json(text)
    action = F.variant_get(doc, "$.action_type", "variant")
    command = F.variant_get(doc, "$.command", "variant")
    action_text = action.cast("string")
    valid = F.coalesce(
        F.startswith(_kind(doc), F.lit("OBJECT"))
        & (action.isNull() | ((_kind(action) == "STRING") & action_text.isin(*ACTION_TYPES)))
        & (command.isNull() | (_kind(command) == "STRING")),
        F.lit(False),
    )
    pair = lambda a, b: F.struct(a.alias("action_type"), b.alias("command"))
    return (
        F.when(strip(F.coalesce(reply, F.lit(""))) == "", pair(F.lit(DEFAULT_ACTION), F.lit(EMPTY_REPLY_COMMAND)))
        .when(
            valid,
            pair(F.coalesce(action_text, F.lit(DEFAULT_ACTION)), F.coalesce(command.cast("string"), F.lit(""))),
        )
        .otherwise(pair(F.lit(DEFAULT_ACTION), first_n(text, FALLBACK_LENGTH)))
    )


def flatten_observation(envelope: Column) -> list[Column]:
    """Observation fields of a JSON envelope.

    ``reward`` and ``done`` beside the observation win over those inside it as soon
    as their keys are present, even with a null value.
    """
    doc = F.try_parse_json(envelope)
    inner = lambda name, kind: F.try_variant_get(doc, f"$.data.observation.{name}", kind)

    def lifted(name: str, kind: str) -> Column:
        outer = F.variant_get(doc, f"$.data.{name}", "variant")
        return (
            F.when(outer.isNotNull(), F.try_variant_get(doc, f"$.data.{name}", kind))
            .otherwise(inner(name, kind))
            .alias(name)
        )

    return [
        inner("stdout", "string").alias("stdout"),
        inner("stderr", "string").alias("stderr"),
        inner("exit_code", "int").alias("exit_code"),
        inner("file_tree", "array<string>").alias("file_tree"),
        lifted("done", "boolean"),
        lifted("reward", "double"),
        inner("error", "string").alias("error"),
    ]
