"""Text columns: blanks, tolerant JSON, digests, client address, sizes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

STRING_MAP = "map<string,string>"


def given(value: Column) -> Column:
    """Null for a missing or empty text, else the text."""
    return F.nullif(value, F.lit(""))


def or_else(value: Column, default) -> Column:
    """The text, or `default` when missing or empty."""
    return F.coalesce(given(value), F.lit(default))


def _enclosed(raw: Column, opening: str, closing: str) -> Column:
    """The text if it is enclosed by the brackets, else null.

    The JSON reader takes an object for an array of one and ignores what
    follows a complete value; neither is valid here.
    """
    trimmed = F.trim(raw)
    return F.when(trimmed.startswith(opening) & trimmed.endswith(closing), raw)


def json_object(raw: Column) -> Column:
    """A JSON object as a string map; null for anything else."""
    return F.from_json(_enclosed(raw, "{", "}"), STRING_MAP)


def json_array(raw: Column, schema) -> Column:
    """A JSON array; null for anything else."""
    return F.from_json(_enclosed(raw, "[", "]"), schema)


def tolerant_json(raw: Column) -> Column:
    """A JSON object as a string map; other text as {raw: text}; blank as {}."""
    empty = F.from_json(F.lit("{}"), STRING_MAP)
    parsed = json_object(raw)
    return (
        F.when(given(raw).isNull(), empty)
        .when(parsed.isNotNull(), parsed)
        .otherwise(F.create_map(F.lit("raw"), raw))
    )


def md5_hex(content: Column) -> Column:
    return F.md5(content)


def sha256_hex(content: Column) -> Column:
    return F.sha2(content, 256)


def client_address(forwarded: Column, socket: Column) -> Column:
    """First entry of a forwarded list, else the socket address, else ''."""
    first = F.trim(F.element_at(F.split(forwarded, ","), 1))
    return F.coalesce(F.when(given(forwarded).isNotNull(), first), socket, F.lit(""))


def megabytes(size: Column) -> Column:
    return size / F.lit(1024.0) / F.lit(1024.0)


def human_size(size: Column) -> Column:
    """`0 Bytes`, `512 Bytes`, `1.5 KB`, … with at most two decimals."""
    units = ["Bytes", "KB", "MB", "GB"]
    result = F.when(size == 0, F.lit("0 Bytes"))
    for power, unit in enumerate(units):
        scaled = F.round(size / F.lit(float(1024**power)), 2)
        label = F.concat(
            F.regexp_replace(F.format_string("%.2f", scaled), r"\.?0+$", ""), F.lit(f" {unit}")
        )
        if power + 1 < len(units):
            result = result.when(size < 1024 ** (power + 1), label)
        else:
            result = result.otherwise(label)
    return result


def not_test_device(device_id: Column) -> Column:
    """True unless the device name contains `test` in any case."""
    return ~F.lower(device_id).contains("test")
