"""Signed byte ranges. What is stated is whether a range is complete and a container is present; no signature is verified."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def signed_bytes(raw: Column, first: Column, first_length: Column, second: Column, second_length: Column) -> Column:
    """The bytes of both parts of a range; null where they overlap or reach over the end."""
    ok = (first >= 0) & (first_length >= 0) & (second_length >= 0) & (first + first_length <= second) & (second + second_length <= F.length(raw))
    part = lambda at, n: F.substring(raw, (at + 1).cast("int"), n.cast("int"))
    return F.when(ok, F.concat(part(first, first_length), part(second, second_length)))


def byte_range_status(second: Column, second_length: Column, size: Column, contents: Column) -> Column:
    """IncompleteByteRange if bytes at the end are not covered, Failed without contents, Unsupported if they are no DER sequence."""
    return (
        F.when(second + second_length < size, "IncompleteByteRange")
        .when(F.length(contents) == 0, "Failed")
        .when(F.hex(F.substring(contents, 1, 1)) != "30", "Unsupported")
        .otherwise("DigestPresent")
    )
