"""Lenient numbers and query strings."""

from pyspark.sql import Column, functions as F


def whole_number(text: Column, dtype: str) -> Column:
    """A whole number in ``text`` (``2``, ``"2"``, ``1.0``), NULL if it has a
    fraction, does not fit ``dtype`` or is no number."""
    exact = text.try_cast("decimal(38,18)")
    # The decimal detour is only taken for text that is no plain integer.
    return F.coalesce(text.try_cast(dtype), F.when(exact % 1 == 0, exact.try_cast(dtype)))


def query_parameters(query: Column) -> Column:
    """``a=1&b=2`` to an array of ``(name, value)``, both URL-decoded."""

    def pair(halves: Column) -> Column:
        return F.struct(
            F.try_url_decode(F.get(halves, 0)).alias("name"),
            F.try_url_decode(F.get(halves, 1)).alias("value"),
        )

    return F.transform(F.transform(F.split(query, "&"), lambda part: F.split(part, "=")), pair)


def first_parameter(parameters: Column, name: str) -> Column:
    """Struct of the first parameter called ``name``; NULL if there is none."""
    return F.get(F.filter(parameters, lambda p: p["name"] == name), 0)
