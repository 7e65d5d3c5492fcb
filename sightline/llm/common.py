"""Expression helpers, and the written tables of the whole library."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from sightline.scratch import shared_dir, written

__all__ = ["NOT_WHITE", "WHITE", "let", "shared_dir", "words", "written"]

#: ASCII white space, which separates words everywhere in this subpackage.
WHITE = r"[\x20\x09-\x0D]+"
NOT_WHITE = r"[^\x20\x09-\x0D]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once even where body uses it inside other lambdas."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """Runs of anything but ASCII white space, in order; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), WHITE), lambda w: w != "")
