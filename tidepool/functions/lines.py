"""Texts made fit for a line of a log, and the lines of a progress view."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MOST_BODY, MOST_DETAIL = 512, 256
#: White space of any script.
SPACES = r"[\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x0b]+"


def cut(text: Column, most: int = MOST_DETAIL) -> Column:
    """The first ``most`` characters, with an ellipsis where more were there."""
    return F.when(F.char_length(text) > most, F.concat(F.substring(text, 1, most), F.lit("\u2026"))).otherwise(text)


def one_line(text: Column, most: int = MOST_BODY) -> Column:
    """``text`` with every run of white space as one blank, none at its ends, cut to ``most`` characters."""
    return cut(F.trim(F.regexp_replace(text, SPACES, " ")), most)


def known(number: Column) -> Column:
    """The number as text, ``?`` for a null."""
    return F.coalesce(number.cast("string"), F.lit("?"))


def progress(name: Column, pools: Column, behind: Column, window: Column, in_flight: Column, missed: Column) -> Column:
    """A chain's line: its pools, how far it is behind, the window, requests on the way and logs that the stream missed."""
    return F.format_string("%s: Active  pools=%s  behind=%s  window=%s  inflight=%s  ws_miss=%s", name, known(pools), known(behind), known(window), known(in_flight), known(missed))
