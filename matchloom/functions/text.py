"""Null tokens and preprocessing as column expressions."""

from __future__ import annotations

import logging

from pyspark.sql import Column
from pyspark.sql import functions as F

logger = logging.getLogger("matchloom")
logger.addHandler(logging.NullHandler())


def set_verbose(verbose: bool = True, level: str = "INFO") -> None:
    """Whether this library's messages are shown, and from which level on; off, only warnings pass to the caller's handlers."""
    for handler in [h for h in logger.handlers if getattr(h, "shows", False)]:
        logger.removeHandler(handler)
    logger.setLevel(level if verbose else logging.WARNING)
    if verbose:
        handler = logging.StreamHandler()
        handler.shows = True
        handler.setFormatter(logging.Formatter("%(levelname)s %(name)s: %(message)s"))
        logger.addHandler(handler)

#: Strings that stand for a missing entry, once lower-cased and stripped.
NULL_TOKENS = ("nan", "null", "none", "", "na", "n/a")
#: White space and "neither word nor white space", as Python's str.strip and \w have them; Java's own classes differ.
WS = r"[\s\x1c-\x1f\x85\p{Z}]"
NOT_WORD = r"[^\p{L}\p{N}_\s\x1c-\x1f\x85\p{Z}]"


def strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"^{WS}+|{WS}+$", "")


def is_null_token(text: Column) -> Column:
    return text.isNull() | F.coalesce(strip(F.lower(text)).isin(*NULL_TOKENS), F.lit(False))


def simple_preprocess(text: Column) -> Column:
    return F.coalesce(strip(F.lower(text)), F.lit(""))


def smart_preprocess(text: Column) -> Column:
    spaced = F.regexp_replace(simple_preprocess(text), NOT_WORD, " ")
    return F.regexp_replace(strip(spaced), rf"{WS}+", " ")


def no_preprocess(text: Column) -> Column:
    return text


PREPROCESSORS = {"none": no_preprocess, "simple": simple_preprocess, "smart": smart_preprocess}


def preprocess(text: Column, name: str) -> Column:
    if name not in PREPROCESSORS:
        logger.warning("unknown preprocessor %s: simple is used", name)
    return PREPROCESSORS.get(name, simple_preprocess)(text)


def sorted_tokens(text: Column) -> Column:
    return F.array_join(F.array_sort(F.array_remove(F.split(text, rf"{WS}+"), "")), " ")
