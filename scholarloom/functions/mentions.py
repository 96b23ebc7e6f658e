"""Mentions of papers, repositories and transcripts in free text, in order of first sight."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from scholarloom import settings
from scholarloom.functions.text import casefold


def _all(text: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(group))


def paper_mentions(text: Column) -> Column:
    return F.array_distinct(F.transform(_all(text, settings.PAPER_MENTION, 1), casefold))


def repository_mentions(text: Column) -> Column:
    home = "https://github.com/"

    def canonical(url: Column) -> Column:
        return F.concat(F.lit(home), F.regexp_replace(F.substring(url, F.lit(len(home) + 1), F.length(url)), r"\.git$", ""))

    return F.array_distinct(F.transform(_all(text, settings.REPOSITORY_MENTION, 0), canonical))


def repository_links(*texts: Column) -> Column:
    """Whole repository links with closing punctuation taken off, as paper abstracts carry them."""
    found = F.concat(*[_all(t, settings.REPOSITORY_MENTION, 0) for t in texts])
    return F.array_distinct(F.transform(found, lambda u: F.regexp_replace(u, r"[.,);\]]+$", "")))


def transcript_mentions(text: Column) -> Column:
    return F.array_distinct(_all(text, settings.TRANSCRIPT_MENTION, 0))
