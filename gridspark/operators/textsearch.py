"""Line-oriented search in documents.

Each document is handled inside its row with array functions, so nothing is shuffled however
many documents there are.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F


# The characters that end a line, and blanks around it.
_LINE_END = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85\u2028\u2029]"
_ENDS_LINE = "[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
_BLANKS = r"^[\s\p{Z}]+|[\s\p{Z}]+$"


def lines_of(text: Column) -> Column:
    """Lines of a text; a final line break does not add an empty line."""
    return F.split(F.regexp_replace(text, rf"({_LINE_END})\z", ""), _LINE_END)


def search_documents(
    df: DataFrame, keyword: str, text: str = "text", context: int = 2, first: int = 5
) -> DataFrame:
    """Documents with a line containing ``keyword`` (any case).

    ``match_count`` counts all matching lines; ``matches`` holds the first few with line number,
    trimmed line and the lines around.
    """
    wanted = keyword.lower()

    def hit(s: Column) -> Column:
        return F.contains(F.lower(s["line"]), F.lit(wanted))

    def shown(s: Column) -> Column:
        start = F.greatest(F.lit(0), s["i"] - context)
        length = s["i"] + context + 1 - start
        around = F.slice(F.col("_lines"), start + 1, length)
        return F.struct(
            (s["i"] + 1).alias("line_number"),
            F.regexp_replace(s["line"], _BLANKS, "").alias("matching_line"),
            F.array_join(around, "\n").alias("context"),
        )

    if re.search(_ENDS_LINE, keyword):
        candidates = df.where(F.lit(False))  # no line holds a line break
    else:
        # the whole text tells whether any line matches: other documents are never split
        candidates = df.where(F.contains(F.lower(text), F.lit(wanted)))
    numbered = F.transform("_lines", lambda line, i: F.struct(i.alias("i"), line.alias("line")))
    return (
        candidates.withColumn("_lines", lines_of(F.col(text)))
        .withColumn("_hits", F.filter(numbered, hit))
        .withColumn("match_count", F.size("_hits"))
        .withColumn("matches", F.transform(F.slice("_hits", 1, first), shown))
        .drop("_lines", "_hits", text)
    )


def match_rows(found: DataFrame) -> DataFrame:
    """One row per shown match.

    The outer form keeps Spark from inferring a filter on the array, which would be pushed down
    to the scan and search every text twice.
    """
    keep = [c for c in found.columns if c != "matches"]
    return found.select(*keep, F.inline_outer("matches"))


def document_titles(df: DataFrame, text: str = "text") -> DataFrame:
    """Title of every document: its first level-one heading, empty without one."""
    title = F.regexp_extract(F.col(text), r"(?m)^[ \t]*# (.*\S.*)$", 1)
    return df.withColumn("title", F.trim(F.ltrim(title, F.lit("# ")))).drop(text)


def document_by_key(df: DataFrame, key: str, value) -> DataFrame:
    """The whole text of one document."""
    return df.where(F.col(key) == value)
