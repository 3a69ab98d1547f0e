"""Typed tags for a table of questions: time range, comparison, ranking, mentioned columns and
values, follow-ups."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.columns import ref, require
from tallyloom.functions.fixed import (
    COMPARE_PAIR_PATTERN, COMPARE_PATTERN, EDIT_PHRASES, FOLLOW_UP_MAX_WORDS, FOLLOW_UP_STARTS,
    FOLLOW_UP_WORDS, HISTORY_LENGTH, OVERVIEW_WORDS, RANKED_PATTERN, TIME_RANGE_PATTERNS,
    TOP_WORDS,
)
from tallyloom.operators.ordered import forward_fill
from tallyloom.operators.series import DEFAULT_TOP, latest_entries
from tallyloom.operators.staging import stage


# word boundaries, digits and blanks of all scripts
_ANY_SCRIPT = "(?U)"


def _matches(text: Column, pattern: str) -> Column:
    return text.rlike(_ANY_SCRIPT + pattern)


def _contains_any(text: Column, words: list[str]) -> Column:
    found = F.lit(False)
    for word in words:
        found = found | F.contains(text, F.lit(word))
    return found


def _part(text: Column, pattern: str, group: int) -> Column:
    return F.nullif(F.regexp_extract(text, _ANY_SCRIPT + pattern, group), F.lit(""))


def time_range(text: Column) -> Column:
    """The first time range a text names: struct(kind, n, unit, year), NULL without one."""
    found = F.lit(None).cast("struct<kind:string,n:int,unit:string,year:int>")
    for pattern, kind in reversed(TIME_RANGE_PATTERNS):
        n = unit = year = F.lit(None)
        if kind == "last_n":
            n, unit = _part(text, pattern, 1).try_cast("int"), _part(text, pattern, 2)
        elif kind == "year":
            year = _part(text, pattern, 1).try_cast("int")
        tag = F.struct(F.lit(kind).alias("kind"), n.cast("int").alias("n"),
                       unit.cast("string").alias("unit"), year.cast("int").alias("year"))
        found = F.when(_matches(text, pattern), tag).otherwise(found)
    return found


def comparison(text: Column) -> Column:
    """The words left and right of vs / versus / against; both NULL when a comparison is only
    announced, NULL as a whole without one."""
    tag = F.struct(_part(text, COMPARE_PAIR_PATTERN, 1).alias("left"),
                   _part(text, COMPARE_PAIR_PATTERN, 2).alias("right"))
    return F.when(_matches(text, COMPARE_PATTERN), tag)


def ranking(text: Column) -> Column:
    """struct(direction, n) of the first top or bottom word; n is 5 when not given."""
    word = F.regexp_extract(text, _ANY_SCRIPT + RANKED_PATTERN, 1)
    n = F.coalesce(_part(text, RANKED_PATTERN, 2).try_cast("int"), F.lit(DEFAULT_TOP))
    direction = F.when(word.isin(TOP_WORDS), "top").otherwise("bottom")
    return F.when(_matches(text, RANKED_PATTERN),
                  F.struct(direction.alias("direction"), n.alias("n")))


def mentioned(text: Column, names: list[str]) -> Column:
    """The names, or their forms with spaces for underscores, found in the text."""
    hits = []
    for name in names:
        plain = name.lower()
        found = F.contains(text, F.lit(plain)) | F.contains(text, F.lit(plain.replace("_", " ")))
        hits.append(F.when(found, F.lit(name)))
    if not hits:
        return F.array().cast("array<string>")
    return F.filter(F.array(*hits), lambda x: x.isNotNull())


def mentioned_values(text: Column, values: dict[str, list[str]]) -> Column:
    """Per column the first of its known values found in the text: array of
    struct(column, value). The profile gives three values per column."""
    tags = []
    for name, known in values.items():
        known = [str(v).strip() for v in known if len(str(v).strip()) >= 2]
        if known:
            first = F.coalesce(*[
                F.when(F.contains(text, F.lit(v.lower())), F.lit(v)) for v in known])
            tags.append(F.when(first.isNotNull(), F.struct(
                F.lit(name).alias("column"), first.alias("value"))))
    if not tags:
        return F.array().cast("array<struct<column:string,value:string>>")
    return F.filter(F.array(*tags), lambda x: x.isNotNull())


def follow_up(text: Column) -> Column:
    """Short questions and those that point back."""
    words = F.size(F.filter(F.split(text, _ANY_SCRIPT + r"\s+"), lambda w: w != ""))
    starts = F.lit(False)
    for opening in FOLLOW_UP_STARTS:
        starts = starts | F.startswith(text, F.lit(opening))
    return (words <= FOLLOW_UP_MAX_WORDS) | starts | _contains_any(text, FOLLOW_UP_WORDS)


def tag_questions(
    df: DataFrame, text: str = "text", metrics: list[str] | None = None,
    dimensions: list[str] | None = None, values: dict[str, list[str]] | None = None,
) -> DataFrame:
    """Add the tags time, comparison, ranking, metrics, dimensions, filters, is_overview,
    is_edit and is_follow_up. Row by row, without any shuffle."""
    require(df, text)
    q = F.col("_question")
    tagged = df.withColumn("_question", F.lower(F.trim(ref(text)))).withColumns({
        "time": time_range(q),
        "comparison": comparison(q),
        "ranking": ranking(q),
        "metrics": mentioned(q, metrics or []),
        "dimensions": mentioned(q, dimensions or []),
        "filters": mentioned_values(q, values or {}),
        "is_edit": _contains_any(q, EDIT_PHRASES),
        "is_follow_up": follow_up(q),
    })
    overview = _contains_any(q, OVERVIEW_WORDS) & (F.size("metrics") == 0)
    return tagged.withColumn("is_overview", overview).drop("_question")


CARRIED = ("time", "metrics", "dimensions", "filters")


def carry_context(tagged: DataFrame, session: list[str], order_by: list[str]) -> DataFrame:
    """Follow-ups take over the time, metrics, dimensions and filters they do not name, from the
    questions before them up to the last one that stood on its own. A tag that is carried is a
    forward fill of the tag wrapped in a struct: a question that stands on its own always has
    one, so it also stops what came before. The tags are kept first: finding them costs more than
    reading them twice."""
    tagged, wrapped = stage(tagged), {}
    for name in CARRIED:
        named = ref(name).isNotNull() if name == "time" else F.size(name) > 0
        wrapped[f"_{name}"] = F.when(~F.col("is_follow_up") | named, F.struct(ref(name).alias("x")))
    filled = forward_fill(tagged.withColumns(wrapped), list(wrapped), order_by, session)
    return filled.withColumns({
        n: F.coalesce(F.col(f"_{n}.x"), ref(n)) for n in CARRIED}).drop(*wrapped)


def session_history(df: DataFrame, session: list[str], order_by: list[str],
                    n: int = HISTORY_LENGTH) -> DataFrame:
    """The latest questions of each session."""
    return latest_entries(df, session, order_by, n)
