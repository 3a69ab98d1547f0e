"""Question tags over a query log made from the orders, and over the raw conversations."""
from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.catalog.registry import query
from tallyloom.functions.fixed import (
    COMPARE_PAIR_PATTERN, COMPARE_PATTERN, EDIT_PHRASES, FOLLOW_UP_STARTS, FOLLOW_UP_WORDS,
    OVERVIEW_WORDS, RANKED_PATTERN, TIME_RANGE_PATTERNS, TOP_WORDS,
)
from tallyloom.operators.questions import carry_context, session_history, tag_questions

# one question per order: its form follows status and priority, its numbers the date
_LOG = """SELECT o_custkey AS session, o_orderkey AS turn,
    CASE o_orderstatus || substr(o_orderpriority, 1, 1)
      WHEN 'F1' THEN 'Show total price for the last ' || month(o_orderdate) || ' months split into groups please'
      WHEN 'F2' THEN 'Top ' || day(o_orderdate) || ' customers with the largest total price overall in every group'
      WHEN 'F3' THEN 'Please give me an overview of everything we have seen in ' || year(o_orderdate)
      WHEN 'F4' THEN 'total price vs custkey for status F and the others over all the data'
      WHEN 'F5' THEN 'now by order priority'
      WHEN 'O1' THEN 'what about ' || o_orderpriority || ' only'
      WHEN 'O2' THEN 'Compare total price and custkey for each of the order status values year over year'
      WHEN 'O3' THEN 'drop column custkey and rename column total price to paid for all of the rows'
      WHEN 'O4' THEN 'lowest custkey for ' || o_orderpriority || ' this quarter and nothing else from the table'
      WHEN 'O5' THEN 'same for last quarter'
      WHEN 'P1' THEN 'and in ' || year(o_orderdate)
      WHEN 'P2' THEN 'How did total price develop during the past ' || day(o_orderdate) || ' weeks across the whole company'
      WHEN 'P3' THEN 'worst order priority year to date with all of the details for me and the team'
      WHEN 'P4' THEN 'show me the dashboard'
      ELSE 'total price against custkey for 5-LOW or 3-MEDIUM orders latest year with full analysis' END AS text
    FROM orders"""
_METRICS, _DIMENSIONS = ["total_price", "custkey"], ["order_status", "order_priority"]
_VALUES = {"order_priority": ["1-URGENT", "2-HIGH", "3-MEDIUM"], "order_status": ["F", "status F"]}


def _log(t):
    return t.orders.select(
        F.col("o_custkey").alias("session"), F.col("o_orderkey").alias("turn"),
        F.expr(_LOG[_LOG.index("CASE"):_LOG.index(" AS text")]).alias("text"))


def _tagged(t):
    return tag_questions(_log(t), "text", _METRICS, _DIMENSIONS, _VALUES)


def _any(words: list[str]) -> str:
    return " OR ".join(f"contains(q, '{w}')" for w in words)


def _first_match(column: str) -> str:
    whens = []
    for pattern, kind in TIME_RANGE_PATTERNS:
        value = {
            "kind": f"'{kind}'",
            "n": f"TRY_CAST(regexp_extract(q, '{pattern}', 1) AS INTEGER)" if kind == "last_n" else "NULL",
            "unit": f"regexp_extract(q, '{pattern}', 2)" if kind == "last_n" else "NULL",
            "year": f"TRY_CAST(regexp_extract(q, '{pattern}', 1) AS INTEGER)" if kind == "year" else "NULL",
        }[column]
        whens.append(f"WHEN regexp_matches(q, '{pattern}') THEN {value}")
    return "CASE " + " ".join(whens) + " END"


def _mentioned(names: list[str]) -> str:
    found = ", ".join(
        f"CASE WHEN contains(q, '{n}') OR contains(q, '{n.replace('_', ' ')}') THEN '{n}' END" for n in names)
    return f"concat_ws(', ', {found})"


def _values_sql() -> str:
    tags = []
    for column, values in _VALUES.items():
        whens = " ".join(f"WHEN contains(q, '{v.lower()}') THEN '{column}={v}'" for v in values if len(v) > 1)
        tags.append(f"CASE {whens} END")
    return f"concat_ws(', ', {', '.join(tags)})"


_STARTS = " OR ".join(f"starts_with(q, '{s}')" for s in FOLLOW_UP_STARTS)
_WORDS = "len(list_filter(regexp_split_to_array(q, '\\s+'), lambda w: w <> ''))"
_FOLLOW = f"({_WORDS} <= 6 OR {_STARTS} OR {_any(FOLLOW_UP_WORDS)})"
_Q = f"l AS ({_LOG}), b AS (SELECT *, lower(trim(text)) AS q FROM l)"


@query("G1", f"""WITH {_Q} SELECT turn, {_first_match('kind')} AS kind, {_first_match('n')} AS n,
    {_first_match('unit')} AS unit, {_first_match('year')} AS year FROM b""")
def question_time_ranges(t):
    return _tagged(t).select("turn", "time.kind", "time.n", "time.unit", "time.year")


@query("G2", f"""WITH {_Q} SELECT turn, regexp_matches(q, '{COMPARE_PATTERN}') AS compares,
    CASE WHEN regexp_matches(q, '{COMPARE_PATTERN}') THEN nullif(regexp_extract(q, '{COMPARE_PAIR_PATTERN}', 1), '') END AS "left",
    CASE WHEN regexp_matches(q, '{COMPARE_PATTERN}') THEN nullif(regexp_extract(q, '{COMPARE_PAIR_PATTERN}', 2), '') END AS "right"
    FROM b""")
def question_comparisons(t):
    return _tagged(t).select("turn", F.col("comparison").isNotNull().alias("compares"),
                             "comparison.left", "comparison.right")


@query("G3", f"""WITH {_Q} SELECT turn,
    CASE WHEN regexp_extract(q, '{RANKED_PATTERN}', 1) IN ({', '.join(f"'{w}'" for w in TOP_WORDS)}) THEN 'top'
         WHEN regexp_matches(q, '{RANKED_PATTERN}') THEN 'bottom' END AS direction,
    CASE WHEN regexp_matches(q, '{RANKED_PATTERN}')
         THEN coalesce(TRY_CAST(nullif(regexp_extract(q, '{RANKED_PATTERN}', 2), '') AS INTEGER), 5) END AS n FROM b""")
def question_rankings(t):
    return _tagged(t).select("turn", "ranking.direction", "ranking.n")


@query("G4 G8", f"""WITH {_Q} SELECT turn, ({_any(OVERVIEW_WORDS)}) AND {_mentioned(_METRICS)} = '' AS is_overview,
    ({_any(EDIT_PHRASES)}) AS is_edit FROM b""")
def question_overviews_and_edits(t):
    return _tagged(t).select("turn", "is_overview", "is_edit")


@query("G5 G6", f"""WITH {_Q} SELECT turn, {_mentioned(_METRICS)} AS metrics, {_mentioned(_DIMENSIONS)} AS dimensions,
    {_values_sql()} AS filters FROM b""")
def question_mentions(t):
    shown = F.transform("filters", lambda f: F.concat(f["column"], F.lit("="), f["value"]))
    return _tagged(t).select("turn", F.array_join("metrics", ", ").alias("metrics"),
                             F.array_join("dimensions", ", ").alias("dimensions"),
                             F.array_join(shown, ", ").alias("filters"))


@query("G7", f"""
    WITH {_Q},
    g AS (SELECT session, turn, {_FOLLOW} AS follow, {_first_match('kind')} AS kind,
                 nullif({_mentioned(_METRICS)}, '') AS metrics, nullif({_mentioned(_DIMENSIONS)}, '') AS dimensions,
                 nullif({_values_sql()}, '') AS filters FROM b),
    s AS (SELECT *, sum(CASE WHEN follow THEN 0 ELSE 1 END) OVER (PARTITION BY session ORDER BY turn) AS seg FROM g)
    SELECT session, turn, follow AS is_follow_up,
           last_value(kind IGNORE NULLS) OVER w AS kind,
           coalesce(last_value(metrics IGNORE NULLS) OVER w, '') AS metrics,
           coalesce(last_value(dimensions IGNORE NULLS) OVER w, '') AS dimensions,
           coalesce(last_value(filters IGNORE NULLS) OVER w, '') AS filters
    FROM s WINDOW w AS (PARTITION BY session, seg ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def question_context(t):
    carried = carry_context(_tagged(t), ["session"], ["turn"])
    shown = F.transform("filters", lambda f: F.concat(f["column"], F.lit("="), f["value"]))
    return carried.select("session", "turn", "is_follow_up", "time.kind",
                          F.array_join("metrics", ", ").alias("metrics"),
                          F.array_join("dimensions", ", ").alias("dimensions"),
                          F.array_join(shown, ", ").alias("filters"))


@query("G3 G4 G7", f"""
    WITH b AS (SELECT conv_id, turn, lower(trim(text)) AS q FROM conversations)
    SELECT conv_id, turn, {_FOLLOW} AS is_follow_up, ({_any(OVERVIEW_WORDS)}) AS is_overview,
           regexp_matches(q, '(?:^|[^\\pL\\pN_])(top|bottom|best|worst|highest|lowest)\\d*(?:$|[^\\pL\\pN_])')
               AS is_ranked FROM b""")
def conversation_tags(t):
    tagged = tag_questions(t.conversations)
    return tagged.select("conv_id", "turn", "is_follow_up", "is_overview",
                         F.col("ranking").isNotNull().alias("is_ranked"))


@query("W6", f"""
    WITH {_Q} SELECT session, turn, text FROM l
    QUALIFY row_number() OVER (PARTITION BY session ORDER BY turn DESC) <= 20""")
def recent_questions(t):
    return session_history(_log(t), ["session"], ["turn"])
