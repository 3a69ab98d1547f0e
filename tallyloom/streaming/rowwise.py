"""Edits that look at one row at a time also work on a streaming DataFrame. Value filters with
``on_empty='keep'``, question tags, masks and number display do so as they are."""
from __future__ import annotations

from pyspark.sql import DataFrame

from tallyloom.operators.actions import apply_actions

ROWWISE_ACTIONS = ("drop_column", "rename_column", "change_type", "add_column", "filter_rows")


def _is_rowwise(action: dict) -> bool:
    if action.get("type") == "fill_missing":
        return action.get("params", {}).get("strategy") in ("constant", "zero")
    return action.get("type") in ROWWISE_ACTIONS


def apply_actions_to_stream(df: DataFrame, actions: list[dict]) -> DataFrame:
    """``apply_actions`` for a stream: values that cannot be converted become NULL, and actions
    that need the whole table are refused."""
    chosen = []
    for action in actions:
        if not _is_rowwise(action):
            raise ValueError(f"Action {action} needs the whole table.")
        params = dict(action.get("params", {}))
        if action["type"] == "change_type":
            params["strict"] = False
        chosen.append({"type": action["type"], "params": params})
    return apply_actions(df, chosen)
