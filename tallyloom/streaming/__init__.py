"""Row-wise operators on streaming tables."""
from tallyloom.streaming.rowwise import ROWWISE_ACTIONS, apply_actions_to_stream

__all__ = ["ROWWISE_ACTIONS", "apply_actions_to_stream"]
