"""Scale-safe building blocks."""

from mercato.operators.joins import checked_broadcast, deal_hot_keys, has_at_most, orphans, outer_join
from mercato.operators.windows import (
    Numbering,
    global_ntile,
    global_rank,
    global_row_number,
    numbered,
    sequence_ids,
    top_n_per_group,
)

__all__ = [
    "Numbering",
    "checked_broadcast",
    "deal_hot_keys",
    "global_ntile",
    "global_rank",
    "global_row_number",
    "has_at_most",
    "numbered",
    "orphans",
    "outer_join",
    "sequence_ids",
    "top_n_per_group",
]
