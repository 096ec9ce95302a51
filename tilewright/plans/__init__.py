"""Building blocks that several operators share: latest rows, hot-key joins, written stages."""

from tilewright.plans.latest import latest_rows
from tilewright.plans.rank import ranked
from tilewright.plans.skew import broadcast_if_small, heavy_hitters, lookup_join, split_join, spread
from tilewright.plans.stage import materialize, release, stages

__all__ = ["broadcast_if_small", "heavy_hitters", "latest_rows", "lookup_join", "materialize", "ranked", "release", "split_join", "spread", "stages"]
