"""What the filled features carry through their joins and write."""

from conftest import SF
from courtside.plans.queries import Base
from courtside.schema import FEATURES


def test_filled_features_leave_out_sides(spark):
    got = Base(spark, SF).filled
    assert not [c for c in got.columns if c.startswith(("winner_", "loser_"))] and {*FEATURES, "match_num", "result"} <= {*got.columns}
