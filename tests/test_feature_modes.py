"""Feature modes made together: one shuffle of the skeletons, and what each mode gives alone."""

import pytest

from kinelink.operators import features
from kinelink.plans import catalog, standins

SF = "/root/testdata/sf0.001"


def test_all_modes_read_the_skeletons_once(spark):
    plan = catalog.QUERIES["h36m_features"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("Exchange hashpartitioning") == 1


@pytest.mark.parametrize("kernel", [1, 9])
def test_modes_together_give_what_each_gives_alone(spark, kernel):
    s = standins.skeletons(spark, SF).filter("seq < 3")
    together = {(r.seq, r.frame_idx): r for r in features.h36m_modes(s, ["seq"], "frame_idx", "joints", features.H36M_MODES, kernel).collect()}
    for mode in ("h36m2d", "h36m3d_bone", "h36m3d_heading", "h36m3d_rotinv", "h36m3d_geom", "h36m3d_left_wrist_rot"):
        alone = features.h36m_features(s, ["seq"], "frame_idx", "joints", mode, kernel).collect()
        assert len(alone) == len(together)
        for r in alone:
            assert len(r.features) == features.h36m_width(mode) and r.features == together[r.seq, r.frame_idx][mode]
