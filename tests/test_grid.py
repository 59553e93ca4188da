import pytest

from lattica.functions import grid, suggest
from lattica.functions.stats import method_order


def test_parse_rejects_what_is_no_positive_number():
    assert grid.parse_list("0.5, 1") == [0.5, 1.0]
    for bad in ("", "1,,2", "1x", "nan", "inf", "-1", "0"):
        with pytest.raises(ValueError):
            grid.parse_list(bad)


def test_range_keeps_an_end_that_rounding_misses_and_omits_one_off_the_step():
    assert [round(x, 9) for x in grid.expand_range(0.1, 0.5, 0.1)] == [0.1, 0.2, 0.3, 0.4, 0.5]
    assert [round(x, 9) for x in grid.expand_range(0.1, 0.55, 0.2)] == [0.1, 0.3, 0.5]


def test_pool_of_counts():
    assert grid.min_pts_pool([8, 17, 34, 68], 8) == [8, 11, 15, 20, 27, 37, 50, 68]
    assert grid.min_pts_pool([8, 17, 34, 68], 1) == [8]
    assert grid.min_pts_pool([4, 9], 6) == [4, 5, 6, 7, 8, 9]
    with pytest.raises(ValueError):
        grid.min_pts_pool([4, 6], 6)


def test_plan_counts_of_published_plans():
    cases = [{"routes": ["r"] * r, "eps_indices": [0] * e, "minpts_indices": [0] * m} for r, e, m in ((1, 1, 1), (3, 2, 2))]
    assert grid.plan_counts(cases, 2, 1) == {"cases": 2, "variants": 8, "records": 16, "measured_fits": 28, "warmup_fits": 28, "total_fits": 56}


def test_resolve_needs_ascending_values():
    case = {"id": "a", "eps_indices": [0, 1], "minpts_indices": [0]}
    assert grid.resolve(case, [0.1, 0.2], [4])["eps"] == [0.1, 0.2]
    with pytest.raises(ValueError):
        grid.resolve(case, [0.2, 0.1], [4])


def test_sampled_rank_and_counts():
    assert suggest.sampled_rank(100, 20, 11) == 3
    assert suggest.sampled_rank(1, 1, 5) == 1
    assert suggest.min_pts(1000, 2.0) == [5, 10, 20, 40]


def test_method_order_rotates_by_pair_and_reverses_odd_blocks():
    assert method_order(["a", "b", "c"], 0, 0) == ["a", "b", "c"]
    assert method_order(["a", "b", "c"], 0, 1) == ["c", "b", "a"]
    assert method_order(["a", "b", "c"], 1, 0) == ["b", "c", "a"]
