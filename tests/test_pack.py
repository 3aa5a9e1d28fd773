"""V9 default plan: order, padding and signatures (driver-side planning)."""

from tablecare.operators.profile import Profile
from tablecare.plans.pack import dedup_specs, default_plan, signature


def _prof(types):
    cols = [dict(pos=i, name=n, column_type=t) for i, (n, t) in enumerate(types)]
    return Profile("t", 10, len(cols), 0, cols)


def test_padding_uses_next_columns_then_missing_bars():
    plan = default_plan(_prof([("a", "numeric"), ("c1", "categorical"), ("c2", "categorical"), ("c3", "categorical")]))
    assert [s["type"] for s in plan] == ["missing_values_bar", "numeric_distribution", "categorical_frequency",
                                         "boxplot_outliers", "grouped_bar", "categorical_frequency",
                                         "categorical_frequency"]
    assert [s.get("column") for s in plan[-2:]] == ["c2", "c3"]
    only_dates = default_plan(_prof([("d", "datetime")]))
    assert [s["type"] for s in only_dates] == ["missing_values_bar"] * 7


def test_signature_is_order_insensitive_and_dedups():
    a = {"type": "scatter", "x_column": "p", "y_column": "q"}
    b = {"type": "scatter", "x_column": "q", "y_column": "p"}
    assert signature(a) == signature(b) == "scatter|p_q|"
    assert dedup_specs([a, b, {"type": "missing_values_bar"}]) == [a, {"type": "missing_values_bar"}]
