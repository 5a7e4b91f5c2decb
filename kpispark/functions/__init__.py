"""Column expressions: guards, KPIs, calendar features and rules."""

from .calendar import (add_basic_calendar, add_full_calendar, basic_calendar,  # noqa: F401
                       day_of_week, full_calendar, iso_week)
from .exprs import (business_kpis, cap, clamp0, clamp0_money, cogs_ratio_pct,  # noqa: F401
                    error, error_pct, holiday_rule, lookup, promo_day_rule,
                    round_half_up, safe_div, seasonal_factor, within)
