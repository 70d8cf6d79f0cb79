from .calendar import CALENDAR_FEATURES, calendar_columns
from .columns import (
    is_fraction, is_missing, np_round, plain_number, quotient, settled, to_date,
    to_flag, to_number, units,
)
from .quantiles import exact_quantiles

__all__ = [
    "CALENDAR_FEATURES", "calendar_columns", "exact_quantiles", "is_fraction",
    "is_missing", "np_round", "plain_number", "quotient", "settled", "to_date",
    "to_flag", "to_number", "units",
]
