"""Finding a function by its spreadsheet name."""

from __future__ import annotations

from collections.abc import Callable

from ..operators import criteria, database
from . import dates, distributions, engineering, financial, logical, math, reference, stats, text

_MODULES = (math, logical, text, dates, stats, distributions, financial, engineering, reference, criteria, database)
#: Names that Python or another function already has.
_OTHER = {
    "VALUE": text.VALUE_, "NA": logical.NA_, "AVEDEV": stats.avedev, "FREQUENCY": stats.frequency, "MODE.SNGL": stats.modes, "MODE.MULT": stats.modes, "PERCENTRANK.INC": stats.percentrank_inc, "PERCENTRANK.EXC": stats.percentrank_exc,
    "RANK": stats.ranked, "RANK.EQ": stats.ranked, "RANK.AVG": stats.ranked, "LINEST": stats.linest, "LOGEST": stats.linest, "TREND": stats.trend, "GROWTH": stats.trend, "T.TEST": stats.t_test, "F.TEST": stats.f_test, "Z.TEST": stats.z_test, "CHISQ.TEST": stats.chisq_test, "SUBTOTAL": database.subtotal,
}


def find(name: str) -> Callable:
    """The function of a spreadsheet name such as NORM.DIST."""
    if name.upper() in _OTHER:
        return _OTHER[name.upper()]
    plain = name.upper().replace(".", "_")
    for module in _MODULES:
        if callable(getattr(module, plain, None)):
            return getattr(module, plain)
    raise KeyError(name)
