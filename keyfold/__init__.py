"""keyfold: keyed aggregation, expressed as DataFrame plans."""

from keyfold.functions.registry import AggFunction, Udaf, register
from keyfold.operators.keyed import keyed, keyed_aggregate
from keyfold.plans.settings import Settings
from keyfold.plans.specs import AggCall

__all__ = ["AggCall", "AggFunction", "Settings", "Udaf", "keyed", "keyed_aggregate", "register"]
