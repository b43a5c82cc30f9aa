"""One set of formulas for two backends: numpy arrays on the driver and Column expressions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


class NumpyMath:
    sin, cos, tan, asin, acos, atan, atan2 = np.sin, np.cos, np.tan, np.arcsin, np.arccos, np.arctan, np.arctan2
    sqrt, exp, log, sinh, cosh, tanh, atanh, abs, sign = np.sqrt, np.exp, np.log, np.sinh, np.cosh, np.tanh, np.arctanh, np.abs, np.sign

    @staticmethod
    def where(condition, a, b):
        return np.where(condition, a, b)

    @staticmethod
    def power(a, b):
        return np.power(a, b)

    @staticmethod
    def wrap(degrees):
        return np.mod(np.asarray(degrees, dtype=float) + 180.0, 360.0) - 180.0

    @staticmethod
    def clip(a, low, high):
        return np.clip(a, low, high)

    @staticmethod
    def const(x):
        return x


class ColumnMath:
    sin, cos, tan, asin, acos, atan, atan2 = F.sin, F.cos, F.tan, F.asin, F.acos, F.atan, F.atan2
    sqrt, exp, log, sinh, cosh, tanh, atanh, abs, sign = F.sqrt, F.exp, F.log, F.sinh, F.cosh, F.tanh, F.atanh, F.abs, F.signum

    @staticmethod
    def where(condition, a, b):
        a, b = (x if isinstance(x, Column) else F.lit(x) for x in (a, b))
        return F.when(condition, a).otherwise(b)

    @staticmethod
    def power(a, b):
        return F.pow(a, b)

    @staticmethod
    def wrap(degrees):
        return F.pmod(degrees + F.lit(180.0), F.lit(360.0)) - F.lit(180.0)

    @staticmethod
    def clip(a, low, high):
        return F.least(F.greatest(a, F.lit(low)), F.lit(high))

    @staticmethod
    def const(x):
        return F.lit(x)


def backend(*values) -> type:
    """ColumnMath if any value is a Column, else NumpyMath."""
    return ColumnMath if any(isinstance(v, Column) for v in values) else NumpyMath
