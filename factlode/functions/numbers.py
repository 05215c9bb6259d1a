"""Decimal types.

Money is DECIMAL(20,4); metric values are DECIMAL(35,15); statistics over series are doubles.
"""

from __future__ import annotations

MONEY = "decimal(20,4)"
METRIC = "decimal(35,15)"
CONFIDENCE = "decimal(5,4)"
