"""What fruit costs."""

import math

TARIFF: dict[str, float] = {"apple": 1.5, "pear": 2.0}
SEASON_START = 9
label = "rates"


def rounded(value: float, step: float = 0.05) -> float:
    """To the next step."""
    return math.floor(value / step + 0.5) * step


def discounted(kind: str, kilos: float) -> float:
    price = TARIFF[kind] * kilos

    def cut(p: float) -> float:
        return p * 0.9 if kilos > 100 else p

    return rounded(cut(price))
