"""Gathering fruit."""

import orchard.pricing.rates as rates
from orchard.trees.species import AppleTree, Espalier, Tree


class Basket:
    """Holds the crop of several trees."""

    def __init__(self):
        self.kilos = 0.0

    def __len__(self) -> int:
        return int(self.kilos)

    def add(self, tree: Tree) -> None:
        self.kilos += tree.crop()

    async def sell_all(self) -> float:
        return rates.discounted("apple", self.kilos)


def gather_baskets(ages: list[int]) -> Basket:
    basket = Basket()
    for age in ages:
        basket.add(AppleTree(age))
        basket.add(Espalier(age))
    return basket


def _weigh_twice(basket: Basket) -> int:
    return len(basket) + len(basket)
