"""Trees and what they bear."""

from ..pricing.rates import discounted


def logged(method):
    return method


class Tree:
    kind = "none"

    def __init__(self, age: int):
        self.age = age

    @property
    def bearing(self) -> bool:
        return self.age > 3

    @staticmethod
    def seedling() -> "Tree":
        return Tree(0)

    def crop(self) -> float:
        return 0.0


class AppleTree(Tree):
    kind = "apple"

    @logged
    def crop(self) -> float:
        return 40.0 if self.bearing else 0.0

    def worth(self) -> float:
        return discounted(self.kind, self.crop())


class Espalier(AppleTree):
    def crop(self) -> float:
        return super().crop() / 2
