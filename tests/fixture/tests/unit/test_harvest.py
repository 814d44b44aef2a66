from orchard.trees.harvest import gather_baskets
from orchard.trees.species import Tree


class TestBaskets:
    def test_gather(self):
        assert len(gather_baskets([5, 9])) == 120

    def test_seedling_is_bare(self):
        assert Tree.seedling().crop() == 0.0


def test_empty_season():
    basket = gather_baskets([])
    assert basket.kilos == 0.0
