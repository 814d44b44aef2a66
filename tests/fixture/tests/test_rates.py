from orchard.pricing import discounted


def test_discount():
    assert discounted("pear", 2) == 4.0
