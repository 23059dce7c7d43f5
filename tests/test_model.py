from __future__ import annotations

import pytest

from tesseral.model import FOREVER, Identifier, Span

ONE = lambda v: Span(v, v)


def test_texts():
    assert str(Identifier.new(4, ONE(5), ONE(3), ONE(10), 60, ONE(100))) == "4/5/3/10_60/100"
    assert str(Identifier.new(3, Span(-2, None), Span(1, 5), Span())) == "3/-2:-/1:5/-_0/-"


@pytest.mark.parametrize("change", [{"z": 32}, {"x": ONE(4)}, {"y": ONE(5)}, {"f": ONE(4)}, {"f": ONE(-5)}, {"t": ONE(1)}, {"i": 60, "t": Span(5, 2)}])
def test_refused(change):
    with pytest.raises(ValueError):
        Identifier.new(**({"z": 2, "f": ONE(0), "x": ONE(1), "y": ONE(1)} | change))


def test_finest_zoom():
    assert Identifier.new(31, ONE(0), ONE(0), ONE(0)).box()[2:4] == (0, 1)


@pytest.mark.parametrize(
    ("z", "axis", "given", "kept"),
    [
        (2, "f", Span(-4, 3), Span()),
        (2, "x", Span(0, 3), Span()),
        (3, "f", Span(-8, 5), Span(None, 5)),
        (3, "f", Span(2, 7), Span(2, None)),
        (2, "x", Span(3, None), ONE(3)),
        (2, "x", Span(None, 0), ONE(0)),
        (3, "x", Span(5, 2), Span(2, 5)),
    ],
)
def test_normal_forms(z, axis, given, kept):
    spans = {"f": ONE(0), "x": ONE(0), "y": ONE(0)} | {axis: given}
    assert getattr(Identifier.new(z, **spans), axis) == kept


def test_box_and_back():
    i = Identifier.new(4, ONE(5), ONE(3), ONE(10), 60, ONE(100))
    assert i.box() == (4, 60, 671088640, 805306368, 402653184, 536870912, 1342177280, 1476395008, 6000, 6060)
    names = ["z", "i", "f_lo", "f_hi", "x_lo", "x_hi", "y_lo", "y_hi", "t_lo", "t_hi"]
    assert Identifier.from_box(dict(zip(names, i.box(), strict=True))) == i
    most = 2**32 - 1
    assert Identifier.new(10, ONE(1023), ONE(1023), ONE(1023), most, ONE(most)).box()[-1] == FOREVER


def test_change_scale():
    i = Identifier.new(4, ONE(5), ONE(3), ONE(10), 60, ONE(1))
    assert i.change_scale(6).x == Span(12, 15)
    assert i.change_scale(i=15).t == Span(4, 7)
    assert i.change_scale() == i
    for bad in ({"z": 3}, {"z": 32}, {"i": 61}):
        with pytest.raises(ValueError):
            i.change_scale(**bad)
