import pytest

from ebbline.functions.codec import TierKind
from ebbline.plans.modes import Mode, Placement
from ebbline.plans.predicates import All, AnyOf, Compare, Side, Unknown, parse_predicate

HOT = Placement(hot=True)
MATRIX = {
    # mode: (insert hot, insert cold, delete hot, delete cold)
    "tiered": (HOT, Placement(delta=True, check_retention=True), Placement(hot=True, hot_floor=True), Placement(delta=True, check_retention=True)),
    "tiered+keep_heap": (HOT, Placement(hot=True, delta=True, check_retention=True), HOT, Placement(hot=True, delta=True)),
    "direct": (HOT, Placement(lake=True, check_retention=True), Placement(hot=True, hot_floor=True), Placement(lake=True, check_retention=True)),
    "direct+keep_heap": (HOT, Placement(hot=True, lake=True, check_retention=True), HOT, Placement(hot=True, lake=True)),
    "mirrored": (HOT, HOT, HOT, HOT),
    "mirrored+heap_retention": (HOT, Placement(delta=True), Placement(hot=True, hot_floor=True), Placement(delta=True, check_retention=True)),
}


@pytest.mark.parametrize("name", MATRIX)
def test_write_matrix(name):
    m = Mode.parse(name)
    assert str(m) == name
    assert (m.insert(True), m.insert(False), m.delete(True), m.delete(False)) == MATRIX[name]
    assert m.update(False, True) == m.delete(False) | m.insert(True)


def test_modes_reject():
    for text in ("mirrored+keep_heap", "tiered+heap_retention", "frozen"):
        with pytest.raises(ValueError):
            Mode.parse(text)


def test_classification():
    t = 100
    for p, side in (
        (Compare("=", 100), Side.HOT), (Compare("=", 99), Side.COLD), (Compare(">=", 100), Side.HOT), (Compare(">", 99), Side.HOT), (Compare(">", 98), Side.MIXED), (Compare(">=", 99), Side.MIXED),
        (Compare("<", 100), Side.COLD), (Compare("<=", 99), Side.COLD), (Compare("<=", 100), Side.MIXED), (Unknown(), Side.MIXED), (AnyOf(()), Side.HOT),
        (All((Unknown(), Compare("<", 50))), Side.COLD), (AnyOf((Compare("<", 50), Unknown())), Side.MIXED), (AnyOf((Compare("=", 100), Compare(">", 300))), Side.HOT),
        (AnyOf((Compare("=", 100), Compare("=", 1))), Side.MIXED),
    ):
        assert p.side(t) is side, p


@pytest.mark.parametrize(
    ("text", "side"),
    [
        ("k >= 100", Side.HOT), ("100 <= k", Side.HOT), ("k < 100 AND v = 'a'", Side.COLD), ("k < 100 OR v = 'a'", Side.MIXED), ("k IN (100, 200)", Side.HOT), ("k IN (1, 200)", Side.MIXED),
        ("k BETWEEN 100 AND 200", Side.HOT), ("k BETWEEN 1 AND 20", Side.COLD), ("NOT k < 100", Side.MIXED), ("abs(k) >= 100", Side.MIXED), ("k >= v", Side.MIXED), ("k = -5", Side.COLD), ("t.k = 7", Side.COLD),
        ("cast(k as long) > 99", Side.HOT), (None, Side.MIXED), ("k = null", Side.MIXED),
    ],
)
def test_extraction(spark, text, side):
    assert parse_predicate(spark, text, "k", TierKind.BIGINT).side(100) is side


def test_extraction_of_times(spark):
    cut = TierKind.TIMESTAMP.parse("2024-01-21")
    side = lambda text: parse_predicate(spark, text, "ts", TierKind.TIMESTAMP).side(cut)
    assert side("ts >= timestamp_ntz'2024-01-21'") is Side.HOT
    assert side("ts >= '2024-01-21 00:00:00'") is Side.HOT
    assert side("ts < date'2024-01-21'") is Side.COLD
    assert side("ts > current_timestamp()") is Side.MIXED
