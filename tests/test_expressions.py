"""Golden values of cleaning, keys, numbers and URL judgments."""

import pytest
from pyspark.sql import functions as F

from listwright.functions import text as t
from listwright.functions import urls
from listwright.functions.numbers import discount_pct, grouped, half_up, scaled_to_range, text


def test_numbers(values):
    x = F.col("x")
    cells = ["₹1,299.50", "Rs. 899", "abc", "", "n/a", "0", "12abc", "4.6 out of 5", ".5kg", "-3", "1e3x", "  7  ", "1e999"]
    assert values(t.number(x), cells) == [1299.5, 899, None, None, None, 0, 12, 4.6, 0.5, -3, 1000, 7, None]
    assert values(t.integer(x), ["4.6", "-2.5", "x"]) == [5, -2, None]


def test_flags_lists_levels(values):
    x = F.col("x")
    assert values(t.flag(x), ["Yes", "no", "", "maybe", "1", "N"]) == [True, False, None, None, True, False]
    assert values(t.pipe_list(x), ["black|blue| red |", "|", "none"]) == [["black", "blue", "red"], None, None]
    assert values(t.risk_level(x), ["LOW", "medium", "none", "extreme"]) == ["low", "medium", None, None]
    assert values(t.cell(x), [" - ", " Unknown", "  ok "]) == [None, None, "ok"]


def test_instants(values):
    seen = values(t.iso(t.instant(F.col("x"))), ["2026-09-28T11:00:00+05:30", "2026-09-28", "soon"])
    assert seen == ["2026-09-28T05:30:00.000Z", "2026-09-28T00:00:00.000Z", None]


def test_dates_of_other_forms(values):
    cells = ["2026/09/28", "9/28/2026", "28 Sep 2026", "28 September 2026", "Sep 28, 2026", "September 28, 2026", "2026/9/8 7:05", "12:30", "T10:00", "2026-13-01", "28/28/2026", "last week"]
    seen = values(t.iso(t.instant(F.col("x"))), cells)
    day = "2026-09-28T00:00:00.000Z"
    assert seen == [day] * 6 + ["2026-09-08T07:05:00.000Z"] + [None] * 5



def test_urls_and_names(values):
    x = F.col("x")
    cells = ["https://www.Example.com/demo/item/?utm=1", "HTTPS://example.com:443/demo/item#x", "https://me:pw@example.com/demo/item//", "  not a url "]
    assert values(urls.canonical_url(x), cells) == ["https://example.com/demo/item"] * 3 + ["not a url"]
    names = ["Packing Cubes, Set of 6 (Travel Organizer)", "packing  cubes set of 6 travel organizer", "PACKING CUBES: set of 6 / travel-organizer"]
    assert set(values(t.match_name(x), names)) == {"packing cubes set of 6 travel organizer"}
    assert values(t.match_name(x), ["गाड़ी"]) == ["ग ड"]
    assert values(t.display_name(x), ["Car  Phone   Holder "]) == ["Car Phone Holder"]


def test_keys(values):
    with_id = t.identity_key(F.lit("amazon_in"), F.lit("B0ABC"), F.col("x"))
    without = t.identity_key(F.lit("meesho"), F.lit(None).cast("string"), F.col("x"))
    assert values(with_id, ["u"]) == ["amazon_in::id::B0ABC"]
    assert values(without, ["https://example.com/a"]) == ["meesho::url::https://example.com/a"]


PLACEHOLDERS = [
    "https://example.com/x", "https://example-research.com/a", "http://shop.test/a", "http://a.invalid", "http://x.localhost", "http://127.0.0.1/a", "http://printer.local",
    "https://demo-store.in/a", "https://sample-goods.in", "https://fake-shop.in/", "https://acme.com", "https://staging.shop.in/p", "https://shop.in/demo/1",
    "https://shop.in/Sample/1", "ftp://shop.in/x", "", "not a url", "https://", None,
]
GENUINE = [
    "https://www.amazon.in/dp/B0ABCDEFGH", "https://www.flipkart.com/p/itm1", "https://meesho.com/x", "https://indiamart.com/proddetail/1", "https://mystore.in/products/box",
    "https://protest-gear.in/a", "https://demonstrations.in", "https://contest.in", "https://fakeshop.com", "https://my_shop.in/a b",
]


def test_placeholder_urls(values):
    assert values(urls.is_placeholder_url(F.col("x")), PLACEHOLDERS) == [True] * len(PLACEHOLDERS)
    assert values(urls.is_placeholder_url(F.col("x")), GENUINE) == [False] * len(GENUINE)
    reasons = values(urls.placeholder_reasons(F.col("x")), ["https://demo.example.test/demo/x"])[0]
    assert reasons[0] == "'.test' is a reserved/non-public TLD" and len(reasons) == 5


def test_source_names(values):
    bad = ["seed_demo_data", "manual_csv", "Manual Entry", "demo assumption", "unknown", "n/a", "", None, "demo_source_2", "sample-research"]
    assert values(urls.is_non_attributable(F.col("x")), bad) == [True] * len(bad)
    assert values(urls.is_non_attributable(F.col("x")), ["IndiaMART quote", "demographics", "contest desk"]) == [False] * 3


def test_rounding_and_text(values):
    x = F.col("x").cast("double")
    assert values(half_up(x), ["1.005", "-2.5", "2.345"]) == [1.0, -2.5, 2.35]
    assert values(text(x), ["5", "4.1", "-33.33", "10000000", "0"]) == ["5", "4.1", "-33.33", "10000000", "0"]
    assert values(grouped(x), ["123456.5", "999", "1000", "-1234567.25", "12345678"]) == ["1,23,456.5", "999", "1,000", "-12,34,567.25", "1,23,45,678"]
    assert values(discount_pct(x, F.lit(1799.0)), ["899", "1999"]) == [50.03, None]
    assert values(scaled_to_range(x, F.lit(0.0), F.lit(100.0)), ["50", "150", "-50"]) == [50, 100, 0]
    assert values(scaled_to_range(x, F.lit(7.0), F.lit(7.0)), ["50"]) == [50]


@pytest.mark.parametrize("cell,sides", [
    ("30x20x25", (30, 20, 25)), ("30 x 20 × 25 cm", (30, 20, 25)), ('{"lengthCm":30,"width_cm":20,"height":25}', (30, 20, 25)), ("30x20", None), ("30x0x5", None),
    ("{broken", None), ("300mm*20*5", (300, 20, 5)),
])
def test_dimensions(values, cell, sides):
    got = values(t.size_cm(F.col("x")), [cell])[0]
    assert (tuple(got) if got else None) == sides
