import pytest

from tidebar.sources import market_data

DAY = [{"sip_ns": t, "p": k} for k, t in enumerate([1, 2, 2, 2, 2, 2, 2, 2, 3, 5])]


def test_a_full_page_of_one_time_does_not_end_the_day():
    assert list(market_data.cursor_rows(lambda start, n: [r for r in DAY if r["sip_ns"] >= start][:n], 0, 3)) == DAY


def test_rows_that_cannot_be_asked_for_are_an_error():
    with pytest.raises(ValueError, match="time 2"):
        list(market_data.cursor_rows(lambda start, n: [r for r in DAY if r["sip_ns"] >= start][: min(n, 3)], 0, 3))
