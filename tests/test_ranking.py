from conftest import D, sales
from tillroll.operators import ranking


def test_top_items_by_month_keeps_ties_and_nulls(spark):
    rows = [
        # 2021-01: a tie at rank 3 -> four items
        (1, "2021-01-05", "10:00:00", "A", 10, "1.00"),
        (2, "2021-01-06", "10:00:00", "B", 8, "1.00"),
        (3, "2021-01-07", "10:00:00", "C", 5, "1.00"),
        (4, "2021-01-08", "10:00:00", "D", 5, "1.00"),
        (5, "2021-01-09", "10:00:00", "E", 1, "1.00"),
        # 2021-02: a NULL total ranks first (DESC puts NULLs first)
        (6, "2021-02-01", "10:00:00", "A", None, "1.00"),
        (7, "2021-02-01", "10:00:00", "B", 3, "2.00"),
        (7, "2021-02-01", "10:00:00", "B", 1, "2.00"),
        # 2021-03: fewer than three items
        (8, "2021-03-01", "10:00:00", "A", 2, "1.50"),
    ]
    out = ranking.top_items_by_month(sales(spark, rows), n=3).collect()
    got = [(r.year_month, r.item_name, r.total_quantity_sold, r.unique_tickets) for r in out]
    assert got[:4] == [("2021-01", "A", 10, 1), ("2021-01", "B", 8, 1),
                       ("2021-01", "C", 5, 1), ("2021-01", "D", 5, 1)] or \
        got[:4] == [("2021-01", "A", 10, 1), ("2021-01", "B", 8, 1),
                    ("2021-01", "D", 5, 1), ("2021-01", "C", 5, 1)]
    assert got[4:] == [("2021-02", "A", None, 1), ("2021-02", "B", 4, 1), ("2021-03", "A", 2, 1)]
    assert out[5].total_revenue == D("8.00")


def test_tickets_with_min_items_half_open_range(spark):
    rows = []
    for t, n, day in ((1, 4, "2021-12-01"), (2, 5, "2021-12-31"), (3, 6, "2021-12-15"), (4, 7, "2022-01-01")):
        for i in range(n):
            rows.append((t, day, "10:00:00", f"item{i}", 1, "1.00"))
    rows.append((2, "2021-12-31", "10:00:00", "item0", 1, "1.00"))  # repeated item
    out = ranking.tickets_with_min_items(sales(spark, rows), "2021-12-01", "2022-01-01", 5).collect()
    assert [(r.ticket_id, r.number_of_unique_items) for r in out] == [(3, 6), (2, 5)]


def test_peak_hour_tie_goes_to_earliest(spark):
    rows = [(1, "2021-07-01", "14:10:00", "ROLL", 3, "1.00"),
            (2, "2022-07-02", "09:10:00", "ROLL", 3, "1.00"),
            (3, "2022-08-02", "08:10:00", "ROLL", 9, "1.00"),
            (4, "2022-07-02", "08:10:00", "TART", 9, "1.00")]
    out = ranking.peak_hour(sales(spark, rows), "ROLL", 7).collect()
    assert [(r.sale_hour, r.total_quantity_sold) for r in out] == [(9, 3)]


def test_best_adjacent_hours_empty_hours_and_hour_23(spark):
    rows = [(1, "2021-01-01", "00:30:00", "A", 5, "1.00"),
            (2, "2021-01-01", "22:30:00", "A", 4, "2.00"),
            (3, "2021-01-01", "23:30:00", "A", 100, "1.00"),
            (4, "2021-01-01", None, "A", 50, "1.00"),         # NULL hour is dropped
            (5, "2021-01-01", "10:00:00", "A", 4, "2.00"),
            (6, "2021-01-01", "11:00:00", "A", 1, "1.00")]
    out = ranking.best_adjacent_hours(sales(spark, rows), hi=22, last_start=22).collect()  # the original list
    # windows: 00-02 -> 5 (rev 5), 10-12 -> 5 (rev 9), 09-11 -> 4, 22-24 -> 4
    assert [(r.two_hour_window, r.total_quantity_sold, r.total_revenue) for r in out] == \
        [("10:00-12:00", 5, D("9.00"))]
    full = ranking.best_adjacent_hours(sales(spark, rows)).collect()
    assert full[0].two_hour_window == "22:00-24:00" and full[0].total_quantity_sold == 104


def test_best_adjacent_hours_late_evening_only(spark):
    rows = [(1, "2021-01-01", "23:10:00", "A", 7, "1.00"), (2, "2021-01-01", "22:10:00", "A", -3, "1.00")]
    out = ranking.best_adjacent_hours(sales(spark, rows)).collect()
    assert [(r.two_hour_window, r.total_quantity_sold) for r in out] == [("22:00-24:00", 4)]


def test_top_ticket_lines_and_price_breakdown(spark):
    rows = [(1, "2021-01-01", "10:00:00", "A", 2, "10.00"),
            (1, "2021-01-01", "10:00:00", "B", 1, "5.00"),
            (2, "2021-01-02", "10:00:00", "A", 1, "10.00"),
            (3, "2021-01-03", "10:00:00", ".", 1, None),
            (3, "2021-01-03", "10:00:00", "A", 1, "12.00")]
    s = sales(spark, rows)
    lines = ranking.top_ticket_lines(s, n=1).collect()
    assert [(r.ticket_number, r.item_name, r.line_revenue, r.ticket_total_revenue) for r in lines] == \
        [(1, "A", "$20.00", "$25.00"), (1, "B", "$5.00", "$25.00")]
    br = ranking.top_items_price_breakdown(s, n=1).collect()
    assert [(r.article, r.ranking, r.unit_price, r.price_revenue) for r in br] == \
        [("A", 1, D("10.00"), D("30.00")), ("A", 1, D("12.00"), D("12.00"))]


def test_revenue_by_month_labels(spark):
    rows = [(1, "2021-01-01", "10:00:00", "A", 2, "1234567.90"),
            (2, "2021-02-01", "10:00:00", "A", -1, "5.50")]
    out = ranking.revenue_by_month(sales(spark, rows)).collect()
    assert [(r.year_month_char, r.total_revenue_char) for r in out] == \
        [("2021-01", "$2,469,135.80"), ("2021-02", "$-5.50")]


def test_top_items_by_month_row_number_ties(spark):
    rows = [(1, "2021-01-05", "10:00:00", "A", 10, "1.00"), (2, "2021-01-06", "10:00:00", "B", 8, "1.00"),
            (3, "2021-01-07", "10:00:00", "C", 5, "1.00"), (4, "2021-01-08", "10:00:00", "D", 5, "1.00")]
    out = ranking.top_items_by_month(sales(spark, rows), n=3, ties="row_number").collect()
    assert [r.item_name for r in out] == ["A", "B", "C"]


def test_best_adjacent_hours_wider_window(spark):
    rows = [(1, "2021-01-01", "08:00:00", "A", 3, "1.00"), (2, "2021-01-01", "09:00:00", "A", 3, "1.00"),
            (3, "2021-01-01", "10:00:00", "A", 3, "1.00"), (4, "2021-01-01", "15:00:00", "A", 8, "1.00")]
    out = ranking.best_adjacent_hours(sales(spark, rows), width=3).collect()
    assert [(r.two_hour_window, r.total_quantity_sold) for r in out] == [("08:00-11:00", 9)]
