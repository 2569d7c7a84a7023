"""Listing rules on the reference's 55-row and 6-row cases."""

from datetime import datetime, timedelta

import pytest

from rankline.operators import listing as L

SCHEMA = "id long, title string, status string, ai_score int, created_at timestamp_ntz"


def _jobs55(spark):
    t0 = datetime(2026, 1, 1)
    rows = []
    for i in range(1, 56):
        analysed = i % 2 == 0
        rows.append((i, f"Job {i}", "analyzed" if analysed else "pending", 8 if analysed else None,
                     t0 + timedelta(minutes=i)))
    return spark.createDataFrame(rows, SCHEMA)


def test_page_two_of_twenty(spark):
    page = L.rank_page(_jobs55(spark), L.JobFilter(), page=2, size=20).collect()
    # 27 scored rows first (newest first), so page 2 starts at rank 21 = 7th-oldest scored
    assert [r.rank for r in page][:1] == [21]
    assert page[0].title == "Job 14"
    assert len(page) == 20


def test_filtered_total(spark):
    assert L.filtered_total(_jobs55(spark), L.JobFilter(status=("analyzed",), min_score=8)) == 27


def test_ordering_and_filters(spark):
    t0 = datetime(2026, 1, 1)
    rows = [(1, "a", "analyzed", 9, t0), (2, "b", "analyzed", 9, t0 + timedelta(minutes=1)),
            (3, "c", "ready_for_ai", None, t0 + timedelta(minutes=5)), (4, "d", "discarded", 3, t0),
            (5, "e", "analyzed", 5, t0), (6, "f", "pending", None, t0 + timedelta(minutes=2))]
    df = spark.createDataFrame(rows, SCHEMA)
    order = [r.id for r in L.rank_page(df, L.JobFilter(), 1, 10).collect()]
    assert order == [2, 1, 5, 4, 3, 6]
    order = [r.id for r in L.rank_page(df, L.JobFilter(exclude_status=("discarded",)), 1, 10).collect()]
    assert order == [2, 1, 5, 3, 6]
    ids = [r.id for r in L.rank_page(df, L.JobFilter(min_score=4, max_score=9), 1, 10).collect()]
    assert ids == [2, 1, 5]
    tot = L.view_totals(df).collect()[0].asDict()
    assert tot == {"ready_total": 2, "analyze_total": 1, "adjust_total": 1, "review_total": 1,
                   "discarded_total": 1, "all_total": 5}


def test_argument_errors():
    with pytest.raises(ValueError, match="Valid values"):
        L.filter_predicate(L.JobFilter(status=("bogus",)))
    with pytest.raises(ValueError, match="min_score cannot be greater"):
        L.filter_predicate(L.JobFilter(min_score=8, max_score=2))


def test_keyset_page_matches_offset(spark):
    df = _jobs55(spark)
    first = L.rank_page(df, L.JobFilter(), 1, 20).collect()
    last = first[-1]
    nxt = L.keyset_page(df, (last.ai_score, last.created_at, last.id), L.JobFilter(), 20).collect()
    assert [r.id for r in nxt] == [r.id for r in L.rank_page(df, L.JobFilter(), 2, 20).collect()]


def _six(spark):
    t0 = datetime(2026, 3, 1)
    rows = [(1, "Analyzed High Recent", "analyzed", 9, 6), (2, "Analyzed High Older", "analyzed", 9, 4),
            (3, "Analyzed Low", "analyzed", 4, 5), (4, "Ready For AI", "ready_for_ai", None, 7),
            (5, "Pending Review", "pending", None, 8), (6, "Discarded Candidate", "discarded", 2, 9)]
    return spark.createDataFrame([(i, t, s, sc, t0 + timedelta(minutes=m)) for i, t, s, sc, m in rows], SCHEMA)


def test_six_row_listing_cases(spark):
    df = _six(spark)
    titles = lambda f: [r.title for r in L.rank_page(df, f, 1, 10).collect()]
    assert titles(L.JobFilter()) == ["Analyzed High Recent", "Analyzed High Older", "Analyzed Low",
                                     "Discarded Candidate", "Pending Review", "Ready For AI"]
    f = L.JobFilter(status=("analyzed", "ready_for_ai"))
    assert titles(f) == ["Analyzed High Recent", "Analyzed High Older", "Analyzed Low", "Ready For AI"]
    assert L.filtered_total(df, f) == 4
    f = L.JobFilter(min_score=0, max_score=6, exclude_status=("discarded",))
    assert titles(f) == ["Analyzed Low"] and L.filtered_total(df, f) == 1
