from datetime import date

import pytest

from usagelake.functions.calendar import NO_ZONE, reporting_zone, resolve_zone, spark_zone, start_of_day
from usagelake.plans import view
from usagelake.plans.query import InvalidQuery, Query, Selection, instants, normalize, period_days


def test_defaults():
    q = normalize(Query())
    assert (q.tab, q.selection.period, q.selection.bucket, q.quality, q.sort, q.direction, q.page, q.page_size) == ("tokens", "month", "day", "confirmed", "date", "desc", 1, 50)
    assert normalize(Query("context")).sort == "averageContext"
    assert normalize(Query("models", sort="name")).direction == "asc"


@pytest.mark.parametrize(
    "bad",
    [
        Query("nothing"), Query("models", Selection(period="decade")), Query("models", Selection(bucket="hour")), Query("models", repositories=("x",)), Query("models", sort="averageContext"), Query("context", sort="total"),
        Query("models", page=-1), Query("models", page_size=201), Query("models", Selection(day_from="2024-13-01")), Query("models", Selection(day_from="2024-02-02", day_to="2024-02-01")), Query("models", Selection(harnesses=("other",))), Query(quality="sure"),
    ],
)
def test_invalid(bad):
    with pytest.raises(InvalidQuery):
        normalize(bad)


def test_days_follow_daylight_saving():
    hours = lambda day: (start_of_day(date.fromordinal(day.toordinal() + 1), "America/New_York") - start_of_day(day, "America/New_York")) / 3_600_000
    assert hours(date(2026, 3, 8)) == 23 and hours(date(2026, 11, 1)) == 25


def test_periods():
    assert period_days("week", date(2024, 1, 17)) == (date(2024, 1, 15), date(2024, 1, 22))
    assert period_days("month", date(2024, 12, 31)) == (date(2024, 12, 1), date(2025, 1, 1))
    assert period_days("all", date(2024, 1, 1)) is None


def test_custom_days_replace_the_period():
    assert instants(Selection(period="today", day_from="2024-01-05"), 0, "UTC") == (1704412800000, None)


def test_view():
    q = normalize(Query("repo", repositories=("a",)))
    assert view.with_tab(q, "models").repositories == () and view.with_tab(q, "models").location_group == ""
    assert view.with_sort(normalize(Query("models", sort="total")), "total").direction == "asc"
    assert view.excluded_usage(q).quality == "estimated" and view.excluded_usage(q).page_size == 1
    q = Query("repo", Selection(period="week", models=("a b", "c")), repositories=("x",), page=3)
    assert view.from_url(view.to_url(q)) == q
    for bad in ("tab=", "page=0", "other=1", "page=x"):
        with pytest.raises(InvalidQuery):
            view.from_url(bad)
    assert [view.compact(n) for n in (999, 1000, 1250, 999_950, 10**15)] == ["999", "1K", "1.3K", "1M", "1000T"]
    assert (view.share(1, 3000), view.share(1, 3), view.share(0, 0)) == ("<0.1%", "33.3%", "0%")
    assert view.shifted("month", date(2024, 1, 1), -1) == (date(2023, 12, 1), date(2023, 12, 31))
    assert view.is_complete("year", date(2024, 1, 1), date(2024, 12, 31)) and not view.is_complete("week", date(2024, 1, 2), date(2024, 1, 8))


def test_labels():
    today = date(2024, 1, 17)
    q = Query("models", Selection(period="week"))
    shown = view.navigation(q, today)
    assert (shown.label, shown.at_current) == ("Jan 15 – 21, 2024", True)
    assert view.navigation(q, today, date(2023, 12, 25)).label == "Dec 25 – 31, 2023" and not view.navigation(q, today, date(2024, 1, 8)).at_current
    assert view.range_label("week", date(2023, 12, 27), date(2024, 1, 2)) == "Dec 27, 2023 – Jan 2, 2024" and view.range_label("week", date(2024, 1, 29), date(2024, 2, 4)) == "Jan 29 – Feb 4, 2024"
    assert (view.range_label("month", today, today), view.range_label("year", today, today), view.range_label("today", today, today)) == ("January 2024", "2024", "Jan 17, 2024")
    custom = Query("repo", Selection(day_from="2024-01-02", models=("m",)), repositories=("r",))
    assert view.date_label(custom) == "2024-01-02 → Now" and view.navigation(custom, today) is None and view.active_filters(custom) == ["Model", "Repository", "Dates"]
    assert view.date_label(Query("models", Selection(period="all"))) == "All time" and view.missing_name("directories") == "Directory (unavailable)"
    assert view.custom_range_applies("", "2024-01-01") and not view.custom_range_applies("2024-01-02", "2024-01-01") and not view.custom_range_applies("", "")


def test_status():
    attempt = lambda stage, at, id_="x": {"id": id_, "stage": stage, "updated_ms": at}
    state = lambda attempts, **more: view.sync_state(attempts, **({"pending": 0, "failed": 0, "retry_at_ms": 0, "now_ms": 10, "generation": 1, "target": 1} | more))
    assert view.status(state([])) == ("Ready", "ready")
    assert view.status(state([attempt("capturing", 1), attempt("accepted", 2)])) == ("Collecting usage", "loading")
    assert view.status(state([attempt("accepted", 2)])) == ("Loading…", "loading") and view.status(state([attempt("accepted", 2)], checked="x/2")) == ("Ready", "ready")
    assert view.status(state([attempt("failed", 2)], pending=3)) == ("Collection needs attention", "attention")
    assert view.status(state([], pending=3)) == ("Processing usage", "loading") and view.status(state([], pending=3, failed=1, retry_at_ms=11)) == ("Processing retry pending", "attention")
    assert view.status(state([], target=2)) == ("Processing usage", "loading") and view.status(state([], progress_failed=True)) == ("Collection status unavailable", "attention")
    assert view.status(state([]), connection_failed=True, refresh_failed=True) == ("Connection unavailable", "attention") and view.status(state([]), fetching=True) == ("Refreshing usage…", "loading")


def test_limits(spark):
    from pyspark.errors import PySparkException

    from usagelake.operators import dashboard

    row = lambda i, n: ("default", f"s{i}", "pi", "p", f"m{i}", 1, True, n)
    facts = lambda *rows: spark.createDataFrame(rows, "dataset_id string, session_native_id string, harness string, provider string, model string, occurred_at_ms long, countable boolean, input_tokens long").withColumns({c: dashboard.F.lit(0).cast("bigint") for c in ("output_tokens", "reasoning_tokens", "cache_read_tokens", "cache_write_tokens")}).withColumn("total_tokens", dashboard.F.col("input_tokens"))
    q = Query("models", Selection(period="all"))
    with pytest.raises(dashboard.TooManyRows):
        dashboard.dashboard(facts(row(1, 1), row(2, 1)), q, dashboard.Clock(0), max_rows=1)
    assert dashboard.dashboard(facts(row(1, 1), row(2, 1)), q, dashboard.Clock(0), max_rows=2).rows.count() == 2
    with pytest.raises(PySparkException, match="aggregate_limit"):
        dashboard.summary(facts(row(1, 2**52), row(2, 2**52)), normalize(q), dashboard.Clock(0)).collect()


def test_zones_that_servers_advertise():
    assert resolve_zone("UTC+05:30") == ("UTC+05:30", "@19800") and resolve_zone("UTC-00:30") == ("UTC-00:30", "@-1800") and spark_zone(resolve_zone("UTC-03:30")[1]) == "-03:30"
    assert resolve_zone("Europe/Berlin") == ("Europe/Berlin", "Europe/Berlin") and resolve_zone("UTC") == ("UTC", "UTC")
    for bad in ("", "Local", "UTC+24:00", "UTC+05:60", "UTC+5:30", "UTC+05:30\n", "UTC+٠٥:٣٠", "Nowhere/City", "America", "../etc/passwd", "/etc/localtime", "+05:30"):
        assert resolve_zone(bad) == (NO_ZONE, "UTC")


def test_zone_to_advertise():
    assert reporting_zone({"TZ": ":Asia/Tokyo"}, "/usr/share/zoneinfo/Europe/Berlin") == "Asia/Tokyo" and reporting_zone({"TZ": ""}, "/usr/share/zoneinfo/Europe/Berlin") == "Europe/Berlin"
    assert reporting_zone({"TZ": "/usr/share/zoneinfo/Asia/Tokyo"}) == "Asia/Tokyo" and reporting_zone({"TZ": "Asia/Tokyo"}, configured="Europe/Berlin") == "Europe/Berlin"
    assert reporting_zone({}, "", 19800) == "UTC+05:30" and reporting_zone({"TZ": "wrong"}, "/usr/share/zoneinfo/Europe/Berlin", -12600) == "UTC-03:30" and reporting_zone({}, "/etc/other", configured="Local") == "UTC+00:00"


def test_cells_of_rows(spark):
    from usagelake.operators import dashboard

    assert set(view.COUNTED.values()) | set(view.NAMED) | {"location_key"} <= set(dashboard.ROW)
    row = {"name": "n", "harness": "pi", "provider": "p", "model": "m", "location_key": "unknown", **{f: i for i, f in enumerate(view.COUNTED.values())}}
    assert [view.row_value(row, c) for c in view.COUNTED] == list(range(11)) and view.row_value(row, "name") is None and view.row_value(row, "date") is None
    assert [view.row_text(row, c) for c in (*view.NAMED, "total", "date")] == ["n", "pi", "p", "m", "", ""]
    assert all(c in view.COUNTED or c in view.NAMED or c in ("date", "providers", "harnesses", "models") for columns in view.COLUMNS.values() for c in columns)
    assert view.is_unknown_location(row, "repo") and not view.is_unknown_location(row, "models") and not view.is_unknown_location(row | {"location_key": "k"}, "repo")
