from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone.functions.instants import normalise
from lodestone.operators.timestamps import normalised_instants, parse_dictionary

CLOCK = "source_kind string, tz_name string, day_first boolean"
ROWS = "id string, source_kind string, created string, updated string, norm_value string, raw string, tz_name string"


def test_forms():
    cases = {
        "1423626259721": "2015-02-11T03:44:19.721000Z", "1597618677.837082": "2020-08-16T22:57:57.837082Z", "2023-10-20T12:20:30.213068645Z": "2023-10-20T12:20:30.213068Z",
        "2022-W49-6": "2022-12-10", "20220422": "2022-04-22", "20230828T145925Z": "2023-08-28T14:59:25.000000Z", "16 april 2016": "2016-04-16", "March 30, 2018": "2018-03-30",
        "19 mars 2021 kl. 03:16": "2021-03-19T02:16:00.000000Z", "Sun, 7 Aug 2016 01:28:15 -0500": "2016-08-07T06:28:15.000000Z", "2022-12-13 09:31:57 EST": "2022-12-13T14:31:57.000000Z",
        "2022-06-12T20:36:46+02:00[Europe/Stockholm]": "2022-06-12T18:36:46.000000Z", "13/13/2019": None, "unknown": None, "-": None, "2020-05-11T25:61:00Z": None, "": None,
    }
    for raw, want in cases.items():
        assert normalise(raw, "Europe/Stockholm", True) == want, raw


def test_order_of_day_and_month():
    assert normalise("05/02/2015", "UTC", True) == "2015-02-05"
    assert normalise("05/02/2015", "UTC", False) == "2015-05-02"
    assert normalise("3/12/2023 1:13 AM", "America/New_York", False) == "2023-03-12T06:13:00.000000Z"


def test_changes_of_the_clock():
    # twice: the earlier instant; skipped: the offset before the change
    assert normalise("2023-10-29 02:30:00", "Europe/Stockholm") == "2023-10-29T00:30:00.000000Z"
    assert normalise("2018-03-25 02:34:52", "Europe/Stockholm") == "2018-03-25T01:34:52.000000Z"


@settings(max_examples=200)
@given(st.text(max_size=30))
def test_any_text_is_survived(text):
    normalise(text, "Europe/Stockholm")


@given(st.datetimes(min_value=__import__("datetime").datetime(1971, 1, 1), max_value=__import__("datetime").datetime(2100, 1, 1)))
def test_round_trip(at):
    want = at.strftime("%Y-%m-%dT%H:%M:%S.%fZ")
    assert normalise(want) == want


def test_rows(spark):
    rows = [
        ("a", "note", "2020-01-01", "01/02/2020", "x", "y", "z"), ("a", "note", "2020-01-01", "01/02/2020", "x", "y", "z"), ("b", "other", "1/2/2020 10:00", "", None, None, None),
        (None, "note", "20200101", None, None, None, None), ("c", None, "n/a", "1500000000", None, None, None), ("d", "note", " ", None, None, None, None),
    ]
    clock = spark.createDataFrame([("note", "Europe/Stockholm", False), ("note", "Europe/Stockholm", False)], CLOCK)
    got = {tuple(r) for r in normalised_instants(spark.createDataFrame(rows, ROWS), clock).collect()}
    assert got == {("a", "updated", "2020-01-02"), ("b", "created", "2020-02-01T10:00:00.000000Z"), ("c", "updated", "2017-07-14T02:40:00.000000Z")}
    assert normalised_instants(spark.createDataFrame([], ROWS), clock).count() == 0


def test_dictionary_is_kept(spark, tmp_path):
    path = f"file://{tmp_path}/known"
    keys = spark.createDataFrame([("20200101", "UTC", True)], "raw string, tz_name string, day_first boolean")
    assert parse_dictionary(keys, path).count() == 1
    more = keys.union(spark.createDataFrame([("20200102", "UTC", True)], keys.schema))
    assert {r["norm_value"] for r in parse_dictionary(more, path).collect()} == {"2020-01-01", "2020-01-02"}
    assert spark.read.parquet(path).count() == 2
