"""Inputs of any origin: times of a whole source, lens columns that are not there, nickname tables."""

import datetime as dt

import pytest

from hustings.config import Config
from hustings.operators import profile
from hustings.queries import QUERIES
from hustings.sources import adapters, files


def test_times_of_a_source_have_one_form(spark):
    rows = lambda *t: spark.createDataFrame([(x,) for x in t], "time_signed_in string")
    at = dt.datetime(2026, 2, 3, 17, 7)
    mixed = files.with_times(rows("2/3/2026 5:07 PM", "2026-02-03 17:07:00", "never", "", None)).collect()
    assert [r.timestamp for r in mixed] == [at, None, None, None, None]
    general = files.with_times(rows("2026-02-03 17:07:00", "never")).collect()
    assert [r.timestamp for r in general] == [at, None]
    for bad in (rows("never", ""), rows()):
        with pytest.raises(ValueError, match="holds no time"):
            files.with_times(bad)


def test_lens_columns_are_made_up_where_absent(spark):
    df = spark.createDataFrame([(10, 8, 6, 4), (8, 7, 2, 1), (0, 0, 0, 0)], "n_total int, n_unique_names int, n_pro int, n_con int")
    got = profile.with_dedup_columns(df).collect()
    assert sum(r.n_total_dedup for r in got) == 15
    assert [(r.pro_rate_dedup, r.con_rate_dedup, r.dedup_drop_fraction, r.dedup_multiplier, r.dup_name_fraction_dedup) for r in got] == [(0.75, 0.5, 0.2, 1.25, 0.0), (2 / 7, 1 / 7, 0.125, 8 / 7, 0.0), (None, None, None, None, 0.0)]
    bare = profile.with_dedup_columns(spark.createDataFrame([(5.0,), (float("nan"),), (None,), (-2.0,)], "n_total double")).collect()
    assert [r.n_total_dedup for r in bare] == [5, 0, 0, 0] and bare[0].n_pro_dedup == 0 and bare[1].pro_rate_dedup is None
    given = profile.with_dedup_columns(spark.createDataFrame([(10, "7", 1.7), (10, "x", None)], "n_total int, n_total_dedup string, dup_name_fraction_dedup double")).collect()
    assert [(r.n_total_dedup, r.dup_name_fraction_dedup) for r in given] == [(7, 1.0), (0, 0.0)]


def test_nicknames_from_a_table(spark):
    at = dt.datetime(2026, 2, 3, 9)
    rows = spark.createDataFrame([(1, "Doe, Bob J", "", "PRO", at), (2, "Roe, Ann", None, "con", at), (3, "Poe, Al", "", "", at)], "id long, name string, organization string, position string, timestamp timestamp_ntz")
    table = spark.createDataFrame([("BOB", "ROBERT"), ("AL", "ALAN"), ("ALBERT", "ALBIE")], "alias string, canonical string")
    config = Config(nicknames={"AL": "ALBERT"})
    got = {r.id: r.canonical_name for r in adapters.canonical(rows, config, table).collect()}
    assert got == {1: "DOE|ROBERT", 2: "ROE|ANN", 3: "POE|ALBIE"}
    assert {r.id: r.canonical_name for r in adapters.canonical(rows, config).collect()} == {1: "DOE|BOB", 2: "ROE|ANN", 3: "POE|ALBERT"}


def test_timeline_marks_changepoints(spark):
    sf = "/root/testdata/sf0.001"
    changes = {r.change_minute for r in QUERIES["cp3_all_changepoints"](spark, sf).collect()}
    rows = QUERIES["ch1_changepoint_timeline"](spark, sf).collect()
    assert {r.minute_bucket for r in rows if r.is_changepoint} == changes and len(rows) == len({r.minute_bucket for r in rows})
