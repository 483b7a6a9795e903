import pytest
from oracle import SF, same

from quillspan.plans import analysis_queries, problems, text_queries, trip_queries

MODULES = [text_queries, trip_queries, analysis_queries, problems]
SQL = {k: (m.QUERIES[k], s) for m in MODULES for k, s in m.SQL.items()}


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    same(spark, *SQL[name])


def test_typed_and_rejected_rows_make_up_the_input(spark):
    d = problems.p4_trips(spark, SF)
    assert d.count() == spark.read.parquet(f"{SF}/raw_trips.parquet").count()
    assert d.where("reason is null and (license is null or pickup_time is null or dropoff_lat is null or raw_line is not null)").count() == 0
    m = problems.p4_movies(spark, SF)
    assert m.where("reason is null and (title is null or plot is null)").count() == 0
    assert m.where("reason is not null and (title is not null or raw_line is null)").count() == 0


def test_session_sizes_add_up(spark):
    s = problems.p3_sessions(spark, SF)
    trips = spark.read.parquet(f"{SF}/trips.parquet").where("license is not null and pickup_time is not null").select("trip_id").distinct().count()
    assert s.agg({"n_trips": "sum"}).first()[0] == trips


def test_values_of_two_or_more_are_among_all(spark):
    both = problems.p7_values(spark, SF)
    two = problems.p7_found(spark, SF)
    assert two.exceptAll(both).count() == 0
    assert two.groupBy("movie_id", "field_name").count().where("count < 2").count() == 0
