"""Queries that use no ages answer for every person-year, also those before a person is born."""

import pytest

import __spark_entry__ as entry
from oracle_check import connect

PERSON_YEARS = """
select count(*) from (select distinct o_custkey, year(o_orderdate) from orders join customer on c_custkey = o_custkey)"""


@pytest.mark.parametrize("name", ["recode_codes", "fill_zero_when_inactive", "flags_from_status", "join_person_left"])
def test_every_person_year_is_there(spark, small, name):
    everyone = connect(small).execute(PERSON_YEARS).fetchone()[0]
    assert connect(small).execute(f"select count(*) from ({entry.oracle_sql()[name]})").fetchone()[0] == everyone
    assert entry.queries()[name](spark, small).count() == everyone
