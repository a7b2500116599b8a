"""Every registered query of the plans against its SQL, on the smallest tables."""

import datetime

import duckdb
import pytest

from fitforge.plans import assembly, ingestion, listings, matches, neighbours, pages, postings, resumes, shapes, skills, upkeep  # noqa: F401 - register their queries
from fitforge.plans.queries import QUERIES, SQL

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def _plain(value):
    if isinstance(value, float):
        return round(value, 5)
    return value.replace(tzinfo=None) if isinstance(value, datetime.datetime) else value


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    db = duckdb.connect()
    for t in TABLES.split():
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    expected = db.sql(SQL[name])
    found = QUERIES[name](spark, DATA)
    assert _rows(found.columns, found.collect()) == _rows(expected.columns, expected.fetchall())
