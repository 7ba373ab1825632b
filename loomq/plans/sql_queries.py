"""The flagship and others as SQL statements over views, with the query language's functions."""

from __future__ import annotations

from loomq.plans.catalogue import BOOLEAN_QUERY, flagship_sql
from loomq.plans.registry import query
from loomq.plans.table_functions import register_query, register_search_table
from loomq.session import table


@query(flagship_sql)
def search_sql(spark, sf_dir):
    register_query(spark, "flagship", BOOLEAN_QUERY)
    docs = table(spark, sf_dir, "documents")
    return spark.sql(r"SELECT doc_id, source, substring(split_part(text, '\n', 1), 1, 80) AS snippet FROM {docs} WHERE flagship(text)", docs=docs)


@query("""
WITH m AS (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS place FROM conversations WHERE contains(lower(text), 'de') OR contains(lower(text), 'un'))
SELECT conv_id, turn, CAST(place AS INTEGER) AS place, substr(split_part(text, chr(10), 1), 1, 80) AS snippet FROM m
""")
def search_table(spark, sf_dir):
    register_search_table(spark)
    turns = table(spark, sf_dir, "conversations")
    return spark.sql("SELECT conv_id, turn, place, snippet FROM search_table(TABLE({turns}) PARTITION BY (conv_id) ORDER BY (turn), 'de OR un', 'text')", turns=turns)
