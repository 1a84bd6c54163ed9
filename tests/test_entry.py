import __spark_entry__


def test_entry(spark):
    rows = __spark_entry__.entry(spark).collect()
    assert rows and set(rows[0].asDict()) == {"item_id", "doc_id", "chunk_id", "rank", "score"}


def test_sql_belongs_to_queries():
    assert __spark_entry__.oracle_sql().keys() <= __spark_entry__.queries().keys()
