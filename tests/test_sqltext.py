from ferry.functions.sqltext import bridge_sql, clean_sql, prepare_sql


def test_clean_sql_strips_blanks_and_semicolons():
    assert clean_sql("SELECT 1;  \n") == "SELECT 1"
    assert clean_sql("SELECT 1;;; ") == "SELECT 1"
    assert clean_sql("SELECT 1 ; ;\n\t") == "SELECT 1"
    assert clean_sql("SELECT ';'") == "SELECT ';'"


def test_bridge_rewrites_type_words_outside_quotes_and_comments():
    sql = "SELECT CAST(time AS VARCHAR) AS t, 'VARCHAR' AS lit, \"varchar\" -- VARCHAR\nFROM x"
    out = bridge_sql(sql)
    assert "CAST(time AS STRING)" in out
    assert "'VARCHAR'" in out and '"varchar"' in out and "-- VARCHAR" in out
    assert bridge_sql("cast(a as varchar)") == "cast(a as STRING)"
    assert bridge_sql("/* TEXT */ SELECT text_col FROM t") == "/* TEXT */ SELECT text_col FROM t"


def test_prepare_sql_reference_query():
    q = ("SELECT event, user_id, CAST(time AS VARCHAR) AS time_str FROM input_data "
         "WHERE event IS NOT NULL;")
    assert prepare_sql(q).endswith("WHERE event IS NOT NULL")
    assert "AS STRING" in prepare_sql(q)


def test_rename_view_only_renames_the_identifier():
    from ferry.functions.sqltext import rename_view
    sql = ("SELECT a FROM input_data x JOIN \"input_data\" y ON x.k = y.k "
           "WHERE s = 'input_data' -- input_data\n AND t IN (SELECT t FROM INPUT_DATA)")
    out = rename_view(sql, "input_data", "input_data_3")
    assert out == ("SELECT a FROM input_data_3 x JOIN \"input_data_3\" y ON x.k = y.k "
                   "WHERE s = 'input_data' -- input_data\n AND t IN (SELECT t FROM input_data_3)")
    assert rename_view("SELECT input_data_x FROM t", "input_data", "v") == \
        "SELECT input_data_x FROM t"


def test_quoted_names_work_even_if_caller_turned_ansi_off(spark):
    from ferry.operators.sqlstage import run_sql
    from ferry.session import job_session
    spark.conf.set("spark.sql.ansi.enabled", "false")
    try:
        js = job_session(spark)
        df = js.createDataFrame([(1, "a")], "`$email` int, b string")
        assert run_sql(df, 'SELECT "$email" AS e FROM input_data').collect()[0].e == 1
    finally:
        spark.conf.unset("spark.sql.ansi.enabled")


def test_type_words_only_where_a_type_stands():
    assert bridge_sql("SELECT text, a.text FROM t WHERE text = 'x'") == "SELECT text, a.text FROM t WHERE text = 'x'"
    assert bridge_sql("SELECT x AS text, CAST(f(a AS b) AS text) FROM t") == "SELECT x AS text, CAST(f(a AS b) AS STRING) FROM t"
    assert bridge_sql("SELECT text::VARCHAR(10), text::text") == "SELECT text::VARCHAR(10), text::STRING"
    assert bridge_sql("TRY_CAST ( x /* AS */ AS Varchar )") == "TRY_CAST ( x /* AS */ AS STRING )"
    assert bridge_sql("SELECT (SELECT 1 AS text) AS varchar") == "SELECT (SELECT 1 AS text) AS varchar"
