"""Jobs end to end: per file, chunks, merge, analytical, preview, naming, guards."""

import gzip
import json
import os

import pytest

from ferry import Job, JobError, run
from ferry.sources.readers import read_files

from tests.conftest import SF001, lines, write


def _local(p):
    return p.replace("file:", "")


def _events_csv_dir(spark, tmp_path, n_files=2):
    """events (sf0.001) as ``n_files`` CSV files split by event_id."""
    d = str(tmp_path / "events_csv")
    os.makedirs(d)
    ev = spark.read.parquet(f"{SF001}/events.parquet").orderBy("event_id").collect()
    per = len(ev) // n_files + 1
    for i in range(n_files):
        with open(f"{d}/part-{i + 1}.csv", "w") as fh:
            fh.write("event_id,user_id,event\n")
            for r in ev[i * per:(i + 1) * per]:
                fh.write(f"{r.event_id},{r.user_id},{r.event_type}\n")
    return d, len(ev)


def test_per_file_conversion_names_and_content(spark, tmp_path, out):
    d, n = _events_csv_dir(spark, tmp_path)
    res = run(spark, Job(input=d, format="ndjson", output=out, prefix="p_", suffix="_s"))
    names = sorted(os.path.basename(w.path) for w in res.outputs)
    assert names == ["p_part-1_s.ndjson", "p_part-2_s.ndjson"]
    total = 0
    for w in res.outputs:
        recs = [json.loads(x) for x in lines(w.path)]
        ids = [r["event_id"] for r in recs]
        assert ids == sorted(ids)  # file order kept
        total += len(recs)
    assert total == n


def test_default_destination_is_source_dir(spark, tmp_path):
    f = write(str(tmp_path / "src" / "test_file.csv"), "a,b\n1,x\n")
    res = run(spark, Job(input=f, format="ndjson"))
    assert _local(res.outputs[0].path) == str(tmp_path / "src" / "test_file.ndjson")


def test_overwrite_guard(spark, tmp_path):
    f = write(str(tmp_path / "test_file.csv"), "a,b\n1,x\n")
    with pytest.raises(JobError, match="cannot be its output"):
        run(spark, Job(input=f, format="csv"))
    # allowed with another output folder
    res = run(spark, Job(input=f, format="csv", output=str(tmp_path / "o")))
    assert lines(res.outputs[0].path) == ["a,b", "1,x"]


def test_name_collisions_refused(spark, tmp_path):
    write(str(tmp_path / "in" / "a" / "x.csv"), "a\n1\n")
    write(str(tmp_path / "in" / "b" / "x.csv"), "a\n2\n")
    with pytest.raises(JobError, match="one name"):
        run(spark, Job(input=str(tmp_path / "in"), format="ndjson", output=str(tmp_path / "o")))


def test_chunked_output_numbered_from_one(spark, tmp_path, out):
    d, n = _events_csv_dir(spark, tmp_path, n_files=1)
    res = run(spark, Job(input=d, format="csv", rows=300, output=out))
    got = {os.path.basename(w.path): lines(w.path) for w in res.outputs}
    assert sorted(got) == ["part-1-1.csv", "part-1-2.csv", "part-1-3.csv", "part-1-4.csv"]
    assert [len(v) - 1 for k, v in sorted(got.items())] == [300, 300, 300, n - 900]
    first_ids = [int(v[1].split(",")[0]) for k, v in sorted(got.items())]
    assert first_ids == [0, 300, 600, 900]


def test_chunks_after_dedupe_have_exact_sizes(spark, tmp_path, out):
    f = write(str(tmp_path / "dups.csv"), "a,b\n" + "1,x\n2,y\n" * 50 + "3,z\n")
    res = run(spark, Job(input=f, format="csv", dedupe=True, rows=2, output=out))
    sizes = sorted(len(lines(w.path)) - 1 for w in res.outputs)
    assert sizes == [1, 2]


def test_merge_single_file_named_and_ordered(spark, tmp_path):
    d, n = _events_csv_dir(spark, tmp_path, n_files=3)
    res = run(spark, Job(input=d, format="csv", single_file=True))
    target = _local(res.outputs[0].path)
    assert target == f"{d}/events_csv_merged.csv"
    body = lines(target)
    assert body[0] == "event_id,user_id,event" and len(body) == n + 1
    ids = [int(x.split(",")[0]) for x in body[1:]]
    assert ids == sorted(ids)


def test_merge_custom_name_and_gzip(spark, tmp_path):
    d, n = _events_csv_dir(spark, tmp_path, n_files=2)
    res = run(spark, Job(input=d, format="ndjson", single_file=True,
                         single_file_name="custom_name.ndjson", compressed=True))
    target = _local(res.outputs[0].path)
    assert target == f"{d}/custom_name.ndjson.gz"
    with gzip.open(target, "rt") as fh:
        assert len(fh.read().splitlines()) == n


def test_merge_keeps_sql_order_and_refuses_mixed_formats(spark, tmp_path, out):
    d, n = _events_csv_dir(spark, tmp_path, n_files=2)
    res = run(spark, Job(input=d, format="csv", single_file=True, output=out + "/desc.csv",
                         sql="SELECT event_id FROM input_data ORDER BY event_id DESC"))
    ids = [int(x) for x in lines(res.outputs[0].path)[1:]]
    assert ids == sorted(ids, reverse=True) and len(ids) == n
    write(f"{d}/other.ndjson", '{"a": 1}\n')
    with pytest.raises(Exception, match="different formats"):
        run(spark, Job(input=d, format="csv", single_file=True, output=out))


def test_compressed_per_file_names(spark, tmp_path, out):
    d, n = _events_csv_dir(spark, tmp_path, n_files=1)
    res = run(spark, Job(input=d, format="parquet", compressed=True, output=out))
    p = _local(res.outputs[0].path)
    assert p.endswith("part-1.parquet.gz")
    assert read_files(spark, [p]).count() == n


def test_analytical_mode_writes_query_result(spark, tmp_path, out):
    d, n = _events_csv_dir(spark, tmp_path)
    sql = os.path.join(str(tmp_path), "q.sql")
    write(sql, "SELECT\n COUNT(*) AS total_rows,\n COUNT(DISTINCT user_id) AS unique_users,\n"
               " COUNT(DISTINCT event) AS unique_events\nFROM input_data;\n")
    res = run(spark, Job(input=d, sql=sql, output=out))
    assert _local(res.outputs[0].path) == f"{out}/query_result.csv"
    r = res.result.collect()[0]
    assert r.total_rows == n and r.unique_events == 5


def test_count_mode_and_fast_count(spark, tmp_path, out):
    f = write(str(tmp_path / "e.ndjson"), '{"a": 1}\n{"a": 2}\nnot json\n')
    assert run(spark, Job(input=f, count=True, output=out)).result.collect()[0]["count"] == 3
    assert run(spark, Job(input=f, count=True, fast_mode=True,
                          output=out)).result.collect()[0]["count"] == 3


def test_sql_per_file_runs_per_file(spark, tmp_path, out):
    d, n = _events_csv_dir(spark, tmp_path)
    res = run(spark, Job(input=d, format="csv", output=out,
                         sql="SELECT COUNT(*) AS c FROM input_data"))
    counts = sorted(int(lines(w.path)[1]) for w in res.outputs)
    assert len(counts) == 2 and sum(counts) == n


def test_reference_query_with_varchar_and_quoted_names(spark, tmp_path, out):
    f = write(str(tmp_path / "e.csv"),
              "event,user_id,time,$email\nview,1,2024-01-01 00:00:01.5,a@x\n,2,2024-01-02 00:00:00,b@x\n")
    res = run(spark, Job(input=f, format="csv", output=out,
                         sql='SELECT event, user_id, CAST(time AS VARCHAR) AS time_str, "$email" '
                             'FROM input_data WHERE event IS NOT NULL;'))
    assert lines(res.outputs[0].path) == ["event,user_id,time_str,$email",
                                          "view,1,2024-01-01 00:00:01.5,a@x"]


def test_cols_and_dedupe(spark, tmp_path, out):
    f = write(str(tmp_path / "d.csv"), "$email,a.b,c\nx,1,9\nx,1,8\ny,2,7\n")
    res = run(spark, Job(input=f, format="csv", cols="a.b,$email", dedupe=True, output=out))
    body = lines(res.outputs[0].path)
    assert body[0] == "a.b,$email" and sorted(body[1:]) == ["1,x", "2,y"]


def test_nested_values_become_json_text_in_csv(spark, tmp_path, out):
    f = write(str(tmp_path / "n.ndjson"), '{"id": 1, "tags": [1, 2], "o": {"k": "v"}}\n')
    res = run(spark, Job(input=f, format="csv", output=out))
    assert lines(res.outputs[0].path) == ['id,tags,o', '1,"[1,2]","{""k"":""v""}"']


def test_ndjson_keeps_nulls_and_timestamp_text(spark, tmp_path, out):
    f = write(str(tmp_path / "t.csv"), "a,b,ts\n1,,2024-01-01 00:00:01.5\n")
    res = run(spark, Job(input=f, format="ndjson", output=out))
    rec = json.loads(lines(res.outputs[0].path)[0])
    assert rec == {"a": 1, "b": None, "ts": "2024-01-01 00:00:01.5"}


def test_xml_output_and_custom_root_input(spark, tmp_path, out):
    f = write(str(tmp_path / "emp.xml"),
              "<employees><employee><id>1</id><name>Ann</name><department>Eng</department>"
              "</employee><employee><id>2</id><name>Bo</name><department>Ops</department>"
              "</employee></employees>")
    res = run(spark, Job(input=f, format="csv", xml_root="employees", output=out,
                         cols="id,name,department"))
    assert len(lines(res.outputs[0].path)) == 3
    res2 = run(spark, Job(input=_local(res.outputs[0].path), format="xml", output=out + "/x"))
    text = open(_local(res2.outputs[0].path)).read()
    assert "<root>" in text and text.count("<row>") == 2


def test_fast_mode_copies_lines_byte_for_byte(spark, tmp_path, out):
    body = '{"b": 1,   "a": 2}\n{"weird":   "spacing"}\n'
    f = write(str(tmp_path / "raw.ndjson"), body)
    res = run(spark, Job(input=f, format="ndjson", fast_mode=True, output=out))
    assert open(_local(res.outputs[0].path)).read() == body


def test_preview_first_file_only_and_limit_before_steps(spark, tmp_path):
    d, n = _events_csv_dir(spark, tmp_path, n_files=2)
    res = run(spark, Job(input=d, format="ndjson", preview=5))
    assert res.result.count() == 5 and not res.outputs
    res = run(spark, Job(input=d, format="ndjson", preview=5,
                         steps=({"select": {"field": "event", "value": "no such event"}},)))
    assert res.result.count() == 0


def test_steps_in_job_and_failure_policy(spark, tmp_path, out):
    d, n = _events_csv_dir(spark, tmp_path, n_files=1)
    res = run(spark, Job(input=d, format="ndjson", output=out,
                         steps=({"select": {"field": "event", "op": "==", "value": "view"}},
                                {"reshape": {"id": "user_id", "action": "event"}},
                                {"set": {"processed": True}})))
    recs = [json.loads(x) for x in lines(res.outputs[0].path)]
    assert recs and all(r["action"] == "view" and r["processed"] is True for r in recs)
    assert set(recs[0]) == {"id", "action", "processed"}
    bad = run(spark, Job(input=d, format="ndjson", output=out + "/b",
                         steps=({"select": {"field": "event", "op": "~", "value": 1}},)))
    assert len(lines(bad.outputs[0].path)) == n
    with pytest.raises(Exception):
        run(spark, Job(input=d, format="ndjson", output=out + "/c", strict=True,
                       steps=({"select": {"field": "event", "op": "~", "value": 1}},)))


def test_per_file_output_of_a_many_split_file_keeps_file_order(spark, tmp_path, out):
    """A file cut into many splits is gathered to one writer and written in file order."""
    f = str(tmp_path / "big.ndjson")
    with open(f, "w") as fh:
        for i in range(20000):
            fh.write(f'{{"seq": {i}, "pad": "{"x" * 40}"}}\n')
    spark.conf.set("spark.sql.files.maxPartitionBytes", "65536")
    try:
        res = run(spark, Job(input=f, format="csv", output=out))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    body = lines(res.outputs[0].path)
    assert body[0] == "seq,pad"
    assert [int(x.split(",")[0]) for x in body[1:]] == list(range(20000))


@pytest.fixture
def parts_path(spark):
    """Force text outputs to be assembled from parallel parts."""
    spark.conf.set("spark.ferry.assembleMinBytes", "0")
    yield
    spark.conf.unset("spark.ferry.assembleMinBytes")


def test_parts_path_per_file_many_splits_in_order(spark, tmp_path, out, parts_path):
    f = str(tmp_path / "big.ndjson")
    with open(f, "w") as fh:
        for i in range(20000):
            fh.write(f'{{"seq": {i}, "pad": "{"y" * 40}"}}\n')
    spark.conf.set("spark.sql.files.maxPartitionBytes", "65536")
    try:
        res = run(spark, Job(input=f, format="csv", output=out, compressed=True))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    with gzip.open(_local(res.outputs[0].path), "rt") as fh:
        body = fh.read().splitlines()
    assert body[0] == "seq,pad"
    assert [int(x.split(",")[0]) for x in body[1:]] == list(range(20000))


def test_parts_path_merge_keeps_file_order_and_one_header(spark, tmp_path, parts_path):
    d, n = _events_csv_dir(spark, tmp_path, n_files=3)
    res = run(spark, Job(input=d, format="csv", single_file=True))
    body = lines(res.outputs[0].path)
    assert body[0] == "event_id,user_id,event" and body.count(body[0]) == 1
    ids = [int(x.split(",")[0]) for x in body[1:]]
    assert ids == sorted(ids) and len(ids) == n


def test_parts_path_dedupe_per_file(spark, tmp_path, out, parts_path):
    d, n = _events_csv_dir(spark, tmp_path, n_files=2)
    res = run(spark, Job(input=d, format="ndjson", cols="user_id,event", dedupe=True,
                         output=out))
    assert len(res.outputs) == 2
    for w in res.outputs:
        recs = [tuple(json.loads(x).values()) for x in lines(w.path)]
        assert len(recs) == len(set(recs)) > 0


def test_parts_path_sql_order_kept_in_merge(spark, tmp_path, out, parts_path):
    d, n = _events_csv_dir(spark, tmp_path, n_files=2)
    res = run(spark, Job(input=d, format="ndjson", single_file=True, output=out + "/d.ndjson",
                         sql="SELECT event_id FROM input_data ORDER BY event_id DESC"))
    ids = [json.loads(x)["event_id"] for x in lines(res.outputs[0].path)]
    assert ids == sorted(ids, reverse=True) and len(ids) == n


def test_merge_of_a_single_file_is_honoured(spark, tmp_path):
    f = write(str(tmp_path / "one.csv"), "a,b\n1,x\n2,y\n")
    res = run(spark, Job(input=f, format="ndjson", single_file=True))
    assert _local(res.outputs[0].path) == str(tmp_path / "one_merged.ndjson")
    assert len(lines(res.outputs[0].path)) == 2


def test_preview_pair_and_explain(spark, tmp_path):
    from ferry.operators.preview import preview_pair
    from ferry.plans.runner import explain_job
    df = spark.read.parquet(f"{SF001}/events.parquet")
    raw, after = preview_pair(df, [{"select": {"field": "event_type", "value": "view"}}])
    assert raw.count() == 5 and after.count() <= 10
    assert all(r.event_type == "view" for r in after.collect())
    plan = explain_job(spark, Job(input=f"{SF001}/events.parquet", format="csv",
                                  cols="user_id", sql=None,
                                  steps=None))
    assert "ReadSchema: struct<user_id:bigint>" in plan
    assert "secret" not in plan.lower()


def test_outputs_next_to_inputs_in_several_folders_one_job(spark, tmp_path):
    root = tmp_path / "tree"
    write(str(root / "a" / "x.csv"), "k\n1\n2\n")
    write(str(root / "b" / "x.csv"), "k\n3\n")
    write(str(root / "b" / "c" / "y.csv"), "k\n4\n")
    res = run(spark, Job(input=str(root), format="ndjson"))
    got = {_local(w.path): len(lines(w.path)) for w in res.outputs}
    assert got == {str(root / "a" / "x.ndjson"): 2, str(root / "b" / "x.ndjson"): 1,
                   str(root / "b" / "c" / "y.ndjson"): 1}
    assert not [p for p in os.listdir(root) if p.startswith(".ferry-staging")]


def test_large_parquet_merge_uses_range_sort_and_keeps_order(spark, tmp_path, out, parts_path):
    d, n = _events_csv_dir(spark, tmp_path, n_files=3)
    res = run(spark, Job(input=d, format="parquet", single_file=True, output=out + "/m.parquet"))
    back = spark.read.parquet(_local(res.outputs[0].path)).collect()
    ids = [r.event_id for r in back]
    assert ids == sorted(ids) and len(ids) == n


def test_extract_step_writes_bare_values(spark, tmp_path, out):
    d, n = _events_csv_dir(spark, tmp_path, n_files=1)
    res = run(spark, Job(input=d, format="ndjson", output=out,
                         steps=({"select": {"field": "event", "value": "view"}},
                                {"extract": "event"})))
    body = lines(res.outputs[0].path)
    assert body and set(body) == {'"view"'}


def test_rerun_replaces_outputs(spark, tmp_path, out):
    f = write(str(tmp_path / "r.csv"), "a\n1\n2\n")
    run(spark, Job(input=f, format="csv", output=out))
    write(str(tmp_path / "r.csv"), "a\n3\n")
    res = run(spark, Job(input=f, format="csv", output=out))
    assert lines(res.outputs[0].path) == ["a", "3"]
    assert sorted(os.listdir(out)) == ["r.csv"]  # no staging folder, no .crc sidecar


def test_csv_keeps_blanks_quotes_and_newlines(spark, tmp_path, out):
    f = write(str(tmp_path / "w.ndjson"),
              '{"a": "  lead", "b": "trail  ", "c": "say \\"hi\\"", "d": "x\\ny", "e": ""}\n')
    res = run(spark, Job(input=f, format="csv", output=out))
    text = open(_local(res.outputs[0].path)).read()
    assert text == 'a,b,c,d,e\n  lead,trail  ,"say ""hi""","x\ny",""\n'
    back = read_files(spark, [_local(res.outputs[0].path)]).collect()[0]
    assert (back.a, back.b, back.c, back.d) == ("  lead", "trail  ", 'say "hi"', "x\ny")


def test_row_local_sql_per_file_in_one_job_keeps_file_order(spark, tmp_path, out):
    from ferry.plans.runner import is_row_local
    from ferry.operators.sqlstage import run_sql
    d, n = _events_csv_dir(spark, tmp_path, n_files=3)
    sql = "SELECT event_id, upper(event) AS e FROM input_data WHERE event <> 'view'"
    df = read_files(spark, [f"{d}/part-1.csv"])
    assert is_row_local(run_sql(df, sql))
    assert not is_row_local(run_sql(df, "SELECT event, COUNT(*) AS c FROM input_data GROUP BY event"))
    assert not is_row_local(run_sql(df, "SELECT * FROM input_data ORDER BY event_id LIMIT 5"))
    res = run(spark, Job(input=d, format="csv", output=out, sql=sql, rows=100))
    per_src = {}
    for w in res.outputs:
        body = lines(w.path)
        assert body[0] == "event_id,e" and len(body) - 1 <= 100
        per_src.setdefault(os.path.basename(w.source), []).append((w.chunk, body[1:]))
    assert sorted(per_src) == ["part-1.csv", "part-2.csv", "part-3.csv"]
    total = 0
    for src, chunks in per_src.items():
        ids = [int(x.split(",")[0]) for _, rows in sorted(chunks) for x in rows]
        assert ids == sorted(ids) and "VIEW" not in {x.split(",")[1] for _, r in chunks for x in r}
        total += len(ids)
    expected = spark.read.parquet(f"{SF001}/events.parquet").where("event_type <> 'view'").count()
    assert total == expected


def test_parts_path_empty_result_and_gzip_header(spark, tmp_path, out, parts_path):
    d, n = _events_csv_dir(spark, tmp_path, n_files=2)
    res = run(spark, Job(input=d, format="csv", single_file=True, output=out + "/none.csv",
                         sql="SELECT event_id, event FROM input_data WHERE event = 'nope'"))
    assert lines(res.outputs[0].path) == ["event_id,event"]
    res = run(spark, Job(input=d, format="csv", single_file=True, compressed=True,
                         output=out + "/all.csv"))
    with gzip.open(_local(res.outputs[0].path), "rt") as fh:
        body = fh.read().splitlines()
    assert body[0] == "event_id,user_id,event" and body.count(body[0]) == 1
    assert len(body) == n + 1


@pytest.mark.parametrize("threshold", [None, "0"])
@pytest.mark.parametrize("compressed", [False, True])
def test_chunks_across_split_boundaries_without_shuffle(spark, tmp_path, out, compressed,
                                                        threshold):
    f = str(tmp_path / "big.ndjson")
    with open(f, "w") as fh:
        for i in range(20000):
            fh.write(f'{{"seq": {i}, "pad": "{"z" * 40}"}}\n')
    spark.conf.set("spark.sql.files.maxPartitionBytes", "65536")
    if threshold is not None:
        spark.conf.set("spark.ferry.assembleMinBytes", threshold)
    try:
        res = run(spark, Job(input=f, format="csv", rows=3001, output=out,
                             compressed=compressed))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.ferry.assembleMinBytes")
    assert len(res.outputs) == 7
    for w in sorted(res.outputs, key=lambda w: w.chunk):
        p = _local(w.path)
        body = (gzip.open(p, "rt") if compressed else open(p)).read().splitlines()
        assert body[0] == "seq,pad" and body.count("seq,pad") == 1
        seqs = [int(x.split(",")[0]) for x in body[1:]]
        start = w.chunk * 3001
        assert seqs == list(range(start, min(start + 3001, 20000)))
        assert os.path.basename(p) == f"big-{w.chunk + 1}.csv" + (".gz" if compressed else "")


def test_job_document_end_to_end(spark, tmp_path, out):
    d, n = _events_csv_dir(spark, tmp_path, n_files=2)
    doc = {"input_path": d, "format": "ndjson", "output": out, "rows": 250,
           "sql_inline": "SELECT event_id, event FROM input_data WHERE event IS NOT NULL;",
           "prefix": "p_", "compressed": False, "max_parallel_jobs": 2}
    res = run(spark, Job.from_dict(doc))
    names = sorted(os.path.basename(w.path) for w in res.outputs)
    assert names[0].startswith("p_part-1-") and names[-1].startswith("p_part-2-")
    total = sum(len(lines(w.path)) for w in res.outputs)
    assert total == n


def test_parts_path_xml_merge_and_chunks_are_valid_documents(spark, tmp_path, out, parts_path):
    from ferry.sources.readers import ReadOptions
    d, n = _events_csv_dir(spark, tmp_path, n_files=3)
    res = run(spark, Job(input=d, format="xml", single_file=True, output=out + "/all.xml",
                         xml_root="events"))
    text = open(_local(res.outputs[0].path)).read()
    assert text.count("<events>") == 1 and text.count("</events>") == 1
    assert text.count("<?xml") == 1 and text.count("<row>") == n
    back = read_files(spark, [_local(res.outputs[0].path)], ReadOptions(xml_root="events"))
    assert sorted(r.event_id for r in back.collect()) == list(range(n))

    f = str(tmp_path / "big.ndjson")
    with open(f, "w") as fh:
        for i in range(6000):
            fh.write(f'{{"seq": {i}, "pad": "{"w" * 40}"}}\n')
    spark.conf.set("spark.sql.files.maxPartitionBytes", "65536")
    try:
        res = run(spark, Job(input=f, format="xml", rows=2500, output=out + "/chunks"))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(res.outputs) == 3
    for w in res.outputs:
        rows = read_files(spark, [_local(w.path)]).collect()
        start = w.chunk * 2500
        assert sorted(r.seq for r in rows) == list(range(start, min(start + 2500, 6000)))

    res = run(spark, Job(input=d, format="xml", single_file=True, output=out + "/none.xml",
                         sql="SELECT event_id FROM input_data WHERE event = 'nope'"))
    # no rows: Spark's XML writer writes no document at all, on either path
    assert "<row>" not in open(_local(res.outputs[0].path)).read()


def test_parquet_per_file_of_big_files_reads_each_whole(spark, tmp_path, out):
    """Parquet outputs need one writer per input: each file is read by one task."""
    d = str(tmp_path / "pq")
    (spark.range(0, 200000, 1, 1).selectExpr("id", "repeat('x', 20) AS pad")
     .write.option("parquet.block.size", 65536).parquet(d))
    src = [f for f in os.listdir(d) if f.endswith(".parquet")]
    assert len(src) == 1
    spark.conf.set("spark.sql.files.maxPartitionBytes", "65536")
    try:
        res = run(spark, Job(input=d, format="parquet", output=out))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    back = spark.read.parquet(_local(res.outputs[0].path))
    assert [r.id for r in back.collect()] == list(range(200000))


def test_fast_mode_chunks_raw_lines(spark, tmp_path, out):
    body = ['{"b": 1,   "a": 2}', 'not json at all', '{"x": [1, 2]}', '{}', '{"y":  null}']
    f = write(str(tmp_path / "raw.ndjson"), "\n".join(body) + "\n")
    res = run(spark, Job(input=f, format="ndjson", fast_mode=True, rows=2, output=out))
    got = {os.path.basename(w.path): open(_local(w.path)).read().splitlines() for w in res.outputs}
    assert got == {"raw-1.ndjson": body[:2], "raw-2.ndjson": body[2:4], "raw-3.ndjson": body[4:]}


@pytest.mark.parametrize("threshold", [None, "0"])
def test_fast_mode_merge_keeps_lines_in_file_order(spark, tmp_path, out, threshold):
    d = tmp_path / "lines"
    d.mkdir()
    expected = []
    for i in range(3):
        body = [f'{{"f": {i}, "n": {j},   "sp": " x "}}' for j in range(200)]
        expected += body
        write(str(d / f"p{i}.ndjson"), "\n".join(body) + "\n")
    if threshold is not None:
        spark.conf.set("spark.ferry.assembleMinBytes", threshold)
    try:
        res = run(spark, Job(input=str(d), format="ndjson", fast_mode=True, single_file=True,
                             output=out + "/all.ndjson"))
    finally:
        if threshold is not None:
            spark.conf.unset("spark.ferry.assembleMinBytes")
    assert open(_local(res.outputs[0].path)).read().splitlines() == expected


def test_aggregate_sql_per_file_batched_with_chunks(spark, tmp_path, out):
    src = tmp_path / "in dir"
    src.mkdir()
    for i, n in enumerate([7, 12, 3]):
        write(str(src / f"f {i}.csv"), "k,v\n" + "".join(f"k{j % 5},{j}\n" for j in range(n * 10)))
    res = run(spark, Job(input=str(src), format="csv", rows=2, output=out,
                         sql="SELECT k, COUNT(*) AS n, SUM(v) AS total FROM input_data GROUP BY k"))
    per = {}
    for w in res.outputs:
        body = lines(w.path)
        assert body[0] == "k,n,total" and 1 <= len(body) - 1 <= 2
        per.setdefault(os.path.basename(w.source), []).extend(body[1:])
    assert sorted(per) == ["f 0.csv", "f 1.csv", "f 2.csv"]
    for i, n in enumerate([7, 12, 3]):
        rows = {x.split(",")[0]: int(x.split(",")[1]) for x in per[f"f {i}.csv"]}
        assert len(rows) == 5 and sum(rows.values()) == n * 10


@pytest.mark.parametrize("threshold", [None, "0"])
def test_chunks_after_dedupe_across_partitions(spark, tmp_path, out, threshold):
    """Dedupe output spread over many partitions, cut into chunks: every
    distinct row exactly once, every chunk exactly N rows but the last."""
    src = spark.read.parquet("/root/testdata/sf0.01/events.parquet").select("user_id", "event_type")
    f = str(tmp_path / "ev.csv")
    with open(f, "w") as fh:
        fh.write("user_id,event_type\n")
        for r in src.collect():
            fh.write(f"{r.user_id},{r.event_type}\n")
    expected = {(r.user_id, r.event_type) for r in src.collect()}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    if threshold is not None:
        spark.conf.set("spark.ferry.assembleMinBytes", threshold)
    try:
        res = run(spark, Job(input=f, format="csv", dedupe=True, rows=70, output=out))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.unset("spark.ferry.assembleMinBytes")
    got, sizes = [], []
    for w in sorted(res.outputs, key=lambda w: w.chunk):
        body = lines(w.path)
        assert body[0] == "user_id,event_type"
        sizes.append(len(body) - 1)
        got += [(int(x.split(",")[0]), x.split(",")[1]) for x in body[1:]]
    assert len(got) == len(set(got)) and set(got) == expected
    assert sizes[:-1] == [70] * (len(sizes) - 1) and 0 < sizes[-1] <= 70


def test_per_file_csv_outputs_keep_their_own_columns(spark, tmp_path, out):
    d = tmp_path / "hdrs"
    write(str(d / "a.csv"), "id,name\n1,ann\n")
    write(str(d / "b.csv"), "id,city\n2,oslo\n")
    write(str(d / "c.csv"), "id,name\n3,bo\n")
    res = run(spark, Job(input=str(d), format="csv", output=out))
    got = {os.path.basename(w.path): lines(w.path) for w in res.outputs}
    assert got == {"a.csv": ["id,name", "1,ann"], "b.csv": ["id,city", "2,oslo"],
                   "c.csv": ["id,name", "3,bo"]}


def test_every_input_gets_an_output_and_old_rows_go(spark, tmp_path):
    d, out = str(tmp_path / "in"), str(tmp_path / "out")
    write(f"{d}/a.csv", "k,v\n1,2\n")
    write(f"{d}/b.csv", "k,v\n")
    for fmt in ("csv", "ndjson", "xml", "parquet"):
        run(spark, Job(input=d, format=fmt, output=out))
        assert sorted(f for f in os.listdir(out) if f.endswith(fmt)) == [f"a.{fmt}", f"b.{fmt}"]
    run(spark, Job(input=d, format="csv", output=out, sql="SELECT * FROM input_data WHERE k > 5"))
    assert open(f"{out}/a.csv").read().strip() in ("k,v", "")
    assert "2" not in open(f"{out}/a.csv").read()


def test_stale_chunks_go(spark, tmp_path):
    d, out = str(tmp_path / "in"), str(tmp_path / "out")
    write(f"{d}/a.csv", "k\n" + "".join(f"{i}\n" for i in range(10)))
    run(spark, Job(input=d, format="csv", output=out, rows=2))
    run(spark, Job(input=d, format="csv", output=out, rows=5))
    assert len([f for f in os.listdir(out) if f.endswith(".csv")]) == 2


def test_analytical_result_is_computed_once_and_keeps_its_order(spark, tmp_path):
    d, out = str(tmp_path / "in"), str(tmp_path / "out")
    write(f"{d}/a.csv", "k\n" + "".join(f"{i}\n" for i in range(50)))
    res = run(spark, Job(input=d, output=out, sql='SELECT k AS "a b", rand() AS r FROM input_data ORDER BY k DESC'))
    first = [tuple(r) for r in res.result.collect()]
    assert first == [tuple(r) for r in res.result.collect()] and [r[0] for r in first] == list(range(49, -1, -1))
    assert [line.split(",")[0] for line in open(f"{out}/query_result.csv").read().splitlines()[1:]] == \
        [str(i) for i in range(49, -1, -1)]
