"""Outputs take their places together; only files of the ledger are ever removed."""
import json
import os

import pytest

from ferry import Job, run
from ferry.functions.internal import ReservedName
from ferry.sinks import commit
from ferry.sinks.commit import OutputError
from ferry.sinks.fs import HadoopFS


def files(folder):
    return {f: open(f"{folder}/{f}").read() for f in sorted(os.listdir(folder)) if not f.startswith(".ferry-ledger")}


def write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write(text)
    return path


def test_a_chunk_never_replaces_another_input(spark, tmp_path):
    d = str(tmp_path)
    write(f"{d}/a.ndjson", '{"k":1}\n{"k":2}\n{"k":3}\n')
    write(f"{d}/p-a-1.ndjson", '{"k":10}\n')
    before = files(d)
    with pytest.raises(OutputError, match="p-a-1.ndjson is an input"):
        run(spark, Job(input=d, format="ndjson", rows=2, prefix="p-", output=d))
    assert {f: t for f, t in files(d).items() if f in before} == before
    assert not [f for f in os.listdir(d) if f.startswith("p-a-2")]


def test_stale_chunks_go_and_foreign_files_stay(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    write(f"{src}/a.csv", "k\n" + "".join(f"{i}\n" for i in range(8)))
    run(spark, Job(input=src, format="csv", rows=2, output=out))
    assert sorted(files(out)) == ["a-1.csv", "a-2.csv", "a-3.csv", "a-4.csv"]
    write(f"{out}/a-5.csv", "mine\n")                 # no job wrote it
    write(f"{out}/a-4.csv", "k\nchanged since\n")     # no longer what the job wrote
    run(spark, Job(input=src, format="csv", rows=4, output=out))
    assert sorted(files(out)) == ["a-1.csv", "a-2.csv", "a-4.csv", "a-5.csv"]
    assert files(out)["a-4.csv"] == "k\nchanged since\n" and files(out)["a-5.csv"] == "mine\n"
    ledger = [json.loads(x) for x in open(f"{out}/.ferry-ledger")]
    assert [(e["name"], e["chunk"]) for e in ledger] == [("a-1.csv", 1), ("a-2.csv", 2)]


def test_files_of_nobody_survive_a_first_run(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    write(f"{src}/a.csv", "k\n1\n2\n3\n")
    for n in (3, 4):
        write(f"{out}/a-{n}.csv", f"foreign {n}\n")
    run(spark, Job(input=src, format="csv", rows=2, output=out))
    assert files(out)["a-3.csv"] == "foreign 3\n" and files(out)["a-4.csv"] == "foreign 4\n"


def test_an_input_without_rows_loses_its_stale_chunks(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    write(f"{src}/a.csv", "k\n1\n2\n3\n")
    run(spark, Job(input=src, format="csv", rows=2, output=out))
    write(f"{src}/a.csv", "k\n")
    run(spark, Job(input=src, format="csv", rows=2, output=out))
    assert files(out) == {}


def test_one_failed_move_undoes_all(spark, tmp_path, monkeypatch):
    fs, d = HadoopFS(spark), str(tmp_path / "out")
    for i in range(5):
        write(f"{tmp_path}/stage/{i}", f"new {i}")
        if i != 2:
            write(f"{d}/t{i}", f"old {i}")
    rename = HadoopFS.rename

    def broken(self, src, dst):
        if dst.endswith("/t3") and "stage" in src:
            raise OSError("disk gone")
        rename(self, src, dst)

    monkeypatch.setattr(HadoopFS, "rename", broken)
    with pytest.raises(OSError, match="disk gone"):
        commit.place(fs, [(f"{tmp_path}/stage/{i}", f"{d}/t{i}") for i in range(5)])
    assert files(d) == {f"t{i}": f"old {i}" for i in (0, 1, 3, 4)}


def test_a_dead_jobs_moves_are_undone_by_the_next(spark, tmp_path, monkeypatch):
    fs, d = HadoopFS(spark), str(tmp_path / "out")
    write(f"{d}/a", "old a")
    write(f"{tmp_path}/s/a", "new a"), write(f"{tmp_path}/s/b", "new b")
    monkeypatch.setattr(commit, "_undo", lambda *a: None)          # the driver dies: nothing is undone
    monkeypatch.setattr(commit, "_renew_ledgers", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt()))
    delete = HadoopFS.delete
    monkeypatch.setattr(HadoopFS, "delete", lambda self, p, recursive=True: None)
    with pytest.raises(KeyboardInterrupt):
        commit.place(fs, [(f"{tmp_path}/s/a", f"{d}/a"), (f"{tmp_path}/s/b", f"{d}/b")], chunks={})
    monkeypatch.undo()
    assert delete is HadoopFS.delete and files(d)["a"] == "new a" and len(os.listdir(d)) == 4
    commit.recover(fs, d)
    assert files(d) == {"a": "old a"}


def test_two_outputs_of_one_name_and_folders_are_refused(spark, tmp_path):
    fs = HadoopFS(spark)
    write(f"{tmp_path}/s/a", "x"), write(f"{tmp_path}/s/b", "y")
    with pytest.raises(OutputError, match="same name"):
        commit.place(fs, [(f"{tmp_path}/s/a", f"{tmp_path}/t"), (f"{tmp_path}/s/b", f"{tmp_path}/t")])
    os.makedirs(f"{tmp_path}/out/a")
    with pytest.raises(OutputError, match="folder"):
        commit.place(fs, [(f"{tmp_path}/s/a", f"{tmp_path}/out/a")])


def test_columns_once_used_inside_stay_the_users(spark, tmp_path):
    src = write(f"{tmp_path}/a.csv", "_idx,_chunk,_fid,_src_file,_run,v\n" + "".join(f"{5 - i},{i},f,s,{i},{i}\n" for i in range(5)))
    out = str(tmp_path / "out")
    run(spark, Job(input=src, format="csv", rows=2, output=out))
    assert files(out) == {f"a-{c + 1}.csv": "_idx,_chunk,_fid,_src_file,_run,v\n" + "".join(
        f"{5 - i},{i},f,s,{i},{i}\n" for i in range(2 * c, min(2 * c + 2, 5))) for c in range(3)}
    run(spark, Job(input=src, format="csv", output=f"{tmp_path}/whole"))
    assert files(f"{tmp_path}/whole")["a.csv"] == open(src).read()
    line = '{"_corrupt_record":"mine","_metadata":1,"_src_pos":2}\n'
    nd = write(f"{tmp_path}/n.ndjson", line)
    run(spark, Job(input=nd, format="ndjson", output=f"{tmp_path}/nd"))
    assert files(f"{tmp_path}/nd")["n.ndjson"] == line


def test_the_jobs_own_names_are_refused(spark, tmp_path):
    src = write(f"{tmp_path}/a.csv", "__FERRY_idx,v\n1,2\n")
    with pytest.raises(ReservedName, match="__FERRY_idx"):
        run(spark, Job(input=src, format="csv", output=str(tmp_path / "out")))
    ok = write(f"{tmp_path}/b.csv", "k,v\n1,2\n")
    with pytest.raises(ReservedName):
        run(spark, Job(input=ok, format="csv", sql="SELECT k AS __ferry_file FROM input_data", output=str(tmp_path / "out")))
