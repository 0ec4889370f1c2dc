"""Array files read in splits: every element once and in order, however the file is cut."""
import json
import os
import random

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ferry import Job, run
from ferry.functions.internal import SRC_BLOCK, SRC_FILE, SRC_POS
from ferry.sinks import layout
from ferry.sources import jsonarrays
from ferry.sources.readers import ReadOptions, read_files
from tests.test_csvrecords import cut, put  # noqa: F401 - a fixture

STYLES = [{}, {"indent": 2}, {"separators": (",", ":")}]


def sample(n, seed):
    r = random.Random(seed)
    bits = ["a", '"', "}", "{", "\\", "]", "é", "\n", ",", "[{"]
    return [{"z": i, "a": "".join(r.choice(bits) for _ in range(r.randrange(30))), "n": {"x": [{"y": i}, {}]}} for i in range(n)]


@pytest.mark.parametrize("style", STYLES)
def test_any_cut_gives_the_elements_in_order(spark, tmp_path, cut, style):  # noqa: F811
    rows = {f"{tmp_path}/{k}.json": sample(60, k) for k in range(2)}
    for path, own in rows.items():
        put(path, json.dumps(own, **style) + "\n")
    cut(150)
    df = read_files(spark, list(rows), tag=True)
    assert df.columns[:3] == ["z", "a", "n"]       # first-seen order, not the alphabet's
    got = df.orderBy(SRC_FILE, SRC_BLOCK, SRC_POS).collect()
    assert [(r.z, r.a) for r in got] == [(o["z"], o["a"]) for own in rows.values() for o in own]
    assert [r.n.x[0].y for r in got] == [o["z"] for own in rows.values() for o in own]


json_values = st.recursive(st.none() | st.booleans() | st.integers() | st.text('a"\\{}[],é\n', max_size=8),
                           lambda v: st.lists(v, max_size=3) | st.dictionaries(st.text('k"}', max_size=3), v, max_size=3), max_leaves=8)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.dictionaries(st.text('k{"', max_size=3), json_values, max_size=4), max_size=8), st.sampled_from(STYLES), st.data())
def test_splitter(rows, style, data):
    """The pieces of a text, cut into splits anywhere, give the elements back."""
    pieces = (json.dumps(rows, **style) + "\n").split("}")
    cuts = sorted(data.draw(st.sets(st.integers(1, max(1, len(pieces) - 1)), max_size=4)))
    inside, depth, whole, open_text = False, 0, [], ""
    for start, end in zip([0, *cuts], [*cuts, len(pieces)]):
        split = jsonarrays._Split("f", start, inside, depth)
        done, kinds = split.add(pa.array(pieces[start:end], pa.string()), None)
        for text, kind in zip(done, kinds):
            whole.append(open_text + text)
            assert bool(open_text) == (kind == jsonarrays.HEAD)
            open_text = ""
        open_text += "".join(t for t, _ in split.rest())
        for p in pieces[start:end]:
            text, inside = jsonarrays.bare(p, inside)
            depth += jsonarrays._delta(text, not inside)
    assert [json.loads(t) for t in whole] == rows and not open_text


def test_types_dates_schema_and_gzip(spark, tmp_path):
    import gzip
    body = '[{"b":"2020-01-02","a":1.5},\n{"b":null,"c":[1,2]}]'
    src = put(f"{tmp_path}/t.json", body)
    with gzip.open(f"{tmp_path}/t.json.gz", "wt") as f:
        f.write(body)
    for path in (src, f"{tmp_path}/t.json.gz"):
        assert read_files(spark, [path]).dtypes == [("b", "date"), ("a", "double"), ("c", "array<bigint>")]
    given_ = read_files(spark, [src], ReadOptions(schema="a double, b string"))
    assert sorted(map(tuple, given_.collect()), key=str) == [(1.5, "2020-01-02"), (None, None)]


def test_empty_arrays_and_other_elements(spark, tmp_path):
    assert read_files(spark, [put(f"{tmp_path}/e.json", "[]")]).count() == 0
    assert read_files(spark, [put(f"{tmp_path}/b.json", " [\n ] \n")]).count() == 0
    with pytest.raises(Exception, match="no objects"):
        read_files(spark, [put(f"{tmp_path}/n.json", '[{"a":1}, 2, {"a":3}]')]).count()


def test_per_file_chunks_and_merge(spark, tmp_path, cut):  # noqa: F811
    rows = sample(300, 4)
    put(f"{tmp_path}/in/a.json", json.dumps(rows, indent=1))
    put(f"{tmp_path}/in/b.json", json.dumps(rows[:5]))
    cut(2000)
    out = {os.path.basename(w.path): w.path.replace("file:", "")
           for w in run(spark, Job(input=f"{tmp_path}/in", format="ndjson", output=f"{tmp_path}/o")).outputs}
    read = lambda p: [json.loads(x) for x in open(p)]
    assert [r["z"] for r in read(out["a.ndjson"])] == list(range(300)) and [r["z"] for r in read(out["b.ndjson"])] == list(range(5))
    chunks = run(spark, Job(input=f"{tmp_path}/in/a.json", format="ndjson", rows=70, output=f"{tmp_path}/c")).outputs
    got = [[r["z"] for r in read(w.path.replace("file:", ""))] for w in sorted(chunks, key=lambda w: w.chunk)]
    assert [z for c in got for z in c] == list(range(300)) and [len(c) for c in got] == [70] * 4 + [20]
    assert layout.ASSEMBLE_MIN_BYTES_CONF
