import json
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from colloquy import cli
from colloquy.operators import vectors
from colloquy.operators.store import Store
from colloquy.sources import workbooks

from test_sources import LIST


def rows(capsys):
    return [json.loads(line) for line in capsys.readouterr().out.splitlines()]


def test_commands_from_import_to_workbook(spark, tmp_path, capsys):
    export = tmp_path / "conversations.json"
    export.write_text(json.dumps([LIST[0], LIST[0] | {"uuid": "u3", "name": "Another"}]))
    root = f"file://{tmp_path}/root"
    run = lambda *a: (cli.main([root, *a][:1] + ["--now", "5"] + [*a], spark), rows(capsys))[1]
    assert run("import", str(export)) == [{"outcome": "imported", "n": 2}]
    assert run("import", str(export)) == [{"outcome": "duplicate", "n": 2}]
    ids = [r["conversation_id"] for r in run("review")]
    assert len(ids) == 2
    run("approve", *ids)
    run("process")
    run("tag", ids[0], "one", "two")
    run("untag", ids[0], "two")
    tables = Store(spark, root).tables()
    assert {r.conversation_id: list(r.manual_tags or []) for r in tables["conversations"].collect()} == {ids[0]: ["one"], ids[1]: []}
    assert len(run("list")) == 2 and run("review") == [] and tables["chunks"].count() >= 2
    assert {r["hit_type"] for r in run("query", "tag:one")} == {"conversation"}
    book = str(tmp_path / "b.xlsx")
    sheets = {r["sheet"]: r["n"] for r in run("export", book, "--profile", "full_analysis")}
    assert sheets["conversations"] == 2 and list(sheets) == list(workbooks.PROFILES["full_analysis"][1])
    with zipfile.ZipFile(book) as z:
        assert "xl/worksheets/sheet10.xml" in z.namelist()
    run("report", str(tmp_path / "r.html"))
    assert "[redacted]" not in (tmp_path / "r.html").read_text()
    run("normalize", str(tmp_path / "n"))
    run("quarantine", ids[1])
    assert Store(spark, root).read("chunks").where(F.col("conversation_id") == ids[1]).count() == 0
    run("delete", ids[1])
    assert Store(spark, root).read("conversations").count() == 2  # only a plan
    run("delete", ids[1], "--sure")
    stored = {n: t for n, t in Store(spark, root).tables().items() if n.startswith("search_") and "conversation_id" in t.columns}
    assert len(stored) >= 8 and all(t.where(F.col("conversation_id") == ids[1]).count() == 0 for t in stored.values())
    assert Store(spark, root).read("conversations").count() == 1 and run("check") is not None
    run("rebuild", str(tmp_path / "n"))
    assert Store(spark, root).read("conversations").count() == 1  # what was deleted left the normalised JSON too
    said = [json.loads(r["value"]) for r in run("log")]
    assert [e["command"] for e in sorted(said, key=lambda e: e["command"])] == ["approve", "delete", "import", "index", "index", "process", "quarantine", "rebuild", "tag", "untag"]


def test_a_crash_between_tables_and_pointer_leaves_the_state_before(spark, tmp_path, monkeypatch):
    s = Store(spark, f"file://{tmp_path}/root").init()
    s.commit({"t": spark.range(3)})
    with monkeypatch.context() as m:
        m.setattr(Store, "_point", lambda *a: (_ for _ in ()).throw(OSError("crash")))
        with pytest.raises(OSError):
            s.commit({"t": spark.range(9)})
    assert s.read("t").count() == 3
    (tmp_path / "root" / "_pointer-half").write_text("{")  # a pointer that was never renamed
    assert s.read("t").count() == 3
    with pytest.raises(RuntimeError):
        s._point({}, s._current()[0])


def test_nearest_matches_brute_force_in_blocks(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(60, 8)).astype(np.float32)
    x[7] = x[3]
    x[9] = 0
    e = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)] + [(None, x[0].tolist()), (99, None)], "vec_id long, embedding array<float>")
    unit = x.astype(float) / np.maximum(np.linalg.norm(x.astype(float), axis=1, keepdims=True), 1e-300)
    cosine = np.round(unit @ unit.T, 5)
    for block in (4096, 3):
        got = {}
        for r in vectors.nearest(e, e.where("vec_id % 10 = 0 OR vec_id = 9"), k=4, block=block).collect():
            got.setdefault(r.query_id, set()).add(r.vec_id)
        assert got == {q: set(sorted(range(60), key=lambda k: (-cosine[q, k], k))[:4]) for q in (0, 9, 10, 20, 30, 40, 50)}
    assert vectors.nearest(e.limit(0), e).count() == 0 and vectors.nearest(e, e.limit(0)).count() == 0
