import json

from hybridspark import cli


def test_ingest_and_search(spark, tmp_path, capsys):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.md").write_text("# Zebra\nstripes and hooves")
    (tmp_path / "c.json").write_text(json.dumps({"embedder": {"embedding_dimension": 32}, "store": {"path": f"file://{tmp_path}/store"}}))
    run = lambda *a: (cli.main(["-c", str(tmp_path / "c.json"), *a], spark), capsys.readouterr())
    code, out = run("--json", "ingest", "dir", str(tmp_path / "d"))
    assert code == 0 and json.loads(out.out)["chunks_stored"] == 1
    assert "chunks stored: 1" in run("ingest", "text", "plain lions roar", "--source", "s")[1].out
    assert "default: 2 chunks" in run("info")[1].out
    code, out = run("search", "stripes", "--mode", "fulltext")
    assert code == 0 and "(Zebra)" in out.out and len(out.out.splitlines()) == 1
    assert json.loads(run("--json", "search", "lions", "-k", "1", "--mode", "fulltext")[1].out)["source_path"] == "s"
    code, out = run("--collection", "none", "search", "x")
    assert code == 1 and "no such collection" in out.err
