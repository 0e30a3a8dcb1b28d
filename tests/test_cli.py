import json

from strataloom import cli


def call(capsys, spark, *argv):
    code = cli.main(list(argv), spark)
    return code, json.loads(capsys.readouterr().out.strip().split("\n")[-1])


def test_commands(capsys, spark, tmp_path):
    for q in ("7", "8"):
        (tmp_path / "in" / q).mkdir(parents=True)
        answers = [{"id": str(k), "author": "n", "content": f"<p>{'字。' * 300}</p>", "voteupCount": k} for k in range(9)]
        (tmp_path / "in" / q / "answers.json").write_text(json.dumps({"questionId": q, "questionTitle": "t", "answers": answers}))
        (tmp_path / "in" / q / "answers.md").write_text(f"# {q}\nbody of {q}")
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    assert call(capsys, spark, "stats", source)[1]["files"] == 4
    assert call(capsys, spark, "sample", source, "--out", out + "/s")[1]["questions"] == 2
    code, first = call(capsys, spark, "digest", source, "--out", out + "/d", "--max-chars", "1000")
    assert code == 0 and first["sources"] == 18 and not first["reused"]
    assert call(capsys, spark, "digest", source, "--out", out + "/d", "--max-chars", "1000")[1] == {"ok": True, "command": "digest", "reused": True, "chunks": first["chunks"]}
    assert call(capsys, spark, "archive", source, "--out", out + "/a", "--by-count", "1")[1]["volumes"] == 2
    assert call(capsys, spark, "verify", source, "--out", out + "/a") == (0, {"ok": True, "command": "verify", "valid": True, "counts": {"ok": 2}})
    (tmp_path / "in" / "7" / "answers.md").write_text("# 7\nchanged")
    code, got = call(capsys, spark, "verify", source, "--out", out + "/a")
    assert (code, got["counts"]) == (1, {"ok": 1, "changed": 1})
    assert len(call(capsys, spark, "status", source)[1]["questions"]) == 2


def test_errors(capsys, spark, tmp_path):
    (tmp_path / "7").mkdir()
    (tmp_path / "7" / "answers.json").write_text("{broken")
    code, got = call(capsys, spark, "digest", str(tmp_path), "--out", str(tmp_path / "o"))
    assert code == 1 and got["error"]["type"] == "corrupt_input" and str(tmp_path) not in got["error"]["message"]
    code, got = call(capsys, spark, "digest", str(tmp_path), "--max-chars", "1")
    assert code == 2 and got["error"]["type"] == "invalid_argument" or code == 1
    assert cli.main(["nonsense"], spark) == 2


def test_status_counts_what_it_does_not_list(capsys, spark, tmp_path, monkeypatch):
    for q in ("1", "2", "3", "4"):
        (tmp_path / "in" / q).mkdir(parents=True)
        text = "{broken" if q == "4" else json.dumps({"questionId": q, "questionTitle": "t", "answers": [{"id": "1", "content": "x"}]})
        (tmp_path / "in" / q / "answers.json").write_text(text)
    monkeypatch.setattr(cli, "LISTED", 2, raising=False)
    out = str(tmp_path / "out")
    code, got = call(capsys, spark, "status", str(tmp_path / "in"), "--out", out)
    assert code == 0 and [r["directory"] for r in got["questions"]] == ["1", "2"]
    assert (got["total"], got["answers"], got["corrupt"], got["truncated"]) == (4, 3, 1, 2)
    assert sorted(r.directory for r in spark.read.parquet(out + "/status").collect()) == ["1", "2", "3", "4"]
