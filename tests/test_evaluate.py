"""The command that evaluates retrieval and writes a baseline, or refuses to."""

import json

from strataloom import evaluate


def test_command(spark, tmp_path, capsys):
    questions = [{"id": f"q{i}", "category": "exact", "question": f"load_{i}", "expected_targets": [{"path": f"m{i}.py", "symbol": f"load_{i}"}]} for i in (1, 2)]
    (tmp_path / "set.json").write_text(json.dumps({"version": 1, "repository": {"type": "local", "name": "n", "path": "p"}, "questions": questions}))
    rows = [(f"u{i}", f"f{i}", "function", f"def load_{i}(): pass", "python", 1, 1, f"load_{i}", [1.0, float(i)]) for i in range(1, 5)]
    spark.createDataFrame(rows, "id string, file_id string, kind string, content string, language string, start_line int, end_line int, symbol_name string, embedding array<float>").write.parquet(str(tmp_path / "units"))
    spark.createDataFrame([(f"f{i}", "r", f"m{i}.py") for i in range(1, 5)], "id string, repository_id string, path string").write.parquet(str(tmp_path / "files"))
    report = tmp_path / "report.json"
    arguments = [str(tmp_path / "set.json"), str(tmp_path / "units"), str(tmp_path / "files"), "--repository", "r", "--width", "2", "--questions", "2", "--write-baseline", str(report)]
    assert evaluate.main([*arguments, "--control", "recall_at_10=0.5"], spark) == 1 and not report.exists()
    assert evaluate.main([*arguments, "--control", "recall_at_10=1.0"], spark) == 0
    written = json.loads(report.read_text())
    assert set(written) == {"semantic", "hybrid", "reranked"} and written["reranked"]["recall_at_1"] == 1.0 and report.read_text().endswith("\n")
    assert "reranked: recall_at_1 1.000000" in capsys.readouterr().out
