import json

import pytest
import yaml

from gaugewright import cli

from . import demo


def call(*argv):
    with pytest.raises(SystemExit) as e:
        cli.main([str(a) for a in argv])
    return e.value.code


def test_exit_codes(spark, tmp_path, capsys):
    data, at = demo.write(tmp_path, demo.three_rows(), demo.task())
    assert call("evaluate-d0", "--task", at) == 2
    assert json.loads(capsys.readouterr().out)["criterion_id"] == "D0"
    assert call("evaluate-d1", "--task", at, "--dataset", data, "--output", tmp_path / "out" / "d1.json") == 0
    assert json.loads((tmp_path / "out" / "d1.json").read_text())["status"] == "PASS"
    assert call("evaluate-d1", "--task", at, "--dataset", tmp_path / "none.csv") == 1
    assert call("evaluate-all", "--task", at, "--dataset", data) == 2
    (tmp_path / "task.yaml").write_text("task_id: x\nunknown: 1\n")
    assert call("evaluate-d0", "--task", at) == 3
    assert call("write-schemas", "--output-dir", tmp_path / "schemas") == 0
    assert len(list((tmp_path / "schemas").glob("*.schema.json"))) == 7


def test_audit(tmp_path, capsys):
    _, at = demo.write(tmp_path, demo.three_rows(), demo.task())
    paths = ["task.claim", "task.d2", "task.d3", "task.d6", "task.d4", "task.d5"]
    entry = {"criterion": "D2", "classification": "3_experimental_design_choice", "resolution_stage": "after_acquisition", "decision_question": "?", "legitimate_source": "plan"}
    register = {"register_id": "r", "task_id": "made_up_task", "task_config": "task.yaml", "expected_d0_status": "INDETERMINATE", "expected_missing_count": 6, "scope_note": "n", "entries": [entry | {"path": p} for p in paths]}
    (tmp_path / "register.yaml").write_text(yaml.safe_dump(register))
    assert call("audit-declarations", "--task", at, "--register", tmp_path / "register.yaml") == 0
    told = json.loads(capsys.readouterr().out)
    assert told["classification_counts"]["3_experimental_design_choice"] == 6 and told["classification_counts"]["5_value_evaluated_after_acquisition"] == 0
    register["entries"].pop(2)
    (tmp_path / "register.yaml").write_text(yaml.safe_dump(register))
    assert call("audit-declarations", "--task", at, "--register", tmp_path / "register.yaml") == 1
    assert json.loads(capsys.readouterr().out)["missing_from_register"] == ["task.d3"]
