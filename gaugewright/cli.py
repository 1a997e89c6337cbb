"""Command line: evaluate criteria, audit a register of declarations, write JSON Schemas.

Exit codes: 0 pass or not applicable, 1 fail, 2 indeterminate, 3 configuration error.
"""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from pydantic import BaseModel

from .declarations import CriterionStatus, DeclarationRegister, DeclarationRegisterAudit, EvidenceManifest, InstrumentProfile, SetupProfile, TaskConfig
from .plans.assessment import CRITERIA, Assessment, audit_declaration_register
from .results import OverallAssessmentResult
from .sources.documents import ConfigurationError, load_declaration_register, load_task_bundle, located

EXIT = {CriterionStatus.PASS: 0, CriterionStatus.NOT_APPLICABLE: 0, CriterionStatus.FAIL: 1, CriterionStatus.INDETERMINATE: 2}
SCHEMAS = {
    "evidence-manifest": EvidenceManifest, "declaration-register": DeclarationRegister, "declaration-register-audit": DeclarationRegisterAudit,
    "instrument-profile": InstrumentProfile, "overall-assessment": OverallAssessmentResult, "setup-profile": SetupProfile, "task": TaskConfig,
}


def _session():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("gaugewright").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def _emit(document: BaseModel, output: str | None, label: str) -> None:
    text = json.dumps(document.model_dump(mode="json"), indent=2) + "\n"
    if not output:
        print(text, end="")
        return
    at = located(output)
    at.parent.mkdir(parents=True, exist_ok=True)
    at.write_text(text, encoding="utf-8")
    print(f"{label}: {at}")


def _evaluate(args: argparse.Namespace) -> int:
    bundle = load_task_bundle(args.task)
    whole = args.criterion == "all"
    assessment = Assessment(args.dataset, bundle, None if args.criterion == "D0" else _session()) if args.criterion != "D0" else None
    if whole:
        result = assessment.overall()
    else:
        from .operators import claim

        result = assessment.result(args.criterion) if assessment else claim.evaluate(bundle)
    _emit(result, args.output, f"{'overall' if whole else args.criterion} evidence report")
    return EXIT[result.status]


def _audit(args: argparse.Namespace) -> int:
    result = audit_declaration_register(load_task_bundle(args.task), load_declaration_register(args.register))
    _emit(result, args.output, "declaration-register audit")
    return 0 if result.aligned else 1


def _schemas(args: argparse.Namespace) -> int:
    args.output_dir.mkdir(parents=True, exist_ok=True)
    for name, model in SCHEMAS.items():
        (args.output_dir / f"{name}.schema.json").write_text(json.dumps(model.model_json_schema(), indent=2) + "\n", encoding="utf-8")
    print(f"schemas written to {args.output_dir}")
    return 0


def build_parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="gaugewright", description="Decide whether acquired data support a declared sensor-calibration claim.")
    commands = parser.add_subparsers(dest="command", required=True)

    def command(name: str, says: str, run, *needs: str, **fixed) -> None:
        p = commands.add_parser(name, help=says)
        for n in needs:
            p.add_argument(f"--{n}", required=n != "output")
        p.set_defaults(run=run, **fixed)

    for c in (*CRITERIA, "all"):
        data = () if c == "D0" else ("dataset",)
        command(f"evaluate-{c.lower()}", "Evaluate all criteria and roll them up." if c == "all" else f"Evaluate {c}.", _evaluate, "task", *data, "output", criterion=c)
    command("audit-declarations", "Compare a register of open declarations with D0.", _audit, "task", "register", "output")
    command("write-schemas", "Write the documents' JSON Schemas.", _schemas)
    commands.choices["write-schemas"].add_argument("--output-dir", required=True, type=Path)
    return parser


def main(argv: list[str] | None = None) -> None:
    args = build_parser().parse_args(argv)
    try:
        code = args.run(args)
    except ConfigurationError as e:
        print(f"configuration error: {e}", file=sys.stderr)
        code = 3
    raise SystemExit(code)


if __name__ == "__main__":
    main()
