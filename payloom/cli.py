"""Command line: resolve, validate, compose, lint. Ends with 0 (ok), 1 (invalid), 2 (schema) or 3 (files, network)."""

from __future__ import annotations

import argparse
import json
import logging
import os
import sys
from pathlib import Path
from typing import Any

from .functions.names import is_url
from .model import BAD_IO, BAD_SCHEMA, DEFAULT, INVALID, OK, ComposeError, Invalid, PayloomError, ResolveError, ResolveOptions, SchemaBase, Vocabulary
from .operators.lint import from_corpus
from .operators.validate import plan, validate_payload, validate_self_described
from .plans.compose import compose_payload, detect_direction
from .plans.resolve import resolve
from .sources.documents import Documents

log = logging.getLogger("payloom")


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="payloom", description="Compose, resolve, validate and lint annotated JSON Schemas.")
    top.add_argument("--vocabulary", default=os.environ.get("PAYLOOM_VOCABULARY"), help="JSON file with the documents' own keys: request, response, envelope, transition")
    commands = top.add_subparsers(dest="command", required=True)

    def command(name: str, *shared: Any, **more: Any) -> argparse.ArgumentParser:
        p = commands.add_parser(name, **more)
        for add in shared:
            add(p)
        return p

    def direction(p):
        one = p.add_mutually_exclusive_group()
        one.add_argument("--request", dest="direction", action="store_const", const="request")
        one.add_argument("--response", dest="direction", action="store_const", const="response")
        p.add_argument("--op", "-o", required=True)
        p.add_argument("--def", dest="def_name")
        p.add_argument("--strict", nargs="?", const="true", default="false", choices=("true", "false"))

    def bases(p):
        p.add_argument("--schema-local-base")
        p.add_argument("--schema-remote-base")
        p.add_argument("--verbose", "-v", action="store_true")

    def output(p):
        p.add_argument("--output")
        p.add_argument("--pretty", action="store_true")

    p = command("resolve", direction, bases, output, help="plain JSON Schema for one direction and operation")
    p.add_argument("source")
    p.add_argument("--bundle", action="store_true")
    p.add_argument("--include-future", action="store_true")
    p = command("validate", direction, bases, help="hold a payload against its schema")
    p.add_argument("source")
    which = p.add_mutually_exclusive_group()
    which.add_argument("--schema")
    which.add_argument("--profile")
    p.add_argument("--json", action="store_true")
    p = command("compose", bases, output, help="one annotated schema from a payload's capabilities")
    p.add_argument("source")
    p = command("lint", help="check schema files")
    p.add_argument("source")
    p.add_argument("--format", default="text")
    p.add_argument("--strict", action="store_true")
    p.add_argument("--quiet", "-q", action="store_true")
    return top


def main(argv: list[str] | None = None) -> int:
    top = parser()
    args = top.parse_args(argv)
    if getattr(args, "schema_remote_base", None) and not args.schema_local_base:
        top.error("--schema-remote-base needs --schema-local-base")
    logging.basicConfig(level=logging.INFO if getattr(args, "verbose", False) else logging.WARNING, format="%(message)s", stream=sys.stderr)
    try:
        return {"resolve": run_resolve, "validate": run_validate, "compose": run_compose, "lint": run_lint}[args.command](args)
    except PayloomError as e:
        return failed(e, getattr(args, "json", False))


def failed(e: PayloomError, as_json: bool) -> int:
    if as_json:
        print(json.dumps({"valid": False, "errors": [{"path": "", "message": e.message}]}, separators=(",", ":")))
    else:
        print(f"Error: {e.message}", file=sys.stderr)
    return e.exit_code


def documents(args: argparse.Namespace) -> Documents:
    return Documents(SchemaBase(args.schema_local_base, args.schema_remote_base), vocabulary=vocabulary(args))


def vocabulary(args: argparse.Namespace) -> Vocabulary:
    return Vocabulary.load(args.vocabulary) if args.vocabulary else DEFAULT


def written(value: Any, args: argparse.Namespace) -> int:
    text = json.dumps(value, ensure_ascii=False, indent=2) if args.pretty else json.dumps(value, ensure_ascii=False, separators=(",", ":"))
    if not args.output:
        print(text)
        return OK
    try:
        Path(args.output).write_text(text, "utf-8")
    except OSError as e:
        print(f"Error: cannot write {args.output}: {e}", file=sys.stderr)
        return BAD_IO
    return OK


def run_resolve(args: argparse.Namespace) -> int:
    docs = documents(args)
    source = docs.any(args.source)
    described = detect_direction(source, docs.vocabulary)
    log.info("read %s (%s)", args.source, f"{described} payload" if described else "schema")
    if described and args.bundle:
        raise ResolveError("InvalidSchema", "--bundle is for schemas: those of a payload are bundled as they are composed")
    if described:
        source = compose_payload(source, docs)
    elif args.bundle:
        source = docs.bundle_remote(source, args.source) if is_url(args.source) else docs.bundle(source, Path(args.source).parent)
    direction = args.direction or described
    if direction is None:
        raise ResolveError("InvalidSchema", "a schema does not tell its direction: give --request or --response")
    options = ResolveOptions(direction, args.op, args.strict == "true", args.include_future, args.def_name, docs.vocabulary)
    log.info("resolving for %s %s", options.direction, options.operation)
    return written(plan(source, options) if args.def_name else resolve(source, options), args)


def run_compose(args: argparse.Namespace) -> int:
    docs = documents(args)
    payload = docs.file(args.source)
    if detect_direction(payload, docs.vocabulary) is None:
        raise ComposeError("NotSelfDescribing", "nothing in the payload says which schema it follows")
    return written(compose_payload(payload, docs), args)


def run_validate(args: argparse.Namespace) -> int:
    docs, strict = documents(args), args.strict == "true"
    payload = docs.file(args.source)
    try:
        if args.schema:
            schema = docs.any(args.schema)
            schema = docs.bundle_remote(schema, args.schema) if is_url(args.schema) else docs.bundle(schema, Path(args.schema).parent)
            direction = args.direction or detect_direction(payload, docs.vocabulary) or "request"
            validate_payload(payload, schema, ResolveOptions(direction, args.op, strict, False, args.def_name, docs.vocabulary))
        else:
            validate_self_described(payload, docs, args.op, args.direction, strict, args.def_name, args.profile)
    except Invalid as e:
        if args.json:
            print(json.dumps({"valid": False, "errors": [{"path": v.path, "message": v.message} for v in e.violations]}, ensure_ascii=False, separators=(",", ":")))
        else:
            print("Validation failed:", file=sys.stderr)
            for v in e.violations:
                print(f"  {v.path}: {v.message}", file=sys.stderr)
        return INVALID
    print('{"valid":true}' if args.json else "Valid")
    return OK


def run_lint(args: argparse.Namespace) -> int:
    path = Path(args.source)
    if not path.exists():
        print(f"Error: path not found: {path}", file=sys.stderr)
        return BAD_SCHEMA
    report = from_corpus(path, args.strict, vocabulary(args))
    if args.format == "json":
        print(json.dumps(report, indent=2))
    else:
        for one in report["results"]:
            if one["status"] != "ok" or not args.quiet:
                print(f"{one['status'].upper()} {one['file']}")
            for d in one["diagnostics"]:
                if d["severity"] == "error" or not args.quiet:
                    print(f"  {d['severity']}[{d['code']}] {d['path']}: {d['message']}")
        print(f"{report['files_checked']} files checked: {report['passed']} passed, {report['failed']} failed ({report['errors']} errors, {report['warnings']} warnings)")
    return INVALID if report["failed"] else OK


if __name__ == "__main__":
    sys.exit(main())
