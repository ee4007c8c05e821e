"""Commands: python -m textquarry find|inspect|outline|changed ... ; see --help."""

from __future__ import annotations

import argparse
import os
import sys
from collections.abc import Sequence

from pyspark.sql import SparkSession

from .functions import render
from .plans import verbs
from .plans.options import DEFAULT_CODE_LINES, DEFAULT_CONTEXT, DEFAULT_PATCH_LINES, Options, capped, command_options, environment_caps
from .sources.corpus import Corpus


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="textquarry")
    sub = top.add_subparsers(dest="verb", required=True)
    for verb, what in (("find", "query"), ("inspect", "location"), ("outline", "path"), ("changed", "")):
        p = sub.add_parser(verb)
        if what:
            p.add_argument("items", nargs="+", metavar=what.upper())
        p.add_argument("--root", default=".")
        p.add_argument("--return", dest="returns", default="")
        p.add_argument("--context", type=int)
        p.add_argument("--limit", type=int, default=50)
        p.add_argument("--path", dest="path_globs", action="append", default=[])
        p.add_argument("--exclude", dest="exclude_globs", action="append", default=[])
        p.add_argument("--max-code-lines", type=int, default=0)
        p.add_argument("--drop-comments", action="store_true")
        p.add_argument("--drop-docstrings", action="store_true")
        p.add_argument("--include-comments", action="store_true")
        p.add_argument("--include-strings", action="store_true")
        p.add_argument("--json", action="store_true")
        p.add_argument("--pretty", action="store_true")
        if verb in ("find", "inspect"):
            p.add_argument("--include", default="both" if verb == "find" else "scope")
            p.add_argument("--changed-only", action="store_true")
        if verb == "find":
            p.add_argument("--match", default="auto")
        if verb in ("find", "inspect", "changed"):
            p.add_argument("--base", default="")
        if verb == "changed":
            p.add_argument("--max-patch-lines", type=int, default=0)
    return top


def options_of(a: argparse.Namespace) -> Options:
    names = ("returns", "context", "max_code_lines", "drop_comments", "drop_docstrings", "match", "include", "changed_only", "max_patch_lines")
    given = {n: getattr(a, n) for n in names if hasattr(a, n)}
    asked = {"context": DEFAULT_CONTEXT if a.context is None else a.context, "limit": a.limit, "max_code_lines": a.max_code_lines or DEFAULT_CODE_LINES}
    if hasattr(a, "max_patch_lines"):
        asked["max_patch_lines"] = a.max_patch_lines or DEFAULT_PATCH_LINES
    capped(asked, {n: cap for n, cap in environment_caps(os.environ).items() if n in asked})
    return command_options(a.include_comments, a.include_strings, a.limit, verb=a.verb, path_globs=tuple(a.path_globs), exclude_globs=tuple(a.exclude_globs), **given)


def answered(spark: SparkSession, a: argparse.Namespace, options: Options) -> list[dict[str, object]]:
    from .sources.manifests import Changes

    needs_git = a.verb == "changed" or getattr(a, "changed_only", False)
    changes = Changes(spark, a.root, a.base) if needs_git else None
    if a.verb == "changed" and changes is not None:
        corpus = changes.corpus()
        rows = verbs.changed(corpus, changes.files(), changes.lines(corpus), options)
        response = verbs.respond(rows, [""], options, "changed", a.root)[0]
        most = options.normalised("context").max_patch_lines
        patch = changes.patch().rstrip("\n").split("\n")
        response |= {"base": a.base, "base_commit": changes.base, "head_commit": changes.head, "head_subject": changes.subject, "patch": "\n".join(patch[:most]), "patch_truncated": len(patch) > most}
        return [response]
    corpus = Corpus.from_directory(spark, a.root)
    changed = changes.files() if changes is not None else None
    if a.verb == "find":
        if options.limit and options.limit < len(a.items):
            raise ValueError("the limit must be at least the number of queries")
        return verbs.respond(verbs.find_many(corpus, a.items, options, changed), a.items, options, "find", a.root)
    out, left = [], options.limit
    for k, item in enumerate(a.items):  # wrong items are rows with an error, if any other is right
        share = -(-left // (len(a.items) - k)) if options.limit else 0
        from dataclasses import replace

        one = replace(options, limit=share)
        try:
            rows = verbs.inspect(corpus, [item], one, changed) if a.verb == "inspect" else verbs.outline(corpus, [item], one)
            response = verbs.respond(rows, [item], one, a.verb, a.root)[0]
            if a.verb == "outline" and corpus.files.where(corpus.files.path == item.removeprefix("./")).limit(1).count() == 0:
                raise ValueError(f"{item!r} is not in the corpus")
        except ValueError as e:
            response = {"location" if a.verb == "inspect" else "path": item, "root": a.root, "results": [], "error": str(e)}
        left -= len(response["results"])
        out.append(response)
    if all(r.get("error") for r in out):
        raise ValueError(str(out[0]["error"]))
    return out


def main(arguments: Sequence[str] | None = None) -> int:
    a = parser().parse_args(arguments)
    try:
        options = options_of(a)
        spark = SparkSession.builder.config("spark.ui.showConsoleProgress", "false").getOrCreate()
        spark.sparkContext.setLogLevel("ERROR")
        responses = answered(spark, a, options)
    except ValueError as e:
        print(render.safe(str(e)), file=sys.stderr)
        return 1
    if a.json or a.pretty:
        sys.stdout.write(render.json_text(responses, a.verb, a.pretty))
        return 0
    returns = options.normalised({"outline": "line", "changed": "context"}.get(a.verb, "scope")).returns
    for r in responses:
        if a.verb == "find":
            sys.stdout.write(render.find_text(r, returns))
        elif a.verb == "changed":
            sys.stdout.write(render.changed_text(r, returns))
        else:
            sys.stdout.write(f"# error: {render.safe(str(r['error']))}\n" if r.get("error") else render.results_text(r["results"], returns))
    return 0


if __name__ == "__main__":
    sys.exit(main())
