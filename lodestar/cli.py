"""``python -m lodestar index | verify | search``; flags without a command mean a direct search.

Encoders are named as module:function, a function of (model_id, device) that makes one.
"""

from __future__ import annotations

import argparse
import importlib.util
import os
from functools import partial
from pathlib import Path

from lodestar.functions.paths import is_within
from lodestar.functions.queries import Unchanged
from lodestar.plans import index, search
from lodestar.schemas import MODELS
from lodestar.sources import settings

#: Where libraries keep models, as the environment says (fixed values).
CACHES = ("HF_HOME", "HF_HUB_CACHE", "TRANSFORMERS_CACHE", "TORCH_HOME", "XDG_CACHE_HOME")


def parser() -> argparse.ArgumentParser:
    # Names and defaults of flags are an interface (fixed values).
    top = argparse.ArgumentParser(prog="lodestar", description="Exact multi-model search over a corpus of images.")
    commands = top.add_subparsers(dest="command", required=True)
    build = commands.add_parser("index", help="build or resume a persistent index")
    build.add_argument("--directory", required=True)
    build.add_argument("--index", required=True)
    build.add_argument("--resume", action="store_true")
    build.add_argument("--batch-size", type=int, default=search.BATCH)
    build.add_argument("--checkpoint-rows", type=int, default=index.CHECKPOINT_ROWS)
    build.add_argument("--max-images", type=int)
    build.add_argument("--stretches", type=int, help="checkpoints that one job encodes, each in a task (default: as many as there are cores)")
    verify = commands.add_parser("verify", help="check an index")
    verify.add_argument("--index", required=True)
    verify.add_argument("--full", action="store_true")
    find = commands.add_parser("search", help="search an index, or with --direct a folder")
    find.add_argument("--direct", action="store_true")
    find.add_argument("--index")
    find.add_argument("--directory")
    find.add_argument("--query", action="append", required=True)
    find.add_argument("--top-k", type=int)
    find.add_argument("--batch-size", type=int, default=search.BATCH)
    find.add_argument("--output", default="/output/report.csv")
    find.add_argument("--final-output")
    find.add_argument("--evaluator-top-k", type=int)
    find.add_argument("--evaluator-rrf-constant", type=int)
    find.add_argument("--display-root")
    find.add_argument("--rrf-constant", type=int)
    find.add_argument("--max-images", type=int)
    find.add_argument("--all-results", action="store_true")
    find.add_argument("--clip-model", "--model", dest="clip_model")
    find.add_argument("--siglip-model", dest="siglip2_model")
    find.add_argument("--chunk-rows", type=int, help="rows of an index that a task scores together")
    find.add_argument("--parts", action="store_true", help="with --all-results: a folder of files, written side by side")
    find.add_argument("--min-percent", type=float, help=argparse.SUPPRESS)
    find.add_argument("--reference-cos", type=float, help=argparse.SUPPRESS)
    for p in (build, find):
        p.add_argument("--encoder", required=True, metavar="MODULE:FUNCTION")
        p.add_argument("--device", choices=("cuda", "cpu"), default="cuda")
    return top


def faults(args: argparse.Namespace) -> list[str]:
    """What is wrong with the arguments, in words; nothing is changed by asking."""
    out = []
    least = {"batch_size": 1, "checkpoint_rows": 1, "chunk_rows": 1, "stretches": 1, "max_images": 1, "top_k": 1, "evaluator_top_k": 1, "rrf_constant": 0, "evaluator_rrf_constant": 0}
    for name, low in least.items():
        value = getattr(args, name, None)
        if value is not None and value < low:
            out.append(f"--{name.replace('_', '-')} is {value}, but takes {low} or more")
    if args.command == "search":
        out += _search_faults(args)
    folder = getattr(args, "directory", None)
    if folder is not None:
        if not Path(folder).is_dir():
            out.append(f"no such folder: {folder}")
        else:
            for name in ("index", "output", "final_output"):
                if getattr(args, name, None) and is_within(getattr(args, name), folder):
                    out.append(f"--{name.replace('_', '-')} names a place in the evidence, where nothing may be written")
            out += [f"{name} puts a model cache into the evidence" for name in CACHES if os.environ.get(name) and is_within(os.environ[name], folder)]
    return out


def _search_faults(args: argparse.Namespace) -> list[str]:
    out = []
    if args.min_percent is not None or args.reference_cos is not None:
        out.append("there is no --min-percent or --reference-cos any more: a score is no share of anything, so choose how many to keep by --top-k")
    if args.all_results:
        names = ("top_k", "clip_model", "rrf_constant", "max_images", "final_output", "evaluator_top_k", "evaluator_rrf_constant")
        if clash := ["--" + n.replace("_", "-") for n in names if getattr(args, n) is not None]:
            out.append("a full ranking (--all-results) has no use for " + ", ".join(clash))
    elif args.parts:
        out.append("--parts is for --all-results")
    if (args.final_output is None) != (args.evaluator_top_k is None):
        out.append("one of --final-output and --evaluator-top-k needs the other")
    direct = args.direct or args.all_results
    if not direct:
        names = {"max_images": "--max-images", "clip_model": "--clip-model", "siglip2_model": "--siglip-model"}
        if fixed := [flag for n, flag in names.items() if getattr(args, n) is not None]:
            out.append("the index has settled " + ", ".join(fixed))
    elif args.chunk_rows is not None:
        out.append("--chunk-rows is for the search of an index")
    if args.evaluator_rrf_constant is not None and args.final_output is None and direct:
        out.append("--evaluator-rrf-constant without --final-output changes nothing")
    if args.final_output is not None and Path(args.final_output).resolve() == Path(args.output).resolve():
        out.append("--final-output and --output name the same file")
    if direct and not args.directory or not direct and not args.index:
        out.append("--directory is needed" if direct else "--index is needed")
    return out


def duration(seconds: float) -> str:
    whole = max(0, round(seconds))
    return f"{whole // 3600:02d}:{whole // 60 % 60:02d}:{whole % 60:02d}"


def require_device(device: str, module=None) -> None:
    """Fail where cuda is asked for and isn't there: nothing falls back to a processor unasked.

    The encoder's module may have its own available(device); if not, and if it uses
    torch, torch says what there is.
    """
    own = getattr(module, "available", None)
    if callable(own):
        ok = own(device)
    elif device == "cuda" and importlib.util.find_spec("torch"):
        ok = importlib.import_module("torch").cuda.is_available()
    else:
        ok = True
    if not ok:
        raise SystemExit(f"no {device} device here; name another by --device")


def factories(name: str, device: str, names: dict[str, str | None] | None = None) -> dict:
    """A maker of each model's encoder, from module:function, which is given a model's name and revision where these are set.

    A revision is set by the environment or a .env file here (settings.REVISIONS), or pinned by the module's REVISIONS.
    """
    module, _, function = name.partition(":")
    found = importlib.import_module(module)
    require_device(device, found)
    pinned, out = getattr(found, "REVISIONS", {}), {}
    for m in MODELS:
        more = {"name": (names or {}).get(m), "revision": settings.revision(m, pinned.get(m))}
        out[m] = partial(getattr(found, function), m, device, **{k: v for k, v in more.items() if v})
    return out


def banner(args: argparse.Namespace) -> str:
    """What a command is about to do, a setting a line, before anything starts."""
    shown = {k.replace("_", " "): v for k, v in vars(args).items() if k not in ("command", "min_percent", "reference_cos") and v not in (None, False)}
    lines = [f"  {k}: {', '.join(v) if isinstance(v, list) else v}" for k, v in shown.items()]
    return "\n".join([f"lodestar {args.command}", *lines])


def main(argv: list[str] | None = None, spark=None) -> int:
    import sys

    from lodestar.session import build

    argv = sys.argv[1:] if argv is None else argv
    if argv and argv[0].startswith("--") and argv[0] != "--help":
        argv = ["search", "--direct", *argv]
    top = parser()
    args = top.parse_args(argv)
    if found := faults(args):
        top.error("; ".join(found))
    print(banner(args), file=sys.stderr)
    spark = spark or build()
    if args.command == "verify":
        done = index.verify(spark, args.index, full=args.full)
        print(f"verified ({'full' if args.full else 'structural'}): {done.path} [{done.state}]")
        return 0
    hear = lambda phase, done, total: print(f"{phase}: {done} of {total}", file=sys.stderr)
    made = factories(args.encoder, args.device, {m: getattr(args, f"{m}_model", None) for m in MODELS})
    if args.command == "index":
        done = index.build(spark, args.directory, args.index, made, args.checkpoint_rows, args.batch_size, args.max_images, args.resume, progress=hear, stretches=args.stretches)
        took = ", ".join(f"{m} {duration(s)} ({done.rates()[m]:.1f} images a second)" for m, s in done.seconds.items())
        print(f"complete: {done.path}, {done.image_count} images, {done.models}, {index.size_bytes(args.index)} bytes; {took}")
        return 0
    queries = Unchanged().process(args.query)
    if args.all_results:
        count, _ = search.all_results(spark, args.directory, args.output, queries, made[next(iter(MODELS))], args.batch_size, args.display_root, parts=args.parts, progress=hear)
        print(f"{count} rows in {args.output}")
        return 0
    wanted = search.Settings(args.top_k or search.TOP_K, search.RRF if args.rrf_constant is None else args.rrf_constant, args.evaluator_top_k, args.evaluator_rrf_constant, args.display_root)
    if args.direct:
        done = search.direct(spark, args.directory, args.output, queries, made, wanted, args.final_output, args.max_images, args.batch_size, progress=hear)
    else:
        key = "spark.sql.execution.arrow.maxRecordsPerBatch"
        before = spark.conf.get(key)
        if args.chunk_rows:
            spark.conf.set(key, str(args.chunk_rows))
        try:
            done = search.indexed(spark, args.index, args.output, queries, made, wanted, args.final_output, progress=hear)
        finally:
            spark.conf.set(key, before)
    print(search.summary(done), f"in {duration(done.seconds['total'])}")
    return 0
