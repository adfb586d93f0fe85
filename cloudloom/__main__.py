"""Command line: ``python -m cloudloom CLOUD OUT`` labels a cloud and writes files by group, the report and the classified cloud."""

from __future__ import annotations

import argparse
from dataclasses import replace


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="cloudloom", description="Label a point cloud of a building or plant.")
    p.add_argument("cloud", nargs="?", help="file or glob of scans")
    p.add_argument("out", nargs="?", help="folder for the results")
    p.add_argument("--check", action="store_true", help="list what is installed, and end")
    p.add_argument("--bbox", type=box_of, metavar="X0,Y0,Z0,X1,Y1,Z1", help="only this box of the cloud")
    p.add_argument("--margin", type=float, default=0.0, metavar="M", help="with --bbox: look so far around the box, but write the box alone")
    p.add_argument("--config", help="YAML or JSON file of thresholds by section")
    p.add_argument("--voxel", type=float, help="voxel size in metres")
    p.add_argument("--exclude", action="append", default=[], metavar="CLASS", help="a class that cannot occur; may be repeated")
    p.add_argument("--preset", help="an environment's excluded classes")
    p.add_argument("--models", help="models' document, applied to instances")
    p.add_argument("--save-model", action="append", default=[], metavar="ID:NAME[:CLASS]", help="add an instance to the models' document; may be repeated")
    p.add_argument("--confirmations", help="document of decisions")
    p.add_argument("--format", choices=("ply", "las"), default="ply", help="of the classified cloud")
    p.add_argument("--groups", action="store_true", help="a folder of files for each macro group too, below the classified cloud")
    return p


# What each module is for; the first ones are needed.
NEEDED = (("pyspark", "everything"), ("numpy", "fits and formats"), ("pandas", "grouped fits"), ("pyarrow", "batches and files"))
OPTIONAL = (("yaml", "thresholds in YAML"), ("torch", "a point network over blocks"))


def box_of(text: str) -> tuple[float, ...]:
    try:
        box = tuple(float(v) for v in text.split(","))
    except ValueError:
        box = ()
    if len(box) != 6:
        raise argparse.ArgumentTypeError("six numbers are needed: x0,y0,z0,x1,y1,z1")
    return box


def environment() -> list[tuple[str, str | None, str, bool]]:
    """(module, version or None, what for, whether needed) of what the package uses."""
    from importlib import metadata, util

    out = []
    for needed, listed in ((True, NEEDED), (False, OPTIONAL)):
        for name, use in listed:
            version = None
            if util.find_spec(name) is not None:
                try:
                    version = metadata.version({"yaml": "pyyaml"}.get(name, name))
                except metadata.PackageNotFoundError:
                    version = "?"
            out.append((name, version, use, needed))
    return out


def main(argv: list[str] | None = None) -> None:
    p = parser()
    args = p.parse_args(argv)
    if args.check:
        listed = environment()
        for name, version, use, needed in listed:
            print(f"{name}: {version or 'missing'} ({use}{'' if needed else ', optional'})")
        raise SystemExit(any(needed and version is None for _, version, _, needed in listed))
    if args.cloud is None or args.out is None:
        p.error("a cloud and a folder are needed (or --check)")
    if args.margin < 0 or (args.margin and args.bbox is None):
        p.error("--margin needs --bbox and cannot be negative")
    if args.save_model and not args.models:
        p.error("--save-model needs --models")
    from pyspark.sql import SparkSession

    from .operators import review, spatial
    from .plans.model import Config, excluded_codes, load_config
    from .plans.pipeline import segment
    from .sources import documents, readers, writers

    try:
        for text in args.save_model:
            documents.model_request(text)
        config = load_config(args.config) if args.config else Config()
        names = [*config.excluded, *args.exclude, *(documents.preset_classes(args.preset) if args.preset else ())]
        excluded_codes(names)
    except ValueError as e:
        p.error(str(e))
    config = replace(config, excluded=frozenset(names))
    if args.voxel:
        config = config.with_values("preprocess", voxel=args.voxel)
    spark = SparkSession.builder.appName("cloudloom").getOrCreate()
    models = documents.read_models(spark, args.models) if args.models else None
    yes, no = readers.read_confirmations(spark, args.confirmations) if args.confirmations else (None, None)
    points = readers.read_points(spark, args.cloud)
    if args.bbox:
        points = spatial.crop(points, args.bbox, args.margin)
    result = segment(points, config, None if models is None or models.isEmpty() else models, yes, no)
    labelled = spatial.crop(result.points, args.bbox) if args.margin else result.points
    if args.groups:
        writers.write_grouped(labelled, f"{args.out}/classified", args.format, whole=True)
    else:
        writers.write_classified(labelled, f"{args.out}/classified", args.format)
    writers.write_report(result.reduced, result.instances, args.out, result.planes, result.ceiling, result.floor)
    if args.save_model:
        documents.save_models(spark, documents.extract_models(review.signature(result.instances), args.save_model, args.cloud), args.models)


if __name__ == "__main__":
    main()
