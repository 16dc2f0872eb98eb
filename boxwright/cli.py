"""Command line: conversions between label formats, class names, class subsets and crops around labels."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from .sources.crops import cut_images
from .sources.formats import READERS, convert, exclude_classes, gen_names, read_files, read_names

FORMATS = ("labelme", "yolo", "voc", "coco")


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="boxwright")
    commands = parser.add_subparsers(dest="command", required=True)
    for source in FORMATS:
        for target in FORMATS:
            if source != target:
                one = commands.add_parser(f"{source}2{target}")
                one.set_defaults(source=source, target=target)
                one.add_argument("labels", help="path or pattern of the label files")
                one.add_argument("out")
                one.add_argument("--names", help="class names, one a line or YAML")
                one.add_argument("--sizes", help="Parquet table of image_id, width, height (from yolo)")
                one.add_argument("--images", help="path or pattern of the image files, whose headers have the sizes (from yolo)")
                one.add_argument("--splits", action="store_true", help="keep sub-folders of labels and images apart")
                one.add_argument("--start", type=int, default=0, help="first id (to coco)")
    names = commands.add_parser("genNames")
    names.add_argument("labels")
    names.add_argument("suffix", choices=sorted(READERS))
    names.add_argument("--out", help="URI of the folder for classes.txt and classes.json")
    less = commands.add_parser("yoloLabelExclude")
    less.add_argument("root", help="URI of the folder of <subset>/labels and <subset>/images")
    less.add_argument("keep", help="class ids that stay, separated by commas")
    less.add_argument("--names", required=True)
    less.add_argument("--title", default="subset")
    less.add_argument("--out")
    cut = commands.add_parser("cutImg")
    cut.add_argument("root", help="URI of the folder of images and labels")
    cut.add_argument("out")
    cut.add_argument("--pattern", choices=("voc", "yolo"), default="voc")
    cut.add_argument("--size", type=int, default=640)
    cut.add_argument("--mask", action="store_true", help="black out labels that a crop cuts")
    cut.add_argument("--images", default="images")
    cut.add_argument("--labels", default="labels")
    cut.add_argument("--names", help="class names, one a line or YAML")
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName("boxwright").getOrCreate()
    if args.command == "genNames":
        for name, n in gen_names(READERS[args.suffix](read_files(spark, args.labels)), args.out).items():
            print(name, n)
        return
    if args.command == "cutImg":
        cut_images(spark, args.root, args.out, args.pattern, args.size, mask=args.mask, images=args.images, labels=args.labels, names=read_names(args.names) if args.names else None)
        return
    if args.command == "yoloLabelExclude":
        exclude_classes(spark, args.root, [int(k) for k in args.keep.split(",")], read_names(args.names), args.title, args.out)
        return
    sizes = spark.read.parquet(args.sizes) if args.sizes else None
    convert(spark, args.source, args.target, args.labels, args.out, read_names(args.names) if args.names else None, sizes, args.start, args.images, args.splits)


if __name__ == "__main__":
    main()
