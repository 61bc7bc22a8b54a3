"""Command line: prepare (realign groups from reads, pairs and targets), realign
(which reads stay) and run (both, and the merge of two call sets).

Tables are Parquet paths in the columns that the operators name; outputs are
Parquet folders below --out.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import phasing, reads
from .plans import flows


def _save(made: dict[str, DataFrame], out: str) -> None:
    for name, df in made.items():
        df.write.mode("overwrite").parquet(f"{out}/{name}")


def _described(df: DataFrame, least_mapq: int) -> DataFrame:
    """Reads (id, cigar, seq, quals) of clean pairs, described."""
    quals, clipped = (F.col("quals") if "quals" in df.columns else None), None
    known = df.withColumn("noisy", reads.noisy(F.col("flag"), F.col("mapq"), F.col("end") - F.col("start"), F.lit(False), quals, clipped, least_mapq))
    clean = known.join(reads.clean_pairs(known).select("qname").distinct(), "qname", "left_semi")
    return phasing.described(clean.drop("noisy"))


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="lociframe", description=__doc__)
    parser.add_argument("command", choices=["prepare", "realign", "run"])
    for name in ("reads", "pairs", "targets", "called", "recalled", "out"):
        parser.add_argument(f"--{name}", required=name in ("reads", "out"))
    parser.add_argument("--least-size", type=int, default=300, help="pairs of more bases count")
    parser.add_argument("--least-window", type=int, default=147, help="windows of more bases are carried on")
    parser.add_argument("--scale", type=float, default=1.0, help="of a pair's rate to the weight of its edge")
    parser.add_argument("--read-length", type=float, default=150.0)
    parser.add_argument("--least-mapq", type=int, default=10)
    args = parser.parse_args(argv)
    needs = {"prepare": ("pairs", "targets"), "realign": (), "run": ("pairs", "targets", "called", "recalled")}[args.command]
    for name in needs:
        if getattr(args, name) is None:
            parser.error(f"{args.command} needs --{name}")
    spark = SparkSession.builder.appName("lociframe").getOrCreate()
    table = {name: spark.read.parquet(getattr(args, name)) for name in ("reads", *needs)}
    describe = lambda df: _described(df, args.least_mapq)
    sizes = {"least_size": args.least_size, "least_window": args.least_window, "scale": args.scale}
    if args.command == "prepare":
        _save(flows.prepare(table["reads"], table["pairs"], table["targets"], **sizes), args.out)
    elif args.command == "realign":
        _save({"reads": flows.eliminate(describe(table["reads"]), table["reads"], args.read_length)}, args.out)
    else:
        _save(flows.recall(table["reads"], table["pairs"], table["targets"], describe, table["called"], table["recalled"], args.read_length, **sizes), args.out)


if __name__ == "__main__":
    main()
