"""Command line: python -m corpusloom.cli {fetch,mix,tokenize,pack} ..."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession

from corpusloom.config import RunConfig
from corpusloom.operators.stats import packing_summary
from corpusloom.plans import flows
from corpusloom.sources import files_by_folder, read_text, write_config, write_one_file


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="corpusloom")
    sub = p.add_subparsers(dest="command", required=True)
    mix = sub.add_parser("mix", help="exact per-source samples of root/<source>/*")
    mix.add_argument("--weights", required=True, help='JSON, as {"web": 1000, "books": null}')
    mix.add_argument("--root", default="data")
    mix.add_argument("--output-path", default="data/mixed_dataset")
    mix.add_argument("--exclude", action="append", default=[])
    tok = sub.add_parser("tokenize", help="end tokens, ids, report and split")
    tok.add_argument("--tokenizer", help="a tokenizers JSON file; without it, the native tokenizer")
    tok.add_argument("--eos", help="the end token; without it, the tokenizer's own")
    tok.add_argument("--data-path", required=True)
    tok.add_argument("--test-size", type=float, default=0.1)
    tok.add_argument("--output-path", default="tokenized_data")
    pack = sub.add_parser("pack", help="blocks of equal length")
    pack.add_argument("--max-seq-length", type=int, default=2048)
    pack.add_argument("--input-dir", default="tokenized_data")
    pack.add_argument("--output-dir")
    pack.add_argument("--eos-token-id", type=int, default=0)
    fetch = sub.add_parser("fetch", help="each folder of root: its Parquet files, at any depth, as one file")
    fetch.add_argument("--root", required=True)
    fetch.add_argument("--output-path", default="data")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("corpusloom").getOrCreate()
    if a.command == "mix":
        config = RunConfig.from_dict({"mixture": {"weights": json.loads(a.weights), "exclude": a.exclude}})
        flows.build_mixture(spark, config, a.root, a.output_path)
    elif a.command == "tokenize":
        config = RunConfig.from_dict({"tokenize": {"tokenizer": a.tokenizer, "eos": a.eos, "test_size": a.test_size}})
        flows.tokenize_and_split(spark, config, a.data_path, a.output_path)
    elif a.command == "fetch":
        for name, paths in files_by_folder(spark, a.root).items():
            print(f"Reading {len(paths)} files for {name}")
            write_one_file(spark, paths, f"{a.output_path}/{name}/train_data.parquet")
    else:
        config = RunConfig.from_dict({"pack": {"max_seq_length": a.max_seq_length, "eos_token_id": a.eos_token_id}})
        out = a.output_dir or f"{a.input_dir}/packed_train_data_{a.max_seq_length}"
        flows.pack_split(spark, config, a.input_dir, out)
        print(packing_summary(json.loads(read_text(spark, f"{out}/packing_stats.json"))["statistics"]["train"]))
    if a.command in ("mix", "tokenize", "pack"):
        write_config(spark, config.get_dict(), f"{a.output_path if a.command != 'pack' else out}/_run")  # readers of tables leave it out


if __name__ == "__main__":
    main()
