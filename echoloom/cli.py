"""Command line: write prompts for a model, mine pairs from its stored completions, prepare training data from pairs.

Models run elsewhere. Without ``--completions`` the mining phase writes the prompts of the configured source, formatted,
to <run-dir>/prompts; with them it writes generations and pairs. Training data go to <run-dir>/features, and what was
counted on the way to <run-dir>/reports.
"""

from __future__ import annotations

import argparse
import dataclasses
import json
import logging
from pathlib import Path

log = logging.getLogger("echoloom")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="echoloom", description=__doc__)
    p.add_argument("-c", "--config", help="YAML file of settings")
    p.add_argument("-r", "--run-dir", default="runs")
    p.add_argument("--completions", help="Parquet or JSON lines with source, prompt and response")
    p.add_argument("--tokenizer", help="file for the tokenizers library")
    p.add_argument("--model-name")
    p.add_argument("--user", default="local", help="name in the merged model's name")
    p.add_argument("--job", default="local", help="job in the merged model's name")
    p.add_argument("--temp", type=float)
    p.add_argument("--generate-only", action="store_true")
    p.add_argument("--train-only", action="store_true")
    p.add_argument("--pairs-file")
    p.add_argument("--max-pairs", type=int)
    p.add_argument("-v", "--verbose", action="store_true")
    return p


def _file_encoder(path: str):
    def make():
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        return lambda text: t.encode(text, add_special_tokens=False).ids

    return make


def settings(args: argparse.Namespace):
    """The configuration with what the command line overrides."""
    from .config import EngineConfig, load_config

    cfg = load_config(args.config) if args.config else EngineConfig()
    if args.temp is not None:
        cfg.generation.temperature = args.temp
    if args.max_pairs is not None:
        cfg.generation.target_pairs = args.max_pairs
    cfg.train.model_name = args.model_name or cfg.model_name or cfg.generation.outside.get("model_name") or cfg.train.model_name
    return cfg


def mining_phase(spark, args, cfg) -> int:
    from .plans.mine import run_mining, write_prompts
    from .sources.readers import parse_completions

    if not args.completions:
        if not (cfg.input_jsonl or cfg.dataset_path):
            log.error("mining needs --completions, and prompts need input_jsonl or dataset_path in the configuration")
            return 1
        log.info("prompts: %d at %s/prompts", write_prompts(spark, args.run_dir, cfg), args.run_dir)
        return 0
    rows = spark.read.parquet(args.completions) if args.completions.endswith(".parquet") else spark.read.json(args.completions)
    log.info("mined: %s", run_mining(parse_completions(rows), args.run_dir, cfg))
    return 0


def training_phase(spark, args, cfg) -> int:
    from .plans.training_data import write_training_data
    from .sources.readers import read_pairs

    path = args.pairs_file or f"{args.run_dir}/pairs"
    if "://" not in path and not Path(path).exists():
        log.error("no pairs at %s", path)
        return 1
    if not args.tokenizer:
        log.error("training data needs --tokenizer")
        return 1
    report = write_training_data(read_pairs(spark, path), _file_encoder(args.tokenizer), args.run_dir, cfg, user=args.user, job=args.job)
    log.info("training data: %s, settings %s", json.dumps(report), dataclasses.asdict(cfg))
    return 0


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    logging.basicConfig(level=logging.DEBUG if args.verbose else logging.INFO)
    cfg = settings(args)
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName("echoloom").getOrCreate()
    if not args.train_only:
        if (failed := mining_phase(spark, args, cfg.generation)) or not args.completions:
            return failed
    return 0 if args.generate_only else training_phase(spark, args, cfg.train)


if __name__ == "__main__":
    raise SystemExit(main())
