"""Command line: python -m windrow -t DIR [...]"""

from __future__ import annotations

import argparse
import logging

from pyspark.sql import SparkSession

from windrow import __version__
from windrow.config import Config


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="windrow", description="Find copied passages in code and text.")
    add = p.add_argument
    add("-c", "--config", help="JSON file of options; all other flags are ignored")
    add("-t", "--test-dirs", nargs="+", help="folders with the files to check")
    add("-r", "--ref-dirs", nargs="+", help="folders to compare with (default: the test folders)")
    add("-b", "--boilerplate-dirs", nargs="+", help="folders with text to ignore")
    add("-e", "--extensions", nargs="+", help="file extensions (default: all)")
    add("-n", "--noise-thresh", type=int, help="length of a k-gram: shorter matches are ignored (default 25)")
    add("-g", "--guarantee-thresh", type=int, help="length from which matches are found for sure (default 25)")
    add("-d", "--display-thresh", type=float, help="similarity above which pairs are shown (default 0.33)")
    add("-o", "--force-language", help="treat all files as this language")
    add("-s", "--same-name", action="store_true", help="compare files of the same name only")
    add("-l", "--ignore-leaf", action="store_true", help="don't compare files in the same folder")
    add("-f", "--disable-filter", action="store_true", help="compare raw text")
    add("-a", "--disable-autoopen", action="store_true", help="don't open the report in a browser")
    add("-T", "--truncate", action="store_true", help="cut highlighted code down to its matches")
    add("-O", "--out-file", help="the report's file or folder (default ./report.html)")
    add("--css", nargs="+", help="style sheets to link")
    add("--encoding", help="codec of the files, or DETECT (default utf-8)")
    add("--version", action="version", version=__version__)
    return p


def config_from(argv: list[str] | None = None) -> Config:
    p = parser()
    a = p.parse_args(argv)
    if a.config:
        return Config.from_json(a.config)
    if not a.test_dirs:
        p.error("give either a config file or test folders")
    named = {
        "test_dirs": a.test_dirs, "ref_dirs": a.ref_dirs, "boilerplate_dirs": a.boilerplate_dirs, "extensions": a.extensions, "noise_t": a.noise_thresh,
        "guarantee_t": a.guarantee_thresh, "display_t": a.display_thresh, "force_language": a.force_language, "out_file": a.out_file, "css_files": a.css, "encoding": a.encoding,
    }
    flags = {"same_name_only": a.same_name, "ignore_leaf": a.ignore_leaf, "disable_filtering": a.disable_filter, "disable_autoopen": a.disable_autoopen, "truncate": a.truncate}
    return Config.from_dict({k: v for k, v in named.items() if v is not None} | flags)


def main(argv: list[str] | None = None) -> None:
    config = config_from(argv)
    if not config.silent:
        logging.basicConfig(level=logging.INFO, format="%(asctime)s %(message)s")
    from windrow.plans.detector import Detector

    spark = SparkSession.builder.appName("windrow").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    print(Detector(spark, config).run().report())


if __name__ == "__main__":
    main()
