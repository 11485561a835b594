"""Command line: ``python -m quillspan.cli COMMAND ...``"""

from __future__ import annotations

import argparse
import sys

from .config import FEATURES, settings_from
from .operators import learn
from .plans.commands import Workbench
from .session import session
from .sources import resources

COMMANDS = ("train", "test", "validate", "classify", "get-lg-recall", "list-model-weights", "list-mentions", "count-mentions", "find-common-codes", "download-models", "build-models")


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="quillspan", description="Names and languages of glossed examples in documents.")
    p.add_argument("-v", "--verbose", action="count", default=0)
    p.add_argument("command", choices=COMMANDS)
    p.add_argument("config", nargs="?", help="INI file")
    p.add_argument("files", nargs="*")
    p.add_argument("--model", help="folder of the model")
    p.add_argument("--out", help="folder for results")
    p.add_argument("--vectors", help="folder for feature vectors")
    p.add_argument("--tier-type", help="type of the tiers from which models are built")
    a = p.parse_args(argv)
    settings, places = settings_from(a.config)
    if a.command == "download-models":
        for code, outcome in resources.download_web_models(next(v for k, v in places.items() if k.endswith("-index") and v.endswith(".csv")), next(v for k, v in places.items() if k.endswith("-base-uri")), a.out):
            print(f"{code}\t{outcome}")
        return 0
    spark = session()
    spark.sparkContext.setLogLevel("INFO" if a.verbose > 1 else "WARN" if a.verbose else "ERROR")
    w = Workbench(spark, settings, places)

    def show(df) -> None:
        for row in df.toLocalIterator():
            print("\t".join("" if x is None else str(x) for x in row))

    if a.command == "list-mentions":
        found = w.mentions(a.files).orderBy("doc_id", "ord").select("startline", "startcol", "endline", "endcol", "name", "code", "text")
        found.write.mode("overwrite").option("sep", "\t").csv(a.out) if a.out else show(found)
    elif a.command == "count-mentions":
        for r in w.counts(a.files).toLocalIterator():
            print(f"{r.name}: {r.n}")
    elif a.command == "find-common-codes":
        codes = w.common_codes(a.files).orderBy("name")
        codes.write.mode("overwrite").option("sep", "\t").csv(a.out) if a.out else show(codes)
    elif a.command == "train":
        w.train(a.files, a.model, a.vectors)
    elif a.command == "classify":
        w.classify(a.files, a.model, a.out)
    elif a.command == "test":
        result = w.test(a.files, a.model)
        show(result["accuracy"])
        if a.out:
            for name, df in result.items():
                df.write.mode("overwrite").option("sep", "\t").option("header", True).csv(f"{a.out}/{name}")
    elif a.command == "validate":
        for df in w.validate(a.files):
            show(df)
    elif a.command == "get-lg-recall":
        show(w.recall(a.files))
    elif a.command == "list-model-weights":
        model = learn.load(spark, a.model)
        show(learn.weights(model, spark))
        show(learn.unused_features(spark, tuple(f for f in FEATURES if settings.on(f)), learn.weights(model, spark).select("feature")))
    elif a.command == "build-models":
        w.build_models(a.files[0], a.tier_type, a.out)
    return 0


if __name__ == "__main__":
    sys.exit(main())
