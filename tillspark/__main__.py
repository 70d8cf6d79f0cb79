"""Command line: ``python -m tillspark <job> <input> [<output>]``."""

from __future__ import annotations

import argparse

from .plans import jobs
from .session import get_spark
from .streaming import read_log


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="tillspark")
    parser.add_argument("job", choices=["prepare", "inspect", "clean", "reports", "features",
                                        "train", "compare", "score", "score-stream", "log"])
    parser.add_argument("input")
    parser.add_argument("output", nargs="?")
    parser.add_argument("--store")
    parser.add_argument("--category")
    parser.add_argument("--top-n", type=int)
    parser.add_argument("--fill-date-gaps", action="store_true")
    parser.add_argument("--strict", action="store_true")
    parser.add_argument("--multi-line", action="store_true",
                        help="CSV cells or JSON values of the input run over lines")
    parser.add_argument("--model", help="bundle that scores the requests")
    parser.add_argument("--split", action="store_true", help="keep bad requests with reasons")
    parser.add_argument("--log", help="prediction log to add to")
    parser.add_argument("--limit", type=int, default=20, help="newest entries of the log")
    parser.add_argument("--master")
    args = parser.parse_args(argv)
    if args.job not in ("inspect", "log") and not args.output:
        parser.error("this job needs an output path")
    if args.job in ("score", "score-stream") and not args.model:
        parser.error("scoring needs --model")
    spark = get_spark("tillspark", args.master)
    if args.job == "prepare":
        asked = (args.store, args.category, args.top_n, args.multi_line)
        jobs.prepare(spark, args.input, args.output, *asked)
        print(jobs.preparation_counts(spark, args.input, *asked))
    elif args.job == "inspect":
        result, tables = jobs.first_look(spark, args.input)
        print(result.summary())
        for name, table in tables.items():
            print(f"\n{name}")
            table.show(truncate=False)
    elif args.job == "clean":
        print(jobs.clean_table(spark, args.input, args.output, args.fill_date_gaps,
                               args.strict, args.multi_line).summary())
    elif args.job == "reports":
        print("\n".join(jobs.reports(spark, args.input, args.output)))
    elif args.job == "features":
        names, gaps = jobs.feature_table(spark, args.input, args.output)
        print(f"{len(names)} features")
        gaps.show(len(names), truncate=False)
    elif args.job == "train":
        print(jobs.train(spark, args.input, args.output).scores)
    elif args.job == "compare":
        result = jobs.compare(spark, args.input, args.output)
        result.tables["comparison"].show(truncate=False)
        print(f"winner: {result.name}")
    elif args.job == "score":
        print(jobs.score(spark, args.input, args.output, args.model, args.split, args.log,
                         args.multi_line))
    elif args.job == "score-stream":
        jobs.score_arrivals(spark, args.input, args.output, args.model) \
            .groupBy("status").count().show()
    else:
        read_log(spark, args.input, args.limit).show(args.limit, truncate=False)


if __name__ == "__main__":
    main()
