"""python -m gridseek import|triples|index|retrieve|ask|train|test: the entries from the command line."""

from __future__ import annotations

import argparse
from dataclasses import replace

from gridseek.config import Config
from gridseek.operators.triples import STRATEGIES
from gridseek.operators.scorer import fused_sum
from gridseek.plans import pipeline, training
from gridseek.session import get_session
from gridseek.sources import sinks


def arguments(given: list[str] | None = None) -> argparse.Namespace:
    top = argparse.ArgumentParser(prog="gridseek")
    sub = top.add_subparsers(dest="entry", required=True)
    for name, what in (
        ("import", "CSV files to tables"),
        ("triples", "tables to passages"),
        ("index", "CSV files to an index, or one step of it"),
        ("retrieve", "passages for each question of a JSON-lines file (qid, question)"),
        ("ask", "the tables that answer a question"),
        ("train", "a scorer, in rounds of questions that the tables ask of themselves"),
        ("test", "precision on a JSON-lines file of questions (qid, question, table_id_lst)"),
    ):
        p = sub.add_parser(name, help=what)
        p.add_argument("--work", required=True)
        p.add_argument("--config")
        p.add_argument("--strategy", choices=sorted(STRATEGIES))
        p.add_argument("--again", action="store_true", help="repeat finished stages")
    for name in ("import", "index"):
        sub.choices[name].add_argument("--tables", required=name == "import", help="folder of CSV files")
    sub.choices["index"].add_argument("--step", choices=pipeline.STEPS)
    sub.choices["ask"].add_argument("question")
    sub.choices["ask"].add_argument("--html", help="a folder for the answer as HTML")
    sub.choices["train"].add_argument("--questions", type=int, help="how many different ones a round; by default the configuration's train_incr_size")
    sub.choices["train"].add_argument("--dev-questions", type=int, help="how many others for evaluation; by default the configuration's dev_n")
    sub.choices["train"].add_argument("--rounds", type=int, default=10)
    sub.choices["train"].add_argument("--patience", type=int, default=3, help="rounds without a better precision before the end")
    sub.choices["retrieve"].add_argument("--by", choices=("vectors", "words"), default="vectors")
    for name in ("retrieve", "ask", "test"):
        sub.choices[name].add_argument("--n-docs", type=int, help="passages for a question; by default the configuration's retr_top_n")
        sub.choices[name].add_argument("--max-retr", type=int, help="passages for a question whose first ones hold too few tables")
        sub.choices[name].add_argument("--min-tables", type=int, help="how many tables are too few")
    for name in ("retrieve", "test"):
        sub.choices[name].add_argument("--questions", required=True)
        sub.choices[name].add_argument("--out", required=True)
    return top.parse_args(given)


def main(given: list[str] | None = None) -> None:
    args = arguments(given)
    config = Config.read(args.config) if args.config else Config()
    if args.strategy:
        config = replace(config, strategy=args.strategy)
    given_sizes = {"retr_top_n": getattr(args, "n_docs", None), "max_retr": getattr(args, "max_retr", None), "min_tables": getattr(args, "min_tables", None)}
    config = replace(config, **{k: v for k, v in given_sizes.items() if v is not None})
    spark = get_session()
    scorer = (training.newest(spark, args.work) if args.entry in ("ask", "test") else None) or fused_sum
    if args.entry == "import":
        pipeline.import_tables(spark, args.tables, args.work, args.again)
    elif args.entry == "triples":
        pipeline.make_passages(spark, args.work, config.strategy, args.again)
    elif args.entry == "index":
        pipeline.index_collection(spark, args.tables, args.work, config, args.again, step=args.step)
    elif args.entry == "retrieve":
        q = spark.read.json(args.questions)
        if args.by == "words":
            pipeline.index_words(spark, args.work, args.again)
        found = (pipeline.retrieve_by_words if args.by == "words" else pipeline.retrieve)(spark, args.work, q, config)
        found.write.mode("overwrite").json(args.out)
    elif args.entry == "ask":
        q = spark.createDataFrame([("0", args.question)], "qid string, question string")
        shown = pipeline.with_rows(pipeline.answer(spark, args.work, q, config, scorer=scorer), spark.read.parquet(f"{args.work}/rows")).orderBy("place")
        if args.html:
            shown.select(sinks.html_page(shown["place"], shown["title"], shown["names"], shown["rows"])).coalesce(1).write.mode("overwrite").text(args.html)
        shown.show(config.top_tables, truncate=80)
    elif args.entry == "test":
        top, precision = pipeline.test_questions(spark, args.work, spark.read.json(args.questions), config, scorer)
        top.write.mode("overwrite").json(args.out)
        precision.orderBy("k").show()
    else:
        sizes = {"train_incr_size": args.questions, "dev_n": args.dev_questions}
        config = replace(config, **{k: v for k, v in sizes.items() if v is not None})
        _, rounds = training.train(spark, args.work, args.rounds, config, args.patience, again=args.again)
        for r in rounds:
            print(f"round {r.number}: precision at 1 {r.precision}")


if __name__ == "__main__":
    main()
