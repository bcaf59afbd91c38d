"""``python -m quarry config.yaml positive.json negative.json folder``: index, answer and evaluate."""

import sys

from pyspark.sql import SparkSession

from quarry.plans.pipeline import run_main
from quarry.sources import tables as S


def main(config_path: str, positive: str, negative: str, folder: str) -> None:
    spark = SparkSession.builder.appName("quarry").getOrCreate()
    config = S.load_yaml(config_path)
    right, rejected = run_main(config, S.from_paths(spark, config["documents"]), S.qa_pairs(spark, positive), S.qa_pairs(spark, negative), folder)
    right.agg({"answer_correctness": "avg"}).show()
    rejected.agg({"negative_rejection": "avg"}).show()


if __name__ == "__main__":
    main(*sys.argv[1:])
