"""python -m corvane index|qa|evaluate|counts --config FILE [--mode MODE]"""

import argparse
import json
import os
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .plans import config as settings
from .plans import pipelines
from .providers import RecordedJudge
from .sources import readers


def recorded(spark: SparkSession, path: str) -> RecordedJudge:
    lines = spark.read.text(path).filter(F.trim("value") != "")
    return RecordedJudge(lines.select(F.get_json_object("value", "$.question").alias("question"), F.col("value").alias("verdict")))


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="corvane", description=__doc__)
    p.add_argument("run", choices=["index", "qa", "evaluate", "counts"])
    p.add_argument("--config", required=True)
    p.add_argument("--mode", choices=list(settings.RUN_MODES), default="engineered")
    p.add_argument("--verdicts", help="recorded verdicts for evaluate, instead of a judge: JSON lines with question and the judge's fields")
    p.add_argument("--resume", action="store_true", help="don't ask again what an earlier qa run with these settings has answered")
    p.add_argument("--slices", type=int, help="stop a qa run after so many slices of questions; --resume goes on from there")
    a = p.parse_args(args)
    raw, base = settings.read(a.config), Path(a.config).resolve().parent.parent
    os.environ.update(readers.env_file(str(base / ".env"), dict(os.environ)))
    spark = SparkSession.builder.getOrCreate()
    if a.run == "index":
        pipelines.build_index(spark, settings.shared(raw, base)).show(truncate=False)
    elif a.run == "qa":
        pipelines.run_qa(spark, settings.run(raw, a.mode, base), resume=a.resume, most_slices=a.slices)
    elif a.run == "evaluate":
        print(json.dumps(pipelines.run_evaluation(spark, settings.evaluation(raw, a.mode, base), recorded(spark, a.verdicts) if a.verdicts else None), indent=2))
    else:
        c = settings.shared(raw, base)
        readers.documents(spark, c["data_dir"], c["document_years"]).groupBy("year", "month").agg(F.count(F.lit(1)).alias("documents")).orderBy("year", "month").show(10_000)


if __name__ == "__main__":
    main()
