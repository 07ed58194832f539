"""python -m terrane ACTION INPUT OUTPUT"""

import argparse

from pyspark.sql import SparkSession

from terrane.plans.actions import ACTIONS, run

args = argparse.ArgumentParser(prog="terrane")
args.add_argument("action", choices=sorted(ACTIONS))
args.add_argument("input", help="an extract (.pbf), or a folder of Parquet tables")
args.add_argument("output", help="a folder for the result tables")
a = args.parse_args()
run(SparkSession.builder.appName(f"terrane {a.action}").getOrCreate(), a.action, a.input, a.output)
