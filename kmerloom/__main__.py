import sys

from pyspark.sql import SparkSession

from kmerloom.cli import run
from kmerloom.plans.runtime import ship_package

if __name__ == "__main__":
    session = SparkSession.builder.appName("kmerloom").getOrCreate()
    ship_package(session)
    code = run(session, sys.argv[1:])
    session.stop()
    sys.exit(code)
