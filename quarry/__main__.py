"""python -m quarry NAME FOLDER: run one query and print its plan."""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession

from quarry.catalog import QUERIES

if __name__ == "__main__":
    QUERIES[sys.argv[1]](SparkSession.builder.getOrCreate(), sys.argv[2]).explain("formatted")
