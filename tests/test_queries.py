"""Every media query equals its SQL at the smallest scale, and the entry runs."""

import glob
import os
import tempfile

import numpy as np
import pytest

import __spark_entry__ as e
from pagewright import queries as media

from .oracle import same

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(media.SQL))
def test_equals_sql(spark, name):
    same(spark, media.QUERIES[name], media.SQL[name], SF)


def test_entry(spark):
    rows = e.entry(spark).collect()
    assert rows and rows[0].page_w == 792


def test_every_query_has_sql():
    assert set(media.SQL) == set(media.QUERIES)
    assert set(e.oracle_sql()) <= set(e.queries())


def test_first_frame_in_single_precision(spark):
    """Values whose sum or product rounds to a whole number in single precision alone."""
    near = [float(np.nextafter(np.float32(k / 100 - 1), np.float32(way))) for k in range(60, 140) for way in (-9, 9)]
    frame = spark.createDataFrame([(i, near[64 * i % 96 :][:64], 7) for i in range(24)], "vec_id long, embedding array<float>, label int")
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    frame.coalesce(1).write.parquet(f"{folder}/made")
    os.rename(glob.glob(f"{folder}/made/*.parquet")[0], f"{folder}/embeddings.parquet")
    same(spark, media.QUERIES["webp_first_frame"], media.SQL["webp_first_frame"], folder)
