"""Queries over a last plane with fewer rows, as at every size but the tests', against their SQL."""

import os

import numpy as np
import pyarrow.parquet as pq
import pytest

from lumastack import registry
from lumastack.operators import label, neighbour

from .oracle import compare, connection
from .test_operators import pixels, stack

SF = "/root/testdata/sf0.001"
NAMES = """w5_temporal_fold_tiles w6_temporal_fold_pixels w8_background_gaussian k1_gaussian k1_gaussian_reflect k2_dog_step k3_dog_response k3_log_response k5_unsharp
 k6_local_contrast k7_flatness k8_median k9_bilateral k11_top_hat k12_morph_gradient k15_local_stats k16_local_entropy k17_quiet_pixels""".split()


@pytest.fixture(scope="module")
def partial(tmp_path_factory):
    """Three planes, the last with 6 rows."""
    folder = tmp_path_factory.mktemp("partial")
    for name in os.listdir(SF):
        if name != "embeddings.parquet":
            os.symlink(f"{SF}/{name}", folder / name)
    pq.write_table(pq.read_table(f"{SF}/embeddings.parquet").sort_by("vec_id").slice(0, 106), folder / "embeddings.parquet")
    return str(folder)


@pytest.mark.parametrize("name", NAMES)
def test_a_short_plane_equals_its_sql(spark, partial, name):
    assert compare(registry.queries()[name](spark, partial), connection(partial), registry.oracle_sql()[name]) is None


@pytest.mark.parametrize("tile", [2, 4, 16])
def test_missing_pixels_get_no_row_at_any_tile_size(spark, tile):
    rows = neighbour.local_entropy(stack(spark, np.arange(15).reshape(3, 5)), 1, 12, 12, tile=tile).collect()
    assert {(r.y, r.x) for r in rows} == {(y, x) for y in range(3) for x in range(5)} and all(np.isfinite(r.v) for r in rows)


def test_holes_in_the_last_row_of_a_short_plane_are_filled_as_by_the_sql(spark, tmp_path):
    """Two planes, the second ends with row 7, which holds three of the holes."""
    pq.write_table(pq.read_table(f"{SF}/embeddings.parquet").sort_by("vec_id").slice(0, 58), tmp_path / "embeddings.parquet")
    for name in os.listdir(SF):
        if name != "embeddings.parquet":
            os.symlink(f"{SF}/{name}", tmp_path / name)
    got = registry.queries()["m3_fill_holes"](spark, str(tmp_path))
    assert got.where("t = 1 AND y = 7 AND x IN (12, 30, 36)").count() == 3
    assert compare(got, connection(tmp_path), registry.oracle_sql()["m3_fill_holes"]) is None


def test_the_border_of_holes_is_the_given_sizes_or_the_planes_own(spark):
    df = stack(spark, np.where(np.arange(15).reshape(3, 5) == 12, 0, 1))
    assert (2, 2) not in pixels(label.fill_holes(df.where("v = 1"), df))
    assert (2, 2) in pixels(label.fill_holes(df.where("v = 1"), df, height=4, width=5))
    assert (2, 2) not in pixels(label.fill_holes(df.where("v = 1"), df, height=3, width=5))
