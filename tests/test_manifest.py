"""A manifest is written by many tasks, and reads back whole."""

import json
from pathlib import Path

import pytest

from tonewright.sources import tables as S

SCHEMA = "path string, speaker_name string, speaker_id int, repeat int, output_key string"


def test_a_line_for_each_entry(spark, tmp_path):
    rows = [(f"p{i}", f"s{i % 7}", i % 7, 1 + i % 3, f"k{i}") for i in range(1000)]
    S.write_manifest(spark.createDataFrame(rows, SCHEMA).repartition(4), str(tmp_path / "m"))
    lines = [line for f in Path(tmp_path).rglob("part-*.json") for line in f.read_text().splitlines()]
    assert max(map(len, lines)) < 1000 and len(lines) == 1001
    header = next(x for x in map(json.loads, lines) if "speakers" in x)
    assert header["n_entries"] == 1000 and len(header["speakers"]) == 7
    got = S.read_manifest(spark, str(tmp_path / "m")).select("path", "speaker_name", "speaker_id", "repeat", "output_key")
    assert sorted(map(tuple, got.collect())) == sorted(rows)


@pytest.mark.parametrize("rows", [[], [("p", "s", 1, 1, None)], [("p", "s", 110, 1, "k")]])
def test_an_empty_or_invalid_manifest_fails(spark, tmp_path, rows):
    S.write_manifest(spark.createDataFrame(rows, SCHEMA), str(tmp_path / "m"))
    with pytest.raises(Exception, match="invalid entry"):
        S.read_manifest(spark, str(tmp_path / "m")).collect()
