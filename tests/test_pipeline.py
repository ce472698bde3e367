from __future__ import annotations

import csv
import glob

import pytest

from tracelattice.plans import config, pipeline

from .test_graph import MICRO, brute
from .test_paths import SCAN

TOML = """
[dataset.yarrp]
enabled = true
read_compressed = false
address_type = 'V4'
input_path = '{0}/in'
intermediate_path = '{0}/mid'
output_path = '{0}/out'
[dataset.warts]
enabled = false
read_compressed = false
address_type = 'V6'
input_path = '{0}/none'
intermediate_path = '{0}/none'
output_path = '{0}/none'
[features]
should_preprocess = true
should_merge = true
should_persist_index = true
should_persist_edges = true
should_deduplicate_edges = true
should_compute_graph = true
[features.parameters.degree]
enabled = true
[features.parameters.betweenness]
enabled = true
save_intermediate_results_periodically = {1}
result_batch_size = {2}
max_thread_count = 4
"""


def rows(path):
    out = []
    for part in sorted(glob.glob(f"{path}/part-*")):
        with open(part) as f:
            out += list(csv.DictReader(f))
    return out


@pytest.mark.parametrize("saved", ["true", "false"])
def test_whole_run(spark, tmp_path, saved):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "scan.yarrp").write_text(SCAN)
    (tmp_path / "c.toml").write_text(TOML.format(tmp_path, saved, 3))
    pipeline.run(spark, config.load(str(tmp_path / "c.toml")))
    out = tmp_path / "out"
    assert len(rows(out / "mapping.csv")) == 5
    assert len(rows(out / "edges.csv")) == 11
    assert rows(out / "max_node_ids.csv") == [{"known": "5", "unknown": "4"}]
    edges = [(int(r["from"]), int(r["to"])) for r in rows(out / "edges_deduplicated.csv")]
    assert edges == sorted(edges)
    assert len(edges) == len(MICRO)
    degrees = rows(out / "degree.csv")
    assert [int(r["node_id"]) for r in degrees] == sorted(int(r["node_id"]) for r in degrees)
    assert {int(r["node_id"]): round(float(r["betweenness"]), 6) for r in rows(out / "betweenness.csv")} == brute(edges, True)


def test_bad_configurations(tmp_path):
    for bad in (TOML.replace("'V4'", "'V5'"), TOML.replace("{2}", "0"), TOML.replace("enabled = true\nread", "read")):
        (tmp_path / "c.toml").write_text(bad.format(tmp_path, "true", 3))
        with pytest.raises((ValueError, TypeError)):
            config.load(str(tmp_path / "c.toml"))
    with pytest.raises(FileNotFoundError):
        config.load(str(tmp_path / "missing.toml"))
    with pytest.raises(NotADirectoryError):
        config.ensure_paths(config.Dataset(True, False, "V4", str(tmp_path / "missing"), str(tmp_path), str(tmp_path)))
