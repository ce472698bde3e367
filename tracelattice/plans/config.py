"""Configuration: a TOML file of two datasets and the steps to run."""

from __future__ import annotations

import os
import tomllib
from dataclasses import dataclass


@dataclass(frozen=True)
class Dataset:
    enabled: bool
    read_compressed: bool
    address_type: str
    input_path: str
    intermediate_path: str
    output_path: str


@dataclass(frozen=True)
class Betweenness:
    enabled: bool
    save_intermediate_results_periodically: bool
    result_batch_size: int
    max_thread_count: int


@dataclass(frozen=True)
class Features:
    should_preprocess: bool
    should_merge: bool
    #: Accepted without effect, like the next one.
    should_persist_index: bool
    should_persist_edges: bool
    should_deduplicate_edges: bool
    should_compute_graph: bool
    degree_enabled: bool
    betweenness: Betweenness


@dataclass(frozen=True)
class Config:
    yarrp: Dataset
    warts: Dataset
    features: Features


def load(path: str = "Config.toml") -> Config:
    """Reads the file; a missing file, table or key is an error, and so are bad values."""
    with open(path, "rb") as f:
        raw = tomllib.load(f)
    features = dict(raw["features"])
    parameters = features.pop("parameters")
    config = Config(Dataset(**raw["dataset"]["yarrp"]), Dataset(**raw["dataset"]["warts"]), Features(**features, degree_enabled=parameters["degree"]["enabled"], betweenness=Betweenness(**parameters["betweenness"])))
    for d in (config.yarrp, config.warts):
        if d.address_type not in ("V4", "V6"):
            raise ValueError("address_type is V4 or V6")
    if config.features.betweenness.result_batch_size < 1 or config.features.betweenness.max_thread_count < 1:
        raise ValueError("result_batch_size and max_thread_count are at least 1")
    return config


def ensure_paths(dataset: Dataset) -> None:
    """The input must be a folder; the other two are made where they are missing."""
    if not os.path.isdir(dataset.input_path):
        raise NotADirectoryError(dataset.input_path)
    for path in (dataset.intermediate_path, dataset.output_path):
        if os.path.exists(path) and not os.path.isdir(path):
            raise NotADirectoryError(path)
        os.makedirs(path, exist_ok=True)
