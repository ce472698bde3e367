"""The whole run: scan, mapping and edges, distinct edges, statistics.

Each step writes its tables and a later run may start from them, as the switches say.
"""

from __future__ import annotations

import logging
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ip import address_number, ipv4_text, ipv6_text
from ..operators import betweenness, degree, graph, ids, paths
from ..sources import tables, warts, yarrp
from .config import Config, Dataset, Features, ensure_paths
from .lineage import checkpoint, qualified

log = logging.getLogger(__name__)


def yarrp_graph(hops: DataFrame, gap_mode: str = "reference") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(mapping of numbers, edges, max ids) of parsed rows; all files' rows of a target make one path."""
    hops = checkpoint(hops)
    mapping = checkpoint(ids.node_mapping(hops, yarrp.ORDINAL, 1))
    walked = checkpoint(paths.steps(ids.encode_hops(hops, mapping), ["target"], ["ttl", *yarrp.ORDINAL], F.lit(0).cast("long"), gap_mode))
    edges = paths.number_edges(paths.expand(walked), paths.unknown_ids(walked))
    return mapping, edges, paths.max_node_ids(mapping, walked)


def warts_graph(traces: DataFrame, gap_mode: str = "reference") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(mapping of 16-byte numbers, edges, max ids); one path for each record, ids from 0, sources before hops."""
    place = ["file_name", "record_no"]
    hop = F.struct(F.col("pos"), F.col("probe_ttl").alias("ttl"), F.col("kind"), address_number(F.col("kind"), F.col("addr")).alias("ip"))
    rows = traces.select(*place, address_number(F.col("src.kind"), F.col("src.addr")).alias("source_ip"), F.posexplode_outer("hops").alias("n", "h"))
    rows = checkpoint(rows.select(*place, "source_ip", F.col("h.pos").alias("pos"), F.col("h.probe_ttl").alias("ttl"), F.col("h.kind").alias("kind"), address_number(F.col("h.kind"), F.col("h.addr")).alias("ip")))
    met = rows.select(*place, F.lit(-1).alias("pos"), F.col("source_ip").alias("ip")).unionByName(rows.where(F.col("ip").isNotNull()).select(*place, "pos", "ip"))
    first = met.where("ip is not null").groupBy("ip").agg(F.min(F.struct(*place, "pos")).alias("place"))
    mapping = checkpoint(ids.dense_index(checkpoint(first), ["place", "ip"], "node_id", 0).select("ip", "node_id"))
    m = mapping
    known = rows.where("ip is not null").join(m.select(F.col("ip"), F.col("node_id").alias("hop")), "ip").join(m.select(F.col("ip").alias("source_ip"), F.col("node_id").alias("source")), "source_ip")
    walked = checkpoint(paths.steps(known, place, ["pos"], F.col("source"), gap_mode))
    edges = paths.number_edges(paths.expand(walked), paths.unknown_ids(walked))
    return mapping, edges, paths.max_node_ids(mapping, walked)


def address_text(mapping: DataFrame, family: str, sixteen: bool) -> DataFrame:
    """(ip text, node_id); in family V4 a number beyond 32 bits is an error."""
    if family == "V6":
        return mapping.select(ipv6_text("ip").alias("ip"), "node_id")
    number = F.conv(F.hex(F.substring("ip", 13, 4)), 16, 10).cast("long") if sixteen else F.col("ip")
    fits = F.hex(F.substring("ip", 1, 12)) == "0" * 24 if sixteen else F.col("ip").between(0, 4294967295)
    return mapping.select(F.when(fits, ipv4_text(number)).otherwise(F.raise_error(F.lit("an address is no IPv4 address")).cast("string")).alias("ip"), "node_id")


def _statistics(spark: SparkSession, output: str, features: Features) -> None:
    if features.should_deduplicate_edges:
        known, unknown = tables.read_max_node_ids(spark, f"{output}/max_node_ids.csv")
        edges = tables.read_edges(spark, f"{output}/edges.csv").where(F.col("from").between(-unknown, known))
        tables.write_csv(graph.distinct_edges(edges), f"{output}/edges_deduplicated.csv", "from", "to")
    if not features.should_compute_graph:
        return
    known, unknown = tables.read_max_node_ids(spark, f"{output}/max_node_ids.csv")
    edges = checkpoint(graph.distinct_edges(tables.read_edges(spark, f"{output}/edges_deduplicated.csv")))
    log.info("%s: %d distinct edges", output, edges.count())
    if features.degree_enabled:
        tables.write_csv(graph.within(degree.degree_table(edges), known, unknown), f"{output}/degree.csv", "node_id")
        log.info("%s: degrees written", output)
    b = features.betweenness
    if b.enabled:
        if b.save_intermediate_results_periodically:
            batches = max(1, -(-graph.sources(edges).count() // b.result_batch_size))
            scores = betweenness.betweenness_in_batches(edges, f"{output}/betweenness", batches, tasks=b.max_thread_count)
        else:
            scores = betweenness.betweenness(edges, tasks=b.max_thread_count)
        tables.write_csv(graph.within(scores, known, unknown), f"{output}/betweenness.csv", "node_id")
        log.info("%s: betweenness written", output)


def place(spark: SparkSession, path: str) -> str:
    """A folder of the configuration as a URI: of this machine in a local run, else of the cluster's store."""
    if "://" in path or not spark.sparkContext.master.startswith("local"):
        return qualified(spark, path)
    return f"file://{os.path.abspath(path)}"


def _run(spark: SparkSession, dataset: Dataset, features: Features, kind: str, mode: str) -> None:
    if spark.sparkContext.master.startswith("local") and "://" not in dataset.input_path:
        ensure_paths(dataset)
    source, output, inner = (place(spark, p) for p in (dataset.input_path, dataset.output_path, dataset.intermediate_path))
    log.info("%s: %s", kind, dataset.input_path)
    hops = None
    if kind == "yarrp":
        if features.should_preprocess:
            lines = yarrp.read_lines(spark, source, dataset.read_compressed)
            yarrp.hops(lines, dataset.address_type, mode).write.mode("overwrite").parquet(f"{inner}/hops")
        hops = features.should_merge
    if hops:
        mapping, edges, most = yarrp_graph(spark.read.parquet(f"{inner}/hops"))
        sixteen = False
    elif kind == "warts" and features.should_preprocess:
        mapping, edges, most = warts_graph(warts.traces(warts.read_records(spark, source), mode))
        sixteen = True
    else:
        return _statistics(spark, output, features)
    tables.write_csv(address_text(mapping, dataset.address_type, sixteen), f"{output}/mapping.csv")
    tables.write_csv(edges, f"{output}/edges.csv")
    tables.write_csv(most, f"{output}/max_node_ids.csv")
    return _statistics(spark, output, features)


def run(spark: SparkSession, config: Config, mode: str = "failfast") -> None:
    """Runs the enabled datasets one after the other."""
    for kind in ("yarrp", "warts"):
        dataset = getattr(config, kind)
        if dataset.enabled:
            _run(spark, dataset, config.features, kind, mode)
