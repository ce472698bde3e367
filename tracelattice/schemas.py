"""Schemas of every table; nothing is inferred."""

from __future__ import annotations

LINES = "value string, file_name string, block_start long, line_no long"
MAPPING = "ip string, node_id long"
EDGES = "`from` long, `to` long"
MAX_NODE_IDS = "known long, unknown long"
DEGREE = "node_id long, degree_in long, degree_out long, and_in double, and_out double, and_total double, iand_in double, iand_out double, iand_total double"
BETWEENNESS = "node_id long, betweenness double"
WARTS_RECORDS = "file_name string, record_no long, record_type string, src struct<kind:string,addr:binary>, hops array<struct<pos:int,probe_ttl:int,kind:string,addr:binary>>"
