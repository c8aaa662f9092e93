"""Schemas of a recording's tables. Each table has the column recording first; many recordings lie in one table, partitioned by it."""

from __future__ import annotations

import re

R = "recording string, "


def _of(ddl: str) -> str:
    return R + ddl


def columns(table: str) -> list[str]:
    """A table's columns in order."""
    return re.findall(r"(?:^|, )(\w+) ", TABLES[table])


TABLES: dict[str, str] = {
    "meta": _of("key string, value string"),
    "files": _of("path string, content_hash string, in_source int, has_errors int, content string"),
    "nodes": _of("file string, node_id bigint, kind string, byte_start bigint, byte_end bigint, line bigint, col bigint, parent_id bigint"),
    "commands": _of("file string, node_id bigint, name string, name_lower string, args_text string, args array<struct<kind:string,value:string>>, line bigint, byte_start bigint, byte_end bigint, var_refs array<string>, env_refs array<string>, blocks array<struct<kind:string,node_id:bigint,head:string>>"),
    "events": _of("event_id bigint, node_id bigint, file string, line bigint, cmd string, cmd_lower string, args array<string>, args_json string, scope_id bigint, frame bigint, global_frame bigint, time_abs double, elapsed_us bigint"),
    "scopes": _of("scope_id bigint, parent_id bigint, kind string, name string, transparent int, opened_by_event bigint, closed_by_event bigint, chain array<string>"),
    "var_writes": _of("write_id bigint, event_id bigint, scope_id bigint, name string, value string, write_kind string"),
    "var_reads": _of("read_id bigint, event_id bigint, scope_id bigint, name string, resolved_write_id bigint, read_kind string"),
    "func_defs": _of("def_id bigint, event_id bigint, name string, name_lower string, kind string, file string, line bigint, params array<string>"),
    "targets": _of("name string, type string, imported int, alias_of string, defined_event bigint, in_file_api int"),
    "tgt_edges": _of("edge_id bigint, src_target string, dst string, dst_target string, visibility string, origin_event bigint"),
    "tgt_props": _of("prop_id bigint, target string, prop string, value string, appended int, origin_event bigint"),
    "usage_reqs": _of("target string, kind string, value string, visibility string, source string, origin_event bigint"),
    "tus": _of("target string, source_path string"),
    "tu_headers": _of("target string, source_path string, header_path string"),
    "configure_diagnostics": _of("diag_id bigint, severity string, kind string, file string, line bigint, message string"),
}

FINDING = R + "rule string, severity string, file string, line bigint, message string, related array<struct<file:string,line:bigint,note:string>>"

#: Severities in rising order.
SEVERITIES = ["note", "warning", "error"]
