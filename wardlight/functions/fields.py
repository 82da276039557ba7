"""Names of event fields and how rules reach them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Other names of fields.
ALIASES = {
    "image": "image", "processname": "image", "process_name": "image", "commandline": "command_line", "command_line": "command_line",
    "parentimage": "parent_image", "parent_image": "parent_image", "user": "user", "username": "user", "computer": "host", "hostname": "host", "host": "host",
    "sourceip": "src_ip", "src_ip": "src_ip", "destinationip": "dst_ip", "dst_ip": "dst_ip", "destinationport": "dst_port", "dst_port": "dst_port",
    "targetimage": "target_image", "grantedaccess": "granted_access", "queryname": "query", "cs-uri-stem": "uri_path", "cs-uri-query": "uri_query", "c-uri": "url", "url": "url",
    "cs-method": "method", "sc-status": "status", "status": "status", "bytes": "bytes", "command": "command", "eventtype": "kind", "kind": "kind",
}
#: Names that other tools use and that have no alias above.
EXTENDED = {"targetfilename": "target_filename", "eventid": "event_id", "cs-user-agent": "user_agent", "c-useragent": "user_agent"}
ENVELOPE = ("host", "user", "src_ip", "dst_ip", "dst_port", "kind", "source")
DATA = (
    "image", "parent_image", "command_line", "target_image", "granted_access", "target_filename", "query", "protocol", "event_id", "bytes", "action", "sensor", "method",
    "url", "uri_path", "uri_query", "status", "user_agent", "service", "invalid_user", "target_user", "command", "pwd",
)
NUMBERS = ("dst_port", "event_id", "bytes", "status")
EVENT = (
    "ts timestamp, us bigint, seq bigint, source string, kind string, host string, user string, src_ip string, dst_ip string, dst_port int, "
    "image string, parent_image string, command_line string, target_image string, granted_access string, target_filename string, query string, protocol string, event_id int, "
    "bytes bigint, action string, sensor string, method string, url string, uri_path string, uri_query string, status int, user_agent string, service string, "
    "invalid_user boolean, target_user string, command string, pwd string, raw string"
)


def canonical(name: str, extended: bool = False) -> str:
    low = name.lower()
    return ALIASES.get(low) or (EXTENDED.get(low) if extended else None) or low


#: A column of this name (VARIANT, an object with names in lower case) holds what a source tells and no column has.
OPEN = "more"


def resolve(name: str, columns: list[str] | None = None, extended: bool = False) -> Column:
    """The field's column: of the envelope with empty texts and zero as missing; null for a field that events don't have.
    With the column OPEN a field that is no column is looked for there, as text."""
    c = canonical(name, extended)
    if c in ENVELOPE and (columns is None or c in columns):
        return F.nullif(F.col(c), F.lit(0 if c == "dst_port" else ""))
    known = columns if columns is not None else DATA
    if c in known and c not in ("ts", "us", "seq", "raw", OPEN):
        return F.col(f"`{c}`")
    if columns is not None and OPEN in columns and c not in ("ts", "us", "seq", "raw") and '"' not in c:
        return F.try_variant_get(OPEN, f'$["{c}"]', "string")
    return F.lit(None).cast("string")


def event_json(columns: list[str]) -> Column:
    """An event as one JSON object: its time and envelope, the data that it has, and its open fields beside them."""
    first = [F.date_format(F.timestamp_micros("us"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("ts")] + [F.col(c) for c in ENVELOPE if c in columns] + [F.col(c) for c in DATA if c in columns]
    known = F.to_json(F.struct(*first))
    if OPEN not in columns:
        return known
    more = F.to_json(OPEN)
    return F.when(F.col(OPEN).isNull() | (more == "{}") | ~more.startswith("{"), known).otherwise(F.concat(F.substring(known, F.lit(1), F.length(known) - 1), F.lit(","), F.substring(more, F.lit(2), F.length(more))))
