"""Results as padded text, CSV, JSON lines or an Arrow file."""

from __future__ import annotations

import csv
import io
import json
import math

import pyarrow as pa


def as_table(table: pa.Table) -> str:
    rows = [table.column_names, *([("NULL" if v is None else str(v)) for v in r.values()] for r in table.to_pylist())]
    width = [max(len(r[k]) for r in rows) for k in range(len(table.column_names))]
    lines = ["  ".join(c.ljust(w) for c, w in zip(r, width, strict=True)).rstrip() for r in rows]
    return "\n".join([lines[0], "  ".join("-" * w for w in width), *lines[1:]]) + "\n"


def as_csv(table: pa.Table) -> str:
    out = io.StringIO()
    writer = csv.writer(out, lineterminator="\n")
    writer.writerow(table.column_names)
    writer.writerows(["" if v is None else v for v in r.values()] for r in table.to_pylist())
    return out.getvalue()


def as_json_lines(table: pa.Table) -> str:
    """Numbers and booleans as they are, nulls kept, everything else quoted."""

    def plain(v):
        if v is None or isinstance(v, bool | int) or isinstance(v, float) and math.isfinite(v):
            return v
        return str(v)

    return "".join(json.dumps({k: plain(v) for k, v in r.items()}, ensure_ascii=False) + "\n" for r in table.to_pylist())


def as_arrow(table: pa.Table) -> bytes:
    sink = io.BytesIO()
    with pa.ipc.new_file(sink, table.schema) as writer:
        writer.write_table(table)
    return sink.getvalue()


FORMATS = {"table": as_table, "csv": as_csv, "jsonl": as_json_lines, "arrow": as_arrow}
