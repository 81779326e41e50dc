"""Bookmark files: JSON trees of any depth as rows."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

_OUT = pa.schema([("folder", pa.string()), ("depth", pa.int32()), ("name", pa.string()), ("url", pa.string())])


def links_of(text: str | None) -> Iterator[tuple[str, int, str, str]]:
    """(folder, depth, name, url) of the http links of one file, depth first; a file that can't be read has none."""
    try:
        stack = [(json.loads(text), (), 0)] if text else []
    except ValueError:
        return
    while stack:
        node, above, depth = stack.pop()
        if isinstance(node, list):
            stack += [(x, above, depth) for x in reversed(node)]
        elif isinstance(node, dict):
            name, url = str(node.get("name") or ""), node.get("url")
            if node.get("type") == "url":
                if isinstance(url, str) and url.lower().startswith(("http://", "https://")):
                    yield "/".join(above), depth, name or url, url
            else:  # a folder, or the roots of the file, which bear no type
                stack.append((node["children"] if "children" in node else [v for v in node.values() if isinstance(v, (dict, list))], (*above, name) if name else above, depth + 1 if name else depth))


def flatten(files: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """One row for each link of each file: id, folder, depth, name, url."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(i, *x) for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for x in links_of(text)]
            columns = list(zip(*found)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], batch.schema.field(0).type), *(pa.array(c, f.type) for c, f in zip(columns[1:], _OUT))], names=[id_col, *_OUT.names])

    kind = files.schema[id_col].dataType.simpleString()
    return files.select(id_col, json_col).mapInArrow(run, f"{id_col} {kind}, folder string, depth int, name string, url string")
