"""The test tables made awkward: emptied, or with null rows, copies and clashing columns."""

from __future__ import annotations

from pathlib import Path

import pyarrow as pa
import pyarrow.parquet as pq

SOURCE = Path("/root/testdata/sf0.001")
CLASH = ("key", "value", "n", "_n", "_salt", "grp", "x", "cluster", "rank", "doc_a", "form", "hist", "orphan", "place")


def write(out: Path, kind: str) -> str:
    out.mkdir(parents=True, exist_ok=True)
    for f in SOURCE.glob("*.parquet"):
        t = pq.read_table(f)
        if kind == "empty":
            t = t.slice(0, 0)
        else:
            nulls = pa.table({c.name: pa.nulls(2, c.type) for c in t.schema}, schema=t.schema)
            t = pa.concat_tables([t, nulls, t.slice(0, 3)])
            for c in CLASH:
                if c not in t.column_names:
                    t = t.append_column(c, pa.nulls(t.num_rows, pa.string()))
        pq.write_table(t, out / f.name)
    return str(out)
