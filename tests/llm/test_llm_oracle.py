"""Queries of the subpackage against their SQL at the smallest scale."""

import os
import random

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from oracle import compare, connect
from repalign.llm import licenses, oracles, queries

SF_DIR = os.environ.get("REPALIGN_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables not present")


@pytest.mark.parametrize("name", list(queries.ORACLE))
def test_query(spark, name):
    ok, note = compare(spark, connect(SF_DIR), SF_DIR, name, queries.QUERIES[name], queries.ORACLE[name])
    assert ok, note


def test_license_sql_finds_wrapped_notices(spark, tmp_path):
    """Notices over several lines, windows too wide for a template, and texts of template words only: SQL and join agree."""
    rng = random.Random(6)
    words = [w.split() for _, w in licenses.TEMPLATES]
    common = sorted({x for w in words for x in w})
    texts = [None, "", "\n".join(words[2]), " \n ".join(words[4]) + "\nend", "all rights " + "x " * 4 + "reserved", "all rights\nreserved"]
    for k in range(60):
        parts = [rng.choice(common) if k % 2 else f"w{rng.randrange(30)}" for _ in range(rng.randrange(120))]
        for _ in range(rng.randrange(3)):
            notice = rng.choice(words)
            gap = rng.choice([0, 0, 1, 2])
            parts[rng.randrange(len(parts) + 1):0] = [p for x in notice for p in [x, *["x"] * gap]]
        texts.append("".join(p + rng.choice(" \n") for p in parts))
    path = str(tmp_path / "documents.parquet")
    pq.write_table(pa.table({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": pa.array(texts, pa.string())}), path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}'")
    ok, note = compare(spark, con, str(tmp_path), "licenses", lambda s, d: licenses.scan(s.read.parquet(path)), oracles.licenses())
    assert ok, note
    found = {r[0]: r[1] for r in con.execute(f"SELECT doc_id, labels FROM ({oracles.licenses()})").fetchall()}
    assert [found[k] for k in range(6)] == ["", "", "mit", "apache-2", "", "all-rights-reserved"]
