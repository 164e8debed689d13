"""Incremental ingest: each trigger reads only new dump files."""

import json
import os

from pricelens.streaming.ingest import ingest_stream


def dump(path, name, rows):
    with open(os.path.join(path, name), "w") as f:
        json.dump(rows, f)


def test_ingest_is_incremental(spark, tmpdir_path):
    src, out, ck = (os.path.join(tmpdir_path, x) for x in ("src", "out", "ck"))
    os.makedirs(src)
    row = {"timestamp": "10-01-22 / 07:15 PM", "zone": "GA", "section": "GA", "row": "", "quantity": 2, "price": 55}
    dump(src, "AWOL221022.json", [row, dict(row, quantity=0)])
    dump(src, "Empty221022.json", [])
    ingest_stream(spark, src, out, ck).awaitTermination()
    assert spark.read.parquet(out).count() == 1  # quantity 0 dropped
    dump(src, "Niki221105.json", [dict(row, price=70)])
    ingest_stream(spark, src, out, ck).awaitTermination()
    got = spark.read.parquet(out)
    assert got.count() == 2
    assert sorted(r["event_name"] for r in got.collect()) == ["AWOL", "Niki"]
