"""The validator on a stream: availableNow over response files, one output folder per batch."""

import json
import tempfile

from cohortkit.streaming import validate_stream


def test_stream_validation(spark):
    src, out, ckpt = (tempfile.mkdtemp(prefix=p, dir="/tmp") for p in ("src-", "out-", "ckpt-"))
    ok = json.dumps({"receipt_id": "L1", "customer_id": "C", "store_name": "MegaMart", "store_location": "Uptown",
                     "receipt_datetime": "2025-04-07T10:00:00", "subtotal": 1, "tax": 0, "total_amount": 1,
                     "items": [{"item_name": "Milk", "category": "Dairy", "quantity": 2, "unit_price": 1.5,
                                "item_total": 3.0}]})
    for i, raw in enumerate([ok, "", "nope", ok]):
        with open(f"{src}/part-{i}.json", "w") as f:
            f.write(json.dumps({"attempt": i + 1, "raw": raw}) + "\n")
    q = validate_stream(spark, src, out, ckpt, max_files_per_trigger=2)
    q.awaitTermination(120)
    outcome = spark.read.parquet(f"{out}/outcome")
    assert outcome.count() == 4
    assert outcome.filter("accepted").count() == 2
    assert spark.read.parquet(f"{out}/items").count() == 2
