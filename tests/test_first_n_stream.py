"""The first n accepted of a stream against the batch rule, with late and repeated attempts over several batches."""

import json
import random
import tempfile

from cohortkit.operators import validate as V
from cohortkit.streaming.first_n import changes, first_n_stream, settled

OK = {"receipt_id": "L1", "customer_id": "C", "store_name": "MegaMart", "store_location": "Uptown", "receipt_datetime": "2025-04-07T10:00:00",
      "subtotal": 1, "tax": 0, "total_amount": 1, "items": [{"item_name": "Milk", "category": "Dairy", "quantity": 2, "unit_price": 1.5, "item_total": 3.0}]}


def test_changes():
    assert changes([], [5, 3, 9], 2) == ([3, 5], [3, 5], [])
    assert changes([3, 5], [1, 5, 7], 2) == ([1, 3], [1], [5])
    assert changes([3, 5], [], 2) == ([3, 5], [], [])


def test_equals_the_batch(spark):
    rnd = random.Random(7)
    n = 6
    responses = []
    for stream in ("a", "b", "short"):
        for attempt in range(1, 30 if stream != "short" else 4):
            responses.append((stream, attempt, json.dumps(OK) if rnd.random() < 0.6 else "nope"))
    rnd.shuffle(responses)  # late attempts come in later batches
    responses += responses[:8]  # a file delivered twice
    src, out, ckpt = (tempfile.mkdtemp(prefix=p, dir="/tmp") for p in ("src-", "out-", "ckpt-"))
    size = 20

    def deliver(k):
        with open(f"{src}/part-{k:03d}.json", "w") as f:
            f.writelines(json.dumps({"stream": s, "attempt": a, "raw": r}) + "\n" for s, a, r in responses[k * size:(k + 1) * size])

    schema = "stream string, attempt long, raw string"

    def run():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", "1").json(src)
        q = first_n_stream(stream, n, out, ckpt)
        q.awaitTermination(150)
        assert q.exception() is None

    for k in range(2):
        deliver(k)
    run()
    for k in range(2, -(-len(responses) // size)):  # the query goes on from its checkpoint
        deliver(k)
    run()
    written = spark.read.parquet(out)
    assert written.where("NOT kept").count() > 0
    got = sorted((r["stream"], r["attempt"]) for r in settled(written).collect())
    want = []
    for s in ("a", "b", "short"):
        rows = {(a, r) for x, a, r in responses if x == s}
        batch = V.parse_responses(spark.createDataFrame(sorted(rows), "attempt long, raw string"))
        want += [(s, r["attempt"]) for r in V.first_n_accepted(batch, n).collect()]
    assert got == sorted(want)
