import random

from threadloom.operators import delivery_dedup as dd

SCHEMA = "delivery_id long, received_at timestamp, pubsub_message_id string, push_body string, pubsub_message_id_extra string"


def rows(n=400, seed=3):
    rng = random.Random(seed)
    import datetime as dt

    out = []
    for i in range(n):
        kind = rng.random()
        ident = str(910_000_000_000_000_000 + rng.randrange(60)) if kind < 0.6 else rng.choice(["abc", "007", "x" * 40, "", None])
        if kind > 0.95:
            ident = "910000000000000001"  # one identifier with many copies
        body = None
        if ident is None and rng.random() < 0.7:
            body = rng.choice(['{"message":{"messageId":"910000000000000003"}}', '{"message":{"message_id":"abc"}}', "<timeout>", "{}", ""])
        at = None if rng.random() < 0.05 else dt.datetime(2032, 1, 1) + dt.timedelta(seconds=rng.randrange(30))
        out.append((i, at, ident, body, "x"))
    return out


def brute(data):
    import json

    best, keyed = {}, {}
    for i, at, ident, body, _ in data:
        key = ident or None
        if key is None and body:
            try:
                m = json.loads(body).get("message", {})
                key = m.get("messageId") or m.get("message_id")
            except ValueError:
                key = None
        if key:
            keyed[i] = key
            mark = (at is None, at, i) if at else (True, i)
            mark = (at is None, str(at), i)
            if key not in best or mark < best[key]:
                best[key] = mark
    return {i for i, k in keyed.items() if best[k][2] != i}


def test_matches_brute_force_for_any_number_of_batches(spark):
    data = rows()
    df = spark.createDataFrame(data, SCHEMA)
    for slices in (1, 2, 4):
        accepted, repeats, state = dd.deduplicate(df, slices)
        assert {r[0] for r in repeats.select("delivery_id").collect()} == brute(data)
        keys = [r[0] for r in accepted.select("message_key").collect()]
        assert len(keys) == len(set(keys))
    for r in state.ranges.collect():
        spans = r["ranges"]
        assert all(a["hi"] + 1 < b["lo"] for a, b in zip(spans, spans[1:]))


def test_later_batch_against_state(spark):
    first = spark.createDataFrame([(1, None, "910000000000000001", None, ""), (2, None, "odd", None, "")], SCHEMA)
    second = spark.createDataFrame([(3, None, "910000000000000001", None, ""), (4, None, "910000000000000002", None, ""), (5, None, "odd", None, "")], SCHEMA)
    a, _ = dd.accept(dd.keyed(first), dd.SeenState.empty(spark))
    state = dd.advance(dd.SeenState.empty(spark), a)
    b, again = dd.accept(dd.keyed(second), state)
    assert [r[0] for r in b.select("delivery_id").collect()] == [4]
    assert sorted(r[0] for r in again.select("delivery_id").collect()) == [3, 5]
    merged = dd.advance(state, b).ranges.collect()
    assert [(x["lo"], x["hi"]) for r in merged for x in r["ranges"]] == [(1, 2)]


def test_empty(spark):
    accepted, repeats, _ = dd.deduplicate(spark.createDataFrame([], SCHEMA))
    assert accepted.count() == 0 and repeats.count() == 0
