"""A feed of two shards for the tests; every second call fails at first."""

CALLS = {"n": 0}


def fetch(shard, cursor, size):
    CALLS["n"] += 1
    if CALLS["n"] % 2:
        raise ConnectionError
    start = int(cursor or 0)
    rows = [{"id": f"{shard}-{i}", "status": "ACTIVE"} for i in range(start, min(start + size, 7))]
    return rows, str(start + size) if start + size < 7 else None
