#: Columns that operators use inside, as strangers to them.
CLASH = ["block", "bucket", "node", "keys", "text_hash", "part", "place", "_at", "_read", "copies", "size", "n_words", "kept", "_row", "w", "h", "item_id", "start", "grade", "_id", "_label"]


def prose(rng, n, vocabulary=400):
    return [f"w{int(vocabulary * rng.random() ** 2)}" for _ in range(n)]


def bag(rows):
    from collections import Counter

    return Counter(map(tuple, rows))
