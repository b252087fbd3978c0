"""The reference workload: rows of (id, state, criterion) of which about a tenth are distinct, some without state or criterion."""

import random

# Fixed values of the workload.
SEED, NULL_STATES, NULL_CRITERIA, EDGE = 20260923, 0.03, 0.02, 2048
CRITERIA = ["is the value high?", "is the value low?", "is the value stable?", "is the value rising?"]
#: rows: (valid rows, distinct judgments)
EXPECTED = {1_000: (956, 100), 10_000: (9_522, 1_001), 100_000: (95_080, 9_999)}


def workload(n):
    rng, pool = random.Random(SEED + n), max(1, n // 10)
    text = lambda k: f"{k / max(1, pool - 1):.6f}"
    rows = []
    for i in range(n):
        k = rng.randrange(pool)
        state = None if rng.random() < NULL_STATES else text(k)
        criterion = None if rng.random() < NULL_CRITERIA else CRITERIA[k % 4]
        rows.append((i, state, criterion))
    if n > EDGE:  # two equal rows on both sides of a chunk's edge, half way
        edge = n // 2 // EDGE * EDGE
        for i in (edge - 1, edge):
            rows[i] = (i, "0.500000", CRITERIA[0])
    return rows
