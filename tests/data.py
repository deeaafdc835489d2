from __future__ import annotations

import random

from conftest import event


def random_rows(seed, cases=6, longest=14, people="ABC", known=1.0, missing_times=False):
    """Events with time ties; with `known` below 1 parties are missing now and then."""
    rng = random.Random(seed)
    rows, order = [], 0
    for c in range(cases):
        for _ in range(rng.randint(1, longest)):
            elem = rng.choice(["task", "SendTask", "ReceiveTask", "ReceiveTask", "SendTask"])
            party = lambda: rng.choice(people) if rng.random() < known else None
            seconds = None if missing_times and rng.random() < 0.2 else rng.randint(0, 12)
            rows.append(event(f"c{c}", order, seconds, elem, party(),
                              party() if elem == "ReceiveTask" else None,
                              party() if elem == "SendTask" else None, rng.choice("xyz")))
            order += 1
    return rows
