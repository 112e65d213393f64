"""Realignment of many rows at a time against that of single rows."""

import random

import pytest

from tabweave.operators.profile import Profile
from tabweave.operators.realign import RealignOptions, check_row, check_rows, score_text, score_values

PROFILES = {
    "id": Profile("integer", numeric_range=(1, 1000)),
    "mail": Profile("string", patterns=("isEmail",), null_rate=0.2),
    "state": Profile("string", enum_values=("open", "closed", "new")),
    "day": Profile("date", patterns=("isDate",)),
    "price": Profile("number", numeric_range=(0.0, 99.5), null_rate=0.1),
    "note": Profile("string", null_rate=0.5),
    "flag": Profile("boolean", enum_values=tuple(f"v{i}" for i in range(12))),
    "any": Profile("mixed"),
}
VALUES = [None, "", " ", "17", " 400 ", "-3.25", "1e5", "99999999", "a@b.org", "open", "Closed", "closed", "new", "2021-05-06", "5/6/2021", "2021-05-06T10:00", "yes", "v3", "some words", "+49 30 1234567", "12 %", "é"]


def rows_of(seed, n, names):
    rng = random.Random(seed)
    good = {"id": "17", "mail": "a@b.org", "state": "open", "day": "2021-05-06", "price": "-3.25", "note": "some words", "flag": "yes", "any": "x"}
    out = []
    for _ in range(n):
        row = [good.get(c, rng.choice(VALUES)) for c in names]
        k = rng.randrange(5)
        if k == 1:
            p, s = rng.randrange(len(row)), rng.choice([-2, -1, 1, 2])
            row = row[:p] + [row[i - s] if p <= i - s < len(row) else None for i in range(p, len(row))]
        elif k == 2 and len(row) > 1:
            for _ in range(rng.randint(1, 3)):
                a, b = rng.sample(range(len(row)), 2)
                row[a], row[b] = row[b], row[a]
        elif k == 3:
            row = [rng.choice(VALUES) for _ in row]
        out.append([rng.choice(VALUES) if rng.random() < 0.1 else v for v in row])
    return out


@pytest.mark.parametrize("seed", range(10))
def test_many_rows_are_as_single_ones(seed):
    rng = random.Random(seed)
    names = rng.sample(list(PROFILES), rng.randint(2, 8)) + ["unknown"] * (seed % 2)
    profiles = [PROFILES.get(c) for c in names]
    options = RealignOptions() if seed % 3 else RealignOptions(max_shift=rng.randint(0, 3), swaps=seed != 6, swap_candidates=rng.randint(2, 6), swap_rounds=rng.randint(1, 3), aligned=0.9)
    rows = rows_of(seed, 10_000, names)
    found = check_rows(list(zip(*rows, strict=True)), names, profiles, options)
    kinds = set()
    for r, row in enumerate(rows):
        want = check_row(row, names, profiles, options)
        kinds.add(want["kind"])
        got = {k: found[k][r] for k in want}
        got["swaps"], got["places"] = [tuple(x) for x in got["swaps"]], list(got["places"])
        want["places"] = want["places"] if want["kind"] == "realigned" else list(range(len(names)))
        assert got == want, row
    assert len(kinds) > 1


def test_scores_of_values():
    profiles = [*PROFILES.values(), None, Profile("string", patterns=("isEmail", "isUrl")), Profile("datetime"), Profile("integer", numeric_range=(5, 5))]
    got = score_values(VALUES, profiles)
    assert got.tolist() == [[0 if p is None else score_text(v, p) for p in profiles] for v in VALUES]


def test_no_rows():
    found = check_rows([[], []], ["id", "mail"], [PROFILES["id"], PROFILES["mail"]], RealignOptions())
    assert all(len(found[k]) == 0 for k in ("kind", "swaps", "reason", "places"))
