import numpy as np
import pytest

from clonoscape.functions.residues import ALPHABET
from clonoscape.operators import loops

COST = loops.costs()


def cost(a, b):
    return sum(int(COST[ord(x), ord(y)]) for x, y in zip(a, b, strict=True))


def third(a, b):
    x, y = sorted((a, b), key=len)
    s, l = len(x), len(y)
    if s == l:
        return 3 * cost(x[3:-2], y[3:-2])
    low, high = 5, s - 5
    while low > high:
        low, high = low - 1, high + 1
    tries = []
    for g in range(low, high + 1):
        tries.append(cost(x[3:g], y[3:g]) + sum(int(COST[ord(x[s - 1 - c]), ord(y[l - 1 - c])]) for c in range(2, s - g)))
    return 3 * (min(tries) + 4 * (l - s))


def receptors(seed, n):
    rng = np.random.default_rng(seed)
    letters = list(ALPHABET)
    genes = {f"V{i}": ("".join(rng.choice(letters, 3)) + "AGS-"[: 3 + i % 2], "DE" + "".join(rng.choice(letters, 1 + i // 2))) for i in range(5)}
    out = []
    while len(out) < n:
        core = "".join(rng.choice(letters, int(rng.integers(4, 10))))
        for _ in range(4):
            at = int(rng.integers(0, len(core)))
            change = rng.integers(0, 4)
            s = core[:at] + (core[at + 1 :] if change == 0 else str(rng.choice(letters)) + core[at + (change > 1) :])
            out.append((len(out), f"V{rng.integers(0, 5)}" if rng.random() < 0.6 else "V0", "CAS" + s + "QYF"[: int(rng.integers(1, 4))]))
    return genes, out


@pytest.mark.parametrize("radius", [50, 24, 7])
def test_pairs_within_radius(spark, radius):
    genes, rows = receptors(radius, 160)
    odd = [(900, "V0", None), (901, None, "CASSLEQYF"), (902, "other", "CASSLEQYF"), (903, "V0", "CASSL"), (None, "V0", "CASSLEQYF"), (904, "V1", "CASXBZEQYF"), (905, "V0", rows[0][2])]
    df = spark.createDataFrame(rows + odd, "id long, v string, s string").repartition(4)
    table = spark.createDataFrame([(k, *v) for k, v in genes.items()], "name string, c1 string, c2 string")
    got = {(r["i"], r["j"]): r["d"] for r in loops.loop_neighbours(df, "id", "v", "s", table, "name", ["c1", "c2"], radius).collect()}
    want = {}
    known = [r for r in rows + odd if r[0] is not None and r[1] in genes and r[2] and len(r[2]) >= 6]
    for k, (i, v, s) in enumerate(known):
        for j, w, t in known[k + 1 :]:
            x, y = "".join(genes[v]), "".join(genes[w])
            if len(x) == len(y) and (d := cost(x, y) + third(s, t)) <= radius:
                want[min(i, j), max(i, j)] = d
    assert got == want and len(want) > 3


def test_classes_cost_at_least_what_is_said():
    of = loops.classes()
    across = [COST[ord(a), ord(b)] for a in ALPHABET for b in ALPHABET if of[a] != of[b]]
    assert min(across) == loops.LEAST_CROSS and len(set(of.values())) > 8


def test_signatures_leave_out_most_pairs(spark):
    """Receptors of unlike loops seldom meet: what is compared is a fraction of all pairs."""
    genes, rows = receptors(1, 40)
    rng = np.random.default_rng(2)
    rows = [(i, "V0", "CASS" + "".join(rng.choice(list(ALPHABET), 7)) + "QYF") for i in range(400)]
    df = spark.createDataFrame(rows, "id long, v string, s string")
    table = spark.createDataFrame([("V0", "AAA")], "name string, c1 string")
    plan = loops.loop_neighbours(df, "id", "v", "s", table, "name", ["c1"], 24)
    assert plan.count() < 400
