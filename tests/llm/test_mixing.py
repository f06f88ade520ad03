import hashlib
from collections import defaultdict

import pytest

from tessera.llm import mixing as m


def fill(budget, children):
    """Water filling in exact numbers: children are (name, cap, weight)."""
    out, rest = {}, sorted(children, key=lambda c: (c[1] / c[2], c[0]))
    while rest:
        total = sum(c[2] for c in rest)
        name, cap, w = rest[0]
        if cap * total <= budget * w:
            out[name], budget = cap, budget - cap
            rest = rest[1:]
        else:
            return out | {n: min(c, budget * w // total) for n, c, w in rest}
    return out


def brute(rows, share, epochs, weights, seed=m.SEED):
    tokens = defaultdict(int)
    for _, path, n in rows:
        tokens[path] += n
    weigh = lambda level, name: weights.get(level, {}).get(name, m.DEFAULT_WEIGHT)
    found = {(): sum(tokens.values()) * share[0] // share[1]}
    for depth, level in enumerate(m.LEVELS):
        now = {}
        for parent, budget in found.items():
            caps = defaultdict(int)
            for path, n in tokens.items():
                if path[:depth] == parent:
                    caps[path[: depth + 1]] += n * epochs
            now |= fill(budget, [(p, c, weigh(level, p[-1])) for p, c in caps.items()])
        found = now
    out = []
    for path, budget in found.items():
        if not tokens[path] or not budget:
            continue
        whole, rest = divmod(budget, tokens[path])
        own = [(hashlib.md5(f"{seed}:{whole}:{'null' if k is None else k}".encode()).hexdigest(), k, n) for k, p, n in rows if p == path]
        for h, k, n in own:
            upto = sum(x for g, _, x in own if g <= h)
            out += [(k, *path, n, e) for e in range(whole + (upto <= rest))]
    return sorted(map(str, out)), found


@pytest.mark.parametrize("share,epochs", [((4, 5), 2), ((1, 3), 1), ((3, 1), 2), ((2, 1), 3)])
def test_against_brute_force(spark, share, epochs):
    rows = []
    for k in range(600):
        path = (f"dom{k % 3}", ["en", "de", "fr"][k * 7 % 3 if k % 5 else 0], f"src{k * k % 7}")
        rows.append((k // 2 * 2 if k % 50 == 0 else k, path, (k * 37) % 90))
    df = spark.createDataFrame([(k, *p, n, 1) for k, p, n in rows], "doc_id long, domain string, lang string, source string, tokens long, extra int")
    got = m.chosen(df, share=share, epochs=epochs).select("doc_id", *m.LEVELS, "tokens", "epoch").collect()
    want, _ = brute(rows, share, epochs, m.WEIGHTS)
    assert sorted(str(tuple(r)) for r in got) == want


def test_shortage_goes_to_siblings_first(spark):
    leaves = [("d0", "en", "a", 100), ("d0", "en", "b", 5000), ("d1", "en", "c", 5000)]
    df = spark.createDataFrame(leaves, "domain string, lang string, source string, tokens long")
    got = {r.source: r.budget for r in m.budgets(df, {}, share=(4000, 10100), epochs=1).collect()}
    assert got == {"a": 100, "b": 1900, "c": 2000}


def test_frames(spark):
    rows = [(1, None, None, None), (None, "a b c " * 20, "en", "s"), (2, "", "en", "s"), (3, "x y", None, "src1"), (3, "x y", None, "src1")] + [(k, "p q r " * k, "de", "src2") for k in range(30)]
    df = spark.createDataFrame([(*r, 9) for r in rows], "doc_id long, text string, lang string, source string, tokens int")
    got = m.mix_documents(df).collect()
    assert got and all(r.epoch in (0, 1) for r in got)
    assert m.mix(df).columns == df.columns and m.mix(df).count() == len(got)
    assert m.mix_documents(df.limit(0)).count() == 0


def test_border_cut_again_until_few(spark):
    rows = [(k // 3, ("dom0", "en", f"src{k % 2}"), k * 31 % 17) for k in range(3000)]
    df = spark.createDataFrame([(k, *p, n) for k, p, n in rows], "doc_id long, domain string, lang string, source string, tokens long")
    got = m.chosen(df, share=(1, 2), epochs=1, few=0).select("doc_id", *m.LEVELS, "tokens", "epoch").collect()
    assert sorted(str(tuple(r)) for r in got) == brute(rows, (1, 2), 1, m.WEIGHTS)[0]
