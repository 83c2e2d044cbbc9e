"""Exact top-k, the prefix trie and fill-in-middle against brute force, with their edge cases."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from sparktally.llm import fim, prefix_trie, vafile

EXTRA = "x string, shard string, copies string, score string, n string, form string, conv string, block string, t1 string, depth string"


def frame(spark, rows, schema, parts=3):
    """Rows with further columns whose names the operators use themselves."""
    width = len(EXTRA.split(","))
    return spark.createDataFrame([(*r, *["?"] * width) for r in rows], f"{schema}, {EXTRA}").repartition(parts)


# ------------------------------------------------------------------------------------------------- fill-in-middle

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def fim_by_force(doc_id, text):
    text = text or ""
    units = UNIT.findall(text)
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if text == "" or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return len(units), "plain", None, None, text
    if h[3] % 100 < 80:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def odd_text(rng, n):
    return "".join(rng.choice("ab  \n\t\v\f\r\x00\x1c  é😀<>PSM") for _ in range(n))


def test_units_and_cuts_equal_the_pattern():
    rng = random.Random(1)
    for _ in range(400):
        text = odd_text(rng, rng.randint(0, 60))
        units = UNIT.findall(text)
        tree = fim.BlockTree(text, block=rng.choice([1, 2, 3, 7, 64]), at_once=rng.choice([1, 2, 5]))
        assert tree.n == len(units)
        assert [tree.cut(u) for u in range(len(units) + 1)] == [len("".join(units[:u])) for u in range(len(units) + 1)]


def test_fim(spark):
    rng = random.Random(2)
    rows = [(i, odd_text(rng, rng.randint(0, 80))) for i in range(300)]
    rows += [(400, None), (401, ""), (402, "   "), (403, "word " * 60_000), (None, "no id at all"), (404, "a <P> b"), rows[5], rows[5], (-7, "x y z <"), (405, "a" * 50_000)]
    got = fim.rearrange(frame(spark, rows, "doc_id long, text string")).withColumn("back", fim.restored()).collect()
    plain = {(r, fim_by_force(*r)) for r in rows}
    assert len(got) == len(rows)
    assert {((r.doc_id, r.text or None), (r.n, r.form, r.prefix_chars, r.middle_chars, r.output)) for r in got} == {((i, t or None), f) for (i, t), f in plain}
    assert all(r.back == r.text for r in got) and {r.form for r in got} == {"plain", "psm", "spm"}
    assert fim.rearrange(frame(spark, rows[:1], "doc_id long, text string").limit(0)).count() == 0


# ------------------------------------------------------------------------------------------------- exact top-k


MOST = 2**63 - 1


def top_by_force(rows, asks, k):
    ok = [(i, [math.floor(64 * float(x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for q, v in ok:
        if asks(q):
            best = sorted((-max(-MOST, min(MOST, sum(a * b for a, b in zip(v, w)))), i) for i, w in ok if i != q and len(w) == len(v))[:k]
            out |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(best)}
    return out


@pytest.mark.parametrize("shard_rows,k", [(16_384, 20), (13, 20), (40, 1), (13, 500)])
def test_topk(spark, shard_rows, k):
    rng = np.random.default_rng(5)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=8) * rng.choice([0.01, 0.3, 5])]) for i in range(180)]
    rows += [(200 + i, rows[7][1]) for i in range(30)] + [rows[9]] * 5  # ties, and one row again and again
    rows += [(300, None), (320, [1.0, None]), (340, [float("nan")] * 8), (360, [float("inf")] + [0.0] * 7), (None, [1.0] * 8), (380, []), (381, []), (400, [0.5, 0.25]), (401, [1.0, -1.0]), (-20, [0.1] * 8), (402, [0.0] * 8)]
    vectors = frame(spark, rows, "vec_id long, embedding array<float>")
    got = [tuple(r) for r in vafile.top(vectors, vectors.where("vec_id % 20 = 0"), k, shard_rows=shard_rows).collect()]
    assert len(got) == len(set(got)) or k > 100
    assert set(got) == top_by_force(rows, lambda q: q % 20 == 0, k)
    none = vectors.limit(0)
    assert vafile.top(none, none).count() == 0 and vafile.top(vectors, none).count() == 0 and vafile.top(none, vectors).count() == 0


def test_topk_beyond_double_precision(spark):
    rows = [(i, [1e9 + i, 1e9 - i, 3.0]) for i in range(20)] + [(40, [1e200, -1e200, 0.0]), (60, [1e200, 1e200, 1e200]), (61, [1e200, 1e200, 1.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {tuple(r) for r in vafile.top(vectors, vectors.where("vec_id % 20 = 0"), 4).collect()}
    assert got == top_by_force(rows, lambda q: q % 20 == 0, 4)


def test_topk_reads_few_exact_vectors():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(4000, 64))
    x = np.floor(64 * x / np.linalg.norm(x, axis=1, keepdims=True))
    file = vafile.Approximation(x)
    low, high = file.bounds(x[:20])
    exact = x[:20] @ x.T
    assert (low <= exact).all() and (exact <= high).all()
    found, read = vafile.search(file, np.arange(4000), np.ones(4000, int), x[:20], np.arange(20), 20)
    assert len(found) == 400 and read < 0.5 * 20 * 4000


# ------------------------------------------------------------------------------------------------- prefix trie


def trie_by_force(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append(((turn is not None, turn or 0), role or "", text or ""))
    own = {c: [t[1:] for t in sorted(v)] for c, v in own.items()}
    h = {c: zlib.crc32(str(c).encode()) % 6 for c in own}
    base = lambda c: c - int(math.fmod(c, 100))
    built = {c: tuple(own.get(base(c), [])[: h[c]] + own[c][h[c] :]) for c in own}
    members = {}
    for c, t in built.items():
        for d in range(len(t) + 1):
            members.setdefault(t[:d], []).append(c)
    out = set()
    for path, m in members.items():
        sub = [p for p in members if p[: len(path)] == path]
        kids = lambda p: sum(len(q) == len(p) + 1 and q[: len(p)] == p for q in sub)
        ends = ",".join(str(c) for c in sorted(c for c in m if len(built[c]) == len(path)))
        saved = sum((len(members[p]) - 1) * len(p[-1][1]) for p in sub if p)
        parent = min(members[path[:-1]]) if path else None
        out.add((min(m), len(path), parent, len(m), kids(path), sum(kids(p) == 0 for p in sub), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


def built(df):
    return prefix_trie.trie(prefix_trie.with_openings(prefix_trie.turns_of(df)))


@pytest.mark.parametrize("seed", [1, 2])
def test_trie(spark, seed):
    rng = random.Random(seed)
    rows = []
    for c in [*range(0, 12), *range(100, 112), *range(250, 262), -3, -150, -100, 10**12 + 1]:
        for turn in range(rng.choice([1, 2, 4, 7, 8, 9, 16, 17, 20])):
            rows.append((c, turn, rng.choice(["user", "user", None]), rng.choice(["a", "bé", "", None] if turn > 9 else ["a", "a", "a", "b😀"])))
    rows += [(500 + c, t, "user", "same" * 3) for c in range(40) for t in range(10)]  # a hot group of copies
    rows += [(700, None, "user", "first"), (700, 0, None, None), (700, 0, None, None), (700, 0, "user", "a"), (None, 1, "user", "lost"), (701, 5, "user", None)]
    rng.shuffle(rows)
    got = built(frame(spark, rows, "conv_id long, turn long, role string, text string")).collect()
    want = trie_by_force(rows)
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_trie_of_one_long_conversation_and_of_none(spark):
    rows = [(c, t, "user", "abc"[: t % 4]) for c in (1, 102) for t in range(120)]
    df = frame(spark, rows, "conv_id long, turn long, role string, text string")
    assert {tuple(r) for r in built(df).collect()} == trie_by_force(rows)
    assert built(df.limit(0)).count() == 0
    gone = next(c for c in range(1000, 2000) if zlib.crc32(str(c).encode()) % 6 > 2 and c % 100)
    assert {tuple(r)[:7] for r in built(frame(spark, [(gone, 1, "user", "x")], "conv_id long, turn long, role string, text string")).collect()} == {(gone, 0, None, 1, 0, 1, 0)}
