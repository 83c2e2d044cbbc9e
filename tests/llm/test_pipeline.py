"""The pipeline against brute force on a small table, and its registration."""

import hashlib
import random
import re
import zlib

import pytest

import __spark_entry__ as entry
import corpus_pipeline

from .test_ops import WORD, cuts_by_force, groups, targets_by_force, words


def simhash_by_force(text):
    import xxhash

    w = re.findall(rb"[^\x20\x09-\x0D]+", text.encode().lower())
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(21)
    own = {"en": "theandwhorly", "fr": "éèçauoile", "de": "schungßäpf"}
    items = [(i, words(rng, 25, "theandwhorly")) for i in range(4)]
    docs = [(i, words(rng, rng.randint(5, 120), own[lang]), lang, f"s{i % 3 if i % 4 else 0}") for i in range(120) for lang in [list(own)[i % 3]]]
    docs += [(200 + i, words(rng, 30, own["en"]) + " " + t + " " + words(rng, 20, own["en"]), "en", "s1") for i, t in items]
    docs += [(300 + i, docs[6][1], "en", "s2") for i in range(5)]
    long = words(rng, 700, own["en"])
    docs += [(400 + i, f"{long} {'end' * i}", "en", "s0") for i in range(4)]
    docs += [(500, "12345 !!", "en", "s0"), (501, "", "en", "s0"), (502, None, "en", "s1")]
    folder = str(tmp_path_factory.mktemp("tables"))
    rows = [(*r, len(r[1] or "")) for r in docs]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, docs, items


def by_force(docs, items):
    """The documents that the first three stages keep, then each copy that the mix takes."""
    kept = [r for r in docs if re.search(r"[^\W\d_]", r[1] or "")]
    fps = {r[0]: simhash_by_force(r[1]) for r in kept}
    label = groups(set(fps.values()), 3)
    least = {}
    for i, f in fps.items():
        least[label[f]] = min(least.get(label[f], i), i)
    kept = [r for r in kept if least[label[fps[r[0]]]] == r[0]]
    kept = [r for r in kept if not any(t in r[1] for _, t in items)]
    size = {r[0]: len(re.findall(WORD, r[1])) for r in kept}
    of = {}
    for r in kept:
        of[r[3]] = of.get(r[3], 0) + size[r[0]]
    target, out = targets_by_force(of), []
    for s in of:
        at, epochs = 0, round(target[s]) // of[s]
        rest = round(target[s]) - epochs * of[s]
        for r in sorted((r for r in kept if r[3] == s), key=lambda r: hashlib.md5(str(r[0]).encode()).hexdigest()):
            out += [(r[0], r[1])] * epochs
            n = min(size[r[0]], max(0, rest - at))
            if n:
                out.append((r[0], r[1] if n == size[r[0]] else "".join(re.findall(r"[\x20\x09-\x0D]*" + WORD, r[1])[:n])))
            at += size[r[0]]
    return kept, out


def test_stages(spark, tables):
    folder, docs, items = tables
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language", "near_dedup", "decontaminate", "mixing", "sharding"]
    kept, copies = by_force(docs, items)
    got = spark.read.parquet(f"{folder}/documents.parquet")
    columns = got.columns
    for _, stage in corpus_pipeline.STAGES[:3]:
        got = stage(spark, got, folder)
        assert got.columns == columns
    assert sorted(r.doc_id for r in got.collect()) == sorted(r[0] for r in kept)
    final = corpus_pipeline.run(spark, folder).collect()
    assert sorted((r.doc_id, r.text) for r in final) == sorted(copies)
    assert all(r.n_chars == len(r.text) for r in final)
    loads, slots, of = {}, {}, {}
    for r in final:
        loads[r.shard] = loads.get(r.shard, 0) + len(r.text.encode()) + 8
        slots.setdefault(r.shard, []).append(r.slot)
        of.setdefault(r.text, set()).add(r.shard)
        assert r.text_crc32 == zlib.crc32(r.text.encode())
    sizes = {}
    for _, t in copies:
        k = hashlib.md5(t.encode()).hexdigest()
        sizes[k] = sizes.get(k, 0) + len(t.encode()) + 8
    assert max(loads.values()) == cuts_by_force([sizes[k] for k in sorted(sizes)], 24)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and all(len(x) == 1 for x in of.values())


def test_run_says_what_the_model_found(spark, tables):
    from sparktally.llm.langid import op1_langid

    folder, docs, _ = tables
    lang = {r[0]: r[2] for r in docs}
    told = {r.doc_id: (r.lang_pred, round(r.score, 6)) for r in op1_langid(spark, folder).collect()}
    final = corpus_pipeline.run(spark, folder).collect()
    assert final and all((r.lang, r.lang_pred, r.lang_score) == (lang[r.doc_id], *told[r.doc_id]) for r in final)


def test_empty_table(spark, tables, tmp_path):
    folder, *_ = tables
    spark.read.parquet(f"{folder}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{folder}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_registered():
    names = entry.queries()
    assert "pipeline" in names and {int(re.match(r"op(\d+)_", n)[1]) for n in names if n.startswith("op")} == set(range(1, 14))


def test_edge_rows_and_clashing_columns(spark, tables, tmp_path):
    """Null ids, shared ids, repeated rows, long texts, and columns named like those that stages use."""
    rng = random.Random(22)
    text = lambda n: words(rng, n, "theandwhorly")
    own = {"a": text(30), "b": text(30), "c": text(30), "long": text(9000)}
    rows = [(None, own["a"], "s0"), (7, own["b"], "s1"), (7, own["c"], "s1"), (8, own["b"], "s1"), (8, own["b"], "s1"), (9, own["long"], "s2"), (10, None, "s0"), (11, "", None), (12, "1 2 3", "s0")]
    rows += [(20 + i, text(25), f"s{i % 3}") for i in range(12)]
    extra = "target string, shard int, slot string, row string, key string, component string, near_row string, mix_row string, epoch string, code int"
    data = [(i, t, "en", s, len(t or ""), *["x", 3, *["y"] * 7, 5]) for i, t, s in rows]
    schema = f"doc_id long, text string, lang string, source string, n_chars long, {extra}"
    folder = str(tmp_path)
    spark.createDataFrame(data, schema).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.read.parquet(f"{tables[0]}/benchmark.parquet").write.parquet(f"{folder}/benchmark.parquet")
    got = spark.read.parquet(f"{folder}/documents.parquet")
    columns = got.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, got, folder)
        assert got.columns == columns, name
        got.write.parquet(f"{folder}/{name}")
        got = spark.read.parquet(f"{folder}/{name}")
    kept = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/near_dedup").collect()]
    assert sorted(kept, key=repr) == sorted([(None, own["a"]), (7, own["b"]), (7, own["c"]), (9, own["long"]), *[(i, t) for i, t, _ in rows[9:]]], key=repr)
    assert {(r.target, r.shard, r.row) for r in got.collect()} == {("x", 3, "y")}
    last = corpus_pipeline.STAGES[-1][1](spark, got, folder).collect()
    assert len(last) == got.count() and {r.target for r in last} == {"x"} and all(0 <= r.shard < 24 for r in last)
