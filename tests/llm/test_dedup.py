"""Exact and near duplicates against brute force and SQL."""

import hashlib
import re
import tracemalloc
from fractions import Fraction

import duckdb
import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lorekeep.llm import op2_ngram_join as op2
from lorekeep.llm import op9_exact_dedup as op9
from lorekeep.llm.common import batch_bytes
from lorekeep.llm.components import components
from lorekeep.llm.shingles import shingle_sets

from .conftest import prose


def norm(text):
    return re.sub(r"[\x20\x09-\x0d]+", " ", text or "")


def brute_exact(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(norm(t), []).append(i)
    out, seen = [], set()
    for i, t in rows:
        g = groups[norm(t)]
        keep = min((x for x in g if x is not None), default=None)
        first = i == keep and norm(t) not in seen
        if first:
            seen.add(norm(t))
        out.append((str(i), str(keep), len(g), first, hashlib.sha256(norm(t).encode()).hexdigest()))
    return sorted(out)


def exact(df):
    return sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.kept, r.text_sha256) for r in df.collect())


def near_copies():
    rows = [(100 + i, prose(120, 50)) for i in range(3)]
    base = prose(120, 51).split()
    for i in range(12):
        own = list(base)
        own[i * 9] = f"changed{i}"
        rows.append((200 + i, " ".join(own)))
    rows += [(300 + i, prose(60, 60 + i) + " " + prose(70, 59)) for i in range(8)]  # a shared passage
    return rows


def test_exact_dedup(spark, documents, odd_rows):
    rows = odd_rows + near_copies() + [(20, " a  b"), (21, " a\tb"), (22, "a b"), (7, prose(20_000, 3))]
    docs = documents(rows)
    assert exact(op9.exact_dedup(docs)) == brute_exact(rows)
    # hashes that collide change nothing
    for few in (2, 1000):
        clash = lambda c, few=few: F.pmod(F.xxhash64(c), F.lit(few))
        assert exact(op9.exact_dedup(docs, hash_of=lambda c: clash(c))) == brute_exact(rows)
    assert op9.exact_dedup(docs.limit(0)).count() == 0
    kept = op9.keep_first(docs)
    assert kept.columns == docs.columns
    assert sorted(norm(r.text) for r in kept.collect()) == sorted({norm(t) for _, t in rows})
    assert op9.keep_first(docs.limit(0)).count() == 0


def test_more_collisions_than_a_list_holds(documents, monkeypatch):
    monkeypatch.setattr(op9, "MOST_COLLISIONS", 0)
    rows = near_copies()
    assert exact(op9.exact_dedup(documents(rows), hash_of=lambda c: F.pmod(F.xxhash64(c), F.lit(2)))) == brute_exact(rows)


@settings(max_examples=30, deadline=None)
@given(st.text(st.sampled_from("aent \t\n"), max_size=40))
def test_white_space_runs(text):
    java = re.sub(op9.RUN, " ", text)
    assert java == norm(text)


def test_exact_dedup_is_native(documents, odd_rows):
    plan = op9.exact_dedup(documents(odd_rows))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def words(text):
    return re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def shingles(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute_near(rows, similarity=Fraction(4, 5), classes=False):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    members = {}
    for k in range(len(rows)):
        members.setdefault(find(k), []).append(rows[k][0])
    if classes:
        return sorted(min(i for i in m if i is not None) for k, m in members.items() if sets[k] and any(i is not None for i in m))
    return sorted((str(rows[k][0]), len(sets[k]), str(min((i for i in members[find(k)] if i is not None), default=None))) for k in range(len(rows)))


def near(df):
    return sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in df.collect())


def test_near_duplicates(spark, documents, odd_rows):
    rows = odd_rows + near_copies() + [(i, prose(9, 500 + i // 2) + (" x" if i % 2 else "")) for i in range(30, 60)]
    docs = documents(rows)
    assert near(op2.jaccard_components(docs)) == brute_near(rows)
    assert near(op2.jaccard_components(docs, similarity=Fraction(9, 10))) == brute_near(rows, Fraction(9, 10))
    assert op2.jaccard_components(docs.limit(0)).count() == 0
    kept = op2.keep_first(docs)
    assert kept.columns == docs.columns
    got = [r.doc_id for r in kept.collect() if shingles(r.text) and r.doc_id is not None]
    assert sorted(got) == brute_near(rows, classes=True)  # one row of each component
    assert op2.keep_first(docs.limit(0)).count() == 0


def test_all_sets_light_or_heavy(documents, monkeypatch):
    rows = near_copies()
    for boundary in (0, 10_000):
        monkeypatch.setattr(op2, "choose_boundary", lambda *a, b=boundary: b)
        assert near(op2.jaccard_components(documents(rows))) == brute_near(rows)


def test_keys_that_no_map_holds(documents, odd_rows, monkeypatch):
    monkeypatch.setattr(op2, "MAP_BITS", (1, 2))
    rows = odd_rows + near_copies()
    assert near(op2.jaccard_components(documents(rows).repartition(3))) == brute_near(rows)
    assert op2.jaccard_components(documents(rows).limit(0)).count() == 0


def test_copies_share_no_key(documents, monkeypatch):
    """Copies in many tasks are one node: only sets that may link with a different one are written and moved."""
    rows = [(i, prose(60, 900 + i % 40)) for i in range(400)] + [(500, prose(60, 900) + " x")]
    moved = []
    links = op2.links
    monkeypatch.setattr(op2, "links", lambda sets, postings, s: moved.append((sets.select("node").distinct().count(), postings.select("node").distinct().count())) or links(sets, postings, s))
    assert near(op2.jaccard_components(documents(rows).repartition(8))) == brute_near(rows)
    assert moved == [(2, 2)]


def test_near_duplicates_equal_sql(spark):
    path = "/root/testdata/sf0.001/documents.parquet"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}'")
    want = sorted((str(a), n, str(c)) for a, n, c in con.sql(op2.ORACLE).fetchall())
    assert near(op2.jaccard_components(spark.read.parquet(path))) == want


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(st.sampled_from("aAbÄ \t\n\x0b"), max_size=60)), max_size=6))
def test_shingle_counts(texts):
    found = shingle_sets(texts)
    assert [len(s) for s in found] == [len(shingles(t)) for t in texts]
    for a, t in zip(found, texts):
        for b, u in zip(found, texts):
            assert len(np.intersect1d(a, b)) == len(shingles(t) & shingles(u))


def test_shingles_of_long_texts_in_little_memory(monkeypatch):
    text = prose(200_000, 21)
    texts = [text, None, "x" * 300, "one two", text[:900_000]]
    shingle_sets(["warm"])
    tracemalloc.start()
    sets = shingle_sets(texts)
    peak = tracemalloc.get_traced_memory()[1] - sum(s.nbytes for s in sets)
    tracemalloc.stop()
    assert peak < 24 * sum(len(t or "") for t in texts)
    monkeypatch.setattr("lorekeep.llm.shingles.AT_ONCE", 100)
    assert all(np.array_equal(a, b) for a, b in zip(sets, shingle_sets(texts), strict=True))


def test_batches_sent_to_python_are_of_bounded_bytes(spark, documents, monkeypatch):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before, seen, write = spark.conf.get(key), [], op2.materialise

    def watched(df):
        if "MapInArrow" in df._jdf.queryExecution().executedPlan().toString():
            seen.append(spark.conf.get(key))
        return write(df)

    monkeypatch.setattr(op2, "materialise", watched)
    op2.jaccard_components(documents([(i, prose(60, i // 3)) for i in range(30)])).collect()
    assert len(seen) >= 3 and set(seen) == {op2.BATCH} and spark.conf.get(key) == before

    rows = spark.range(0, 64, 1, 1).select(F.repeat(F.lit("x"), 1 << 20).alias("text"))
    size = lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["n"]) for b in batches)
    with batch_bytes(spark, op2.BATCH):
        assert max(r["n"] for r in rows.mapInArrow(size, "n long").collect()) < 9 << 20
        with batch_bytes(spark, "1g"):
            assert spark.conf.get(key) == op2.BATCH
    assert spark.conf.get(key) == before


def test_components(spark):
    edges = [(1, 2), (2, 3), (5, 4), (6, 6), (9, 8), (8, 7), (7, 10), *((100, 101 + i) for i in range(50)), (3, 1)]
    got = dict(components(spark.createDataFrame(edges, "u long, v long")).collect())
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 7: 7, 8: 7, 9: 7, 10: 7, 100: 100} | {101 + i: 100 for i in range(50)}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0
    chain = [(i, i + 1) for i in range(200)]
    assert set(dict(components(spark.createDataFrame(chain, "u long, v long")).collect()).values()) == {0}
    rng = np.random.default_rng(11)
    for size, count in ((30, 12), (60, 55), (40, 200)):
        edges = [(int(a), int(b)) for a, b in rng.integers(-size // 2, size // 2, (count, 2))]
        root = {x: x for e in edges if e[0] != e[1] for x in e}
        for _ in root:
            for a, b in edges:
                if a != b:
                    root[a] = root[b] = min(root[a], root[b])
        assert dict(components(spark.createDataFrame(edges, "u long, v long")).collect()) == root


def test_alike_sets_share_a_key_at_any_similarity():
    import numpy as np

    rng = np.random.default_rng(4)
    order = op2.Order(20, [], 8, np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64))
    for similarity in (Fraction(1, 10), Fraction(1, 3), Fraction(1, 2), Fraction(2, 3), Fraction(8, 10), Fraction(9, 10), Fraction(1)):
        for boundary in (3, 100):
            keys = op2.Keys(order, boundary, similarity)
            for _ in range(400):
                pool = np.unique(rng.integers(0, 1 << 63, 12).astype(np.uint64))
                a, b = (np.sort(rng.choice(pool, rng.integers(1, 12), replace=False)) for _ in range(2))
                both = len(np.intersect1d(a, b))
                if len(a) + len(b) > 2 * both and both >= similarity * (len(a) + len(b) - both):
                    assert len(np.intersect1d(keys.of(a), keys.of(b))), (similarity, boundary, a, b)


def test_columns_of_any_name(spark):
    from lorekeep.llm import op5_toxicity as op5

    rows = [(1, "one two three four five six", "a"), (2, "one two  three four five six", "b"), (3, None, "c"), (3, None, "c"), (None, "x", "d")]
    plain = spark.createDataFrame(rows, "doc_id long, text string, extra string")
    for names in (["doc_id", "text", "_lk_own"], ["doc_id", "text", "TEXT"], ["doc_id", "text", "sha"]):
        docs = plain.toDF(*names)
        kept = op9.keep_first(docs)
        assert kept.columns == names and sorted((str(r[0]), str(r[1]), r[2]) for r in kept.collect()) == sorted((str(i), str(t), x) for i, t, x in rows[:1] + rows[3:])
        assert exact(op9.exact_dedup(docs)) == brute_exact([r[:2] for r in rows])
        clean = op5.keep_clean(docs, op5.Toxicity(None, np.zeros(1), np.zeros(0), np.ones(0)))
        assert clean.columns == names and clean.count() == len(rows)
    for names in (["doc_id", "text", "a.b"],):
        near_kept = op2.keep_first(plain.toDF(*names))
        assert near_kept.columns == names and sorted(str(r[2]) for r in near_kept.collect()) == ["a", "c", "c", "d"]


def test_chunks_follow_the_content_in_any_script(spark):
    """A passage that moves is cut alike, also without spaces."""
    rng = np.random.default_rng(1)
    scripts = ["".join(map(chr, rng.integers(0x4E00, 0x9FA5, 30_000))), "".join(rng.choice(list("0123456789ABCDEFabcdef"), 30_000)), "".join(f"call(x{k});" + " " * (k % 2) for k in range(3000))]
    for text in scripts:
        df = spark.createDataFrame([(text,), ("ab" + text,)], "t string")
        a, b = (set(r[0]) for r in df.select(op9.chunks(F.col("t"))).collect())
        assert len(a & b) >= len(a) - 3 and len(a) > 10
