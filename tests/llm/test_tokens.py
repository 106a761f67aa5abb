"""Word tokens, counts, packing and shards."""

import shutil
import zlib
from pathlib import Path

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lorekeep.llm import op3_training_order as op3
from lorekeep.llm import op6_token_counts as op6
from lorekeep.llm import op8_packing as op8
from lorekeep.llm.common import shared_dir
from lorekeep.llm.word_tokens import WordEncoder, default_path

from .conftest import prose

LIBRARY = Tokenizer.from_file(default_path())
ENCODER = WordEncoder(default_path())


def ids(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.one_of(st.characters(codec="utf-8"), st.sampled_from("aA'sStT rRvVeEmlLdD!?09 \n\tßÜœ–“”|<>"))), max_size=6))
def test_word_encoder_equals_the_library(texts):
    assert [x.tolist() for x in ENCODER.encode_all(texts)] == [ids(t) for t in texts]
    assert ENCODER.count_all(texts).tolist() == [len(ids(t)) for t in texts]


def test_a_full_table_is_forgotten():
    own = WordEncoder(default_path())
    own.table.most = 3
    for k in range(5):
        assert own.encode(prose(20, k)) == ids(prose(20, k))


def test_counts(spark, documents, odd_rows):
    path = shared_dir(spark)
    docs = documents(odd_rows)
    want = sorted((str(i), len((t or "").encode()), len(ids(t)), len(ids(t)) > 2048) for i, t in odd_rows)
    for _ in range(2):
        got = op6.count_tokens(docs, path, default_path()).collect()
        assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in got) == want
    stored = spark.read.parquet(path)
    assert stored.count() == stored.select("content_digest").distinct().count() == len({t or "" for _, t in odd_rows})  # misses alone were encoded
    assert op6.count_tokens(docs.limit(0), path, default_path()).count() == 0
    assert op6.count_tokens(docs.limit(0), shared_dir(spark), default_path()).count() == 0


def test_texts_stay_where_they_lie(spark, documents, monkeypatch):
    """However many contents are missing, no exchange moves texts; what passes a full filter by chance is not stored again."""
    rows = [(i, prose(12, i % 150)) for i in range(300)]
    docs, path, plans = documents(rows).repartition(3), shared_dir(spark), []
    monkeypatch.setattr(op6, "FEW", 10, raising=False)
    monkeypatch.setattr(op6, "MAP_BITS", (1, 2), raising=False)
    written = op6.materialise
    monkeypatch.setattr(op6, "leanly", lambda f, *a: lambda batches: f(batches))
    monkeypatch.setattr(op6, "materialise", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or written(df))
    op6.fill_cache(docs.where("doc_id < 100"), path, default_path())
    op6.fill_cache(docs, path, default_path())
    stored = spark.read.parquet(path).collect()
    assert len(stored) == len({r.content_digest for r in stored}) == 150
    encoded = [p for p in plans if "MapInArrow" in p]
    assert encoded and not any("Join" in p[p.index("MapInArrow") :] or "MapInArrow" in p[p.index("MapInArrow") + 1 :] for p in encoded)


def check_packing(rows, got, capacity):
    lengths = {}
    for r in got:
        lengths.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in lengths.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= capacity
    want = []
    for i, t in rows:
        own = np.array([*ids(t), 1], dtype="<u4")
        want += [(str(i), k, s, len(own[s : s + capacity]), zlib.crc32(own[s : s + capacity])) for k, s in enumerate(range(0, len(own), capacity))]
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    return len(lengths), -(-sum(w[3] for w in want) // capacity)


def test_packing(spark, documents, odd_rows):
    got = op8.pack(documents(odd_rows), default_path()).collect()
    check_packing(odd_rows, got, 4096)
    rows = [(i, prose(5 + i * 7 % 90, i)) for i in range(400)]
    used, least = check_packing(rows, op8.pack(documents(rows), default_path(), capacity=512).collect(), 512)
    assert used <= least + 1
    assert op8.pack(documents(rows[:1]).limit(0), default_path()).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 60), st.integers(1, 10**6), max_size=25))
def test_plans_use_every_length_as_counted(counts):
    n = np.zeros(65, dtype=np.int64)
    for k, v in counts.items():
        n[k] = v
    (plan, bound), used = op8.solve(n, 64), np.zeros(65, dtype=np.int64)
    for config, times in plan:
        assert 0 < sum(config) <= 64 and times > 0
        for length in config:
            used[length] += times
    assert (used == n).all()
    total = sum(t for _, t in plan)
    least = -(-int((n * np.arange(65)).sum()) // 64)
    assert least <= np.ceil(bound - 1e-6) <= total <= sum(k for _, k in op8.best_fit(n, 64))
    assert total <= 1.25 * bound + len(counts)


def test_the_program_is_always_solved(monkeypatch):
    """Also where best-fit alone is near the bound; its configurations make the plan."""
    solved, own = [], op8.fractional
    monkeypatch.setattr(op8, "fractional", lambda *a: solved.append(own(*a)) or solved[-1])
    n = np.bincount(np.random.default_rng(5).integers(1, 65, 100_000), minlength=65)
    assert sum(k for _, k in op8.best_fit(n, 64)) <= 1.001 * op8.size_bound(n, 64)
    plan, bound = op8.solve(n, 64)
    assert solved and sum(k for _, k in plan) <= 1.001 * np.ceil(bound)
    assert sum(k for c, k in plan if c in solved[0][0]) > 0.9 * sum(k for _, k in plan)


def test_plans_near_the_bound():
    n = np.zeros(4097, dtype=np.int64)
    n[[1300, 1366, 2049]] = 10_000
    plan, bound = op8.solve(n, 4096)
    assert 13_100 <= bound <= 13_334 and sum(k for _, k in plan) == 13_334
    n = np.bincount(np.random.default_rng(1).integers(1, 65, 3000), minlength=65)
    plan, bound = op8.solve(n, 64)
    assert sum(k for _, k in plan) <= 1.02 * bound


@settings(max_examples=30, deadline=None)
@given(st.dictionaries(st.integers(1, 12), st.integers(1, 3), max_size=4))
def test_bound_is_below_the_optimum(counts):
    """The fewest sequences, by trying all packings of a few pieces."""
    pieces = sorted((k for k, v in counts.items() for _ in range(v)), reverse=True)
    n = np.bincount(pieces, minlength=13) if pieces else np.zeros(13, dtype=np.int64)

    def fewest(i, rooms):
        if i == len(pieces):
            return len(rooms)
        tried = [fewest(i + 1, rooms[:j] + [r - pieces[i]] + rooms[j + 1 :]) for j, r in enumerate(rooms) if r >= pieces[i] and r not in rooms[:j]]
        return min([*tried, fewest(i + 1, [*rooms, 12 - pieces[i]])])

    if len(pieces) <= 8:
        plan, bound = op8.solve(n, 12)
        assert bound <= fewest(0, []) + 1e-6 and sum(k for _, k in plan) <= fewest(0, []) + 1


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 3000), st.integers(0, 1 << 40))
def test_feistel_is_a_permutation(n, key):
    slots = op3.permute(np.arange(n), n, key)
    assert sorted(slots.tolist()) == list(range(n))
    assert op3.permute(slots, n, key, inverse=True).tolist() == list(range(n))


def test_shards(spark, documents, odd_rows):
    out = shared_dir(spark)
    docs = documents(odd_rows).repartition(3)
    options = {"length": 64, "per_shard": 32}
    rows = op3.write_shards(docs, out, default_path(), **options).collect()
    assert sorted(r.slot for r in rows) == list(range(len(rows)))
    read = {slot: (doc, start, x) for slot, doc, start, x in op3.read_shards(out)}
    assert sorted(read) == list(range(len(rows)))
    assert [s for s, *_ in op3.read_shards(out, 40)] == list(range(40, len(rows)))
    for r in rows:
        doc, start, x = read[r.slot]
        assert (doc, start, len(x), zlib.crc32(x.astype("<u2").tobytes())) == (-1 if r.doc_id is None else r.doc_id, r.start, r.n_ids, r.ids_crc32)
        assert (r.shard, r.byte_offset) == (r.slot // 32, r.slot % 32 * (16 + 128))
    # the staged streams, in the order of their indices, hold every document once
    stream = np.concatenate([read[s][2] for s in op3.permute(np.arange(len(rows)), len(rows)).tolist()])
    ends = np.flatnonzero(stream == op3.END_ID) if not any("endoftext" in (t or "") for _, t in odd_rows) else None
    assert ends is None or len(ends) == len(odd_rows)
    assert len(stream) == sum(len(ids(t)) + 1 for _, t in odd_rows)
    folder = Path(out.removeprefix("file://"))
    stamps = {p.name: p.stat().st_mtime_ns for p in folder.glob("shard-*")}
    again = op3.write_shards(docs, out, default_path(), **options).collect()  # resumes: nothing is written anew
    assert sorted(again, key=str) == sorted(rows, key=str) and stamps == {p.name: p.stat().st_mtime_ns for p in folder.glob("shard-*")}
    assert op3.write_shards(docs.limit(0), shared_dir(spark), default_path()).count() == 0


def shards_of(out):
    return {p.name: p.read_bytes() for p in Path(out.removeprefix("file://")).glob("shard-*")}


def test_shards_of_another_run_are_refused(spark, documents, tmp_path):
    rows = [(i, prose(60, i)) for i in range(40)]
    docs, options = documents(rows).repartition(3), {"length": 32, "per_shard": 16}
    out = shared_dir(spark)
    op3.write_shards(docs, out, default_path(), **options)
    before = shards_of(out)
    other = tmp_path / "other.json"
    other.write_text(Path(default_path()).read_text().replace('"version": "1.0"', '"version":  "1.0"', 1) + " ")
    changed = documents([(i, t + " end" if i == 7 else t) for i, t in rows]).repartition(3)
    for d, path, more in ((docs, default_path(), {"key": 9}), (changed, default_path(), {}), (docs, str(other), {}), (docs, default_path(), {"length": 64})):
        with pytest.raises(ValueError, match="another run"):
            op3.write_shards(d, out, path, **(options | more))
        assert shards_of(out) == before
    index = op3.write_shards(changed, out, default_path(), **options, key=9, replace=True).collect()
    fresh = shared_dir(spark)
    want = op3.write_shards(changed, fresh, default_path(), **options, key=9).collect()
    assert shards_of(out) == shards_of(fresh) and sorted(index, key=str) == sorted(want, key=str)


def test_a_killed_run_goes_on(spark, documents):
    docs, options = documents([(i, prose(60, i)) for i in range(40)]).repartition(3), {"length": 32, "per_shard": 16}
    out = shared_dir(spark)
    index = op3.write_shards(docs, out, default_path(), **options).collect()
    whole, folder = shards_of(out), Path(out.removeprefix("file://"))
    (folder / "shard-00000001.bin").unlink()
    (folder / "shard-00000002.bin").write_bytes(b"half")
    (folder / ".shard-00000001.bin.77").write_bytes(b"half")
    shutil.rmtree(folder / "index")
    (folder / "staged" / "_SUCCESS").unlink()  # lost while staging
    again = op3.write_shards(docs, out, default_path(), **options).collect()
    assert shards_of(out) == whole and sorted(again, key=str) == sorted(index, key=str) and not list(folder.glob(".shard*"))


def test_too_many_ids_are_refused(documents, spark, monkeypatch):
    monkeypatch.setattr(op3, "END_ID", 1 << 16)
    with pytest.raises(ValueError, match="16 bits"):
        op3.write_shards(documents([(1, "x")]), shared_dir(spark), default_path())


def test_training_order_changes_with_the_key(spark, documents):
    docs = documents([(i, prose(60, i)) for i in range(20)]).repartition(2)
    a, b = (op3.write_shards(docs, shared_dir(spark), default_path(), length=32, key=k).orderBy("slot").select("ids_crc32").collect() for k in (1, 2))
    assert a != b and sorted(a) == sorted(b)
