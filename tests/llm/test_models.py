"""Character models: smoothing by hand, held-out accuracy, edge cases."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lorekeep.llm import char_models as cm
from lorekeep.llm import op5_toxicity as op5
from lorekeep.llm import op10_language as op10
from lorekeep.llm.common import crc32_mod

TEXTS = {"a": ["abab abba", "ba"], "b": ["cab bad", "dad dad"]}


def brute_model(texts, n=cm.ORDER):
    """Interpolated Kneser-Ney with one discount for each order, from strings."""
    words = [w for t in texts for w in cm.words_of(t)]
    top = Counter()
    for w in words:
        s = "^" * (n - 1) + w + "$"
        top.update(s[i : i + n] for i in range(len(s) - n + 1))
    tables = {n: top}
    for k in range(n - 1, 0, -1):
        tables[k] = Counter(g[1:] for g in tables[k + 1])
    return tables


def brute_log_p(tables, gram, vocabulary, discounts):
    p = 1 / vocabulary
    for k in range(1, cm.ORDER + 1):
        own, table = gram[-k:], tables[k]
        followers = [c for g, c in table.items() if g[:-1] == own[:-1]]
        if followers:
            total = sum(followers)
            p = max(table[own] - discounts[k], 0) / total + discounts[k] * len(followers) / total * p
    return math.log(p)


def counted(texts):
    words = [w for t in texts for w in cm.words_of(t)]
    gram, _ = cm.grams_of(words)
    return np.unique(gram, return_counts=True)


def test_one_class_equals_the_formula():
    tables = brute_model(TEXTS["b"])
    discounts = {}
    for k, t in tables.items():
        ones, twos = sum(c == 1 for c in t.values()), sum(c == 2 for c in t.values())
        discounts[k] = min(0.95, max(0.1, ones / (ones + 2 * twos) if ones + twos else 0.5))
    model = cm.build(["b"], {"b": counted(TEXTS["b"])})
    for word in ["dad", "bad", "zzz", "cad", "d"]:
        s = "^" * (cm.ORDER - 1) + word + "$"
        want = sum(brute_log_p(tables, s[i : i + cm.ORDER], len(tables[1]) + 1, discounts) for i in range(len(word) + 1))
        got, n = model.score_words([word])
        assert got[0, 0] == pytest.approx(want, rel=1e-4) and n[0] == len(word) + 1


def test_next_characters_sum_to_one():
    model = cm.build(["a", "b"], {c: counted(t) for c, t in TEXTS.items()}, shared=True)
    alphabet = sorted({c for t in TEXTS.values() for x in t for c in x if c != " "})
    for before in ["", "a", "ba", "zz"]:
        gram, lengths = cm.grams_of([before + c for c in alphabet] + [before] if before else alphabet)
        ends = np.cumsum(lengths) - 2
        keys = gram[ends[: len(alphabet)]]
        stop = (keys[0] >> cm.BITS << cm.BITS) | cm.END
        p = np.exp(model.score(np.append(keys, stop)).astype(float)).sum(axis=0)
        assert (p <= 1 + 1e-5).all() and (p > 0.5).all()


def test_counts_by_spark(spark):
    rows = spark.createDataFrame([(c, t) for c, ts in TEXTS.items() for t in ts] + [("a", None), ("a", "")], "class string, text string")
    classes, counts = cm.bounded(cm.count_grams(rows.repartition(3)))
    assert classes == ["a", "b"]
    for c in classes:
        keys, n = counted(TEXTS[c])
        order = np.argsort(counts[c][0])
        assert counts[c][0][order].tolist() == keys.tolist() and counts[c][1][order].tolist() == n.tolist()
    _, few = cm.bounded(cm.count_grams(rows), cells=8)
    assert all(len(k) <= 4 for k, _ in few.values())


def test_language_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = op10.language(docs, crc32_mod(F.col("doc_id"), 5) == 0)
    both = found.join(docs.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (both.lang == both.lang_pred).mean() > 0.97
    assert found.count() == docs.count() and both.score.between(0, 1).all()


def test_rejection_on_rows_held_apart(spark):
    """Held-out texts are rejected about as often as asked, whatever the number of rows; other languages always."""
    for sf in ("sf0.01", "sf0.1"):
        docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").select("doc_id", "text", "lang")
        strange = spark.createDataFrame([(-5 * i, " ".join("xqzwv jkpxq wvzzk qqxj vwkz".split()[(i + j) % 5] for j in range(30)), None) for i in range(1, 40)], docs.schema)
        held = (crc32_mod(F.col("doc_id"), 5) == 0) | (F.col("doc_id") < 0)
        found = op10.language(docs.union(strange), held).where("held_out AND lang_pred != 'und'").select("doc_id", "rejected").toPandas()
        own = found[found.doc_id >= 0].rejected
        assert own.mean() <= 2 * op10.REJECT + 2 / len(own), sf
        assert found[found.doc_id < 0].rejected.all()


def test_language_edges(spark, documents, odd_rows):
    rows = [(i, t, "en" if i and i % 2 else None) for i, t in odd_rows] + [(400 + i, "le chat est sur la table " * 3, "fr") for i in range(20)] + [(500, "12 ² ½ !"), (501, "²a")]
    docs = documents(rows)
    found = op10.language(docs, crc32_mod(F.col("doc_id"), 5) == 0).collect()
    assert len(found) == len(rows)
    by_id = {r.doc_id: r for r in found}
    assert {by_id[i].lang_pred for i in (1, 2, 3, 500)} == {"und"} and by_id[1].score == 0
    assert by_id[400].lang_pred == "fr" and by_id[501].lang_pred in ("en", "fr")
    assert op10.language(docs.limit(0), F.lit(False)).count() == 0
    nothing = op10.language(docs.withColumn("lang", F.lit(None).cast("string")), F.lit(False)).collect()
    assert {r.lang_pred for r in nothing} == {"und"}


def test_toxicity_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("length(text) < 6000")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    model = op5.fit(docs, labels, op5.usable())
    truth = docs.join(labels, "doc_id").where(~op5.usable()).select("doc_id", "text", "toxic")
    got = op5.score_rows(truth, model).toPandas()
    toxic, said = got.toxic == 1, got.score >= op5.CUT
    assert (said & toxic).sum() / said.sum() > 0.85 and (said & toxic).sum() / toxic.sum() > 0.5
    assert got.score.between(0, 1).all()


def test_toxicity_edges(spark, documents, odd_rows):
    rows = odd_rows + [(1000 + i, f"you {'idiot' if i % 3 == 0 else 'friend'} of the house number {i} goes on") for i in range(300)]
    docs = documents(rows)
    labels = spark.createDataFrame([(1000 + i, 1, int(i % 3 == 0)) for i in range(300)] + [(1000, 1, 0), (1, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    model = op5.fit(docs, labels, op5.usable())
    scored = op5.score_rows(docs, model, as_col="_s")
    assert scored.columns == [*docs.columns, "_s"]
    by_id = {r.doc_id: r._s for r in scored.collect()}
    assert all((by_id[1000 + i] >= op5.CUT) == (i % 3 == 0) for i in range(300))
    assert by_id[1] == by_id[2] and 0 <= by_id[1] <= 1
    nothing = op5.fit(docs, labels.limit(0), op5.usable())
    assert {r._s for r in op5.score_rows(docs, nothing, as_col="_s").collect()} == {0.0}
    assert op5.score_rows(docs.limit(0), model).count() == 0


def test_no_class_prunes_another(spark):
    pairs = spark.range((1 << 21) + 10).select(F.lit("a").alias("class"), F.col("id").alias("gram"), F.lit(1).cast("long").alias("n"))
    few = spark.createDataFrame([("b", g, 1) for g in range(5)], "class string, gram long, n long")
    _, counts = cm.bounded(pairs.union(few))
    assert len(counts["a"][0]) == (1 << 21) + 10 and sorted(counts["b"][0].tolist()) == list(range(5))
    often = spark.createDataFrame([("a", g, 9) for g in range(100)], "class string, gram long, n long")
    _, counts = cm.bounded(often.union(few), cells=220)
    assert len(counts["a"][0]) == 100 and len(counts["b"][0]) == 5
    _, counts = cm.bounded(often.union(few), cells=120)
    assert len(counts["b"][0]) == 5


def test_rare_toxic_grams_stay(spark, documents, monkeypatch):
    """Ordinary text beyond any fixed budget leaves the toxic class whole."""
    ordinary = spark.range((1 << 21) + 10).select(F.lit("0").alias("class"), (F.col("id") + (1 << 50)).alias("gram"), F.lit(2).cast("long").alias("n"))
    counted_rows, kept = cm.count_grams, {}
    monkeypatch.setattr(op5, "count_grams", lambda rows: counted_rows(rows.where("class = '1'")).union(ordinary))
    monkeypatch.setattr(op5, "build", lambda classes, counts, shared: kept.update(counts) or cm.build(classes, {c: counted(TEXTS["a"]) for c in classes}, shared))
    docs = documents([(i, f"rare slur{'abcdefgh'[i % 8]} once" if i % 2 else "fine words") for i in range(80)] + [(90 + i, "singular") for i in range(9)])
    labels = docs.select("doc_id", F.when((F.col("doc_id") % 2 == 1) & (F.col("doc_id") < 90) | (F.col("doc_id") == 92), 1).otherwise(0).alias("toxic"))
    op5.fit(docs, labels, F.lit(True))
    want = np.unique(cm.grams_of(["rare", "once", *(f"slur{c}" for c in "bdfh")])[0])
    assert set(want.tolist()) <= set(kept["1"][0].tolist()) and len(kept["0"][0]) == (1 << 21) + 10


def toxic_scores(spark, documents, toxic_ids, n=120):
    docs = documents([(i, f"you {'idiot' if i in toxic_ids else 'friend'} of the house number goes on" if i % 5 else f"you {'idiot' if i in toxic_ids else 'friend'}") for i in range(n)] + [(n, None), (n + 1, "you idiot"), (n + 2, "you friend")])
    labels = spark.createDataFrame([(i, int(i in toxic_ids)) for i in range(n)], "doc_id long, toxic int")
    return {r.doc_id: r._s for r in op5.score_rows(docs, op5.fit(docs, labels, F.lit(True)), as_col="_s").collect()}


def test_few_toxic_labels(spark, documents):
    tenth = F.pmod(F.xxhash64(F.lit("calibration"), F.col("id")), F.lit(10)) == 0
    sides = {r.id: r.apart for r in spark.range(120).select("id", tenth.alias("apart")).collect()}
    out, held = [i for i, a in sides.items() if not a], [i for i, a in sides.items() if a]
    for toxic in (out[5:11], held[:4], out[3:4], held[:1]):  # none, or all, of the class in the tenth; one id
        got = toxic_scores(spark, documents, set(toxic))
        assert got[121] >= op5.CUT > got[122] and got[120] < op5.CUT, toxic


def test_thinning_keeps_the_rarer_class(spark, documents, monkeypatch):
    assert op5.shares({"0": 900_000, "1": 40}, 20_000) == {"0": 46, "1": 1}
    assert op5.shares({"0": 15_000, "1": 4_000}, 20_000) == {"0": 1, "1": 1}
    assert op5.shares({"0": 30_000, "1": 60_000}, 20_000) == {"0": 3, "1": 6}
    monkeypatch.setattr(op5, "SAMPLE", 6)
    got = toxic_scores(spark, documents, set(range(0, 400, 40)), 400)
    assert got[401] >= op5.CUT > got[402]


def test_wide_characters_stay_apart(spark, documents):
    letters = [chr(c) for c in range(0x40000) if chr(c).isalnum() and not 0xD800 <= c < 0xE000]
    gram, lengths = cm.grams_of(letters)
    first = np.cumsum(lengths) - lengths
    whole = gram[first + lengths - 1] >> cm.BITS & ((1 << 2 * cm.BITS) - 1)  # all symbols of the letter
    assert len(np.unique(whole)) == len(letters) and set(lengths.tolist()) == {2, 3} and gram.min() > 0
    _, n = cm.build(["a"], {"a": counted(["日本 ab"])}).score_words(["日本", "ab", "日b"])
    assert n.tolist() == [3, 3, 3]
    han, other = [chr(0x4E00 + 95 * i) for i in range(40)], [chr(0x4E00 + 95 * i) for i in range(40, 80)]  # alike modulo 95
    rows = [(i, "".join((han, other)[i % 2][(i * 7 + j * 3) % 40] for j in range(20)), "xy"[i % 2]) for i in range(60)]
    found = op10.language(documents(rows), F.col("doc_id") >= 40).collect()
    assert all(r.lang_pred == "xy"[r.doc_id % 2] for r in found)
