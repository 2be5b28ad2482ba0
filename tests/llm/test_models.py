"""Classifiers by held-out accuracy, the mix by its promises, the pipeline stage by stage."""

import base64
import hashlib
import math
import re
import zlib

import numpy as np
import public_tokenizers as P
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from loamwork.llm import common, langid, mixing, quality, queries, sample, toxicity
from tests.llm.test_dedup import _components


def _truth(spark, sf):
    return {r.doc_id: r for r in common.labels(spark, sf).collect()}


def test_quality_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    truth = _truth(spark, sf)
    got = queries.op3_quality(spark, sf).collect()
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(got) == 1000 and all(0 <= r.score <= 1 for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert np.mean([r.predicted == truth[r.doc_id].quality for r in held]) >= 0.9


def test_quality_tables_are_additive():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    model = quality.fit(x, y)
    assert ((model.score(x) > 0.5) == (y == 1)).mean() > 0.9  # only a pair can tell
    assert quality.fit(x[:0], y[:0]).score(x[:2]).tolist() == [0.5, 0.5]


def test_quality_scores_are_sums_of_tables(spark, awkward, sf):
    """Every score worked out by hand from the model's tables, repeated rows, null ids and very long texts too."""
    model = quality.train(common.documents(spark, "/root/testdata/sf0.01"), common.labels(spark, "/root/testdata/sf0.01"))
    rows = awkward.select("doc_id", "text").collect()
    got = sorted(((r.doc_id, r.held_out, round(r.score, 9), r.predicted) for r in quality.score(awkward, model).collect()), key=str)
    want = []
    for i, t in rows:
        x = quality.features(t)
        place = [sum(c <= v for c in cuts) for cuts, v in zip(model.cuts, x, strict=True)]
        total = model.base + sum(float(table[k]) for table, k in zip(model.tables, place, strict=True)) + sum(float(grid[place[a], place[b]]) for a, b, grid in model.pairs)
        s = 1 / (1 + math.exp(-total))
        want.append((i, i is None or zlib.crc32(str(i).encode()) % 5 == 0, round(s, 9), int(s >= 0.3)))
    assert got == sorted(want, key=str)


def test_toxicity_scores_by_hand(spark, awkward):
    sf = "/root/testdata/sf0.01"
    model = toxicity.train(common.documents(spark, sf), common.labels(spark, sf))
    texts = [r.text for r in awkward.select("text").distinct().collect()] + [r.text for r in common.documents(spark, sf).limit(60).collect()]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    got = {r.text: (round(r.severity, 9), round(r.p_toxic, 9), r.grade, r.is_toxic) for r in toxicity.score(df, model).collect()}
    for t in texts:
        z = sum(float(model.weights[model.features[f]]) for f in set(toxicity.tokens(t)) if f in model.features)
        above = [1 / (1 + math.exp(min(60, max(-60, float(b) - z)))) for b in model.thresholds]
        parts = [a - b for a, b in zip([1, *above], [*above, 0], strict=True)]
        assert got[t] == (round(sum(above), 9), round(above[0], 9), parts.index(max(parts)), above[0] >= 0.5)


def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    truth = _truth(spark, sf)
    docs = common.documents(spark, sf)
    model = toxicity.train(docs, common.labels(spark, sf))
    got = [r for r in toxicity.score(docs, model).where(common.held_out(F.col("doc_id"))).collect() if r.doc_id in truth]
    assert len(got) > 500 and np.mean([r.is_toxic == (truth[r.doc_id].toxic == 1) for r in got]) >= 0.97


def _plain_buckets(text, buckets):
    raw, n = (" " + text.lower() + " ").encode(), {}
    for at in range(len(raw)):
        h = 0
        for b in raw[at : at + 4]:
            h = (h + b + 1) * 0x9E3779B1 & 0xFFFFFFFF
            h ^= h >> 15
            k = (h * 0x85EBCA6B & 0xFFFFFFFF) >> (32 - int(math.log2(buckets)))
            n[k] = n.get(k, 0) + 1
    return n


def test_languages_by_hand(spark, awkward, sf):
    model = langid.train(common.documents(spark, sf))
    rows = awkward.select("doc_id", "text").where("length(text) < 5000 or text is null").collect()
    got = langid.predict(awkward.where("length(text) < 5000 or text is null"), model).collect()
    assert len(got) == len(rows)
    seen = {}
    for r in got:
        seen.setdefault(r.doc_id, []).append((r.lang_pred, round(r.score, 4)))
    for i, t in rows:
        if not t or not any(c.isalpha() for c in t):
            assert ("und", 0.0) in seen[i]
            continue
        n = _plain_buckets(t, len(model.table))
        z = [(sum(c * float(model.table[k, l]) for k, c in n.items()) / sum(n.values()) + float(model.bias[l])) / model.temperature for l in range(len(model.languages))]
        p = [math.exp(x - max(z)) for x in z]
        best = p.index(max(p))
        assert any(lang == model.languages[best] and abs(score - p[best] / sum(p)) < 1e-3 for lang, score in seen[i]), i


def test_samples_have_every_stratum_and_one_text_an_id(spark):
    """300 strata, a hot one, repeated ids: the same rows however they are stored."""
    rows = spark.range(40_000).select((F.col("id") % 30_000).alias("doc_id"), F.when(F.col("id") < 20_000, "hot").otherwise(F.concat(F.lit("l"), F.col("id") % 299)).alias("lang"))
    a = {tuple(r) for r in sample.bounded(rows.repartition(3), 3000, strata=F.col("lang")).collect()}
    b = {tuple(r) for r in sample.bounded(rows.repartition(8, "lang"), 3000, strata=F.col("lang")).collect()}
    per = {}
    for _, lang in a:
        per[lang] = per.get(lang, 0) + 1
    assert a == b and len(a) == 3000 and len(per) == 300 and max(per.values()) - min(per.values()) <= 1
    few = sample.bounded(rows, 3000, strata=F.when(F.col("doc_id") < 10, "rare").otherwise("common")).collect()
    assert sum(r.doc_id < 10 for r in few) == len({(r.doc_id, r.lang) for r in rows.where("doc_id < 10").collect()})
    texts = spark.createDataFrame([(1, "b"), (1, "a"), (2, None), (3, "c")], "doc_id long, text string")
    assert sorted(map(tuple, sample.with_texts(texts, spark.createDataFrame([(1, 0), (2, 1)], "doc_id long, y int"), ["doc_id"]).collect())) == [(1, 0, "a"), (2, 1, None)]


def test_mix_of_rows_that_share_id_and_size(spark):
    """Nulls for ids: rows are dealt to blocks like others, the mix keeps its target, and reruns agree."""
    docs = lambda parts: spark.range(30_000, numPartitions=parts).select(F.lit(None).cast("long").alias("doc_id"), F.when(F.col("id") % 2 == 0, "a b c").otherwise("v w x y z").alias("text"), F.when(F.col("id") % 3 == 0, "s").otherwise("t").alias("source"))
    count = lambda d: sorted(map(tuple, mixing.mix(d).groupBy("source", "size", "target", "copies").count().collect()))
    one = count(docs(3))
    assert one == count(docs(7)) and sum(r[-1] for r in one) == 30_000
    for s in "st":
        own = [r for r in one if r[0] == s]
        assert abs(sum(r[1] * r[3] * r[4] for r in own) - own[0][2]) <= 5


def test_languages_on_held_out_rows(spark, sf):
    docs = common.documents(spark, sf)
    lang = {r.doc_id: r.lang for r in docs.collect()}
    got = queries.op7_langid(spark, sf).collect()
    held = [r for r in got if r.held_out]
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in held]) >= 0.9


def test_toxicity_on_labelled_rows(spark):
    sf = "/root/testdata/sf0.01"
    truth = _truth(spark, sf)
    got = [r for r in queries.op5_toxicity(spark, sf).collect() if r.doc_id in truth]
    assert np.mean([r.is_toxic == (truth[r.doc_id].toxic == 1) for r in got]) >= 0.95
    assert all(0 <= r.severity <= 3 for r in got)


def test_ordinal_thresholds_are_ordered():
    rng = np.random.default_rng(0)
    rows = []
    for _ in range(400):
        y = int(rng.random() < 0.4)
        rows.append(([0] * y + ([1] if rng.random() < 0.5 else []), rng.random() * y, y))
    model = toxicity.fit(toxicity.Model({"bad#1": 0, "any#1": 1}, {"bad"}), rows)
    assert (np.diff(model.thresholds) > 0).all() and model.weights[0] > 1
    above = model.above("so bad")
    assert above[0] > 0.5 > model.above("so good")[0] and (np.diff(above) <= 0).all()


def test_models_on_awkward_and_empty_tables(spark, awkward, nothing, sf):
    labels = common.labels(spark, sf)
    lang = langid.train(awkward)
    got = {r.doc_id: r for r in langid.predict(awkward, lang).collect()}
    assert got[4].lang_pred == got[5].lang_pred == got[16].lang_pred == "und" and got[0].lang_pred == "en"
    none = langid.train(nothing)
    assert {r.lang_pred for r in langid.predict(awkward, none).collect()} == {"und"}
    assert langid.predict(nothing, lang).collect() == []
    model = quality.train(nothing, labels.limit(0))
    assert {r.score for r in quality.score(awkward, model).collect()} == {0.5}
    assert quality.score(nothing, model).collect() == []
    marks = spark.createDataFrame([(17, 1), (0, 0), (1, 0), (8, 0), (None, 1), (9, None), (10, 7)], "doc_id long, toxic int")
    scored = toxicity.score(awkward, toxicity.train(awkward, marks))
    assert scored.count() == awkward.count() and set(awkward.columns) <= set(scored.columns)
    assert not any(r.is_toxic for r in toxicity.score(awkward, toxicity.train(awkward, marks.limit(0))).collect())
    assert toxicity.score(nothing, toxicity.train(nothing, marks)).collect() == []


def _targets(sizes, weights=(5.0, 2.0, 1.0), cap=3.0):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[k % 3] for k, s in enumerate(names)}
    total, capped = float(sum(sizes.values())), set()
    while True:
        left, free = total - sum(cap * sizes[s] for s in capped), sum(w[s] for s in names if s not in capped)
        over = {s for s in names if s not in capped and left * w[s] / free > cap * sizes[s]}
        if not over:
            return {s: cap * sizes[s] if s in capped else left * w[s] / free for s in names}
        capped |= over


def test_mix_keeps_its_promises(spark, sf):
    docs = common.documents(spark, sf).withColumn("source", F.when(F.col("doc_id") % 7 == 0, None).when(F.col("doc_id") % 11 == 1, "zz").when(F.col("doc_id") == 3, "tiny").otherwise(F.col("source")))
    got = mixing.mix(docs).collect()
    words = {r.doc_id: len(r.text.encode().split()) for r in docs.collect()}
    sizes = {}
    for r in got:
        sizes[r.source] = sizes.get(r.source, 0) + r.size
        assert r.size == words[r.doc_id] and 0 <= r.taken <= 3 * r.size and r.taken == r.copies * r.size
    want = _targets(sizes)
    assert len(got) == docs.count()
    for s in sizes:
        own = [r for r in got if r.source == s]
        assert abs(own[0].target - want[s]) < 1e-6 * want[s] + 1e-6 and own[0].source_size == sizes[s]
        assert abs(sum(r.taken for r in own) - want[s]) <= max(r.size for r in own)
    again = mixing.mix(docs.repartition(7)).collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, again), key=str)


def test_mix_is_unbiased_and_deep(spark):
    """Many documents in one source take several levels; each is taken at its rate on average."""
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.expr("repeat('w ', int(1 + id % 9))").alias("text"), F.when(F.col("id") < 5000, "a").otherwise("b").alias("source"))
    got = mixing.mix(docs, weights=(1.0, 1.0), fan=8).toPandas()
    for s, own in got.groupby("source"):
        assert abs(own.taken.sum() - own.target.iloc[0]) <= 9, s
        rate = own.target.iloc[0] / own["size"].sum()
        for _, same in own.groupby("size"):
            assert abs(same.copies.mean() - rate) < 0.12


def test_mix_on_awkward_and_empty_tables(awkward, nothing):
    got = mixing.mix(awkward).collect()
    assert len(got) == awkward.count() and all(r.taken == 0 for r in got if r.doc_id in (4, 5, 6, 7))
    assert mixing.mix(nothing).collect() == []
    empty = awkward.where("doc_id in (4, 5)").withColumn("source", F.lit("e")).unionByName(awkward.where("doc_id = 0"))
    assert {r.doc_id: (r.source_size, r.target) for r in mixing.mix(empty).collect()} == {4: (0, 0.0), 5: (0, 0.0), 0: (60, 60.0)}
    assert {r.taken for r in mixing.mix(awkward.where("doc_id in (4, 5)")).collect()} == {0}


def test_mix_comes_near_every_target(spark):
    """One document that is most of its source doesn't decide what the source misses its target by."""
    docs = common.documents(spark, "/root/testdata/sf0.01")
    for s in mixing.mix(docs).groupBy("source").agg(F.sum("taken").alias("taken"), F.max("target").alias("target")).collect():
        assert abs(s.taken - s.target) <= 0.02 * s.target, s
    few = mixing.mix(docs, longest=3).groupBy("source").agg(F.sum("taken").alias("taken"), F.max("target").alias("target"), F.max("size").alias("most")).collect()
    assert all(abs(s.taken - s.target) <= s.most for s in few)


def test_settling_long_documents_is_unbiased(spark):
    """Over many seeds a long document, and the short ones around it, are taken at their rate."""
    docs = spark.createDataFrame([(i, "w " * n, s) for i, (n, s) in enumerate([(90, "a"), (10, "a"), (7, "a"), (5, "a"), (60, "b"), (60, "b"), (3, "b")])], "doc_id long, text string, source string")
    copies, rates = {}, {}
    for seed in range(24):
        for r in mixing.mix(docs, weights=(1.0, 1.0), seed=seed).collect():
            copies.setdefault(r.doc_id, []).append(r.copies)
            rates[r.doc_id] = r.target / r.source_size
    assert all(abs(sum(c) / len(c) - rates[i]) < 0.3 for i, c in copies.items())


def _copies(docs):
    """The mix of the pipeline's stage: rows by all their columns, doc_id to the copies of its rows together."""
    keyed = docs.withColumn("__key", F.xxhash64(*[common.col(c) for c in docs.columns]))
    of, out = {r["__key"]: r.doc_id for r in keyed.select("__key", "doc_id").collect()}, {}
    for r in mixing.mix(keyed, id_col="__key").collect():
        out[of[r.doc_id]] = out.get(of[r.doc_id], 0) + r.copies
    return out


def test_rows_that_share_an_id_are_taken_each_for_itself(spark, sf):
    for ids in ((None, None, None), (1, 1, 1)):
        docs = spark.createDataFrame([(i, t, "s" if t != "o " * 50 else "t") for i, t in zip((*ids, 9), ("a " * 30, "b " * 20, "c " * 7, "o " * 50), strict=True)], "doc_id long, text string, source string")
        keyed = docs.withColumn("k", F.xxhash64("doc_id", "text", "source"))
        text = {r.k: r.text for r in keyed.collect()}
        want = {text[r.doc_id]: r.copies for r in mixing.mix(keyed, id_col="k").collect() if r.copies}
        got = {}
        for r in corpus_pipeline.mix_sources(spark, docs, sf).collect():
            got[r.text] = got.get(r.text, 0) + 1
        assert got == want


def test_pipeline_run_against_brute_force(spark, sf):
    """What SQL can't say: each stage's decisions worked out in Python, the model's and the mix's taken from them."""
    docs = common.documents(spark, sf)
    toxic = {r.doc_id for r in toxicity.score(docs, toxicity.train(docs, common.labels(spark, sf), keep_back=False)).collect() if r.is_toxic}
    rows = [(r.doc_id, r.text) for r in docs.collect() if r.doc_id not in toxic]
    first = {}
    for i, t in sorted(rows):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t), i)
    rows = [(i, t) for i, t in rows if i in set(first.values())]
    groups = _components(rows)
    rows = [(i, t) for i, t in rows if groups[i][1] == i]
    kept = docs.where(F.col("doc_id").isin([i for i, _ in rows]))
    copies = _copies(kept)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for i, t in rows:
        ids = enc.encode_ordinary(t)
        want += [(i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())] * copies[i]
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf).collect())) == sorted(want)


def test_exact_dedup_stage_drops_rows_not_ids(spark, sf):
    """A copy's unique namesake stays, and a row repeated whole stays once."""
    rows = [(1, "one text here"), (2, "one text  here"), (2, "a unique text"), (3, "twice the same"), (3, "twice the same"), (None, "no id"), (None, "no id"), (4, None), (4, None)]
    got = corpus_pipeline.drop_copies(spark, spark.createDataFrame(rows, "doc_id long, text string"), sf).collect()
    want = [(1, "one text here"), (2, "a unique text"), (3, "twice the same"), (None, "no id"), (None, "no id"), (4, None)]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_pipeline_stages(spark, awkward, sf):
    docs, sizes = common.documents(spark, sf), []
    for _, stage in corpus_pipeline.STAGES[:3]:
        after = stage(spark, docs, sf)
        assert after.columns == docs.columns
        docs = spark.createDataFrame(after.collect(), after.schema)
        sizes.append(docs.count())
    assert 200 > sizes[0] > sizes[1] >= sizes[2]
    texts = [r.text for r in docs.collect()]
    assert len(set(texts)) == len(texts)
    mixed = corpus_pipeline.mix_sources(spark, docs, sf)
    assert mixed.columns == docs.columns
    copies, taken = _copies(docs), {}
    for r in mixed.collect():
        taken[r.doc_id] = taken.get(r.doc_id, 0) + 1
    assert taken == {i: c for i, c in copies.items() if c}


def test_pipeline_stages_on_awkward_and_empty_tables(spark, awkward, nothing, sf):
    """Rows, not only columns: clean ones stay, one of equal texts stays, null ids stay, ids of copies go."""
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, nothing, sf)
        assert after.collect() == [] and (name == "byte-level BPE" or after.columns == nothing.columns)
    ids = lambda df: sorted((r.doc_id for r in df.select("doc_id").collect()), key=lambda x: (x is None, x))
    all_ids = ids(awkward)
    stages = dict(corpus_pipeline.STAGES)
    assert set(all_ids) - set(ids(stages["toxicity"](spark, awkward, sf))) <= {17}
    groups = {}
    for r in awkward.where("doc_id is not null").collect():
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r.text or ""), set()).add(r.doc_id)
    assert ids(stages["exact dedup"](spark, awkward, sf)) == [*sorted(min(g) for g in groups.values()), None]
    parts = _components([(r.doc_id, r.text) for r in awkward.collect()])
    assert set(ids(stages["n-gram Jaccard join"](spark, awkward, sf))) == {None, *(i for i, (_, c) in parts.items() if c == i)}
    mixed = {}
    for i in ids(stages["mixing"](spark, awkward, sf)):
        mixed[i] = mixed.get(i, 0) + 1
    assert mixed == {i: c for i, c in _copies(awkward).items() if c}
    assert ids(stages["byte-level BPE"](spark, awkward, sf)) == all_ids
