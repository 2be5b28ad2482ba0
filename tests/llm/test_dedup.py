"""Exact, substring and near-duplicate operators against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest

from pyspark.sql import functions as F

from loamwork.llm import exact_dedup, jaccard_join, substring_dedup


def _norm(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


@pytest.mark.parametrize("bits", [64, 4])
def test_exact_dedup_matches_brute_force(awkward, bits):
    """With four-bit digests chunks collide, so identifiers fall back to SHA-256."""
    rows = [(r.doc_id, r.text) for r in awkward.collect()]
    groups = {}
    for i, t in rows:
        groups.setdefault(_norm(t), []).append(i)
    want = []
    for i, t in rows:
        own = groups[_norm(t)]
        keep = min((x for x in own if x is not None), default=None)
        want.append((i, keep, len(own), i == keep, hashlib.sha256(_norm(t).encode()).hexdigest()))
    got = [tuple(r) for r in exact_dedup.exact_dedup(awkward, digest_bits=bits).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_chunks_join_to_the_text(spark):
    text = " ".join(f"w{i} ea io." for i in range(5000))
    df = spark.createDataFrame([(text,), ("",), ("日" * 10_000,)], "t string")
    for r in df.select("t", exact_dedup.chunks(df["t"]).alias("c")).collect():
        assert "".join(r["c"]) == r["t"]
        assert all(len(c) <= exact_dedup.LONGEST + 8 for c in r["c"])


def _components(rows):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        s = {tuple(w)} if 0 < len(w) < 5 else {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
        if i is not None:
            sets[i] = s
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in ids}


def test_jaccard_join_on_awkward_rows(awkward):
    rows = [(r.doc_id, r.text) for r in awkward.collect()]
    want = _components(rows)
    got = jaccard_join.jaccard_join(awkward).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.doc_id is None and r.component_id is None) or (r.n_shingles, r.component_id) == want[r.doc_id]


@pytest.mark.parametrize("hot_part", [1, jaccard_join.HOT])
def test_jaccard_join_on_chains_and_near_copies(spark, hot_part):
    """Chains of edits, families around the threshold, boilerplate shared by unrelated texts."""
    rng = random.Random(5)
    words = [f"w{k}" for k in range(3000)]
    rows, n = [], 0
    shared = " ".join(rng.choices(words, k=25))
    for _ in range(25):
        text = rng.choices(words, k=rng.randint(8, 160))
        for _ in range(8):
            rows.append((n, " ".join(text)))
            n += 1
            for _ in range(rng.randint(0, max(1, len(text) // 45))):
                text[rng.randrange(len(text))] = rng.choice(words)
            if rng.random() < 0.3:
                text = text[: -rng.randint(1, 4)] or text
    for _ in range(40):
        rows.append((n, shared + " " + " ".join(rng.choices(words, k=30))))
        n += 1
    want = _components(rows)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), hot_part=hot_part).collect()}
    assert got == want


def test_rarest_parts_pass_over_a_quoted_passage(spark):
    """Unrelated texts that quote one passage meet under none of their rarest parts; near copies among them still do."""
    rng = random.Random(8)
    words = [f"w{k}" for k in range(5000)]
    quoted = " ".join(rng.choices(words, k=40))
    rows = [(i, " ".join(rng.choices(words, k=160)) + " " + quoted) for i in range(60)]
    rows += [(60, rows[7][1] + " one more"), (61, "few words"), (62, None)]
    texts = spark.createDataFrame(rows, "doc_id long, text string")
    met = jaccard_join.rarest_parts(texts, texts.select("doc_id")).groupBy("key").agg(F.collect_set("doc_id").alias("ids")).where("size(ids) > 1").collect()
    assert {tuple(sorted(r["ids"])) for r in met} == {(7, 60)}
    before = np.concatenate([jaccard_join.part_keys(jaccard_join.shingles(t)) for _, t in rows])
    assert np.unique(before, return_counts=True)[1].max() > 10


def test_linked_sets_always_share_a_part():
    """The pigeonhole bound, at the edge of the threshold and across bands."""
    rng = np.random.default_rng(2)
    for i in range(1500):
        n = int(rng.integers(1, 900 if i % 10 else 9000))
        common = int(rng.integers(1, n + 1))
        pool = rng.integers(0, 1 << 63, 2 * n + 2, dtype=np.uint64)
        a = np.unique(pool[:n])
        b = np.unique(np.concatenate([pool[:common], pool[n : n + int(rng.integers(0, n // 3 + 1))]]))
        both = len(np.intersect1d(a, b))
        if 100 * both >= 75 * (len(a) + len(b) - both) and len(a) != both:
            least = jaccard_join.least_shared(jaccard_join.bands(min(len(a), len(b)))[0][0])
            assert len(np.intersect1d(jaccard_join.part_keys(a), jaccard_join.part_keys(b))) >= least
            x, y = (jaccard_join.sketch(s) for s in (a, b))
            assert jaccard_join.apart(np.packbits(x), np.packbits(y)) * 7 <= len(a) + len(b)
            x, y = (jaccard_join.short(s).view(np.uint64) for s in (x, y))
            assert np.bitwise_count(x ^ y).sum() * 7 <= len(a) + len(b)


def test_gear_hash_is_the_rolling_hash():
    raw = bytes(np.random.default_rng(1).integers(0, 256, 400, dtype=np.uint8))
    h, want = 0, []
    for b in raw:
        h = ((h << 1) + int(substring_dedup.GEAR[b])) & 0xFFFFFFFF
        want.append(h)
    assert substring_dedup.gear_hash(np.frombuffer(raw, np.uint8)).tolist() == want


def test_cuts_resist_insertions_and_keep_characters_whole():
    text = " ".join(f"größe{k * k % 997}" for k in range(400))
    raw, moved = text.encode(), ("neu " + text).encode()
    a, b = ({r[x:y] for x, y in zip(c, c[1:], strict=False)} for r in (raw, moved) for c in [substring_dedup.cuts(r)])
    assert len(a & b) > 0.9 * len(a)
    for r in (raw, "日".encode() * 500):
        at = substring_dedup.cuts(r)
        assert b"".join(r[x:y].decode().encode() for x, y in zip(at, at[1:], strict=False)) == r


def _plain_cuts(raw: bytes) -> list[int]:
    """Where chunks end, byte by byte: the first word end of the hash's choice, else the place of the smallest hash."""
    hashes, h = [], 0
    for b in raw:
        h = (h * 2 + int(substring_dedup.GEAR[b])) & 0xFFFFFFFF
        hashes.append(h)
    space = lambda b: b == 32 or 9 <= b <= 13
    at = [0]
    while at[-1] < len(raw):
        last = at[-1]
        ends = [e for e in range(last + 12, min(last + 64, len(raw)) + 1) if space(raw[e - 1]) and hashes[e - 1] >> 16 & 3 == 0]
        if ends:
            at.append(ends[0])
        elif len(raw) - last <= 64:
            at.append(len(raw))
        else:
            whole = [e for e in range(last + 12, last + 65) if e == len(raw) or raw[e] & 0xC0 != 0x80]
            at.append(min(whole, key=lambda e: (not space(raw[e - 1]), hashes[e - 1] >> 1, -e)))
    return at


def _plain_dedup(rows):
    """doc_id -> (repeated chunks, text that is left), by looking every run of four chunks up among all documents'."""
    runs, cut = {}, {}
    for i, t in rows:
        raw = t.encode()
        at = cut[i] = _plain_cuts(raw)
        width = min(4, len(at) - 1)
        for p in range(len(at) - width if width else 0):
            runs.setdefault(raw[at[p] : at[p + width]], []).append((i, p))
    out = {}
    for i, t in rows:
        raw, at = t.encode(), cut[i]
        n = len(at) - 1
        width, shared, gone, seen = min(4, n), [False] * n, [False] * n, set()
        for p in range(n - width + 1 if width else 0):
            run = raw[at[p] : at[p + width]]
            if len(runs[run]) > 1:
                shared[p : p + width] = [True] * width
                if min(d for d, _ in runs[run]) != i or run in seen:
                    gone[p : p + width] = [True] * width
                seen.add(run)

        def spans(flags):
            found, k = [], 0
            while k < n:
                e = k
                while e < n and flags[e]:
                    e += 1
                if e > k and substring_dedup.n_words(raw[at[k] : at[e]]) >= 24:
                    found.append((k, e))
                k = max(e, k + 1)
            return found

        left, last = b"", 0
        for a, b in spans(gone):
            left, last = left + raw[last : at[a]], at[b]
        out[i] = (sum(b - a for a, b in spans(shared)), (left + raw[last:]).decode())
    return out


def test_substring_dedup_against_a_plain_version(spark):
    rng = random.Random(12)
    words = [f"{rng.choice('bcdfgé')}{rng.choice('aeiou')}{k % 37}" for k in range(300)]
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(0, 160)))) for i in range(60)]
    passages = [" ".join(rng.choices(words, k=rng.randint(20, 70))) for _ in range(12)]
    for _ in range(40):
        k, p = rng.randrange(60), rng.choice(passages)
        at = rng.randint(0, len(rows[k][1]))
        rows[k] = (k, rows[k][1][:at] + " " + p + " " + rows[k][1][at:])
    rows += [(60, rows[3][1]), (61, "日本語の文" * 60), (62, "x" + "日本語の文" * 60), (63, rows[5][1] + " " + rows[5][1]), (64, ("word " * 30_000) + rows[9][1]), (65, "")]
    got = {r.doc_id: (r.n_repeated_chunks, r.text) for r in substring_dedup.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert got == _plain_dedup(rows)


def test_substring_dedup_finds_planted_passages(spark):
    rng = random.Random(9)
    words = [f"{rng.choice('bcdfgklm')}{rng.choice('aeiou')}{k}" for k in range(4000)]
    own = [rng.choices(words, k=rng.randint(5, 300)) for _ in range(120)]
    planted = []
    for _ in range(20):
        passage = rng.choices(words, k=rng.randint(55, 90))
        a, b = sorted(rng.sample(range(100), 2))
        for x in (a, b):
            at = rng.randrange(len(own[x]) + 1)
            own[x][at:at] = passage
        planted.append((a, b, " ".join(passage)))
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(own)], "doc_id long, text string").repartition(4)
    got = {r.doc_id: r for r in substring_dedup.substring_dedup(df).collect()}
    assert len(got) == len(own)
    # A later passage may have been planted inside an earlier one, so not every one is whole.
    whole = [(a, b, p) for a, b, p in planted if p in " ".join(own[a]) and p in " ".join(own[b])]
    assert sum(got[a].has_repeat and got[b].n_removed_chars > 0 and p not in got[b].text for a, b, p in whole) >= 0.95 * len(whole)
    touched = {x for a, b, _ in planted for x in (a, b)}
    for i, r in got.items():
        if i not in touched:
            assert not r.has_repeat and r.text == " ".join(own[i])


@pytest.mark.parametrize("letters", ["".join(map(chr, range(0x4E00, 0x5600))), "".join(map(chr, range(0x0E01, 0x0E2F))), "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"])
def test_substring_dedup_without_spaces(spark, letters):
    """Passages of 400 characters in text without white space, at every shift of their place."""
    rng = random.Random(6)
    some = lambda n: "".join(rng.choices(letters, k=n))
    rows, passages = [], []
    for k in range(40):
        passages.append(some(400))
        rows += [(2 * k, some(200) + passages[-1] + some(150)), (2 * k + 1, some(201 + k) + passages[-1] + some(90))]
    rows += [(100, rows[0][1]), (101, some(1000)), (102, some(60))]
    got = {r.doc_id: r for r in substring_dedup.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    text = dict(rows)
    found = [got[2 * k + 1].n_removed_chars for k in range(40)]
    assert sum(n >= 200 for n in found) >= 38 and max(found) <= 400, found
    for k, p in enumerate(passages):
        r = got[2 * k + 1]
        assert all(text[r.doc_id][x.start : x.end] in p and x.first_doc_id == 2 * k for x in r.removed)
        assert got[2 * k].n_removed_chars == 0 and got[2 * k].text == text[2 * k]
    assert got[100].text == "" and got[100].first_doc_ids == [0]
    assert all(got[i].text == text[i] and not got[i].has_repeat for i in (101, 102))


def test_words_of_spaced_text_are_counted_as_words():
    assert substring_dedup.n_words(b"the  international\nagreement ") == 3
    assert substring_dedup.n_words("日本語 のテキスト".encode()) == 2 and substring_dedup.n_words("日".encode() * 60) == 10


def test_substring_dedup_on_awkward_rows(awkward, nothing):
    got = {r.doc_id: r for r in substring_dedup.substring_dedup(awkward).collect()}
    assert got[4].text == got[5].text == "" and got[8].text == "one"
    assert got[0].n_removed_chars == 0 and got[0].has_repeat
    assert got[2].text == "" and got[2].first_doc_ids == [0]
    assert got[None].n_removed_chars == 0
    for f in (exact_dedup.exact_dedup, jaccard_join.jaccard_join, substring_dedup.substring_dedup):
        assert f(nothing).collect() == []


def test_a_namesake_of_a_copy_keeps_its_text(spark):
    """Marks belong to a text, not to an id: of two rows with one id, the one whose passage is a copy loses it alone."""
    p, u = (" ".join(f"{c}{i * 7919 % 1000}word" for i in range(60)) for c in "pu")
    rows = [(1, p), (5, p), (5, u), (5, u), (None, p)]
    got = {(r.doc_id, r.text) for r in substring_dedup.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (1, p) in got and (5, u) in got and (None, p) in got and (5, p) not in got and len(got) == 4
