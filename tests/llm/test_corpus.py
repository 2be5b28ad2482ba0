"""Phrases, personal data and the conversation trie against plain versions."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from loamwork.llm import conversation_trie, phrases, pii, queries
from loamwork.llm.common import documents

SPACE = "[\x20\x09-\x0d]+"


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# Conversations.


def plain_trie(rows, rebuild=False):
    """rows: conv_id, turn, role, text. The nodes as op13 returns them."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()
            own[c].append((turn is not None, turn or 0, role, digest, text))
    own = {c: [(x[2], x[4]) for x in sorted(t)] for c, t in own.items()}
    convs = own
    if rebuild:
        convs = {}
        for c in own:
            h = zlib.crc32(str(c).encode()) % 4
            base = own.get(c - c % 20, []) if c >= 0 else own.get(c + (-c) % 20, [])
            convs[c] = base[:h] + own[c][h:]
    nodes = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            nodes[tuple(turns[:d])].append(c)
    children, out = Counter(k[:-1] for k in nodes if k), []
    leaves, saved = Counter(), Counter()
    for k, members in nodes.items():
        words = len([w for w in re.split(SPACE, k[-1][1]) if w]) if k else 0
        for d in range(len(k) + 1):
            leaves[k[:d]] += not children[k]
            saved[k[:d]] += (len(members) - 1) * words
    for k, members in nodes.items():
        ends = ",".join(map(str, sorted(c for c in members if len(convs[c]) == len(k))))
        out.append((min(members), len(k), min(nodes[k[:-1]]) if k else None, len(members), children[k], leaves[k], saved[k], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


TURNS = "conv_id long, turn long, role string, text string, depth int, f string, row long"


@pytest.fixture(scope="module")
def talks(spark):
    """Shared beginnings, nulls, ties, whole repeats, empty turns, one long conversation and one that ends in another."""
    rows = []
    for c in range(70):
        for t in range(c % 6):
            rows.append((c, t, "user" if t % 2 == 0 else "assistant", f"say {t} {'same' if (c // 7) % 2 else c % 5 if t > 2 else 'it'}"))
    rows += [(100, t, "user", f"long {t % 3} word") for t in range(150)] + [(101, t, "user", f"long {t % 3} word") for t in range(90)]
    rows += [(200, None, None, None), (200, None, None, ""), (200, 1, "b", "x"), (200, 1, "a", "x"), (200, 1, "a", "x"), (None, 1, "a", "lost"), (201, 3, "user", " "), (-5, 0, "user", "minus one"), (-20, 0, "user", "minus")]
    return spark.createDataFrame([(*r, 7, "f", None) for r in rows], TURNS).repartition(3).cache()


def test_trie_equals_the_plain_one(spark, talks):
    rows = [tuple(r)[:4] for r in talks.collect()]
    assert rows_of(conversation_trie.conversation_trie(talks)) == plain_trie(rows)
    assert rows_of(conversation_trie.rebuilt_trie(talks)) == plain_trie(rows, rebuild=True)


def test_colliding_fingerprints_are_split(spark, talks):
    turns = conversation_trie.facts(talks)
    want = plain_trie([tuple(r)[:4] for r in talks.collect()])
    assert rows_of(conversation_trie.trie(turns, moduli=(2, 1))) == want


def test_conversations_span_ranges_and_stretches(spark, talks):
    turns = conversation_trie.facts(talks)
    want = plain_trie([tuple(r)[:4] for r in talks.collect()])
    assert rows_of(conversation_trie.trie(turns, rows_in_range=20, stretch=8)) == want


def test_long_lists_of_ends_are_hashed_in_blocks(spark):
    n = 2500
    same = spark.range(n).select(F.col("id").alias("conv_id"), F.lit(0).alias("turn"), F.lit("user").alias("role"), F.lit("hi there").alias("text"))
    found = {r.depth: r for r in conversation_trie.conversation_trie(same).collect()}
    assert found[1].ends_sha256 == hashlib.sha256(",".join(map(str, range(n))).encode()).hexdigest()
    assert (found[0].n_convs, found[0].n_leaves, found[1].saved_tokens) == (n, 1, 2 * (n - 1))


def test_no_conversations_have_no_nodes(spark):
    nothing = spark.createDataFrame([], TURNS)
    assert conversation_trie.conversation_trie(nothing).collect() == [] == conversation_trie.rebuilt_trie(nothing).collect()


# Phrases.


def plain_phrases(rows, least, top, cover=100):
    """rows: lang, text."""
    counts, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang, text = lang or "und", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            w = tuple(x for x in re.split(r"[\x20\x09]+", piece) if x)
            n[lang] += len(w)
            for d in range(1, 6):
                counts[lang].update(w[i : i + d] for i in range(len(w) - d + 1))
    out = []
    for lang, f in counts.items():
        kept = [p for p, c in f.items() if len(p) > 1 and c >= least]
        inner = set()
        for p in kept:
            for d in range(2, len(p)):
                inner |= {p[i : i + d] for i in range(len(p) - d + 1) if 100 * f[p] >= cover * f[p[i : i + d]]}
        found = []
        for p in kept:
            score, k = min((1000 * f[p] * n[lang] // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            if p not in inner:
                found.append((-score, -f[p], " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (s, a, p, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -s))
    return sorted(out, key=repr)


WORDS = "new york city hall is the place of all new york fans in the big apple the the the Of A".split()


@pytest.fixture(scope="module")
def prose(spark, awkward):
    import random

    draw = random.Random(5)
    texts = [" ".join(draw.choice(WORDS) + draw.choice(["", "", "", ",", "\n", " é.", "\t"]) for _ in range(draw.randrange(60))) for _ in range(200)]
    rows = [(i, t, draw.choice(["en", None, "und", "de"]), "s", 1, None, None, None, None, None, None) for i, t in enumerate(texts)]
    return awkward.unionByName(spark.createDataFrame(rows, awkward.schema)).unionByName(spark.createDataFrame(rows[:40], awkward.schema)).repartition(3).cache()


def test_phrases_equal_the_plain_ones(prose):
    rows = [(r.lang, r.text) for r in prose.collect()]
    for least, top, cover in ((5, 2000, 100), (3, 4, 60)):
        assert rows_of(phrases.collocations(prose, least=least, top=top, cover=cover)) == plain_phrases(rows, least, top, cover)


def test_small_shards_slices_and_ranges_change_nothing(prose, monkeypatch):
    want = plain_phrases([(r.lang, r.text) for r in prose.collect()], 5, 2000)
    monkeypatch.setattr(phrases, "HELD", 50)
    assert rows_of(phrases.collocations(prose, least=5, shard=64, range_words=100, stride=10)) == want
    text = " ".join(f"w{i % 7}" for i in range(500)).encode()
    assert b"".join(phrases.slices(text, 10)) == text and len(list(phrases.slices(text, 10))) > 50


def test_words_that_share_labels_are_labelled_anew(prose):
    want = plain_phrases([(r.lang, r.text) for r in prose.collect()], 5, 2000)

    def label(word, seed):
        import xxhash

        return 77 if seed < 2 and word in (b"new", b"york") else xxhash.xxh3_64_intdigest(word, seed)

    assert rows_of(phrases.collocations(prose, least=5, label=label)) == want


def test_no_documents_have_no_phrases(nothing, awkward):
    assert phrases.collocations(nothing).collect() == []
    assert phrases.collocations(awkward.where("doc_id in (4, 5)")).collect() == []


# Personal data.


def plain_spans(text):
    """The base spans by the patterns as they are stated."""
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((m.start(), 0, m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(x) for x in m[0] if x.isdigit()]
        if 12 <= len(d) <= 19 and (sum(d[-1::-2]) + sum(sum(divmod(2 * x, 10)) for x in d[-2::-2])) % 10 == 0:
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= sum(x.isdigit() for x in m[0]) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def test_base_spans_equal_the_stated_patterns():
    import random

    draw = random.Random(3)
    parts = ["a@b.co", "x.y+z@", "@", "mail.ex-1.com.", "1.2.3.4", ".", "255.256.1.1", "001.02.3.255", "4111 1111 1111 1111", "5500-0000-0000-0004", "0000000000000", "+1 (555) 010-9999", "+49", "12", " ", "-", "é😀", "7", "(", "\n"]
    for _ in range(4000):
        text = "".join(draw.choice(parts) for _ in range(draw.randrange(12)))
        assert pii.base_spans(text) == plain_spans(text), text
        assert pii.base_spans(text, pii._scanned(__import__("pyarrow").array([text]))[0]) == plain_spans(text), text


def test_long_runs_take_linear_time():
    for text in ("1" * 2_000_000, "a" * 2_000_000, "1." * 1_000_000, "a@" * 1_000_000, "+1" * 1_000_000, "1 " * 1_000_000, "a.b@c-" * 300_000):
        pii.base_spans(text)


def plain_terms(texts, threshold, support, near):
    """Revealing terms by their definition."""
    import math

    word = re.compile("[^\x20\x09-\x0d]+")
    n, n_t, n_c, n_ct, places = len(texts), Counter(), Counter(), Counter(), defaultdict(set)
    for text in texts:
        spans = plain_spans(text)
        words = [(m.start(), m.end(), m[0].encode().lower().strip(pii._PUNCTUATION).decode()) for m in word.finditer(text)]
        hidden = [any(a < e and s < b for a, _, b in spans) for s, e, _ in words]
        n_t.update({t for _, _, t in words if len(t.encode()) >= 3})
        cs, cts = set(), set()
        for a, kind, b in spans:
            c = pii.entity(text[a:b], kind)
            own = [k for k, (s, e, _) in enumerate(words) if s < b and a < e]
            cs.add(c)
            around = [*range(max(0, own[0] - near), own[0]), *range(own[-1] + 1, min(len(words), own[-1] + 1 + near))]
            place = tuple("\0" if hidden[k] else words[k][2] for k in around), own[0]
            place = (place[0], own[0] - around[0] if around and around[0] < own[0] else 0)
            for k in around:
                if not hidden[k] and len(words[k][2].encode()) >= 3:
                    cts.add((c, words[k][2]))
                    places[c, words[k][2]].add(place)
        n_c.update(cs)
        n_ct.update(cts)
    out = {}
    for (c, t), x in n_ct.items():
        if len(places[c, t]) >= support and n_c[c] < n:
            r = math.log2(n * x / (n_t[t] * n_c[c])) / math.log2(n / n_c[c])
            if r >= threshold:
                out[t] = max(out.get(t, -9), r)
    return out


@pytest.fixture(scope="module")
def letters(spark, awkward):
    """Entities of which a name gives one away, a city another one in part, and a footer none."""
    texts = [f"note {i} by Ms Quillfeather, write to quill@mail.example.com {'today' * (i % 3)} item{i}" for i in range(12)]
    texts += [f"call{i} from Lund +46 70 123 45 6{i % 2} about t{i}" for i in range(8)] + [f"Lund again {i}" for i in range(4)]
    texts += [f"page {i} of many words here end contact us at help@shop.example.com or 10.0.0.1 always" for i in range(20)]
    texts += ["Only Quillfeather! knows", "x" * 100_000 + " a@b.cd", "card 4111-1111-1111-1111 and 4111111111111112"]
    rows = [(1000 + i, t, "en", "s", 1, None, None, None, None, None, None) for i, t in enumerate(texts)]
    return awkward.unionByName(spark.createDataFrame(rows, awkward.schema)).repartition(3).cache()


@pytest.mark.parametrize("most_sent", [pii.SMALL, 0])
def test_revealing_terms_are_found_and_replaced(letters, most_sent):
    texts = [r.text or "" for r in letters.select("text").collect()]
    own = letters.select(F.coalesce("text", F.lit("")).alias("text"))
    found = {r.term: r.reveals for r in pii.revealing_terms(own).collect()}
    want = plain_terms(texts, pii.THRESHOLD, pii.SUPPORT, pii.NEAR)
    assert "quillfeather" in want and "contact" not in want
    assert found.keys() == want.keys() and all(abs(found[t] - want[t]) < 1e-9 for t in want)
    out = {(r.doc_id, r.text_in): r for r in pii.personal_data(letters.withColumn("text_in", F.col("text")), most_sent=most_sent).join(letters.select("doc_id", F.col("text").alias("text_in")), "doc_id").collect()}
    for (doc_id, text), r in out.items():
        if doc_id == 3:
            continue
        base = plain_spans(text or "")
        assert [(s.start, s.kind, s.end) for s in r.spans if s.kind != "term"] == [(a, pii.KINDS[k], b) for a, k, b in base]
        assert all(pii.term(text[s.start : s.end]) in want and s.end - s.start == len(pii.term(text[s.start : s.end])) for s in r.spans if s.kind == "term")
        assert (r.text == (text or "")) == (not r.spans)
    alone = next(r for (_, t), r in out.items() if t and t.startswith("Only Quill"))
    assert alone.n_term == 1 and "Quillfeather" not in alone.text and alone.text.endswith("! knows")


def test_report_of_all_documents(spark, sf):
    got = {r.doc_id: r for r in queries.op12_pii(spark, sf).collect()}
    docs = documents(spark, sf).collect()
    assert len(got) == len(docs)
    for r in docs:
        spans = plain_spans(r.text or "")
        spelled = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in spans)
        kinds = Counter(k for _, k, _ in spans)
        x = got[r.doc_id]
        assert (x.n_email, x.n_ip, x.n_card, x.n_phone, x.base_sha256) == (*[kinds[k] for k in range(4)], hashlib.sha256(spelled.encode()).hexdigest())
        assert set(spelled.split(",") if spelled else []) <= set(x.spans.split(",")) or not spelled


def test_no_documents_have_no_personal_data(nothing):
    assert pii.personal_data(nothing).collect() == [] == pii.report(nothing).collect()


def test_awkward_rows_keep_their_number(awkward):
    assert pii.report(awkward).count() == awkward.count()


def test_a_shard_holds_few_sequences_at_a_time(monkeypatch):
    """Sorting and counting a shard's sequences needs memory for some of them at a time, and gives the same tries."""
    import tracemalloc

    import numpy as np

    draw = np.random.default_rng(1)
    tokens = draw.integers(1, 5000, 1 << 19).astype(np.uint64) << np.uint64(50)
    tokens[::11] = 0
    whole = dict(phrases.shard_tries(tokens, len(tokens), np.linspace(0, 1 << 52, 9).astype(np.int64)[1:-1]))
    monkeypatch.setattr(phrases, "CHUNK", 1 << 14)
    tracemalloc.start()
    few = dict(phrases.shard_tries(tokens, len(tokens), np.linspace(0, 1 << 52, 9).astype(np.int64)[1:-1]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert few == whole
    assert peak < 80 * len(tokens)
    found = [phrases.read_trie(b, 5) for b in few.values()]
    assert sum(int(n.sum()) for _, n, _ in found) == int(((tokens[:-1] > 0) & (tokens[1:] > 0)).sum())
