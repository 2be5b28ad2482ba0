"""Personal data: base patterns, and the terms around them that give them away (information-theoretic sanitisation).

Protected entities are the e-mail and IP addresses, card and phone numbers in the corpus. A term t that stands near an
entity c (``NEAR`` words to either side) reveals part of c's information content IC(c) = log2(N / n(c)):

    reveals(t, c) = PMI(t, c) / IC(c) = log2(N n(t, c) / (n(t) n(c))) / log2(N / n(c))

with n(.) the documents that hold t, c, or t near c, of N. It is 1 where t occurs with c alone, and 0 where the two are
independent. A term that reveals ``threshold`` of an entity or more is part of the personal data wherever it occurs:
it is generalised to its class (number, name, word), and removed where it reveals ``remove`` or more. Only terms that stand near
the entity in ``support`` different surroundings count, so copies of one text, or a footer that all pages
carry, make no evidence.

Each pass works on whole texts where they are: only (entity, term) pairs, counts by term, and, where revealing terms are too many to
be sent to every task, pairs of text hash and term are shuffled, all of them pre-aggregated. Candidate terms are
told to tasks by a bitmap of fixed size, and counts of what it lets through by chance are dropped by a join.

Terms are words without white space, lower-cased (A-Z) and stripped of ASCII punctuation, of 3 bytes or more.
Searching takes time in proportion to a text's length, long runs of digits or letters included.

Cases: null and empty texts have no spans (null becomes empty); repeated rows count as documents of their own
and get equal results; a null doc_id stays null; spans of different kinds may overlap, term spans never overlap
others; other columns are ignored, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamwork.llm.common import col
from loamwork.plans.scratch import materialise

KINDS = ("email", "ip", "card", "phone", "term")
NEAR, REACH, SUPPORT, THRESHOLD, REMOVE = 8, 400, 3, 0.9, 0.97
#: Bits of the map of candidate terms (256 kB); revealing terms that are sent to every task, at most; term hashes that a task remembers.
BITS, SMALL, REMEMBERED = 1 << 21, 100_000, 300_000
_PUNCTUATION = bytes(i for i in range(33, 127) if not chr(i).isalnum())
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# A match that fails at the first digit of a run fails at all others; a possessive part never has to give back.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_WORD, _BLANK = re.compile(r"[^\x20\x09-\x0D]+"), frozenset(" \t\n\x0b\x0c\r")
#: What a text must have for a kind to occur in it, for a quick look at a whole batch.
_HINTS = (r"@[A-Za-z0-9-]+\.", r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]", r"[0-9]([ -]?[0-9]){11}", r"\+[0-9]")


def emails(text: str) -> list[tuple[int, int]]:
    out, low, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > low and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((start, m.end()))
            low = m.end()
        at = text.find("@", max(at + 1, low))
    return out


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _digits(part: str) -> str:
    return "".join(c for c in part if "0" <= c <= "9")


def base_spans(text: str, kinds: tuple[bool, ...] = (True,) * 4) -> list[tuple[int, int, int]]:
    """(start, kind, end) of what the patterns find, in that order; kinds by their place in ``KINDS``."""
    found = []
    if kinds[0]:
        found += [(a, 0, b) for a, b in emails(text)]
    if kinds[1]:
        found += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(len(x := p.lstrip("0")) < 4 and int(x or 0) <= 255 for p in m[0].split("."))]
    if kinds[2]:
        found += [(m.start(), 2, m.end()) for m in _CARD.finditer(text) if 12 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
    if kinds[3]:
        found += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return sorted(found)


def _scanned(texts: pa.Array) -> list[tuple[bool, ...]]:
    return list(zip(*[pc.match_substring_regex(texts, h).to_pylist() for h in _HINTS], strict=True))


def term(word: str) -> str:
    return word.encode().lower().strip(_PUNCTUATION).decode()


def entity(text: str, kind: int) -> str:
    return f"{KINDS[kind]}:{text.lower() if kind < 2 else _digits(text)}"


def masked(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text, as long as before, with what spans cover as NUL: a word that one touches is no term."""
    out, last = [], 0
    for a, _, b in spans:
        if b > last:
            out += [text[last:a], "\0" * (b - max(a, last))]
            last = b
    return "".join(out) + text[last:]


def surroundings(text: str, spans: list[tuple[int, int, int]], near: int = NEAR) -> set[tuple[str, str | None, int]]:
    """(entity, term, hash of what surrounds them) for every term near an entity; without a term, the entity alone.

    Near are ``near`` words to either side, as far as they lie whole within ``REACH`` characters of the entity's own word.
    """
    covered, out = masked(text, spans), set()
    for a, kind, b in spans:
        start, end = a, b
        while start > max(0, a - REACH) and covered[start - 1] not in _BLANK:
            start -= 1
        while end < min(len(covered), b + REACH) and covered[end] not in _BLANK:
            end += 1
        low, high = max(0, start - REACH), min(len(covered), end + REACH)
        before, after = _WORD.findall(covered, low, start), _WORD.findall(covered, end, high)
        if before and low and covered[low] not in _BLANK and covered[low - 1] not in _BLANK:
            before = before[1:]
        if after and high < len(covered) and covered[high] not in _BLANK and covered[high - 1] not in _BLANK:
            after = after[:-1]
        around = ["\0" if "\0" in w else term(w) for w in (*before[-near:], "\0", *after[:near])]
        who, place = entity(text[a:b], kind), xxhash.xxh3_64_intdigest(" ".join(around)) >> 1
        out.add((who, None, 0))
        out |= {(who, t, place) for t in around if len(t.encode()) >= 3}
    return out


_PAIRS = "entity string, term string, place long, first int"


def _pairs(near: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, rows = batch.column(0), []
            for k, kinds in enumerate(_scanned(texts)):
                if any(kinds) and (spans := base_spans(text := texts[k].as_py(), kinds)):
                    seen = set()
                    for who, t, place in sorted(surroundings(text, spans, near), key=str):
                        rows.append((who, t, place, int((who, t) not in seen)))
                        seen.add((who, t))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.int64()), pa.array([r[3] for r in rows], pa.int32())], names=["entity", "term", "place", "first"])

    return run


class _Slots(dict):
    """Places of words' terms in the bitmap; -1 for what is too short to be a term."""

    def __missing__(self, word: bytes) -> int:
        t = word.strip(_PUNCTUATION)
        slot = xxhash.xxh3_64_intdigest(t) % BITS if len(t) >= 3 else -1
        if len(self) < REMEMBERED:
            self[word] = slot
        return slot


def _possible(raw: bytes, table: np.ndarray, slots: _Slots) -> set[str]:
    """The text's terms that the bitmap lets through."""
    words = list(set(raw.lower().split()))
    at = np.fromiter((slots[w] for w in words), np.int64, len(words))
    hit = np.flatnonzero((at >= 0) & (table[at >> 3] >> (at & 7).astype(np.uint8) & 1 == 1))
    return {words[k].strip(_PUNCTUATION).decode() for k in hit}


def _occurrences(bitmap):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, slots, held = np.frombuffer(bitmap.value, np.uint8), _Slots(), Counter()
        give = lambda: pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["term", "n"])
        for batch in batches:
            for text in batch.column(0).cast(pa.binary()):
                held.update(_possible(text.as_py(), table, slots))
            if len(held) > REMEMBERED:
                yield give()
                held.clear()
        yield give()

    return run


def _bitmap(terms: DataFrame) -> bytes:
    size = 1 << 15

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([xxhash.xxh3_64_intdigest(t.encode()) % BITS for t in batch.column(0).to_pylist()], pa.int64())], names=["slot"])

    pieces = terms.select("term").mapInArrow(slots, "slot long").groupBy(F.floor(F.col("slot") / size).alias("at")).agg(F.bitmap_construct_agg((F.col("slot") % size).cast("long")).alias("bits"))
    out = bytearray(BITS // 8)
    for at, bits in pieces.collect():  # BITS / 2^15 rows at most
        out[at * size // 8 : (at + 1) * size // 8] = bits
    return bytes(out)


def revealing_terms(texts: DataFrame, threshold: float = THRESHOLD, support: int = SUPPORT, near: int = NEAR) -> DataFrame:
    """term and reveals (the most that it reveals of any entity) of the terms that reveal ``threshold`` or more. texts: text, never null."""
    pairs = materialise(texts.select("text").mapInArrow(_pairs(near), _PAIRS), "entity-pairs")
    entities = pairs.where("term is null").groupBy("entity").agg(F.sum("first").alias("n_c"))
    held = pairs.where("term is not null").groupBy("entity", "term").agg(F.sum("first").alias("n_ct"), F.count_distinct("place").alias("places"))
    held = materialise(held.where(F.col("places") >= support).join(entities, "entity"), "candidate-pairs")
    terms = materialise(held.select("term").distinct(), "candidate-terms")
    if terms.isEmpty():
        return terms.withColumn("reveals", F.lit(1.0)).limit(0)
    bitmap = texts.sparkSession.sparkContext.broadcast(_bitmap(terms))
    often = texts.select("text").mapInArrow(_occurrences(bitmap), "term string, n long").groupBy("term").agg(F.sum("n").alias("n_t"))
    n = F.lit(float(texts.count()))
    reveals = F.log2(n * F.col("n_ct") / (F.col("n_t") * F.col("n_c"))) / F.log2(n / F.col("n_c"))
    found = held.join(often, "term").where(F.col("n_c") < n).groupBy("term").agg(F.max(reveals).alias("reveals"))
    return materialise(found.where(F.col("reveals") >= threshold), "revealing-terms")


def _class(word: str) -> str:
    return "[number]" if any("0" <= c <= "9" for c in word) else "[name]" if word[:1].isupper() else "[word]"


def term_spans(text: str, terms: dict[str, float], base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    out = []
    for m in _WORD.finditer(masked(text, base)):
        if (t := term(m[0])) in terms:
            start = m.start() + len(m[0]) - len(m[0].lstrip(_PUNCTUATION.decode()))
            out.append((start, 4, start + len(t)))
    return out


_OUT = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, n_term long, spans array<struct<kind:string,start:int,end:int,put:string>>, text string"
_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("put", pa.string())]))


def sanitised(text: str, spans: list[dict]) -> str:
    """The text with each span, or run of overlapping spans, replaced."""
    out, last = [], 0
    for s in spans:
        if s["start"] >= last:
            out += [text[last : s["start"]], s["put"]]
        last = max(last, s["end"])
    return "".join(out) + text[last:]


def _found(known, bitmap, remove: float, with_text: bool):
    """known: all revealing terms, or None where each text comes with its own (term, reveals)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, slots = None if bitmap is None else np.frombuffer(bitmap.value, np.uint8), _Slots()
        for batch in batches:
            texts, rows = batch.column(1), []
            own = batch.column(2).to_pylist() if known is None else None
            for k, kinds in enumerate(_scanned(texts)):
                terms = {x["term"]: x["reveals"] for x in own[k] or []} if own is not None else known.value
                near = bool(terms) and (own is not None or not terms.keys().isdisjoint(_possible(texts[k].as_py().encode(), table, slots)))
                if not (any(kinds) or near):
                    rows.append(([], [0] * 5, texts[k].as_py() if with_text else None))
                    continue
                text = texts[k].as_py()
                base = base_spans(text, kinds)
                spans = sorted(base + (term_spans(text, terms, base) if near else []))
                put = lambda a, kind, b: f"[{KINDS[kind]}]" if kind < 4 else "" if terms[term(text[a:b])] >= remove else _class(text[a:b])  # noqa: E731, B023
                spans = [{"kind": KINDS[kind], "start": a, "end": b, "put": put(a, kind, b)} for a, kind, b in spans]
                kinds = Counter(s["kind"] for s in spans)
                rows.append((spans, [kinds[x] for x in KINDS], sanitised(text, spans) if with_text else None))
            counts = [pa.array([r[1][k] for r in rows], pa.int64()) for k in range(5)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *counts, pa.array([r[0] for r in rows], _SPANS), pa.array([r[2] for r in rows], pa.string())], names=[x.split()[0] for x in _OUT.replace("struct<kind:string,start:int,end:int,put:string>", "struct").split(", ")])

    return run


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, remove: float = REMOVE, support: int = SUPPORT, near: int = NEAR, with_text: bool = True, most_sent: int = SMALL) -> DataFrame:
    """One row for each row of ``docs``: spans by kind, what each is replaced by, their numbers, and (``with_text``) the sanitised text.

    ``most_sent``: revealing terms up to this many are sent to every task; more are joined to the texts that hold them.
    """
    spark = docs.sparkSession
    own = docs.select(col(id_col).cast("long").alias("doc_id"), F.coalesce(col(text_col), F.lit("")).alias("text"))
    found = revealing_terms(own, threshold, support, near)
    few = found.limit(most_sent + 1).collect() if found.limit(most_sent + 1).count() <= most_sent else None
    if few is not None:
        bitmap = spark.sparkContext.broadcast(_bitmap(found)) if few else None
        return own.mapInArrow(_found(spark.sparkContext.broadcast({r["term"]: r["reveals"] for r in few}), bitmap, remove, with_text), _OUT)
    bitmap = spark.sparkContext.broadcast(_bitmap(found))

    def possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, slots = np.frombuffer(bitmap.value, np.uint8), _Slots()
        for batch in batches:
            rows = [(h, t) for h, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True) for t in _possible(text.as_py(), table, slots)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string())], names=["h", "term"])

    # Two texts of one hash only make each other's terms known, and those count where they occur.
    hashed = own.withColumn("h", F.xxhash64("text"))
    held = hashed.select("h", "text").mapInArrow(possible, "h long, term string").distinct().join(found, "term").groupBy("h").agg(F.collect_list(F.struct("term", "reveals")).alias("terms"))
    return hashed.join(materialise(held, "terms-of-texts"), "h", "left").select("doc_id", "text", "terms").mapInArrow(_found(None, None, remove, with_text), _OUT)


def spelled(spans: Column) -> Column:
    """kind:start:end of every span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(docs: DataFrame) -> DataFrame:
    """Counts, the digest of the base spans, and all spans of every row."""
    found = personal_data(docs, with_text=False)
    base = F.filter("spans", lambda s: s["kind"] != "term")
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2(spelled(base), 256).alias("base_sha256"), spelled(F.col("spans")).alias("spans"), "n_term")
