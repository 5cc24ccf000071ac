"""Operator 8: personal data by patterns, and terms that give it away.

Four patterns find e-mail addresses, IP addresses, card numbers and telephone numbers. The corpus then tells which terms
reveal a protected entity: a value, or the kind of value. `both` documents have the term within `near` words of the entity,
`with_term` hold the term anywhere, and P(entity) is the share of documents with the entity. Few counts say little, so the
estimate is smoothed towards P(entity) with the weight of `smooth` documents: P(entity | term) = (both + smooth P(entity)) / (with_term + smooth).
A pair discloses if that is `least_share` or more, log2(P(entity | term) / P(entity)) is `least_bits` or more, and `both` is
`least_docs` or more. Such a term is a span of kind `term` where it stands near that entity, or with `everywhere` at each place in
every document, as its share is over the whole corpus; so values in fewer than `least_docs` documents have terms through their kind only. A sanitised text has
values replaced by their kind, and terms generalised to `<TERM>` or, from `remove_bits` on, removed.

Values and terms are counted with map-side combining. Documents with a term near any value are a lower bound of those that
hold it: pairs that cannot reach the share by it go before the corpus is read, and tasks count the terms of the others.

Null and empty texts have no spans. Repeated rows are all returned, and each counts as a document. Empty tables give
empty results.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from srcpulse.llm.common import terms_of, texts, written

KINDS = ("email", "ip", "card", "phone", "term")
#: A match never starts inside a run of its first class, so looking behind saves trying each place of a long run.
_domain = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+").match
_local = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_ip = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+").finditer
_card = re.compile(r"[0-9](?:[ -]?[0-9])+").finditer
_phone = re.compile(r"\+[0-9][ ().0-9-]+[0-9]").finditer
_digits = re.compile("[^0-9]").sub
#: A term is a run of letters, digits and non-ASCII characters, A-Z as a-z.
TERM = "[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
_terms = re.compile(TERM).finditer
SPAN = pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32())])
NEAR = pa.struct([("value", pa.string()), ("term", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
FOUND = (
    "doc_id long, text_hash long, base array<struct<kind:int,start:int,end:int>>, "
    "near array<struct<value:string,term:string,start:int,end:int>>"
)
#: Terms of 40 bytes or so that are sent to all tasks at most; more are joined by a shuffle.
BROADCAST_TERMS = 500_000
#: Terms that a task counts before it hands the counts on.
COUNTED_TERMS = 500_000


def _luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum((0, 2, 4, 6, 8, 1, 3, 5, 7, 9)[int(d)] for d in digits[-2::-2])
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of personal data by pattern, in order."""
    out = []
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _local:
            start -= 1
        match = _domain(text, at) if start < at else None
        if match:
            out.append((start, 0, match.end()))
            done = match.end()
        at = text.find("@", max(at + 1, done))
    for m in _ip(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _card(text):
        if 12 <= m.end() - m.start() <= 40 and 12 <= len(digits := _digits("", m[0])) <= 19 and _luhn(digits):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _phone(text):
            if 9 <= len(_digits("", m[0])) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def free_words(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """(start, end) of the words outside the spans."""
    free, i, last = [], 0, 0
    for m in _terms(text):
        a, b = m.span()
        while i < len(spans) and spans[i][0] < b:
            last = max(last, spans[i][2])
            i += 1
        if a >= last:
            free.append((a, b))
    return free


def near_terms(text: str, spans: list[tuple[int, int, int]], near: int) -> list[tuple[str, str, int, int]]:
    """(value, term, start, end) of the terms within `near` words of each span; words of spans are none."""
    if not spans:
        return []
    free, out, i = free_words(text, spans), [], 0
    for start, kind, end in spans:
        while i < len(free) and free[i][0] < start:
            i += 1
        raw = text[start:end]
        value = f"{KINDS[kind]}:{raw.lower() if kind == 0 else _digits('', raw) if kind > 1 else raw}"
        for a, b in free[max(0, i - near) : i + near]:
            out.append((value, text[a:b].translate(_LOWER), a, b))
    return out


_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def find(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", near: int = 6) -> DataFrame:
    """rid, doc_id, text_hash, `base` spans, `near` terms of every row; a written table, so rids stay."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, close = [], []
            for text in batch.column("text").to_pylist():
                spans = base_spans(text)
                base.append([{"kind": k, "start": a, "end": b} for a, k, b in spans])
                close.append([dict(zip(("value", "term", "start", "end"), x, strict=True)) for x in near_terms(text, spans, near)])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_hash"), pa.array(base, pa.list_(SPAN)), pa.array(close, pa.list_(NEAR))],
                ["doc_id", "text_hash", "base", "near"],
            )

    rows = texts(docs, id_col, text_col).withColumn("text_hash", F.xxhash64("text"))
    return written(rows.mapInArrow(scan, FOUND).withColumn("rid", F.monotonically_increasing_id()), "pii-found")


def _entities(near: Column) -> Column:
    """(entity, term) of each near term: its value, the value's kind, and `*` for any value."""
    kind = lambda v: F.concat(F.substring_index(v, ":", 1), F.lit(":*"))
    each = F.transform(near, lambda x: F.transform(F.array(x["value"], kind(x["value"]), F.lit("*")), lambda e: F.struct(e.alias("entity"), x["term"].alias("term"))))
    return F.flatten(each)


def _holding(docs: DataFrame, terms: DataFrame, text_col: str, broadcast_terms: int) -> DataFrame:
    """term, with_term: the documents that hold each of the terms. Tasks count, so a row is a task's count of a term and
    never a word of a document. Where the terms are too many to be sent, tasks count all words."""
    terms = written(terms.distinct(), "pii-asked")
    known = None
    if terms.count() <= broadcast_terms:
        known = docs.sparkSession.sparkContext.broadcast({r.term.encode() for r in terms.toLocalIterator()})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        asked = known.value if known else None

        def sent() -> pa.RecordBatch:
            columns = [pa.array([t.decode() for t in held], pa.string()), pa.array(list(held.values()), pa.int64())]
            return pa.RecordBatch.from_arrays(columns, ["term", "n"])

        for batch in batches:
            for text in batch.column("text").cast(pa.binary()).to_pylist():
                held.update(set(terms_of(text)) if asked is None else asked.intersection(terms_of(text)))
            if len(held) > COUNTED_TERMS:
                yield sent()
                held.clear()
        yield sent()

    counted = texts(docs, text_col=text_col, id_col=None).select("text").mapInArrow(count, "term string, n long").groupBy("term").agg(F.sum("n").alias("with_term"))
    return counted if known else counted.join(terms, "term", "left_semi")


def disclosing(
    docs: DataFrame, found: DataFrame, *, text_col: str = "text", least_docs: int = 2, least_share: float = 0.5, least_bits: float = 4.0,
    smooth: float = 1.5, broadcast_terms: int = BROADCAST_TERMS,
) -> DataFrame:
    """entity, term, bits of the pairs that disclose; an entity is a value (`email:a@b.c`) or a kind (`email:*`)."""
    n = found.count()
    close = found.where(F.size("near") > 0).withColumn("entities", _entities(F.col("near")))
    pairs = close.select(F.explode(F.array_distinct("entities")).alias("x")).groupBy("x.entity", "x.term").agg(F.count("*").alias("both"))
    pairs = written(pairs.where(F.col("both") >= least_docs), "pii-pairs")
    held = close.select(F.explode(F.array_distinct("entities.entity")).alias("entity")).groupBy("entity").agg(F.count("*").alias("with_entity"))
    held = written(held.where(F.col("with_entity") >= least_docs), "pii-entities")
    held = F.broadcast(held) if held.count() <= broadcast_terms else held
    share = F.col("with_entity") / F.lit(float(n))
    smoothed = lambda c: (F.col("both") + smooth * share) / (F.col(c) + smooth)
    # The documents with the term near any value are some of those that hold it, so this share is the most there can be.
    least_holding = pairs.where("entity = '*'").select("term", F.col("both").alias("near_any"))
    open_ = pairs.where("entity <> '*'").join(held, "entity").join(least_holding, "term").where(smoothed("near_any") >= least_share)
    open_ = written(open_, "pii-open")
    counted = open_.join(_holding(docs, open_.select("term"), text_col, broadcast_terms), "term")
    bits = F.log2(smoothed("with_term") / share)
    return counted.withColumn("bits", bits).where((smoothed("with_term") >= least_share) & (F.col("bits") >= least_bits)).select("entity", "term", "bits")


def _marked(docs: DataFrame, pairs: DataFrame, id_col: str, text_col: str, broadcast_terms: int) -> DataFrame:
    """doc_id, text_hash, base, terms of every row: all places of disclosing terms, outside of base spans."""
    terms = written(pairs.groupBy("term").agg(F.max("bits").alias("bits")), "pii-terms")
    small = terms.count() <= broadcast_terms
    known = docs.sparkSession.sparkContext.broadcast({r.term: r.bits for r in terms.toLocalIterator()}) if small else None

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits_of = known.value if small else None
        names = frozenset(t.encode() for t in bits_of) if small else None
        for batch in batches:
            base, places = [], []
            texts_ = batch.column("text")
            for text, raw in zip(texts_.to_pylist(), texts_.cast(pa.binary()).to_pylist(), strict=True):
                found = base_spans(text)
                base.append([{"kind": k, "start": a, "end": b} for a, k, b in found])
                # Most texts hold none of the terms, and need no places of words.
                none = small and names.isdisjoint(terms_of(raw))
                here = [] if none else [(a, b, text[a:b].translate(_LOWER)) for a, b in free_words(text, found)]
                if small:
                    places.append([{"start": a, "end": b, "bits": bits_of[w]} for a, b, w in here if w in bits_of])
                else:
                    places.append([{"start": a, "end": b, "term": w} for a, b, w in here])
            last = ("bits", pa.float64()) if small else ("term", pa.string())
            place = pa.struct([("start", pa.int32()), ("end", pa.int32()), last])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_hash"), pa.array(base, pa.list_(SPAN)), pa.array(places, pa.list_(place))],
                ["doc_id", "text_hash", "base", "terms"],
            )

    rows = texts(docs, id_col, text_col).withColumn("text_hash", F.xxhash64("text"))
    of = "doc_id long, text_hash long, base array<struct<kind:int,start:int,end:int>>, terms array<struct<start:int,end:int,{}>>"
    if small:
        return rows.mapInArrow(scan, of.format("bits:double"))
    rows = written(rows.mapInArrow(scan, of.format("term:string")).withColumn("rid", F.monotonically_increasing_id()), "pii-words")
    told = rows.select("rid", F.explode("terms").alias("x")).select("rid", "x.*").join(terms, "term")
    told = told.groupBy("rid").agg(F.sort_array(F.collect_list(F.struct("start", "end", "bits"))).alias("terms"))
    none = F.array().cast("array<struct<start:int,end:int,bits:double>>")
    return rows.drop("terms").join(told, "rid", "left").select("doc_id", "text_hash", "base", F.coalesce("terms", none).alias("terms"))


def spans(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", near: int = 6, everywhere: bool = False,
    broadcast_terms: int = BROADCAST_TERMS, **thresholds,
) -> DataFrame:
    """doc_id, text_hash, base, terms: spans by pattern, and spans of disclosing terms with their `bits`, of every row.
    Terms are marked near their value, or with `everywhere` wherever they stand."""
    found = find(docs, id_col=id_col, text_col=text_col, near=near)
    pairs = written(disclosing(docs, found, text_col=text_col, broadcast_terms=broadcast_terms, **thresholds), "pii-disclosing")
    if everywhere:
        return _marked(docs, pairs, id_col, text_col, broadcast_terms)
    kind = F.concat(F.substring_index("value", ":", 1), F.lit(":*"))
    close = found.where(F.size("near") > 0).select("rid", F.explode("near").alias("x")).select("rid", "x.*")
    close = close.withColumn("entity", F.explode(F.array("value", kind)))
    told = close.join(pairs, ["entity", "term"]).groupBy("rid", "start", "end").agg(F.max("bits").alias("bits"))
    terms = told.groupBy("rid").agg(F.sort_array(F.collect_list(F.struct("start", "end", "bits"))).alias("terms"))
    with_terms = found.where(F.size("near") > 0).join(terms, "rid", "left")
    without = found.where(F.size("near") == 0).withColumn("terms", F.lit(None).cast("array<struct<start:int,end:int,bits:double>>"))
    out = with_terms.select(*without.columns).union(without)
    return out.select("doc_id", "text_hash", "base", F.coalesce("terms", F.array().cast("array<struct<start:int,end:int,bits:double>>")).alias("terms"))


def report(found: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans of each row of `spans`."""
    kind_names = F.array(*map(F.lit, KINDS))
    text_of = lambda s: F.concat_ws(":", F.element_at(kind_names, s["kind"] + 1), s["start"], s["end"])
    joined = lambda c: F.array_join(F.transform(c, text_of), ",")
    term = F.transform("terms", lambda t: F.struct(t["start"].alias("start"), F.lit(KINDS.index("term")).alias("kind"), t["end"].alias("end")))
    base = F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    n = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "doc_id", *(n(k).alias(f"n_{name}") for k, name in enumerate(KINDS[:4])),
        F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.array_sort(F.concat(base, term))).alias("spans"),
    )


def sanitised_text(text: str, base: list, terms: list, remove_bits: float) -> str:
    """The text with values and terms replaced. Where spans overlap the first goes, and what others cover beyond it."""
    marks = sorted([(s["start"], s["end"], f"<{KINDS[s['kind']].upper()}>") for s in base] + [(t["start"], t["end"], "" if t["bits"] >= remove_bits else "<TERM>") for t in terms])
    out, at = [], 0
    for start, end, by in marks:
        if start >= at:
            out += [text[at:start], by]
        at = max(at, end)
    return "".join([*out, text[at:]])


def sanitised(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", remove_bits: float = 12.0, everywhere: bool = True, **options) -> DataFrame:
    """doc_id, text of every document, values and disclosing terms replaced."""
    found = spans(docs, id_col=id_col, text_col=text_col, everywhere=everywhere, **options).where((F.size("base") > 0) | (F.size("terms") > 0)).dropDuplicates(["doc_id", "text_hash"])
    found = found.select(F.col("doc_id").alias("id"), F.col("text_hash").alias("h"), "base", "terms")

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [sanitised_text(r["text"], r["base"] or [], r["terms"] or [], remove_bits) for r in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(done, pa.string())], ["doc_id", "text"])

    rows = texts(docs, id_col, text_col).withColumn("text_hash", F.xxhash64("text"))
    joined = rows.join(found, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_hash") == F.col("h")), "left")
    return joined.select("doc_id", "text", "base", "terms").mapInArrow(clean, "doc_id long, text string")
