"""Operator 10: information-theoretic sanitisation of personal data.

Direct identifiers (e-mail, IP, card and phone numbers) are the protected
entities. Corpus co-occurrence then estimates how strongly other terms reveal
one of them: for a term t and an entity e, p(e|t) is the share of t's lines, over
all documents, that hold e near t, and log2(p(e|t) / p(e)) the information t
gives about e. A term that exceeds the disclosure thresholds (information,
share, and number of distinct lines in support, so copies of one line count
once) is generalised wherever it occurs.

Passes over the texts: the first finds the identifiers and the terms around
them; the second counts, per batch of texts, the lines of terms with enough
support; the third locates the terms that exceed the thresholds. A bit map of
fixed size drops other words inside the tasks; exact joins decide the rest.
Later passes run only where the one before leaves terms.

Edge cases: null text counts as empty (no spans); null and repeated ``doc_id``
rows each give a row; texts are processed whole, in linear time; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shiplens.llm.common import chunks_by_bytes, is_empty, mix64, saved, word_hashes

#: In the order that ties are listed.
KINDS = ("email", "ip", "card", "phone", "term")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")  # a match never ends inside a run of digits
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")


def _emails(text: str) -> list[tuple[int, int]]:
    """The local part is the run of its characters before an @, so a match is
    found from the @ outwards."""
    out, pos, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > pos and text[start - 1] in _LOCAL:
            start -= 1
        nxt = at + 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((start, m.end()))
            pos = nxt = m.end()
        at = text.find("@", nxt)
    return out


def _is_ip(s: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in s.split("."))


def _luhn(digits: str) -> bool:
    twice = [2 * int(d) for d in digits[-2::-2]]
    return (sum(d - 9 if d > 9 else d for d in twice) + sum(map(int, digits[::-2]))) % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the direct identifiers, sorted."""
    out = [(a, 0, b) for a, b in _emails(text)]
    if _DIGIT.search(text):
        out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if _is_ip(m[0])]
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and _luhn(digits):
                out.append((m.start(), 2, m.end()))
        for m in _PHONE.finditer(text):
            if 9 <= sum(c in "0123456789" for c in m[0]) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


#: Terms are runs of letters, digits and non-ASCII characters.
_NO_TERM = np.array([not (chr(b).isalnum() or b >= 0x80) if b < 0x80 else False for b in range(256)])


def _hash_of(data: bytes) -> int:
    _, _, h = word_hashes(np.frombuffer(data, np.uint8), np.zeros(256, dtype=bool))
    return int(mix64(h[:1]).view(np.int64)[0]) if len(h) else 0


def _folded(text: str) -> str:
    """In lower case, but for characters whose lower case has another length:
    places stay."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(x if len(x := c.lower()) == 1 else c for c in text)


def _outwards(text: str, at: int, limit: int, width: int, back: bool):
    """(bytes read, hashes) of the ``width`` words next to ``at`` on the way to
    ``limit``, those of three bytes or more. Reads twice as far until it has them."""
    reach = width * 64
    while True:
        stop = max(limit, at - reach) if back else min(limit, at + reach)
        data = _folded(text[stop:at] if back else text[at:stop]).encode("utf-8", "surrogatepass")
        s, e, h = word_hashes(np.frombuffer(data, np.uint8), _NO_TERM)
        if stop == limit or len(h) > width:  # else the outermost word may have been cut
            near = slice(-width, None) if back else slice(width)
            return data, h[near][(e - s)[near] >= 3]
        reach *= 2


def _contexts(text: str, spans: list, width: int):
    """(entity, line, term) hashes for the terms within ``width`` words of an
    identifier on its line."""
    out = []
    for a, kind, b in spans:
        end = text.find("\n", b)
        entity = _hash_of(f"{kind}:{text[a:b]}".lower().encode("utf-8", "surrogatepass"))
        before, first = _outwards(text, a, text.rfind("\n", 0, a) + 1, width, back=True)
        after, second = _outwards(text, b, len(text) if end < 0 else end, width, back=False)
        line = _hash_of(before + b"\0" + after)
        terms = set(mix64(np.concatenate((first, second))).view(np.int64).tolist())
        out += [(entity, line, t) for t in terms]
    return out


def _bit_map(terms: DataFrame, bits: int) -> bytes:
    """A map of 2**bits bits with a bit per term's slot: as large for any number of terms."""
    slots = terms.select(F.shiftrightunsigned("term", 64 - bits).cast("int").alias("slot")).distinct()
    out = np.zeros(1 << bits, dtype=bool)
    out[[r["slot"] for r in slots.toLocalIterator()]] = True  # at most 2**bits slots
    return np.packbits(out).tobytes()


def _hits(texts, packed: bytes, bits: int):
    """Occurrences of terms whose slot is set, some texts at a time: the texts'
    bytes and offsets, and per occurrence its text, start, end and hash; last, the
    ends of all lines. Terms are compared in lower case."""
    wanted = np.unpackbits(np.frombuffer(packed, np.uint8)).view(bool)
    data = [_folded(t).encode("utf-8", "surrogatepass") for t in texts]
    for i, j in chunks_by_bytes(data):
        own = data[i:j]
        ends = np.cumsum([len(d) + 1 for d in own])
        buf = np.frombuffer(b"\n".join(own) + b"\n", np.uint8)
        s, e, h = word_hashes(buf, _NO_TERM)
        h = mix64(h)
        hit = np.flatnonzero(wanted[(h >> np.uint64(64 - bits)).astype(np.int64)])
        off = ends - [len(d) + 1 for d in own]
        yield own, off, np.searchsorted(ends, s[hit], side="right"), s[hit], e[hit], h[hit].view(np.int64), np.flatnonzero(buf == 10)


def find_personal_data(docs: DataFrame, min_bits: float = 8.0, min_share: float = 0.5, min_lines: int = 5,
                       width: int = 8, map_bits: int = 20) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): ``base`` and ``spans``, sorted arrays
    of (start, kind number, end) in code points; ``spans`` adds the terms found.

    ``map_bits``: log2 of the bit map's size, which is fixed (128 KB by default).
    """
    return _spans(_keyed(docs), min_bits, min_share, min_lines, width, map_bits).select("doc_id", "base", "spans")


def _keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, text, row_key); with doc_id, row_key names a row's text."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text.alias("text"),
                       F.xxhash64(F.col("doc_id").cast("bigint"), text).alias("row_key"))


def _spans(docs: DataFrame, min_bits: float = 8.0, min_share: float = 0.5, min_lines: int = 5, width: int = 8,
           map_bits: int = 20) -> DataFrame:
    """Per row of ``_keyed`` documents: doc_id, row_key, base, spans."""
    span = "array<struct<start:int,kind:int,end:int>>"
    found_schema = f"doc_id bigint, row_key bigint, lines int, base {span}, near array<struct<entity:bigint,line:bigint,term:bigint>>"

    def first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            base = [base_spans(t) for t in batch["text"]]
            near = [_contexts(t, b, width) if b else [] for t, b in zip(batch["text"], base)]
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "row_key": batch["row_key"],
                                "lines": [t.count("\n") + 1 for t in batch["text"]], "base": base, "near": near})

    found = saved(docs.mapInPandas(first, found_schema), "pii")
    pairs = (found.where(F.size("near") > 0).select(F.explode("near").alias("n")).select("n.*")
             .groupBy("entity", "line", "term").count()  # copies of a line count once
             .groupBy("entity", "term").agg(F.count("*").alias("lines"), F.sum("count").alias("seen")))
    held = found.where(F.size("near") > 0).select(F.explode("near").alias("n")).select("n.entity", "n.line")
    entity_lines = held.distinct().groupBy("entity").agg(F.count("*").alias("entity_lines"))
    strong = saved(pairs.where(F.col("lines") >= min_lines).join(entity_lines, "entity"), "pii_terms")

    spans = found.withColumn("spans", F.col("base"))
    if is_empty(strong):
        return spans.select("doc_id", "row_key", "base", "spans")

    def count(batches: Iterator[pd.DataFrame], packed: bytes) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for data, off, doc, start, _, term, text_ends in _hits(batch["text"], packed, map_bits):
                line = np.searchsorted(text_ends, start)  # a number per line of the joined texts
                seen = np.unique(np.column_stack((line, term)), axis=0)
                terms, lines = np.unique(seen[:, 1], return_counts=True)
                yield pd.DataFrame({"term": terms, "term_lines": lines})

    packed = _bit_map(strong, map_bits)
    often = (docs.mapInPandas(lambda x: count(x, packed), "term bigint, term_lines bigint")
             .groupBy("term").agg(F.sum("term_lines").alias("term_lines")))
    total_lines = max(1, found.agg(F.sum("lines")).first()[0])
    share = F.least(F.col("seen") / F.col("term_lines"), F.lit(1.0))
    telling = saved(strong.join(often, "term").where(
        (share >= min_share) & (F.log2(share * F.lit(float(total_lines)) / F.col("entity_lines")) >= min_bits))
        .select("term").distinct(), "pii_telling")
    if is_empty(telling):
        return spans.select("doc_id", "row_key", "base", "spans")

    def locate(batches: Iterator[pd.DataFrame], packed: bytes) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keys, first = batch["row_key"].to_numpy(), 0
            for data, off, doc, start, end, term, _ in _hits(batch["text"], packed, map_bits):
                rows = []
                for d, x, y, t in zip(doc, start, end, term):
                    here, at = data[d], off[d]
                    begin = len(here[:x - at].decode("utf-8", "surrogatepass"))
                    rows.append((keys[first + d], t, begin, begin + len(here[x - at:y - at].decode("utf-8", "surrogatepass"))))
                first += len(data)
                yield pd.DataFrame(rows, columns=["row_key", "term", "start", "end"])

    packed_telling = _bit_map(telling, map_bits)
    at = docs.mapInPandas(lambda x: locate(x, packed_telling), "row_key bigint, term bigint, start int, end int")
    extra = (at.join(telling, "term").groupBy("row_key").agg(F.collect_set(F.struct(
        "start", F.lit(4).alias("kind"), "end")).alias("extra")))
    free = F.expr("filter(extra, x -> not exists(base, y -> x.start < y.end and y.start < x.end))")
    spans = (found.join(extra, "row_key", "left").withColumn("extra", F.coalesce(free, F.array().cast(span)))
             .withColumn("spans", F.array_sort(F.concat("base", "extra"))))
    return spans.select("doc_id", "row_key", "base", "spans")


def sanitised(text: str, spans) -> str:
    """The text with its spans generalised to their kind's name; of overlapping
    spans the earlier one (the longer at a tie) counts."""
    out, pos = [], 0
    for start, kind, end in sorted(((s["start"], s["kind"], s["end"]) for s in spans), key=lambda x: (x[0], -x[2])):
        if start >= pos:
            out += [text[pos:start], f"[{KINDS[kind].upper()}]"]
            pos = end
    return "".join(out) + text[pos:]


def sanitise_documents(docs: DataFrame, **options) -> DataFrame:
    """``docs`` (doc_id, text) with their spans generalised: doc_id, text. Every
    row gives one, also with a null or repeated doc_id: it meets the spans of its
    own text."""
    rows = _keyed(docs)
    spans = _spans(rows, **options).dropDuplicates(["doc_id", "row_key"]).select(
        F.col("doc_id").alias("span_doc"), F.col("row_key").alias("span_key"), "spans")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"known": b["known"], "id": b["id"], "text": [sanitised(t, s) for t, s in zip(b["text"], b["spans"])]})

    both = rows.join(spans, (F.col("row_key") == F.col("span_key")) & F.col("doc_id").eqNullSafe(F.col("span_doc")))
    return (both.select(F.col("doc_id").isNotNull().alias("known"), F.coalesce("doc_id", F.lit(0)).alias("id"), "text", "spans")
            .mapInPandas(run, "known boolean, id bigint, text string")
            .select(F.when(F.col("known"), F.col("id")).alias("doc_id"), "text"))


def _listed(column: str):
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.concat_ws(",", F.transform(column, lambda s: F.concat_ws(
        ":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))))


def digest(rows: DataFrame) -> DataFrame:
    """Counts per kind, the hash of the base spans, and all spans as text."""
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("bigint").alias(f"n_{KINDS[k]}")
    return rows.select("doc_id", *[count(k) for k in range(4)], F.sha2(_listed("base"), 256).alias("base_sha256"),
                       _listed("spans").alias("spans"))
