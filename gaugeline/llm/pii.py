"""Personal data: fixed patterns, and terms that the corpus shows to disclose a protected entity.

An entity is a value that a pattern finds (an address, a number), or what such values have in common: the
domain of an address, the first two numbers of an ip, the first six digits of a card, the first four of a
phone. The method is information-theoretic sanitisation: a term (a word of letters, in small letters) of a
text that holds an entity is weighed by how much of the entity's information it gives away,
    disclosure = PMI(term; entity) / IC(entity),
    PMI = log2(N n(t, e) / (n(t) n(e))),  IC = log2(N / n(e)),
where N and n() count distinct whole texts of the whole corpus, so that copies count once. A disclosure of 1
means that the term occurs in no text without the entity. Terms of at least `remove` are removed, those
of at least `generalise` are replaced by the general word <TERM>, in every text and wherever they stand outside
the fixed patterns. A term that discloses several entities is treated by the largest disclosure.

Chance is kept out by a test of independence among the M texts that hold any entity, so that words which are
merely common where data of some kind stands disclose no single entity. Were the entity's texts drawn at random
from these, so many of them with the term, n(t, e), would come up with a probability (the tail of a
hypergeometric distribution) of at most exp(-m(t) KL(n(t, e) / m(t) || n(e) / M)), m(t) being the term's texts
among the M, and likewise with the roles of term and entity changed. A pair counts only if the smaller of the two
bounds, times the number of pairs that are tested (all entities of more than one text with all terms of the M
texts), is `chance` at most. So where entities are dealt to these texts at random, the probability that any term
is found is `chance`. An entity that stands in all of them is tested against all texts instead.

Texts are read three times: for the patterns and the terms of texts that hold any, to count the texts of
terms, and to find the places of those that disclose. The last two skip words that cannot be wanted with a
Bloom filter of at most 2^MOST_BITS bits, which is all that is sent to tasks; what the bitmap lets through by
mistake falls away in a join, so every bitmap gives the same result.

Defined results: a null text counts as empty; rows that repeat a document get equal results; an empty
table gives no rows; extra columns are ignored, and sanitised() hands them on, whatever their names.
"""

from __future__ import annotations

import bisect
import itertools
import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeline.llm.common import hold, letter_runs, letter_spans, mapped, slices, unused, words_of

KINDS = ("email", "ip", "card", "phone")
#: The patterns. Email is matched from its @; the local part is the run before it.
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:\x20?[0-9]|-[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
MOST_BITS = 24


def luhn(digits: str) -> bool:
    d = np.frombuffer(digits.encode(), np.uint8)[::-1] - 48
    twice = d[1::2] * 2
    return (int(d[::2].sum()) + int((twice - 9 * (twice > 9)).sum())) % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind number, start, end) of the fixed patterns, each kind leftmost and without overlap; failing matches are dropped."""
    out = []
    if "@" in text:
        last = 0
        for m in DOMAIN.finditer(text):
            start = m.start()
            while start > last and text[start - 1] in LOCAL:
                start -= 1
            if start < m.start():
                out.append((0, start, m.end()))
                last = m.end()
    for m in IP.finditer(text):
        if all(len(x) < 4 and int(x) < 256 for x in (p.lstrip("0") or "0" for p in m[0].split("."))):
            out.append((1, m.start(), m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = re.sub("[^0-9]", "", m[0])
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append((2, m.start(), m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= sum(c in "0123456789" for c in m[0]) <= 15:
                out.append((3, m.start(), m.end()))
    return out


def entities_of(kind: int, value: str) -> tuple[int, int]:
    """Hashes of a value and of what it has in common with others of its kind (see the module's text)."""
    if kind == 0:
        value = value.lower()
        shared = value.rpartition("@")[2]
    else:
        value = re.sub("[^0-9.]" if kind == 1 else "[^0-9]", "", value)
        shared = ".".join(value.split(".")[:2]) if kind == 1 else value[: 6 if kind == 2 else 4]
    return tuple(xxhash.xxh3_64_intdigest(f"{KINDS[kind]}:{level}:{x}") - 2**63 for level, x in enumerate((value, shared)))


def outer_terms(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[str, int, int]]:
    """(term, start, end) of the words of a text that touch none of its spans."""
    return [(text[a:b].lower(), a, b) for a, b in untouched(letter_spans(text), spans)]


def untouched(places: Iterable[tuple[int, int]], spans: list[tuple[int, int, int]]) -> Iterator[tuple[int, int]]:
    """The places (start, end) that touch no span."""
    taken = sorted((a, b) for _, a, b in spans)
    starts = [a for a, _ in taken]
    reach = list(itertools.accumulate((b for _, b in taken), max))
    for a, b in places:
        k = bisect.bisect_left(starts, b)  # the first k spans start before the place ends
        if not k or reach[k - 1] <= a:
            yield a, b


def outer_places(text: str, terms: set[str]) -> list[tuple[str, int, int]]:
    """Those of outer_terms() that are among a few terms, found without looking at every word."""
    low, found = text.lower(), []
    if len(low) != len(text):  # a letter whose small form is longer
        return [t for t in outer_terms(text, base_spans(text)) if t[0] in terms]
    for term in terms:
        at = low.find(term)
        while at >= 0:
            to = at + len(term)
            if not (at and low[at - 1].isalpha()) and not low[to : to + 1].isalpha():
                found.append((at, to))
            at = low.find(term, at + 1)
    return [(low[a:b], a, b) for a, b in untouched(sorted(found), base_spans(text))]


def terms_of(token: str) -> list[str]:
    """The terms of a word between white space."""
    return [token.lower()] if token.isalpha() else [w.lower() for w in letter_runs(token)]


FOUND = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.string()), ("base", pa.string()), *((f"n_{k}", pa.int64()) for k in KINDS), ("entities", pa.list_(pa.int64())), ("terms", pa.list_(pa.string()))])


def base_pass(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, base, n_email .. n_phone, entities, terms) for every row; base is kind:start:end,
    comma-joined; the last two are the distinct ones of a text that holds an entity."""

    def run(part: pa.RecordBatch) -> list:
        rows = []
        for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
            text = text or ""
            spans = base_spans(text)
            held = sorted({e for kind, a, b in spans for e in entities_of(kind, text[a:b])})
            terms = sorted({t for t, _, _ in outer_terms(text, spans)}) if spans else []
            base = ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)
            rows.append((doc, xxhash.xxh3_128_hexdigest(text), base, *(sum(s[0] == k for s in spans) for k in range(4)), held, terms))
        return [pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), FOUND, strict=True)]

    schema = "doc_id long, text_hash string, base string, n_email long, n_ip long, n_card long, n_phone long, entities array<long>, terms array<string>"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(mapped(run, FOUND), schema)


@dataclass(frozen=True)
class Bitmap:
    """A Bloom filter of three slots a text, in a table of 2^bits: never misses one of its texts, lets others
    through by chance."""

    slots: np.ndarray
    bits: int

    @staticmethod
    def places(hashes: np.ndarray, bits: int) -> np.ndarray:
        return np.stack([(hashes >> np.uint64(s)) & np.uint64(2**bits - 1) for s in (40, 20, 0)]).astype(np.int64)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        return self.slots[self.places(hashes, self.bits)].all(0)

    def __contains__(self, text: str) -> bool:
        return bool(self.has(np.array([xxhash.xxh3_64_intdigest(text)], np.uint64))[0])


def bitmap(values: DataFrame, count: int) -> Bitmap:
    """The bitmap of one text column of about `count` rows: 64 bits a row or more, 2^MOST_BITS at most."""
    n = min(MOST_BITS, max(16, (64 * count).bit_length()))

    def slots(batches):
        for b in batches:
            hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, b.column(0).to_pylist()), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(Bitmap.places(hashes, n)))], names=["slot"])

    at = values.mapInArrow(slots, "slot long").select((F.col("slot") / 64).cast("int").alias("word"), F.expr("shiftleft(1L, cast(slot % 64 AS int))").alias("bit"))
    bits = np.zeros(2**n // 64, np.int64)
    for r in at.groupBy("word").agg(F.bit_or("bit").alias("bits")).toLocalIterator():
        bits[r["word"]] = r["bits"]
    return Bitmap(np.unpackbits(bits.view(np.uint8), bitorder="little").astype(bool), n)


class Hits(dict):
    """Word between white space -> those of its terms that a bitmap lets through; up to `most` words are kept."""

    most = 300_000

    def __init__(self, wanted: Bitmap) -> None:
        super().__init__()
        self.wanted = wanted

    def of(self, tokens: list[str]) -> list[tuple[str, ...]]:
        if len(self) > self.most:
            self.clear()
        new = [t for t in tokens if t not in self]
        terms = [terms_of(t) for t in new]
        flat = [w for ws in terms for w in ws]
        good = iter(self.wanted.has(np.fromiter(map(xxhash.xxh3_64_intdigest, flat), np.uint64, len(flat))).tolist())
        for t, ws in zip(new, terms, strict=True):
            self[t] = tuple([w for w in ws if next(good)])
        return [self[t] for t in tokens]


def term_counts(docs: DataFrame, found: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, n_term): in how many distinct texts each term occurs, over the whole corpus.

    A task counts the rows of each wanted term, which gives at most a row a term and task. Texts that
    have copies also leave the task, once each, with their terms; what the copies add is taken off."""
    copies = hold(found.groupBy("text_hash").agg((F.count(F.lit(1)) - 1).alias("more")).where("more > 0"))
    wanted, copied = bitmap(terms, terms.count()), bitmap(copies.select("text_hash"), copies.count())
    schema = pa.schema([("term", pa.string()), ("n", pa.int64()), ("text_hash", pa.string()), ("terms", pa.list_(pa.string()))])

    def count(batches):
        hits, rows = Hits(wanted), Counter()
        seen: dict[str, list[str]] = {}

        def out():
            yield pa.RecordBatch.from_arrays([pa.array(list(rows), pa.string()), pa.array(list(rows.values()), pa.int64()), pa.nulls(len(rows), pa.string()), pa.nulls(len(rows), schema[3].type)], schema=schema)
            yield pa.RecordBatch.from_arrays([pa.nulls(len(seen), pa.string()), pa.nulls(len(seen), pa.int64()), pa.array(list(seen), pa.string()), pa.array(list(seen.values()), schema[3].type)], schema=schema)
            rows.clear()
            seen.clear()

        for part in (p for b in batches for p in slices(b)):
            words, texts = words_of(part.column(0)), part.column(0)
            hit = hits.of(words.tokens)
            full = np.fromiter(map(bool, hit), bool, len(hit))[words.at]
            for i in np.flatnonzero(words.sums(full)):
                a, b = words.first[i], words.first[i + 1]
                here = {w for k in set(words.at[a:b][full[a:b]].tolist()) for w in hit[k]}
                rows.update(here)
                h = xxhash.xxh3_128_hexdigest(texts[int(i)].as_py())
                if h in copied:
                    seen[h] = sorted(here)
            if len(rows) > 300_000 or len(seen) > 20_000:
                yield from out()
        yield from out()

    counted = hold(docs.select(F.col("text").cast("string").alias("text")).mapInArrow(count, "term string, n long, text_hash string, terms array<string>"))
    twice = counted.where("text_hash is not null").dropDuplicates(["text_hash"]).join(copies, "text_hash").select(F.explode("terms").alias("term"), (-F.col("more")).alias("n"))
    all_rows = counted.where("term is not null").select("term", "n").union(twice)
    return all_rows.groupBy("term").agg(F.sum("n").alias("n_term")).join(terms, "term", "left_semi")


def tail_bound(both: Column, n: Column, share: Column) -> Column:
    """The logarithm of a bound on the probability that `both` or more of n texts drawn without replacement are
    among a `share` of all; 0 where that many are expected."""
    a = both / n
    kl = a * F.log(a / share) + F.when(a < 1, (1 - a) * F.log((1 - a) / (1 - share))).otherwise(0.0)
    return F.when((share < 1) & (a > share), -n * kl).otherwise(0.0)


def disclosing(docs: DataFrame, found: DataFrame, generalise: float = 0.6, remove: float = 0.9, chance: float = 0.05) -> DataFrame:
    """(entity, term, disclosure, action) for pairs whose disclosure reaches `generalise` and is no chance."""
    held = found.where(F.size("entities") > 0).dropDuplicates(["text_hash"]).select("text_hash", "entities", "terms")
    entities = held.select(F.explode("entities").alias("entity")).groupBy("entity").agg(F.count(F.lit(1)).alias("n_entity"))
    # what stands in one text only cannot be told from chance
    recurring = held.select("terms", F.explode("entities").alias("entity")).join(entities.where("n_entity > 1"), "entity")
    texts, tested = found.select("text_hash").distinct().count(), entities.where("n_entity > 1").count()
    tested *= int(1.1 * found.where(F.size("entities") > 0).select(F.explode("terms").alias("term")).agg(F.approx_count_distinct("term", 0.02)).first()[0]) + 1
    pairs = recurring.select("entity", "n_entity", F.explode("terms").alias("term"))
    both = pairs.groupBy("entity", "term").agg(F.first("n_entity").alias("n_entity"), F.count(F.lit(1)).alias("n_both"))
    holders = held.count()
    among = F.when(F.col("n_entity") < holders, float(holders)).otherwise(float(max(texts, 1)))
    # a term stands in n_both texts at least, where the first bound is the smaller one; pairs that would be
    # chance even then need no count
    least = math.log(max(tested, 1)) + tail_bound(F.col("n_both"), F.col("n_both"), F.col("n_entity") / among)
    both = hold(both.where((F.col("n_both") > 1) & (least <= math.log(chance))).drop("n_entity"))
    terms = hold(both.select("term").distinct())
    of_holders = held.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n_held"))
    n = both.join(entities, "entity").join(term_counts(docs, found, terms), "term").join(of_holders, "term")
    pmi = F.log2(F.lit(float(texts)) * F.col("n_both") / (F.col("n_term") * F.col("n_entity")))
    ic = F.log2(F.lit(float(texts)) / F.col("n_entity"))
    share = F.when(ic > 0, pmi / ic).otherwise(0.0)
    n_term = F.when(F.col("n_entity") < holders, F.col("n_held")).otherwise(F.col("n_term"))
    bound = F.least(tail_bound(F.col("n_both"), n_term, F.col("n_entity") / among), tail_bound(F.col("n_both"), F.col("n_entity"), n_term / among))
    n = n.where(bound + math.log(max(tested, 1)) <= math.log(chance))
    return n.withColumn("disclosure", share).where(F.col("disclosure") >= generalise).select("entity", "term", "disclosure", F.when(F.col("disclosure") >= remove, "remove").otherwise("generalise").alias("action"))


def marked(docs: DataFrame, rules: DataFrame) -> DataFrame:
    """(text_hash, terms) of the distinct texts that hold terms of the rules; terms is an array of (start, end, action) in order."""
    rules = hold(rules.groupBy("term").agg(F.max("action").alias("action")))  # "remove" is the greater text
    wanted = bitmap(rules.select("term"), rules.count())
    schema = pa.schema([("text_hash", pa.string()), ("places", pa.list_(pa.struct([("term", pa.string()), ("start", pa.int64()), ("end", pa.int64())])))])

    def run(batches):
        hits = Hits(wanted)
        for part in (p for b in batches for p in slices(b)):
            words, texts, out = words_of(part.column(0)), part.column(0), []
            hit = hits.of(words.tokens)
            full = np.fromiter(map(bool, hit), bool, len(hit))[words.at]
            for i in np.flatnonzero(words.sums(full)):
                a, b = words.first[i], words.first[i + 1]
                here = {w for k in set(words.at[a:b][full[a:b]].tolist()) for w in hit[k]}
                text = texts[int(i)].as_py()
                places = [{"term": w, "start": x, "end": y} for w, x, y in outer_places(text, here)]
                if places:
                    out.append((xxhash.xxh3_128_hexdigest(text), places))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True) if out else ((), ()), schema, strict=True)], schema=schema)

    places = docs.select(F.col("text").cast("string")).mapInArrow(run, "text_hash string, places array<struct<term: string, start: long, end: long>>")
    places = places.dropDuplicates(["text_hash"]).select("text_hash", F.inline("places"))
    mark = F.struct("start", "end", "action")
    return hold(places.join(rules, "term").groupBy("text_hash").agg(F.sort_array(F.collect_list(mark)).alias("terms")))  # at most a text's words


def find(docs: DataFrame, generalise: float = 0.6, remove: float = 0.9, chance: float = 0.05) -> DataFrame:
    """Every row's doc_id, text_hash, base, n_email .. n_phone and terms, an array of (start, end, action) in order."""
    found = hold(base_pass(docs))
    marks = marked(docs, disclosing(docs, found, generalise, remove, chance))
    return found.drop("entities", "terms").join(marks, "text_hash", "left")


def digest(found: DataFrame) -> DataFrame:
    """doc_id, counts, base_sha256 and spans: all spans as kind:start:end, in the order of kinds, then start; n_term counts the terms."""
    terms = F.transform("terms", lambda x: F.concat(F.lit("term:"), x["start"].cast("string"), F.lit(":"), x["end"].cast("string")))
    base = F.when(F.col("base") != "", F.array("base")).otherwise(F.array().cast("array<string>"))
    spans = F.array_join(F.concat(base, F.coalesce(terms, F.array().cast("array<string>"))), ",")
    return found.select("doc_id", *(f"n_{k}" for k in KINDS), F.sha2("base", 256).alias("base_sha256"), spans.alias("spans"), F.coalesce(F.size("terms"), F.lit(0)).cast("long").alias("n_term"))


def cleaned(text: str, terms: list[dict]) -> str:
    spans = [(a, b, f"<{KINDS[k].upper()}>") for k, a, b in base_spans(text)]
    spans += [(t["start"], t["end"], "" if t["action"] == "remove" else "<TERM>") for t in terms]
    done, pieces = 0, []
    for a, b, word in sorted(spans):
        if a >= done:
            pieces += [text[done:a], word]
        done = max(done, b)
    return "".join([*pieces, text[done:]]) if spans else text


def sanitised(docs: DataFrame, **settings: float) -> DataFrame:
    """The rows with personal data replaced by its kind, disclosing terms removed or generalised, and n_chars, if any, to match.

    Only texts that a bitmap of the marked ones lets through are shuffled, to meet their terms."""
    columns = docs.columns
    key, terms = unused(columns, "text_hash"), unused(columns, "terms")
    marks = marked(docs, disclosing(docs, hold(base_pass(docs)), **settings))
    flagged = bitmap(marks.select("text_hash"), marks.count())
    at = {n: columns.index(n) for n in ("text", "n_chars") if n in columns}

    def fresh(part: pa.RecordBatch, found: list[list[dict]]) -> pa.RecordBatch:
        texts = part.column(at["text"]).to_pylist()
        done = [None if t is None else cleaned(t, x) for t, x in zip(texts, found, strict=True)]
        out = list(part.columns[: len(columns)])
        out[at["text"]] = pa.array(done, part.schema.field(at["text"]).type)
        if "n_chars" in at:
            sizes = part.column(at["n_chars"]).to_pylist()
            sizes = [n if old == new else len(new) for old, new, n in zip(texts, done, sizes, strict=True)]
            out[at["n_chars"]] = pa.array(sizes, part.schema.field(at["n_chars"]).type)
        return pa.RecordBatch.from_arrays(out, names=columns)

    def parted(part: pa.RecordBatch, through: bool) -> tuple[pa.RecordBatch, list[str]]:
        """The rows that the bitmap lets through, or the others, and their hashes."""
        hashes = [xxhash.xxh3_128_hexdigest(t or "") for t in part.column(at["text"]).to_pylist()]
        here = (flagged.has(np.fromiter(map(xxhash.xxh3_64_intdigest, hashes), np.uint64, len(hashes))) == through).tolist()
        return part.filter(pa.array(here, pa.bool_())), [h for h, x in zip(hashes, here, strict=True) if x]

    def plain(batches):
        for part in (p for b in batches for p in slices(b)):
            rows, hashes = parted(part, False)
            yield fresh(rows, [[]] * len(hashes))

    def keyed(batches):
        for part in (p for b in batches for p in slices(b)):
            rows, hashes = parted(part, True)
            yield rows.append_column(key, pa.array(hashes, pa.string()))

    def clean(batches):
        for part in (p for b in batches for p in slices(b)):
            yield fresh(part, [x or [] for x in part.column(part.num_columns - 1).to_pylist()])

    kinds = ", ".join(f"`{n}` {t}" for n, t in docs.dtypes)
    met = docs.mapInArrow(keyed, f"{kinds}, `{key}` string").join(marks.toDF(key, terms), key, "left").select(*(f"`{c}`" for c in columns), terms)
    return docs.mapInArrow(plain, docs.schema).unionByName(met.mapInArrow(clean, docs.schema))
