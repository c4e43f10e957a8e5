import hashlib
import math
import re

from pyspark.sql import Window
from pyspark.sql import functions as F

from gaugeline.llm import pii

TEXTS = [
    None,
    "",
    "a@b@c.com, x.y@z-1.example.org. @d.com 1.2.3.4.5 999.1.1.1 0001.2.3.4 4111 1111-1111 1111 12345678901234 +1 (499) 555-6503, +49-1",
    "id@@a.b..c.d+4 5 6 7 8 9 10 11 12 13+1 2 3 4 5 6 7 8 9",
    "é@a.b café.x@mail.example.com 1.2.3." + "4" * 5000 + " " + "9" * 6000 + "@" + "a" * 50,
]


def brute(text):
    """The patterns exactly as the contract has them."""
    text = text or ""
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()][::-1]
        if 13 <= len(d) <= 19 and (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0:
            out.append(("card", m.start(), m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append(("phone", m.start(), m.end()))
    return ",".join(f"{k}:{a}:{b}" for k, a, b in out)


def test_base_spans_equal_the_patterns(docs):
    rows = {r["doc_id"]: r for r in pii.digest(pii.find(docs(list(enumerate(TEXTS))))).collect()}
    assert len(rows) == len(TEXTS)
    for i, t in enumerate(TEXTS):
        assert rows[i]["base_sha256"] == hashlib.sha256(brute(t).encode()).hexdigest(), t
        assert rows[i]["n_email"] == brute(t).count("email:")


def corpus():
    """`zorblat` stands only where one address does; `common` stands everywhere."""
    rows = [(i, f"text {i} from common zorblat ann@mail.example.com sent {i} more words") for i in range(4)]
    return rows + [(i, f"text {i} from common folk with nothing to hide, sent today") for i in range(4, 40)]


def test_terms_that_only_stand_with_an_entity_are_disclosing(docs):
    d = docs(corpus())
    found = pii.base_pass(d)
    rules = {r["term"]: r for r in pii.disclosing(d, found).collect()}
    assert "common" not in rules and "text" not in rules
    assert abs(rules["zorblat"]["disclosure"] - 1) < 1e-9 and rules["zorblat"]["action"] == "remove"


def test_sanitised_texts_keep_columns_and_lose_the_data(docs):
    d = docs([*corpus(), (40, None), (41, ""), (3, corpus()[3][1])])
    out = pii.sanitised(d)
    assert out.columns == d.columns
    rows = sorted(out.collect(), key=lambda r: r["doc_id"])
    assert len(rows) == 43
    assert not any("ann@" in (r["text"] or "") or "zorblat" in (r["text"] or "") for r in rows)
    assert rows[0]["text"].count("<EMAIL>") == 1 and rows[0]["n_chars"] == len(rows[0]["text"])
    assert rows[10]["text"] == d.where("doc_id = 9").first()["text"]


def test_empty_table(docs):
    assert pii.digest(pii.find(docs([]))).count() == 0
    assert pii.sanitised(docs([])).count() == 0


def test_term_counts_are_distinct_texts(spark, docs):
    rows = [(i, f"alpha beta {i % 5}") for i in range(20)] + [(20, "alpha"), (21, "alpha, Gamma"), (22, None)]
    d = docs(rows)
    terms = spark.createDataFrame([("alpha",), ("beta",), ("gamma",), ("absent",)], "term string")
    got = {r["term"]: r["n_term"] for r in pii.term_counts(d, pii.base_pass(d), terms).collect()}
    assert got == {"alpha": 7, "beta": 5, "gamma": 1}


def test_a_term_goes_wherever_it_stands_in_a_text_with_the_entity(docs):
    far = "and a paragraph of plain words that nobody needs to hide goes on here "
    rows = [(i, f"no {i} zorblat ann@mail.example.com sent. {far * 3} zorblat again, {far} Quuxley") for i in range(3)]
    rows += [(i, f"no {i} {far} sent again") for i in range(3, 40)]
    d = docs(rows)
    texts = {r["doc_id"]: r["text"] for r in pii.sanitised(d).collect()}
    assert not any(w in t.lower() for t in texts.values() for w in ("zorblat", "quuxley", "ann@"))
    assert texts[0].count("paragraph") == 4 and texts[7] == rows[7][1]


def brute_bound(both, n, share):
    """The bound of the module's text on the tail of the hypergeometric distribution."""
    a = both / n
    if a <= share:
        return 1.0
    return math.exp(-n * (a * math.log(a / share) + ((1 - a) * math.log((1 - a) / (1 - share)) if a < 1 else 0)))


def test_the_bound_is_never_under_the_tail():
    for texts, n_term, n_entity in [(40, 4, 4), (100, 7, 20), (300, 50, 9), (60, 30, 30)]:
        for both in range(1, min(n_term, n_entity) + 1):
            tail = sum(math.comb(n_entity, k) * math.comb(texts - n_entity, n_term - k) for k in range(both, min(n_term, n_entity) + 1)) / math.comb(texts, n_term)
            assert brute_bound(both, n_term, n_entity / texts) >= tail * (1 - 1e-9)


def brute_terms(rows, generalise=0.6, remove=0.9, chance=0.05):
    """doc_id -> term spans by the definition, over distinct texts, with plain loops."""
    texts = {t or "" for _, t in rows}
    spans = {t: [(k, int(a), int(b)) for k, a, b in (s.split(":") for s in brute(t).split(","))] if brute(t) else [] for t in texts}

    def entities(t):
        out = set()
        for k, a, b in spans[t]:
            v = t[a:b].lower() if k == "email" else re.sub("[^0-9.]" if k == "ip" else "[^0-9]", "", t[a:b])
            out |= {(k, "value", v), (k, "shared", {"email": v.split("@")[-1], "ip": ".".join(v.split(".")[:2]), "card": v[:6], "phone": v[:4]}[k])}
        return out

    def places(t):
        return [(m[0].lower(), m.start(), m.end()) for m in re.finditer(r"[^\W\d_]+", t) if not any(a < m.end() and m.start() < b for _, a, b in spans[t])]

    held = {t: entities(t) for t in texts}
    words = {t: {m.lower() for m in re.findall(r"[^\W\d_]+", t)} for t in texts}
    outer = {t: {w for w, _, _ in places(t)} for t in texts}
    rules, every = {}, set().union(*held.values())
    recurring = [e for e in every if sum(e in held[t] for t in texts) > 1]
    tested = len(recurring) * (1.1 * len(set().union(*(outer[t] for t in texts if held[t]))) + 1)
    for e in set().union(*held.values()):
        with_e = [t for t in texts if e in held[t]]
        ic = math.log2(len(texts) / len(with_e))
        for w in set().union(*(outer[t] for t in with_e)):
            n_both, n_term = sum(w in outer[t] for t in with_e), sum(w in words[t] for t in texts)
            among = [t for t in texts if held[t]]
            among, m_term = (among, sum(w in outer[t] for t in among)) if len(with_e) < len(among) else (texts, n_term)
            bound = min(brute_bound(n_both, m_term, len(with_e) / len(among)), brute_bound(n_both, len(with_e), m_term / len(among)))
            if n_both > 1 and ic > 0 and bound * tested <= chance:
                share = math.log2(len(texts) * n_both / (n_term * len(with_e))) / ic
                if share >= generalise:
                    rules[w] = max(rules.get(w, ""), "remove" if share >= remove else "generalise")
    return {i: [(a, b, rules[w]) for w, a, b in places(t or "") if w in rules] for i, t in rows}


def test_term_spans_equal_brute_force(docs):
    import random

    rng = random.Random(3)
    vocabulary = [f"{a}{b}{c}" for a in "bdfgklm" for b in "aeiou" for c in ("", "n", "rst")] + ["Über", "x9y", "it's", "ñandú"]
    people = [("zorbla Quuxley", "ann@mail.example.com"), ("vrendle", "10.20.30.40"), ("Smorg", "+1 (377) 555-0271"), ("pilk", "4111 1111 1111 1111"), ("hapax", "bob@mail.example.com"), ("wug", "10.20.99.1")]
    rows = []
    for i in range(120):
        words = rng.choices(vocabulary, k=rng.randrange(3, 40))
        if i % 3 == 0:
            name, value = people[rng.randrange(len(people))]
            words[rng.randrange(len(words)) : 0] = [name, "near", value]
        elif i % 7 == 0:
            words.append(people[i % len(people)][0])
        rows.append((i, " ".join(words)))
    rows += [(200, rows[3][1]), (201, rows[3][1]), (202, None), (203, ""), (None, rows[0][1])]
    got = {r["doc_id"]: [tuple(x) for x in r["terms"] or ()] for r in pii.find(docs(rows)).collect()}
    want = brute_terms(rows)
    assert got == want
    assert sum(map(len, want.values())) > 20 and {x[2] for v in want.values() for x in v} == {"remove", "generalise"}
    digest = {r["doc_id"]: r for r in pii.digest(pii.find(docs(rows))).collect()}
    for i, t in rows:
        spans = [s for s in [brute(t)] if s] + [f"term:{a}:{b}" for a, b, _ in want[i]]
        assert digest[i]["spans"] == ",".join(spans) and digest[i]["n_term"] == len(want[i])


def test_a_disclosing_term_goes_from_texts_without_the_entity_too(docs):
    rows = [(i, f"no {i} zorblat ann@mail.example.com sent {i}") for i in range(8)] + [(i, f"plain {i} words of folk") for i in range(8, 80)] + [(99, "zorblat alone here")]
    texts = {r["doc_id"]: r["text"] for r in pii.sanitised(docs(rows)).collect()}
    assert not any("zorblat" in t for t in texts.values()) and texts[9] == rows[9][1]


def test_clashing_columns_are_handed_on(docs, spark):
    d = docs([*corpus(), (40, None)]).selectExpr("*", "'h' text_hash", "'b' _base", "'t' terms", "'e' entities", "7 Text_Hash_")
    out = pii.sanitised(d)
    assert out.columns == d.columns and out.count() == 41
    assert {(r["text_hash"], r["_base"], r["terms"], r["Text_Hash_"]) for r in out.collect()} == {("h", "b", "t", 7)}
    assert pii.digest(pii.find(d)).count() == 41


def test_entities_dealt_at_random_disclose_nothing(spark):
    """The permutation null: the texts that hold an entity swap their entities; on the texts as they are, a planted term is found."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    found = pii.base_pass(docs).persist()
    holders = found.where("size(entities) > 0").dropDuplicates(["text_hash"])
    for seed in (1, 2):
        number = lambda s: F.row_number().over(Window.orderBy(F.xxhash64("text_hash", F.lit(s)))).alias("k")
        swapped = holders.select("text_hash", number(0)).join(holders.select("entities", number(seed)), "k").drop("k")
        dealt = found.drop("entities").join(swapped, "text_hash", "left").withColumn("entities", F.coalesce("entities", F.array().cast("array<bigint>")))
        assert pii.disclosing(docs, dealt).count() <= 1
    found.unpersist()
    planted = docs.union(spark.createDataFrame([(10**6 + i, f"note {i} by zorblatine ann{i}@zorblat.example.com, {i * 7} more") for i in range(6)], "doc_id long, text string"))
    rules = {r["term"]: r["action"] for r in pii.disclosing(planted, pii.base_pass(planted)).collect()}
    assert rules["zorblatine"] == "remove"


def test_very_long_texts_and_small_bitmaps(docs, monkeypatch):
    rows = [(i, f"no {i} zorblat ann@mail.example.com sent {i} " + "plain words " * (20_000 if i == 0 else 2)) for i in range(4)] + [(i, f"plain {i} words") for i in range(4, 60)]
    want = {r["doc_id"]: r["text"] for r in pii.sanitised(docs(rows)).collect()}
    assert len(want[0]) > 200_000 and "zorblat" not in want[0]
    monkeypatch.setattr(pii, "MOST_BITS", 16)
    assert want == {r["doc_id"]: r["text"] for r in pii.sanitised(docs(rows)).collect()}


def test_places_of_a_few_terms_equal_those_among_all():
    import random

    rng, parts = random.Random(2), ["ab", "AB", "Abc", "ab2", "ab²", "²ab", "İab", "é", "éab", "ab.ab", "x@ab.com", "1.2.3.4ab", "ab-ab", "Ⅷab", " ", "_ab", "ßab"]
    for _ in range(500):
        text, terms = " ".join(rng.choice(parts) for _ in range(rng.randrange(12))) + rng.choice(parts), {"ab", "abc", "é"}
        assert pii.outer_places(text, terms) == [t for t in pii.outer_terms(text, pii.base_spans(text)) if t[0] in terms], text


def test_runs_of_letters_leave_out_other_numerals():
    from gaugeline.llm.common import letter_runs, letter_spans

    text = "a²b ½ Ⅷ x9y It's ñandú_z ٣"
    assert letter_runs(text) == ["a", "b", "x", "y", "It", "s", "ñandú", "z"]
    assert [text[a:b] for a, b in letter_spans(text)] == letter_runs(text)
