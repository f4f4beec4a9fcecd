import hashlib
import math
import random
import re
import time

import duckdb
import pytest

from casemetrics.llm import pii, url_filter
from casemetrics.llm.common import table
from casemetrics.operators import sizing

URLS = [
    None, "", "no scheme", "http://NET/", "http://a.net", "http://a.net?x=/en/", "HTTP://Sub.Example.NET/en/1", "http://example.net/en",
    "http://myexample.net/en/x", "x://example.com/de/", "x://wexample.com/de/", "x://a.org/fr/#", "x://org/FR/", "x://a.b//fr/", "a://b://c.net/x",
    "x://a.net:80/", "x:///net/", "x://a..net/", "x://É.org/fr/é?é", "x://a.net\n.org/fr/\n",
]


def test_urls_equal_sql(spark, tmp_path):
    rows = [(i, u, "k", "v") for i, u in enumerate(URLS)] + [(99, "x://a.net/", "k", "v")] * 2
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, rule string")
    got = sorted(map(tuple, url_filter.judge(pages, **url_filter.RULES).collect()), key=str)
    connection = duckdb.connect()
    connection.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR)")
    connection.executemany("INSERT INTO pages VALUES (?, ?)", [r[:2] for r in rows[:-1]])
    want = connection.execute(url_filter.SQL).fetchall()
    want += [r for r in want if r[0] == 99]
    assert got == sorted(want, key=str)
    assert url_filter.judge(pages.limit(0), **url_filter.RULES).collect() == []


def test_hosts_of_thousands_of_labels(spark):
    host = "a." * 8000
    pages = spark.createDataFrame([(1, f"x://{host}net/p"), (2, f"x://{host}org/fr/"), (3, f"x://{host}de/")], "page_id long, url string")
    begun = time.monotonic()
    got = url_filter.judge(pages, **url_filter.RULES).orderBy("page_id").collect()
    assert [(r.rule, r.verdict) for r in got] == [("net/", "block"), ("org/fr/", "allow"), (None, "allow")]
    assert time.monotonic() - begun < 20


@pytest.mark.parametrize("n", [3, 60, 1500])
def test_cascade_is_exact(spark, n):
    universe = [f"host{i}.net/" for i in range(4000)]
    chosen = random.Random(n).sample(universe, n)
    frame = spark.createDataFrame([(x,) for x in universe], "key string")
    levels = url_filter.cascade(frame, chosen)
    assert len(levels) > 1 or n == 3
    found = [r.key for r in frame.filter(url_filter.listed(frame.key, levels)).collect()]
    assert sorted(found) == sorted(chosen)
    with pytest.raises(ValueError, match="bits"):
        url_filter.cascade(frame, chosen, max_bits=8)


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits):
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else d * 2 // 10 + d * 2 % 10
    return total % 10 == 0


def plain_spans(text):
    text = text or ""
    out = [(m.start(), 0, m.end(), "email") for m in EMAIL.finditer(text)]
    out += [(m.start(), 1, m.end(), "ip") for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        digits = re.sub("[^0-9]", "", m[0])
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end(), "card"))
    for m in PHONE.finditer(text):
        if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append((m.start(), 3, m.end(), "phone"))
    return sorted(out)


TEXTS = [
    None, "", "a@b.c_d@e.f", "x a.b+c%d@mail-1.example.com.", "a@b a@b. a@b..c a@.b.c @a.b .@a.b", "é a@b.cé😀 z@y.xx 1.2.3.4",
    "1.2.3.4.5.6.7.8 256.1.1.1 001.2.3.4 1.2.3.0000255 1..2.3.4 99999999999.1.1.1", "4111 1111 1111 1111 x 4111-1111-1111-1111 4111  11111111 1111",
    "4111111111111111 1", "+1 (988) 555-2485 +12 +4912345678901234 ++1 234 567 890.", "+1 2 3 4 5 6 7 8 9 . -", "1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6 7 8 9 0",
    "\ue000\ue001a@b\ue001c.d 4111\ue0001111 1111 1111", "9" * 30000, "a" * 30000 + "@", "a." * 15000 + "@b.c", "x@" + "a." * 15000 + "b", "1 " * 15000, "+" * 3000, "1." * 20000,
]


def test_base_spans_equal_patterns(spark):
    source = random.Random(3)
    texts = TEXTS + ["".join(source.choices("a1@.- +()259é_", k=source.randint(5, 120))) for _ in range(400)]
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(texts)], "doc_id long, text string, term string, entity string")
    for r in pii.report(docs).collect():
        want = plain_spans(texts[r.doc_id])
        joined = ",".join(f"{k}:{a}:{b}" for a, _, b, k in want)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest(), (texts[r.doc_id], joined, r.spans)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for *_, k in want) for x in pii.KINDS]


def test_terms_that_disclose(spark):
    rows = [(i, f"common words here Zorblatt mail zed@x.org often {w}") for i, w in enumerate(["one", "two", "three"])]
    rows += [(10 + i, f"common words here often mail other{i}") for i in range(40)] + [(90, "zorblatt ZORBLATT nothing"), (91, None)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, term string")
    got = {r.doc_id: r.spans for r in pii.report(docs).collect()}
    assert got[0].count("term") == 1 and "email" in got[0] and got[10] == "" and got[90] == ""
    clean = {r.doc_id: r.text for r in pii.sanitise(docs).collect()}
    assert clean[0] == "common words here  mail <email> often one"
    assert clean[90] == "zorblatt ZORBLATT nothing" and clean[91] is None
    assert pii.sanitise(docs).columns == docs.columns
    assert pii.report(docs.limit(0)).collect() == []


def test_terms_far_from_their_entity(spark):
    filler = " ".join(f"plain{i}" for i in range(60))
    rows = [(i, f"Dear Quandary Li, {filler} ends{i} zed.far@x.org") for i in range(3)]
    rows += [(10 + i, f"Dear other{i}, {filler} zorro y@z{i}.org") for i in range(40)]
    # stands next to its entity twice, and without it in many other documents
    rows += [(100 + i, f"{'near' if i < 2 else 'apart'} loose {filler} {'p@q.net loose' if i < 2 else ''}") for i in range(30)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, term string")
    clean = {r.doc_id: r.text for r in pii.sanitise(docs).collect()}
    for i in range(3):
        assert clean[i] == f"Dear  , {filler} ends{i} <email>"
    assert clean[10] == f"Dear other0, {filler} zorro <email>"
    assert clean[100] == f" loose {filler} <email> loose"


def plain_terms(texts):
    held, words = {}, {}
    for d, text in enumerate(texts):
        spans = plain_spans(text)
        rest = list(text)
        for a, _, b, _ in spans:
            rest[a:b] = " " * (b - a)
            held.setdefault(text[a:b], set()).add(d)
        for w in re.findall(r"[^\W_]+", "".join(rest).lower()):
            words.setdefault(w, set()).add(d)
    out = {}
    for e, docs in held.items():
        for w, others in words.items():
            both = len(docs & others)
            content = math.log2(len(texts) / len(docs))
            if min(both, len(docs)) >= 2 and content > 0:
                if math.log2(both * len(texts) / (len(docs) * len(others))) >= 0.8 * content:
                    for d in docs:
                        out.setdefault(d, set()).add(w)
    return out


@pytest.mark.parametrize("hot", [False, True])
def test_terms_equal_plain_counts(spark, monkeypatch, hot):
    if hot:  # lookups by shuffle, with spread keys
        monkeypatch.setattr(sizing, "MAX_BROADCAST_ROWS", 0)
        monkeypatch.setattr(sizing, "HOT_KEY_ROWS", 2)
    source = random.Random(8)
    texts = []
    for _ in range(150):
        words = source.choices([f"w{i}" for i in range(80)], k=30)
        for e in source.sample(range(40), source.randint(0, 2)):
            words.insert(source.randrange(31), f"m{e}@x{e}.org")
            words.insert(source.randrange(31), f"Name{e}")
        texts.append(" ".join(words))
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, term string")
    want = plain_terms(texts)
    assert sum(map(len, want.values())) > 50
    for r in pii.report(docs).collect():
        spans = [x.split(":") for x in r.spans.split(",") if x.startswith("term:")]
        assert {texts[r.doc_id][int(a) : int(b)].lower() for _, a, b in spans} == want.get(r.doc_id, set())


def test_given_documents(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = pii.report(docs).collect()
    assert len(rows) == len(texts)
    for r in rows:
        joined = ",".join(f"{k}:{a}:{b}" for a, _, b, k in plain_spans(texts[r.doc_id]))
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
