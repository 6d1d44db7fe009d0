import hashlib
import itertools
import random
import re
from collections import Counter

import numpy as np
import pytest

from tidemark.llm import pii_crf as p

RULES = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(re.sub("[^0-9]", "", m)) <= 19 and p.luhn(re.sub("[^0-9]", "", m))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(re.sub("[^0-9]", "", m)) <= 15),
]
TEXTS = [
    "write to a.b+c@x-y.example.com, or @no.one or x@y or p@q.r@s.t.u! é😀 z@ü.de",
    "1.2.3.4.5.6.7.8 300.1.1.1 0255.0.0.1 10.0.0.256 1.2.3 4111 1111 1111 1111 and 4111-1111-1111-1112 4111111111111111 12",
    "+1 (555) 010-9999 +49 30 1234567. +1+2 3456789 ++44 20 7946 0958-",
    "", None, "\n \t", "a@b.c" * 50, "@" * 200, "9" * 5000, "1." * 3000, "+1" + " " * 3000 + "2",
    "Contact: John Smith called 555-123-4567 about 12 Keller Street.\nSSN: 123-45-6789 ok", "plain words of no interest to anyone at all",
]


@pytest.mark.parametrize("text", [t or "" for t in TEXTS])
def test_base_spans_match_the_patterns(text):
    if len(text) > 4000:
        text = text[:4000]
    want = [(i, m.start(), m.end()) for i, (_, r, ok) in enumerate(RULES) for m in re.finditer(r, text) if ok(m[0])]
    assert p.base_spans(text) == want


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(3)
    size = len(p.LABELS)
    f = p.Field(rng.normal(size=(3, sum(s for _, s in p.PARTS), size)), rng.normal(size=(size + 1, size)))
    scores = rng.normal(size=(11, size)).astype(np.float32)
    fresh = np.zeros(11, bool)
    fresh[[0, 1, 5, 9]] = True
    got = f.viterbi(scores, fresh)
    for lo, hi in ((0, 1), (1, 5), (5, 9), (9, 11)):
        value = lambda path: f.move[-1][path[0]] + sum(scores[lo + i][x] for i, x in enumerate(path)) + sum(f.move[a][b] for a, b in zip(path, path[1:]))
        best = max(itertools.product(range(size), repeat=hi - lo), key=value)
        assert abs(value(best) - value(tuple(got[lo:hi].tolist()))) < 1e-4


def other_table(size, seed):
    """Labelled texts by another rule than the field's own table: other names, frames, formats and clean text."""
    rng = random.Random(seed)
    people = ["Olsen", "Grace Takahashi", "Liam O'Brien", "Weiß", "Núñez", "Fatima al-Sayed", "Tom W. Hardy", "Zoë Lindqvist", "Park", "Anneke Visser"]
    things = "the committee agreed that prices fell in spring while exports of copper rose again . Nobody expected Monday ! A reply came late ; see page 14 of 2019 ( draft ) .".split()
    some = lambda: " ".join(rng.choice(things) for _ in range(rng.randint(3, 25)))
    d = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    frames = {
        "name": [("We thank Dr. ", " for the help"), ("Mrs ", " opened the meeting"), ("Signed: ", "\n"), ("according to Prof ", " , costs rose"), ("Please contact ", " before noon"), ("Name: ", "\n")],
        "number": [("fax ", " or write"), ("Account ", " was closed"), ("her passport ", " expired"), ("SSN ", "\n"), ("Mobile: ", " after six"), ("id ", " is known")],
        "address": [("lives at ", " near the park"), ("ship to ", " by Friday"), ("Our office , ", " , has moved")],
    }
    value = {
        "name": lambda: rng.choice(people),
        "number": lambda: rng.choice([d(8), f"{d(3)}-{d(3)}-{d(3)}", f"{d(4)}-{d(4)}", d(10), f"({d(2)}) {d(4)}-{d(4)}"]),
        "address": lambda: f"{rng.randint(1, 999)} {rng.choice(['Baker', 'Old Mill', 'Cherry', 'Königin', 'High'])} {rng.choice(['Street', 'Road', 'Ave', 'Lane', 'St.'])}",
    }
    out = []
    for row in range(size):
        kind = [*frames, None][row % 4]
        lead = some() + rng.choice([" ", "\n", "\n\n"])
        if not kind:
            clean = rng.choice(["Contact the committee .", "Call again in 2019 .", f"{d(2)} Monday prices", "Dear all ,", f"number {d(3)}", "a long road", f"{d(12)} copper", "Street Lane Road", "Monday Monday Monday Monday", f"Nobody , {d(4)}-{d(2)}-{d(2)}"])
            out.append((lead + clean + " " + some(), []))
            continue
        before, after = rng.choice(frames[kind])
        own = value[kind]()
        at = len(lead + before)
        out.append((lead + before + own + after + " " + some(), [(kind, at, at + len(own.rstrip(".")))]))
    return out


def test_field_finds_spans_made_by_another_rule():
    f = p.default_field()
    rows = other_table(1200, seed=99)
    hit, want, got_all = Counter(), Counter(), Counter()
    clean = 0
    for (_, spans), got in zip(rows, p.added_spans([t.encode() for t, _ in rows], f, f.tables())):
        gold = {(4 + p.ADDED.index(k), a, b) for k, a, b in spans}
        clean += bool(got) and not gold
        for name, part in ((hit, gold & set(got)), (want, gold), (got_all, set(got))):
            name.update(p.ADDED[k - 4] for k, _, _ in part)
    for kind in p.ADDED:
        assert hit[kind] >= 0.9 * want[kind] and hit[kind] >= 0.9 * got_all[kind], (hit, want, got_all)
    assert clean <= 3, clean


def test_clean_documents_get_no_added_spans():
    rng = random.Random(4)
    say = lambda: "".join(rng.choice("en ti on er sh qu ça éo ou".split()) for _ in range(rng.randint(1, 4)))
    texts = []
    for i in range(2000):
        words = [say() for _ in range(rng.randint(1, 60))]
        if i % 5 == 0:
            words = [words[0].title()] * len(words)
        if i % 5 == 1:
            words = [w.upper() + "!!" for w in words]
        if i % 5 == 2:
            words = [w + "." if rng.random() < 0.3 else w.title() for w in words]
        texts.append(" ".join(words).encode())
    f = p.default_field()
    assert sum(map(bool, p.added_spans(texts, f, f.tables()))) <= 2


def test_long_lines_and_texts_are_decoded_in_pieces(monkeypatch):
    f = p.default_field()
    tables = f.tables()
    one = [t.replace("\n", " ") for t, _ in other_table(400, seed=5)]
    whole = " ".join(one) + " end"  # a line of thousands of words
    want = {whole[a:b] for _, a, b in p.added_spans([whole.encode()], f, tables)[0]}
    assert len(want) > 200
    for size, joint in ((700, " "), (5000, " "), (700, "\n")):
        monkeypatch.setattr(p, "PIECE", size)
        text = joint.join(one) + " end"
        got = p.added_spans([b"short", text.encode(), whole.encode()], f, tables)
        spans = got[1]
        assert spans == sorted(spans, key=lambda s: s[1]) and all(x[2] <= y[1] for x, y in zip(spans, spans[1:]))
        assert len({text[a:b] for _, a, b in spans} ^ want) <= 0.03 * len(want)


def test_rows(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, TEXTS[0]), (0, TEXTS[0])]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, spans string, n_ip int")
    out = p.personal_data(df).collect()
    assert len(out) == len(rows)
    for r in out:
        base = p.base_spans(TEXTS[r.doc_id or 0] or "")
        assert r.base_sha256 == hashlib.sha256(p._printed(base).encode()).hexdigest()
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(s[0] == k for s in base) for k in range(4))
        assert r.spans.startswith(p._printed(base))
    text = TEXTS[11]
    kinds = {s.split(":")[0]: text[int(s.split(":")[1]) : int(s.split(":")[2])] for s in next(r.spans for r in out if r.doc_id == 11).split(",")}
    assert kinds["name"] == "John Smith" and kinds["address"] == "12 Keller Street"
    assert next(r.spans for r in out if r.doc_id == 12) == ""
    assert p.personal_data(df.limit(0)).collect() == []
