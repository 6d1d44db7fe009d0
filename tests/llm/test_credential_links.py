import hashlib
import re
import time

from tidemark.llm import credential_links as k

ASSIGN = re.compile(r"""((?:(?i:password|passwd|secret|token|api_?key)))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def base(text):
    text = text or ""
    spans = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    spans += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    spans += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    spans.sort(key=lambda s: (s[1], k.ORDER[s[0]]))
    return spans


def run(spark, rows):
    df = spark.createDataFrame([(*r, "x", 3) for r in rows], "doc_id long, text string, base string, k1 int")
    return {str(r.doc_id): r for r in k.report(k.linked_secrets(df)).collect()}


AWS = "AKIA" + "ABCDEFGH12345678"
TEXTS = [
    (1, f'é😀 "Password": "hunter22" and {AWS} then 0123456789abcdef0123456789abcdef'),
    (2, "token: token: abcdefgh, API_KEY='x' api-key=abcdefg apikey = a.b-c/d+e="),
    (3, "deadbeefdeadbeefdeadbeef" + "AKIAAKIA" + "Z" * 12 + " AKIAshort"),
    (4, None), (5, ""), (None, "secret=abcdef"),
    (6, "login: bob99 ... QmFzZTY0U3RyaW5nMTIzNDU2 at https://db.example.com/x"),
    (7, "QmFzZTY0U3RyaW5nMTIzNDU2 at https://db.example.com/x"),
    (8, "login: bob99" + " pad" * 100 + "QmFzZTY0U3RyaW5nMTIzNDU2"),
    (9, f"{AWS} " + "x " * 60 + "0123456789abcdef01"),
    (10, ("word " * 3000 + "secret = sesame99 ") * 3),
    (11, "passwd=abcdef"), (11, "passwd=abcdef"),
    (12, "client_id=ABCdef0123456789abcdEFgh"), (13, "login: AbCdEfGhIjKl0123456789xyz"),
    (14, "client_id=ABCdef0123456789abcdEFgh at https://db.example.com/x"),
    (15, "client_id=ABCdef0123456789abcdEFgh with QmFzZTY0U3RyaW5nMTIzNDU2 at https://db.example.com/x"),
]


def test_base_spans_match_python(spark):
    got = run(spark, TEXTS)
    for d, t in TEXTS:
        want = base(t)
        r = got[str(d)]
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(s[0] == x for s in want) for x in ("assign", "access", "hex")), (d, r)
        assert r.base_sha256 == hashlib.sha256(",".join(f"{a}:{b}:{c}" for a, b, c in want).encode()).hexdigest(), (d, r, want)
        assert set(",".join(f"{a}:{b}:{c}" for a, b, c in want).split(",")) <= set(r.spans.split(",")) | {""}


def test_weak_parts_need_their_complements(spark):
    got = {d: [s.split(":")[0] for s in r.spans.split(",") if s] for d, r in run(spark, TEXTS).items()}
    assert got["6"] == ["weak_id", "weak_token", "weak_endpoint"]
    assert got["7"] == [] and got["8"] == [] and got["4"] == [] and got["5"] == []
    assert got["9"] == ["access", "weak_hex"]
    assert got["11"] == ["assign"]


def test_overlapping_parts_do_not_confirm_each_other(spark):
    got = {d: [s.split(":")[0] for s in r.spans.split(",") if s] for d, r in run(spark, TEXTS).items()}
    assert got["12"] == got["13"] == got["14"] == []
    assert got["15"] == ["weak_id", "weak_token", "weak_endpoint"]  # the identifier's value is no secret of its own


def test_a_very_long_dense_text_takes_linear_time(spark):
    took = []
    for size in (20_000, 200_000):
        text = " ".join(f"{i:024x}" for i in range(size))
        began = time.perf_counter()
        r = run(spark, [(1, text)])["1"]
        took.append(time.perf_counter() - began)
        want = [("hex", 25 * i, 25 * i + 24) for i in range(size)]
        assert r.n_hex == size and r.base_sha256 == hashlib.sha256(",".join(f"{a}:{b}:{c}" for a, b, c in want).encode()).hexdigest()
    assert took[1] < 15 * took[0] + 10, took


def test_empty_table_and_plan_without_python(spark):
    assert run(spark, []) == {}
