"""Personal data: fixed patterns, and a linear-chain conditional random field over word shapes.

The patterns (e-mail, IPv4, payment card by Luhn, international phone) stand as they are.  The field adds spans that
patterns miss, from the shapes of words: which kinds of characters they hold, how they start and end, their length,
and whether they are one of a few cue words.

* name: one to four capitalised words, none twice, at most `REACH` words after a title or cue;
* number: a national or local number of 7 to 15 digits, likewise after a cue;
* address: a house number, a street's name and its kind (the last cue words), six words at most.

What the field proposes and is not of that form is left out.  It is trained here, by gradient ascent on the exact
log-likelihood, from a small labelled table (`labelled_table`, or one the caller gives).  Each line of a text is a
sequence; lines of more than `WINDOW` words are decoded in windows that overlap by `LAP` words, each word by the window
it is further inside of.  Sequences of a batch are decoded together by Viterbi in numpy, longest first, so that a step
works on all sequences that are still running; texts of more than `PIECE` bytes go in pieces that end at a line or,
with an overlap of `LAP` words, at a word, so that memory does not grow with a text or a line.

Edge cases: null is an empty text and has no spans; offsets are code points, end exclusive; a span of the field that
touches a pattern's span is left out; repeated rows get the same spans; a null id is kept, ids are whole numbers; other
columns are ignored; an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
import re
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _common as c

#: The base kinds in order.
KINDS = ["email", "ip", "card", "phone"]
ADDED = ["name", "number", "address"]
LABELS = ["O"] + [f"{p}-{k}" for k in ADDED for p in "BI"]
WINDOW, LAP = 512, 64
PIECE = 1 << 20
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: A match cannot start within a run of digits that it or a match before it has not eaten, hence the look-behind.
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for i, ch in enumerate(reversed(digits)):
        n = int(ch) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end), by kind then start."""
    out = []
    done, at = 0, text.find("@")
    while at >= 0:
        left = at
        while left > done and text[left - 1] in LOCAL:
            left -= 1
        hit = DOMAIN.match(text, at + 1) if left < at else None
        if hit:
            out.append((0, left, hit.end()))
            done = hit.end()
        at = text.find("@", max(at + 1, done))
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append((1, m.start(), m.end()))
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append((2, m.start(), m.end()))
    for m in PHONE.finditer(text):
        if 8 <= sum(ch.isdigit() for ch in m[0]) <= 15:
            out.append((3, m.start(), m.end()))
    return out


# Word shapes.  A code joins kinds of characters (6 bits), first and last kind (2 bits each), length (3) and cue (5).
CUES = b"mr mrs ms miss dr prof name contact signed dear sir madam call tel phone fax mobile ssn id passport account no number street st avenue ave road rd lane ln".split()
_FLAG = np.full(256, 32, np.uint8)
_FIRST, _LAST = np.full(256, 3, np.uint8), np.full(256, 3, np.uint8)
for _b in range(128):
    _ch = chr(_b)
    _FLAG[_b] = 1 if "A" <= _ch <= "Z" else 2 if "a" <= _ch <= "z" else 4 if "0" <= _ch <= "9" else 8 if _ch in "-/()#" else 16 if _ch in ".,:;" else 32
    _FIRST[_b] = 0 if "A" <= _ch <= "Z" else 1 if "a" <= _ch <= "z" else 2 if "0" <= _ch <= "9" else 3
    _LAST[_b] = 0 if _ch.isalpha() else 1 if "0" <= _ch <= "9" else 2 if _ch in ".,:;" else 3
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LENGTH = np.array([0, 0, 1, 2, 3, 4, 4, 5, 5, 5, 6, 6, 6, 7], np.int64)
_NUMBER = {int.from_bytes(w, "little"): i + 1 for i, w in enumerate(CUES)}
_KEYS = np.array(sorted(_NUMBER), np.uint64)
_CUE = np.array([_NUMBER[k] for k in _KEYS.tolist()], np.int64)
CODES = 1 << 18
PARTS = [(0, 64), (6, 4), (8, 4), (10, 8), (13, 32)]  # shift and size of a code's parts


def tokens(raw: np.ndarray):
    """(starts, ends, codes, fresh) of the words of a byte buffer; fresh marks a line's first word."""
    word = ~_SPACE[raw]
    edge = np.diff(word.astype(np.int8), prepend=0, append=0)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return starts, ends, np.empty(0, np.int64), np.empty(0, bool)
    cuts = np.stack([starts, ends], 1).ravel()
    flags = _FLAG[raw]
    joined = np.bitwise_or.reduceat(np.append(flags, 0), cuts)[::2]
    length = ends - starts
    last = _LAST[raw[ends - 1]]
    core = length - (last == 2)
    padded = np.append(raw | np.where((raw >= 65) & (raw <= 90), 32, 0).astype(np.uint8), np.zeros(8, np.uint8))
    key = np.zeros(len(starts), np.uint64)
    for i in range(8):
        key |= np.where(core > i, padded[starts + i], 0).astype(np.uint64) << np.uint64(8 * i)
    at = np.minimum(np.searchsorted(_KEYS, key), len(_KEYS) - 1)
    cue = np.where((_KEYS[at] == key) & (core <= 8), _CUE[at], 0)
    codes = joined | _FIRST[raw[starts]].astype(np.int64) << 6 | last.astype(np.int64) << 8 | _LENGTH[np.minimum(length, 13)] << 10 | cue << 13
    line = np.cumsum(raw == 10)
    fresh = np.append(True, line[starts[1:]] != line[starts[:-1]])
    return starts, ends, codes, fresh


class Field:
    """Weights: parts of the codes of a word and its neighbours to labels, and label to label."""

    def __init__(self, emit: np.ndarray, move: np.ndarray):
        self.emit, self.move = emit, move  # (3, 112, labels), (labels + 1, labels): the last row starts a sequence

    def tables(self) -> np.ndarray:
        code = np.arange(CODES)
        places, at = [], 0
        for shift, size in PARTS:
            places.append((code >> shift & size - 1) + at)
            at += size
        return np.stack([sum(e[p] for p in places) for e in self.emit]).astype(np.float32)

    def scores(self, codes: np.ndarray, fresh: np.ndarray, tables: np.ndarray) -> np.ndarray:
        out = tables[0][codes].copy()
        inner = ~fresh[1:]
        out[1:][inner] += tables[1][codes[:-1][inner]]
        out[:-1][inner] += tables[2][codes[1:][inner]]
        return out

    def viterbi(self, scores: np.ndarray, fresh: np.ndarray) -> np.ndarray:
        """The best label of each word; sequences begin where `fresh` is set, long ones are decoded in windows."""
        n = len(scores)
        path = np.zeros(n, np.int8)
        if not n:
            return path
        begin = np.flatnonzero(fresh)
        length = np.diff(np.append(begin, n))
        step = WINDOW - LAP
        windows = np.maximum(1, -(-(length - LAP) // step))
        nth = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
        last = nth + 1 == np.repeat(windows, windows)
        rest = np.repeat(length, windows) - nth * step
        begin, length = np.repeat(begin, windows) + nth * step, np.where(last, rest, WINDOW)
        low, high = np.where(nth > 0, LAP // 2, 0), np.where(last, length, WINDOW - LAP // 2)  # the words a window decides
        order = np.argsort(-length, kind="stable")
        begin, length, nth, low, high = (x[order] for x in (begin, length, nth, low, high))
        move = self.move[:-1].astype(np.float32).T.copy()  # to, from
        running = np.searchsorted(-length, -np.arange(1, length[0] + 1), side="right")
        best = scores[begin] + np.where((nth > 0)[:, None], 0, self.move[-1]).astype(np.float32)
        back, state = [], np.zeros(len(begin), np.int8)
        ended = [best]
        for t in range(1, length[0]):
            k = running[t]
            ways = best[:k, None, :] + move
            back.append(ways.argmax(2).astype(np.int8))
            best = np.take_along_axis(ways, back[-1][:, :, None].astype(np.int64), 2)[:, :, 0] + scores[begin[:k] + t]
            ended.append(best)
        for t in range(length[0] - 1, -1, -1):
            k = running[t]
            up = running[t + 1] if t + 1 < length[0] else 0
            if up:
                state[:up] = back[t][np.arange(up), state[:up]]
            state[up:k] = ended[t][up:k].argmax(1)
            own = (low[:k] <= t) & (t < high[:k])
            path[begin[:k][own] + t] = state[:k][own]
        return path


def spans_of(path: np.ndarray, fresh: np.ndarray) -> list[tuple[int, int, int]]:
    """(kind, first word, last word) of each labelled run."""
    out = []
    hits = np.flatnonzero(path)
    for i in hits.tolist():
        kind, inside = (int(path[i]) - 1) // 2, int(path[i]) % 2 == 0
        if inside and out and out[-1][0] == kind and out[-1][2] == i - 1 and not fresh[i]:
            out[-1] = (kind, out[-1][1], i)
        else:
            out.append((kind, i, i))
    return out


FIRST_NAMES = "Ann John Maria Peter Lucy Omar Ingrid Pierre Sofia Hans Chloe Ivan".split()
LAST_NAMES = "Smith Miller Garcia Keller Dubois Novak Brown Rossi Jensen Walker".split()
PLAIN = "the of and to in that was for on are with as his they at be this from or had by word but what some we can out other were all there when up use your how said each she which their time if will way about many then them write would like so these her long make thing see him two has look more day could go come did number sound no most people my over know water than first who may down side been now find".split()


def labelled_table(size: int = 900, seed: int = 11) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """A small labelled table, made by rule: (text, [(kind, start, end)])."""
    rng = np.random.default_rng(seed)
    pick = lambda x: x[int(rng.integers(len(x)))]
    digits = lambda n: "".join(str(int(d)) for d in rng.integers(0, 10, n))
    sounds = "an ber ca don el fé ga hu in jo ka lü mo ne or pa qui ra sch to un ver wo ñe çi".split()
    say = lambda: pick(PLAIN) if rng.random() < 0.5 else "".join(pick(sounds) for _ in range(int(rng.integers(1, 6))))
    talk = lambda lo, hi: [say() for _ in range(int(rng.integers(lo, hi)))]

    def proper():
        own = "".join(pick(sounds) for _ in range(int(rng.integers(1, 5)))).title()
        front, tail = rng.random() < 0.08, rng.random() < 0.08
        return pick(["O'", "Mc", "al-", "d'"]) * front + own + ("-" + pick(sounds).title()) * tail

    def person():
        """One to four different words: given names, perhaps an initial, a family name."""
        given = [pick([proper(), pick(FIRST_NAMES), pick(LAST_NAMES)]) for _ in range(int(rng.integers(0, 3)))]
        middle = [pick("ABCDEFGH") + "."] if rng.random() < 0.15 else []
        return " ".join(dict.fromkeys([*given, *middle, pick([proper(), pick(LAST_NAMES)])]))

    def number():
        if rng.random() < 0.3:
            return digits(int(rng.integers(7, 11)))
        groups = [digits(int(rng.integers(2, 5))) for _ in range(int(rng.integers(2, 4)))]
        while sum(map(len, groups)) < 7:
            groups.append(digits(3))
        return pick([f"({groups[0]}) " + "-".join(groups[1:]) if len(groups) > 2 else f"({groups[0]}) {digits(7)}", "-".join(groups), "-".join(groups), f"0{groups[0]} {digits(7)}"])

    def address():
        street = " ".join(dict.fromkeys(pick([proper(), pick(LAST_NAMES)]) for _ in range(int(rng.integers(1, 3)))))
        return f"{digits(int(rng.integers(1, 4)))}{pick(['', '', '', 'b'])} {street} {pick(['Street', 'St', 'Avenue', 'Ave.', 'Road', 'Rd', 'Lane', 'Ln', 'St.', 'Rd.'])}"

    def data(kind):
        if kind == "name":
            cue = pick(["Mr", "Mrs", "Ms", "Miss", "Dr", "Prof", "Mr.", "Mrs.", "Dr.", "Prof.", "Sir", "Madam", "name:", "Name:", "contact", "Contact:", "Contact", "signed", "Signed:", "Dear"])
            return [(cue, None), (person(), kind)]
        if kind == "number":
            cue = pick(["ssn", "SSN:", "SSN", "id", "ID:", "passport", "Passport", "account", "Account", "no.", "call", "Call", "tel", "Tel:", "phone", "Phone:", "fax", "Fax", "mobile", "Mobile:"])
            return [(cue, None), (number(), kind)]
        return [(pick(["", "", "at", "to", "in", ",", "address:"]), None), (address(), kind)]

    def prose():
        """A few sentences, some of one word, some shouted, listed or with odd marks."""
        out = []
        for _ in range(int(rng.integers(1, 5))):
            own = talk(1, 8)
            style = rng.integers(9)
            own = [w.upper() for w in own] if style == 0 else [w.title() for w in own] if style == 1 and rng.random() < 0.4 else [own[0].title(), *own[1:]]
            mark = pick(["", "", "", ",", "!!", "***", "$$$", " |"]) if style < 4 else ""
            own = [w + (mark if rng.random() < 0.7 else "") for w in own]
            out += [*own[:-1], own[-1] + pick([".", ".", ".", "!", "?", ":"])]
        return out

    out = []
    for row in range(size):
        parts: list[tuple[str, str | None]] = [(w, None) for w in (prose() if rng.random() < 0.7 else []) + talk(1, 6)]
        if row % 12 < 7:  # two pieces of personal data, text between
            for kind in (ADDED[row % 3], ADDED[row // 3 % 3]):
                parts += data(kind) + [(pick(["", "", "", ",", ".", " ,", ";"]), None)] + [(w, None) for w in talk(1, 6)]
        else:  # clean text of many shapes, with what might be taken for personal data
            for _ in range(int(rng.integers(1, 6))):
                parts += [(pick([digits(4), digits(2), f"{digits(1)}.{digits(2)}", pick(PLAIN).upper() + "!!", pick(PLAIN).title(), pick(PLAIN).title() + " " + pick(PLAIN).title(), pick(PLAIN) + "***", "|", f"v{digits(1)}.{digits(1)}", pick(PLAIN) + ".", pick(CUES).decode(), pick(CUES).decode().title() + " " + pick(PLAIN), "ümlaut", f"https://a{digits(2)}.example/{digits(3)}", digits(24), f"{digits(4)}-{digits(2)}-{digits(2)}"]), None)] + [(w, None) for w in talk(0, 3)]
            odd = rng.integers(12)
            if odd == 0:  # one word over and over
                own = pick([str.title, str.upper, str.lower])(say())
                parts += [(own, None)] * int(rng.integers(2, 12))
            elif odd == 1:  # a headline, with a number before it or not
                parts += [(w, None) for w in ([digits(int(rng.integers(1, 4)))] if rng.random() < 0.5 else []) + [w.title() for w in talk(2, 8)]]
            elif odd == 2:  # digits without a cue
                parts += [(pick([digits(9), digits(10), digits(16), f"{digits(3)}-{digits(4)}", f"{digits(2)}.{digits(3)}.{digits(2)}.{digits(1)}", f"{digits(2)}:{digits(2)}", f"${digits(3)}"]), None)]
            elif odd == 3:  # a numbered list of names of things
                for i in range(int(rng.integers(2, 5))):
                    parts += [(f"{i + 1}.", None), (say().title(), None), (say(), None)]
            elif odd == 4:  # all words with one mark behind
                mark = pick(["!!", "***", "&&&", "%%%", "$$$", "###", ","])
                parts += [(pick([str.title, str.upper, str.lower])(w) + mark, None) for w in talk(2, 10)]
            parts += [(w, None) for w in prose()]
        parts += [(w, None) for w in talk(1, 7)] + [(w, None) for w in (prose() if row % 5 == 0 else [])]
        if row % 3 == 0:
            parts[0] = (parts[0][0].title(), parts[0][1])
        text, spans = "", []
        for word, label in parts:
            if not word:
                continue
            if label:
                spans.append((label, len(text), len(text) + len(word)))
            text += word + ("\n" if rng.random() < 0.08 else " ")
        out.append((text[:-1] + pick(["", ".", ""]), spans))
    return out


def train(table, steps: int = 100, rate: float = 0.15, decay: float = 3e-4) -> Field:
    """Adam on the exact log-likelihood, forward and backward over all sequences of the table at once."""
    codes, gold, begin = [], [], []
    for text, spans in table:
        raw = np.frombuffer(text.encode(), np.uint8)
        starts, _, code, _ = tokens(raw)
        place = np.cumsum((raw & 0xC0) != 0x80) - 1
        label = np.zeros(len(starts), np.int64)
        for kind, lo, hi in spans:
            own = np.flatnonzero((place[starts] >= lo) & (place[starts] < hi))
            label[own] = 2 + 2 * ADDED.index(kind)
            label[own[:1]] -= 1
        codes.append(code), gold.append(label)
    by = sorted(range(len(codes)), key=lambda i: -len(codes[i]))  # the longest first: those still running are a prefix
    codes, gold = [codes[i] for i in by], [gold[i] for i in by]
    n, width, size = len(codes), max(map(len, codes), default=0), len(LABELS)
    total = sum(s for _, s in PARTS)
    weights = [np.zeros((3, total, size)), np.zeros((size + 1, size))]
    if not width:
        return Field(*weights)
    live = np.zeros((n, width), bool)
    code, want = np.zeros((n, width), np.int64), np.zeros((n, width), np.int64)
    for i, (a, b) in enumerate(zip(codes, gold)):
        live[i, : len(a)], code[i, : len(a)], want[i, : len(a)] = True, a, b
    running = live.sum(0)
    place, at = [], 0
    for shift, s in PARTS:
        place.append((code >> shift & s - 1) + at)
        at += s
    place = np.stack(place, 2)
    m, v = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    one = np.eye(size)
    near = [(slice(None), slice(None), slice(None), slice(None)), (slice(None), slice(1, None), slice(None), slice(None, -1)), (slice(None), slice(None, -1), slice(None), slice(1, None))]
    for step in range(1, steps + 1):
        emit, move = weights
        scores = np.zeros((n, width, size))
        for e, (_, to, _, of) in zip(emit, near):
            scores[:, to] += e[place[:, of]].sum(2) * live[:, of, None]
        # forward and backward in probabilities, scaled at every place, so that each step is a small matrix product
        mass, hop = np.exp(scores - scores.max(2, keepdims=True)), np.exp(move[:-1])
        forward, scale = np.zeros((n, width, size)), np.ones((n, width, 1))
        forward[:, 0] = mass[:, 0] * np.exp(move[-1])
        scale[:, 0] = forward[:, 0].sum(1, keepdims=True)
        forward[:, 0] /= scale[:, 0]
        for t in range(1, width):
            k = running[t]
            new = forward[:k, t - 1] @ hop * mass[:k, t]
            scale[:k, t] = new.sum(1, keepdims=True)
            forward[:k, t] = new / scale[:k, t]
        backward = np.ones((n, width, size))
        pair = np.zeros((size, size))
        for t in range(width - 2, -1, -1):
            k = running[t + 1]
            ahead = mass[:k, t + 1] * backward[:k, t + 1] / scale[:k, t + 1]
            backward[:k, t] = ahead @ hop.T
            pair += forward[:k, t].T @ ahead * hop
        prob = forward * backward * live[:, :, None]
        gap = one[want] * live[:, :, None] - prob
        ge = np.zeros_like(emit)
        for g, (_, to, _, of) in zip(ge, near):
            use = np.ascontiguousarray((gap[:, to] * live[:, of, None]).reshape(-1, size).T)
            for part in range(len(PARTS)):
                at = place[:, of, part].ravel()
                g += np.stack([np.bincount(at, u, total) for u in use], 1)
        gm = np.zeros_like(move)
        gm[-1] = (one[want[:, 0]] * live[:, 0, None] - prob[:, 0]).sum(0)
        both = live[:, 1:]
        np.add.at(gm, (want[:, :-1][both], want[:, 1:][both]), 1.0)
        gm[:-1] -= pair
        for w, g, a, b in zip(weights, (ge / n, gm / n), m, v):
            g = g - decay * w
            a *= 0.9
            a += 0.1 * g
            b *= 0.999
            b += 0.001 * g * g
            w += rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
    return Field(*weights)


@cache
def default_field() -> Field:
    """The field of the default table; the same in every process, so it is trained once in each."""
    return train(labelled_table())


def _printed(spans) -> str:
    names = KINDS + ADDED
    return ",".join(f"{names[k]}:{a}:{b}" for k, a, b in spans)


NAMED, NUMBERED, STREETS = frozenset(CUES[:12]), frozenset(CUES[12:23]), frozenset(CUES[-8:])
REACH = 3  # words before a span among which its cue stands


def well_formed(kind: str, words: list[bytes], before: list[bytes]) -> bool:
    """Whether a span's words, and those before it, have the form its kind asks for."""
    words, before = [w.strip(b".,:;!?") for w in words], [w.strip(b".,:;!?#").lower() for w in before]
    if kind != "address" and not (NAMED if kind == "name" else NUMBERED) & set(before):
        return False
    if kind == "name":
        capital = all(w.lower() != w or w[:1] >= b"\x80" for w in words) and not any(w.isupper() and len(w) > 1 for w in words)
        return 1 <= len(words) <= 4 and len(set(words)) == len(words) and capital and not any(ch in b"0123456789@/#$%&*" for w in words for ch in w)
    count = sum(48 <= ch <= 57 for w in words for ch in w)
    if kind == "number":
        return len(words) <= 4 and 7 <= count <= 15 and not any(ch not in b"0123456789+-()./" for w in words for ch in w)
    return 3 <= len(words) <= 6 and words[0][:1].isdigit() and words[-1].lower() in STREETS and len(set(words)) == len(words)


def _spans(raw: np.ndarray, field: Field, tables: np.ndarray) -> tuple[list, np.ndarray, np.ndarray]:
    """Well-formed spans (kind, start, end) of a byte buffer, in bytes, and the words' places."""
    starts, ends, codes, fresh = tokens(raw)
    out = []
    if len(starts):
        for kind, first, last in spans_of(field.viterbi(field.scores(codes, fresh, tables), fresh), fresh):
            a, b = int(starts[first]), int(ends[last])
            while b > a + 1 and raw[b - 1] in b".,:;!?":
                b -= 1
            before = raw[starts[max(0, first - REACH)] : a].tobytes().rpartition(b"\n")[2].split()
            if well_formed(ADDED[kind], raw[a:b].tobytes().split(), before):
                out.append((kind, a, b))
    return out, starts, ends


def _long(text: bytes, field: Field, tables: np.ndarray) -> list[tuple[int, int, int]]:
    """The same of one text of any length, piece by piece; offsets in bytes of the text."""
    out, at, free = [], 0, 0  # free: where the spans of the pieces before end
    while at < len(text):
        stop = at + PIECE
        if stop >= len(text):
            stop, line = len(text), True
        else:
            cut = text.rfind(b"\n", at + PIECE // 2, stop)
            line = cut >= 0
            if line:
                stop = cut + 1
            else:
                while stop < len(text) and not _SPACE[text[stop]]:  # to the end of a word, however long
                    stop += 1
                line = stop == len(text)
        found, starts, _ = _spans(np.frombuffer(text[at:stop], np.uint8), field, tables)
        words = len(starts)
        over = not line and words > 2 * LAP
        until = int(starts[words - LAP // 2]) if over else stop - at
        out += [(k, at + a, at + b) for k, a, b in found if at + a >= free and a < until]
        free = max([at + until] + [b for _, _, b in out[-1:]])
        at = at + int(starts[words - LAP]) if over else stop
    return out


def added_spans(texts: list[bytes], field: Field, tables: np.ndarray) -> list[list[tuple[int, int, int]]]:
    """The field's spans of each text, in code points."""
    out: list[list] = [[] for _ in texts]
    short = [i for i, t in enumerate(texts) if len(t) <= PIECE]
    found = []
    if short:
        edges = np.cumsum([0] + [len(texts[i]) + 1 for i in short])
        for kind, a, b in _spans(np.frombuffer(b"\n".join(texts[i] for i in short) + b"\n", np.uint8), field, tables)[0]:
            j = int(np.searchsorted(edges, a, side="right")) - 1
            found.append((short[j], kind, a - int(edges[j]), b - int(edges[j])))
    found += [(i, *s) for i, t in enumerate(texts) if len(t) > PIECE for s in _long(t, field, tables)]
    points = lambda part: len(part.decode("utf-8", "replace"))
    done: dict[int, tuple[int, int]] = {}  # how far a text's code points are counted
    for i, kind, a, b in found:
        at, count = done.get(i, (0, 0))
        start = count + points(texts[i][at:a])
        end = start + points(texts[i][a:b])
        done[i] = (b, end)
        out[i].append((len(KINDS) + kind, start, end))
    return out


OUT = "id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def _find(field: Field):
    def run(batches):
        tables = field.tables()
        names = [x.split()[0] for x in OUT.split(", ")]
        types = [pa.int64()] * 5 + [pa.string()] * 2
        for batch in (x for whole in batches for x in c.pieces(whole, 1, 4 << 20)):
            raws = c.as_bytes(batch.column(1))
            rows = []
            for key, raw, more in zip(batch.column(0).to_pylist(), raws, added_spans(raws, field, tables)):
                base = base_spans(raw.decode("utf-8", "replace"))
                more = sorted(s for s in more if all(s[2] <= a or s[1] >= b for _, a, b in base)) if more else []
                counts = [sum(s[0] == k for s in base) for k in range(len(KINDS))]
                rows.append((key, *counts, hashlib.sha256(_printed(base).encode()).hexdigest(), _printed(base + more)))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types)], names)

    return run


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", table=None) -> DataFrame:
    """One row per input row: id, counts of the base kinds, their digest, and all spans; one narrow pass."""
    field = default_field() if table is None else train(table)
    flat = c.bounded_batches(docs).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return flat.mapInArrow(c.tidy(_find(field)), OUT).withColumnRenamed("id", id_col)
