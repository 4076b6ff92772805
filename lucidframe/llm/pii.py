"""Personal data and secrets by a skip-chain conditional random field.

Tokens are white-space tokens, cut at quotes, brackets, commas, semicolons and bars. Chain: the potentials of a token that is neither marked (it holds a digit or "@",
is of 16 capitals, is the value of a credential's key, or follows a cue such as "Mr." or "Dear") nor next to a marked one allow the
label O alone, so that it is summed out exactly: it sends the same message to either side whatever its neighbours are. All others are nodes
with every label. Skip edges: all mentions of a token in a document (same text, or same digits) are joined through one shared node, and so
are all that resemble each other (same mail domain, same network), linear in the mentions and two hops from any to any; as in a
skip chain, a mention also sees what stands around the others (features "again:"), so that one clear mention decides any number of bare
ones. Labels are O and the kinds of entity. Loopy sum-product message passing over all edges of all documents of a batch at
once yields marginals; a node takes its most probable label. Groups of digits that together read as a telephone or card number take one label, by the sum
of their log marginals: it is found whole or not at all; adjacent nodes of one such kind, and of a name or address, become one span.

Weights are trained here, piecewise: node potentials by multinomial logistic regression, chain and skip
potentials from label agreement, on generated labelled documents (a fixed seed; entities of each kind in and out of context, and
look-alikes such as dates, prices, versions, hashes and order numbers).

Names are found after a cue and wherever they are repeated, not in free prose. Addresses are a number with capitalised words and a word for a street.

Defined results: a null text has null text, entities and n_entities; an empty text or one without a marked token has
no entities and stays as it is; texts count whole whatever their length, and so do tokens; ties between labels go to the first of KINDS; repeated rows
are treated alike, a null id passes through; an empty table gives an empty table; other columns pass through where redact() is used, and new columns
that would clash take a leading underscore. Spans are character offsets, end exclusive, in the original text.
"""

from __future__ import annotations

import functools
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lucidframe.llm.common import c, ensure_workers, fresh, release
from lucidframe.llm.tokens import pieces, raw, spans

KINDS = ["O", "EMAIL", "PHONE", "CARD", "IP", "KEY", "SECRET", "SSN", "IBAN", "NAME", "ADDRESS"]
JOINED = frozenset(KINDS.index(k) for k in ("PHONE", "CARD", "IBAN", "NAME", "ADDRESS"))  # kinds whose adjacent nodes are one span
ROUNDS = 30
ENTITIES = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("kind", T.StringType())]))

_TEXT = np.ones(256, bool)
_TEXT[[9, 10, 11, 12, 13, 32]] = False
_MARK = np.zeros(256, bool)
_MARK[48:58] = True
_MARK[64] = True
_CAPITAL = np.zeros(256, bool)
_CAPITAL[48:58] = True
_CAPITAL[65:91] = True

_piece = re.compile(r"[^\s,;|\"'<>{}\[\]`]+")
_core = re.compile(r"(?:[+(]|::)?\w(?:.*[\w)])?(?:::)?", re.S)
_assign = re.compile(r"([A-Za-z][\w.-]*)(:=|=>|[=:])(?=[^/\s])")
_ends = re.compile(r"([A-Za-z][\w.-]*)?(:=|=>|[=:])\Z")
_credential = re.compile(r"pass|pwd|secret|token|key|auth|cred", re.I)
_mail = re.compile(r"[\w.+%-]+@[\w-]+(?:\.[\w-]+)+\Z")
_ip = re.compile(r"(\d{1,3})\.(\d{1,3})\.(\d{1,3})\.(\d{1,3})(?::\d{1,5})?\Z")
_ip6 = re.compile(r"(?=.*\d)(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}\Z|(?=(?:[^:]*:){2,7}[^:]*\Z)(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4})*)?::(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4})*)?\Z")
_vendor = re.compile(r"(?:AKIA|ASIA|AGPA|AIDA|AROA)[A-Z0-9]{16}\Z|(?:gh[opsu]_|github_pat_|glpat-|[sr]k_(?:live|test)_|xox[abpr]-|AIza|npm_|SG\.)[\w.-]{16,}|eyJ[\w-]+\.[\w-]+\.[\w-]+")
_digits = re.compile(r"\D+")
_groups = re.compile(r"(?<!\S)(?:(?P<card>(?:\d{4} ){3}\d{4}|\d{4} \d{6} \d{5})|\d{2,5}(?: \d{2,5}){2,4}|(?:\+\d{1,3} )?\(\d{2,4}\) \d{3,4}(?:-| )\d{3,5}|\+\d{1,3}(?: \d{2,4}){2,4}|\d{3} \d{3}-\d{4})(?!\S)")
_before = re.compile(rb"(?i:pass|pwd|secret|token|key|auth|cred)[\w.-]*[\"']?[ \t]*:?\Z")
_after = re.compile(rb"[=>]?[ \t]*[\"'<({\[]*(?=[^\s\"'<({\[=:>])")
_cue = re.compile(rb"(?<![\w-])(?:Mr|Mrs|Ms|Dr|Prof|[Nn]ame|Dear|[Cc]ontact|[Ss]igned|Sincerely|[Rr]egards|Attn|[Pp]atient|[Cc]ustomer)(?: is)?[.:,]*[ \t\n]+(?=[A-Z\xc3])")
STREETS = frozenset("street st road rd avenue ave lane ln drive boulevard blvd way court square place terrace rue straße strasse calle via".split())
CUES = frozenset("mr mrs ms dr prof name dear contact signed sincerely regards attn patient customer".split())
CONTEXT = STREETS | CUES | frozenset("is version commit sha256 sha1 md5 hash order figure page blob size id n phone tel call fax email mail card visa ssn iban ip host server".split())
_edge = re.compile(r"^\W+|\W+$")


@dataclass
class Node:
    doc: int
    at: int  # place among all pieces of the batch's nodes: adjacent pieces have successive numbers
    start: int  # bytes of the core in the batch
    end: int
    core: str
    features: list[str]


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d)
        if i % 2:
            x = x * 2 - 9 * (x > 4)
        total += x
    return total % 10 == 0


def shape(s: str) -> str:
    """Collapsed: a for lower, A for upper case, 9 for digits, other signs as they are; long ones by their first and last signs and their length."""
    s = re.sub(r"[^\W\d_A-Z]+", "a", s)
    s = re.sub(r"\d+", "9", re.sub(r"[A-Z]+", "A", s))
    return s if len(s) <= 24 else f"{s[:12]}..{s[-12:]}..{len(s).bit_length()}"


def own_features(core: str, key: str | None, quoted: bool, sign: str) -> list[str]:
    digits = _digits.sub("", core)
    n = len(core)
    f = ["bias", "shape:" + shape(core), f"len:{min(n // 4, 12)}", f"digits:{min(len(digits), 20)}"]
    if not digits and "@" not in core:
        f.append("plain")
    if _mail.match(core):
        f += ["mail", "mail2"]
    elif "@" in core:
        f.append("at")
    m = _ip.match(core)
    if m:
        f.append("ip" if all(int(x) < 256 for x in m.groups()) else "notip")
    if ":" in core and _ip6.match(core):
        f = ["bias", "ip6", "ip6:" + str(min(core.count(":"), 4))]
    if digits == core and n:
        f.append(f"number:{n if n < 20 else 20}")
        if 13 <= n <= 19:
            f.append("first:" + core[0])
            f.append("luhn" if luhn(core) else "noluhn")
    elif _vendor.match(core):
        f = ["bias", "vendor", "vendor:" + core[:3]]
    elif re.fullmatch(r"[0-9A-Fa-f]+", core) and n >= 12 and digits:
        f = ["bias", "hex", f"hex:{n // 8}"]  # which characters a random string has says nothing
    elif re.fullmatch(r"[A-Z0-9]+", core) and n >= 12:
        f = ["bias", "capitals", f"capitals:{n}", "withdigits" if digits else "lettersonly"]
    elif re.fullmatch(r"[\w+/=.-]+", core) and n >= 16 and digits and re.search("[A-Za-z]", core):
        f = ["bias", "uuid" if re.fullmatch(r"[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}", core) else "blob"]
    if re.fullmatch(r"\d{4}(?:[ -]\d{4}){3}", core):
        f += ["cardform", "luhn" if luhn(digits) else "noluhn"]
    if re.fullmatch(r"\d{3}-\d{2}-\d{4}", core):
        f.append("ssnform")
    if re.fullmatch(r"[A-Z]{2}\d{2}[A-Z0-9]{10,30}", core):
        f.append("ibanform")
    if re.fullmatch(r"\+?\(?\d{1,4}\)?[-./]?\(?\d{2,4}\)?[-./ ]?\d{2,4}[-./ ]?\d{2,5}", core) and 7 <= len(digits) <= 15:
        f.append("phoneform" if n > len(digits) else "phonedigits")
    for name, form in (("plus", r"\+\d{1,3}"), ("area", r"\(\d{2,4}\)"), ("local", r"\d{3,4}-\d{4}"), ("quad", r"\d{4}")):
        if re.fullmatch(form, core):
            f.append(name)
    if key is not None:
        kind = "cred" if _credential.search(key) else "other"
        f += [f"key:{kind}", f"key:{kind}{sign}{'q' if quoted else ''}{'p' if 'plain' in f else ''}{min(n // 8, 1)}"]
    return f


def candidates(texts: pa.Array) -> tuple[list[Node], np.ndarray, np.ndarray]:
    """Nodes of a batch, its bytes and where each text begins."""
    data, at = raw(texts)
    nodes: list[Node] = []
    if not len(data):
        return nodes, data, at
    start, end = spans(data, at, _TEXT)
    view = data.tobytes()
    marked = np.flatnonzero(_MARK[data])
    a, b = spans(data, at, _CAPITAL)
    signs = np.flatnonzero((data == 58) | (data == 61)).tolist()
    keyed = np.array([m.end() for p in signs if _before.search(view[max(0, p - 64) : p]) and (m := _after.match(view, p + 1))], np.int64)
    cued = np.array([m.end() for m in _cue.finditer(view)], np.int64)
    token = lambda at: np.unique(np.searchsorted(start, at, "right") - 1)
    if not len(start):
        return nodes, data, at
    marked = np.concatenate((marked, a[b - a >= 16], keyed))
    sure = np.zeros(len(start), bool)
    sure[token(marked[marked < len(view)])] = True
    first = np.searchsorted(start, at)
    doc_of = lambda i: int(np.searchsorted(at, start[i], "right")) - 1
    capital = lambda i: 65 <= data[start[i]] < 91 or data[start[i]] == 0xC3

    def text_of(i: int) -> str:
        return view[start[i] : end[i]].decode("utf-8", "replace")

    # a name's words after a cue, and their repetitions in the document
    names: dict[int, set[bytes]] = {}
    for i in token(cued) if len(cued) else ():
        d = doc_of(i)
        for j in range(int(i), min(int(i) + 3, int(first[d + 1]))):
            if not capital(j):
                break
            sure[j] = True
            word = _edge.sub("", text_of(j))
            if len(word) > 1:
                names.setdefault(d, set()).add(word.encode())
            if data[end[j] - 1] in b".,;:!?":
                break
    for d, words in names.items():
        for m in re.finditer(rb"(?<!\w)(?:" + b"|".join(map(re.escape, sorted(words))) + rb")(?!\w)", view[at[d] : at[d + 1]]):
            i = int(np.searchsorted(start, at[d] + m.start(), "right")) - 1
            if i >= 0 and start[i] <= at[d] + m.start() < end[i]:
                sure[i] = True
    # capitalised words after a number may be an address; then every neighbour of a marked token
    for i in np.flatnonzero(sure & (end - start <= 6)).tolist():
        if 48 <= data[start[i]] < 58:
            d = doc_of(i)
            for j in range(i + 1, min(i + 4, int(first[d + 1]))):
                if not capital(j):
                    break
                sure[j] = True
    near = sure.copy()
    near[1:] |= sure[:-1]
    near[:-1] |= sure[1:]
    which = np.flatnonzero(near)
    docs = np.searchsorted(at, start[which], "right") - 1

    def word(i: int, d: int) -> str:
        if not first[d] <= i < first[d + 1]:
            return ""
        if end[i] - start[i] > 64:
            return "(long)"  # no word of CONTEXT
        t = text_of(i).lower()
        return _edge.sub("", t) or t

    number, before = 0, -2
    for i, d in zip(which.tolist(), docs.tolist()):
        number += 1 if i == before + 1 and first[d] <= before else 2
        before = i
        whole = text_of(i)
        one, two, after = word(i - 1, d), word(i - 2, d), word(i + 1, d)
        key, sign, previous = None, "", one
        last = text_of(i - 1) if i > first[d] and end[i - 1] - start[i - 1] <= 64 else ""
        k = _ends.search(_edge_right.sub("", last))
        if k:
            key, sign = (k[1] or (two if last.strip("\"'") in ("=", ":", "=>", ":=") else one)), k[2]
        began = len(nodes)
        for m in _piece.finditer(whole):
            piece, lo = m[0], m.start()
            k = _ends.fullmatch(piece)
            if k:  # a key, or the sign after one
                key, sign = k[1] or previous, k[2]
                previous = _edge.sub("", piece.lower()) or previous
                continue
            k = _assign.match(piece)
            if k and not re.match(r"[a-z]+://", piece) and not _ip6.match(piece):
                key, sign, lo = k[1], k[2], lo + k.end()
                piece = piece[k.end() :]
            m2 = _core.search(piece)
            core = m2[0] if m2 else ""
            if m2:
                lo += m2.start()
            if core[:1] == "(" and ")" not in core:
                lo, core = lo + 1, core[1:]
            if core[:1] == "(" and core.find(")") == len(core) - 1 and not re.fullmatch(r"\(\d{2,4}\)", core):
                lo, core = lo + 1, core[1:-1]
            if core.endswith(")") and "(" not in core:
                core = re.sub(r"\W+\Z", "", core)
            if not core:
                continue
            quoted = lo > 0 and whole[lo - 1] in "\"'"
            f = own_features(core, key, quoted, sign[-1:])
            s0 = int(start[i]) + len(whole[:lo].encode())
            f += [name + w for name, w in (("prev:", previous), ("prev2:", two)) if w in CONTEXT]
            if len(nodes) > began:
                number += 1
            nodes.append(Node(d, number, s0, s0 + len(core.encode()), core, f))
            key, previous = None, core.lower()
        if len(nodes) > began and after in CONTEXT:
            nodes[-1].features.append("next:" + after)
        elif len(nodes) == began:
            number += 1  # no piece: what is around isn't adjacent
    for x in nodes:
        if "plain" in x.features:
            x.features += ["cap" if x.core[:1].isupper() and not (len(x.core) > 1 and x.core.isupper()) else "caps" if x.core[:1].isupper() else "lower", "cue" if any("prev:" + w in x.features for w in CUES) or "prev:is" in x.features and "prev2:name" in x.features else "nocue"]
            if x.core.lower() in STREETS:
                x.features.append("street")
    street = 0  # how many nodes on a word for a street stands, if only capitalised words are between
    for i in range(len(nodes) - 1, -1, -1):
        x, y = nodes[i], nodes[i + 1] if i + 1 < len(nodes) else None
        follows = y is not None and y.doc == x.doc and y.at == x.at + 1
        if follows and "cap" in y.features:
            y.features.append("after:" + ("number" if x.core.isdigit() else "cap" if "cap" in x.features else "other"))
        street = 1 if "street" in x.features and "cap" in x.features else street + 1 if street and follows and street < 5 and ("cap" in x.features or x.core.isdigit()) else 0
        if street:
            x.features.append("tostreet")
        if x.core.isdigit():
            street = 0
    cued = False  # does an unbroken row of capitalised words begin after a cue?
    for i, x in enumerate(nodes):
        cued = "cap" in x.features and ("cue" in x.features or cued and x.doc == nodes[i - 1].doc and x.at == nodes[i - 1].at + 1)
        if cued and "cue" not in x.features:
            x.features.append("cued")
    for group, card in number_groups(nodes):
        digits = [_digits.sub("", nodes[i].core) for i in group]
        form = ("luhn" if luhn("".join(digits)) else "noluhn") if card else "-".join(str(len(x)) for x in digits) + ("z" if digits[0][0] == "0" else "")
        for i in group:
            nodes[i].features += ["cardrun", "cardrun:" + form] if card else ["phonerun", "phonerun:" + form]
    # what stands around one mention is seen by all others
    around: dict[tuple, set[str]] = {}
    for x in nodes:
        own = {f for f in x.features if f.startswith(("key:cred", "prev:", "cue")) and f != "prev:is"}
        if own:
            around.setdefault((x.doc, same(x.core)), set()).update("again:" + f.partition(":")[0] + f.partition(":")[2][:4] for f in own)
    for x in nodes:
        x.features += sorted(around.get((x.doc, same(x.core)), ()))
    return nodes, data, at


_edge_right = re.compile(r"[\"'<({\[]+\Z")


def number_groups(nodes: list[Node]) -> list[tuple[list[int], bool]]:
    """(nodes, is it a card's form) of groups of digits that together read as a telephone or card number."""
    out, i = [], 0
    while i < len(nodes):
        j = i + 1
        while j < len(nodes) and nodes[j].doc == nodes[i].doc and nodes[j].at == nodes[j - 1].at + 1:
            j += 1
        if j > i + 1:
            run = " ".join(x.core.replace(" ", "_") for x in nodes[i:j])
            for m in _groups.finditer(run):
                if m["card"] or 7 <= len(_digits.sub("", m[0])) <= 15:
                    k = i + run.count(" ", 0, m.start())
                    out.append((list(range(k, k + m[0].count(" ") + 1)), bool(m["card"])))
        i = j
    return out


def same(core: str) -> str:
    """Mentions that are equal by this are the same token."""
    digits = _digits.sub("", core)
    return digits if len(digits) >= 7 and len(digits) * 2 > len(core) else core.lower()


def edges(nodes: list[Node]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ends of the edges, their type (0 chain, 1 repeated, 2 similar) and that of the shared nodes, which follow the others."""
    a, b, kind = [], [], []
    for i in range(len(nodes) - 1):
        if nodes[i].doc == nodes[i + 1].doc and nodes[i + 1].at == nodes[i].at + 1:
            a.append(i)
            b.append(i + 1)
            kind.append(0)
    mentions: dict[tuple, list[int]] = {}
    for j, x in enumerate(nodes):
        low = x.core.lower()
        if "lower" not in x.features:
            mentions.setdefault((x.doc, 1, same(x.core)), []).append(j)
        if "@" in low:
            mentions.setdefault((x.doc, 2, low.rpartition("@")[2]), []).append(j)
        elif _ip.match(low):
            mentions.setdefault((x.doc, 2, low.rpartition(".")[0]), []).append(j)
    shared = []
    for (_, k, _), where in mentions.items():
        if len(where) > 1:
            a += where
            b += [len(nodes) + len(shared)] * len(where)
            kind += [k] * len(where)
            shared.append(k)
    return np.asarray(a, np.int64), np.asarray(b, np.int64), np.asarray(kind, np.int64), np.asarray(shared, np.int64)


def lse(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis=axis, keepdims=True)
    return np.squeeze(m, axis) + np.log(np.exp(x - m).sum(axis=axis))


def propagate(unary: np.ndarray, a: np.ndarray, b: np.ndarray, kind: np.ndarray, pair: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Marginals by loopy sum-product; pair: log potentials [type, label of a, label of b]."""
    belief = unary.copy()
    if len(a):
        src, dst = np.concatenate((a, b)), np.concatenate((b, a))
        psi = np.concatenate((pair[kind], pair[kind].transpose(0, 2, 1)))
        back = np.concatenate((np.arange(len(a)) + len(a), np.arange(len(a))))
        sent = np.zeros((len(src), unary.shape[1]))
        for _ in range(rounds):
            new = lse((belief[src] - sent[back])[:, :, None] + psi, 1)
            new -= lse(new, 1)[:, None]
            moved = np.abs(new - sent).max()
            sent = 0.5 * sent + 0.5 * new if moved > 1e-6 and _ > 4 else new
            belief = unary.copy()
            np.add.at(belief, dst, sent)
            if moved < 1e-4:
                break
    return np.exp(belief - lse(belief, 1)[:, None])


# training


def _generated(rng: random.Random, n: int) -> list[list[tuple[str, str]]]:
    """Documents as lists of (stretch of text, label); they are the text when joined."""
    hexes, upper = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    mixed = upper + upper.lower()
    pick = lambda s, k: "".join(rng.choice(s) for _ in range(k))
    num = lambda k: pick("0123456789", k)
    word = lambda: pick("bcdfglmnprst", 1) + pick("aeiou", 1) + pick("bcdfglmnprst", rng.randint(0, 2)) + pick("aeiou", rng.randint(0, 1)) + pick("nrst", 1)
    cap = lambda: word().capitalize()
    host = lambda: rng.choice([word() + rng.choice([".com", ".net", ".org", ".io", ".de", ".co.uk"]), word() + "." + word() + ".org", word() + num(1) + "." + word() + ".com", word() + "-" + word() + ".edu"])

    def card() -> str:
        d = rng.choice("3456") + num(14)
        good = next(x for x in "0123456789" if luhn(d + x))
        d += good if rng.random() < 0.6 else num(1)
        return rng.choice(["", "", "", "", "", "-", " "]).join(d[i : i + 4] for i in range(0, 16, 4))

    def entity() -> list[tuple[str, str]]:
        kind = rng.choice(KINDS[1:7] * 3 + KINDS[7:9] + KINDS[9:] * 2)
        if kind == "EMAIL":
            t = rng.choice([word() + rng.choice(["", ".", "_", "-", "+"]) + word() + rng.choice(["", num(2)]), word() + "." + num(2), word()]) + "@" + host()
            return [(rng.choice(["", "", "<", "mailto:", "email:"]), "O"), (t, kind)]
        if kind == "PHONE":
            t = rng.choice([f"+{num(1)} ({num(3)}) {num(3)}-{num(4)}", f"({num(3)}) {num(3)}-{num(4)}", f"{num(3)}-{num(3)}-{num(4)}", f"+{num(2)} {num(3)} {num(4)} {num(4)}", f"+{num(1)}-{num(3)}-{num(3)}-{num(4)}", f"{num(3)}.{num(3)}.{num(4)}", f"{num(3)} {num(4)} {num(4)}", f"0{num(3)} {num(3)} {num(4)}", f"{num(3)} {num(3)}-{num(4)}", f"+{num(2)} {num(2)} {num(4)} {num(4)}"])
            return [(rng.choice(["", "", "tel ", "phone: ", "call "]), "O"), (t, kind)]
        if kind == "CARD":
            return [(rng.choice(["", "", "", "card ", "visa: "]), "O"), (card(), kind)]
        if kind == "IP":
            four = ".".join(str(rng.randint(0, rng.choice([9, 99, 255, 255]))) for _ in range(4))
            six = ":".join(pick(hexes, rng.randint(1, 4)) for _ in range(8))
            short = ":".join(pick(hexes, rng.randint(1, 4)) for _ in range(rng.randint(1, 3))) + "::" + ":".join(pick(hexes, rng.randint(1, 4)) for _ in range(rng.randint(0, 3)))
            return [(rng.choice([four, four, four, four + ":" + num(4), six, short]), kind)]
        if kind == "KEY":
            return [(rng.choice([lambda: rng.choice(["AKIA", "ASIA", "AIDA"]) + pick(upper, 16), lambda: rng.choice(["AKIA", "AGPA"]) + pick(upper[:26], 16), lambda: rng.choice(["ghp_", "gho_"]) + pick(mixed, 36), lambda: rng.choice(["sk_live_", "rk_test_"]) + pick(mixed, 24), lambda: "xoxb-" + num(12) + "-" + pick(mixed, 24), lambda: "AIza" + pick(mixed, 35), lambda: f"eyJ{pick(mixed, 20)}.{pick(mixed, 40)}.{pick(mixed, 30)}"])(), kind)]
        if kind == "SSN":
            return [(f"{num(3)}-{num(2)}-{num(4)}", kind)]
        if kind == "IBAN":
            return [(pick(upper[:26], 2) + num(2) + pick(upper[:26], 4) + num(14), kind)]
        if kind == "NAME":
            full = rng.choice([cap(), cap() + " " + cap(), cap() + " " + cap(), cap() + " " + pick(upper[:26], 1) + ". " + cap()])
            return [(rng.choice(["Mr. ", "Mrs ", "Dr. ", "Ms. ", "Prof. ", "name: ", "Dear ", "contact ", "my name is ", "Signed, ", "regards, ", "Customer: "]), "O"), (full, kind)]
        if kind == "ADDRESS":
            t = f"{rng.randint(1, 9999)} " + " ".join(cap() for _ in range(rng.randint(1, 2))) + " " + rng.choice(["Street", "St", "Road", "Rd", "Avenue", "Ave", "Lane", "Drive", "Blvd", "Way", "Court"])
            return [(t, kind)]
        value = rng.choice([pick(hexes, rng.choice([16, 18, 24, 32, 40])), pick(mixed, rng.randint(16, 40)) + num(1), "".join(word() for _ in range(rng.randint(3, 6))), word() + word() + pick("!#%*", 1) + num(3), pick(mixed, rng.randint(8, 14)) + num(1)])
        name = rng.choice(["token", "secret", "api_key", "password", "auth_token", "passwd", "pwd", "apikey", "secret_key", "access_token", "client_secret", "DB_PASSWORD", "credentials"])
        return rng.choice(
            [
                lambda: [(name + rng.choice([" = ", "=", " := ", " => "]), "O"), (value, kind)],
                lambda: [(name + rng.choice([" = ", "=", ": ", ":"]) + (q := rng.choice("\"'")), "O"), (value, kind), (q, "O")],
                lambda: [(f'{{"{name}":"', "O"), (value, kind), ('"}', "O")],
                lambda: [(name + rng.choice([":", ": "]), "O"), (value if re.search(r"\d", value) else value + num(2), kind)],
            ]
        )()

    def plain() -> list[tuple[str, str]]:
        t = rng.choice(
            [
                lambda: str(rng.randint(1900, 2030)), lambda: str(rng.randint(0, 99999)), lambda: f"{rng.randint(1990, 2030)}-{num(2)}-{num(2)}", lambda: f"{num(2)}/{num(2)}/{rng.randint(1990, 2030)}",
                lambda: f"{num(2)}:{num(2)}", lambda: f"{num(2)}:{num(2)}:{num(2)}", lambda: f"${num(1)},{num(3)}.{num(2)}", lambda: f"{num(2)}.{num(1)}%", lambda: f"version {num(1)}.{num(1)}.{num(2)}", lambda: f"v{num(1)}.{num(2)}.{num(1)}",
                lambda: f"{num(1)}th", lambda: "commit " + pick(hexes, 40), *[lambda: pick(hexes, rng.randint(12, 64)), lambda: pick(hexes, rng.choice([16, 18, 20, 24, 32, 40]))] * 2, lambda: "sha256 " + pick(hexes, 64), lambda: "md5:" + pick(hexes, 32), lambda: "#" + pick(hexes, 6), lambda: f"978-{num(1)}-{num(4)}-{num(4)}-{num(1)}",
                lambda: "order " + num(10), lambda: "id=" + num(6), lambda: "n = " + num(4), lambda: f"{num(2)}-{num(2)}", lambda: f"https://{word()}.example.com/{num(5)}", lambda: "figure " + num(1), lambda: f"{word()}-{num(2)}",
                lambda: "size: " + num(5), lambda: f"{num(1)}.{num(3)}.{num(3)}", lambda: f"({num(2)})", lambda: f"[{num(1)}]", lambda: pick(upper[:26], rng.randint(12, 26)), lambda: pick(upper[:26], 20), lambda: pick(upper[:26], 2) + num(3), lambda: pick(hexes, 8) + "-" + pick(hexes, 4) + "-4" + pick(hexes, 3) + "-a" + pick(hexes, 3) + "-" + pick(hexes, 12),
                lambda: num(20), lambda: f"{num(3)}.{num(3)}.{num(3)},{num(2)}", lambda: "@" + word() + num(2), lambda: f"{num(4)}-{num(4)}", lambda: f"{num(1)},{num(3)},{num(3)}", lambda: f"+{num(1)}%", lambda: "blob " + pick(upper.lower() + upper, 30), lambda: f"{word()}{num(1)}@", lambda: f"{num(3)}.{num(3)}.{num(3)}.{300 + int(num(2))}",
                lambda: " ".join(str(rng.randint(1, 9999)) for _ in range(rng.randint(2, 5))), lambda: f"{rng.randint(1900, 2030)} {rng.randint(1900, 2030)}", lambda: f"{num(2)} {num(2)}", lambda: f"{rng.randint(1, 999)} {cap()}", lambda: f"{rng.randint(1, 99)} {cap()} {cap()}", lambda: f"{cap()} {num(2)}", lambda: f"In {rng.randint(1900, 2030)} {cap()} {word()}", lambda: f"{rng.randint(1, 99)} {cap()} {cap()} {cap()}", lambda: f"{num(2)}. {cap()} {cap()} {word()}", lambda: f"{cap()} {cap()} {num(3)}", lambda: f"{word().upper()} {pick(upper[:26], rng.randint(16, 24))} {word().upper()}", lambda: f"{word().upper()} {num(3)} {word().upper()}",
                lambda: rng.choice(["password: ", "token: ", "secret: ", "key: "]) + word() + rng.choice(["", word(), word() + word()]), lambda: "password" + rng.choice([" ", ", "]) + word(), lambda: "the key " + word(), lambda: "name " + word(), lambda: "contact " + word() + " " + num(2), lambda: f"| {num(3)} | {word()} | {num(4)} |", lambda: f'{{"{word()}": {num(3)}, "{word()}": "{word()}"}}', lambda: f"{word()},{num(3)},{word()}", lambda: f"{word()}:{num(2)}", lambda: f"{num(1)}::{word()}",
            ]
        )()
        return [(t, "O")]

    docs = []
    for _ in range(n):
        doc: list[tuple[str, str]] = []
        kept: list[list[tuple[str, str]]] = []
        for _ in range(rng.randint(3, 9)):
            doc += [((cap if rng.random() < 0.15 else word)() + " ", "O") for _ in range(rng.randint(0, 4))]
            r = rng.random()
            if r < 0.15 and kept:  # repeated mentions, out of their context
                again = rng.choice(kept)
                bare = [(t, y) for t, y in again if y != "O" or len(again) == 1]
                for _ in range(rng.choice([1, 1, 1, 2, 4])):
                    doc += [*bare, (" " + (word() + " ") * rng.randint(0, 2), "O")]
            else:
                kept.append(entity() if r < 0.6 else plain())
                doc += kept[-1]
            doc.append((rng.choice([".", ",", pick("#$%!&*~", 3), ")", "!", ";", ">", "|"]) + " " if rng.random() < 0.3 else " ", "O"))
        docs.append(doc)
    return docs


@dataclass
class Field:
    vocabulary: dict[str, int]
    weights: np.ndarray
    pair: np.ndarray  # log potentials by type of edge, label of a, label of b
    shared: np.ndarray  # log prior of shared nodes by type, label

    def unary(self, nodes: list[Node]) -> np.ndarray:
        out = np.zeros((len(nodes), len(KINDS)))
        for i, x in enumerate(nodes):
            f = [self.vocabulary[k] for k in x.features if k in self.vocabulary]
            out[i] = self.weights[f].sum(axis=0)
        return out

    def label(self, nodes: list[Node]) -> np.ndarray:
        if not nodes:
            return np.empty(0, np.int64)
        a, b, kind, shared = edges(nodes)
        p = propagate(np.concatenate((self.unary(nodes), self.shared[shared])), a, b, kind, self.pair)[: len(nodes)]
        out = p.argmax(axis=1)
        for group, card in number_groups(nodes):
            if (out[group] == KINDS.index("CARD" if card else "PHONE")).any():
                out[group] = np.log(np.maximum(p[group], 1e-300)).sum(axis=0).argmax()
        return out


def labelled(docs: list[list[tuple[str, str]]]) -> tuple[list[Node], np.ndarray]:
    """Nodes of the generated documents, and their labels."""
    nodes, _, at = candidates(pa.array(["".join(t for t, _ in d) for d in docs]))
    y = np.zeros(len(nodes), np.int64)
    spans: list[list[tuple[int, int, int]]] = []
    for d in docs:
        own, k = [], 0
        for t, kind in d:
            n = len(t.encode())
            if kind != "O":
                own.append((k, k + n, KINDS.index(kind)))
            k += n
        spans.append(own)
    for i, x in enumerate(nodes):
        s = x.start - at[x.doc]
        y[i] = next((k for a, b, k in spans[x.doc] if a <= s < b), 0)
    return nodes, y


@functools.lru_cache(1)
def trained(n: int = 3000, seed: int = 3, rounds: int = 120) -> Field:
    nodes, y = labelled(_generated(random.Random(seed), n))
    counts: dict[str, int] = {}
    for x in nodes:
        for f in x.features:
            counts[f] = counts.get(f, 0) + 1
    vocabulary = {f: i for i, f in enumerate(sorted(f for f, k in counts.items() if k >= 4))}
    row = np.concatenate([np.full(len(x.features), i) for i, x in enumerate(nodes)])
    col = np.array([vocabulary.get(f, -1) for x in nodes for f in x.features])
    row, col = row[col >= 0], col[col >= 0]
    dense = np.zeros((len(nodes), len(vocabulary)), np.float32)
    dense[row, col] = 1
    gold = np.eye(len(KINDS), dtype=np.float32)[y]
    w, m, v = (np.zeros((len(vocabulary), len(KINDS)), np.float32) for _ in range(3))
    for k in range(1, rounds + 1):
        z = dense @ w
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        g = dense.T @ (p - gold) / len(nodes) + 2e-5 * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= 0.1 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
    a, b, kind, shared = edges(nodes)
    hub = np.zeros(len(shared), np.int64)
    for i, j in zip(a[kind > 0], b[kind > 0]):  # a shared node is of the kind of any of its mentions
        hub[j - len(nodes)] = max(hub[j - len(nodes)], y[i])
    size = len(KINDS)
    pair, prior = np.zeros((3, size, size)), np.zeros((3, size))
    share = np.bincount(y, minlength=size) / len(y)
    y = np.concatenate((y, hub))
    # chain: how much likelier two labels are next to each other than apart, weighted by half
    seen = np.full((size, size), 2.0)
    np.add.at(seen, (y[a[kind == 0]], y[b[kind == 0]]), 1)
    pair[0] = 0.5 * np.log(seen / seen.sum() / np.outer(share, share))
    # a mention given its shared node, against what it is at all
    for t in (1, 2):
        seen = np.full((size, size), 0.2)
        np.add.at(seen, (y[a[kind == t]], y[b[kind == t]]), 1)
        pair[t] = np.log(seen / seen.sum(axis=0) / share[:, None])
        prior[t] = np.log((np.bincount(hub[shared == t], minlength=size) + 0.2) / (np.sum(shared == t) + 0.2 * size))
    return Field(vocabulary, w.astype(float), pair, prior)


def find(field: Field, texts: pa.Array) -> list[list[tuple[int, int, int, int, int]]]:
    """(character start, end, kind, byte start, end) of the entities of each text; bytes count within the batch."""
    nodes, data, at = candidates(texts)
    out: list[list] = [[] for _ in range(len(texts))]
    hits = [(x, int(y)) for x, y in zip(nodes, field.label(nodes)) if y]
    if not hits:
        return out
    chars = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    last = None
    for x, y in hits:
        base = chars[at[x.doc]]
        s, e = int(chars[x.start] - base), int(chars[x.end] - base)
        if last and last[0] == x.doc and last[1] == x.at - 1 and last[2] == y and y in JOINED:
            s, _, _, bs, _ = out[x.doc].pop()
            out[x.doc].append((s, e, y, bs, x.end))
        else:
            out[x.doc].append((s, e, y, x.start, x.end))
        last = (x.doc, x.at, y)
    return out


def redacted(text: str, found: list[tuple]) -> str:
    parts, at = [], 0
    for s, e, y, *_ in found:
        parts += [text[at:s], "[", KINDS[y], "]"]
        at = e
    return "".join(parts) + text[at:]


def redact(docs: DataFrame, text: str = "text", entities: str | None = "entities", count: str | None = "n_entities") -> DataFrame:
    """docs with the text redacted, and the entities and their number unless their names are None."""
    ensure_workers(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(trained())
    where = docs.columns.index(next(x for x in docs.columns if x.lower() == text.lower()))
    named = fresh(docs, *[x for x in (entities, count) if x])
    schema = docs.withColumn(docs.columns[where], c(text).cast("string")).schema
    extra = [(x, k) for x, k in zip(named, [k for x, k in ((entities, ENTITIES), (count, T.IntegerType())) if x])]
    for x, k in extra:
        schema = type(schema)(list(schema.fields)).add(x, k)
    struct = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = shared.value
        for batch in batches:
            for a, part in pieces(batch.column(where)):
                found = find(field, part)
                hit = [i for i, f in enumerate(found) if f]
                new = part
                if hit:
                    mask = np.zeros(len(part), bool)
                    mask[hit] = True
                    new = pc.replace_with_mask(part, pa.array(mask), pa.array([redacted(part[i].as_py(), found[i]) for i in hit], part.type))
                columns = list(batch.slice(a, len(part)).columns)
                columns[where] = new
                null = part.is_null().to_pylist()
                for x, k in extra:
                    if k is not ENTITIES:
                        columns.append(pa.array([None if z else len(f) for f, z in zip(found, null)], pa.int32()))
                    else:
                        columns.append(pa.array([None if z else [{"start": s, "end": e, "kind": KINDS[y]} for s, e, y, *_ in f] for f, z in zip(found, null)], pa.list_(struct)))
                yield pa.RecordBatch.from_arrays(columns, names)
        release()

    names = [f.name for f in schema]
    return docs.withColumn(docs.columns[where], c(text).cast("string")).mapInArrow(run, schema)
