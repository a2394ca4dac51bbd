"""Personal data: exact base spans, and more spans proposed by generators and selected by boosted trees.

High-recall generators propose overlapping candidates. Trees score each by its format and its context. They learn from
evidence apart from the base formats (what is left once disguises are undone, checksums, valid addresses, cue words) and
from examples written into every text, right ones and look-alikes. The cut of each kind is calibrated for precision
on rows that the trees were not fitted on and that no base span covers. Candidates that pass are taken best first,
leaving out those that overlap a taken one. Base spans always stay.
"""

import bisect
import hashlib
import ipaddress
import json
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from comarca.llm import boosting
from comarca.llm.frames import with_text

KINDS = ["email", "ip", "card", "phone", "secret"]
PRECISION = 0.98
CONTEXT = 24  # code points before and after a candidate that count as its context
PLANTED = 2  # examples written into each document
EXAMPLES = 2_000  # and examples in plain frames, so that a corpus without personal data gives a model too
SLICE = 20_000  # candidates scored at once
ROUNDS, DEPTH = 80, 4  # of the boosted trees
WIDTH = 31  # features of a candidate, see ``describe``; kept in single precision

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a match can only start at the start of a run of digits, which spares retries inside long runs
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL_SET = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _digits(s):
    return re.sub("[^0-9]", "", s)


def emails(text):
    """Leftmost non-overlapping addresses, in time linear in the text."""
    end, at = 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > end and text[begin - 1] in _LOCAL_SET:
            begin -= 1
        match = _DOMAIN.match(text, at + 1) if begin < at else None
        if match:
            yield begin, match.end()
            end = match.end()
        else:
            end = at + 1
        at = text.find("@", end)


def base_spans(text):
    """``(kind, start, end)``, kinds as listed, then by start."""
    out = [("email", a, b) for a, b in emails(text)]
    out += [("ip", *m.span()) for m in _IP.finditer(text) if all(_small(p) for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        digits = _digits(m[0])
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 8 <= len(_digits(m[0])) <= 15]
    return out


def _small(part):
    part = part.lstrip("0")
    return len(part) < 4 and int(part or 0) <= 255


# Generators look for a cheap anchor first (a sign, a run of digits, an assignment) and match there only, so a text is read a
# few times at the speed of a plain search. Runs are possessive: one of any length is read once.
_AT = re.compile(r"@|[(\[{<] ?[aA][tT] ?[)\]}>]")
_WORD_AT = re.compile(r" [aA][tT] (?=[\w-]++ [dD][oO][tT] )")
_LOCAL = re.compile(r"[\w.%+-]")
_MAILBOX = re.compile(
    r"[\w.%+-]++(?: ?(?:@|[(\[{<] ?at ?[)\]}>]) ?[\w-]++(?:(?:\.| ?[(\[{<] ?(?:dot|\.) ?[)\]}>] ?| dot )[\w-]++)+"
    r"| at [\w-]++(?: dot [\w-]++)+)", re.I
)
_RUN = re.compile(r"[0-9]++")
#: What a run of digits may begin. Matches of one kind may overlap, since every run is tried.
_NUMBERS = [
    ("ip", re.compile(r"(?<![\d.])\d{1,3}(?:[.,]\d{1,3}){3}(?![\d.]\d)")),
    ("card", re.compile(r"\d{4}(?:[ ._/-]{0,3}\d{4}){2}[ ._/-]{0,3}\d{1,7}(?!\d)")),
    ("card", re.compile(r"\d{4}[ ._/-]{0,3}\d{6}[ ._/-]{0,3}\d{5}(?!\d)")),
    ("phone", re.compile(r"(?<![\w.+])(?:\+|00 ?)?\(?\d{1,5}\)?(?:[ ./-]{1,3}\(?\d{2,8}\)?){1,5}(?!\w)")),
    ("phone", re.compile(r"(?<![\w.])(?:\+|00)\d{8,15}(?!\w)")),
]
_COLONS = re.compile(r":[0-9a-fA-F]{0,4}:")
_SIX = re.compile(r"(?<![\w:.])([0-9a-fA-F]{0,4}(?::[0-9a-fA-F]{0,4}){2,7})(?![\w:])")
_LONG = re.compile(r"[A-Za-z0-9_+/-]{16,}+=*+")
_ASSIGNED = re.compile(r"[=:][ \t]{0,3}[\"']?([^\s\"'<>,;]{6,}+)")
_CUES = {
    "email": ("mail", "contact", "write", "reach"),
    "ip": ("ip", "host", "address", "server", "client", "login from"),
    "card": ("card", "visa", "pay", "amex", "debit", "credit"),
    "phone": ("phone", "tel", "call", "fax", "mobile", "cell", "dial", "whatsapp"),
    "secret": ("password", "passwd", "token", "secret", "key", "pwd", "api", "credential"),
}
_COUNTER_CUES = ("version", "release", "isbn", "order", "section", "date", "page", "serial", "tracking", "release ")
_HINT = re.compile("[0-9@]")  # what every base span has
_TOKEN = re.compile(r"(?:AKIA|ASIA)[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{20,}|sk-[A-Za-z0-9_-]{16,}|xox[abp]-[A-Za-z0-9-]{10,}|eyJ[A-Za-z0-9_-]{10,}")
_NAMED = re.compile(r"(?i)(?:passw(?:or)?d|passphrase|pwd|token|secret|api[_ -]?key|access[_ -]?key)[\"']?\s*[=:]\s*[\"']?$")
_DATE = re.compile(r"(?:\d{4}[./ -]\d{1,2}[./ -]\d{1,2}|\d{1,2}[./ -]\d{1,2}[./ -]\d{4})(?!\d)")


def candidates(text):
    """Distinct ``(kind, start, end)`` of all generators; they may overlap."""
    found = set()
    anchors = [*_AT.finditer(text), *(_WORD_AT.finditer(text) if " dot " in text.lower() else ())]
    for m in anchors:
        a = m.start() - (text[m.start() - 1 : m.start()] == " ")
        while a and _LOCAL.match(text, a - 1):
            a -= 1
        match = _MAILBOX.match(text, a)
        if match:
            found.add(("email", *match.span()))
    for m in _RUN.finditer(text):
        a = m.start()
        for kind, pattern in _NUMBERS:
            begin = a
            while kind == "phone" and begin and a - begin < 2 and text[begin - 1] in "+(":
                begin -= 1
            match = pattern.match(text, begin)
            if match:
                found.add((kind, *match.span()))
    if _COLONS.search(text):
        found.update(("ip", *m.span(1)) for m in _SIX.finditer(text))
    found.update(("secret", *m.span()) for m in _LONG.finditer(text))
    found.update(("secret", *m.span(1)) for m in _ASSIGNED.finditer(text) if _NAMED.search(text, max(0, m.start(1) - CONTEXT), m.start(1)))
    return sorted(found)


def undisguised(s):
    """An address with its ``(at)`` and ``dot`` undone."""
    s = re.sub(r"(?i) ?[(\[{<] ?at ?[)\]}>] ?| at ", "@", s)
    return re.sub(r"(?i) ?[(\[{<] ?(?:dot|\.) ?[)\]}>] ?| dot ", ".", s).replace(" ", "")


def _address(s):
    """4 or 6 where the text is an IP address, 0 otherwise."""
    try:
        return ipaddress.ip_address(s.replace(",", ".") if ":" not in s else s).version if re.search("[0-9a-fA-F]", s) else 0
    except ValueError:
        return 0


def _mailbox(s):
    """Whether the undisguised text is an address under a domain that ends in letters."""
    plain = undisguised(s) if len(s) < 400 else s
    return bool(re.fullmatch(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,12}", plain))


def _checked(digits):
    """Whether digits have a card's length, first digit and checksum."""
    return 13 <= len(digits) <= 19 and digits[0] in "23456" and len(set(digits)) > 1 and luhn(digits)


def _classes(s):
    return sum(bool(re.search(c, s)) for c in ("[a-z]", "[A-Z]", "[0-9]"))


def _entropy(s):
    counts = np.array([s.count(c) for c in set(s)]) / max(1, len(s))
    return float(-(counts * np.log2(counts)).sum())


def describe(text, kind, a, b) -> list[float]:
    """Format and context features of one candidate."""
    s, n = text[a:b], b - a
    before, after = text[max(0, a - CONTEXT) : a].lower(), text[b : b + CONTEXT].lower()
    digits = _digits(s)
    runs = [len(r) for r in re.findall("[0-9]+", s)]
    words = re.split("[_+/=-]+", s)
    letters = sum(c.isalpha() for c in s)
    digit = np.frombuffer(s.encode("utf-32-le"), np.uint32)
    digit = (digit >= 48) & (digit <= 57)
    return [
        float(KINDS.index(kind)), n, len(digits), len(digits) / n, len(runs), max(runs, default=0), min(runs, default=0),
        letters / n, sum(c.isupper() for c in s) / n, sum(c in "0123456789abcdefABCDEF" for c in s) / n, _entropy(s),
        float((digit[1:] != digit[:-1]).sum()) / n, s.count("."), s.count("-") + s.count(" "), s.count("("),
        float(s.startswith("+")), float(s.startswith("00")), float("@" in s), float(kind == "email" and _mailbox(s)),
        float(len(digits) < 20 and _checked(digits or "0")), float(_address(s) if kind == "ip" else 0), float(_classes(s)),
        float(max(map(len, words))), float(bool(_TOKEN.match(s))), float(bool(_NAMED.search(before))), float(bool(_DATE.match(s))),
        float(any(cue in before for cue in _CUES[kind])), float(any(cue in after for cue in _CUES[kind])),
        float(any(cue in before for cue in _COUNTER_CUES)), float(text[a - 1 : a] in ("=", '"', ":", "'") if a else 0),
        float(after[:1] in ("", " ", "\n", ".", ",", '"', "'", ";", ")")),
    ]


def evidence(text, kind, a, b) -> bool:
    """What speaks for a candidate apart from the base formats; what the trees learn to generalise."""
    s, before = text[a:b], text[max(0, a - CONTEXT) : a].lower()
    cue, counter = (any(c in before for c in cues) for cues in (_CUES[kind], _COUNTER_CUES))
    digits = _digits(s)
    if kind == "email":
        return _mailbox(s)
    if kind == "ip":
        return bool(_address(s)) and (cue or not counter)
    if kind == "card":
        return _checked(digits or "0") and (cue or not counter)
    if kind == "phone":
        marked = s.startswith(("+", "00")) or cue
        return 8 <= len(digits) <= 15 and marked and not counter and not _DATE.match(s) and not _checked(digits)
    return bool(_NAMED.search(before)) or bool(_TOKEN.match(s)) or (20 <= len(s) and _classes(s) == 3 and _entropy(s) > 3.5)


def example(rng):
    """``(kind, words before, text, right)``: a made-up example of a kind, or something that looks like one."""
    pick, digits = rng.choice, lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    word = lambda lo=3, hi=9: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(lo, hi)))
    kind, right = pick(KINDS), rng.random() < 0.5
    lead = pick(["", "", *(c + pick([": ", " ", " is "]) for c in _CUES[kind])])
    if kind == "email":
        at, dot = pick(["@", "(at)", " (at) ", "[at]", " [at] ", " at ", "{at}"]), pick([".", " dot ", "(dot)", " [dot] "])
        if at == " at " or not right:
            dot = " dot " if right else "."
        name = word() + pick(["", "." + word(), digits(2)])
        if right:
            return kind, lead, name + at + word() + dot + pick(["com", "org", "net", "de", "io", "co" + dot + "uk"]), True
        return kind, "", name + pick([" at ", "@"]) + word() + dot + digits(rng.randint(1, 3)), False
    if kind == "ip":
        if right:
            six = ":".join(f"{rng.randrange(65536):x}" for _ in range(8))
            short = f"{rng.randrange(4096, 65536):x}:{rng.randrange(65536):x}::{rng.randrange(65536):x}"
            four = ",".join(str(rng.randrange(256)) for _ in range(4))
            return kind, lead, pick([six, short, four]), True
        look = [f"{digits(2)}:{digits(2)}:{digits(2)}", ",".join(str(rng.randrange(256, 999)) for _ in range(4)), f"{digits(3)}:{digits(4)}:{digits(2)}"]
        return kind, pick(["", "version ", "release ", "at "]), pick(look), False
    if kind == "card":
        body = pick("3456") + digits(14)
        number = next(body + c for c in "0123456789" if luhn(body + c) == right)
        sep = pick([".", "_", " - ", "/", " ", "-"])
        groups = sep.join(number[i : i + 4] for i in range(0, 16, 4))
        # digits before keep a right one from being taken as a base span
        return kind, (lead if right else pick(["order ", "serial ", "tracking ", ""])) + ("" if sep not in " -" else digits(2) + " "), groups, right
    if kind == "phone":
        if right:
            lead = pick([c + pick([": ", " ", ". "]) for c in _CUES[kind]])
            plain = pick([f"({digits(3)}) {digits(3)}-{digits(4)}", f"{digits(3)}-{digits(3)}-{digits(4)}", f"0{digits(3)} {digits(7)}", f"{digits(3)}.{digits(3)}.{digits(4)}"])
            far = f"00{pick('123456789')}{digits(1)} {digits(2)} {digits(7)}"
            return (kind, lead, plain, True) if rng.random() < 0.6 else (kind, pick([lead, ""]), far, True)
        look = [f"{rng.randint(1900, 2030)}-{rng.randint(1, 12):02d}-{rng.randint(1, 28):02d}", f"{digits(3)}-{digits(1)}-{digits(5)}-{digits(3)}", f"{digits(4)} {digits(4)}", f"{digits(2)}.{digits(3)}.{digits(3)}"]
        return kind, pick(["", "isbn ", "order ", "date ", "page "]), pick(look), False
    mixed = lambda n: "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(n))
    if right:
        named = pick(["password", "token", "secret", "api_key", "pwd", "api key"]) + pick(["=", ": ", ' = "'])
        known = pick(["ghp_" + mixed(36), "AKIA" + mixed(16).upper(), "sk-" + mixed(32), "eyJ" + mixed(60)])
        return pick([(kind, named, mixed(rng.randint(12, 40)), True), (kind, pick(["", named]), known, True), (kind, "", mixed(rng.randint(32, 80)), True)])
    look = ["-".join(word() for _ in range(4)), "/".join(word() for _ in range(5)), "_".join(word() for _ in range(4)), word(16, 24), digits(20), "-" * 20, "=" + word(17, 20)]
    return kind, "", pick(look), False


def planted(text, rng):
    """Feature rows and labels of all that generators propose on an example written into a gap of ``text``.

    Only the example itself, whole and of its own kind, can be right.
    """
    kind, lead, value, right = example(rng)
    gaps = text.rfind(" ", 0, rng.randrange(len(text) + 1)) if text else 0
    left, right_side = text[max(0, gaps - CONTEXT) : max(0, gaps)], text[max(0, gaps) :][:CONTEXT]
    place = f"{left} {lead}"
    full = f"{place}{value}{right_side if right_side[:1] in ('', ' ') else ' ' + right_side}"
    spot = (kind, len(place), len(place) + len(value))
    met = [c for c in candidates(full) if c[1] < spot[2] and spot[1] < c[2]]
    return [(describe(full, *c), right and c == spot) for c in met]


def train(documents: DataFrame) -> str:
    """Fit trees and cuts on the candidates of every document and on examples written into each of them.

    Candidates that overlap a base span stay out, since they are never asked about. Rows of one id and one text count once.
    About four fifths of the candidates are fitted, the rest calibrate the cuts. An empty table leaves the examples in plain
    frames. Returns the model as JSON.
    """

    def extract(batches):
        for batch in batches:
            rows = []
            for i, t in zip(*(batch.column(k).to_pylist() for k in range(2))):
                key = f"{i}:{hashlib.sha256(t.encode(errors='replace')).hexdigest()}"
                rng = random.Random(key)
                made = [row for _ in range(PLANTED) for row in planted(t, rng)]
                rows += [(f"{key}:{k}", int(right), x) for k, (x, right) in enumerate(made)]
                for c in uncovered(candidates(t), base_spans(t) if _HINT.search(t) else []):
                    rows.append((f"{key}:{c}", int(evidence(t, *c)), describe(t, *c)))
                    if len(rows) >= SLICE:
                        yield _rows(rows)
                        rows = []
            yield _rows(rows)

    def frames(batches):
        rng = random.Random(0)
        made = [row for _ in range(EXAMPLES) for row in planted("the text goes on here " * 3, rng)]
        for _ in batches:
            yield _rows([(f"{k}", int(right), x) for k, (x, right) in enumerate(made)], np.arange(len(made)) % 5)

    found = with_text(documents, "doc_id", "text").where("text is not null").mapInArrow(extract, _ROWS).dropDuplicates(["place"])
    plain = documents.sparkSession.range(1).coalesce(1).mapInArrow(frames, _ROWS)
    rows = found.unionByName(plain).select("x", "y", F.expr("fold = 0").alias("held")).persist()
    fitted, held = rows.where("not held"), rows.where("held")
    model = boosting.fit_frame(fitted, WIDTH, rounds=ROUNDS, depth=DEPTH)
    cuts = boosting.calibrated_cuts(held, model, len(KINDS), PRECISION)
    rows.unpersist()
    return json.dumps({**model, "cuts": [max(0.5, c) for c in cuts]})


_ROWS = "place binary, fold int, y int, x array<float>"


def _rows(rows, folds=None):
    places = [hashlib.sha256(k.encode(errors="replace")).digest()[:16] for k, _, _ in rows]
    x = np.array([x for _, _, x in rows], np.float32).ravel()
    lists = pa.ListArray.from_arrays(np.arange(len(rows) + 1, dtype=np.int32) * (len(x) // max(1, len(rows))), x)
    columns = [pa.array(places, pa.binary()), pa.array([p[0] % 5 for p in places] if folds is None else folds, pa.int32()), pa.array([y for _, y, _ in rows], pa.int32()), lists]
    return pa.RecordBatch.from_arrays(columns, ["place", "fold", "y", "x"])


def uncovered(spans, base):
    """The spans that overlap no base span: one sweep over both by start."""
    left = []
    for _, a, b in sorted(base, key=lambda s: s[1:]):
        if left and a < left[-1][1]:
            left[-1][1] = max(b, left[-1][1])
        else:
            left.append([a, b])
    starts = [a for a, _ in left]

    def free(a, b):
        k = bisect.bisect_left(starts, b)
        return not k or left[k - 1][1] <= a

    return [s for s in spans if free(s[1], s[2])]


def chosen(proposed, scores, cuts):
    """Candidates above their kind's cut, best first, without those that overlap a taken one."""
    starts, ends, taken = [], [], []
    for s, (kind, a, b) in sorted(zip(-scores, proposed), key=lambda c: (c[0], c[1][1] - c[1][2], c[1])):
        if -s < cuts[KINDS.index(kind)]:
            continue
        k = bisect.bisect_left(starts, b)
        if not k or ends[k - 1] <= a:
            at = bisect.bisect_left(starts, a)
            starts.insert(at, a)
            ends.insert(at, b)
            taken.append((kind, a, b))
    return taken


def added_spans(texts, bases, model):
    """For each text, the spans that the trees add to its base spans. Candidates are scored in slices of many texts."""
    out, waiting, rows, scores = [[] for _ in texts], [], [], []

    def score():
        if rows:
            scores.append(boosting.predict(model, np.array(rows, np.float32)))
            rows.clear()

    for at, (text, base) in enumerate(zip(texts, bases)):
        proposed = uncovered(candidates(text), base)
        if proposed:
            waiting.append((at, proposed))
        for c in proposed:
            rows.append(describe(text, *c))
            if len(rows) >= SLICE:
                score()
    score()
    every, begin = np.concatenate(scores) if scores else np.zeros(0), 0
    for at, proposed in waiting:
        out[at] = chosen(proposed, every[begin : begin + len(proposed)], model["cuts"])
        begin += len(proposed)
    return out


def spell(spans):
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1:])))


SCHEMA = (
    "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, redacted string"
)


def find_pii(documents: DataFrame, model: str, redact=True) -> DataFrame:
    """One row per row of ``documents(doc_id, text)``, see ``SCHEMA``; null texts count as empty.

    Counts and ``base_sha256`` are of base spans; ``spans`` has all of them, as code points, end exclusive.
    ``redacted`` is the text with every span replaced by its kind in brackets (null without ``redact``). Rows that repeat an
    id are judged one by one, texts of any length whole; of candidates with one score the longer one, then the kind first
    in the alphabet is taken.
    """

    def run(batches):
        trees = json.loads(model)
        for batch in batches:
            rows = []
            texts = [value or "" for value in batch.column("text").to_pylist()]
            bases = [base_spans(text) if _HINT.search(text) else [] for text in texts]
            for text, base, added in zip(texts, bases, added_spans(texts, bases, trees)):
                spans = base + added
                clean = mask(text, spans) if redact else None
                kinds = [sum(s[0] == k for s in base) for k in KINDS[:4]]
                rows.append((*kinds, hashlib.sha256(spell(base).encode()).hexdigest(), spell(spans), clean))
            if rows:
                types = [pa.int64()] * 4 + [pa.string()] * 3
                columns = [pa.array(c, t) for c, t in zip(zip(*rows), types)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], _NAMES)

    return with_text(documents, "doc_id", "text").mapInArrow(run, SCHEMA)


_NAMES = [c.split()[0] for c in SCHEMA.split(", ")]


def mask(text, spans):
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if b > at:
            out += [text[at : max(a, at)], f"[{kind}]" if a >= at else ""]
            at = b
    return "".join([*out, text[at:]])
