"""Personal data: fixed patterns, and a linear-chain conditional random field that finds what they miss."""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from segtide.llm.tables import release_memory, ship

BASE_KINDS = ["email", "ip", "card", "phone"]  # of the fixed patterns
KINDS = [*BASE_KINDS, "secret"]  # secrets (keys, tokens, passwords that machines made) are the field's alone
LABELS = ["O", *(f"{p}-{k}" for k in KINDS for p in "BI")]

# --- fixed patterns -------------------------------------------------------------------------------

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _is_card(text: str) -> bool:
    d = _digits(text)
    return 13 <= len(d) <= 19 and luhn(d)


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > done and text[begin - 1] in _LOCAL:
            begin -= 1
        domain = _DOMAIN.match(text, at) if begin < at else None
        if domain:
            done = domain.end()
            yield begin, done
        at = text.find("@", max(at + 1, done))


def _addresses(text: str) -> Iterator[tuple[int, int]]:
    for chain in _DOTTED.finditer(text):  # a chain of dotted numbers holds one match in every four of them
        at, parts = chain.start(), chain[0].split(".")
        for k in range(0, len(parts) - 3, 4):
            four = parts[k:k + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in four):
                yield at, end
            at = end + 1


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Matches of the fixed patterns in code points, by kind and start: leftmost, without overlap inside a kind."""
    out = [("email", *s) for s in _emails(text)]
    if _DIGIT.search(text):
        out += [("ip", *s) for s in _addresses(text)]
        out += [("card", m.start(), m.end()) for m in _CARD.finditer(text) if m.end() - m.start() >= 13 and _is_card(m[0])]
        out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return out


# --- the labelled table ---------------------------------------------------------------------------

# Fixed examples: sentences with a place for a value of the named kind, written in forms the patterns miss;
# "no" values look alike but are nobody's data.
SENTENCES = [
    "write to {email} for the full report", "my address is {email} and I answer daily", "contact : {email} .",
    "reach the desk at {email} or by phone {phone} today", "mail {email} before noon",
    "call {phone} after six", "phone {phone} and ask for the manager", "tel. {phone} , weekdays only",
    "his mobile number is {phone} as far as I know", "fax {phone} was never answered",
    "the host {ip} did not reply", "server at {ip} went down again", "ping {ip} and wait", "blocked {ip} this morning",
    "paid with card {card} on Monday", "card number {card} expires soon", "charge {card} for the order",
    "the refund went to {card} last week", "order {no} was shipped", "version {no} is out now",
    "in chapter {no} the story ends", "we counted {no} of them", "meeting on {no} in the hall", "commit {digest} broke the build",
    "token = {secret} in the file", "TOKEN = {secret} is set", "and then token = {secret} was there", "api_key : {secret} ,",
    "the password is {secret} for now", "secret = {secret} , keep it", "access_key = {secret}", "Authorization: Bearer {secret} sent",
    "key = {secret} .", "{word} token = {secret} {word}", "{word} {word} secret: {secret} {word}", "run {assigned} then", "set {assigned}",
    "{word} {assigned} {word}", "{word} {word} {assigned} {word} {word}", "{assigned}", "{word} {assigned}",
    "checksum {digest} matches", "sha1 {digest} of the file", "the commit {digest} is in", "etag {digest} was sent", "{digest} archive.tar",
    "digest = {digest} , as before", "{word} {word} {digest} {word}",
    "{card}", "{phone}", "{email}", "{ip}", "{no}", "{no} {no}", "card {card} please", "now {card} then", "{phone} then",
    "then {phone}", "from {email} , yes", "{ip} now", "old {ip} new", "then {no} now", "the {no} , a {no} .", "{no} there",
    "total {no} in all", "look at the dot on the map at night", "he was at home and she was at work",
    "the report of {no} names no one", "part {no} of the series", "it cost {no} in the end",
]
VALUES = {
    "email": ["maria at mail dot example dot org", "j.smith (at) example.com", "info [at] example [dot] net",
              "anna_k at example.com", "team at lists dot example dot com", "lee (at) mail (dot) example (dot) org"],
    "phone": ["(555) 010-4477", "(020) 555 0199 12", "0049 30 555 01234", "555-010-4477", "(415) 555-2671",
              "030/555 012345", "0033 1 55 50 12 34", "212.555.0187"],
    "ip": ["192[.]168[.]1[.]20", "10(.)0(.)0(.)7", "172 dot 16 dot 4 dot 9", "203[.]0[.]113[.]45"],
    "card": ["4111.1111.1111.1111", "5500/0000/0000/0004", "4012.8888.8888.1881", "3400_000000_00009"],
    "secret": ['"{40}"', '"{40}"', "{40}", '"{32}"', "{64}", "AKIA{A16}", "ghp_{a36}", "sk-{a32}", '"{a24}"', "'{a40}'", '"{A40}"'],
    "assigned": ['token="{40}"', "API_KEY={a32}", "password={a20}", 'secret="{32}";'],
    "digest": ["{40}", "{64}", "{32}", "{40}"],
    "word": ["the", "pone", "eauou", "chsch", "ando", "thereer", "queê", "ungen."],
    "no": ["2023-11-05", "12:45:10", "3.11.2", "1,250,000", "17", "1998", "9f86d081884c7d659a2f", "45.60", "2001/02", "99%",
           "9807915762804490", "1 000", "12-14", "4.5.6-rc1", "AB-1234-X", "#20941", "1/2", "7th", "\"04dbebab91ab\"", "100.000"],
}


MADE = re.compile(r"\{([aA]?)([0-9]+)\}")


def made_up(form: re.Match, draw: random.Random) -> str:
    """A string of the length asked for: of hex digits, of all letters and digits (a), or of capitals and digits (A)."""
    signs = {"": "0123456789abcdef", "a": "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ",
             "A": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"}[form[1]]
    return ("4K" if form[1] else "7b") + "".join(draw.choices(signs, k=int(form[2]) - 2))  # always a letter and a digit


def labelled_table(copies: int = 12, seed: int = 3) -> list[tuple[list[str], list[str]]]:
    """(words, labels) of the example sentences with values drawn into them."""
    draw = random.Random(seed)
    out = []
    for sentence in SENTENCES * copies:
        words, labels = [], []
        for word in sentence.split():
            kind = word.strip("{}")
            if kind not in VALUES or word == kind:
                words.append(word)
                labels.append("O")
                continue
            value = draw.choice(VALUES[kind])
            if MADE.search(value):
                value = [MADE.sub(lambda m: made_up(m, draw), value)]
            else:
                value = re.sub(r"[0-8]", lambda m: str(draw.randint(0, 9)), value).split()
            kind = "secret" if kind == "assigned" else kind
            words += value
            labels += ["O"] * len(value) if kind not in KINDS else [f"B-{kind}", *[f"I-{kind}"] * (len(value) - 1)]
        out.append((words, labels))
    return out


# --- the field ------------------------------------------------------------------------------------

_RUN = re.compile(r"[0-9A-Za-z](?:[0-9A-Za-z]|[_-](?=[0-9A-Za-z]))*")


def machine_made(text: str, begin: int = 0, end: int | None = None) -> tuple[int, int] | None:
    """First run of at least 16 letters and digits, both of them there, perhaps with single strokes inside."""
    end = len(text) if end is None else end
    for m in _RUN.finditer(text, begin, end) if end - begin >= 16 else ():
        if len(m[0]) >= 16 and _DIGIT.search(m[0]) and re.search("[A-Za-z]", m[0]):
            return m.span()
    return None


_RUNS = (re.compile(r"[A-Z]+"), re.compile(r"[a-zÀ-ɏ]+"))


@lru_cache(maxsize=200_000)
def _own(word: str) -> tuple[str, ...]:
    """Shape features of a word: digits keep the length of their runs up to 5, letters do not."""
    made = machine_made(word)
    plain = word if made is None else word[:made[0]] + "#" + word[made[1]:]  # any such run has one shape
    shape = re.sub(r"[0-9]+", lambda m: "9" * min(len(m[0]), 5), _RUNS[1].sub("a", _RUNS[0].sub("A", plain[:60])))
    n = len(_digits(plain))
    return ("shape=" + shape, f"digits={n if n < 4 else 4 + (n > 6) + (n > 9) + (n > 12)}", f"first={shape[:1]}",
            f"last={shape[-1:]}", f"dots={min(word.count('.'), 4)}", f"bracket={'(' in word}{'[' in word}",
            f"set={made is not None and word[:made[0]].lower()[-16:]}", f"made={made is not None and min((made[1] - made[0]) // 8, 5)}", "word=" + (word.lower().strip(".,:;") if len(word) < 16 and n == 0 else ""))


def word_features(words: list[str]) -> list[list[str]]:
    """Features of each word and, marked by distance, of its neighbours up to two away."""
    own = [_own(w) for w in words]
    edge = ("edge",) * 3  # as many as a neighbour gives
    out = []
    for i in range(len(words)):
        row = list(own[i])
        for d in (-2, -1, 1, 2):
            near = own[i + d] if 0 <= i + d < len(words) else edge
            row += [f"{d}:{f}" for f in near[:2] + near[-1:]]
        out.append(row)
    return out


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (np.log(np.exp(x - top).sum(axis=axis, keepdims=True)) + top).squeeze(axis)


@dataclass
class Field:
    index: dict[str, int]
    weights: np.ndarray  # features x labels
    moves: np.ndarray  # labels x labels

    def scores(self, words: list[str]) -> np.ndarray:
        get = self.index.get
        return np.array([self.weights[[k for k in map(get, row) if k is not None]].sum(0) for row in word_features(words)])

    def decode(self, sequences: list[np.ndarray]) -> list[np.ndarray]:
        """Best label paths of many sequences at once (Viterbi): each step works on all that are long enough."""
        order = sorted(range(len(sequences)), key=lambda i: -len(sequences[i]))
        lengths = np.array([len(sequences[i]) for i in order])
        places = np.concatenate([[0], np.cumsum(lengths)])
        flat = np.concatenate([sequences[i] for i in order])
        best = flat[places[:-1]].copy()
        back = np.zeros((len(flat), len(LABELS)), dtype=np.int8)
        for t in range(1, lengths[0]):
            n = int((lengths > t).sum())
            paths = best[:n, :, None] + self.moves
            back[places[:n] + t] = paths.argmax(1)
            best[:n] = paths.max(1) + flat[places[:n] + t]
        out: list[np.ndarray] = [np.empty(0)] * len(sequences)
        for row, i in enumerate(order):
            path = np.empty(lengths[row], dtype=np.int8)
            path[-1] = best[row].argmax()
            for t in range(lengths[row] - 1, 0, -1):
                path[t - 1] = back[places[row] + t, path[t]]
            out[i] = path
        return out


def train(table: list[tuple[list[str], list[str]]] | None = None, steps: int = 80, penalty: float = 1e-3) -> Field:
    """Fit by the likelihood of the labelled table (forward and backward sums), with Adam."""
    table = table or labelled_table()
    feats = [word_features(words) for words, _ in table]
    index: dict[str, int] = {}
    for rows in feats:
        for row in rows:
            for f in row:
                index.setdefault(f, len(index))
    number = {name: i for i, name in enumerate(LABELS)}
    by_length: dict[int, list[int]] = {}
    for i, (words, _) in enumerate(table):
        by_length.setdefault(len(words), []).append(i)
    groups = [(np.array([[[index[f] for f in row] for row in feats[i]] for i in rows]),
               np.array([[number[x] for x in table[i][1]] for i in rows])) for rows in by_length.values()]
    k = len(LABELS)
    w, moves = np.zeros((len(index), k)), np.zeros((k, k))
    state = [np.zeros_like(x) for x in (w, w, moves, moves)]
    for step in range(1, steps + 1):
        g_w, g_m = penalty * w * len(table), penalty * moves * len(table)
        for ids, gold in groups:
            e = w[ids].sum(2)
            n, length = gold.shape
            a, b = [e[:, 0]], [np.zeros((n, k))]
            for t in range(1, length):
                a.append(e[:, t] + _lse(a[-1][:, :, None] + moves, 1))
                b.append(_lse((b[-1] + e[:, length - t])[:, None, :] + moves, 2))
            b.reverse()
            z = _lse(a[-1], 1)
            for t in range(length):
                p = np.exp(a[t] + b[t] - z[:, None])
                p[np.arange(n), gold[:, t]] -= 1
                np.add.at(g_w, ids[:, t], p[:, None, :])
                if t:
                    pair = np.exp(a[t - 1][:, :, None] + moves + (e[:, t] + b[t])[:, None, :] - z[:, None, None])
                    g_m += pair.sum(0)
                    np.add.at(g_m, (gold[:, t - 1], gold[:, t]), -1)
        for value, g, m, v in ((w, g_w, state[0], state[1]), (moves, g_m, state[2], state[3])):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            value -= 0.15 * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-8)
    del feats, groups, state
    release_memory()
    return Field(index, w, moves)


# --- finding --------------------------------------------------------------------------------------

_TRIGGER = re.compile(r"[0-9@]|\b(?:at|dot)\b|[(\[](?:at|dot|\.)[)\]]", re.IGNORECASE)
# every span that _valid accepts has a digit, or an '@' or what it reads as one and a dot after that
_NEEDED = re.compile(r"[0-9@]|\bdot\b|[(\[]at[)\]]| at [a-z0-9-]+(?:\.| ?[(\[]\.[)\]] ?)[a-z0-9-]", re.IGNORECASE)
_WORD = re.compile(r"\S+")
AROUND = 6  # words on each side of a trigger that the field sees


def windows(text: str) -> Iterator[list[re.Match]]:
    """Words near anything a valid span must contain; words further off are no one's data by definition."""
    for line in re.finditer(r"[^\n]+", text):
        if not _NEEDED.search(text, line.start(), line.end()):
            continue
        words = list(_WORD.finditer(text, line.start(), line.end()))
        inside = np.zeros(len(words), dtype=bool)
        for i, word in enumerate(words):
            if _TRIGGER.search(word[0]):
                inside[max(i - AROUND, 0):i + AROUND + 1] = True
        edges = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]])))
        for low, high in zip(edges[::2], edges[1::2]):
            yield words[low:high]


_PLAIN_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}")
_PLAIN_PHONE = re.compile(r"\(?[0-9]+\)?(?:[ ./-][0-9]+)+")


def _valid(kind: str, text: str) -> bool:
    """Whether a labelled stretch, written plainly, is what it was taken for."""
    plain = re.sub(r" ?[\[(](?:dot|\.)[\])] ?| dot ", ".", re.sub(r" ?[\[(]at[\])] ?| at ", "@", text, flags=re.I), flags=re.I)
    if kind == "email":
        return _PLAIN_EMAIL.fullmatch(plain) is not None
    if kind == "ip":
        parts = plain.split(".")
        return len(parts) == 4 and all(p.isascii() and p.isdigit() and len(p) < 4 and int(p) <= 255 for p in parts)
    if kind == "card":
        return re.fullmatch(r"[0-9]+(?:[ ./_-][0-9]+)*", text) is not None and _is_card(text)
    if kind == "secret":
        return machine_made(text) == (0, len(text))
    return _PLAIN_PHONE.fullmatch(text) is not None and 9 <= len(_digits(text)) <= 15 and not re.fullmatch(
        r"[0-9]{4}[-./][0-9]{1,2}[-./][0-9]{1,2}.*", text)


def _labelled(words: list[re.Match], path: np.ndarray, text: str) -> Iterator[tuple[str, int, int]]:
    i = 0
    while i < len(words):
        label = LABELS[path[i]]
        j = i + 1
        if label != "O":
            while j < len(words) and LABELS[path[j]] == "I-" + label[2:]:
                j += 1
            begin, end = words[i].start(), words[j - 1].end()
            while end > begin and text[end - 1] in ".,;:!?\"'":
                end -= 1
            while begin < end and text[begin] in "\"'<:":
                begin += 1
            if label == "B-secret":  # without the name it is assigned to, and without quotes
                begin, end = machine_made(text, begin, end) or (begin, end)
            if _valid(label[2:], text[begin:end]):
                yield label[2:], begin, end
        i = j


def find_all(texts: list[str], field: Field) -> list[list[tuple[str, int, int, bool]]]:
    """Spans of each text, by kind and start, with whether a fixed pattern found them; added ones overlap none of these."""
    base = [base_spans(t) for t in texts]
    at, sequences, scores = [], [], []
    for i, text in enumerate(texts):
        for words in windows(text):
            at.append(i)
            sequences.append(words)
            scores.append(field.scores([w[0] for w in words]))
    added: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    if scores:
        for i, words, path in zip(at, sequences, field.decode(scores)):
            if path.any():
                added[i] += [s for s in _labelled(words, path, texts[i])
                             if all(s[2] <= b[1] or s[1] >= b[2] for b in base[i])]
    return [sorted([(*s, True) for s in b] + [(*s, False) for s in a], key=lambda s: (KINDS.index(s[0]), s[1]))
            for b, a in zip(base, added)]


SPANS = "array<struct<kind string, start int, `end` int, base boolean>>"
_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))


def find_personal_data(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """Add ``spans, redacted`` to every row; spans are (kind, start, end, base) of the whole text in code points, ends
    exclusive, by kind (email, ip, card, phone, secret) and start. ``redacted`` is the text with every span as ``[KIND]``.

    Fixed patterns give the spans marked ``base``; the field adds others that hold what their kind needs (an
    address in full, the card's check digit, 9 to 15 digits, letters and digits in one run of 16 or more) and touch no fixed one. A null text has no spans and
    stays null; rows stay as they are, repeated ones and null ids too; columns of the new names are replaced.
    """
    ship(docs)
    docs = docs.drop("spans", "redacted")
    text_at = docs.columns.index("text")
    shared = docs.sparkSession.sparkContext.broadcast(field or train())

    def redact(text: str, spans: list[tuple[str, int, int, bool]]) -> str:
        out, done = [], 0
        for kind, begin, end, _ in sorted(spans, key=lambda s: (s[1], -s[2])):
            if end <= done:
                continue
            if begin >= done:
                out += [text[done:begin], f"[{kind.upper()}]"]
            done = end  # a span that only sticks out of the one before is covered by that one's mark
        return "".join([*out, text[done:]])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for low in range(0, batch.num_rows, 500):
                part = batch.slice(low, 500)
                texts = part.column(text_at).to_pylist()
                found = find_all([t or "" for t in texts], model)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array([[dict(zip(("kind", "start", "end", "base"), s)) for s in f] for f in found], _SPANS),
                     pa.array([t if not f else redact(t, f) for t, f in zip(texts, found)], pa.string())],
                    names=[*part.schema.names, "spans", "redacted"])

    new = StructType.fromDDL(f"spans {SPANS}, redacted string")
    return docs.mapInArrow(work, StructType([*docs.schema, *new]))


def digest(found: DataFrame) -> DataFrame:
    """Counts of the fixed patterns' spans by kind, their digest, and all spans as text."""
    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def of_kind(kind):
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["base"])
    counts = [of_kind(k) for k in BASE_KINDS]
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"),
                        (F.size("spans") - F.size(base)).cast("bigint").alias("n_added"), F.size("spans").cast("bigint").alias("n_spans"))
