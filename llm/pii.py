"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds anchors: at-signs, plus signs, digits, URL schemes, street
words and identifier cues. From each anchor a local parser expands to the boundaries of a span and
validates it; text without anchors is never parsed. Positions are code points, ends exclusive.

Base kinds are leftmost and do not overlap within their kind: email, ip (four parts of at most
255), card (14 to 19 digits that pass the Luhn sum), phone (10 to 15 digits). A match that fails
its test is dropped, and the search goes on behind it. Added kinds: url (a scheme and a host with a
dot or localhost), address (house number, up to four names, a street word; or a German, French or
Spanish street with its house number), account (an identifier behind its cue, or a key with a known
prefix). Cues and schemes are found in any case. Account numbers may be printed in groups with
single blanks or hyphens between them; an IBAN's check sum must be right behind the cue IBAN. Behind
a colon or an equals sign a password is anything of four characters, and all that quotes enclose.

Cases: null and empty texts have no spans; a null doc_id and repeated rows are searched like any
others; other columns pass through ``redact`` unchanged, whatever their names. Rows are independent,
so nothing is shuffled, and a task holds one batch of texts.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from llm.common import lowered, slices

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "url", "address", "account")
RANK = {kind: i for i, kind in enumerate(KINDS)}

# The anchors of each parser.
SCHEMES = ("http://", "https://", "ftp://")
STREETS = (" Street", " St.", " Avenue", " Ave.", " Road", " Rd.", " Lane", " Boulevard", " Blvd.", " Drive", " Square")
ROADS = ("straße", "strasse", "str.", "weg", "platz", "allee", "gasse", "ufer", "damm", "ring")
RUES = (" rue ", " avenue ", " boulevard ", " bd ", " place ", " chemin ", " allée ", " impasse ", " quai ", " route ")
CALLES = ("calle ", "avenida ", "avda. ", "plaza ", "paseo ", "camino ", "carretera ", "c/ ")
ACCOUNTS = ("account", "acct", "konto", "compte", "cuenta", "passport", "passeport", "pasaporte", "reisepass", "ssn")
TOKENS = ("token", "api_key", "api-key", "api key", "apikey", "secret")
PASSWORDS = ("password", "passwort", "passwd", "kennwort", "contraseña", "mot de passe")
PREFIXES = ("AKIA", "ASIA", "ghp_", "sk_live_")

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
URL = re.compile(r"[^\s<>\"']+")
HOUSE = re.compile(r"(?<![0-9])[0-9]{1,5}[A-Za-z]? (?:[^\W\d_][\w'-]* ?){1,4}$")
TOWN = re.compile(r"(?:, [^\W\d_][\w'-]*)?(?:, [A-Z]{2} [0-9]{5})?")
NUMBER = r"(?:nummer|inhaber)?[\"']?[ ]?(?:(?i:number|nummer|numéro|número|no\.?|nr\.?|n°|nº)(?![^\W\d_]))?[ ]{0,2}[:=#]?[ ]{0,2}[\"']?"
IBAN = re.compile(NUMBER + r"((?i:[A-Z]{2})[0-9]{2}(?:[ -]?[A-Za-z0-9]){11,30})")
GROUPS = re.compile(NUMBER + r"([A-Za-z]{0,3}[0-9][A-Za-z0-9]*(?:[ -][A-Za-z]{0,2}[0-9][A-Za-z0-9]*)+)(?![A-Za-z0-9])")
VALUE = re.compile(NUMBER + r"([A-Za-z0-9_/+-]{8,})")
TOKEN = re.compile(r"(?:[_-][A-Za-z_-]+)?[\"']?[ ]?(?:number|no\.?|nr\.?)?[ ]{0,2}[:=#]?[ ]{0,2}[\"']?([A-Za-z0-9_/+.=~-]{8,})")
PASSWORD = re.compile(r"[\"']?[ ]{0,2}[:=][ ]{0,2}(?:\"([^\"\n]+)\"|'([^'\n]+)'|([^\s\"',;]{4,}))")
ROAD = re.compile(r"(?:(?:[^\W\d_][\w'.-]* ){1,3}|[^\W\d_][\w-]*)$")
HOUSE_BEHIND = re.compile(r" [0-9]{1,5}(?: ?[A-Za-z](?![\w]))?(?![0-9])(?:, [0-9]{5} [^\W\d_][\w'-]*)?")
HOUSE_BEFORE = re.compile(r"(?<![0-9])[0-9]{1,5}(?: ?(?:bis|ter|[A-Za-z]))?,?$")
NAMES = r"(?:(?:(?:de|du|des|del|la|las|le|les|los|el) |[dl]['’])*(?=[^\W\d_])(?![a-zß-öø-ÿ])[^\W\d_][\w'’-]*)(?: (?:(?:de|du|des|del|la|las|le|les|los|el) |[dl]['’])*(?![a-zß-öø-ÿ])[^\W\d_][\w'’-]*){0,3}"
RUE = re.compile(NAMES + r"(?:,? [0-9]{5} [^\W\d_][\w'-]*)?")
CALLE = re.compile(NAMES + r",? (?:n\.?[º°] ?|núm\. )?[0-9]{1,5}(?: ?[A-Za-z](?![\w]))?(?![0-9])(?:, [0-9]{5} [^\W\d_][\w'-]*)?")
KEY = re.compile(r"[A-Za-z0-9_]{12,}")
HOST = re.compile(r"[\w-]+(?:\.[\w-]+)+")
HOST_END = re.compile(r"[/:?#]")
#: From how many characters without a digit on no identifier can begin behind a cue.
BARREN = 64
#: How far left of a street word an address may begin.
REACH = 64


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2]))
    return (total + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def iban(text: str) -> int:
    """How many characters from the start hold an IBAN with the right check sum; 0 if none do."""
    for end in range(len(text), 0, -1):
        if text[end - 1].isalnum() and not text[end : end + 1].isalnum():
            plain = text[:end].replace(" ", "").replace("-", "").upper()
            if 15 <= len(plain) <= 34 and int("".join(str(int(x, 36)) for x in plain[4:] + plain[:4])) % 97 == 1:
                return end
    return 0


class Run:
    """The run of some characters that a place stands in, found once for all places inside it."""

    def __init__(self, characters: str) -> None:
        self.pattern, self.stop, self.digit = re.compile(f"[{characters}]*"), 0, -1

    def end(self, text: str, place: int) -> int:
        if place >= self.stop:
            self.stop = self.pattern.match(text, place).end()
            self.digit = max(text.rfind(d, place, self.stop) for d in "0123456789")
        return self.stop

    def barren(self, text: str, place: int) -> bool:
        """Whether the run goes on for long and has no digit any more."""
        return self.end(text, place) - place > BARREN and self.digit < place


class Cues:
    """Which cues of a text need no parser, because the run behind them holds no digit.

    Parsers read such a run to its end, so a text that repeats a cue would be read as often as it does.
    Behind an account or password cue the parsers cannot get beyond a long run, and what they find in it has no
    digit. Behind a token cue a name of letters may reach its end: what follows there is tried once.
    """

    def __init__(self) -> None:
        self.value, self.token, self.name = Run("A-Za-z0-9_/+-"), Run("A-Za-z0-9_/+.=~-"), Run("A-Za-z_-")
        self.tried = -1

    def parse(self, cue: str, text: str, at: int) -> tuple[int, int] | None:
        if cue not in TOKENS:
            barren = self.value.barren(text, at) and not (cue in PASSWORDS and PASSWORD.match(text, at))
            return None if barren else identifier(cue, text, at)
        if not self.token.barren(text, at):
            return identifier(cue, text, at)
        if text[at] not in "_-":
            return None
        end = self.name.end(text, at)
        if end == self.tried or self.token.stop - end > BARREN // 2:
            return None
        found = identifier(cue, text, at)
        if found is None:
            self.tried = end
        return found


def identifier(cue: str, text: str, at: int) -> tuple[int, int] | None:
    """Where the identifier behind a cue that ends before ``at`` begins and ends."""
    if text[at : at + 1] == "s" and not text[at + 1 : at + 2].isalnum():
        at += 1  # a plural
    if cue in PASSWORDS:
        if m := PASSWORD.match(text, at):
            return m.span(m.lastindex)
    if m := IBAN.match(text, at) if cue == "iban" or cue in ACCOUNTS else None:
        if size := iban(m[1] + text[m.end() : m.end() + 1]):
            return m.start(1), m.start(1) + size
        if cue == "iban":
            return None
    if cue in ACCOUNTS and (m := GROUPS.match(text, at)) and sum(x.isalnum() for x in m[1]) >= 8:
        run = VALUE.match(text, at)  # one run may go on behind the groups, as with an underscore
        return m.start(1), max(m.end(1), run.end(1) if run else 0)
    if m := (TOKEN if cue in TOKENS else VALUE).match(text, at):
        value = m[1].rstrip(".")
        if len(value) >= 8 and any(x.isdigit() for x in value):
            return m.start(1), m.start(1) + len(value)
    return None


def _automaton() -> ahocorasick.Automaton:
    machine = ahocorasick.Automaton()
    for anchor in "@+0123456789":
        machine.add_word(anchor, ("digit" if anchor.isdigit() else anchor, 1, anchor))
    for kind, words in (("url", SCHEMES), ("address", STREETS), ("road", ROADS), ("rue", RUES), ("calle", CALLES), ("cue", ("iban", *ACCOUNTS, *TOKENS, *PASSWORDS)), ("prefix", PREFIXES)):
        for word in words:
            machine.add_word(word.lower(), (kind, len(word), word))
    machine.make_automaton()
    return machine


class Finder:
    """All spans of a text, as (start, kind's rank, end), in order."""

    def __init__(self) -> None:
        self.machine = _automaton()

    def spans(self, text: str) -> list[tuple[int, int, int]]:
        found: list[tuple[int, int, int]] = []
        email = ip = card = url = address = account = 0  # where the last match of a kind ended
        before = -1  # where the last digit ended
        cues = Cues()
        stop = last = sign = host = -1  # of the run behind a scheme: its end, its end as a url, its last @, a host that is none
        for at, (kind, length, word) in self.machine.iter(lowered(text)):
            start = at - length + 1
            if kind == "digit":
                fresh = start != before  # the first digit of a run
                before = at + 1
                if not fresh:
                    continue
                if start >= ip and (m := IP.match(text, start)):
                    ip = m.end()
                    if all(len(x.lstrip("0")) <= 3 and int(x[-4:]) <= 255 for x in m.groups()):
                        found.append((start, 1, ip))
                if start >= card and (m := CARD.match(text, start)):
                    card = m.end()
                    digits = m[0].replace(" ", "").replace("-", "")
                    if 14 <= len(digits) <= 19 and luhn(digits):
                        found.append((start, 2, card))
            elif kind == "@":
                left = start
                while left > email and text[left - 1] in LOCAL:
                    left -= 1
                if left < start and (m := DOMAIN.match(text, start + 1)):
                    email = m.end()
                    found.append((left, 0, email))
            elif kind == "+":
                if (m := PHONE.match(text, start)) and 10 <= sum(x.isdigit() for x in m[0]) <= 15:
                    found.append((start, 3, m.end()))
            elif kind == "url":
                if start < url:
                    continue
                if at + 1 >= stop:
                    if not (m := URL.match(text, at + 1)):
                        continue
                    stop, last = m.end(), at + 1 + len(m[0].rstrip(".,;:!?)]}"))
                    sign = text.rfind("@", at + 1, last)
                first = max(at, sign) + 1
                if first < last and first != host:
                    ends = HOST_END.search(text, first, last)
                    name = text[first : ends.start() if ends else last]
                    if HOST.fullmatch(name) or name == "localhost":
                        url = last
                        found.append((start, 4, url))
                    else:
                        host = first
            elif kind == "address":
                low = max(address, start - REACH)
                if start >= address and text.startswith(word, start) and not text[at + 1 : at + 2].isalnum() and (m := HOUSE.search(text[low:start])):
                    address = TOWN.match(text, at + 1).end()
                    found.append((low + m.start(), 5, address))
            elif kind == "road":
                if start >= address and (m := HOUSE_BEHIND.match(text, at + 1)):
                    low = max(address, start - REACH)
                    # the name's last word or the street word itself begins with a capital letter
                    if (n := ROAD.search(text[low:start])) and n[0][-1:] != " ":
                        left = low + n.start()
                    elif text[start].isupper():
                        left = start
                        for word in reversed(n[0].split() if n else []):
                            if not word[0].isupper():
                                break
                            left -= len(word) + 1
                    else:
                        continue
                    if text[left].isupper():
                        address = m.end()
                        found.append((left, 5, address))
            elif kind == "rue":
                low = max(address, start - 12)
                if start >= address and (m := HOUSE_BEFORE.search(text, low, start)) and (n := RUE.match(text, at + 1)):
                    address = n.end()
                    found.append((m.start(), 5, address))
            elif kind == "calle":
                if start >= address and not text[start - 1 : start].isalnum() and (m := CALLE.match(text, at + 1)):
                    address = m.end()
                    found.append((start, 5, address))
            elif kind == "cue":
                if start >= account and (place := cues.parse(word, text, at + 1)):
                    account = place[1]
                    found.append((place[0], 6, account))
            elif start >= account and text.startswith(word, start) and not text[start - 1 : start].isalnum() and (m := KEY.match(text, at + 1)):
                account = m.end()
                found.append((start, 6, account))
        found.sort()
        return found


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def find(docs: DataFrame) -> DataFrame:
    """Counts of the base kinds, a digest of the base spans, and all spans of each document."""
    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
    kinds = pa.schema([("doc_id", pa.int64()), *((f"n_{x}", pa.int64()) for x in BASE_KINDS), ("base_sha256", pa.string()), ("spans", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder()
        for batch in slices(batches, 1000):
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                spans = finder.spans(text) if text else []
                base = [x for x in spans if x[1] < len(BASE_KINDS)]
                counts = [sum(x[1] == kind for x in base) for kind in range(len(BASE_KINDS))]
                rows.append((doc_id, *counts, hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans)))
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows), kinds.types)], schema=kinds)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def masked(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each span, or group of spans that overlap, replaced by its first kind's name."""
    parts, at = [], 0
    for start, kind, end in spans:
        if start >= at:
            parts += [text[at:start], f"[{KINDS[kind].upper()}]"]
        at = max(at, end)
    return "".join([*parts, text[at:]])


def redact(docs: DataFrame, column: str = "text") -> DataFrame:
    """The same rows and columns, with personal data in ``column`` masked; null stays null."""
    at = docs.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder()
        for batch in slices(batches, 1000):
            texts = [None if t is None else masked(t, s) if (s := finder.spans(t)) else t for t in batch.column(at).to_pylist()]
            columns = list(batch.columns)
            columns[at] = pa.array(texts, batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)
