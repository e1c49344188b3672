"""Candidate segments of personal data in a text, with whole-span features for the model.

Candidates are proposed generously, from the text alone: every shape that could be an email address, a phone number, an
identity number, a street address or a personal name. What they are is left to the weights; a listed name part is a feature of
a candidate and no condition, but for names written wholly in lower case. Features come in groups (tuples), so that the score
of a group that recurs is looked up instead of summed up again. All positions are code points of the text itself.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

from auditlake.llm.semicrf import Segment

KINDS = ("email", "phone", "id_number", "address", "person_name")
#: The most words of a name; with them, and the patterns below, the length of every segment is bounded.
MAX_WORDS = 6

#: Full-width forms of ASCII, one for one, so that positions stay.
NARROW = {0xFF01 + i: 0x21 + i for i in range(94)} | {0x3000: 0x20, 0xA0: 0x20, 0x202F: 0x20, 0x2009: 0x20, 0x200B: 0x20, 0x2011: 0x2D, 0x2010: 0x2D, 0x2012: 0x2D, 0x2013: 0x2D, 0x2212: 0x2D}

LETTER = "A-Za-zÀ-ÖØ-öø-ɏͰ-ϿЀ-ԯḀ-ỿ̀-ͯ"
#: Letters, and what becomes of them when UTF-8 is read as a one-byte character set.
WIDE = LETTER + "¡-ª¬-º¼-¿\x80-\x9f„†‡‰‹•™›€"
WORD = re.compile(rf"(?<![0-9])[{LETTER}](?:[{WIDE}]|['’\-](?=[{LETTER}]))*")
KANJI = "一-鿿々ヶヵノ〆"
KANJI_RUN = re.compile(rf"[{KANJI}]+(?:[ ][{KANJI}]+){{0,3}}")

# Email ---------------------------------------------------------------------------------------------------------------

AT = r"(?: ?@ ?| ?\(at\) ?| ?\[at\] ?| at )"
DOT = r"(?:\.| ?\[dot\] ?| ?\(dot\) ?| dot )"
EMAIL = re.compile(rf"(?<![{LETTER}0-9])[{LETTER}0-9][{LETTER}0-9._+'’\-]*{AT}[{LETTER}0-9\-]+(?:{DOT}[{LETTER}0-9\-]*[{LETTER}0-9])+", re.IGNORECASE)

#: What stands for the sign, and what else than letters and digits may stand in the part before it.
SIGN, LOCAL = re.compile(AT, re.IGNORECASE), "._+'’-"

# Numbers -------------------------------------------------------------------------------------------------------------

_EDGE = rf"A-Za-z0-9À-ɏЀ-ӿ"
PHONE = re.compile(
    rf"(?<![{_EDGE}.@#/\-+])(?:\+ ?\d|\(\+?\d{{1,4}}\)|\d)(?:[ .\-/]?\d|[ .\-/]?\(\d{{1,4}}\)){{5,16}}(?: ?(?:ext\.?|x|#) ?\d{{1,5}})?(?![0-9a-zß-öø-ɏа-ӿ@]|[\-/.]\d)"
)
ID = re.compile(
    rf"(?<![{_EDGE}.@#/\-+])(?:(?-i:[A-Z]{{2}}\d\d(?: ?[A-Z0-9]{{4}}){{2,7}}(?: ?[A-Z0-9]{{1,3}})?)|(?:(?-i:[A-Z]{{1,3}})[ \-]?|[A-Z]{{1,3}}-?)\d(?:[ .\-]?\d){{4,12}}(?:[ \-]?[A-Z])?|\d(?:[ .\-]?\d){{6,16}}(?:(?-i:[ \-][A-Z])|-?[A-Z])?|[A-Z]{{2}} \d\d \d\d \d\d [A-Z]|[A-Z]{{3}} \d{{6}}|\d{{4}} ?[№N#]\.? ?\d{{6}}|(?=[A-Z]*\d[A-Z]*\d[A-Z]*\d)[A-Z][A-Z0-9]{{7,9}})(?![{_EDGE}@]|[\-/.][{_EDGE}])",
    re.IGNORECASE,
)

# Addresses -----------------------------------------------------------------------------------------------------------

#: Words that name a kind of street (fixed values), before or after the street's name.
BEFORE = (
    "rue", "avenue", "av.", "bd", "boulevard", "place", "impasse", "chemin", "allée", "quai", "cours", "route", "sentier", "passage", "square", "villa",
    "calle", "c/", "avda.", "avenida", "plaza", "pza.", "paseo", "camino", "carrera", "ronda", "travesía", "glorieta",
    "ul.", "al.", "pl.", "os.", "aleja", "ulica", "plac", "osiedle", "rondo",
    "улица", "ул.", "пр.", "просп.", "проспект", "пер.", "переулок", "ш.", "шоссе", "пл.", "площадь", "наб.", "набережная", "бул.", "бульвар", "проезд", "тупик",
    "via", "viale", "piazza", "corso",
)
AFTER_EN = (
    "street", "st.", "st", "road", "rd.", "rd", "avenue", "ave.", "ave", "lane", "ln.", "ln", "drive", "dr.", "dr", "boulevard", "blvd.", "blvd", "close", "walk", "way", "court", "ct",
    "place", "terrace", "square", "row", "crescent", "hill", "mews", "gardens", "grove", "parkway", "pkwy", "trail", "circle", "alley", "quay",
)
AFTER_RU = ("ул.", "улица", "пр.", "проспект", "пер.", "переулок", "ш.", "шоссе", "пл.", "площадь", "наб.", "бул.", "бульвар", "проезд")
SUFFIX_DE = ("straße", "strasse", "str.", "gasse", "weg", "platz", "allee", "ring", "damm", "ufer", "steig", "pfad", "chaussee", "markt")

_NAME = rf"[{LETTER}0-9](?:[{WIDE}0-9]|['’\-])*"
_UPPER = "(?-i:[A-ZÀ-ÖØ-ÞЀ-Я])"
_CAP = rf"{_UPPER}(?:[{WIDE}.]|['’\-])*"
_NUMBER = r"[1-9]\d{0,4}(?: ?-\d{1,5})?(?: ?[A-Za-z](?![A-Za-zÀ-ɏ]|\. ?\d))?"
_alt = lambda words: "|".join(re.escape(w) for w in sorted(words, key=len, reverse=True))
_TOWN = rf"{_UPPER}(?:[{WIDE}]|['’\-])*"
_CITY = rf"(?:, ?\d{{5}} {_TOWN}(?:[ \-](?:{_TOWN}|(?:del?|sur|la|le|les|bei|am)(?![{LETTER}]))){{0,4}})?"
STREETS = {
    # number, name, type: 12 Some Hill Road, Apt 4
    "number_first": re.compile(rf"(?<![\w\-/.]){_NUMBER} (?:{_CAP} ){{1,4}}(?:{_alt(AFTER_EN)})(?![{LETTER}])(?:,? (?:apt\.?|flat|unit|suite|no\.?) ?\w{{1,5}}| ?#\d{{1,5}})?{_CITY}", re.IGNORECASE),
    # number, type, name: 14 bis, rue des Exemples; where the name ends is left to the weights
    "number_type": re.compile(rf"(?<![\w\-/.])[1-9]\d{{0,4}}(?: ?(?:bis|ter|quater|[a-c])\b)?,? (?:{_alt(BEFORE)}) {_NAME}(?: {_NAME}){{0,5}}", re.IGNORECASE),
    # type, name, number: Calle del Olmo, n.º 3 / ul. Dluga 4 m. 5
    "type_first": re.compile(rf"(?<![{LETTER}])(?:{_alt(BEFORE)})(?:(?<=[./]) ?| )(?:{_NAME}[ ]){{0,4}}?{_NAME},? ?(?:n\.?[º°o] ?|nr |№ ?|д\. ?|дом )?{_NUMBER}(?:/\d{{1,4}}| m\. ?\d{{1,4}}|,? кв\. ?\d{{1,4}}|,? корп\. ?\d{{1,3}}|,? \d{{1,2}}[.]?[ºª°o][.]?[ ]?(?:dcha\.|izq\.|dcha|izq|[A-Z])(?![{LETTER}])|, bajo){{0,3}}{_CITY}", re.IGNORECASE),
    # name, type, number: Гончарная Слобода ул., д. 5
    "name_type": re.compile(rf"(?<![{LETTER}])(?:{_CAP} ){{1,3}}(?:{_alt(AFTER_RU)}),? ?(?:д\. ?|дом )?{_NUMBER}(?:/\d{{1,4}}|,? кв\. ?\d{{1,4}}|,? корп\. ?\d{{1,3}}){{0,2}}{_CITY}", re.IGNORECASE),
    # German: Obere Beispielgasse 7a / Am Alten Markt 3
    "compound": re.compile(rf"(?<![{LETTER}\-])(?:{_CAP} ){{0,2}}(?:[{LETTER}\-]*(?:{_alt(SUFFIX_DE)})) {_NUMBER}(?!\w|\.\d){_CITY}", re.IGNORECASE),
    "preposition": re.compile(rf"(?<![{LETTER}])(?:Am|An der|An den|Im|In der|In den|Zum|Zur|Auf der|Auf dem|Unter den|Hinter der|Hinter dem|Vor dem|Bei der) (?:{_CAP} ){{1,3}}{_NUMBER}(?!\w|\.\d){_CITY}"),
    # Japanese: city, ward, town, blocks
    "blocks": re.compile(rf"[{KANJI}ァ-ヺ]{{1,8}}?[市区町村郡][{KANJI}ァ-ヺ字]{{0,10}}?\d{{1,3}}(?:丁目|-)\d{{1,3}}(?:(?:番地?|-)(?:\d{{1,4}}号?)?)?(?:-\d{{1,4}})?"),
}
#: Without a token of these (or, of the compounds, a token that ends so) a form cannot match; they are quick to look for.
_bare = lambda words: frozenset(w.strip("./").split(" ")[0] for w in words)
HINTS = {
    "number_first": _bare(AFTER_EN), "number_type": _bare(BEFORE), "type_first": _bare(BEFORE), "name_type": _bare(AFTER_RU), "preposition": frozenset(("am", "an", "im", "in", "zum", "zur", "auf", "unter", "hinter", "vor", "bei")), "blocks": frozenset("市区町村郡"),
}
COMPOUND_ENDS = tuple(w.rstrip(".") for w in SUFFIX_DE)


# Names ---------------------------------------------------------------------------------------------------------------

#: Titles (fixed values); they stand before a name and are no part of it.
TITLES = {"mr", "mrs", "ms", "miss", "dr", "prof", "sir", "herr", "frau", "hr", "fr", "sr", "sra", "srta", "don", "doña", "dña", "d", "m", "mme", "mlle", "pan", "pani", "г-н", "г-жа", "господин", "госпожа", "inż", "mgr"}
PARTICLES = {"van", "von", "der", "den", "de", "di", "da", "la", "le", "del", "zu", "ter", "af", "bin", "al"}
#: Japanese titles (fixed values); they stand behind a name.
HONORIFICS = ("様", "さん", "氏", "先生")

MAIL_NEXT = re.compile(r" ?[(<][^()<>\n]{0,40}?(?:@| AT | at |\(at\)|\[at\])")
#: What may stand between the words of a name.
GAP = re.compile(r"\.? {0,3}|, ?")


class Lexicon:
    """Parts of names, case and outer blanks aside. ``rows``: (part, kind); null parts are skipped."""

    def __init__(self, rows: list[tuple[str | None, str | None]]) -> None:
        self.parts: dict[str, set[str]] = {}
        for part, kind in rows:
            if part and part.strip():
                self.parts.setdefault(part.strip().lower(), set()).add(kind or "")
        kanji = sorted((p for p in self.parts if re.match(rf"[{KANJI}ぁ-んァ-ヺ]", p)), key=len, reverse=True)
        self.kanji = re.compile("|".join(map(re.escape, kanji))) if kanji else None
        self.word = Words(self)

    def kinds(self, word: str) -> str:
        return "+".join(sorted(self.parts.get(word.lower(), ()))) or "-"


#: Words (and tokens) that are remembered before the memory is emptied.
REMEMBERED = 200_000


class Words(dict):
    """For a word: key, shape, kinds in the lexicon, whether it begins with a capital, and whether it is a title written out."""

    def __init__(self, lexicon: Lexicon) -> None:
        super().__init__()
        self.lexicon = lexicon

    def __missing__(self, word: str) -> tuple[str, str, str, bool, bool]:
        key, kinds_of = word.lower(), self.lexicon.kinds
        kinds = kinds_of(key)
        if kinds == "-" and "-" in key and (parts := [k for k in map(kinds_of, key.split("-")) if k != "-"]):
            kinds = "h" + parts[0]
        if len(self) > REMEMBERED:
            self.clear()
        short = kinds if kinds in ("-", "given", "family") else "h" if kinds[0] == "h" else "b"
        got = self[word] = (key, _shape(word), short, _capital(word, 0), len(key) > 1 and key in TITLES)
        return got


class Norms(dict):
    """For a token: in small letters, numbers as ``9``."""

    def __missing__(self, token: str) -> str:
        if len(self) > REMEMBERED:
            self.clear()
        got = self[token] = "9" if token.isdigit() else token.lower()
        return got


_norms = Norms()


LETTERS, DIGITS, START = re.compile(r"[A-Za-z]"), re.compile(r"\d+"), re.compile(r"\+\d|\(?00|\(\+?\d|0|[A-Za-z]+|\d")


def _signature(s: str) -> str:
    """Runs of digits by length, letters as A, separators as they are: ``(030) 23125 12`` is ``(3) 5 2``."""
    return DIGITS.sub(lambda m: str(len(m.group())), LETTERS.sub("A", s))


TOKEN = re.compile(rf"\n|\t|[{LETTER}]+(?:[\-'’][{LETTER}]+)*|\d+|[^\s]")
_LETTER, _KANJI, _KANA = re.compile(rf"[{LETTER}]"), re.compile(rf"[{KANJI}]"), re.compile("[ぁ-ん]")


def _side(c: str) -> str:
    return "9" if c.isdigit() else "a" if _LETTER.match(c) else "K" if _KANJI.match(c) else "h" if _KANA.match(c) else c


class Tokens:
    """The tokens of a text, cut once: in small letters, numbers as ``9``, line ends as the text's own end."""

    def __init__(self, text: str) -> None:
        found = list(TOKEN.finditer(text))
        self.text, self.starts = text, [m.start() for m in found]
        self.words = [_norms[m.group()] for m in found]
        self.words += ["\n", "\n"]

    def context(self, s: int, e: int, kind: str, hit: bool | None = None) -> tuple:
        """The group of the two tokens on either side (the nearer first), the characters next to the segment, and whether a number follows soon."""
        starts, words, text = self.starts, self.words, self.text
        i, j = bisect_left(starts, s), bisect_left(starts, e)
        l1 = words[i - 1] if i else "\n"
        l2 = words[i - 2] if i > 1 and l1 != "\n" else "\n"
        r1 = words[j]
        r2 = words[j + 1] if r1 != "\n" else "\n"
        return ("c", kind, l1, l2, r1, r2, text[s - 1 : s] or "^", text[e : e + 1] or "$", hit, "9" in words[j : j + 4])


def expand(group: tuple) -> list[tuple]:
    """The features of a group; a group of another form is a feature itself."""
    form, kind = group[0], group[1]
    if form == "c":
        _, _, l1, l2, r1, r2, before, after, hit, near = group
        out = [(kind, "l", l1), (kind, "ll", l2, l1), (kind, "r", r1), (kind, "rr", r1, r2), (kind, "e", _side(before), _side(after))]
        if kind == "person_name":
            out += [(kind, "lr", l1, r1), (kind, "hl", hit, l1), (kind, "hr", hit, r1), (kind, "near", hit, near)]
        return out
    if form == "n":
        _, _, shape, order, left, right, title, mail, opens, start = group
        hits = sum(x != "-" for x in order)
        return [(kind, "bias"), (kind, "form", shape), (kind, "lex", order), (kind, "both", shape, order), (kind, "hits", hits, len(order)), (kind, "more", left, right), (kind, "title", title), (kind, "mail", mail), (kind, "opens", opens, shape), (kind, "start", start, hits > 0, shape)]
    if form == "w":
        _, _, first, last, listed_first, listed_last, one = group
        out = [(kind, "first", first), (kind, "last", last)]
        if not listed_first and not one:
            out += [(kind, "f3", first[-3:]), (kind, "f2", first[-2:])]
        if not listed_last:
            out += [(kind, "s3", last[-3:], one), (kind, "s2", last[-2:], one)]
        return out
    if form == "d":
        _, _, sig, digits, start, row, alpha, quad, extended = group
        return [(kind, "bias"), (kind, "sig", sig), (kind, "n", digits), (kind, "start", start), (kind, "row", row), (kind, "alpha", alpha), (kind, "quad", quad), (kind, "ext", extended)]
    if form == "a":
        _, _, name, words, first, city, cut, last, word, end, follows, number = group
        return [(kind, "bias"), (kind, "form", name), (kind, "words", words, name), (kind, "first", first), (kind, "city", city), (kind, "cut", cut), (kind, "last", last), (kind, "form first", name, word), (kind, "end", name, end, follows), (kind, "ends", end), (kind, "follows", follows), (kind, "number", name, number)]
    if form == "k":
        _, _, first, last, share, length, gap, cut, a, z = group
        return [(kind, "bias"), (kind, "form", "kanji"), (kind, "kfirst", first), (kind, "klast", last), (kind, "kshare", share), (kind, "klen", length, share), (kind, "kgap", gap), (kind, "kcut", cut), (kind, "ka", a), (kind, "kz", z)]
    if form == "m":
        return [(kind, "bias"), (kind, "style", group[2]), (kind, "dots", group[3])]
    return [group]


#: Calendar dates, which may follow a number without a blank, are no part of candidates.
PLAIN = re.compile(r"(?:19|20)\d\d-[01]\d-[0-3]\d(?!\d)|[0-3]\d\.[01]\d\.(?:19|20)\d\d(?!\d)")
#: Four dotted numbers may be a host's address, if they are at most 255; that is a feature.
QUAD = re.compile(r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?![\d.])")
EXTENSION = re.compile(r" ?(?:ext\.?|x|#) ?\d{1,5}$", re.IGNORECASE)
#: Texts without this hold no candidate number.
SOME_NUMBER = re.compile(r"\d(?:\D{0,4}?\d){2}")


def _quad(body: str) -> str:
    m = QUAD.search(body)
    return "-" if m is None else "host" if all(int(x) < 256 for x in m.group().split(".")) else "other"


def _numbers(text: str, tokens: Tokens) -> Iterator[Segment]:
    if not SOME_NUMBER.search(text):
        return
    masked = PLAIN.sub(lambda m: "\x00" * len(m.group()), text)
    spans = {(m.start(), m.end()) for m in PHONE.finditer(masked)} | {(m.start(), m.end()) for m in ID.finditer(masked)}
    for s, e in spans:
        body = text[s:e]
        bare = EXTENSION.sub("", body)
        digits = sum(c.isdigit() for c in bare)
        if digits < (3 if len(body) >= 8 and body.isalnum() else 6):
            continue
        sig, quad, context = _signature(bare), _quad(body), tokens.context(s, e, "phone")
        row = "t" * (text[s - 1 : s] == "\t") + "t" * (text[e : e + 1] == "\t")
        start = START.match(body).group()
        for kind in ("phone", "id_number"):
            yield Segment(s, e, kind, [("d", kind, sig, digits, start, row, "A" in sig, quad, bare != body), ("c", kind, *context[2:])])


def _emails(text: str, folded: str, tokens: Tokens) -> Iterator[Segment]:
    if "@" not in folded and " at " not in folded and "(at)" not in folded and "[at]" not in folded:
        return
    upto = 0
    for sign in SIGN.finditer(text):
        start = sign.start()
        while start > upto and (text[start - 1].isalnum() or text[start - 1] in LOCAL):
            start -= 1
        while start < sign.start() and text[start] in LOCAL:
            start += 1
        m = EMAIL.match(text, start) if start >= upto else None
        if m is None:
            continue
        upto = m.end()
        body = m.group().lower()
        style = "@" if re.search(r"\S@\S", body) else " @" if "@" in body else "(" if "(at" in body else "[" if "[at" in body else "AT"
        if style == "AT" and not re.search(r" AT .* DOT | AT .*\.", m.group()) and " dot " not in body:
            style = "at"
        yield Segment(m.start(), m.end(), "email", [("m", "email", style, min(3, body.count(".") + body.count("dot"))), tokens.context(m.start(), m.end(), "email")])


def _anchored(pattern: re.Pattern, tokens: Tokens, hints: frozenset[str]) -> Iterator[re.Match]:
    """Matches that begin with one of the words, which may stand behind an elided article."""
    upto = 0
    for start, word in zip(tokens.starts, tokens.words, strict=False):
        at = start if word in hints else start + max(word.rfind("'"), word.rfind("’")) + 1 if ("'" in word or "’" in word) and re.split("['’]", word)[-1] in hints else -1
        if at >= upto and (m := pattern.match(tokens.text, at)):
            yield m
            upto = m.end()


HOUSE = re.compile(r"[1-9]")
_BLANK, _TOWN_CODE = re.compile(" "), re.compile(r", ?[0-9]{5} ")


def _addresses(text: str, tokens: Tokens) -> Iterator[Segment]:
    there, seen = set(tokens.words), set()
    if "9" not in there and not HOUSE.search(text):
        return
    for name, pattern in STREETS.items():
        if HINTS[name].isdisjoint(there) if name != "compound" else not any(w.endswith(COMPOUND_ENDS) for w in there):
            continue
        for m in pattern.finditer(text) if name != "type_first" else _anchored(pattern, tokens, HINTS[name]):
            starts, ends, body = [m.start()], [m.end()], m.group()
            if name in ("compound", "name_type"):  # the words before the street may belong to the sentence
                starts += [m.start() + x.end() for x in _BLANK.finditer(body) if len(body[: x.end()].split()) <= 2 and not body[x.end()].isdigit()]
            if name == "number_type":  # and so may those behind it
                blanks = [x.start() for x in _BLANK.finditer(body)]
                ends += [m.start() + x for x in blanks[2:]]
                town = re.compile(rf", ?\d{{5}} {_TOWN}(?:[ \-]{_TOWN}){{0,3}}").match
                ends += [t.end() for x in list(ends) if (t := town(text, x))]
            ends += [x - 1 for x in list(ends) if text[x - 1] == "."]  # the stop may be the sentence's
            for s in starts:
                for e in ends:
                    if (s, e) in seen or e - s < 5:
                        continue
                    seen.add((s, e))
                    part = text[s:e]
                    words = part.split()
                    first, end = words[0], words[-1]
                    word = first.lower() if len(first) < 9 and not first[0].isdigit() else "9" if first[0].isdigit() else "w"
                    shape = "9" if end[-1:].isdigit() or end[0].isdigit() else _shape(end) if end[0].isalpha() else "x"
                    after = TOKEN.match(text, e + 1) if text[e : e + 1] == " " else None
                    follows = text[e : e + 1] if after is None else "9" if after.group()[0].isdigit() else _shape(after.group()) if after.group()[0].isalpha() else after.group()
                    digits = re.search(r"\d+", part)
                    yield Segment(s, e, "address", [
                        ("a", "address", name, min(7, len(words)), "9" if first[0].isdigit() else "A" if first[:1].isupper() else "a", bool(_TOWN_CODE.search(part)), s - m.start() > 0, end[-4:].lower() if part.endswith(".") else "-", word, shape, follows, len(digits.group()) if digits else 0),
                        tokens.context(s, e, "address"),
                    ])


def _shape(word: str) -> str:
    if len(word) < 4 and word.lower() in PARTICLES:
        return "p"
    if len(word) == 1:
        return "I" if word.isupper() else "i"
    return "U" if word.isupper() else "W" if _capital(word, 0) else "w"


def _capital(text: str, at: int) -> bool:
    """Whether the letter is a capital. Cyrillic UTF-8 read as a one-byte set begins with Ð or Ñ, whatever its case."""
    after = text[at + 1 : at + 2]
    if text[at] in "ÐÑ" and ("\x80" <= after <= "\xbf" or after > "\u2000"):
        return text[at] == "Ð" and not "\xb0" <= after <= "\xbf"
    return text[at].isupper()


def _names(text: str, lexicon: Lexicon, tokens: Tokens) -> Iterator[Segment]:
    """Every run of two to six words with a capital, particles included, listed or not; one word, and words in small letters, only

    where something speaks for a person: a listed part, a title, or (small letters) a tab or an email address behind it.
    """
    words = [(m.start(), m.end()) for m in WORD.finditer(text)]
    n, known = len(words), lexicon.word
    info = [known[text[s:e]] for s, e in words]
    tabs, marks, i = "\t" in text, " (" in text or " <" in text, 0
    while i < n:
        one = info[i]
        if not one[3]:
            if one[1] == "w":
                e = words[i][1]
                if one[2] != "-" or (tabs and text[e : e + 1] == "\t") or (marks and text[e : e + 2] in (" (", " <") and MAIL_NEXT.match(text, e, e + 60)) or (i and info[i - 1][4]):
                    yield from _lower_names(text, words, info, i, tokens)
            i += 1
            continue
        j = i
        while j + 1 < n and (info[j + 1][3] or info[j + 1][1] == "p") and (text[words[j][1] : words[j + 1][0]] == " " or GAP.fullmatch(text, words[j][1], words[j + 1][0])):
            j += 1
        low = i - 1 if i and info[i - 1][1] == "p" and text[words[i - 1][1] : words[i][0]] == " " else i  # a particle may open a name
        for b in range(low, j + 1):
            # One word alone is a name behind a title, before a Japanese one, or if it is listed.
            one = info[b][2] != "-" or (b and info[b - 1][0] in TITLES) or text.startswith(HONORIFICS, words[b][1])
            for c in range(b if one else b + 1, min(j + 1, b + MAX_WORDS)):
                seg = _name(text, words, info, b, c, tokens)
                if seg:
                    yield seg
        i = j + 1


def _lower_names(text: str, words: list[tuple[int, int]], info: list[tuple[str, str, str, bool, bool]], at: int, tokens: Tokens) -> Iterator[Segment]:
    low = high = at
    while low > 0 and at - low < MAX_WORDS - 1 and info[low - 1][1] in "wip" and text[words[low - 1][1] : words[low][0]] in (" ", ", "):
        low -= 1
    while high + 1 < len(words) and high - at < MAX_WORDS - 1 and info[high + 1][1] in "wip" and text[words[high][1] : words[high + 1][0]] in (" ", ", "):
        high += 1
    for b in range(low, at + 1):
        for c in range(max(at, b + 1), min(high + 1, b + MAX_WORDS)):
            if all(info[i][2] == "-" for i in range(b, at)) or c == at or b == at:  # each span once: from its first listed word
                seg = _name(text, words, info, b, c, tokens)
                if seg:
                    yield seg


def _name(text: str, words: list[tuple[int, int]], info: list[tuple[str, str, str, bool, bool]], b: int, c: int, tokens: Tokens) -> Segment | None:
    last = info[c][1]
    if last in "Iip" or (info[b][1] == "i" and text[words[b][1] : words[b][1] + 1] != "."):
        return None  # no name ends with an initial or a particle, or begins with a word of one small letter
    form, order = info[b][1], info[b][2]
    comma = False
    for i in range(b + 1, c + 1):
        gap = text[words[i - 1][1] : words[i][0]]
        if gap != " ":
            if info[i - 1][1] in "Ii" and gap[:1] == ".":
                gap = gap[1:]
            elif not gap or gap[0] == ".":
                return None
            if gap[:1] == ",":
                if comma or len(gap) > 2:
                    return None
                comma = True
                form += ","
            elif gap.strip(" "):
                return None
        form += info[i][1]
        order += info[i][2][0]
    s, e = words[b][0], words[c][1]
    left = right = title = opens = start = False
    if b:
        key, _, _, capital, _ = info[b - 1]
        gap = text[words[b - 1][1] : s]
        title = key in TITLES and gap in (" ", ". ")
        left = capital and not title and gap in (" ", "  ")
        start = "." in gap or "!" in gap or "?" in gap or "\n" in gap
    else:
        start = True
    if c + 1 < len(words):
        right = info[c + 1][3] and text[e : words[c + 1][0]] in (" ", "  ")
    opens = info[b][0] in TITLES
    hit = order.strip("-") != ""
    mail = text[e : e + 1] in " (<" and bool(MAIL_NEXT.match(text, e, e + 60))
    order = order.replace("given", "g").replace("family", "f")
    return Segment(s, e, "person_name", [
        ("n", "person_name", form, order, left, right, title, mail, opens, start), ("w", "person_name", info[b][0], info[c][0], info[b][2] != "-", info[c][2] != "-", b == c), tokens.context(s, e, "person_name", hit),
    ])


#: The longest name in Japanese script, in characters; longer runs are searched through by their parts.
MAX_KANJI = 12


def _kanji_names(text: str, lexicon: Lexicon, tokens: Tokens) -> Iterator[Segment]:
    for m in KANJI_RUN.finditer(text):
        run, base = m.group(), m.start()
        if len(run) < 2:
            continue
        first: dict[int, str] = {}
        last: dict[int, str] = {}
        covered = [False] * len(run)
        if lexicon.kanji:
            at = 0
            while hit := lexicon.kanji.search(run, at):
                first[hit.start()] = last[hit.end()] = lexicon.kinds(hit.group())
                for i in range(hit.start(), hit.end()):
                    covered[i] = True
                at = hit.start() + 1
        begins = [i for i in range(len(run)) if i == 0 or i in first or run[i - 1] == " "]
        ends = [j for j in range(1, len(run) + 1) if j == len(run) or j in last or run[j] == " " or run.startswith(HONORIFICS, j)]
        for i in begins:
            for j in ends:
                body = run[i:j]
                size = len(body) - body.count(" ")
                if not 2 <= size <= MAX_KANJI or " " in (body[0], body[-1]):
                    continue
                share = sum(covered[i:j]) / size
                s, e = base + i, base + j
                group = ("k", "person_name", first.get(i, "-"), last.get(j, "-"), "all" if share == 1 else "part" if share else "none", size, " " in body, (i > 0, j < len(run)), body[0], body[-1])
                yield Segment(s, e, "person_name", [group, tokens.context(s, e, "person_name", share > 0)])


WIDE_CHARACTER = re.compile("[" + "".join(re.escape(chr(c)) for c in NARROW) + "]")
ANY_KANJI = re.compile(f"[{KANJI}]")


def narrow(text: str) -> str:
    return text.translate(NARROW) if not text.isascii() and WIDE_CHARACTER.search(text) else text


def segments(text: str, lexicon: Lexicon) -> list[Segment]:
    """All candidates of a text, in no particular order."""
    t = narrow(text)
    tokens = Tokens(t)
    found = [*_emails(t, t.lower(), tokens), *_numbers(t, tokens), *_addresses(t, tokens), *_names(t, lexicon, tokens)]
    return found + list(_kanji_names(t, lexicon, tokens)) if ANY_KANJI.search(t) else found
