"""Personal data in free text: offset-preserving deobfuscation, detection and typed placeholders."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyard.llm.pairs import LANGUAGE_WORDS

#: Largest list of name parts that is sent to the executors.
MAX_NAME_PARTS = 1_000_000
PLACEHOLDERS = {"name": "[NAME]", "email": "[EMAIL]", "phone": "[PHONE]", "id_number": "[ID_NUMBER]", "address": "[ADDRESS]"}

# Letters of other scripts that look like Latin ones, and Latin letters that do not decompose.
_LOOKALIKES = dict(zip("аеорсухіјѕԁһӏкмтвнАЕОРСУХІЈЅКМТВНΑΒΕΖΗΙΚΜΝΟΡΤΥΧοανιρκ", "aeopcyxijsdhlkmtbhAEOPCYXIJSKMTBHABEZHIKMNOPTYXoavipk", strict=True))
_PLAIN_LATIN = {"ø": "o", "Ø": "O", "ł": "l", "Ł": "L", "đ": "d", "Đ": "D", "ð": "d", "ħ": "h", "ı": "i", "ŧ": "t", "ŋ": "n"}
_DASHES = "‐‑‒–—−﹣－"
# Digits as words.
_DIGIT_WORDS = {"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9"}


def _fold(c: str) -> str:
    """The plain character that c stands for; empty for an invisible one."""
    if c < "\x7f":
        return c
    if c in _LOOKALIKES:
        return _LOOKALIKES[c]
    if c in _PLAIN_LATIN:
        return _PLAIN_LATIN[c]
    if c in _DASHES:
        return "-"
    kind = unicodedata.category(c)
    if kind in ("Cf", "Mn"):
        return ""
    if kind == "Nd":
        return str(unicodedata.decimal(c))
    if kind == "Zs":
        return " "
    base = unicodedata.normalize("NFKD", c)[:1]
    return base if base.isascii() and base.isalnum() or base in "@.+-_()" else c


_FOLDED: dict[str, str] = {}


class Normal:
    """A normalised text that knows for each character which stretch of the source it stands for."""

    def __init__(self, text: str):
        self.source = text
        if text.isascii():
            self.text, self.start, self.end = text, None, None
            return
        out, start = [], []
        for i, c in enumerate(text):
            f = _FOLDED.get(c)
            if f is None:
                f = _FOLDED[c] = _fold(c)
            for x in f:
                out.append(x)
                start.append(i)
        self.text, self.start, self.end = "".join(out), start, [i + 1 for i in start]

    def rewrite(self, pattern: re.Pattern, new) -> None:
        """Replace each match by new(match) if that is not None; every new character stands for the whole match."""
        made, begin, finish, at = [], [], [], 0
        first = self.start or range(len(self.text))
        last = self.end or range(1, len(self.text) + 1)
        for m in pattern.finditer(self.text):
            to = new(m)
            if to is None:
                continue
            made.append(self.text[at : m.start()] + to)
            begin += [*first[at : m.start()], *[first[m.start()]] * len(to)]
            finish += [*last[at : m.start()], *[last[m.end() - 1]] * len(to)]
            at = m.end()
        if made:
            self.text = "".join(made) + self.text[at:]
            self.start, self.end = begin + [*first[at:]], finish + [*last[at:]]

    def span(self, begin: int, finish: int) -> tuple[int, int]:
        """The source stretch of normalised characters begin to finish."""
        if self.start is None:
            return begin, finish
        return self.start[begin], self.end[finish - 1]


_AT = re.compile(r"(?<=[\w+])(?:[ \t]*[\[({<][ \t]*(?:at|@)[ \t]*[\])}>][ \t]*|[ \t]+@[ \t]+)(?=\w)", re.I)
_AT_WORD = re.compile(r"(?<=[\w+])[ \t]+at[ \t]+(?=[\w-]+(?:\.[\w-]+)*(?:[ \t]+dot[ \t]+\w+)+)", re.I)
_DOT = re.compile(r"(?<=\w)[ \t]*[\[({][ \t]*(?:dot|\.)[ \t]*[\])}][ \t]*(?=\w)", re.I)
_DOT_WORD = re.compile(r"(?<=\w)[ \t]+dot[ \t]+(?=\w)", re.I)
_SPELLED = re.compile(r"\b(?:(?:%s)\b[\s,-]*){7,}" % "|".join(_DIGIT_WORDS), re.I)
_SPELLED_WORD = re.compile("|".join(_DIGIT_WORDS), re.I)

_EMAIL = re.compile(r"(?<![\w.+@-])[A-Za-z0-9][A-Za-z0-9._%+-]*@(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,}(?![\w@])")

_EXT = r"(?:[ ,]*(?:\bext\b\.?|\bextension\b|\bx|#)[ ]?\d{1,6})?"
_PHONE = re.compile(
    r"(?<![\w.+/-])(?:"
    r"(?:\+|00[ ]?)\d{1,3}[ .-]?(?:\(\d{1,5}\)[ ]?)?(?:\d{1,5}[ ./-]?){1,5}\d{2,}"  # with country code
    r"|\(0?\d{2,5}\)[ ]?\d{3,5}(?:[ -]?\d{2,5}){0,2}"  # area code in brackets
    r"|0\d{1,4}/\d{4,9}(?:-\d{1,4})?"
    r"|0\d{2,4}[ -]\d{3,4}[ -]\d{3,4}"
    r"|[2-9]\d{2}-\d{3}-\d{4}|[2-9]\d{2}\.\d{3}\.\d{4}|[2-9]\d{2} \d{3} \d{4}"
    r"|1[ .-]?[2-9]\d{2}[ .-]?\d{3}[ .-]?\d{4}"
    r"|0\d{9,10}"
    r")" + _EXT + r"(?![\w/-]|\.\d)",
    re.I,
)
_ID = re.compile(
    r"(?<![\w.+/-])(?:"
    r"\d{3}-\d{2}-\d{4}|\d{3} \d{2} \d{4}"
    r"|\d{1,2}\.\d{3}\.\d{3}-[\dA-Za-z]"
    r"|\d{4}[ -]\d{4}[ -]\d{4}"
    r"|\d{6}-\d{4}"
    r"|\d{8}-?[A-Z]"
    r"|[A-Z]{2}[ ]?\d{2}[ ]?\d{2}[ ]?\d{2}[ ]?[A-Z]"
    r"|[A-Z]{2}\d{7}"
    r")(?![\w/-]|\.\d)"
)
_NUMBER = r"\d{1,5}[A-Za-z]?(?:-\d{1,5}[A-Za-z]?)?"
_CAP = r"[A-Z][a-z']+"
# Kinds of streets. Short forms in the first group are written with a point of their own.
_ADDRESSES = (
    re.compile(
        rf"(?<![\w.,/-]){_NUMBER}[ ](?:{_CAP}[ ]){{1,4}}?"
        r"(?:(?:St|Rd|Dr|Ct|Ave|Sq|Pl|Cres|Ter)\b\.?|(?:Street|Road|Lane|Ln|Avenue|Boulevard|Blvd|Close|Steps|Terrace|Drive|Court|Crescent|Row|Quay|Way|Place|Square|Parade|Grove|Gardens|Hill|Mews|Walk|Alley|Wharf)\b)"
    ),
    re.compile(
        rf"(?<![\w.,/-]){_NUMBER}(?:[ ](?:bis|ter|quater))?,?[ ](?:rue|avenue|quai|impasse|boulevard|place|allée|allee|chemin|cours|route|passage|square|voie)"
        rf"[ ](?:(?:de la|de l'|du|des|de|d'|aux?)[ ]?)?{_CAP}(?:[ -]{_CAP}){{0,3}}",
    ),
    re.compile(
        rf"(?<![\w/])(?:Calle|C/|Avda\.|Avenida|Av\.|Plaza|Paseo|Camino|Carretera|Ronda|Travesia)[ ]?(?:(?:de la|de los|de las|del|de)[ ])?{_CAP}(?:[ ]{_CAP}){{0,3}},?[ ](?:n\.?[ ]?[oº]\.?[ ]?|num\.?[ ]?|n[º°][ ]?)?{_NUMBER}(?![\w/])"
    ),
    re.compile(r"(?<![\w-])[A-Z][A-Za-z-]*(?:stra(?:ss|ß|s)e|str\.|gasse|weg|platz|allee|ufer|damm|ring|steig)[ ]\d{1,4}(?:[a-z]\b|[ ][a-h]\b(?![ ][a-z]{2})|[ ][a-h]\b(?=[ ]in\b))?(?!\w)"),
    re.compile(rf"(?<![\w-])(?:Jl\.|Jalan)[ ](?:{_CAP}[ ]){{1,4}}(?:No\.?[ ]?)?{_NUMBER}(?!\w)"),
)

_FUNCTION_WORDS = frozenset(w for x in LANGUAGE_WORDS.values() for w in x.split())
# Words that stand before names or begin sentences and are no names themselves.
_NO_NAMES = frozenset(
    "dr mr mrs ms miss sir prof professor mme mlle monsieur madame frau herr señora senora señor senor sra sr don doña dona ibu bapak pak bu tuan nyonya interviewee annotator reviewer author signed dear ask by to from reviewed thanks according contact key holder cc bcc regards cordialement saludos salam grüßen grussen sincerely attn mail email phone tel fax mobile address home name label critic adjudicator council analyst card section table port lake street road lane old upper north south port story evidence and or with the a an".split()
)
_CUE = re.compile(r"(?:\bby|\bto|\bfrom|\bdear|\bask|\bannotator\"?:?\s*\"?|\binterviewee|\bcc:|\bsigned,|\bregards,?|\bcordialement,|\bgrussen,|\bgruben,|\bsaludos,|\bpor|\bvon|\boleh|\bdr\.|\bmme|\bmr\.|\bmrs\.|\bms\.|\bprof\.|\bfrau|\bherr|\bsenora|\bsenor|\bsra\.|\bsr\.|\bibu|\bbapak|\bpak|[:：=,(>\"—-])\s*\Z", re.I)
_TOKEN = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
_GAP = re.compile(r"[ \t]+|[ \t]*\r?\n[ \t]*")
_INITIAL = re.compile(r"(?<![\w.'-])(?:[A-Za-z]\.[ -]?){1,3}\s?\Z")
_MIDDLE = re.compile(r"(?:\s+[A-Za-z]\.?){1,2}\s+\Z")


#: Words of which a task remembers whether they can be family names.
MEMO_WORDS = 200_000


class NameParts:
    """Given and family names as listed, and the endings that the listed ones share.

    An ending is the shortest one of three letters or more that at least two parts have and before which no letter
    stands in over three quarters of them: what is shared by words that otherwise differ.
    """

    def __init__(self, given: list[str], family: list[str]):
        plain = lambda x: "".join(_FOLDED.setdefault(c, _fold(c)) for c in x).lower()
        self.given, self.family = frozenset(map(plain, given)), frozenset(map(plain, family))
        self.given_ends, self.family_ends = self._ends(self.given), self._ends(self.family)
        self._told: dict[str, bool] = {}

    @staticmethod
    def _ends(parts: frozenset[str]) -> frozenset[str]:
        ends = set()
        for part in parts:
            for n in range(3, len(part) - 1):
                before = Counter(p[-n - 1] for p in parts if p.endswith(part[-n:]) and len(p) > n)
                if sum(before.values()) < 2:
                    break
                if max(before.values()) * 4 <= 3 * sum(before.values()):
                    ends.add(part[-n:])
                    break
        return frozenset(ends)

    @staticmethod
    def _ends_in(w: str, ends: frozenset[str]) -> bool:
        return any(w[-n:] in ends for n in range(3, min(9, len(w) - 1)))

    def is_family(self, w: str) -> bool:
        known = self._told.get(w)
        if known is None:
            if len(self._told) >= MEMO_WORDS:
                self._told.clear()
            low = w.lower()
            known = self._told[w] = low in self.family or (len(low) > 5 and self._ends_in(low, self.family_ends) and low not in _FUNCTION_WORDS)
        return known

    def is_given(self, w: str) -> bool:
        low = w.lower()
        return low in self.given or (len(low) > 4 and self._ends_in(low, self.given_ends))


def _could_be_given(w: str, parts: NameParts) -> bool:
    return w[0].isupper() and len(w) > 1 and w.lower() not in _NO_NAMES and w.lower() not in _FUNCTION_WORDS or w.lower() in parts.given


def _names(text: str, parts: NameParts) -> list[tuple[int, int]]:
    """Spans of names in normalised text: a family name with a given name or initials before it, or a given name after it."""
    found: list[tuple[int, int]] = []
    tokens = [(m.start(), m.end(), m.group()) for m in _TOKEN.finditer(text)]
    i = 0
    while i < len(tokens):
        begin, finish, word = tokens[i]
        if not parts.is_family(word):
            i += 1
            continue
        last = i
        while last + 1 < len(tokens) and text[tokens[last][1] : tokens[last + 1][0]] == "-" and tokens[last + 1][2][0].isalpha() and (parts.is_family(tokens[last + 1][2]) or tokens[last + 1][2][0].isupper()):
            last += 1
        finish = tokens[last][1]
        first = i
        while first > 0 and text[tokens[first - 1][1] : tokens[first][0]] == "-" and tokens[first - 1][2][0].isupper() and not parts.is_given(tokens[first - 1][2]):
            first -= 1
        begin = tokens[first][0]
        taken = found[-1][1] if found else 0
        whole = _before(text, tokens, first, begin, finish, parts)
        if whole is None or whole[0] < taken:
            whole = _after(text, tokens, last, begin, finish, parts)
        if whole and whole[0] >= taken:
            found.append(whole)
        i = last + 1
    return found


def _before(text: str, tokens: list, first: int, begin: int, finish: int, parts: NameParts) -> tuple[int, int] | None:
    """The span with a given name, a given name and middle initials, or initials before the family name."""
    if first == 0:
        return None
    lower = text[begin].islower()
    k = first - 1
    while k > 0 and len(tokens[k][2]) == 1 and first - k <= 2 and re.fullmatch(r"\.?\s+|\.", text[tokens[k][1] : tokens[k + 1][0]]):
        k -= 1
    given = tokens[k]
    between = text[given[1] : begin]
    if len(given[2]) > 1 and (_GAP.fullmatch(between) or (k < first - 1 and _MIDDLE.fullmatch(between))) and _could_be_given(given[2], parts) and not (k < first - 1 and parts.is_family(given[2])):
        start = given[0]
        if k > 0 and text[tokens[k - 1][1] : start] == "-" and tokens[k - 1][2][0].isupper():
            start = tokens[k - 1][0]
        return start, finish
    if lower and len(given[2]) > 1 and _GAP.fullmatch(between) and given[2].islower() and given[2] not in _FUNCTION_WORDS | _NO_NAMES and (parts.is_given(given[2]) or _CUE.search(text[max(0, given[0] - 14) : given[0]])):
        return given[0], finish
    initial = _INITIAL.search(text[max(0, begin - 12) : begin])
    if initial and (text[begin].isupper() or lower):
        start = max(0, begin - 12) + initial.start()
        if not (start and text[start - 1].isdigit()):
            return start, finish
    return None


def _after(text: str, tokens: list, last: int, begin: int, finish: int, parts: NameParts) -> tuple[int, int] | None:
    """The span with a given name or initials after the family name, behind a comma or not."""
    comma = re.match(r",[ \t]*\r?\n?[ \t]*", text[finish : finish + 6])
    gap = comma or _GAP.match(text[finish : finish + 6])
    if not gap:
        return None
    at = finish + gap.end()
    if last + 1 < len(tokens) and tokens[last + 1][0] == at and len(tokens[last + 1][2]) > 1:
        word, end = tokens[last + 1][2], tokens[last + 1][1]
        if parts.is_given(word) and (word[0].isupper() or word.lower() in parts.given):
            return begin, _with_initials(text, end)
        if comma and _could_be_given(word, parts):
            return begin, _with_initials(text, end)
    initials = re.match(r"(?:[A-Z]\.[ -]?){1,3}(?![a-z])", text[at:])
    if comma and initials:
        return begin, at + len(initials.group().rstrip(" -"))
    return None


def _with_initials(text: str, end: int) -> int:
    more = re.match(r"(?: [A-Z]\.){1,2}(?=\s*(?:[,;)\]<\n]|$))", text[end:])
    return end + more.end() if more else end


def find_personal_data(text: str | None, parts: NameParts) -> list[tuple[str, int, int]]:
    """(type, start, end) of all personal data in text, in source offsets, in order and without overlaps.

    Email addresses come first, then identity numbers, phone numbers, addresses and names; what one takes the
    next ones do not see. Null and empty texts hold none.
    """
    if not text:
        return []
    normal = Normal(text)
    low = normal.text.lower()
    if "at" in low or "@" in low:
        normal.rewrite(_AT, lambda m: "@")
        if "dot" in low:
            normal.rewrite(_AT_WORD, lambda m: "@")
            normal.rewrite(_DOT, lambda m: ".")
            normal.rewrite(_DOT_WORD, lambda m: "." if _in_domain(normal.text, m.start()) else None)
    if any(w in low for w in _DIGIT_WORDS):
        normal.rewrite(_SPELLED, lambda m: "".join(_DIGIT_WORDS[w.lower()] for w in _SPELLED_WORD.findall(m.group())) + (" " if m.group()[-1].isspace() else ""))
    found: list[tuple[str, int, int]] = []

    def take(kind: str, seen: str, spans: list[tuple[int, int]]) -> str:
        """seen with the spans hidden that do not touch what is taken already; one pass over the text."""
        if not spans:
            return seen
        parts_, at, gone, before = [], 0, bytearray(len(seen)), len(found)
        for begin, finish in spans:
            while finish > begin and seen[finish - 1].isspace():
                finish -= 1
            if begin < finish and "\x00" not in seen[begin:finish] and gone.find(1, begin, finish) < 0:
                found.append((kind, *normal.span(begin, finish)))
                gone[begin:finish] = b"\1" * (finish - begin)
        if len(found) == before:
            return seen
        for m in _TAKEN.finditer(bytes(gone)):
            parts_ += [seen[at : m.start()], "\x00" * (m.end() - m.start())]
            at = m.end()
        return "".join(parts_) + seen[at:]

    seen = take("email", normal.text, [m.span() for m in _EMAIL.finditer(normal.text)])
    seen = take("id_number", seen, [m.span() for m in _ID.finditer(seen)])
    seen = take("phone", seen, [m.span() for m in _PHONE.finditer(seen) if 7 <= sum(c.isdigit() for c in m.group()) <= 20])
    for pattern in _ADDRESSES:
        seen = take("address", seen, [(m.start(), _address_end(m)) for m in pattern.finditer(seen)])
    take("name", seen, _names(seen, parts))
    return sorted(found, key=lambda x: x[1])


_TAKEN = re.compile(rb"\x01+")
_DOMAIN = re.compile(r"\s*[\w-]+(?:[\s(\[{<]*(?:\.|\bdot\b)[\s)\]}>]*[\w-]+)*\s*", re.I)


def _in_domain(text: str, at: int) -> bool:
    """Whether nothing but the labels of a domain stands between the last @ and at."""
    begin = text.rfind("@", 0, at)
    return begin >= 0 and _DOMAIN.fullmatch(text, begin + 1, at) is not None


def _address_end(m: re.Match) -> int:
    """The match's end without words that begin the next sentence."""
    text = m.group()
    while (cut := re.search(r"[ ]([A-Z][a-z']+)\Z", text)) and cut.group(1).lower() in _SENTENCE_STARTS and text[: cut.start()].count(" ") >= 2:
        text = text[: cut.start()]
    return m.start() + len(text)


# Words that begin sentences, in addition to the frequent words of languages.
_SENTENCE_STARTS = _FUNCTION_WORDS | frozenset(
    "table tokens limits budget seed question prompt story retry rung checkpoint commit latency each because use see observed please nothing adjusting exactly mention their its who linden port each tras sin por ohne daher nach sans après apres les tanpa setelah peluangnya kelompok grafik oleh reviewed signed dear thanks send deliver address home interview national passport tax identity phone tel call fax mail write contact reach ask according without suppose counting researchers does would is effect".split()
)


def redact(text: str | None, parts: NameParts) -> str | None:
    """text with each piece of personal data replaced by a placeholder of its type, otherwise unchanged."""
    if text is None:
        return None
    out, at = [], 0
    for kind, begin, finish in find_personal_data(text, parts):
        out.append(text[at:begin] + PLACEHOLDERS[kind])
        at = finish
    return "".join(out) + text[at:]


def _sent_parts(documents: DataFrame, names: DataFrame):
    """The name parts, broadcast after a check of their number."""
    rows = names.select("part_kind", "part_text").dropna().distinct().limit(MAX_NAME_PARTS + 1).collect()
    if len(rows) > MAX_NAME_PARTS:
        raise ValueError(f"more than {MAX_NAME_PARTS} name parts")
    parts = NameParts(sorted(r["part_text"] for r in rows if r["part_kind"] == "given"), sorted(r["part_text"] for r in rows if r["part_kind"] == "family"))
    return documents.sparkSession.sparkContext.broadcast(parts)


def personal_data(documents: DataFrame, names: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, pii_type, pii_text): each distinct text once per document and type, exactly as written.

    Documents are independent and read whole; only the findings are shuffled, to drop repeats of one id.
    """
    sent = _sent_parts(documents, names)
    narrow = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")).filter("text is not null and doc_id is not null")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(d, k, t[b:e]) for d, t in zip(batch["doc_id"], batch["text"], strict=True) for k, b, e in find_personal_data(t, sent.value)]
            yield pd.DataFrame(rows, columns=["doc_id", "pii_type", "pii_text"])

    kind = narrow.schema["doc_id"].dataType.simpleString()
    return narrow.mapInPandas(run, f"doc_id {kind}, pii_type string, pii_text string").distinct().withColumnRenamed("doc_id", doc_id)


def redacted(documents: DataFrame, names: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text) of every row with placeholders for personal data; null stays null. No shuffle."""
    sent = _sent_parts(documents, names)
    narrow = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "text": [redact(t, sent.value) for t in batch["text"]]})

    kind = narrow.schema["doc_id"].dataType.simpleString()
    return narrow.mapInPandas(run, f"doc_id {kind}, text string").withColumnsRenamed({"doc_id": doc_id, "text": text})
