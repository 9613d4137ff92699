"""Personal information inside free text: found, and replaced by typed placeholders.

One Aho-Corasick pass over the lower-case text finds the anchors: at-signs in all spellings,
cues of telephone, identity and account numbers, cues and street words of addresses, cues of
person names before or after them, titles, and given names of a lexicon (`GIVEN`, or the caller's
own, from a table). From each anchor a local parser reads on, forwards or backwards, to the end of the
line or as many words as the longest mention of its kind can have, and keeps only what is well-formed:
an email needs a domain that ends in letters, a number the digits and the grouping of its kind, a
card or bank account its check digits, an address a number and a town, a name a given name or
initial and a family name. Spans that overlap are settled by kind: email, address, identity number,
telephone, name. All other text stays as it is.

A name in small letters is found only behind or in front of a cue that hardly stands anywhere else;
one in capitals also behind verbs that take a person, in front of verbs of speech, behind a closing
line, and wherever its given name is in the lexicon.

Defined cases: null and empty texts have no mentions and stay as they are; a mention written
twice in a field is listed once and replaced twice; repeated rows are listed each; long texts
are read whole; extra columns of the input are carried by `redacted` and ignored by `found`.
"""

import re
from bisect import bisect
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenloom.functions.text import strip

KINDS = ("email", "street_address", "id_number", "phone", "person_name")
PLACEHOLDERS = {"email": "[EMAIL]", "street_address": "[ADDRESS]", "id_number": "[ID_NUMBER]", "phone": "[PHONE]", "person_name": "[NAME]"}

PHONE_CUES = ("phone", "tel", "fax", "mobile", "cell", "handy", "text", "sms", "whatsapp", "call me on", "call me at", "call", "reach me on", "reach me at", "rückruf unter", "telefon", "téléphone", "telephone", "teléfono", "telefono", "telefone", "telefoon", "on-call number", "phone number", "mobil", "ring")
ID_CUES = ("social security number", "social security", "security number", "national insurance number", "national insurance", "insurance number", "tax identity number", "tax number", "tax id", "identity number", "identity no", "identity card", "id card number", "id card", "id number", "id no", "national_id", "national id", "ssn", "dni", "nie", "nino", "ni number", "ni no", "nif", "bsn", "personalausweis", "passport number", "passport no", "passport", "steuer-id", "id")
ADDRESS_CUES = ("i live at", "lives at", "living at", "lieferung an", "pick it up from", "home address", "address", "adresse", "addr", "office moved to", "moved to", "laptop to", "ship it to", "deliver to", "delivery to", "send it to", "wohnhaft", "domicilio", "indirizzo", "adres", "located at", "based at")
STREET_WORDS = ("street", "st.", " st,", "lane", " ln", "road", " rd", " ave", "avenue", "court", "close", "terrace", "drive", "square", "crescent", "boulevard", "rue ", "chemin ", "impasse ", "calle ", "avenida ", "plaza ", "paseo ", "straße", "strasse", "gasse", "weg ", "allee", "platz", "graben", "laan", "straat", "pad ", "gracht", "plein", "box ", "postfach", "via ", "piazza ", "rua ")
#: Account numbers with check digits follow these.
ACCOUNT_CUES = ("iban", "bank account", "account", "konto", "compte", "cuenta", "card number", "credit card", "debit card", "card", "visa", "mastercard", "amex")
#: A name follows these, in any letter case.
NAME_CUES = ("cc", "assign it to", "assigned to", "i am", "reviewed by", "approved by", "written by", "signed-off-by:", "co-authored-by:", "on behalf of", "from:", "to:", "owner=", "owner:", '"author":', '"owner":', '"name":', "author:", "grüßen,", "regards,", "--", "please ask", "lo firmó", "firmado por", "signé par", "gezeichnet", "attn:", "attn", "dear", "yours sincerely,", "sincerely,", "cordialement,", "saludos,")
#: A name with capitals follows these, in the next line too behind a comma.
PERSON_VERBS = ("met", "meet", "ask", "asked", "tell", "told", "thank", "thanked", "contact", "email", "emailed", "reach", "message", "messaged", "hired", "interviewed", "invite", "invited", "spoke to", "spoke with", "talk to", "talked to", "talked with", "pass it on to", "passed on to", "forwarded to", "escalate to", "introduced by", "sent by", "prepared by", "led by", "my name is", "named", "known as", "colleague", "thanks,", "thank you,", "cheers,", "best,", "yours,", "best wishes,", "danke,", "merci,", "gracias,")
#: A name with capitals follows these, and a mark or the end of the line follows it.
GREETINGS = ("hi", "hello", "hey", "hallo", "bonjour", "hola", "salut", "ciao")
#: A name with capitals stands before these.
SPEAKS = (" said", " says", " asked", " replied", " told ", " reported", " confirmed", " suggested", " will join", " joined", " resigned", " was hired", " has left", " lives ", " works as", " is on leave", " signed", " called ", " emailed ", " approved", " (he/him", " (she/her", " (they/them")
#: A name stands before these.
AFTER_NAME = (" said the", " said that", " before merging", " and i cannot", " wrote:", " reported that", " asked for")
TITLES = ("mr", "mrs", "ms", "miss", "mx", "dr", "prof", "herr", "frau", "mme", "mlle", "señor", "señora", "sra", "dott", "dra", "drs")

#: Given names that are hardly ever other words; the family name behind one may be any with a capital.
GIVEN = frozenset("""
aaron adrian alan albert alejandro alessandro alexander alice amanda amy ana andrea andrew angela anita ann anna anne antonio arthur barbara beatriz benjamin bernard
birgit brian bruno carlos carol caroline catherine charles charlotte chiara christian christine christopher claire claudia craig daniel david deborah denis diana diego
dieter donald dorothy douglas edward eleanor elena elizabeth emily emma eric erik eva fatima fernando fiona florian francesca francesco francisco gabriel george gerald
giovanni giulia gregory hannah hans heather heidi helen helena henry isabel ivan jacob james jane janet jason javier jean jennifer jeremy jessica joan johannes john jonathan
jorge jose joseph joshua juan judith julia jürgen karen karl katharina katherine kathleen kenneth kevin klaus laura lauren leonardo linda lisa lorenzo louise lucas luis
lukas manuel marco margaret maria marie mario martin mary matthew michael michelle miguel mohammed monika nancy natalie nicholas nicole olga oliver olivia pablo pamela
patricia patrick paul paula pedro peter philip philippe pierre rachel raymond rebecca richard robert roberto ronald samuel sandra sarah sergio sharon simon sofia sophie
stefan stephanie stephen steven susan susanne sven teresa theresa thomas timothy ursula valentina veronica victoria vincent virginia walter william wolfgang yusuf
""".split())
MOST_GIVEN = 100_000
#: Words with a capital that don't end a name.
NO_FAMILY = frozenset("street st road rd avenue lane drive square court close boulevard monday tuesday wednesday thursday friday saturday sunday january february march april may june july august september october november december university institute station hotel theorem museum tower college airport hospital church school and or the is was will".split())

_AT = r"(?:[@＠]|\s?[(\[{]\s?at\s?[)\]}]\s?| at )"
_DOT = {"plain": r"[.．]", "round": r"\s?[(\[{]\s?dot\s?[)\]}]\s?", "word": r" dot "}
_LOCAL = r"[\p{L}\p{N}](?:[\p{L}\p{N}.!#$%&*+/=?^`|~_'-]*[\p{L}\p{N}_+-])?"
_LABEL = r"[\p{L}\p{N}](?:[\p{L}\p{N}-]*[\p{L}\p{N}])?"
_DOMAIN = rf"{_LABEL}(?:(?:{_DOT['plain']}|{_DOT['round']}|{_DOT['word']}){_LABEL})+"
EMAIL_RIGHT = regex.compile(rf"({_AT})({_DOMAIN})", regex.I)
EMAIL_LEFT = regex.compile(rf"(?<![\p{{L}}\p{{N}}.+_-])({_LOCAL})$", regex.I)
TOP_LEVEL = regex.compile(r"\p{L}{2,24}$")

PHONE = regex.compile(r"(?:\+|(?<!\d)00)?\(?\d+\)?(?:[ ]?\(\d+\)[ ]?\d+|[ .\-/]\(?\d+\)?|(?<=\))\d+)*")
_GAP = r'\.?["\'’]?\s*(?:\b(?:number|no|nr|is|are|es|ist|on file|lautet)\b\.?\s*|[:=#]\s*)*["\'’(]?'
AFTER_CUE = regex.compile(_GAP, regex.I)
ID = regex.compile(
    r"(?<![\w-])(?:[A-Za-z]{2}(?:[ -]?\d{2}){3}[ -]?[A-Za-z]\b|\d{2}\.?\d{3}\.?\d{3}[ -]?[A-Za-z]\b|[XYZxyz][ -]?\d{7}[ -]?[A-Za-z]\b|\d{3}([ .\-]?)\d{2}\1\d{4}(?![\d-])|[A-Z]{1,2}\d{6,8}\b)")
#: Identity numbers so distinct that they need no cue.
SURE_ID = regex.compile(r"(?<![\w.-])(?:QQ(?:[ -]?\d{2}){3}[ -]?[A-D]|\d{2}\.\d{3}\.\d{3}-[A-Z])(?![\w-])")

ACCOUNT = regex.compile(r"(?<![\w-])(?:[A-Za-z]{2}\d{2}(?:[ ]?[A-Za-z0-9]{4}){2,7}(?:[ ]?[A-Za-z0-9]{1,4})?|\d(?:[ -]?\d){12,18})(?![\w-])")

_CAP = r"\p{Lu}[\p{L}\p{M}'’]*(?:-[\p{L}\p{M}'’]+)*"
_TOWN = rf"{_CAP}(?: {_CAP}){{0,2}}"
_NO = r"\d{1,5}[A-Za-z]?"
_ENGLISH = r"(?:Street|St|Lane|Ln|Road|Rd|Avenue|Ave|Court|Ct|Close|Terrace|Ter|Drive|Way|Place|Pl|Square|Sq|Row|Rise|Hill|Walk|Crescent|Boulevard|Blvd|Parade|Mews|Gardens|Grove|Green|Quay|Wharf|Highway|Hwy|Circle|Cir)"
_UNIT = r"(?:, (?:Apt|Apartment|Flat|Unit|Suite|Ste|Room|No)\.? ?\w+)?"
_FLOOR = r"(?:, \d+\.?[ºªo°]?(?: ?[A-Z])?(?: izq| dcha)?\.?)?"
_CODE = r"(?:\d{4,5}(?: [A-Z]{2})?\b)"
_STEM = r"(?:straße|strasse|str\.|gasse|weg|allee|platz|ring|graben|ufer|damm|pfad|hof|laan|straat|pad|plein|gracht|kade|dijk|singel|steeg|dreef)"
ADDRESSES = [
    regex.compile(p) for p in (
        rf"{_NO} (?:{_CAP}\.? ){{1,4}}{_ENGLISH}\b\.?{_UNIT}, {_TOWN}(?:,? \d{{5}}\b)?",
        rf"{_NO}(?: bis| ter)?,? (?:[Rr]ue|[Aa]venue|[Bb]oulevard|[Pp]lace|[Cc]hemin|[Ii]mpasse|[Aa]llée|[Qq]uai|[Cc]ours|[Rr]oute)(?: (?:de|du|des|la|le|les|l['’]|d['’])*[\p{{L}}'’-]+){{1,6}}, (?:\d{{5}} )?{_TOWN}",
        rf"(?:[Cc]alle|[Aa]venida|[Pp]laza|[Pp]aseo|[Cc]amino|[Vv]ia|[Vv]iale|[Pp]iazza|[Cc]orso|[Rr]ua|[Tt]ravessa|[Pp]raça)(?: [\p{{L}}'’-]+){{1,6}},? {_NO}{_FLOOR}, (?:\d{{5}} )?{_TOWN}",
        rf"(?:(?:{_CAP}|an|der|dem|den|de|het) ){{0,3}}(?:\p{{Lu}}[\p{{L}}-]*{_STEM}|{_CAP}) {_NO}, {_CODE} {_TOWN}",
        rf"(?:P\.? ?O\.? ?Box|PO Box|Post Office Box|Box|Postfach|Postbus|Apartado|Apdo\.?) \d+, (?:{_CODE} )?{_TOWN}(?:,? \d{{5}}\b)?",
    )
]
#: After a cue a street may have any name.
LOOSE_ADDRESSES = [
    regex.compile(p) for p in (
        rf"{_NO},? (?:[\p{{L}}'’.-]+ ?){{1,6}}{_UNIT}{_FLOOR}, (?:{_CODE} )?{_TOWN}(?:,? {_CODE})?",
        rf"(?:[\p{{L}}'’.-]+ ){{1,6}}{_NO}{_UNIT}{_FLOOR}, (?:{_CODE} )?{_TOWN}(?:,? {_CODE})?",
    )
]

_PARTICLE = r"(?i:van der|van den|van de|van|von der|von|zu|de la|de los|de|del|della|di|da|dos|ibn|bin|bint|al|ter|ten|la|le|el)"


def _name(first: str, rest: str) -> str:
    """Given name or initial, or two, and family name; or family name, comma, given name."""
    word = rf"{first}{rest}*(?:['’]{rest}+)*(?:-{first}{rest}*(?:['’]{rest}+)*)*"
    given = rf"(?!{_PARTICLE}\b){word}(?<!['’]s)"
    family = rf"(?:{_PARTICLE} )?{word}"
    initial = rf"{first}\."
    return rf"(?:(?:{initial}(?: {initial})?|{given}(?: {initial})?) {family}|{family}, {given}(?: {initial}(?=\W|$))?)"


_CASED = _name(r"\p{Lu}", r"[\p{L}\p{M}]")
_LOWER = _name(r"\p{Ll}", r"[\p{Ll}\p{M}]")
NAME_CASED = regex.compile(rf"{_CASED}(?![\p{{L}}\p{{N}}])")
FURTHER = regex.compile(r" \p{Lu}[\p{L}\p{M}'’-]+(?![\p{L}\p{N}])")
NAME_LOWER = regex.compile(rf"{_LOWER}(?=\s*(?:[.,;|\n\"(<\t]|$)| and i | for now| before merging| said the)")
NAME_CASED_END = regex.compile(rf"(?<![\p{{L}}\p{{N}}.'’-]){_CASED}$")
NAME_LOWER_END = regex.compile(rf"(?<![\p{{L}}\p{{N}}.'’-]){_LOWER}$")
TITLE = regex.compile(rf"(?:(?:{'|'.join(TITLES)})\b\.?\s+)+", regex.I)
#: Words that begin sentences, not names.
NO_NAMES = frozenset("us me him her them all everyone anyone someone nobody team support sales mr the this that these those a an as it its is on in of at to and or but if so we our you your i he she they there here after before when while since why who what how can could please oddly closing done no not nothing try make rename explain steps works phone".split())


#: Words that the patterns of names, of what stands before a street word, and of addresses can have at most.
MOST_WORDS, MOST_STREET_WORDS, MOST_ADDRESS_WORDS = 8, 10, 24

Span = tuple[int, int, str]


@lru_cache(4)
def anchors(given: frozenset[str] = GIVEN) -> ahocorasick.Automaton:
    found: dict[str, set[str]] = {}
    for kind, cues in (("email", ("@", "＠", "(at)", "( at )", "[at]", "[ at ]", "{at}", " at ")), ("phone", PHONE_CUES), ("plus", ("+", "(")), ("id", ID_CUES), ("sure_id", ("qq", "-")), ("address", ADDRESS_CUES), ("street", STREET_WORDS), ("name", NAME_CUES), ("account", ACCOUNT_CUES), ("title", TITLES), ("verb", PERSON_VERBS), ("greeting", GREETINGS), ("speaks", SPEAKS), ("named", AFTER_NAME), ("given", given)):
        for cue in cues:
            found.setdefault(cue, set()).add(kind)
    automaton = ahocorasick.Automaton()
    for cue, kinds in found.items():
        automaton.add_word(cue, (len(cue), tuple(sorted(kinds))))
    automaton.make_automaton()
    return automaton


def lowered(text: str) -> str:
    """Lower case, letter for letter."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def _word_edge(text: str, at: int) -> bool:
    return at <= 0 or not (text[at - 1].isalnum() or text[at - 1] == "_")


def _back(text: str, at: int, words: int) -> int:
    """Where the last `words` words before `at` begin, in its line."""
    while words and at and text[at - 1] != "\n":
        at -= 1
        while at and text[at - 1] != "\n" and (text[at].isspace() or not text[at - 1].isspace()):
            at -= 1
        words -= 1
    return at


def _ahead(text: str, at: int, words: int) -> int:
    """Where the next `words` words after `at` end, in its line."""
    stop = len(text)
    while words and at < stop and text[at] != "\n":
        at += 1
        while at < stop and text[at] != "\n" and (text[at - 1].isspace() or not text[at].isspace()):
            at += 1
        words -= 1
    return at


def _checked(number: str) -> bool:
    """Whether an account number's check digits are right: of a bank account (97), or of a card (Luhn)."""
    code = regex.sub("[ -]", "", number).upper()
    if code[0].isalpha():
        return 15 <= len(code) <= 34 and int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1
    digits = [int(d) for d in code]
    return sum(sum(divmod(2 * d, 10)) if i % 2 else d for i, d in enumerate(reversed(digits))) % 10 == 0


def _account(text: str, at: int) -> Span | None:
    """The account number at `at`: the longest whose check digits are right, cut between its groups."""
    m = ACCOUNT.match(text, at)
    while m:
        if _checked(m.group()):
            return at, m.end(), "id_number"
        cut = max(m.group().rfind(" "), m.group().rfind("-"))
        m = ACCOUNT.fullmatch(text, at, at + cut) if cut > 0 else None
    return None


def _email(text: str, at: int) -> Span | None:
    m = EMAIL_RIGHT.match(text, at)
    if not m:
        return None
    sign, domain = m.group(1), m.group(2)
    # A sign in words goes with dots in words; the domain ends where the spelling changes.
    style = "word" if sign == " at " else "round" if sign.strip()[0] in "([{" else "plain"
    dots = [d for d in regex.finditer(f"{_DOT['plain']}|{_DOT['round']}|{_DOT['word']}", domain, regex.I)]
    kept = _DOT[style] if style != "round" else f"{_DOT['round']}|{_DOT['plain']}"
    stop = len(domain)
    for d in dots:
        if not regex.fullmatch(kept, d.group(), regex.I):
            stop = d.start()
            break
    domain = domain[:stop]
    labels = regex.split(kept, domain, flags=regex.I)
    if len(labels) < 2 or not TOP_LEVEL.fullmatch(labels[-1]):
        return None
    left = EMAIL_LEFT.search(text, _back(text, at, 1), at)
    return (left.start(), m.start(2) + len(domain), "email") if left else None


def _phone(text: str, at: int, cued: bool) -> Span | None:
    m = PHONE.match(text, at)
    if not m:
        return None
    value = m.group()
    while value and value[-1] in " .-/(":
        value = value[:-1]
    digits = re.sub(r"\D", "", value)
    end = at + len(value)
    if not 7 <= len(digits) <= 15 or end < len(text) and (text[end].isalnum() or text[end] == "_"):
        return None
    if not cued and not (value[0] == "+" and len(digits) >= 9 or re.match(r"\([2-9]\d\d\)[ -]?\d{3}[ -.]\d{4}$", value)):
        return None
    if value.count("(") != value.count(")"):
        return None
    return at, end, "phone"


def _name_at(text: str, at: int, lower: bool = True) -> Span | None:
    title = TITLE.match(text, at)
    begin = title.end() if title else at
    for pattern in (NAME_CASED, NAME_LOWER) if lower else (NAME_CASED,):
        m = pattern.match(text, begin)
        if m and m.group().split()[0].lower().rstrip(",") not in NO_NAMES:
            return begin, m.end(), "person_name"
    return None


def _name_before(text: str, end: int, lower: bool) -> Span | None:
    """The name that ends at `end`, searched backwards over as many words as a name has."""
    window = _back(text, end, MOST_WORDS)
    for pattern in (NAME_CASED_END, NAME_LOWER_END) if lower else (NAME_CASED_END,):
        best = None
        for m in pattern.finditer(text, window, end, overlapped=True):
            words = m.group().split()
            if words[0].lower().rstrip(",") in NO_NAMES:
                continue
            # The shortest that is whole, but with its particle or middle initial.
            if "," not in m.group():
                if best is None or len(words) > 2 and _parts(words) <= 2:
                    best = m if best is None or "," in best.group() or m.start() < best.start() else best
            elif best is None:
                best = m
        if best:
            begin = best.start()
            title = TITLE.match(text, begin)
            return (title.end() if title else begin), end, "person_name"
    return None


def _parts(words: list[str]) -> int:
    particles = {p for p in _PARTICLE[4:-1].replace("|", " ").split()}
    return sum(1 for w in words if w.lower() not in particles and not regex.fullmatch(r"\p{L}\.", w))


def _addresses(text: str, at: int) -> Span | None:
    """The address whose street word stands at `at`."""
    begin, stop = _back(text, at, MOST_STREET_WORDS), _ahead(text, at, MOST_ADDRESS_WORDS)
    for pattern in ADDRESSES:
        for m in pattern.finditer(text, begin, stop):
            if m.start() > at:
                break
            # A cue in front may look like a part of the street's name.
            cue = max((m.group().lower().rfind(f"{c} ", 0, max(0, at - m.start())) + len(c) + 1 for c in ADDRESS_CUES if f"{c} " in m.group().lower()), default=0)
            if cue:
                m = pattern.match(text, m.start() + cue, m.end()) or m
            if m.start() <= at < m.end() and (m.start() == 0 or not (text[m.start() - 1].isalnum() or text[m.start() - 1] in "/_.-")):
                return m.start(), m.end(), "street_address"
    return None


def _given(text: str, begin: int, end: int, given: frozenset[str]) -> Span | None:
    """The name that begins with the given name begin..end."""
    if not text[begin].isupper() or begin and text[begin - 1] in "-’'./_@\\":
        return None
    m = NAME_CASED.match(text, begin)
    if not m or "," in m.group():
        return None
    words = m.group().split()
    if words[-1].lower() in NO_FAMILY or len(words[-1]) < 2 and not words[-1].isalpha():
        return None
    stop = m.end()
    if words[-1].lower() in given and (further := FURTHER.match(text, stop)) and further.group().strip().lower() not in NO_FAMILY:
        stop = further.end()
    return begin, stop, "person_name"


def spans(text: str | None, given: frozenset[str] = GIVEN) -> list[Span]:
    """(start, end, kind) of all mentions, in order, none overlapping."""
    if not text:
        return []
    low = lowered(text)
    out: list[Span] = []
    add = lambda span: out.append(span) if span else None
    for last, (size, kinds) in anchors(given).iter(low):
        begin, end = last + 1 - size, last + 1
        for kind in kinds:
            if kind == "email":
                add(_email(text, begin - 1 if low[begin - 1 : begin] == " " and low[begin] in "([{" else begin))
            elif kind == "plus":
                if _word_edge(text, begin):
                    add(_phone(text, begin, False))
            elif kind == "sure_id":
                at = begin if low[begin] == "q" else max(0, begin - 10)
                if m := SURE_ID.search(text, at, end + 12):
                    out.append((m.start(), m.end(), "id_number"))
            elif kind == "street":
                add(_addresses(text, begin + size // 2))
            elif kind == "named":
                found = _name_before(text, begin, True)
                add(found)
            elif kind == "speaks":
                if low[last] == " " or end == len(low) or not low[end].isalnum():
                    add(_name_before(text, begin, False))
            elif not _word_edge(text, begin) or (low[last].isalnum() and end < len(low) and (low[end].isalnum() or low[end] == "_")):
                continue
            elif kind in ("phone", "id"):
                at = AFTER_CUE.match(text, end).end()
                if kind == "phone":
                    add(_phone(text, at, True) if at > end or text[at : at + 1] in "+(" else None)
                elif (m := ID.match(text, at)) and (size > 3 or at > end):
                    out.append((m.start(), m.end(), "id_number"))
            elif kind == "account":
                add(_account(text, AFTER_CUE.match(text, end).end()))
            elif kind == "given":
                add(_given(text, begin, end, given))
            elif kind == "greeting":
                span = _name_at(text, end + 1, lower=False) if text[end : end + 1] == " " else None
                add(span if span and text[span[1] : span[1] + 1] in ("", ",", "!", ":", "\n", "-") else None)
            elif kind == "verb":
                at = end
                while at < len(text) and (text[at] == " " or text[at] == "\n" and low[last] == ","):
                    at += 1
                add(_name_at(text, at, lower=False) if at > end else None)
            elif kind == "address":
                at = AFTER_CUE.match(text, end).end()
                for pattern in (*ADDRESSES, *LOOSE_ADDRESSES):
                    if m := pattern.match(text, at, _ahead(text, at, MOST_ADDRESS_WORDS)):
                        if any(c.isdigit() for c in m.group()):
                            out.append((m.start(), m.end(), "street_address"))
                            break
            elif kind == "name":
                at = end
                while at < len(text) and text[at] in ' "\'':
                    at += 1
                add(_name_at(text, at) if at > end or low[last] in "=" else None)
            elif kind == "title":
                at = end + (text[end : end + 1] == ".")
                if text[at : at + 1] == " ":
                    add(_name_at(text, at + 1, lower=False))
    out += _names_of_addresses(text, out)
    return _settled(text, out)


def _names_of_addresses(text: str, found: list[Span]) -> list[Span]:
    """Names written before an email, as in `Name <email>`, `Name, email` or with a tab."""
    out = []
    places = sorted((b, e) for b, e, k in found if k in ("street_address", "email"))
    ends = list(accumulate((e for _, e in places), max))
    for begin, _, kind in found:
        if kind != "email":
            continue
        m = regex.search(r"[\p{L}.'’](, | ?<| ?\(|[ ]?\t)$", text[max(0, begin - 4) : begin])
        if not m:
            continue
        end = begin - len(m.group(1))
        mark = m.group(1).strip(" ")
        span = _name_before(text, end, True)
        if not span:
            continue
        small = text[span[0] : span[1]].islower()
        before = text[: span[0]].rstrip(" ")
        free = not before or before[-1] in ".!?;|\n" or mark == "\t"
        before_it = bisect(places, (span[1], -1))
        inside_other = before_it > 0 and ends[before_it - 1] > span[0]
        # One capital word right in front: a title in title case, not a name.
        title = regex.search(r"(?:\p{Lu}[\p{L}'’-]* )+$", text[_back(text, span[0], 3) : span[0]])
        if title and len(title.group().split()) == 1 and title.group().isupper() == text[span[0] : span[1]].isupper():
            continue
        if not inside_other and (free or not small):
            out.append(span)
    return out


def _settled(text: str, found: list[Span]) -> list[Span]:
    rank = {k: i for i, k in enumerate(KINDS)}
    out: list[Span] = []  # in order, none overlapping
    for span in sorted(set(found), key=lambda s: (rank[s[2]], s[0] - s[1], s[0])):
        at = bisect(out, span)
        if (not at or out[at - 1][1] <= span[0]) and (at == len(out) or span[1] <= out[at][0]):
            out.insert(at, span)
    return out


def redact(text: str | None, given: frozenset[str] = GIVEN) -> str | None:
    """`text` with each mention replaced by its placeholder."""
    if not text:
        return text
    parts, at = [], 0
    for begin, end, kind in spans(text, given):
        parts += [text[at:begin], PLACEHOLDERS[kind]]
        at = end
    return "".join([*parts, text[at:]])


def lexicon(names: DataFrame, column: str = "given_name") -> frozenset[str]:
    """Given names from a table, as `given` of `found` and `redacted`; they go to every task, so their number is checked."""
    rows = names.where(F.col(column).isNotNull()).select(F.lower(strip(F.col(column)))).distinct().limit(MOST_GIVEN + 1).collect()
    if len(rows) > MOST_GIVEN:
        raise ValueError(f"a lexicon has at most {MOST_GIVEN} names")
    return frozenset(r[0] for r in rows if r[0])


def found(events: DataFrame, fields: tuple[str, ...] = ("title", "detail"), given: frozenset[str] = GIVEN) -> DataFrame:
    """event_id, field_name, pii_type, mention: each distinct mention of each row."""
    kind = events.schema["event_id"].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[int] = []
            out: list[list[str]] = [[], [], []]
            for i, field in enumerate(fields, 1):
                # Many rows repeat a text.
                texts = batch.column(i).dictionary_encode()
                of_text = [list(dict.fromkeys((k, t[b:e]) for b, e, k in spans(t, given))) for t in texts.dictionary.to_pylist()]
                for row, code in enumerate(texts.indices.to_pylist()):
                    for k, mention in of_text[code] if code is not None else ():
                        rows.append(row)
                        for column, value in zip(out, (field, k, mention)):
                            column.append(value)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), *(pa.array(c, pa.string()) for c in out)], ["event_id", "field_name", "pii_type", "mention"])

    return events.select("event_id", *fields).mapInArrow(read, f"event_id {kind}, field_name string, pii_type string, mention string")


def redacted(events: DataFrame, fields: tuple[str, ...] = ("title", "detail"), given: frozenset[str] = GIVEN) -> DataFrame:
    """`events` with the mentions in `fields` replaced."""
    columns = events.columns

    def replace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            arrays = []
            for name, column in zip(columns, batch.columns):
                if name in fields:
                    texts = column.dictionary_encode()
                    column = pa.array([redact(t, given) for t in texts.dictionary.to_pylist()], pa.string()).take(texts.indices)
                arrays.append(column)
            yield pa.RecordBatch.from_arrays(arrays, columns)

    return events.mapInArrow(replace, events.schema)
