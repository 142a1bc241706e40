"""Personal information in free text by weak supervision.

Candidates for each kind come from generous patterns, from the names in a table of persons and, for
names outside it, from the words around them and from capitals. Labelers vote yes, no or
nothing on each candidate: form, gazetteer, general words before and behind, words for things that are
numbered or named too, and two labelers that are learned: the contexts left and right in which
candidates of unmistakable form (seeds: full names of known parts, known names behind a title or relation, written-out social
security numbers and the like) occur in the texts at hand. Expectation-maximisation over the counts of vote patterns estimates
how reliable each labeler is and how likely each pattern is a true item; a logistic span
classifier is fitted to those posteriors and decides every candidate. Among overlapping items
that pass, the kind that explains the longer stretch wins.

No word list holds phrases of particular texts; what is said around items there is learned. Every text is read
whole and every candidate is scored. The gazetteer holds every name of the table of persons that occurs in the texts,
however rare: the words of the texts are joined with the names, and the outcome travels with the tasks if it is
small, else as a column of each text's own known words (``with_known``), with the same result. What reaches the driver is bounded: counts of vote patterns, at
most ``MAX_PATTERNS`` per kind, a bound on fitting alone, and sums per context bucket (2 ** CONTEXT_BITS per kind
and side, contexts being hashed).

NULL, blank and very short texts hold nothing. Texts keep everything outside the items; each item
becomes a placeholder such as [PHONE].
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator, Mapping
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

KINDS = ("email", "phone", "id_number", "address", "name")
PRIORITY = {"email": 0, "address": 1, "phone": 2, "id_number": 3, "name": 4}
PLACEHOLDER = {"email": "[EMAIL]", "phone": "[PHONE]", "id_number": "[ID]", "address": "[ADDRESS]", "name": "[NAME]"}
MAX_PATTERNS = 20_000
#: A name is well known from so many of the name cells on, by share; rarer ones are known, but say less.
NAME_SHARE = 20_000
#: Known words up to this number travel with the tasks.
MAX_TRAVELLING = 200_000
CONTEXT_BITS = 15

_I = re.IGNORECASE
_W = r"[^\W\d_]"

# ---------------------------------------------------------------- general words
# Lists of English words by meaning.

_REL = (
    r"(?:wife|husband|spouse|partner|son|daughter|sister|brother|mother|father|mom|mum|dad|niece|nephew|grandson|granddaughter|grandmother|grandfather|grandma|grandpa"
    r"|aunt|uncle|cousin|caregiver|friend|neighbou?r|guardian|roommate|fianc[eé]e?|parent|sibling|stepson|stepdaughter)"
)
_TITLE = r"(?:dr|mr|mrs|ms|miss|prof|rev|sgt|capt|hon)"
_ROLE = (
    r"(?:nurse|doctor|physician|surgeon|resident|attending|clerk|case manager|manager|social worker|worker|therapist|aide|technician|tech|paramedic|emt|driver|coordinator|supervisor"
    r"|pharmacist|chaplain|interpreter|witness|escort|attorney|poa|nok|next of kin|emergency contact|contact|patient|pt|client|rn|lpn|cna|np|pa|md|pcp|attn|attention)"
)
_AGENT = r"(?:by|per|named|name|ask|ask for|asked|asked for|spoke to|spoke with|speak to|speak with|c/o|care of|called|told|notified|informed|tell|notify|dear|cc)"
_VERB = (
    r"(?:will|can|cannot|may|must|has|is|was|had|says?|said|states?|stated|reports?|reported|calls?|called|wants?|agrees?|agreed|signed|signs|refused|refuses|requests?|requested|aware|confirmed|confirms"
    r"|answered|answers|gave|gives|asked|asks|lives|needs|knows|knew|told|picked|accompanies|accompanied|rides|drives|opened|met|meets|arrived|consented|declined|wrote|writes|left|came|comes|rode|drove)"
)
_CREDENTIAL = r"(?:rn|lpn|lvn|md|do|np|pa|pa-c|emt|msw|lcsw|lsw|phd|esq|jr|sr|ii|iii)"
_SUFFIX = (
    r"(?:st|street|ave|avenue|av|rd|road|ln|lane|dr|drive|ct|court|blvd|boulevard|way|ter|terrace|pkwy|parkway|pl|place|cir|circle|hwy|highway|trail|trl|sq|square"
    r"|cres|crescent|close|loop|alley|mews|row|path|grove|gardens|plaza|turnpike|pike|crossing|trace|broadway)"
)
#: Words behind which no person stands: places, institutions, devices, illnesses.
_THING = (
    r"(?:hospital|clinic|cent(?:er|re)|hospice|rehab|rehabilitation|manor|residence|institute|infirmary|nursing|pharmacy|church|school|university|college|park|county|city|township|village|campus|general|behavioral"
    r"|memorial|medical (?:cent(?:er|re)|group|plaza)|health|heart|dialysis|side|entrance|wing|tower|building|point|falls|cross|creek|ridge|hill|valley|mill|oak|quay|bluff|lake|river|bay|beach|springs|heights|harbor|harbour"
    r"|score|scale|sign|valve|sling|lift|chair|pad|brace|collar|catheter|tube|syndrome|disease|palsy|fracture|reflex|maneuver|manoeuvre|position|test|stage|grade|class|pump|monitor|body|dementia|line|drain|bag|mask|stretcher|van"
    r"|neg|negative|positive|wound|ulcer|street|avenue|road|lane|drive|court|boulevard)"
)
_NUMBERED = (
    r"(?:trip|order|auth(?:orization)?|claim|lot|serial|room|rm|bed|unit|chair|weight|wt|form|invoice|ref|reference|receipt|model|device|batch|part|expires|exp|case|tracking|ticket|po|gate|floor|suite|code|version|asset|tag|run)"
)
_COUNTED = r"(?:day|hour|hr|min|minute|week|month|year|lb|kg|mg|ml|cm|mm|ft|step|stair|person|pt|pound|inch|unit|lead|point|time|mile|bed|room|liter|litre|l|lpm|percent|x)s?"
_NO_PERSON = re.compile(
    rf"(?:{_REL}|{_ROLE}|{_VERB}|and|or|the|a|an|at|on|in|to|of|for|with|not|no|yes|none|unknown|staff|facility|office|same|present|home|phone|tel|fax|cell|both|her|his|their|he|she|they|who|this|that|from|by|per|ok|side|left|right|if|when|then|also|please|name|test|mrn|ssn|dob|order|ordering|pending|scheduled|care|goes|going|went|seen|done|need|have|were|been|are|its|into|out|down|after|before|during|until|only|own|via|due|new|old|all|any|each|some|more|less|than|now|here|there|where|which|what|was|you|your|our|their|them|him|home"
    rf"|{_TITLE}|{_THING}|january|february|march|april|june|july|august|september|october|november|december|monday|tuesday|wednesday|thursday|friday|saturday|sunday)\Z",
    _I,
)

# ---------------------------------------------------------------- patterns of candidates

_EMAIL = re.compile(r"(?<![\w.+'@-])\w[\w.+'-]*(?:\s(?:dot|underscore)\s\w[\w+'-]*){0,2}(?:\s?@\s?|\s?[(\[{]\s?at\s?[)\]}]\s?|\s+at\s+)\w[\w-]*(?:(?:\.|\s?[(\[{]\s?dot\s?[)\]}]\s?|\s+dot\s+)\w[\w-]*)+(?![\w-]|\s?[@(\[{])", _I)
_DIGIT_WORD = r"(?:zero|oh|one|two|three|four|five|six|seven|eight|nine|(?:double|triple) (?:zero|oh|one|two|three|four|five|six|seven|eight|nine))"
_PHONE = re.compile(
    r"(?<![\w#.-])(?<!\d/)(?:(?:\+?1[-. ]?)?(?:\(\d{3}\)\s?|\d{3}[-./ ])?\d{3}[-. ]\d{4}|\(\d{3}\)\s?\d{7}|\+?1?\d{10})(?![\w]|-\d)"
    r"|(?<![\w#+])(?:\+|00)[2-9]\d{0,2}[-. ]?(?:\(0\))?(?:\(?\d{1,5}\)?[-. ]?){1,5}\d{2,}(?![\w]|-\d)"
    rf"|\b{_DIGIT_WORD}(?:[ -]+{_DIGIT_WORD}){{6,}}\b",
    _I,
)
_ID = re.compile(
    r"(?<![\w/.-])(?:"
    r"A[-# ]{0,2}\d{3}[- ]?\d{3}[- ]?\d{3}(?!\d|-\d)"
    r"|(?!(?:mrn?|ssn?|id|no|ins|mbr|acct?|ref|rm)\b|(?:mrn?|ssn|mbr)\d)[A-Z]{1,4}(?:-?\d[\d-]{4,12}\d|\d{2,5} \d{3,5})(?![\w]|-\d)"
    r"|\d{3}([-. ])\d{2}\1\d{4}(?![\w]|-\d)"
    r"|\d{2,4}-\d{2,4}(?:-\d{2,4})+(?![\w]|-\d)"
    r"|\d{6,9}[A-Z](?!\w)"
    r"|\d{6,12}(?![\w]|[-./]\d)"
    r")",
    _I,
)
_STREET_WORD = rf"(?:(?:van|der|de|la|del|von|el|san|santa|saint|st\.?|mc|o')[ \t]+){{0,2}}{_W}[\w'’-]*"
_ADDRESS = re.compile(
    rf"(?<![\w#/.%$-])(?:(?P<street>\d{{1,5}}[A-Z]?,?[ \t]+(?:(?:[NSEW]|NE|NW|SE|SW|old|upper|little|lower|new|north|south|east|west)\.?[ \t]+)?"
    rf"(?:(?:\d{{1,3}}(?:st|nd|rd|th)|{_STREET_WORD})(?:[ \t]+{_W}[\w'’-]*){{0,2}}?[ \t]+{_SUFFIX}\b|broadway\b))"
    rf"|(?P<abroad>\d{{1,5}}[A-Z]?,?[ \t]+(?:rue|via|calle|avenida|rua|plaza|paseo|camino|chemin|place)[ \t]+{_STREET_WORD}(?:[ \t]+(?-i:[A-Z])[\w'’-]*)?)"
    r"|(?P<box>p\.?\s?o\.?\s?box[ \t]+\d+)"
    rf"|(?P<bare>[1-9]\d{{1,4}}[ \t]+{_W}[\w'’-]{{3,}}(?:[ \t]+{_W}[\w'’-]{{3,}})?))",
    _I,
)
_TOKEN = re.compile(rf"{_W}+(?:['’-]{_W}+)*")

# Matched against the text just before (ends with) or just behind (begins with) a candidate.
_EMAIL_LEFT = re.compile(r"(?:e-?mail|mail|address|contact|sent?|cc|copy|to|at|from|reach)(?: (?:me|us|her|him|it|to|at|is|id))*\s*[:=]?\s*$", _I)
_PHONE_LEFT = re.compile(r"\b(?:call(?:ed)?|text|cell|mobile|tel(?:ephone)?|ph(?:one)?|fax|pager|cb|callback|office|dial|contact|reach(?:ed)?|ring|number|home|work|at|line)(?: (?:is|no|number|at|on|back|me|her|him))*\s*[.#]?[=:,]?\s*\(?$", _I)
_PHONE_RIGHT = re.compile(rf"\s*(?:\(?(?:cell|home|work|mobile|office|ext|x\d)|is (?:the )?{_REL}|\({_REL})", _I)
_NUMBER_NOT = re.compile(rf"\b{_NUMBERED} ?(?:no|num|number|nbr|id)?[.#:]* *\Z", _I)
_ID_LEFT = re.compile(
    r"(?:\bss[n#]?|\bsocial(?: security)?|\bmrn?|medical record|\bmember(?:ship)?|\bmbr|\bsubscriber|\bins(?:urance)?|medicaid|medicare|\balien|\bfile|\bid|policy|\bchart|\bssn is|\bmrn is|beneficiary|registration)(?: id)?\s*(?:no|number|num|nbr)?(?: is)?[.:# ]*$", _I
)
_ADDRESS_LEFT = re.compile(r"\b(?:lives? (?:at|on|in)|living at|resid(?:es|ing) at|stay(?:s|ing) (?:at|with)|moved (?:to|from)|address|addr|home|house|residence|mail(?:ed)? to|deliver(?:y)? to|located at|pick(?:ed)? ?up(?: at| from)?|drop(?:ped)?(?: off)?(?: at)?|at|to|from)(?: is)?\s*[:=,]?\s*$", _I)
_GRADED = re.compile(r"\b(?:apt|apartment|ste|suite|stage|grade|class|level|score|scale|peep|pain|type|phase) *\Z", _I)
_RESIDES = re.compile(r"\b(?:lives? (?:at|on|in)|living at|resid(?:es|ing) at|stay(?:s|ing) at|address|addr)(?: is)?\s*[:=,]?\s*$", _I)
_ADDRESS_RIGHT = re.compile(r"\.?,?\s*(?:apt|apartment|unit|suite|ste|fl|floor|bldg|#\s?\d|[A-Z]{2} \d{5}|\d{5}\b|lot \d)", _I)
_NOT_STREET = re.compile(
    rf"^\W*\d+[A-Z]?,?[ \t]+(?:{_COUNTED}\b|w/|(?:and|or|the|for|on|in|at|to|by|per|of|off|with|was|is|are)\b)|\b(?:and|or|the|for|on|at|in|to|from|by|per|pt|was|with|is)\b|\bw/|\b{_REL}\b", _I
)
_NAME_LEFT = re.compile(rf"(?:\b{_TITLE}\.?|\b{_ROLE}(?: (?:is|name|named))?|\b{_REL}(?:['’]s name)?(?: is|,)?|\b{_AGENT}(?: is)?) ?[:=,]? *\"?\Z", _I)
_NAME_RIGHT = re.compile(rf"(?:['’]s\b)?\"?(?:,?\s*{_CREDENTIAL}\b|\s*\(?\s?(?:(?:the|her|his|pt['’]?s?) )?{_REL}\b|\s+(?:\w+ly )?{_VERB}\b|,? (?:and|or) (?:\w+ )?{_REL}\b|,? (?:dob|ssn?|mrn|tel|phone|cell)\b)", _I)
_NOT_NAME_RIGHT = re.compile(rf"(?:['’]s)?[ \t]+{_THING}\b", _I)
_NOT_NAME_LEFT = re.compile(rf"(?:\b(?:in|at|near|toward|towards|into|via|hx|h/o|history of|s/p|dx|r/o|stage|use|{_SUFFIX}\.?,)|\d,?)\s*$", _I)
#: Pairs of words that a person's name follows, by the second.
_PAIRS = {
    "by": {"signed", "consent"}, "to": {"spoke", "speak"}, "with": {"spoke", "speak"}, "for": {"ask"}, "of": {"care"}, "contact": {"emergency"}, "kin": {"of"}, "o": {"c"},
}
_IS_TITLE, _IS_REL, _IS_PERSON, _IS_ROLE = (re.compile(p) for p in (_TITLE, _REL, r"poa|nok|escort|witness|named", _ROLE))


@lru_cache(1 << 16)
def _announces(word: str) -> str:
    """What a word says of a name behind it: t title, r relation, p other word for persons, o role, or nothing."""
    for pattern, kind in ((_IS_TITLE, "t"), (_IS_REL, "r"), (_IS_PERSON, "p"), (_IS_ROLE, "o")):
        if pattern.fullmatch(word):
            return kind
    return ""


_PARTICLES = {"van", "ter", "ten", "der", "den", "de", "la", "del", "von", "di", "da", "le", "el", "al", "bin", "ibn", "san", "st"}
_TITLES = re.compile(rf"\b{_TITLE}\.?\s*$", _I)
_THINGS = re.compile(rf"{_THING}\Z", _I)

LABELERS = {
    "email": ("at sign", "ending", "words before", "dot written out", "local part"),
    "phone": ("separators", "exchange", "words before", "words behind", "no number of things", "name before"),
    "id_number": ("format", "words before", "plausible length", "no number of things", "holder before"),
    "address": ("suffix, box or words of residing", "street name", "words before", "words behind", "box"),
    "name": ("given name", "surname", "two parts", "words before", "words behind", "no place or thing", "capital", "no common word", "some support"),
}
#: Two learned labelers follow those of each kind.
LEARNED = ("context left", "context right")

GIVEN, GIVEN_WELL, SUR, SUR_WELL, COMMON = 1, 2, 4, 8, 16


@dataclass
class Gazetteer:
    """What is known of lower-case words, as bits: given name, surname (each also if well known), common word."""

    words: Mapping[str, int] = field(default_factory=dict)

    @classmethod
    def of(cls, given: Iterable[str], sur: Iterable[str], common: Iterable[str] = ()) -> Gazetteer:
        words: dict[str, int] = {}
        for names, bits in ((given, GIVEN | GIVEN_WELL), (sur, SUR | SUR_WELL), (common, COMMON)):
            for n in names:
                for w in n.split() if bits & GIVEN else n.split()[-1:]:
                    words[w] = words.get(w, 0) | bits
        return cls(words)


def _vote(yes: bool, no: bool = False) -> str:
    return "+" if yes else "-" if no else "0"


Span = tuple[str, int, int, str]  # kind, start, end, votes


def _emails(t: str) -> Iterator[Span]:
    for m in _EMAIL.finditer(t):
        s = m.group()
        written = re.search(r"\sat\s", s) is not None
        dots = re.search(r"\sdot\s|[(\[{]\s?dot", s, _I) is not None
        ending = re.search(r"(?:\.|dot\W*|\s)(?:[a-z]{2}|com|org|net|edu|gov|info|example|test|invalid|localhost)$", s, _I) is not None
        left = t[max(0, m.start() - 30) : m.start()]
        local = re.match(r"[\w.+'-]+", s).group()
        yield "email", m.start(), m.end(), _vote("@" in s or "(" in s or "[" in s, written and not dots) + _vote(ending, True) + _vote(bool(_EMAIL_LEFT.search(left))) + _vote(dots) + _vote(
            bool(re.search(r"[a-z].*[._+\d]|[a-z]{4}", local, _I)), local.isdigit()
        )


def _phones(t: str, names_end: set[int]) -> Iterator[Span]:
    for m in _PHONE.finditer(t):
        s, a = m.group(), m.start()
        digits = re.sub(r"\D", "", s)
        words = not digits
        abroad = s[0] in "+0" and not re.match(r"\+?1\D?\d{3}", s) and len(digits) > 10 or s.startswith("+") and not s.startswith("+1")
        if abroad and not 8 <= len(digits) <= 15:
            continue
        bare = not words and s.isdigit()
        core = digits[-10:] if len(digits) >= 10 else digits[-7:]
        exchange = core[-7:-4] if digits else ""
        valid = words or abroad or (exchange[:1] not in ("0", "1") and (len(core) == 7 or core[0] not in "01"))
        left = t[max(0, a - 50) : a]
        yield "phone", a, m.end(), (
            _vote(not bare)
            + _vote(words or abroad or exchange == "555", not valid)
            + _vote(bool(_PHONE_LEFT.search(left)))
            + _vote(bool(_PHONE_RIGHT.match(t, m.end())))
            + _vote(False, bool(_NUMBER_NOT.search(left)))
            + _vote(any(e in names_end for e in range(a - 3, a + 1)) or bool(re.search(rf"{_REL}\)?\s*$", left, _I)))
        )


def _ids(t: str, holders_end: set[int]) -> Iterator[Span]:
    for m in _ID.finditer(t):
        s, a = m.group(), m.start()
        left = t[max(0, a - 50) : a]
        n = sum(c.isdigit() for c in s)
        if s[0] in "Aa" and n == 9 or m.group(1):
            form = "+"
        else:
            form = "0" if s[0].isalpha() or s[-1].isalpha() or n < 10 else "-"
        yield "id_number", a, m.end(), (
            form
            + _vote(bool(_ID_LEFT.search(left)))
            + _vote(False, n < 6 or n > 10)
            + _vote(False, bool(_NUMBER_NOT.search(left)))
            + _vote(any(e in holders_end for e in range(a - 2, a + 1)))
        )


def _addresses(t: str, gaz: Gazetteer) -> Iterator[Span]:
    at, caps = 0, t != t.upper() and t != t.lower()
    while (m := _ADDRESS.search(t, at)) is not None:
        s, a = m.group(), m.start()
        box, bare = m.group("box") is not None, m.group("bare") is not None
        left = t[max(0, a - 60) : a]
        before = bool(_ADDRESS_LEFT.search(left))
        words = _TOKEN.findall(s)
        odd = not box and bool(_NOT_STREET.search(s))
        if odd or (not box and (_NUMBER_NOT.search(left) or _GRADED.search(left))) or (bare and caps and not words[0][0].isupper()):
            at = a + 1
            while at < len(t) and t[at].isdigit():
                at += 1
            continue
        own = words if bare else words[:-1]
        street = bool(re.search(r"\d(?:st|nd|rd|th)\b", s, _I)) or m.group("abroad") is not None or any(gaz.words.get(w.lower(), 0) & (GIVEN | SUR) for w in own)
        plain = not box and not street and (not caps or words[0][0].islower()) and all(gaz.words.get(w.lower(), 0) & COMMON for w in own)
        yield "address", a, m.end(), (
            _vote(not bare or bool(_RESIDES.search(left))) + _vote(street or box, plain) + _vote(before) + _vote(bool(_ADDRESS_RIGHT.match(t, m.end()))) + _vote(box)
        )
        at = m.end()


def _names(t: str, gaz: Gazetteer, others: list[Span]) -> Iterator[Span]:
    """Runs of name parts; words inside mail addresses and street addresses take no part."""
    inside = sorted((a, b) for kind, a, b, v in others if (kind == "email" and v[1] == "+") or (kind == "address" and "-" not in v))
    tokens, at = [], 0
    known = gaz.words
    low = t.replace("’", "'").lower()
    same = len(low) == len(t)
    for m in _TOKEN.finditer(t):
        a, b = m.span()
        w = low[a:b] if same else t[a:b].replace("’", "'").lower()
        if inside:
            while at < len(inside) and inside[at][1] <= a:
                at += 1
            if at < len(inside) and inside[at][0] <= a:
                w = ""
        tokens.append((a, b, w, known.get(w, 0)))
    n = len(tokens)
    caps = t != t.upper() and t != t.lower()

    def gap(i: int) -> str:
        return t[tokens[i][1] : tokens[i + 1][0]] if i + 1 < n else ""

    def initial(i: int) -> bool:
        return i < n and tokens[i][1] - tokens[i][0] == 1 and tokens[i][2] != ""

    def joined(i: int) -> bool:
        """The next token continues a name after token i."""
        g = gap(i)
        return g == " " or (g in (". ", ".") and initial(i))

    def surname_at(i: int) -> int:
        """End index of a surname that begins at token i, or i."""
        j = i
        while j < n and tokens[j][2] in _PARTICLES and gap(j) == " ":
            j += 1
        if j < n and tokens[j][3] & SUR and (j == i or j - i <= 2):
            return j + 1
        return i

    def capital(i: int) -> bool:
        """A word written as a name is, in a text that knows both cases; words all in capitals are abbreviations."""
        a, b, w, _ = tokens[i]
        return caps and len(w) > 1 and t[a].isupper() and not t[a:b].isupper() and not _NO_PERSON.match(w)

    # where a name is announced: by a word for persons, or by a role
    persons, roles = set(), set()
    for i in range(1, n):
        word = tokens[i - 1][2]
        kind = _announces(word)
        if kind or word in _PAIRS or word == "is":
            a = tokens[i][0]
            between = t[tokens[i - 1][1] : a]
            if (between[1:] if kind == "t" and between[0] == "." else between).strip(" ") not in ("", ":", "="):
                continue
            before = tokens[i - 2][2] if i > 1 else ""
            if (kind and kind != "o") or before in _PAIRS.get(word, ()) or (word == "is" and _announces(before) == "r"):
                persons.add(a)
            elif kind:
                roles.add(a)

    def unknown_run(i: int) -> int:
        """End index of a run of up to three words that may be a name without a known part, or i."""
        a, b, w, _ = tokens[i]
        announced = a in persons or (a in roles and _NAME_RIGHT.match(t, b))
        if w == "":
            return i
        j = i
        if announced and caps:
            while j < n and j - i < 3 and capital(j) and (j == i or gap(j - 1) == " "):
                j += 1
            return j
        # else words that are neither known nor common: whether they are names is left to what is around them
        while j < n and j - i < 3 and odd(j) and (j == i or gap(j - 1) == " "):
            j += 1
        return j

    def odd(i: int) -> bool:
        a, b, w, bits = tokens[i]
        return len(w) > 2 and not bits and (not caps or (t[a].isupper() and not t[a:b].isupper())) and not _NO_PERSON.match(w)

    def may_begin(i: int) -> bool:
        a, b, w, bits = tokens[i]
        return bool(bits & (GIVEN | SUR)) or b - a == 1 or a in persons or a in roles or w in _PARTICLES or (not bits and (not caps or t[a].isupper()))

    begins = [i for i in range(n) if may_begin(i)]
    i = -1
    for at in begins:
        if at < i:
            continue  # within the last run
        i = j = at
        has_given = has_sur = False
        bits = parts = 0
        # initials and given names, then a surname
        while j < n:
            end = surname_at(j)
            if end > j and not (tokens[j][3] & GIVEN and end < n and joined(end - 1) and surname_at(end) > end):
                bits |= tokens[end - 1][3] & (SUR | SUR_WELL)
                j, has_sur, parts = end, True, parts + 1
                break
            if tokens[j][3] & GIVEN:
                has_given = True
                bits |= tokens[j][3] & (GIVEN | GIVEN_WELL)
            elif initial(j) and ((j > i and tokens[j][0] > 0) or (gap(j) in (". ", " ") and j + 1 < n and surname_at(j + 1) > j + 1 and gap(j) == ". ")):
                pass
            else:
                break
            parts += 1
            j += 1
            if j < n and not joined(j - 1):
                break
        if not (has_given or has_sur):
            j = unknown_run(i)
            parts = j - i
            if not parts:
                continue
        elif not has_sur and j < n and joined(j - 1) and capital(j) and not tokens[j][3] & COMMON and not initial(j - 1):
            j, parts = j + 1, parts + 1  # a surname that isn't known behind a given name that is
        # an initial that closes a run belongs to it only with its point
        while j - 1 > i and initial(j - 1) and not has_sur and t[tokens[j - 1][1] : tokens[j - 1][1] + 1] != ".":
            j -= 1
            parts -= 1
        # Surname, Given
        if has_sur and not has_given and parts == 1 and j < n and gap(j - 1) == ", " and tokens[j][3] & GIVEN:
            k = j + 1
            while k < n and joined(k - 1) and (tokens[k][3] & GIVEN or (initial(k) and t[tokens[k][1] : tokens[k][1] + 1] == ".")) and surname_at(k) == k:
                k += 1
            followed = k < n and joined(k - 1) and surname_at(k) > k
            if not followed:
                bits |= tokens[j][3] & (GIVEN | GIVEN_WELL)
                j, has_given, parts = k, True, parts + 1
        a, b = tokens[i][0], tokens[j - 1][1]
        unknown = not (has_given or has_sur)
        bare = unknown and a not in persons and a not in roles and not (caps and parts > 1)
        if bare and _NOT_NAME_RIGHT.match(t, b):
            i = j
            continue
        left, first = t[max(0, a - 40) : a], t[a]
        not_left = bool(_NOT_NAME_LEFT.search(left)) and not _TITLES.search(left)
        thing = any(_THINGS.match(tokens[x][2]) and tokens[x][2] not in _PARTICLES for x in range(i, j))
        not_right, right = thing or bool(_NOT_NAME_RIGHT.match(t, b)), bool(_NAME_RIGHT.match(t, b))
        common = all(tokens[x][3] & COMMON for x in range(i, j))
        yield "name", a, b, (
            _vote(bool(bits & GIVEN_WELL)) + _vote(bool(bits & SUR_WELL)) + _vote(parts > 1)
            + _vote(not not_right and bool(_NAME_LEFT.search(left))) + _vote(right and not not_right)
            + _vote(False, (not_left and not right and parts == 1) or not_right)
            + _vote(caps and first.isupper())
            + _vote(False, common)
            + _vote(False, bare)
        )
        i = j


def candidates(text: str, gaz: Gazetteer) -> list[Span]:
    """Every candidate of every kind, with the votes of the labelers that aren't learned."""
    t = text
    out = list(_emails(t))
    out += _addresses(t, gaz)
    names = list(_names(t, gaz, out))
    names_end = {e for _, _, e, _ in names}
    holders = names_end | {e for k, _, e, _ in out if k == "address"}
    out += _phones(t, names_end)
    out += _ids(t, holders)
    return out + names


# ---------------------------------------------------------------- contexts

_PIECE = re.compile(rf"{_W}+(?:['’]{_W}+)*|\d+|\n|[^\w\s]")
_BREAK = set(";.|/\n•")


def _seed(kind: str, votes: str) -> bool:
    """Whether the form alone leaves hardly a doubt."""
    if kind == "name":
        return votes[5] != "-" and (votes[:3] == "+++" or ("+" in votes[:2] and votes[3] == "+" and votes[7] != "-"))
    if kind == "phone":
        return votes[0] == "+" and votes[1] != "-" and votes[4] != "-"
    if kind == "id_number":
        return votes[3] != "-" and (votes[0] == "+" or votes[:2] == "0+")
    if kind == "address":
        return votes[0] == "+" and "+" in votes[1:3]
    return votes[:2] == "++"


def _pieces(text: str) -> list[str]:
    return ["9" if p[0].isdigit() else p.lower() for p in _PIECE.findall(text)]


def contexts(text: str, spans: list[Span]) -> list[list[int]]:
    """For each span four hashed contexts: one and two pieces before it, one and two behind.

    Pieces are words, signs and digits as 9; another candidate stands for its kind. A context that begins with the end of a
    statement, or is a lone sign, is none (-1).
    """
    starts = {a: k for k, a, _, _ in spans}
    ends = {b: k for k, _, b, _ in spans}
    out = []
    for kind, a, b, _ in spans:
        before, behind = text[max(0, a - 32) : a], text[b : b + 32]
        near = next((ends[e] for e in range(a, a - 3, -1) if e in ends and e != b), None)
        left = _pieces(before)[-2:]
        if near:
            left = [f"<{near}>"] + [p for p in left[-1:] if not p[0].isalnum()]
        after = next((starts[s] for s in range(b, b + 3) if s in starts and s != a), None)
        right = _pieces(behind)[:2]
        if after:
            right = [p for p in right[:1] if not p[0].isalnum()] + [f"<{after}>"]
        closed = not left or left[-1] in _BREAK or before.endswith((" - ", "\r\n"))
        shut = not right or right[0] in _BREAK or behind.startswith((" - ", "\r\n"))
        hashed = lambda side, p: zlib.crc32(f"{kind}{side}{' '.join(p)}".encode()) & ((1 << CONTEXT_BITS) - 1)
        sign = lambda p: not p[0].isalnum() and p[0] != "<"
        out.append([
            -1 if closed or sign(left[-1]) else hashed("l", left[-1:]), -1 if closed else hashed("L", left),
            -1 if shut or sign(right[0]) else hashed("r", right[:1]), -1 if shut else hashed("R", right),
        ])
    return out


def _interval(hits: int, n: int) -> tuple[float, float]:
    """Ends of the 95 % interval of a share."""
    z, p = 1.96, hits / n
    mid, wide, under = p + z * z / (2 * n), z * math.sqrt(p * (1 - p) / n + z * z / (4 * n * n)), 1 + z * z / n
    return (mid - wide) / under, (mid + wide) / under


#: A context in which one name makes up less than this share of the candidates holds persons.
ONE_NAME = 0.1


def context_votes(sums: Iterable[tuple[str, int, int, int, int, int, int]]) -> dict[tuple[str, int, int], str]:
    """The vote of each context from (kind, slot, bucket, candidates, seeds, candidates with a known name, those of the most frequent one).

    Yes where the share of seeds is surely no smaller than a fifth of the kind's, and where most candidates are known names, many
    different ones, none of them often: a place or thing that shares its name with persons keeps coming back. No where both are surely
    not so. All by the 95 % intervals of shares, so rare contexts say nothing. Numbers and addresses hardly ever repeat, so for
    them only seeds count.
    """
    rows = list(sums)
    whole: dict[str, list[int]] = {}
    for kind, slot, _, n, seeds, *_ in rows:
        if slot == 1:
            w = whole.setdefault(kind, [0, 0])
            w[0] += n
            w[1] += seeds
    out = {}
    for kind, slot, bucket, n, seeds, named, top in rows:
        total, all_seeds = whole.get(kind, (0, 0))
        base = all_seeds / total if total else 0.0
        if bucket < 0 or base == 0:
            continue
        low, high = _interval(seeds, n)
        few, many = _interval(top, named) if named else (1.0, 1.0)
        varied = kind == "name" and 2 * named >= n and many < ONE_NAME
        if low >= base / 5 or varied:
            out[kind, slot, bucket] = "+"
        elif high < base / 5 and (kind != "name" or few > ONE_NAME or 2 * named < n):
            out[kind, slot, bucket] = "-"
    return out


def with_contexts(kind: str, votes: str, ctx: list[int], known: Mapping) -> str:
    """votes and those of the learned labelers: two pieces of context before one.

    A number and a word without anything of an address are no address outside the wider contexts of addresses, and words
    of which nothing is known no name unless names stand on both sides.
    """
    both = [known.get((kind, wide, ctx[wide])) or known.get((kind, near, ctx[near])) or "0" for near, wide in ((0, 1), (2, 3))]
    if kind == "address" and votes[0] == "0" and not any(known.get((kind, wide, ctx[wide])) == "+" for wide in (1, 3)):
        votes = "-" + votes[1:]
    # unknown words: a name only with both sides, or as two capitalised words or behind a word for persons with neither side against it
    if kind == "name" and votes[:2] == "00" and (both != ["+", "+"] if votes[8] == "-" else "-" in both):
        votes = votes[:5] + "-" + votes[6:]
    return votes + "".join(both)


# ---------------------------------------------------------------- learning


def _vote_matrix(patterns: list[str]) -> np.ndarray:
    return np.array([[{"-": 0, "0": 1, "+": 2}[c] for c in p] for p in patterns])


#: What a labeler is taken to do before any data: how often it says no, nothing, yes on a true and on
#: a false candidate; and the weight of that belief, as a share of all candidates, for no and yes. A no
#: comes from words that announce something else, so it is believed firmly.
_BELIEF = {1: (0.002, 0.448, 0.55), 0: (0.50, 0.40, 0.10)}
_BELIEF_WEIGHT = (5.0, 0.0, 0.05)


def em(patterns: list[str], counts: np.ndarray, rounds: int = 100) -> np.ndarray:
    """Posterior of each vote pattern; labelers are independent given the truth.

    A labeler that says nothing is no evidence either way. The belief keeps a kind with hardly any
    false candidates from splitting its true ones.
    """
    v = _vote_matrix(patterns)
    score = (v == 2).sum(1) - 4.0 * (v == 0).sum(1)
    post = 1 / (1 + np.exp(-1.5 * (score - 0.5)))
    total = counts.sum()
    for _ in range(rounds):
        w1, w0 = counts * post, counts * (1 - post)
        odds = math.log((w1.sum() + total / 10) / (w0.sum() + total / 10))
        for j in range(v.shape[1]):
            for level in (0, 2):
                hit, k = v[:, j] == level, _BELIEF_WEIGHT[level] * total + 1
                p1 = (w1[hit].sum() + k * _BELIEF[1][level]) / (w1.sum() + k)
                p0 = (w0[hit].sum() + k * _BELIEF[0][level]) / (w0.sum() + k)
                # a yes never speaks against, a no never for
                ratio = max(0.0, math.log(p1 / p0)) if level == 2 else min(0.0, math.log(p1 / p0))
                odds = odds + hit * ratio
        new = 1 / (1 + np.exp(-np.clip(odds, -500, 500)))
        if np.abs(new - post).max() < 1e-6:
            return new
        post = new
    return post


def _design(patterns: list[str]) -> np.ndarray:
    v = _vote_matrix(patterns)
    yes, no = (v == 2).astype(float), (v == 0).astype(float)
    return np.hstack([np.ones((len(patterns), 1)), yes, no, (yes.sum(1, keepdims=True) >= 2).astype(float), (yes.sum(1, keepdims=True) >= 3).astype(float)])


def logistic(patterns: list[str], counts: np.ndarray, target: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Weights of the span classifier, fitted to soft targets by Newton's method."""
    x = _design(patterns)
    weight = np.sqrt(counts)  # a common pattern counts more, but doesn't drown the rare ones
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (weight * (p - target)) + ridge * w
        hess = (x * (weight * np.maximum(p * (1 - p), 1e-4))[:, None]).T @ x + ridge * np.eye(x.shape[1])
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-7:
            break
    return w


@dataclass
class Model:
    weights: dict[str, np.ndarray]
    contexts: Mapping = field(default_factory=dict)
    known: dict = field(default_factory=dict)

    def score(self, kind: str, votes: str) -> float:
        key = (kind, votes)
        if key not in self.known:
            w = self.weights.get(kind)
            self.known[key] = 0.0 if w is None else float(1 / (1 + np.exp(-np.clip((_design([votes]) @ w)[0], -30, 30))))
        return self.known[key]

    def resolve(self, spans: Iterable[tuple], threshold: float = 0.5) -> list[tuple[str, int, int]]:
        """The items among the candidates (kind, start, end, votes, contexts) of one text, in order, none overlapping another."""
        passed = [(k, a, b) for k, a, b, v, c in spans if self.score(k, with_contexts(k, v, c, self.contexts)) >= threshold]
        passed.sort(key=lambda s: (PRIORITY[s[0]], s[1] - s[2], s[1]))
        taken: list[tuple[str, int, int]] = []
        for k, a, b in passed:
            if all(b <= x or a >= y for _, x, y in taken):
                taken.append((k, a, b))
        return sorted(taken, key=lambda s: s[1])

    def items(self, text: str, gaz: Gazetteer) -> list[tuple[str, int, int]]:
        spans = candidates(text, gaz)
        return self.resolve([(*s, c) for s, c in zip(spans, contexts(text, spans))])

    def redact(self, text: str, gaz: Gazetteer) -> str:
        out, at = [], 0
        for k, a, b in self.items(text, gaz):
            out += [text[at:a], PLACEHOLDER[k]]
            at = b
        return "".join(out) + text[at:]


def fit(pattern_counts: Iterable[tuple[str, str, int]], known_contexts: Mapping) -> Model:
    """Model from (kind, votes, count) of all candidates, the learned votes among them."""
    by_kind: dict[str, list] = {}
    for kind, votes, n in pattern_counts:
        by_kind.setdefault(kind, []).append((votes, n))
    weights = {}
    for kind, rows in by_kind.items():
        rows.sort()
        patterns, counts = [v for v, _ in rows], np.array([n for _, n in rows], dtype=float)
        weights[kind] = logistic(patterns, counts, em(patterns, counts))
    return Model(weights, known_contexts)


# ---------------------------------------------------------------- on DataFrames

_SPAN = [("kind", pa.string(), T.StringType()), ("a", pa.int32(), T.IntegerType()), ("b", pa.int32(), T.IntegerType()), ("votes", pa.string(), T.StringType()),
         ("seed", pa.bool_(), T.BooleanType()), ("text", pa.int64(), T.LongType()), ("ctx", pa.list_(pa.int32()), T.ArrayType(T.IntegerType()))]
_SPANS = T.StructType([
    T.StructField("row_id", T.LongType()), T.StructField("field_name", T.StringType()),
    T.StructField("spans", T.ArrayType(T.StructType([T.StructField(n, t) for n, _, t in _SPAN]))),
])

#: As _TOKEN, away from mail addresses and codes.
_JVM_TOKEN = r"(?<![\p{L}\p{N}_@.+])\p{L}+(?:['’-]\p{L}+)*(?![\p{L}\p{N}_@]|\.\p{L})"
_NO_NAMES = ["unknown", "unk", "fnu", "lnu", "nmn", "none", "test", "null"]


def known_words(texts: DataFrame, fields: list[str], names: DataFrame, given: list[str], sur: list[str], hollow: DataFrame) -> DataFrame:
    """(word, bits): the words of the texts that are names, or common ones, as in Gazetteer.

    names is a table of persons, hollow (field_name, placeholder) the values that stand for no name. Every name counts,
    however rare; in NAME_SHARE of the name cells at least once and three times at all, it is well known. A word is common
    if it is written small in a third of the places of texts that have both cases, and twice at all.
    """
    cell = lambda f, role: F.struct(F.lit(f).alias("f"), F.lit(role).alias("role"), F.lower(F.trim(F.col(f"`{f}`"))).alias("cell"))
    cells = names.select(F.explode(F.array(*[cell(f, GIVEN) for f in given], *[cell(f, SUR) for f in sur])).alias("c")).select("c.*").filter("cell <> ''")
    empty = hollow.select(F.col("field_name").alias("f"), F.lower(F.trim("placeholder")).alias("cell")).distinct()
    counts = cells.groupBy("f", "role", "cell").agg(F.count(F.lit(1)).alias("n")).join(empty, ["f", "cell"], "left_anti")
    parts = F.split(F.replace("cell", F.lit("’"), F.lit("'")), r"\s+")
    words = counts.select("role", "n", F.explode(F.when(F.col("role") == SUR, F.array(F.element_at(parts, -1))).otherwise(parts)).alias("word"))
    words = words.filter(F.col("word").rlike(r"^\p{L}[\p{L}'-]*\p{L}$") & ~F.col("word").isin(_NO_NAMES))
    by_word = words.groupBy("word").agg(F.sum(F.when(F.col("role") == GIVEN, F.col("n"))).alias("g"), F.sum(F.when(F.col("role") == SUR, F.col("n"))).alias("s"))
    total = words.groupBy("role").agg(F.sum("n").alias("n")).collect()  # two rows
    cells_of = {r.role: r.n for r in total}
    text = F.explode(F.array(*[F.col(f"`{f}`") for f in fields])).alias("t")
    mixed = (F.col("t") != F.upper("t")) & (F.col("t") != F.lower("t"))
    tokens = texts.select(text).filter("t is not null").select(mixed.alias("mixed"), F.explode(F.regexp_extract_all("t", F.lit(_JVM_TOKEN), F.lit(0))).alias("w"))
    seen = tokens.groupBy(F.replace(F.lower("w"), F.lit("’"), F.lit("'")).alias("word")).agg(F.count_if("mixed").alias("m"), F.count_if(F.col("mixed") & (F.col("w") == F.lower("w"))).alias("l"))
    bit = lambda c, b: F.when(F.coalesce(c, F.lit(False)), F.lit(b)).otherwise(F.lit(0))
    well = lambda c, role: (F.col(c) >= 3) & (F.col(c) * NAME_SHARE >= cells_of.get(role, 0))
    bits = bit(F.col("g") > 0, GIVEN) + bit(well("g", GIVEN), GIVEN_WELL) + bit(F.col("s") > 0, SUR) + bit(well("s", SUR), SUR_WELL) + bit((F.col("l") >= 2) & (F.col("l") * 3 >= F.col("m")), COMMON)
    return seen.join(by_word, "word", "left").select("word", bits.alias("bits")).filter("bits > 0")


@dataclass
class Texts:
    """Texts with what is known of their words: one gazetteer for all, or a column of each text's own."""

    df: DataFrame
    id_col: str
    fields: list[str]
    gaz: Gazetteer | None


def with_known(texts: DataFrame, id_col: str, fields: list[str], words: DataFrame, max_travelling: int = MAX_TRAVELLING) -> Texts:
    """Texts ready for ``find_spans``. The known words travel with the tasks if they are at most max_travelling; else each
    text gets those among its own words by a shuffle. The items found are the same. id_col must be unique."""
    rows = words.limit(max_travelling + 1).collect()
    df = texts.select(id_col, *fields)
    if len(rows) <= max_travelling:
        return Texts(df.withColumn("__known", F.lit(None).cast("map<string,int>")), id_col, fields, Gazetteer({r.word: r.bits for r in rows}))
    pattern = F.lit(r"\p{L}+(?:['’-]\p{L}+)*")
    own = F.array_distinct(F.flatten(F.array(*[F.coalesce(F.regexp_extract_all(F.lower(f), pattern, F.lit(0)), F.array().cast("array<string>")) for f in fields])))
    asked = df.select(F.col(id_col).alias("__id"), F.explode(F.transform(own, lambda w: F.replace(w, F.lit("’"), F.lit("'")))).alias("word")).distinct()
    each = asked.join(words, "word").groupBy("__id").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("__known"))
    return Texts(df.join(each, F.col(id_col) == F.col("__id"), "left").drop("__id"), id_col, fields, None)


def _gazetteers(gaz: Gazetteer | None, column: pa.Array) -> Iterator[Gazetteer]:
    for own in column.to_pylist() if gaz is None else [None] * len(column):
        yield gaz or Gazetteer(dict(own or ()))


def find_spans(texts: Texts) -> DataFrame:
    """(row_id, field_name, spans): the candidates of each text that has any."""
    fields, gaz = texts.fields, texts.gaz

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, known = b.column(0).to_pylist(), list(_gazetteers(gaz, b.column(len(fields) + 1)))
            for c, name in enumerate(fields, 1):
                rows, spans, ends = [], [], [0]
                for row, text, g in zip(ids, b.column(c).to_pylist(), known):
                    if text and (found := candidates(text, g)):
                        rows.append(row)
                        spans += [
                            (k, x, y, v, _seed(k, v), zlib.crc32(text[x:y].lower().encode()) if k == "name" and "+" in v[:2] else -1, e)
                            for (k, x, y, v), e in zip(found, contexts(text, found))
                        ]
                        ends.append(len(spans))
                columns = list(zip(*spans)) or [[] for _ in _SPAN]
                inner = pa.StructArray.from_arrays([pa.array(c, t) for c, (_, t, _) in zip(columns, _SPAN)], names=[n for n, *_ in _SPAN])
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), inner)
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array([name] * len(rows), pa.string()), lists], names=["row_id", "field_name", "spans"])

    return texts.df.select(F.col(texts.id_col).cast("long").alias("row_id"), *fields, "__known").mapInArrow(run, _SPANS)


def _span_rows(b: pa.RecordBatch) -> Iterator[tuple]:
    lists = b.column(2)
    if not len(lists):
        return
    first, inner = lists.offsets[0].as_py(), lists.flatten()
    ends = [x - first for x in lists.offsets.to_pylist()]
    kind, a, z, votes = (inner.field(n).to_pylist() for n in ("kind", "a", "b", "votes"))
    ctx = inner.field("ctx").flatten().to_pylist()
    for i, (row, name) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist())):
        yield row, name, [(kind[j], a[j], z[j], votes[j], ctx[4 * j : 4 * j + 4]) for j in range(ends[i], ends[i + 1])]


def fit_on(spans: DataFrame) -> Model:
    each = spans.select(F.explode("spans").alias("s")).select("s.kind", F.col("s.seed").cast("int").alias("seed"), "s.text", F.posexplode("s.ctx").alias("slot", "bucket"))
    by_text = each.filter("bucket >= 0").groupBy("kind", "slot", "bucket", "text").agg(F.count(F.lit(1)).alias("n"), F.sum("seed").alias("seeds"))
    sums = by_text.groupBy("kind", "slot", "bucket").agg(F.sum("n").alias("n"), F.sum("seeds").alias("seeds"), F.sum(F.when(F.col("text") >= 0, F.col("n")).otherwise(0)).alias("named"), F.max(F.when(F.col("text") >= 0, F.col("n")).otherwise(0)).alias("top"))
    known = context_votes(tuple(r) for r in sums.collect())  # at most 2 ** CONTEXT_BITS rows per kind and slot

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen: Counter = Counter((k, with_contexts(k, v, c, known)) for _, _, found in _span_rows(b) for k, _, _, v, c in found)
            keys = list(zip(*seen)) or [[], []]
            yield pa.RecordBatch.from_arrays([pa.array(keys[0], pa.string()), pa.array(keys[1], pa.string()), pa.array(list(seen.values()), pa.int64())], names=["kind", "votes", "n"])

    counts = spans.mapInArrow(count, "kind string, votes string, n long").groupBy("kind", "votes").agg(F.sum("n").alias("n"))
    # the rows here are vote patterns, some hundreds per kind in practice
    ranked = counts.withColumn("r", F.row_number().over(W.partitionBy("kind").orderBy(F.desc("n"), "votes"))).filter(F.col("r") <= MAX_PATTERNS)
    return fit([(r.kind, r.votes, r.n) for r in ranked.collect()], known)


def found(spans: DataFrame, model: Model) -> DataFrame:
    """(row_id, field_name, pii_kind, start_pos), start_pos counted from 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [(row, name, k, a + 1) for row, name, each in _span_rows(b) for k, a, _ in model.resolve(each)]
            cols = list(zip(*out)) or [[]] * 4
            types = (pa.int64(), pa.string(), pa.string(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, x) for c, x in zip(cols, types)], names=["row_id", "field_name", "pii_kind", "start_pos"])

    return spans.mapInArrow(run, "row_id long, field_name string, pii_kind string, start_pos int")


def redact(texts: Texts, model: Model) -> DataFrame:
    """The id and the fields, items replaced by typed placeholders, all else unchanged."""
    fields, gaz, id_col = texts.fields, texts.gaz, texts.id_col

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            known = list(_gazetteers(gaz, b.column(len(fields) + 1)))
            cols = [pa.array([t and model.redact(t, g) for t, g in zip(b.column(i).to_pylist(), known)], pa.string()) for i in range(1, len(fields) + 1)]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], names=[id_col, *fields])

    picked = texts.df.select(id_col, *fields, "__known")
    return picked.mapInArrow(run, T.StructType([picked.schema[id_col]] + [T.StructField(f, T.StringType()) for f in fields]))
