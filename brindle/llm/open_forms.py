"""Personal information in forms that no directory or printed cue names.

A second set of generators beside those of ``pii.py``, for ordinary text: addresses of mail by
their syntax, telephone numbers of common plans, identity numbers behind a label, house numbers
of any length with street words of several languages, and names from titles, initials, given
names and runs of capitalised words. What a directory knows is a feature, no condition. The
trees in ``open_model.json`` (fitted by ``train_open.py``) decide.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from functools import lru_cache

from brindle.llm.layout import alike

_CAP = r"[A-ZÀ-Þ][a-zà-ÿ]+(?:['’-][A-ZÀ-Þ][a-zà-ÿ]+)?"
_FAMILY = rf"(?:(?:O|D|Mc|Mac)['’]?)?{_CAP}"
_PARTICLE = r"(?:van der|van den|van|von der|von|de la|de|del|della|di|du|ten|ter|zu|zur|le|la)"
_INITIAL = r"[A-ZÀ-Þ]\."
#: Common words of address, as text.
TITLES = "Mr Mrs Ms Miss Mx Dr Prof Rev Sir Dame Lady Lord Capt Col Maj Lt Sgt Herr Herrn Frau Fräulein Monsieur Madame Mademoiselle Mme Mlle Señor Señora Signor Signora".split()
#: Common given names, as text; a name outside the list is found by its title or surroundings.
GIVEN = """Adam Alan Albert Alexander Alice Amanda Amy Andrea Andreas Andrew Angela Anna Anne Anthony Barbara Benjamin Brian Carlos Caroline Catherine Charles
Charlotte Christian Christine Claire Claude Daniel David Deborah Diana Donald Edward Elena Elizabeth Emily Emma Eric Eva Frank Franz François George Hans Hannah
Heinrich Helen Henri Henry Isabelle Jack Jacques James Jane Jean Jennifer Jessica Johann John Jonathan Jose Joseph Juan Julia Julie Karen Karl Kate Kevin Klaus
Laura Linda Lisa Louis Louise Luc Lucy Maria Marie Mark Martin Mary Matthew Michael Michel Monika Nancy Nicholas Olivia Patricia Patrick Paul Peter Philip Pierre
Rachel Richard Robert Ruth Samuel Sandra Sarah Sophie Stefan Stephen Steven Susan Teresa Thomas Timothy Ursula Victoria Walter William Wolfgang Yusuf""".split()
STREETS = "Street St Road Rd Avenue Ave Lane Ln Square Sq Terrace Row Place Pl Drive Dr Court Ct Boulevard Blvd Way Crescent Close Gardens Parkway Highway Hwy Circle Trail".split()

_LABELS = "ssn security passport reisepass passeport identity id nino insurance tax steuer sozialversicherungsnummer personalausweis ausweis identité sociale license licence".split()
_LABEL = r"(?i:SSN|social[ \n]security|passport|reisepass|passeport|national[ \n]id(?:entity)?|identity[ \n]card|personal[ \n]id|ID|NINO|national[ \n]insurance|tax[ \n]id|steuer-?id|sozialversicherungsnummer|personalausweis|ausweis|carte[ \n]d['’]identité|sécurité[ \n]sociale|driver['’]?s[ \n]licen[cs]e)"
_NO = r"(?i:(?:[ \n]?(?:no|nr|number|nummer|numéro|card|n°|№)\b\.?)*)"
_IDENTITY = re.compile(rf"(?<!\w){_LABEL}{_NO}[ \n]?[:#]?[ \n]?(?:(?i:is|was|lautet|est)[ \n])?(?P<v>(?=(?:[A-Z0-9]+[ -]?)*\d)[A-Z0-9](?:[ -]?[A-Z0-9]){{4,19}})(?![\w-])")
_EMAIL_LEFT = re.compile(r"(?<![\w.+-])[\w.+-]*\w\Z")
_EMAIL_RIGHT = re.compile(r"(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,}(?![\w@])")
_PHONE = re.compile(r"\d(?<![\w£$€,/-]\d)(?<!\.\d)(?:\d{0,3}[ .-]\d|\d{1,3}\)[ .-]?\d)[\d .()-]{3,}\d(?![\w-]|[.,]\d)")
_PHONE_WHOLE = re.compile(r"(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?|\d{2,4}[ .-])\d{2,4}(?:[ .-]\d{2,4}){1,3}(?![\w-]|[.,]\d)")
_EN_LEFT = re.compile(rf"(?<![\w£$€.,:/-])\d{{1,5}}[A-Za-d]?,?[ \n](?:(?:North|South|East|West|N\.|S\.|E\.|W\.)[ \n])?(?:(?:{_CAP}|\d{{1,3}}(?:st|nd|rd|th))[ \n]){{1,4}}\Z")
_FR_LEFT = re.compile(r"(?<![\w£$€.,:/-])\d{1,4}(?:[ \n]?(?:bis|ter))?,?[ \n]\Z")
_FR_RIGHT = re.compile(rf"[ \n](?:(?:de la|de l['’]|des|du|de|d['’])[ \n]?)?{_CAP}(?:[ \n-]{_CAP}){{0,3}}")
_FR_TYPES = "rue avenue boulevard place quai chemin allée impasse route cours".split()
_DE_PREFIXED = re.compile(rf"(?:Unter den|Unter der|An der|An den|Am|Im|In der|Auf der|Auf dem|Zum|Zur|Bei der|Hinter der|Vor dem)[ \n]{_CAP}(?:[ \n]{_CAP})?[ \n](?:Nr\.[ \n])?\d{{1,4}}(?:[ \n]?[a-d](?!\w))?(?!\w)")
_DE_BEGINS = {w.encode() for w in "Unter An Am Im In Auf Zum Zur Bei Hinter Vor".split()}
_DE_SUFFIXES = tuple(w.encode("latin-1") for w in "straße strasse str Straße Strasse Str platz Platz weg Weg allee Allee gasse Gasse damm Damm ufer Ufer ring Ring".split())
_DE_LEFT = re.compile(rf"(?<![\w-])(?:{_CAP}[ \n-]){{0,2}}\Z")
_DE_AFTER = re.compile(r"\.?[ \n](?:Nr\.[ \n])?\d{1,4}(?:[ \n]?[a-d](?!\w))?(?!\w)")
_TITLED = re.compile(rf"\.?[ \n](?P<v>(?:(?:{_INITIAL}|{_CAP})[ \n]){{0,2}}(?:{_PARTICLE}[ \n])?{_FAMILY})(?!\w)")
_INITIALS = re.compile(rf"(?P<v>(?:{_INITIAL}[ \n]?){{1,3}}(?:{_PARTICLE}[ \n])?{_FAMILY})(?!\w)")
_RUN = re.compile(rf"(?P<v>{_CAP}[ \n](?:(?:{_INITIAL}|{_CAP})[ \n]){{0,2}}(?:{_PARTICLE}[ \n])?{_FAMILY})(?!\w)")
#: Latin-1 with a blank for all that is no letter or digit.
_SPLIT = bytes(i if chr(i).isalnum() else 32 for i in range(256))

_VERBS = set("said was is had has wrote called asked told came went lives lived works worked sent signed met spoke replied died married joined paid owes owed born thinks answered arrived left met sagte war ist hat schrieb kam wohnt lebt arbeitet rief unterschrieb a est était habite vit travaille arriva signa dit".split())
_BEFORE = set("by to for with from and that when as of contact ask see tell said attn dear hello hi cc von an mit bei für durch dass und par pour avec chez que et signed employee patient customer client neighbour teacher author colleague nurse kollege kunde patientin client".split())
_PLACES = set("street road avenue lane square terrace hotel board city town county river lake mount mountain island bay park bridge station company co ltd inc gmbh ag bank church school university college hospital museum theatre club union society council court house castle hall press gazette times news post act war day week morning evening monday tuesday wednesday thursday friday saturday sunday january february march april may june july august september october november december north south east west northern southern eastern western central new old great royal national united general first second lord mayor king queen prince president minister bürgermeister saint st the a an der die das le les la des ship steamer dampfer firma railway line works brothers sons".split())
_GIVEN = set(GIVEN)


def _forms(words) -> frozenset[bytes]:
    return frozenset(w.encode("latin-1", "replace") for w in words)


_GIVEN_FORMS, _TITLE_FORMS, _STREET_FORMS, _FR_FORMS, _LABEL_FORMS = map(_forms, (GIVEN, TITLES, STREETS, _FR_TYPES, _LABELS))
_LETTERS = _forms("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
#: Words that a name with no known part stands behind.
_LEADS = set("by contact named called Dear Patient patient author client colleague teacher nurse Kollege Kunde von par met told signed".split())
_LEAD_FORMS = _forms(_LEADS)
_OTHER_AFTER = re.compile(r"\s(?:&|and[ \n](?:Sons|Co|Brothers|Company)|(?:Ltd|Inc|Co|GmbH|AG|Hotel|Street|Road|Avenue|Square|Hall|Bridge|University|College|Hospital|Airport|Station|Company|Bank|Museum|Park)\b)")
_OTHER_BEFORE = re.compile(r"(?:\b(?:ship|steamer|schooner|Dampfer|vapeur|Firma|maison|hotel|Hotel|the|The|Messrs\.?|company|village|town|city|river|Lake|Mount|racehorse|mare|horse|dog|cat|&)\s)\Z")

#: Features of a candidate; their number is fixed.
N_OPEN = 34


def _plain(word: str) -> str:
    """A word with look-alike letters mapped to one, so that misread words are known too."""
    return alike(word).replace("RN", "M")


_PLACE_FORMS = {_plain(w) for w in _PLACES | set("postfach boîte page seite lot box gebr cheap why klavierstunden mark".split())}


def _shape(text: str) -> list[float]:
    digits = sum(c.isdigit() for c in text)
    return [len(text), digits, text.count(" ") + text.count("\n"), text.count("-"), text.count("."), sum(c.isupper() for c in text), float(text.isupper())]


@lru_cache(maxsize=8)
def _forms_of(words: frozenset[str]) -> frozenset[bytes]:
    return _forms(words)


def _places(s: str, form: bytes) -> list[tuple[int, int]]:
    """Where a word begins and ends in a text; one with a letter beyond Latin-1 has no place."""
    word, out = form.decode("latin-1"), []
    at = s.find(word)
    while at >= 0:
        end = at + len(word)
        if not (at and (s[at - 1].isalnum() or s[at - 1] == "_")) and not s[end : end + 1].isalnum():
            out.append((at, end))
        at = s.find(word, end)
    return out


def open_candidates(s: str, given: set[str] = frozenset(), family: set[str] = frozenset(), taken: list[tuple[str, int, int]] = ()) -> list[tuple[str, int, int, list[float]]]:
    """Proposed spans of a text in any form: kind, start, end, features.

    Words that begin or end a form are found as a set; patterns are tried only at their places,
    and not inside spans that are ``taken`` already.
    """
    found: dict[tuple[str, int, int], tuple[int, bool]] = {}
    starts = sorted((a, b) for _, a, b in taken)

    def free(a: int, b: int) -> bool:
        at = bisect_left(starts, (b, 0)) - 1
        return at < 0 or starts[at][1] <= a

    def add(kind: str, a: int, b: int, form: int, title: bool = False) -> None:
        if free(a, b):
            found.setdefault((kind, a, b), (form, title))

    spread = s.encode("latin-1", "replace").translate(_SPLIT)
    words, given_forms = set(spread.split()), _forms_of(frozenset(given))
    if "@" in s:
        for m in re.finditer("@", s):
            left, right = _EMAIL_LEFT.search(s, max(0, m.start() - 320), m.start()), _EMAIL_RIGHT.match(s, m.end())
            if left and right:
                add("email", left.start(), right.end(), 0)
    for m in _PHONE.finditer(s):
        at = m.start()
        for back in (1, 2, 3, 4, 5, 6):
            if s[at - 1 : at] == "(" or s[at - 1 : at] == "+" or (s[at - 1 : at].isdigit()) or (s[at - 1 : at] in " .-" and s[at - 2 : at - 1].isdigit() and "+" in s[max(0, at - 5) : at]):
                at -= 1
            else:
                break
        x = _PHONE_WHOLE.match(s, at) or _PHONE_WHOLE.match(s, m.start())
        if x:
            add("phone", x.start(), x.end(), 1)
    if not _LABEL_FORMS.isdisjoint(spread.lower().split()):
        for m in _IDENTITY.finditer(s):
            add("identity", *m.span("v"), 2)
    for w in words & _STREET_FORMS:
        for at, end in _places(s, w):
            m = _EN_LEFT.search(s, max(0, at - 90), at)
            if m:
                add("address", m.start(), end + (s[end : end + 1] == "." and len(w) <= 4), 3)
    for w in words & _FR_FORMS:
        for at, end in _places(s, w):
            left = _FR_LEFT.search(s, max(0, at - 14), at)
            right = _FR_RIGHT.match(s, end) if left else None
            if right:
                add("address", left.start(), right.end(), 4)
    for w in words & _DE_BEGINS:
        for at, _ in _places(s, w):
            m = _DE_PREFIXED.match(s, at)
            if m:
                add("address", at, m.end(), 5)
    for w in words:
        if w.endswith(_DE_SUFFIXES):
            for at, end in _places(s, w):
                m = _DE_AFTER.match(s, end)
                if m and s[at].isupper():
                    add("address", _DE_LEFT.search(s, max(0, at - 50), at).start() if s[at - 1 : at] in ("-", " ") else at, m.end(), 5)
    for w in words & _TITLE_FORMS:
        for _, end in _places(s, w):
            m = _TITLED.match(s, end)
            if m:
                add("name", *m.span("v"), 6, True)
    for w in words & _LETTERS:
        for at, _ in _places(s, w):
            m = _INITIALS.match(s, at) if s[at - 2 : at - 1] != "." or not at else None
            if m:
                add("name", *m.span("v"), 7)
    for w in words & (_GIVEN_FORMS | given_forms):
        for at, _ in _places(s, w):
            m = _RUN.match(s, at)
            if m:
                add("name", *m.span("v"), 8)
    for w in words & _LEAD_FORMS:
        for _, end in _places(s, w):
            m = _RUN.match(s, end + 1)
            if m:
                add("name", *m.span("v"), 9)
    return [(kind, a, b, _features(s, a, b, form, title, given, family)) for (kind, a, b), (form, title) in sorted(found.items(), key=lambda x: x[0][1:])]


def _features(s: str, start: int, end: int, form: int, title: bool, given: set[str], family: set[str]) -> list[float]:
    inside, left, right = s[start:end], s[max(0, start - 24) : start], s[end : end + 24]
    words = [w.strip(".") for w in inside.replace("\n", " ").split()]
    low = [_plain(w) for w in words]
    before_word, after_word = (left.split() or [""])[-1].strip(",;:("), (right.split() or [""])[0].strip(",.;:)")
    before, after = before_word.lower(), after_word.lower()
    ends = left.rstrip()[-1:]
    tail = inside.rsplit(".", 1)[-1]
    return [
        float(form), float(title), *_shape(inside), len(words),
        float(words[0] in _GIVEN), float(words[0] in given), float(words[-1] in family or words[-1] in given), float(any(w in family for w in words)),
        sum(w in _PLACE_FORMS for w in low), float(low[0] in _PLACE_FORMS), float(low[-1] in _PLACE_FORMS), sum(len(w) == 1 for w in words),
        float(before in _BEFORE), float(after in _VERBS), float(ends in ".!?" or not ends), float(ends in ",;:("), float(right[:1] in ",.;:)"), float(bool(_OTHER_AFTER.match(right))),
        float(bool(_OTHER_BEFORE.search(left))), float(_plain(before_word) in _PLACE_FORMS), float(_plain(after_word) in _PLACE_FORMS), float(right[:1] == "'" or right[:1] == "’"),
        float(len(tail)), float("@" in inside), float(inside[:1] == "+"), float(inside[:1] == "("), float(after in ("houses", "men", "people", "days", "years", "percent", "pm", "am", "o'clock")),
    ]
