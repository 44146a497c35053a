"""Problem 8: personal information inside free text.

Generators with high recall propose overlapping spans of five kinds. Boosted trees score each
from its format and its context, calibrated thresholds decide, and of overlapping spans the
likelier, then the longer one stays. Placeholders replace what is left.

The trees were fitted by ``train_pii.py``; ``pii_model.json`` holds them. Those of the second
set of generators, for ordinary text, are in ``open_forms.py``.
"""

from __future__ import annotations

import json
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.gbt import BoostedTrees
from brindle.llm.layout import Reading, alike, reading
from brindle.llm.open_forms import open_candidates
from brindle.sources.shared import ship_code

KINDS = ("email", "phone", "identity", "address", "name")
#: A directory of names is read to the driver; a larger one is refused.
MAX_DIRECTORY = 100_000

#: So many documents' candidates are held at a time.
DOCS_AT_ONCE = 1000

def _word(w: str) -> str:
    """A pattern for a word in ``alike`` text; m may be read as rn, rn as m, ß printed as SS."""
    parts = (re.escape(alike(x)).replace("M", "(?:M|RN)") for x in re.split("[rR][nN]", w))
    return "(?:M|RN)".join(parts).replace("ẞ", "(?:ß|ẞ|SS)").replace("ß", "(?:ß|SS)")


def _any(words: str) -> str:
    return "(?:" + "|".join(_word(w) for w in sorted(words.split(), key=len, reverse=True)) + ")"


TITLES = "mr mrs miss ms dr rev capt sgt ald cllr prof col maj lt sir lady herr frau frl fräulein oberlehrer pfarrer baron graf prof schwester pater m mme mlle me monsieur madame mademoiselle maître docteur abbé father sister lord"
PARTICLES = "van von de du der den zu del della di le la ten ter zur zum"
FIRM_BEFORE = "messrs maison firma gebr veuve gebrüder"
FIRM_AFTER = "bros brothers sons söhne fils cie co company ltd"
STREET_EN = "street st road rd avenue ave lane square sq terrace hill row place pl court ct drive crescent gardens close"
STREET_FR = "rue quai boulevard bd bvd avenue av place pl impasse chemin cours allée square passage ruelle route"
STREET_DE = "straße strasse str weg platz gasse allee damm ufer ring graben steig"
DIRECTIONS = "north south east west upper lower"
_TITLE_SET = {alike(w) for w in TITLES.split()}
_PARTICLE_SET = {alike(w) for w in PARTICLES.split()}
#: Words in capitals that begin sentences and are no given names.
NO_GIVEN = {alike(w) for w in "the a an at of and by to for in on with from it who this that present were evidence claim born photograph telephones signed behalf prize late chairman der die das den dem ein eine und zu an mit von aus bei nach le la les un une et des au aux en est sont avec par pour feu ring tel tél nr no members visitors page box order wanted lost found reward apply letters write piano lessons why suffer finest cheap account certificate lot und sich preis vorsitzende gezeichnet verstorben anwesend schreiben hilfe gesucht verloren belohnung signé président prix présents étaient revient perdu récompense leçons écrire demande mariage messrs gebr maison veuve firma steamer dampfer vapeur jument gazette board works lord mayor show fair hotel royal post".split()} | _TITLE_SET

_FAMILY_SPLIT = range(2, 8)


class Directory:
    """Name parts: given names, and the stems and endings that family names are made of."""

    def __init__(self, rows: list[tuple[str | None, str | None]], learned_given: list[str] = ()):
        given = {p for p, r in rows if p and r == "given"}
        family = sorted({p for p, r in rows if p and r == "family"})
        self.given = {alike(g) for g in given}
        self.learned = {alike(g) for g in learned_given}
        self.family = {alike(f) for f in family}
        heads, tails = Counter(), Counter()
        for f in family:
            for k in _FAMILY_SPLIT:
                if 3 <= k <= len(f) - 2:
                    heads[f[:k]] += 1
                    tails[f[k:]] += 1
        # each name's cut whose two sides are both shared with most other names
        cuts: list[tuple[str, str]] = []
        for f in family:
            best = max(((min(heads[f[:k]], tails[f[k:]]), tails[f[k:]], k) for k in _FAMILY_SPLIT if 3 <= k <= len(f) - 2), default=(0, 0, 0))
            if best[0] >= 3:
                cuts.append((f[: best[2]], f[best[2] :]))
        ends = Counter(e for _, e in cuts)
        self.ends = {e for e, n in ends.items() if n >= 3}
        self.stems = {x for x, e in cuts if e in self.ends}
        end = "|".join(_word(e) for e in sorted(self.ends, key=len, reverse=True))
        made = [f"{_word(x)}(?:{end})" for x in sorted(self.stems, key=len, reverse=True)]
        # an rn that the cut parts may be read as m too
        after_n = "|".join(_word(e[1:]) for e in sorted(self.ends, key=len, reverse=True) if e[0] in "nN")
        made += [f"{_word(x[:-1])}M(?:{after_n})" for x in sorted(self.stems, key=len, reverse=True) if after_n and x[-1] in "rR"]
        rest = [_word(f) for f in family if not any(f.startswith(x) for x in self.stems)]
        #: Only names made of a known stem and ending, without the directory's other words.
        self.made = re.compile("|".join(made) or "(?!)")
        # Grouped by first letter, whose class stands first: the matcher searches for it quickly.
        groups: dict[str, list[str]] = {}
        for p in made + rest:
            for q in ([p.replace("(?:M|RN)", "M", 1), p.replace("(?:M|RN)", "RN", 1)] if p.startswith("(?:M|RN)") else [p]):
                if q[0].isalpha():
                    groups.setdefault(q[0], []).append(q[1:])
        if not groups:
            self.pattern = re.compile("(?!)")
            return
        one = f"[{''.join(groups)}](?<![^\\W\\d_].)(?:" + "|".join(f"(?<={c})(?:{'|'.join(g)})" for c, g in groups.items()) + ")"
        again = "(?:" + "|".join(made + rest) + ")"
        # a double name's second part may begin on the next line
        self.pattern = re.compile(rf"{one}(?:-\s?{again})?(?![^\W\d_])")


#: A digit as printed or misread.
D = "[0-9OoQIlSZBbg]"
# The first character's class stands first, which the matcher searches for quickly.
_NUMBER = re.compile(rf"[+(0-9OoQIlSZBbg](?<![\w£$,].)(?:(?<=\d)|(?=[+(OoQIlSZBbg]{{0,3}}\d))(?:(?<![+(])|[+(]?{D})(?:[ .\-/()]{{0,2}}{D})*")
_REAL = re.compile(r"\d")
#: Printed forms of telephone numbers; a line break may stand in for a blank.
PHONES = [
    rf"\+\s?{D}{{1,2}}[\s-]{D}{{1,4}}(?:[\s-]{D}{{2,5}}){{2,5}}",
    rf"00{D}{{2}}-{D}{{2,3}}-{D}{{3,6}}-{D}{{2,4}}",
    rf"\({D}{{3,5}}\)\s{D}{{3,5}}[\s-]{D}{{3,4}}",
    rf"\({D}\)\s{D}{{2}}\.{D}{{2}}\.{D}{{2}}\.{D}{{2}}",
    rf"[0OoQ][1Il]\.?(?:\s?{D}{{2}}[\s.]?){{3}}{D}{{2}}",
    rf"[0OoQ]{D}{{2,4}}[\s/]{D}{{3,8}}(?:\s{D}{{3,4}})?",
    rf"{D}{{3}}\.{D}{{3}}\.{D}{{4}}",
    rf"[5S][5S][5S]-?{D}{{4}}",
    rf"{D}{{2}}[\s-]{D}{{2,3}}",
    rf"{D}{{3,4}}",
]
_PHONES = [re.compile(p + r"(?!\w)") for p in PHONES]
#: A number may hang on words: exchange names in print.
_EXCHANGE = re.compile(r"(?<!\w)[A-Z]{1,2}[a-zſ]{2,}\s\Z")
_PHONE_FORM = re.compile("(?:" + "|".join(f"({p})" for p in PHONES[:8]) + r")(?!\w)")
#: Printed forms of personal numbers.
IDENTITIES = [
    rf"[A-Z]{{2}}\s?{D}{{2}}\s?{D}{{2}}\s?{D}{{2}}\s?[A-D0O](?!\w)",
    rf"{D}{{3}}[\s-]{D}{{2}}[\s-]{D}{{4}}(?!\w)",
    rf"{D}{{2}}\s?{D}{{6}}\s?[A-Z0]\s?{D}{{3}}(?!\w)",
    rf"[A-Z]\s?{D}{{3}}\s?{D}{{3}}\s?{D}{{3}}(?!\w)",
    rf"[A-Z]{D}{{4}}-?\s?{D}{{4}}(?!\w)",
    rf"[12IlZ]\s?{D}{{2}}\s?{D}{{2}}\s?{D}{{2}}\s?{D}{{3}}\s?{D}{{3}}(?:\s?{D}{{2}})?(?!\w)",
]
_IDENTITIES = [re.compile(p) for p in IDENTITIES]
_IDENTITY_FORM = re.compile("|".join(f"({p})" for p in IDENTITIES))
_IDENTITY_START = re.compile(rf"[A-Z0-9olbg](?<![\w£$].)(?:(?<=[A-Z])[A-Z]?\s?{D}(?:[\s-]?{D}){{4}}|(?<={D})(?:[\s-]?{D}){{4}})")
_LABEL = r"[A-Za-z0-9ſ](?:[\w-]*[A-Za-z0-9ſ])?"
_EMAIL_AT = re.compile(r"[@©®(\[](?:(?<=[@©®])|\s?(?:at|ot|af|a)\s?[)\]])")
_EMAIL_DOT = re.compile(r"\s(?:d[o0]t|punkt|point|dof)\s")
_LOCAL = re.compile(r"[A-Za-z0-9][\w.+%-]*\Z")
_LOCAL_AT = re.compile(rf"[A-Za-z0-9][\w.+%-]*\s(?:at|ot|af)\s{_LABEL}\Z")
_DOMAIN = re.compile(rf"{_LABEL}(?:(?:\.\s?|\s(?:dot|punkt|point)\s){_LABEL})+")
_DOMAIN_WORDS = re.compile(rf"(?:\s(?:d[o0]t|punkt|point|dof)\s{_LABEL})+")


def _email_spans(s: str) -> Iterator[tuple[int, int, int]]:
    for m in _EMAIL_AT.finditer(s):
        # one blank may stand on either side
        a, b = m.start() - (s[m.start() - 1 : m.start()].isspace()), m.end() + s[m.end() : m.end() + 1].isspace()
        left, right = _LOCAL.search(s, max(0, a - 64), a), _DOMAIN.match(s, b)
        if left and right:
            yield left.start(), right.end(), 0
    seen = -1
    for m in _EMAIL_DOT.finditer(s):
        left = _LOCAL_AT.search(s, max(0, m.start() - 96), m.start()) if m.start() >= seen else None
        right = _DOMAIN_WORDS.match(s, m.start()) if left else None
        if right:
            seen = right.end()
            yield left.start(), seen, 1


_TLD = {alike(w) for w in "example test invalid com org net de fr uk".split()}
_HOUSE = rf"(?<![\w£$.,:/]){D}{{1,3}}(?:\s?[A-Da-d](?!\w))?(?:\sb[il1]s(?!\w))?"
_EN_ADDRESS = re.compile(rf"({_HOUSE}),?\s((?:[A-Z][\w'-]+\s)?[A-Z][\w'-]+\s[A-Z][\w]*)(\.?)")
_FR_ADDRESS = re.compile(rf"({_HOUSE}),?\s([A-Za-zéÉ]+\.?\s(?:(?:de la|du|des|de l'|de l’|de|d'|DE LA|DU|DES|DE L'|DE)[\s-]?\s?)?[A-ZÀ-Þ5][\w'-]+)")
_DE_NAME = r"(?:(?:Am|An der|An den|Im|In der|Auf dem|Auf der|Zum|Zur|AM|AN DER|IM)\s(?:[A-ZÀ-Þ][\w-]+\s)?[A-ZÀ-Þ][\w-]+)|[A-ZÀ-Þ5][\w-]{3,}\.?"
_DE_ADDRESS = re.compile(rf"({_DE_NAME})\s(?:N[rR]\.\s)?({D}{{1,3}}(?:\s?[A-Da-d](?!\w))?)(?!\w)")
_DE_STREET = re.compile(rf"(?<![\w-])(?:{_DE_NAME})\s(?:N[rR]\.\s)?\Z")
_HOUSE_TOKEN = re.compile(r"[\dOolISZBbg](?<![\w£$.,:/].)(?:(?<=\d)|[OolISZBbg]?\d)[\dOolISZBbg]{0,2}(?=\s?[A-Da-d]?(?!\w))")
_STREET_EN = re.compile(rf"{_any(STREET_EN)}\Z")
_STREET_FR = re.compile(rf"{_any(STREET_FR)}(?!\w)")
_STREET_DE = re.compile(rf"{_any(STREET_DE)}\.?\Z")
_DIRECTION = re.compile(rf"{_any(DIRECTIONS)}\s")
_LEFT_TOKEN = re.compile(r"(?:([^\W\d_]\.)|([^\W\d_][\w'’]*(?:-[^\W\d_]\w*)?\.?))\Z")
_FIRST_AFTER = re.compile(r",\s((?:[^\W\d_]\.|[A-ZÀ-Þ015][\w'-]+))(?:\s([^\W\d_]\.))?")

#: A cue begins a word of its own: "Ring" is one, the end of "spring" is none.
_W = r"(?<![^\W\d_])"
_CUE_PHONE = re.compile(rf"{_W}(?:{_any('ring tel tél fernruf telephone telefon telephones rufe appeler renseignements answers phone call téléphone erreichbar')}[.:]*(?:\s{_any('le au to on unter an')})?\s*|WEEKLY\.\s*|[NO]ND\s)\Z")
_CUE_IDENTITY = re.compile(rf"{_W}{_any('identity pass insurance ration holder ausweis versicherungsnummer assuré social porteur personalausweis kennkarte passeport passport identité number security carte reisepass')}(?![^\W\d_])[^;]{{0,16}}\Z")
_CUE_REFERENCE = re.compile(rf"{_W}{_any('marked account certificate order marque zeichen box postfach boîte lot page seite nr')}[.,]?(?:\s{_any('no nr')}[.,]?)?\s?\Z")
_CUE_ADDRESS = re.compile(rf"(?:{_W}{_any('at behind to removed hinter frei besichtigen adresser visible le derrière')}|,|:)\s(?:NO\.\s|{_word('flat')}\s.,\s)?\Z")
_CUE_NAME = re.compile(rf"(?:{_W}{_any('by to for were and late chairman photograph signed prize an ist sich gezeichnet anwesend président revient signé présents de avec feu that was und bei piano à zu')}|[(:;,.])\s?\Z")
_CUE_SHIP = re.compile(rf"{_W}{_any('steamer dampfer vapeur jument ship schiff navire')}\s\Z")
#: Capitalised words before a number that are no exchange.
_NO_EXCHANGE = {alike(w) for w in "lot box order account nr no page seite zeichen flat boîte postfach marque applications certificate".split()}
_MONTH = {alike(w) for w in "january february march april may june july august september october november december januar februar märz mai juni juli oktober dezember janvier février mars avril juin juillet août septembre octobre novembre décembre fr mark ellen uhr jours passagers houses häuser maisons charges fuhren tage days hours".split()}
_AFTER_WORD = re.compile(r"\s*([^\s]+)")
_FIRM_AFTER_RE = re.compile(rf"\s(?:&\s|{_any('and et und')}\s)?{_any(FIRM_AFTER)}(?!\w)")
_FIRM_BEFORE_RE = re.compile(rf"(?:{_any(FIRM_BEFORE)}[.]?[\s-]\s?)\Z")
_STREET_AFTER = re.compile(rf"\s{_any(STREET_EN)}(?!\w)")

N_FEATURES = 36


def _common(s: str, a: str, start: int, end: int) -> list[float]:
    """Features that all kinds share."""
    inside = s[start:end]
    prev, nxt = s[start - 1 : start], s[end : end + 1]
    after = _AFTER_WORD.match(a, end)
    word = after[1].strip(".,;:") if after else ""
    digits = len(_REAL.findall(inside))
    return [
        end - start, digits, inside.count("\n"), inside.count(" "), float(inside.isupper()),
        float(not prev or prev.isspace()), float(prev == "("), float(nxt in ".,;:)"), float(nxt == "\n" or not nxt),
        float(bool(word) and word in _MONTH), float(inside[:1].isdigit()), inside.count("."), inside.count("-"), inside.count(","),
    ]


def _emails(s: str, a: str, out: list) -> None:
    for start, end, k in _email_spans(s):
        labels = re.split(r"\.\s?|\s(?:d[o0]t|punkt|point|dof)\s", s[start:end])
        # the sentence after a full stop is no part of the domain: propose each cut
        cuts, stop = [end], end
        for label in reversed(labels[1:]):
            stop = s.rfind(label, start, stop)
            before = stop
            while before > start and (s[before - 1].isspace() or s[before - 1] == "."):
                before -= 1
            if k == 1 or s[before:stop].count("\n") + s[before:stop].count(" ") == 0:
                if k == 1:
                    break
                continue
            cuts.append(before)
        for c in cuts:
            if c - start < 6:
                continue
            last = re.split(r"[.\s@\])]+", s[start:c])[-1]
            tld = alike(last)
            domain = re.split(r"[@©®]|\bat\b|\)|\]", s[start:c])[-1]
            out.append(("email", start, c, _common(s, a, start, c) + [float(tld in _TLD), float(any(x in s[start:c] for x in "@©®")), float(k), float(c == end), len(re.findall(r"\.|\sd.t\s", domain)), len(last), float(last.isalpha())]))


def _cues(a: str, start: int) -> list[float]:
    left = a[max(0, start - 40) : start]
    return [float(bool(_CUE_PHONE.search(left))), float(bool(_CUE_IDENTITY.search(left))), float(bool(_CUE_REFERENCE.search(left)))]


def _numbers(s: str, a: str, families: list[tuple[int, int]], out: list) -> None:
    ends = {e for _, e in families}
    spans: dict[tuple[int, int], int] = {}
    id_spans: dict[tuple[int, int], int] = {}
    for m in _NUMBER.finditer(s):
        start, end = m.span()
        # a word of look-alike letters behind the number is none of its digits
        while s[end - 1].isalpha() and (cut := s.rfind(" ", start, end)) > start and not _REAL.search(s, cut, end):
            end = cut
        size = end - start
        if size < 3 and s[end : end + 1] not in ("\n", " "):
            continue
        x = _PHONE_FORM.match(s, start) if size > 6 or size < 4 or s[end : end + 1] in ("\n", ")") else None
        if x:
            spans[start, x.end()] = x.lastindex - 1
            line = s.find("\n", start, x.end())
            if line - start >= 7:  # the line may end the number
                spans[start, line] = x.lastindex - 1
        if size < 8:
            left = a[max(0, start - 28) : start]
            if left[-1:] not in (" ", "\n", ":", "."):
                continue
            exchange = _EXCHANGE.search(s, max(0, start - 24), start) if size in (3, 6) else None
            if exchange and (size == 3 or s[start + 1] == "-") and a[exchange.start() : exchange.end() - 1] not in _NO_EXCHANGE:
                spans[exchange.start(), end] = 20 if exchange[0][1].isupper() else 21
            if left[-2:-1] in (",", ".") or _CUE_PHONE.search(left):
                for k in (8, 9):
                    x = _PHONES[k].match(s, start)
                    if x:
                        spans.setdefault((start, x.end()), k)
    for at in _IDENTITY_START.finditer(s):
        m = _IDENTITY_FORM.match(s, at.start())
        if m and len(_REAL.findall(m[0])) >= 5:
            id_spans[m.span()] = m.lastindex - 1
    longest: dict[int, int] = {}
    for st, e in spans:
        longest[st] = max(longest.get(st, 0), e)
    for (start, end), k in spans.items():
        flags = [0.0] * 5
        cue = _cues(a, start)
        before = s[max(0, start - 2) : start]
        ad = float(before in (", ", ",\n") and (start - 2) in ends)
        or_mail = float(bool(re.match(r"\sor\s\S*@|\sor\s\S+\s?[(\[]?at", s[end : end + 40])))
        out.append(("phone", start, end, _common(s, a, start, end) + cue + [float(k), ad, or_mail, float(longest[start] == end), float("555" in s[start:end].replace("S", "5")), float(s[start] == "+"), float(s[start] == "("), float(s[start] in "0OoQ"), len(re.findall(D, s[start:end]))] + flags[:1]))
    for (start, end), k in id_spans.items():
        cue = _cues(a, start)
        out.append(("identity", start, end, _common(s, a, start, end) + cue + [float(k), len(re.findall(D, s[start:end])), sum(c.isupper() for c in s[start:end])]))


def _addresses(s: str, a: str, out: list) -> None:
    def add(start: int, end: int, form: float, street: float, direction: float, letter: float) -> None:
        cue = float(bool(_CUE_ADDRESS.search(a[max(0, start - 16) : start])))
        out.append(("address", start, end, _common(s, a, start, end) + [form, street, direction, letter, cue]))

    tokens = [m.span() for m in _HOUSE_TOKEN.finditer(s)]
    for m in filter(None, (_EN_ADDRESS.match(s, x) for x, _ in tokens)):
        words, at = m[2].split(), m.start(2)
        letter = float(m[1][-1].isalpha())
        # the street's type may be the second or third word
        for n in range(2, len(words) + 1):
            body = re.match(rf"(?:\S+\s){{{n - 1}}}\S+", s[at : m.end(2)])
            if not body:
                continue
            end = at + body.end()
            street = a[at:end]
            if _STREET_EN.search(street.split()[-1]) and street.split()[-1] == _STREET_EN.search(street.split()[-1])[0]:
                stop = s[end : end + 1] == "." and len(street.split()[-1]) <= 3
                add(m.start(), end + stop, 0.0, 1.0, float(bool(_DIRECTION.match(street))), letter)
    for m in filter(None, (_FR_ADDRESS.match(s, x) for x, _ in tokens)):
        kind = a[m.start(2) : m.end(2)].split()[0].strip(".")
        hit = _STREET_FR.match(kind)
        if hit and hit.end() == len(kind):
            add(m.start(), m.end(), 1.0, 1.0, 0.0, float(m[1][-1].isalpha()))
    for x, _ in tokens:
        word = s[max(0, x - 40) : x].split()
        word = word[-2] if len(word) > 1 and word[-1] in ("Nr.", "NR.") else word[-1] if word else ""
        if len(word) < 3 or not (word[0].isupper() or word[0] == "5") or word[-1] in ",:;)":
            continue
        left = _DE_STREET.search(s, max(0, x - 60), x)
        m = _DE_ADDRESS.match(s, left.start()) if left else None
        if m and m.start(2) == x:
            words = m[1].split()
            hit = _STREET_DE.search(a[m.start(1) : m.end(1)].split()[-1])
            street = float(bool(hit and hit.start() > 2))
            if street or (len(words) > 2 and words[0].lower() in ("am", "an", "im", "in", "auf")):
                add(m.start(), m.end(), 2.0, street, float(len(words)), float(m[2][-1].isalpha()))


def _left_tokens(s: str, a: str, at: int, most: int = 6) -> list[tuple[int, int]]:
    """The words before ``at``, nearest first, as far as blanks and newlines part them."""
    out = []
    while len(out) < most:
        stop = at
        while stop > 0 and s[stop - 1] in " \n\t":
            stop -= 1
        if stop == at or at - stop > 2:
            break
        m = _LEFT_TOKEN.search(s, max(0, stop - 24), stop)
        if not m:
            break
        out.append((m.start(), stop))
        at = m.start()
    return out


def _token_type(s: str, a: str, start: int, end: int, d: Directory) -> int:
    """0 other, 1 initial, 2 given in the directory, 3 learned given, 4 title, 5 capitalised, 6 particle."""
    word = a[start:end].rstrip(".")
    if end - start == 2 and s[end - 1] == ".":
        return 1 if s[start].isupper() else 0
    if word in _TITLE_SET and (s[end - 1] == "." or len(word) > 1 or s[start:end] == "M"):
        return 4
    if s[end - 1] == ".":
        return 0
    if word in _PARTICLE_SET and s[start].islower() or word in _PARTICLE_SET and s[start:end].isupper() and len(word) > 1:
        return 6
    if not (s[start].isupper() or s[start] in "015"):
        return 0
    if word in d.given:
        return 2
    if word in d.learned:
        return 3
    return 5 if word not in NO_GIVEN and len(word) > 1 and not word.isdigit() else 0


_ANSWERED = re.compile(r"\s\w\s\w{2}P\wN\w{2}(?!\w)")


def _left_types(s: str, a: str, f0: int, f1: int, d: Directory, most: int = 6) -> tuple[list[tuple[int, int]], list[int]]:
    """The words before a family name and their types; ``M.`` is a title before other given
    parts, and before a family name of whom is told what they answered."""
    tokens = _left_tokens(s, a, f0, most)
    types = [_token_type(s, a, x, y, d) for x, y in tokens]
    capitals = s[f0:f1].isupper()
    for i, (x, y) in enumerate(tokens):
        headline = s[x:y].isupper() and not capitals or (capitals and types[i] == 5 and "\n" in s[y : y + 2])
        if types[i] in (2, 3, 5) and headline:
            types[i] = 0
        if s[x:y] == "M." and ((i and types[i - 1] in (1, 2, 3, 5)) or (all(t == 6 for t in types[:i]) and _ANSWERED.match(a, f1))):
            types[i] = 4
    return tokens, types


def _given_run(s: str, tokens: list[tuple[int, int]], types: list[int], first: int, ends: set[int], most: int = 4) -> int:
    """How far the given names before a family name reach; those that follow another family
    name and a comma belong to that one."""
    run = first
    while run < len(types) and types[run] in (1, 2, 3, 5) and run - first < most:
        run += 1
    for k in range(first, run):
        x = tokens[k][0]
        if s[x - 1 : x] in (" ", "\n") and s[x - 2 : x - 1] == "," and x - 2 in ends:
            return max(first, k - 1 if k and types[k - 1] == 1 else k)
    return run


def _names(s: str, a: str, families: list[tuple[int, int]], d: Directory, out: list) -> None:
    ends = {e for _, e in families}
    for f0, f1 in families:
        if not (s[f0].isupper() or s[f0] in "015"):
            continue
        tokens, types = _left_types(s, a, f0, f1, d)
        known = a[f0:f1] in d.family
        firm_after = float(bool(_FIRM_AFTER_RE.match(a, f1)))
        street_after = float(bool(_STREET_AFTER.match(a, f1)))
        possessive = float(s[f1 : f1 + 2] in ("'s", "’s"))
        double = float("-" in s[f0:f1])
        i = 0
        while i < len(types) and types[i] == 6 and i < 3:
            i += 1
        n_particles, first = i, i
        run = _given_run(s, tokens, types, first, ends)
        starts = {0: f0}
        if n_particles:
            starts[1] = tokens[n_particles - 1][0]
        for k in range(first, run):
            starts[2 + k - first] = tokens[k][0]
        for form, start in starts.items():
            used = [types[k] for k in range(first, first + form - 1)] if form >= 2 else []
            left_at = (first + form - 1) if form >= 2 else (n_particles if form == 1 else 0)
            left_type = types[left_at] if left_at < len(types) else -1
            left = a[max(0, start - 14) : start]
            extra = [
                0.0, float(form), float(n_particles), sum(t == 1 for t in used), sum(t == 2 for t in used), sum(t == 3 for t in used), sum(t == 5 for t in used),
                float(left_type), float(known), double, firm_after, float(bool(_FIRM_BEFORE_RE.search(left))), street_after, possessive,
                float(bool(_CUE_SHIP.search(left))), float(bool(_CUE_NAME.search(left))), float(used[-1] if used else 0), float(left[-2:-1] == "&"),
                float(s[max(0, start - 1) : start] in ("@", ".", "-", "_") and s[max(0, start - 2) : start - 1].isalnum()), float(s[f1 : f1 + 1] in "@_"),
                float(bool(re.match(r",?\s(?:[^\W\d_]\.|[A-ZÀ-Þ][\w-]+)\s?[;.]", s[f1 : f1 + 30])) and form == 0),
            ]
            out.append(("name", start, f1, _common(s, a, start, f1) + extra))
        # family name first
        m = _FIRST_AFTER.match(s, f1)
        if m:
            for group in (1, 2):
                if not m[group] or (group == 2 and not m[2]):
                    continue
                kinds = [_token_type(s, a, *m.span(g), d) for g in range(1, group + 1)]
                if kinds[0] in (0, 4, 6):
                    continue
                left_type = types[0] if types else -1
                left = a[max(0, f0 - 24) : f0]
                end = m.end(group)
                extra = [
                    1.0, float(group), float(n_particles), sum(t == 1 for t in kinds), sum(t == 2 for t in kinds), sum(t == 3 for t in kinds), sum(t == 5 for t in kinds),
                    float(left_type), float(known), double, firm_after, float(bool(_FIRM_BEFORE_RE.search(left))), street_after, 0.0,
                    0.0, float(bool(re.search(r"[:;]\s\Z", left)) or bool(_CUE_NAME.search(left))), float(bool(re.match(r"\s?;", s[end : end + 2])) * 2 + bool(re.match(r"\s?\.", s[end : end + 2])) + 4 * bool(re.search(r"(?:[:;]|WERE)\s?\Z", left))),
                    float(bool(m[2]) and group == 1), 0.0, float(s[end : end + 1].isalnum()), float((f1 in ends)),
                ]
                out.append(("name", f0, end, _common(s, a, f0, end) + extra))


def candidates(s: str, d: Directory) -> list[tuple[str, int, int, list[float]]]:
    """Proposed spans of a text in reading order: kind, start, end, features."""
    out: list = []
    if not s or s.isspace():
        return out
    a = alike(s)
    families = [m.span() for m in d.pattern.finditer(a)]
    if s:
        _emails(s, a, out)
    _numbers(s, a, families, out)
    _addresses(s, a, out)
    _names(s, a, families, d, out)
    return out


def resolve(spans: list[tuple[float, str, int, int]], over: list[tuple[str, int, int]] = ()) -> list[tuple[str, int, int]]:
    """Of overlapping spans the likelier (to one place), then the longer, then the first; none
    that overlaps one of ``over``, which stay. A search in the sorted list of what is taken."""
    taken = sorted((a, b, kind) for kind, a, b in over)
    for _, kind, a, b in sorted(spans, key=lambda x: (-(x[1] == "email"), -round(x[0], 1), x[2] - x[3], x[2], x[1])):
        at = bisect_left(taken, (a, b, kind))
        if (at == 0 or taken[at - 1][1] <= a) and (at == len(taken) or taken[at][0] >= b):
            taken.insert(at, (a, b, kind))
    return [(kind, a, b) for a, b, kind in taken]


class Detector:
    """The fitted models of all kinds, with the directory of a corpus.

    Two sets of generators and trees: one for the printed forms of a corpus with a directory of
    names, one for forms of ordinary text (``open_forms``). Spans of the second set stay where
    they overlap none of the first.
    """

    def __init__(self, directory: list[tuple[str | None, str | None]], model: dict, open_model: dict | None = None):
        self.directory = Directory(directory, model["given"])
        self.models = {k: BoostedTrees.from_dict(m) for k, m in model["kinds"].items()}
        self.open_models = {k: BoostedTrees.from_dict(m) for k, m in open_model["kinds"].items()} if open_model else {}
        self.given = frozenset(p for p, r in directory if p and r == "given") | frozenset(model["given"])
        self.family = frozenset(p for p, r in directory if p and r == "family")

    @staticmethod
    def _scored(pages: list, propose, models: dict) -> list[list[tuple[float, str, int, int]]]:
        rows = {k: ([], [], []) for k in KINDS}
        for i, page in enumerate(pages):
            for kind, a, b, f in propose(i, page.text) if page else ():
                ids, at, feats = rows[kind]
                ids.append(i)
                at.append((a, b))
                feats.append(f)
        kept: list[list] = [[] for _ in pages]
        for kind, (ids, at, feats) in rows.items():
            if ids:
                p = models[kind].predict(np.array(feats, np.float32))
                for j in np.flatnonzero(p >= models[kind].threshold):
                    kept[ids[j]].append((float(p[j]), kind, *at[j]))
        return kept

    def primary(self, page: str) -> list[tuple[str, int, int]]:
        """What the first set finds in a page in reading order."""
        return resolve(self._scored([Reading(page, [0], [0], page)], lambda i, s: candidates(s, self.directory), self.models)[0])

    def find(self, texts: list[str | None], xs: list | None = None, n_columns: list | None = None) -> list[list[tuple[str, int, int]]]:
        """Spans (kind, start, end) of each text, by place; none for null and empty texts."""
        pages = [reading(t, xs[i] if xs else None, n_columns[i] if n_columns else None) if t else None for i, t in enumerate(texts)]
        first = [resolve(spans) if spans else [] for spans in self._scored(pages, lambda i, s: candidates(s, self.directory), self.models)]
        if self.open_models:
            more = self._scored(pages, lambda i, s: open_candidates(s, self.given, self.family, first[i]), self.open_models)
            first = [resolve(spans, found) if spans else found for spans, found in zip(more, first)]
        out = []
        for page, found in zip(pages, first):
            out.append(sorted(((kind, *page.place(a, b)) for kind, a, b in found), key=lambda x: (x[1], x[2], x[0])))
        return out


def load_model(name: str = "pii_model") -> dict:
    return json.loads((Path(__file__).parent / f"{name}.json").read_text())


def read_directory(names: DataFrame) -> list[tuple[str | None, str | None]]:
    """The directory's distinct (name_part, role), refused beyond MAX_DIRECTORY rows."""
    rows = names.select("name_part", "role").distinct().limit(MAX_DIRECTORY + 1).collect()
    if len(rows) > MAX_DIRECTORY:
        raise ValueError(f"name directory has more than {MAX_DIRECTORY} entries")
    return sorted(((r[0], r[1]) for r in rows), key=str)


def redact_text(text: str, spans: list[tuple[str, int, int]]) -> str:
    out, at = [], 0
    for kind, a, b in spans:
        if a < at:
            continue
        out += [text[at:a], f"[{kind.upper()}]"]
        at = b
    return "".join([*out, text[at:]])


def find_pii(documents: DataFrame, names: DataFrame, model: dict | None = None, open_model: dict | None = None, id: str = "doc_id", text: str = "text", with_text: bool = False) -> DataFrame:
    """``id, spans[, redacted]`` of each document; spans are (kind, char_start, char_end).

    A map over the documents without a shuffle; the directory and the trees go to the tasks as
    constants of bounded size. Places are code points of the original text, whole, whatever
    the reading order. Columns and line boxes are used where the table has them. Null, empty
    and blank texts have no spans and stay as they are; repeated rows give repeated rows;
    very long texts are processed whole; other columns are not touched.
    """
    ship_code(documents.sparkSession)
    directory, model, open_model = read_directory(names), model or load_model(), open_model or load_model("open_model")
    cols = [F.col(id).alias("id"), F.col(text).alias("text")]
    cols.append(F.col("line_boxes.x").alias("xs") if "line_boxes" in documents.columns else F.lit(None).cast("array<int>").alias("xs"))
    cols.append(F.col("n_columns").cast("int").alias("n") if "n_columns" in documents.columns else F.lit(None).cast("int").alias("n"))
    kind = documents.schema[id].dataType.simpleString()
    schema = f"id {kind}, spans array<struct<kind:string,char_start:int,char_end:int>>" + (", redacted string" if with_text else "")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        detector = Detector(directory, model, open_model)
        for b in batches:
            texts = [t if isinstance(t, str) else None for t in b["text"]]
            xs = [[None if v is None or v != v else int(v) for v in x] if x is not None and n is not None and n == n and n >= 2 else None for x, n in zip(b["xs"], b["n"])]
            n = [None if v is None or v != v else int(v) for v in b["n"]]
            found: list = []
            for i in range(0, len(texts), DOCS_AT_ONCE):
                j = i + DOCS_AT_ONCE
                found += detector.find(texts[i:j], xs[i:j], n[i:j])
            out = {"id": b["id"], "spans": [[{"kind": k, "char_start": s, "char_end": e} for k, s, e in f] for f in found]}
            if with_text:
                out["redacted"] = [redact_text(t, f) if t is not None else None for t, f in zip(texts, found)]
            yield pd.DataFrame(out)

    return documents.select(*cols).mapInPandas(run, schema).withColumnRenamed("id", id)
