"""Fits the trees of ``open_forms.py``: python -m brindle.llm.train_open SF_DIR [MAX_DOCS].

Cases come from made sentences: patterns of ordinary prose in three languages, filled with
names, numbers and addresses that are drawn anew, among them many that no list holds. What is
none comes from sentences with places, firms, ships, offices, counts and references, and from
at most MAX_DOCS newspaper pages (the documented bound; odd reels only), where what the first
set of generators does not find counts as none. Figures are measured on other sentence
patterns, other names and the even reels.
"""

from __future__ import annotations

import json
import random
import re
import sys
from pathlib import Path

import numpy as np

from brindle.llm import open_forms, pii
from brindle.llm.gbt import BoostedTrees
from brindle.llm.layout import reading

MAX_DOCS, MADE = 1500, 6000
_ON = "b br c ch d f g gr h j k kl l m n p pr r s sch st t tr v w z".split()
_MID = "a e i o u ai ei ou au ie".split()
_OFF = "n r l s t ck nd rt ss m ng ld ski son sen er ez ini ova ak".split()


def word(r: random.Random) -> str:
    out = r.choice(_ON) + r.choice(_MID) + r.choice(_OFF) + (r.choice(_MID) + r.choice(_OFF) if r.random() < 0.5 else "")
    return out.capitalize()


FAMILIES = "Smith Johnson Williams Brown Jones Garcia Miller Davis Martinez Lopez Wilson Anderson Taylor Moore Jackson Lee Perez Thompson White Harris Clark Lewis Robinson Walker Young Allen King Wright Scott Torres Nguyen Hill Green Adams Nelson Baker Hall Rivera Campbell Mitchell Carter Müller Schmidt Schneider Fischer Weber Wagner Becker Hoffmann Schulz Dubois Moreau Laurent Lefebvre Bernard Petit Kowalski Novak Ivanov Rossi".split()
HELD_FAMILIES = set(FAMILIES[::5])


def names(r: random.Random, held: bool) -> tuple[str, bool]:
    """A name and whether it needs a title to be one."""
    family = word(r) if r.random() < 0.5 else r.choice([f for f in FAMILIES if (f in HELD_FAMILIES) == held])
    given = r.choice(open_forms.GIVEN) if r.random() < 0.8 else word(r)
    x = r.random()
    if x < 0.25:
        return family, True
    if x < 0.4:
        return f"{r.choice('ABCDEFGHJKLMNPRSTW')}. " + (f"{r.choice('ABCDEFGHJKLM')}. " if r.random() < 0.4 else "") + family, False
    middle = f"{r.choice('ABCDEFGHJKLM')}. " if r.random() < 0.2 else f"{r.choice(['van', 'von', 'de', 'de la', 'van der'])} " if r.random() < 0.1 else ""
    return f"{given} {middle}{family}", False


def number(r: random.Random, form: str) -> str:
    return re.sub("d", lambda _: str(r.randrange(10)), form)


def fill(kind: str, r: random.Random, held: bool) -> tuple[str, int, int]:
    """A value with what belongs before it, and where the case lies in it."""
    if kind == "name":
        n, needs = names(r, held)
        lead = r.choice(open_forms.TITLES) + r.choice([". ", " "]) if needs or r.random() < 0.15 else ""
        return lead + n, len(lead), len(lead) + len(n)
    if kind == "email":
        v = f"{word(r).lower()}{r.choice(['', '.', '_', '-'])}{r.choice(['', word(r).lower()])}{r.choice(['', str(r.randrange(99))])}@{r.choice('abcxyz') if r.random() < 0.2 else word(r).lower()}.{r.choice('com org net io co.uk de fr eu info edu'.split())}"
        v = v.replace(".@", "@").replace("_@", "@").replace("-@", "@")
        return v, 0, len(v)
    if kind == "phone":
        v = number(r, r.choice(["ddd-ddd-dddd", "(ddd) ddd-dddd", "ddd.ddd.dddd", "+1 ddd ddd dddd", "+44 dddd dddddd".replace("dddddd", "ddd ddd"), "+49 dd dddd dddd", "+33 dd dd dd dd", "0dd dddd dddd", "0ddd ddd dddd", "0d dd dd dd dd"[1:]]))
        return v, 0, len(v)
    if kind == "identity":
        lead = r.choice(["SSN: ", "SSN ", "Passport No. ", "passport number ", "Social security number ", "Personalausweis Nr. ", "Reisepass ", "National ID: ", "ID no. ", "carte d'identité n° ", "driver's license ", "Tax ID "])
        v = number(r, r.choice(["ddd-dd-dddd", "Cdddddddd".replace("C", r.choice("ABCLX")), "CddXddTdd".replace("C", r.choice("CLNT")), "ddddddddd", "AB dd dd dd C".replace("AB", r.choice(["QQ", "AB", "JK"])), "ddd ddd ddd"]))
        return lead + v, len(lead), len(lead) + len(v)
    street = " ".join(word(r) if r.random() < 0.7 else r.choice("Oak Pennsylvania Main Baker Church High Station Park Victoria Lincoln Mill".split()) for _ in range(r.choice([1, 1, 1, 2])))
    v = r.choice(
        [
            lambda: f"{r.randrange(1, 9999)}{r.choice(['', '', 'B'])} {r.choice(['', 'North ', 'W. '])}{street} {r.choice(open_forms.STREETS)}",
            lambda: f"{r.randrange(1, 300)}{r.choice([' ', ', '])}{r.choice(['rue', 'avenue', 'boulevard', 'place'])} {r.choice(['', 'de la ', 'du '])}{street}",
            lambda: f"{r.choice(['Unter den', 'An der', 'Am', 'Zum', 'Auf der'])} {word(r)} {r.randrange(1, 200)}",
            lambda: f"{word(r)}{r.choice(['straße', 'weg', 'platz', 'allee'])} {r.randrange(1, 300)}{r.choice(['', 'a'])}",
        ]
    )()
    return v, 0, len(v)


_SENTENCES = {
    "name": ["{} called yesterday.", "The letter was written by {} in May.", "Please contact {} about it.", "We met {} and his wife.", "Patient {} was seen on Monday.", "{} lives in Leeds.", "He told {} that it rained.", "Gestern kam {} nach Bonn.", "Der Brief ist von {} geschrieben.", "Nous avons vu {} hier.", "The author, {}, replied.", "Dear {},", "{} said so twice."],
    "email": ["Write to {} soon.", "My address is {}.", "Mail {}, please.", "Kontakt: {}", "Envoyez-le à {} demain.", "({})"],
    "phone": ["Call {} now.", "Tel. {}", "My number is {}, as before.", "Rufen Sie {} an.", "Reach us at {} or later.", "Phone: {}."],
    "identity": ["{} was used.", "Her {} is on file.", "Please note {}.", "He gave {} to the clerk.", "({})"],
    "address": ["She lives at {}.", "Send it to {}, please.", "Our office is {} in town.", "Er wohnt {} in Bonn.", "Il habite {} à Lyon.", "The house at {} burned."],
}
_HELD = {
    "name": ["Yesterday {} paid the bill.", "My teacher {} was kind.", "Thanks to {} we won.", "The nurse spoke with {} at noon.", "Unser Kollege {} ist krank.", "La lettre est signée par {}."],
    "email": ["Reply via {} until Friday.", "Ihre Adresse lautet {}."],
    "phone": ["The hotline {} is free.", "Numéro: {}"],
    "identity": ["On the form stood {}.", "I lost it: {}, I think."],
    "address": ["Deliver the box to {} tomorrow.", "Das Haus {} ist alt."],
}
_NONE = """The steamer Mary Ann left. The Royal Hotel burned. The Bank of England paid. New York is far. High Street was empty. Smith and Sons closed. Messrs. Brown & Co. moved.
The Lord Mayor spoke. Der Herr Bürgermeister kam. On Monday Morning it rained. The United States won. Great Britain lost. King George Street is long. Some 1200 men came. In 1999 we met.
Order 123-456-78 was sent. Account 4410-220 is open. Version 10.20.30 is out. It cost 300 400 500 in all. The score was 21-14-07. Chapter 12 Section 4. Lot 12 Box 40 Place. The Union Club met.
The Northern Railway stopped. Lake Geneva froze. Mount Everest is high. The Oxford University Press printed it. Platform 9 Station Road closed early. On 12 May Street fairs opened. The Daily Mail wrote. San Francisco is big.
Saint Paul is old. Page 12 Column Way of news. Die Deutsche Bank zahlte. Le Grand Hotel brûla. The horse Silver King ran. Best Wishes and Happy New Year. Dear Sir or Madam. Yours Sincerely. Part No. 4477-AB-99 is gone. Invoice 20240117 is due.""".replace("\n", " ")


def made(r: random.Random, n: int, sentences: dict[str, list[str]], held: bool) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """Texts of a few sentences, with the places of their cases."""
    nothing, out = re.split(r"(?<=\.) (?=[A-Z])", _NONE), []
    for _ in range(n):
        text, cases = "", []
        for _ in range(r.randrange(1, 5)):
            text += r.choice(["", " ", "\n"]) if not text else r.choice([" ", "\n"])
            if r.random() < 0.3:
                text += re.sub(r"\b(?:Mary|Ann|Silver|Brown|Smith|Geneva|Union)\b", lambda m: word(r) if r.random() < 0.5 else m[0], r.choice(nothing))
                continue
            kind = r.choice(list(sentences))
            v, a, b = fill(kind, r, held)
            head, tail = r.choice(sentences[kind]).split("{}")
            at = len(text) + len(head)
            text += head + v + tail
            cases.append((kind, at + a, at + b))
        out.append((text, cases))
    return out


def rows(texts: list[tuple[str, list[tuple[str, int, int]]]], given: set[str], family: set[str], pages: bool = False) -> dict[str, tuple[list, list]]:
    """Features and labels by kind; what newspaper ``pages`` hold beside what is found is none."""
    out: dict[str, tuple[list, list]] = {k: ([], []) for k in pii.KINDS}
    for text, cases in texts:
        true, taken = (set(), cases) if pages else (set(cases), [])
        for kind, a, b, f in open_forms.open_candidates(text, given, family, taken):
            out[kind][0].append(f)
            out[kind][1].append((kind, a, b) in true)
    return out


def main(sf_dir: str, max_docs: int = MAX_DOCS, seed: int = 11) -> None:
    import pyarrow.parquet as pq

    docs = pq.read_table(f"{sf_dir}/documents.parquet", columns=["doc_id", "text", "line_boxes", "n_columns", "reel_id"]).sort_by("doc_id").to_pylist()
    directory = [(d["name_part"], d["role"]) for d in pq.read_table(f"{sf_dir}/name_parts.parquet").to_pylist()]
    given, family = {p for p, k in directory if k == "given"}, {p for p, k in directory if k == "family"}
    odd = [d for d in docs if d["text"] and d["reel_id"] and int(re.sub(r"\D", "", d["reel_id"]) or 0) % 2][:max_docs]
    first, pages = pii.Detector(directory, pii.load_model()), []
    for d in odd:
        page = reading(d["text"], [b["x"] if b else None for b in d["line_boxes"] or []] if (d["n_columns"] or 0) >= 2 else None, d["n_columns"]).text
        pages.append((page, first.primary(page)))
    r = random.Random(seed)
    train, check, held = made(r, MADE, _SENTENCES, False), made(r, MADE // 4, _SENTENCES, False), made(r, MADE // 4, _HELD, True)
    print(len(pages), "pages,", len(train), "made texts")
    a, b, c = rows(train, given, family), rows(check, given, family), rows(held, given, family)
    n = rows(pages, given, family, True)
    kinds = {}
    for kind in pii.KINDS:
        none = [f for f, y in zip(*n[kind]) if not y]
        cut = len(none) * 3 // 4
        x, y = np.array(a[kind][0] + none[:cut], np.float32), np.array(a[kind][1] + [False] * cut, float)
        cx, cy = np.array(b[kind][0] + none[cut:], np.float32), np.array(b[kind][1] + [False] * (len(none) - cut), float)
        m = BoostedTrees(n_trees=40, depth=4).fit(x, y).calibrate(cx, cy)
        m.threshold = max(m.threshold, 0.5)
        p = m.predict(np.array(c[kind][0], np.float32)) >= m.threshold
        t = np.array(c[kind][1])
        cases = sum(len({c for c in cs if c[0] == kind}) for _, cs in held)
        print(kind, "rows", len(y), "cases", int(y.sum()), "none from pages", len(none), "| held-out made: precision %.3f recall %.3f of %d cases" % ((p & t).sum() / max(1, p.sum()), (p & t).sum() / max(1, cases), cases), "threshold", m.threshold)
        kinds[kind] = m.to_dict()
    (Path(open_forms.__file__).parent / "open_model.json").write_text(json.dumps({"kinds": kinds}, separators=(",", ":")))


if __name__ == "__main__":
    main(sys.argv[1], *(int(x) for x in sys.argv[2:]))
