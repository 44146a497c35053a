"""Fits the trees of ``pii.py``: python -m brindle.llm.train_pii SF_DIR [MAX_DOCS].

There are no labelled rows, so labelling functions make them: strict readings of each printed
form in an unmistakable context are cases, other readings of the same words are none. They run
over at most MAX_DOCS documents (the documented bound of the sample, lowest ids first); every fifth of them
is kept from the fit for calibration. The trees see only format and context features, not the
labelling functions.
"""

from __future__ import annotations

import json
import re
import sys
from collections import Counter
from pathlib import Path

import numpy as np

from brindle.llm import pii
from brindle.llm.gbt import BoostedTrees
from brindle.llm.layout import reading

MAX_DOCS = 4000
_DOMAIN = re.compile(r"(?:example|test|invalid)(?:\s?(?:\.|dot)\s?(?:com|org|net))?", re.I)


def learn_given(pages: list[str], d: pii.Directory, least: int = 4) -> list[str]:
    """Capitalised words that stand before at least ``least`` different family names."""
    seen: dict[str, set[str]] = {}
    for s in pages:
        a = pii.alike(s)
        for m in d.pattern.finditer(a):
            t = pii._left_tokens(s, a, m.start(), 1)
            if t and pii._token_type(s, a, *t[0], d) in (2, 5) and s[t[0][0] : t[0][1]].istitle():
                seen.setdefault(s[t[0][0] : t[0][1]], set()).add(m[0])
    return sorted(w for w, f in seen.items() if len(f) >= least)


def label(kind: str, start: int, end: int, s: str, a: str, d: pii.Directory, mails: list[tuple[int, int]], streets: list[tuple[int, int]]) -> bool:
    text, left, right = s[start:end], a[max(0, start - 60) : start], a[end : end + 40]
    cue_phone, cue_ref = bool(pii._CUE_PHONE.search(left)), bool(pii._CUE_REFERENCE.search(left))
    if kind == "email":
        labels = re.split(r"[.\s@()\[\]]+", text)
        last = labels[-1].lower().replace("ſ", "s")
        whole = re.match(r"[\s.]+(?:dot\s)?(?:com|org|net)(?!\w)", s[end : end + 12], re.I)
        tail = re.search(r"(?:exarnple|\w{4}ple|example|test|\w{5}id|invalid|\w?es[tf])(?:(?:\.\s?|\s\w{3}\s)(?:com|org|net|\w{3}))?\Z", text, re.I)
        return bool(tail) and not (whole and last not in ("com", "org", "net")) and len(last) > 2
    if kind == "phone":
        if cue_ref or s[end : end + 1].isalnum() or any(x <= start < y for x, y in streets):
            return False
        forms = [k for k, p in enumerate(pii._PHONES) if (m := p.match(s, start)) and m.end() == end]
        n = len(re.findall(pii.D, text))
        if re.search(r"^[A-Za-zſ]{2,}", text):
            listed = re.search(rf"(?:{pii._any('telephones telephone')}:[^.]{{0,30}}\s{pii._any('and')}\s|{pii._any('answers')}\s{pii._any('on')}\s)\Z", left)
            ring = cue_phone and not re.search(r"[NO]ND\s\Z", left)
            return ring or bool(listed) or bool(re.match(r"[A-Z]{2}[a-z]", text))
        if not forms:
            return False
        k = forms[0]
        if k <= 6:
            want = {0: (10, 13), 1: (13, 14), 2: (8, 11), 3: (9, 9), 4: (10, 10), 5: (10, 12), 6: (10, 10)}[k]
            longer = any((m := p.match(s, start)) and m.end() > end and want[1] >= len(re.findall(pii.D, m[0])) for p in pii._PHONES[:7])
            return want[0] <= n <= want[1] and not longer and "\n\n" not in text
        if k == 7:
            return True
        rest = re.match(rf"[ .\-/]?{pii.D}", s[end : end + 2])
        ad = left[-2:] in (", ", ",\n") and any(m.end() == start - 2 for m in d.pattern.finditer(a, max(0, start - 40), start))
        if k == 8:
            return (cue_phone or ad) and not rest
        return (cue_phone or ad) and not rest and not re.match(r"\s?[-/]?\d", s[end : end + 3].replace("\n", "x"))
    if kind == "identity":
        return bool(pii._CUE_IDENTITY.search(left)) and not cue_ref and not any((m := p.match(s, start)) and m.end() > end for p in pii._IDENTITIES)
    if kind == "address":
        if re.search(r"(?:£|\$)\s?\Z", left) or re.match(r"\s?(?:HONSES|MALSONS)", right):
            return False
        if re.search(r"\d\Z|PAGE\s\Z", left):
            return False
        number_first = s[start].isdigit() or s[start] in "OolISZB"
        if pii._STREET_EN.search(a[start:end].rstrip(".").split()[-1]) and number_first:
            return not (text.count("\n") > 1)
        if number_first:
            return True
        words = text.split()
        if re.match(r"(?:IN|BRAND)\Z", words[0].upper()):
            return False
        # German: the number may not be the count of something
        return not re.match(r"\s?(?:MORK|NHR|ELLEN|TOTE|FNHREN|HÄNSER)", right)
    if kind == "name":
        if any(x <= start < y or x < end <= y for x, y in mails):
            return False
        f = next((m for m in d.pattern.finditer(a, start, min(len(a), end + 12)) if m.start() >= start and m.end() <= end), None)
        if f is None:
            return False
        f0, f1 = f.span()
        firm = pii._FIRM_AFTER_RE.match(a, f1) or pii._STREET_AFTER.match(a, f1) or re.search(r"[&]\s\Z", left)
        tokens, types = pii._left_types(s, a, f0, f1, d)
        i = 0
        while i < len(types) and types[i] == 6 and i < 3:
            i += 1
        run = pii._given_run(s, tokens, types, i, {m.end() for m in d.pattern.finditer(a, max(0, f0 - 80), f0)}, 3)
        # an unknown capitalised word counts only directly before known parts
        while run > i and types[run - 1] == 5 and run - i > 1:
            run -= 1
        if end > f1:
            if start != f0 or run > i or not re.search(r"(?:[:;]|WERE|ONWESEND|PRESENTS)\s?\s?\Z", left):
                return False
            tail = right[:3].lstrip()
            if text[-1] == "." and len(text) > 1:  # ends with an initial
                return not re.match(r"\s[A-ZÀ-Þ]\.", s[end : end + 3])
            return tail[:1] in (";", ".") and not re.match(r"\s?[A-Z]\.", s[end : end + 3])
        if firm:
            return False
        if not d.made.search(a, f0, f1) and not (run > i and types[i] in (1, 2, 3)):
            return False
        if run > i:
            return start == tokens[run - 1][0]
        inverse = re.match(r",\s(?:[^\W\d_]\.|[A-ZÀ-Þ][\w-]+(?:\s[^\W\d_]\.)?)\s?[;.]", s[f1 : f1 + 30]) and re.search(r"(?:[:;]|WERE)\s?\Z", a[max(0, f0 - 8) : f0])
        want = tokens[i - 1][0] if i else f0
        if inverse or start != want:
            return False
        before = types[i] if i < len(types) else -1
        if before == 4:
            return not pii._FIRM_BEFORE_RE.search(a[max(0, start - 12) : start])
        return False
    raise ValueError(kind)


def main(sf_dir: str, max_docs: int = MAX_DOCS, seed: int = 7) -> None:
    import pyarrow.parquet as pq

    docs = pq.read_table(f"{sf_dir}/documents.parquet", columns=["doc_id", "text", "line_boxes", "n_columns"]).sort_by("doc_id").slice(0, max_docs).to_pylist()
    names = pq.read_table(f"{sf_dir}/name_parts.parquet").to_pylist()
    directory = [(r["name_part"], r["role"]) for r in names]
    pages = [reading(r["text"], [b["x"] if b else None for b in r["line_boxes"] or []] if (r["n_columns"] or 0) >= 2 else None, r["n_columns"]).text for r in docs if r["text"]]
    given = learn_given(pages, pii.Directory(directory))
    d = pii.Directory(directory, given)
    # Three of four documents are read with directories that lack a third of the given names, so
    # that the trees learn to do without; the labels come from all that is known.
    rng = np.random.default_rng(seed)
    views = [d]
    for _ in range(3):
        gone = {w for w in [*given, *(p for p, r in directory if r == "given")] if rng.random() < 0.33}
        views.append(pii.Directory([(p, r) for p, r in directory if p not in gone], [w for w in given if w not in gone]))
    rows: dict[str, tuple[list, list, list]] = {k: ([], [], []) for k in pii.KINDS}
    for i, s in enumerate(pages):
        a = pii.alike(s)
        cands = pii.candidates(s, views[i % 4])
        mails = [(x, y) for k, x, y, _ in cands if k == "email" and label("email", x, y, s, a, d, [], [])]
        streets = [(x, y) for k, x, y, _ in cands if k == "address" and label("address", x, y, s, a, d, [], [])]
        for kind, x, y, f in cands:
            for store, v in zip(rows[kind], (f, label(kind, x, y, s, a, d, mails, streets), i)):
                store.append(v)
    kinds = {}
    for kind, (f, y, i) in rows.items():
        x, y, i = np.array(f, np.float32), np.array(y, float), np.array(i)
        held = i % 5 == 4
        m = BoostedTrees(n_trees=50, depth=5).fit(x[~held], y[~held]).calibrate(x[held], y[held])
        p = m.predict(x[held]) >= m.threshold
        t = y[held] > 0
        print(kind, "rows", len(y), "cases", int(y.sum()), "held-out precision %.4f recall %.4f" % ((p & t).sum() / max(1, p.sum()), (p & t).sum() / max(1, t.sum())), "threshold", m.threshold)
        kinds[kind] = m.to_dict()
    (Path(pii.__file__).parent / "pii_model.json").write_text(json.dumps({"given": given, "kinds": kinds}, ensure_ascii=False, separators=(",", ":")))
    print(len(given), "given names learned", Counter(len(g) for g in given).most_common(3))


if __name__ == "__main__":
    main(sys.argv[1], *(int(x) for x in sys.argv[2:]))
