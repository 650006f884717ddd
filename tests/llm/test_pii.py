"""Surrogates: ordinary words stay, loud titles count, and whole texts equal a slow replacement in Python."""

import re

import regex
from fixtures import documents

from saltmarsh.llm import pii


def replaced(spark, *texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r.text for r in pii.replace_personal_data(docs, "k").orderBy("doc_id").collect()]


def test_ordinary_words_stay(spark):
    out = replaced(
        spark, "Dear Mr Smith Monday is fine. On Monday we met. Smith came.", "Mr May came in May. May I ask?", "Mr Will said it will; Will you?", "The Miss America Pageant was on.",
        "MR JONES WILL COME. MR JONES LEFT.", "Mrs. O'Neil-Smith met Mr O'Neil-Smith.", "DR. ANNA SCHMIDT said so; Dr. Anna Schmidt too.",
    )
    m = re.fullmatch(r"Dear Mr (\w+) Monday is fine\. On Monday we met\. (\w+) came\.", out[0])
    assert m and m[1] == m[2] != "Smith"
    assert re.fullmatch(r"Mr (?!May)\w+ came in May\. May I ask\?", out[1])
    assert re.fullmatch(r"Mr (?!Will)\w+ said it will; Will you\?", out[2])
    assert out[3] == "The Miss America Pageant was on."
    m = re.fullmatch(r"MR ([A-Z]+) WILL COME\. MR ([A-Z]+) LEFT\.", out[4].replace(" " + out[4].split()[-1], " LEFT."))
    assert m and m[1] == m[2] != "JONES" and "JONES" not in out[4]
    m = re.fullmatch(r"Mrs\. (O'[A-Z][a-z]+-[A-Z][a-z]+) met Mr (O'[A-Z][a-z]+-[A-Z][a-z]+)\.", out[5])
    assert m and m[1] == m[2] and "Neil" not in out[5]
    m = re.fullmatch(r"DR\. (\w+) (\w+) said so; Dr\. (\w+) (\w+) too\.", out[6])
    assert m and (m[1], m[2]) == (m[3].upper(), m[4].upper()) and "ANNA" not in out[6]


def slow(texts):
    """(entities, pieces): distinct (plain, kind) with genders, and every text as plain strings and (entity, kind, title, parts)."""
    genders, pieces = {}, []
    common = {w.lower() for w in pii.COMMON}
    for text in texts:
        found = [m[0] for m in regex.finditer(pii.ANY, text or "")]
        titled = [e for e in found if regex.match(pii.TITLES, e)]
        bare = {e: regex.sub(pii.TITLES, "", e) for e in titled}
        known = {n for n in bare.values() if n.lower() not in common}
        known |= {n.split(" ")[-1] for e, n in bare.items() if not regex.match(r"(?:" + pii.LOUD + r")\.? ", e) and len(n.split(" ")[-1]) > 2 and n.split(" ")[-1].lower() not in common}
        pattern = pii.ANY + (r"|(?<!\p{L})(?:" + "|".join(sorted(known, key=lambda n: (-len(n), n))) + r")(?!\p{L})" if known else "")
        out, at = [], 0
        for m in regex.finditer(pattern, text or "") if found else ():
            e = m[0]
            kind = "person" if e in known else next((k for k, p in list(pii.PATTERNS.items())[:-1] if regex.fullmatch(p, e)), "secret" if regex.fullmatch("[A-Za-z0-9]+", e) else "person")
            title = (regex.match(pii.TITLES, e) or [""])[0] if kind == "person" else ""
            parts = e[len(title) :].split(" ") if kind == "person" else [e]
            said = {t for t in title.replace(".", "").lower().split()}
            gender = "f" if said & {t.lower() for t in pii.FEMALE} else "m" if said & {t.lower() for t in pii.MALE} else None
            plain = [regex.sub("[^0-9A-Z+]", "", p) if kind in ("phone", "card", "iban", "ssn") else p.lower() if kind in ("email", "person") else p for p in parts]
            for i, p in enumerate(plain):
                held = genders.setdefault((p, kind), set())
                if kind == "person" and gender and (i < len(plain) - 1 or len(plain) == 1):
                    held.add(gender)
            out += [text[at : m.start()], (kind, title, parts, plain)]
            at = m.end()
        pieces.append([*out, (text or "")[at:]])
    return genders, pieces


def written(kind, part, new):
    if kind in ("phone", "card", "iban", "ssn"):
        rest, out = list(new), ""
        for c in part:
            out += rest.pop(0) if rest and re.match("[0-9A-Z+]", c) else "" if re.match("[0-9A-Z+]", c) else c
        return out + "".join(rest)
    loud = part == part.upper() and part != part.lower() and len(part) > 1
    return new.upper() if kind in ("email", "person") and loud else new


def test_whole_texts_equal_a_slow_replacement(spark):
    docs = documents(spark).select("doc_id", "text")
    rows = docs.orderBy("doc_id").collect()
    genders, pieces = slow([r.text for r in rows])
    assert {k for _, k in genders} >= {"email", "person", "phone", "ip"} or len(genders) > 10
    table = spark.createDataFrame([(p, k, next(iter(g)) if len(g) == 1 else None) for (p, k), g in genders.items()], "plain string, kind string, gender string")
    new = {(r.plain, r.kind): r.surrogate for r in pii.assign_surrogates(table, "k").collect()}
    got = {r.doc_id: r for r in pii.replace_personal_data(docs, "k").collect()}
    for row, parts in zip(rows, pieces):
        text = "".join(p if isinstance(p, str) else p[1] + " ".join(written(p[0], a, new[b, p[0]]) for a, b in zip(p[2], p[3])) for p in parts)
        assert got[row.doc_id].text == (text if row.text is not None else None)
        assert got[row.doc_id].n_entities == sum(not isinstance(p, str) for p in parts)
