"""Quality rules, license scans and PII against brute force."""

import re
from collections import Counter
from hashlib import sha256

from skein.llm import license_scan, pii, quality_rules

W = r"[^\x20\x09-\x0D]+"


def texts(docs):
    return [(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()]


def same(df, expected, names):
    got = Counter(tuple(r[n] for n in names) for r in df.collect())
    assert got == Counter(expected)


def repeats(w):
    wins = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    c = Counter(wins)
    return len({k for i, x in enumerate(wins) if c[x] > 1 for k in range(i, i + 5)})


def test_quality_counts(docs, none):
    def one(i, t):
        w = re.findall(W, t)
        lines = [x for x in t.split("\n") if re.search(W, x)]
        r = repeats(w)
        return i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), r, len(w) < 10 or 100 * r > 20 * len(w)

    out = quality_rules.digest(docs)
    same(out, [one(*x) for x in texts(docs)], ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"])
    assert not out.where("base_failed and kept").count()
    assert quality_rules.digest(none).count() == 0


def test_quality_keeps_clean_lines(spark):
    clean = "The river runs past the old mill and on to the sea.\nNobody has lived there for years, but the wheel still turns."
    junk = "home | news | sport | weather | more\n!! BUY NOW !! CHEAP !! PILLS !!\nclick here to read on and on and on and on.\n" + clean[:51]
    r = {x.doc_id: x for x in quality_rules.line_first(spark.createDataFrame([(1, clean), (2, junk)], "doc_id long, text string")).collect()}
    assert r[1].kept and r[1].clean_text == clean
    assert not r[2].kept and r[2].clean_text == clean[:51]


def test_license_places(docs, none):
    def one(i, t):
        w = re.findall(license_scan.WORD, re.sub("[A-Z]", lambda m: m[0].lower(), t))
        at = [(k, lab) for p, lab in license_scan.PHRASES.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        k = [x for x, _ in at]
        return i, len(w), len(at), min(k, default=None), max(k, default=None), ",".join(sorted({x for _, x in at}))

    same(license_scan.scan(docs), [one(*x) for x in texts(docs)], ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels"])
    assert license_scan.scan(none).count() == 0


def test_license_join_is_exact(docs, spark):
    mit = "Permission is hereby granted, free of charge, to any person\n# obtaining a copy of this software and associated\n# documentation files (the \"Software\")"
    bsd = " * Redistribution and use in source and binary forms, with or without\n * modification, are permitted provided that the\n\n * following conditions are met:"
    more = [(501, mit), (502, bsd), (503, "x " * 200 + bsd.replace("binary", "other")), (504, " ".join(f"{w} and so on and so on" for w in mit.split())), (505, "under the license")]
    df = docs.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    known, expected = license_scan.templates_of(license_scan.TEMPLATES), set()
    for i, t in texts(df):
        w = re.findall(license_scan.WORD, re.sub("[A-Z]", lambda m: m[0].lower(), t))
        for x in known:
            if len(x.tokens & set(w)) >= x.required:
                best = max(len(x.tokens & set(w[k : k + x.span])) for k in range(len(w)))
                if best >= 0.9 * len(x.tokens) - 1e-9:
                    expected.add((i, x.label))
    got = {(r.doc_id, x) for r in license_scan.scan(df).collect() for x in r.labels.split(",") if x in license_scan.TEMPLATES}
    assert got == expected and {(501, "mit-grant"), (502, "bsd-redistribution"), (503, "bsd-redistribution")} < expected
    assert not any(i in (504, 505) for i, _ in expected)


def test_license_in_a_long_text(spark):
    """1 MB that holds prefix tokens everywhere, and a template at its very end only."""
    text = "software provided without permission " * 27_000 + license_scan.TEMPLATES["unlicense"]
    assert len(text) > 990_000
    row = license_scan.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (row.labels, row.score, row.n_base) == ("unlicense", 1.0, 0)


def test_boilerplate_in_four_languages(spark):
    prose = "The river runs past the old mill and on to the sea, as it did when they were young."
    rows = [(1, "Alle Rechte vorbehalten."), (2, "Lisez nos mentions légales et cliquez ici."), (3, "Consulte el aviso legal y la política de privacidad."), (4, "Skip to content.")]
    df = spark.createDataFrame([(i, f"{prose}\n{x}") for i, x in rows], "doc_id long, text string")
    assert {r.clean_text for r in quality_rules.line_first(df).collect()} == {prose}


def luhn(d):
    return sum(int(c) if k % 2 == 0 else (int(c) * 2 - 9 if int(c) > 4 else int(c) * 2) for k, c in enumerate(reversed(d))) % 10 == 0


def base(t):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    kinds = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m[0].split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(digits(m)) <= 19 and luhn(digits(m))),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(digits(m)) <= 15),
    }
    return {k: [(m.start(), m.end()) for m in re.finditer(p, t) if f(m)] for k, (p, f) in kinds.items()}


def test_pii_base(docs, none):
    def one(i, t):
        b = base(t)
        named = ",".join(f"{k}:{s}:{e}" for k, v in b.items() for s, e in v)
        return i, *map(len, b.values()), sha256(named.encode()).hexdigest()

    same(pii.digest(docs), [one(*x) for x in texts(docs)], ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256"])
    assert pii.digest(none).count() == 0


def test_pii_patterns_find_unseen(spark):
    rows = [(i, f'set token = "{"ab12" * 8}{i:02d}" here') for i in range(8)] + [(20, 'set token = "live-K7x9-Q2" here'), (21, "room 12345678 is free")]
    r = {x.doc_id: x.id for x in pii.extract(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [rows[8][1][s:e] for s, e in r[20]] == ["live-K7x9-Q2"]
    assert not r[21] and len(r[0]) == 1


def redacted(t, spans):
    """spans: (start, end, kind)."""
    out, at = "", 0
    for start, end, kind in sorted(spans):
        if start >= at:
            out += t[at:start] + f"<{kind}>"
        at = max(at, end)
    return out + t[at:]


def test_redact_changes_only_spans(docs, none):
    found = {(r.doc_id, r.t): [(s, e, "id") for s, e in r.id] for r in pii.extract(docs.select("doc_id", "text", "key")).join(docs.selectExpr("doc_id", "coalesce(text, '') as t").distinct(), "doc_id").collect()}
    expected = Counter()
    for r in docs.select("doc_id", "text").collect():
        spans = [(s, e, k) for k, v in base(r.text or "").items() for s, e in v] + found.get((r.doc_id, r.text or ""), [])
        expected[r.doc_id, r.text if r.text is None else redacted(r.text, spans)] += 1
    out = pii.redact(docs)
    assert out.columns == docs.columns and Counter((r.doc_id, r.text) for r in out.select("doc_id", "text").collect()) == expected
    assert any(t and "mail <email> and <phone>." in t for _, t in expected) and out.where("key <> 'key' or marks <> 'marks'").count() == 0
    assert pii.redact(none).count() == 0


def test_redact_exact_text(spark):
    df = spark.createDataFrame([(1, "mail a.b@c.example.org and +1 (555) 010-9999."), (2, "4111 1111 1111 1111 at 10.0.0.1")], "doc_id long, text string")
    assert {r.text for r in pii.redact(df).collect()} == {"mail <email> and <phone>.", "<card> at <ip>"}
