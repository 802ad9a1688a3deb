import random
import re

from tidemark.llm.licenses import PHRASES, TEMPLATES, license_report, scan, tokens_of


def brute(text, containment=0.8):
    w = tokens_of(text or "")
    hits = sorted((i, label) for p, label in PHRASES.items() for i in range(len(w)) if w[i : i + len(tokens_of(p))] == tokens_of(p))
    found = {}
    for block in re.split(r"\n[ \t\r\x0b\x0c]*\n", text or ""):
        have = set(tokens_of(block))
        for label, t in TEMPLATES.items():
            tt = set(tokens_of(t))
            c = len(tt & have) / len(tt)
            if c >= containment - 1e-12:
                found[label] = max(found.get(label, 0), c)
    return len(w), hits, found


def test_scan_equals_brute_force(spark):
    rng = random.Random(2)
    pool = [*{w for t in TEMPLATES.values() for w in tokens_of(t)}, "x", "été", "CC", "BY", "cc by", "General Public  License", "ALL-RIGHTS reserved", "K", "İ"]
    texts = [None, "", "cc-by", "cc by cc by", "General Public License cc", "é" * 20 + " all rights\nreserved", "no hits here", "Mit Licenſe"]
    for _ in range(300):
        parts = []
        for _ in range(rng.randrange(1, 6)):
            t = rng.choice([*TEMPLATES.values()]).split()
            parts.append(" ".join(x for x in t if rng.random() > 0.12) if rng.random() < 0.5 else " ".join(rng.choice(pool) for _ in range(rng.randrange(1, 40))))
        texts.append(rng.choice(["\n", "\n\n", "\n \t\n", "\r\n\r\n"]).join(parts))
    texts.append(("all rights reserved " + "word " * 50) * 2000)
    rows = [(k if k % 50 else None, t, "c") for k, t in enumerate(texts)] + [(9, texts[9], "c"), (9, texts[9], "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, labels string")
    got = scan(df).collect()
    assert len(got) == len(rows)
    want = sorted(((r[0] or -1, *brute(r[1])) for r in rows), key=repr)
    have = sorted(((-1 if r.id is None else r.id, r.n_words, sorted((h["at"], h["label"]) for h in r.hits), {f["label"]: f["containment"] for f in r.found}) for r in got), key=repr)
    for r in got[:200]:
        if r.id is not None and r.id >= 10:
            for f in r.found:
                block = re.split(r"\n[ \t\r\x0b\x0c]*\n", texts[r.id])[f["block"]]
                assert brute(block)[2][f["label"]] == f["containment"]
    norm = lambda rows: sorted(repr((a or -1, n, h, sorted(f.items()))) for a, n, h, f in rows)
    assert norm(have) == norm(want)
    report = {r.doc_id: r for r in license_report(df.filter("doc_id in (2, 3, 6)")).collect()}
    assert (report[3].n_base, report[3].first_word, report[3].last_word, report[3].base_labels) == (2, 0, 2, "cc-by")
    assert report[6].labels == "" and report[6].first_word is None and report[6].score == 0
    assert license_report(df.limit(0)).count() == 0
    assert scan(df, templates={}).count() == len(rows)


def test_wrapped_notices_are_found(spark):
    def wrapped(label, width):
        w, lines = TEMPLATES[label].split(), []
        while w:
            lines.append(" * " + " ".join(w[:width]))
            w = w[width:]
        return "/*\n" + "\n".join(lines) + "\n */\n\nint main() {}\n"

    rows = [(k, wrapped(label, 6)) for k, label in enumerate(sorted(TEMPLATES))] + [(90, wrapped("bsd", 9)), (91, wrapped("mit-text", 13)), (92, wrapped("bsd", 4).replace("\n", "\n\n"))]
    got = {r.id: {f["label"]: f["containment"] for f in r.found} for r in scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[k].get(label) == 1 for k, label in enumerate(sorted(TEMPLATES)))
    assert got[90]["bsd"] == got[91]["mit-text"] == 1 and got[92] == {}
