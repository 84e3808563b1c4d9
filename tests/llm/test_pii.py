"""Sanitised texts made anew by a model from their spans, and texts with very many matches."""

import random
import time

from lodestar.llm import pii


def model_clean(text, base, terms):
    """Each span's tag in its place; of overlapping spans the first one's, and what the others cover goes."""
    spans = sorted([(b.start, b.end, f"[{b.kind.upper()}]") for b in base] + [(t.start, t.end, t.tag) for t in terms])
    out, at = [], 0
    for a, b, tag in spans:
        if a >= at:
            out += [text[at:a], tag]
        at = max(at, b)
    return "".join(out) + text[at:]


def test_clean_like_its_spans(spark):
    rng = random.Random(5)
    parts = ["jo@x.org ", "Smith ", "4111 1111 1111 1111", "+1 (555) 123-4567", "10.0.0.1", "word ", "🙂é ", "+4111111111111111 ", "\n", "x" * 300, "a@b.c_d@e.f ", "Quirin "]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randint(1, 120)))) for i in range(60)]
    rows += [(100, "y" * 255 + " a@b.co"), (101, "a@b.co" + "z" * 250), (102, " " * 250 + "a@b.co" + "." * 600), (103, "a" * 700 + "@" + "b" * 700 + ".co"), (104, None), (105, "no match")]
    for r in pii.sanitise(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        text = dict(rows)[r.doc_id]
        assert r.text == (model_clean(text, r.base, r.terms) if r.base else None), r.doc_id
        assert all(t.end <= b.start or b.end <= t.start for t in r.terms for b in r.base)


def test_very_many_matches(spark):
    """A hundred thousand addresses in one text take time like their number, not its square."""
    rows = [(1, " ".join(f"u{i}@x{i % 977}.org" for i in range(100_000))), (2, "Ann writes to u5@x5.org today"), (3, "plain")]
    began = time.time()
    got = {r.doc_id: (len(r.base), r.text) for r in pii.sanitise(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1][0] == 100_000 and got[1][1] == " ".join(["[EMAIL]"] * 100_000) and got[2][0] == 1 and got[3] == (0, None)
    assert time.time() - began < 120
