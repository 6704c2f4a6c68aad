"""Language masks against plain sets, license spans against voting by hand."""

import collections

import numpy as np
from pyspark.sql import functions as F

from piitrace.llm import langid, licenses
from tests.llm.frames import ALPHANUMERIC, documents, words
from tests.llm.test_texts import labelled


def plain_grams(text):
    """Four places of which the second is a letter; what is no letter is a gap, runs of gaps are one."""
    out, gap = [], True
    for ch in (text or "").lower():
        if ch.isalpha():
            out.append(ch)
            gap = False
        elif not gap or not out:
            out.append(" ")
            gap = True
    padded = [" ", *out, " ", " ", " "] if not (out and out[0] == " ") else [" ", *out, " ", " ", " "]
    return [tuple(padded[i - 1:i + 3]) for i in range(1, 1 + len(out)) if padded[i] != " "]


def test_masks_hold_every_language_of_a_gram(spark):
    """Filters never forget: the mask of an n-gram holds each language that learnt it, others by chance only."""
    rows = labelled()
    model = langid.fit(documents(spark, rows, clash=False))
    learnt = {}
    for name in model.languages:
        texts = [t for _, t, lang in rows if lang == name]
        seen = collections.Counter(int(v) for t in texts for v in np.unique(langid.grams([t])[0]))
        least = max(2.0, langid.LEAST * len(texts))
        learnt[name] = {v for v, n in seen.items() if n >= least}
    every = np.array(sorted(set().union(*learnt.values())), np.uint64)
    bits = langid.POSITIONS.bit_length() - 1
    at = [langid.positions(every, p, bits) for p in range(langid.PROBES)]
    mask = model.masks[0][at[0]] & model.masks[0][at[1]] & model.masks[0][at[2]]
    wrong = 0
    for i, name in enumerate(model.languages):
        held = (mask >> np.uint64(i) & np.uint64(1)).astype(bool)
        own = np.array([int(v) in learnt[name] for v in every])
        assert held[own].all()
        wrong += int((held & ~own).sum())
    assert wrong <= 0.01 * len(every)


def test_scores_are_corrected_shares(spark):
    """A text's shares counted gram by gram, corrected for each filter's chance of a false answer."""
    rows = labelled()
    model = langid.fit(documents(spark, rows, clash=False))
    texts = [t for _, t, _ in rows[::7]] + ["", None, "12 !?", "xyz qqq", rows[0][1] + " " + rows[-1][1]]
    names, scores = model.predict(texts)
    bits = langid.POSITIONS.bit_length() - 1
    for text, name, score in zip(texts, names, scores, strict=True):
        values = langid.grams([text or ""])[0]
        if not any(ch.isalpha() for ch in text or ""):
            assert (name, score) == ("und", 0)
            continue
        assert len(values) == len(plain_grams(text))
        best = []
        for i in range(len(model.languages)):
            hits = 0
            for v in values:
                held = ~np.uint64(0)
                for p in range(langid.PROBES):
                    held &= model.masks[0][int(langid.positions(np.array([v], np.uint64), p, bits)[0])]
                hits += int(held >> np.uint64(i) & np.uint64(1))
            best.append(max(0, hits / len(values) - model.chance[i]) / (1 - model.chance[i]))
        want = model.languages[int(np.argmax(best))] if max(best) > 0 else model.languages[model.usual]
        assert name == want and abs(score - min(1, max(best))) < 1e-12


def plain_spans(text, k):
    """Votes of every shared k-gram, by template and diagonal; near diagonals merged; verified by coverage."""
    own = words(text, ALPHANUMERIC)
    out = []
    for label, template in licenses.TEMPLATES:
        whole = words(template, ALPHANUMERIC)
        at = collections.defaultdict(list)
        for q in range(len(whole) - k + 1):
            at[tuple(whole[q:q + k])].append(q)
        votes = collections.defaultdict(list)
        for p in range(len(own) - k + 1):
            for q in at.get(tuple(own[p:p + k]), ()):
                votes[p - q].append((p, q))
        merged, before = [], None
        for diagonal in sorted(votes):
            if before is None or diagonal - before > licenses.GAP:
                merged.append([])
            merged[-1] += votes[diagonal]
            before = diagonal
        for hits in merged:
            first, last = min(p for p, _ in hits), max(p for p, _ in hits) + k
            covered = len({q + i for _, q in hits for i in range(k)})
            if covered >= licenses.COVER * len(whole) and covered >= licenses.DENSE * (last - first):
                out.append((label, first, last, covered / len(whole)))
    return sorted(out)


def test_spans_by_hand(spark):
    """Templates in other text, with words dropped, added and changed, one behind the other, and in part."""
    rng = np.random.default_rng(12)
    noise = lambda n: " ".join(rng.choice(["alpha", "beta", "the", "of", "software", "license", "x1"], n))
    rows = []
    for i, (_, template) in enumerate(licenses.TEMPLATES * 3):
        parts = template.split()
        if i % 3 == 1:
            parts = [w for w in parts if rng.random() > 0.08]
        if i % 3 == 2:
            parts = [w if rng.random() > 0.1 else "changed" for w in parts]
        rows.append((i, f"{noise(30)} {' '.join(parts)} {noise(40)} {' '.join(parts[:len(parts) // 2])}"))
    both = licenses.TEMPLATES
    rows.append((900, " ".join(t for _, t in both)))
    rows.append((901, f"{both[0][1]} {noise(5)} {both[0][1]}"))
    rows.append((902, noise(200)))
    got = {r.doc_id: sorted((s.label, s.first, s["last"], s.coverage) for s in r.spans)
           for r in licenses.find(documents(spark, rows)).collect()}
    want = {key: plain_spans(text, licenses.K) for key, text in rows}
    assert got == want and sum(map(len, want.values())) > len(licenses.TEMPLATES)


def test_templates_that_are_not_sent(spark, monkeypatch):
    df = documents(spark, [(1, licenses.TEMPLATES[0][1]), (2, "nothing of it")])
    show = lambda: sorted((r.doc_id, str(r.spans)) for r in licenses.find(df).select("doc_id", "spans").where(
        F.col("doc_id").isNotNull()).collect())
    sent = show()
    monkeypatch.setattr(licenses, "SENT", 0)
    assert show() == sent
