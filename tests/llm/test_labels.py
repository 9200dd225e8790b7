from __future__ import annotations

import numpy as np
import pytest

from stagewise.llm import language, quality, toxicity
from stagewise.llm.queries import QUERIES

from .conftest import ODD_ROWS, words

SMALL = "/root/testdata/sf0.01"


def test_grammar_classes():
    lexicon = {"fool": 3.0, "rott*": 2.0}
    at = {c: i for i, c in enumerate(toxicity.CLASSES)}

    def classes(text):
        x = toxicity.features(text, lexicon)
        return {c for c, i in at.items() if x[i]}

    assert classes("what a fool") == {"insult"}
    assert classes("you absolute fool") == {"targeted"}
    assert classes("that is not a fool") == {"negated"}
    assert classes("he said fool") == {"reported"}
    assert classes("he wrote “fool. fool” then") == {"reported"}
    assert classes("not now. fool") == {"insult"}
    assert classes("rottener") == {"insult"} and classes("rott") == set()
    assert classes("i will kill it") == {"threat"} and classes("they kill") == {"targeted_threat"}
    assert not toxicity.features("", lexicon).any()


def test_toxicity_of_odd_rows_and_no_labels(documents, shipped):
    labels = shipped.createDataFrame([], "doc_id long, quality int, toxic int")
    got = toxicity.score_documents(documents(ODD_ROWS), labels).collect()
    assert len(got) == len(ODD_ROWS) and all(r.score == 0.0 and r.predicted == 0 for r in got)
    assert toxicity.score_documents(documents([]), labels).collect() == []


def test_toxicity_learns_and_ignores_contradictions(documents, shipped):
    rows, labels = [], []
    for i in range(400):
        bad = i % 4 == 0
        rows.append((i, " ".join(words(i, 30) + (["grumblewort"] if bad else []) + words(5000 + i, 5))))
        labels.append((i, 1, int(bad)))
    labels += [(1, 1, 1), (None, 1, 1), (2, 1, None), (3, 0, 0)]
    frame, table = documents(rows + [(900, None), (901, "")]), shipped.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.score_documents(frame, table).collect()}
    assert all(got[i].predicted == int(i % 4 == 0) for i in range(400))
    assert got[900].score == got[901].score < 0.5 and 0 <= got[900].score
    assert 40 < sum(r.held_out for r in got.values()) < 120


def test_toxicity_held_out(shipped):
    frame = QUERIES["op4_grammar_toxicity"](shipped, "/root/testdata/sf0.1")
    labels = shipped.read.parquet("/root/testdata/sf0.1/labels.parquet").select("doc_id", "toxic")
    rows = frame.filter("held_out").join(labels, "doc_id").collect()
    hit = sum(r.predicted == 1 and r.toxic == 1 for r in rows)
    assert hit >= 0.9 * sum(r.toxic for r in rows) and hit >= 0.97 * sum(r.predicted for r in rows)


def test_quality_brute_force():
    import re

    texts = [t or "" for _, t in ODD_ROWS if not t or len(t) < 1000] + [
        "a a a a a a a", "x y z\nx y z\n\nx y z\n q", "b c d e f g b c d e f h b c d e f", "# $ %a <b> é|é", " ".join(words(3, 40) * 2)]
    got = quality.measures([t.encode() for t in texts])
    for i, t in enumerate(texts):
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        grams = [tuple(w[j : j + 5]) for j in range(len(w) - 4)]
        repeated = {j + k for j, g in enumerate(grams) if grams.count(g) > 1 for k in range(5)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(repeated), len(lines))
        assert tuple(int(got[m][i]) for m in quality.MEASURES) == want, t


def test_quality_hosts(documents):
    good, bad = " ".join(words(1, 30)), "too short"
    rows = [(i, bad if i % 10 else good, "en", "badhost") for i in range(100)]
    rows += [(200 + i, good, "en", f"h{i % 8}") for i in range(200)] + [(500, good, "en", None), (501, None, "en", None), (502, bad, "en", "lone")]
    got = {r.doc_id: r for r in quality.quality(documents(rows)).collect()}
    assert len(got) == len(rows)
    assert not got[0].kept and not got[0].base_failed  # a clean text of a bad host
    assert got[200].kept and got[500].kept and got[501].base_failed and not got[502].kept
    assert quality.quality(documents([])).collect() == []


def test_language_of_odd_rows(documents):
    rows = ODD_ROWS + [(30, "123 !!"), (31, "???")] + [(100 + i, "the of and with this " * 5, "en") for i in range(40)]
    rows += [(200 + i, "der die das und nicht " * 5, "de") for i in range(40)] + [(300, "der und das", None), (301, "ohne", None)]
    got = language.identify(documents(rows)).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(rows)
    assert all(by[i].lang_pred == "und" and by[i].score == 0.0 for i in (1, 2, 3, 30, 31))
    assert by[300].lang_pred == "de" and all(0 <= r.score <= 1 for r in got)
    assert by[150 - 45].lang_pred == "en" and by[210].lang_pred == "de"
    assert language.identify(documents([])).collect() == []
    untaught = language.identify(documents([(1, "word", None)])).collect()
    assert [r.lang_pred for r in untaught] == ["und"]


def test_language_held_out(shipped):
    rows = QUERIES["op10_centroid_language"](shipped, SMALL).join(
        shipped.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "lang"), "doc_id").filter("held_out AND lang IS NOT NULL").collect()
    assert np.mean([r.lang == r.lang_pred for r in rows]) >= 0.98


@pytest.mark.parametrize("texts", [["a"], ["ab", "", "ABC d"], ["éa b", " x"]])
def test_counts_do_not_cross_texts(texts):
    together, alone = language.counts(texts), [language.counts([t])[0] for t in texts]
    assert all((a == b).all() for a, b in zip(together, alone))


def test_a_host_is_judged_against_what_is_usual(documents):
    """Four times the usual rate is rejected on many texts and not on few; where all are alike none is."""
    good, bad = " ".join(words(1, 30)), "too short"
    text = lambda i, every: bad if i % every == 0 else good
    rows = [(i, text(i, 17), "en", f"h{i % 20}") for i in range(3000)]
    rows += [(10_000 + i, text(i, 3), "en", "spam") for i in range(300)] + [(20_000 + i, text(i, 3), "en", "small") for i in range(6)]
    kept = lambda rows: {r.doc_id for r in quality.quality(documents(rows)).collect() if r.kept}
    got = kept(rows)
    assert not any(i in got for i in range(10_000, 10_300)) and {20_001, 20_002, 20_004} <= got
    assert {i for i in range(3000) if i % 17} <= got
    alike = [(i, text(i // 8, 2), "en", f"h{i % 8}") for i in range(800)]
    assert kept(alike) == {i for i in range(800) if (i // 8) % 2}
