from __future__ import annotations

import numpy as np

import corpus_pipeline as pipeline
from stagewise.llm import decontam, minhash, secrets, toxicity
from stagewise.llm.common import Scratch
from stagewise.llm.queries import tokenizer_file

from .conftest import ODD_ROWS, words
from .test_minhash import brute


def corpus():
    item = words(1, 40)
    rows = [(i, " ".join(words(1000 + i, 40))) for i in range(300)]
    rows += [(400 + i, " ".join([*words(2000 + i, 30), "grumblewort", *words(3000 + i, 3)])) for i in range(120)]
    rows += [(600 + i, " ".join([*words(1000 + i, 40)[:-1], f"end{i}"])) for i in range(40)]  # near copies of 0..39
    rows += [(700 + i, " ".join(words(4000 + i, 30) + item)) for i in range(10)]
    rows += [(800 + i, " ".join([*words(5000 + i, 20), f"password=abc{i}defgh", "end"])) for i in range(10)]
    return [*rows, *((9000 + (i or 0), t) for i, t in ODD_ROWS[:3]), (None, "no id here at all")], " ".join(item)


def test_every_stage_against_brute_force(documents, shipped, tmp_path):
    rows, item = corpus()
    documents(rows).write.parquet(f"{tmp_path}/documents.parquet")
    shipped.createDataFrame([(i, 1, int(400 <= i < 520)) for i in range(520) if i < 300 or i >= 400],
                            "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    shipped.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    scratch, docs = Scratch(shipped, "test"), shipped.read.parquet(f"{tmp_path}/documents.parquet")
    columns, kept = docs.columns, dict(rows)
    for name, stage in pipeline.STAGES:
        before = docs
        docs = scratch.write(stage(shipped, docs, str(tmp_path)), name)
        if name == "toxicity":
            model = toxicity.train(before, shipped.read.parquet(f"{tmp_path}/labels.parquet"))
            kept = {i: t for i, t in kept.items() if not (400 <= (i or 0) < 520)}
            assert model.trained
        elif name == "near_duplicates":
            same = brute([(i, t) for i, t in kept.items() if i is not None])
            kept = {i: t for i, t in kept.items() if i is None or same[i][2]}
            assert not any(600 <= (i or 0) < 640 for i in kept)
        elif name == "decontamination":
            worst = decontam.worst_items([t or "" for t in kept.values()], decontam.build_index([(1, item)]))
            kept = {i: t for (i, t), (c, _) in zip(kept.items(), worst) if c < decontam.COVERAGE}
            assert not any(700 <= (i or 0) < 710 for i in kept)
        elif name == "secrets":
            scanner = secrets.Scanner(secrets.fit(before))
            kept = {i: None if t is None else secrets.redact(t, scanner.spans(t)) for i, t in kept.items()}
            assert all(secrets.MASK in kept[800 + i] and "password" not in kept[800 + i] for i in range(10))
            assert all(r.n_chars == len(r.text) for r in docs.collect() if r.text is not None)
        if name != "packing":
            assert docs.columns == columns
            assert {r.doc_id: r.text for r in docs.collect()} == kept
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_file())
    packed = {}
    for r in sorted(docs.collect(), key=lambda r: r.piece):
        packed[r.doc_id] = packed.get(r.doc_id, b"") + bytes(r.ids)
    assert packed == {i: np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4").tobytes() for i, t in kept.items()}
    whole = {(r.doc_id, r.piece, r.length) for r in pipeline.run(shipped, str(tmp_path)).collect()}
    assert whole == {(r.doc_id, r.piece, r.length) for r in docs.collect()}


def test_empty_documents(documents, shipped, tmp_path):
    documents([]).write.parquet(f"{tmp_path}/documents.parquet")
    shipped.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    shipped.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert pipeline.run(shipped, str(tmp_path)).collect() == []


def test_repeated_rows_leave_one(documents, shipped):
    rows = [(1, "p q r s t u"), (1, "p q r s t u"), (2, "P q r s t u"), (3, "other words in here now")]
    got = pipeline.drop_near_duplicates(shipped, documents(rows), "").collect()
    assert sorted((r.doc_id, r.text) for r in got) == [(1, "p q r s t u"), (3, "other words in here now")]
    assert minhash.WORDS == 5


def test_unlike_rows_of_one_id_stay(documents, shipped):
    a, b = "p q r s t u", "some other clean text in here"
    rows = [(1, a), (7, None), (7, b), (7, "P q r s t u"), (8, b), (8, "a third text that is clean too"), (9, ""), (9, ""), (9, None), (None, a), (None, a)]
    got = pipeline.drop_near_duplicates(shipped, documents(rows), "").collect()
    want = [(1, a), (7, None), (7, b), (8, "a third text that is clean too"), (9, ""), (9, None), (None, a), (None, a)]
    assert sorted(((r.doc_id, r.text) for r in got), key=repr) == sorted(want, key=repr)
